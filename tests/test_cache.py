"""The cache sink: published whole or not at all."""

import json

import pytest
from pyspark.sql import functions as F

from meterglass.sources import cache, files, logs
from meterglass.sources.files import Config


def rows(spark, *ns):
    return spark.createDataFrame([(1700000000000 + n, f'm"{n}é', n, 2, 3, 0.5) for n in ns], cache.EVENT)


def read(folder):
    return json.loads((folder / "events.json").read_text())["events"]


def test_pages_to_cache_to_messages(spark, tmp_path):
    folder = tmp_path / "cache"
    cache.write_cache(spark, rows(spark, *range(50)).repartition(3), str(folder))
    assert sorted(e["input_tokens"] for e in read(folder)) == list(range(50)) and [f.name for f in folder.iterdir()] == ["events.json"]
    page = '{"usageEventsDisplay": [{"timestamp": "1700000000007", "model": "gpt-5", "tokenUsage": {"inputTokens": 5, "outputTokens": 6, "totalCents": 150}}, {"timestamp": "no"}]}'
    cache.write_cache(spark, logs.cursor_pages(spark.createDataFrame([(page,)], "value string")), f"file://{folder}")
    (folder / "usage.csv").write_text("Date,Model,Input With Cache,Input Without Cache,Cache Read,Output,Total,Cost\n2023-11-15T00:00:00Z,o3,3,2,1,4,10,Included\n")
    got = logs.cursor(spark, Config(home=str(tmp_path), roots={"cursor": [str(folder)]})).collect()
    assert [(r.model_id, r.input, r.output, r.cost, r.dedup_key) for r in got] == [("gpt-5", 5, 6, 1.5, "cursor:1700000000007:5:6")]
    cache.write_cache(spark, rows(spark), str(folder))
    assert read(folder) == [] and [r.model_id for r in logs.cursor(spark, Config(home=str(tmp_path), roots={"cursor": [str(folder)]})).collect()] == ["o3"]


def test_a_failed_job_changes_nothing(spark, tmp_path):
    cache.write_cache(spark, rows(spark, 1), str(tmp_path))
    bad = rows(spark, *range(20)).repartition(4).withColumn("cost", F.when(F.col("input_tokens") == 13, F.raise_error(F.lit("lost")).cast("double")).otherwise(0.5))
    with pytest.raises(Exception, match="lost"):
        cache.write_cache(spark, bad, str(tmp_path))
    assert [e["input_tokens"] for e in read(tmp_path)] == [1]
    assert [f.name for f in tmp_path.iterdir()] == ["events.json"]
    with pytest.raises(Exception, match="overwrite"):
        spark.dataSource.register(cache.UsageCache)
        rows(spark, 2).write.format("usage_cache").option("path", str(tmp_path)).mode("append").save()


def test_a_large_cache_is_read_by_ranges(spark, tmp_path, monkeypatch):
    """The same messages as by one task; a cache that isn't whole, or of another form, is read as one document."""
    config = Config(home=str(tmp_path), roots={"cursor": [str(tmp_path)]})
    seen = lambda: sorted((r.model_id, r.timestamp_ms, r.input, r.cost, r.dedup_key) for r in logs.cursor_json(spark, config).collect())
    cache.write_cache(spark, rows(spark, *range(40)).repartition(3), str(tmp_path))
    want = seen()
    assert len(want) == 40 and len((tmp_path / "events.json").read_text().splitlines()) == 42
    monkeypatch.setattr(logs, "LARGE", 0)
    documents, whole = logs.documents, []

    def counted(*args):
        found = documents(*args)
        whole.append(found.count())
        return found

    monkeypatch.setattr(logs, "documents", counted)
    assert seen() == want and whole == [0]
    text = (tmp_path / "events.json").read_text()
    lines = text.splitlines()
    one = json.dumps(json.loads(text))
    two = "\n".join([lines[0], f"{lines[1]} {lines[2]}", *lines[3:]])
    for form, n in ((one, 40), (two, 40), (text.replace("},\n", "}\n", 1), 0), (text.replace('"model": "', '"model": 1, "m": "', 1), 0), (text.replace("\n]}", "\n]"), 0)):
        (tmp_path / "events.json").write_text(form)
        assert len(seen()) == n, form[:300]
    assert whole[1:3] == [1, 1]


def test_ranges_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"{k:09}\n" for k in range(3000)))
    found = files.lines(spark, [str(tmp_path)], "*.jsonl", size=10_000)
    assert found.rdd.getNumPartitions() == 3 and sorted(r.value for r in found.collect()) == [f"{k:09}" for k in range(3000)]
