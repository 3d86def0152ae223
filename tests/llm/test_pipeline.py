"""The pipeline against plain Python on the smallest tables, stage by stage."""

import hashlib
import os
import re

import pytest

import corpus_pipeline
from helpers import AWKWARD, docs
from meterglass.llm import queries, toxicity
from test_mixing import brute as mix
from test_simhash import closed, plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def letters(text):
    return " " + re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (text or "").translate({c: c + 32 for c in range(65, 91)})).strip() + " "


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = chain.scorer()
    rows = [r for r in docs.collect() if score(r["text"])[1] < chain.threshold(1)]
    keep = {}
    for r in rows:
        h = hashlib.sha256((r["text"] or "").encode()).digest()
        keep[h] = max(keep.get(h, -1), r["doc_id"])
    rows = [r for r in rows if r["doc_id"] in set(keep.values())]
    ids = [r["doc_id"] for r in rows]
    root = closed(ids, [plain(r["text"]) for r in rows])
    rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    items = [letters(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in letters(r["text"]) for i in items)]
    taken, *_ = mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows])
    out = corpus_pipeline.run(spark, SF)
    got = {r["doc_id"]: r["taken"] for r in out.collect()}
    assert got == {x[0]: x[4] for x in taken if x[4]}
    assert set(docs.columns) <= set(out.columns)


def test_run_on_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, and columns named like those that stages add."""
    item = "seven wizards quietly boil pots of vivid jade soup near the old harbour while a brown fox looks on"
    rows = [*AWKWARD, (20, f"before {item} after"), (21, "a text with words enough to be no near copy of any other one"), (22, "a text with words enough to be no near copy of any other one"), (None, "a row without any id"), (None, "a row without any id")]

    def written(name, docs_):
        folder = str(tmp_path / name)
        docs_.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        return folder

    out = corpus_pipeline.run(spark, written("awkward", docs(spark, rows, extra=True)))
    got = sorted((r["doc_id"] or 0, r["text"]) for r in out.collect())
    # no labels of both values: nothing is toxic; wordless texts are near copies of each other and have no words to take
    budget = out.agg({"target": "max"}).first()[0]
    assert sum(r["taken"] for r in out.collect()) <= budget
    assert {i for i, _ in got} <= {0, 1, 4, 5, 7, 8, 22, 6, 21} and 20 not in {i for i, _ in got}
    assert (0, "a row without any id") in got and {r["found"] for r in out.collect()} == {"own found"}
    assert out.columns[: len(docs(spark, []).columns)] == docs(spark, []).columns
    empty = corpus_pipeline.run(spark, written("empty", docs(spark, [], extra=True)))
    assert empty.count() == 0 and "position" in empty.columns


def test_run_removes_what_stages_wrote(spark):
    from meterglass.llm import common

    own = common.fresh_path(spark, "of-the-caller")
    before, tables = len(common.SCRATCH), len(spark.catalog.listTables())
    out = corpus_pipeline.run(spark, SF)
    assert len(common.SCRATCH) == before + 1 and out.count() > 0 and (own, None) in common.SCRATCH
    assert len(spark.catalog.listTables()) == tables


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert "doc_id" in df.columns or "conv_id" in df.columns
    assert df.count() == (spark.read.parquet(f"{SF}/documents.parquet").count() if "doc_id" in df.columns else spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1)
