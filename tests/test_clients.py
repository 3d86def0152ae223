"""The logs that the clients' queries write for themselves."""

from pathlib import Path

from pyspark.sql import functions as F

from meterglass.plans import clients
from meterglass.sources import listing, sqlite


def test_tasks_write_the_files_under_their_names(spark):
    """A file a user, in the order of its lines, beside those that are there, however many: the driver renames none."""
    rows = spark.range(600).selectExpr("id % 150 AS user_id", "-id AS ord", "IF(id = 151, NULL, CAST(id AS STRING)) AS line")
    path = clients.written(rows, F.col("line"), "user_id", lambda user: f"_{int(user) % 2}/{user}.txt")
    assert clients.written(rows.filter("user_id = 1"), F.lit("x"), "user_id", "{}/b.json", path) == path
    root = Path(listing.local(path))
    found = {str(f.relative_to(root)): f.read_text() for f in root.rglob("*") if f.is_file()}
    assert found.pop("1/b.json") == "x\n" * 4
    assert len(found) == 150 and found["_0/2.txt"] == "452\n302\n152\n2\n" and found["_1/1.txt"] == "451\n301\n\n1\n"


def test_rows_of_one_database_are_dealt_over_tasks(spark, tmp_path):
    """A database is read by one task; what is made of its rows is not."""
    rows = spark.range(400).selectExpr("CAST(id AS STRING) AS id", "'s' AS session_id", "'{}' AS data")
    clients.databases(rows, "CREATE TABLE message (id TEXT PRIMARY KEY, session_id TEXT, data TEXT)", str(tmp_path), "opencode-{}.db", parts=1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = sqlite.opencode_messages(spark, [str(tmp_path)])
        assert found.count() == 400 and found.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
