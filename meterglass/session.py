"""A session with the settings that the log sources need."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Settings for reading logs: UTC dates unless set otherwise, and the last of repeated JSON keys wins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "meterglass", time_zone: str = "UTC", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, "spark.sql.session.timeZone": time_zone, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, whose executors run inside the driver, may go without it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints/meterglass"


#: Folders that queries have written for themselves in this process.
SCRATCH: list[str] = []


def scratch(path: str) -> str:
    """Notes a folder that is only needed while results are made of it."""
    SCRATCH.append(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return scratch(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def clean() -> None:
    """Removes all noted folders; results that aren't written yet are lost with them. Runs when the process ends."""
    jvm = SparkContext._jvm
    while SCRATCH and jvm is not None:
        folder = jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        folder.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # the JVM may be gone before
        clean()


def once(df: DataFrame) -> DataFrame:
    """Rows that several results are made of, made once: a checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows that are dear to make, made once: as ``once``, but few bytes of disk for long repeated values."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
