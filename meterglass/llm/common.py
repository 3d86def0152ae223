"""What the operators of this package share."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that may meet in one task before the key is dealt over salts.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


#: Folders that operators have written for themselves in this session, with the tables over them.
SCRATCH: list[tuple[str, str | None]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    SCRATCH.append((path, None))
    return path


def owned(path: str, table: str) -> None:
    """Notes the table over a folder that ``fresh_path`` gave."""
    if (path, None) in SCRATCH:
        SCRATCH[SCRATCH.index((path, None))] = (path, table)


def clean(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Removes what operators have written for themselves, from number ``since`` on, but for ``keep``. Results not yet written are lost with it."""
    own, left = SCRATCH[since:], []
    del SCRATCH[since:]
    for path, name in own:
        if path == keep:
            left.append((path, name))
            continue
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    SCRATCH.extend(left)


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # the session may have ended before
        clean(SparkSession.getActiveSession())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a file in the shared folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows as a table in the shared folder, read again: cuts lineage like ``cut``, and its size is known.

    For loops: the estimated size of a checkpoint is that of the plan behind it, which joins multiply from step to step.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salt(col: Column, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def arrow_rows(batches, columns):
    """The named columns of Arrow batches as Python lists, a few MB of text at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield [part.column(c).to_pylist() for c in columns]


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return (text or "").encode("utf-8", "replace")
