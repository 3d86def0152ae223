"""SQLite files read through Spark: each file is copied to its task's folder, piece by piece, and queried there.

The write-ahead log beside a database (its path and ``-wal``) is read with it, so rows that were
committed but not yet checkpointed are there. The two are read one after the other: a checkpoint
just between them is not noticed. A file that can't be read is named in a warning of its task.
"""

from __future__ import annotations

import logging
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import closing, contextmanager, suppress
from itertools import batched
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import listing
from .files import listed

#: Rows of a database that a task holds at a time.
BATCH_ROWS = 10_000


def copied(path: str, to: Path) -> None:
    where, inner = listing.store(path)
    with where.open_input_stream(inner) as source, to.open("wb") as out:
        while piece := source.read(8 << 20):
            out.write(piece)


@contextmanager
def opened(path: str) -> Iterator[sqlite3.Connection]:
    """The database and its write-ahead log, if there is one, as copies in the task's temporary folder."""
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder) / "copy.db"
        copied(path, copy)
        with suppress(FileNotFoundError):
            copied(f"{path}-wal", Path(f"{copy}-wal"))
        with closing(sqlite3.connect(copy)) as db:
            yield db


def fits(value, kind: str):
    """Strict typing by storage class: a row with another class is skipped."""
    if kind == "string":
        return isinstance(value, str)
    if kind == "double":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, int) and (kind == "long" or -(2**31) <= value < 2**31)


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def table_rows(spark: SparkSession, roots: list[str], glob: str, read, columns: dict[str, str], only: DataFrame | None = None) -> DataFrame:
    """``read(connection)`` yields rows; those whose values fit ``columns`` come with file, root_ord, path_key, block, pos and mtime_ms."""
    fixed = {"file": "string", "root_ord": "int", "path_key": "string", "block": "long", "pos": "long", "mtime_ms": "long"}
    schema = ", ".join(f"{n} {t}" for n, t in {**fixed, **columns}.items())
    kinds = list(columns.values())

    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                try:
                    with opened(f["file"]) as db:
                        rows = (r for r in read(db) if all(fits(v, k) for v, k in zip(r, kinds)))
                        for some in batched(enumerate(rows), BATCH_ROWS):
                            cols = list(zip(*[(f["file"], f["root_ord"], f["file"].replace("/", "\0"), 0, i, f["mtime_ns"] // 1_000_000, *r) for i, r in some]))
                            yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(cols, [*fixed.values(), *kinds])], names=[*fixed, *columns])
                except (sqlite3.Error, OSError) as e:  # no such table, no database, or gone: nothing to read
                    logging.getLogger(__name__).warning("%s not read to its end: %s", f["file"], e)

    found = listed(spark, roots, glob, recursive=False, only=only)
    # a task a file, as its few rows would else be put in one; what comes of a large file is then dealt over all
    dealt = found.repartition(max(1, min(found.count(), 4 * spark.sparkContext.defaultParallelism)))
    return dealt.mapInArrow(run, schema).repartition("file", "pos")


def opencode_messages(spark: SparkSession, roots: list[str], only: DataFrame | None = None) -> DataFrame:
    def read(db):
        try:
            found = db.execute("SELECT m.id, m.session_id, m.data FROM message m LEFT JOIN session s ON s.id = m.session_id ORDER BY m.id, m.session_id")
        except sqlite3.Error:  # older files have no session table
            found = db.execute("SELECT id, session_id, data FROM message ORDER BY id, session_id")
        return ((i, s if isinstance(s, str) else "", d) for i, s, d in found)

    return table_rows(spark, roots, "{opencode.db,opencode-*.db}", read, {"id": "string", "session_id": "string", "data": "string"}, only)


#: Columns, types and what stands for those that a file lacks (None: they must be there).
HERMES = {
    "id": ("string", None), "model": ("string", None), "input_tokens": ("long", None), "output_tokens": ("long", None), "cache_read_tokens": ("long", None), "cache_write_tokens": ("long", None),
    "reasoning_tokens": ("long", "0"), "billing_provider": ("string", "''"), "started_at": ("double", "0"), "ended_at": ("double", "0"),
    "actual_cost_usd": ("double", "0"), "estimated_cost_usd": ("double", "0"), "message_count": ("int", "1"),
}


def hermes_sessions(spark: SparkSession, roots: list[str], only: DataFrame | None = None) -> DataFrame:
    def read(db):
        there = {r[1] for r in db.execute("PRAGMA table_info(sessions)")}
        picked = []
        for name, (kind, missing) in HERMES.items():
            if name in ("id", "model"):
                picked.append(name)
            elif missing is None:
                picked.append(f"COALESCE({name}, 0)")
            else:
                picked.append(f"COALESCE({name}, {missing})" if name in there else missing)
        order = "started_at, id" if "started_at" in there else "id"
        return db.execute(f"SELECT {', '.join(picked)} FROM sessions WHERE model IS NOT NULL AND TRIM(model) != '' ORDER BY {order}")

    return table_rows(spark, roots, "state.db", read, {n: t for n, (t, _) in HERMES.items()}, only)
