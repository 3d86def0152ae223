"""The usage cache as a sink: tasks stage, the commit publishes.

``df.write.format("usage_cache").option("path", folder).mode("overwrite").save()`` replaces
``events.json`` in a folder by the rows (timestamp_ms, model, the three token counts, cost). Each
task writes its rows as one staged file of its own; the commit joins the staged files, in the order
of their names and a few MB at a time, to one document beside the cache and renames it, so a reader
sees the old cache or the new one. A job that fails, or a task that is run twice, leaves the cache as
it is. The cache is one account's events: one document, as its readers want it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import listing

EVENT = "timestamp_ms long, model string, input_tokens long, output_tokens long, cache_read_tokens long, cost double"
FIELDS = tuple(f.split()[0] for f in EVENT.split(", "))
NAME = "events.json"
STEP = 4 << 20
#: The first and last line: each event has a line of its own, so that a large cache is read by ranges.
HEAD, TAIL = '{"events": [', "]}"


@dataclass
class Staged(WriterCommitMessage):
    part: int
    file: str
    rows: int


class CacheWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.run = folder.rstrip("/"), uuid.uuid4().hex

    def inner(self, name: str):
        return listing.store(f"{self.folder}/{name}")

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        name = f".staged-{self.run}-{part:08d}-{uuid.uuid4().hex}"  # attempts of a task don't meet
        store, at = self.inner(name)
        store.create_dir(at.rpartition("/")[0])
        with store.open_output_stream(at) as out:
            for row in iterator:
                out.write((",\n" if n else "").encode() + json.dumps({f: row[f] for f in FIELDS}, ensure_ascii=False, allow_nan=False).encode("utf-8"))
                n += 1
        return Staged(part, name, n)

    def commit(self, messages: list[Staged]) -> None:
        full = sorted((m for m in messages if m and m.rows), key=lambda m: m.part)
        store, made = self.inner(f".made-{self.run}")
        store.create_dir(made.rpartition("/")[0])
        with store.open_output_stream(made) as out:
            out.write(f"{HEAD}\n".encode())
            for k, m in enumerate(full):
                out.write(b",\n" if k else b"")
                with store.open_input_stream(self.inner(m.file)[1]) as staged:
                    while piece := staged.read(STEP):
                        out.write(piece)
            out.write((f"\n{TAIL}" if full else TAIL).encode())
        store.move(made, self.inner(NAME)[1])
        self.clean()

    def abort(self, messages: list[Staged]) -> None:
        self.clean()

    def clean(self) -> None:
        """Removes what this run has staged, attempts that were lost included."""
        store, _ = self.inner(NAME)
        for e in listing.entries(self.folder):
            if not e.folder and self.run in e.path:
                with suppress(OSError):
                    store.delete_file(listing.store(e.path)[1])


class UsageCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "usage_cache"

    def schema(self) -> str:
        return EVENT

    def writer(self, schema, overwrite: bool) -> CacheWriter:
        if not overwrite:
            raise ValueError("a usage cache is replaced as a whole: write it with mode('overwrite')")
        return CacheWriter(self.options["path"])


def write_cache(spark: SparkSession, events: DataFrame, folder: str) -> None:
    """Replaces the folder's cache by the events, as ``logs.cursor_pages`` gives them."""
    spark.dataSource.register(UsageCache)
    events.selectExpr(*[f"CAST({f.split()[0]} AS {f.split()[1]}) AS {f.split()[0]}" for f in EVENT.split(", ")]).write.format("usage_cache").option("path", folder).mode("overwrite").save()
