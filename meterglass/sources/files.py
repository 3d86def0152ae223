"""Log files as rows whose order within and between files is explicit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import models
from ..functions import time as times
from . import listing

MESSAGE_COLUMNS = ("client", "model_id", "provider_id", "timestamp_ms", "date", "input", "output", "cache_read", "cache_write", "reasoning", "cost", "messages", "dedup_key", "ord")


@dataclass(frozen=True)
class Config:
    """Where logs lie. ``roots`` replaces a client's usual folders; ``now_ms`` is the clock.

    With ``stop_at_bad_line`` a file ends before its first line that isn't UTF-8; otherwise such
    lines are left out and the rest is read. ``only`` (file) restricts what is read to some files.
    """

    home: str
    now_ms: int = 0
    data_home: str | None = None
    codex_home: str | None = None
    stop_at_bad_line: bool = False
    roots: dict[str, list[str]] = field(default_factory=dict)
    only: DataFrame | None = None

    @property
    def data(self) -> str:
        return self.data_home or f"{self.home}/.local/share"

    def of(self, client: str, *usual: str) -> list[str]:
        """The client's folders, each once, in order."""
        return list(dict.fromkeys(p.rstrip("/") for p in self.roots.get(client) or usual))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there, on whatever file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def children(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, in the order of their names; none where it isn't there."""
    if not existing(spark, [path]):
        return []
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = found.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(found)
    return sorted(f"{path}/{f.getPath().getName()}" for f in listed if f.isDirectory())


def path_key(path: Column) -> Column:
    """Paths in byte order, component by component."""
    return F.replace(path, F.lit("/"), F.lit("\u0000"))  # translate() would drop what becomes U+0000


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def folder(path: Column, up: int = 1) -> Column:
    """The name of the folder ``up`` levels above the file."""
    return F.regexp_extract(path, "([^/]*)" + "/[^/]*" * up + "$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


#: Bytes of a file that one task reads, and that it holds at a time.
RANGE, STEP = 64 << 20, 4 << 20
LINES = "file string, root_ord int, path_key string, block long, pos long, mtime_ms long, value string"


def listed(spark: SparkSession, roots: list[str], glob: str, recursive: bool = True, only: DataFrame | None = None) -> DataFrame:
    """The files to read, of those ``only`` (file) if given."""
    found = listing.files(spark, roots, glob, recursive)
    return found if only is None else found.join(only.select("file").distinct(), "file", "left_semi")


def valid(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def line_batches(read: Callable[[int, int], bytes], start: int, end: int, size: int, stop: bool) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(places, texts) of the lines that start within [start, end), a few MB at a time; ``read(a, b)`` gives bytes a..b.

    A carriage return before the newline is left out, and so are lines that aren't UTF-8; with
    ``stop`` all after such a line, too.
    """
    at, held = start, b""
    if start:  # the line that runs into the range is the one before's
        at, held = start - 1, b""
        while at < size and (cut := (piece := read(at, min(size, at + STEP))).find(b"\n")) < 0:
            at += len(piece)
            if not piece:
                return
        at += cut + 1 if at < size else 0
    pos = at
    while at < end:
        piece = read(pos, min(size, pos + STEP)) if pos < size else b""
        pos += len(piece)
        held += piece
        cut = held.rfind(b"\n") + 1 if piece else len(held)
        if not cut and piece:
            continue
        whole, held = held[:cut], held[cut:]
        if not whole:
            return
        data = np.frombuffer(whole, np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate(([0], ends + 1))
        if whole[-1] == 10:
            starts = starts[:-1]
        else:
            ends = np.append(ends, len(data))
        own = starts + at < end
        starts, ends = starts[own], ends[own]
        ends = ends - ((ends > starts) & (data[np.maximum(ends, 1) - 1] == 13))
        bad = np.zeros(len(starts), bool) if valid(whole) else np.array([not valid(whole[a:b]) for a, b in zip(starts, ends)], bool)
        if stop and bad.any():
            starts, ends, bad = (x[: bad.argmax()] for x in (starts, ends, bad))
            end = at
        starts, ends = starts[~bad], ends[~bad]
        mask = np.zeros(len(data) + 1, np.int8)
        np.add.at(mask, starts, 1)
        np.add.at(mask, ends, -1)
        texts = data[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)]
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        yield starts + at, pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(texts)])
        at += cut


def opened(path: str):
    """A function that gives bytes a..b of a file, and what closes it."""
    where, inner = listing.store(path)
    handle = where.open_input_file(inner)

    def read(a: int, b: int) -> bytes:
        handle.seek(a)
        return handle.read(b - a)

    return read, handle.close


def _read(found: DataFrame, whole: bool, stop: bool = False, size: int = RANGE) -> DataFrame:
    """Rows of the listed files, ranges of ``size`` bytes dealt over tasks. A file that is gone meanwhile has none."""
    cut = F.lit(1) if whole or stop else F.greatest(F.ceil(F.col("size") / size), F.lit(1))
    n, total = found.agg(F.sum(cut), F.sum("size")).first()  # ranges: those of one large file are dealt, too
    parts = min(n or 0, max(-(-(total or 0) // size), found.sparkSession.sparkContext.defaultParallelism)) or 1
    step = F.greatest("size", F.lit(1)) if whole or stop else F.lit(size).cast("long")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), step)
    ranges = found.select("file", "root_ord", "mtime_ns", "size", F.explode(cuts).alias("start")).withColumn("end", F.least(F.col("start") + step, "size"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    read, close = opened(r["file"])
                except OSError:
                    continue
                try:
                    if whole:
                        text = read(0, r["size"])
                        each = [(np.zeros(1, np.int64), pa.array([text.decode()]))] if valid(text) else []
                    else:
                        each = line_batches(read, r["start"], r["end"], r["size"], stop)
                    for at, texts in each:
                        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), len(at))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [same(r["file"], pa.string()), same(r["root_ord"], pa.int32()), same(r["file"].replace("/", "\0"), pa.string()), same(r["start"], pa.int64()), pa.array(at, pa.int64()), same(r["mtime_ns"] // 1_000_000, pa.int64()), texts],
                            names=["file", "root_ord", "path_key", "block", "pos", "mtime_ms", "value"],
                        )
                except OSError:
                    continue
                finally:
                    close()

    return ranges.repartition(parts, "file", "start").mapInArrow(run, LINES)


def lines(spark: SparkSession, roots: list[str], glob: str, stop: bool = False, only: DataFrame | None = None, size: int = RANGE) -> DataFrame:
    """A row a line. Large files are split over tasks; (block, pos) is the order within a file.

    Lines that are no UTF-8 are dropped, and with ``stop`` all lines after them in their file, which
    one task reads then.
    """
    return _read(listed(spark, roots, glob, only=only), whole=False, stop=stop, size=size)


def documents(spark: SparkSession, roots: list[str], glob: str, only: DataFrame | None = None) -> DataFrame:
    """A row a file; none for a file that isn't UTF-8."""
    return _read(listed(spark, roots, glob, only=only), whole=True)


def parsed(rows: DataFrame) -> DataFrame:
    """Adds ``v``, the line or file as VARIANT; what is no JSON is dropped."""
    return rows.withColumn("v", J.parse(F.col("value"))).filter("v IS NOT NULL").drop("value")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds line_no, from 0 within each file, counting every line."""
    from pyspark.sql import Window

    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("block", "pos")) - 1)


def messages(rows: DataFrame, client: str, *, model: Column, provider: Column, ts: Column, input: Column, output: Column, cache_read: Column | int = 0, cache_write: Column | int = 0, reasoning: Column | int = 0, cost: Column | float = 0.0, key: Column | None = None, count: Column | int = 1, index: Column | int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the fact table's form. ``index`` orders several messages of one line."""
    col = lambda x: F.lit(x) if isinstance(x, (int, float)) else x
    ord_ = F.struct(F.lit(models.CLIENTS.index(client)).alias("client_ord"), F.col("root_ord"), F.col("path_key"), F.col("block"), F.col("pos"), col(index).cast("long").alias("index"))
    made = {"input": input, "output": output, "cache_read": cache_read, "cache_write": cache_write, "reasoning": reasoning}
    return rows.select(
        F.lit(client).alias("client"), models.normalize_model(model).alias("model_id"), provider.alias("provider_id"), ts.cast("long").alias("timestamp_ms"),
        times.local_date(ts.cast("long")).alias("date"), *[col(c).cast("long").alias(n) for n, c in made.items()], F.greatest(col(cost).cast("double"), F.lit(0.0)).alias("cost"),
        col(count).cast("int").alias("messages"), (F.lit(None).cast("string") if key is None else key).alias("dedup_key"), ord_.alias("ord"), *keep,
    )
