"""A fact table that is brought up to date by what changed.

For each client there are batches of parsed messages and versions of a manifest, which names every
unit (a file, or files that belong together) with what it looked like (paths, sizes, times) and the
batch that holds its messages. An update lists the client's folders, anti-joins the units with the
last manifest, parses the new and changed ones only, writes their messages as one batch and then
the next manifest. Readers join batches with the last manifest, so messages of changed and vanished
units are gone with it.

A manifest counts once it is whole, so an update that is lost at any point changes nothing; the
next one writes the same batch again. What neither the last manifest nor the one before names is
removed after an update; ``compact`` rewrites a client's batches as one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import once
from . import listing
from .files import MESSAGE_COLUMNS, Config, children, existing
from .logs import READS, SOURCES

MANIFEST = "unit string, looks string, batch string, files long, bytes long"


@dataclass(frozen=True)
class Report:
    """Units and bytes of an update."""

    client: str
    units: int
    parsed: int
    removed: int
    parsed_bytes: int


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def next_batch(versions: list[str]) -> str:
    return f"b{int(versions[-1].rpartition('/v')[2]) + 1 if versions else 1:08d}"


class Facts:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self, client: str) -> list[str]:
        """Folders of whole manifests, oldest first."""
        found = children(self.spark, f"{self.path}/manifests/client={client}")
        return [v for v in found if existing(self.spark, [f"{v}/_SUCCESS"])]

    def manifest(self, client: str, version: str | None = None) -> DataFrame:
        """unit, looks, batch, files and bytes of the client's units, as of the last update."""
        if version is None:
            found = self.versions(client)
            if not found:
                return self.spark.createDataFrame([], MANIFEST)
            version = found[-1]
        return self.spark.read.schema(MANIFEST).parquet(version)

    def files(self, client: str, config: Config) -> DataFrame:
        """file and unit of all that the client's source would read, with size and time."""
        reads = READS[client]
        roots, out = reads.roots(self.spark, config), None
        for glob in reads.globs:
            found = listing.files(self.spark, roots, glob, reads.recursive).withColumn("unit", reads.unit(F.col("file")))
            out = found if out is None else out.unionByName(found)
        return out

    def update(self, config: Config, clients: list[str] | None = None) -> list[Report]:
        chosen = [c for c in SOURCES if clients is None or c in clients]
        if not chosen:
            raise ValueError(f"no such clients: {clients}")
        return [self.updated(c, config) for c in chosen]

    def updated(self, client: str, config: Config) -> Report:
        files = once(self.files(client, config))
        look = F.concat_ws(":", "root_ord", "file", "size", "mtime_ns")
        now = files.groupBy("unit").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(look)), "\n"), 256).alias("looks"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
        known = self.versions(client)
        before = self.manifest(client)
        state = once(now.join(before.select("unit", F.col("looks").alias("had"), "batch"), "unit", "left").withColumn("same", F.coalesce(F.col("looks") == F.col("had"), F.lit(False))))
        units, parsed, size = state.agg(F.count(F.lit(1)), F.count_if(~F.col("same")), F.sum(F.when(~F.col("same"), F.col("bytes")))).first()
        gone = before.join(state, "unit", "left_anti").count()
        report = Report(client, units, parsed, gone, size or 0)
        if known and not parsed and not gone:
            return report
        batch = next_batch(known)
        if parsed:
            only = files.join(state.filter("NOT same").select("unit"), "unit", "left_semi")
            rows = SOURCES[client](self.spark, replace(config, only=only))
            rows.select(self.unit(client).alias("unit"), *[c for c in MESSAGE_COLUMNS if c != "client"]).write.mode("overwrite").parquet(f"{self.path}/facts/client={client}/batch={batch}")
        self.commit(client, state.select("unit", "looks", F.when(F.col("same"), F.col("batch")).otherwise(batch).alias("batch"), "files", "bytes"), batch)
        return report

    def unit(self, client: str) -> Column:
        return READS[client].unit(F.replace("ord.path_key", F.lit("\0"), F.lit("/")))

    def commit(self, client: str, manifest: DataFrame, batch: str) -> None:
        """The manifest becomes the last one; what only older ones name is removed."""
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifests/client={client}/v{batch[1:]}")
        *older, last = self.versions(client)
        named = {r.batch for v in [*older[-1:], last] for r in self.manifest(client, v).select("batch").distinct().collect()}  # a few batches
        for folder in children(self.spark, f"{self.path}/facts/client={client}"):
            if folder.rpartition("=")[2] not in named:
                removed(self.spark, folder)
        for folder in older[:-1]:
            removed(self.spark, folder)

    def client_rows(self, client: str) -> DataFrame | None:
        folder = f"{self.path}/facts/client={client}"
        if not children(self.spark, folder):
            return None
        rows = self.spark.read.option("basePath", folder).parquet(folder)
        return rows.join(self.manifest(client).select("unit", "batch"), ["unit", "batch"], "left_semi")

    def client_changes(self, client: str) -> DataFrame:
        """The messages that the last update brought or took away (of units that were there before, both)."""
        *older, last = self.versions(client)
        now, pair = self.manifest(client, last), ["unit", "batch"]
        before = self.manifest(client, older[-1]) if older else self.spark.createDataFrame([], MANIFEST)
        changed = now.join(before, pair, "left_anti").select(pair).unionByName(before.join(now, pair, "left_anti").select(pair))
        folder = f"{self.path}/facts/client={client}"
        if not children(self.spark, folder):
            return self.nothing(())
        return self.spark.read.option("basePath", folder).parquet(folder).join(changed, pair, "left_semi")

    def read(self, clients: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """The messages of all units that are there. ``keep``: unit, batch or both."""
        out = None
        for client in SOURCES:
            if clients is not None and client not in clients:
                continue
            if (rows := self.client_rows(client)) is not None:
                rows = rows.withColumn("client", F.lit(client)).select(*MESSAGE_COLUMNS, *keep)
                out = rows if out is None else out.unionByName(rows)
        return self.nothing(keep) if out is None else out

    def nothing(self, keep: tuple[str, ...]) -> DataFrame:
        made = SOURCES["claude"](self.spark, Config(home=f"{self.path}/none"))
        return made.select(*MESSAGE_COLUMNS, *[F.lit(None).cast("string").alias(k) for k in keep]).limit(0)

    def compact(self, client: str) -> None:
        """Rewrites the client's messages as one batch."""
        known, rows = self.versions(client), self.client_rows(client)
        if not known or rows is None:
            return
        batch = next_batch(known)
        rows.drop("batch").write.mode("overwrite").parquet(f"{self.path}/facts/client={client}/batch={batch}")
        self.commit(client, self.manifest(client).withColumn("batch", F.lit(batch)), batch)
