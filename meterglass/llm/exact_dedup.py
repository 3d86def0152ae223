"""Exact duplicates against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of new rows is reduced to
one row per digest, sort-merge anti-joined with the index (whose buckets need no shuffle) and
what is new is appended. A digest that the index has wins over any new row; among equal new
texts the row with the largest ``doc_id`` stays.

Batches have names. Rows that a batch has appended don't count against the same batch, and what
it has appended is not appended again: a batch that is run again, after a failure at any point,
gives the same rows and the same index.

Defined results: a null text counts as empty, and all empty texts are one group; rows that
repeat a ``doc_id`` with the same text count as one document (``group_size`` counts rows of the
batch); a null ``doc_id`` is smaller than any other; ``keep_id`` is the row that stays, of an
earlier batch if that had the text; an empty table gives an empty result; columns beyond
``doc_id`` and ``text`` play no part, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, owned, salt


def digests(docs: DataFrame, normalize=lambda text: text) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text, lowercase hex) and the row's salt."""
    text = F.coalesce(normalize(F.col("text")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("digest"), salt(F.col("doc_id")).alias("salt"))


def groups(keyed: DataFrame) -> DataFrame:
    """One row per digest: its keeper, its size and the salts that it has rows in.

    A digest that a third of the rows share is counted salt by salt first, and its rows are later
    joined salt by salt, so no task sees more than a salt's share of it.
    """
    by_salt = keyed.groupBy("digest", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    return by_salt.groupBy("digest").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))


#: Digests of a bucket, about, in an index that is sized by its first batch.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: int) -> int:
    return max(16, -(-rows // BUCKET_ROWS))


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far, at ``path`` in shared storage.

    The number of buckets holds for the life of the index: choose it by the digests to come, about
    ``BUCKET_ROWS`` a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, name: str | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or "digest_index_" + "".join(c if c.isalnum() else "_" for c in path)[-80:]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def known(self, batch: str | None) -> DataFrame:
        """Digests of other batches, with the rows that stay."""
        rows = self.read() if batch is None else self.read().filter(F.col("batch") != batch)
        return rows.select("digest", F.col("keep_id").alias("held_id")).hint("merge")

    def new(self, by_digest: DataFrame, batch: str | None = None) -> DataFrame:
        """The digests that no other batch has: a sort-merge anti-join on the buckets."""
        return by_digest.join(self.known(batch), "digest", "left_anti")

    def append(self, by_digest: DataFrame, batch: str) -> None:
        """Appends what this batch hasn't appended yet; each bucket's rows come from one task, so each append adds a file a bucket."""
        done = self.read().filter(F.col("batch") == batch).select("digest").hint("merge")
        rows = by_digest.join(done, "digest", "left_anti").select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )

    def take(self, by_digest: DataFrame, batch: str) -> DataFrame:
        """Adds the batch's new digests; returns, for all of its digests, the row that stays and whether it is new."""
        fresh = cut(self.new(by_digest, batch))
        self.append(fresh, batch)
        old = by_digest.join(self.known(batch), "digest").withColumn("keep_id", F.col("held_id")).drop("held_id")
        return fresh.withColumn("fresh", F.lit(True)).unionByName(old.withColumn("fresh", F.lit(False)))

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """One row per document of the batch, and the batch's new digests go into the index.

        ``kept`` is true for the one document of each digest that is new to the index. A batch that
        may have to be run again needs a name of its own.
        """
        keyed = digests(docs)
        return self.judged(keyed, cut(groups(keyed)), batch or uuid.uuid4().hex)

    def judged(self, keyed: DataFrame, by_digest: DataFrame, batch: str) -> DataFrame:
        dealt = self.take(by_digest, batch).select("digest", "keep_id", "group_size", "fresh", F.explode("salts").alias("salt"))
        return (
            keyed.distinct().join(dealt, ["digest", "salt"])
            .select(
                "doc_id", "keep_id", "group_size",
                (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                F.col("digest").alias("text_sha256"),
            )
        )


def new_index(spark: SparkSession, by_digest: DataFrame, buckets: int | None) -> DigestIndex:
    """An index for one job, in a folder that ``common.clean`` removes."""
    index = DigestIndex(spark, fresh_path(spark, "digests"), buckets or buckets_for(by_digest.count()))
    owned(index.path, index.name)
    return index


def exact_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every document of ``docs`` with its group, through a new index of its own."""
    keyed = digests(docs)
    by_digest = cut(groups(keyed))
    return new_index(docs.sparkSession, by_digest, buckets).judged(keyed, by_digest, "all")


def drop_exact_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat doc_id and text one stays.

    Whole rows are shuffled once, by digest and doc_id; repeats are dropped before and after it.
    """
    def key(digest, doc_id):
        return F.concat(digest, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))

    by_digest = cut(groups(digests(docs)))
    index = new_index(docs.sparkSession, by_digest, buckets)
    index.take(by_digest, "all")
    winners = index.read().select(key(F.col("digest"), F.col("keep_id")).alias("__mg_key"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    once = Window.partitionBy("__mg_key").orderBy("__mg_key")
    rows = docs.withColumn("__mg_key", key(F.sha2(text, 256), F.col("doc_id").cast("long"))).withColumn("__mg_n", F.row_number().over(once)).filter("__mg_n = 1")
    return rows.join(winners, "__mg_key", "left_semi").select(*docs.columns)
