"""Ranked lexical search by windowed bucket scoring over a persistent index.

The index is a Parquet table of segments. A segment numbers up to ``SEGMENT_DOCS`` documents of one
task from 0 and has, for each of its terms, one row with the numbers of the documents that hold it
and how often (postings), and one head row with their ids and lengths. Segments never change: more
documents are appended as more segments, and df, N and L are sums over all of them.

A search joins the queries' terms with the index, by broadcast while they are few (checked) and by
shuffle beyond, and sends what it finds of a segment to one task for each block of queries. There
all postings are traversed in windows of ``WINDOW`` document numbers: for each query the scores of
a window's postings are scatter-added into one array of that size, which fits a core's first cache,
a bitset of occupied buckets (the union of the terms' bitsets in that window) tells which to
harvest, and these go into the query's heap of the best k. A window whose best possible score is
below the heap's least is passed over. Tasks emit their heaps, of which the best k of a query stay.

Scores are whole numbers. N documents have at least one term, L is the number of all their terms,
df the documents that hold a term; its weight is w = floor(1000 ln((2N+2)/(2df+1))). In a document
of n terms, m = 25 + 75nN div L, and tf occurrences score w * (10^9 tf div (1000 tf + 8m)).

Defined results: null and empty texts and texts without a term aren't indexed and match nothing;
rows that repeat a doc_id are documents of their own; a null doc_id ranks behind equal scores; rows
that repeat an item_id (null included) are one item with the terms of all of them, repeats
included; an item without terms, an empty table of items or of documents gives no rows; whole texts
are read; other columns play no part.
"""

from __future__ import annotations

import heapq
import uuid
from array import array
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, cut, fresh_path

K = 10
#: Documents of a window: its scores fill 32 KB.
WINDOW = 1 << 12
#: Documents and postings of a segment, at most (a document's postings are never parted).
SEGMENT_DOCS = 1 << 16
SEGMENT_POSTINGS = 2_000_000
#: Items of a block, about.
BLOCK = 1024
#: Pairs of item and term that are sent to every task, some 40 bytes each; more are met by a shuffle.
MOST_BROADCAST = 200_000
#: Letters A-Z become lower case, what is no letter, digit or byte of a longer character a blank.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
INDEX = "segment string, term binary, df int, words long, docs binary, tfs binary"


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive parts of ``data`` as binary values, without a copy."""
    ends = np.concatenate(([0], np.cumsum(sizes * data.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


class Segment:
    """Postings of documents numbered from 0."""

    def __init__(self, name: str):
        self.name, self.codes = name, defaultdict(count().__next__)
        self.ids, self.words, self.sizes, self.found, self.tfs = [], [], [], array("I"), array("I")

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        tfs = Counter(words)
        self.ids.append(doc_id)
        self.words.append(len(words))
        self.sizes.append(len(tfs))
        self.found.extend(map(self.codes.__getitem__, tfs))
        self.tfs.extend(tfs.values())

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or len(self.found) >= SEGMENT_POSTINGS

    def rows(self):
        if not self.ids:
            return
        n, words = len(self.ids), np.array(self.words, np.uint32)
        ids = np.array([i or 0 for i in self.ids], np.int64).tobytes() + np.array([i is None for i in self.ids], np.uint8).tobytes()
        yield self.batch([b""], [n], [int(words.sum(dtype=np.int64))], pa.array([ids], pa.binary()), pa.array([words.tobytes()], pa.binary()))
        found, tfs = np.frombuffer(self.found, np.uint32), np.frombuffer(self.tfs, np.uint32)
        order = np.argsort(found, kind="stable")
        docs, tfs, dfs = np.repeat(np.arange(n, dtype=np.uint16), self.sizes)[order], tfs[order], np.bincount(found)
        names, starts = np.array(list(self.codes), object), np.concatenate(([0], np.cumsum(dfs)[:-1]))
        narrow = np.maximum.reduceat(tfs, starts) < 256
        for kind, rows in ((np.uint8, np.flatnonzero(narrow)), (np.uint32, np.flatnonzero(~narrow))):
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                own = np.zeros(len(dfs), bool)
                own[part] = True
                keep = np.repeat(own, dfs)
                yield self.batch(names[part].tolist(), dfs[part], [None] * len(part), binaries(docs[keep], dfs[part]), binaries(tfs[keep].astype(kind), dfs[part]))

    def batch(self, names, dfs, words, docs, tfs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.name] * len(names)), pa.array(names, pa.binary()), pa.array(dfs, pa.int32()), pa.array(words, pa.int64()), docs, tfs], names=["segment", "term", "df", "words", "docs", "tfs"])


def postings(docs: DataFrame, batch: str) -> DataFrame:
    """The rows of an index; ``batch`` keeps its segments' names apart from other batches'."""

    def run(batches):
        names = (f"{batch}/{TaskContext.get().partitionId()}/{k}" for k in count())
        segment = Segment(next(names))
        for ids, texts in arrow_rows(batches, ("doc_id", "text")):
            for doc_id, text in zip(ids, texts):
                if words := terms(as_bytes(text)):
                    segment.add(doc_id, words)
                if segment.full():
                    yield from segment.rows()
                    segment = Segment(next(names))
        yield from segment.rows()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


class Index:
    """A lexical index at ``path`` in shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, docs: DataFrame, batch: str | None = None) -> Index:
        """Adds the documents. A job that fails adds nothing; its next run gives the same segments."""
        postings(docs, batch or uuid.uuid4().hex).write.mode("append").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(self.path)

    def search(self, items: DataFrame, k: int = K) -> DataFrame:
        """item_id, rank, doc_id, score: each item's best ``k`` documents with a score above 0."""
        return ranked(self.read(), items, k)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times."""

    def run(batches):
        for ids, texts in arrow_rows(batches, ("item_id", "text")):
            found = [(i, t, n) for i, text in zip(ids, texts) for t, n in Counter(terms(as_bytes(text))).items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.int64())], names=["item_id", "term", "times"])

    pairs = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term binary, times long")
    return pairs.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Best:
    """The best ``k`` documents of each item, in heaps."""

    def __init__(self, k: int):
        self.k, self.heaps = k, defaultdict(list)

    def least(self, item) -> int:
        """A score that a document must reach to be kept."""
        heap = self.heaps[item]
        return heap[0][0] if len(heap) == self.k else 1

    def take(self, item, scores: np.ndarray, ids: list[int | None]) -> None:
        heap = self.heaps[item]
        for score, doc_id in zip(scores.tolist(), ids):
            entry = (score, doc_id is not None, -(doc_id or 0))  # greater is better
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def rows(self) -> pa.RecordBatch:
        found = [(item, -least if known else None, score) for item, heap in self.heaps.items() for score, known, least in heap]
        return pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], names=["item_id", "doc_id", "score"])


class Traversal:
    """One segment's postings of one block's terms, gone through window by window."""

    def __init__(self, head: tuple, n_docs: int, n_terms: int):
        docs, words = head
        n = len(words) // 4
        self.ids, self.unknown = np.frombuffer(docs, np.int64, n), np.frombuffer(docs, np.uint8, n, 8 * n)
        self.length_norm = 25 + 75 * np.frombuffer(words, np.uint32).astype(np.int64) * n_docs // n_terms
        self.windows = range(0, n, WINDOW)
        self.lists: list[list[tuple]] = [[] for _ in self.windows]  # by window: (term's place, buckets, scores, greatest score, occupancy)
        self.items: dict = defaultdict(dict)

    def add(self, place: int, weight: int, docs: bytes, tfs: bytes, items) -> None:
        if weight <= 0:
            return
        at = np.frombuffer(docs, np.uint16)
        tf = np.frombuffer(tfs, np.uint8 if len(tfs) == len(at) else np.uint32).astype(np.int64)
        scores = weight * (10**9 * tf // (1000 * tf + 8 * self.length_norm[at]))
        edges = np.searchsorted(at, [*self.windows, 1 << 16])
        for w, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                buckets = at[a:b] - self.windows[w]
                occupied = np.zeros(WINDOW, bool)
                occupied[buckets] = True
                self.lists[w].append((place, buckets, scores[a:b], int(scores[a:b].max()), np.packbits(occupied)))
        for item in items:
            self.items[item["item_id"]][place] = item["times"]

    def harvest(self, best: Best) -> None:
        bucket = np.zeros(WINDOW, np.int64)
        for start, lists in zip(self.windows, self.lists):
            here = {entry[0]: entry for entry in lists}
            for item, times in self.items.items():
                own = [(here[p], n) for p, n in times.items() if p in here]
                if sum(n * most for (_, _, _, most, _), n in own) < best.least(item):
                    continue
                occupancy = np.zeros(WINDOW // 8, np.uint8)
                for (_, buckets, scores, _, occupied), n in own:
                    bucket[buckets] += scores if n == 1 else scores * n
                    occupancy |= occupied
                touched = np.flatnonzero(np.unpackbits(occupancy))
                scores = bucket[touched]
                bucket[touched] = 0
                good = scores >= best.least(item)
                touched, scores = touched[good], scores[good]
                if len(scores) > best.k:  # all that reach the k-th best, ties included
                    good = scores >= np.partition(scores, -best.k)[-best.k]
                    touched, scores = touched[good], scores[good]
                at = start + touched
                best.take(item, scores, [None if u else i for i, u in zip(self.ids[at].tolist(), self.unknown[at])])


def ranked(index: DataFrame, items: DataFrame, k: int = K, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    pairs = cut(query_terms(items))
    n_pairs, n_items = pairs.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).first()
    n_docs, n_terms = (x or 0 for x in index.filter(F.col("term") == F.lit(b"")).agg(F.sum("df"), F.sum("words")).first())
    few = F.broadcast if n_pairs <= most_broadcast else lambda df: df
    dfs = index.select("term", "df").join(few(pairs.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("n") + 1))).cast("long")
    n_blocks = -(-n_items // BLOCK) or 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int")
    asked = pairs.withColumn("block", block).groupBy("term", "block").agg(F.collect_list(F.struct("item_id", "times")).alias("items"))
    asked = cut(asked.join(dfs.select("term", weight.alias("weight")), "term"))
    found = index.join(few(asked), "term").select("segment", "block", "weight", "docs", "tfs", "items")
    heads = index.filter(F.col("term") == F.lit(b"")).select("segment", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(-1).cast("long").alias("weight"), "docs", "tfs", F.expr("CAST(NULL AS array<struct<item_id:bigint,times:bigint>>)").alias("items"))

    def score(batches):
        """Groups stream by, the segment's head first; the heaps are kept for all of them."""
        best, group, traversal = Best(k), None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("segment", "block", "weight", "docs", "tfs", "items")]
            for at in range(batch.num_rows):
                segment, block, weight, docs, tfs, own = (c[at].as_py() for c in columns)
                if group != (segment, block):
                    if traversal:
                        traversal.harvest(best)
                    group, traversal, place = (segment, block), Traversal((docs, tfs), n_docs, n_terms), -1
                else:
                    place += 1
                    traversal.add(place, weight, docs, tfs, own)
        if traversal:
            traversal.harvest(best)
        yield best.rows()

    rows = heads.unionByName(found).repartition("segment", "block").sortWithinPartitions("segment", "block", "weight")
    heaps = rows.mapInArrow(score, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def best_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Each item's best documents, through an index of this job's own."""
    index = Index(docs.sparkSession, fresh_path(docs.sparkSession, "lexical")).append(docs)
    return index.search(items, k)
