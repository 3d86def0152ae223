"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at ``RADIUS`` (3) or fewer differing bits. Two blocks of 31
bits are cut out of it, so a linked pair differs in at most one bit of one of them. In a block
the anchors are the code words of the perfect Hamming(31, 26) code: every block lies within
covering radius 1 of exactly one anchor, its home. A fingerprint is copied to every anchor
within covering radius plus threshold, 1 + 1 = 2 bits (1 or 16 of 2^26), so it meets the home
of each fingerprint one bit away. At an anchor, homes are compared with all that came there on
the full 64 bits, and what is emitted are links that span the linked set, never all its pairs.

Anchors at which more than ``HOT`` fingerprints may meet are found from counts of equal blocks
before anything is copied. There homes are dealt over one set of salts and visitors over another,
and each pair of salts is a group of its own; a group keeps its homes and streams its visitors, so
a task's memory is bounded by ``HOT`` homes wherever fingerprints crowd.

Only distinct fingerprints travel; their documents are joined back salt by salt. Components are
found by alternating star contraction with salted joins. Their nodes are fingerprints; those of
rows that share a doc_id are linked, too, and the least doc_id of a component is taken last.

Defined results: a null or wordless text has fingerprint zero and links like any other; rows
that repeat a doc_id have one component, whatever their texts; rows with a null doc_id link, and
so join others, like any row, and get the component's least doc_id, or null if all its doc_ids are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, arrow_rows, as_bytes, cut, salt, stored

WORDS = 3
SEED = 42
RADIUS = 3
BLOCK = 31
#: Homes that one group may hold, and visitors that it may be sent, about.
HOT = 1 << 16
#: Crowded anchors that are sent to every task.
MOST_BROADCAST = 100_000
LOW = (1 << BLOCK) - 1
#: Bits of a block whose places (from 1) have bit j set: a word's syndrome is the parity of each.
CHECKS = tuple(sum(1 << (i - 1) for i in range(1, BLOCK + 1) if i >> j & 1) for j in range(5))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    found = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not found:
        return 0
    whole = b" ".join(found)
    ends = list(accumulate((len(w) + 1 for w in found), initial=0))
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = np.array([digest(whole, SEED)], np.uint64)
    else:
        hashes = np.fromiter((digest(whole[a : b - 1], SEED) for a, b in zip(ends, ends[words:])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for ids, texts in arrow_rows(batches, ("doc_id", "text")):
            fps = np.array([fingerprint(as_bytes(t), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def homes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block's anchor and its syndrome (0: it is an anchor itself)."""
    syndrome = np.zeros(len(block), np.uint64)
    for j, mask in enumerate(CHECKS):
        syndrome |= (np.bitwise_count(block & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1)), np.uint64(0))
    return block ^ flip, syndrome


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor (with the block's number above its bits), row of ``fps``, and whether it is the home."""
    out = []
    rows = np.arange(len(fps))
    for k in range(2):
        block = (fps >> np.uint64(BLOCK * k)) & np.uint64(LOW)
        home, syndrome = homes(block)
        tag = np.uint64(k) << np.uint64(BLOCK)
        out.append((home | tag, rows, np.ones(len(fps), bool)))
        for i in range(1, BLOCK + 1):
            j = syndrome ^ np.uint64(i)
            own = (syndrome > 0) & (j > i)  # bits i < j whose places sum to the syndrome
            flipped = block[own] ^ (np.uint64(1) << np.uint64(i - 1)) ^ (np.uint64(1) << (j[own] - np.uint64(1)))
            out.append((flipped | tag, rows[own], np.zeros(int(own.sum()), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


class Span:
    """Links that span whatever is within ``radius`` of a common home: one a row that has a near home, and fewer than one a home."""

    def __init__(self, home_fp: np.ndarray, home_id: np.ndarray, radius: int = RADIUS):
        self.fp, self.id, self.radius = home_fp, home_id, radius
        self.root = np.arange(len(home_fp))  # of each home: the least home that it is known to be linked with

    def links(self, all_fp: np.ndarray, all_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some rows with the homes and, through them, of the homes with each other."""
        left, right, none, root = [], [], len(self.fp), self.root
        step = max(1, 2_000_000 // max(1, none))
        for at in range(0, len(all_fp), step):
            fp, ids = all_fp[at : at + step], all_id[at : at + step]
            near = np.bitwise_count(self.fp[:, None] ^ fp[None, :]) <= self.radius
            best = np.where(near, root[:, None], none).min(0)
            hit = best < none
            left.append(ids[hit])
            right.append(self.id[best[hit]])
            # all homes near a row are linked with its best one: join their roots until none differ
            home, row = np.nonzero(near & (root[:, None] != best[None, :]))
            high, low = root[home], best[row]
            while len(high):
                pairs = np.unique(np.maximum(high, low) * none + np.minimum(high, low))
                high, low = pairs // none, pairs % none
                moved, first = np.unique(high, return_index=True)  # each root moves once, to the least it meets
                left.append(self.id[moved])
                right.append(self.id[low[first]])
                root[moved] = low[first]
                while ((jumped := root[root]) != root).any():
                    root = jumped
                high, low = root[high], root[low]
                high, low = high[high != low], low[high != low]
        self.root = root
        return np.concatenate(left), np.concatenate(right)


def spanning_links(home_fp, home_id, all_fp, all_id, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    return Span(home_fp, home_id, radius).links(all_fp, all_id)


def crowded(nodes: DataFrame, most: int = HOT) -> DataFrame:
    """anchor, home_salts, visitor_salts: the anchors at which more than ``most`` rows may meet, of which there are few.

    An anchor has rows of at most 497 blocks (those within two bits of it); blocks with few rows
    can't crowd it, so only blocks with more than a 497th of ``most`` are spread.
    """
    blocks = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", BLOCK * k).bitwiseAND(F.lit(LOW)).alias("block")) for k in range(2)])).alias("b"))
    many = blocks.groupBy("b.k", "b.block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most // 497)

    def spread(batches):
        for batch in batches:
            k, block, n = (batch.column(c).to_numpy() for c in ("k", "block", "n"))
            fps = block.view(np.uint64) << (k.astype(np.uint64) * np.uint64(BLOCK))
            anchor, row, home = anchors(fps)
            own = (anchor >> np.uint64(BLOCK)) == k[row].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[own].view(np.int64)), pa.array(n[row][own]), pa.array(np.where(home[own], n[row][own], 0))], names=["anchor", "n", "homes"])

    sums = many.mapInArrow(spread, "anchor long, n long, homes long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("homes").alias("homes")).filter(F.col("n") > most)
    salts = [F.floor(F.col(c) / most + 1).cast("int") for c in ("homes", "n")]
    return sums.select("anchor", salts[0].alias("home_salts"), salts[1].alias("visitor_salts"))


def dealt(rows: DataFrame, crowds: DataFrame) -> DataFrame:
    """Rows with the group that they are compared in. At a crowded anchor a home is held by its own salt's groups,
    once for each visitors' salt, and goes as a visitor to the others'."""
    n = crowds.count()
    if not n:
        return rows.withColumns({"h": F.lit(0), "v": F.lit(0)})
    # a row is a few bytes; more of them are met by a shuffle
    hot = rows.join(F.broadcast(crowds) if n <= MOST_BROADCAST else crowds, "anchor", "left")

    def every(n: str):
        return F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1)

    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.coalesce(F.col(n), F.lit(1))).cast("int")
    group = lambda h, v, home: F.struct(h.alias("h"), v.alias("v"), home.alias("as_home"))
    mine, guest = own("home_salts", "home"), own("visitor_salts", "visitor")
    as_home = F.transform(every("visitor_salts"), lambda v: group(mine, v, F.lit(True)))
    as_visitor = F.transform(F.filter(every("home_salts"), lambda h: ~F.col("home") | (h != mine)), lambda h: group(h, guest, F.lit(False)))
    groups = F.when(F.col("home"), F.concat(as_home, as_visitor)).otherwise(as_visitor)
    return hot.withColumn("g", F.explode(groups)).select("anchor", "g.h", "g.v", "fp", "id", F.col("g.as_home").alias("home"))


def links(nodes: DataFrame, radius: int = RADIUS, most: int = HOT) -> DataFrame:
    """u, v (u > v): links between node ids that span every linked set. ``nodes``: fp, id."""

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                fps = part.column("fp").to_numpy().view(np.uint64)
                anchor, row, home = anchors(fps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(fps.view(np.int64)[row]), pa.array(part.column("id").to_numpy()[row]), pa.array(home)],
                    names=["anchor", "fp", "id", "home"],
                )

    def compare(batches):
        """Groups stream by, homes first: a group's homes are kept until the next group, its visitors only met."""
        group, span = None, None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("anchor", "h", "v")])
            fp, ids, home = batch.column("fp").to_numpy().view(np.uint64), batch.column("id").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(keys)] if len(keys) else starts
            goes_on = group is not None and len(keys) > 0 and tuple(keys[0]) == group
            # a group matters if it has a home and another row; the first and the last may go on in other batches
            matter = home[starts] & (ends - starts > 1)
            matter[:1] |= goes_on
            matter[-1:] = True
            us, vs = [], []
            for a, b in zip(starts[matter], ends[matter]):
                n = int(home[a:b].sum())
                if tuple(keys[a]) != group:
                    group, span, held = tuple(keys[a]), None, []
                if n:  # homes come first
                    held += [(fp[a : a + n], ids[a : a + n])]
                    span = Span(*(np.concatenate(x) for x in zip(*held)), radius)
                    others = (np.concatenate(x) for x in zip(*held)) if len(held) > 1 else (fp[a : a + n], ids[a : a + n])
                    u, v = span.links(*others)
                    us.append(np.maximum(u, v)[u != v])
                    vs.append(np.minimum(u, v)[u != v])
                if b > a + n and span is not None:
                    u, v = span.links(fp[a + n : b], ids[a + n : b])
                    us.append(np.maximum(u, v)[u != v])
                    vs.append(np.minimum(u, v)[u != v])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    rows = dealt(nodes.mapInArrow(spread, "anchor long, fp long, id long, home boolean"), cut(crowded(nodes, most)))
    rows = rows.repartition("anchor", "h", "v").sortWithinPartitions("anchor", "h", "v", F.desc("home"))
    return rows.mapInArrow(compare, "u long, v long").distinct()


def with_min(edges: DataFrame) -> DataFrame:
    """u, v, m: each row with the least v of its u, met salt by salt so that no task holds a hub."""
    keyed = edges.withColumn("s", salt(F.col("v")))
    by_salt = keyed.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = by_salt.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("s").alias("ss")).select("u", "m", F.explode("ss").alias("s"))
    return keyed.join(least, ["u", "s"]).drop("s")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (u, v)."""

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    while (now := state(edges)) != seen:
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_min(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.filter("u <> v").distinct()
        small = with_min(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def least_ids(ids: DataFrame, found: DataFrame) -> DataFrame:
    """node and component_id, the least id of all nodes of its component. ``ids``: node, id; ``found``: as of ``components``.

    A component that holds very many nodes is met salt by salt.
    """
    root = F.coalesce("component", "node").alias("root")
    named = stored(ids.join(found, "node", "left").select("node", root, "id", salt(F.col("node")).alias("salt")))
    by_salt = named.groupBy("root", "salt").agg(F.min("id").alias("id"))
    least = by_salt.groupBy("root").agg(F.min("id").alias("component_id"), F.collect_set("salt").alias("salts")).select("root", "component_id", F.explode("salts").alias("salt"))
    return named.join(least, ["root", "salt"]).select("node", "component_id")


def links_of_ids(prints: DataFrame) -> DataFrame:
    """u, v: links between the fingerprints of each doc_id that has several."""
    known = prints.filter("doc_id IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").drop("high")
    return known.join(several, "doc_id").select(F.col("fp").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut(fingerprints(docs, words))
    keyed = prints.withColumn("salt", salt(F.col("doc_id")))
    by_salt = keyed.groupBy("fp", "salt").agg(F.min("doc_id").alias("id"))
    by_print = cut(by_salt.groupBy("fp").agg(F.min("id").alias("id"), F.collect_set("salt").alias("salts")))
    near = links(by_print.select("fp", F.col("fp").alias("id")), radius)
    found = least_ids(by_print.select(F.col("fp").alias("node"), "id"), components(near.unionByName(links_of_ids(prints))))
    dealt = by_print.join(found, by_print["fp"] == found["node"]).select("fp", "component_id", F.explode("salts").alias("salt"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return keyed.join(dealt, ["fp", "salt"]).select("doc_id", hexed, "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component; rows without doc_id stay."""
    others = near_duplicates(docs, words, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias("__mg_id")).distinct()
    return docs.join(others, docs["doc_id"] == others["__mg_id"], "left_anti")
