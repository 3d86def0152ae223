"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are normalised to lower-case words joined by single spaces. An item of m bytes
that stands in a text with at most e edits shares at least m + 1 - q - q e of its q-grams with
it, all on 2 e + 1 neighbouring diagonals (text place minus item place). Shared q-grams are
counted in bands of twice that width which overlap by half, so each such set of diagonals lies
within one band; bands that meet the bound are verified by banded alignment of the whole item.

An item of which only a part stands in a text is found by its passages: windows of ``PASSAGE``
consecutive words, one from each word on, each with the edit budget, the bound and the alignment
of its own length. Of runs without blanks longer than ``LONG`` bytes, each ``PIECE`` bytes count as
a word here. An item found whole is reported so; else the first passage that verifies, those with
most shared q-grams first. Before alignment the lemma is applied to q-grams of ``SHORT_Q`` bytes, too. A passage in which replaced words take more than the budget isn't found.

Common q-grams are counted by item and band, ``PAIRS`` of them at once, before any is kept: a
text that repeats one phrase takes time, not memory. Bands are looked at one by one.

The benchmark goes to the tasks in blocks of at most about ``BLOCK_BYTES`` of item text (more only
where one item is longer), broadcast one by one, so the driver holds one at a time; documents
are read once for each ``AT_ONCE`` blocks, and texts stream, a few at a time. No document or item
is cut.

Defined results: null or empty texts match nothing; null or empty items are never found; items
shorter than ``q`` must stand exactly, as whole words; rows that repeat an item count once, items
of equal text each for itself; repeated rows of documents are results of their own; an item
without item_id counts as found but isn't listed; an empty table gives an empty result;
``drop_contaminated`` passes all columns through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

Q = 10
#: Edits allowed, as a share of the item's normalised bytes.
EDITS = 0.08
BLOCK_BYTES = 4_000_000
#: Blocks that one pass over the documents looks for.
AT_ONCE = 2
#: Pairs of a text's and an item's equal q-grams that are counted at once.
PAIRS = 1 << 20
TABLE_BITS = 22
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Length of the q-grams that a passage is looked at for before it is aligned.
SHORT_Q = 4
#: Words of a passage, and what counts as one in a run of bytes without blanks.
PASSAGE = 13
LONG, PIECE = 24, 6
#: Alignments of a text that are remembered.
KEPT = 1000
#: Lifts the numbers of bands above zero.
LIFT = 1 << 31
#: Letters and digits stay (A-Z as a-z, all beyond ASCII); everything else is a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str | None) -> np.ndarray:
    """Bytes of the normalised text, one blank before and after it."""
    a = np.frombuffer(b" " + (text or "").encode("utf-8", "replace").translate(FOLD) + b" ", np.uint8)
    keep = np.ones(len(a), bool)
    np.logical_or(a[1:] != 32, a[:-1] != 32, out=keep[1:])
    return a[keep]


def qgrams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each q-gram, built by doubling."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, width, part = None, 0, 1, a.astype(np.uint64)
    power = np.full(1, PRIME)  # an array, so that it wraps silently
    while width <= q:
        if q & width:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += width
        if width * 2 <= q:
            part = part[:-width] * power + part[width:]
        power, width = power * power, width * 2
    return out


def allowed(m: int, q: int = Q, edits: float = EDITS) -> int:
    """The edit budget: the share of the length, and never more than leaves one q-gram to find."""
    return max(0, min(int(edits * m), (m - q) // q))


def windows(a: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where passages of ``words`` words start and end in a normalised item; none if it has no more words."""
    ends = np.flatnonzero(a == 32)
    long = np.flatnonzero(np.diff(ends) > LONG)
    if len(long):
        ends = np.sort(np.r_[ends, *(np.arange(ends[i] + PIECE, ends[i + 1], PIECE) for i in long)])
    if len(ends) - 1 <= words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return ends[:-words], ends[words:] + 1


class Index:
    """The q-grams of a block of items, in a sorted hash array with a bitmap before it.

    With ``words``, ``find`` also finds items of which a passage of so many words stands in the text.
    """

    def __init__(self, items: list[tuple[int, str | None]], q: int = Q, edits: float = EDITS, words: int | None = None):
        self.q = q
        texts = [(i, normalise(t)) for i, t in items]
        texts = [(i, a) for i, a in texts if len(a) > 1]
        self.ids = [i for i, _ in texts]
        self.items = [a for _, a in texts]
        self.budget = np.array([allowed(len(a), q, edits) for a in self.items], np.int64)
        sizes = np.array([len(a) for a in self.items], np.int64)
        self.least = np.maximum(1, sizes + 1 - q - q * self.budget)
        self.short = np.flatnonzero(sizes < q)
        self.words = words
        if words:
            self.windows = []  # of each item: starts, ends, budgets and least shared q-grams
            for a in self.items:
                lo, hi = windows(a, words)
                e = np.maximum(0, np.minimum((edits * (hi - lo)).astype(np.int64), (hi - lo - q) // q))
                self.windows.append((lo, hi, e, np.maximum(1, hi - lo + 1 - q - q * e)))
            self.width = np.array([2 * int(e.max(initial=0)) + 1 for _, _, e, _ in self.windows], np.int64)
            self.fewest = np.array([int(n.min(initial=LIFT)) for _, _, _, n in self.windows], np.int64)
        grams = [qgrams(a, q) for a in self.items]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << TABLE_BITS, bool)
        self.bitmap[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """item_id, start, end (bytes of the normalised text) and edits of each item's best place."""
        a = normalise(text)
        if len(a) < 2:
            return []
        raw, found = None, []
        if len(self.short):
            raw = a.tobytes()
            for k in self.short:
                if (at := raw.find(self.items[k].tobytes())) >= 0:
                    found.append((self.ids[k], at, at + len(self.items[k]), 0))
        h = qgrams(a, self.q)
        if not len(h) or not len(self.keys):
            return found
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[slot] == h[at]
        at, slot = at[same], slot[same]
        parts = Parts(self, at, slot)
        totals, bands = self.counted(parts)
        whole, self.seen = set(), {}
        for k in np.flatnonzero(totals >= self.least).tolist():
            got = self.verify(a, k, *bands(k))
            if got:
                found.append((self.ids[k], *got))
                whole.add(k)
        if self.words:
            found += self.passages(a, h, parts, whole)
        return found

    def pairs(self, at: np.ndarray, slot: np.ndarray):
        """(item, diagonal) of the pairs of equal q-grams, about ``PAIRS`` at once. ``at``, ``slot``: text places and their keys."""
        count = self.count[slot]
        ends = np.cumsum(count)
        i = 0
        while i < len(at):
            done = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            many = count[i:j]
            entry = np.repeat(self.first[slot[i:j]] - (ends[i:j] - many - done), many) + np.arange(int(ends[j - 1]) - done)
            yield self.item[entry], np.repeat(at[i:j], many) - self.place[entry]
            i = j

    def counted(self, parts: "Parts"):
        """Equal q-grams by item; and a function that gives an item's bands (for the whole item) and their counts."""
        totals = sum(np.bincount(item, minlength=len(self.items)) for item, _ in parts)

        def bands(k: int) -> tuple[np.ndarray, np.ndarray]:
            width = 2 * int(self.budget[k]) + 1
            return merged([np.unique(d[item == k] // width, return_counts=True) for item, d in parts])

        return totals, bands

    def passages(self, a: np.ndarray, h: np.ndarray, parts: "Parts", whole: set[int]) -> list[tuple[int, int, int, int]]:
        """What ``find`` gives, of a passage of each item that isn't in ``whole``. ``h``: the text's q-grams."""
        # bands are counted in a small table first: two numbers that share a place only count too much
        mask = (1 << min(22, max(8, parts.total.bit_length() + 1))) - 1
        n = sum(np.bincount((item * 40503 + d // self.width[item]) & mask, minlength=mask + 1) for item, d in parts)
        codes = []
        for item, d in parts:
            band = d // self.width[item]
            spot = (item * 40503 + band) & mask
            keep = n[spot] + np.maximum(n[(spot + 1) & mask], n[(spot - 1) & mask]) >= self.fewest[item]
            if keep.any():
                codes.append(np.unique((item[keep].astype(np.int64) << 32) + band[keep] + LIFT, return_counts=True))
        if not codes:
            return []
        groups, count = paired(*merged(codes))
        tries, grams, own = {}, None, {}
        for group in groups[count >= self.fewest[groups >> 32]].tolist():
            k = group >> 32
            if k in whole:
                continue
            lo, hi, e, least = self.windows[k]
            width, b = int(self.width[k]), (group & (1 << 32) - 1) - LIFT
            if k not in own:
                own[k] = qgrams(self.items[k], self.q)
            shared = running(any_near(own[k], h, b * width, 2 * width))
            if shared[-1] < self.fewest[k]:
                continue
            shared = shared[hi - self.q + 1] - shared[lo]
            w = np.flatnonzero(shared >= least)
            if not len(w):
                continue
            # the lemma again, with short q-grams, of which more must be there
            if grams is None:
                grams = short_grams(a)
            have = running(any_near(short_grams(self.items[k][lo[w[0]] : hi[w[-1]]]), grams, b * width + int(lo[w[0]]), 2 * width))
            x, y = lo[w] - lo[w[0]], hi[w] - lo[w[0]]
            w = w[have[y - SHORT_Q + 1] - have[x] >= y - x + 1 - SHORT_Q - SHORT_Q * e[w]]
            if len(w):
                tries.setdefault(k, []).extend((-int(shared[i]), i, b) for i in w.tolist())
        found = []
        for k, places in tries.items():
            lo, hi, e, _ = self.windows[k]
            width = int(self.width[k])
            for _, w, b in sorted(places):
                low = b * width + int(lo[w])
                got = self.aligned((k, w), self.items[k][lo[w] : hi[w]], a, low, 2 * width, int(e[w]))
                if got:
                    found.append((self.ids[k], *got))
                    break
        return found

    def aligned(self, name, part: np.ndarray, a: np.ndarray, low: int, size: int, most: int) -> tuple[int, int, int] | None:
        """``align`` on the diagonals from low on; where a text repeats itself, one answer holds for equal stretches of it."""
        high = low + len(part) + size
        if low < 0 or high > len(a):
            return align(part, a, low, low + size - 1, most)
        key = name, a[low:high].tobytes()
        if key not in self.seen:
            if len(self.seen) >= KEPT:
                self.seen.clear()
            self.seen[key] = align(part, a[low:high], 0, size - 1, most)
        got = self.seen[key]
        return got and (got[0] + low, got[1] + low, got[2])

    def verify(self, a: np.ndarray, k: int, bands: np.ndarray, counts: np.ndarray) -> tuple[int, int, int] | None:
        """The best place of item k among the bands whose equal q-grams meet the bound."""
        e, best = int(self.budget[k]), None
        width = 2 * e + 1
        bands, hits = paired(bands, counts)
        for b in bands[hits >= self.least[k]]:
            got = self.aligned(k, self.items[k], a, int(b * width), 2 * width, e)
            if got and (best is None or got[2] < best[2]):
                best = got
            if best and not best[2]:
                break
        return best


class Parts:
    """The pairs of a text's and the items' equal q-grams, part by part; made once if they are few, else each time anew."""

    def __init__(self, index: Index, at: np.ndarray, slot: np.ndarray):
        self.index, self.at, self.slot = index, at, slot
        self.total = int(index.count[slot].sum())
        self.kept = list(index.pairs(at, slot)) if self.total <= PAIRS else None

    def __iter__(self):
        return iter(self.kept) if self.kept is not None else self.index.pairs(self.at, self.slot)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of several such pairs, each number once."""
    numbers, back = np.unique(np.concatenate([n for n, _ in parts]), return_inverse=True)
    return numbers, np.bincount(back, weights=np.concatenate([c for _, c in parts]), minlength=len(numbers)).astype(np.int64)


def paired(bands: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands of twice the width, which overlap by half: each with the counts of a band and the next."""
    return merged([(bands, counts), (bands - 1, counts)])


def running(hits: np.ndarray) -> np.ndarray:
    """How many hold before each place, and in all."""
    out = np.zeros(len(hits) + 1, np.int64)
    np.cumsum(hits, out=out[1:])
    return out


def short_grams(a: np.ndarray) -> np.ndarray:
    """The ``SHORT_Q``-grams themselves, as numbers."""
    n = max(0, len(a) - SHORT_Q + 1)
    out = np.zeros(n, np.int64)
    for i in range(SHORT_Q):
        out = out << 8 | a[i : i + n]
    return out


def any_near(own: np.ndarray, grams: np.ndarray, low: int, size: int) -> np.ndarray:
    """Of each of an item's q-grams: whether the text's, ``grams``, have it on one of the diagonals low..low + size - 1."""
    if not len(own):
        return np.zeros(0, bool)
    # beyond the text stands a number that the item doesn't have
    most, one = own.max(), own.dtype.type(1)
    there = np.full(len(own) + size - 1, most + one if most < np.iinfo(own.dtype).max else own.min() - one, own.dtype)
    lo, hi = max(0, low), min(len(grams), low + len(there))
    if hi > lo:
        there[lo - low : hi - low] = grams[lo:hi]
    step = there.strides[0]
    # a row a diagonal: rows are long, so they are compared and joined fast
    return np.logical_or.reduce(np.ndarray((size, len(own)), own.dtype, there, 0, (step, step)) == own)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the whole item's best alignment on the diagonals low..high, or None beyond ``most`` edits.

    Cells of one row of the band at a time; text before and after the item is free.
    """
    m, n, size = len(item), len(text), high - low + 1
    far = m + n + 1
    spot = np.arange(size)
    column = low + spot  # text place before the first byte, on each diagonal
    padded = np.full(m + size + 1, 0, np.int64)
    lo, hi = max(0, low), min(n, low + m + size)
    if hi <= lo:
        return None
    padded[lo - low : hi - low] = text[lo:hi].astype(np.int64) + 1
    inside = (column >= 0) & (column <= n)
    cost = np.where(inside, 0, far)
    start = column.copy()
    target = item.astype(np.int64) + 1
    up, after = np.full(size, far + 1), np.zeros(size, np.int64)  # one diagonal on
    for i in range(m):
        column = low + i + 1 + spot
        fits = (column >= 0) & (column <= n)
        same = padded[i : i + size] != target[i]
        step = cost + same
        np.add(cost[1:], 1, out=up[:-1])
        after[:-1] = start[1:]
        take = up < step
        step, begin = np.where(take, up, step), np.where(take, after, start)
        step = np.where(fits, step, far)
        # from the left: the least of (cost - place), carried on
        level = step - spot
        run = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == run, spot, 0))
        cost, start = np.where(fits, run + spot, far), begin[source]
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return (int(start[k]), int(low + m + k), int(cost[k])) if cost[k] <= most else None


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """The items, each once, in blocks of about ``most`` bytes, by hash; one block comes to the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def passes(docs: DataFrame, benchmark: DataFrame) -> list[list]:
    """The benchmark's blocks as broadcasts, which leave the driver's memory, by passes over the documents."""
    context = docs.sparkSession.sparkContext
    handles = [context.broadcast(block) for block in blocks(benchmark)]
    return [handles[at : at + AT_ONCE] for at in range(0, len(handles), AT_ONCE)]


def small_parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


HIT = pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "edits")])
FOUND = "array<struct<item_id:long,start:long,end:long,edits:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``found``, each item that stands in it with start and end in the normalised text and edits of it or its passage."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr(f"cast(array() as {FOUND})").alias("found"))
    every = passes(docs, benchmark)
    for number, handles in enumerate(every):
        last = number + 1 == len(every)

        def run(batches, handles=handles, last=last):
            indexes = [Index(h.value, q, edits, PASSAGE) for h in handles]
            for part in small_parts(batches):
                found = []
                for t, before in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                    hits = [m for index in indexes for m in index.find(t)] if t else []
                    found.append(before + [dict(zip(("item_id", "start", "end", "edits"), m)) for m in hits])
                columns = {"doc_id": part.column("doc_id"), "text": part.column("text"), "found": pa.array(found, pa.list_(HIT))}
                if last:
                    del columns["text"]
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        rows = rows.mapInArrow(run, f"doc_id long, {'' if last else 'text string, '}found {FOUND}")
        if not last:
            rows = cut(rows)  # or the passes' workers and indexes would all be in memory at once
    return rows


def by_document(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (sorted), least_edits; no shuffle."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    found = contamination(docs, benchmark, q, edits)
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.array_min(F.transform("found", lambda m: m["edits"])).alias("least_edits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` in which no item and no passage of one stands, with all their columns; no shuffle."""
    every = passes(docs, benchmark)
    for number, handles in enumerate(every):

        def run(batches, handles=handles):
            indexes = [Index(h.value, q, edits, PASSAGE) for h in handles]
            for part in small_parts(batches):
                yield part.filter(pa.array([not (t and any(index.find(t) for index in indexes)) for t in part.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if number + 1 < len(every):
            docs = cut(docs)
    return docs
