"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of consecutive words with least period q (words q apart are equal) that holds at
least two periods and ``MIN_WORDS`` words and that no neighbouring word extends with period q.

A word sequence is cut into its LZ factors, each the longest prefix of what is left that also
starts earlier, read from a suffix automaton that knows where each of its states first ends. Runs
that end in a factor and start at or before its first word are found by Main's algorithm: longest
extensions to both sides of the factor's border, for every period, over the factor and the part
before it that they can reach (fewer than twice the last factor's words and once this one's). Runs
that end with a factor's last word are found at the next border. All others lie inside of a factor
and are copied from its earlier occurrence, shifted. The work is linear in the words of a sequence.

Before, what can hold no run is passed over: words q apart are equal at MIN_WORDS / 2 consecutive
places of a run at least, so every word of a run, and a neighbour that would extend it, stands in a
sequence of half MIN_WORDS words that occurs twice in the text. Maximal stretches of such words are
found for many texts at once by sorting hashes (equal hashes of different sequences only make a
stretch longer), and each stretch is a sequence of its own.

A text is worked on whole in one task, with memory in proportion to it; texts don't meet, so there
is no shuffle.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text;
each row of ``docs`` gives one row, repeated rows and null doc_ids included; other columns play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes

MIN_WORDS = 12
RUNS = "array<struct<start:long,length:long,period:long>>"
ODD = np.uint64(0x9E3779B97F4A7C15)


def lz_factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of the earlier occurrence or -1) of each factor."""
    go, link, length, ends = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        now = len(go)
        go.append({})
        link.append(0)
        length.append(i + 1)
        ends.append(i)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] > length[p] + 1:
                copy = len(go)
                go.append(go[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                link[q] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                q = copy
            link[now] = q
        last = now
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n and ends[to := go[state][w[j]]] < j:
            state, j = to, j + 1
        out.append((i, j - i, ends[state] - (j - i) + 1) if j > i else (i, 1, -1))
        i = max(j, i + 1)
    return out


def prefixes(s: list[int]) -> list[int]:
    """For each place, how many words from there equal the first ones."""
    n, out, left, right = len(s), [0] * len(s), 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def at_border(w: list[int], s: int, e: int, before: int, least: int):
    """(start, end, period) of runs that end in w[s:e] or at s - 1 and start at or before s, within ``before`` words of it; ends are exclusive."""
    u, t = w[s:e], w[s - before : s]
    m, low = len(u), s - before
    back = t[::-1]
    left = prefixes([*back, -1, *u[::-1], *back])  # equal words backwards from the border, with each later or earlier place
    right = prefixes([*u, -1, *t, *u])
    for p in range(1, m + 1):  # a whole period stands after the border
        ls, lp = left[before + 1 + m - p], right[p] if p < m else 0
        if ls + lp >= p and ls + lp + p >= least:
            a, z = s - ls, s + p + lp
            if not (z == e < len(w) and w[e] == w[e - p]) and not (a == low > 0 and w[a - 1] == w[a - 1 + p]):
                yield a, z, p
    for p in range(1, before + 1):  # a whole period stands before the border
        ls, lp = left[p] if p < before else 0, right[m + 1 + before - p] if m else 0
        if ls + lp >= p and ls + lp + p >= least:
            a, z = s - p - ls, s + lp
            if not (z == e < len(w) and w[e] == w[e - p]) and not (a == low > 0 and w[a - 1] == w[a - 1 + p]):
                yield a, z, p


def runs_of(w: list[int], least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least ``least`` words, by start and end; ends are exclusive."""
    found: dict[int, dict[int, int]] = {}  # by start: end and least period

    def keep(a: int, z: int, p: int) -> None:
        own = found.setdefault(a, {})
        own[z] = min(p, own.get(z, p))

    last = 0
    for s, m, source in [*lz_factors(w), (len(w), 0, -1)]:
        e, before = s + m, min(s, 2 * last + m)
        if before + m >= least:
            for a, z, p in at_border(w, s, e, before, least):
                keep(a, z, p)
        if source >= 0 and m > least:
            shift = s - source
            for a in range(s + 1, e - least):
                if a - shift in found:
                    for z, p in list(found[a - shift].items()):
                        if z + shift < e:
                            keep(a, z + shift, p)
        last = m
    return sorted((a, z, p) for a, own in found.items() for z, p in own.items())


def repeated(codes: np.ndarray, text: np.ndarray, gram: int) -> np.ndarray:
    """Which words stand in a sequence of ``gram`` words that occurs twice in their text. ``text``: each word's text, ascending."""
    n = len(codes) - gram + 1
    if n < 2:
        return np.zeros(len(codes), bool)
    h = text[:n].astype(np.uint64) * ODD
    for k in range(gram):
        h = (h ^ (h >> np.uint64(29))) * ODD + codes[k : k + n]
    whole = np.flatnonzero(text[:n] == text[gram - 1 :])
    order = whole[np.argsort(h[whole])]
    same = h[order[1:]] == h[order[:-1]]
    starts = np.zeros(n, bool)
    starts[order[1:][same]] = starts[order[:-1][same]] = True
    edges = np.zeros(len(codes) + 1, np.int32)
    edges[:n] += starts
    edges[gram : gram + n] -= starts
    return np.cumsum(edges[:-1]) > 0


def runs_of_texts(texts: list[list[bytes]], least: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start and period."""
    sizes = np.array([len(t) for t in texts])
    found: list[list] = [[] for _ in texts]
    if not sizes.sum():
        return found
    codes = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy()
    text, starts = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    hit = repeated(codes.astype(np.uint64), text, -(-least // 2))
    begins = np.flatnonzero(hit & ~(np.r_[False, hit[:-1]] & np.r_[False, text[1:] == text[:-1]]))
    ends = np.flatnonzero(hit & ~(np.r_[hit[1:], False] & np.r_[text[1:] == text[:-1], False])) + 1
    for a, z in zip(begins, ends):
        if z - a >= least:
            at = int(a - starts[text[a]])
            found[text[a]] += [(at + b, e - b, p) for b, e, p in runs_of(codes[a:z].tolist(), least)]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(drop)) if not d)


def find_runs(docs: DataFrame, least: int = MIN_WORDS, rewrite=None) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period) and collapsed, the text with one period of each run.

    ``rewrite(doc_id, words)``, where given, returns the words to look at.
    """

    def run(batches):
        for ids, texts in arrow_rows(batches, ("doc_id", "text")):
            words = [as_bytes(t).split() for t in texts]  # of bytes: the six ASCII blanks
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(ids, words)]
            runs = runs_of_texts(words, least)
            flat = [r for own in runs for r in own]
            structs = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in runs])], pa.int32()), structs)
            kept = pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, kept.cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """One row per row of ``find_runs``: how many runs, the longest one, and digests of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", longest)
    length = -F.col("best.less")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
