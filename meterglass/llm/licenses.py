"""License scans by an exact set-similarity join of text blocks with templates.

A template is the set of words of a license notice; it is found where a window of consecutive
words, a quarter longer than the notice, holds at least ``THRESHOLD`` of its words. Texts are
cut into blocks of twice the longest window that overlap by half, so each window lies in one
block, and blocks are joined with the template table on word sets:

* words that no template has can't overlap one and are left out; the others are ordered by their
  global frequency, counted over all documents, rarest first;
* prefix filter: a block can reach the overlap o with an n-word template only if it holds one of
  the template's n - o + 1 rarest words, so only these are indexed;
* length filter: the block has at least o words;
* positional filter: where the first common word stands i-th of the block's m words and j-th of
  the template's, no more than 1 + min(m - i - 1, n - j - 1) words can be common;
* what is left is verified exactly, window by window; overlapping windows that match are merged.

Exact phrases of words (the base) are found besides and count with score 1.

A template table of at most ``MAX_TEMPLATE_BYTES`` (checked) travels with the job, and tasks join
their texts with it where they lie. A larger one is met by shuffles (``scan_shuffled``) with the
same rows: ranks, prefixes and blocks are tables, candidates a join on prefix words, and only
candidates meet the words of their block.

Defined results: a null or empty text has no words and no labels; repeated rows are results of
their own; ties in frequency fall to the word's order; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, stored

THRESHOLD = 0.9
MAX_TEMPLATE_BYTES = 4_000_000
#: Candidate templates that meet the words of a block at a time, where templates are shuffled.
AT_A_TIME = 64
#: Bytes of UTF-8: digits, a-z after lower-casing A-Z, and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("all-rights-reserved", "copyright all rights reserved no part may be reproduced"),
)


def words(text: str | None) -> list[bytes]:
    return WORD.findall(as_bytes(text).lower())


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    ordered: tuple[int, ...]  # ranks of its words, rarest first
    overlap: int
    window: int

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.ordered[: len(self.ordered) - self.overlap + 1]


class Join:
    """The template side of the join: ranks of all its words, and its prefixes as an inverted index."""

    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        notices = [(label, words(notice)) for label, notice in templates]
        vocabulary = sorted({w for _, notice in notices for w in notice}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(vocabulary)}
        # the least whole overlap that reaches the threshold, free of rounding noise
        self.templates = [
            Template(k, label, tuple(sorted({self.rank[w] for w in n})), ceil(threshold * len(set(n)) - 1e-9), ceil(len(n) * 1.25))
            for k, (label, n) in enumerate(notices) if n
        ]
        self.members = [frozenset(t.ordered) for t in self.templates]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            for j, r in enumerate(t.prefix):
                self.index.setdefault(r, []).append((k, j))
        self.first = frozenset(vocabulary[r] for r in self.index)
        self.step = max((t.window for t in self.templates), default=1)

    def candidates(self, block: list[int], seen: Counter | None = None) -> list[int]:
        """The templates that a block, its words' ranks ascending, may reach. ``seen`` counts what each filter decides."""
        out, met = [], set()
        for i, r in enumerate(block):
            for k, j in self.index.get(r, ()):
                if k in met:
                    continue
                met.add(k)
                t = self.templates[k]
                if len(block) < t.overlap:
                    why = "length"
                elif 1 + min(len(block) - i - 1, len(t.ordered) - j - 1) < t.overlap:
                    why = "position"
                else:
                    why = "candidate"
                    out.append(k)
                if seen is not None:
                    seen[why] += 1
        if seen is not None:
            seen["prefix"] += len(self.templates) - len(met)
        return out

    def hits(self, found: list[bytes], seen: Counter | None = None) -> list[tuple[int, str, int, int, float]]:
        """Template number, label, first and last word place and containment of each merged run of matching windows."""
        places = [(i, self.rank[w]) for i, w in enumerate(found) if w in self.rank]
        halves: dict[int, set[int]] = {}
        for i, r in places:
            halves.setdefault(i // self.step, set()).add(r)
        blocks: dict[int, set[int]] = {}  # of each template: the halves that its candidates touch
        for h, own in halves.items():
            for k in self.candidates(sorted(own | halves.get(h + 1, set())), seen):
                blocks.setdefault(k, set()).update((h, h + 1))
        out = []
        for k in sorted(blocks):
            t, member = self.templates[k], self.members[k]
            own = [(i, r) for i, r in places if r in member and i // self.step in blocks[k]]
            out += [(t.number, t.label, a, b, n / len(t.ordered)) for a, b, n in runs(own, t)]
        return out


def runs(own: list[tuple[int, int]], template: Template) -> list[tuple[int, int, int]]:
    """Merged runs of matching windows: first and last word place, and the best overlap. ``own``: the template's words by place."""
    out: list[tuple[int, int, int]] = []
    inside: dict[int, int] = {}
    left = 0
    for place, word in own:
        inside[word] = inside.get(word, 0) + 1
        while own[left][0] <= place - template.window:
            gone = own[left][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            left += 1
        if len(inside) >= template.overlap:
            first = own[left][0]
            if out and first <= out[-1][1]:
                out[-1] = (out[-1][0], place, max(out[-1][2], len(inside)))
            else:
                out.append((first, place, len(inside)))
    return out


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each word of the vocabulary, over all documents; as many rows as the vocabulary has."""

    def run(batches):
        count = dict.fromkeys(vocabulary, 0)
        for (texts,) in arrow_rows(batches, ("text",)):
            for t in texts:
                for w in vocabulary.intersection(words(t)):
                    count[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan_text(text: str | None, join: Join, phrases: dict[str, list[bytes]], needed: frozenset[bytes]):
    """Number of words, base hits (label, first, last) and template hits (number, label, first, last, containment)."""
    found = words(text)
    if needed.isdisjoint(found):
        return len(found), [], []
    base = []
    for label, phrase in phrases.items():
        at = -1
        try:
            while True:
                at = found.index(phrase[0], at + 1)
                if found[at : at + len(phrase)] == phrase:
                    base.append((label, at, at + len(phrase) - 1))
        except ValueError:  # no further place
            pass
    return len(found), base, join.hits(found)


SCHEMA = (
    "n_words long, base array<struct<label:string,first:long,last:long>>, "
    "hits array<struct<template:long,label:string,first:long,last:long,containment:double>>"
)
HIT = pa.struct([("template", pa.int64()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())])
PHRASE_HIT = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])


def template_files(spark: SparkSession, path: str) -> DataFrame:
    """A template table of whole license texts, one a file; the file's name is the label."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("label"), F.col("value").alias("notice"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, ``base`` and ``hits`` with word places from 0.

    ``templates``: a table with label and notice, or such pairs; a null notice is no template.
    """
    if isinstance(templates, DataFrame):
        templates = templates.select("label", "notice").filter("notice IS NOT NULL")
        if (templates.agg(F.sum(F.octet_length("notice"))).first()[0] or 0) > MAX_TEMPLATE_BYTES:
            return scan_shuffled(docs, templates, phrases, threshold)
        templates = [(r["label"], r["notice"]) for r in templates.orderBy("label", "notice").collect()]
    join = Join(word_frequencies(docs, frozenset(w for _, notice in templates for w in words(notice))), templates, threshold)
    return scan_in_place(docs.select(F.col("doc_id").cast("long"), "text"), join, phrases)


def scan_in_place(docs: DataFrame, join: Join, phrases: dict[str, str]) -> DataFrame:
    """The join where the texts lie; other columns of ``docs`` than the text stay."""
    spelled = {label: words(p) for label, p in phrases.items()}
    # a text without any of these can't match, so its places are never listed
    needed = join.first | frozenset(p[0] for p in spelled.values())
    kept = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches):
        for *own, texts in arrow_rows(batches, (*names, "text")):
            rows = [scan_text(t, join, spelled, needed) for t in texts]
            keys = ("label", "first", "last"), ("template", "label", "first", "last", "containment")
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(v, pa.int64() if f.dataType.typeName() == "long" else pa.binary()) for v, f in zip(own, kept)), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[dict(zip(keys[0], x)) for x in r[1]] for r in rows], pa.list_(PHRASE_HIT)),
                    pa.array([[dict(zip(keys[1], x)) for x in r[2]] for r in rows], pa.list_(HIT)),
                ],
                names=[*names, "n_words", "base", "hits"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{schema}, {SCHEMA}")


# --- beyond what may travel with the job ------------------------------------------------------


def word_list(text: Column) -> Column:
    """The words of a text, as ``words`` has them."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows with their number from 0 in the order: a range sort, and the sizes of its partitions summed."""
    spark = df.sparkSession
    # the part is stored with its rows, so that no later read can number them differently
    placed = stored(df.orderBy(*order).select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")), "numbered")
    at, starts = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect()):  # a row for each partition
        starts.append((part, at))
        at += n
    begins = spark.createDataFrame(starts, "part int, begin long")
    return placed.join(begins, "part").withColumn(name, F.col("begin") + F.col("at")).drop("part", "at", "begin")


def template_tables(docs: DataFrame, templates: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The ranks of all template words, rarest first, and the templates as arrays of ranks."""
    listed = numbered(templates, "number", "label", "notice").select("number", "label", word_list(F.col("notice")).alias("ws"))
    spelled = listed.select("number", F.explode(F.array_distinct("ws")).alias("word"))
    holding = docs.select(F.explode(F.array_distinct(word_list(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequency = spelled.select("word").distinct().join(holding, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    ranks = stored(numbered(frequency, "rank", "n", "word").select("word", "rank"), "ranks")
    ordered = spelled.join(ranks, "word").groupBy("number").agg(F.sort_array(F.collect_list("rank")).alias("ordered"))
    need = F.ceil(F.lit(threshold) * F.size("ordered") - F.lit(1e-9)).cast("int")
    return ranks, stored(
        listed.join(ordered, "number").select("number", "label", "ordered", need.alias("overlap"), F.ceil(F.size("ws") * F.lit(1.25)).cast("int").alias("window")), "templates"
    )


def candidate_pairs(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """Blocks (key, half) and the templates that prefix, length and positional filters leave them."""
    size = F.size("ordered").alias("n")
    prefixes = templates.select("number", "overlap", size, F.posexplode(F.slice("ordered", F.lit(1), F.size("ordered") - F.col("overlap") + 1)).alias("j", "rank"))
    ranks = F.array_distinct(F.transform("places", lambda p: p["rank"]))
    own = blocks.select("key", "half", ranks.alias("ranks")).select("key", "half", F.size("ranks").alias("m"), F.posexplode("ranks").alias("i", "rank"))
    met = own.join(prefixes, "rank").filter("m >= overlap").groupBy("key", "half", "number").agg(F.min(F.struct("i", "j", "m", "n", "overlap")).alias("a"))
    return met.filter("1 + least(a.m - a.i - 1, a.n - a.j - 1) >= a.overlap").select("key", "half", "number")


def verified(pairs: DataFrame, blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """The runs of matching windows of candidates, block by block: key, number, first, last and the best overlap."""
    chunk = F.floor(F.col("number") / AT_A_TIME).alias("chunk")
    sides = pairs.join(templates.drop("label"), "number").groupBy("key", "half", chunk).agg(F.collect_list(F.struct("number", "ordered", "overlap", "window")).alias("ts"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # row by row, so that one block and its templates are objects at a time
                key, places, ts = (batch.column(c)[k].as_py() for c in ("key", "places", "ts"))
                by_place = sorted((p["place"], p["rank"]) for p in places)
                out = []
                for t in ts:
                    member = frozenset(t["ordered"])
                    template = Template(t["number"], "", tuple(t["ordered"]), t["overlap"], t["window"])
                    out += [(t["number"], *r) for r in runs([x for x in by_place if x[1] in member], template)]
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(out), pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], names=["key", "number", "first", "last", "common"])

    joined = sides.join(blocks, ["key", "half"]).select("key", "places", "ts")
    return joined.mapInArrow(run, "key binary, number long, first long, last long, common long")


def scan_shuffled(docs: DataFrame, templates: DataFrame, phrases: dict[str, str], threshold: float) -> DataFrame:
    """``scan`` with templates of any size: nothing of them is broadcast or collected.

    Equal texts are one key, the digest of the text, so copies are joined with templates once. A
    block is at most two of the longest windows. Runs found in blocks that overlap are merged.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"))
    ranks, listed = template_tables(docs, templates, threshold)
    step = listed.agg(F.max("window")).first()[0] or 1
    placed = docs.select("key", F.posexplode(word_list(F.col("text"))).alias("place", "word")).join(ranks, "word")
    half = F.floor(F.col("place") / step)
    halved = placed.select("key", "place", "rank", F.explode(F.array(half - 1, half)).alias("half")).filter("half >= 0")
    blocks = stored(halved.groupBy("key", "half").agg(F.sort_array(F.collect_set(F.struct("rank", "place"))).alias("places")), "blocks")
    found = verified(stored(candidate_pairs(blocks, listed), "candidates"), blocks, listed)
    by_first = Window.partitionBy("key", "number").orderBy("first", "last")
    before = F.max("last").over(by_first.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(F.col("first") <= before, 0).otherwise(1)).withColumn("run", F.sum("opens").over(by_first.rowsBetween(Window.unboundedPreceding, 0)))
    merged = opened.groupBy("key", "number", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("common").alias("common"))
    named = merged.join(listed.select("number", "label", F.size("ordered").alias("n")), "number")
    hit = F.struct(F.col("number").alias("template"), "label", "first", "last", (F.col("common") / F.col("n")).alias("containment"))
    hits = named.groupBy("key").agg(F.array_sort(F.collect_list(hit)).alias("found"))
    rows = scan_in_place(docs, Join({}, ()), phrases).join(hits, "key", "left")
    return rows.select("doc_id", "n_words", "base", F.coalesce("found", "hits").alias("hits"))


def digest(found: DataFrame) -> DataFrame:
    """The labels of each document and where its base phrases stand."""
    starts = F.transform("base", lambda x: x["first"])
    base = F.transform("base", lambda x: x["label"])
    labels = F.concat(base, F.transform("hits", lambda x: x["label"]))
    best = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("hits", lambda x: x["containment"])), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        best.alias("score"),
    )
