"""Personal data by DataFrame functions alone.

Regular expressions propose spans, checksum validators (Luhn for cards, mod-97 for IBANs, digit
counts, number ranges) confirm them, and context words shortly before a span raise its score.
Spans are in code points, end exclusive. A match that fails its validator is dropped and not
searched again from within.

The patterns are possessive and start only where a run of their first class starts, which gives
the leftmost matches of the plain patterns without their quadratic retries on long runs.

Defined results: a null or empty text has no spans; overlapping kinds are all reported, ordered
by start, then kind as listed; repeated rows are results of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a span in which context words count.
CONTEXT = 40
CONTEXT_SCORE = 0.15


def count_digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))

    def add(total, i):
        d = F.ascii(digits.substr(i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))

    def add(rest, i):
        c = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def parts_at_most_255(match: Column) -> Column:
    def small(part):
        plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(plain) <= 3) & (F.lpad(plain, 3, "0") <= "255")

    return F.forall(F.split(match, r"\."), small)


@dataclass(frozen=True)
class Kind:
    """A kind of span; ``hint`` is a cheap test that every text with a match passes."""

    name: str
    pattern: str
    hint: str
    score: float
    context: str
    valid: object = None


#: The base kinds, in order, then those that the method adds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.8, r"mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|host|server|address", parts_at_most_255),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, r"card|visa|credit|payment", lambda m: count_digits(m).between(14, 19) & luhn(m)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"phone|\btel|call|fax|mobile", lambda m: count_digits(m).between(10, 15)),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.8, r"iban|account|bank", mod97),
    Kind("secret", r"(?i)(?<![A-Za-z0-9])(?:token|secret|password|api[_-]?key)[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9_/+-]{16,}+", r"[=:][ \t]*[\"']?[A-Za-z0-9_/+-]{16}", 0.75, r"auth|private|login"),
)
BASE = 4

SPAN = "array<struct<start:int,place:int,end:int,kind:string,score:double>>"
#: Matches (or spans) that are placed in one go; arrays are never grown beyond it, so work is linear in the matches.
BLOCK = 256
#: Matches before a block that its first context can reach back to: each is two code points at least.
BACK = CONTEXT // 2 + 1


def let(value: Column, f) -> Column:
    """f(value) with the value evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def blocks_of(n: Column) -> Column:
    """The numbers, from 0, of the blocks of n elements; n is at least 1."""
    return F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))


def sliced(values: Column, k: Column) -> Column:
    return F.slice(values, k * BLOCK + 1, F.lit(BLOCK))


def placed(pieces: Column, k: Column) -> Column:
    """Block k: its length (at) and its matches (got) with places from the block's start and the text before each."""
    before = F.slice(pieces, F.greatest(k * BLOCK - BACK, F.lit(0)) + 1, F.least(k * BLOCK, F.lit(BACK)))
    tail = F.right(F.array_join(F.transform(before, lambda p: F.concat(p["tail"], p["match"])), ""), F.lit(CONTEXT))
    none = F.struct(F.lit(0).alias("at"), tail.alias("tail"), F.expr("cast(array() as array<struct<start:int,end:int,match:string,near:string>>)").alias("got"))

    def step(state, p):
        near = F.right(F.concat(state["tail"], p["tail"]), F.lit(CONTEXT))
        start = state["at"] + p["gap"]
        end = start + F.length(p["match"])
        span = F.struct(start.alias("start"), end.alias("end"), p["match"].alias("match"), near.alias("near"))
        return F.struct(end.alias("at"), F.right(F.concat(near, p["match"]), F.lit(CONTEXT)).alias("tail"), F.concat(state["got"], F.array(span)).alias("got"))

    return F.aggregate(sliced(pieces, k), none, step)


def spans_of(text: Column, place: int, kind: Kind) -> Column:
    """The confirmed spans of one kind: what stands between the matches gives their places.

    The text is matched once; places are sums of lengths, first within blocks of matches, then over
    the blocks, so that a text with very many matches costs no more than its length.
    """
    none = F.expr(f"cast(array() as {SPAN})")
    between, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    piece = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("gap"), F.right(b, F.lit(CONTEXT)).alias("tail"), m.alias("match")))
    pieces = F.filter(piece, lambda p: p["match"].isNotNull())  # what stands after the last match

    def scored(s, base):
        return F.struct(
            (s["start"] + base).alias("start"), F.lit(place).alias("place"), (s["end"] + base).alias("end"), F.lit(kind.name).alias("kind"),
            (F.lit(kind.score) + F.when(F.lower(s["near"]).rlike(kind.context), CONTEXT_SCORE).otherwise(0.0)).alias("score"),
        )

    def confirmed(block, base):
        kept = F.filter(block["got"], lambda s: kind.valid(s["match"])) if kind.valid else block["got"]
        return F.transform(kept, lambda s: scored(s, base))

    def shifted(blocks):
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("bases"))
        bases = F.aggregate(blocks, start, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["bases"], F.array(s["at"])).alias("bases")), lambda s: s["bases"])
        return F.flatten(F.zip_with(blocks, bases, confirmed))

    def of(pieces):
        return F.when(F.size(pieces) > 0, let(F.transform(blocks_of(F.size(pieces)), lambda k: placed(pieces, k)), shifted)).otherwise(none)

    return F.when(text.rlike(kind.hint), let(pieces, of)).otherwise(none)


def find_pii(docs: DataFrame, kinds=KINDS) -> DataFrame:
    """doc_id and ``found``: the spans (start, place of the kind, end, kind, score), sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.array_sort(F.concat(*[spans_of(text, k, kind) for k, kind in enumerate(kinds)])).alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, kinds=KINDS, base: int = BASE) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans and the highest score."""
    spans = F.col("found")

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["place"] == k)).cast("long").alias(f"n_{kinds[k].name}")

    counts = [count(k) for k in range(base)]
    return found.select(
        "doc_id", *counts, F.sha2(written(F.filter(spans, lambda s: s["place"] < base)), 256).alias("base_sha256"),
        written(spans).alias("spans"), F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def redact(docs: DataFrame, least: float = 0.6, kinds=KINDS) -> DataFrame:
    """doc_id and text with every span of at least that score replaced by [KIND]; overlaps go to the first."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    spans = F.filter(F.array_sort(F.concat(*[spans_of(text, k, kind) for k, kind in enumerate(kinds)])), lambda s: s["score"] >= least)

    def block(state, part):
        """A block of spans over the piece of text that it reaches, so that no span is looked up from the text's start."""
        reach = F.greatest(state["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        base = state["at"]

        def within(chunk):
            def step(now, s):
                out = F.concat(now["out"], chunk.substr(now["at"] - base + 1, s["start"] - now["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.when(s["start"] >= now["at"], F.struct(s["end"].alias("at"), out.alias("out"))).otherwise(now)

            return F.aggregate(part, F.struct(base.alias("at"), F.lit("").alias("out")), step)

        return let(let(text.substr(base + 1, reach - base), within), lambda done: F.struct(done["at"].alias("at"), F.concat(state["parts"], F.array(done["out"])).alias("parts")))

    def redacted(spans):
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
        done = F.aggregate(blocks_of(F.size(spans)), start, lambda state, k: let(sliced(spans, k), lambda part: block(state, part)), lambda s: F.concat(F.array_join(s["parts"], ""), text.substr(s["at"] + 1, F.length(text))))
        return F.when(F.size(spans) > 0, done).otherwise(text)

    return rows.select("doc_id", let(spans, redacted).alias("text"))
