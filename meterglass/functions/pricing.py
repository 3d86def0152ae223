"""Token prices: ordered rules over the model id, tiers, and the cost of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(column: str, *parts: str) -> str:
    return "(" + " OR ".join(f"_{column} LIKE '%{p}%'" for p in parts) + ")"


def begins(column: str, *parts: str) -> str:
    return "(" + " OR ".join(f"_{column} LIKE '{p}%'" for p in parts) + ")"


def same(column: str, *values: str) -> str:
    return f"_{column} IN ({', '.join(repr(v) for v in values)})"


#: Fixed values, first match wins. m: lower-case model; n: m with dots, blanks and underscores as
#: dashes; t: n after its last slash; c: t without grok-. Then USD per million tokens: input,
#: output, cache read, cache write; and above a threshold: input, output, cache read, cache write.
RULES = (
    (has("n", "fable"), (10.0, 50.0, 1.0, 12.5)),
    (has("n", "opus-4-6-fast", "opus-4-7-fast"), (30.0, 150.0, 3.0, 37.5)),
    (has("n", "opus-4-8-fast"), (10.0, 50.0, 1.0, 12.5)),
    (has("n", "opus-4-5", "opus-4-6", "opus-4-7", "opus-4-8"), (5.0, 25.0, 0.5, 6.25)),
    (has("m", "opus"), (15.0, 75.0, 1.5, 18.75)),
    (has("n", "haiku-4-5"), (1.0, 5.0, 0.1, 1.25)),
    (has("m", "haiku"), (0.8, 4.0, 0.08, 1.0)),
    (has("n", "sonnet-4"), (3.0, 15.0, 0.3, 3.75), 200_000, (6.0, 22.5, 0.6, 7.5)),
    (has("n", "sonnet-3-5", "3-5-sonnet"), (3.0, 15.0, 0.3, 3.75), 200_000, (6.0, 30.0, 0.6, 7.5)),
    (has("m", "sonnet", "claude"), (3.0, 15.0, 0.3, 3.75)),
    (has("t", "gpt-4o-2024-05-13"), (5.0, 15.0, 0.0, 0.0)),
    (has("t", "gpt-4o-mini"), (0.15, 0.6, 0.075, 0.0)),
    (has("m", "gpt-4o"), (2.5, 10.0, 1.25, 0.0)),
    (has("t", "gpt-5-5-pro", "gpt-5-4-pro"), (30.0, 180.0, 0.0, 0.0), 272_000, (60.0, 270.0, 0.0, None)),
    (has("t", "gpt-5-2-pro"), (21.0, 168.0, 0.0, 0.0)),
    (begins("t", "gpt-5-pro"), (15.0, 120.0, 0.0, 0.0)),
    (has("t", "gpt-5-4-mini"), (0.75, 4.5, 0.075, 0.0)),
    (has("t", "gpt-5-4-nano"), (0.2, 1.25, 0.02, 0.0)),
    (f"({begins('t', 'gpt-5-5')} OR {has('t', 'gpt-5-5-codex')})", (5.0, 30.0, 0.5, 0.0), 272_000, (10.0, 45.0, 1.0, None)),
    (f"({begins('t', 'gpt-5-4')} OR {has('t', 'gpt-5-4-codex')})", (2.5, 15.0, 0.25, 0.0), 272_000, (5.0, 22.5, 0.5, None)),
    (f"({begins('t', 'gpt-5-3')} OR {has('t', 'gpt-5-3-codex')})", (1.75, 14.0, 0.175, 0.0)),
    (f"({begins('t', 'gpt-5-2')} OR {has('t', 'gpt-5-2-codex')})", (1.75, 14.0, 0.175, 0.0)),
    (f"({has('t', 'gpt-5-1-codex-mini')} OR {begins('t', 'gpt-5-mini')})", (0.25, 2.0, 0.025, 0.0)),
    (begins("t", "gpt-5-nano"), (0.05, 0.4, 0.005, 0.0)),
    (f"({begins('t', 'gpt-5')} OR {has('t', 'codex')} OR {has('m', 'codex')})", (1.25, 10.0, 0.125, 0.0)),
    (begins("t", "o3-pro"), (20.0, 80.0, 0.0, 0.0)),
    (begins("t", "o3-mini"), (1.1, 4.4, 0.55, 0.0)),
    (begins("t", "o3-deep-research"), (10.0, 40.0, 2.5, 0.0)),
    (begins("t", "o3"), (2.0, 8.0, 0.5, 0.0)),
    (begins("t", "o4-mini-deep-research"), (2.0, 8.0, 0.5, 0.0)),
    (begins("t", "o4-mini"), (1.1, 4.4, 0.275, 0.0)),
    (begins("t", "o4"), (2.0, 8.0, 0.5, 0.0)),
    (has("n", "glm-4-7-flashx"), (0.07, 0.4, 0.01, 0.0)),
    (has("n", "glm-4-7"), (0.6, 2.2, 0.11, 0.0)),
    (has("n", "kimi-k2-5"), (0.6, 3.0, 0.1, 0.0)),
    (same("c", "composer-1"), (1.25, 10.0, 0.125, 0.0)),
    (same("c", "composer-1-5"), (3.5, 17.5, 0.35, 0.0)),
    (same("c", "composer-2", "composer-2-5"), (0.5, 2.5, 0.2, 0.0)),
    (same("c", "composer-2-fast", "composer-2-5-fast"), (1.5, 7.5, 0.35, 0.0)),
    (has("n", "gemini-3-5-flash"), (1.5, 9.0, 0.15, 0.0)),
    (has("n", "gemini-3-1-flash-lite"), (0.25, 1.5, 0.025, 0.0)),
    (has("n", "gemini-3-1-pro", "gemini-3-pro"), (2.0, 12.0, 0.2, 0.0), 200_000, (4.0, 18.0, 0.4, 0.0)),
    (has("n", "gemini-3-flash"), (0.5, 3.0, 0.05, 0.0)),
    (has("n", "gemini-2-5-flash-lite"), (0.1, 0.4, 0.01, 0.0)),
    (has("n", "gemini-2-5-flash"), (0.3, 2.5, 0.03, 0.0)),
    (has("n", "gemini-2-0-flash-lite"), (0.075, 0.3, 0.0, 0.0)),
    (has("n", "gemini-2-0-flash"), (0.1, 0.4, 0.025, 0.0)),
    (has("n", "gemini-2-5-pro"), (1.25, 10.0, 0.125, 0.0), 200_000, (2.5, 15.0, 0.25, 0.0)),
    (has("n", "gemini-flash-lite-latest"), (0.1, 0.4, 0.025, 0.0)),
    (has("n", "gemini-flash-latest"), (0.3, 2.5, 0.075, 0.0)),
    (f"({has('m', 'gemini')} AND {has('m', 'flash')})", (0.3, 2.5, 0.075, 0.0)),
    (has("m", "gemini"), (1.25, 10.0, 0.125, 0.0)),
    (has("n", "grok-4-5"), (2.0, 6.0, 0.5, 0.0)),
    (has("n", "grok-4-3"), (1.25, 2.5, 0.2, 0.0)),
    (has("n", "grok-4-1"), (0.2, 0.5, 0.05, 0.0)),
    (has("n", "grok-4"), (3.0, 15.0, 0.75, 0.0)),
    (has("n", "grok-3-mini"), (0.3, 0.5, 0.075, 0.0)),
    (has("n", "grok-3"), (3.0, 15.0, 0.75, 0.0)),
    (has("m", "grok"), (2.0, 6.0, 0.5, 0.0)),
    (same("provider", "anthropic"), (3.0, 15.0, 0.3, 3.75)),
    (same("provider", "openai"), (1.25, 10.0, 0.125, 0.0)),
    (same("provider", "google"), (1.25, 10.0, 0.125, 0.0)),
    (same("provider", "xai"), (2.0, 6.0, 0.5, 0.0)),
    ("TRUE", (0.0, 0.0, 0.0, 0.0)),
)
PARTS = ("input", "output", "cache_read", "cache_write")
COLUMNS = ("price_rule", *[f"{p}_price" for p in PARTS], "tier_at", *[f"{p}_above" for p in PARTS])


def rule_sql() -> str:
    """The number (from 1) of the first rule that holds, over columns _m, _n, _t, _c and _provider."""
    return "CASE " + " ".join(f"WHEN {test} THEN {k}" for k, (test, *_) in enumerate(RULES, 1)) + " END"


def number(value: float | None, kind: str) -> str:
    """A literal of SQL, parsed at once with all others: L for a long, D for a double."""
    return "NULL" if value is None else f"{value}{kind}"


def with_prices(df: DataFrame, model: str = "model_id", provider: str = "provider_id") -> DataFrame:
    """Adds ``COLUMNS``: the rule of each row's model and provider, and its prices from constant arrays.

    Rules run once a row, in its own stage: no join, and no second pass over the rows for their models.
    """
    m = F.lower(F.col(model))
    n = F.translate(m, "._ ", "---")
    t = F.regexp_replace(n, "^.*/", "")
    shaped = df.withColumns({"_m": m, "_n": n, "_t": t, "_c": F.regexp_replace(t, "^grok-", ""), "_provider": F.coalesce(F.col(provider), F.lit(""))})
    ruled = shaped.withColumn("price_rule", F.expr(rule_sql())).drop("_m", "_n", "_t", "_c", "_provider")
    tiers = [tier for _, _, *tier in RULES]
    values = {f"{p}_price": [base[k] for _, base, *_ in RULES] for k, p in enumerate(PARTS)}
    values["tier_at"] = [tier[0] if tier else None for tier in tiers]
    values |= {f"{p}_above": [tier[1][k] if tier else None for tier in tiers] for k, p in enumerate(PARTS)}
    return ruled.withColumns({c: F.expr(f"element_at(array({', '.join(number(v, 'L' if c == 'tier_at' else 'D') for v in vs)}), price_rule)") for c, vs in values.items()})


def price_table(df: DataFrame, model: str = "model_id", provider: str = "provider_id") -> DataFrame:
    """The distinct (model, provider) pairs of ``df`` with their prices."""
    return with_prices(df.select(F.col(model), F.col(provider)).distinct(), model, provider)


def tiered(tokens: Column, price: Column, tier_at: Column, above: Column) -> Column:
    """Marginal: tokens up to the threshold at the price, those beyond at the higher one where there is one."""
    has_tier = tier_at.isNotNull() & above.isNotNull()
    low = F.least(tokens, tier_at)
    return F.when(has_tier, low * price + F.greatest(tokens - tier_at, F.lit(0)) * above).otherwise(tokens * price)


def estimated_cost(input_: Column, output: Column, cache_read: Column, cache_write: Column, reasoning: Column) -> Column:
    """USD of a message whose row has the price columns; reasoning is billed as output."""
    tokens = {"input": input_, "output": output + reasoning, "cache_read": cache_read, "cache_write": cache_write}
    parts = [tiered(F.greatest(t, F.lit(0)), F.col(f"{p}_price"), F.col("tier_at"), F.col(f"{p}_above")) for p, t in tokens.items()]
    return (parts[0] + parts[1] + parts[2] + parts[3]) / 1e6
