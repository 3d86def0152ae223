"""Names, plans, money and account labels as quota views show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How some words of a limit's name are written.
SPECIAL_WORDS = {"gpt": "GPT", "codex": "Codex"}
DISPLAY_NAMES = {
    "claude": "Claude", "codex": "Codex", "cursor": "Cursor", "opencode": "OpenCode", "gemini": "Gemini", "copilot": "Copilot", "amp": "Amp", "droid": "Droid", "hermes": "Hermes", "grok": "Grok", "omp": "Omp",
}


#: The colours of clients in charts, and of all others.
COLORS = {
    "claude": "#d97706", "openclaw": "#dc2626", "gemini": "#60a5fa", "opencode": "#1f2937", "codex": "#9ca3af", "copilot": "#1f2937", "cursor": "#0ea5e9", "amp": "#10b981", "droid": "#22c55e", "hermes": "#a78bfa",
    "grok": "#111827", "pi": "#f472b6", "kimi": "#fbbf24", "qwen": "#7c3aed", "roocode": "#ef4444", "kilocode": "#f97316", "kilo": "#f59e0b", "mux": "#06b6d4", "crush": "#ec4899", "synthetic": "#64748b",
}
OTHER_COLOR = "#6b7280"


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))


def words(text: Column) -> Column:
    """Words between blanks, dashes and underscores."""
    return F.filter(F.split(F.translate(text, "_-", "  "), r"\s+"), lambda w: w != "")


def limit_label(text: Column) -> Column:
    def shown(w: Column) -> Column:
        out = F
        for word, text_ in SPECIAL_WORDS.items():
            out = out.when(F.lower(w) == word, F.lit(text_))
        return out.otherwise(capitalised(w))

    return F.array_join(F.transform(words(text), shown), " ")


def extra_limit_label(name: Column, feature: Column) -> Column:
    source = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(feature), F.lit("")), F.lit("Codex extra limit"))
    return F.when(F.lower(source).contains("spark"), F.lit("Codex Spark")).otherwise(limit_label(source))


def plan_label(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, "[_-]"), lambda w: w != ""), capitalised), " ")


def title_words(text: Column) -> Column:
    return F.array_join(F.transform(words(text), lambda w: capitalised(F.lower(w))), " ")


def tier_label(text: Column) -> Column:
    return title_words(F.regexp_replace(F.regexp_replace(text, "^(SUBSCRIPTION_TIER_)+", ""), "^(TIER_)+", ""))


def is_active(status: Column) -> Column:
    upper = F.upper(F.trim(status))
    return (upper == "ACTIVE") | upper.endswith("STATUS_ACTIVE")


def two_places(x: Column) -> Column:
    return F.regexp_replace(F.format_number(x, 2), ",", "")


def minor_units(value: Column, currency: Column) -> Column:
    """Cents as $1.23, other currencies as 1.23 EUR."""
    code = F.upper(F.trim(F.coalesce(currency, F.lit("USD"))))
    amount = two_places(value / 100)
    return F.when(code.isin("USD", ""), F.concat(F.lit("$"), amount)).otherwise(F.concat(amount, F.lit(" "), code))


def cycle_label(start_ms: Column, end_ms: Column) -> Column:
    """Weekly for 6 to 8 days, Monthly for 27 to 33, else Credits."""
    days = F.call_function("div", end_ms - start_ms, F.lit(86_400_000))
    return F.when(days.between(6, 8), F.lit("Weekly")).when(days.between(27, 33), F.lit("Monthly")).otherwise(F.lit("Credits"))


def display_name(client: Column) -> Column:
    out = F
    for k, v in DISPLAY_NAMES.items():
        out = out.when(client == k, F.lit(v))
    return out.otherwise(F.initcap(F.translate(client, "-_", "  ")))


def client_color(client: Column) -> Column:
    out = F
    for k, v in COLORS.items():
        out = out.when(client == k, F.lit(v))
    return out.otherwise(F.lit(OTHER_COLOR))


def jwt_claim(token: Column, claim: str) -> Column:
    """A text claim of a JSON web token's payload, unverified; null where it isn't one."""
    part = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = F.concat(part, F.repeat(F.lit("="), F.pmod(-F.length(part), F.lit(4))))
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), f"$.{claim}")
