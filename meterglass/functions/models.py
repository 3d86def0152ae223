"""Model ids and the providers that they imply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The clients in registry order, with display names and colours.
CLIENTS = ("claude", "codex", "cursor", "opencode", "gemini", "copilot", "amp", "droid", "hermes", "grok", "omp")

#: Fixed values, in order: what a model id contains or starts with, and its provider.
CONTAINS, STARTS = "contains", "starts"
PROVIDER_RULES = (
    ("anthropic", CONTAINS, ("claude", "sonnet", "opus", "haiku", "fable")),
    ("openai", STARTS, ("gpt-", "o1", "o3", "o4")),
    ("google", CONTAINS, ("gemini",)),
    ("xai", CONTAINS, ("grok",)),
    ("deepseek", CONTAINS, ("deepseek",)),
    ("meta", CONTAINS, ("llama",)),
)
#: What a billing provider contains.
BILLING_RULES = (
    ("anthropic", ("anthropic",)),
    ("openai", ("openai",)),
    ("google", ("google", "gemini")),
    ("xai", ("xai", "grok")),
    ("deepseek", ("deepseek",)),
    ("meta", ("meta", "llama")),
)
#: Routing ids and their providers.
ROUTING = {
    "anthropic": ("anthropic", "anthropic-messages", "claude"),
    "openai": ("openai", "azure", "azure-openai"),
    "google": ("google", "google-vertex", "google-gemini", "gemini"),
    "xai": ("xai",),
}
DEFAULT_MODELS = {"anthropic": "claude-unknown", "openai": "gpt-unknown", "google": "gemini-unknown", "xai": "grok-unknown"}


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def cases(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F
    for test, value in pairs:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def infer_provider(model: Column) -> Column:
    m = F.lower(model)
    rules = [(any_of([m.contains(w) if how == CONTAINS else m.startswith(w) for w in words]), F.lit(p)) for p, how, words in PROVIDER_RULES]
    return cases(rules, F.lit("unknown"))


def billing_provider(billed: Column, model: Column) -> Column:
    """A billing name's provider; an empty one follows the model, an unknown one stays."""
    b = F.lower(F.trim(billed))
    rules = [(any_of([b.contains(w) for w in words]), F.lit(p)) for p, words in BILLING_RULES]
    return cases([*rules, (b == "", infer_provider(model))], b)


def routing_provider(raw: Column) -> Column:
    """A routing id's provider; blank for gateways, so that the model decides."""
    r = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return cases([(r.isin(*ids), F.lit(p)) for p, ids in ROUTING.items()], F.lit(""))


def default_model(provider: Column) -> Column:
    return cases([(provider == p, F.lit(m)) for p, m in DEFAULT_MODELS.items()], F.lit("unknown"))


def normalize_model(model: Column) -> Column:
    """As rollups group it."""
    return F.lower(F.trim(model))


def normalize_live_model(model: Column) -> Column:
    """As live views group it: lower case, without one trailing -YYYYMMDD."""
    return F.regexp_replace(F.lower(model), "(?<=.)-[0-9]{8}$", "")


def normalize_settings_model(model: Column) -> Column:
    """As session settings write it: without custom: and [..], dots, blanks and underscores as single dashes."""
    plain = F.regexp_replace(F.regexp_replace(model, "^custom:", ""), r"\[[^\]]*(\]|$)|\]", "")
    lower = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ._ ", "abcdefghijklmnopqrstuvwxyz---")
    return F.regexp_replace(F.regexp_replace(lower, "-{2,}", "-"), "^-+|-+$", "")


def live_client(client: Column) -> Column:
    """The dashboard's id of a live client."""
    return (
        F.when(client == "claude-code", F.lit("claude"))
        .when(client == "codex-cli", F.lit("codex"))
        .when(client == "gemini-cli", F.lit("gemini"))
        .otherwise(F.regexp_replace(client, "-cli$", ""))
    )


def sidechain_label(path: Column) -> Column:
    """subagent:<stem>, without the stem's agent- prefix."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.concat(F.lit("subagent:"), F.regexp_replace(stem, "^agent-", ""))
