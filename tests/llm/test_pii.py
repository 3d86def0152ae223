import hashlib
import random
import re

from helpers import AWKWARD, docs
from meterglass.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PIECES = ["a@b.c", "@", ".", "+1 (555) 555-0100", "1", "22", "256", "-", " ", "4111 1111 1111 1111", "é", "𝒳", "_", "%", "x", "10.0.0.1", "0", "4111111111111111", "\n", "(", ")"]


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_against_plain_patterns(spark):
    r = random.Random(5)
    rows = [(100 + i, "".join(r.choice(PIECES) for _ in range(r.randint(0, 25)))) for i in range(400)]
    rows += [*AWKWARD, (90, "1" * 20_000), (91, "a" * 20_000), (92, "1 " * 5_000), (93, "a@" + "b." * 5_000 + "c")]
    got = P.digest(P.find_pii(docs(spark, rows, extra=True))).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for x in got:
        want = brute(text[x["doc_id"]])
        assert x["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text[x["doc_id"]]
        assert [x[f"n_{k}"] for k in PATTERNS] == [want.count(f"{k}:") for k in PATTERNS]


def test_added_kinds_and_context(spark):
    rows = [(1, "my iban is GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, 'api_key = "abcdefghij0123456789"'), (4, "call +1 555 555 0100"), (5, "see +1 555 555 0100")]
    got = {r["doc_id"]: r for r in P.digest(P.find_pii(docs(spark, rows))).collect()}
    assert got[1]["spans"] == "iban:11:38" and got[2]["spans"] == "" and got[3]["spans"].startswith("secret:0:")
    assert got[4]["top_score"] > got[5]["top_score"] > 0 == got[2]["top_score"]
    text = {r["doc_id"]: r["text"] for r in P.redact(docs(spark, rows)).collect()}
    assert text[1] == "my iban is [IBAN]." and text[4] == "call [PHONE]"


def test_native_plan_and_empty(spark):
    df = P.digest(P.find_pii(docs(spark, [])))
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_very_many_matches(spark):
    """Places and contexts hold across blocks of matches, and time doesn't grow with their square."""
    r = random.Random(8)
    mixed = "".join(r.choice([*PIECES, "mail ", "card ", "call "]) for _ in range(30_000))
    rows = [(1, "a@b.c " * 100_000), (2, mixed), (3, "7 12 " * 3_000 + "x card 4111111111111111")]
    got = {x["doc_id"]: x for x in P.digest(P.find_pii(docs(spark, rows))).collect()}
    assert got[1]["n_email"] == 100_000
    for i, t in rows:
        assert got[i]["base_sha256"] == hashlib.sha256(brute(t).encode()).hexdigest()
    scores = {x["doc_id"]: x["found"] for x in P.find_pii(docs(spark, rows[1:])).collect()}
    for i, t in rows[1:]:
        for s in scores[i]:
            kind = P.KINDS[s["place"]]
            near = re.search(kind.context, t[max(0, s["start"] - P.CONTEXT) : s["start"]].lower())
            assert s["score"] == kind.score + (P.CONTEXT_SCORE if near else 0.0)
    text = {x["doc_id"]: x["text"] for x in P.redact(docs(spark, rows)).collect()}
    assert text[1] == "[EMAIL] " * 100_000
    out, at = [], 0
    for s in scores[2]:
        if s["start"] >= at:
            out += [mixed[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = s["end"]
    assert text[2] == "".join(out) + mixed[at:]
