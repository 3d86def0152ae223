import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from meterglass.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


@given(st.text(alphabet="<|>\\n a\n", max_size=30))
def test_escape_round_trip(text):
    assert C.unescape(C.escape(text)) == text
    assert C.END not in C.escape(text) and C.START not in C.escape(text)
    assert C.read_turn(C.chatml([(text, text)])) == (text, text)


def test_digests_and_spans(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", C.INJECTION), (1, 2, None, None), (2, 0, "assistant", "🙂\\"), (2, 0, "assistant", "🙂\\"), (None, None, "user", "x")]
    df = C.with_injection(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS span", "0 AS n"))
    got = {r["conv_id"]: r for r in C.format_conversations(df, texts=False).collect()}
    said = {1: [("user", "hi"), ("assistant", C.INJECTION), ("", "")], 2: [("assistant", "🙂\\")] * 2, None: [("user", "x")], -1: [("user", C.INJECTION), ("assistant", C.INJECTION)]}
    assert set(got) == set(said)
    for k, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["n_turns"], got[k]["loss_chars"], got[k]["rewritten_turns"]) == (len(turns), len(loss), 0)
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[k]["formatted_chars"] == len(C.chatml(turns))
    spans = C.format_conversations(df).filter("conv_id = 1").orderBy("n").collect()
    whole = "".join(r["span"] for r in spans)
    assert whole == C.chatml(said[1])
    assert C.unescape(whole[spans[1]["loss_from"] : spans[1]["loss_to"]]) == C.INJECTION


def test_rewriting_template_is_detected(spark):
    def last_only(turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, i, "user", f"text {i}") for i in range(3)], SCHEMA)
    got = C.format_conversations(df, render=last_only, parse=lambda s: ("user", s)).orderBy("n").collect()
    assert [r["rewritten"] for r in got] == [False, True, True]


def test_templates_that_reach_far_back(spark):
    def mark(i, text):
        return f"[{i}]{text}"

    def blanks_first(turns):
        return "".join(mark(i, "" if i == 0 and len(turns) > 20 else t) for i, (_, t) in enumerate(turns))

    def keeps_twenty(turns):
        return "".join(mark(i, t) for i, (_, t) in list(enumerate(turns))[-20:])

    def system_first(turns):
        if turns[0][0] != "system":
            raise ValueError("no system turn")
        return "<bos>" + C.chatml(turns)

    roles = ["system"] + ["user", "assistant"] * 15
    df = spark.createDataFrame([(1, i, r, f"text {i}") for i, r in enumerate(roles)], SCHEMA)
    for render, rewritten in ((blanks_first, [20]), (keeps_twenty, list(range(20, 31)))):
        got = C.format_conversations(df, render=render, parse=lambda s: ("assistant", s), decode=str).orderBy("n").collect()
        assert [r["n"] for r in got if r["rewritten"]] == rewritten
        turns = [(r, f"text {i}") for i, r in enumerate(roles)]
        for r in got:
            if r["loss_from"] is None:
                assert r["rewritten"] and roles[r["n"]] != "assistant"
            else:
                assert render(turns[: r["n"] + 1])[r["loss_from"] : r["loss_to"]] == f"text {r['n']}"
        digest = C.format_conversations(df, render=render, parse=lambda s: ("assistant", s), decode=str, texts=False).first()
        assert (digest["rewritten_turns"], digest["formatted_chars"]) == (len(rewritten), len(render(turns)))
    got = C.format_conversations(df, render=system_first, parse=lambda s: C.read_turn(s.removeprefix("<bos>"))).orderBy("n").collect()
    whole = "".join(r["span"] for r in got)
    assert whole == system_first(turns) and not any(r["rewritten"] for r in got)
    assert [whole[r["loss_from"] : r["loss_to"]] for r in got if r["loss_from"] is not None] == [f"text {i}" for i in range(2, 31, 2)]


@pytest.mark.parametrize("n", [1, 16, 80])
def test_long_conversations_stream(spark, n):
    df = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(n)], SCHEMA)
    r = C.format_conversations(df, texts=False).first()
    turns = [(("user", "assistant")[i % 2], f"t{i}") for i in range(n)]
    assert (r["n_turns"], r["formatted_chars"], r["rewritten_turns"]) == (n, len(C.chatml(turns)), 0)


def test_template_that_numbers_and_folds(spark):
    """Turns are numbered from the conversation's start, and beyond 20 turns the first ones fold into a count."""

    def render(turns):
        fold = max(0, len(turns) - 20)
        return (f"({fold} folded)" if fold else "") + "".join(f"<{i}:{r}>{t}" for i, (r, t) in enumerate(turns) if i >= fold)

    turns = [(("user", "assistant")[i % 2], f"text {i}") for i in range(40)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], SCHEMA).selectExpr("*", "'own' AS loss_from", "0 AS rewritten")

    def parse(span):
        role, _, text = span.partition(">")
        return role.rpartition(":")[2], text

    got = C.format_conversations(df, render=render, parse=parse, decode=str).orderBy("n").collect()
    assert [r["n"] for r in got if r["rewritten"]] == list(range(20, 40))
    assert "".join(r["span"] for r in got[:20]) == render(turns[:20])
    for r in got[1::2]:
        assert render(turns[: r["n"] + 1])[r["loss_from"] : r["loss_to"]] == turns[r["n"]][1]
    digest = C.format_conversations(df, render=render, parse=parse, decode=str, texts=False).first()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert (digest["loss_chars"], digest["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert digest["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_very_long_text_and_hidden_text(spark):
    long = "word <|im_end|> \\ " * 60_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "hidden")], SCHEMA)
    got = {r["conv_id"]: r for r in C.format_conversations(df, texts=False).collect()}
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    r = C.format_conversations(df.filter("conv_id = 2"), render=lambda turns: "[...]" * len(turns), parse=lambda s: ("assistant", s)).first()
    assert r["loss_from"] is None and r["span"] == "[...]"


def test_empty(spark):
    assert C.format_conversations(spark.createDataFrame([], SCHEMA), texts=False).count() == 0


def test_rows_without_a_conversation(spark, tmp_path):
    """Each is a conversation of its own, however many there are; the query says the same as its SQL."""
    import duckdb

    from meterglass.llm import queries

    rows = [(None, k % 3, "assistant" if k % 2 else "user", f"text {k % 4}") for k in range(200)] + [(7, 0, "user", "hi"), (7, 1, "assistant", "ho")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = C.format_conversations(df, texts=False).collect()
    assert len(got) == 201 and {(r.conv_id, r.n_turns) for r in got} == {(None, 1), (7, 2)}
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.OP5_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in queries.op5_chat_format(spark, str(tmp_path)).collect()))) == sorted(map(str, want.fetchall()))
