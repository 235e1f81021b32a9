"""Quotation linking beside a plain version."""

import itertools
import random
import re
import time

import pytest

from readlake.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    def split(text):
        out = []
        for line in re.sub("\r\n?", "\n", text or "").split("\n"):
            marks = re.match(r"[ \t>]*>", line) if re.match(r"[ \t]{0,3}>", line) else None
            depth = marks[0].count(">") if marks else 0
            body = re.sub(r"^[ \t>]*>[ \t]?", "", line) if depth else line
            out.append((depth, not norm(body), body))
        return [(d, "\n".join(x[2] for x in run)) for (d, _), run in itertools.groupby(out, key=lambda x: x[:2])]

    def norm(text):
        return re.sub(r"[\W_]+", " ", text.lower()).strip()

    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    turns = sorted({r[:2] for r in rows})
    originals = {(r[0], r[1], norm(t)) for r in rows for d, t in split(r[3]) if d == 0 and norm(t)}
    found = {}
    for conv, turn in turns:
        linked = []
        for r in rows:
            if r[:2] == (conv, turn):
                for d, t in split(r[3]):
                    if d and norm(t):
                        best = max((o[1] for o in originals if o[0] == conv and o[1] < turn and o[2] == norm(t)), default=None)
                        linked.append((d, best))
        earlier = [t for c, t in turns if c == conv and t < turn]
        quoted = max((b for d, b in linked if d == 1 and b is not None), default=None)
        reply = quoted if quoted is not None else earlier[-1] if earlier else None
        found[conv, turn] = len(earlier) + 1, reply, len(linked), sum(b is not None for _, b in linked)
    out = []
    for conv, turn, role, text in rows:
        position, reply, n_quotes, n_linked = found[conv, turn]
        message = re.sub("\n{3,}", "\n\n", "\n".join(t for d, t in split(text) if d == 0).strip(" \t\r\n"))
        role = "unknown" if role is None else role
        out.append((conv, turn, position, role, reply, n_quotes, n_linked, message, f"<|{role}|>\n{message}\n<|end|>\n"))
    return out


def conversations():
    rng = random.Random(12)
    rows = [
        (1, 0, "user", "Hello there,\nfriend!\n\nSecond para"),
        (1, 1, "bot", "> hello there\n> friend\n\nHi. a > b"),
        (1, 2, "user", ">> Hello there, friend\n> Hi. A > b\nnew words"),
        (1, 3, None, "> second PARA\r\nyes\n > unknown quote\n\n\n\n\nmore"),
        (1, 4, "x", None),
        (1, 9, "x", "> Hello there friend\n>\n> > new words"),
        (2, 5, "u", ">\n>"),
        (2, 5, "u", ">\n>"),
        (2, 9, "a", "> x\nHello there,\nfriend!"),
        (2, 10, "a", "> Hello there, friend!"),
        (None, 1, "u", "q"),
        (3, None, "u", "q"),
        (4, 7, "", ""),
    ]
    lines = ["ok", "fine then", "what is it", "no", "so be it", ""]
    for conv in (10, 11):
        for turn in rng.sample(range(6000), 60):
            marks = rng.choice(["> ", ">> ", "", "> > ", ">"])
            parts = [*(marks + rng.choice(lines) for _ in range(2)), rng.choice(lines), "", "> " + rng.choice(lines), rng.choice(lines)]
            rows.append((conv, turn, rng.choice(["a", "b"]), "\n".join(parts)))
    return rows


@pytest.mark.parametrize("block", [quotes.BLOCK_TURNS, 50])
def test_chat_format(spark, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK_TURNS", block)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    df = df.selectExpr("*", *(f"1 AS `{c}`" for c in ("position", "message", "passage", "depth", "_no", "block", "quote_hash")))
    got = [tuple(r) for r in quotes.chat_format(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_given_table_with_quotes_made_from_it(spark, sf_dir):
    """Each second message quotes the whole message before it, at depth one, and is linked to it."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = {(r.conv_id, r.turn): r.text for r in given.collect()}
    rows = []
    for r in given.collect():
        before = text.get((r.conv_id, r.turn - 1))
        quoted = "\n".join("> " + line for line in before.split("\n")) + "\n" if before and r.turn % 2 else ""
        rows.append((r.conv_id, r.turn, r.role, quoted + r.text))
    found = quotes.chat_format(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    assert all(r.message == text[r.conv_id, r.turn].strip() for r in found)
    assert all(r.n_quotes == r.n_linked for r in found) and sum(r.n_quotes for r in found) > 20
    assert all(r.reply_to == r.turn - 1 for r in found if r.n_quotes)


def test_empty(spark):
    assert quotes.chat_format(spark.createDataFrame([], SCHEMA)).count() == 0


def test_messages_of_many_lines_take_linear_time(spark):
    def lines(n):
        return [f"> asked {k}" if k % 3 == 0 else "" if k % 7 == 0 else f"line {k}" for k in range(n)]

    def passages(n):
        return sum(k % 3 == 0 for k in range(n))

    rows = [(1, 0, "user", "asked 0\n\nhello"), (1, 1, "user", "\n".join(lines(50_000)))]
    start = time.perf_counter()
    got = quotes.chat_format(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert time.perf_counter() - start < 60
    long = next(r for r in got if r.turn == 1)
    assert (long.n_quotes, long.n_linked, long.reply_to) == (passages(50_000), 1, 0)
    assert long.message.split() == [w for k in range(50_000) if k % 3 and k % 7 for w in ("line", str(k))]
