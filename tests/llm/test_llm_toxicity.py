import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.llm import toxicity
from readlake.llm.toxicity import ATTACK, DENIED, KINDS, MENACE, PLAIN, REPORTED, _given, fit, matched, toxicity as score

from data import SPECIAL, documents, empty

WORDS = _given({w: 1.0 for w in toxicity.LEXICON[toxicity.INSULT].split()})


def kinds(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n int, text string")
    return [r.kinds for r in matched(df, WORDS, "text", "kinds").orderBy("n").collect()]


CLAUSES = [
    ("What an idiot.", PLAIN, 1.0),
    ("A very stupid thing", PLAIN, toxicity.STRENGTHENED),
    ("You are an idiot", ATTACK, 1.0),
    ("you are such a MORON!", ATTACK, toxicity.STRENGTHENED),
    ("I will kill you", MENACE, 1.0),
    ("I am gonna really hurt all these people", MENACE, 1.0),
    ("he is not an idiot", DENIED, 1.0),
    ("I will not hurt you", DENIED, 1.0),
    ("she said that he is an idiot", REPORTED, 1.0),
    ("she said it. idiot", PLAIN, 1.0),
    ("not now; idiot", PLAIN, 1.0),
    ("du bist ein Trottel", ATTACK, 1.0),
    ("you one two three four five idiot", PLAIN, 1.0),
]


@pytest.mark.parametrize("case", range(len(CLAUSES)))
def test_clauses(spark, case):
    text, kind, weight = CLAUSES[case]
    wanted = [0.0] * len(KINDS)
    wanted[kind] = weight
    assert kinds(spark, [text]) == [wanted]


def test_nothing_matches(spark):
    texts = ["", None, "they kill time", "idiotic", "ididiot", "a scumbag", "they say you are right", "x" * 10000]
    assert kinds(spark, texts) == [[0.0] * len(KINDS)] * len(texts)


def test_composed_machine_equals_the_cascade():
    """The tables do word by word what the transducers do one after another."""
    parts = [toxicity._strengthen(), toxicity._threaten(), toxicity._bind(), toxicity._deny(), toxicity._report()]
    following, said, factor = toxicity.grammar()
    rng = random.Random(1)
    for _ in range(300):
        state, states = 0, [0] * len(parts)
        for _ in range(30):
            symbol = rng.choice([0, 0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 7, 8])
            now, times = symbol, 1.0
            for k, part in enumerate(parts):
                states[k], now, by = part.step(states[k], now)
                times *= by
            assert said[state][symbol] == (toxicity.NOTHING if now == toxicity.END else now)
            assert factor[state][symbol] == times
            state = following[state][symbol]


def test_many_texts_equal_one_by_one(spark):
    """Texts, clauses and words of one slice do not run into each other."""
    rng = random.Random(2)
    vocabulary = "idiot not you will kill said very the of . ; trash them x\n".split(" ")
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    following, said, factor = toxicity.grammar()
    known = {w: (k, x) for w, k, x in WORDS}
    for got, text in zip(kinds(spark, texts), texts):
        wanted, state = [0.0] * len(KINDS), 0
        for word in text.replace("\n", " . ").split():
            kind, weight = known.get(word, (toxicity.END if word in ".;" else toxicity.OTHER, 1.0))
            out = said[state][kind]
            if out != toxicity.NOTHING:
                wanted[out] += (weight if kind == toxicity.INSULT else 1.0) * factor[state][kind]
            state = following[state][kind]
        assert got == pytest.approx(wanted)


def corpus(spark, n=600):
    """Toxic texts have an invented insult; a text copied with changes is toxic by label alone."""
    rng = random.Random(7)
    rows, told = [], []
    for k in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(40)]
        toxic = k % 8 == 0
        if toxic:
            words.insert(rng.randint(0, 39), "Zorkhead")
        if k % 8 == 1:
            words, toxic = ["lorem", "copied"] * 8 + [f"tail{k}"], True
        rows.append((k, " ".join(words)))
        told.append((k, 1, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(told, "doc_id long, quality int, toxic int"))


def test_learns_insults_from_different_texts_only(spark):
    docs, labels = corpus(spark)
    model = fit(docs, labels, learn_from=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    learned = {w: x for w, kind, x in model.words if kind == toxicity.INSULT}
    assert learned.get("zorkhead", 0) > 0.8
    assert not {"lorem", "copied"} & learned.keys()
    held_out = {k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1}
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert all(got[k].predicted == 1 for k in held_out if k % 8 == 0)
    assert all(got[k].predicted == 0 for k in held_out if k % 8 not in (0, 1))


def test_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = score(docs, fit(docs, labels, learn_from=~held)).join(labels, "doc_id").where(held).collect()
    insults = set(toxicity.LEXICON[toxicity.INSULT].split())
    texts = {r.doc_id: set((r.text or "").lower().replace(".", " ").replace(",", " ").split()) for r in docs.collect()}
    bad = [r for r in rows if r.toxic == 1 and texts[r.doc_id] & insults]
    assert len(bad) > 5
    assert all(r.predicted == 1 for r in bad)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(rows)


def test_edge_cases(spark):
    df, rows = documents(spark, SPECIAL + ["you idiot"])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = fit(df, labels)
    got = score(df, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.doc_id for r in got if r.attack] == [len(SPECIAL) + 1] * 2  # the row comes twice
    none = fit(empty(spark), labels.limit(0))
    assert np.array_equal(none.weights, toxicity.PRIOR)
    assert score(empty(spark), none).collect() == []
