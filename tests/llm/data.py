"""Small tables with the cases every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, in other cases too, beside the columns they read.
CLASHING = (
    "found spans Text_hash kept_id fp root component_id size target taken copies row _no _first _row _source k1 k2 _text "
    "ranges anchor digest text_key item_ids Found_ coverage label key digest_ buckets id"
).split()

SPECIAL = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "a ",
    "  b",
    "12 34",
    "é" * 30 + " " + "é" * 30,
    "　a\xa0b",
    "▁ x▁▁y ▁",
    "<s> </s> <unk>",
    "one\n\ntwo\none\n  \none",
    "word " * 400,
    "ab " * 3000,
    "x" * 5000,
    "a 𝒳 b",
]


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "und", "été", "x", "Big", "cat."]) + str(rng.randint(0, 9)) for _ in range(n))


def documents(spark, texts, clashing: bool = True, partitions: int = 3):
    """Rows with ids 1, 2, ...; one id is null, one row comes twice; more columns clash."""
    rows = [(k + 1, text, ["en", "de", None][k % 3], ["s0", "s1", None][k % 3], len(text or "")) for k, text in enumerate(texts)]
    rows += [(None, "a row without an id", None, None, None), rows[-1]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    if clashing:
        df = df.selectExpr("*", *(f"'clash' AS `{c}`" for c in CLASHING))
    return df, rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
