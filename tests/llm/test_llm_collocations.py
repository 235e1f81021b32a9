import random
import re
from collections import Counter

import pytest

from readlake.llm import collocations
from readlake.llm.collocations import collocations as find

from data import SPECIAL, documents, empty, words

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, min_count, top):
    """The definition, word by word."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            found = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(found)
            for size in (1, 2, 3):
                for i in range(len(found) - size + 1):
                    key = tuple(found[i : i + size])
                    counts.setdefault(lang, Counter())[key] += 1
    out = []
    for lang, own in counts.items():
        chosen = {k: a for k, a in own.items() if len(k) > 1 and a >= min_count}
        kept = []
        for phrase, a in chosen.items():
            if any(
                len(other) > len(phrase) and 100 * f >= 50 * a
                and any(other[i : i + len(phrase)] == phrase for i in range(len(other) - len(phrase) + 1))
                for other, f in chosen.items()
            ):
                continue
            cuts = [(1000000 * a * a // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def result(df):
    assert df.columns == COLUMNS
    assert all(kind in ("bigint", "string") for _, kind in df.dtypes)
    return sorted(tuple(r) for r in df.collect())


def texts():
    rng = random.Random(5)
    base = ["New York city is; in new york", "ÄB äb the the the the the", "a.b,c:d!e?f\ng\x0bh\x0ci\rj k\tl"]
    return SPECIAL + base * 12 + [words(rng, rng.randint(1, 300)) for _ in range(40)]


@pytest.mark.parametrize(("min_count", "top"), [(10, 2000), (3, 2000), (2, 7)])
def test_equals_brute_force(spark, min_count, top):
    df, rows = documents(spark, texts())
    wanted = brute([(r[2], r[1]) for r in rows], min_count, top)
    assert len(wanted) > 5
    assert result(find(df, min_count=min_count, top=top)) == wanted


def test_small_parts_and_heavy_words(spark, monkeypatch):
    """Stripes of every size of text and row, with all frequent words dealt out in portions."""
    df, rows = documents(spark, texts())
    wanted = brute([(r[2], r[1]) for r in rows], 3, 2000)
    heavy = {(lang, word): 7 for lang in ("en", "de", "und") for word in ("the", "new", "word", "ab", "the0", "of1")}
    cut = collocations.stripes(df, heavy, "text", "lang").selectExpr("lang", "first", "portion").distinct().collect()
    assert {r.portion for r in cut if r["first"] == "the0"} > {0}
    monkeypatch.setattr(collocations, "_portions", lambda words: heavy)
    assert result(find(df, min_count=3)) == wanted


def test_long_texts_are_counted_in_overlapping_blocks(spark):
    """In this process, with blocks of 64 words, so that texts cross them."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    text = words(rng, 1000)
    block = collocations._Words(pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]}))
    whole = Counter()
    for portion_size in (64, 1 << 20):
        found = Counter()
        old, collocations.BLOCK_WORDS = collocations.BLOCK_WORDS, portion_size
        try:
            for begin in range(0, block.n, portion_size):
                part = collocations._stripes(block, begin, np.ones(len(block.words) + 1, np.int64))
                for row in part.to_pylist():
                    for entry, n in zip(row["next"].split("\n"), row["n"], strict=True):
                        found[row["first"], entry] += n
        finally:
            collocations.BLOCK_WORDS = old
        whole = whole or found
        assert found == whole


def test_empty_table_and_no_words(spark):
    assert result(find(empty(spark))) == []
    assert result(find(documents(spark, [None, "", " \n", "one"])[0])) == []
