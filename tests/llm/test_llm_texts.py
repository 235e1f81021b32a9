"""Token counts and quality rules beside plain versions."""

import collections
import random
import re

import data
import public_tokenizers
import pytest
import sentencepiece

from readlake.llm import quality, tokens

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def texts():
    rng = random.Random(1)
    out = list(data.SPECIAL)
    out += ["".join(rng.choice("ab \n▁é<") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    passage = data.words(rng, 90)
    out += [f"{data.words(rng, 200)} {passage} {data.words(rng, 30)} {passage}", f"{passage}\n{passage}\n{passage}"]
    return out


def test_token_counts(spark):
    df, rows = data.documents(spark, texts())
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = tokens.token_counts(df, MODEL, limit=100).collect()
    want = []
    for key, text, *_ in rows:
        n = len(model.encode(text or ""))
        want.append((key, len((text or "").encode()), n, n > 100))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_counts_without_safe_cuts(monkeypatch):
    counter = tokens.Counter(MODEL)
    assert counter.cuts
    sample = [text for text in texts() if text][:20]
    cut = counter.count(sample)
    counter.cuts = False
    assert counter.count(sample) == cut
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    counter.cuts = True
    assert counter.count(sample) == cut == counter.count(sample)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated_lines += line in seen
            seen.add(line)

    def covered(width):
        windows = [tuple(words[i : i + width]) for i in range(n - width + 1)]
        count = collections.Counter(windows)
        return len({j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + width)})

    longest = max((k for k in range(8, n) if covered(k)), default=0) if covered(8) else 0
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated_lines, covered(8), covered(16), longest


def test_quality_counts(spark):
    some = [text for text in texts() if len(text or "") < 4000] + ["a# *b$%&|<> c\nline\nline\n\tline"]
    df, rows = data.documents(spark, some)
    got = {tuple(r)[:8] for r in quality.quality_rules(df).select("doc_id", *quality.COLUMNS).collect()}
    assert got == {(key, *brute_quality(text)) for key, text, *_ in rows}


def test_quality_verdicts(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    plain = " ".join(f"w{k}" for k in range(400))
    cases = {
        plain: (False, True),
        "few words": (True, False),
        None: (True, False),
        "same line of eight words is repeated here\n" * 9: (True, False),
        f"{passage} {plain} {passage}": (False, False),  # a long repeat
        f"{plain} {data.words(rng, 3)} w1 w2 w3 w4 w5 w6 w7 w8 w9 w10": (False, True),  # a short one
    }
    df, _ = data.documents(spark, list(cases))
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_rules(df).collect()}
    assert [got[k + 1] for k in range(len(cases))] == list(cases.values())


@pytest.mark.parametrize("find", [quality.quality_rules, lambda df: tokens.token_counts(df, MODEL)])
def test_empty_table(spark, find):
    assert find(data.empty(spark)).count() == 0


def test_lines_and_words_made_to_have_equal_sums(spark):
    """A sequence of Thue and Morse and its complement agree in any sum modulo 2^64."""
    signs = "a"
    while len(signs) < 4096:
        signs += signs.translate(str.maketrans("ab", "ba"))
    other = signs.translate(str.maketrans("ab", "ba"))
    df, _ = data.documents(spark, [f"{signs}\n{other}", f"{signs}\n{signs}"])
    got = {r.doc_id: r.n_dup_lines for r in quality.quality_rules(df).collect()}
    assert (got[1], got[2]) == (0, 1)


def test_a_long_repeat_in_a_longer_text(spark):
    """A repeat of 500 words or more is not kept, whatever its share of the text."""
    fresh = iter(f"w{k}" for k in range(100_000))

    def text(repeat, n):
        part = [next(fresh) for _ in range(repeat)]
        return " ".join([*part, *(next(fresh) for _ in range(n - 2 * repeat)), *part])

    df, _ = data.documents(spark, [text(1900, 20_000), text(500, 20_000), text(499, 20_000)])
    got = {r.doc_id: r.kept for r in quality.quality_rules(df).collect()}
    assert [got[k] for k in (1, 2, 3)] == [False, False, True]
