"""Removed bytes beside a plain count of all windows."""

import collections
import hashlib
import random

import data
import numpy as np
import pyarrow as pa
import pytest

from readlake.llm import suffixes
from readlake.llm.text import utf8

LENGTH = suffixes.LENGTH


def brute(rows, length=LENGTH):
    raw = [(key, (text or "").encode()) for key, text in rows]
    count = collections.Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for key, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b)))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(9)

    def words(n):
        return " ".join(rng.choice(["ab", "cde", "é", "the", "x", "of"]) + str(rng.randint(0, 9)) for _ in range(n))

    base, passage = words(300), words(60)
    out = [*data.SPECIAL, base, base, "x" * 1000, "x" * 200, "ab" * 300, base[:400] + "!" + base[400:], passage * 2]
    out += [f"{words(rng.randint(0, 80))} {passage} {words(rng.randint(0, 80))}" for _ in range(25)]
    for _ in range(12):
        signs = list(base)
        for _ in range(2):
            signs[rng.randrange(len(signs))] = "#"
        out.append("".join(signs))
    return out


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 3])
def test_removed_bytes(spark, crowd):
    df, rows = data.documents(spark, texts())
    got = [tuple(r) for r in suffixes.remove_repeats(df, crowd=crowd).collect()]
    want = brute([row[:2] for row in rows])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 10_000


def test_kept_bytes_and_length(spark):
    df, rows = data.documents(spark, ["abcdefghijklmnopqrst-1", "2 abcdefghijklmnopqrst", "abcdefghijklmnopqr"])
    found = {r.doc_id: r for r in suffixes.remove_repeats(df, length=20, with_kept=True).collect()}
    assert [bytes(found[k].kept) for k in (1, 2)] == [b"-1", b"2 "]
    assert found[3].n_removed == 0


def test_parts_of_a_long_text_give_the_same_segments(monkeypatch):
    raw, offsets = utf8(pa.array(texts(), pa.string()))

    def segments():
        out = []
        for shift, part, borders in suffixes._pieces(raw, offsets, LENGTH):
            _, place, first, end = suffixes.anchors(part, borders)
            out += [(p + shift, s + shift) for p, a, b in zip(place, first, end) for s in range(a, b - LENGTH + 1)]
        return sorted(out)

    whole = segments()
    monkeypatch.setattr(suffixes, "PIECE", 333)
    assert segments() == whole
    assert len(whole) == sum(max(0, n - LENGTH + 1) for n in np.diff(offsets))


def test_build_up_is_a_suffix_order():
    rng = random.Random(10)
    segments, before, group = [], [], []
    for g in range(30):
        for _ in range(rng.randint(1, 9)):
            segments.append(bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 12))))
            before.append(rng.randint(0, 4))
            group.append(g)
    before = np.minimum(np.array(before), [len(s) - 1 for s in segments])
    got = {(who, at) for who, lo, hi in suffixes.build_up(segments, before, np.array(group), 4) for at in range(lo, hi + 1)}
    windows = collections.defaultdict(set)
    for k, s in enumerate(segments):
        for at in range(len(s) - 3):
            windows[group[k], at - before[k], s[at : at + 4]].add(k)
    assert got == {(k, key[1]) for key, who in windows.items() if len(who) > 1 for k in who}


def test_empty(spark):
    assert suffixes.remove_repeats(data.empty(spark)).count() == 0
