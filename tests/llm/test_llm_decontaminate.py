"""String tiling beside a plain greedy version."""

import random
import re

import data
import pytest

from readlake.llm import decontaminate as d


def tokens(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_tiles(text, item, least=5):
    """Covered words of the item and the longest tile, by looking for the longest match again and again."""
    a, b = tokens(text), tokens(item)
    used_a, used_b, longest = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return len(used_b), longest, len(b)
        longest = longest or k
        used_a |= set(range(i, i + k))
        used_b |= set(range(j, j + k))


ITEMS = [
    "Alpha beta gamma delta epsilon zeta eta theta iota kappa, lambda mu nu xi omicron pi rho sigma tau upsilon.",
    "one two three four five six seven eight nine ten eleven twelve",
    "too short item",
    None,
    "one two three four five one two three four five one two three four five",
]


def documents():
    rng = random.Random(6)
    alpha, numbers = ITEMS[0].split(), ITEMS[1].split()
    texts = [
        *data.SPECIAL,
        "before " + ITEMS[0] + " after",
        "BEFORE " + ITEMS[0].upper().replace(" ", " -- ") + " after",
        "x " + " ".join(alpha[10:]) + " moved " + " ".join(alpha[:10]) + " y",
        "x " + " ".join(alpha[:9]) + " only a part",
        "x " + " ".join(alpha[:16]) + " four fifths",
        " ".join(numbers[:4]) + " . " + " ".join(numbers[5:9]),
        ITEMS[1] + " " + ITEMS[0],
        "one two three four five " * 3,
        "too short item",
    ]
    pool = alpha[:9] + numbers[:7]
    for _ in range(25):
        texts.append(" ".join(" ".join(pool[k : k + rng.randint(1, 8)]) for k in [rng.randrange(len(pool)) for _ in range(6)]))
    return texts


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 60])
def test_tiles(spark, block_bytes):
    df, rows = data.documents(spark, documents())
    bench = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(ITEMS)], "item_id long, text string, doc_id string")
    got = {(r.doc_id, tuple(r.item_ids), round(r.best_coverage, 9), r.longest_tile, r.contaminated, r.n_items)
           for r in d.contamination(df, bench, block_bytes=block_bytes).collect()}
    want = set()
    for key, text, *_ in rows:
        found = [brute_tiles(text[:2000] if text and len(set(text)) < 4 else text, item) for item in ITEMS]
        shares = [c / n if n else 0.0 for c, _, n in found]
        ids = tuple(k for k, s in enumerate(shares) if s >= 0.8)
        want.add((key, ids, round(max(shares), 9), max(f[1] for f in found), bool(ids), len(ids)))
    assert got == want
    kept = d.clean(df, bench, block_bytes=block_bytes)
    assert kept.columns == df.columns
    contaminated = {w[0] for w in want if w[4]}
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == sorted(
        (r[0], r[1]) for r in rows if r[0] and r[0] not in contaminated
    ) or any(r[1] is None for r in rows)
    assert kept.count() == sum(r[0] not in contaminated for r in rows)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, ITEMS[0])], "item_id long, text string")
    assert d.contamination(data.empty(spark), bench).count() == 0
    df, rows = data.documents(spark, ["some text", None])
    found = d.contamination(df, bench.limit(0)).collect()
    assert len(found) == len(rows) and not any(r.contaminated for r in found)
