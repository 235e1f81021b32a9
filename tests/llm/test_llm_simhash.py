"""Fingerprints, links and components beside brute force."""

import random
import re

import data
import numpy as np
import pytest
import xxhash

from readlake.llm import simhash
from readlake.llm.components import components


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, threshold=2):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(x) for x in range(len(prints))]


def texts():
    rng = random.Random(3)
    out = list(data.SPECIAL)
    base = [data.words(rng, 150) for _ in range(8)]
    for text in base * 2:
        for _ in range(4):
            parts = text.split()
            parts[rng.randrange(len(parts))] = "changed"
            out.append(" ".join(parts))
    return out + base + [base[0].upper()]


def test_code_covers():
    rng = np.random.default_rng(1)
    fp = rng.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64)
    row, anchor, home = simhash.anchors(fp, 2)
    assert home.sum() == len(fp)  # a perfect code has one nearest word
    homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
    for flips in ((), (0,), (22, 23), (45, 46), (63, 1), (5, 6)):
        near = fp.copy()
        for bit in flips:
            near = near ^ np.array(1 << bit, np.uint64).astype(np.int64)
        of, to, _ = simhash.anchors(near, 2)
        met = set(zip(of.tolist(), to.tolist()))
        assert all((k, homes[k]) in met for k in range(len(fp)))


@pytest.mark.parametrize("dense", [simhash.DENSE_HOME, 0])
def test_near_duplicates(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE_HOME", dense)
    df, rows = data.documents(spark, texts())
    prints = [brute_fingerprint(row[1]) for row in rows]
    groups = brute_groups(prints)
    names = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in groups}
    want = sorted(((r[0], p, names[g]) for r, p, g in zip(rows, prints, groups)), key=str)
    found = simhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=str) == want
    assert len(set(groups)) < len(rows) - 20
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(n or 0 for n in names.values())


def test_links_of_random_prints(spark):
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for c in centre for _ in range(20)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    for threshold in (0, 1, 2):
        pairs = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, threshold).collect()}
        want = {
            frozenset((p, q)) for p in prints for q in prints if p != q and (p ^ q).bit_count() <= threshold
        }
        assert {frozenset(pair) for pair in pairs} == want


@pytest.mark.parametrize("threshold", [0, 1, 2])
def test_links_at_dense_homes(spark, monkeypatch, threshold):
    """All links at 0 and 1 bit, and at 2 bits enough to join up the same fingerprints."""
    monkeypatch.setattr(simhash, "DENSE_HOME", 2)
    rng = random.Random(9)
    centre = [0, *(rng.getrandbits(63) for _ in range(3))]
    prints = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for c in centre for _ in range(40)}
    prints = sorted((prints | {4, 9, 12, 13}) - {8})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    pairs = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(df, threshold).collect()}
    near = {frozenset((p, q)) for p in prints for q in prints if p != q and (p ^ q).bit_count() <= threshold}
    if threshold < 2:
        assert pairs == near
    assert pairs <= near or threshold == 2

    def joined(edges):
        root = {p: p for p in prints}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in map(sorted, edges):
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {p: find(p) for p in prints}

    assert joined(pairs) == joined(near)


def test_components(spark):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(7, k) for k in range(500, 560)]
    more = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    edges = [*chain, *star, *more, (3, 3), (None, 5), (139, 100), (7, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want, real = {}, [(a, b) for a, b in edges if a is not None and a != b]
    for node in {x for edge in real for x in edge}:
        reached, todo = {node}, [node]
        while todo:
            x = todo.pop()
            for a, b in real:
                for y in ((b,) if a == x else (a,) if b == x else ()):
                    if y not in reached:
                        reached.add(y)
                        todo.append(y)
        want[node] = min(reached)
    assert got == want


def test_empty(spark):
    assert simhash.near_duplicates(data.empty(spark)).count() == 0
    assert simhash.keep_one(data.empty(spark)).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
