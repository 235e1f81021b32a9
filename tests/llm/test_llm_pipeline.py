"""The pipeline stage by stage, each beside what it must do to its own input."""

import collections
import re

import corpus_pipeline
import pytest

from readlake.llm import langid, queries
from readlake.session import materialize
from test_llm_decontaminate import brute_tiles, tokens
from test_llm_mixing import brute_targets
from test_llm_pii import BASE, brute
from test_llm_simhash import brute_fingerprint, brute_groups


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test-stage")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_language(spark, steps):
    model = langid.fit(steps[0])
    found = langid.identify(steps[0], model).collect()
    assert rows(steps[1]).keys() == {r.doc_id for r in found if not r.rejected}
    assert steps[1].count() >= 0.98 * steps[0].count()


def test_near_duplicates(steps):
    before = sorted(steps[1].collect(), key=lambda r: r.doc_id)
    groups = brute_groups([brute_fingerprint(r.text) for r in before])
    assert rows(steps[2]).keys() == {before[g].doc_id for g in groups}


def test_decontamination(spark, steps, sf_dir):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {tuple(tokens(x)[i : i + 5]) for x in items for i in range(len(tokens(x)) - 4)}
    gone = set()
    for key, r in rows(steps[2]).items():
        mine = tokens(r.text)
        if any(tuple(mine[i : i + 5]) in grams for i in range(len(mine) - 4)):
            tiles = [brute_tiles(r.text, item) for item in items if set(tokens(item)) & set(mine)]
            if any(covered >= 0.8 * n for covered, _, n in tiles):
                gone.add(key)
    assert gone and rows(steps[3]).keys() == rows(steps[2]).keys() - gone


def test_personal_data(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert before.keys() == after.keys()
    for key, r in after.items():
        assert not brute(r.text) and r.n_chars == len(r.text)
        spans = [s for s in brute(before[key].text) if s.split(":")[0] in BASE]
        if not spans and "[SECRET]" not in r.text:
            assert r.text == before[key].text


def test_mixture(steps):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for k, r in rows(steps[4]).items()}
    total, taken = collections.Counter(), collections.Counter()
    for key, r in rows(steps[4]).items():
        total[r.source] += size[key]
    copies = collections.Counter()
    for r in steps[5].collect():
        taken[r.source] += size[r.doc_id]
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    target = brute_targets(total)
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in total)


def test_registration():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert queries.ORACLES.keys() <= entry.oracle_sql().keys()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "mixing sources to target weights"
    ]
