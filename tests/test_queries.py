"""Every registered query beside its oracle, on the smallest tables."""

from collections import Counter

import duckdb  # noqa: F401 - fails early where it is missing
import pytest
from compare import compare, connect

import __spark_entry__ as entry
from readlake.plans import catalog

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(spark, con, sf_dir, name):
    problems, _ = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert problems == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert ORACLES.keys() <= QUERIES.keys()


def test_tokenize_gives_every_task_as_much_text(spark, tmp_path, monkeypatch):
    rows = [(k % 40 if k else None, f"word{k} und und Ä") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' AS lang", "'s' AS source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog, "TOKENIZED_SHARE", 100, raising=False)
    counted = QUERIES["tokenize"](spark, str(tmp_path))
    expected = Counter()
    for doc_id, text in rows:
        expected.update((None if doc_id is None else doc_id + 1, word) for word in text.lower().replace("ä", "a").split())
    assert {(r.id, r.term): r.n for r in counted.collect()} == expected
    size = sum(len(text.encode()) for _, text in rows)
    assert counted.rdd.getNumPartitions() == 1 + size // 100  # where the words are counted
