"""Subwords beside a plain version, held-out accuracy, and rejection."""

import zlib

import data
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readlake.llm import langid

SF = "/root/testdata/sf0.01"


def brute_subwords(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").encode())
    out = []
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if gram != b"  " and 32 not in gram[1:-1]:
                out.append((int.from_bytes(gram, "little") * 0x9E3779B97F4A7C15 % 2**64) >> 48)
    return sorted(out)


def test_subwords():
    texts = [*data.SPECIAL, "The Äpfel 12 x.", "q w"]
    buckets, starts = langid.subwords(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert sorted(buckets[starts[k] : starts[k + 1]].tolist()) == brute_subwords(text)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return langid.fit(documents)


def test_held_out_accuracy(documents, model):
    lang = documents.select("doc_id", F.col("lang").alias("truth"))
    rows = langid.identify(documents, model).join(lang, "doc_id").collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.truth for r in held) >= 0.98 * len(held) > 100
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)
    assert langid.accepted(documents, model).count() >= 0.995 * len(rows)


def test_held_out_rows_and_columns_are_not_learned_from(documents, model):
    other = documents.withColumns(
        {
            "lang": F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")),
            "source": F.lit("other"),
        }
    )
    assert (langid.fit(other).scores == model.scores).all()


def test_special_texts(spark, model):
    df, rows = data.documents(spark, [*data.SPECIAL, "中文字符测试", "the and of that was in"])
    found = langid.identify(df, model).collect()
    assert len(found) == len(rows)
    texts = dict((r[0], r[1]) for r in rows)
    for r in found:
        und = not any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == und and 0 <= r.score <= 1
        assert not und or (r.score == 0 and r.rejected)
    unknown = [r for r in found if texts[r.doc_id] == "中文字符测试"]
    assert all(r.rejected and r.lang_pred in model.languages for r in unknown)
    assert {r.lang_pred for r in found if texts[r.doc_id] == "the and of that was in"} == {"en"}


def test_nothing_to_learn_from(spark):
    df, rows = data.documents(spark, ["some text", None])
    assert langid.fit(data.empty(spark)) is None
    found = langid.identify(df, None).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found} == {"und"}
    assert langid.identify(data.empty(spark), None).count() == 0


def test_the_driver_gives_the_memory_of_the_sample_back(documents, monkeypatch):
    released = []

    class Pool:
        def release_unused(self):
            released.append(True)

    monkeypatch.setattr(langid.pa, "default_memory_pool", Pool)
    assert langid.fit(documents.limit(200)) is not None and released
