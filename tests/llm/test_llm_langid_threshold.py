"""The rejection threshold: languages that were not learned, two languages in a text, many languages."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from readlake.llm import langid

SF = "/root/testdata/sf0.01"
NEVER_LEARNED = [
    "Suomen kieli kuuluu uralilaisiin kieliin ja sitä puhutaan pääasiassa Suomessa. Kesällä järvet ovat lämpimiä.",
    "Język polski należy do grupy języków zachodniosłowiańskich. Latem ludzie wyjeżdżają nad morze i odpoczywają.",
    "La lingua italiana appartiene al gruppo delle lingue romanze. In estate le persone vanno al mare con la famiglia.",
    "Türkçe, Türk dilleri ailesine ait bir dildir. Yaz aylarında insanlar deniz kenarına gider, yüzer ve dinlenirler.",
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def held(documents):
    rows = documents.select("doc_id", "lang", "text").orderBy("doc_id").collect()
    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]


def kept(model, texts):
    column = pa.array(texts, pa.string())
    return model.sure(column, model.predict(column)[1])


def test_languages_never_learned(documents):
    assert not kept(langid.fit(documents), NEVER_LEARNED).any()


def test_a_language_left_out(documents, held):
    model = langid.fit(documents.where("lang != 'de'"))
    assert kept(model, [r.text for r in held if r.lang == "de"]).mean() < 0.3
    assert kept(model, [r.text for r in held if r.lang != "de"]).mean() > 0.98


def test_two_languages_in_a_text(documents, held):
    model = langid.fit(documents)
    by = {lang: [r.text for r in held if r.lang == lang] for lang in ("de", "en", "es", "fr")}
    pairs = [(x[: len(y)], y[: len(x)]) for a in by for b in by if a < b for x, y in zip(by[a], by[b])]
    mixed = ["\n".join(pair) for pair in pairs]
    whole = model.predict(pa.array(mixed, pa.string()))[1] >= model.threshold
    assert kept(model, mixed).mean() > max(0.8, whole.mean())


def test_threshold_is_the_stated_quantile():
    """On average over samples of 150 rows the threshold is where the share is, not far below it."""
    rng = np.random.default_rng(2)
    odds = [4 - rng.exponential(0.6, 150) for _ in range(400)]
    ends = [langid.lower_end(1 / (1 + np.exp(-z)), 0.002) for z in odds]
    below = np.exp(-(4 - np.log(np.array(ends) / (1 - np.array(ends)))) / 0.6)
    assert 0.0005 < below.mean() < 0.005
    assert np.median(below) < 0.0035
    assert langid.lower_end(np.array([0.9]), 0.002) == pytest.approx(0.9)


def test_no_language_is_dropped(spark):
    rows = [(k, f"wort{k % 250} text", f"l{k % 250:03}") for k in range(1000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 250


def test_pieces():
    text = " ".join(f"word{k}" for k in range(200))
    assert " ".join(langid.pieces(text)) == text and len(langid.pieces(text)) > 8
    assert langid.pieces("") == [] and langid.pieces("a b") == ["a b"]
