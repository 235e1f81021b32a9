"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (runs of 2 to 4 bytes within a word or
at its border, hashed into buckets); a linear layer without bias gives one score per
language. Both are trained in numpy by stochastic gradient descent on a bounded sample, in one task. A
temperature, fitted on rows set apart, makes the scores calibrated. A text whose score is
below what those rows reach is rejected, unless its pieces reach it on average, as those of a
text in two languages do. Buckets that training has not met are zero, so a text of unknown
subwords scores the same for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t
from .columns import fresh

BUCKET_BITS = 16
SIZES = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
RATE = 1.0
SAMPLE_ROWS = 2400  # labelled rows to learn from, about as many of each language
LEAST_ROWS = 12  # but not fewer of a language, however many languages there are
PIECE = 150  # bytes of a text that are judged by themselves
REJECTED = 0.002  # share of rightly labelled rows set apart that may fall below the threshold
UNDETERMINED = "und"
_STEPS = 1 << 20


def held_out(id_column: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, grouped by text, and where each text's begin."""
    raw, offsets = t.utf8(column)
    lower = np.arange(256, dtype=np.uint32)
    lower[65:91] += 32
    lower[[c for c in range(128) if not chr(c).isalpha()]] = 32
    signs = lower[raw]
    space = signs == 32
    last = np.zeros(len(raw), bool)  # last byte of its text
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = True
    found, places = [], []
    gram, inside, within = signs, ~space, np.ones(len(raw), bool)
    for size in range(2, max(SIZES) + 1):
        if len(gram) < 2:
            break
        gram = gram[:-1] | (signs[size - 1 :] << np.uint32(8 * (size - 1)))
        within = within[:-1] & ~last[size - 2 : len(raw) - 1]
        if size == 2:
            inside = ~(space[:-1] & space[1:])
            middle = np.ones(len(gram), bool)
        else:
            middle = middle[:-1] & ~space[size - 2 : len(raw) - 1]
            inside = middle
        if size in SIZES:
            at = np.flatnonzero(inside & within)
            hashed = gram[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)
            found.append(hashed.astype(np.int32))
            places.append(np.searchsorted(at, offsets))
    n = len(offsets) - 1
    if not found:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    starts = sum(places)
    out = np.empty(starts[-1], np.int32)
    filled = starts[:-1].copy()
    for hashed, place in zip(found, places):
        counts = np.diff(place)
        out[np.repeat(filled - place[:-1], counts) + np.arange(len(hashed))] = hashed
        filled += counts
    return out, starts


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # one row per bucket: what it adds to each language, before averaging
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        buckets, starts = subwords(column)
        out = np.zeros((len(column), len(self.languages)))
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            counts = np.diff(starts)[some]
            out[some] = np.add.reduceat(self.scores[buckets], starts[some], axis=0, dtype=np.float64) / counts[:, None]
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of the best language (the first of equals) and its probability."""
        chances = softmax(self.logits(column) / self.temperature)
        best = chances.argmax(1)
        return best, chances[np.arange(len(best)), best]

    def sure(self, column: pa.Array, score: np.ndarray) -> np.ndarray:
        """Whether the score of a text, or of its pieces on average, reaches the threshold."""
        out = score >= self.threshold
        for k in np.flatnonzero(~out):
            cut = pieces(column[k].as_py() or "")
            sizes = [len(piece.encode()) for piece in cut]
            if len(cut) > 1:
                out[k] = np.average(self.predict(pa.array(cut))[1], weights=sizes) >= self.threshold
        return out


def pieces(text: str) -> list[str]:
    """The words of a text in order, in parts of about ``PIECE`` bytes."""
    words = text.split()
    ends = np.cumsum([len(word.encode()) + 1 for word in words])
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(words)]
    return [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def lower_end(scores: np.ndarray, share: float) -> float:
    """The score that ``share`` of all rows like these are below. Few rows have no such quantile:
    their lowest is above more of the others. So the log-odds of the lowest twentieth (seven at least) are
    carried on as an exponential tail, and the result is never above the plain quantile."""
    odds = np.sort(np.log(scores + 1e-12) - np.log(1 - scores + 1e-12))
    count = max(1, len(odds) // 20, min(7, len(odds) // 4))
    from_here = odds[min(count, len(odds) - 1)]
    fall = (from_here - odds[:count]).mean()
    tail = from_here - fall * np.log(max(1.0, count / len(odds) / share))
    return float(min(np.quantile(scores, share), 1 / (1 + np.exp(-tail))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], seed: int = 0) -> Model:
    """Fit to rows of (buckets, counts); every fifth row is set apart for the calibration."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    apart, learned = order[::5], np.delete(order, np.s_[::5])
    if not len(learned):
        learned = apart
    embedding = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.float32)
    linear = rng.normal(size=(DIMENSIONS, len(languages))).astype(np.float32)
    steps, step = EPOCHS * len(learned), 0
    for _ in range(EPOCHS):
        for row in rng.permutation(learned):
            buckets, counts = rows[row]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            if not len(buckets):
                continue
            share = counts / counts.sum(dtype=np.float32)
            vector = share @ embedding[buckets]
            error = softmax(vector @ linear)
            error[labels[row]] -= 1
            back = linear @ error
            linear -= rate * 0.1 * np.outer(vector, error)
            # Shares are small; scaled by the row's number of buckets they move by about the rate.
            embedding[buckets] -= rate * np.outer(share * np.float32(len(buckets)), back)
    scores = embedding @ linear
    model = Model(languages, scores)
    logits = np.stack([(rows[r][1] / max(1, rows[r][1].sum())) @ scores[rows[r][0]] for r in apart])
    right = labels[apart]
    # All rows right still leaves some doubt: one row in as many as were set apart.
    doubt = 1 / (len(apart) + 1)

    def loss(temperature: float) -> float:
        logs = np.log(softmax(logits / temperature) + 1e-300)
        return -((1 - doubt) * logs[np.arange(len(apart)), right] + doubt * logs.mean(1)).mean()

    model.temperature = float(min(np.geomspace(0.05, 200, 80), key=loss))
    chances = softmax(logits / model.temperature)
    sure = chances.max(1)[chances.argmax(1) == right]
    model.threshold = lower_end(sure, REJECTED) if len(sure) else 1 / len(languages)
    return model


def fit(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
) -> Model | None:
    """Learn from about ``sample_rows`` rows that have an id, a language and a text and are not
    held out, chosen by a hash of the id, about as many per language and of each some
    ``LEAST_ROWS``. Counts of subwords are taken where the texts are; those of the sample go to one task, which
    learns from them. None if there is no such row.
    """
    source = documents.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    ).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    usable = source.where(F.col("text").isNotNull())
    ranked = usable.groupBy("lang").count().collect()
    if not ranked:
        return None
    languages = sorted(row["lang"] for row in ranked)
    each = max(LEAST_ROWS, sample_rows / len(languages))
    shares = F.create_map(*(F.lit(x) for row in ranked for x in (row["lang"], min(1.0, each / row["count"]))))
    chosen = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(_STEPS)) < _STEPS * shares[F.col("lang")]
    sample = usable.where(chosen)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                buckets, starts = subwords(part.column("text"))
                pairs = [np.unique(buckets[a:b], return_counts=True) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("lang"),
                        pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
                        pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                    ],
                    ["id", "lang", "buckets", "counts"],
                )

    schema = f"id {source.schema['id'].dataType.simpleString()}, lang string, buckets array<int>, counts array<int>"
    number = {language: k for k, language in enumerate(languages)}

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            lists = [batch.column(c) for c in ("buckets", "counts")]
            starts = lists[0].offsets.to_numpy()
            buckets, counts = (x.values.to_numpy() for x in lists)
            rows += [(buckets[a:b], counts[a:b].astype(np.float32)) for a, b in zip(starts, starts[1:])]
            labels += [number[x] for x in batch.column("lang").to_pylist()]
        if rows:
            found = train(rows, np.array(labels), languages)
            values = {"scores": found.scores.astype(np.float32).tobytes(), "temperature": found.temperature, "threshold": found.threshold}
            yield pa.RecordBatch.from_pylist([values])

    # Repeated ids could make the sample larger than asked for; the order makes reruns agree.
    counted_rows = sample.mapInArrow(counted, schema)
    bounded = counted_rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(int(4 * each * len(languages)))
    # The sample is bounded and one partition: it is learned from in a task, and only the model comes to the driver.
    found = bounded.mapInArrow(trained, "scores binary, temperature double, threshold double").toArrow().to_pylist()
    pa.default_memory_pool().release_unused()  # or the driver keeps that memory for good
    if not found:
        return None
    scores = np.frombuffer(found[0]["scores"], np.float32).reshape(-1, len(languages))
    return Model(languages, scores, found[0]["temperature"], found[0]["threshold"])


def predictor(documents: DataFrame, model: Model):
    """A column function: the language and the score of a text, and whether it is sure."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,sure:boolean>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array(shared.value.languages, pa.string())
        for batch in texts:
            parts = []
            for part in t.slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text"):
                best, score = shared.value.predict(part.column("text"))
                sure = shared.value.sure(part.column("text"), score)
                found = [names.take(pa.array(best)), pa.array(score), pa.array(sure)]
                parts.append(pa.StructArray.from_arrays(found, ["lang_pred", "score", "sure"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.null())

    return predict.asNondeterministic()  # or a filter on its result would run it twice


def with_language(documents: DataFrame, model: Model | None, name: str, text_column: str = "text") -> DataFrame:
    """One more column, a struct: ``lang_pred``, ``score`` from 0 to 1, ``rejected``.

    A null text, one without a letter, and any text without a model is `und`, with score 0,
    and rejected. Only the text is looked at.
    """
    text = F.col(f"`{text_column}`")
    nothing = F.struct(
        F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
    )
    if model is None:
        return documents.withColumn(name, nothing)
    judged = documents.withColumn(name, predictor(documents, model)(text))
    found = F.struct(
        F.col(name)["lang_pred"].alias("lang_pred"),
        F.col(name)["score"].alias("score"),
        (~F.col(name)["sure"]).alias("rejected"),
    )
    return judged.withColumn(name, F.when(has_letter(text), found).otherwise(nothing))


def identify(
    documents: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row its id as ``doc_id``, ``held_out`` (false for a null id), and the fields of
    ``with_language``. Repeated rows come back as they are; other columns are not read."""
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = with_language(source, model, "found")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.*")


def accepted(documents: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """The documents that are not rejected, with their columns as they are."""
    (name,) = fresh(documents, "found")
    return with_language(documents, model, name, text_column).where(~F.col(name)["rejected"]).drop(name)
