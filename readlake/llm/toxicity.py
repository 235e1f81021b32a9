"""Toxic texts by a weighted finite-state grammar over word classes.

Words of a text are read as classes: insults, threatening verbs, targets, negations, verbs of
speech, intensifiers, words of intent. Small transducers rewrite the classes of a clause one
after another: an intensifier strengthens an insult, intent and target make a threat of a verb,
a target near an insult makes it an attack, a negation or a verb of speech before it makes it
denied or reported. They are composed into one machine, which reads every clause that has an
insult or a threatening verb once and gives weights by kind of clause. A text's score is a
logistic function of those weights.

Which words insult, and what the kinds count for, is learned from labelled rows: words that
stand in many different toxic texts and hardly in others join a short list given here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _members, range_hashes, runs, slices, text_of, utf8

SAMPLE_ROWS = 4000  # labelled rows of each class to learn from, at most
LEXICON_WORDS = 2000  # learned words, at most
LEAST_SUPPORT, LEAST_SHARE, LEAST_ODDS = 5, 0.01, 60.0
FULL_ODDS = 1000.0  # from these odds on a learned word counts fully
SEED_WEIGHT = 0.6
THRESHOLD = 0.7

# Words of the classes in the four languages of the corpus.
INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSIFIER, INTENT, OTHER, END = range(9)
LEXICON = {
    INSULT: (
        "idiot idiots moron morons stupid dumb imbecile fool scum trash garbage worthless pathetic loser losers clown "
        "disgusting vermin bastard jerk creep freak pig "
        "idioten dummkopf abschaum trottel arschloch versager widerlich "
        "idiote imbécile connard salaud ordure minable dégoûtant "
        "idiota imbécil estúpido basura escoria patético asqueroso"
    ),
    THREAT: (
        "kill hurt destroy beat smash stab shoot burn hang strangle "
        "töten umbringen vernichten schlagen tuer frapper détruire matar golpear destruir"
    ),
    TARGET: (
        "you your yours yourself he him she her they them their these those people everyone "
        "du dich dir ihr euch sie tu toi vous ils elles tú ti usted ustedes ellos ellas"
    ),
    NEGATION: (
        "not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't won't "
        "nicht kein keine nie niemals pas jamais ni nunca jamás"
    ),
    REPORT: (
        "said says say called calls wrote writes reported reports claimed quoted quote according "
        "sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó"
    ),
    INTENSIFIER: "very so such really total totally complete completely absolute utterly sehr total très si muy tan",
    INTENT: "will gonna going shall must should want werde wirst vais voy quiero",
}

# What the composed machine says of a word.
PLAIN, ATTACK, MENACE, DENIED, REPORTED, NOTHING = range(6)
KINDS = ("plain", "attack", "menace", "denied", "reported")
# What a kind counts for before anything is learned; the first is the bias.
PRIOR = np.array([-3.0, 2.5, 3.0, 3.0, 0.5, 0.5])
PRIOR_STRENGTH = 1.0
STRENGTHENED = 1.5


@dataclass
class Transducer:
    """A sequential letter-to-letter transducer: (state, symbol) to (state, symbol, factor).
    An arc that is not given passes its symbol on and stays; END leads to the start."""

    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        if symbol == END:
            return 0, END, 1.0
        return self.arcs.get((state, symbol), (self.rest(state), symbol, 1.0))

    def rest(self, state: int) -> int:
        return state


class Within(Transducer):
    """A transducer whose states above 0 count down with every word that has no arc."""

    def rest(self, state: int) -> int:
        return max(0, state - 1)


def _strengthen() -> Transducer:
    return Within({
        (0, INTENSIFIER): (2, INTENSIFIER, 1.0), (1, INTENSIFIER): (2, INTENSIFIER, 1.0), (2, INTENSIFIER): (2, INTENSIFIER, 1.0),
        (1, INSULT): (0, INSULT, STRENGTHENED), (2, INSULT): (0, INSULT, STRENGTHENED),
    })


def _threaten() -> Transducer:
    """Intent, at most two words, a verb, at most two words, a target: the target is the threat.
    States 1 to 3 follow intent, 4 to 6 the verb. A verb alone is no threat."""

    class Threat(Transducer):
        def rest(self, state: int) -> int:
            return 0 if state in (0, 1, 4) else state - 1

    arcs: dict[tuple[int, int], tuple[int, int, float]] = {}
    for state in range(7):
        arcs[state, INTENT] = (3, OTHER, 1.0)
        arcs[state, THREAT] = (6 if 1 <= state <= 3 else 0, OTHER, 1.0)
        if state > 3:
            arcs[state, TARGET] = (0, THREAT, 1.0)
    return Threat(arcs)


# After the targets were bound, INTENSIFIER and INTENT are not needed; ATTACKED takes a place.
ATTACKED = INTENT


def _bind() -> Transducer:
    """A target at most four words before an insult makes it an attack."""
    arcs: dict[tuple[int, int], tuple[int, int, float]] = {}
    for state in range(5):
        arcs[state, TARGET] = (4, OTHER, 1.0)
        arcs[state, INTENSIFIER] = (max(0, state - 1), OTHER, 1.0)
        if state:
            arcs[state, INSULT] = (state - 1, ATTACKED, 1.0)
    return Within(arcs)


def _deny() -> Transducer:
    """A negation at most three words before; what it denies is passed on as NEGATION."""
    arcs: dict[tuple[int, int], tuple[int, int, float]] = {}
    for state in range(4):
        arcs[state, NEGATION] = (3, OTHER, 1.0)
        if state:
            for symbol in (INSULT, ATTACKED, THREAT):
                arcs[state, symbol] = (state - 1, NEGATION, 1.0)
    return Within(arcs)


def _report() -> Transducer:
    """A verb of speech earlier in the clause; gives the kinds."""
    arcs: dict[tuple[int, int], tuple[int, int, float]] = {}
    kinds = {INSULT: PLAIN, ATTACKED: ATTACK, THREAT: MENACE, NEGATION: DENIED}
    for state in range(2):
        for symbol in range(END):
            arcs[state, symbol] = (state, NOTHING, 1.0)
        arcs[state, REPORT] = (1, NOTHING, 1.0)
        for symbol, kind in kinds.items():
            arcs[state, symbol] = (state, REPORTED if state else kind, 1.0)
    return Transducer(arcs)


def compose(*machines: Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One machine that does what the given ones do one after another, as tables: the next
    state, the kind and the factor for each state and class. State 0 is the start."""
    start = (0,) * len(machines)
    numbers, todo = {start: 0}, [start]
    table: list[list[tuple[int, int, float]]] = []
    while todo:
        states = todo.pop(0)
        row = []
        for symbol in range(END + 1):
            after, now, factor = [], symbol, 1.0
            for machine, state in zip(machines, states):
                to, now, times = machine.step(state, now)
                after.append(to)
                factor *= times
            if tuple(after) not in numbers:
                numbers[tuple(after)] = len(numbers)
                todo.append(tuple(after))
            row.append((numbers[tuple(after)], NOTHING if now == END else now, factor))
        table.append(row)
    values = np.array(table, float)
    return values[:, :, 0].astype(np.int64), values[:, :, 1].astype(np.int64), values[:, :, 2]


def grammar() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return compose(_strengthen(), _threaten(), _bind(), _deny(), _report())


@dataclass(frozen=True)
class Model:
    """Words with class and weight, and what the kinds count for (bias first)."""

    words: tuple[tuple[str, int, float], ...]
    weights: np.ndarray


def _given(insults: dict[str, float]) -> tuple[tuple[str, int, float], ...]:
    known = {word: (kind, 1.0) for kind, listed in LEXICON.items() if kind != INSULT for word in listed.split()}
    known |= {word: (INSULT, weight) for word, weight in insults.items() if weight > 0 and word not in known}
    return tuple((word, kind, weight) for word, (kind, weight) in sorted(known.items()))


CLAUSE_ENDS = b".;!?\n\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b"'" + bytes(range(128, 256))


class _Reader:
    """Reads texts with the grammar; made once per task."""

    def __init__(self, words: tuple[tuple[str, int, float], ...]):
        self.words = [w.encode() for w, _, _ in words]
        spelled = np.frombuffer(b"".join(self.words), np.uint8)
        ends = np.cumsum([len(w) for w in self.words])
        hashes = range_hashes(spelled, np.r_[0, ends[:-1]], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.kinds = np.array([k for _, k, _ in words])[self.order]
        self.weights = np.array([w for _, _, w in words])[self.order]
        following, said, factor = grammar()
        self.following, self.said, self.factor = following.tolist(), said.tolist(), factor.tolist()

    def kinds_of(self, part: pa.RecordBatch) -> np.ndarray:
        """For each text the summed weights of its clauses by kind."""
        raw, offsets = utf8(part.column("text"))
        raw = _LOWER[raw]
        out = np.zeros((part.num_rows, len(KINDS)))
        starts, ends = runs(raw, offsets, _members(_WORD)[raw])
        if not len(starts):
            return out
        hashes = range_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == hashes)
        spelled = raw.tobytes()
        symbols = np.full(len(starts), OTHER)
        # A hash says where to look; the word itself decides.
        sure = [k for k in found.tolist() if spelled[starts[k] : ends[k]] == self.words[self.order[at[k]]]]
        symbols[sure] = self.kinds[at[sure]]
        hot = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
        if not len(hot):
            return out
        text = text_of(starts, offsets)
        marks = np.cumsum(_members(CLAUSE_ENDS)[raw], dtype=np.int64)
        clause = np.cumsum(np.r_[True, (np.diff(marks[starts]) > 0) | (np.diff(text) > 0)]) - 1
        wanted = np.zeros(clause[-1] + 1, bool)
        wanted[clause[hot]] = True
        chosen = np.flatnonzero(wanted[clause])
        state, before = 0, -1
        for k, symbol, own, row in zip(chosen.tolist(), symbols[chosen].tolist(), clause[chosen].tolist(), text[chosen].tolist()):
            if own != before:
                state, before = 0, own
            kind = self.said[state][symbol]
            if kind != NOTHING:
                weight = self.weights[at[k]] if symbol == INSULT else 1.0
                out[row, kind] += weight * self.factor[state][symbol]
            state = self.following[state][symbol]
        return out


def matched(texts: DataFrame, words: tuple[tuple[str, int, float], ...], text_column: str, name: str) -> DataFrame:
    """The table without its text, with an array of the weights by kind of clause."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(words)
        for batch in batches:
            for part in slices(batch, "text"):
                kinds = pa.array(reader.kinds_of(part).tolist(), pa.list_(pa.float64()))
                others = [part.column(k) for k in range(part.num_columns) if part.schema.names[k] != "text"]
                yield pa.RecordBatch.from_arrays([*others, kinds], [*(n for n in part.schema.names if n != "text"), name])

    rest = [c for c in texts.columns if c != text_column]
    given = texts.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_column}`").alias("text"))
    types = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in rest)
    return given.mapInArrow(read, f"{types}, {name} array<double>")


def strengths(kinds: np.ndarray) -> np.ndarray:
    return np.log1p(4 * kinds)


def _learned(rows: DataFrame) -> dict[str, float]:
    """Insulting words: in many different toxic texts and hardly in others, with a weight.

    Texts with the same smallest word hash count once, so a text that was copied a thousand
    times with changes is no evidence by itself.
    """
    spelled = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.split(spelled, r"[^\p{L}\p{N}']+"))
    told = rows.select("toxic", words.alias("words")).withColumn(
        "form", F.array_min(F.transform("words", lambda w: F.xxhash64(w)))
    )
    sides = {name: F.collect_set(F.when(F.col("toxic") == value, F.col("form"))) for name, value in (("toxic", 1), ("clean", 0))}
    n = told.agg(*(F.size(s).alias(name) for name, s in sides.items())).first()
    if not n["toxic"] or not n["clean"]:
        return {w: SEED_WEIGHT for w in LEXICON[INSULT].split()}
    # Sets of a bounded sample's texts.
    per_word = told.select("toxic", "form", F.explode("words").alias("word")).groupBy("word").agg(
        *(F.size(s).alias(name) for name, s in sides.items())
    )
    odds = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * (n["clean"] / n["toxic"])
    per_word = per_word.withColumn("odds", odds)
    seeds = LEXICON[INSULT].split()
    found = per_word.where(
        (F.length("word") > 2)
        & (F.col("toxic") >= max(LEAST_SUPPORT, LEAST_SHARE * n["toxic"]))
        & (F.col("odds") >= LEAST_ODDS)
    ).orderBy(F.desc("toxic"), "word").limit(LEXICON_WORDS)
    insults = {w: SEED_WEIGHT for w in seeds}
    # A given word that clean texts use as well is no insult here.
    used = per_word.where(F.col("word").isin(seeds) & (F.col("clean") >= LEAST_SUPPORT) & (F.col("odds") < 2)).collect()
    insults |= {r["word"]: 0.0 for r in used}
    insults |= {r["word"]: min(1.0, float(np.log(r["odds"]) / np.log(FULL_ODDS))) for r in found.collect()}
    return insults


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    learn_from: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learn from labelled rows: at most ``sample_rows`` of each class, chosen by a hash of the
    id. ``learn_from`` is a condition on ``doc_id`` that they have to meet. Without rows of both
    classes the given words and weights stand."""
    key = F.col(f"`{id_column}`").alias("doc_id")
    told = labels.select(key, F.col(f"`{label_column}`").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    told = told.where(F.col("doc_id").isNotNull() & (F.lit(True) if learn_from is None else learn_from)).distinct()
    counts = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    few = [
        told.where(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for side in (0, 1)
    ]
    sample = few[0].union(few[1])
    # At most twice ``sample_rows`` narrow rows.
    rows = documents.select(key, F.col(f"`{text_column}`").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    words = _given(_learned(rows))
    if set(counts) != {0, 1}:
        return Model(words, PRIOR)
    seen = matched(rows, words, "text", "kinds").toArrow()
    y = seen.column("toxic").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Model(words, PRIOR)
    x = strengths(np.array(seen.column("kinds").to_pylist()))
    share = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return Model(words, _logistic(x, y, share / share.mean()))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, held to the given ones where rows say little."""
    x = np.c_[np.ones(len(x)), x]
    weights = PRIOR.copy()
    hold = np.full(x.shape[1], PRIOR_STRENGTH)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - y)) + hold * (weights - PRIOR)
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        weights -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    # A matched clause never speaks for a text.
    weights[1:] = np.maximum(weights[1:], 0)
    return weights


def toxicity(
    documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, score, predicted, plain, attack, menace, denied, reported): per row the score
    from 0 to 1, whether it reaches the threshold, and the weights of its clauses by kind.

    A text that is null, empty or without words has no clause and the score of such a text.
    Repeated rows come back as they are; other columns are not read.
    """
    source = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    found = matched(source, model.words, "text", "kinds")
    z = F.lit(float(model.weights[0]))
    for k, weight in enumerate(model.weights[1:].tolist()):
        z = z + F.lit(weight) * F.log1p(F.col("kinds")[k] * 4)
    score = 1 / (1 + F.exp(-z))
    return found.withColumn("score", score).select(
        "doc_id",
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *(F.col("kinds")[k].alias(name) for k, name in enumerate(KINDS)),
    )
