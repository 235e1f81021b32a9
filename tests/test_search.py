"""Search against a full-text index of SQLite on small random texts."""

import random
import sqlite3
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readlake.operators import index as index_module
from readlake.operators import search as search_module
from readlake.operators.generations import Generations
from readlake.operators.index import Index, write_index
from readlake.operators.search import (
    adjacent,
    both,
    either,
    match_batch,
    matches,
    near,
    phrase,
    postings_of,
    search,
    search_batch,
    term,
    within,
    without,
)
from readlake.functions.text import tokenize_words
from readlake.session import scratch_path

WORDS = ["sea", "seal", "search", "paper", "pale", "ink", "café", "owl"]
SCHEMA = "id bigint, url string, title string, author string, text string, added_at string"


def make_articles(n=60, seed=7):
    rng = random.Random(seed)

    def words(low, high):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high)))

    return [(i, f"https://e.org/{i}", words(0, 3), rng.choice([None, words(1, 2)]), words(1, 14),
             "2024-01-01T00:00:00Z") for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(make_articles(), SCHEMA).cache()


@pytest.fixture(scope="module")
def index(spark, articles):
    root = scratch_path(spark, "index")
    write_index(articles.where("id <= 25"), root, 0)
    write_index(articles, root, 1)  # replaced by the next line
    write_index(articles.where("id > 25"), root, 1)
    write_index(articles, root, 2)  # replaced by nothing
    write_index(articles.limit(0), root, 2)
    return Index.read(spark, root)


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, author, text)")
    db.executemany("insert into t(rowid, title, author, text) values (?, ?, ?, ?)",
                   [(a[0], a[2], a[3], a[4]) for a in make_articles()])
    return lambda q: {i: s for i, s in db.execute("select rowid, rank from t where t match ?", (q,))}


# (query text for SQLite, the same query composed)
SINGLE = [
    ("sea", term("sea")),
    ("CAFE", term("Café")),
    ('"sea paper"', phrase("sea paper")),
    ('"owl ink owl"', phrase("owl ink owl")),
    ("se*", term("se", prefix=True)),
    ("s*", term("s", prefix=True)),
    ('"paper se" *', phrase("paper se", prefix=True)),
    ("^owl", term("owl", first=True)),
    ('^"ink sea"', phrase("ink sea", first=True)),
    ("title:sea", within(term("sea"), "title")),
    ("{title author}:owl", within(term("owl"), "title", "author")),
    ("-title:owl", within(term("owl"), "title", exclude=True)),
    ("title:^owl", within(term("owl", first=True), "title")),
    ("sea AND owl", both(term("sea"), term("owl"))),
    ("sea owl ink", both(term("sea"), term("owl"), term("ink"))),
    ("sea OR owl", either(term("sea"), term("owl"))),
    ("sea NOT owl", without(term("sea"), term("owl"))),
    ("NEAR(sea owl, 1)", near("sea", "owl", distance=1)),
    ("NEAR(sea owl)", near("sea", "owl")),
    ('NEAR("sea ink" owl, 2)', near("sea ink", "owl", distance=2)),
    ("NEAR(sea owl ink, 2)", near("sea", "owl", "ink", distance=2)),
    ("text:NEAR(pale paper, 0)", within(near("pale", "paper", distance=0), "text")),
    ('"" AND sea', both(phrase(""), term("sea"))),
    ('"" sea', adjacent(phrase(""), term("sea"))),
    ('"" OR sea', either(phrase(""), term("sea"))),
    ('sea NOT ""', without(term("sea"), phrase(""))),
    ('"" NOT sea', without(phrase(""), term("sea"))),
    ("missing", term("missing")),
    ('""', phrase("")),
]
NESTED = [
    ("sea AND (owl OR ink) NOT paper", both(term("sea"), without(either(term("owl"), term("ink")), term("paper")))),
    ("(sea owl) OR title:pale", either(both(term("sea"), term("owl")), within(term("pale"), "title"))),
    ("NEAR(sea owl, 3) OR seal*", either(near("sea", "owl", distance=3), term("seal", prefix=True))),
    ("(pa* NOT sea) AND ink", both(without(term("pa", prefix=True), term("sea")), term("ink"))),
]


@pytest.mark.parametrize("text,query", SINGLE, ids=[t for t, _ in SINGLE])
def test_matches_and_scores(index, fts, text, query):
    expected = fts(text)
    got = {r.id: r.score for r in matches(index, query).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[i] - expected[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("text,query", NESTED, ids=[t for t, _ in NESTED])
def test_nested_matches(index, fts, text, query):
    assert {r.id for r in matches(index, query).collect()} == fts(text).keys()


def random_query(rng, depth):
    """A random tree, as text and composed."""
    kind = rng.choice(["term", "phrase", "prefix", "near", "column"]) if depth == 0 else rng.choice(
        ["and", "or", "not", "term"])
    a, b = rng.choice(WORDS), rng.choice(WORDS)
    if kind == "term":
        return a, term(a)
    if kind == "phrase":
        return f'"{a} {b}"', phrase(f"{a} {b}")
    if kind == "prefix":
        return f"{a[:3]}*", term(a[:3], prefix=True)
    if kind == "near":
        n = rng.randint(0, 4)
        return f"NEAR({a} {b}, {n})", near(a, b, distance=n)
    if kind == "column":
        f = rng.choice(["title", "author", "text"])
        return f"{f}:{a}", within(term(a), f)
    (lt, lq), (rt, rq) = random_query(rng, depth - 1), random_query(rng, depth - 1)
    combine = {"and": both, "or": either, "not": without}[kind]
    return f"({lt}) {kind.upper()} ({rt})", combine(lq, rq)


def test_random_trees(index, fts):
    rng = random.Random(3)
    for _ in range(12):
        text, query = random_query(rng, 2)
        assert {r.id for r in matches(index, query).collect()} == fts(text).keys(), text
    for _ in range(8):
        text, query = random_query(rng, 1)
        expected = fts(text)
        got = {r.id: r.score for r in matches(index, query).collect()}
        assert got.keys() == expected.keys(), text
        assert all(abs(got[i] - expected[i]) < 1e-9 for i in got), text


def test_search_returns_columns_best_first(index, articles, fts):
    rows = search(index, articles, both(term("sea"), term("owl"))).collect()
    assert [r.id for r in rows] == sorted(fts("sea owl"), key=lambda i: (fts("sea owl")[i], i))
    assert rows[0].asDict().keys() == {"id", "url", "title", "author", "added_at", "score"}
    top = search(index, articles, both(term("sea"), term("owl")), limit=3).collect()
    assert top == rows[:3]


def test_bad_queries_fail_before_any_job(index):
    for bad in (lambda: within(term("a"), "body"), lambda: without(term("a")),
                lambda: both("sea", "owl"), lambda: near("a", "b", distance=-1),
                lambda: matches(index, "sea")):
        with pytest.raises(ValueError):
            bad()


def test_unwritten_index_gives_the_same(index, articles):
    query = either(phrase("sea paper"), term("owl"))
    assert sorted(matches(index, query).collect()) == sorted(matches(Index.of(articles), query).collect())


def test_batch_equals_single_queries(spark, index, fts):
    texts = ["sea owl", "ink", "paper pale seal", "sea nowhere", "..."]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    rows = match_batch(index, queries).collect()
    for number, text in enumerate(texts):
        got = {r.id: r.score for r in rows if r.query_id == number}
        expected = fts(text) if text not in ("...",) else {}
        assert got.keys() == expected.keys()
        assert all(abs(got[i] - expected[i]) < 1e-9 for i in got)
    top = search_batch(index, queries, k=2)
    assert sorted((r.query_id, r.rank) for r in top.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert "WindowGroupLimit" in plan_of(top)


@pytest.mark.parametrize("first_blocks", [1, 3])
def test_blocks_that_are_passed_over_change_nothing(spark, articles, monkeypatch, first_blocks):
    monkeypatch.setattr(index_module, "BLOCK_BITS", 2)
    root = scratch_path(spark, "blocks")
    write_index(articles.where("id <= 21"), root, 0)  # the two batches share a block
    write_index(articles.where("id > 21"), root, 1)
    index = Index.read(spark, root)
    texts = ["sea", "sea owl", "paper pale seal", "café", "sea nowhere", "ink ink", "..."]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    every = match_batch(index, queries).collect()
    assert sorted(match_batch(index, queries, one_block=0).collect()) == sorted(every)
    scored = []

    def spied(used, blocks, corpus):
        scored.append(blocks.count())
        return answered(used, blocks, corpus)

    answered = search_module._answered
    monkeypatch.setattr(search_module, "_answered", spied)
    for k in (1, 4, 100):
        best = {}
        for row in sorted(every, key=lambda r: (r.query_id, round(r.score, 9), r.id)):
            best.setdefault(row.query_id, []).append(row.id)
        got = {}
        top = search_batch(index, queries, k, one_block=0, first_blocks=first_blocks).collect()
        for row in sorted(top, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(row.query_id, []).append(row.id)
        assert got == {query: ids[:k] for query, ids in best.items()}
    # For each k what is scored first, then what can still reach the best: fewer if k is small.
    assert scored[1] < scored[5]


@pytest.mark.parametrize("one_block", [0, 1_000_000])
def test_candidates_do_not_carry_the_words_of_their_query(spark, index, monkeypatch, one_block):
    """What is written and moved per candidate does not grow with the length of a query."""
    schemas, written = {}, search_module._written

    def spied(df, name):
        schemas[name] = {f.name: f.dataType.typeName() for f in df.schema}
        return written(df, name)

    monkeypatch.setattr(search_module, "_written", spied)
    queries = spark.createDataFrame([(1, "sea owl paper"), (2, "owl sea")], "query_id int, text string")
    got = search_module.match_batch(index, queries, one_block=one_block)
    wanted = {1: both(term("sea"), term("owl"), term("paper")), 2: both(term("sea"), term("owl"))}
    for number, query in wanted.items():
        expected = {r.id: r.score for r in matches(index, query).collect()}
        found = {r.id: r.score for r in got.where(F.col("query_id") == number).collect()}
        assert expected and found.keys() == expected.keys()
        assert all(abs(found[i] - expected[i]) < 1e-9 for i in found)
    for name in set(schemas) - {"queries", "plans", "terms", "needed"}:
        assert not {"array", "struct", "string"} & set(schemas[name].values()), name


def test_prefixes_are_looked_up_in_the_dictionary(index, articles, monkeypatch):
    """None, one and several words, and more than are listed, alone, in phrases and with columns;
    a search is the same without a dictionary."""
    unwritten = Index.of(articles)
    assert index.listed("sea") == ["sea", "seal", "search"] and index.listed("o") == ["owl"] and index.listed("x") == []
    assert unwritten.listed("sea") is None
    queries = [
        term("sea", prefix=True), term("o", prefix=True), term("x", prefix=True),
        both(term("pa", prefix=True), term("ow", prefix=True)), either(term("x", prefix=True), term("ink")),
        phrase("sea pa", prefix=True), phrase("ink ow", prefix=True), phrase("s", prefix=True, first=True),
        within(term("se", prefix=True), "title"), without(term("s", prefix=True), phrase("sea i", prefix=True)),
        both(term("sea"), near("paper", "ink", distance=3)),
    ]
    for listed in (1000, 2, 0):
        monkeypatch.setattr(index_module, "LISTED_WORDS", listed)
        for query in queries:
            got, expected = ({r.id: round(r.score, 9) for r in matches(i, query).collect()} for i in (index, unwritten))
            assert got == expected, (listed, query)


def test_the_postings_of_a_prefix_are_those_of_its_words(index):
    read = postings_of(index, [("sea", True)], {"sea": ["sea", "seal"]})
    assert {r.term for r in read.select("term").distinct().collect()} == {"sea", "seal"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term_bucket" in plan and "In(term, [sea,seal])" in plan
    assert postings_of(index, [("x", True)], {"x": []}).count() == 0


def test_words_alone_move_no_positions(index):
    plan = matches(index, both(term("sea"), either(term("ink"), within(term("paper"), "text"))))
    assert "collect_list" not in plan._jdf.queryExecution().toString()


def test_blocks_bound_every_score(index):
    posted = index.terms().select("term", index_module.block_of(F.col("id")).alias("block"), "dl", F.size("at").alias("n"))
    # A block that batches share has a row of each.
    rows = index.blocks.groupBy("term", "block").agg(F.max("most").alias("most"), F.min("shortest").alias("shortest"))
    assert posted.join(rows, ["term", "block"], "left").where("most IS NULL OR n > most OR dl < shortest").count() == 0
    assert index.blocks.groupBy("term").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits")).exceptAll(
        index.document_frequencies()).count() == 0


def test_batches_without_blocks_get_theirs_from_the_postings(spark, articles):
    root = scratch_path(spark, "older")
    write_index(articles.where("id <= 20"), root, 0)
    write_index(articles.where("id > 20"), root, 1)
    batches = Generations(spark, root)
    state = batches.state()
    expected = sorted(Index.committed(batches).blocks.drop("batch_id").collect())
    older = replace(state.valid[0], tables={k: v for k, v in state.valid[0].tables.items() if k != "blocks"})
    state = replace(state, valid={**state.valid, 0: older})
    assert sorted(Index.committed(batches, state=state).blocks.drop("batch_id").collect()) == expected


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_plan_prunes_buckets_and_reads_postings_once(index):
    for query in (term("sea"), both(term("sea"), term("owl")), either(term("sea"), without(term("owl"), term("ink")))):
        plan = plan_of(matches(index, query))
        scans = [line for line in plan.split("\n") if line.startswith("Location") and "/postings/" in line]
        assert len(scans) == 1
        filters = [line for line in plan.split("\n") if line.startswith("PartitionFilters")]
        assert any("term_bucket" in line for line in filters)
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
        assert "Exchange hashpartitioning(term" not in plan


def test_one_letter_prefix_prunes_buckets(index):
    everything = index.postings.select("term_bucket").distinct().count()
    read = postings_of(index, [("s", True)])
    assert {r.term[0] for r in read.select("term").distinct().collect()} == {"s"}
    plan = plan_of(read)
    filters = next(line for line in plan.split("\n") if line.startswith("PartitionFilters"))
    assert "term_bucket" in filters and everything > 1


def test_large_distances_compare_positions(index, fts):
    for distance in (0, 70, 1000):
        got = {r.id: r.score for r in matches(index, near("sea", "owl", "paper", distance=distance)).collect()}
        expected = fts(f"NEAR(sea owl paper, {distance})")
        assert got.keys() == expected.keys()
        assert all(abs(got[i] - expected[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("listed", [64, -1])
def test_near_in_long_articles_equals_a_plain_count(spark, monkeypatch, listed):
    """Positions are swept in order, also for short distances; every start that counts is counted."""
    from readlake.operators import search as module

    monkeypatch.setattr(module, "LISTED_WINDOW", listed)
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["sea", "owl", "ink", *["x"] * density]) for _ in range(400)) for density in (1, 20, 90, 300)]
    rows = [(n, "u", "sea", None, text, "2024-01-01T00:00:00Z") for n, text in enumerate(texts)]
    index = Index.of(spark.createDataFrame(rows, SCHEMA))
    for distance in (0, 5, 70, 150):
        query = near("sea x", "owl", "ink", distance=distance)
        got = {r.id: (r.f0, r.f1, r.f2) for r in module._article_hits(index, query)[0].collect() if r.f0}
        wanted = {}
        for n, text in enumerate(texts):
            words = text.split()
            at = [[i for i in range(len(words)) if words[i : i + len(p)] == p] for p in (["sea", "x"], ["owl"], ["ink"])]
            reach = [distance + 2, distance + 1, distance + 1]
            ends = [e for e in sorted({i for m in at for i in m})
                    if all(any(e - w <= i <= e for i in m) for m, w in zip(at, reach))]
            counts = tuple(sum(any(i <= e <= i + w for e in ends) for i in m) for m, w in zip(at, reach))
            if counts[0]:
                wanted[n] = counts
        assert got == wanted


def test_totals_count_every_article(index):
    row = index.corpus().first()
    tokens = sum(len((a[2] + " " + (a[3] or "") + " " + a[4]).split()) for a in make_articles())
    assert (row.n_docs, row.n_tokens) == (60, tokens)
    assert index.document_frequencies().where(F.col("term") == "").count() == 0


def test_postings_are_gathered_a_share_of_tokens_at_a_time(spark, monkeypatch):
    rows = [(1, "b a", None, "a a Ä"), (None, None, None, None), (2, "", "x", "one two " * 40), (1, "b", "b", "")]
    words = [(i, *(tokenize_words(x or "") for x in fields)) for i, *fields in rows]
    batch = pa.RecordBatch.from_pydict({
        name: pa.array([row[k] for row in words], kind)
        for k, (name, kind) in enumerate([("id", pa.int64()), *((f, pa.list_(pa.string())) for f in index_module.FIELDS)])
    })
    expected = []
    for i, *fields in words:
        at = {}
        for name, found in zip(index_module.FIELDS, fields, strict=True):
            for k, word in enumerate(found):
                at.setdefault(word, []).append(index_module.field_start(name) + k)
        dl = sum(map(len, fields))
        expected += [("", i, dl, []), *((word, i, dl, places) for word, places in at.items())]
    for share in (1, 4, 1 << 18):
        monkeypatch.setattr(index_module, "GATHERED", share)
        parts = list(index_module._gather(iter([batch, batch[:0]])))
        found = [tuple(row.values()) for part in parts for row in part.to_pylist()]
        assert sorted(found, key=str) == sorted(expected, key=str)
    columns = spark.createDataFrame(rows, "id bigint, title string, author string, text string")
    found = [tuple(row)[:4] for row in index_module.postings(columns).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
