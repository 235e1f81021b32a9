"""The log of an archive: reruns, writers that meet, checkpoints, merges, and the keys."""

import pytest
from pyspark.sql import functions as F

from readlake.operators import ingest
from readlake.operators import store as store_module
from readlake.operators.generations import CHECKPOINT_EVERY, LOG, Conflict, Generations, _ranges, merged_groups
from readlake.operators.ingest import ITEM_SCHEMA, deduplicate, run_import
from readlake.operators.search import matches, term
from readlake.operators.store import KEY_SCHEMA, URL_BUCKETS, Store, url_bucket
from readlake.session import list_names, read_text, scratch_path, write_new

NOW = "2025-05-05T05:05:05Z"
FETCHED = "url string, title string, author string, text string, source string, reason string"


def items(spark, *urls, tags=None):
    rows = [(f"https://{u}", u, None, None, f"text {u.replace('/', ' ')}", tags, "list", n) for n, u in enumerate(urls)]
    return spark.createDataFrame(rows, ITEM_SCHEMA)


@pytest.fixture
def store(spark):
    return Store(spark, scratch_path(spark, "store"))


@pytest.fixture
def put(spark, store):
    nothing = spark.createDataFrame([], FETCHED)
    return lambda batch_id, *urls, **more: run_import(store, items(spark, *urls, **more), nothing, batch_id, F.lit(NOW))


def ids(store):
    return {r.url.removeprefix("https://"): r.id for r in store.articles().collect()}


def rows_of(store):
    found = store.articles().collect()
    assert len({r.id for r in found}) == len({r.url for r in found}) == len(found)
    return ids(store)


def test_an_older_batch_again_keeps_ids_and_urls_unique(store, put):
    put(1, "a/1", "a/2", tags=["one"])
    put(2, "b/1", "b/2", "a/1", tags=["two"])
    again = put(1, "a/1", "a/2", "a/3", "b/1", tags=["one"])
    assert rows_of(store) == {"a/1": 1, "a/2": 2, "b/1": 3, "b/2": 4, "a/3": 5}
    assert again.summary().first().asDict() == {
        "saved": 3, "from_export": 3, "from_wayback": 0, "skipped": 1, "failed": 0}
    tags = {}
    for r in store.tags().collect():
        tags.setdefault(r.article_id, set()).add(r.tag)
    assert tags == {1: {"one", "two"}, 2: {"one"}, 3: {"one", "two"}, 4: {"two"}, 5: {"one"}}
    assert [r.id for r in matches(store.index(), term("3")).collect()] == [5]
    # An id is not given twice, also when the article that had it is gone.
    put(1, "a/2")
    put(3, "c/1", "a/1")
    assert rows_of(store) == {"a/2": 2, "b/1": 3, "b/2": 4, "c/1": 6, "a/1": 7}


def interrupted(monkeypatch, other):
    """Run something else between a batch's reading and its commit, once."""
    append, todo = store_module.Store.append, [other]

    def late(self, *args, **more):
        if todo:
            todo.pop()()
        return append(self, *args, **more)

    monkeypatch.setattr(store_module.Store, "append", late)


def test_a_batch_is_made_again_if_another_took_its_urls_or_ids(store, put, monkeypatch):
    put(1, "a/1")
    interrupted(monkeypatch, lambda: put(3, "b/1", "c/1"))
    result = put(2, "b/1", "b/2")
    assert rows_of(store) == {"a/1": 1, "b/1": 2, "c/1": 3, "b/2": 4}
    assert result.summary().first()["skipped"] == 1


def test_a_batch_that_another_job_wrote_is_not_replaced_unseen(spark, store, put, monkeypatch):
    interrupted(monkeypatch, lambda: put(1, "x/1"))
    put(1, "a/1")
    assert rows_of(store) == {"a/1": 2}
    state = store.batches.state()
    put(1, "a/2")
    with pytest.raises(Conflict):
        store.append(store.articles(), store.tags(), 1, state=state)
    monkeypatch.setattr(ingest, "ATTEMPTS", 1)
    interrupted(monkeypatch, lambda: put(5, "z/1"))
    with pytest.raises(Conflict, match="meanwhile"):
        put(4, "z/1")


def test_writers_that_do_not_clash_both_commit(spark, store):
    no_tags = spark.createDataFrame([], "article_id bigint, tag string")
    rows = "id bigint, url string, title string, author string, text string, added_at string"
    state = store.batches.state()
    for n in (1, 2):
        one = spark.createDataFrame([(n, f"https://e.org/{n}", None, None, "t", "2024-01-01T00:00:00Z")], rows)
        store.append(one, no_tags, n, state=state)
    assert rows_of(store) == {"e.org/1": 1, "e.org/2": 2}
    with pytest.raises(Conflict, match="url https://e.org/2"):
        store.append(store.articles().where("id = 2").withColumn("id", F.lit(9)), no_tags, 3, state=state)


def test_a_file_is_written_once(spark):
    folder = scratch_path(spark, "log")
    assert list_names(spark, folder) == [] and read_text(spark, f"{folder}/1") is None
    assert write_new(spark, f"{folder}/1", "één") and not write_new(spark, f"{folder}/1", "two")
    assert list_names(spark, folder) == ["1"] and read_text(spark, f"{folder}/1") == "één"


def test_many_small_batches_end_in_few_folders_and_one_log_file(spark):
    """A hundred commits, with a table that only some have, merged as they come."""
    batches = Generations(spark, scratch_path(spark, "batches"))
    for n in range(100):
        state = batches.state()
        generation = batches.new(n, state)
        tables = {"a": batches.write(spark.range(n, n + 1), "a", n, generation)}
        if n % 10 == 0:
            tables["b"] = batches.write(spark.range(1).selectExpr(f"{n} AS x", "id % 2 AS p"), "b", n, generation, ("p",))
        batches.commit(generation, n, tables, state, rows=1, last_id=n)
        if n % 20 == 19:
            batches.compact(keep=[n])
    state = batches.state()
    assert len(state.valid) <= 10 and state.last_id == 99 and 99 in state.valid
    files = list_names(spark, f"{batches.root}/{LOG}")
    assert sum(name.endswith(".checkpoint") for name in files) == 1 and len(files) <= CHECKPOINT_EVERY
    batches.checkpoint()
    assert len(list_names(spark, f"{batches.root}/{LOG}")) == 1 and batches.state() == state
    batches.vacuum()
    assert sorted(r.id for r in batches.read("a", "id bigint").collect()) == list(range(100))
    assert sorted(r.x for r in batches.read("b", "x int, p bigint").collect()) == list(range(0, 100, 10))
    with pytest.raises(ValueError, match="merged"):
        batches.new(3, state)


def test_ranges():
    assert _ranges((), [3, 1, 2, 9]) == ((1, 3), (9, 9))
    assert _ranges([(1, 3), (9, 9)], [4, 8]) == ((1, 4), (8, 9))


def test_an_unfinished_write_is_not_read_and_young_folders_stay(spark, store, put):
    put(1, "a/1")
    aside = store.batches.path("articles", 7, "unfinished")
    store.articles().drop("batch_id").write.parquet(aside)
    assert ids(store) == {"a/1": 1}
    store.vacuum(older_than=3600)
    assert list_names(spark, aside)
    store.vacuum()
    assert not list_names(spark, aside) and ids(store) == {"a/1": 1}


def test_only_buckets_of_the_urls_are_read(spark, store, put):
    put(1, *(f"e.org/{n}" for n in range(300)))
    urls = spark.createDataFrame([(f"https://e.org/{n}",) for n in (5, 299, 300)], "url string")
    found = store.keys(urls)
    assert {r.url[-3:]: r.id for r in found.collect()} == {"g/5": 6, "299": 300}
    plan = found._jdf.queryExecution().executedPlan().toString()
    buckets = {r[0] for r in urls.select(url_bucket(F.col("url"))).collect()}
    assert "PartitionFilters" in plan and len(buckets) < URL_BUCKETS
    partition_filters = plan[plan.index("PartitionFilters"):]
    assert all(f"{b}" in partition_filters[:300] for b in buckets) and "url_bucket" in partition_filters[:300]
    assert "In(url" in plan  # pushed to Parquet, which asks its Bloom filters
    # All keys are there, once.
    keys = store.batches.read("keys", KEY_SCHEMA)
    assert keys.count() == 300 and keys.where(F.col("url_bucket") != url_bucket(F.col("url"))).count() == 0
    assert store.keys(spark.createDataFrame([], "url string")).count() == 0


def test_key_files_have_bloom_filters(spark, store, put):
    put(1, *(f"e.org/{n}" for n in range(50)))
    file = store.batches.read("keys", KEY_SCHEMA).inputFiles()[0]
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    conf = spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    offsets = {columns.get(k).getPath().toDotString(): columns.get(k).getBloomFilterOffset() for k in range(columns.size())}
    reader.close()
    assert offsets["url"] > 0 and offsets["id"] < 0


def test_a_rerun_that_saves_nothing_writes_no_articles(spark, store, put):
    put(1, "a/1", tags=["x"])
    put(2, "a/1", tags=["y"])
    assert set(store.batches.state().valid[2].tables) == {"tags"}
    assert {r.tag for r in store.tags().collect()} == {"x", "y"} and ids(store) == {"a/1": 1}


def test_items_without_places_do_not_all_meet(spark):
    """A list without places: each url once, and no pair of different urls is compared."""
    rows = [(f"https://e.org/{n % 2500}?utm_source={n}", f"t{n}", None, None, None, None, None, None) for n in range(5000)]
    rows += [("https://e.org/1", "again", None, None, "x", None, "file", None)] * 3
    found = deduplicate(spark.createDataFrame(rows, ITEM_SCHEMA)).collect()
    assert len(found) == len({r.url for r in found}) == 2500
    assert sum(r.n_items for r in found) == 5003


def test_what_is_merged_again_is_written_once(spark):
    """Three of nine like batches give one of the next size, three of which are merged again."""
    batches = Generations(spark, scratch_path(spark, "batches"))
    for n in range(9):
        state = batches.state()
        generation = batches.new(n, state)
        tables = {"a": batches.write(spark.range(n, n + 1), "a", n, generation)}
        batches.commit(generation, n, tables, state, rows=1, last_id=n)
    assert batches.compact(fanout=3) == 1 and list(batches.state().valid) == [8]
    assert batches.compact(fanout=3) == 0 and batches.state().closed == ((0, 8),)
    assert sorted(r.id for r in batches.read("a", "id bigint").collect()) == list(range(9))
    groups = merged_groups({0: 9, 1: 9, 2: 9, 3: 30, 4: 30, 5: 300}, 3)
    assert sorted(groups) == [[0, 1, 2, 3, 4], [5]]
