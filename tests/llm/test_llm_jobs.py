"""What the first stages of the pipeline ask of the driver: jobs, each of a task per partition, and rows."""

import os

from test_llm_simhash import texts

import data
from readlake.llm import langid, simhash
from readlake.session import materialize


def jobs(spark, run):
    """The result, and how many jobs it took (without those of broadcasts)."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    before = len(context.statusTracker().getJobIdsForGroup("counted"))
    try:
        out = run()
        return out, len(context.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def test_a_written_table_is_read_without_a_look_at_its_files(spark):
    df = spark.createDataFrame([(1, "a", [1.5]), (2, None, None)], "n long not null, s string, x array<double>")
    _, wrote = jobs(spark, lambda: df.write.format("noop").mode("overwrite").save())
    kept, count = jobs(spark, lambda: materialize(df, "jobs"))
    assert count == wrote
    again = spark.read.parquet(kept.inputFiles()[0].rpartition("/")[0])
    assert kept.schema == again.schema and sorted(kept.collect()) == sorted(again.collect())


def test_keep_one_takes_few_jobs(spark):
    df, _ = data.documents(spark, texts())
    _, count = jobs(spark, lambda: simhash.keep_one(df).write.format("noop").mode("overwrite").save())
    assert count <= 42


def test_the_sample_is_learned_from_in_a_task(spark, sf_dir, monkeypatch):
    """Only the model comes to the driver, and it is what learning there gives."""

    here, real = os.getpid(), langid.train

    def refuse(*args):
        assert os.getpid() != here, "the driver learns"
        return real(*args)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(langid, "train", refuse)
    model = langid.fit(docs)
    assert len(model.languages) == 4 and model.scores.shape == (1 << langid.BUCKET_BITS, 4) and model.scores.any()
    assert 0 < model.threshold < 1 and model.temperature > 0
