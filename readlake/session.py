"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Recommended settings for a batch session. Shuffle partitions are left to the
# cluster: AQE coalesces small ones and splits skewed ones.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # So many urls are looked up by the Bloom filters of the key files.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}

_local_scratch: dict[str, str] = {}


def session(app_name: str = "readlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own;
    on a cluster a machine-local folder would be invisible to the other hosts.
    """
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="readlake-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder."""
    return f"{scratch_dir(spark)}/readlake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing a table; it stays columnar and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # no job that looks the columns up


class Scratch:
    """Tables that one job needs between its steps and deletes when it is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            delete_path(self.spark, path)
        self.paths = []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *error: object) -> None:
        self.drop()


def delete_path(spark: SparkSession, path: str) -> None:
    _, files, location = _located(spark, path)
    files.delete(location, True)


# Small files that the driver itself reads and writes, on whatever file system Spark uses.


def _located(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    location = hadoop.Path(path)
    return hadoop, location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files in a folder, sorted; none if there is no such folder."""
    _, files, location = _located(spark, folder)
    if not files.exists(location):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(location))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; null if it is gone."""
    _, files, location = _located(spark, path)
    if not files.exists(location):
        return None
    stream = files.open(location)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that does not exist yet, whole or not at all; false if it exists.

    It is written aside and renamed: of two writers of one name, one loses, where the file
    system renames without replacing (HDFS, ABFS, local disks).
    """
    hadoop, files, location = _located(spark, path)
    location = files.makeQualified(location)
    aside = hadoop.Path(location.getParent(), f".{location.getName()}.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(location.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(aside, location, no_options)
    except Py4JJavaError as error:
        files.delete(aside, False)
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Deal out rows that come from few files, before work that is heavy per row.

    For callers who know that their files are few: one small file is one task however
    many cores there are. Operators never do this by themselves. How many tasks there
    are is left to Spark, which merges small ones and splits large ones.
    """
    return df.repartition(key)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Arrow functions find it
    on workers that do not share the driver's Python path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="readlake-package-")  # the driver serves it to the others
    archive = os.path.join(folder, "readlake-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for parent, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(parent, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
