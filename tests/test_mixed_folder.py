"""The files of the mixed folder are as many as its links ask for."""

import re

from pyspark.sql import functions as F

from readlake.plans import catalog
from readlake.session import scratch_path
from readlake.sources import exports

SF = "/root/testdata/sf0.01"


def test_no_file_holds_a_share_of_all_links(spark, monkeypatch):
    write, lines = catalog.export.write_files, {}

    def watched(documents, folder, **more):
        if folder.endswith(("/bookmarks", "/pocket-pages", "/urls")):
            counted = documents.select(F.size(F.split("content", "\n")).alias("n"))
            lines[folder.rsplit("/", 1)[-1]] = [r.n for r in counted.collect()]
        write(documents, folder, **more)

    monkeypatch.setattr(catalog.export, "write_files", watched)
    catalog.QUERIES["import_mixed_folder"](spark, SF)
    assert len(lines) == 3
    for found in lines.values():
        assert len(found) > 8 and max(found) <= 1000


def test_the_folder_is_listed_once_for_all_readers(spark, monkeypatch):
    root = scratch_path(spark, "listed")
    spark.createDataFrame([("https://e.org/a",)], "url string").coalesce(1).write.text(f"{root}/urls")
    spark.createDataFrame([('<a href="https://e.org/b">b</a>',)], "v string").coalesce(1).write.text(f"{root}/links")
    listings = []
    reader = type(spark.read)
    read = reader.format

    def watched(self, source):
        if source == "binaryFile":
            listings.append(source)
        return read(self, source)

    monkeypatch.setattr(reader, "format", watched)
    assert sorted(r.url for r in exports.read_exports(spark, root).collect()) == ["https://e.org/a", "https://e.org/b"]
    assert len(listings) == 1


def test_only_known_columns_of_wide_csv_files_are_read(spark):
    """A column that a row lacks costs an exception inside Spark's parser, so a wide file among
    narrow ones must not have all its columns asked for."""
    root = scratch_path(spark, "wide")
    narrow = 'Title, URL ,time_added,tags\n"a\nb",https://e.org/a,86400,x|y\nc,https://e.org/c\n'
    wide = ",".join([*(f"c{k}" for k in range(299)), "URL", "url"]) + "\n" + "," * 299 + "https://e.org/w,https://e.org/no\n"
    files = [("narrow.csv", narrow), ("wide.CSV", wide), ("bare.csv", "URL\nhttps://e.org/b\n")]
    catalog.export.write_files(spark.createDataFrame(files, "path string, content string"), root)
    items = exports._csv_items(spark, root)
    got = sorted((r.url, r.title, r.added_at, r.tags) for r in items.collect())
    assert got == [
        ("https://e.org/a", "a\nb", "1970-01-02T00:00:00Z", ["x", "y"]),
        ("https://e.org/b", None, None, None),
        ("https://e.org/c", "c", None, [""]),
        ("https://e.org/w", None, None, None),
    ]
    plan = items._jdf.queryExecution().sparkPlan().toString()
    scanned = next(line for line in plan.splitlines() if "FileScan csv" in line).split("FileScan csv", 1)[1]
    assert len(re.findall(r"\bc\d+#", scanned.split("]", 1)[0])) == 5
