"""The pages format: ranges, pruning, errors."""

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import files
from scriptorium.sources.pages import page_source


def count(path):
    with open(path) as f:
        return len(f.read().split("|"))


def read(path, first, after):
    with open(path) as f:
        pages = f.read().split("|")[first:after]
    if "torn" in pages:
        raise ValueError("a torn page")
    with open(path + ".read", "a") as log:
        log.write(f"{first}-{after}\n")
    return pages


@pytest.fixture
def folder(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(page_source(count, read, pushdown=True))
    (tmp_path / "long.pdf").write_text("|".join(f"page {i}" for i in range(100)))
    (tmp_path / "bad.PDF").write_text("|".join(["one"] * 10 + ["torn"] + ["two"] * 9))
    (tmp_path / "other.txt").write_text("no page")
    return tmp_path


def pages(spark, folder, **options):
    return spark.read.format("pages").options(**{"rangeBytes": 40} | options).load(str(folder))


def test_a_long_file_is_many_tasks(spark, folder):
    df = pages(spark, folder)
    assert df.rdd.getNumPartitions() > 10
    rows = {r.page: r.text for r in df.where(F.col("path").endswith("long.pdf")).collect()}
    assert rows == {i: f"page {i}" for i in range(100)}


def test_only_a_torn_range_is_lost(spark, folder):
    rows = pages(spark, folder, rangeBytes=20).where(F.col("path").endswith("bad.PDF")).collect()
    (lost,) = [r for r in rows if r.error]
    assert "ValueError: a torn page" == lost.error and lost.text is None
    assert 0 < sum(r.text == "one" for r in rows) <= 10 and any(r.text == "two" for r in rows)


def test_pruning(spark, folder):
    df = spark.read.format("pages").schema("page int, path string").option("rangeBytes", 40).load(str(folder))
    assert df.where(F.col("path") == str(folder / "long.pdf")).count() == 100 and df.columns == ["page", "path"]
    assert not list(folder.glob("*.read"))  # no text was asked for
    assert pages(spark, folder).where(F.col("path") == str(folder / "long.pdf")).count() == 100
    assert not (folder / "bad.PDF.read").exists()


def test_documents_of_pages(spark, folder):
    (folder / "bad.PDF").unlink()
    docs = {r.file_name: r for r in files.documents(spark, str(folder), paged=pages(spark, folder)).collect()}
    assert docs["long.pdf"].text.split("\n")[:2] == ["page 0", "page 1"] and docs["long.pdf"].error is None
    assert docs["other.txt"].text == "no page"


def test_nothing_there(spark, folder):
    (folder / "empty").mkdir()
    assert pages(spark, folder / "empty").count() == 0
    with pytest.raises(Exception, match="nothing at"):
        spark.read.format("pages").load(str(folder / "none")).count()
