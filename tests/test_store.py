"""Collections: changes listed by version, key filters, batches, compaction; replies and rows computed once."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.plans import api, pipelines, providers
from scriptorium.plans.replies import Replies
from scriptorium.schemas import CASE_CHUNK, CHUNK
from scriptorium.sources import store as st
from scriptorium.sources.store import Collection
from scriptorium.streaming.ingest import landing, upsert_stream

EMBED = providers.hashed(16)
REPLY = "SECTION 0: METADATA\nFILE NAME: {n}\nSECTION 1: FACTS\nfacts of {n} {k}\nSECTION 2: ISSUES\nissues\n"


def some(spark, *ids, source="s"):
    return spark.createDataFrame([(i, f"text {i}", source) for i in ids], "id string, text string, source string").coalesce(1)


def test_versions_list_changes_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "BASE", 5)
    c = Collection(spark, str(tmp_path), CHUNK, keys=())
    for i in range(8):
        c.append(some(spark, str(i), source=f"s{i % 2}"))
    assert c.count() == 8 and len(c._version()[2]) == 8
    lines = [len(open(f).read().split("\n")) - 1 for f in sorted(glob.glob(f"{tmp_path}/_versions/0*"))]
    assert lines == [0, 1, 1, 1, 1, 5, 1, 1, 1]  # a full list every fifth
    assert c._version(4)[2] == c._version()[2][:4]
    assert c.delete(F.col("source") == "s0") == 4 and c.count() == 4
    again = Collection(spark, str(tmp_path), CHUNK, keys=())
    assert again.vacuum(keep=1, older_than=0) > 0 and again.count() == 4 and min(again._numbers()) == 5


def test_filters_name_the_files(spark, tmp_path):
    c = Collection(spark, str(tmp_path), CHUNK)
    for i in range(6):
        c.append(some(spark, *[f"{i}-{k}" for k in range(40)], source=f"s{i % 3}"))
    files = c._version()[2]
    by = {f: {r.id for r in spark.read.parquet(f"{tmp_path}/{f}").collect()} for f in files}
    opened = 0
    for i in (0, 2, 5):
        keys = spark.createDataFrame([(f"{i}-{k}",) for k in range(40)], "id string")
        may = c.candidates(keys, "id")
        assert {f for f in files if by[f] & {f"{i}-{k}" for k in range(40)}} <= set(may)  # never misses one
        opened += len(c.candidates(keys.where(F.col("id") == f"{i}-7"), "id"))
    assert 3 <= opened <= 4  # of 18
    assert len(c.by_ids(["3-1"]).inputFiles()) <= 2 and c.by_ids(["3-1"]).count() == 1 and c.has("5-39") and not c.has("no")
    assert c.by_ids(spark.createDataFrame([("1-1",), ("2-2",), ("no",)], "id string")).count() == 2
    assert len(c.where(source="s1").inputFiles()) <= 3 and c.where(source="s1").count() == 80
    assert c.by_ids([]).count() == 0 and c.where(source=None).count() == 0


def test_filters_of_many_keys(spark, tmp_path):
    c = Collection(spark, str(tmp_path), CHUNK)
    c.append(spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("source")).coalesce(1))
    c.append(spark.range(50_000, 50_010).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("source")).coalesce(1))
    (large, small) = c._version()[2]
    sizes = {(r.file, r.key): r.pieces for r in spark.read.parquet(f"{tmp_path}/d-*/_keys").collect()}
    assert sizes[large, "id"] == 16 and sizes[small, "id"] == 1 and (small, "source") not in sizes
    of = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("id"))
    assert large in c.candidates(of(19_999, 20_000), "id") and small not in c.candidates(of(19_999, 20_000), "id")
    assert small in c.candidates(of(50_009, 50_011), "id")
    wrong = [c.candidates(of(i, i + 1), "id") for i in range(30_000, 30_005)]
    assert sum(large in x for x in wrong) <= 1
    assert c.candidates(spark.range(5).select(F.col("id").cast("string")), "id", None) == [large]


def test_large_key_sets_read_the_column(spark, tmp_path, monkeypatch):
    c = Collection(spark, str(tmp_path), CHUNK)
    c.append(some(spark, "a"))
    c.append(some(spark, "b"))
    monkeypatch.setattr(st, "MOST_TESTS", 3)
    two = spark.createDataFrame([("a",), ("x",)], "id string")
    assert c.candidates(two, "id") == c._version()[2] and c.by_ids(two).count() == 1


def test_batches_are_written_once(spark, tmp_path):
    c = Collection(spark, str(tmp_path), CHUNK)
    c.replace_groups(some(spark, "a", "b"), "source", batch=("stream", 0))
    number = c._version()[0]
    assert c.replace_groups(some(spark, "z"), "source", batch=("stream", 0)).count() == 0 and c._version()[0] == number
    c.append(some(spark, "c", source="t"), batch=("other", 7))
    assert c.append(some(spark, "d", source="t"), batch=("other", 6)) == 0
    c.append(some(spark, "e", source="u"))
    assert (c.batch("stream"), c.batch("other"), c.batch("none")) == (0, 7, -1)
    assert {r.id for r in c.read().collect()} == {"a", "b", "c", "e"}


def test_compaction(spark, tmp_path):
    c = Collection(spark, str(tmp_path), CHUNK)
    for i in range(4):
        c.append(some(spark, *[f"{i}-{k}" for k in range(5)]))
    before, plan = sorted(map(tuple, c.read().collect())), c.read()
    assert c.compact(key="id") == 4 and len(c._version()[2]) == 1
    assert sorted(map(tuple, c.read().collect())) == before and plan.count() == 20 and c.has("3-4")
    assert c.compact() == 0


def test_stream_replays_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    rows = lambda f: f.select(F.col("path").alias("id"), F.col("path").alias("source"), seen(F.col("content").cast("string")).alias("text"))
    c = Collection(spark, str(tmp_path / "db"), CHUNK)
    run = lambda: upsert_stream(landing(spark, str(tmp_path / "in"), files_a_batch=1), rows, c, "source", str(tmp_path / "cp"), compact_every=3).awaitTermination()
    for n in range(3):
        (tmp_path / f"in/{n}.txt").write_text(f"text {n}")
    run()
    assert c.count() == 3 and calls.value == 3 and len(c._version()[2]) == 1  # compacted
    # stopped after the write, before the commit: the last batch comes again
    os.remove(tmp_path / "cp/commits/2")
    for x in glob.glob(f"{tmp_path}/cp/commits/.2.crc"):
        os.remove(x)
    number = c._version()[0]
    run()
    assert c.count() == 3 and calls.value == 3 and c._version()[0] == number
    # stopped before the write: it is written
    (tmp_path / "in/9.txt").write_text("late")
    failing = upsert_stream(landing(spark, str(tmp_path / "in")), lambda f: f.select(F.raise_error(F.lit("stop")).alias("id"), F.col("path").alias("source")), c, "source", str(tmp_path / "cp"))
    with pytest.raises(Exception, match="stop"):
        failing.awaitTermination()
    assert c.count() == 3
    run()
    assert c.count() == 4


# replies


def counting(spark, change=False):
    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        if "boom" in prompt:
            raise RuntimeError("no answer")
        import uuid

        return REPLY.format(n=uuid.uuid4().hex if change else prompt.split()[-1], k="x")

    return model, calls


def documents(spark, n=5):
    return spark.createDataFrame([(f"f{i}", f"case {i}") for i in range(n)], "source string, text string")


def test_a_case_is_asked_once(spark, tmp_path):
    model, calls = counting(spark)
    c = Collection(spark, str(tmp_path), CASE_CHUNK)
    docs = documents(spark)
    for turn, ingest in ((1, pipelines.ingest_cases), (2, api.ingest_firac)):
        done = ingest(c, pipelines.extracted(docs, model, "{document_text}"), EMBED)
        assert [r.status for r in done.collect()] == ["ingested"] * 5 and done.count() == 5
        assert calls.value == 5 * turn and c.count() == 10


def test_a_model_that_changes_its_mind(spark, tmp_path):
    model, calls = counting(spark, change=True)
    c = Collection(spark, str(tmp_path), CASE_CHUNK)
    for turn in (1, 2):
        pipelines.ingest_cases(c, pipelines.extracted(documents(spark, 3), model, "{document_text}"), EMBED)
        names = {r.case_identifier for r in c.read().collect()}
        facts = [r.text for r in c.read().where("firac_component = 'facts'").collect()]
        # what is stored under a name is the reply that gave the name
        assert len(names) == 3 * turn and sorted(facts) == sorted(f"facts of {n} x" for n in names)


def test_replies_are_kept(spark, tmp_path):
    model, calls = counting(spark)
    replies = Replies(spark, str(tmp_path / "r"))
    docs = documents(spark, 4).unionByName(spark.createDataFrame([("f9", "case 1"), ("f8", "case boom"), ("f7", None)], "source string, text string"))
    ask = lambda: replies.answered(docs, F.concat(F.lit("read "), F.col("text")), model, wave=2)
    got = {r.source: r.reply for r in ask().collect()}
    assert calls.value == 5  # five different prompts
    assert got["f9"].answer == got["f1"].answer and "facts of 1" in got["f1"].answer
    assert got["f8"].answer is None and "no answer" in got["f8"].error and got["f7"].answer is None and got["f7"].error is None
    got = {r.source: r.reply for r in ask().collect()}
    assert calls.value == 6 and got["f8"].error and got["f0"].answer  # only the failure again
    assert replies.stored().count() == 4


def test_digest_with_replies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "AB":
        (tmp_path / f"in/{n}.txt").write_text(f"case {n}")
    model, calls = counting(spark)
    replies, c = Replies(spark, str(tmp_path / "r")), Collection(spark, str(tmp_path / "db"), CASE_CHUNK)

    def failing(texts):
        raise RuntimeError("no vectors")

    with pytest.raises(Exception, match="no vectors"):
        api.digest(c, spark, str(tmp_path / "in"), model, "{document_text}", failing, replies=replies)
    assert calls.value == 2 and c.count() == 0
    _, totals = api.digest(c, spark, str(tmp_path / "in"), model, "{document_text}", EMBED, replies=replies)
    assert totals.first().ingested == 2 and calls.value == 2 and c.count() == 4
