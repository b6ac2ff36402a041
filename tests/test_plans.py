import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.operators import articles, audit, ranking
from scriptorium.plans import api, pipelines, providers
from scriptorium.schemas import ARTICLE_CHUNK, CASE_CHUNK, CHUNK
from scriptorium.sources import files
from scriptorium.sources.store import Collection
from scriptorium.streaming.ingest import landing, upsert_stream

EMBED = providers.hashed(16)
REPLY = "SECTION 0: METADATA\nFILE NAME: {n}\nLEGAL DOMAIN: criminal law\nSECTION 1: FACTS\nfacts of {n}\nSECTION 2: ISSUES\nissues\nSECTION 3: RULES\nrules\nSECTION 4: APPLICATION\napplication\nSECTION 5: CONCLUSION\n"


def test_store_round_trip(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), CHUNK)
    rows = spark.createDataFrame([("a", "x", "s1", "h1"), ("b", "y", "s2", "h2")], "id string, text string, source string, file_hash string")
    c.append(rows)
    assert c.count() == 2 and c.has("a") and not c.has("z")
    assert c.insert_absent(rows) == (0, 2)
    state = c.replace_changed(spark.createDataFrame([("n", "new", "s1", "h9"), ("b", "other", "s2", "h2")], "id string, text string, source string, file_hash string"))
    assert {r.source: r.status for r in state.collect()} == {"s1": "ingested", "s2": "skipped"}
    assert {r.id: r.text for r in c.read("id", "text").collect()} == {"n": "new", "b": "y"}
    assert c.delete(F.col("source") == "s1") == 1 and c.delete(F.col("source") == "none") == 0
    assert {r.source: r.n for r in c.truncate("source").collect()} == {"s2": 1} and c.count() == 0
    with pytest.raises(FileNotFoundError):
        Collection(spark, str(tmp_path / "none"), create=False)


def test_store_keeps_what_a_stopped_writer_left(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), CHUNK)
    rows = spark.createDataFrame([(str(i), f"t{i}", f"s{i % 3}", "h") for i in range(9)], "id string, text string, source string, file_hash string")
    for s in ("s0", "s1", "s2"):
        c.append(rows.where(F.col("source") == s).coalesce(1))
    _, _, files = c._version()
    assert len(files) == 3
    c._written(c.read().limit(1))  # stopped before its version was published
    again = Collection(spark, str(tmp_path / "c"), CHUNK)
    assert again.count() == 9
    open_plan = again.read()
    again.replace_groups(rows.where("source = 's1'").limit(1), "source")
    assert set(files) - set(again._version()[2]) == {f for f in files if spark.read.parquet(str(tmp_path / "c" / f)).first().source == "s1"}  # others are not rewritten
    assert again.count() == 7 and open_plan.count() == 9
    number, schema, now = again._version()
    with pytest.raises(RuntimeError):  # a second writer of a version
        again._publish(number, schema, now)
    assert again.vacuum(older_than=0) > 0 and again.count() == 7
    assert again.delete_ids(spark.createDataFrame([("0",), ("3",)], "id string")) == 2 and again.count() == 5


def test_ingest_says_what_it_skipped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Some words on rent. " * 20)
    store = Collection(spark, str(tmp_path / "db"), CHUNK)
    run = lambda: {r.source.rsplit("/", 1)[1]: r.status for r in pipelines.ingest_documents(store, files.documents(spark, str(tmp_path / "in")), EMBED).collect()}
    assert run() == {"a.txt": "ingested"}
    (tmp_path / "in/b.txt").write_text("Other words on bread. " * 20)
    assert run() == {"a.txt": "skipped", "b.txt": "ingested"}
    (tmp_path / "in/a.txt").write_text("Changed words on rent. " * 20)
    assert run() == {"a.txt": "ingested", "b.txt": "skipped"}


def test_ocr_reads_a_file_once(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"s|" * 19 + b"s")
    calls = spark.sparkContext.accumulator(0)

    def ocr(content):
        calls.add(1)
        return [f"page {i}" for i in range(20)]

    got = files.pages(spark.read.format("binaryFile").load(str(tmp_path)), lambda b: b.decode().split("|"), ocr).collect()
    assert sorted(r.text for r in got) == sorted(f"page {i}" for i in range(20)) and calls.value == 1


def test_a_chunk_that_fails_is_counted(spark, tmp_path):
    schema = T.StructType([*ARTICLE_CHUNK.fields, T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("document_type", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    store = Collection(spark, str(tmp_path / "db"), schema)

    def embed(texts):
        if any("Land is held" in t for t in texts):
            raise RuntimeError("no")
        return EMBED(texts)

    r = api.digest_statute(store, spark.createDataFrame([("s.txt", STATUTE)], "file_name string, text string"), embed).first()
    assert (r.ingested, r.failed, r.articles_processed, r.overall) == (2, 1, 2, "partial_success") and store.count() == 2


def test_classification_retries(spark):
    good = '{"intents":[],"target_components":[],"legal_domains":[],"vector_query":"q","reasoning_summary":"r"}'

    def failing(status, times):
        left = [status] * times

        def model(p):
            if left:
                raise providers.Refused(left.pop())
            return good

        return model

    waits = []
    got = api.qclassify(spark, "q?", failing(429, 2), sleep=waits.append).first()
    assert got.success and got.classification.vector_query == "q" and waits == [5, 10]
    for status in (400, 401):
        waits.clear()
        got = api.qclassify(spark, "q?", failing(status, 1), sleep=waits.append).first()
        assert not got.success and str(status) in got.error and not waits
    assert not api.qclassify(spark, " ", failing(400, 0)).first().success


def test_result_file_and_display(spark, tmp_path):
    df = spark.createDataFrame([("facts", None), ("Rules", "x"), ("other", "é"), ("issues", "y")], "c string, v string")
    files.write_array(df.coalesce(1), str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*")
    assert json.loads(part.read_text()) == [{"c": a, "v": b} for a, b in (("facts", None), ("Rules", "x"), ("other", "é"), ("issues", "y"))]
    assert [r.c for r in pipelines.in_display_order(df, "c").collect()] == ["facts", "issues", "Rules", "other"]
    shares = spark.createDataFrame([(1, 3), (1, 0)], "a int, b int").select(pipelines.shown_percent(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in shares.collect()] == ["33.3%", "0.0%"]


def test_files_and_pdf(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Search\nhello  there")
    (tmp_path / "b.PDF").write_bytes(b"one|two")
    (tmp_path / "c.txt").write_text("|\n")
    (tmp_path / "d.bin").write_text("x")
    assert [r.name for r in files.listed(spark, str(tmp_path)).collect()] == ["a.txt", "b.PDF", "c.txt"]
    docs = {r.file_name: r for r in files.documents(spark, str(tmp_path), reader=lambda b: b.decode().split("|")).collect()}
    assert docs["a.txt"].text == "hello there" and docs["b.PDF"].text == "one\ntwo" and docs["c.txt"].text == "|\n"
    assert docs["a.txt"].error is None
    failed = files.documents(spark, str(tmp_path)).where("file_type = '.pdf'").first()
    assert "NotImplementedError" in failed.error


def test_ocr_only_for_short_pages(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"s|" + b"l" * 60)
    got = files.pages(spark.read.format("binaryFile").load(str(tmp_path)), lambda b: b.decode().split("|"), lambda b: ["OCR", "OCR"])
    assert [r.text for r in got.orderBy("page").collect()] == ["OCR", "l" * 60]


def test_chat_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/law.txt").write_text("The tenant pays rent to the landlord. " * 40)
    (tmp_path / "in/food.txt").write_text("Bread is baked from flour and water. " * 40)
    store = Collection(spark, str(tmp_path / "db"), CHUNK)
    with pytest.raises(LookupError):
        api.chat(store, "rent?", EMBED, providers.echo)
    done = pipelines.ingest_documents(store, files.documents(spark, str(tmp_path / "in")), EMBED)
    assert [r.status for r in done.collect()] == ["ingested"] * 2
    before = store.count()
    pipelines.ingest_documents(store, files.documents(spark, str(tmp_path / "in")), EMBED)
    assert store.count() == before
    got = api.chat(store, "who pays rent to the landlord", EMBED, providers.echo).first()
    assert got.error is None and "law.txt" in got.answer.split("Sources:")[1].split("\n")[1]
    with pytest.raises(ValueError):
        api.chat(store, " ", EMBED, providers.echo)


def test_cases_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("A", "B"):
        (tmp_path / f"in/{n}.txt").write_text(f"case text {n}")
    (tmp_path / "in/bad.txt").write_text("case text boom")

    def model(prompt):
        if "boom" in prompt:
            raise RuntimeError("no answer")
        return REPLY.format(n=prompt.split()[-1])

    store = Collection(spark, str(tmp_path / "db"), CASE_CHUNK)
    outcomes, totals = api.digest(store, spark, str(tmp_path / "in"), model, "read: {document_text}", EMBED)
    assert totals.first().overall == "partial_success" and totals.first().failed == 1
    assert store.count() == 8  # the conclusions are empty
    missing = {r.case_identifier: r.missing for r in audit.missing_components(store.read(), "case_identifier", "firac_component").collect()}
    assert missing == {"A": ["conclusion"], "B": ["conclusion"]}
    reply = json.dumps({"intents": [], "target_components": ["FACTS"], "legal_domains": ["criminal law"], "vector_query": "facts of A", "reasoning_summary": ""})
    rows = api.qretrieve(store, "what of A", lambda p: reply, EMBED).collect()
    assert rows[0].case_name == "A" and rows[0].matched_components == ["facts"] and rows[0].best_chunk == "facts of A"
    assert "FACTS: facts of A" in rows[0].ai_summary
    none = reply.replace("FACTS", "NOTHING")
    assert api.qretrieve(store, "what", lambda p: none, EMBED).first().evidence_count == 0


def test_classify_asks_again(spark):
    replies = iter(["not json", '{"intents":[],"target_components":[],"legal_domains":[],"vector_query":"q","reasoning_summary":"r"}'])
    assert pipelines.classify(spark, "q?", lambda p: next(replies)).first().vector_query == "q"
    with pytest.raises(ValueError):
        pipelines.classify(spark, "q?", lambda p: "{}", attempts=2)


def test_retry_waits_longer_each_time():
    waits, calls = [], iter([1, 1, 0])

    def model(p):
        if next(calls):
            raise RuntimeError
        return "ok"

    assert providers.retried(model, 3, 5, waits.append)("p") == "ok" and waits == [5, 10]


STATUTE = "CHAPTER ONE\n\nThe People\nPART 1 – Rights\nFreedom\n1. Everyone is free.\n(2) Also here.\nLand\n2. Land is held.\nCHAPTER TWO\n3. No title above.\nother\n3. Same number goes on.\n"


def test_articles(spark):
    df = spark.createDataFrame([("s.txt", STATUTE)], "file_name string, text string")
    rows = pipelines.statute_chunks(df).orderBy("article_number").collect()
    assert [r.article_number for r in rows] == ["1", "2", "3"]
    a, b, c = rows
    assert (a.article_header, a.chapter, a.chapter_title, a.part, a.part_title) == ("Freedom", "ONE", "The People", "1", "Rights")
    assert a.chunk_text == "1. Everyone is free.\n(2) Also here.\nLand"
    assert (c.chapter, c.chapter_title, c.part) == ("TWO", None, None) and "Same number" in c.chunk_text
    assert a.is_complete_article and a.chunk_index == 1


def test_statute_ingest_status_reset(spark, tmp_path):
    schema = ARTICLE_CHUNK.add("id", "string").add("text", "string").add("document_type", "string").add("embedding", T.ArrayType(T.FloatType()))
    store = Collection(spark, str(tmp_path / "db"), schema)
    df = spark.createDataFrame([("s.txt", STATUTE)], "file_name string, text string")
    assert api.digest_statute(store, df, EMBED).first().ingested == 3
    again = api.digest_statute(store, df, EMBED).first()
    assert (again.ingested, again.skipped, again.overall) == (0, 3, "success")
    assert api.statute_status(store).first().articles == 3
    assert api.statute_reset(store) == 3 and store.count() == 0


def test_chunk_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s.txt", STATUTE)], "file_name string, text string")
    flat = pipelines.statute_chunks(df).select(*[f.name for f in ARTICLE_CHUNK if f.name in ("article_number", "chunk_index", "chunk_text", "source_document")])
    files.write_chunk_file(flat, str(tmp_path / "f"))
    back = files.chunk_file(spark, str(tmp_path / "f"), flat.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))


def test_model_articles(spark):
    df = spark.createDataFrame([("a", "good"), ("b", "bad")], "source string, text string")
    got = pipelines.model_articles(df, lambda p: '[{"article_no": 1}]' if "good" in p else "oops", "{document_text}")
    assert {r.source: (r.article_no, r.error) for r in got.collect()} == {"a": (1, None), "b": (None, "not JSON")}


def test_filter_stays_above_limit(spark):
    df = spark.range(200).select(F.col("id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"), F.when(F.col("id") < 100, "a").otherwise("b").alias("c"))
    near = ranking.nearest(df, F.array(F.lit(0.0), F.lit(1.0)), 50)
    assert ranking.keep_components(near, ["b"], "c").count() == 50  # none of the 50 is b: all stay
    assert ranking.keep_components(near, ["a"], "c").count() == 50


def test_numeric_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("x",)], "n string")
    assert [r.n for r in df.orderBy(*articles.numeric_first("n")).collect()] == ["9", "10", "x"]


def test_stream_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    store = Collection(spark, str(tmp_path / "db"), CHUNK)
    rows = lambda f: f.select(F.col("path").alias("id"), F.col("path").alias("source"), F.col("content").cast("string").alias("text"))
    for _ in range(2):
        upsert_stream(landing(spark, str(tmp_path / "in")), rows, store, "source", str(tmp_path / "cp")).awaitTermination()
        assert store.count() == 1


def test_classification_given(spark, tmp_path):
    given = {"vector_query": "q", "legal_domains": ["a"]}
    (tmp_path / "c.json").write_text(json.dumps(given))
    for form in (given, json.dumps(given), str(tmp_path / "c.json")):
        assert pipelines.classification_given(spark, form).first().vector_query == "q"
    with pytest.raises(ValueError):
        pipelines.classification_given(spark, "nonsense")


def test_token_chunks_with_language(spark):
    df = spark.createDataFrame([("f.txt", "h", "A sentence of six words here. " * 300)], "file_name string, file_hash string, text string")
    rows = pipelines.token_chunked(df, EMBED, "hashed", detect=lambda t: "en").collect()
    assert len(rows) > 1 and all(500 <= r.token_count <= 800 and r.language == "en" and r.embedding_dim == 16 for r in rows)
    assert [r.chunk_number for r in rows] == list(range(1, len(rows) + 1))
