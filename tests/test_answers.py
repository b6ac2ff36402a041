"""Summaries, envelopes, probes, displays."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import parse, vector
from scriptorium.operators import audit
from scriptorium.plans import api, pipelines, providers
from scriptorium.schemas import CASE_CHUNK, CHUNK
from scriptorium.sources.store import Collection

EMBED = providers.hashed(16)
KIND = json.dumps({"intents": ["i"], "target_components": ["FACTS"], "legal_domains": ["land law"], "vector_query": "facts of A", "reasoning_summary": ""})


@pytest.fixture
def cases(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "db"), CASE_CHUNK)
    rows = spark.createDataFrame([(f"{n}-{p}", f"{p} of {n}", n, "land law", p, "Judge J") for n in "AB" for p in ("facts", "rules")], "id string, text string, case_identifier string, legal_domain string, firac_component string, judge string")
    c.append(providers.with_embeddings(rows, EMBED, "hashed"))
    return c


def test_summaries_by_a_model(cases):
    asked = []

    def model(prompt):
        if prompt.startswith("summarise"):
            if "Case: B" in prompt or "B (score" in prompt:
                raise RuntimeError("no")
            return f" summary [{prompt}] "
        asked.append(prompt)
        return KIND

    rows = {r.case_name: r.ai_summary for r in api.qretrieve(cases, "what of A", model, EMBED, summary_prompt="summarise {query}|{case}|{components}").collect()}
    assert rows["A"].startswith("summary [summarise facts of A|A (score") and "judge: Judge J" in rows["A"] and "[facts]\nfacts of A" in rows["A"]
    assert "FACTS: facts of B" in rows["B"]  # the fallback
    assert asked == ["what of A"]


def test_envelope(cases):
    r = api.qanswer(cases, "what of A", lambda p: KIND, EMBED).first()
    assert r.success and r.error is None and r.classification.vector_query == "facts of A"
    assert [x["rank"] for x in r.retrieval] == [1, 2] and r.retrieval[0].case_name == "A"
    bad = api.qanswer(cases, " ", lambda p: KIND, EMBED).first()
    assert not bad.success and bad.retrieval == [] and bad.error

    def failing(texts):
        raise RuntimeError("no vectors")

    bad = api.qanswer(cases, "what of A", lambda p: KIND, failing).first()
    assert not bad.success and "no vectors" in bad.error and bad.classification.vector_query == "facts of A"


def test_probe_uses_the_collections_embedder(spark, tmp_path):
    made = {"embedder": "hashed-16", "dim": 16}
    c = Collection(spark, str(tmp_path / "a"), CHUNK, properties=made)
    c.append(providers.with_embeddings(spark.createDataFrame([("a", "rent and land"), ("b", "bread and flour")], "id string, text string"), EMBED, "hashed-16"))
    again = Collection(spark, str(tmp_path / "a"))
    assert again.properties == made
    with pytest.raises(LookupError, match="registered"):
        pipelines.probe(again, "land")
    providers.register("hashed-16", EMBED)
    assert [r.id for r in pipelines.probe(again, "land rent", 1).collect()] == ["a"]
    providers.register("hashed-16", providers.hashed(8))
    with pytest.raises(ValueError, match="8"):
        pipelines.probe(again, "land")
    with pytest.raises(LookupError, match="without an embedder"):
        pipelines.probe(Collection(spark, str(tmp_path / "b"), CHUNK), "land")
    providers.REGISTRY.clear()


def test_sequence_in_stored_order(spark, tmp_path):
    rows = [("a", i, 3) for i in (1, 2, 3)] + [("b", i, 3) for i in (1, 3, 2)] + [("c", i, 4) for i in (1, 2)]
    spark.createDataFrame(rows, "art string, i int, n int").coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = audit.in_stored_order(spark.read.parquet(str(tmp_path / "t")))
    ok = lambda order: {r.art: (r.n, r.indices_ok, r.total_ok) for r in audit.sequences(stored, "art", "i", "n", order).collect()}
    assert ok("stored_") == {"a": (3, True, True), "b": (3, False, True), "c": (2, True, False)}
    assert ok(None) == {"a": (3, True, True), "b": (3, True, True), "c": (2, True, False)}


def test_totals_and_displays(spark):
    r = audit.extraction_totals(spark.createDataFrame([(1,), (3,), (2,)], "num_chunks int")).first()
    assert (r.articles, r.chunks, r.multi_chunk_articles) == (3, 6, 2)
    df = spark.createDataFrame([("SECTION 1: FACTS\nf\nSECTION 3: RULES\n \nSECTION 4: APPLICATION\na",)], "t string")
    found, missing = parse.found_sections(F.col("s"))
    r = df.select(parse.sections(F.col("t")).alias("s")).select(found.alias("f"), missing.alias("m"), audit.first_of(missing, 2).alias("d"), audit.first_of(found, 2).alias("e"), vector.shown_similarity(F.lit(1.5)).alias("s")).first()
    assert r.f == ["facts", "application"] and r.m == ["metadata", "issues", "rules", "conclusion"]
    assert (r.d, r.e, r.s) == ("metadata, issues and 2 more", "facts, application", -0.5)
