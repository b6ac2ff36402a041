"""Whole plans: ingest, retrieval, answers. Each is one lazy DataFrame up to its result."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import chunk, parse, vector
from scriptorium.functions import text as tx
from scriptorium.operators import articles, audit, dedupe, keyword, ranking
from scriptorium.plans import providers
from scriptorium.plans.replies import Replies
from scriptorium.schemas import CASE_FIELDS, COMPONENTS
from scriptorium.shared import cut
from scriptorium.sources.store import Collection, changed

INITIAL, FINAL = 10, 3


def chunked(docs: DataFrame, embed: providers.Embedder, model: str) -> DataFrame:
    """Loaded documents to embedded chunks, one row each."""
    cut = docs.where("error is null").withColumn("pieces", chunk.recursive(F.col("text"))).withColumn("total_chunks", F.size("pieces"))
    rows = cut.select(*[c for c in docs.columns if c not in ("text", "error")], "total_chunks", F.posexplode("pieces").alias("chunk_index", "piece"))
    rows = rows.withColumn("text", F.col("piece.text")).withColumn("start_index", F.col("piece.start")).drop("piece")
    # two files of one stem would share ids, so the path's hash is part of them
    rows = rows.withColumn("id", F.concat(tx.stem(F.col("source")), F.lit("_"), F.substring(F.sha2(F.col("source"), 256), 1, 8), F.lit("_chunk_"), F.col("chunk_index").cast("string")))
    rows = rows.withColumn("chunk_id", F.col("chunk_index")).withColumn("chunk_size", F.length("text")).withColumn("ingested_at", F.current_timestamp())
    return providers.with_embeddings(rows, embed, model)


def ingest_documents(store: Collection, docs: DataFrame, embed: providers.Embedder, model: str = "hashed") -> DataFrame:
    """Upsert documents whose content hash is not stored; (source, status, error): ingested, skipped or failed."""
    known = store.read("source", "file_hash")  # before the change
    store.replace_changed(chunked(docs, embed, model), "source", "file_hash")
    state = changed(docs.select("source", "file_hash").distinct(), known, "source", "file_hash")
    return docs.select("source", "error").join(state, "source").select("source", F.when(F.col("error").isNull(), F.col("status")).otherwise("failed").alias("status"), "error")


def token_chunked(docs: DataFrame, embed: providers.Embedder, model: str, *, counter: Callable[[str], int] = chunk.count_words, detect: providers.Detector = providers.unknown, title: str = "file_name", legacy: bool = False) -> DataFrame:
    """Loaded documents to sentence chunks of bounded token counts, with vectors and language."""
    cut = docs.withColumn("c", F.explode(chunk.token_chunks(tx.sentences(F.col("text"), legacy), counter)))
    rows = cut.select(F.col(title).alias("title"), F.col("file_hash").alias("file_id"), "c.*")
    rows = rows.withColumn("id", F.concat_ws("_", "file_id", F.col("chunk_number").cast("string"))).withColumn("page_no", F.lit(None).cast("int")).withColumn("heading", F.col("title"))
    rows = rows.withColumn("language", providers.language(F.col("text"), detect)).withColumn("ingest_time", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    return providers.with_embeddings(rows, embed, model)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, least, most and average tokens."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.avg("token_count").alias("avg_tokens"))


def keyword_hits(docs: DataFrame, queries: DataFrame, *, id: str = "source", text: str = "text", k: int = FINAL) -> DataFrame:
    """Paragraph chunks ranked by plain TF-IDF, ``k`` a query, which are sent to the chunks; no vectors needed."""
    cut = docs.select(id, F.posexplode(chunk.paragraphs(F.col(text))).alias("chunk_index", "chunk_text"))
    cut = cut.withColumn("chunk_id", F.concat_ws("#", F.col(id).cast("string"), F.format_string("%08d", F.col("chunk_index"))))
    found = keyword.scores(cut.select("chunk_id", "chunk_text"), queries, id="chunk_id", text="chunk_text", query="query_id", query_text="query", alone=keyword.one_each(docs, id))
    best = keyword.top(found.withColumn("keyword", F.round("keyword", 9)), "query_id", "keyword", k, "chunk_id")
    return cut.join(F.broadcast(best), "chunk_id").select("query_id", "rank", "chunk_id", F.col("keyword").alias("score"), "chunk_text")


# cases


def extracted(docs: DataFrame, model: providers.Model, prompt: str, *, id: str = "source", text: str = "text", replies: Replies | None = None) -> DataFrame:
    """Documents to their six sections by one call of a model; failures have an ``error`` and no sections.

    With ``replies`` a document that was answered before is not sent again.
    """
    filled = F.replace(F.lit(prompt), F.lit("{document_text}"), F.coalesce(F.col(text), F.lit("")))
    asked = replies.answered(docs, filled, model) if replies else docs.withColumn("reply", providers.answered(filled, model))
    s = asked.withColumn("s", parse.sections(F.coalesce(F.col("reply.answer"), F.lit(""))))
    return s.select(F.col(id).alias("source_file_path"), F.col(text).alias("document"), *[F.col(f"s.{n}").alias(n) for n in parse.SECTIONS], F.col("reply.answer").alias("full_response"), F.col("reply.error").alias("error"))


def case_chunks(cases: DataFrame) -> DataFrame:
    """Extraction results to one row a non-empty component, with the case's fields.

    A case without a name goes by its document's hash, so that nameless cases
    do not replace each other. Rows with an error give none.
    """
    df = cases.where(F.col("error").isNull()).withColumn("f", parse.case_fields(F.col("metadata"))).withColumn("document_hash", tx.text_hash(F.coalesce("document", F.lit(""))))
    df = df.withColumn("case_identifier", F.when(F.col("f.file_name") != "", F.col("f.file_name")).otherwise(F.concat(F.lit("case_"), F.substring("document_hash", 1, 16))))
    parts = F.array(*[F.struct(F.lit(c).alias("component"), tx.strip(F.coalesce(F.col(c), F.lit(""))).alias("body")) for c in COMPONENTS])
    rows = df.withColumn("part", F.explode(F.filter(parts, lambda p: p["body"] != "")))
    out = rows.select(F.col("part.body").alias("text"), *[F.col(f"f.{c}").alias(c) for c in CASE_FIELDS], F.col("part.component").alias("firac_component"), "case_identifier", "document_hash", "source_file_path", F.length("part.body").alias("content_length"), F.current_timestamp().alias("ingested_at"))
    return out.withColumn("id", tx.safe_id(F.col("case_identifier"), F.col("firac_component"), F.col("text")))


def ingest_cases(store: Collection, cases: DataFrame, embed: providers.Embedder, model: str = "hashed") -> DataFrame:
    """Replace the cases' chunks; (source_file_path, status, error, empty_components, fields).

    ``cases`` is computed once, whatever it takes to: what is stored and what is
    reported are of the same replies.
    """
    cases = cut(cases)
    rows = providers.with_embeddings(case_chunks(cases), embed, model)
    store.replace_groups(rows, "case_identifier")
    empty = F.array_compact(F.array(*[F.when(tx.strip(F.coalesce(F.col(c), F.lit(""))) == "", c) for c in COMPONENTS]))
    n = sum((F.when(F.col(f"f.{f}") != "", 1).otherwise(0) for f in CASE_FIELDS), F.lit(0))
    bad = F.coalesce("error", F.when(F.size(empty) == len(COMPONENTS), F.lit("every component is empty")))
    return cases.withColumn("f", parse.case_fields(F.col("metadata"))).select("source_file_path", F.when(bad.isNull(), "ingested").otherwise("failed").alias("status"), bad.alias("error"), empty.alias("empty_components"), n.alias("fields"), audit.field_warning(n).alias("warning"))


# retrieval


def retrieve_cases(chunks: DataFrame, query: Column, targets: list[str], wanted: Column, *, parent: str = "case_identifier", component: str = "firac_component", domain: str = "legal_domain", fields: tuple[str, ...] = CASE_FIELDS, id: str = "id", candidates: int = ranking.CANDIDATES, k: int = ranking.PARENTS) -> tuple[DataFrame, DataFrame]:
    """(best parents with rank, their best chunks): search, filter, score, group, pick."""
    found = ranking.nearest(chunks, query, candidates, id=id)
    kept = ranking.scored(ranking.keep_components(found, targets, component), wanted, domain=domain, component=component)
    top = ranking.parents(kept, parent=parent, id=id, keep=list(fields), k=k)
    top = ranking.ranked(top, F.desc("best_score"), F.asc("first_seen")).withColumn("warning", F.when(F.col("rank") == 1, ranking.low_confidence(F.col("best_score"))))
    hits = kept.where("component_match").join(F.broadcast(top.select(parent, "rank")), parent)  # k rows
    return top, ranking.best_chunks(hits, parent=parent, component=component, id=id)


def summary_fallback(header: Column, chunks: Column, most: int = 3, n: int = 200) -> Column:
    """A summary without a model: a header and the beginnings of the first chunks (struct component, text)."""
    lines = F.transform(F.slice(chunks, 1, most), lambda c: F.concat(F.lit("- "), F.upper(c["component"]), F.lit(": "), tx.preview(c["text"], n)))
    return F.concat_ws("\n", header, F.array_join(lines, "\n"))


def model_summary(model: providers.Model, query: str, prompt: str, fields: tuple[str, ...] = CASE_FIELDS) -> Callable[[Column, Column], Column]:
    """A ``summary`` for ``result_rows`` by a model, asked once a case; where the call fails, ``summary_fallback``.

    ``prompt`` may have {query}, {case} (the case's fields, one a line) and {components} (its chunks).
    """

    def summary(header: Column, chunks: Column) -> Column:
        case = F.concat_ws("\n", header, *[F.concat(F.lit(f"{f.replace('_', ' ')}: "), F.coalesce(F.col(f), F.lit(""))) for f in fields])
        parts = F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), c["component"], F.lit("]\n"), c["text"])), "\n\n")
        asked = F.lit(prompt)
        for mark, value in (("{query}", F.lit(query)), ("{case}", case), ("{components}", parts)):
            asked = F.replace(asked, F.lit(mark), value)
        return F.coalesce(tx.strip(providers.answered(asked, model)["answer"]), summary_fallback(header, chunks))

    return summary


def probe(store: Collection, question: str, k: int = 3) -> DataFrame:
    """The ``k`` chunks nearest to a question, by the collection's own embedder (its ``embedder`` and ``dim``)."""
    own = store.properties
    if not {"embedder", "dim"} <= own.keys():
        raise LookupError("the collection was created without an embedder")
    embed = providers.resolved(own["embedder"], own["dim"])
    vec = F.array(*[F.lit(float(x)) for x in embed([providers.QUERY + question])[0]])
    return ranking.nearest(store.read(), vec, k)


def result_rows(top: DataFrame, picked: DataFrame, *, parent: str = "case_identifier", component: str = "firac_component", fields: tuple[str, ...] = CASE_FIELDS, summary: Callable[[Column, Column], Column] = summary_fallback) -> DataFrame:
    """One nested row a parent, as the API returns it; scores to three places."""
    one = F.struct(F.col("score").alias("order"), F.struct(F.col(component).alias("component"), "text", F.round("score", 3).alias("score"), F.round("base_similarity", 3).alias("base_similarity"), F.round("domain_boost", 3).alias("domain_boost"), "match_reasons", F.col("id").alias("chunk_id")).alias("c"))
    evidence = picked.groupBy(parent).agg(F.transform(F.sort_array(F.collect_list(one), asc=False), lambda x: x["c"]).alias("chunks"))
    none = F.array().cast(evidence.schema["chunks"].dataType)
    df = top.join(evidence, parent, "left").withColumn("chunks", F.coalesce("chunks", none))
    head = F.format_string("%s (score %.3f)", F.col(parent), F.col("best_score"))
    return df.select(
        "rank",
        F.col(parent).alias("case_name"),
        F.round("best_score", 3).alias("score"),
        summary(head, F.col("chunks")).alias("ai_summary"),
        F.struct(*fields).alias("metadata"),
        F.sort_array(F.array_distinct(F.transform("chunks", lambda c: c["component"]))).alias("matched_components"),
        F.coalesce(F.try_element_at("chunks", F.lit(1))["text"], F.lit("")).alias("best_chunk"),
        "chunks",
        F.size("chunks").alias("evidence_count"),
        "warning",
    ).orderBy("rank")


def retrieval_stats(found: DataFrame, kept: DataFrame, top: DataFrame, parent: str = "case_identifier") -> DataFrame:
    """One row: rows after each stage of a retrieval."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    seen = kept.agg(F.count(F.lit(1)).alias("after_component_filter"), F.count_distinct(parent).alias("unique_parents_found"))
    return n(found, "total_candidates").crossJoin(seen).crossJoin(n(top, "returned_parents"))  # one row each


def classification_given(spark: SparkSession, given: dict | str) -> DataFrame:
    """A classification as one row, from a dict, a JSON text, or the path of a .json file."""
    if isinstance(given, dict):
        reply = spark.createDataFrame([(json.dumps(given),)], "reply string")
    elif isinstance(given, str) and given.strip().endswith(".json"):
        reply = spark.read.text(given.strip(), wholetext=True).withColumnRenamed("value", "reply")
    elif isinstance(given, str) and given.strip().startswith("{"):
        reply = spark.createDataFrame([(given,)], "reply string")
    else:
        raise ValueError("give a dict, a JSON object or the path of a .json file")
    return reply.select(parse.classification(F.col("reply")).alias("c")).select("c.*")


def classify(spark: SparkSession, question: str, model: providers.Model, prompt: str = "{question}", attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One row: the normalised classification of a question.

    Incomplete replies are asked for again; so is a call that failed, after a
    wait, unless the provider refused it for good (``providers.retried``).
    """
    model = providers.retried(model, attempts, sleep=sleep)
    if not question or not question.strip():
        raise ValueError("a question is needed")
    asked = prompt.replace("{question}", question)
    for attempt in range(attempts):
        reply = spark.createDataFrame([(question, model(asked))], "query string, reply string")
        out = reply.select("query", parse.classification(F.col("reply")).alias("c"), parse.missing_keys(F.col("reply")).alias("missing"), "reply")
        missing = out.select("missing").first()[0]
        if not missing:
            return out.select("query", "c.*")
        asked = f"{asked}\nThe last reply lacked: {', '.join(missing)}. Reply again as JSON."
    raise ValueError(f"no complete classification in {attempts} attempts")


def search_chunks(chunks: DataFrame, queries: DataFrame, embed: providers.Embedder, *, rerank: providers.Reranker = providers.shared_words, expand: providers.Model | None = None, initial: int = INITIAL, final: int = FINAL, share: float = 0.7, stop: list[str] | None = None, limit: int | None = 1000) -> DataFrame:
    """The best chunks of every query (query_id, query): blend of vector and keyword scores, rerank, near-duplicates out.

    ``expand`` may rewrite a query; an empty, shorter or failed rewrite is not
    used. Only ``initial`` chunks a query reach the reranker.
    """
    asked = queries.withColumn("asked", F.col("query"))
    if expand:
        more = queries.withColumn("reply", providers.answered(F.col("query"), expand))
        longer = F.length(tx.strip(F.coalesce("reply.answer", F.lit("")))) >= F.length("query")
        asked = more.withColumn("asked", F.when(longer, tx.strip(F.col("reply.answer"))).otherwise(F.col("query"))).drop("reply")
    asked = asked.withColumn("vector", providers.embedded(F.col("asked"), embed, providers.QUERY))
    near = chunks.select("id", "text", "source", "start_index", "embedding").crossJoin(F.broadcast(asked.select("query_id", "asked", "vector")))  # a stated query set
    near = near.withColumn("semantic", vector.cosine(F.col("embedding"), F.col("vector"))).drop("embedding", "vector")
    words = keyword.scores(chunks.select("id", "text"), asked.select("query_id", "asked"), id="id", text="text", query="query_id", query_text="asked", stop=stop or keyword.STOP_WORDS, limit=limit)
    both = near.join(words, ["query_id", "id"], "left").withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    first = keyword.top(keyword.hybrid(both, query="query_id", share=share), "query_id", "hybrid", initial, "id")
    scored = first.withColumn("rerank", providers.reranked(F.col("asked"), F.col("text"), rerank))
    last = keyword.top(scored.drop("rank"), "query_id", "rerank", final, "id")
    kept = dedupe.fold(last, group="query_id", rank="rank", id="id", text="text")
    return last.join(kept.select("query_id", "id"), ["query_id", "id"], "left_semi")


def context(hits: DataFrame, *, group: str = "query_id") -> DataFrame:
    """(group, context, citations): the text that an answer is made from, and its footer."""
    block = F.format_string("[Chunk %d - Relevance Score: %.4f]\n%s", F.col("rank"), F.col("rerank"), F.col("text"))
    cite = F.format_string("[%d] %s (start %s)", F.col("rank"), F.coalesce("source", F.lit("Unknown")), F.coalesce(F.col("start_index").cast("string"), F.lit("Unknown")))
    rows = hits.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b"), cite.alias("c")))).alias("x"))
    return rows.select(group, F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("context"), F.array_join(F.transform("x", lambda r: r["c"]), "\n").alias("citations"))


def answer(chunks: DataFrame, queries: DataFrame, embed: providers.Embedder, model: providers.Model, **options) -> DataFrame:
    """(query_id, query, answer, error): an answer with its citations."""
    ctx = context(search_chunks(chunks, queries, embed, **options))
    asked = queries.join(ctx, "query_id", "left").withColumn("prompt", F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("query")))
    out = asked.withColumn("reply", providers.answered(F.col("prompt"), model))
    return out.select("query_id", "query", F.when(F.col("reply.answer").isNotNull(), F.concat(F.col("reply.answer"), F.lit("\n\nSources:\n"), F.coalesce("citations", F.lit("none")))).alias("answer"), F.col("reply.error").alias("error"))


# statutes


def shown_percent(part: Column, whole: Column) -> Column:
    """A share as it is displayed: one place and a % sign; 0.0% of nothing."""
    return F.format_string("%.1f%%", F.when(whole > 0, part * 100.0 / whole).otherwise(0.0))


def in_display_order(chunks: DataFrame, component: str = "firac_component", expected: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Chunks by component, in the order of the sections; unknown components last."""
    place = F.array_position(F.array(*map(F.lit, expected)), F.lower(F.coalesce(F.col(component), F.lit(""))))
    return chunks.orderBy(F.when(place == 0, len(expected) + 1).otherwise(place), component)


def statute_chunks(docs: DataFrame, *, source: str = "file_name", text: str = "text") -> DataFrame:
    """Loaded statutes to flat chunks, with content ids."""
    cut = articles.segmented(docs.select(F.col(source).alias("source_document"), F.col(text).alias("body")), id="source_document", text="body")
    flat = articles.flattened(articles.with_chunks(cut, "source_document"))
    return flat.withColumn("id", tx.chunk_id(tx.stem(F.col("source_document")), F.col("article_number"), F.col("chunk_index"), F.col("chunk_text"))).withColumn("document_type", F.lit("constitution"))


def model_articles(docs: DataFrame, model: providers.Model, prompt: str, *, id: str = "source", text: str = "text") -> DataFrame:
    """Articles that a model extracts, a context at a time; replies that are no JSON are left out, with an error."""
    parts = docs.select(id, F.posexplode(chunk.chapters(F.col(text))).alias("part", "body"))
    asked = parts.withColumn("reply", providers.answered(F.replace(F.lit(prompt), F.lit("{document_text}"), F.col("body")), model))
    rows = asked.withColumn("list", parse.extracted_articles(F.col("reply.answer")))
    return rows.select(id, "part", F.coalesce(F.col("reply.error"), F.when(F.col("list").isNull(), F.lit("not JSON"))).alias("error"), F.explode_outer("list").alias("article")).select(id, "part", "error", "article.*")


def chapter_counts(rows: DataFrame, chapter: str = "chapter_no") -> DataFrame:
    """(chapter, articles), in order."""
    return rows.groupBy(chapter).agg(F.count(F.lit(1)).alias("articles")).orderBy(chapter)
