"""What the service's routes do, as functions over collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as tx
from scriptorium.operators import articles, audit
from scriptorium.plans import pipelines, providers
from scriptorium.plans.replies import Replies
from scriptorium.sources import files
from scriptorium.sources.store import Collection


def chat(store: Collection, question: str, embed: providers.Embedder, model: providers.Model, **options) -> DataFrame:
    """POST /chat. One row: answer or error."""
    if not question or not question.strip():
        raise ValueError("a query is needed")
    if store.read().isEmpty():
        raise LookupError("the collection is empty")
    asked = store.spark.createDataFrame([(1, question)], "query_id int, query string")
    return pipelines.answer(store.read(), asked, embed, model, **options)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """GET /files."""
    return files.listed(spark, path).select("name")


def digest(store: Collection, spark: SparkSession, path: str, model: providers.Model, prompt: str, embed: providers.Embedder, replies: Replies | None = None, **reading) -> tuple[DataFrame, DataFrame]:
    """POST /digest: load, extract, ingest cases. (per-file outcomes, totals); a bad file fails alone.

    One model call a document; with ``replies`` none for those that were answered before.
    """
    docs = files.documents(spark, path, clean=tx.clean_ocr, **reading)
    loaded = docs.where("error is null")
    cases = pipelines.extracted(loaded, model, prompt, replies=replies)
    done = pipelines.ingest_cases(store, cases, embed).select("source_file_path", "status", "error")
    lost = docs.where("error is not null").select(F.col("source").alias("source_file_path"), F.lit("failed").alias("status"), "error")
    outcomes = done.unionByName(lost)
    return outcomes, audit.ingest_stats(outcomes)


def firac(spark: SparkSession, docs: DataFrame, model: providers.Model, prompt: str) -> DataFrame:
    """POST /firac: extraction results, one {content, metadata} a section."""
    found = pipelines.extracted(docs, model, prompt)
    return found.select("source_file_path", *[F.struct(F.col(c).alias("content"), F.col("metadata").alias("metadata")).alias(c) for c in ("facts", "issues", "rules", "application", "conclusion")], "metadata", "error")


def ingest_firac(store: Collection, cases: DataFrame, embed: providers.Embedder) -> DataFrame:
    """POST /ingest-firac."""
    return pipelines.ingest_cases(store, cases, embed)


def digest_statute(store: Collection, docs: DataFrame, embed: providers.Embedder, model: str = "hashed") -> DataFrame:
    """POST /digest/constitution: insert chunks that are new; totals by status and the articles processed, in one row.

    A chunk whose embedding fails is counted as failed and left out.
    """
    rows = providers.with_embeddings(pipelines.statute_chunks(docs).withColumnRenamed("chunk_text", "text"), embed, model, lenient=True).persist()
    try:
        done, skipped = store.insert_absent(rows.where("embedding is not null"))
        failed = rows.where("embedding is null").count()
        seen = rows.where("embedding is not null").agg(F.count_distinct("article_number")).first()[0]
    finally:
        rows.unpersist()
    counts = store.spark.createDataFrame([(done, skipped, failed, seen)], "ingested long, skipped long, failed long, articles_processed long")
    return counts.withColumn("overall", audit.status(F.col("failed"), F.col("ingested"), F.col("skipped")))


def statute_status(store: Collection) -> DataFrame:
    """GET /digest/constitution/status: chunks and articles stored."""
    return store.where(document_type="constitution").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("article_number").alias("articles"))


def statute_reset(store: Collection) -> int:
    """DELETE /digest/constitution/reset: rows deleted."""
    return store.delete(F.col("document_type") == "constitution")


def _retrieved(store: Collection, c, question: str, embed: providers.Embedder, summary=pipelines.summary_fallback) -> DataFrame:
    """The best cases for one classification row."""
    words = c["vector_query"] or question
    vec = F.array(*[F.lit(float(x)) for x in embed([words])[0]])
    wanted: Column = F.array(*[F.struct(F.lit(d["domain"]).alias("domain"), F.lit(d["confidence_score"]).alias("confidence_score")) for d in c["legal_domains"]]) if c["legal_domains"] else F.array().cast("array<struct<domain:string,confidence_score:double>>")
    top, picked = pipelines.retrieve_cases(store.read(), vec, list(c["target_components"]), wanted)
    return pipelines.result_rows(top, picked, summary=summary)


def qretrieve(store: Collection, question: str, model: providers.Model, embed: providers.Embedder, prompt: str = "{question}", summary_prompt: str | None = None) -> DataFrame:
    """POST /qretrieve: classify a question, then the best cases with their evidence; summaries by the model, if there is a prompt for them."""
    c = pipelines.classify(store.spark, question, model, prompt).first()
    summary = pipelines.model_summary(model, c["vector_query"] or question, summary_prompt) if summary_prompt else pipelines.summary_fallback
    return _retrieved(store, c, question, embed, summary)


def qanswer(store: Collection, question: str, model: providers.Model, embed: providers.Embedder, prompt: str = "{question}", **options) -> DataFrame:
    """Classify, then retrieve: one row {success, query, classification, retrieval, error}; a failure is a row, too."""
    got = qclassify(store.spark, question, model, prompt, **options).first()
    head = store.spark.createDataFrame([got], T.StructType([T.StructField("success", T.BooleanType()), T.StructField("query", T.StringType()), T.StructField("classification", _classification_kind(store.spark)), T.StructField("error", T.StringType())]))
    kind = None
    if got.success:
        try:
            rows = _retrieved(store, got.classification, question, embed)
            kind = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("retrieval"))  # a few cases, by rank
            kind.first()
        except Exception as e:  # noqa: BLE001 - as in qclassify
            head = head.withColumns({"success": F.lit(False), "error": F.lit(f"{e}")})
            kind = None
    if kind is None:
        return head.select("success", "query", "classification", F.array().alias("retrieval"), "error")
    return head.crossJoin(kind).select("success", "query", "classification", "retrieval", "error")  # one row each


def _classification_kind(spark: SparkSession) -> T.StructType:
    return pipelines.classification_given(spark, {}).schema


def qclassify(spark: SparkSession, question: str, model: providers.Model, prompt: str = "{question}", **options) -> DataFrame:
    """Classify a question: one row {success, query, classification, error}; a failure is a row, too."""
    kind = _classification_kind(spark)
    try:
        got = pipelines.classify(spark, question, model, prompt, **options)
        return got.select(F.lit(True).alias("success"), "query", F.struct(*kind.names).alias("classification"), F.lit(None).cast("string").alias("error"))
    except Exception as e:  # noqa: BLE001 - providers raise anything
        none = F.lit(None).cast(kind)
        return spark.range(1).select(F.lit(False).alias("success"), F.lit(question).cast("string").alias("query"), none.alias("classification"), F.lit(f"{e}").alias("error"))


def article_listing(store: Collection) -> DataFrame:
    """Stored articles in numeric order, others last."""
    return store.read().groupBy("article_number").agg(F.count(F.lit(1)).alias("chunks")).orderBy(*articles.numeric_first("article_number"))
