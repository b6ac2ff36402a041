"""Completeness and consistency of a store, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.schemas import CASE_FIELDS, COMPONENTS


def _lit(names) -> F.Column:
    return F.array(*map(F.lit, names))


def component_counts(chunks: DataFrame, component: str, expected: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """(component, n) for every expected component, 0 where there is none."""
    dim = chunks.sparkSession.createDataFrame([(c,) for c in expected], "component string")
    have = chunks.groupBy(F.col(component).alias("component")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(have, "component", "left").select("component", F.coalesce("n", F.lit(0)).alias("n"))


def missing_components(chunks: DataFrame, case: str, component: str, expected: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """(case, n_chunks, missing): the expected components that a case lacks, in order."""
    return chunks.groupBy(case).agg(F.count(F.lit(1)).alias("n_chunks"), F.collect_set(component).alias("have")).select(case, "n_chunks", F.array_except(_lit(expected), F.col("have")).alias("missing"))


def missing_fields(chunks: DataFrame, fields: tuple[str, ...] = CASE_FIELDS, name: str = "missing_fields") -> DataFrame:
    """Chunks with the names of their empty fields."""
    return chunks.withColumn(name, F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", f) for f in fields])))


def in_stored_order(collection: DataFrame) -> DataFrame:
    """The rows of a Parquet read with ``stored_``, their file and place in it."""
    return collection.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("stored_"))


def sequences(chunks: DataFrame, group: str, index: str, total: str, order: str | None = None) -> DataFrame:
    """(group, n, indices_ok, total_ok): are the indices 1..n, and is the stated total n?

    With ``order``, a column such as ``stored_``, they have to come in that
    order, too; without it, in any.
    """
    by = F.struct(F.col(order or index).alias("at"), F.col(index).alias("i"))
    have = chunks.groupBy(group).agg(F.sort_array(F.collect_list(by)).alias("x"), F.count(F.lit(1)).alias("n"), F.max(total).alias("stated"))
    found = F.transform("x", lambda v: v["i"])
    return have.select(group, F.col("n").cast("int").alias("n"), (found == F.sequence(F.lit(1), F.col("n").cast("int"))).alias("indices_ok"), (F.col("stated") == F.col("n")).alias("total_ok"))


def extraction_totals(articles: DataFrame) -> DataFrame:
    """One row: articles, their chunks, and articles of more than one."""
    return articles.agg(F.count(F.lit(1)).alias("articles"), F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("chunks"), F.count_if(F.col("num_chunks") > 1).alias("multi_chunk_articles"))


def first_of(list_: F.Column, most: int) -> F.Column:
    """The first ``most`` of a list as it is displayed, and how many more there are."""
    more = F.size(list_) - most
    return F.when(more > 0, F.concat(F.array_join(F.slice(list_, 1, most), ", "), F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.array_join(list_, ", "))


def completeness(chunks: DataFrame) -> DataFrame:
    """One row on an article store: distinct chapters, parts and articles, complete and partial ones, chunk lengths."""
    each = chunks.groupBy("article_number").agg(F.bool_or("is_complete_article").alias("whole"))
    tally = each.agg(F.count_if("whole").alias("complete_articles"), F.count_if(~F.col("whole")).alias("partial_articles"))
    named = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    rest = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        named("chapter").alias("chapters"),
        named("part").alias("parts"),
        named("article_number").alias("articles"),
        F.avg(F.length("chunk_text")).alias("avg_length"),
        F.min(F.length("chunk_text")).alias("min_length"),
        F.max(F.length("chunk_text")).alias("max_length"),
    )
    return rest.crossJoin(tally)  # one row beside one row


def populated(fields: tuple[str, ...] = CASE_FIELDS) -> F.Column:
    """How many of a case's fields have a value."""
    out = F.lit(0)
    for f in fields:
        out = out + (F.coalesce(F.col(f), F.lit("")) != "").cast("int")
    return out


def field_warning(n: F.Column) -> F.Column:
    return F.when(n == 0, "no metadata").when(n < 4, "little metadata")


def status(failed: F.Column, done: F.Column, skipped: F.Column) -> F.Column:
    """failed if nothing was ingested or skipped; else partial_success if some failed, success if none."""
    return F.when(done + skipped == 0, "failed").when(failed > 0, "partial_success").otherwise("success")


def ingest_stats(outcomes: DataFrame, outcome: str = "status", by: list[str] | None = None) -> DataFrame:
    """Counts of ingested, skipped and failed rows, and the overall status."""
    out = outcomes.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(outcome) == s).alias(s) for s in ("ingested", "skipped", "failed")])
    return out.withColumn("overall", status(F.col("failed"), F.col("ingested"), F.col("skipped")))


def failures(outcomes: DataFrame, id: str, error: str, most: int = 10, outcome: str = "status") -> DataFrame:
    """The first ``most`` failures, a report."""
    return outcomes.where(F.col(outcome) == "failed").select(id, error).orderBy(id).limit(most)
