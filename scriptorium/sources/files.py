"""Files to documents and back: text, PDF, JSON, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.plans.providers import PageReader, no_pages

SUFFIXES = ("txt", "pdf")
#: A page with fewer characters than this is read by OCR.
OCR_BELOW = 50


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, name, length, modified) of the files with these suffixes, any case, by name; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    keep = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*suffixes)
    return files.where(keep).select("path", tx.file_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified")).orderBy("path")


def pages(files: DataFrame, reader: PageReader = no_pages, ocr: PageReader | None = None, below: int = OCR_BELOW) -> DataFrame:
    """(path, page, text, error) of PDF files: one row a page, read where the file is.

    A page with under ``below`` characters is read by ``ocr``, if there is
    one; where that fails, the short text stays. A file that cannot be read
    has one row with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out, seen = [], None
                try:
                    for i, page in enumerate(reader(content)):
                        if ocr and len(page.strip()) < below:
                            try:
                                seen = ocr(content) if seen is None else seen  # once a file
                                page = seen[i]
                            except Exception:  # noqa: BLE001 - any failure of a provider keeps what there is
                                seen = [] if seen is None else seen
                        out.append((path, i, page, None))
                except Exception as e:  # noqa: BLE001 - becomes a row
                    out = [(path, 0, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["path", "page", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def documents(spark: SparkSession, path: str, *, reader: PageReader = no_pages, ocr: PageReader | None = None, clean: Callable = tx.clean_web, page_break: str = "\n\n", paged: DataFrame | None = None) -> DataFrame:
    """One row a file: text, cleaned, with its metadata, SHA-256 and a typed ``error``.

    Blank pages are dropped and the rest joined. Where cleaning leaves
    nothing, the raw text stays. Files that are no PDF are read as UTF-8.
    ``paged``: the rows of the format ``pages`` for these files, instead of a reader.
    """
    files = spark.read.format("binaryFile").load(path)
    files = files.withColumn("file_type", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    facts = ("path", "file_type", F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"))
    plain = files.where(F.col("file_type") != ".pdf").select(*facts, F.make_valid_utf8(F.col("content").cast("string")).alias("raw"), F.lit(None).cast("string").alias("error"))
    found = pages(files.where(F.col("file_type") == ".pdf"), reader, ocr) if paged is None else paged.withColumn("path", F.concat(F.lit("file:"), "path"))
    solid = F.when(tx.strip(F.coalesce("text", F.lit(""))) != "", F.struct("page", "text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(solid)), lambda x: x["text"]), page_break)
    pdf = found.groupBy("path").agg(joined.alias("raw"), F.max("error").alias("error"))
    raw = plain.unionByName(files.where(F.col("file_type") == ".pdf").select(*facts).join(pdf, "path"))
    df = raw.withColumn("clean", clean(F.col("raw"))).withColumn("text", tx.cleaned_or_raw(F.col("clean"), F.col("raw")))
    return df.select(
        "text",
        F.col("path").alias("source"),
        "file_type",
        "file_size",
        F.length("raw").alias("original_size"),
        F.current_timestamp().alias("loaded_at"),
        (tx.strip(F.col("clean")) != "").alias("cleaned"),
        tx.file_name(F.col("path")).alias("file_name"),
        "file_hash",
        tx.percent_removed(F.col("text"), F.col("raw")).alias("percent_removed"),
        F.when(F.col("error").isNotNull(), F.col("error")).when(tx.strip(F.col("raw")) == "", "no text").alias("error"),
    )


def chunk_file(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a JSON file {metadata, embeddable_chunks[]}; an empty list gives no row."""
    whole = spark.read.json(path, multiLine=True, schema=f"metadata map<string,string>, embeddable_chunks array<{schema.simpleString()}>")
    return whole.select(F.explode("embeddable_chunks").alias("c")).select("c.*")


def write_chunk_file(chunks: DataFrame, path: str, size: int = 1000, overlap: int = 300, description: str = "") -> None:
    """The JSON file that ``chunk_file`` reads. One value by format, so one row; Unicode stays as it is."""
    head = F.struct(
        F.count_distinct("article_number").cast("string").alias("total_articles"),
        F.count(F.lit(1)).cast("string").alias("total_embeddable_chunks"),
        F.lit(str(size)).alias("chunk_size"),
        F.lit(str(overlap)).alias("chunk_overlap"),
        F.first("source_document").alias("source_document"),
        F.lit(description).alias("description"),
    )
    rows = F.sort_array(F.collect_list(F.struct("article_number", "chunk_index", F.struct(*chunks.columns).alias("row"))))
    one = chunks.agg(head.alias("metadata"), F.transform(rows, lambda x: x["row"]).alias("embeddable_chunks"))
    one.select(F.to_json(F.struct("metadata", "embeddable_chunks"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_array(df: DataFrame, path: str) -> None:
    """One JSON document, an array of the rows in order. One value by format, so one task: for results, not for corpora."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"), F.monotonically_increasing_id().alias("at"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("x"))
    one.select(F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["value"]), ",\n"), F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines, in parallel."""
    df.write.mode("overwrite").json(path)


def write_report(articles: DataFrame, path: str, order: str = "number") -> None:
    """A text report: one block an article, in numeric order."""
    line = F.concat_ws("\n", F.concat(F.lit("ARTICLE "), F.col("number"), F.lit(": "), F.coalesce("header", F.lit(""))), F.concat(F.lit("CHAPTER: "), F.coalesce("chapter", F.lit("-")), F.lit(" | PART: "), F.coalesce("part", F.lit("-"))), F.concat(F.lit("LENGTH: "), F.col("text_length").cast("string"), F.lit(" | CHUNKS: "), F.col("num_chunks").cast("string")), F.col("full_article_text"), F.lit("-" * 40))
    articles.orderBy(F.expr(f"try_cast({order} as int)").asc_nulls_last(), order).select(line.alias("value")).write.mode("overwrite").text(path)
