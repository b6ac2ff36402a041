"""Numbered articles of a statute, from its lines, by window functions.

Chapter and part carry forward to the lines below; a chapter ends the part.
An article begins at a numbered line unless the article above has the same
number, and runs to the next number, part or chapter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.chunk import article_windows
from scriptorium.functions.text import strip

#: The lines that open an article, a part and a chapter.
NUMBERED = r"^(\d+)\.\s+(.+)"
PART = r"(?i)^PART\s+(\d+)\s*[–-]\s*(.+)"
CHAPTER = r"(?i)^CHAPTER\s+(.+)"
MOST = 264


def segmented(docs: DataFrame, *, id: str, text: str, most: int = MOST) -> DataFrame:
    """One row an article: number, header, sentence, text, part and chapter with titles; at most ``most`` a document."""
    raw = docs.select(id, F.posexplode(F.split(text, "\n")).alias("n", "raw"))
    df = raw.withColumn("s", strip(F.col("raw")))
    kind = F.when(F.col("s").rlike(PART), "p").when(F.col("s").rlike(CHAPTER), "c").when(F.col("s").rlike(NUMBERED), "a")
    df = df.withColumn("kind", kind).withColumn("number", F.when(F.col("kind") == "a", F.regexp_extract("s", NUMBERED, 1)))
    order = Window.partitionBy(id).orderBy("n")
    above, upto, below = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    event = F.when(F.col("kind").isNotNull(), F.struct("kind", "number"))
    df = df.withColumn("last", F.last(event, True).over(above)).withColumn("now", F.last(event, True).over(upto))
    starts = (F.col("kind") == "a") & ~F.coalesce((F.col("last.kind") == "a") & (F.col("last.number") == F.col("number")), F.lit(False))
    df = df.withColumn("starts", F.coalesce(starts, F.lit(False))).withColumn("article", F.sum(F.col("starts").cast("int")).over(upto))
    solid = F.when(F.col("s") != "", F.struct("s", "kind"))
    df = df.withColumn("next", F.first(solid, True).over(below)).withColumn("one", F.lag("s", 1).over(order)).withColumn("two", F.lag("s", 2).over(order))
    title = F.when(F.coalesce(F.col("next.kind"), F.lit("")).isin("p", "a"), None).otherwise(F.col("next.s"))
    chapter = F.when(F.col("kind") == "c", F.struct(strip(F.regexp_extract("s", CHAPTER, 1)).alias("name"), title.alias("title")))
    part = F.when(F.col("kind") == "p", F.struct(F.regexp_extract("s", PART, 1).alias("name"), strip(F.regexp_extract("s", PART, 2)).alias("title"))).when(F.col("kind") == "c", F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("title")))
    df = df.withColumn("chapter_", F.last(chapter, True).over(upto)).withColumn("part_", F.last(part, True).over(upto))
    header = F.when(F.coalesce("one", F.lit("")) != "", F.col("one")).otherwise(F.coalesce("two", F.lit("")))
    inside = df.where((F.col("now.kind") == "a") & (F.col("article") <= most))
    at = F.struct("n")
    return inside.groupBy(id, "article").agg(
        F.min_by("number", at).alias("number"),
        F.min_by(header, at).alias("header"),
        F.min_by(F.regexp_extract("s", NUMBERED, 2), at).alias("sentence"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("s") != "", F.struct("n", "raw")))), lambda x: x["raw"]), "\n").alias("full_article_text"),
        F.min_by(F.col("part_.name"), at).alias("part"),
        F.min_by(F.col("part_.title"), at).alias("part_title"),
        F.min_by(F.col("chapter_.name"), at).alias("chapter"),
        F.min_by(F.col("chapter_.title"), at).alias("chapter_title"),
    )


def with_chunks(articles: DataFrame, source: str) -> DataFrame:
    """Articles with their length and windows; ``source`` names the column that becomes source_document."""
    df = articles.withColumn("text_length", F.length("full_article_text")).withColumn("chunks", article_windows(F.col("full_article_text")))
    return df.withColumn("num_chunks", F.size("chunks")).withColumn("source_document", F.col(source))


def flattened(articles: DataFrame) -> DataFrame:
    """One row a chunk, numbered from 1, with the article's fields."""
    base = articles.select(F.col("number").alias("article_number"), F.col("header").alias("article_header"), "chapter", "chapter_title", "part", "part_title", "source_document", F.col("text_length").alias("article_length"), F.col("num_chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk_text"))
    return base.withColumn("chunk_index", F.col("chunk_index") + 1).withColumn("chunk_length", F.length("chunk_text")).withColumn("is_complete_article", F.col("total_chunks") == 1)


def numeric_first(number: str):
    """Order of article numbers: as numbers, others last."""
    return F.expr(f"try_cast({number} as int)").asc_nulls_last(), F.col(number)
