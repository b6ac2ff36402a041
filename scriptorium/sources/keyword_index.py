"""A stored inverted index: TF-IDF postings by term, read for a query's terms only.

Postings (term, id, weight) have the weights of ``keyword.weights``: each
text's vector has length 1, so nothing else of a text is needed to score it.
They are partitioned by a hash of the term and ordered by term in each file, so
a query opens the partitions of its terms, and in them the row groups whose
range of terms has one. A term in very many texts is spread over files by the
write's rebalance. How terms were hashed and which were left out is written
last; without that there is no index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import keyword

#: Partitions of the postings.
BUCKETS = 64
#: Distinct query terms that are named in the scan's filter; more are joined instead, and the scan is whole.
MOST_TERMS = 10_000

_MADE = "buckets int, stop array<string>, id string, kind string"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str):
        """Open the index at ``path``; an unfinished one is an error of Spark's reader."""
        self.spark, self.path = spark, path.rstrip("/")
        made = spark.read.schema(_MADE).parquet(f"{self.path}/made").first()
        self.buckets, self.stop = made.buckets, list(made.stop)
        self._schemas = {"terms": "term string, idf double, bucket int", "postings": f"{made.id} {made.kind}, term string, weight double, bucket int"}

    @classmethod
    def build(cls, texts: DataFrame, path: str, *, id: str, text: str, stop: list[str] | None = None, limit: int | None = None, buckets: int = BUCKETS) -> KeywordIndex:
        """Index texts, each named by ``id``; stop words and vocabulary limit as in ``keyword.scores``."""
        spark, path = texts.sparkSession, path.rstrip("/")
        rows = keyword.frequencies(texts, id, text, stop, keyword.one_each(texts, id))
        vocab = keyword.vocabulary(rows, texts, limit).withColumn("bucket", _bucket(buckets))
        cls._write(vocab, f"{path}/terms")
        terms = spark.read.schema("term string, idf double").parquet(f"{path}/terms")
        if limit and limit <= keyword.MOST_SENT:
            terms = F.broadcast(terms)
        cls._write(keyword.weights(rows, terms, id).withColumn("bucket", _bucket(buckets)), f"{path}/postings")
        spark.createDataFrame([(buckets, list(stop or []), id, texts.schema[id].dataType.simpleString())], _MADE).coalesce(1).write.mode("overwrite").parquet(f"{path}/made")
        return cls(spark, path)

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def of_terms(self, table: str, asked: DataFrame) -> DataFrame:
        """The rows of ``terms`` or ``postings`` whose term ``asked`` has; the scan opens their partitions only."""
        rows = self.spark.read.schema(self._schemas[table]).parquet(f"{self.path}/{table}")
        named = asked.select("term").distinct().withColumn("bucket", _bucket(self.buckets)).limit(MOST_TERMS + 1).collect()
        if len(named) > MOST_TERMS:
            return rows.join(asked.select("term").distinct(), "term", "left_semi")
        return rows.where(F.col("bucket").isin(*{r.bucket for r in named}) & F.col("term").isin(*[r.term for r in named]))

    def scores(self, queries: DataFrame, *, query: str, query_text: str, id: str) -> DataFrame:
        """(query, id, keyword), as ``keyword.scores`` of the indexed texts gives."""
        asked = keyword.frequencies(queries, query, query_text, self.stop)
        weighed = keyword.weights(asked, self.of_terms("terms", asked).select("term", "idf"), query).withColumnRenamed("weight", "asked")
        hits = self.of_terms("postings", asked).select("term", id, "weight").join(weighed, "term")
        return hits.groupBy(query, id).agg(F.sum(F.col("weight") * F.col("asked")).alias("keyword"))
