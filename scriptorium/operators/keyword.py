"""TF-IDF keyword scores of chunks against queries, as aggregations and joins.

Weights: tf * (ln((1 + n) / (1 + df)) + 1), each text's vector scaled to length
1; a score is the product with the query's vector. Terms are runs of two or
more word characters, lower-cased. Terms are counted inside a text's row where
no id is there twice, so a limited vocabulary shuffles sums alone, and one
without a limit (chunk, term) counts, by term and then by chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scriptorium.shared import cut

#: Terms of a limited vocabulary that is broadcast, at most.
MOST_SENT = 100_000

#: Default stop words; a parameter everywhere.
STOP_WORDS = (
    "a about after all also an and any are as at be been but by can could for from had has have he her his how if in into is it its "
    "may more most no not of on one only or other our out over she so some such than that the their them then there these they this "
    "to under up was we were what when where which who will with would you your"
).split()


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def one_each(df: DataFrame, id: str) -> bool:
    """Whether no id is there twice; only ids are read."""
    return df.groupBy(id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))
def _counted(lists: pa.Array) -> pa.Array:
    """The distinct terms of each list with their counts."""
    lists = lists.filter(pa.array(np.ones(len(lists), bool)))  # offsets from 0
    n, at = len(lists), lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode() if n else pa.array([], pa.string()).dictionary_encode()
    width = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(n), np.diff(at))
    pairs, tf = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
    ends = np.searchsorted(pairs, np.arange(n + 1) * width)
    items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % width)), pa.array(tf.astype(np.int64))], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)


def frequencies(df: DataFrame, id: str, text: str, stop: list[str] | None = None, alone: bool = False) -> DataFrame:
    """(id, term, tf); counts of texts that have their id ``alone`` are not shuffled, others are combined before they are."""
    if alone:
        out = df.select(id, F.explode(_counted(terms(F.col(text)))).alias("x")).select(id, "x.term", "x.tf")
        return out.where(~F.col("term").isin(*stop)) if stop else out
    out = df.select(id, F.explode(terms(F.col(text))).alias("term"))
    if stop:
        out = out.where(~F.col("term").isin(*stop))
    return out.groupBy(id, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, texts: DataFrame, limit: int | None = None) -> DataFrame:
    """(term, idf) of the most frequent terms, ties by term: ``limit`` of them and at most 100 a text; of all without a limit."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    n = texts.agg(F.count(F.lit(1)).alias("n"))  # one row
    if limit:
        best = df.orderBy(F.desc("total"), "term").limit(limit)
        df = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "term")))  # ``limit`` rows
    df = df.crossJoin(F.broadcast(n))
    if limit:
        df = df.where(F.col("place") <= 100 * F.col("n"))
    return df.select("term", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def weights(tf: DataFrame, vocab: DataFrame, id: str) -> DataFrame:
    """(id, term, weight), vectors of length 1."""
    raw = tf.join(vocab, "term").withColumn("w", F.col("tf") * F.col("idf"))
    size = raw.groupBy(id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, id).select(id, "term", (F.col("w") / F.col("size")).alias("weight"))


def scores(texts: DataFrame, queries: DataFrame, *, id: str, text: str, query: str, query_text: str, stop: list[str] | None = None, limit: int | None = None, alone: bool | None = None) -> DataFrame:
    """(query, id, keyword) of texts that share a term with a query; all others score 0.

    The vocabulary is that of the texts. Queries are a stated set. Each text's
    length and its hits come from one aggregate over its own terms. ``alone``
    says whether every text has its own id; it is looked up if not given.
    """
    tf = frequencies(texts, id, text, stop, one_each(texts, id) if alone is None else alone)
    vocab = vocabulary(tf, texts, limit)
    if limit and limit <= MOST_SENT:
        vocab = F.broadcast(cut(vocab))  # ``limit`` rows
    asked = weights(frequencies(queries, query, query_text, stop), vocab, query)
    by_term = asked.groupBy("term").agg(F.collect_list(F.struct(F.col(query).alias("q"), F.col("weight").alias("asked"))).alias("asks"))
    known = vocab.join(by_term, "term", "left")
    if limit and limit <= MOST_SENT:
        known = F.broadcast(known)
    raw = tf.join(known, "term").withColumn("w", F.col("tf") * F.col("idf"))
    # sums by id and query, in tasks before they are shuffled; of no query: the length's
    kind = raw.schema["asks"].dataType.elementType["q"].dataType
    own = F.array(F.struct(F.lit(True).alias("own"), F.lit(None).cast(kind).alias("q"), (F.col("w") * F.col("w")).alias("x")))
    hits = F.transform(F.coalesce("asks", F.array().cast(raw.schema["asks"].dataType)), lambda a: F.struct(F.lit(False).alias("own"), a["q"].alias("q"), (a["asked"] * F.col("w")).alias("x")))
    sums = raw.select(id, F.explode(F.concat(own, hits)).alias("s")).groupBy(id, "s.own", "s.q").agg(F.sum("s.x").alias("x"))
    each = sums.groupBy(id).agg(F.sqrt(F.max(F.when(F.col("own"), F.col("x")))).alias("size"), F.collect_list(F.when(~F.col("own"), F.struct("q", "x"))).alias("hits")).where(F.size("hits") > 0)
    return each.select(id, "size", F.explode("hits").alias("h")).select(F.col("h.q").alias(query), id, (F.col("h.x") / F.col("size")).alias("keyword"))


def hybrid(scored: DataFrame, *, query: str, semantic: str = "semantic", keyword: str = "keyword", share: float = 0.7) -> DataFrame:
    """``scored`` with ``hybrid``: both scores stretched to 0..1 over a query's candidates and blended.

    Equal semantic scores count 1, equal keyword scores 0; a lone candidate
    keeps its semantic score.
    """
    ends = scored.groupBy(query).agg(F.count(F.lit(1)).alias("n_"), *[f(c).alias(f"{a}_{k}") for c, k in ((semantic, "s"), (keyword, "k")) for f, a in ((F.min, "lo"), (F.max, "hi"))])

    def stretched(c: str, k: str, flat: float) -> Column:
        span = F.col(f"hi_{k}") - F.col(f"lo_{k}")
        return F.when(span > 1e-8, (F.col(c) - F.col(f"lo_{k}")) / span).otherwise(flat)

    blend = stretched(semantic, "s", 1.0) * share + stretched(keyword, "k", 0.0) * (1 - share)
    # one row a query: a join by it would send a query's candidates, texts included, to one task
    return scored.join(F.broadcast(ends), query).withColumn("hybrid", F.when(F.col("n_") < 2, F.col(semantic)).otherwise(blend)).select(*scored.columns, "hybrid")


def top(scored: DataFrame, query: str, by: str, k: int, tie: str, descending_tie: bool = True) -> DataFrame:
    """The ``k`` best of each query with ``rank`` 1..k; ties by id, the later first."""
    order = Window.partitionBy(query).orderBy(F.desc(by), F.desc(tie) if descending_tie else F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
