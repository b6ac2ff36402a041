"""Chat formatting: collapse cumulative snapshots, then render what is left.

Logs often hold a conversation again and again as it grows. A rolling hash of
turn prefixes names every prefix of every conversation; a conversation whose
whole hash is the hash of a proper prefix of a longer one is dropped by an
anti-join, and of equal conversations the one with the least id stays. The
rest are rendered in a turn-marked template. DataFrame functions only.

The rolling hash is kept in 128 bits: two running XORs of hashes of (position,
role, text), so a window computes it in one sorted pass that can spill. Equal
hashes are trusted: at 10^11 prefixes a chance clash has odds under 10^-16.

What is shuffled to find the conversations that stay is a hash of each turn's
text, never the text. The texts move once, to be rendered.

Hot keys: prefix and conversation hashes are pre-aggregated before their
shuffle; a conversation repeated very often meets the anti-join as one row.
Only a rendered conversation, which is one value, has its turns together.

Defined results: turns are ordered by (turn, role, MD5 of the text), nulls
last, and a repeated row counts once; a null role is rendered as ``unknown``
and a null text as an empty text, and each equals itself only; an empty table
gives an empty result; a null conv_id is a conversation of its own; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame, conv: str, turn: str, role: str, *more) -> DataFrame:
    """The id in a struct, in which null equals null, whatever joins or groups by it."""
    return turns.select(F.struct(F.col(conv).alias("id")).alias("c"), F.col(turn).alias("turn"), F.col(role).alias("role"), *more)


def _hash(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (c, turn, role, said), once each, with ``n`` (1, 2, ...) and the hash ``p``, ``q`` of the prefix that ends there."""
    order = Window.partitionBy("c").orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("said"))
    df = turns.distinct().withColumn("n", F.row_number().over(order))
    known = [F.col("role").isNull(), F.col("role"), F.col("said").isNull(), F.col("said")]
    df = df.withColumn("p", F.xxhash64("n", *known)).withColumn("q", F.xxhash64(F.lit("second"), *known, "n"))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("p", F.bit_xor("p").over(run)).withColumn("q", F.bit_xor("q").over(run))


def _maximal(turns: DataFrame) -> DataFrame:
    """(c, n, copies) of conversations that no other extends; of equal ones, the least id."""
    marked = prefixes(turns).select("c", "n", "p", "q")
    last = F.max(F.struct("n", "p", "q"))
    whole = marked.groupBy("c").agg(last.alias("l")).select("c", "l.*")
    once = whole.groupBy("n", "p", "q").agg(F.min(F.struct(F.col("c.id").isNull().alias("z"), "c")).alias("c"), F.count(F.lit(1)).alias("copies"))
    # proper prefixes: every prefix but the whole
    ends = Window.partitionBy("c").orderBy(F.desc("n"))
    proper = marked.withColumn("r", F.row_number().over(ends)).where("r > 1").select("n", "p", "q").distinct()
    left = once.join(proper, ["n", "p", "q"], "left_anti")
    return left.select("c.c", F.col("n").cast("long").alias("n"), "copies")


def maximal(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies) of conversations that no other extends; of equal ones, the least id."""
    kept = _maximal(_turns(turns, conv, turn, role, _hash(text).alias("said")))
    return kept.select(F.col("c.id").alias(conv), F.col("n").alias("n_turns"), F.col("copies").alias("n_copies"))


def rendered(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies, chat): maximal conversations in the template."""
    kept = _maximal(_turns(turns, conv, turn, role, _hash(text).alias("said")))
    mine = _turns(turns, conv, turn, role, F.col(text).alias("text")).join(kept, "c")
    nulls_last = F.struct(F.col("turn").isNull().alias("a"), "turn", F.col("role").isNull().alias("b"), "role", F.col("text").isNull().alias("d"), _hash("text").alias("said"), "text")
    said = F.transform(F.sort_array(F.collect_set(nulls_last)), lambda x: F.concat(F.lit(START), F.coalesce(x["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(END), F.lit("\n")))
    # grouped by what the join has dealt the rows by: the texts do not move again
    out = mine.groupBy("c").agg(F.first("n").alias("n_turns"), F.first("copies").alias("n_copies"), F.array_join(said, "").alias("chat"))
    return out.select(F.col("c.id").alias(conv), "n_turns", "n_copies", "chat")


def query(spark, sf_dir: str) -> DataFrame:
    return rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
one AS (SELECT conv_id, count(*) AS n,
               list({{'r': role, 't': text}} ORDER BY turn NULLS LAST, role NULLS LAST, md5(text) NULLS LAST) AS said,
               string_agg('{START}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '{END}' || chr(10), '' ORDER BY turn NULLS LAST, role NULLS LAST, md5(text) NULLS LAST) AS chat
        FROM t GROUP BY conv_id),
same AS (SELECT min(conv_id) AS conv_id, n, said, any_value(chat) AS chat, count(*) AS n_copies FROM one GROUP BY n, said)
SELECT conv_id, n::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, chat FROM same a
WHERE NOT EXISTS (SELECT 1 FROM same b WHERE b.n > a.n AND b.said[1:a.n] = a.said)"""
