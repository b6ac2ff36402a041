"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents form blocks of ``block_rows``. A source of integer
weight a gets a slots in every round. Within a round of T slots, its block j
may not start before floor(j T / a) (release) and has to end by
ceil((j + 1) T / a) (deadline); earliest-deadline-first over released blocks
meets all deadlines, so at every slot each source has had its share of the
round to within less than one block.

Rounds with the same sources have the same schedule. A source leaves after its
last round, in which it may have fewer blocks; so there are at most 2 S + 1
distinct rounds for S sources, and the schedules are computed once for each,
whatever the number of documents. A document's place is arithmetic on its rank
in its source.

Bounds: S is checked against MAX_SOURCES before sources are put into one row,
given weights against MAX_ROUND; the schedule table has at most (2 S + 1)
rounds of RESOLUTION + S, or MAX_ROUND + S, slots: a function of the weights,
not of the rows. Ranks come from ``common.ranked``: no source, however large,
is put into one task.

Defined results: nothing is dropped or repeated; a null source is a source of
its own; sources without a weight get weight 1; repeated rows each get a
place of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import fresh, ranked

BLOCK_ROWS = 32
#: Slots that a round has, about; the grain of the weights.
RESOLUTION = 240
#: More sources than this are an error: group the small ones before mixing.
MAX_SOURCES = 1000
#: Given weights may sum to so much: a round is scheduled slot by slot.
MAX_ROUND = 2000


def _schedule(jobs: Column, total: Column) -> Column:
    """Sources in the order of their slots: earliest deadline first among the released.

    ``jobs``: array of (source, blocks). The state is how many blocks of each
    source are placed; a slot takes the released one with the least (deadline,
    place in the array).
    """
    step = F.struct(F.transform(jobs, lambda x: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("out"))

    def pick(state: Column, slot: Column) -> Column:
        due = F.zip_with(jobs, state["done"], lambda j, d: F.when((d < j["blocks"]) & (F.floor(d * total / j["blocks"]) <= slot), F.ceil((d + 1) * total / j["blocks"])))
        return F.array_min(F.filter(F.transform(due, lambda x, i: F.struct(x.alias("d"), i.alias("i"))), lambda x: x["d"].isNotNull()))["i"]

    def take(state: Column, slot: Column) -> Column:
        placed = lambda p: F.struct(F.transform(state["done"], lambda d, i: d + F.when(i == p, 1).otherwise(0)).alias("done"), F.concat(state["out"], F.array(p)).alias("out"))
        return F.transform(F.array(pick(state, slot)), placed)[0]  # binds the pick: it is worked out once a slot

    return F.aggregate(F.sequence(F.lit(0), total - 1), step, take, lambda a: a["out"])


def mixed(docs: DataFrame, *, id: str = "doc_id", source: str = "source", weights: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, position: str = "position", tie: str | None = None) -> DataFrame:
    """``docs`` with ``slot`` (of the document's block) and ``position`` (gapless from 0).

    ``weights``: whole numbers by source. Without them, a source's weight
    follows the square root of its size (temperature sampling), at least 1,
    about RESOLUTION in all. New names that clash get underscores in front.
    ``tie``: the column that orders rows of equal id; without it, a hash of the row.
    """
    if weights is not None and (sum(weights.values()) > MAX_ROUND or any(w < 1 or w != int(w) for w in weights.values())):
        raise ValueError(f"weights are whole numbers from 1, {MAX_ROUND} in all at most: divide them by a common number")
    named = fresh(docs, "block", "slot", position)
    k, rank, block, slot, pos = "source_key", "rank_", "block", "slot", "position"
    # a row travels whole in a struct, so its column names meet none of those used here
    key = F.concat(F.when(F.col(source).isNull(), "n").otherwise("s"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    keyed = docs.select(F.struct(*docs.columns).alias("row_"), F.col(id).alias("id_"), (F.col(tie) if tie else F.xxhash64(*docs.columns)).alias("hash_"), key.alias(k))
    place = ranked(keyed, [k], [F.col("id_"), F.col("hash_")], rank)
    # one row a source from here to the schedule
    sizes = keyed.groupBy(k).agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.limit(MAX_SOURCES + 1).withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
    if weights is None:
        root = F.sqrt("rows")
        sizes = sizes.withColumn("a", F.greatest(F.lit(1), F.round(root * RESOLUTION / F.sum(root).over(Window.partitionBy(F.lit(0))))).cast("int"))
    else:
        given = F.lit(1)
        for name, w in weights.items():
            given = F.when(F.col(k) == ("n" if name is None else f"s{name}"), w).otherwise(given)
        sizes = sizes.withColumn("a", given.cast("int"))
    sizes = sizes.withColumn("last", F.floor((F.col("blocks") - 1) / F.col("a")).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct(F.col(k).alias("k"), "rows", "blocks", "a", "last")))
    one = sizes.agg(listed.alias("all")).withColumn("all", F.when(F.size("all") <= MAX_SOURCES, F.col("all")).otherwise(F.raise_error(F.lit(f"over {MAX_SOURCES} sources: group them first"))))
    # the first round of each stretch of equal rounds
    one = one.withColumn("first", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("all", lambda s: s["last"]), F.transform("all", lambda s: s["last"] + 1)))))
    rounds = one.select("all", F.explode("first").alias("first"))
    left = F.transform("all", lambda s: F.struct(s["k"].alias("k"), F.greatest(F.lit(0), F.least(s["a"], s["blocks"] - s["a"] * F.col("first"))).alias("blocks")))
    rounds = rounds.withColumn("jobs", F.filter(left, lambda j: j["blocks"] > 0)).where(F.size("jobs") > 0)
    rounds = rounds.withColumn("total", F.aggregate("jobs", F.lit(0), lambda a, j: a + j["blocks"]))
    rounds = rounds.withColumn("order", _schedule(F.col("jobs"), F.col("total")))
    spread = rounds.select("first", "total", "jobs", F.posexplode("order").alias("at", "pick")).withColumn(k, F.get("jobs", F.col("pick"))["k"])
    nth = Window.partitionBy("first", k).orderBy("at")
    table = spread.select("first", k, (F.row_number().over(nth) - 1).alias("j"), "at")
    # slots before a round: what each source has placed by then
    before = lambda r: F.aggregate("all_", F.lit(0).cast("long"), lambda a, s: a + F.least(s["blocks"].cast("long"), s["a"] * r))
    # blocks that are not full are the last of their source, and a last round begins a stretch
    ends = one.select(F.col("all").alias("all_"), F.col("first").alias("first_"))
    last = ends.select("all_", F.explode("all_").alias("s_")).select("all_", F.col("s_")["k"].alias(k), F.col("s_")["last"].alias("first"), ((F.col("s_")["blocks"] - 1) % F.col("s_")["a"]).cast("int").alias("j"), (block_rows * F.col("s_")["blocks"].cast("long") - F.col("s_")["rows"]).alias("n"))
    short = last.join(table, ["first", k, "j"]).select(F.struct((before(F.col("first")) + F.col("at")).alias("s"), "n").alias("x")).agg(F.collect_list("x").alias("short_"))
    ends = ends.crossJoin(short)  # one row beside one row
    shares = sizes.select(k, F.col("a").alias("a_"))
    df = place.withColumn(block, F.floor(F.col(rank) / block_rows).cast("long")).join(F.broadcast(shares), k).crossJoin(F.broadcast(ends))  # MAX_SOURCES entries at most, and one row
    df = df.withColumn("round_", F.floor(F.col(block) / F.col("a_")).cast("long")).withColumn("j_", (F.col(block) % F.col("a_")).cast("int"))
    df = df.withColumn("before_", before(F.col("round_"))).withColumn("stretch_", F.array_max(F.filter("first_", lambda x: x <= F.col("round_"))))
    t = F.broadcast(table.select(F.col("first").alias("stretch_"), F.col(k), F.col("j").alias("j_"), F.col("at").alias("at_")))  # bounded by the weights
    df = df.join(t, ["stretch_", k, "j_"]).withColumn(slot, F.col("before_") + F.col("at_"))
    gaps = F.aggregate(F.filter("short_", lambda x: x["s"] < F.col(slot)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    df = df.withColumn(pos, F.col(slot) * block_rows + F.col(rank) % block_rows - gaps)
    return df.select("row_.*", *[F.col(c).alias(name) for c, name in zip((block, slot, pos), named, strict=True)])


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """The documents with their own columns, sorted into the mix (a range partitioning, not one task)."""
    (pos,) = fresh(docs, "mix_position")
    return mixed(docs, position=pos, **options).orderBy(pos).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mixed(docs).select("doc_id", "source", "block", "slot", "position")
