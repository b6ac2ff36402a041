"""Sharding: balanced label propagation under capacity quotas.

Documents are nodes; a link group (here: equal texts) ties its members. Labels
are shards. Every round, in Spark joins:

1. groups vote: members count by label, pre-aggregated on (group, label);
   members that have settled vote for their shard;
2. a group aims at the label that most of its members have, among labels with
   room for all that have not settled (or else any room), and these want to
   move there;
3. quotas: a label admits groups up to its room, the largest first (running
   sums over buckets of groups, then within a bucket); a group that fits
   nowhere whole, or in the last round, is admitted in part;
4. admitted members are settled. Those left over vote again.

Documents without links, and members that no round settled, fill the room that
is left. Law ``rows``: shard sizes in rows differ by one at most, always.

A group larger than a shard is cut beforehand into pieces of that size (it has
to span shards anyway), by a bucketed ranking, so no group is ever one task.
First labels follow a ranking of the rows' hashes, so a row's shard depends on
the rows alone, not on how they are dealt to partitions. State is written to
shared storage each round; nothing but per-shard counts (one row a shard)
reaches the driver.

Defined results: a null text has size 16 and CRC 0, and nulls are equal to
each other; an empty text likewise has size 16 and CRC 0 but is another text;
repeated rows are separate members of one group; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import RANK_BUCKETS, counted, fresh, ranked, stage

SHARDS = 40
ROUNDS = 8


def _best(votes: DataFrame, demand: DataFrame, room: list[int]) -> DataFrame:
    """(g, d, target): the label with the most members among those with room for all d, or else for some; ties by a hash of both."""
    rooms = F.array(*[F.lit(int(r)) for r in room])
    labels = F.array(*[F.lit(j) for j in range(len(room))])
    whole = F.filter(labels, lambda j: F.get(rooms, j) >= F.col("d"))
    some = F.filter(labels, lambda j: F.get(rooms, j) > 0)
    goals = demand.withColumn("goals", F.when(F.size(whole) > 0, whole).otherwise(some))
    best = votes.join(goals, "g").where(F.array_contains("goals", F.col("label"))).groupBy("g").agg(F.max(F.struct("c", F.xxhash64("g", "label").alias("h"), "label"))["label"].alias("label"))
    # groups with no member in such a label are spread over them by hash
    other = F.get("goals", F.pmod(F.xxhash64("g"), F.size("goals")).cast("int"))
    return goals.join(best, "g", "left").select("g", "d", F.coalesce("label", other).alias("target"))


def _admitted(demand: DataFrame, room: list[int], last: bool) -> DataFrame:
    """(g, target, d, admitted): how many members of each group its target takes within its room, large groups first.

    A group that fits no label, or any in the ``last`` round, may be taken in part; others wait for a label that takes them whole.
    """
    rooms = F.array(*[F.lit(int(r)) for r in room])
    each = RANK_BUCKETS // 64
    b = demand.withColumn("b", ((63 - F.floor(F.log2("d"))) * each + F.pmod(F.xxhash64("g"), F.lit(each))).cast("int"))
    upto = Window.partitionBy("target").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = b.groupBy("target", "b").agg(F.sum("d").alias("s")).withColumn("s", F.coalesce(F.sum("s").over(upto), F.lit(0)))
    inside = Window.partitionBy("target", "b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    run = b.withColumn("r", F.coalesce(F.sum("d").over(inside), F.lit(0))).join(starts, ["target", "b"])
    left = F.get(rooms, F.col("target")) - F.col("r") - F.col("s")
    part = F.lit(last) | (F.col("d") > max(room))
    return run.select("g", "target", "d", F.when((left >= F.col("d")) | part, F.greatest(F.lit(0), F.least("d", left))).otherwise(F.lit(0)).alias("admitted"))


def balanced_shards(nodes: DataFrame, *, id: str, group: str, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Staged ``nodes`` with ``shard``: 0 .. shards - 1, row counts at most one apart.

    ``id`` numbers the rows from 0, without gaps; nodes with equal ``group`` are linked.
    """
    shard, g, piece, size, rank = fresh(nodes, "shard", "g_", "piece_", "size_", "rank_")
    first = nodes.withColumn(g, F.col(group))
    total = first.count()
    cap = [total // shards + (j < total % shards) for j in range(shards)]
    sizes = counted(first.groupBy(g).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) > 1))
    chunk = max(1, min(cap))
    small = first.join(sizes.where(F.col(size) <= chunk), g).select(F.col(id).alias("i"), F.col(g).alias("g"), F.lit(0).cast("long").alias("p"))
    large = ranked(first.join(sizes.where(F.col(size) > chunk), g), [g], [F.col(id)], piece)
    large = large.select(F.col(id).alias("i"), F.col(g).alias("g"), F.floor(F.col(piece) / chunk).cast("long").alias("p"))
    # the first label of a node is its number, so labels start out even
    linked = stage(small.unionByName(large).select("i", F.xxhash64("g", "p").alias("g"), F.pmod("i", F.lit(shards)).cast("int").alias("label")), "linked")
    settled, homes, open_ = [], None, linked
    room = cap[:]
    for turn in range(rounds):
        if not any(room):
            break
        votes = open_.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
        demand = open_.groupBy("g").agg(F.count(F.lit(1)).alias("d"))
        if homes is not None:
            votes = votes.unionByName(homes.join(demand.select("g"), "g", "left_semi")).groupBy("g", "label").agg(F.sum("c").alias("c"))
        admitted = stage(_admitted(_best(votes, demand, room), room, turn + 1 == rounds), "admitted")
        whole = open_.join(admitted.where("admitted = d"), "g").select("i", "g", "label", "target", F.lit(True).alias("in"))
        part = ranked(open_.join(admitted.where("admitted < d"), "g"), ["g"], [F.col("i")], "nth")
        part = part.select("i", "g", "label", "target", (F.col("nth") < F.col("admitted")).alias("in"))
        moved = stage(whole.unionByName(part), "moved")
        settled.append(moved.where("in").select("i", F.col("target").alias("shard")))
        home = admitted.where("admitted > 0").select("g", F.col("target").alias("label"), F.col("admitted").cast("long").alias("c"))
        homes = home if homes is None else homes.unionByName(home)
        taken = {r["label"]: r["n"] for r in home.groupBy("label").agg(F.sum("c").alias("n")).collect()}  # a row a shard
        room = [c - taken.get(j, 0) for j, c in enumerate(room)]
        open_ = moved.where("not in").select("i", "g", "label")
        if open_.isEmpty():
            break
    done = linked.limit(0).select("i", F.lit(0).alias("shard"))
    for s in settled:
        done = done.unionByName(s)
    done = done.select(F.col("i").alias(id), F.col("shard").cast("int").alias(shard))
    rest = ranked(first.join(done, id, "left_anti"), [], [F.col(id)], rank)
    ends, at = [], 0
    for r in room:
        at += r
        ends.append(at)
    fill: Column = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col(rank)))
    rest = rest.withColumn(shard, fill.cast("int"))
    kept = first.join(done, id)
    return kept.unionByName(rest.select(*kept.columns)).drop(g)


def cut_links(placed: DataFrame, *, group: str, shard: str = "shard") -> DataFrame:
    """One row: pairs of linked rows, those that shards cut, and those that a shard drawn by lot would cut, on average."""
    by = placed.groupBy(group, shard).agg(F.count(F.lit(1)).cast("double").alias("c"))
    each = by.groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("together"))
    links = F.col("n") * (F.col("n") - 1) / 2
    out = each.agg(F.coalesce(F.sum(links), F.lit(0.0)).alias("links"), F.coalesce(F.sum(links - F.col("together")), F.lit(0.0)).alias("cut"))
    shards = placed.agg(F.count_distinct(shard).alias("shards"))
    return out.crossJoin(shards).select("links", "cut", (F.col("links") * (1 - 1 / F.greatest(F.lit(1), F.col("shards")))).alias("cut_by_lot"))  # one row beside one row


def measured(docs: DataFrame, *more: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, equal) of every row of ``docs``, and ``more``: what sharding reads instead of texts."""
    raw = F.col(text).cast("binary")
    equal = F.when(F.col(text).isNull(), "null").otherwise(F.sha2(raw, 256))
    size = (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long")
    crc = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.crc32(raw))
    return docs.select(F.col(id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), equal.alias("equal"), *more)


def dealt(nodes: DataFrame, *, shards: int = SHARDS, position: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of ``measured`` rows.

    ``position``: a column, gapless from 0, that every shard's slots follow;
    without it they follow a hash of the id.
    """
    # equal rows may change places, so the numbers depend on the rows alone
    lot = F.xxhash64(*nodes.columns)
    nodes = stage(ranked(nodes, [], [lot, F.col("doc_id"), F.col("equal")], "row", F.pmod(lot, F.lit(RANK_BUCKETS))), "rows")
    placed = balanced_shards(nodes, id="row", group="equal", shards=shards)
    if position is None:
        out = ranked(placed, ["shard"], [F.xxhash64("doc_id"), F.col("row")], "slot")
    else:
        part = F.floor(F.col(position) * RANK_BUCKETS / F.lit(max(1, nodes.count())))
        out = ranked(placed, ["shard"], [F.col(position)], "slot", part)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row of ``docs``; groups are equal texts."""
    return dealt(measured(docs, id=id, text=text), shards=shards).withColumnRenamed("doc_id", id)


def query(spark, sf_dir: str) -> DataFrame:
    return labelled(sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def labelled(out: DataFrame) -> DataFrame:
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
