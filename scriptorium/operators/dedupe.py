"""Greedy removal of near-duplicates from ranked lists, of any length.

A chunk is dropped if it shares over ``threshold`` of the larger word set with
a chunk of its list that was kept before it. That is the lexicographically
first independent set of the graph of similar pairs, found as joins:

* Equal word sets first: the first of each stands for all, as whatever becomes
  of it, the others are dropped.
* Similar pairs by sketches: a set becomes a row of bits, each the parity of the
  words that hash to it. Two rows differ in no more bits than the sets in words,
  which bounds the shared words from above, so no similar pair is missed. Sets
  are dealt into pieces by list and size, pieces of sizes that can be similar
  meet pair by pair, and what the bound leaves is verified by its whole sets.
* Sweeps come first, so that a group of near copies costs a row a copy and not
  a pair: of each chunk, only the first before it that the bound leaves is kept.
  A chunk with none stays; one that is similar to a chunk that stays goes.
* Rounds then settle the pairs that are left: a chunk that is second in no pair
  stays, what it is similar to goes, with its pairs. A round settles at least
  the first chunk of every list; the number of rounds is the longest chain of
  chunks that hang on each other.

No list is in one task or row, and every round is cut from its lineage on
shared storage. Shuffles carry sketches, half a byte or so a word, to each piece
that a piece meets, and never pairs that the bound rules out; comparing them is
quadratic in a list's sets of like size, in numpy. ``fold`` is the same over a short list that a search
has bounded, as one expression.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.shared import cut, drop

THRESHOLD = 0.7
SWEEPS = 2
#: Bytes of a piece of sketches: when firsts are sought, and when all pairs are, whose number is then bounded too.
PIECE, SMALL_PIECE = 1 << 21, 1 << 18
#: Bits of a sketch, at most; longer texts have more pairs to verify.
MOST_BITS = 1 << 15
#: Tasks that pieces are dealt to, at most.
MOST_TASKS = 1 << 12


def word_set(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"(?U)\s+"), ""))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger set; 0 where a set is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def _alike(a: Column, b: Column, threshold: float) -> Column:
    """``overlap`` over the threshold; sets whose sizes rule that out are not intersected."""
    near = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b)) > threshold
    return F.when(near, overlap(a, b) > threshold).otherwise(False)


def fold(ranked: DataFrame, *, group: str, rank: str, id: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(group, id, rank) of the chunks that stay; for lists of some tens, each of which is one row."""
    item = F.struct(F.col(rank).alias("rank"), F.col(id).alias("id"), word_set(F.col(text)).alias("words"))
    lists = ranked.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.filter("items", lambda x: F.lit(False))
    kept = F.aggregate("items", none, lambda acc, x: F.when(F.exists(acc, lambda y: _alike(x["words"], y["words"], threshold)), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select(group, F.explode(kept).alias("x")).select(group, F.col("x.id").alias(id), F.col("x.rank").alias(rank))


def _without(df: DataFrame, gone: DataFrame, *at: str) -> DataFrame:
    for c in at:
        df = df.join(gone.select(F.col("n").alias(c)), c, "left_anti")
    return df


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike; only sets in a pair are shuffled."""
    pairs = cut(pairs)
    named = cut(pairs.select(F.col("a").alias("n")).unionByName(pairs.select(F.col("b").alias("n"))).distinct())
    some = cut(sets.select("n", "words").join(named, "n", "left_semi"))
    of = lambda c: some.select(F.col("n").alias(c), F.col("words").alias(f"w{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    out = cut(both.where(_alike(F.col("wa"), F.col("wb"), threshold)).select("a", "b"))
    drop(pairs, named, some)
    return out


@F.arrow_udf(T.BinaryType())
def _sketch(hashes: pa.Array, bits: pa.Array) -> pa.Array:
    """``bits`` parities of each list of hashes, a power of 2 and at least 64."""
    at, flat, width = hashes.offsets.to_numpy(), hashes.values.to_numpy(), bits.to_numpy().astype(np.int64)
    parts, step = [], 1024
    for i in range(0, len(width), step):
        w, ends = width[i : i + step], at[i : i + step + 1]
        start = np.concatenate([[0], np.cumsum(w)])
        owner = np.repeat(np.arange(len(w)), np.diff(ends))
        place = start[owner] + (flat[ends[0] : ends[-1]] & (w[owner] - 1))
        rows = np.packbits((np.bincount(place, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little")
        parts += [pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(rows)])]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def _unpacked(sketches: pa.ChunkedArray) -> np.ndarray:
    raw = sketches.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.uint64).reshape(len(raw), -1) if raw else np.zeros((0, 1), np.uint64)


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


def _near(left: np.ndarray, ls: np.ndarray, right: np.ndarray, rs: np.ndarray, threshold: float, high: int = 32, wide: int = 4096):
    """(i, j) arrays of rows whose sketches let the sets be alike; both sides are in order of their sizes ``ls`` and ``rs``."""
    columns = np.ascontiguousarray(right.T)
    for i in range(0, len(left), high):
        rows, size = left[i : i + high], ls[i : i + high]
        lo, hi = np.searchsorted(rs, size[0] * threshold - 1e-6), np.searchsorted(rs, size[-1] / threshold + 1e-6, "right")
        for j in range(lo, hi, wide):
            end = min(j + wide, hi)
            apart = np.zeros((len(rows), end - j), np.uint16)
            for k in range(rows.shape[1]):
                apart += np.bitwise_count(rows[:, k, None] ^ columns[None, k, j:end])
            a, b = size[:, None], rs[None, j:end]
            x, y = np.nonzero(apart <= a + b - 2 * threshold * np.maximum(a, b) + 1e-6)
            if len(x):
                yield x + i, y + j


def _meet(threshold: float, first: bool):
    """Of two pieces, or one with itself: pairs (a, b), a before an open b, that sketches leave; of each b the first alone if ``first``."""

    def run(both: pa.Table) -> pa.Table:
        both = both.sort_by("size")
        right = both.filter(both["second"])
        own = right.num_rows == 0
        left = both.filter(pc.invert(both["second"]))
        right = left if own else right
        ns, opens, sizes = ([t.column(c).to_numpy() for t in (left, right)] for c in ("n", "open", "size"))
        l, r = _unpacked(left.column("sketch")), _unpacked(right.column("sketch"))
        width = min(l.shape[1], r.shape[1])
        firsts = [np.full(len(n), np.iinfo(np.int64).max) for n in ns]
        found = []
        for x, y in _near(_folded(l, width), sizes[0], _folded(r, width), sizes[1], threshold):
            p, q = ns[0][x], ns[1][y]
            for earlier, later, place, k in ((p, q, y, 1), (q, p, x, 0)):
                if own and k == 0:
                    continue  # the other order comes up by itself
                ok = (earlier < later) & opens[k][place]
                if first:
                    np.minimum.at(firsts[k], place[ok], earlier[ok])
                else:
                    found.append((earlier[ok], later[ok]))
        if first:
            for n, f in zip(ns, firsts, strict=True):
                some = f < np.iinfo(np.int64).max
                found.append((f[some], n[some]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        return pa.table({"a": a, "b": b})

    return run


def _candidates(pool: DataFrame, threshold: float, first: bool) -> DataFrame:
    """(a, b): the sets before each open set of ``pool`` that may be similar to it, or the first of them alone."""
    spark = pool.sparkSession
    most = PIECE if first else SMALL_PIECE
    bytes_ = F.sum(F.length("sketch") + 32)
    cell = cut(pool.groupBy("g", "open", "band").agg(F.ceil(bytes_ / most).cast("int").alias("pieces"), bytes_.alias("bytes")))
    part = cell.select("g", "open", "band", (F.col("bytes") / F.col("pieces")).alias("bytes"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    at = lambda c: part.select(F.col("g").alias(f"g{c}"), F.struct("open", "band", "piece").alias(c), F.col("bytes").alias(f"bytes_{c}"))
    x, y = at("x"), at("y")
    can = (F.col("x.open") | F.col("y.open")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1) & (F.col("x") <= F.col("y"))
    meets = cut(x.join(y, F.col("gx").eqNullSafe(F.col("gy")) & can).select("gx", "x", "y", (F.col("bytes_x") * F.col("bytes_y")).alias("work")).withColumn("meet", F.monotonically_increasing_id()))
    work = meets.agg(F.sum("work")).first()[0] or 0.0  # one row
    tasks = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, math.ceil(work / PIECE**2)))
    dealt = pool.join(cell.withColumnRenamed("g", "g_"), F.col("g").eqNullSafe(F.col("g_")) & (pool["open"] == cell["open"]) & (pool["band"] == cell["band"]))
    dealt = dealt.select("g", F.struct(pool["open"], pool["band"], F.pmod(F.xxhash64("n"), F.col("pieces")).cast("int").alias("piece")).alias("at"), "n", "size", "sketch")

    asked = F.array(F.struct(F.col("x").alias("at"), F.lit(False).alias("second")), F.struct(F.col("y").alias("at"), F.lit(True).alias("second")))
    asks = meets.select("meet", F.col("gx").alias("g_"), F.explode(F.when(F.col("x") == F.col("y"), F.slice(asked, 1, 1)).otherwise(asked)).alias("ask"))
    sent = dealt.join(asks, F.col("g").eqNullSafe(F.col("g_")) & (F.col("at") == F.col("ask.at")))
    sent = sent.select("meet", "n", "size", F.col("at.open").alias("open"), F.col("ask.second").alias("second"), "sketch").repartition(tasks, "meet")
    met = sent.groupBy("meet").applyInArrow(_meet(threshold, first), "a long, b long")
    return met.groupBy("b").agg(F.min("a").alias("a")) if first else met


def greedy(ranked: DataFrame, *, group: str, rank: str, id: str, text: str, threshold: float = THRESHOLD, sweeps: int = SWEEPS) -> DataFrame:
    """(group, id, rank) of the chunks that stay. Null groups are one list; equal rank and id: by a hash of the words."""
    words = F.coalesce(F.sort_array(word_set(F.col(text))), F.array().cast("array<string>"))
    rows = ranked.select(F.col(group).alias("g"), F.col(rank).alias("rank"), F.col(id).alias("id"), words.alias("words"))
    empty = rows.where(F.size("words") == 0).select("g", "id", "rank")
    # o is the place in the list; n names a set, and is in the order of places
    o = F.struct("rank", "id", F.xxhash64("words").alias("h"))
    sets = rows.where(F.size("words") > 0).groupBy("g", "words").agg(F.min(o).alias("o"))
    sets = cut(sets.orderBy("g", "o").withColumn("n", F.monotonically_increasing_id()))

    # sizes whose ratio is over the threshold are in one band or in neighbours
    step = -math.log(threshold)
    band = F.floor(F.log(F.size("words").cast("double")) / step).cast("int")
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(64), F.pow(F.lit(2.0), F.ceil(F.log2(4 * F.exp((F.col("band") + 1) * step)))))).cast("int")
    pool = sets.select("n", "g", F.size("words").alias("size"), band.alias("band"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    pool = cut(pool.select("n", "g", "size", "band", _sketch("hashes", bits).alias("sketch"), F.lit(True).alias("open")))
    gone = None
    for _ in range(sweeps):
        firsts = cut(_candidates(pool, threshold, first=True))
        sure = cut(pool.where("open").select("n").join(firsts.select(F.col("b").alias("n")), "n", "left_anti"))
        stay = sure.unionByName(pool.where("not open").select("n"))
        out = cut(_similar(firsts.join(stay.select(F.col("n").alias("a")), "a").select("a", "b"), sets, threshold).select(F.col("b").alias("n")))
        gone = out if gone is None else gone.unionByName(out)
        known = sure.withColumn("sure", F.lit(True))
        last, pool = pool, cut(_without(pool, out, "n").join(known, "n", "left").withColumn("open", F.col("open") & F.col("sure").isNull()).drop("sure"))
        drop(last, firsts, sure)
    edges = _similar(_candidates(pool, threshold, first=False), sets, threshold)
    while not edges.isEmpty():
        stays = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
        out = cut(edges.join(stays, "a").select(F.col("b").alias("n")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        last, edges = edges, cut(_without(edges, out, "a", "b"))
        drop(last)
    kept = sets if gone is None else _without(sets, gone, "n")
    left = kept.select("g", F.col("o.id").alias("id"), F.col("o.rank").alias("rank")).unionByName(empty)
    return left.select(F.col("g").alias(group), F.col("id").alias(id), F.col("rank").alias(rank))
