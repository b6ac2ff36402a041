"""Pieces that several training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII whitespace that separates words: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
#: Hash buckets of a distributed ranking. A ranking task holds about rows/1024
#: of one group, however hot the group is.
RANK_BUCKETS = 1024
#: Edges (16 bytes each) whose components one task may find.
SMALL_GRAPH = 1_000_000

_OWN: dict[str, str] = {}
#: Folders staged inside each open ``scope``, innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, where one machine is everything, may go without the
    setting; it gets a temporary folder that is removed at exit.
    """
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not conf.get("spark.master", "").startswith(("local[", "local")) or conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="scriptorium-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str, result: bool = False, free: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage on storage that outlives any executor, and fixes
    values such as ``monotonically_increasing_id`` for all later readers.
    ``free`` lets the shuffle files of the plan behind it go at once, which
    costs a collection of the driver's garbage.
    The folder goes with the innermost ``scope`` (a ``result`` with
    the one around it), or else with the application.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/scriptorium-{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _path(spark, top)
    fs.deleteOnExit(at)
    if len(_SCOPES) > result:
        _SCOPES[-1 - result].append(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the folder of a staged frame that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        at, fs = _path(df.sparkSession, file)
        fs.delete(at.getParent(), True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what operators staged inside, so write their results before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at, fs = _path(spark, path)
            fs.delete(at, True)


def counted(df: DataFrame, free: bool = True) -> DataFrame:
    """Stage an aggregate that is about to be joined back to what it was made from.

    Joined directly, both sides would keep the aggregate's partitioning, and
    adaptive execution could not split the partition of a hot key.
    """
    return stage(df, "counted", free=free)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Runs of non-space characters of a text, as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str, bucket: Column | None = None) -> DataFrame:
    """Add ``rank``: 0, 1, ... within each ``group``, without one task per group.

    Rows of a group are dealt into hash buckets of the ``order`` columns and
    ranked by (bucket, order). Only (group, bucket) pairs form a window;
    bucket offsets come from a pre-aggregated table of at most
    ``RANK_BUCKETS`` rows a group. ``group`` columns must not be null.
    ``bucket``: 0 .. RANK_BUCKETS - 1, rising with ``order`` if ranks have to follow it.
    """
    b, start = fresh(df, "bucket", "start")
    # dealt by bucket here, or Spark would keep a partitioning by group that df may have
    bucket = F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)) if bucket is None else bucket
    df = df.withColumn(b, bucket.cast("int")).repartition(*group, b)
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias(start)).withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    inside = Window.partitionBy(*group, b).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(inside) - 1).join(starts, [*group, b])
    return out.withColumn(rank, (F.col(rank) + F.col(start)).cast("long")).drop(b, start)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of a partition: hooking to least labels and pointer jumping."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
    cuts = np.cumsum([0, *[len(x) for p in parts for x in p]])
    ends = [at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    u, v = np.concatenate(ends[::2]), np.concatenate(ends[1::2])
    label = np.arange(len(nodes))
    while True:
        x, y = label[u], label[v]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL_GRAPH) -> DataFrame:
    """(node, root) of every node in ``edges``; root is the least node reachable.

    Up to ``small`` distinct edges, counted first, are joined up in one task of
    bounded size. More take alternating large-star and small-star rounds: each
    takes the least neighbour of every node with a pre-aggregated min and joins
    it back, so a node with very many links costs no task more than its share.
    Every round is staged on shared storage; rounds end when one changes
    nothing. Both ways are exact.
    """
    now = stage(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u <> v").distinct(), "edges")
    if now.count() <= small:
        return stage(now.coalesce(1).mapInArrow(_joined, "node long, root long"), "roots")
    seen = None
    while True:
        # large-star: larger neighbours of each node point to its least neighbour
        both = now.select(F.explode(F.array(F.struct(F.col("v").alias("n"), F.col("u").alias("m")), F.struct(F.col("u").alias("n"), F.col("v").alias("m")))).alias("e")).select("e.*")
        least = counted(both.groupBy("n").agg(F.min("m").alias("r")).withColumn("r", F.least("r", "n")))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("v"), F.col("r").alias("u"))
        before, large = now, stage(large.unionByName(least.where("n > r").select(F.col("n").alias("v"), F.col("r").alias("u"))).where("u <> v"), "edges")
        # small-star: smaller neighbours of each node, and it, point to the least of them
        low = counted(large.groupBy("v").agg(F.min("u").alias("r")))
        less = large.join(low, "v").select(F.col("u").alias("v"), F.col("r").alias("u")).where("u <> v")
        now = stage(less.unionByName(low.select("v", F.col("r").alias("u"))).distinct(), "edges")
        for done in (before, least, large, low):
            unstage(done)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


__all__ = ["SPACE", "components", "counted", "fresh", "ranked", "scope", "shared_dir", "stage", "unstage", "words"]
