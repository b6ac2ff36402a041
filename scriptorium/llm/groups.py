"""Comparing the members of candidate groups without ever holding a whole group.

A group is dealt into parts of a bounded count and weight; every two parts of a
group meet in a task of their own, and a task returns a spanning forest of the
pairs that it finds, never the pairs. Small groups share tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a part, and bytes of a part. A group of c members is sent c / PART times.
PART, PART_BYTES = 1024, 4 << 20
#: Members of small groups that share a task, about.
BIN = 256
#: Members of groups that a ``small`` function compares all at once.
SMALL = 16
#: Members a task, about, and most tasks.
TASK, MOST_TASKS = 2048, 20_000


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _forests(table: pa.Table, what: Callable, small: Callable | None) -> pa.Table:
    """Spanning forests of the pairs that ``what`` finds, for every (group, parts) in the table."""
    first = pc.not_equal(table["part"], table["a"])  # the first part's members come first
    table = table.drop_columns("gid").append_column("late", first).sort_by([(c, "ascending") for c in ("root", "space", "a", "b", "late", "sid")])
    keys = [table[c].to_numpy() for c in ("root", "space", "a", "b")]
    cuts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0), [True]))).tolist()
    two_parts, late = keys[2] != keys[3], table["late"].to_numpy()
    columns = {c: table[c].to_pylist() for c in table.column_names if c not in ("root", "space", "a", "b", "part", "late")}
    out = []
    if small is not None:
        size = np.diff(cuts)
        few = (size <= SMALL) & (size > 1) & ~two_parts[cuts[:-1]]
        rows = np.flatnonzero(np.repeat(few, size))
        group = np.repeat(np.arange(len(size)), size)[rows]
        arrays = {c: table[c].to_numpy()[rows] for c in columns}
        # a pair is joined by the nearest rows first, and rows that are joined already are left out
        forest, sid = Forest(len(rows)), arrays["sid"]
        out += [(int(sid[i]), int(sid[j])) for i, j in zip(*(x.tolist() for x in small(arrays, group)), strict=True) if forest.join(i, j)] if len(rows) else []
        cuts = [(a, b) for a, b, f in zip(cuts[:-1], cuts[1:], few, strict=True) if not f]
    else:
        cuts = list(zip(cuts[:-1], cuts[1:], strict=True))
    for at, end in cuts:
        left = int((~late[at:end]).sum()) if two_parts[at] else 0
        if end - at > 1 and left < end - at:
            group = {c: v[at:end] for c, v in columns.items()}
            forest, sid = Forest(end - at), group["sid"]
            for i, js in what(group, left):
                out += [(sid[i], sid[j]) for j in js.tolist() if forest.join(i, j)]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def in_parts(members: DataFrame, weight: Column, what: Callable, count: str | None = None, total: int | None = None, small: Callable | None = None) -> DataFrame:
    """Edges (a, b) that ``what`` finds in groups of ``members`` (root, space, sid, ...), part against part.

    Small groups share a task; a group of more than a part is dealt into parts
    by hash, and every two parts meet in a task of their own. A group's size
    and weight are counted first, unless ``count`` names a column that has the
    size already and all members of a group weigh the same; ``total`` is how
    many members there are, if that is known. ``small``, if there is one,
    compares groups of up to SMALL members, many at once: of their columns and
    a group number a row it makes the pairs of rows (i < j) that are linked.
    """
    if count:
        rows = members.withColumn("parts", F.greatest(F.ceil(F.col(count) / PART), F.ceil(F.col(count) * weight / PART_BYTES)).cast("int")).drop(count)
    else:
        size = members.groupBy("root", "space").agg(F.count(F.lit(1)).alias("c"), F.sum(weight).alias("w"))
        size = size.where("c > 1").select("root", "space", F.greatest(F.ceil(F.col("c") / PART), F.ceil(F.col("w") / PART_BYTES)).cast("int").alias("parts"))
        rows = members.join(size, ["root", "space"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("a", F.least("part", "to")).withColumn("b", F.greatest("part", "to"))
    total = members.count() if total is None else total
    bins = max(1, total // BIN)
    gid = F.when(F.col("parts") == 1, F.xxhash64("root", "space") % bins).otherwise(F.xxhash64("root", "space", "a", "b"))
    extra = [c for c in members.columns if c not in ("root", "space", "sid", count)]
    rows = rows.select(gid.alias("gid"), "root", "space", "a", "b", "part", "sid", *extra)
    # little data, much work: dealt by number, or adaptive execution would put it into a few tasks by its bytes
    rows = rows.repartition(max(1, min(MOST_TASKS, total // TASK)), "gid")
    return rows.groupBy("gid").applyInArrow(lambda t: _forests(t, what, small), "a long, b long")
