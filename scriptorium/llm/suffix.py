"""Suffix-array dedup: 200-byte strings that start anywhere else are removed.

1. Contexts of minimizers (see ``repeats``) route: a minimizer that occurs once
   holds no repeated string and goes no further; of every other, each distinct
   context is sent once, and once more from another place if it occurs there.
   What a context's suffixes decide holds for its copies, wherever they stand
   (equal context hashes, 64 bits).
2. The bytes of those contexts are dealt to shards of about ``SHARD`` bytes by
   minimizer, so equal strings meet in one shard. A shard that is too large (a
   very hot minimizer) is dealt further into parts.
3. Each part builds its suffix array by Larsson-Sadakane refinement (ranks by
   8 bytes, doubled; only groups that are not yet single are sorted again) and
   its common prefixes by Kasai's rule in permuted order: a position whose
   left neighbour also matches has one less than that neighbour, and only the
   others are compared. A string is repeated if it shares 200 bytes with a
   neighbour in suffix order: nothing else has a string removed.
4. Parts of one shard are merged by binary search: each open string of a part
   is looked up in the sorted strings of every other part.

A task holds one part, or two in step 4. The text itself is shuffled to meet
its intervals and nowhere collected.

Defined results: a null text is empty; texts under 200 bytes are kept whole;
matches never cross documents; strings are judged on the input, not on what is
left; equal rows (same id and text) repeat each other; what is left may cut a
multi-byte character, so it is returned as bytes; an empty table gives an
empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import counted, fresh, stage
from scriptorium.llm.repeats import byte_symbols, covered, keyed, occurrences, recurring

K = 200
#: Bytes of a minimizer.
M = 32
#: Bytes of text in a shard, about: ranks then stay in a core's cache. A shard over PART bytes is dealt into parts.
SHARD, PART = 1 << 17, 2 << 20
#: Most tasks that sort parts.
MOST_TASKS = 20_000


def octets(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number that sorts as they do; zeros after the end."""
    padded = np.concatenate((t, np.zeros(8, dtype=np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(t)].copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(t: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of ``t`` in the order of their suffixes; a shorter one first.

    Larsson-Sadakane refinement: ranks by 8 bytes, then by three ranks at a
    time where three fit into 64 bits, else two; only groups that are not yet
    single are sorted again.
    """
    n = len(t)
    order = np.argsort(keys)
    found = keys[order]
    same = found[1:] == found[:-1]
    # the last bytes are told apart from real zeros by their rank, which counts what is left
    ends = keys[max(0, n - 7) :]
    if (np.searchsorted(found, ends, "right") - np.searchsorted(found, ends) > 1).any():
        order = order[np.lexsort((np.minimum(n - order, 8), found))]
        tail = np.minimum(n - order, 8)
        same &= tail[1:] == tail[:-1]
    rank = np.zeros(n + 1, dtype=np.int32)
    start = np.flatnonzero(np.concatenate(([True], ~same)))
    size = np.diff(np.append(start, n))
    rank[order] = np.repeat(start, size) + 1  # rank 0: beyond the end
    slots = np.flatnonzero(np.repeat(size, size) > 1)
    h, bits = 8, (n + 1).bit_length()
    steps = 2 if 3 * bits <= 64 else 1
    while len(slots):
        at = order[slots]
        key = rank[at].astype(np.uint64)
        for step in range(1, steps + 1):
            key = (key << np.uint64(bits)) | rank[np.minimum(at + step * h, n)].astype(np.uint64)
        new = np.argsort(key)
        order[slots] = at = at[new]
        key = key[new]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(at)))
        rank[at] = np.repeat(slots[start], size) + 1
        slots = slots[np.repeat(size, size) > 1]
        h *= steps + 1
    return order


def common_prefixes(t: np.ndarray, keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each rank but the first, the common prefix with the suffix before it; Kasai's rule in permuted order."""
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    left = np.full(n, -1, dtype=np.int64)
    left[1:] = t[:-1]
    other = np.where(before > 0, left[np.maximum(before, 0)], -2)
    own = np.flatnonzero((left != other) | (i == 0) | (before < 0))
    own = own[before[own] >= 0]
    length = np.zeros(n, dtype=np.int64)
    at, to, done = own, before[own], np.zeros(len(own), dtype=np.int64)
    active = np.arange(len(own))
    while len(active):
        a, b = at[active] + done[active], to[active] + done[active]
        inside = np.maximum(a, b) + 8 <= n
        differ = np.zeros(len(active), dtype=np.uint64)
        differ[inside] = keys[a[inside]] ^ keys[b[inside]]
        step = np.full(len(active), 8)
        # the first differing byte is the highest set bit
        some = differ != 0
        step[some] = (63 - np.floor(np.log2(differ[some].astype(np.float64))).clip(0, 63).astype(np.int64)) // 8
        for k in np.flatnonzero(~inside):
            x, y, m = a[k], b[k], n - max(a[k], b[k])
            eq = t[x : x + m] == t[y : y + m]
            step[k] = m if eq.all() else int(np.argmin(eq))
        done[active] += step
        active = active[inside & (step == 8) & ~some]
    first = np.zeros(n, dtype=bool)
    first[own] = True
    first |= before < 0
    length[own] = done
    last = np.maximum.accumulate(np.where(first, i, 0))
    permuted = length[last] - (i - last)
    return permuted[order[1:]]


def _part(table: pa.Table, k: int) -> dict:
    """Text, key words, suffix array and windows of one part."""
    segs = table.column("seg").to_pylist()
    size = np.array([len(x) for x in segs], dtype=np.int64)
    t = np.frombuffer(b"\xff".join(segs), dtype=np.uint8)  # never in UTF-8
    begin = np.cumsum(np.concatenate(([0], size[:-1] + 1)))
    keys = octets(t)
    order = suffix_array(t, keys)
    valid = np.zeros(len(t), dtype=bool)
    for b, z in zip(begin, size, strict=True):
        valid[b : b + z - k + 1] = True
    shared = common_prefixes(t, keys, order) >= k
    repeated = np.zeros(len(t), dtype=bool)
    repeated[order[1:][shared]] = True
    repeated[order[:-1][shared]] = True
    open_ = np.repeat(np.array(table.column("open").to_pylist(), dtype=bool), np.append(size[:-1] + 1, size[-1])) & valid
    return {"t": t, "begin": begin, "order": order[valid[order]], "found": np.flatnonzero(open_ & repeated), "left": np.flatnonzero(open_ & ~repeated)}


def _compare(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """-1, 0 or 1 for the k bytes at i against those at j; a and b are key words by position."""
    out, active = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
    for d in [*range(0, k - 7, 8), k - 8]:
        x, y = a[i[active] + d], b[j[active] + d]
        out[active] = np.where(x < y, -1, np.where(x > y, 1, 0))
        active = active[x == y]
        if not len(active):
            break
    return out


def looked_up(t: np.ndarray, at: np.ndarray, other: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Mask of the strings of ``t`` at ``at`` that are among the sorted strings ``order`` of ``other``; binary search."""
    a, b = octets(t), octets(other)
    low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(order), dtype=np.int64)
    while (open_ := low < high).any():
        w = np.flatnonzero(open_)
        mid = (low[w] + high[w]) // 2
        more = _compare(a, at[w], b, order[mid], k) > 0
        low[w] = np.where(more, mid + 1, low[w])
        high[w] = np.where(more, high[w], mid)
    out = np.zeros(len(at), dtype=bool)
    ok = np.flatnonzero(low < len(order))
    out[ok] = _compare(a, at[ok], b, order[low[ok]], k) == 0
    return out


_RUN = "mh long, ch long, first int, n int"
_FOUND = f"shard long, part int, {_RUN}, t binary, sorted binary, left binary, begin binary, mhs binary, chs binary"


def _runs(at: np.ndarray, begin: np.ndarray, mh: np.ndarray, ch: np.ndarray) -> dict[str, np.ndarray]:
    """Starts of strings in a part, in order, as runs (first, n) within their context."""
    seg = np.searchsorted(begin, at, "right") - 1
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(seg) != 0)))) if len(at) else np.zeros(0, dtype=np.int64)
    own = seg[edge]
    return {"mh": mh[own], "ch": ch[own], "first": (at[edge] - begin[own]).astype(np.int32), "n": np.diff(np.append(edge, len(at))).astype(np.int32)}


def _sorted_part(table: pa.Table, k: int) -> pa.Table:
    x = _part(table, k)
    mh, ch = (table.column(c).to_numpy() for c in ("mh", "ch"))
    rows = {c: v.tolist() for c, v in _runs(x["found"], x["begin"], mh, ch).items()}
    shard, part, parts = (table.column(c)[0].as_py() for c in ("shard", "part", "parts"))
    n = len(rows["mh"])
    cols = {"shard": [shard] * n, "part": [part] * n, **rows}
    blobs = {c: [None] * n for c in ("t", "sorted", "left", "begin", "mhs", "chs")}
    if parts > 1:
        cols = {c: [*v, {"shard": shard, "part": part}.get(c)] for c, v in cols.items()}
        for c, v in (("t", x["t"]), ("sorted", x["order"].astype(np.int32)), ("left", x["left"].astype(np.int32)), ("begin", x["begin"].astype(np.int32)), ("mhs", mh.astype(np.int64)), ("chs", ch.astype(np.int64))):
            blobs[c].append(v.tobytes())
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("mh", pa.int64()), ("ch", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in blobs]])
    return pa.table(cols | blobs, schema=schema)


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of parts: the left strings of one, looked up in the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c, kind: np.frombuffer(batch.column(batch.schema.get_field_index(c))[i].as_py(), dtype=kind)  # noqa: B023, E731
            left = get("left", np.int32).astype(np.int64)
            hit = left[looked_up(get("t", np.uint8), left, get("t2", np.uint8), get("sorted2", np.int32).astype(np.int64), k)]
            rows = _runs(hit, get("begin", np.int32).astype(np.int64), get("mhs", np.int64), get("chs", np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in rows.values()], names=list(rows))


def _segments(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that are sent."""
    for batch in batches:
        raw, spots = (batch.column(batch.schema.get_field_index(c)) for c in ("raw", "spots"))
        out, size = [], 0
        for i, found in enumerate(spots.to_pylist()):
            text = raw[i].as_py()
            for x in found:
                out.append((x["mh"], x["ch"], x["open"], text[x["s"] : x["s"] + x["n"] + k - 1]))
                size += len(out[-1][-1])
            if out and (size > 4 << 20 or i == len(spots) - 1):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["mh", "ch", "open", "seg"])
                out, size = [], 0


def _kept(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest, raw, runs = (batch.column(batch.schema.get_field_index(c)) for c in ("rest", "raw", "runs"))
        for i in range(batch.num_rows):  # a row at a time: no second copy of a batch of texts
            text, got = raw[i].as_py(), runs[i].as_py()
            cut = []
            kept = text
            if got:
                gone = covered([(x["first"], x["n"]) for x in got], k, len(text))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
                cut = [{"first": a, "after": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            yield pa.RecordBatch.from_arrays([rest.slice(i, 1), pa.array([kept], pa.binary()), pa.array([len(text)], pa.int64()), pa.array([len(text) - len(kept)], pa.int64()), pa.array([cut], pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())])))], names=["rest", "kept", "n_bytes", "n_removed", "removed"])


def repeated_strings(segments: DataFrame, k: int) -> DataFrame:
    """(mh, ch, first, n), staged: runs of the open strings of staged ``segments`` that occur elsewhere among them."""
    total = segments.agg(F.coalesce(F.sum(F.octet_length("seg")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD))
    dealt = segments.withColumn("shard", F.pmod("mh", F.lit(shards)))
    sizes = counted(dealt.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("seg") + 1) / PART).cast("int").alias("parts")))
    dealt = dealt.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("ch", "open"), F.col("parts")).cast("int"))
    # little data, much work: dealt by number, or adaptive execution would put it into a few tasks by its bytes
    dealt = dealt.repartition(max(1, min(total // PART, MOST_TASKS)), "shard", "part")
    done = stage(dealt.groupBy("shard", "part").applyInArrow(lambda t: _sorted_part(t, k), _FOUND), "suffixes")
    blobs = done.where("t is not null")
    other = blobs.select("shard", F.col("part").alias("part2"), F.col("t").alias("t2"), F.col("sorted").alias("sorted2"))
    pairs = blobs.join(other, "shard").where("part <> part2").select("t", "left", "begin", "mhs", "chs", "t2", "sorted2")
    cross = pairs.mapInArrow(lambda b: _merged(b, k), _RUN)
    return stage(done.where("mh is not null").select("mh", "ch", "first", "n").unionByName(cross), "runs")


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """``docs`` with ``text`` cut to the kept bytes, ``n_bytes``, ``n_removed`` and the ``removed`` byte intervals.

    New names that clash get underscores in front.
    """
    rows = keyed(docs, id, text)
    same = recurring(occurrences(rows, byte_symbols, k, m))
    at = F.struct("ka", "kb", "s", "n")
    each = counted(same.groupBy("mh", "ch").agg(F.min(at).alias("one"), F.max(at).alias("other")))
    sent = F.array_distinct(F.array(F.struct("one.*", F.lit(True).alias("open")), F.struct("other.*", (F.col("one") == F.col("other")).alias("open"))))
    spots = each.select("mh", "ch", F.explode(sent).alias("x")).groupBy("x.ka", "x.kb").agg(F.collect_list(F.struct("x.s", "x.n", "x.open", "mh", "ch")).alias("spots"))
    held = rows.select("ka", "kb", "raw").join(counted(spots), ["ka", "kb"])
    segments = stage(held.mapInArrow(lambda b: _segments(b, k), "mh long, ch long, open boolean, seg binary"), "segments")
    found = same.join(repeated_strings(segments, k).withColumnRenamed("n", "many"), ["mh", "ch"])
    runs = found.select("ka", "kb", F.struct((F.col("s") + F.col("first")).alias("first"), F.col("many").alias("n")).alias("run")).groupBy("ka", "kb").agg(F.collect_set("run").alias("runs"))
    whole = rows.join(counted(runs), ["ka", "kb"], "left")
    schema = T.StructType([rows.schema["rest"], T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType())])))])
    out = whole.mapInArrow(lambda b: _kept(b, k), schema)
    names = fresh(docs, "n_bytes", "n_removed", "removed")
    own = [F.col("kept").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns]
    return out.select(*own, *[F.col(c).alias(x) for c, x in zip(("n_bytes", "n_removed", "removed"), names, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
