"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes. Every
shingle toggles one bit of a long sketch (XOR), so the Hamming distance of two
sketches is at most the symmetric difference of the sets. Two sets of n1 <= n2
with Jaccard >= t differ in at most D = (n1 + n2) (1 - t) / (1 + t) shingles.

1. Size bands: band t has sets of [lo, 1.5 lo). A pair is found in the space
   of its smaller set; a set belongs to the space of its own band, and to that
   of the band of its least partner if this is another.
2. Pigeonhole: a space splits sketches into B = D + 1 + E blocks, so a pair
   agrees on E + 1 blocks or more. A block's bits are sent as a 64-bit key (XOR of
   the codes of its toggled bits). Empty blocks say nothing and are not sent,
   unless a set has more than E of them; so a pair still shares a key.
3. Sets that share a key are compared by folded sketches, in parts of a bounded
   size, each part against each (``groups``). A key that only common passages
   made links nothing, as unlike sets' sketches are far apart.
4. Pairs whose Hamming distance is at most D give candidate groups; each part
   returns a spanning forest of them, not the pairs.
5. In groups, exact intersections (a product of 0/1 matrices) decide links.
   Each block returns a spanning forest of its links, not the pairs.
6. Connected components join the forests.

Copies are one set from step 1 on: they share a key of the whole set. No group
is ever one task; steps 3 and 5 see two parts at a time. Sets are told apart by
64-bit hashes (chance of any clash among 10^8 sets: 0.0003).

Defined results: a null, empty or blank text has an empty set and is linked
with nothing; a text of fewer words than a shingle has its whole sequence as
one; repeated rows are linked as copies; ids may repeat (equal id and text is
one document); a null id names no component unless it is alone; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import components, counted, fresh, stage
from scriptorium.llm.groups import in_parts
from scriptorium.llm.repeats import grouped, mix, prefix, ranges, word_symbols

WIDTH, PERCENT = 4, 85
_TOP = 1 << 40


class Bands:
    """Size bands and, for each space: blocks, allowed empty blocks and words of the folded sketch."""

    def __init__(self, percent: int):
        self.percent = percent
        lo = [1]
        while lo[-1] < _TOP:
            lo.append(max(lo[-1] + 1, lo[-1] * 3 // 2))
        self.lo = np.array(lo, dtype=np.int64)
        top = np.array([x - 1 for x in lo[1:]] + [_TOP * 2], dtype=np.int64)
        most = self.differ(top, top * 100 // percent)
        # empty blocks: at most e^(-n/B) of them at the foot of the band, and four deviations
        base = most + 1.0
        empty = base * np.exp(-self.lo / base)
        self.empty = np.where(most == 0, 0, np.ceil(empty + 4 * np.sqrt(empty))).astype(np.int64)
        self.blocks = most + 1 + self.empty
        self.words = np.maximum(2, (top + 63) // 64)  # a bit a shingle, or more

    def differ(self, a, b):
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, n, "right") - 1


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted; A-Z lower-cased."""
    sym, count = word_symbols([t.lower() for t in texts])
    p, first = prefix(sym), np.cumsum(count) - count
    n = np.maximum(count - width + 1, 0)
    short = np.flatnonzero((count > 0) & (count < width))
    doc = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    h = mix(ranges(p, at, width) + np.uint64(width))
    if len(short):
        doc = np.concatenate((doc, short))
        h = np.concatenate((h, mix(ranges(p, first[short], count[short]) + count[short].astype(np.uint64))))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _space(doc: np.ndarray, h: np.ndarray, n: np.ndarray, space: np.ndarray, bands: Bands) -> tuple[list[np.ndarray], list[bytes]]:
    """Block keys and folded sketch of every document (doc: 0, 1, ... sorted) in its space."""
    b = bands.blocks[space].astype(np.uint64)
    block = ((h >> np.uint64(32)) * b[doc]) >> np.uint64(32)  # rises with h: blocks are runs
    edge = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1]))))
    code = mix(h + np.uint64(0x5851F42D4C957F2D))
    value = np.bitwise_xor.reduceat(code, edge)
    place = mix((space[doc[edge]].astype(np.uint64) << np.uint64(40)) + block[edge] + np.uint64(1))
    keys, owner = mix(value ^ place), doc[edge]
    ends = np.searchsorted(owner, np.arange(len(n) + 1))
    out = [keys[ends[i] : ends[i + 1]] for i in range(len(n))]
    for i in np.flatnonzero(bands.blocks[space] - np.diff(ends) > bands.empty[space]):
        none = np.setdiff1d(np.arange(bands.blocks[space[i]]), block[edge[ends[i] : ends[i + 1]]].astype(np.int64))
        out[i] = np.concatenate((out[i], mix(~mix((np.uint64(space[i]) << np.uint64(40)) + none.astype(np.uint64)))))
    words = bands.words[space]
    start = np.cumsum(words) - words
    bit = (code % (words[doc] * 64).astype(np.uint64)).astype(np.int64) + start[doc] * 64
    odd = (np.bincount(bit, minlength=int(words.sum()) * 64) & 1).astype(np.uint8)
    packed = np.packbits(odd).tobytes()
    return out, [packed[8 * s : 8 * (s + w)] for s, w in zip(start, words, strict=True)]


_SKETCH = "ka long, kb long, sid long, n long, own boolean, space int, sketch binary, keys array<long>"


def _sketches(batches: Iterator[pa.RecordBatch], width: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    names = ["ka", "kb", "sid", "n", "own", "space", "sketch", "keys"]
    kind = pa.list_(pa.int64())
    for batch in batches:
        for first, texts in grouped(batch.column(2)):
            ka, kb = batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts))
            doc, h = shingles(texts, width)
            n = np.bincount(doc, minlength=len(texts))
            some = np.flatnonzero(n)
            if len(some) < len(texts):
                none = pa.array(np.flatnonzero(n == 0))
                k = len(none)
                yield pa.RecordBatch.from_arrays([ka.take(none), kb.take(none), pa.nulls(k, pa.int64()), pa.array(np.zeros(k, dtype=np.int64)), pa.array([True] * k), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, kind)], names=names)
            if not len(some):
                continue
            size = n[some]
            doc = np.repeat(np.arange(len(some)), size)
            edge = np.cumsum(size) - size
            sid = mix(np.add.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F)), edge) + size.astype(np.uint64)).view(np.int64)
            own = bands.of(size)
            least = bands.of(-(-size * bands.percent // 100))
            for step in range(int((own - least).max()) + 1):
                pick, is_own = np.flatnonzero(own - step >= least), step == 0
                space = own - step
                renumber = np.full(len(some), -1)
                renumber[pick] = np.arange(len(pick))
                mine = renumber[doc] >= 0
                keys, sketch = _space(renumber[doc[mine]], h[mine], size[pick], space[pick], bands)
                take = pa.array(some[pick])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32))
                flat = pa.array(np.concatenate(keys).view(np.int64))
                yield pa.RecordBatch.from_arrays([ka.take(take), kb.take(take), pa.array(sid[pick]), pa.array(size[pick]), pa.array([is_own] * len(pick)), pa.array(space[pick].astype(np.int32)), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], names=names)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sid, raw = batch.column(batch.schema.get_field_index("sid")), batch.column(batch.schema.get_field_index("raw"))
        for first, texts in grouped(raw):
            doc, h = shingles(texts, width)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([sid.slice(first, len(texts)), pa.array([h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["sid", "hashes"])


def _near(group: dict[str, list], left: int, bands: Bands) -> Iterator[tuple[int, np.ndarray]]:
    """For each i, the j > i whose sketches are within D; pairs of two parts only if ``left`` is the size of the first."""
    m = np.stack([np.frombuffer(x, dtype=np.uint64) for x in group["sketch"]])
    n = np.array(group["n"], dtype=np.int64)
    for i in range(left or len(n) - 1):
        j = np.arange(left or i + 1, len(n))
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        j = j[small * 100 >= large * bands.percent]
        far = np.bitwise_count(m[j] ^ m[i]).sum(axis=1, dtype=np.int64)
        yield i, j[far <= bands.differ(n[i], n[j])]


def _near_pairs(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        size = np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * bands.percent
        most = bands.differ(n1, n2)
        word = lambda c, i: np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint64)  # noqa: B023, E731
        ok = [bool(size[i]) and int(np.bitwise_count(word(4, i) ^ word(5, i)).sum()) <= most[i] for i in range(batch.num_rows)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _linked(group: dict[str, list], left: int, bands: Bands) -> Iterator[tuple[int, np.ndarray]]:
    """For each i, the j > i with Jaccard at or over the threshold; exact."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["hashes"]]
    n = np.array([len(x) for x in sets], dtype=np.int64)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = count[at] > 1
    at, owner = (np.cumsum(count > 1) - 1)[at[shared]], owner[shared]
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    step = 4096
    for first in range(0, int((count > 1).sum()), step):
        a, b = np.searchsorted(at, (first, first + step))
        m = np.zeros((len(sets), step), dtype=np.float32)
        m[owner[a:b], at[a:b] - first] = 1
        both += m @ m.T
    either = n[:, None] + n[None, :] - both
    for i in range(left or len(n) - 1):
        j = np.arange(left or i + 1, len(n))
        yield i, j[both[i, j] * 100 >= either[i, j] * bands.percent]


def linked(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(ka, kb, id, n, component, least): for each (id, text), its set size, the component's id, and whether it is the component's first."""
    bands = Bands(percent)
    rows = docs.select(F.xxhash64(id).alias("ka"), F.xxhash64(text).alias("kb"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    sk = stage(rows.mapInArrow(lambda b: _sketches(b, width, bands), _SKETCH), "sketches")
    # 2: keys of two sets or more
    keys = sk.select("sid", F.explode("keys").alias("key"))
    twice = counted(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    shared = stage(keys.join(twice, "key").distinct(), "shared")
    seen = counted(shared.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("a"), F.max("sid").alias("b"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("same")).where("c > 1"))
    code = stage(sk.where("sid is not null").groupBy("sid", "space").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "codes")
    # 3: most keys have two sets, which are a pair at once, and the same pair from many keys is one
    pairs = seen.where("c = 2").select("a", "b").distinct().join(code.select(F.col("sid").alias("a"), "space", F.col("n").alias("n1"), F.col("sketch").alias("x")), "a")
    pairs = pairs.join(code.select(F.col("sid").alias("b"), "space", F.col("n").alias("n2"), F.col("sketch").alias("y")), ["b", "space"])
    pairs = pairs.select("a", "b", "n1", "n2", "x", "y").mapInArrow(lambda it: _near_pairs(it, bands), "a long, b long")
    # keys with the same sets, as copies have by the dozen, are one
    more = counted(seen.where("c > 2").groupBy("a", "b", "c", "same").agg(F.min("key").alias("key")))
    members = shared.join(more.select(F.col("key"), F.col("c").alias("size")), "key").join(code, "sid").select(F.col("key").alias("root"), "space", "sid", "n", "sketch", "size")
    total = more.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    near = in_parts(members, F.octet_length("sketch"), lambda g, left: _near(g, left, bands), "size", total).unionByName(pairs)
    groups = stage(components(near), "groups")
    # 5: exact; one document of each set gives its text
    named = sk.where("own and sid is not null").join(groups.withColumnRenamed("node", "sid"), "sid").groupBy("sid").agg(F.min(F.struct("ka", "kb")).alias("k")).select("sid", "k.ka", "k.kb")
    sets = rows.join(named, ["ka", "kb"]).select("sid", "raw").mapInArrow(lambda b: _sets(b, width), "sid long, hashes binary")
    sets = stage(sets.groupBy("sid").agg(F.first("hashes").alias("hashes")).join(groups.withColumnRenamed("node", "sid"), "sid").select("root", F.lit(0).alias("space"), "sid", "hashes"), "sets")
    links = components(in_parts(sets, F.octet_length("hashes"), lambda g, left: _linked(g, left, bands))).withColumnRenamed("node", "sid")
    # 6: the least id of each component
    ids = docs.select(F.xxhash64(id).alias("ka"), F.xxhash64(text).alias("kb"), F.col(id).alias("id"))
    all_ = sk.where("own").select("ka", "kb", "sid", "n").distinct().join(ids.distinct(), ["ka", "kb"]).join(links, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    all_ = stage(all_, "members")
    first = counted(all_.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "ka", "kb")).alias("f")))
    return all_.join(first, "root", "left").select("ka", "kb", "id", "n", F.coalesce("f.id", "id").alias("component"), F.coalesce((F.col("f.ka") == F.col("ka")) & (F.col("f.kb") == F.col("kb")), F.lit(True)).alias("least"))


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with its own columns: of every component the document with the least id, once."""
    a, b = fresh(docs, "key_a", "key_b")
    kept = linked(docs, id=id, text=text, **options).where("least").select(F.col("ka").alias(a), F.col("kb").alias(b))
    out = docs.withColumn(a, F.xxhash64(id)).withColumn(b, F.xxhash64(text))
    return out.join(kept, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = linked(docs).select("ka", "kb", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    keyed = docs.select("doc_id", F.xxhash64("doc_id").alias("ka"), F.xxhash64("text").alias("kb"))
    return keyed.join(found, ["ka", "kb"]).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {WIDTH} THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - {WIDTH - 2}), lambda i: array_to_string(ws[i:i + {WIDTH - 1}], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT y, c FROM reach JOIN links ON x = doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(c) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n"""
