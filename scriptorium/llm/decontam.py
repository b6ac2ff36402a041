"""Benchmark decontamination by a broadcast set of test n-grams.

The benchmark's n-gram windows, hashed, go to every task as sorted arrays that
the driver builds once. A task scans its documents' token windows against them
in numpy, verifies each hit by its words, and marks the covered words. The
documents are read once and never shuffled.

The broadcast is bounded: a benchmark whose text exceeds ``BROADCAST_BYTES``
is split into pieces within the bound. Each piece scans the documents and
returns hits only, which are merged by text before anything is counted or cut:
the result is the same. It costs a scan a piece and a shuffle of the documents.

Words: A-Z lower-cased, then runs of digits, a-z and any non-ASCII. An item of
n words or more has all its n-word windows; a shorter one is one window.

Defined results: null texts and texts without words have no words and no hits;
null or wordless items have no window; an item with a null id marks words but
is not counted or listed; equal items are listed each; repeated document rows
are judged one by one; an empty benchmark leaves everything clean; other
columns are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import fresh
from scriptorium.llm.repeats import grouped, hashed, prefix, ranges, spans

N = 10
#: Most benchmark text in one broadcast. Its arrays take about 5 times that in every Python worker.
BROADCAST_BYTES = 16 << 20

#: A-Z to a-z; digits, a-z and non-ASCII as they are; else a space.
_PLAIN = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))


def _words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Plain texts in one string, starts and ends of the words in it, and the text of each word."""
    joined = b" ".join(t.translate(_PLAIN) for t in texts)
    a, b = spans(np.frombuffer(joined, dtype=np.uint8))
    offset = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return joined, a, b, np.searchsorted(offset, a, "right") - 1


class Grams:
    """The windows of some items: for each window length, sorted hashes with their bytes in ``plain`` and their items."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.names = [str(k) if k is not None else None for k, _ in items]
        texts = [b" ".join(t.translate(_PLAIN).split()) for _, t in items] or [b""]
        self.plain, a, b, item = _words(texts)
        p = prefix(hashed(self.plain, a, b))
        count = np.bincount(item, minlength=len(texts))
        m = np.minimum(n, count)[item]
        last = np.cumsum(count)[item]  # the word after the item's last
        starts = np.flatnonzero(np.arange(len(a)) + m <= last)
        self.by_length = {}
        for k in np.unique(m[starts]).tolist():
            at = starts[m[starts] == k]
            keys = ranges(p, at, k)
            order = np.argsort(keys, kind="stable")
            at = at[order]
            self.by_length[k] = (keys[order], a[at].astype(np.int32), b[at + k - 1].astype(np.int32), item[at].astype(np.int32))

    def bytes(self) -> int:
        return len(self.plain) + sum(x.nbytes for arrays in self.by_length.values() for x in arrays)


def hits(texts: list[bytes], grams: Grams) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text: its words, the runs (first, after) of hit words, and the items whose windows occur."""
    joined, a, b, doc = _words(texts)
    count = np.bincount(doc, minlength=len(texts)).tolist()
    p = prefix(hashed(joined, a, b))
    begin = np.cumsum([0, *count])
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    for m, (keys, first, after, owner) in grams.by_length.items():
        at = np.arange(max(0, len(a) - m + 1))
        at = at[doc[at] == doc[at + m - 1]]
        h = ranges(p, at, m)
        low = np.searchsorted(keys, h)
        some = low < len(keys)
        some[some] = keys[low[some]] == h[some]
        for i, j in zip(at[some].tolist(), low[some].tolist(), strict=True):
            said, k, d = b" ".join(joined[a[i] : b[i + m - 1]].split()), keys[j], int(doc[i])
            found = False
            while j < len(keys) and keys[j] == k:
                if grams.plain[first[j] : after[j]] == said:
                    items[d].add(int(owner[j]))
                    found = True
                j += 1
            if found:
                runs[d].append((i - int(begin[d]), i - int(begin[d]) + m))
    return [(n, merged(r), i) for n, r, i in zip(count, runs, items, strict=True)]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching runs made one, in order."""
    out: list[tuple[int, int]] = []
    for first, after in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(after, out[-1][1]))
        else:
            out.append((first, after))
    return out


def _pieces(benchmark: DataFrame, item: str, text: str, n: int) -> list[Broadcast]:
    """The windows of at most BROADCAST_BYTES of items (or one longer item) a piece.

    The driver reads row by row and holds one piece at a time.
    """
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col(item).alias("k"), F.col(text).cast("binary").alias("t")).where("t is not null")
    out, held, size = [], [], 0
    for r in rows.toLocalIterator():
        if held and size + len(r.t) > BROADCAST_BYTES:
            out.append(sc.broadcast(Grams(held, n)))
            held, size = [], 0
        size += len(r.t)
        held.append((r.k, bytes(r.t)))
    return [*out, sc.broadcast(Grams(held, n))]


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()).fill_null(b"")


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "after": b} for a, b in r] for r in rows], _SPAN)


def _marks(sent: Broadcast, text: str, keep: bool, names: list[str]):
    """Every row with what ``hits`` says of its text; without the text unless ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            own = [i for i in range(batch.num_columns) if keep or i != at]
            for first, texts in grouped(_binary(batch.column(at))):
                found = hits(texts, sent.value)
                listed = [sorted({sent.value.names[i] for i in items} - {None}) for _, _, items in found]
                new = [pa.array([n for n, _, _ in found], pa.int64()), _spans([r for _, r, _ in found]), pa.array(listed, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(texts)) for i in own), *new], names=[*(batch.schema.field(i).name for i in own), *names])

    return run


def _hits_only(sent: Broadcast):
    """(a, b, runs, items) of the texts that have any hit; (a, b) is the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in grouped(_binary(batch.column(2))):
                found = [(first + i, r, items) for i, (_, r, items) in enumerate(hits(texts, sent.value)) if r]
                if found:
                    take = pa.array([i for i, _, _ in found])
                    listed = [sorted({sent.value.names[i] for i in items} - {None}) for _, _, items in found]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), _spans([r for _, r, _ in found]), pa.array(listed, pa.list_(pa.string()))], names=["a", "b", "runs", "items"])

    return run


def _merge(text: str, keep: bool, names: list[str]):
    """Rows with the runs and items of all pieces, merged; their words counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, listed = (batch.schema.get_field_index(c) for c in (text, *names[1:]))
            n = [len(t.translate(_PLAIN).split()) for t in _binary(batch.column(at)).to_pylist()]
            runs = [merged([(x["first"], x["after"]) for part in r or () for x in part]) for r in batch.column(found).to_pylist()]
            items = [sorted({x for part in i or () for x in part}) for i in batch.column(listed).to_pylist()]
            own = [i for i in range(batch.num_columns) if i not in (found, listed) and (keep or i != at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(n, pa.int64()), _spans(runs), pa.array(items, pa.list_(pa.string()))], names=[*(batch.schema.field(i).name for i in own), *names])

    return run


def marked(docs: DataFrame, benchmark: DataFrame, names: list[str], *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, keep: bool = True) -> DataFrame:
    """``docs`` with its words counted, its runs of hit words (first, after) and the sorted names of items found, by ``names``."""
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType())]))
    kinds = [T.LongType(), span, T.ArrayType(T.StringType())]
    schema = T.StructType([f for f in docs.schema if keep or f.name != text] + [T.StructField(c, k) for c, k in zip(names, kinds, strict=True)])
    pieces = _pieces(benchmark, item, item_text, n)
    if len(pieces) == 1:
        return docs.mapInArrow(_marks(pieces[0], text, keep, names), schema)
    narrow = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("a"), F.md5(F.col(text).cast("binary")).alias("b"), F.col(text).alias("t"))
    found = [narrow.mapInArrow(_hits_only(p), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("runs", span), T.StructField("items", kinds[2])])) for p in pieces]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    a, b = fresh(docs, "key_a", "key_b")
    every = every.groupBy(F.col("a").alias(a), F.col("b").alias(b)).agg(F.collect_set("runs").alias(names[1]), F.collect_set("items").alias(names[2]))
    wide = docs.withColumn(a, F.xxhash64(text)).withColumn(b, F.md5(F.col(text).cast("binary"))).join(every, [a, b], "left").drop(a, b)
    return wide.select(*docs.columns, *names[1:]).mapInArrow(_merge(text, keep, names), schema)


def scanned(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_hit`` and the sorted names of the ``items`` found.

    Names that clash get underscores in front.
    """
    words, hit, items = fresh(docs.drop(text), "n_words", "n_hit", "items")
    (runs,) = fresh(docs, "runs_")
    out = marked(docs, benchmark, [words, runs, items], text=text, item=item, item_text=item_text, n=n, keep=False)
    total = F.aggregate(runs, F.lit(0).cast("long"), lambda s, x: s + x["after"] - x["first"])
    return out.select(*[c for c in docs.columns if c != text], words, total.alias(hit), items)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, remove: str = "documents") -> DataFrame:
    """``docs`` with its own columns, without the benchmark's passages.

    ``remove="documents"`` drops documents with a hit. ``remove="spans"``
    keeps them and cuts each run of hit words, with what stands between them,
    out of the text (a space stands for it).
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    names = fresh(docs, "words_", "runs_", "items_")
    out = marked(docs, benchmark, names, text=text, item=item, item_text=item_text, n=n)
    if remove == "documents":
        return out.where(F.size(names[1]) == 0).select(*docs.columns)
    return out.drop(names[0], names[2]).mapInArrow(_cut(text, names[1]), docs.schema)


def _cut(text: str, runs: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = batch.schema.get_field_index(text), batch.schema.get_field_index(runs)
            texts = batch.column(at).to_pylist()
            for i, r in enumerate(batch.column(found).to_pylist()):
                if r:
                    raw = texts[i].encode()
                    a, b = spans(np.frombuffer(raw.translate(_PLAIN), dtype=np.uint8))
                    left, last = [], 0
                    for x in r:
                        left.append(raw[last : a[x["first"]]])
                        last = b[x["after"] - 1]
                    texts[i] = b" ".join([*left, raw[last:]]).decode()
            own = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns) if i != found]
            yield pa.RecordBatch.from_arrays(own, names=[f.name for i, f in enumerate(batch.schema) if i != found])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scanned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
g AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS gram
      FROM (SELECT item_id, ws, least({N}, len(ws)) AS m, unnest(range(1, len(ws) - least({N}, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT m FROM g),
w AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS gram
      FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, lengths WHERE len(ws) >= m)),
h AS (SELECT doc_id, item_id, m, i FROM w JOIN g USING (m, gram)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, m, i FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
