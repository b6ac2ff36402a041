"""Substring dedup: Rabin-Karp hashes of every 35-word window, counted in Spark.

Windows are counted in two steps, with the same result as counting each by
its hash. Every window belongs to a context, a run of windows that share a
minimizer (see ``repeats``); every m-word hash and every context's hash is
made, and contexts are counted as one row each: a window of a context that
occurs twice is repeated, one whose minimizer occurs once is not. Only the
windows that this leaves undecided are hashed and counted one by one. Equal
means equal 64-bit hashes. Repeated windows merge into maximal intervals of
words, which are removed.

The text is shuffled once, to meet its intervals: both joins below use the
same exchange. Two counts and the undecided windows are the only other
shuffles; at about 7 contexts per 100 words they are smaller than the text.

Defined results: a null or blank text has no words; a document shorter than a
window keeps all words; windows are judged on the input, not on what is left;
equal rows (same id, same text) repeat each other, so both lose what a window
covers; an empty table gives an empty result; other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import counted, fresh, stage
from scriptorium.llm.repeats import EVIDENCE, UNDECIDED, covered, keyed, located, occurrences, prefix, ranges, word_symbols

K = 35
#: Words of a minimizer: short enough that contexts are few, long enough that chance repeats are rare.
M = 8


def _undecided(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(ka, kb, s, open, mh, h): the windows of undecided contexts and of what they are held against."""
    for batch in batches:
        ka, kb, raw, spots = (batch.column(batch.schema.get_field_index(c)) for c in ("ka", "kb", "raw", "spots"))
        rows, starts, opens, mhs, hs = [], [], [], [], []
        for i, found in enumerate(spots.to_pylist()):
            found = [x for x in found if x["kind"] in (UNDECIDED, EVIDENCE)]
            if not found:
                continue
            p = prefix(word_symbols([raw[i].as_py()])[0])
            at = np.concatenate([np.arange(x["s"], x["s"] + x["n"]) for x in found])
            n = [x["n"] for x in found]
            rows.append(np.full(len(at), i))
            starts.append(at)
            opens.append(np.repeat([x["kind"] == UNDECIDED for x in found], n))
            mhs.append(np.repeat(np.array([x["mh"] for x in found], dtype=np.int64), n))
            hs.append(ranges(p, at, k).view(np.int64))
        if rows:
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([ka.take(take), kb.take(take), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(opens)), pa.array(np.concatenate(mhs)), pa.array(np.concatenate(hs))], names=["ka", "kb", "s", "open", "mh", "h"])


def _kept(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest, raw, spots, more = (batch.column(batch.schema.get_field_index(c)) for c in ("rest", "raw", "spots", "more"))
        texts, total, gone, cut = [], [], [], []
        for text, known, late in zip(raw.to_pylist(), spots.to_pylist(), more.to_pylist(), strict=True):
            words = text.split()
            total.append(len(words))
            got = [(x["s"], x["n"]) for x in known or () if x["kind"] != UNDECIDED] + [(s, 1) for s in late or ()]
            if not got:
                gone.append(0)
                cut.append([])
                texts.append(b" ".join(words))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], covered(got, k, len(words)).astype(np.int8), [0])))).tolist()
            left, at = [], 0
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                left += words[at:a]
                at = b
            left += words[at:]
            gone.append(len(words) - len(left))
            cut.append([{"first": a, "after": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            texts.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([rest, pa.array(texts, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(cut, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())])))], names=["rest", "kept", "n_words", "n_removed", "removed"])


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """``docs`` with ``text`` cut to the kept words (joined by a space), ``n_words``, ``n_removed`` and the ``removed`` word intervals.

    New names that clash get underscores in front.
    """
    rows = keyed(docs, id, text)
    spots = located(occurrences(rows, word_symbols, k, m))
    held = rows.join(spots, ["ka", "kb"], "inner")
    windows = stage(held.mapInArrow(lambda b: _undecided(b, k), "ka long, kb long, s int, open boolean, mh long, h long"), "windows")
    twice = counted(windows.groupBy("mh", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mh", "h"))
    more = windows.where("open").join(twice, ["mh", "h"]).groupBy("ka", "kb").agg(F.collect_set("s").alias("more"))
    whole = rows.join(spots.join(more, ["ka", "kb"], "left"), ["ka", "kb"], "left")
    schema = T.StructType([rows.schema["rest"], T.StructField("kept", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType())])))])
    out = whole.mapInArrow(lambda b: _kept(b, k), schema)
    names = fresh(docs, "n_words", "n_removed", "removed")
    own = [F.col("kept").cast("string").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns]
    return out.select(*own, *[F.col(c).alias(x) for c, x in zip(("n_words", "n_removed", "removed"), names, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {K - 1}], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {K - 2})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {K})) AS j FROM twice),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""
