"""Phrase collocations: Suffix-sigma counts, then the weakest cut of each phrase.

Words are counted first. No phrase is more frequent than its words, so a word
of under ``least`` occurrences ends every suffix: a bit filter of the others is
broadcast (16 MB at most; what passes it by chance is counted and left out).
Every word of a piece of text then starts a suffix, cut after ``max_n`` words
or before a rare one. Suffixes of two and more words are counted where they are
made, as rows of word numbers, and shuffled by language and first word. There
they are cut once more, where their beginning has under ``least`` occurrences,
and what is left is sorted reverse-lexicographically, so that the counts of all
prefixes come from one stack: when the next suffix leaves a prefix, its count
is final. Of what comes out, phrases of ``least`` occurrences are kept: a
phrase's parts occur at least as often as the phrase, so its score needs no
others, and parts are joined to it afterwards, in exact decimals.

Hot words have over ``hot`` occurrences (and over one in 2^17 of all, so there
are at most 2^17, which are broadcast). The suffixes of a hot first word are
dealt out further by the second word, and by the third where the second is hot,
too; only the counts of such a pair are then sums of several.

Suffixes travel packed, many to a row, in buckets: four for each of Spark's
shuffle partitions and each language. So a task holds one bucket, and buckets
have to be set with the input, as any shuffle has. The most frequent words
(2^18 at most, which are broadcast) go by number; a row has its other words
with it.

Defined results: a null text is empty; a null language is ``und``; a text of
any length is read whole, in one pass; only A to Z are lower-cased; repeated
rows count each; an empty table gives an empty result; other columns are not
carried, so their names cannot clash. Ties: score, then occurrences, then the
phrase's UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import counted
from scriptorium.llm.repeats import digest, hashed, mix

MAX_N, LEAST, TOP, PERCENT, FACTOR = 5, 100, 2000, 100, 1000
HOT = 1 << 20
#: Words whose suffixes a task makes at a time; distinct words that it holds before it sends them on.
HELD = 400_000
#: Bytes of texts whose words a task numbers together, if no text alone is longer.
STEP = 12 << 20
#: Buckets of suffixes for each shuffle partition and language.
BUCKETS = 4
#: Words that go by number, and as many that are hot.
NUMBERED = 1 << 17
#: Bits of the filter of frequent words: for each of them, and at most (as a power of two).
BITS_EACH, MOST_BITS = 16, 27
#: Separates words inside a suffix: less than all other bytes, so that equal first words sort together.
SEP = b"\0"

_TABLE = bytearray(range(256))
for _c in range(ord("A"), ord("Z") + 1):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 10
_TABLE[9] = 32


def numbered(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, and the word's number and the number of the piece of each of their words."""
    text = np.frombuffer(raw.translate(_TABLE), dtype=np.uint8)
    end = text == 10
    gap = np.ones(len(text) + 2, dtype=bool)
    gap[1:-1] = end | (text == 32)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start = edge[::2]
    at = np.concatenate(([0], np.cumsum(edge[1::2] - start)))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(text[~gap[1:-1]])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.cumsum(end, dtype=np.int32)[start]


def escaped(word: bytes) -> bytes:
    return word.replace(b"\1", b"\1\2").replace(SEP, b"\1\1") if SEP in word or b"\1" in word else word


def plain(phrase: bytes) -> str:
    out = phrase.replace(SEP, b" ")
    if b"\1" in out:
        out = re.sub(b"\1([\1\2])", lambda m: SEP if m[1] == b"\1" else b"\1", out)
    return out.decode()


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts), many at once, a piece ending with each."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(lang, []).append(t := text.as_py())
            size += len(t)
            if size >= STEP:
                for k in list(held):
                    yield k, b"\n".join(held.pop(k))
                size = 0
    for k in list(held):
        yield k, b"\n".join(held.pop(k))


def _keys(lang: str, words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word of a language."""
    at = np.cumsum([0, *map(len, words)])
    return mix(hashed(b"".join(words), at[:-1], at[1:]) ^ np.uint64(digest(lang.encode())))


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), combined within a task."""
    held: dict[str, list[pa.Table]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            t = pa.concat_tables(parts)
            t = t.group_by("word").aggregate([("n", "sum")]) if len(parts) > 1 else t.rename_columns({"n": "n_sum"})
            for b in t.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), b.column("word").cast(pa.binary()), b.column("n_sum")], names=["lang", "word", "n"])
        held.clear()

    for lang, raw in _texts(batches):
        words, number, _ = numbered(raw)
        held.setdefault(lang, []).append(pa.table({"word": words, "n": np.bincount(number, minlength=len(words)).astype(np.int64)}))
        size += len(words)
        if size > HELD:
            yield from flush()
            size = 0
    yield from flush()


class Frequent:
    """Which words may be frequent: a bit each by the top of their hash. ``rows`` are (64 bits' number, the bits)."""

    def __init__(self, size: int, rows: Iterable[tuple[int, int]]):
        self.size, self.bits = size, np.zeros(1 << max(0, size - 6), dtype=np.uint64)
        for at, bits in rows:
            self.bits[at] = bits & ((1 << 64) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.size)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _positions(size: int):
    """(at, bits) of the filter that hold words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[bytes]] = {}
            for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.setdefault(lang, []).append(word)
            for lang, words in own.items():
                at = _keys(lang, words) >> np.uint64(64 - size)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    return run


def filtered(words: DataFrame, most: int = MOST_BITS) -> Frequent:
    """The filter of (lang, word): 2^``most`` bits at most, made by Spark, 64 to a row."""
    size = min(most, max(6, (BITS_EACH * words.count() - 1).bit_length()))
    rows = words.select("lang", "word").mapInArrow(_positions(size), "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits"))
    return Frequent(size, ((r.at, r.bits) for r in rows.toLocalIterator()))


def _suffixes(max_n: int, buckets: int, sent):
    """(lang, bucket, words without a number one a line, suffixes as columns of numbers, counts): all suffixes, combined where they are made."""

    def made(lang: str, code: np.ndarray, piece: np.ndarray, first: int, words: np.ndarray, key: np.ndarray, deal: np.ndarray, known: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
        at = np.arange(first, min(len(code) - max_n, first + HELD))
        at = at[(code[at] > 0) & (code[at + 1] > 0) & (piece[at] == piece[at + 1])]
        if not len(at):
            return
        m = np.zeros((max_n, len(at)), dtype=np.int32)
        m[0], m[1] = code[at], code[at + 1]
        for k in range(2, max_n):
            m[k] = np.where((m[k - 1] > 0) & (piece[at + k] == piece[at]), code[at + k], 0)
        # a hot first word's by the second word, too, and by the third where the second is hot
        share, second = deal[m[0]], key[m[1]]
        if max_n > 2:
            second = np.where(deal[m[1]] > 0, mix(second ^ mix(key[m[2]] + np.uint64(1))), second)
        share = np.where(share > 0, second % np.maximum(share, np.uint64(1)) + np.uint64(1), np.uint64(0))
        bucket = mix(key[m[0]] ^ mix(share)) % np.uint64(buckets)
        whole = np.zeros(len(at), dtype=np.uint64)
        for k in range(max_n):
            whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + m[k].astype(np.uint64))
        # first words together, as runs of one number are short when compressed
        order = np.argsort(bucket << np.uint64(40) | key[m[0]] >> np.uint64(48) << np.uint64(24) | whole >> np.uint64(40))
        m, bucket = m[:, order], bucket[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (m[:, 1:] != m[:, :-1]).any(axis=0)
        at = np.flatnonzero(new)
        m, bucket, n = m[:, at], bucket[at], np.diff(np.append(at, len(order))).astype(np.int32)
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rows: list[tuple] = []
        ids, other = known[m], known[m] < 0
        for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
            used, own = np.unique(m[:, a:b][other[:, a:b]], return_inverse=True)
            ids[:, a:b][other[:, a:b]] = most + 1 + own
            rows.append((int(bucket[a]), b"\n".join(words[used - 1]), packed(ids[:, a:b]), n[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True))], names=["lang", "bucket", "words", "suffixes", "counts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if max_n < 2:
            return
        common, shares, frequent = sent.value
        numbers: dict[str, dict[bytes, int]] = {}
        for lang, raw in _texts(batches):
            most = len(common.get(lang, ()))
            if lang not in numbers:
                numbers[lang] = {w: i for i, w in enumerate(common.get(lang, ()), 1)}
            words, number, piece = numbered(raw)
            words = np.array(words.to_pylist(), dtype=object)
            key = _keys(lang, words.tolist())
            may = frequent.holds(key)
            # numbers from 1 on of words that may be frequent, then nothing for the last suffixes to reach into
            left = np.flatnonzero(may)
            to = np.zeros(len(words), dtype=np.int32)
            to[left] = np.arange(1, len(left) + 1)
            words, key = words[left], np.concatenate((np.zeros(1, dtype=np.uint64), key[left]))
            code = np.concatenate((to[number], np.zeros(max_n, dtype=np.int32)))
            piece = np.concatenate((piece, np.full(max_n, -1, dtype=np.int32)))
            known = np.array([0, *(numbers[lang].get(w, -1) for w in words)], dtype=np.int32)
            deal = np.concatenate((np.zeros(1, dtype=np.uint64), shares.get(lang, np.zeros(0, dtype=np.uint64)), np.zeros(1, dtype=np.uint64)))
            deal = deal[np.where(known < 0, 0, np.minimum(known, len(deal) - 1))]
            for first in range(0, len(number), HELD):
                yield from made(lang, code, piece, first, words, key, deal, known, most)

    return run


def packed(ids: np.ndarray) -> bytes:
    """Numbers of under 2^32 as their lower halves, and then the upper ones if there are any."""
    low, high = (ids & 0xFFFF).astype(np.uint16), (ids >> 16).astype(np.uint16)
    return low.tobytes() + (high.tobytes() if high.any() else b"")


def unpacked(raw: bytes, columns: int, rows: int) -> np.ndarray:
    halves = np.frombuffer(raw, dtype=np.uint16).reshape(-1, columns, rows).astype(np.int64)
    return halves[0] | halves[1] << 16 if len(halves) > 1 else halves[0]


def stacked(suffixes: list[tuple[bytes, int]]) -> Iterator[tuple[list[bytes], int]]:
    """(words, occurrences) of every prefix of distinct suffixes, which come in descending order.

    The stack is one prefix, a word and a count a level; a level that the
    next suffix does not share is done, and its count adds to the one below.
    The list that is yielded is the stack itself: read it at once.
    """
    words: list[bytes] = []
    counts: list[int] = []
    for suffix, n in suffixes:
        new = suffix.split(SEP)
        same = 0
        for a, b in zip(words, new):  # noqa: B905 - up to the shorter
            if a != b:
                break
            same += 1
        while len(words) > same:
            c = counts.pop()
            yield words, c
            words.pop()
            if counts:
                counts[-1] += c
        for w in new[same:]:
            words.append(w)
            counts.append(0)
        counts[-1] += n
    while words:
        c = counts.pop()
        yield words, c
        words.pop()
        if counts:
            counts[-1] += c


def rows_cut(m: np.ndarray, n: np.ndarray, least: int, words: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes cut to their longest beginning of ``least`` occurrences: (a row of each, words left, occurrences), without those of under two words left.

    ``m`` has a row a place and a column a suffix, 0 after its last word; a pair stays if both numbers are up to ``hot``. Numbers are up to ``words``.
    """
    group, rows, base = m[0].astype(np.int64), np.arange(m.shape[1]), 0
    depth, leaf = np.zeros(m.shape[1], dtype=np.int8), np.full(m.shape[1], -1)
    for k in range(1, len(m)):
        there = m[k, rows] > 0
        rows, group = rows[there], group[there]
        _, group = np.unique(group * (words + 1) + m[k, rows], return_inverse=True)
        stay = np.bincount(group, n[rows]) >= least
        if k == 1:
            stay = stay[group] | (m[0, rows] <= hot) & (m[1, rows] <= hot)
        else:
            stay = stay[group]
        rows, group = rows[stay], group[stay]
        if not len(rows):
            break
        depth[rows], leaf[rows] = k + 1, base + group
        base += int(group.max()) + 1
    at = np.flatnonzero(leaf >= 0)
    _, first, leaf = np.unique(leaf[at], return_index=True, return_inverse=True)
    return at[first], depth[at[first]], np.bincount(leaf, n[at]).astype(np.int64)


def _prefixes(max_n: int, least: int, sent):
    """(lang, phrase, words, n) of a bucket: counts of ``least`` and more, and the shares of pairs of hot words."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, others, parts, counts, size = key[0].as_py(), [], [], [], 0
        common, shares, _ = sent.value
        common = common.get(lang, [])
        for batch in batches:
            for body, suffixes, n in zip(*batch.columns[2:], strict=True):
                counts.append(np.frombuffer(n.as_py(), dtype=np.int32))
                ids = unpacked(suffixes.as_py(), max_n, len(counts[-1]))
                if own := body.as_py():
                    ids[ids > len(common)] += size
                    others.append(pa.array(own.split(b"\n"), pa.large_binary()))
                    size += len(others[-1])
                parts.append(ids)
        m = np.concatenate(parts, axis=1)
        del parts
        own = []
        if others:
            coded = pa.chunked_array(others).combine_chunks().dictionary_encode()
            own, at = coded.dictionary.to_pylist(), m > len(common)
            m[at] = len(common) + 1 + coded.indices.to_numpy()[m[at] - len(common) - 1]
        hot = len(shares.get(lang, ()))
        rows, depth, n = rows_cut(m, np.concatenate(counts), least, len(common) + len(own), hot)
        word = lambda i: escaped(common[i - 1] if i <= len(common) else own[i - 1 - len(common)])
        held = sorted(((SEP.join([word(i) for i in m[:d, r].tolist()]), c) for r, d, c in zip(rows.tolist(), depth.tolist(), n.tolist(), strict=True)), reverse=True)
        spread = set(map(escaped, common[:hot]))
        phrases, sizes, ns = [], [], []
        for words, n in stacked(held):
            if len(words) > 1 and (n >= least or len(words) == 2 and all(w in spread for w in words)):
                phrases.append(plain(SEP.join(words)))
                sizes.append(len(words))
                ns.append(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ns), pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(ns, pa.int64())], names=["lang", "phrase", "words", "n"])

    return run


def frequent(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of every phrase of up to ``max_n`` words and ``least`` occurrences, (lang, n) all words); both staged."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    single = counted(rows.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counted(single.groupBy("lang").agg(F.sum("n").alias("n")))
    bound = max(hot, (totals.agg(F.sum("n")).first()[0] or 0) >> 17)
    often = single.where(F.col("n") >= least)
    common: dict[str, list[bytes]] = {}
    shares: dict[str, list[int]] = {}
    # counts above a level that leaves as many words as have numbers, found from counts by level, and hot words
    levels, few, from_ = often.groupBy(F.floor(F.log2("n") * 32).alias("level")).count().collect(), 0, 1 << 20
    for r in sorted(levels, reverse=True):
        if (few := few + r[1]) > NUMBERED:
            break
        from_ = r.level
    for r in sorted(often.where((F.floor(F.log2("n") * 32) >= from_) | (F.col("n") > bound)).collect(), key=lambda r: (-r.n, r.lang, r.word)):  # 2^18 words at most
        common.setdefault(r.lang, []).append(bytes(r.word))
        if r.n > bound:
            shares.setdefault(r.lang, []).append(-(-r.n // hot))
    sent = spark.sparkContext.broadcast((common, {k: np.array(v, dtype=np.uint64) for k, v in shares.items()}, filtered(often)))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows.mapInArrow(_suffixes(max_n, buckets, sent), "lang string, bucket int, words binary, suffixes binary, counts binary")
    parts = made.groupBy("lang", "bucket").applyInArrow(_prefixes(max_n, least, sent), "lang string, phrase string, words int, n long")
    words = often.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    return counted(parts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least).unionByName(words)), totals


def scored(phrases: DataFrame, totals: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of phrases of two and more words, by their weakest cut (ties: the first).

    Counts have up to 15 digits: factor * a * n and l * r then fit 38.
    """
    long = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice(w, 1, F.col("k")), " ")).withColumn("right", F.array_join(F.slice(w, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    joined = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    number = lambda c: f"cast({c} as decimal(15, 0))"
    score = F.expr(f"(cast({factor} as decimal(6, 0)) * {number('a')} * {number('n')}) div ({number('l')} * {number('r')})").cast("long")
    best = joined.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def uncontained(phrases: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase) of phrases of two and more words that lie in a longer one with ``percent`` of their occurrences: those to leave out."""
    w = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inner = phrases.where("words > 2").select("lang", "words", "f", w.alias("w")).withColumn("size", F.explode(sizes))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    most = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return most.join(phrases, ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("f") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST, top: int = TOP, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent(docs, text=text, lang=lang, max_n=max_n, least=least, hot=hot)
    left = scored(phrases, totals).join(uncontained(phrases, percent), ["lang", "phrase"], "left_anti")
    # the group limit keeps ``top`` rows a language in each task before the shuffle
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


def _sql() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS words, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM p WHERE i + {k - 1} <= len(ws)" for k in range(1, MAX_N + 1))
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
p AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE f >= {LEAST}),
s AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM c WHERE words > 1),
x AS (
  SELECT s.lang, s.phrase, a, k, l.f AS l, r.f AS r, n, {FACTOR}::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS score
  FROM s JOIN c l ON l.lang = s.lang AND l.phrase = array_to_string(w[1:k], ' ')
         JOIN c r ON r.lang = s.lang AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN n ON n.lang = s.lang),
best AS (SELECT lang, phrase, a, n, unnest(min({{'score': score, 'k': k, 'l': l, 'r': r}})) FROM x GROUP BY lang, phrase, a, n),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, f, words, w, m, unnest(range(1, words - m + 2)) AS i
        FROM (SELECT lang, f, words, string_split(phrase, ' ') AS w, unnest(range(2, words)) AS m FROM c WHERE words > 2)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < {PERCENT} * a)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept)
WHERE rank <= {TOP}"""


ORACLE_SQL = _sql()
