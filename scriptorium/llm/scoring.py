"""Language-model scoring with a log-frequency Bloom filter.

The model is a word bigram model: p(w | v) = (q(v w) + MU * p(w)) / (c(v) + MU),
where p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). Single words' counts c are
exact. The counts of pairs, of which a corpus has far more, are in the filter:
a pair of count c is entered once for each of ``LEVELS`` up to c, and read back
by probing for level 1, 2, ... until one is missing. The answer q is the last
level found: the count rounded down, but for the filter's false positives,
and never over the exact counts of the pair's words. As q is rounded down and
c(v) is exact, the probabilities of all words after v add up to 1 at most.

How it scales: texts are read once, into chunks of words as numbers of a
chunk's own vocabulary. What crosses the network is a row for each word of a
chunk's vocabulary, to sum exact counts and bring them back to the chunk, and
each chunk's distinct pairs, packed, to count them. The filter is built by
Spark in segments by ranges of the pair's hash, sized by what they hold. It is broadcast
in up to ``MOST_PASSES`` pieces of ``PIECE_BYTES``, whole segments each, with a
pass over the chunks for each. It grows with the distinct pairs (about 2 bytes
each): one that is larger is not broadcast at all. Then chunks send the keys of
their distinct pairs to the segments, which are probed where they are and send
the counts back. Segments, probes and results are the same on either way.

Defined results: a null or blank text has one token, its end; any length is
read whole; repeated rows are scored each and count each; a null id hashes as
the empty text; an empty table gives an empty result; without training tokens
every score is that of an empty model; of other columns only the id is
carried, so names cannot clash. Words and pairs are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import stage, unstage
from scriptorium.llm.repeats import digest, grouped, mix, word_symbols

FOLDS, HELD_OUT = 5, 1
#: Weight of the single-word probability, in occurrences: the best of 20, 100, 500, 2000 on held-out texts.
MU = 500.0
#: Bytes of text of a chunk.
CHUNK_BYTES = 16 << 20
#: Training pairs (occurrences) of a segment, on average.
SEGMENT = 1 << 19
#: Of the filter, broadcast at a time.
PIECE_BYTES = 64 << 20
#: Pieces that are broadcast one after another, at most.
MOST_PASSES = 4
BITS, HASHES = 12, 7
#: Counts are rounded down to these: 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, ... three a doubling.
LEVELS = np.unique((2.0 ** (np.arange(3 * 62) / 3) + 1e-9).astype(np.int64))

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: No word is a space or two.
END, START = np.uint64(digest(b" ")), np.uint64(digest(b"  "))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32, or of 64 bits, byte by byte of all: the upper bytes, mostly equal, compress well. A few go as they are."""
    x = np.ascontiguousarray(x)
    if x.nbytes < 1024:
        return b"\0" + x.tobytes()
    return b"\1" + zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(raw, dtype=kind, offset=1)
    planes = np.frombuffer(zlib.decompress(memoryview(raw)[1:]), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def segment_of(keys: np.ndarray, count: int) -> np.ndarray:
    """The segment of a key: of so many equal ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _ended(sym: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The tokens of all texts, each with its end."""
    out = np.full(len(sym) + len(n), END, dtype=np.uint64)
    out[np.arange(len(sym)) + np.repeat(np.arange(len(n)), n)] = sym
    return out


_CHUNK = "ids array<{}>, held array<boolean>, n array<bigint>, code binary, vocab array<bigint>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, held, text) as chunks, with the training count of each word of a chunk's vocabulary."""
    ids, held, sizes, syms, size, number = [], [], [], [], 0, 0
    names = ["chunk", "ids", "held", "n", "code", "vocab", "train"]
    top = TaskContext.get().partitionId() << 32

    def row() -> pa.RecordBatch:
        n = np.concatenate(sizes)
        vocab, code, often = np.unique(_ended(np.concatenate(syms), n), return_inverse=True, return_counts=True)
        # numbered from the most frequent word on: most upper bytes are 0
        order = np.argsort(-often, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        vocab, code = vocab[order], place[code]
        marks = pa.concat_arrays(held)
        learn = np.repeat(~marks.to_numpy(zero_copy_only=False), n + 1)
        train = np.bincount(code[learn], minlength=len(vocab))
        one = lambda a: pa.ListArray.from_arrays([0, len(a)], a)
        return pa.RecordBatch.from_arrays([pa.array([top + number]), one(pa.concat_arrays(ids)), one(marks), one(pa.array(n + 1)), pa.array([packed(code.astype(np.uint32))], pa.binary()), one(pa.array(vocab.view(np.int64))), one(pa.array(train.astype(np.int64)))], names=names)

    for batch in batches:
        for first, texts in grouped(batch.column(2)):
            sym, n = word_symbols([t.translate(_LOWER) for t in texts])
            ids.append(batch.column(0).slice(first, len(texts)))
            held.append(batch.column(1).slice(first, len(texts)))
            sizes.append(n)
            syms.append(sym)
            size += sum(map(len, texts))
            if size >= CHUNK_BYTES:
                yield row()
                ids, held, sizes, syms, size, number = [], [], [], [], 0, number + 1
    if ids:
        yield row()


def pairs(code: np.ndarray, vocab: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit key of each token with the one before it, and whether it is a text's first."""
    sym = mix(vocab)[code]
    before = np.empty_like(sym)
    before[1:] = sym[:-1]
    first = np.zeros(len(sym), dtype=bool)
    first[np.cumsum(n) - n] = True
    before[first] = mix(np.array([START]))
    return mix(before * _ODD ^ sym), first


def _columns(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, vocabulary, tokens of each text, held out) of row ``i``."""
    at = lambda k: batch.column(batch.schema.get_field_index(k))[i]
    return unpacked(at("code").as_py(), "<u4"), at("vocab").values.to_numpy().view(np.uint64), at("n").values.to_numpy(), at("held").values.to_numpy(zero_copy_only=False)


def _by_segment(keys: np.ndarray, count: int) -> tuple[np.ndarray, list[int], list[int]]:
    """The segments of ascending keys, and where each begins and ends."""
    s = segment_of(keys, count)
    cut = np.flatnonzero(np.diff(s, prepend=-1)).tolist()
    return s, cut, [*cut[1:], len(s)] if cut else []


def _pair_counts(segments: int):
    """(segment, keys, counts): the distinct training pairs of each chunk, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                code, vocab, n, held = _columns(batch, i)
                keys, _ = pairs(code, vocab, n)
                keys, c = np.unique(keys[np.repeat(~held, n)], return_counts=True)
                s, cut, ends = _by_segment(keys, segments)
                steps = [packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(cut, ends, strict=True)]  # ascending keys
                times = [packed(c[a:b].astype(np.uint32)) for a, b in zip(cut, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s[cut]), pa.array(steps, pa.binary()), pa.array(times, pa.binary())], names=["segment", "keys", "counts"])

    return run


def _bit(keys: np.ndarray, level: int, k: int, size: np.ndarray | np.uint64) -> np.ndarray:
    h = mix(keys + np.uint64(level * int(_ODD) & (1 << 64) - 1))
    return (h + np.uint64(k) * (mix(h ^ _ODD) | np.uint64(1))) % size


def filled(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits (as bytes) of a segment with these keys and counts."""
    top = np.searchsorted(LEVELS, counts, "right")
    bits = np.zeros(max(64, -(-BITS * int(top.sum()) // 64) * 64), dtype=bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        own = keys[top >= level]
        for k in range(HASHES):
            bits[_bit(own, level, k, np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _segment(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = [], []
    for batch in batches:
        keys += [np.cumsum(unpacked(x.as_py(), "<u8"), dtype=np.uint64) for x in batch.column(1)]
        counts += [unpacked(x.as_py(), "<u4").astype(np.int64) for x in batch.column(2)]
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(own), dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([filled(own, total).tobytes()], pa.binary())], names=["segment", "bits"])


class Piece:
    """Some segments of the filter, all of those that are ``number`` modulo ``pieces``."""

    def __init__(self, segments: list[tuple[int, bytes]], count: int, number: int = 0, pieces: int = 1):
        self.count, self.number, self.pieces = count, number, pieces
        self.first = np.zeros(-(-count // pieces), dtype=np.uint64)
        self.size = np.zeros(-(-count // pieces), dtype=np.uint64)
        at = 0
        for s, bits in segments:
            self.first[s // pieces], self.size[s // pieces] = at * 8, len(bits) * 8
            at += len(bits)
        self.bits = np.frombuffer(b"".join(b for _, b in segments), dtype=np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return segment_of(keys, self.count) % self.pieces == self.number

    def counts(self, keys: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Counts of distinct keys that belong here, from repeated probes; none over ``most``, none probed where that is 0."""
        s = segment_of(keys, self.count) // self.pieces
        first, size = self.first[s], self.size[s]
        out = np.zeros(len(keys), dtype=np.int64)
        left = np.flatnonzero((size > 0) & (most > 0))
        for level in range(1, len(LEVELS) + 1):
            left = left[LEVELS[level - 1] <= most[left]]
            for k in range(HASHES):
                at = first[left] + _bit(keys[left], level, k, size[left])
                left = left[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(left):
                break
            out[left] = LEVELS[level - 1]
        return out


def _with_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk with the exact training counts of its words."""
    c = np.zeros(right.num_rows, dtype=np.int64)
    c[right.column("pos").to_numpy()] = right.column("c").to_numpy()
    return left.append_column("counts", pa.ListArray.from_arrays([0, len(c)], pa.array(c)))


class _Chunk:
    """A row of (chunk, ids, held, n, code, vocab, counts) as arrays, with the pairs of its tokens."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, i: int, texts: int):
        at = lambda k: batch.column(batch.schema.get_field_index(k))[i]
        self.number, self.ids, self.held, self.counts = at("chunk").as_py(), at("ids").values, at("held").values, at("counts").values.to_numpy()
        self.code, vocab, self.n, _ = _columns(batch, i)
        self.keys, first = pairs(self.code, vocab, self.n)
        c = self.counts[self.code]
        self.before = np.empty_like(c)
        self.before[1:] = c[:-1]
        self.before[first] = texts
        self.most = np.minimum(self.before, c)

    def distinct(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys of some tokens, ascending, the most that each may count, and the tokens' places in them."""
        keys, where, back = np.unique(self.keys[own], return_index=True, return_inverse=True)
        return keys, self.most[own][where], back

    def scores(self, own: np.ndarray, q: np.ndarray, total: int, distinct: int, mu: float) -> pa.RecordBatch:
        """A row a text; ``score`` is the share of the tokens ``own``, whose pairs have the counts ``q``."""
        single = (self.counts + 0.5) / (total + 0.5 * (distinct + 1))
        logs = np.zeros(len(self.code))
        logs[own] = np.log10((q + mu * single[self.code[own]]) / (self.before[own] + mu))
        sums = lambda x: np.add.reduceat(x, np.cumsum(self.n) - self.n)
        known = sums((self.counts > 0).astype(np.int64)[self.code])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(self.n), self.number)), pa.array(np.arange(len(self.n))), self.ids, self.held, pa.array(self.n), pa.array(known), pa.array(sums(np.log10(single)[self.code])), pa.array(sums(logs))],
            names=["chunk", "i", "id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )


def _probed(sent, total: int, distinct: int, texts: int, mu: float):
    """The scores of chunks, of the pairs that a broadcast piece of the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _Chunk(batch, i, texts)
                own = np.flatnonzero(piece.holds(chunk.keys))
                keys, most, back = chunk.distinct(own)
                yield chunk.scores(own, piece.counts(keys, most)[back], total, distinct, mu)

    return run


def _asked(count: int, texts: int):
    """(segment, chunk, keys, most): what each chunk has to ask each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _Chunk(batch, i, texts)
                keys, most, _ = chunk.distinct(np.arange(len(chunk.keys)))
                keys, most = keys[most > 0], most[most > 0]
                s, cut, ends = _by_segment(keys, count)
                steps, bounds = ([packed(f(a, b)) for a, b in zip(cut, ends, strict=True)] for f in (lambda a, b: np.diff(keys[a:b], prepend=np.uint64(0)), lambda a, b: most[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(s[cut]), pa.array([chunk.number] * len(cut), pa.int64()), pa.array(steps, pa.binary()), pa.array(bounds, pa.binary())], names=["segment", "chunk", "keys", "most"])

    return run


def _replies(left: pa.Table, right: pa.Table) -> pa.Table:
    """A segment's counts of what chunks asked it."""
    piece = Piece([(0, left.column("bits")[0].as_py())] if left.num_rows else [], 1)
    out = []
    for keys, most in zip(right.column("keys"), right.column("most"), strict=True):
        out.append(packed(piece.counts(np.cumsum(unpacked(keys.as_py(), "<u8"), dtype=np.uint64), unpacked(most.as_py(), "<i8"))))
    return pa.table([right.column("chunk"), right.column("segment"), pa.array(out, pa.binary())], names=["chunk", "segment", "found"])


def _told(total: int, distinct: int, texts: int, mu: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The scores of a chunk with what the segments replied."""
        chunk = _Chunk(left, 0, texts)
        every = np.arange(len(chunk.keys))
        keys, most, back = chunk.distinct(every)
        q = np.zeros(len(keys), dtype=np.int64)
        replies = right.sort_by("segment").column("found")
        if len(replies):
            q[most > 0] = np.concatenate([unpacked(x.as_py(), "<i8") for x in replies])
        return pa.Table.from_batches([chunk.scores(every, q[back], total, distinct, mu)])

    return run


def held_out(id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a row is kept from training, by its id alone."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def scored(docs: DataFrame, *, id: str = "doc_id", text: str = "text", held: Column | None = None, mu: float = MU, piece: int = PIECE_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, by a model of those not held out."""
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), (held_out(F.col(id)) if held is None else held).alias("held"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    chunks = stage(rows.mapInArrow(_chunks, f"chunk bigint, {_CHUNK.format(kind)}, train array<bigint>"), "chunks", free=False)

    # exact counts: one row a word of a chunk's vocabulary, so a frequent word has a row a chunk at most
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("vocab", "train")).alias("pos", "x")).select("chunk", "pos", F.col("x.vocab").alias("h"), F.col("x.train").alias("t"))
    word = Window.partitionBy("h")
    known = stage(each.select("chunk", "pos", F.sum("t").over(word).alias("c"), "t", (F.min("chunk").over(word) == F.col("chunk")).alias("once")), "known")
    total, distinct = known.agg(F.coalesce(F.sum("t"), F.lit(0)), F.count_if(F.col("once") & (F.col("c") > 0))).first()
    texts = chunks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()[0]

    ready = chunks.drop("train").groupBy("chunk").cogroup(known.select("chunk", "pos", "c").groupBy("chunk")).applyInArrow(_with_counts, f"chunk bigint, {_CHUNK.format(kind)}, counts array<bigint>")
    ready = stage(ready, "ready")
    unstage(chunks)
    unstage(known)

    # the filter
    count = min(1 << 32, max(1, -(-total // SEGMENT)))
    made = ready.select("n", "held", "code", "vocab").mapInArrow(_pair_counts(count), "segment bigint, keys binary, counts binary")
    segments = stage(made.groupBy("segment").applyInArrow(_segment, "segment bigint, bits binary"), "filter")
    size = segments.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    pieces = max(1, -(-size // piece))

    row = f"chunk bigint, i bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    if pieces > MOST_PASSES:
        asked = ready.mapInArrow(_asked(count, texts), "segment bigint, chunk bigint, keys binary, most binary")
        told = stage(segments.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(_replies, "chunk bigint, segment bigint, found binary"), "told")
        out = ready.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_told(total, distinct, texts, mu), row)
    else:
        out = None
        for p in range(pieces):
            own = segments.where(F.pmod("segment", F.lit(pieces)) == p).toLocalIterator()  # about ``piece`` bytes
            sent = spark.sparkContext.broadcast(Piece([(r.segment, bytes(r.bits)) for r in own], count, p, pieces))
            one = ready.mapInArrow(_probed(sent, total, distinct, texts, mu), row)
            if pieces > 1:  # staged, so that the piece can go
                one = stage(one, f"scores{p}")
                sent.destroy()
            out = one if out is None else out.unionByName(one)
        if pieces > 1:
            out = out.groupBy("chunk", "i").agg(*[F.first(c).alias(c) for c in ("id", "held_out", "n_tokens", "n_known", "base_score")], F.sum("score").alias("score"))
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs).withColumnRenamed("id", "doc_id")
