"""Finding windows that occur more than once, without shuffling every window.

A window is ``k`` consecutive symbols (word hashes or bytes). Equal windows
have the same minimizer: the least hash among their ``m``-grams, the leftmost
on a tie. Consecutive windows that share one minimizer occurrence form a
context; there is about one for every (k - m + 2) / 2 symbols. Contexts are
what Spark counts:

* a minimizer that occurs once holds no repeated window;
* a context that occurs twice or more is repeated whole;
* what is left, contexts that occur once though their minimizer occurs
  elsewhere (edges of passages, edits), is undecided. Their windows are
  compared one by one with those of the other distinct contexts of that
  minimizer, each context sent once however often it occurs.

This is exact up to 64-bit hashes, for any cut of windows into contexts, as a
window's minimizer depends on the window alone. Rabin-Karp hashes are
polynomials modulo 2^64 with an odd base, so the hash of any range comes from
two prefix sums and an inverse power. Their symbols are mixed hashes, and a
range has some hundreds: known clashes of such polynomials, which hold for
any base, take sequences of two symbols over 1024 long. Words, which have no
such bound, are hashed piece by piece instead (``hashed``).

Hot passages and groups of copies: counts combine before the shuffle and all
joins on hot keys are plain equi-joins that adaptive execution may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import counted, stage

#: Symbols handled together: the arrays of a step stay in cache.
CHUNK = 1 << 18
BASE = 0xD1342543DE82EF95
_LOW = np.uint64((1 << 24) - 1)

#: Kinds of a range of windows in a document.
REPEATED, UNDECIDED, EVIDENCE = 0, 1, 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A fixed value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        for j, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(max(n, 2 * CHUNK), b, dtype=np.uint64)
            x[0] = 1
            _powers[j] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def prefix(sym: np.ndarray) -> np.ndarray:
    """Prefix sums that ``ranges`` takes hashes from."""
    out = np.zeros(len(sym) + 1, dtype=np.uint64)
    np.cumsum(sym * powers(len(sym))[0], out=out[1:])
    return out


def ranges(p: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hashes of sym[start : start + length], wherever the range stands."""
    return (p[start + length] - p[start]) * powers(len(p))[1][start]


def spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text of bytes."""
    space = np.ones(len(text) + 2, dtype=bool)
    space[1:-1] = _SPACE[text]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


#: Bytes of a word that are hashed in numpy; longer words are hashed one by one.
_LONG = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def hashed(joined: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word joined[a:b]: its 8-byte pieces, mixed one after another (no polynomial).

    A word of up to 8 bytes is mixed whole, so two of one length never clash.
    """
    padded = joined + bytes(8)
    piece = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    size = b - a
    out = mix((piece[a] & _MASKS[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64)))
    for at in range(8, _LONG, 8):
        more = np.flatnonzero((size > at) & (size <= _LONG))
        if not len(more):
            break
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) ^ mix(piece[a[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size > _LONG):
        out[i] = digest(joined[a[i] : b[i]])
    return out


def digest(x: bytes) -> int:
    """A 64-bit hash of one string."""
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")


def word_symbols(texts: list[bytes], sizes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit symbol for each word of all texts, and the number of words of each; ``sizes`` receives the words' bytes."""
    syms, counts = [], np.zeros(len(texts), dtype=np.int64)
    held, size = [], 0

    def flush(first: int) -> None:
        joined = b" ".join(held)
        a, b = spans(np.frombuffer(joined, dtype=np.uint8))
        syms.append(hashed(joined, a, b))
        if sizes is not None:
            sizes.append(b - a)
        at = np.cumsum([0] + [len(h) + 1 for h in held])
        counts[first : first + len(held)] += np.diff(np.searchsorted(a, at))

    for i, t in enumerate(texts):
        if len(t) > 4 * CHUNK:  # cut a very long text between words
            if held:
                flush(i - len(held))
                held, size = [], 0
            words = t.split()
            for at in range(0, len(words), CHUNK // 8):
                held = [b" ".join(words[at : at + CHUNK // 8])]
                flush(i)
            held = []
            continue
        held.append(t)
        size += len(t)
        if size >= 4 * CHUNK:
            flush(i + 1 - len(held))
            held, size = [], 0
    if held:
        flush(len(texts) - len(held))
    return (np.concatenate(syms) if syms else np.zeros(0, dtype=np.uint64)), counts


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every w consecutive entries."""
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (w - size)], key[w - size :]) if size < w else key


def _contexts(sym: np.ndarray, lengths: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    n = len(sym) - k + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
    ends = np.cumsum(lengths)
    p = prefix(sym)
    grams = mix((p[m:] - p[:-m]) * powers(len(p))[1][: len(p) - m])
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(key, k - m + 1) & _LOW).astype(np.int64)
    valid = np.arange(k, n + k) <= np.repeat(ends, lengths)[:n]
    change = np.ones(n + 1, dtype=bool)
    change[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    edge = np.flatnonzero(change)
    start, stop = edge[:-1], edge[1:]
    ok = valid[start]
    start, stop = start[ok], stop[ok]
    count, least = stop - start, at[start]
    doc = np.searchsorted(ends, start, "right")
    content = ranges(p, start, count + k - 1)
    content = mix(content ^ mix((count * 1024 + (least - start)).astype(np.uint64)))
    return doc, start - (ends - lengths)[doc], count, grams[least], content


def contexts(sym: np.ndarray, lengths: np.ndarray, k: int, m: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window, windows, minimizer, content) of every context; long documents in overlapping pieces."""
    offs = np.concatenate(([0], np.cumsum(lengths)))
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        a, b = int(offs[i]), int(offs[j])
        if b - a <= 2 * CHUNK:
            d, *rest = _contexts(sym[a:b], np.asarray(lengths[i:j]), k, m)
            yield (d + i, *rest)
        else:
            for s in range(0, b - a - k + 1, CHUNK):
                piece = sym[a + s : min(b, a + s + CHUNK + k - 1)]
                d, first, *rest = _contexts(piece, np.array([len(piece)]), k, m)
                yield (d + i, first + s, *rest)
        i = j


def grouped(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in lists of about 4 * CHUNK bytes, or one longer text; with the number of the first."""
    held, first, size = [], 0, 0
    for i in range(len(texts)):
        held.append(texts[i].as_py())
        size += len(held[-1])
        if size >= 4 * CHUNK:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit symbol for each byte of all texts, and the length of each."""
    return BYTE[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.array([len(t) for t in texts], dtype=np.int64)


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(ka, kb, text as bytes, the other columns in a struct): two hashes name a row; equal rows share them."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(F.xxhash64(id).alias("ka"), F.xxhash64(text).alias("kb"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"), F.struct(*[F.col(c) for c in rest]).alias("rest"))


def occurrences(docs: DataFrame, symbols, k: int, m: int) -> DataFrame:
    """Every context of every document, staged: (ka, kb, s, n, mh, ch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in grouped(batch.column(2)):
                sym, lengths = symbols(texts)
                for doc, s, n, mh, ch in contexts(sym, lengths, k, m):
                    take = pa.array(doc + first)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mh.view(np.int64)), pa.array(ch.view(np.int64))], names=["ka", "kb", "s", "n", "mh", "ch"])

    return stage(docs.select("ka", "kb", "raw").mapInArrow(run, "ka long, kb long, s int, n int, mh long, ch long"), "contexts")


def recurring(occ: DataFrame) -> DataFrame:
    """The contexts of minimizers that occur more than once, staged; no other holds a repeated window."""
    twice = counted(occ.groupBy("mh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mh"))
    return stage(occ.join(twice, "mh"), "recurring")


def located(occ: DataFrame) -> DataFrame:
    """(ka, kb, spots): for each document with any, its ranges of windows as (s, n, kind)."""
    twice = occ.groupBy("mh").agg(F.count(F.lit(1)).alias("c"), F.min("ch").alias("lo"), F.max("ch").alias("hi")).where("c > 1")
    twice = counted(twice.select("mh", (F.col("lo") != F.col("hi")).alias("mixed")))
    same = stage(occ.join(twice, "mh"), "repeated")
    mixed = same.where("mixed")
    kinds = counted(mixed.groupBy("mh", "ch").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("ka", "kb", "s")).alias("rep")))
    kind = F.when(F.col("c") == 1, UNDECIDED).when(F.col("rep") == F.struct("ka", "kb", "s"), EVIDENCE).otherwise(REPEATED)
    spots = mixed.join(kinds, ["mh", "ch"]).select("ka", "kb", F.struct("s", "n", kind.alias("kind"), "mh").alias("spot"))
    sure = same.where("not mixed").select("ka", "kb", F.struct("s", "n", F.lit(REPEATED).alias("kind"), F.lit(0).cast("long").alias("mh")).alias("spot"))
    # a set: equal rows of the input name the same spots
    return spots.unionByName(sure).groupBy("ka", "kb").agg(F.collect_set("spot").alias("spots"))


def covered(spots: list[tuple[int, int]], k: int, size: int) -> np.ndarray:
    """Mask of the symbols that the windows starting in the ranges (s, n) cover."""
    step = np.zeros(size + 1, dtype=np.int64)
    for s, n in spots:
        step[s] += 1
        step[s + n + k - 1] -= 1
    return np.cumsum(step[:-1]) > 0
