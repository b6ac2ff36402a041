"""Chunkers.

Regular ones are column expressions. Those whose next step depends on where
the last one ended run as Arrow UDFs, a batch of texts at a time; each text is
independent, so they stay in the scan's stage and shuffle nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.functions.text import strip

#: Characters of a chunk and of the overlap.
SIZE, OVERLAP = 1000, 300
PARAGRAPH_OVERLAP = 200
#: Where the recursive splitter may cut, best first.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Tokens of a sentence chunk: at least, at most, and percent shared with the next.
MIN_TOKENS, MAX_TOKENS, SHARED_PERCENT = 500, 800, 20
#: Characters that a chapter may have before it is cut for a model's context.
CONTEXT = 15000

PIECE_FIELDS = {"start": T.IntegerType(), "text": T.StringType()}
#: Characters of chunks that are held as Python strings before they go to Arrow.
HELD = 1 << 20


def _kind(fields: dict[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(c, t) for c, t in fields.items()]))


def _lists(rows: Iterable[list[tuple]], fields: dict[str, T.DataType]) -> pa.Array:
    """Lists of structs, a row each, made a part at a time: a batch of any number of texts holds few Python objects."""
    kind = to_arrow_type(_kind(fields))
    item, parts, ends, held, chars = kind.value_type, [], [0], [], 0

    def flush() -> None:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), item, strict=True)] if held else [pa.array([], f.type) for f in item]
        items = pa.StructArray.from_arrays(columns, fields=list(item))
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=kind))
        ends[:], held[:] = [0], []

    at = [i for i, c in enumerate(fields) if c == "text"][0]
    for row in rows:
        held += row
        ends.append(len(held))
        chars += sum(len(x[at]) for x in row)
        if chars > HELD:
            flush()
            chars = 0
    flush()
    return pa.concat_arrays(parts)


def sizes_for(length: int, size: int = SIZE, overlap: int = OVERLAP) -> tuple[int, int]:
    """Smaller chunks for a text shorter than one, so that it still has two or so."""
    if length >= size:
        return size, overlap
    size = max(500, length // 2)
    return size, min(300, size // 3)


def _pieces(text: str, first: int, level: int, size: int):
    """(start, end) of parts no longer than ``size`` where a separator allows; each begins with its separator."""
    sep = next((s for s in SEPARATORS[level:] if s in text), "")
    deeper = SEPARATORS.index(sep) + 1
    if sep:
        cuts = [0, *(m.start() for m in re.finditer(re.escape(sep), text) if m.start()), len(text)]
    else:
        cuts = [*range(len(text)), len(text)]
    return [(first + a, first + b) for a, b in zip(cuts, cuts[1:]) if b > a], deeper


def split_recursive(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk): parts are gathered up to ``size``; the next chunk begins with up to ``overlap`` of the last."""
    out: list[tuple[int, str]] = []

    def emit(held: list[tuple[int, int]]) -> None:
        raw = text[held[0][0] : held[-1][1]]
        if chunk := raw.strip():
            out.append((held[0][0] + len(raw) - len(raw.lstrip()), chunk))

    def gather(parts: list[tuple[int, int]]) -> None:
        held: list[tuple[int, int]] = []
        total = 0
        for a, b in parts:
            if held and total + b - a > size:
                emit(held)
                while held and (total > overlap or total + b - a > size):
                    total -= held[0][1] - held[0][0]
                    held = held[1:]
            held.append((a, b))
            total += b - a
        if held:
            emit(held)

    def split(a: int, b: int, level: int) -> None:
        parts, deeper = _pieces(text[a:b], a, level, size)
        short: list[tuple[int, int]] = []
        for x, y in parts:
            if y - x < size:
                short.append((x, y))
                continue
            if short:
                gather(short)
                short = []
            if deeper >= len(SEPARATORS):
                gather([(x, y)])
            else:
                split(x, y, deeper)
        if short:
            gather(short)

    if text:
        split(0, len(text), 0)
    return out


def recursive(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (start, text) of the recursive splitter; chunks are smaller for short texts."""

    def one(t: str | None) -> list[tuple[int, str]]:
        return split_recursive(t, *sizes_for(len(t), size, overlap)) if t else []

    @F.arrow_udf(_kind(PIECE_FIELDS))
    def run(texts: pa.Array) -> pa.Array:
        return _lists((one(t.as_py()) for t in texts), PIECE_FIELDS)

    return run(text)


def paragraphs(text: Column, size: int = SIZE, overlap: int = PARAGRAPH_OVERLAP) -> Column:
    """Chunks of whole paragraphs, each beginning with the end of the last; a long paragraph is never cut. A fold over the paragraphs."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) > size) & (acc["cur"] != "")
        tail = F.when(F.length(acc["cur"]) > overlap, F.substring(acc["cur"], -overlap, overlap)).otherwise(acc["cur"])
        cur = F.when(full, tail).otherwise(acc["cur"])
        done = F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(cur != "", F.concat(cur, F.lit("\n\n"), p)).otherwise(p).alias("cur"))

    return F.aggregate(F.split(text, "\n\n"), start, add, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows on a regular grid."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def cut_article(text: str, size: int = SIZE, overlap: int = OVERLAP, trim_tail: bool = False) -> list[str]:
    """Windows that end at a space. A token longer than a window is cut rather than repeated.

    The last window is followed by one that repeats its end when over
    ``size - overlap`` characters were left; ``trim_tail`` leaves that out.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            space = text.rfind(" ", start, end)
            # a space so early that the next window would not move on is no place to end
            if space - overlap > start:
                end = space
        out.append(text[start:end].strip())
        if trim_tail and end >= len(text):
            break
        start = end - overlap
    return out


def article_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP, trim_tail: bool = False) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_article(t, size, overlap, trim_tail) if t is not None else [])

    return run(text)


def count_words(text: str) -> int:
    """A token counter without a vocabulary: words and single marks."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def sentence_chunks(sentences: list[str], counts: list[int], low: int = MIN_TOKENS, high: int = MAX_TOKENS, percent: int = SHARED_PERCENT) -> list[tuple[int, int, int]]:
    """(first, after, tokens) of chunks of sentences.

    A chunk is closed when the next sentence would exceed ``high`` and it has
    ``low`` already; the next begins with its last sentences, within
    ``percent`` of ``high``. A rest under ``low`` is dropped.
    """
    out, first, total, shared = [], 0, 0, high * percent // 100
    for k, n in enumerate(counts):
        if k > first and total + n > high and total >= low:
            out.append((first, k, total))
            first, total = k, 0
            while first > out[-1][0] and total + counts[first - 1] <= shared:
                first -= 1
                total += counts[first]
        total += n
    if counts and total >= low:
        out.append((first, len(counts), total))
    return out


TOKEN_FIELDS = {"chunk_number": T.IntegerType(), "text": T.StringType(), "token_count": T.IntegerType(), "sentence_count": T.IntegerType(), "char_count": T.IntegerType()}


def token_chunks(sentences: Column, counter: Callable[[str], int] = count_words, low: int = MIN_TOKENS, high: int = MAX_TOKENS, percent: int = SHARED_PERCENT) -> Column:
    """Chunks of an array of sentences by a token counter, such as a vocabulary's."""

    def one(s: list[str]) -> list[tuple]:
        cut = sentence_chunks(s, [counter(x) for x in s], low, high, percent)
        texts = [" ".join(s[a:b]) for a, b, _ in cut]
        return [(i, t, n, b - a, len(t)) for i, (t, (a, b, n)) in enumerate(zip(texts, cut, strict=True), 1)]

    @F.arrow_udf(_kind(TOKEN_FIELDS))
    def run(all_: pa.Array) -> pa.Array:
        return _lists((one(s.as_py() or []) for s in all_), TOKEN_FIELDS)

    return run(sentences)


def chapters(text: Column, size: int = CONTEXT) -> Column:
    """A long text cut before its chapter lines, neighbours joined again while under ``size``; stripped, blank ones left out."""
    parts = F.filter(F.split(text, r"(?im)(?=^CHAPTER\s)"), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(p) >= size)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(full, p).otherwise(F.concat(acc["cur"], p)).alias("cur"))

    joined = F.aggregate(parts, start, add, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    whole = F.when(F.length(text) <= size, F.array(text)).otherwise(joined)
    return F.filter(F.transform(whole, strip), lambda x: x != "")
