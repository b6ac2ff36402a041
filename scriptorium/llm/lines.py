"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, connected groups.

1. Lines are normalised (A-Z lower-cased, runs of other than digits, letters
   and non-ASCII become one space). Equal normalised lines are one line from
   here on. Its features are its words, or, if it has under ``MIN_WORDS`` of
   them but ``MIN_CHARS`` bytes or more (scripts without spaces), its pairs of
   adjacent characters. Shorter lines are compared for equality only.
2. A line's SimHash is dealt into blocks: a feature votes in one block only, by
   its hash. Lines whose features differ by fewer than there are blocks agree
   on one at least (pigeonhole), however the votes fall. ``LEVELS`` has more
   blocks for longer lines, so that a block holds a few features at any length;
   lines near the end of a level, where a partner may be in the next, have the
   blocks of both. Short lines' blocks count within lines of the same number of
   features, or one more. A block of a few short (so frequent) words would be
   shared by too many lines: a key reaches over the next blocks until it holds
   ``ENOUGH`` bytes of features.
3. Lines that agree on a block are compared by their whole SimHash, part against
   part (``groups``): only lines within ``NEAR`` bits are linked. No pairs
   are made, only spanning forests; their components are candidate groups.
4. In groups, part against part again, lines within ``NEAR`` bits and of edit
   similarity 1 - distance / longer length >= ``SIMILARITY`` are linked; a
   byte-histogram bound and words in step decide most without a distance.
5. Of every connected group the first occurrence, by (id, line), stays.

Defined results: null and empty texts have no lines to judge; blank lines stay;
a document that loses lines keeps the others in order; ties between equal ids
go to the lesser text hash; rows equal in id and text are one document to the
comparison, so they lose the same lines; an empty table gives an empty result;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import components, counted, fresh, stage
from scriptorium.llm.groups import SMALL, Forest, in_parts
from scriptorium.llm.repeats import digest, grouped, mix, spans, word_symbols

MIN_WORDS, MIN_CHARS = 5, 32
#: (most features, blocks) of each level of line length.
LEVELS = ((12, 3), (30, 5), (80, 8), (160, 12), (400, 20), (1 << 40, 32))
#: Bytes of features, or share of the line's, that a key has to hold at least.
ENOUGH, ENOUGH_OF = 16, 0.34
#: Most differing bits of whole SimHashes (64 bits); unrelated lines differ in nearly half.
NEAR = 16
#: Percent of the longer line's length that must be left after the edit distance.
SIMILARITY = 85
#: Features whose bits are added up together.
_STEP = 1 << 14
#: Bits of the numbers that compute many distances at once.
_LANES = 1 << 16
#: Words looked ahead for a place where two lines agree again.
_REACH = 2000
#: Keys that a task holds before it sends them on, and parts of keys for each shuffle partition.
_HELD, _PARTS = 1 << 20, 4
#: Lines that a task keeps in mind, so as not to send a repeated line's keys again.
_KNOWN = 1 << 20

#: A-Z to a-z; digits, letters, non-ASCII and line ends as they are; else a space.
_PLAIN = bytes(c if c >= 128 or c == 10 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normal_lines(text: bytes) -> list[bytes]:
    t = text.translate(_PLAIN)
    while b"  " in t:
        t = t.replace(b"  ", b" ")
    return t.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


def features(line: bytes) -> bytes | None:
    """What a line is judged by, separated by spaces; None for lines that only equality can tell."""
    if line.count(b" ") >= MIN_WORDS - 1:
        return line
    if len(line) < MIN_CHARS:
        return None
    chars = line.replace(b" ", b"").decode()
    return " ".join(map("".join, zip(chars, chars[1:]))).encode() or None


def weighed(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes, their bytes (8 at most), and the number of features of each line."""
    sizes: list[np.ndarray] = []
    sym, count = word_symbols(bodies, sizes)
    return sym, np.minimum(np.concatenate(sizes), 8), count


def _lanes(sym: np.ndarray) -> np.ndarray:
    """The bits of each feature as a byte a bit, eight to a word, to be added up eight at a time."""
    return np.unpackbits(mix(sym + np.uint64(1)).view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)


def _votes(sym: np.ndarray, edge: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each segment (from ``edge``, of ``size`` features) and each bit, how many of its features have the bit."""
    if size.max() <= 255:  # bytes do not overflow
        out = np.empty((len(edge), 64), dtype=np.uint8)
        at = 0
        while at < len(edge):
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + _STEP)))
            out[at:to] = np.add.reduceat(_lanes(sym[edge[at] : edge[to] if to < len(edge) else None]), edge[at:to] - edge[at], axis=0).view(np.uint8)
            at = to
        return out
    votes = np.zeros((len(edge), 64), dtype=np.int32)
    seg = np.repeat(np.arange(len(edge)), size)
    for first in range(0, len(sym), _STEP):
        own = seg[first : first + _STEP]
        at = np.arange(first, first + len(own))
        cut = np.flatnonzero(((at - edge[own]) % 255 == 0) | (at == first))
        np.add.at(votes, own[cut], np.add.reduceat(_lanes(sym[first : first + _STEP]), cut, axis=0).view(np.uint8))
    return votes


def _signs(votes: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.packbits(votes > (of // 2).astype(votes.dtype)[:, None], axis=1).view(np.uint64).ravel()


def _blocked(sym: np.ndarray, weight: np.ndarray, count: np.ndarray, blocks: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lines' blocks, which blocks have any feature, and whole SimHashes."""
    n = len(count)
    line = np.repeat(np.arange(n), count)
    block = ((sym >> np.uint64(40)) * np.uint64(blocks)) >> np.uint64(24)
    seg = line * blocks + block.astype(np.int64)
    order = np.argsort((seg.astype(np.uint64) << np.uint64(38)) | (sym & np.uint64((1 << 38) - 1)))
    sym, own = sym[order], seg[order]
    # the second, third, ... of a feature counts as another, or a frequent word would outvote all others of its block
    new = np.ones(len(sym), dtype=bool)
    new[1:] = (sym[1:] != sym[:-1]) | (own[1:] != own[:-1])
    at = np.arange(len(sym))
    nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    voter = np.where(new, sym, mix(sym ^ nth))
    edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    used, size = own[edge], np.diff(np.append(edge, len(own)))
    votes = _votes(voter, edge, size)
    value = np.zeros(n * blocks, dtype=np.uint64)
    value[used] = mix(_signs(votes, size) + size.astype(np.uint64))
    value = value.reshape(n, blocks)
    lines = np.searchsorted(used, np.arange(n) * blocks)
    if votes.dtype == np.uint8 and count.max() <= 255:
        whole = _signs(np.add.reduceat(votes.view(np.uint64), lines, axis=0).view(np.uint8), count)
    else:
        whole = _signs(np.add.reduceat(votes, lines, axis=0, dtype=np.int32), count)
    heavy = np.zeros(n * blocks)
    heavy[used] = np.add.reduceat(weight[order], edge)
    heavy = heavy.reshape(n, blocks)
    need = np.minimum(ENOUGH, heavy.sum(axis=1) * ENOUGH_OF)
    some = heavy > 0
    place = mix(np.arange(blocks, dtype=np.uint64) + np.uint64(level << 8))
    keys, got = mix(value ^ place), heavy.copy()
    short = np.flatnonzero((some & (got < need[:, None])).ravel())
    for step in range(1, blocks):
        if not len(short):
            break
        at, to = short // blocks, (short % blocks + step) % blocks
        flat = keys.reshape(-1)
        flat[short] = mix(flat[short] ^ mix(value[at, to] + np.uint64(step)))
        got.reshape(-1)[short] += heavy[at, to]
        short = short[got.reshape(-1)[short] < need[at]]
    return keys, some, whole


def simhash(sym: np.ndarray, weight: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block keys of all lines in order, how many each line has, and its whole SimHash.

    ``sym`` are feature hashes, ``weight`` their bytes, ``count`` of each line (at least 1).
    """
    level = np.searchsorted(np.array([most for most, _ in LEVELS]), count)
    codes = np.zeros(len(count), dtype=np.uint64)
    lines, found = [], []
    for k, (_, blocks) in enumerate(LEVELS):
        # its own level, and the next one near the end
        here = (level == k) | ((level == k - 1) & (count * 6 // 5 + 1 > LEVELS[k - 1][0]))
        if not here.any():
            continue
        who, mine = np.flatnonzero(here), np.repeat(here, count)
        keys, some, whole = _blocked(sym[mine], weight[mine], count[who], blocks, k)
        own = level[who] == k
        codes[who[own]] = whole[own]
        if k == 0:  # within lines of the same number of features, or one more
            n = count[who].astype(np.uint64)[:, None]
            keys, some = np.concatenate((mix(keys + n), mix(keys + n + np.uint64(1))), axis=1), np.concatenate((some, some), axis=1)
        found.append(keys[some])
        lines.append(np.repeat(who, some.sum(axis=1)))
    line = np.concatenate(lines)
    return np.concatenate(found)[np.argsort(line, kind="stable")], np.bincount(line, minlength=len(count)), codes


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ka, kb, id, line, lid, keys, code) of every line that is not blank.

    Lines that only equality can tell have no keys, and neither have repeats of a line in a task, nor a code.
    """
    known: set[int] = set()
    for batch in batches:
        for first, texts in grouped(batch.column(2)):
            doc, at, lids, judged, bodies = [], [], [], [], []
            for i, t in enumerate(texts):
                for j, line in enumerate(normal_lines(t)):
                    if line:
                        lid = digest(line)
                        if lid not in known and (body := features(line)):
                            if len(known) >= _KNOWN:
                                known.clear()
                            known.add(lid)
                            judged.append(len(doc))
                            bodies.append(body)
                        doc.append(first + i)
                        at.append(j)
                        lids.append(lid)
            if not doc:
                continue
            sizes, codes = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.uint64)
            flat = pa.array([], pa.int64())
            if bodies:
                keys, sizes[judged], codes[judged] = simhash(*weighed(bodies))
                flat = pa.array(keys.view(np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 1, 3)), pa.array(at, pa.int32()), pa.array(np.array(lids, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, flat), pa.array(codes.view(np.int64))], names=["ka", "kb", "id", "line", "lid", "keys", "code"])


def _dealt(parts: int):
    """(part, keys, lids) of lines with keys: all keys, packed by ranges of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            key, lid = np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held])
            part = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            key, lid, part = key[order], lid[order], part[order]
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            ends = list(zip(cut[:-1], cut[1:], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in ends], pa.binary()) for x in (key, lid))], names=["part", "keys", "lids"])

        held, size = [], 0
        for batch in batches:
            keys = batch.column(1)
            key = keys.flatten().to_numpy()
            held.append((key, np.repeat(batch.column(0).to_numpy(), np.diff(keys.offsets.to_numpy()))))
            size += len(key)
            if size >= _HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _shared_keys(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, lid, a, b) of a part's keys that two lines or more have: each line once, and the least and the greatest."""
    root, lid = (np.concatenate(x) for x in zip(*((np.frombuffer(k.as_py(), dtype=np.int64), np.frombuffer(x.as_py(), dtype=np.int64)) for b in batches for k, x in zip(b.column(1), b.column(2), strict=True)), strict=True))
    order = np.argsort(root)
    root, lid = root[order], lid[order]
    cut = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
    a, b, size = np.minimum.reduceat(lid, cut), np.maximum.reduceat(lid, cut), np.diff(np.append(cut, len(root)))
    stay = np.repeat(a != b, size)
    root, lid, a, b = root[stay], lid[stay], np.repeat(a, size)[stay], np.repeat(b, size)[stay]
    order = np.lexsort((lid, root))
    root, lid, a, b = root[order], lid[order], a[order], b[order]
    new = np.ones(len(root), dtype=bool)
    new[1:] = (root[1:] != root[:-1]) | (lid[1:] != lid[:-1])
    yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (root, lid, a, b)], names=["root", "lid", "a", "b"])


def _in_step(x: list[str], y: list[str], i: int, j: int, reach: int) -> tuple[int, int]:
    """How far to go from i and j, ``reach`` words at most, to words that agree again; or to the ends."""
    for d in range(1, 9):
        for p in range(d + 1):
            if i + p < len(x) and j + d - p < len(y) and x[i + p] == y[j + d - p]:
                return p, d - p
    # a longer passage on one side: the next three words in a row that both have
    there: dict[tuple, int] = {}
    for q in range(min(reach, len(y) - j - 2)):
        there.setdefault((y[j + q], y[j + q + 1], y[j + q + 2]), q)
    for p in range(min(reach, len(x) - i - 2)):
        if (q := there.get((x[i + p], x[i + p + 1], x[i + p + 2]))) is not None:
            return p, q
    return len(x) - i, len(y) - j


def _near_small(columns: dict[str, np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one small group within ``NEAR`` bits."""
    code, out = columns["code"], []
    for step in range(1, SMALL):
        same = np.flatnonzero(group[step:] == group[:-step])
        out.append((same, same + step))
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    ok = np.bitwise_count((code[i] ^ code[j]).view(np.uint64)) <= NEAR
    return i[ok], j[ok]


def at_most(a: str, b: str, most: int = 1 << 60) -> int:
    """A number that the edit distance does not exceed: words in step, with the words between them replaced. Over ``most``, any."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = _in_step(x, y, i, j, min(_REACH, (most - cost) // 2 + 1))  # a word and its space are two edits
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        i, j = i + p, j + q
        if cost > most:
            return max(cost, len(a) + len(b))
    return cost + max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j)


def runs(t: str) -> np.ndarray:
    """How many runs of three characters a text has in each of 4096 hash buckets."""
    c = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    return np.bincount((c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20), minlength=4096).astype(np.int32)


def at_least(a: np.ndarray, b: np.ndarray) -> int:
    """A number that the edit distance of texts with these ``runs`` is not under: an edit undoes three of them at most."""
    gap = a - b
    more = int(np.maximum(gap, 0).sum())
    return -(-max(more, more - int(gap.sum())) // 3)


def _least(plus: int, minus: int, rows: int, column: int, columns: int) -> int:
    """What the distance cannot be under, from the steps down a column: its cells and what is left of either string."""
    down = [np.unpackbits(np.frombuffer(x.to_bytes(-(-rows // 8), "little"), dtype=np.uint8), bitorder="little", count=rows).astype(np.int32) for x in (plus, minus)]
    cells = column + np.concatenate(([0], np.cumsum(down[0] - down[1])))
    return int((cells + np.abs(rows - columns + column - np.arange(rows + 1))).min())


def _shared(a: str, b: str) -> int:
    return len(set(a.split(" ")) & set(b.split(" ")))


def _same(a: str, b: str) -> int:
    """How many characters two texts have in common at their beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # the first low are equal, and no more than high
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or a number over ``most``; bit-parallel, after common ends are cut off."""
    i = _same(a, b)
    a, b = a[i:], b[i:]
    i = _same(a[::-1], b[::-1])
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):  # a turn a character of the shorter one
        a, b = b, a
    if len(b) > 256 and _shared(a[:200], b[:200]) > _shared(a[-200:], b[-200:]):
        a, b = a[::-1], b[::-1]  # begin where they differ most, to be over ``most`` early
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    all_, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = all_, 0, len(a)
    for k, c in enumerate(b):
        eq = where.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(d | plus) & all_), plus & d
        score += bool(up & last) - bool(down & last)
        up = (up << 1 | 1) & all_
        plus, minus = (down << 1 & all_) | (~(x | up) & all_), up & x
        if score - (len(b) - 1 - k) > most or k % 64 == 63 and k + 1 < len(b) and _least(plus, minus, len(a), k + 1, len(b)) > most:
            return most + 1
    return score


def distances(a: str, others: list[str]) -> list[int]:
    """Edit distances from ``a``, bit-parallel for many at once: each has a lane of a wide number, with a spare bit for carries."""
    n, out = len(a), [len(a)] * len(others)
    if not n:
        return [len(b) for b in others]
    width = n // 8 + 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    none, full = bytes(width), (1 << n) - 1
    lane = defaultdict(lambda: none, {c: v.to_bytes(width, "little") for c, v in where.items()})
    per = max(1, _LANES // (8 * width))
    for first in range(0, len(others), per):
        texts = others[first : first + per]
        all_, ones = (int.from_bytes(x.to_bytes(width, "little") * len(texts), "little") for x in (full, 1))
        ends: dict[int, list[int]] = {}
        for k, b in enumerate(texts):
            ends.setdefault(len(b), []).append(k)
        plus, minus = all_, 0
        for column, chars in enumerate(zip_longest(*texts, fillvalue=""), 1):
            eq = int.from_bytes(b"".join(map(lane.__getitem__, chars)), "little")
            x = eq | minus
            d = ((((eq & plus) + plus) ^ plus) | eq) & all_
            up, down = minus | ((d | plus) ^ all_), plus & d
            up = (up << 1 | ones) & all_
            plus, minus = (down << 1 & all_) | ((x | up) ^ all_), up & x
            for k in ends.get(column, ()):
                at = 8 * width * k
                out[first + k] = column + (plus >> at & full).bit_count() - (minus >> at & full).bit_count()
    return out


def _near(group: dict[str, list], left: int) -> Iterator[tuple[int, np.ndarray]]:
    m = np.array(group["code"], dtype=np.int64)
    for i in range(left or len(m) - 1):
        first = left or i + 1
        yield i, first + np.flatnonzero(np.bitwise_count((m[first:] ^ m[i]).view(np.uint64)) <= NEAR)


def _close_two(a: str, b: str) -> bool:
    """Whether two lines are linked, if their SimHashes allow it."""
    most = max(len(a), len(b)) * (100 - SIMILARITY) // 100
    return abs(len(a) - len(b)) <= most and (at_most(a, b, most) <= most or at_least(runs(a), runs(b)) <= most and distance(a, b, most) <= most)


def _close(group: dict[str, list], left: int) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links: what is linked already needs no distance."""
    lines = [x.decode() for x in group["text"]]
    if len(lines) == 2:  # most groups: the bounds below would cost more than they save
        near = ((group["code"][0] ^ group["code"][1]) & ((1 << 64) - 1)).bit_count() <= NEAR
        yield 0, np.array([1] if near and _close_two(*lines) else [], dtype=np.int64)
        return
    code = np.array(group["code"], dtype=np.int64)
    size = np.array([len(x) for x in lines])
    tally = np.stack([np.bincount(np.frombuffer(x, dtype=np.uint8), minlength=256) for x in group["text"]]).astype(np.int16 if size.max() < 8000 else np.int32)
    # an edit of a character changes one byte either way, or four where characters are not ASCII
    width = np.where(tally[:, 128:].any(axis=1), 4, 1)
    forest, seen, later = Forest(len(lines)), {}, []
    for i in range(left or len(lines) - 1):
        j = np.arange(left or i + 1, len(lines))
        most = np.maximum(size[i], size[j]) * (100 - SIMILARITY) // 100
        may = (np.bitwise_count((code[j] ^ code[i]).view(np.uint64)) <= NEAR) & (np.abs(size[i] - size[j]) <= most)
        j, most = j[may], most[may]
        gap = tally[j] - tally[i]
        more = np.maximum(gap, 0).sum(axis=1)
        may = np.maximum(more, more - gap.sum(axis=1)) // np.maximum(width[j], width[i]) <= most
        hit, open_ = [], []
        for k, m in zip(j[may].tolist(), most[may].tolist(), strict=True):
            if forest.root(k) != forest.root(i):
                if at_most(lines[i], lines[k], m) <= m:
                    forest.join(i, k)
                    hit.append(k)
                else:
                    open_.append((k, m))
        if open_:
            later.append((i, np.array(open_, dtype=np.int32)))
        yield i, np.array(hit, dtype=np.int64)
    # distances last: by now most of these are linked by way of others
    for i, pairs in later:
        hit, open_ = [], []
        for k, m in pairs.tolist():
            if forest.root(k) != forest.root(i):
                for x in (i, k):
                    if x not in seen:
                        seen[x] = runs(lines[x])
                if at_least(seen[i], seen[k]) <= m:
                    open_.append((k, m))
        far = distances(lines[i], [lines[k] for k, _ in open_]) if len(open_) > 1 else [distance(lines[i], lines[k], m) for k, m in open_]
        for (k, m), d in zip(open_, far, strict=True):
            if d <= m and forest.join(i, k):
                hit.append(k)
        yield i, np.array(hit, dtype=np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, spots = batch.column(batch.schema.get_field_index("raw")), batch.column(batch.schema.get_field_index("spots"))
        for i in range(batch.num_rows):
            lines = normal_lines(raw[i].as_py())
            got = spots[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([x["lid"] for x in got], pa.int64()), pa.array([x["root"] for x in got], pa.int64()), pa.array([x["code"] for x in got], pa.int64()), pa.array([lines[x["line"]] for x in got], pa.binary())], names=["lid", "root", "code", "text"])


def repeated_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(ka, kb, gone): for each document that loses any, the numbers of its lines that repeat an earlier one."""
    rows = docs.select(F.xxhash64(id).alias("ka"), F.xxhash64(text).alias("kb"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"), F.col(id).alias("id"))
    schema = T.StructType([*rows.schema.fields[:2], rows.schema["id"], T.StructField("line", T.IntegerType()), T.StructField("lid", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("code", T.LongType())])
    lines = stage(rows.mapInArrow(_lines, schema), "lines")
    # 2: blocks of two lines or more. Most keys are of one line, so they travel packed and only the others become rows
    parts = _PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = lines.where(F.size("keys") > 0).select("lid", "keys").mapInArrow(_dealt(parts), "part int, keys binary, lids binary")
    shared = stage(packed.groupBy("part").applyInArrow(_shared_keys, "root long, lid long, a long, b long"), "shared")
    same = F.sum(F.xxhash64("lid").cast("decimal(38,0)"))
    sizes = counted(shared.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.first("a").alias("a"), F.first("b").alias("b"), same.alias("same")))
    # most shared blocks have two lines: these are pairs at once; blocks with the same lines are one
    sizes = counted(sizes.groupBy("a", "b", "size", "same").agg(F.min("root").alias("root")))
    pairs = sizes.where("size = 2").select("a", "b")
    more = sizes.where("size > 2").select("root", "size")
    members = shared.select("root", "lid").join(more, "root")
    wanted = shared.select("lid").distinct()
    # one occurrence of each candidate gives its text
    judged = lines.where(F.size("keys") > 0).select("lid", "code", F.struct("ka", "kb", "line").alias("at"))
    once = stage(judged.join(counted(wanted).hint("shuffle_hash"), "lid").groupBy("lid").agg(F.first("code").alias("code"), F.min("at").alias("at")), "once")
    code = once.select("lid", "code")
    # 3
    close = pairs.join(code.select(F.col("lid").alias("a"), F.col("code").alias("x")), "a").join(code.select(F.col("lid").alias("b"), F.col("code").alias("y")), "b")
    close = close.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= NEAR).select("a", "b")
    members = members.join(code, "lid").select("root", F.lit(0).alias("space"), F.col("lid").alias("sid"), "code", "size")
    total = more.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = components(in_parts(members, F.lit(8), _near, "size", total, _near_small).unionByName(close)).withColumnRenamed("node", "lid")
    # 4
    spots = counted(once.join(groups, "lid").groupBy("at.ka", "at.kb").agg(F.collect_list(F.struct("lid", "root", "code", "at.line")).alias("spots")))
    texts = rows.select("ka", "kb", "raw").join(spots, ["ka", "kb"]).mapInArrow(_texts, "lid long, root long, code long, text binary")
    texts = stage(texts.groupBy("lid", "root").agg(F.first("code").alias("code"), F.first("text").alias("text")), "texts")
    members = texts.select("root", F.lit(0).alias("space"), F.col("lid").alias("sid"), "code", "text")
    links = components(in_parts(members, F.octet_length("text"), _close)).withColumnRenamed("node", "lid")
    # 5: the first occurrence of every group, and of every line, that there are two of
    order = F.struct(F.col("id").isNull().alias("z"), "id", "kb", "line")
    each = lines.select("lid", order.alias("order")).groupBy("lid").agg(F.count(F.lit(1)).alias("c"), F.min("order").alias("first"))
    each = counted(each.join(links, "lid", "left").where("c > 1 or root is not null"))
    joined = each.where("root is not null")
    least = joined.groupBy("root").agg(F.min("first").alias("first"))
    verdict = each.where("root is null").select("lid", "first").unionByName(joined.select("lid", "root").join(counted(least), "root").select("lid", "first"))
    gone = lines.select("ka", "kb", "line", "lid", order.alias("order")).join(counted(verdict), "lid").where(F.col("order") != F.col("first"))
    return counted(gone.groupBy("ka", "kb").agg(F.collect_set("line").alias("gone")))


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that stay in ``text``, ``n_lines``, ``n_removed`` and the numbers of ``removed_lines``.

    New names that clash get underscores in front.
    """
    a, b, gone = fresh(docs, "key_a", "key_b", "gone_")
    total, lost, which = fresh(docs, "n_lines", "n_removed", "removed_lines")
    out = docs.withColumn(a, F.xxhash64(id)).withColumn(b, F.xxhash64(text))
    found = repeated_lines(docs, id=id, text=text).select(F.col("ka").alias(a), F.col("kb").alias(b), F.sort_array("gone").alias(gone))
    out = out.join(found, [a, b], "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    count = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n"))
    out = out.withColumn(total, count.cast("long")).withColumn(text, kept).withColumn(lost, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    return out.withColumn(which, F.coalesce(F.col(gone), F.array().cast(T.ArrayType(T.IntegerType())))).drop(a, b, gone)


def query(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
