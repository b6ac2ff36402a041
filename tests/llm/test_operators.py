"""Every operator against a brute-force version on a table of hard cases, and on an empty one."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, decontam, jaccard, licenses, lines, mixing, quality, repeats, sharding, substring, suffix

SPACE = re.compile(r"[\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def split(t):
    return [w for w in SPACE.split(t or "") if w]


def bag(rows):
    return Counter(map(repr, rows))


# 9


def brute_quality(t):
    w = split(t)
    t = t or ""
    ls = [x for x in t.split("\n") if split(x)]
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(rep), failed


def test_quality(docs, none, rows):
    out = quality.measured(docs).select("doc_id", "quality.*")
    got = bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert got == bag((r[0], *brute_quality(r[1])) for r in rows)
    assert out.where("base_failed and kept").count() == 0
    kept = quality.keep_good(docs.withColumn("t_", F.lit(1)).withColumn("quality_verdict", F.lit(2)))
    assert kept.columns == [*docs.columns, "t_", "quality_verdict"] and kept.count() == out.where("kept").count() > 0
    assert quality.keep_good(none).count() == 0


# 1


def brute_hits(text, items, n=10, mask=False):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, names = low(text), set(), set()
    for k, t in items:
        iw = low(t)
        m = min(n, len(iw))
        for i in range(len(iw) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == iw[i : i + m]:
                    hit |= set(range(j, j + m))
                    names.add(k)
    if mask:
        return [j in hit for j in range(len(w))]
    return len(w), len(hit), sorted(str(k) for k in names if k is not None)


@pytest.fixture(scope="module")
def bench(spark, rows):
    long = max((r[1] for r in rows if r[1]), key=len).split(" ")
    items = [(1, " ".join(long[50:75]).upper().replace("Ü", "ü").replace("Ï", "ï")), (2, "ONE"), (10, " ".join(long[60:80])), (3, None), (4, "--"), (None, "two, words"), (5, "not to be found anywhere at all in these texts")]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [1 << 24, 40, 10])
def test_decontamination(docs, none, rows, bench, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)  # 40 and 10: one item a piece
    items, df = bench
    want = bag((r[0], *brute_hits(r[1], items)) for r in rows)
    wide = docs.withColumn("n_hit", F.lit("mine")).withColumn("runs_", F.lit(1)).withColumn("key_a", F.lit(2)).withColumn("__hit", F.lit(3)).withColumn("__key", F.lit(4))
    out = decontam.scanned(wide, df)
    assert "_n_hit" in out.columns and set(wide.columns) - {"text"} <= set(out.columns)
    got = bag((r["doc_id"], r["n_words"], r["_n_hit"], r["items"]) for r in map(lambda x: x.asDict(), out.collect()))
    assert got == want
    clean = decontam.decontaminated(wide, df)
    assert clean.columns == wide.columns and clean.count() == sum(not brute_hits(r[1], items)[1] for r in rows)
    assert {(r["__hit"], r["__key"], r["key_a"], r["runs_"]) for r in clean.collect()} == {(3, 4, 2, 1)}
    cut = decontam.decontaminated(docs, df, remove="spans")
    plain = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")).split()
    left = bag((r[0], [w for w, hit in zip(plain(r[1]), brute_hits(r[1], items, mask=True), strict=True) if not hit]) for r in rows)
    assert bag((r.doc_id, plain(r.text)) for r in cut.collect()) == left
    assert decontam.scanned(none, df).count() == 0
    assert decontam.scanned(docs, df.limit(0)).where("n_hit > 0").count() == 0


def test_spans_are_cut_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 15))), (2, " ".join(f"w{i}" for i in range(10, 22)))], "item_id long, text string")
    for limit in (10, 40, 1 << 24):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
        (r,) = decontam.decontaminated(docs, items, remove="spans").collect()
        assert r.text.split() == [f"w{i}" for i in range(40) if not 5 <= i < 22]


def test_window_arrays_take_five_times_the_text():
    items = [(i, " ".join(f"word{(i * 7919 + j * 104729) % 50021}" for j in range(60)).encode()) for i in range(2000)]
    assert decontam.Grams(items, 10).bytes() < 5 * sum(len(t) for _, t in items)


# 2


def edf(sizes, weights):
    """Slots by simulation, round by round."""
    left, out = dict(sizes), []
    while any(left.values()):
        jobs = [(k, min(weights[k], left[k])) for k in sorted(left) if left[k]]
        total, done = sum(n for _, n in jobs), Counter()
        for slot in range(total):
            due = [(math.ceil((done[k] + 1) * total / n), i, k) for i, (k, n) in enumerate(jobs) if done[k] < n and done[k] * total // n <= slot]
            k = min(due)[2]
            out.append((k, sizes[k] - left[k] + done[k]))
            done[k] += 1
        for k, n in jobs:
            left[k] -= n
    return out


def test_mixing(spark, docs, none):
    weights = {"a": 5, "b": 3, None: 2, "c": 1}
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 8, "b").when(F.col("id") % 10 < 9, "c").alias("source"), F.lit("x").alias("slot"), F.lit("y").alias("all_"), F.lit("z").alias("rank_"))
    rows = mixing.mixed(df, weights=weights, block_rows=7).collect()
    names = lambda s: "n" if s is None else f"s{s}"
    sizes = {k: -(-n // 7) for k, n in Counter(names(r.source) for r in rows).items()}
    want = edf(sizes, {names(k): w for k, w in weights.items()})
    rows.sort(key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1000))
    seen = list(dict.fromkeys((names(r.source), r.block) for r in rows))
    assert seen == want and all(want[r["_slot"]] == (names(r.source), r.block) for r in rows)
    done = Counter()  # while all sources run, each is within a block of its share
    for t, (k, _) in enumerate(want[: 11 * 5], 1):
        done[k] += 1
        assert all(abs(done[names(s)] - t * w / 11) < 1 for s, w in weights.items())
    got = mixing.mixed(docs)
    assert sorted(r.position for r in got.collect()) == list(range(docs.count()))
    assert mixing.in_mix_order(docs).columns == docs.columns
    assert mixing.mixed(none).count() == 0
    for bad in ({"a": 10**6, "b": 10**6}, {"a": 0}, {"a": 0.5}):
        with pytest.raises(ValueError):
            mixing.mixed(docs, weights=bad)
    with pytest.raises(Exception, match="sources"):
        mixing.mixed(spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))).collect()


# 3


def test_sharding(spark, docs, none, rows):
    big = docs.select("doc_id", "text").unionByName(spark.range(900).select((F.col("id") + 1000).alias("doc_id"), F.when(F.col("id") < 400, "hot").when(F.col("id") < 600, F.concat(F.lit("pair"), (F.col("id") / 2).cast("int"))).otherwise(F.concat(F.lit("own"), "id")).alias("text")))
    out = sharding.sharded(big, shards=7).collect()
    size = Counter(r.shard for r in out)
    assert set(size) <= set(range(7)) and max(size.values()) - min(size.values()) <= 1 and len(out) == big.count()
    for s, n in size.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    raw = lambda t: (t or "").encode()
    assert bag((r.doc_id, r["size"], r.text_crc32) for r in out) == bag((r.doc_id, len(raw(r.text)) + 16, zlib.crc32(raw(r.text))) for r in big.collect())
    text = {r.doc_id: r.text for r in big.collect() if r.doc_id is not None and r.doc_id >= 1000}
    where = defaultdict(set)
    for r in out:
        if r.doc_id in text:
            where[text[r.doc_id]].add(r.shard)
    assert len(where["hot"]) <= 6  # 400 rows do not fit three shards of 134 whole
    apart = sum(len(v) > 1 for k, v in where.items() if k.startswith("pair"))
    assert apart <= 10
    assert sharding.sharded(none).count() == 0
    one = bag((r.doc_id, r["size"], r.shard, r.slot) for r in sharding.sharded(big.coalesce(1), shards=7).collect())
    assert one == bag((r.doc_id, r["size"], r.shard, r.slot) for r in sharding.sharded(big.repartition(7, "text"), shards=7).collect())


def test_sharding_cuts_few_links(spark):
    # groups of 2, 3, ... rows, one of more than half a shard, one of two shards and a half
    text = F.when(F.col("id") < 250, "huge").when(F.col("id") < 310, "large").when(F.col("id") < 700, F.concat(F.lit("g"), F.floor(F.sqrt(F.col("id") * 3)).cast("string"))).otherwise(F.concat(F.lit("own"), "id"))
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), text.alias("text"))
    out = sharding.sharded(docs, shards=10).join(docs, "doc_id").cache()
    (r,) = sharding.cut_links(out, group="text").collect()
    least = 250 * 249 / 2 - 2 * 100 * 99 / 2 - 50 * 49 / 2
    assert r.links > r.cut_by_lot > 1.5 * r.cut and least <= r.cut <= 1.3 * least
    where = {}
    for x in out.collect():
        where.setdefault(x.text, set()).add(x.shard)
    assert len(where["large"]) == 1 and sum(len(v) > 1 for v in where.values()) <= 4


# 4


def brute_links(rows, width, percent):
    sets = []
    for r in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        w = split(w)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return sets, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60), (1, 30)])
def test_jaccard(docs, none, rows, width, percent):
    got = jaccard.linked(docs, width=width, percent=percent).collect()
    unique = list(dict.fromkeys((r[0], r[1]) for r in rows))
    sets, roots = brute_links(unique, width, percent)
    least = {}
    for (i, _), s, root in zip(unique, sets, roots, strict=True):
        if s:
            least[root] = min([x for x in (least.get(root), i) if x is not None], default=None)
    want = bag((i, len(s), least[root] if s else i) for (i, _), s, root in zip(unique, sets, roots, strict=True))
    assert bag((r.id, r.n, r.component) for r in got) == want
    one = jaccard.one_of_each(docs.withColumn("key_a", F.lit(1)), width=width, percent=percent)
    assert one.columns == [*docs.columns, "key_a"]
    assert one.count() == len({root if s else (i, "alone") for i, (s, root) in enumerate(zip(sets, roots, strict=True))})


def test_jaccard_empty(none):
    assert jaccard.linked(none).count() == 0


def test_hamming_bounds_the_difference():
    r, bands = np.random.default_rng(3), jaccard.Bands(85)
    for n in (1, 5, 40, 700):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        k = int(bands.differ(len(a), len(a))) // 2
        b = np.unique(np.concatenate((a[k:], r.integers(0, 1 << 63, k).astype(np.uint64))))
        space = bands.of(np.array([min(len(a), len(b))]))
        keys, sketch = zip(*[jaccard._space(np.zeros(len(x), dtype=np.int64), x, np.array([len(x)]), space, bands) for x in (a, b)], strict=True)
        x, y = (np.frombuffer(s[0], dtype=np.uint64) for s in sketch)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        assert set(keys[0][0].tolist()) & set(keys[1][0].tolist())


@pytest.mark.parametrize("percent", [30, 60, 67, 85])
def test_pairs_of_sizes_share_a_space(percent):
    bands = jaccard.Bands(percent)
    n = np.arange(1, 1500)
    own, least = bands.of(n), bands.of(-(-n * percent // 100))
    for a, space in zip(n.tolist(), own.tolist(), strict=True):
        b = n[(n >= a) & (n * percent <= 100 * a)]
        assert ((least[b - 1] <= space) & (space <= own[b - 1])).all()
        assert (bands.blocks[space] - bands.empty[space] > bands.differ(a, b)).all()


def test_words_that_polynomials_cannot_tell_apart(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert {r.n_removed for r in substring.without_repeats(df).collect()} == {0}
    two = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {(r.id, r.component) for r in jaccard.linked(two).collect()} == {(1, 1), (2, 2)}
    assert {tuple(r.removed_lines) for r in lines.without_repeats(two).collect()} == {()}
    want = [int(g.sum()) for g in brute_windows([a.encode(), b.encode()], 200)]
    assert {r.doc_id: r.n_removed for r in suffix.without_repeats(two).collect()} == {1: want[0], 2: want[1]}


# 5


def brute_chat(rows):
    convs = defaultdict(set)
    for c, t, role, text in rows:
        convs[c].add((t is None, t or 0, role is None, role or "", text is None, hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    said = {c: tuple((x[3] if not x[2] else None, x[6] if not x[4] else None) for x in sorted(v)) for c, v in convs.items()}
    out, groups = [], defaultdict(list)
    for c, s in said.items():
        groups[s].append(c)
    for s, cs in groups.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in groups):
            cs.sort(key=lambda c: (c is None, c))
            out.append((cs[0], len(s), len(cs), "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in s)))
    return out


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (4, 1, "assistant", "no"), (5, 5, "user", "hi"), (5, None, None, None), (None, 0, "user", "alone"), (6, 0, "assistant", "yo"), (7, 0, "user", None), (8, 0, "user", ""), (9, 0, "user", ""), (9, 1, "user", "x" * 100000), (10, 0, "a", "two"), (10, 0, "a", "three"), (11, 0, "a", "three"), (11, 0, "a", "two"), (11, 1, "b", ""), (None, 1, None, "more")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    assert bag(map(tuple, chat.rendered(df).collect())) == bag(brute_chat(rows))
    assert bag(map(tuple, chat.maximal(df).collect())) == bag(r[:3] for r in brute_chat(rows))
    assert chat.rendered(df.limit(0)).count() == 0


# 6 and 8


def brute_windows(seqs, k):
    count, out = Counter(), []
    for s in seqs:
        count.update(s[i : i + k] for i in range(len(s) - k + 1))
    for s in seqs:
        gone = np.zeros(len(s) + 1, dtype=int)
        for i in range(len(s) - k + 1):
            if count[s[i : i + k]] > 1:
                gone[i] += 1
                gone[i + k] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


@pytest.mark.parametrize("k,m", [(35, 8), (10, 4)])
def test_substring(docs, none, rows, k, m):
    seqs = [tuple(split(r[1])) for r in rows]
    want = bag((r[0], len(s), int(g.sum()), " ".join(w for w, x in zip(s, g, strict=True) if not x)) for r, s, g in zip(rows, seqs, brute_windows(seqs, k), strict=True))
    out = substring.without_repeats(docs.withColumn("rest", F.lit(1)).withColumn("n_words", F.lit(2)), k=k, m=m)
    assert out.columns == [*docs.columns, "rest", "n_words", "_n_words", "n_removed", "removed"]
    assert bag((r["doc_id"], r["_n_words"], r["n_removed"], r["text"]) for r in map(lambda x: x.asDict(), out.collect())) == want
    assert substring.without_repeats(none).count() == 0


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_suffix(docs, none, rows, monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD", shard)
    monkeypatch.setattr(suffix, "PART", 2 * shard)
    seqs = [(r[1] or "").encode() for r in rows]
    want = []
    for r, s, g in zip(rows, seqs, brute_windows(seqs, 200), strict=True):
        spans = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        want.append((r[0], len(s), int(g.sum()), spans, sha(np.frombuffer(s, dtype=np.uint8)[~g].tobytes())))
    out = suffix.without_repeats(docs)
    assert bag((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), sha(bytes(r.text))) for r in out.collect()) == bag(want)
    assert suffix.without_repeats(none).count() == 0


def test_hot_minimizer_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 600)
    monkeypatch.setattr(suffix, "PART", 1200)
    r = np.random.default_rng(1)
    core = bytes(r.integers(97, 123, 150).astype(np.uint8)).decode()
    side = ["".join(map(chr, r.integers(97, 123, 60))) for _ in range(6)]
    texts = [a + core + b for a in side for b in side]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seqs = [t.encode() for t in texts]
    want = {i: int(g.sum()) for i, g in enumerate(brute_windows(seqs, 200))}
    assert {x.doc_id: x.n_removed for x in suffix.without_repeats(df).collect()} == want


@pytest.mark.parametrize("n,letters", [(1, 2), (9, 1), (300, 1), (2000, 2), (2000, 200)])
def test_suffix_array(n, letters):
    t = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    b, keys = t.tobytes(), suffix.octets(t)
    order = suffix.suffix_array(t, keys)
    assert list(order) == sorted(range(n), key=lambda i: b[i:])
    lcp = suffix.common_prefixes(t, keys, order)
    for r in range(1, n):
        x, y = b[order[r - 1] :], b[order[r] :]
        assert lcp[r - 1] == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    r = np.random.default_rng(5)
    words = [f"w{x}".encode() for x in r.integers(0, 9999, 5000)]
    text = b" ".join(words)
    whole, n = repeats.word_symbols([text])
    monkeypatch.setattr(repeats, "CHUNK", 1 << 9)
    parts, m = repeats.word_symbols([text, b"x y", text])
    assert list(n) == [5000] and list(m) == [5000, 2, 5000]
    assert (parts[:5000] == whole).all() and (parts[5002:] == whole).all()
    seen = [(s, c) for _, a, b, _, _ in repeats.contexts(whole, n, 35, 8) for s, c in zip(a, b, strict=True)]
    assert sorted(i for s, c in seen for i in range(s, s + c)) == list(range(5000 - 34))


# 7


def test_licences(spark, docs, none):
    mit = "Copyright 2020\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    parts = mit.split("\n\n")
    cases = [(1, mit, ["MIT"]), (2, "\n\n".join([parts[2], parts[1]]), []), (3, "no stop\nReleased under the MIT License.\nmore", ["MIT"]), (4, "licensed under cc-by nc 4.0", ["CC-BY-NC-4.0"]), (5, "SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), (6, "", []), (7, None, []), (8, "x " * 50000 + "\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"])]
    df = spark.createDataFrame([(i, t) for i, t, _ in cases], "doc_id long, text string").withColumn("licences", F.lit("mine"))
    got = {r["doc_id"]: r["_licences"] for r in map(lambda x: x.asDict(), licenses.scanned(df).collect())}
    assert got == {i: w for i, _, w in cases}
    assert licenses.scanned(docs).count() == docs.count() and licenses.scanned(none).count() == 0


# 10


def brute_lines(rows):
    """Lines that go: (row, line) of all but the first occurrence of each group, by all pairs of distinct lines; and the links."""
    plain = lambda x: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x)))
    text = [[plain(x) for x in (r[1] or "").split("\n")] for r in rows]
    some = sorted({x for t in text for x in t if x and lines.features(x.encode())}, key=len)
    links = [(x, y) for i, x in enumerate(some) for y in some[i + 1 :] if len(y) - len(x) <= (m := len(y) * 15 // 100) and lines.distance(x, y, m) <= m]
    up = {}

    def root(x):
        while x in up:
            x = up[x]
        return x

    for x, y in links:
        if root(x) != root(y):
            up[root(x)] = root(y)
    seen, gone = {}, set()
    for i, j in sorted(((i, j) for i, t in enumerate(text) for j, x in enumerate(t) if x), key=lambda p: (rows[p[0]][0] is None, rows[p[0]][0] or 0, p[1])):
        r = root(text[i][j])
        if seen.setdefault(r, (rows[i], j)) != (rows[i], j):
            gone.add((i, j))
    return gone, links


def test_lines_equal_all_pairs(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)] + ["größe", "naïve", "the", "of"]
    base = [" ".join(r.choice(words, n)) for n in (1, 3, 5, 6, 9, 14, 25, 31, 60, 90, 200) for _ in range(6)] + ["漢字" * 30 + "x" * k for k in range(3)]
    rows = []
    for i in range(160):
        some = []
        for k in r.integers(0, len(base), 4).tolist():
            w = base[k].split(" ")
            for _ in range(int(r.integers(0, 3)) * len(w) // 15):
                w[r.integers(0, len(w))] = f"edit{r.integers(0, 99)}"
            some.append(" ".join(w).title() if r.random() < 0.3 else " ".join(w))
        rows.append((i, "\n".join(some)))
    rows += [(200, rows[0][1]), (None, rows[1][1]), (201, None), (202, ""), (203, "\n \n--\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], j) for x in lines.without_repeats(df).collect() for j in x["removed_lines"]}
    gone, links = brute_lines(rows)
    assert len(links) > 300
    want = {(rows[i][0], j) for i, j in gone}
    assert got <= want and len(got) >= 0.95 * len(want)  # links between short lines may be missed


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables are not here")
def test_block_recall(spark):
    """All pairs of the distinct lines of the small documents: blocks and SimHash lose at most one link in twenty."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    some = sorted({x for t in texts for x in lines.normal_lines(t.encode()) if x and lines.features(x)}, key=len)
    text = [x.decode() for x in some]
    size = np.array([len(t) for t in text])
    tally = np.stack([np.bincount(np.frombuffer(x, dtype=np.uint8), minlength=256) for x in some]).astype(np.int32)
    keys, per, code = lines.simhash(*lines.weighed([lines.features(x) for x in some]))
    keys = [set(x.tolist()) for x in np.split(keys, np.cumsum(per)[:-1])]
    links = found = 0
    for i in range(len(some)):
        j = np.arange(i + 1, np.searchsorted(size, size[i] / 0.85 + 1))
        gap = tally[j] - tally[i]
        bound = np.maximum(np.where(gap > 0, gap, 0).sum(axis=1), np.where(gap < 0, -gap, 0).sum(axis=1)) // 4
        for k in j[bound <= size[j] * 15 // 100].tolist():
            most = int(size[k]) * 15 // 100
            if lines.at_most(text[i], text[k]) <= most or (lines.at_least(lines.runs(text[i]), lines.runs(text[k])) <= most and lines.distance(text[i], text[k], most) <= most):
                links += 1
                found += bool(keys[i] & keys[k]) and int(code[i] ^ code[k]).bit_count() <= lines.NEAR
    assert links > 30 and found >= 0.95 * links


def test_lines(spark, none):
    long = "the quick brown fox jumps over the lazy dog near the river bank while many small birds sing in the tall green trees above"
    near = long.replace("lazy", "hazy")
    rows = [(1, f"{long}\nshort line"), (2, f"own words come first in this text\n{near}\n\nshort line"), (3, long.upper() + "!"), (3, long.upper() + "!"), (4, None), (5, ""), (None, long), (6, "é" * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("mine")).withColumn("gone_", F.lit(0)).withColumn("root", F.lit(1))
    out = lines.without_repeats(df)
    assert out.columns == ["doc_id", "text", "n_lines", "gone_", "root", "_n_lines", "n_removed", "removed_lines"]
    got = sorted(((r["doc_id"] or 0, r["text"], r["removed_lines"]) for r in map(lambda x: x.asDict(), out.collect())), key=str)
    want = [(1, rows[0][1], []), (2, "own words come first in this text\n", [1, 3]), (3, "", [0]), (3, "", [0]), (4, None, []), (5, "", []), (0, "", [0]), (6, rows[7][1], [])]
    assert got == sorted(want, key=str)
    assert lines.without_repeats(none).count() == 0


def test_edit_distance():
    def slow(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(q[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    r = np.random.default_rng(2)
    for _ in range(300):
        a, b = ("".join(r.choice(list("abé"), r.integers(0, 14))) for _ in range(2))
        d = slow(a, b)
        assert lines.distance(a, b, 99) == d
        assert (lines.distance(a, b, 3) <= 3) == (d <= 3)
        assert lines.at_least(lines.runs(a), lines.runs(b)) <= d <= lines.at_most(a, b)
    for n in (0, 1, 9, 70):
        a, *others = ("".join(r.choice(list("abé"), r.integers(0, n + 1))) for _ in range(40))
        assert lines.distances(a, others) == [slow(a, b) if a and b else len(a) + len(b) for b in others]
    for _ in range(30):  # long enough to be given up early
        a = "".join(r.choice(list("abcdé"), 400))
        b = "".join(r.choice(list("abcdé"), 150)) + a[r.integers(0, 150) : 380]
        d = slow(a, b)
        assert lines.distance(a, b, 999) == d
        for most in (d - 1, d, 60):
            assert (lines.distance(a, b, most) <= most) == (d <= most)


def test_short_lines(spark, tmp_path):
    long = "one line of more than five words that is only here"
    rows = [(1, f"{long}\nAll rights reserved.\n\nLes."), (2, "Les!\nall rights  reserved\n\n今日は良い天気ですね"), (3, "今日は良い天気ですね\nLesser"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r["removed_lines"] for r in lines.without_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert out == {1: [], 2: [0, 1], 3: [0], 4: []}
    assert {r["doc_id"]: r["n_removed"] for r in lines.query(spark, str(tmp_path)).collect()} == {1: 0, 2: 2, 3: 1, 4: 0}


def test_mpl_notice():
    notice = b"""This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
    starred = b"/* " + notice.replace(b"\n", b"\n * ") + b" */"
    for text in (notice, starred, notice.replace(b"Public\nLicense", b"Public License"), b"Some code.\n\n" + notice):
        assert licenses.licences([k for _, _, k in licenses.recognised(text)]) == ["MPL-2.0"]


def test_every_text_rule_holds_on_its_sentences():
    for licence, rule in licenses.TEXT_RULES:
        if licence.startswith("GPL"):  # the identifiers overlap: the notices are below
            continue
        text = ".\n\n".join(licenses.SENTENCES[k] for k in rule).encode() + b"."
        assert licence in licenses.licences([k for _, _, k in licenses.recognised(text)]), licence
    gpl = "This program is free software%s you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation%s either version %d of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY."
    for a, b, n in ((";", ";", 2), (":", ",", 3)):
        assert f"GPL-{n}.0" in licenses.licences([k for _, _, k in licenses.recognised((gpl % (a, b, n)).encode())])


def test_linked_lines_need_no_distance(monkeypatch):
    """Lines that are linked by way of others, and pairs that words in step decide, take no distance."""
    asked = []
    monkeypatch.setattr(lines, "distance", lambda a, b, most: asked.append((a, b)) or most + 1)
    monkeypatch.setattr(lines, "distances", lambda a, others: asked.extend((a, b) for b in others) or [1 << 40] * len(others))
    w = [f"word{i}" for i in range(40)]
    # words change places from the second line to the first, which words in step overrate, but not by way of the third
    a, b, c = " ".join(w), " ".join([*w[20:23], *w[:20], *w[23:]]), " ".join([*w[20:23], *w[:20], *w[20:]])
    group = {"code": [0, 0, 0], "text": [x.encode() for x in (a, b, c)]}
    most = max(map(len, (a, b))) * (100 - lines.SIMILARITY) // 100
    assert lines.at_most(a, b, most) > most >= max(lines.at_most(a, c, most), lines.at_most(b, c, most))
    found = [(i, j) for i, js in lines._close(group, 0) for j in js.tolist()]
    assert sorted(found) == [(0, 2), (1, 2)] and not asked


def test_shared_keys_by_parts():
    """Keys of two different lines become rows, each line once; a line that comes twice shares nothing with itself."""
    batch = pa.RecordBatch.from_arrays([pa.array([5, 3, 5, 9, 7], pa.int64()), pa.array([[1, -2], [-2], [1, -2], [4], []], pa.list_(pa.int64()))], names=["lid", "keys"])
    dealt = list(lines._dealt(4)(iter([batch.slice(0, 2), batch.slice(2)])))
    got = [r for b in dealt for i in range(b.num_rows) for out in lines._shared_keys((), iter([b.slice(i, 1)])) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert sorted(got) == [(-2, 3, 3, 5), (-2, 5, 3, 5)]
