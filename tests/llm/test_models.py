"""Centroid clustering, language-model scoring and phrase collocations against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import centroids, phrases, scoring

low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

# 11


def brute_clusters(rows, dim, k, rounds, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cs = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cs = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(cs)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=repr), cs


def vectors(n, dim=4):
    r = np.random.default_rng(5)
    some = [(int(i), [float(x) for x in np.round(r.normal(size=dim) + 3 * (i % 3), 1)]) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [nan, 0.0, 0.0, 0.0]), (904, [0.0, -inf, 0.0, 0.0]), (905, [1.0] * 5), (None, [0.5, 0.5, -0.25, 0.0]), (906, [])]
    return some + some[:20] + [some[0]] * 30 + [(950 + i, some[1][1]) for i in range(9)] + odd


@pytest.mark.parametrize("k", [1, 7, 30])
def test_clusters_match_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(centroids, "BATCH", 17)
    rows = vectors(120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(2)})
    got, cs = centroids.clustered(df.repartition(3), dim=4, k=k, rounds=4)
    want, want_cs = brute_clusters(rows, 4, k, 4)
    assert sorted(((r.id, r.cluster, r.distance) for r in got.collect()), key=repr) == want and cs.tolist() == want_cs
    table = centroids.report(got, cs).collect()
    inertia = Counter()
    for _, c, d in want:
        inertia[c] += d
    assert all(r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values()) for r in table) and len(table) == len(want)
    assert {r.centroid_sha256 for r in table} == {hashlib.sha256(",".join(map(str, cs[c].tolist())).encode()).hexdigest() for c in inertia}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=9), st.integers(0, 8))
def test_scan_from_any_old_centroid_finds_the_nearest(points, cs, old):
    x, c = np.array(points, dtype=np.int64), np.array(cs, dtype=np.int64)
    best, least = centroids.nearest(x, np.full(len(x), old % len(c)), c, *centroids.neighbours(c))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()  # argmin: the least number


def test_clusters_of_few_or_wild_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    none, cs = centroids.clustered(spark.createDataFrame([], schema), dim=4)
    assert none.count() == 0 and not len(cs) and centroids.report(none, cs).count() == 0
    two, cs = centroids.clustered(spark.createDataFrame([(1, [0.0] * 4), (2, [1.0] * 4)], schema), dim=4)
    assert sorted(r.distance for r in two.collect()) == [0, 0] and len(cs) == 2
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 4)], schema), dim=4)
    with pytest.raises(ValueError):
        centroids.clustered(two, dim=1 << 20)


# 13


def brute_phrases(rows, least, top=2000, max_n=5, percent=100):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for p in re.split(r"[.,;:!?\x0A-\x0D]", low(t)):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        long = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k]: 0 for p in long for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        for p, a in long.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in long.items():
            if inside.get(p, -1) * 100 >= percent * a:
                continue
            score, _, l, r = min((Fraction(1000 * a * n[lang], c[p[:k]] * c[p[k:]]).__floor__(), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("hot,held", [(1 << 20, 400_000), (6, 50)])
def test_collocations(spark, rows, hot, held, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", held)
    some = [(r[2], r[1]) for r in rows] + [("en", "A\x00b c\x01d A\x00b c\x01d\x02"), ("en", "tick\ttock  tick " * 40), (None, "Ünder  ünder, under under"), ("", "")] * 3
    df = spark.createDataFrame(some, "lang string, text string").withColumn("n", F.lit(1)).repartition(3)
    for least, top in ((1, 50), (4, 2000)):
        got = phrases.collocations(df, least=least, hot=hot, top=top)
        assert tuple(got.columns) == COLUMNS
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(some, least, top)


@pytest.mark.parametrize("numbered,bits", [(3, 27), (0, 6)])
def test_collocations_with_few_numbers_and_bits(spark, rows, numbered, bits, monkeypatch):
    monkeypatch.setattr(phrases, "NUMBERED", numbered)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    some = [(r[2], r[1]) for r in rows] + [("en", "A\x00b c\x01d A\x00b c\x01d\x02")] * 4
    df = spark.createDataFrame(some, "lang string, text string").repartition(3)
    assert sorted(tuple(r) for r in phrases.collocations(df, least=4, hot=6).collect()) == brute_phrases(some, 4)


def test_suffixes_are_few_and_small():
    """Rare words are not sent, equal suffixes are one, and a suffix takes numbers, not words."""
    common = [b"%dword" % i for i in range(50)]
    r = random.Random(3)
    text = b" ".join(x for i in range(5000) for x in (b"rare%d" % i, *(r.choice(common) for _ in range(6))))
    frequent = phrases.Frequent(27, [])
    for k in phrases._keys("en", common):
        at = int(k) >> 37
        frequent.bits[at >> 6] |= np.uint64(1 << (at & 63))
    sent = SimpleNamespace(value=({"en": common}, {}, frequent))
    got = pa.Table.from_batches(phrases._suffixes(5, 4, sent)(iter([pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, text])], names=["lang", "text"])])))
    made = sum(len(x.as_py()) // 4 for x in got.column("counts"))
    assert sum(np.frombuffer(x.as_py(), np.int32).sum() for x in got.column("counts")) == 2 * 5000 * 5  # of six words in a row, the last starts none
    assert made <= 5000 * 5 and got.nbytes < 16 * made


def test_collocations_of_nothing(spark, none):
    assert phrases.collocations(none).count() == 0
    blank = spark.createDataFrame([(None, None), ("en", " .,; ")], "lang string, text string")
    assert phrases.collocations(blank, least=1).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.lists(st.sampled_from([b"a", b"b", b"ab", b"\xc3\xa9"]), min_size=1, max_size=4).map(phrases.SEP.join), st.integers(1, 9), max_size=30))
def test_one_stack_counts_all_prefixes(suffixes):
    want = Counter()
    for s, n in suffixes.items():
        w = s.split(phrases.SEP)
        for k in range(1, len(w) + 1):
            want[tuple(w[:k])] += n
    got = [(tuple(w), n) for w, n in phrases.stacked(sorted(suffixes.items(), reverse=True))]
    assert Counter(dict(got)) == want and len(got) == len(want)


# 12


def floor_level(c):
    return max((int(x) for x in scoring.LEVELS if x <= c), default=0)


def brute_scores(rows, mu):
    tokens = [([*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None], zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1) for i, t in rows]
    c, two, texts = Counter(), Counter(), 0
    for w, held in tokens:
        if not held:
            c.update(w)
            two.update(zip(["<s>", *w], w))
            texts += 1
    total, v = sum(c.values()), len(c)
    one = lambda w: (c[w] + 0.5) / (total + 0.5 * (v + 1))
    out = []
    for (i, _), (w, held) in zip(rows, tokens, strict=True):
        logs = [math.log10((floor_level(two[a, b]) + mu * one(b)) / ((texts if a == "<s>" else c[a]) + mu)) for a, b in zip(["<s>", *w], w)]
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10(one(x)) for x in w), sum(logs)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,segment,piece,passes", [(16 << 20, 1 << 19, 64 << 20, 4), (20_000, 500, 3_000, 99), (20_000, 500, 3_000, 0)])
def test_scores_match_brute_force(spark, docs, rows, chunk, segment, piece, passes, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_PASSES", passes)
    monkeypatch.setattr(scoring, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(scoring, "SEGMENT", segment)
    got = scoring.scored(docs.withColumns({"held": F.lit("x"), "chunk": F.lit(1), "code": F.lit(2)}), piece=piece).collect()
    want = brute_scores([(r[0], r[1]) for r in rows], scoring.MU)
    got = sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    # a false positive of the filter can only raise a score, and is rare
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) and a[6] >= b[6] - 1e-6 for a, b in zip(got, want, strict=True))
    assert sum(a[6] - b[6] > 0.01 * a[2] for a, b in zip(got, want, strict=True)) <= 1
    assert sum(math.isclose(a[6], b[6], rel_tol=1e-9) for a, b in zip(got, want, strict=True)) > len(want) / 2


def test_pieces_do_not_change_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(scoring, "SEGMENT", 500)
    key = lambda df: sorted(((r.id, round(r.score, 6)) for r in df.collect()), key=repr)
    one = key(scoring.scored(docs))
    monkeypatch.setattr(scoring, "MOST_PASSES", 99)
    assert key(scoring.scored(docs, piece=2_000)) == one
    monkeypatch.setattr(scoring, "MOST_PASSES", 0)  # the filter stays where it is
    assert key(scoring.scored(docs)) == one


@pytest.mark.parametrize("passes", [0, 4])
def test_scores_of_nothing(spark, none, passes, monkeypatch):
    assert scoring.scored(none).count() == 0
    monkeypatch.setattr(scoring, "MOST_PASSES", passes)
    assert scoring.scored(none).count() == 0
    one = scoring.scored(spark.createDataFrame([(1, None), (None, "a B a")], "doc_id long, text string"), held=F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in one} == {(1, 0, 0, 0.0, 0.0), (4, 0, 0, 0.0, 0.0)}


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 5000), min_size=1, max_size=60))
def test_filter_never_counts_too_little(counts):
    keys, c = np.array(list(counts), dtype=np.uint64), np.array(list(counts.values()))
    piece = scoring.Piece([(0, scoring.filled(keys, c).tobytes())], 1)
    got = piece.counts(keys, np.full(len(keys), 1 << 40))
    assert (got >= [floor_level(x) for x in c]).all()
    assert (piece.counts(keys, c) == [floor_level(x) for x in c]).all()  # the bound keeps it there
    assert not piece.counts(keys, np.zeros(len(keys), dtype=np.int64)).any()


def test_false_positives_are_few():
    r = np.random.default_rng(1)
    keys, c = r.integers(0, 2**63, 20_000).astype(np.uint64), r.integers(1, 30, 20_000)
    piece = scoring.Piece([(0, scoring.filled(keys, c).tobytes())], 1)
    other = r.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
    assert (piece.counts(other, np.full(20_000, 99)) > 0).mean() < 0.01


@pytest.mark.parametrize("n", [0, 1, 50, 999])
@pytest.mark.parametrize("kind", ["<u4", "<u8"])
def test_packed_round_trip(n, kind):
    x = np.random.default_rng(2).integers(0, 1 << 63, n).astype(kind)
    assert (scoring.unpacked(scoring.packed(x), kind) == x).all()


def test_segments_are_ranges_of_keys():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64))
    for n in (1, 7, 1 << 20):
        s = scoring.segment_of(keys, n)
        assert (np.diff(s) >= 0).all() and s.min() >= 0 and s.max() < n


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = scoring.scored(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] > r[1] and r[2] > 1000
