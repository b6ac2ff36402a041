"""Byte-pair merging against plain merging, and against a public vocabulary where there is one."""

import base64
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import chunk, tokens
from scriptorium.functions import text as tx

PUBLIC = "/opt/tokenizers"


def small_ranks(corpus: str, joins: int = 150) -> dict[bytes, int]:
    """A little vocabulary: single bytes, and the most frequent neighbours joined, again and again."""
    ranks = {bytes([i]): i for i in range(256)}
    parts = [[bytes([b]) for b in w.encode()] for w in re.findall(r" ?\S+", corpus)]
    for _ in range(joins):
        seen = {}
        for p in parts:
            for pair in zip(p, p[1:]):
                seen[pair] = seen.get(pair, 0) + 1
        if not seen:
            break
        a, b = max(seen, key=lambda k: (seen[k], k))
        ranks.setdefault(a + b, len(ranks))
        for p in parts:
            i = 0
            while i < len(p) - 1:
                if (p[i], p[i + 1]) == (a, b):
                    p[i : i + 2] = [a + b]
                i += 1
    return ranks


def plain_merge(piece: bytes, ranks) -> list[bytes]:
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.fixture(scope="module")
def ranks():
    r = random.Random(6)
    return small_ranks(" ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(300)) + " Über naïve 日本語 日本")


def test_merging_equals_plain_merging(ranks):
    r = random.Random(7)
    pieces = ["", "a", "日本語", " Über", "aaaaaaaa"] + ["".join(r.choice("abcde é") for _ in range(r.randrange(40))) for _ in range(300)] + ["ab" * 3000]
    for p in pieces:
        raw = p.encode()
        got = tokens.merged(raw, ranks)
        assert b"".join(got) == raw
        if len(raw) < 200:
            assert got == (plain_merge(raw, ranks) if raw not in ranks else [raw])


def test_counts_in_chunks(spark, ranks, tmp_path):
    (tmp_path / "v.txt").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in ranks.items()))
    assert tokens.read_ranks(spark, str(tmp_path / "v.txt")) == ranks
    count = tokens.counter(spark, ranks)
    text = "bad cab dead bee. " * 400
    n = sum(len(tokens.merged(m.group().encode(), ranks)) for m in re.finditer(tokens.PATTERN, text))
    assert count(text) == n and count("") == count(None) == 0
    df = spark.createDataFrame([(text,)], "text string").select(F.explode(chunk.token_chunks(tx.sentences(F.col("text")), count)).alias("c")).select("c.*")
    rows = df.collect()
    assert len(rows) > 1 and all(r.token_count <= 800 for r in rows)
    assert all(r.token_count == sum(count(s) for s in re.findall(r"[^.]+\.", r.text.replace(". ", ".")) if s) for r in rows)


@pytest.mark.skipif(not os.path.exists(f"{PUBLIC}/byte_bpe_50k.tiktoken"), reason="no public vocabulary here")
def test_a_public_vocabulary(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokens.read_ranks(spark, f"{PUBLIC}/byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=r" ?\p{L}+| ?[^\p{L}]", mergeable_ranks=ranks, special_tokens={})
    count = tokens.counter(spark, ranks, r" ?[^\W\d_]+| ?(?:[\W\d_])")
    for t in ("The tenant pays rent to the landlord.", "Der Mieter zahlt die Miete", "antidisestablishmentarianism " * 50, "x" * 5000):
        assert count(t) == len(own.encode_ordinary(t))
