"""Registered queries read every document whole, against brute force in Python."""

import os

import pytest

from scriptorium import queries
from scriptorium.functions import chunk

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in queries.table(spark, SF, "documents").collect()}


def test_chunk_chapters(spark, texts):
    books = {}
    for r in sorted(queries.chunk_chapters(spark, SF).collect(), key=lambda r: (r["doc_id"], r["part"])):
        books.setdefault(r["doc_id"], []).append(r["body"])
    assert all(p == p.strip() for v in books.values() for p in v)
    assert {k: _squeezed("".join(v)) for k, v in books.items()} == {k: _squeezed("CHAPTER " + r["text"].replace("\n", "\nCHAPTER ")) for k, r in texts.items()}
    assert all(len(p) <= chunk.CONTEXT or p.count("CHAPTER ") == 1 for v in books.values() for p in v)


def test_article_order(spark, texts):
    want = sorted((f"{k}A" if k % 10 == 0 else str(k) for k in texts), key=lambda n: (n.endswith("A"), 0 if n.endswith("A") else int(n), n))
    assert [r["number"] for r in queries.article_order(spark, SF).collect()] == want


def test_context_format(spark, texts):
    want = {}
    for k, r in sorted(texts.items()):
        want.setdefault(k // 3, []).append(f"[Chunk {k % 3 + 1} - Relevance Score: {1 / (k + 1.3):.4f}]\n{r['text']}")
    assert {r["query_id"]: r["context"] for r in queries.context_format(spark, SF).collect()} == {k: "\n\n".join(v) for k, v in want.items()}


def test_dedupe_greedy(spark, texts):
    kept = {}
    for k, r in sorted(texts.items()):
        own = set(r["text"].lower().split())
        rest = kept.setdefault(r["source"], [])
        if not any(len(own & w) / max(len(own), len(w)) > 0.7 for _, w in rest if own and w):
            rest.append((k, own))
    assert sorted((r["source"], r["doc_id"]) for r in queries.dedupe_greedy(spark, SF).collect()) == sorted((s, k) for s, v in kept.items() for k, _ in v)


def test_vector_index_recall(spark):
    rows = queries.vec_index_recall(spark, SF).collect()
    assert len(rows) == 5 and all(r["wanted"] == 50 for r in rows)
    assert sum(r["hits"] for r in rows) >= 0.9 * sum(r["wanted"] for r in rows)


def test_dedupe_greedy_sees_whole_texts(spark, tmp_path):
    head = " ".join(f"w{i}" for i in range(100))
    rows = [(1, head + " " + " ".join(f"a{i}" for i in range(100)), "en", "s", 1), (2, head + " " + " ".join(f"b{i}" for i in range(100)), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.dedupe_greedy(spark, str(tmp_path)).count() == 2


def _squeezed(text):
    return "".join(text.split())


def test_extract_sections(spark, texts):
    for r in queries.extract_sections(spark, SF).collect():
        body = "".join(r[c] for c in ("facts", "issues", "rules", "application", "conclusion"))
        assert _squeezed(body) == _squeezed(texts[r["doc_id"]]["text"])


def test_case_chunks(spark, texts):
    length = {}
    for r in queries.case_chunks(spark, SF).collect():
        length[int(r["source_file_path"])] = length.get(int(r["source_file_path"]), 0) + r["content_length"]
    assert all(length.get(k, 0) >= len(_squeezed(r["text"])) for k, r in texts.items())


def test_payload_flatten(spark, texts):
    got = {r["doc_id"]: r["content"] for r in queries.payload_flatten(spark, SF).collect()}
    assert got == {k: r["text"] if k % 2 == 0 else r["source"] if k % 3 else "" for k, r in texts.items()}


def test_article_segment_lines_are_whole(spark, texts):
    bodies = {r["doc_id"]: r["body"] for r in queries.table(spark, SF, "documents").select("doc_id", queries._statute().alias("body")).collect()}
    for k, r in texts.items():
        rest = iter(bodies[k].split("\n"))
        assert all(any(x.endswith(line) for x in rest) for line in r["text"].split("\n"))
    assert queries.article_segment(spark, SF).count() > 0


def test_store_sides(spark, texts):
    quality = {}
    for r in queries.table(spark, SF, "labels").collect():
        quality[r["doc_id"]] = max(r["quality"], quality.get(r["doc_id"], 0))
    stored = texts.keys() & quality.keys()
    assert stored and texts.keys() - stored
    assert sorted(r["doc_id"] for r in queries.skip_existing(spark, SF).collect()) == sorted(texts.keys() - stored)
    status = {r["doc_id"]: r["status"] for r in queries.change_detection(spark, SF).collect()}
    assert status == {k: "skipped" if k in stored and quality[k] else "ingested" for k in texts}
    after = {r["doc_id"]: r["n"] for r in queries.upsert_by_group(spark, SF).collect()}
    pages = {-1 - r["page_id"]: len(r["html"]) for r in queries.table(spark, SF, "pages").collect()}
    assert after == {k: len(r["text"]) + 4 for k, r in texts.items()} | pages
