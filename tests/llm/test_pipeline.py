import pathlib
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from scriptorium.llm import common, queries
from tests.llm.test_operators import brute_hits, brute_links

BENCH = [(1, "benchmark words that must never be seen in any training text again"), (2, None)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, rows):
    top = tmp_path_factory.mktemp("sf")
    extra = [(500, "good prose with the usual of and to words, not one of which comes twice here: " + BENCH[0][1] + " and the rest of it is long enough to be kept by the rules", "en", "b", 1)]
    from tests.llm.conftest import DOCS

    spark.createDataFrame([*rows, *extra], DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def left_behind(spark):
    return {str(p) for p in pathlib.Path(common.shared_dir(spark)).glob("scriptorium-*/*")}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    tables = [[tuple(r) for r in docs.collect()]]
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        docs = apply(spark, docs, folder)
        assert k == 4 or docs.columns == columns
        docs.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        tables.append([tuple(r) for r in docs.collect()])
    good, unlike, clean, mixed, dealt = tables[1:]
    assert 0 < len(good) < len(tables[0]) and all(len((r[1] or "").split()) >= 20 for r in good)
    sets, roots = brute_links(good, 5, 80)
    assert len(unlike) == len(set(roots)) and len({r[1] for r in unlike}) == len(unlike)
    assert sorted(map(repr, clean)) == sorted(repr(r) for r in unlike if not brute_hits(r[1], BENCH)[1])
    assert len(clean) == len(unlike) - 1
    assert sorted(map(repr, mixed)) == sorted(map(repr, clean)) and len(dealt) == len(mixed)
    with common.scope(spark):
        before = left_behind(spark)
        assert corpus_pipeline.run(spark, folder).count() == len(dealt)
        assert left_behind(spark) - before
    assert left_behind(spark) == before  # a scope removes all that was staged inside


def test_slots_follow_the_mix(spark, tmp_path):
    from scriptorium.llm import mixing
    from tests.llm.conftest import DOCS

    rows = [(i, f"text {i}", "en", "abbcccc"[i % 7], 1) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (5, "another", "en", "a", 1), (None, None, None, None, None)], DOCS)
    place = {(r["doc_id"], r["text"]): r["position"] for r in mixing.mixed(docs).collect()}
    crc = {(i, zlib.crc32((t or "").encode()) if t else 0): p for (i, t), p in place.items()}
    corpus_pipeline.mixed(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    # read in another order: Parquet promises none
    out = corpus_pipeline.dealt(spark, spark.read.parquet(f"{tmp_path}/mixed").repartition(7), "").collect()
    assert len(out) == len(rows) + 2
    shards = {}
    for r in sorted(out, key=lambda r: (r["shard"], r["slot"])):
        shards.setdefault(r["shard"], []).append((r["slot"], crc[r["doc_id"], r["text_crc32"]]))
    for got in shards.values():
        assert [s for s, _ in got] == list(range(len(got)))
        assert [p for _, p in got] == sorted(p for _, p in got)


def test_registered():
    for n in range(1, 11):
        assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
