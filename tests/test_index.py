"""Vector and keyword indexes against the exact operators; greedy near-duplicates against the fold."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions import vector
from scriptorium.operators import dedupe, keyword, ranking
from scriptorium.sources.keyword_index import KeywordIndex
from scriptorium.sources.vectors import VectorIndex, recall


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(4)
    near = lambda c: [c[i] + r.gauss(0, 0.35) for i in range(8)]
    centers = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, near(centers[0] if i % 3 == 0 else r.choice(centers)), f"t{i % 5}") for i in range(900)]
    rows += [(900, [0.0] * 8, "t0"), (901, None, "t1"), (902, rows[0][1], "t2")]
    return spark.createDataFrame(rows, "id long, embedding array<float>, tag string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex.build(vectors, str(tmp_path_factory.mktemp("ivf")), cells=16, sample=300)


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


def test_all_cells_are_exact(index, vectors, queries):
    assert index.rows().count() == vectors.count()  # every row is indexed, not the sample alone
    assert rows_of(index.search(queries, 20, None)) == rows_of(ranking.nearest_each(vectors, queries, 20))
    few = index.search(queries, 5, None, where=F.col("tag") == "t2")
    assert rows_of(few) == rows_of(ranking.nearest_each(vectors.where("tag = 't2'"), queries, 5))


def test_recall_grows_with_probes(index, vectors, queries):
    exact = ranking.nearest_each(vectors, queries, 20)
    found = []
    for probes in (1, 4, 16):
        r = recall(index.search(queries, 20, probes), exact).agg(F.sum("hits"), F.sum("wanted")).first()
        found.append(r[0] / r[1])
    assert found == sorted(found) and found[1] >= 0.9 and found[2] == 1.0


def test_other_cells_are_not_read(index, queries):
    one = queries.where("query_id = 100")
    read = index.candidates(index.probes(one, 2))
    cells = {r.cell for r in read.select("cell").distinct().collect()}
    assert len(cells) <= 3 and -1 in cells and 0 < read.count() < index.rows().count() / 2
    (scan,) = [x for x in plan_of(read).split("\n") if "PartitionFilters" in x][-1:]
    assert "cell#" in scan.split("PartitionFilters")[1].split("]")[0]  # so other cells' files are not opened


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_index_of_little(spark, tmp_path):
    schema = "id long, embedding array<float>"
    for n, rows in enumerate(([], [(1, [0.0, 0.0])], [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)])):
        df = spark.createDataFrame(rows, schema)
        index = VectorIndex.build(df, str(tmp_path / str(n)))
        q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id int, vector array<float>")
        assert rows_of(index.search(q, 5, None)) == rows_of(ranking.nearest_each(df, q, 5))
    with pytest.raises(ValueError):
        VectorIndex.build(df.withColumn("cell", F.lit(1)), str(tmp_path / "x"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        VectorIndex(spark, str(tmp_path / "none"))


def test_keyword_index_of_nothing(spark, texts, tmp_path):
    index = KeywordIndex.build(texts.limit(0), str(tmp_path / "k"), id="id", text="text")
    assert index.scores(spark.createDataFrame([(1, "w1")], "q int, question string"), query="q", query_text="question", id="id").count() == 0


# keywords


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words[: 5 + i]) for _ in range(r.randrange(60)))) for i in range(200)]
    return spark.createDataFrame([*rows, (200, None), (201, ""), (202, "the the w1")], "id long, text string")


@pytest.mark.parametrize("stop,limit", [(None, None), (["the", "w3"], 40)])
def test_keyword_index_scores_as_without(spark, texts, tmp_path, stop, limit):
    asked = spark.createDataFrame([(1, "w1 w2 the w250 w250"), (2, "w3 nothing"), (3, "")], "q int, question string")
    want = keyword.scores(texts, asked, id="id", text="text", query="q", query_text="question", stop=stop, limit=limit)
    KeywordIndex.build(texts, str(tmp_path / "k"), id="id", text="text", stop=stop, limit=limit, buckets=32)
    index = KeywordIndex(spark, str(tmp_path / "k"))
    got = index.scores(asked, query="q", query_text="question", id="id")
    key = lambda df: sorted((r.q, r.id, round(r.keyword, 9)) for r in df.collect())
    assert key(got) == key(want) and got.count() > 0
    few = index.of_terms("postings", keyword.frequencies(asked.where("q = 1"), "q", "question"))
    assert few.select("bucket").distinct().count() <= 4
    (scan,) = [x for x in plan_of(few).split("\n") if "PartitionFilters" in x]
    assert "bucket#" in scan and "In(term" in plan_of(few)  # and of those partitions, row groups by term


def test_scores_against_plain_python(spark, texts):
    import math
    import re

    asked = {1: "w1 w2 w1", 2: "w9"}
    rows = [(r.id, re.findall(r"\w\w+", (r.text or "").lower())) for r in texts.collect()]
    df = {}
    for _, w in rows:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(w):
        v = {t: w.count(t) * idf[t] for t in set(w) if t in idf}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()}

    want = {(q, i): sum(a * unit(w).get(t, 0) for t, a in unit(asked[q].split()).items()) for q in asked for i, w in rows}
    got = keyword.scores(texts, spark.createDataFrame(list(asked.items()), "q int, question string"), id="id", text="text", query="q", query_text="question")
    got = {(r.q, r.id): r.keyword for r in got.collect()}
    assert got.keys() == {k for k, v in want.items() if v} and all(math.isclose(v, want[k], rel_tol=1e-9) for k, v in got.items())


# near-duplicates


def plain_greedy(rows, threshold=0.7):
    out, kept = [], {}
    for g, rank, i, t in sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2])):
        w = set((t or "").lower().split())
        if not any(a and w and len(a & w) / max(len(a), len(w)) > threshold for a in kept.setdefault(g, [])):
            kept[g].append(w)
            out.append((g, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sweeps", [0, 2])
def test_greedy_equals_the_fold(spark, sweeps):
    r = random.Random(2)
    rows, base = [], [[r.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(r.randrange(9)) for _ in range(20)] for _ in range(12)]
    for i in range(240):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3, 4, 6, 7, 12])):  # chains of likeness, across the threshold
            w[r.randrange(20)] = f"x{r.randrange(60)}"
        rows.append((r.choice(["hot", "hot", "hot", "b", None]), r.randrange(500), i, " ".join(w)))
    rows += [("hot", 1000 + i, 1000 + i, rows[0][3].upper()) for i in range(40)]  # copies
    rows += [("b", i, 2000 + i, t) for i, t in enumerate((None, "", " ", "one", "one one", "one two three four five six seven eight nine ten", "one two three four five six seven"))]
    df = spark.createDataFrame(rows, "g string, r int, i long, t string").repartition(5)
    got = dedupe.greedy(df, group="g", rank="r", id="i", text="t", sweeps=sweeps)
    assert sorted(((x.g, x.i) for x in got.collect()), key=repr) == plain_greedy(rows)
    assert dedupe.greedy(df.limit(0), group="g", rank="r", id="i", text="t", sweeps=sweeps).count() == 0


def test_near_copies_cost_no_pairs(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [("g", i, i, " ".join([*words, f"own{i}", f"more{i}"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, r int, i long, t string")
    assert [r.i for r in dedupe.greedy(df, group="g", rank="r", id="i", text="t").collect()] == [0]


def test_near_misses_make_few_pairs(spark, monkeypatch):
    r, seen, real = random.Random(5), [], dedupe._similar
    monkeypatch.setattr(dedupe, "_similar", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    rows = [("g", i, i, " ".join(r.sample([f"w{k}" for k in range(160)], 40))) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, r int, i long, t string")
    assert sorted((("g", x.i) for x in dedupe.greedy(df, group="g", rank="r", id="i", text="t").collect()), key=repr) == plain_greedy(rows)
    assert sum(seen) < 1000, seen  # of 19,900; many share a word that both prefixes have


def test_each_query_is_shortlisted(spark, monkeypatch):
    """Copies, no direction, no numbers, other lengths: as all pairs measured one by one, of which few are left to measure."""
    r, nan, inf = random.Random(8), float("nan"), float("inf")
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(3000)]
    rows += [(3000 + i, v) for i, v in enumerate([None, [0.0] * 6, [1.0, None, 2.0, 0.0, 0.0, 0.0], [nan] * 6, [inf] + [0.0] * 5, [1.0, 2.0], [0.0, 0.0], [None, 1.0], []] * 3)]
    rows += [(4000 + i, rows[7][1]) for i in range(400)] + [(None, rows[8][1]), (9, rows[9][1])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asks = [(i, v) for i, v in rows if i is not None and (i % 300 == 7 or i in (9, 3000, 3001, 3003))]
    q = spark.createDataFrame(asks, "query_id long, vector array<double>")
    pairs = df.crossJoin(q).withColumn("distance", 1.0 - vector.cosine(F.col("embedding"), F.col("vector")))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    want = pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 20")
    got = ranking.nearest_each(df, q, 20)
    shape = lambda d: sorted((x.query_id, x["rank"], repr(x.id), repr(x.distance)) for x in d.collect())
    assert shape(got) == shape(want)
    measured = len(asks) * len(rows)
    assert "FlatMapGroupsInArrow" in plan_of(got) and measured > 40_000


def test_terms_are_counted_in_rows(spark):
    rows = [(1, "Ab ab, the cd ab"), (2, None), (3, ""), (4, "cd ef_1 été"), (5, "the the")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    shape = lambda d: sorted((r.id, r.term, r.tf) for r in d.collect())
    alone = keyword.frequencies(df, "id", "text", ["the"], alone=True)
    assert shape(alone) == shape(keyword.frequencies(df, "id", "text", ["the"])) and "HashAggregate" not in plan_of(alone)
    assert keyword.one_each(df, "id") and not keyword.one_each(df.union(df.where("id = 4")), "id")
    q = spark.createDataFrame([(0, "cd ab"), (1, "ef_1")], "query_id int, q string")
    scores = lambda d, **o: {(r.query_id, r.id): round(r.keyword, 9) for r in keyword.scores(d, q, id="id", text="text", query="query_id", query_text="q", **o).collect()}
    for limit in (None, 4):
        assert scores(df, limit=limit) == scores(df, limit=limit, alone=False) and len(scores(df, limit=limit)) >= 2


def test_a_query_is_not_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(50).select(F.lit(0).alias("query_id"), "id", (F.col("id") / 50).alias("semantic"), F.lit(0.0).alias("keyword"))
        assert "SortMergeJoin" not in plan_of(keyword.hybrid(df, query="query_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
