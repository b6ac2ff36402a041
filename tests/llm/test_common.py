import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import common


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, small):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    got = common.components(df, small=small).collect()
    assert {x.node: x.root for x in got} == want and len(got) == len(want)
    assert common.components(df.limit(0), small=small).count() == 0


def test_ranked_is_gapless_in_every_group(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7 == 0).alias("g"), F.lit(1).alias("start"))
    rows = common.ranked(df, ["g"], [F.col("id")], "rank").collect()
    for g in (True, False):
        assert sorted(x["rank"] for x in rows if x.g == g) == list(range(sum(x.g == g for x in rows)))
    assert rows[0].asDict().keys() == {"id", "g", "start", "rank"}


def test_stage_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        class sparkContext:  # noqa: N801
            getConf = staticmethod(Conf)  # noqa: N815

    with pytest.raises(ValueError):
        common.shared_dir(Session)
