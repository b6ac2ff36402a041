"""An inverted-file index of vectors: cells as Parquet partitions, probes as partition pruning.

``build`` fits spherical k-means (Spark ML) on a bounded sample, assigns every
vector to its nearest centroid, and writes a partition a cell. The sample only
places the centroids: all rows are indexed, and a search of all cells equals
``ranking.nearest_each``. A cell of any size is dealt over several tasks when
it is written (a rebalance, which adaptive execution splits) and read (files
split as any scan).

``search`` ranks the centroids for each query of a stated set (at most
``MOST_CELLS`` rows), names the cells that any query probes as a filter on the
partition column, so other files are never opened, and compares a vector only
with the queries that probe its cell. Each task keeps k rows a query before the
shuffle.

Vectors without a direction (null or zero) have distance 1 to everything; they
are in a cell of their own that every search reads. The centroids are written
last: without them there is no index.
"""

from __future__ import annotations

import json

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scriptorium.functions import vector
from scriptorium.operators import ranking

#: Vectors that centroids are fitted on, at most.
SAMPLE = 100_000
#: Cells of an index, at most; their centroids are broadcast.
MOST_CELLS = 1 << 14
#: The cell of vectors without a direction.
NOWHERE = -1


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        """Open the index at ``path``; an unfinished one is an error of Spark's reader."""
        self.spark, self.path = spark, path.rstrip("/")
        self.centroids = spark.read.schema("cell int, centroid array<double>").parquet(f"{self.path}/centroids")
        self.schema = T.StructType.fromJson(json.loads(spark.read.text(f"{self.path}/schema").first()[0]))

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, embedding: str = "embedding", id: str = "id", cells: int | None = None, sample: int = SAMPLE, seed: int = 1, rounds: int = 15) -> VectorIndex:
        """Index ``rows`` (all columns are kept); about the square root of their number is the default of ``cells``.

        The sample: the ``sample`` rows of least hash of ``id``, the same in every run.
        """
        spark, path = rows.sparkSession, path.rstrip("/")
        if "cell" in rows.columns:
            raise ValueError("cell is the index's own column")
        directed = F.coalesce(F.exists(embedding, lambda x: x != 0), F.lit(False))
        v = array_to_vector(F.col(embedding).cast("array<double>"))
        total = rows.count()
        some = rows.where(directed).orderBy(F.xxhash64(F.col(id)), id).limit(sample).select(v.alias("features")).cache()
        try:
            k = min(cells or max(1, round(total**0.5)), MOST_CELLS, max(1, some.count()))
            model = cls._fitted(some, k, seed, rounds) if k > 1 else None
        finally:
            some.unpersist()
        if model is None:
            placed = rows.withColumn("cell", F.when(directed, 0).otherwise(NOWHERE))
            centers: list[list[float]] = [[0.0]]
        else:
            # MLlib has no distance for a zero vector; a stand-in is placed and then overruled
            there = F.when(directed, F.col(embedding).cast("array<double>")).otherwise(F.lit([1.0] * len(model.clusterCenters()[0])))
            cell = model.setPredictionCol("place").transform(rows.withColumn("features", array_to_vector(there)))
            placed = cell.withColumn("cell", F.when(directed, F.col("place")).otherwise(NOWHERE)).select(*rows.columns, "cell")
            centers = [list(map(float, c)) for c in model.clusterCenters()]
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        spark.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
        spark.createDataFrame(list(enumerate(centers)), "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return cls(spark, path)

    @staticmethod
    def _fitted(some: DataFrame, k: int, seed: int, rounds: int) -> KMeansModel:
        return KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=rounds).fit(some)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("cell", T.IntegerType())])).parquet(f"{self.path}/cells")

    def probes(self, queries: DataFrame, n: int | None, *, query: str = "query_id", vector_of: str = "vector") -> DataFrame:
        """(query, vector_of, cell): the ``n`` cells nearest to each query, all if None, and the one without direction."""
        pairs = queries.select(query, vector_of).crossJoin(F.broadcast(self.centroids))  # MOST_CELLS rows at most
        near = pairs.withColumn("far", 1.0 - vector.cosine(F.col(vector_of), F.col("centroid")))
        if n is not None:
            order = Window.partitionBy(query).orderBy("far", "cell")
            near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
        return near.select(query, vector_of, "cell").unionByName(queries.select(query, vector_of, F.lit(NOWHERE).alias("cell")))

    def candidates(self, probes: DataFrame) -> DataFrame:
        """The rows of the probed cells; the scan opens their files only."""
        named = [r.cell for r in probes.select("cell").distinct().collect()]  # MOST_CELLS at most
        return self.rows().where(F.col("cell").isin(*named))

    def search(self, queries: DataFrame, k: int, probes: int | None = 8, *, query: str = "query_id", vector_of: str = "vector", embedding: str = "embedding", id: str = "id", where: Column | None = None) -> DataFrame:
        """The ``k`` nearest of each query among its ``probes`` nearest cells (None: all, which is exact), with ``distance`` and ``rank``."""
        named = {"query": query, "vector_of": vector_of, "embedding": embedding, "id": id}
        if probes is None:
            found = self.rows() if where is None else self.rows().where(where)
            return ranking.nearest_each(found.drop("cell"), queries, k, **named)
        asked = self.probes(queries, probes, query=query, vector_of=vector_of)
        found = self.candidates(asked)
        return ranking.nearest_in_cells(found if where is None else found.where(where), asked, k, **named)


def recall(found: DataFrame, exact: DataFrame, *, query: str = "query_id", id: str = "id") -> DataFrame:
    """(query, wanted, hits): how many of the exact neighbours of each query were found."""
    hit = found.select(query, id).withColumn("hit", F.lit(1))
    return exact.join(hit, [query, id], "left").groupBy(query).agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"))
