"""Vector search and the ranking of cases: filter, score, group, pick."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions import vector
from scriptorium.shared import cut

#: Rows of a piece, at least and at most; queries of a piece, at most; tasks, at most.
LEAST, ROWS, ASKED, MOST_TASKS = 1 << 10, 1 << 15, 1 << 12, 1 << 12
#: Products of matrices are nearer than this to sums in order, for vectors of length 1.
ROUNDING = 1e-11
CANDIDATES, PARENTS, PER_COMPONENT, LOW_CONFIDENCE = 50, 3, 1, 0.5


def nearest(chunks: DataFrame, query: Column, k: int, *, embedding: str = "embedding", id: str = "id", where: Column | None = None) -> DataFrame:
    """The ``k`` chunks of least cosine distance, exactly, with ``distance``; ``where`` filters before the search.

    Planned as TakeOrderedAndProject: every task keeps k rows.
    """
    df = chunks if where is None else chunks.where(where)
    return df.withColumn("distance", 1.0 - vector.cosine(F.col(embedding), query)).orderBy("distance", id).limit(k)


def _shortlist(k: int):
    """Of a piece of rows and one of queries: (query, id, cell) that may be among the ``k`` nearest, by products of matrices.

    What is within rounding of the last place is kept too, so the exact order
    can be settled from the list. Of equal vectors only the first ``k`` ids count.
    """

    def run(both: pa.Table) -> pa.Table:
        asked = both.filter(both["asks"])
        rows = both.filter(pc.invert(both["asks"]))
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_start"))
        found_q, found_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        q, v = asked["v"].combine_chunks(), rows["v"].combine_chunks()
        q_size, v_size = pc.list_value_length(q).to_numpy(), pc.fill_null(pc.list_value_length(v), -1).to_numpy()
        for d in np.unique(q_size) if len(rows) else ():
            who = np.nonzero(q_size == d)[0]
            qs = q.take(pa.array(who)).flatten().to_numpy().reshape(-1, d)
            fits = np.nonzero(v_size == d)[0]
            flat = v.take(pa.array(fits)).flatten()
            part = flat.to_numpy(zero_copy_only=False).reshape(-1, d)
            nulls = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
            # fixed likenesses: 0 without a direction, none (last) where it is no number, null (first) for another length
            fixed = np.zeros(len(v_size))
            for i in np.nonzero((v_size >= 0) & (v_size != d))[0]:
                x = v[int(i)].as_py()
                fixed[i] = 0.0 if None in x or not any(x) else np.inf
            xs = np.zeros((len(v_size), d))
            sound = ~nulls & np.isfinite(part).all(axis=1)
            xs[fits[sound]] = part[sound]
            fixed[fits[~nulls & ~sound]] = -np.inf
            size = np.sqrt((xs * xs).sum(axis=1))
            free = (size > 0) & np.isfinite(size)
            fixed[np.isinf(size)] = -np.inf
            key = np.hstack([xs, fixed[:, None]]) + 0.0
            _, of = np.unique(key.view(f"V{8 * (d + 1)}").ravel(), return_inverse=True)
            by = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[by], np.arange(of.max() + 1))
            keep = np.sort(by[np.arange(len(by)) - starts[of[by]] < k])
            xs, fixed, free = xs[keep], fixed[keep], free[keep]
            xs[free] /= size[keep][free, None]
            qs = qs / np.sqrt((qs * qs).sum(axis=1))[:, None]
            step = max(1, (1 << 22) // len(keep))
            for i in range(0, len(qs), step):
                like = np.where(free, qs[i : i + step] @ xs.T, fixed)
                last = np.partition(like, max(0, len(keep) - k), axis=1)[:, max(0, len(keep) - k)]
                x, y = np.nonzero(like >= last[:, None] - ROUNDING)
                found_q.append(who[x + i])
                found_r.append(keep[y])
        x, y = pa.array(np.concatenate(found_q)), pa.array(np.concatenate(found_r))
        return pa.table({"query": asked["query"].take(x), "id": rows["id"].take(y), "cell": rows["cell"].take(y)})

    return run


def nearest_in_cells(chunks: DataFrame, queries: DataFrame, k: int, *, query: str = "query_id", vector_of: str = "vector", embedding: str = "embedding", id: str = "id", cell: str = "cell") -> DataFrame:
    """The ``k`` nearest of every query among the chunks of its cells, exactly; ``queries`` has a row a query and cell.

    Cells are few: their sizes are broadcast. Rows and queries of a cell are
    dealt into pieces that meet pair by pair; only what each pair shortlists is
    measured by ``vector.cosine`` and ranked.
    """
    spark = chunks.sparkSession
    length = vector.norm(F.col(vector_of))
    plain = F.coalesce((length > 0) & (length < float("inf")), F.lit(False))
    asked = queries.select(F.col(query).alias("q_"), F.col(vector_of).alias("v_"), F.col(cell).alias("c_"), plain.alias("plain_"))
    few = lambda df, c, most, name: df.groupBy(F.col(c).alias("c_")).agg(F.count(F.lit(1)).alias("n_")).select("c_", F.ceil(F.col("n_") / most).cast("int").alias(name), F.col("n_").alias(f"n_{name}"))
    spread = 4 * spark.sparkContext.defaultParallelism
    sizes = few(chunks, cell, 1, "all").join(few(asked.where("plain_"), "c_", ASKED, "qs"), "c_")
    most = F.greatest(F.lit(LEAST), F.least(F.lit(ROWS), F.ceil(F.sum("n_all").over(Window.partitionBy(F.lit(0))) / spread)))  # one row a cell
    sizes = cut(sizes.select("c_", "qs", F.ceil(F.col("n_all") / most).cast("int").alias("rs")))
    tasks = min(MOST_TASKS, max(1, sizes.agg(F.sum(F.col("qs") * F.col("rs"))).first()[0] or 0))
    piece = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kinds = f"query {queries.schema[query].dataType.simpleString()}, id {chunks.schema[id].dataType.simpleString()}, cell {chunks.schema[cell].dataType.simpleString()}"
    row = chunks.select(F.col(cell).alias("c_"), F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).join(F.broadcast(sizes), "c_")
    row = row.select(F.col("c_").alias("cell"), piece(F.struct("id", "v"), "rs").alias("r"), every("qs").alias("q"), F.lit(False).alias("asks"), F.lit(None).cast(queries.schema[query].dataType).alias("query"), "id", "v")
    ask = asked.where("plain_").join(F.broadcast(sizes), "c_")
    ask = ask.select(F.col("c_").alias("cell"), every("rs").alias("r"), piece(F.struct("q_", "v_"), "qs").alias("q"), F.lit(True).alias("asks"), F.col("q_").alias("query"), F.lit(None).cast(chunks.schema[id].dataType).alias("id"), F.col("v_").cast("array<double>").alias("v"))
    met = row.unionByName(ask).repartition(tasks, "cell", "r", "q").groupBy("cell", "r", "q").applyInArrow(_shortlist(k), kinds)
    short = met.distinct().select(F.col("query").alias("lq_"), F.col("id").alias("li_"), F.col("cell").alias("lc_"))
    pairs = chunks.join(short, F.col(id).eqNullSafe(F.col("li_")) & (F.col(cell) == F.col("lc_")))
    pairs = pairs.join(asked.where("plain_"), F.col("lq_").eqNullSafe(F.col("q_")) & (F.col("lc_") == F.col("c_")))
    rest = chunks.join(asked.where("not plain_"), F.col(cell) == F.col("c_"))  # queries without a direction
    pairs = pairs.select(*chunks.columns, "q_", "v_").unionByName(rest.select(*chunks.columns, "q_", "v_"))
    pairs = pairs.withColumn("distance", 1.0 - vector.cosine(F.col(embedding), F.col("v_"))).withColumnRenamed("q_", query).drop("v_", cell)
    order = Window.partitionBy(query).orderBy("distance", id)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_each(chunks: DataFrame, queries: DataFrame, k: int, *, query: str = "query_id", vector_of: str = "vector", embedding: str = "embedding", id: str = "id") -> DataFrame:
    """As ``nearest`` for every row of ``queries``, a stated query set: all chunks are one cell."""
    one = lambda df: df.withColumn("all_", F.lit(0))
    return nearest_in_cells(one(chunks), one(queries.select(query, vector_of)), k, query=query, vector_of=vector_of, embedding=embedding, id=id, cell="all_")


def keep_components(candidates: DataFrame, targets: list[str], component: str) -> DataFrame:
    """Candidates of the target components, or all of them where none is; after the search, never before.

    The window runs over the candidates of one search, which ``nearest`` bounds.
    """
    hit = F.upper(F.col(component)).isin(*[t.upper() for t in targets]) if targets else F.lit(False)
    any_ = F.max(hit).over(Window.partitionBy(F.lit(0)))
    return candidates.withColumn("component_match", hit).withColumn("any_", any_).where("component_match or not any_").drop("any_")


def scored(candidates: DataFrame, wanted: Column, *, domain: str, component: str) -> DataFrame:
    """With base_similarity, domain_boost, score and match_reasons."""
    df = candidates.withColumn("base_similarity", vector.distance_score(F.col("distance"))).withColumn("domain_boost", vector.domain_boost(F.col(domain), wanted))
    df = df.withColumn("score", F.col("base_similarity") + vector.multiplier(F.col(domain)) * F.col("domain_boost"))
    return df.withColumn("match_reasons", vector.reasons(F.col("base_similarity"), F.col(component), F.col("component_match"), F.col("domain_boost")))


def parents(candidates: DataFrame, *, parent: str, id: str, keep: list[str], k: int = PARENTS) -> DataFrame:
    """The ``k`` best parents: best score, matches, and ``keep`` of the first chunk seen; ties to the first seen."""
    seen = F.struct("distance", id)
    out = candidates.groupBy(parent).agg(
        F.max("score").alias("best_score"),
        F.count_if("component_match").alias("component_matches"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.min(seen).alias("first_seen"),
        *[F.min_by(c, seen).alias(c) for c in keep],
    )
    return out.orderBy(F.desc("best_score"), "first_seen").limit(k)


def best_chunks(candidates: DataFrame, *, parent: str, component: str, id: str, n: int = PER_COMPONENT) -> DataFrame:
    """The ``n`` best chunks of each parent and component."""
    order = Window.partitionBy(parent, component).orderBy(F.desc("score"), "distance", id)
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``rank`` 1, 2, ... over a result that ``limit`` has bounded."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def low_confidence(best: Column) -> Column:
    return F.when(best < LOW_CONFIDENCE, F.lit("Low confidence: the best match scores under 0.5"))
