"""Exact top-k search by inner product, with a pivot table.

Each vector's distances to PIVOTS fixed vectors (and the origin) are precomputed. By the triangle
inequality ``max |d(q,p) - d(x,p)|`` bounds d(q,x) from below, and so the inner product
``(|q|^2 + |x|^2 - d^2) / 2`` from above. A query meets the candidates of a block in the order of
this bound and stops when it falls below the k-th best score: the result is exact.

Work is dealt in cells of a block of queries by a block of candidates; a block is bounded in rows,
so cells grow in number, not in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.llm.common import staged

PIVOTS, QUERY_BLOCK, CANDIDATE_BLOCK = 32, 1024, 4096
#: Candidates are scored this many at a time.
STEP = 512


def integers(vector: Column, scale: int = 1024, row: Column | None = None) -> Column:
    """floor(scale * x) of each component, x as double. One beyond 64 bits is an error that names the ``row``."""
    said = F.concat(F.lit("a component beyond 64 bits in the vector "), F.coalesce(row.cast("string"), F.lit("null")) if row is not None else F.lit(""))

    def one(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < float(1 << 63), F.floor(scaled)).otherwise(F.raise_error(said).cast("long"))

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _exact(m: np.ndarray) -> np.ndarray:
    """As doubles where every sum of products is exact in them, else as Python's integers."""
    most = float(np.abs(m).max(initial=0))
    return m.astype(np.float64) if most * most * max(1, m.shape[1]) < 2**52 else m.astype(object)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): the k best of the block for each query, ties to the smaller id. A query
    isn't its own candidate."""
    width = max(q.shape[1], x.shape[1])
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    qe, xe = _exact(np.vstack([q, x]))[: len(q)], _exact(np.vstack([q, x]))[len(q) :]
    plain = pivots.astype(np.float64)
    distance = lambda m: np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (plain * plain).sum(1) - 2 * m @ plain.T))
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    assert plain.shape[1] == width
    dq, dx = distance(qf), distance(xf)
    q2, x2 = (qf * qf).sum(1), (xf * xf).sum(1)
    reach = float(max(q2.max(initial=0), x2.max(initial=0), (plain * plain).sum(1).max(initial=0)))
    slack = 1 + 1e-6 * reach  # far over the rounding of distances and bounds
    out = []
    for i in range(len(q)):
        low = np.abs(dx - dq[i]).max(axis=1)
        bound = (q2[i] + x2 - low * low) / 2 + slack
        bound[ids == q_ids[i]] = -np.inf
        best_score, best_row = np.empty(0, qe.dtype), np.empty(0, np.int64)
        at, ranked = 0, None
        while at < len(ids):
            if ranked is None and len(ids) > 4 * STEP:
                part = np.argpartition(-bound, STEP)[:STEP]
                rows, rest = part, bound[np.argpartition(-bound, STEP)[STEP]]
                ranked = False
            else:
                if ranked is None or ranked is False:
                    ranked = np.argsort(-bound, kind="stable")
                rows = ranked[at : at + STEP]
                rest = bound[ranked[at + STEP]] if at + STEP < len(ids) else -np.inf
            rows = rows[bound[rows] > -np.inf]
            at += STEP
            best_score = np.concatenate([best_score, xe[rows] @ qe[i]])
            best_row = np.concatenate([best_row, rows])
            top = np.lexsort((best_row, -best_score))[:k]  # rows are in order of id
            best_score, best_row = best_score[top], best_row[top]
            if rest == -np.inf or len(best_row) == k and best_score[-1] > rest:
                break
        found = [(int(q_ids[i]), int(ids[r]), int(s)) for r, s in zip(best_row, best_score, strict=True)]
        if large := [f for f in found if not -(1 << 63) <= f[2] < 1 << 63]:
            raise ValueError("the score of query {} and vector {} is {}: beyond 64 bits".format(*large[0]))
        out += found
    return out


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``queries`` holds, the k rows of highest
    integer inner product, itself excepted; ties to the smaller id; fewer if there are no more.

    ``vector`` is an array of long. Rows with a null id or vector, or a null component, take no part. Shorter vectors
    count as padded with zeros. Equal (id, vector) rows count once; rows that share an id are no
    candidates of each other. An empty table gives none. Other columns are ignored. A score of the k best that doesn't fit
    64 bits is an error that names its two vectors.
    """
    spark = vectors.sparkSession
    clean = vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull()))
    clean = clean.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = staged(clean, "vectors")
    count = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q"), F.max(F.size("v")).alias("w")).first()
    width = max(1, count["w"] or 0)
    # A fixed number of pivots, spread by a hash of the id: any choice gives the same result.
    chosen = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(PIVOTS).collect()
    pivots = np.zeros((len(chosen) + 1, width), np.float64)  # the last is the origin: distances to it are norms
    for i, row in enumerate(chosen):
        pivots[i, : len(row["v"])] = row["v"]
    q_blocks, x_blocks = max(1, -(-count["q"] // QUERY_BLOCK)), max(1, -(-count["n"] // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = rows.filter("is_query").select("id", "v", F.lit(True).alias("asks"), block(q_blocks).alias("qb"), every(x_blocks).alias("xb"))
    met = rows.select("id", "v", F.lit(False).alias("asks"), every(q_blocks).alias("qb"), block(x_blocks).alias("xb"))
    context = spark.sparkContext.broadcast(pivots)
    names = ["query_id", "vec_id", "score"]

    def cell(data: pa.Table) -> pa.Table:
        ids = data.column("id").to_numpy()
        asks = data.column("asks").to_numpy(zero_copy_only=False)
        whole = _matrix(data.column("v"), context.value.shape[1])
        _, first = np.unique(np.column_stack([ids, asks, whole]), axis=0, return_index=True)
        ids, asks, whole = ids[first], asks[first], whole[first]
        found = search_block(ids[asks], whole[asks], ids[~asks], whole[~asks], context.value, k) if asks.any() else []
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=names)

    best = asked.unionByName(met).groupBy("qb", "xb").applyInArrow(cell, T.StructType([T.StructField(n, T.LongType()) for n in names]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
