"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments of equal length. With mean m and deviation s of
each segment (length L), the distance |q - v|^2 is at least the sum over segments
of L ((m_q - m_v)^2 + (s_q - s_v)^2). As |q - v|^2 = |q|^2 + |v|^2 - 2 q.v, this is
the same as q.v being at most the sum of L (m_q m_v + s_q s_v). Candidates are
bounded with few long segments first and with more and shorter ones after; those
that can't reach the query's k-th best score so far are left out, and only the
survivors are scored exactly. A level, or the exact scores, is one matrix product
for a few queries while most candidates are alive, and for the survivors of each
query after.

The stated queries are compared with all vectors in blocks: a block of queries
meets a block of vectors in one task, and each task sends k rows per query. The
first block of vectors is searched first; its k-th best score of each query is
where the search of the other blocks starts from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise

#: Float products of integers are exact below this bound.
EXACT = 2**53
LEVELS = (4, 16, 32)
DENSE = 0.3  # of the candidates alive, from which on a matrix product is cheaper than gathering them


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of (mean, deviation) by segment, times the root of the length, so that the bound is one matrix product."""
    length = x.shape[1] // segments
    cut = x.reshape(len(x), segments, length)
    mean = cut.mean(2)
    spread = np.sqrt(np.maximum((cut * cut).mean(2) - mean * mean, 0))
    return np.concatenate((mean, spread), axis=1) * np.sqrt(length)


def _padded(x: np.ndarray, segments: int) -> np.ndarray:
    width = max(1, -(-x.shape[1] // segments)) * segments
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if width != x.shape[1] else x


def _scores(q: np.ndarray, v: np.ndarray) -> list[int]:
    """Exact inner products of one query with the rows of v."""
    if len(v) and np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, len(q)) >= EXACT:
        return [int(sum(int(a) * int(b) for a, b in zip(q.tolist(), row.tolist(), strict=True))) for row in v]
    return (v @ q).astype(np.int64).tolist()


def block_top_k(
    q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS, floors: np.ndarray | None = None, counts: list[int] | None = None, chunk: int = 64
) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score) of the k best of the block for each query that reach its floor; ties to the smaller identifier.

    ``counts`` gets the pairs that were scored exactly and all pairs.
    """
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order]
    if not len(v) or not len(q):
        return
    stats = [(_statistics(_padded(q, n), n), _statistics(_padded(v, n), n)) for n in sorted(levels) if n < q.shape[1]]
    slack = 1e-6 * (np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] + 1)  # above any rounding of the bounds
    exact = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1]) < EXACT
    floors = np.full(len(q), -np.inf) if floors is None else floors
    for at in range(0, len(q), chunk):
        own = slice(at, min(len(q), at + chunk))
        alive = v_ids[None, :] != q_ids[own, None]
        floor = floors[own].astype(np.float64)
        # a first threshold: exact scores of the k candidates with the highest coarse bound
        first = (stats[0][0][own] @ stats[0][1].T) if stats else (q[own] @ v.T)
        for i in range(len(floor)):
            able = np.flatnonzero(alive[i])
            if len(able) >= k:
                best = able[np.argpartition(-first[i, able], k - 1)[:k]] if len(able) > k else able
                floor[i] = max(floor[i], float(min(_scores(q[at + i], v[best]))))
        if stats:
            alive &= first + slack >= floor[:, None]
        for a, b in stats[1:]:
            if alive.mean() > DENSE:
                alive &= a[own] @ b.T + slack >= floor[:, None]
            else:
                for i in range(len(floor)):
                    left = np.flatnonzero(alive[i])
                    alive[i, left] = b[left] @ a[at + i] + slack >= floor[i]
        if counts is not None:
            counts[0] += int(alive.sum())
            counts[1] += alive.size
        whole = (q[own] @ v.T) if exact and alive.mean() > DENSE else None
        for i in range(len(floor)):
            left = np.flatnonzero(alive[i])
            if not len(left):
                continue
            if whole is not None or exact:
                score = whole[i, left] if whole is not None else v[left] @ q[at + i]
                if len(left) > k:  # all that tie with the k-th stay until the identifiers decide
                    able = score >= -np.partition(-score, k - 1)[k - 1]
                    left, score = left[able], score[able]
                score = score.astype(np.int64).tolist()
            else:
                score = _scores(q[at + i], v[left])
            for s, j in sorted(zip((-s for s in score), left.tolist(), strict=True))[:k]:
                yield int(q_ids[at + i]), int(v_ids[j]), -s


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, dims): floor(scale * x) as doubles; vectors that are null or hold null or non-finite parts are left out."""
    parts = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    able = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~bad
    return df.where(able).select(F.col(id_col).cast("long").alias("vec_id"), parts.alias("v"), F.size(vector_col).alias("dims"))


def top_k(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, query_block: int = 1024, vector_block: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query among all other rows.

    Components are floor(scale * x) of x as double. Fewer than k candidates give
    fewer rows. Ties go to the smaller vec_id. Only vectors of the query's length
    are candidates; empty vectors score 0. Rows whose identifier is the query's
    own, repeats included, are no candidates; a repeated query row answers once.
    Scores beyond 64 bits are clipped to the ends of the range. Empty tables give
    no rows. Other columns are ignored.
    """
    rows = materialise(integer_vectors(df, id_col, vector_col, scale).withColumn("q", is_query).dropDuplicates(["vec_id", "v"]), "vectors")
    n, n_q = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    v_blocks, q_blocks = max(1, -(-n // vector_block)), max(1, -(-n_q // query_block))
    block = lambda salt, most: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(most)).cast("int")
    queries = rows.where("q").select("vec_id", "v", "dims", block(1, q_blocks).alias("qb"))
    vectors = rows.select("vec_id", "v", "dims", block(2, v_blocks).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, q in left.groupby("dims"):
            v = right[right["dims"] == dims]
            if len(v):
                a, b = (np.concatenate([*x["v"].to_numpy(), []]).astype(np.float64).reshape(len(x), dims) for x in (q, v))
                floors = q["floor"].to_numpy(np.float64, na_value=-np.inf)
                for row in block_top_k(q["vec_id"].to_numpy(), a, v["vec_id"].to_numpy(), b, k, floors=floors):
                    out.append((*row[:2], max(-(2**63), min(2**63 - 1, row[2]))))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def met(asked: DataFrame, searched: DataFrame) -> DataFrame:
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # both sides come from one table
        return asked.groupBy("qb", "vb").cogroup(searched.groupBy("qb", "vb")).applyInPandas(search, "query_id long, vec_id long, score long")

    best = met(queries.withColumn("vb", F.lit(0)).withColumn("floor", F.lit(None).cast("double")), vectors.where("vb = 0"))
    if v_blocks > 1:
        best = materialise(best, "first")
        # k rows a query at most
        known = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k)
        asked = queries.join(known.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")
        asked = asked.withColumn("vb", F.explode(F.sequence(F.lit(1), F.lit(v_blocks - 1))))
        best = best.unionByName(met(asked, vectors.where("vb > 0"))).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows of each vector block
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
