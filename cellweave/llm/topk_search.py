"""Exact top-k inner-product search by block-at-a-time pruning.

Queries are taken in blocks of bounded size; each block is broadcast and meets every row once. The driver holds one block
at a time, and where there are several, each block's result is written before the next. A task orders its rows so
that like ones lie together, cuts them into ranges, and keeps per range and component the largest and smallest value. A
query's bound for a range is the sum, over its components, of the largest product they allow. A query visits the ranges
by falling bound, scores them through their forward index, and stops when the bound is below its k-th score so far.
Every task gives its best rows for each query; equal scores go to the smaller id, so the result is exact. Rows and queries
with components too large for exact sums in double precision are scored in whole numbers of any size instead.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows without an id; a
shorter vector counts as filled up with zeros; rows that repeat an id are candidates each, but not of the same id's query,
which is asked once for its least vector; a score among the best that is no bigint raises; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, table

#: Numbers in a broadcast block of queries, rows in a range, rows that a task orders at once.
QUERY_NUMBERS, RANGE_ROWS, TASK_ROWS = 1 << 20, 128, 1 << 15
#: Below this, sums of products are exact in double precision.
EXACT = 2.0**53
RANKED = "query_id bigint, rank int, vec_id bigint, score bigint"


def ordered(x: np.ndarray) -> np.ndarray:
    """An order of the rows that brings like ones together: by the signs along the components that vary most."""
    top = np.argsort(-x.var(axis=0), kind="stable")[:12]
    signs = x[:, top] > np.median(x[:, top], axis=0)
    return np.argsort(signs @ (1 << np.arange(len(top))[::-1]), kind="stable")


def block_topk(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, rows: int = RANGE_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids (-1: none) of each query's k best rows, and how many rows were scored."""
    order = ordered(x)
    x, ids = x[order], ids[order]
    starts = np.arange(0, len(x), rows)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    visit = np.argsort(-bound, axis=1, kind="stable")
    none = -np.inf
    score, best = np.full((len(q), k), none), np.full((len(q), k), -1, np.int64)
    live, scored = np.arange(len(q)), 0
    for turn in range(len(starts)):
        at = visit[live, turn]
        go = bound[live, at] >= score[live, -1]
        live, at = live[go], at[go]
        if not len(live):
            break
        by = np.argsort(at, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            who, b = live[part], at[part[0]]
            block, names = x[starts[b] : starts[b] + rows], ids[starts[b] : starts[b] + rows]
            s = q[who] @ block.T
            scored += s.size
            s[q_ids[who][:, None] == names[None, :]] = none
            all_s = np.concatenate([score[who], s], axis=1)
            all_i = np.concatenate([best[who], np.broadcast_to(names, s.shape)], axis=1)
            if all_s.shape[1] > 4 * k:  # keep what can be among the best, ties included
                kth = np.partition(all_s, -k, axis=1)[:, -k]
                m = int((all_s >= kth[:, None]).sum(axis=1).max())
                pick = np.argsort(-all_s, axis=1, kind="stable")[:, :m]
                all_s, all_i = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
            first = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            score[who], best[who] = np.take_along_axis(all_s, first, 1), np.take_along_axis(all_i, first, 1)
    best[~np.isfinite(score)] = -1
    return score, best, scored


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, q): floor(256 * component) of every vector that takes part, as whole doubles, which none is too large for."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: whole_number(v.cast("double") * 256)).alias("q")
    )


def whole_number(v: Column) -> Column:
    return F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)


def matrix(rows, width: int, exact: bool) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float64 if exact else object)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r if exact else [int(v) for v in r]
    return out


def whole_topk(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int | None]]:
    """(query, row, score) of each query's k best rows, in Python's whole numbers; a score below all bigints is null."""
    for one, name in zip(q, q_ids.tolist()):
        for s, i in heapq.nsmallest(k, ((-s, i) for s, i in zip(x @ one, ids.tolist()) if i != name)):
            if -s >= 2**63:
                raise ValueError(f"the score of query {name} and row {i} is no bigint")
            yield name, i, None if -s < -(2**63) else -s


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` against ``rows``, both (id, q)."""
    spark = rows.sparkSession
    stats = rows.agg(F.max(F.size("q")).alias("w"), F.count("*").alias("n")).first()
    schema = "query_id bigint, vec_id bigint, score bigint"
    width = stats.w or 0
    n = queries.select("id").distinct().count() if stats.n else 0
    each = max(1, QUERY_NUMBERS // max(1, width))
    blocks = -(-n // each)
    if not blocks:
        return spark.createDataFrame([], RANKED)
    limit = float(int((EXACT / max(1, width)) ** 0.5) - 1)  # up to this, sums of products stay below EXACT
    large = lambda m: np.array([max(map(abs, r), default=0) > limit for r in m], bool)

    path = f"{shared_dir(spark)}/top-{uuid.uuid4().hex}"
    asked = queries.groupBy("id").agg(F.min("q").alias("q"))
    for b in range(blocks):  # a pass over the rows for each bounded block of queries
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        q_ids = np.array([r.id for r in block], np.int64)
        big = large([r.q for r in block])
        wide = [r.q for r, x in zip(block, big) if x]
        held = spark.sparkContext.broadcast((q_ids, matrix([r.q for r in block], width, True), big, matrix(wide, width, False)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, mat, big, wide = held.value

            def give(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                f = pd.concat(frames)
                over = large(f["q"])
                if over.any():  # these rows meet all queries in whole numbers
                    every = matrix(mat.tolist(), width, False)
                    yield whole(every, ids, f[over])
                f = f[~over]
                if big.any() and len(f):
                    yield whole(wide, ids[big], f)
                if len(f) and not big.all():
                    yield from close(mat[~big], ids[~big], f)

            def whole(q: np.ndarray, ids: np.ndarray, f: pd.DataFrame) -> pd.DataFrame:
                x = matrix(f["q"].tolist(), width, False)
                out = pd.DataFrame(list(whole_topk(q, ids, x, f["id"].to_numpy(np.int64), k)), columns=["query_id", "vec_id", "score"], dtype=object)
                return out.astype({"query_id": "int64", "vec_id": "int64", "score": "Int64"})

            def close(mat: np.ndarray, ids: np.ndarray, f: pd.DataFrame) -> Iterator[pd.DataFrame]:
                score, best, _ = block_topk(mat, ids, matrix(f["q"].tolist(), width, True), f["id"].to_numpy(np.int64), k)
                at, rank = np.nonzero(best >= -(2**63))
                at, rank = at[np.isfinite(score[at, rank])], rank[np.isfinite(score[at, rank])]
                yield pd.DataFrame({"query_id": ids[at], "vec_id": best[at, rank], "score": score[at, rank].astype(np.int64)})

            held_rows, n_rows = [], 0
            for f in batches:
                held_rows.append(f)
                n_rows += len(f)
                if n_rows >= TASK_ROWS:
                    yield from give(held_rows)
                    held_rows, n_rows = [], 0
            if n_rows and len(ids):
                yield from give(held_rows)

        part = best_of(rows.mapInPandas(run, schema), k)
        if blocks == 1:
            return part
        part.write.mode("append").parquet(path)
        held.unpersist()
    return spark.read.schema(RANKED).parquet(path)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best rows of those that the tasks gave."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    score = F.coalesce("score", F.raise_error(F.lit("a score among the best is no bigint")).cast("long")).alias("score")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("id % 50 = 0"))


ORACLE_SQL = {
    "op6_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}

QUERIES = {"op6_topk_search": op6_topk_search}
