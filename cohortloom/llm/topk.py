"""Exact top-k by inner product with the threshold algorithm.

Every component x is taken as floor(256 x), so scores are integers. Candidates are dealt by a hash into blocks; a block
holds, for each dimension, its rows sorted by that component. For a query the lists are read from the end that the
sign of the query's component favours, some ranks at a time: rows met for the first time are scored in full, and the
sum of the query's components times the values at the read depth bounds every row not met yet. Reading ends when that
bound is below the k-th best score (a bound equal to it could still hide a tie with a smaller id).

Queries and candidates meet block by block; the k best of each block are merged per query.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
CANDIDATE_BLOCK = 8_192
QUERY_BLOCK = 512
#: Ranks read of every list before the first bound test; each further round doubles the depth.
FIRST_DEPTH = 16

_SCHEMA = "query_id long, vec_id long, score long"


def integer_vector(embedding: str) -> Column:
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(embedding: str) -> Column:
    """Neither null nor empty, and every component a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~F.exists(F.col(embedding), bad)


def number_type(queries: np.ndarray, rows: np.ndarray) -> type:
    """Floats where every sum of products stays below 2^53 and so is exact, else 64-bit integers; refused beyond those."""
    reach = lambda v: max(abs(int(v.max())), abs(int(v.min())), 1)
    most = reach(queries) * reach(rows) * rows.shape[1]
    if most >= 1 << 63:
        raise OverflowError("inner products of these vectors pass 64 bits")
    return np.float64 if most < 1 << 53 else np.int64


def threshold_scan(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows other than ``own``; ``order[j]`` lists the rows by ascending component j."""
    n = len(rows)
    seen, met = np.zeros(n, bool), np.zeros(n, bool)
    best_id, best = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)  # lists read from their ends, and from their beginnings
    depth, done = FIRST_DEPTH, 0
    while True:
        depth = min(depth, n)
        if len(up) or len(down):
            met[order[up, n - depth : n - done]] = True
            met[order[down, done:depth]] = True
        else:  # every score is 0
            met[:], depth = True, n
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        new = new[ids[new] != own]
        best_id, best = np.concatenate([best_id, ids[new]]), np.concatenate([best, rows[new] @ query])
        if len(best) > k:
            near = np.flatnonzero(best >= np.partition(best, len(best) - k)[len(best) - k])
            near = near[np.lexsort((best_id[near], -best[near]))[:k]]
            best_id, best = best_id[near], best[near]
        if depth == n:
            break
        bound = rows[order[up, n - depth], up] @ query[up] + rows[order[down, depth - 1], down] @ query[down]
        if len(best) >= k and bound < best.min():
            break
        done, depth = depth, depth * 2
    top = np.lexsort((best_id, -best))[:k]
    return best_id[top], best[top]


def _scan_block(k: int):
    def scan(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy(zero_copy_only=False)
        ids = table["vec_id"].to_numpy()
        rows = np.stack(table["v"].to_numpy(zero_copy_only=False))
        queries, query_ids = rows[is_query], ids[is_query]
        rows, ids = rows[~is_query], ids[~is_query]
        out = [np.zeros((3, 0), np.int64)]
        if len(ids) and len(queries):
            kind = number_type(queries, rows)
            queries, rows = queries.astype(kind), rows.astype(kind)
            order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)
            for q, own in zip(queries, query_ids):
                best_id, best = threshold_scan(q, own, ids, rows, order, k)
                out.append(np.stack([np.full(len(best), own), best_id, best.astype(np.int64)]))
        merged = np.concatenate(out, axis=1)
        return pa.table(dict(zip(["query_id", "vec_id", "score"], merged)))

    return scan


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of every query: query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    Both inputs need an id and an array of numbers; other columns are ignored. Rows with a null id, a null or empty
    vector, or a null or non-finite component take no part. Only vectors of equal length meet. Repeated equal rows
    count once. Inner products that could pass 64 bits are refused with an error. A candidate with the query's own id is left out. A query without candidates has no rows.
    """
    def ready(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), integer_vector(vector_col).alias("v")).distinct()

    rows, asked = ready(candidates), ready(queries)
    blocks = max(1, -(-rows.count() // CANDIDATE_BLOCK))
    asked_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    here = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks))
    theirs = F.pmod(F.xxhash64(F.lit("asked"), "vec_id"), F.lit(asked_blocks))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    every_asked = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked_blocks - 1).cast("long")))
    left = rows.select("vec_id", "v", F.lit(False).alias("is_query"), here.alias("block"), every_asked.alias("asked"))
    right = asked.select("vec_id", "v", F.lit(True).alias("is_query"), every_block.alias("block"), theirs.alias("asked"))
    found = left.unionByName(right).withColumn("dims", F.size("v")).groupBy("block", "asked", "dims").applyInArrow(_scan_block(k), _SCHEMA)
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

