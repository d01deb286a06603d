"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... equal segments. For a segment of length L with means m, m' and root sums of squared
deviations d, d', the inner product of the two vectors there is at most L*m*m' + d*d' (Cauchy-Schwarz), so the sum over
segments bounds the score from above (the distance from below). Candidates are filtered from coarse to fine against the
k-th best exact score met so far, and the exact product is computed for those that survive every level.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def quantised(vec: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of every component as long."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vec: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine, F.lit(False))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row a vector; shorter ones are padded with zeros, which add nothing to a product."""
    out = np.zeros((len(column), width), np.int64)
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    cols = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, cols] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _levels(width: int) -> list[np.ndarray]:
    """Segment borders from coarse to fine."""
    counts, n = [], 1
    while n < max(width, 2) and n <= 32:
        counts.append(n)
        n *= 2
    return [np.linspace(0, width, n + 1).astype(np.int64) for n in counts]


def _statistics(x: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(L) * mean and the root of the summed squared deviations of every segment."""
    length = np.diff(borders).astype(np.float64)
    total = np.add.reduceat(x, borders[:-1], axis=1)
    square = np.add.reduceat(x * x, borders[:-1], axis=1)
    return total / np.sqrt(length), np.sqrt(np.maximum(square - total * total / length, 0))


def _search(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[tuple]:
    """Of the k best of base for each query, as (query_id, vec_id, score), those that reach the query's bar, a score that k
    candidates are known to reach (nan: none is known)."""
    order = np.argsort(ids, kind="stable")
    base, ids = base[order], ids[order]
    b, q = base.astype(np.float64), queries.astype(np.float64)
    exact = float(np.abs(b).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, base.shape[1]) < 2**52
    score_of = (lambda rows, i: (b[rows] @ q[i]).astype(np.int64)) if exact else (lambda rows, i: base[rows] @ queries[i])
    slack = 1e-9 * (np.linalg.norm(b, axis=1).max(initial=0) * np.linalg.norm(q, axis=1).max(initial=0)) + 1.0
    levels = [(_statistics(b, x), _statistics(q, x)) for x in _levels(base.shape[1])] if base.shape[1] else []
    found = []
    for i, query_id in enumerate(query_ids):
        rows = np.flatnonzero(ids != query_id)
        bar = None if bars is None or np.isnan(bars[i]) else bars[i]
        for (bm, bd), (qm, qd) in levels:
            if len(rows) <= k and bar is None:
                break
            bound = bm[rows] @ qm[i] + bd[rows] @ qd[i] + slack
            if bar is None:  # the k most promising candidates give a first k-th best score
                first = rows[np.argpartition(-bound, k - 1)[:k]]
                bar = np.sort(score_of(first, i))[0]
            rows = rows[bound >= bar]
        score = score_of(rows, i)
        best = np.lexsort((ids[rows], -score))[:k]
        found += [(int(query_id), int(ids[rows[j]]), int(score[j])) for j in best if bars is None or np.isnan(bars[i]) or score[j] >= bars[i]]
    return found


def exact_top_k(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "vec", base_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """The k rows of base with the highest integer inner product for every query: query_id, rank, vec_id, score.

    base and queries hold id_col (long) and vec_col (array of long). A row is no candidate for a query of its own id;
    ties go to the smaller id; fewer than k candidates give fewer rows. Rows without id take no part, an empty table
    gives no rows, vectors of unequal length are compared as if padded with zeros, a repeated row counts as often as it
    stands there, other columns are ignored. Products beyond 64 bits are not defined.

    Rows are dealt into blocks by a hash of their id, so that copies of one vector spread. A block of queries first meets
    one block of base, which gives each query a bar; then it meets the others, each in a task of bounded size, which returns
    what reaches the bar, k rows at most for each query.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    base, queries = clean(base), clean(queries)
    n, m = base.agg(F.count("*"), F.max(F.size("v"))).first()
    n_queries, m_queries = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(m or 0, m_queries or 0)
    blocks, query_blocks = max(1, math.ceil(n / base_block)), max(1, math.ceil(n_queries / query_block))

    def block(of: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(q: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        if q.num_rows and b.num_rows:
            bars = np.nextafter(q["bar"].cast(pa.float64(), safe=False).fill_null(float("nan")).to_numpy(), -np.inf)
            rows = _search(_matrix(q["v"], width), q["id"].to_numpy(), _matrix(b["v"], width), b["id"].to_numpy(), k, bars)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], schema=schema)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, "query_id long, vec_id long, score long")

    left, right = queries.withColumn("qb", block(query_blocks)), base.withColumn("vb", block(blocks))
    # the first block of base that a block of queries meets is that of its number, more or less
    partners = F.filter(F.sequence(F.lit(0), F.lit(query_blocks - 1)), lambda x: x % blocks == F.col("vb"))
    no_bar = left.withColumn("bar", F.lit(None).cast("long")).withColumn("vb", F.col("qb") % blocks)
    first = stored(met(no_bar, right.withColumn("qb", F.explode(partners))), "first")
    bars = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).alias("bar"))
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: x != F.col("qb") % blocks)
    rest = F.filter(F.sequence(F.lit(0), F.lit(query_blocks - 1)), lambda x: x % blocks != F.col("vb"))
    second = met(left.join(bars, "id", "left").withColumn("vb", F.explode(others)), right.withColumn("qb", F.explode(rest)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
