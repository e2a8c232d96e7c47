"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are turned to the principal axes of a bounded sample, largest first, which keeps inner products. They are then cut into segments,
each summarised by its mean and deviation. By Cauchy-Schwarz, |q - c|^2 >= sum of |segment| ((mean_q - mean_c)^2 + (dev_q - dev_c)^2), and
with exact norms that lower bound of a distance is an upper bound of the inner product. The coarsest level has segments of 1, 1, 2, 4, ...
axes, and each further level halves them. Each query knows a score that k candidates reach: from the candidates whose coarsest bounds are
highest, and from an earlier pass over one block of candidates. Candidates leave a query at the first level whose bound stays under that
score; those that survive all levels get exact integer products.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is one group, so that no task or broadcast
grows with the data. Each block gives at most k rows a query, and their best k are taken by merging. Every query meets every block of
candidates: shuffle and bounds grow with the product of their numbers, as those of any exact search without an index do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, scoped

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
TILE = 64
#: Vectors of the sample that the axes are fitted on, and the width beyond which vectors are not turned.
SAMPLE = 4096
MOST_TURNED = 1024


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def levels(width: int) -> list[list[int]]:
    """Sizes of the segments of each level, coarse to fine; the last level still has a segment of several axes, where width allows."""
    sizes = [1]
    while sum(sizes) < width:
        sizes.append(min(sum(sizes), width - sum(sizes)))
    out = [sizes]
    while max(out[-1]) > 2:
        out.append([half for n in out[-1] for half in ([n] if n == 1 else [n // 2, n - n // 2])])
    return out


def _summary(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Vectors whose inner products bound those of x from above: means and deviations, weighted by the root of the segment's size."""
    parts = np.split(x, np.cumsum(sizes)[:-1], axis=1)
    out = [p.mean(1) * p.shape[1] ** 0.5 for p in parts] + [p.std(1) * p.shape[1] ** 0.5 for p in parts if p.shape[1] > 1]
    return np.stack(out, axis=1)


def survivors(queries: list[np.ndarray], candidates: list[np.ndarray], reached: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Which pairs of open_ (queries x candidates) no level's bound leaves under what the query has reached. Summaries are given by level."""
    open_ = open_.copy()
    for q, c in zip(queries, candidates, strict=True):
        some = np.flatnonzero(open_.any(0))
        if not len(some):
            break
        bound = q @ c[some].T
        open_[:, some] &= bound * (1 + 1e-9) + 1e-6 * (1 + np.abs(bound)) >= reached[:, None]
    return open_


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    w = min(len(axes), x.shape[1])
    return np.concatenate((x[:, :w] @ axes[:w], x[:, w:]), axis=1) if w == len(axes) else x


def block_top_k(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, axes: np.ndarray) -> pd.DataFrame:
    """The k best candidates (row, vec_id, v) of each query (row, vec_id, v, reached) in one pair of blocks, without those under what it has reached."""
    width = max([1, *map(len, queries["v"]), *map(len, candidates["v"])])
    q, c = _matrix(queries["v"], width), _matrix(candidates["v"], width)
    qr, cr = queries["row"].to_numpy(np.int64), candidates["row"].to_numpy(np.int64)
    qi, ci = queries["vec_id"].to_numpy(np.int64), candidates["vec_id"].to_numpy(np.int64)
    known = queries["reached"].to_numpy(float, na_value=-np.inf)
    exact = width * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) < 2**53
    integers = (lambda vectors: vectors) if exact else (lambda vectors: np.array([[int(x) for x in v] for v in vectors], dtype=object).reshape(len(vectors), width))
    tq, tc = _turned(q, axes), _turned(c, axes)
    sq, sc = ([_summary(x, sizes) for sizes in levels(width)] for x in (tq, tc))
    rows = []
    for a in range(0, len(q), TILE):
        at = slice(a, min(a + TILE, len(q)))
        ids, reached = qi[at], known[at].copy()
        other = qr[at][:, None] != cr[None, :]
        coarse = np.where(other, sq[0][at] @ sc[0].T, -np.inf)
        few = min(len(c), 2 * k)
        first = np.argpartition(-coarse, few - 1, axis=1)[:, :few]
        scores = np.einsum("qd,qcd->qc", q[at], c[first]) if exact else (tq[at][:, None, :] * tc[first]).sum(2)
        scores = np.where(np.take_along_axis(other, first, 1), scores, -np.inf)
        if few >= k:
            slack = 0.0 if exact else 1e-6
            reached = np.maximum(reached, (lambda x: x - slack * (1 + np.abs(x)))(np.partition(scores, -k, axis=1)[:, -k]))
        open_ = survivors([x[at] for x in sq], sc, reached, other)
        for r in range(len(ids)):
            left = np.flatnonzero(open_[r])
            told = integers(c[left]) @ integers(q[at][r : r + 1])[0]
            best = _best(told.astype(float) if exact else told, ci[left], k)
            rows.append(pd.DataFrame({"row": qr[at][r], "query_id": ids[r], "vec_id": ci[left[best]], "score": [int(x) for x in told[best]]}))
    return pd.concat(rows, ignore_index=True) if rows else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")


def principal_axes(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The principal axes, as columns, largest first, of the sample vectors (vec_id, v) of smallest hash; no axes for none or for wide ones."""
    few = [v for (v,) in vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").collect()]
    width = max(map(len, few), default=0)
    if not width or width > MOST_TURNED:
        return np.zeros((0, 0))
    x = _matrix(few, width)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


@scoped
def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) where is_query holds, the k largest integer inner products with all
    other rows, ties to the smaller vec_id; all of them, if fewer.

    Rows with a null vec_id, and vectors that are null or have a null or non-finite component, take no part. Shorter vectors count as padded
    with zeros. Rows that repeat a vec_id are queries and candidates of their own, each other's as well: only a query's own row is left out. vec_ids
    and scores must fit a long. Other columns are ignored; an empty table has no rows.
    """
    own = cut(vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), floored(F.col("embedding"), scale).alias("v"), is_query.alias("is_query")))
    counts = own.agg(F.count("*").alias("all"), F.count_if("is_query").alias("queries")).first()
    axes = principal_axes(own)
    q_blocks, c_blocks = -(-counts["queries"] // QUERY_BLOCK) or 1, -(-counts["all"] // CANDIDATE_BLOCK) or 1
    q_block = F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int")
    c_block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(c_blocks)).cast("int")
    queries = own.where("is_query").select("row", "vec_id", "v", q_block.alias("qb"))
    candidates = own.select("row", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), c_block.alias("cb"))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return block_top_k(left, right, k, axes)

    def passed(asking: DataFrame, first: int, last: int) -> DataFrame:
        dealt = asking.select(*(F.col(c).alias(c) for c in asking.columns), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("cb"))
        met = candidates.where(F.col("cb").between(first, last))
        return dealt.groupBy("qb", "cb").cogroup(met.groupBy("qb", "cb")).applyInPandas(pair, "row long, query_id long, vec_id long, score long")

    each = passed(queries.withColumn("reached", F.lit(None).cast("double")), 0, 0)
    if c_blocks > 1:
        # what k candidates of the first block reach, each query brings to the others
        each = cut(each)
        reached = each.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("reached"))
        asking = queries.join(reached, "row", "left")
        each = each.unionByName(passed(asking, 1, c_blocks - 1))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
