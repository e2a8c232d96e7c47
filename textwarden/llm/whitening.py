"""Whitening of embeddings by a tiled covariance.

Pairs of dimensions are split into square tiles of a fixed width. Each task turns its rows into blocks of bounded size, centres them and cuts them into
column blocks; a column block goes to every tile that it is part of, under the key (row block, tile), so that a task never holds more than two column
blocks of one row block. Their product is that row block's share of the tile; shares are summed by tile on the executors, combined before the shuffle. Only the assembled
matrix, whose size is set by the dimensions and not by the rows, reaches the driver, for its eigenvectors.

Vectors are whole numbers, and so are n * x - S (S: the sums over all n vectors). Both are exact, and centring by them loses nothing, however
far from zero the vectors lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scoped
from .topk_search import usable

SCALE, OFFSET = 1024, 100_000
#: Dimensions of a tile, and the most numbers in a row block of all dimensions.
TILE = 32
BLOCK_CELLS = 1 << 19
#: Eigenvalues below this share of the largest one have no direction to speak of in double precision.
LEAST_SHARE = 1e-10


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors (vec_id, embedding) that take part, as whole numbers floor(1024 * entry) + 100000."""
    entry = lambda c: F.floor(c.cast("double") * SCALE) + OFFSET
    return vectors.where(usable(F.col("embedding")) & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", entry).alias("x"))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one width, as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def column_sums(table: DataFrame, column: str) -> tuple[int, list]:
    """How many rows there are, and their sum by dimension, as exact integers."""

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "sums": [_matrix(batch.column(0)).sum(0).tolist()]})

    parts = cut(table.select(column).mapInArrow(partly, "rows long, sums array<long>"))
    each = parts.select(F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    return parts.agg(F.sum("rows")).first()[0] or 0, [int(r["sum"]) for r in each.orderBy("at").collect()]


def covariance(table: DataFrame, column: str, width: int, n: int, centred: Callable[[np.ndarray], np.ndarray], tile: int = TILE) -> np.ndarray:
    """The covariance matrix, divisor n, of the vectors in a column, all of that width; `centred` takes a block's rows to rows without the mean."""
    columns = -(-width // tile)
    rows = max(1, BLOCK_CELLS // width)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Column blocks of row blocks."""
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                y = centred(_matrix(batch.column(0).slice(first, rows)))
                cells = [y[:, c * tile : (c + 1) * tile].tobytes() for c in range(columns)]
                keys = {"task": [task] * columns, "block": [k] * columns, "part": range(columns), "n": [len(y)] * columns}
                yield pa.RecordBatch.from_pydict({name: pa.array(x, pa.int32()) for name, x in keys.items()} | {"cells": pa.array(cells, pa.binary())})
                k += 1

    def product(met: pd.DataFrame) -> pd.DataFrame:
        """One row block's share of a tile."""
        of = {part: np.frombuffer(cells).reshape(n, -1) for part, cells, n in zip(met["part"], met["cells"], met["n"])}
        i, j = int(met["i"].iloc[0]), int(met["j"].iloc[0])
        return pd.DataFrame({"i": [i], "j": [j], "share": [(of[i].T @ of[j]).ravel()]})

    parts = table.select(column).mapInArrow(blocks, "task int, block int, part int, n int, cells binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    dealt = parts.withColumn("with", other).select("*", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j")).drop("with")
    shares = dealt.groupBy("task", "block", "i", "j").applyInPandas(product, "i int, j int, share array<double>")
    cells = shares.select("i", "j", F.posexplode("share").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for i, j, at, v in cells.collect():  # one number for each pair of dimensions
        wide = min(tile, width - j * tile)
        out[i * tile + at // wide, j * tile + at % wide] = v
    return (np.triu(out) + np.triu(out, 1).T) / n


@scoped
def whiten(vectors: DataFrame, components: int = 8, tile: int = TILE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector of vectors (vec_id, embedding) and component up to that number.

    Vectors that are null, empty, or hold a null or non-finite entry take no part, and neither do vectors shorter than the longest one. Components are
    numbered from 1 by falling eigenvalue; each is turned so that its entry of largest size is positive. Components whose eigenvalue is under 1e-10 of the
    largest are left out (repeated or constant vectors have no further direction): a table of equal vectors, or without any, has no rows. Rows with a null or
    repeated vec_id are vectors of their own. Other columns are ignored. Entries, and the exact squared deviations, must fit a long: it fails beyond that.
    """
    spark = vectors.sparkSession
    every = cut(whole(vectors))
    width = every.agg(F.max(F.size("x"))).first()[0] or 0
    own = every.where(F.size("x") == width)
    n, sums = column_sums(own, "x") if width else (0, [])
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    total = np.array(sums, dtype=object)

    def apart(x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if np.abs(x).max() >= (1 << 62) // n:
            raise OverflowError("n * x must fit a long")
        return x * n - total.astype("int64")

    def centred(x: np.ndarray) -> np.ndarray:
        return apart(x) / n

    v = covariance(own, "x", width, n, centred, tile)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    kept = int(np.sum(e[:components] > max(0.0, LEAST_SHARE * e[0])))
    if not kept:
        return spark.createDataFrame([], schema)
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes[:, :kept]).argmax(0), range(kept)])
    onto = axes / np.sqrt(e[:kept])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = apart(_matrix(batch.column("x")))
                if ((z / 2.0**31) ** 2).sum(1).max() >= 1.999999:
                    raise OverflowError("the squared deviation of a vector must fit a long")
                w = pa.array((z / n @ onto).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array((z * z).sum(1)), w], ["vec_id", "deviation", "w"])

    table = cut(own.mapInArrow(projected, "vec_id long, deviation long, w array<double>"))
    mean = np.array(table.agg(*(F.avg(F.get("w", F.lit(k))) for k in range(kept))).first())
    error = float(np.abs(covariance(table, "w", kept, n, lambda w: w - mean, tile) - np.eye(kept)).max())
    explained = F.array(*(F.lit(float(x)) for x in e[:kept] / np.trace(v)))
    each = table.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
