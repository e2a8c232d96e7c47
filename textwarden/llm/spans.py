"""Repeats of hashed pieces of text across all documents, and the union of spans in a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def repeats(pieces: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The pieces whose key occurs at more than one place (a place is what the order says), with is_first: whether it is its key's first.

    One shuffle of narrow rows by key, then a sort that spills; a frequent key's rows stream through one task. Each
    document adds rows to many keys, so that even a key that a third of all documents hold is a small share of the rows.
    """
    at = Window.partitionBy(*key)
    place = F.struct(*order)
    told = pieces.select("*", F.min(place).over(at).alias("__first"), F.max(place).over(at).alias("__last"))
    return told.where("__first < __last").select(*pieces.columns, (F.col("__first") == place).alias("is_first"))


def union_spans(pieces: DataFrame, of: list[str], least: int = 1, total: str | None = None) -> DataFrame:
    """(*of, start, end): the unions of overlapping or touching spans [start, end), those of at least that length.

    total names a column of the pieces whose sum is added; a piece that ends no later than an earlier one adds nothing."""
    by = Window.partitionBy(*of).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    added = [F.when(F.col("end") <= before, 0).otherwise(F.col(total)).alias(total)] if total else []
    begins = pieces.select(*of, "start", "end", *added, F.when(F.col("start") <= before, 0).otherwise(1).alias("begins"))
    islands = begins.select(*of, "start", "end", *([total] if total else []), F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    sums = [F.sum(total).alias(total)] if total else []
    return islands.groupBy(*of, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *sums).where(F.col("end") - F.col("start") >= least).drop("island")
