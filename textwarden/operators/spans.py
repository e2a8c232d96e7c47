"""Spans of several finders over the same texts: who gives way, and masks over what is left. Sweeps over sorted ends; no pair of spans is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def free_of(second: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """The spans of second (keys, start, end, ...) that overlap none of first (keys, start, end) in the same text.

    Spans that only touch don't overlap; an empty span overlaps those that it lies strictly within. In order of the place where a span of second ends and one of
    first begins, a span is free if the furthest end so far is not beyond its start: one sort a text. Null starts or ends take part in nothing
    and stay. Null keys are keys like others. Rows of second that are equal stay apart.
    """
    own = [c for c in second.columns if c not in keys]
    told = second.select(*keys, F.col("end").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("int").alias("__reach"), F.struct(*own).alias("__row"))
    other = first.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    other = other.select(*keys, F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.col("end").cast("int").alias("__reach"), F.lit(None).cast(told.schema["__row"].dataType).alias("__row"))
    # at equal places the span that ends comes before the one that begins: they only touch
    before = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    met = told.unionByName(other).withColumn("__furthest", F.max("__reach").over(before)).where("__kind = 0")
    free = F.coalesce(F.col("__furthest") <= F.col("__row.start"), F.lit(True)) | F.col("__row.end").isNull() | F.col("__row.start").isNull()
    return met.where(free).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in own))


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All spans of first, and those of second that are free of them; both have the same columns."""
    return first.unionByName(free_of(second, first, keys))


def masked(text: Column, spans: Column) -> Column:
    """text with each stretch that spans (array of structs with start, end, kind) cover replaced by [kind], the kind of the stretch's first span.

    Overlapping spans are one stretch, so that no mask cuts through another and nothing that any of them covers is left.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def take(state: Column, s: Column) -> Column:
        end = -s["back"]
        new = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.when(new, F.concat(state["done"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(state["done"]).alias("done"), F.greatest(end, state["at"]).alias("at"))

    return F.aggregate(ordered, start, take, lambda state: F.concat(state["done"], F.substring(text, state["at"] + 1, F.lit(2**31 - 1))))
