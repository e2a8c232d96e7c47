"""Streams of traces and of the feedback that comes later: joined in event time, and stored exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import fresh_path


def with_feedback(traces: DataFrame, feedback: DataFrame, within: str = "7 days", late: str = "1 hour") -> DataFrame:
    """A stream of traces (run_id, ts, ...) with the last feedback that came within that time after each, or null.

    feedback is a stream (run_id, at, seq, feedback). A trace comes out when the watermark is past all feedback it may have; feedback without a trace, or
    that comes after `within`, falls away, and so do rows that are later than the watermark allows. State is what these times span. Of several,
    the one of the highest seq counts. Repeated rows of a trace come out as one.
    """
    t = traces.withWatermark("ts", late)
    f = feedback.select(F.col("run_id").alias("__of"), F.col("at").alias("__at"), F.col("seq").alias("__seq"), F.col("feedback").alias("__told")).withWatermark("__at", late)
    met = t.join(f, F.expr(f"__of = run_id AND __at >= ts AND __at <= ts + INTERVAL {within}"), "left_outer")
    return met.groupBy(*traces.columns).agg(F.max_by("__told", F.when(F.col("__told").isNotNull(), F.col("__seq"))).alias("feedback"))


def store_kinds(stream: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Starts writing a stream with a column `kind` to one folder, split by kind, each row exactly once; returns the query.

    Files count as soon as the sink's log names them: what a failed batch has left behind isn't read, and a batch that is run again after a restart isn't
    written twice. once: stop when all input there is now has been taken.
    """
    writer = stream.writeStream.format("parquet").partitionBy("kind").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: The numbers in a closing row.
CLOSING = -1


def closed(stream: DataFrame, ts: str, until: str = "2200-01-01 00:00:00") -> DataFrame:
    """A stream over files followed by a row that lies after all others, so that the watermark passes them all: for replays of finished input.

    Its whole numbers are CLOSING, other columns null. The row comes in the first batch, so that the stream must take its input in one.
    """
    spark = stream.sparkSession
    of = {ts: until} | {name: CLOSING for name, kind in stream.dtypes if kind in ("bigint", "int")}
    end = spark.range(1).select(*(F.lit(of.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema))
    path = fresh_path(spark)
    end.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def replayed(stream: DataFrame) -> DataFrame:
    """What a stream yields on all input there is now, through a file sink in the shared folder."""
    out = fresh_path(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", fresh_path(stream.sparkSession)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
