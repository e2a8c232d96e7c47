"""Tables of traces, feedback, reviews and verdicts: append, tolerant reading, and stitching late events on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L

TRACE_SCHEMA = (
    "run_id string, ref string, ts double, user string, thread string, question string, answer string, tokens bigint, t1_in_score double, t1_in_band string, "
    "detectors map<string,double>, strict_mode boolean, t1_out_score double, t2_score double, t2_scores map<string,double>, t2_ran array<string>, action string, "
    "trust_label string, retry_count int, timings map<string,double>, feedback string, sources_disagreed boolean, kind string"
)
REVIEW_SCHEMA = (
    "run_id string, queued_at double, due_at double, question string, answer string, evidence map<string,string>, machine_action string, severity double, status string, "
    "kind string, verdict string, reviewer string, note string, at double"
)


def append(df: DataFrame, path: str) -> None:
    """df appended as JSON lines: a lost write costs its own rows."""
    df.write.mode("append").json(path)


def clear(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The well-formed lines of JSON files, half-written ones dropped, with seq: their order, by file and place."""
    raw = spark.read.schema(f"{schema}, __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    return raw.withColumn("seq", F.monotonically_increasing_id()).where(F.col("__bad").isNull()).drop("__bad")


def last_by(events: DataFrame, value: str, order: str) -> DataFrame:
    """(run_id, value): the last value of each run that is not null."""
    return events.where(F.col(value).isNotNull()).groupBy("run_id").agg(F.max_by(value, order).alias(value))


def stitch_feedback(traces: DataFrame, feedback: DataFrame, order: str = "seq") -> DataFrame:
    """traces with the last feedback of each run; feedback without a trace falls away."""
    return traces.drop("feedback").join(last_by(feedback, "feedback", order), "run_id", "left")


def load_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces and feedback from one file of both kinds."""
    lines = read_lines(spark, path, TRACE_SCHEMA)
    told = F.coalesce("kind", F.lit("trace"))
    return stitch_feedback(lines.where(told != "feedback").drop("kind"), lines.where(told == "feedback").select("run_id", "feedback", "seq")).drop("seq")


def queue(df: DataFrame) -> DataFrame:
    """Review items (run_id, queued_at, ...) as they are queued: due within the time that reviews may take."""
    return df.withColumn("due_at", F.col("queued_at") + L.SLA_HOURS * 3600).withColumn("status", F.lit("waiting"))


def checked_verdicts(verdicts: DataFrame) -> DataFrame:
    """verdicts, failing on one that is not known."""
    return verdicts.where(F.assert_true(F.col("verdict").isin(list(L.LESSONS)), F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit("null")))).isNull())


def stitch_verdicts(items: DataFrame, verdicts: DataFrame, order: str = "at") -> DataFrame:
    """items with the last verdict of each; an item with one is reviewed."""
    last = verdicts.groupBy("run_id").agg(F.max_by("verdict", order).alias("verdict"), F.max_by("reviewer", order).alias("reviewer"))
    out = items.drop("verdict", "reviewer").join(last, "run_id", "left")
    return out.withColumn("status", F.when(F.col("verdict").isNotNull(), "reviewed").otherwise(F.col("status")))


def exported(traces: DataFrame) -> DataFrame:
    """traces as nested run records, scores under prefixed names, thumbs as 1 or 0."""
    prefix = lambda c, p: F.transform_keys(F.coalesce(c, F.create_map().cast("map<string,double>")), lambda k, _: F.concat(F.lit(p), k))
    thumbs = F.when(F.col("feedback").isNotNull(), F.array(F.struct(F.lit("user_thumbs").alias("key"), F.when(F.col("feedback") == "up", 1).otherwise(0).alias("score")))).otherwise(F.array().cast("array<struct<key:string,score:int>>"))
    return traces.select(F.col("run_id").alias("id"), F.lit("request").alias("name"), F.struct("question").alias("inputs"), F.struct("answer", "trust_label").alias("outputs"), F.struct("user", "thread", F.col("t1_in_band").alias("band"), "action", "strict_mode", "retry_count").alias("metadata"), F.map_concat(prefix(F.col("detectors"), "detector."), prefix(F.col("t2_scores"), "tier2.")).alias("scores"), thumbs.alias("feedback"))


def read_attacks(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file's prompts that are not null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select("prompt").dropna()


def read_benign(spark: SparkSession, path: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """Instructions with their inputs from a JSON array; a sample of n by seeded hash."""
    rows = spark.read.schema("instruction string, input string, output string").option("multiLine", True).json(path)
    text = F.trim(F.concat_ws(" ", "instruction", "input"))
    return rows.select(text.alias("prompt")).orderBy(F.xxhash64("prompt", F.lit(seed)), "prompt").limit(n)


def fingerprint(examples: DataFrame, encoder: str) -> str:
    """A digest of an example set (category, text) and an encoder's name: the key under which its vectors may be kept."""
    own = F.conv(F.substring(F.md5(F.concat_ws("\t", F.coalesce("category", F.lit("")), F.coalesce("text", F.lit("")))), 1, 15), 16, 10).cast("decimal(38,0)")
    row = examples.agg(F.count("*").alias("n"), F.sum(own).alias("total")).select(F.md5(F.concat_ws("\t", F.lit(encoder), "n", F.coalesce("total", F.lit(0)))).alias("d")).first()
    return row["d"]


def vectors_of(examples: DataFrame, encoder: str, encode: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """encode(examples), written under folder by the examples' fingerprint; as long as neither changes, it is only read."""
    path = f"{folder}/{fingerprint(examples, encoder)}"
    spark = examples.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        encode(examples).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def simulated(spark: SparkSession, n: int, questions: list[str], users: int = 12, seed: int = 7) -> DataFrame:
    """n requests (run_id, user, thread, question, tokens), the same for the same seed."""
    pick = lambda m, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m))
    user = F.concat(F.lit("u"), pick(users, 1).cast("string"))
    return spark.range(n).select(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12).alias("run_id"), user.alias("user"), F.concat(user, F.lit("-"), pick(3, 2).cast("string")).alias("thread"), F.get(F.array(*map(F.lit, questions)), pick(len(questions), 3).cast("int")).alias("question"), (20 + pick(400, 4)).alias("tokens"))
