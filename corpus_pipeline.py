"""The corpus pipeline: documents in, a de-duplicated and decontaminated mix of good documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import decontaminate, line_dedup, mixing, ngram_jaccard, quality_rules
from textwarden.llm.common import cut, scoped


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of two lines or more that occur earlier; a document of which nothing is left goes."""
    left = line_dedup.dedup_lines(docs)
    return left.where((F.col("lines_removed") == 0) | (F.trim("text") != "")).drop("lines_removed")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near copies (five words, 0.8)."""
    return ngram_jaccard.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that it takes, with the words taken, the shard, and the place in its shuffle."""
    keyed = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    mixed = mixing.mix_sources(keyed, row_key="__row").select("__row", "size", "source_size", "target", "taken", F.explode("parts").alias("p"))
    return keyed.join(cut(mixed.select("__row", "size", "source_size", "target", "taken", "p.*")), "__row").drop("__row")


STAGES = [("quality", quality), ("line dedup", lines), ("n-gram Jaccard", near_copies), ("decontamination", benchmark), ("mixing", mix)]
#: SQL can express neither the classifier nor its training; tests hold the stages against brute force.
ORACLE_SQL = None


@scoped
def through(docs: DataFrame, spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    """docs after the stages up to the last-th. A stage's table goes as soon as the next one's is written, with all that the stage wrote on its way."""
    before = through(docs, spark, sf_dir, last - 1) if last else docs
    return STAGES[last][1](spark, before, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written and read again. The last one's table stays, for the caller."""
    return through(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark, sf_dir, len(STAGES) - 1)
