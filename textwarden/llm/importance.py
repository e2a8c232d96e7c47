"""Importance resampling towards a target: documents whose word runs are likelier in the target than in the corpus are drawn more often.

Features are runs of 1 to 3 words, hashed into a fixed number of buckets. The counts of all buckets, in the corpus and in the target, become one
array of whole-number gains, whose length is a parameter; it is the only thing broadcast. Weights are summed by array lookups in one pass over
the texts: only one narrow row a document is shuffled. Whole-number scores allow an exact histogram, summed up from its top in two levels of
bounded size (bins of scores, then the scores of a bin), which gives each score's first rank and the lowest score that is still drawn. Only documents
from that score on are numbered, by doc_id within each score; no sort over all documents takes place.

Python is not used on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, lower_ascii, scoped, words_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 3
#: Most bins of the coarse histogram, and least scores in each of them.
BINS = 65_536
BIN_SCORES = 1024


def _words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased. Texts of ASCII only, whose bytes are as many as their letters, take the quicker way."""
    return words_of(F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text)), SEPARATORS)


def _by_word(texts: DataFrame) -> DataFrame:
    """texts, which have an array `words`, with a row for each place `at` in it (one with null, for none)."""
    return texts.select("*", F.posexplode_outer("words").alias("at", "word"))


def _buckets(buckets: int) -> list[Column]:
    """The buckets of the features that start at the place `at` of `words`: null where they would pass its end."""
    run, out = F.col("word"), []
    for k in range(LONGEST):
        if k:
            run = F.concat(run, F.lit(" "), F.get("words", F.col("at") + k))
        out.append(F.crc32(run.cast("binary")) % buckets)
    return out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts (text) fall in each bucket that has any."""
    words = texts.select(_words(F.col("text")).alias("words"))
    each = _by_word(words).select(F.explode(F.array(*_buckets(buckets))).alias("bucket")).where(F.col("bucket").isNotNull())
    return each.groupBy("bucket").agg(F.count("*").alias("n"))


def gains_of(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with `gains`, an array over the buckets: floor(1000 * ln of how much likelier a bucket is in the target), with one added to each count."""
    spark = docs.sparkSession
    found = bucket_counts(docs, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    none = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = found.unionByName(none).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    rows = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"), F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("rows"))
    number = lambda c: c.cast("double")
    over, under = number(F.col("all_s")) + buckets, number(F.col("all_t")) + buckets
    return rows.select(F.transform("rows", lambda r: F.floor(F.log((number(r["t"]) + 1) * over / ((number(r["s"]) + 1) * under)) * 1000)).alias("gains"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel draw) that only seed and doc_id decide: the highest sums of weight and draw are a sample without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def scored(docs: DataFrame, gains: DataFrame, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of each document; gains as gains_of() has them."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("words"))
    each = _by_word(texts.crossJoin(F.broadcast(gains)))  # gains is one row of a fixed length
    gain = sum(F.coalesce(F.get("gains", b.cast("int")), F.lit(0)) for b in _buckets(buckets))
    here = sum(F.when(F.get("words", F.col("at") + k).isNotNull(), 1).otherwise(0) for k in range(LONGEST))
    summed = each.groupBy("row", "doc_id").agg(F.count("word").alias("n_words"), F.sum(here.cast("long")).alias("n_features"), F.sum(gain).alias("weight"))
    return summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def first_ranks(counts: DataFrame) -> DataFrame:
    """(score, n, ahead) of (score, n): how many rows have a higher score. Bins first, then the scores of each bin, so that no window is large."""
    ends = counts.agg(F.min("score"), F.max("score")).first()
    low, high = (0, 0) if ends[0] is None else ends
    width = max(BIN_SCORES, (high - low) // BINS + 1)
    binned = counts.withColumn("bin", F.expr(f"(score - {low}L) div {width}L"))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("bin").agg(F.sum("n").alias("of_bin")).select("bin", F.coalesce(F.sum("of_bin").over(above), F.lit(0)).alias("over"))
    within = Window.partitionBy("bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(F.broadcast(bins), "bin").select("score", "n", (F.col("over") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("ahead"))


@scoped
def resample(docs: DataFrame, target: DataFrame, num: int = 5, den: int = 100, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of each row of docs (doc_id, text): the sample towards target (text).

    Of the documents with a doc_id and least_words words or more, floor(num * count / den) with the highest scores are drawn; rank counts them from 1 and is
    null for all others. Ties go to the smaller doc_id, then to the row. A null or empty text has no words, no features and the weight 0. A null
    doc_id has no draw: score and rank are null, and it isn't counted among the documents to draw from. Rows that repeat a doc_id are documents of
    their own with the same draw. Rows and texts of any length are read whole; other columns are ignored. An empty table gives no rows; an
    empty target only makes rare buckets likelier. doc_id must fit a long.
    """
    gains = cut(gains_of(docs, target, buckets))
    every = cut(scored(docs, gains, seed, buckets))
    may = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    counts = cut(every.where(may).groupBy("score").agg(F.count("*").alias("n")))
    drawn = (counts.agg(F.sum("n")).first()[0] or 0) * num // den
    firsts = cut(first_ranks(counts).where(F.col("ahead") < drawn).select("score", "ahead"))
    lowest = firsts.agg(F.min("score")).first()[0]
    if lowest is None:
        return every.withColumn("rank", F.lit(None).cast("long"))
    reached = may & (F.col("score") >= lowest)
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "row"))
    rank = F.col("ahead") + place
    ranked = every.where(reached).join(firsts, "score").withColumn("rank", F.when(rank <= drawn, rank).cast("long")).select(*every.columns, "rank")
    return ranked.unionByName(every.where(~F.coalesce(reached, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, **named) -> DataFrame:
    """The documents drawn, whole, one row for each drawn doc_id's row; see resample(). Rows that repeat a doc_id are drawn together, if any of them is."""
    ids = resample(docs, target, **named).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["__drawn"], "left_semi")
