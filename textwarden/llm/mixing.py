"""Mixing sources to target weights (built-in functions only).

Each source is dealt into blocks of documents by a hash, a fixed random permutation. A source's quota of words is some
whole copies of it and a last part, taken block by block and, in one block, document by document; prefix sums run over
block totals first and inside that single block afterwards, so no task holds a source. The blocks taken go to output shards
by a splitting tree: at each node the number of blocks that every source sends to the left half is drawn from the
multivariate hypergeometric distribution, down to the shards. A shard then draws its disjoint range of each source's
permuted blocks, and is shuffled locally.

Only the table of sources is small by nature: one row a source in the windows over sources and in the tree's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_broadcast, cut, scoped, words_of

SEPARATORS = r"[\x20\x09-\x0D]+"
MOST_COPIES = 3
BLOCK_ROWS = 5000
LEAST_BLOCKS = 16


def n_words(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.size(words_of(text, SEPARATORS)).cast("long")


def dealt(key: Column, seed: str) -> Column:
    """60 random bits that depend on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, sid, weight, source_size, rows, target) of the sources of sizes (source, size).

    Sources in code point order, null last, take the weights in turn. The total size is shared by weight; a target stops at
    MOST_COPIES times the source's size, and what is over is shared again by weight until no target is above. That ends
    at the level where sources, in the order of their caps per weight, first stay below: found here by prefix sums.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("sid", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1).cast("long"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cap = MOST_COPIES * F.col("source_size")
    fill = Window.orderBy(cap / F.col("weight"), "sid")
    ranked = sources.select("*", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("left"), F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("shares"), F.row_number().over(fill).alias("step"))
    below = wide("left") * wide("weight") <= MOST_COPIES * wide("source_size") * wide("shares")
    ranked = ranked.withColumn("stop", F.min(F.when(below, F.col("step"))).over(Window.partitionBy()))
    at = ranked.withColumn("level_left", F.min(F.when(F.col("step") == F.col("stop"), F.col("left"))).over(Window.partitionBy())).withColumn("level_shares", F.min(F.when(F.col("step") == F.col("stop"), F.col("shares"))).over(Window.partitionBy()))
    share = (wide("level_left") * wide("weight")).cast("double") / F.col("level_shares").cast("double")
    return at.select("source", "sid", "weight", "source_size", "rows", F.when(F.col("step") >= F.col("stop"), share).otherwise(cap.cast("double")).alias("target"))


@scoped
def splitting_tree(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """(sid, ends): for each source of quotas (sid, blocks), where each shard's range of its blocks ends.

    shards is a power of two. A node's row holds the blocks each source still has to place below it; the left half's
    blocks are drawn one by one without replacement from all of them, which is the multivariate hypergeometric law.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("sid", "blocks"))).alias("own")).select(F.lit(0).alias("node"), F.col("own.sid").alias("sids"), F.col("own.blocks").alias("own"))

    def draw(state: Column, n: Column) -> Column:
        step = lambda s, i: F.struct(
            (s["want"] - F.when(F.pmod(F.xxhash64(F.lit(seed), F.col("node"), s["of"]), s["of"]) < s["want"], 1).otherwise(0)).alias("want"),
            (s["of"] - 1).alias("of"),
        )
        begun = F.struct(state["want"].alias("want"), state["of"].alias("of"))
        after = F.when(n > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), n), begun, step)).otherwise(begun)
        return F.struct(after["want"].alias("want"), after["of"].alias("of"), F.concat(state["out"], F.array(state["want"] - after["want"])).alias("out"))

    for level in range(shards.bit_length() - 1):
        total = F.aggregate("own", F.lit(0).cast("long"), lambda s, n: s + n)
        halves = nodes.withColumn("total", total).withColumn("half", F.floor((F.col("total") + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node")), F.lit(2))) / 2))
        begun = F.struct(F.col("half").cast("long").alias("want"), F.col("total").alias("of"), F.array().cast("array<bigint>").alias("out"))
        halves = cut(halves.withColumn("left", F.aggregate("own", begun, draw, lambda s: s["out"])))
        sides = F.explode(F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("own")), F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("own", "left", lambda a, b: a - b).alias("own"))))
        nodes = halves.select("sids", sides.alias("s")).select("s.node", "sids", "s.own")
    each = nodes.select("node", F.explode(F.arrays_zip(F.col("sids").alias("sid"), F.col("own").alias("n"))).alias("x")).select("node", "x.sid", "x.n")
    counts = each.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "n"))), lambda x: x["n"]).alias("counts"))
    running = F.aggregate("counts", F.array().cast("array<bigint>"), lambda s, n: F.concat(s, F.array(F.coalesce(F.element_at(F.when(F.size(s) > 0, s), -1), F.lit(0)) + n)))
    return counts.select("sid", running.alias("ends"))


@scoped
def mix_sources(docs: DataFrame, shards: int = 64, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), row_key: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, source, size, source_size, target, taken, and parts, an array of
    (copy, words, shard, place): which of the document's words, how many, go to which shard, and its place's key in the local shuffle.

    taken is at most MOST_COPIES times the size, and the words that a source's documents give are its target, rounded. The last part of a
    source may take the first words of one document only. Null texts have size 0 and give nothing; null sources are a source
    of their own, and sort last; repeated rows are documents of their own, dealt together; rows without doc_id are dealt by their texts. Reruns agree. row_key names a column of docs that
    tells rows apart, by which the result, where it is the first column, can be joined to them: doc_ids may be null or repeat.
    """
    keys = [row_key] if row_key else []
    h = dealt(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), seed)
    sizes = cut(docs.select(*keys, "doc_id", "source", n_words(F.col("text")).alias("size"), h.alias("h")))
    sources = targets(sizes, weights)
    quota = F.least(F.round("target").cast("long"), MOST_COPIES * F.col("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    whole = F.when(whole * F.col("source_size") > quota, whole - 1).otherwise(whole)
    sources = cut(sources.withColumn("copies", whole).withColumn("part", quota - whole * F.col("source_size")).withColumn("blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("rows") / BLOCK_ROWS))))
    known = sizes.alias("d").join(checked_broadcast(sources).alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.sid", "s.source_size", "s.target", "s.copies", "s.part", "s.blocks")
    known = cut(known.withColumn("block", F.pmod("h", F.col("blocks"))))
    by_block = known.groupBy("sid", "block").agg(F.sum("size").alias("block_size"), F.first("copies").alias("copies"), F.first("part").alias("part"))
    before = F.coalesce(F.sum("block_size").over(Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_block = cut(by_block.select("sid", "block", "copies", "block_size", F.greatest(F.lit(0), F.least("block_size", F.col("part") - before)).alias("block_part")))
    copies = F.concat(F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>")), F.when(F.col("block_part") > 0, F.array("copies")).otherwise(F.array().cast("array<bigint>")))
    taken = by_block.select("sid", "block", F.explode(copies).alias("copy"))
    taken = cut(taken.withColumn("turn", F.row_number().over(Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), "sid", "block", "copy"), "copy", "block")) - 1))
    ends = splitting_tree(taken.groupBy("sid").agg(F.count("*").alias("blocks")), shards, seed)
    placed = taken.join(checked_broadcast(ends), "sid").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("turn"))))
    placed = placed.groupBy("sid", "block").agg(F.map_from_entries(F.collect_list(F.struct("copy", "shard"))).alias("shards"))
    blocks = by_block.join(placed, ["sid", "block"], "left").select("sid", "block", "block_size", "block_part", "shards")
    known = known.join(checked_broadcast(cut(blocks)), ["sid", "block"])
    open_block = (F.col("block_part") > 0) & (F.col("block_part") < F.col("block_size"))
    gone = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "block").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", *keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.greatest(F.lit(0), F.least("size", F.col("block_part") - gone))
    known = known.where(open_block).withColumn("last", last).unionByName(known.where(~open_block).withColumn("last", F.when(F.col("block_part") > 0, F.col("size")).otherwise(F.lit(0))))
    part = lambda copy, words: F.struct(copy.alias("copy"), words.alias("words"), F.element_at("shards", copy).alias("shard"), F.xxhash64(F.lit(seed), F.col("doc_id"), copy).alias("place"))
    none = F.array().cast("array<struct<copy:bigint,words:bigint,shard:int,place:bigint>>")
    full = F.when((F.col("copies") > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda c: part(c, F.col("size")))).otherwise(none)
    parts = F.concat(full, F.when(F.col("last") > 0, F.array(part(F.col("copies"), F.col("last")))).otherwise(none))
    return known.select(*keys, "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("last")).alias("taken"), parts.alias("parts"))


def write_shards(mixed: DataFrame, docs: DataFrame, path: str, row_key: str = "doc_id") -> None:
    """The mix as files, a folder a shard, each shard's documents in the order of its local shuffle. row_key tells the rows of docs and of the mix apart."""
    each = mixed.select(row_key, F.explode("parts").alias("p")).select(row_key, "p.*")
    each.join(docs.select(row_key, *({"doc_id", "text"} - {row_key})), row_key).repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
