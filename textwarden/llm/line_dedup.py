"""Line dedup by content-defined chunks of lines (built-in functions only).

A rolling hash over the hashes of neighbouring lines ends a chunk at its local minima, so boundaries depend on nearby lines only, survive
lines inserted elsewhere, and lie at least `reach` + 1 lines apart. Chunks of at least `min_lines` lines are grouped by digest (combined before
the shuffle); of each repeated chunk the first occurrence, by doc_id, text hash and position, stays. The others go after their bytes
have been compared with the first occurrence's. A repeated run may begin and end within chunks: what lies outside the chunks found is
looked up once more as windows of `min_lines` lines, in the same way. A window inside a chunk that has gone needs no look-up, as
the chunk's first occurrence has it too. So exactly the lines in runs of `min_lines` or more that occur earlier go, wherever chunks end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, light, scoped

MODULUS = 2_147_483_647
FACTOR = 31
#: Copies of one span that one task compares with the first; beyond them, its copies are dealt to several.
SALT_ROWS = 20_000


def chunk_spans(lines: Column, reach: int) -> Column:
    """array<struct<from, to>> of 1-based line numbers: the chunks of an array of lines."""

    def once(value, use):  # value is computed once
        return F.get(F.transform(F.array(value), use), 0)

    def rolling(codes):
        return F.transform(codes, lambda c, k: (c + FACTOR * F.coalesce(F.get(codes, k - 1), F.lit(0))) % MODULUS)

    def ends(codes):
        def is_end(i):
            before = F.array_min(F.slice(codes, F.greatest(i - reach, F.lit(1)), F.least(F.lit(reach), i - 1)))
            after = F.array_min(F.slice(codes, i + 1, F.lit(reach)))
            own = F.get(codes, i - 1)
            return (i == F.size(codes)) | (F.coalesce(own < before, F.lit(True)) & F.coalesce(own <= after, F.lit(True)))

        return F.filter(F.sequence(F.lit(1), F.size(codes)), is_end)

    def spans(found):
        return F.transform(found, lambda x, k: F.struct(F.when(k == 0, 1).otherwise(F.get(found, k - 1) + 1).alias("from"), x.alias("to")))

    codes = F.transform(lines, lambda x: F.pmod(F.xxhash64(x), F.lit(MODULUS)))
    return once(codes, lambda c: once(rolling(c), lambda v: once(ends(v), spans)))


def numbers(spans: Column, less: int = 0) -> Column:
    """The line numbers of spans, without the last `less` of each."""
    return F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"] - less)))


def window_spans(lines: Column, size: int, known: Column) -> Column:
    """array<struct<from, to>> of 1-based line numbers: the windows of so many lines that lie in none of the known spans."""
    begins = F.when(F.size(lines) >= size, F.sequence(F.lit(1), F.size(lines) - (size - 1))).otherwise(F.array().cast("array<int>"))
    left = F.array_except(begins, F.coalesce(numbers(known, size - 1), F.array().cast("array<int>")))
    return F.transform(left, lambda i: F.struct(i.alias("from"), (i + (size - 1)).alias("to")))


def chunk_text(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["from"], span["to"] - span["from"] + 1), "\n")


@scoped
def repeats(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, gone array<struct<from, to>>): the spans of texts (doc_id, text_hash, lines, spans) whose lines an earlier span has.

    Texts without spans, or without repeated ones, have no row. Equal rows are one text.
    """
    keys = ["doc_id", "text_hash"]
    shown = F.transform("spans", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), chunk_text(F.col("lines"), s).alias("chunk")))
    each = texts.select(*keys, F.explode(shown).alias("c")).select(*keys, "c.*")
    each = cut(each.withColumn("digest", F.unhex(F.md5("chunk"))))
    counted = each.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(*keys, "from")).alias("first"))
    repeated = cut(counted.where("n > 1").select("digest", "first", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("parts")))
    is_first = F.struct(*keys, "from").eqNullSafe(F.col("first")).alias("is_first")
    wanted = cut(each.join(checked_broadcast(repeated), "digest").select(*keys, "from", "to", "digest", "chunk", "parts", is_first))
    first = wanted.where("is_first").select("digest", "parts", F.col("chunk").alias("first_chunk")).dropDuplicates(["digest"])
    first = first.select("digest", "first_chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = wanted.where("not is_first").withColumn("part", F.pmod(F.xxhash64(*keys, "from"), F.col("parts")).cast("int"))
    same = others.join(first, ["digest", "part"]).where("chunk = first_chunk")
    return same.groupBy(*keys).agg(F.collect_set(F.struct("from", "to")).alias("gone"))


@scoped
def removals(docs: DataFrame, reach: int = 2, min_lines: int = 2) -> DataFrame:
    """(doc_id, text_hash, gone array<struct<from, to>>): which lines of documents (doc_id, text) lie in runs that occur earlier. Spans may overlap."""
    keys = ["doc_id", "text_hash"]
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    chunks = F.filter(chunk_spans(F.col("lines"), reach), lambda s: s["to"] - s["from"] + 1 >= min_lines)
    whole = repeats(texts.withColumn("spans", chunks))
    rest = texts.join(light(whole), keys, "left").select(*keys, "lines", window_spans(F.col("lines"), min_lines, F.col("gone")).alias("spans"))
    return whole.unionByName(repeats(rest)).groupBy(*keys).agg(F.flatten(F.collect_list("gone")).alias("gone"))


def dedup_lines(docs: DataFrame, reach: int = 2, min_lines: int = 2) -> DataFrame:
    """docs, each text without the lines in runs of min_lines lines or more that occur earlier, and lines_removed (long).

    Earlier is by doc_id, text hash and line. n_chars, where docs has it, follows the text. Rows whose text or doc_id is null pass unchanged.
    Rows that are equal in doc_id and text are one document: none of them is the other's repeat. Empty texts have one empty line
    and no run to remove. reach changes how the runs are found, not which.
    """
    columns = docs.columns
    gone = removals(docs.select("doc_id", "text"), reach, min_lines).toDF("gone_id", "gone_hash", "gone_spans")
    joined = docs.join(light(gone), (docs["doc_id"] == F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_hash")), "left")
    after = joined.select(*(docs[c] for c in columns), F.col("gone_spans").alias("__gone"), F.split(docs["text"], "\n").alias("__lines"))
    stay = F.array_except(F.sequence(F.lit(1), F.size("__lines")), numbers(F.col("__gone")))
    after = after.select(*columns, "__lines", F.when(F.col("__gone").isNotNull(), stay).alias("__kept"))
    changed = F.col("__kept").isNotNull()
    text = F.when(changed, F.array_join(F.transform("__kept", lambda i: F.get("__lines", i - 1)), "\n")).otherwise(F.col("text"))
    removed = F.when(changed, F.size("__lines") - F.size("__kept")).otherwise(0).cast("long")
    out = {"text": text} | ({"n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in columns else {})
    return after.select(*(out.get(c, F.col(c)).alias(c) for c in columns), removed.alias("lines_removed"))
