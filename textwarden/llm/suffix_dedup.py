"""Dedup with sparse suffix arrays over words.

Suffixes are kept only where the smallest hash among `window` neighbouring 8-word grams stands (a minimiser), a choice that the
text alone makes, so equal passages keep equal suffixes. The suffixes are sorted by a hash of their first T = length - window + 1
words; equal neighbours are candidates. A run of at least `length` words that two places share has its first
minimiser within the first `window` grams, so its suffix there shares T words: no run is missed.

Then matches are extended, to the right by comparing the first `length` words of all candidates, whose hash each suffix brings along. To the
left, candidates are compared by the windows of `length` words beginning 1 .. window - 1 words before them, except inside a long match, where all
places that share a suffix share its neighbours too: those windows add nothing there. What is marked covers exactly the words that lie in some
`length`-word window occurring at least twice; within a document, marked windows unite to spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, scoped
from .hashing import Words, mix, word_slices
from .spans import repeats, union_spans

GRAM = 8


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minima of the windows of that size, by doubling."""
    done, out = 1, x
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def minimisers(words: Words, window: int) -> np.ndarray:
    """Sorted positions of grams that are the smallest (and, of equals, last) of some window of grams inside one row."""
    grams, ok = words.windows(GRAM)
    n = len(grams)
    if n < window:
        return np.zeros(0, dtype=np.int64)
    # the low bits order equal grams by place, so that minima name their place
    ranked = (mix(grams, 21) & ~np.uint64((1 << 22) - 1)) | (np.uint64((1 << 22) - 1) - (np.arange(n, dtype=np.uint64) & np.uint64((1 << 22) - 1)))
    least = _window_min(ranked, window)
    whole = ok[: len(least)] & ok[window - 1 :] & (np.repeat(words.first[1:], np.diff(words.first))[: len(least)] == np.repeat(words.first[1:], np.diff(words.first))[window - 1 :])
    low = np.uint64((1 << 22) - 1) - (least[whole] & np.uint64((1 << 22) - 1))
    base = np.flatnonzero(whole)
    place = base + ((low.astype(np.int64) - base) & ((1 << 22) - 1))
    return np.unique(place)


def _prefix(code: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the size words from each place on."""
    out = np.zeros(len(at), dtype=np.uint64)
    weight = np.uint64(1)
    for k in range(size):
        out = out + code[at + k] * weight
        weight = np.uint64(int(weight) * 0xD1342543DE82EF95 & (1 << 64) - 1)
    return mix(out, seed)


def _suffixes(length: int, window: int):
    """Rows (doc, text): hashes of the first words of the suffixes at minimisers, and of their first length words, null where the text ends before."""
    first = length - window + 1

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for words in word_slices(batch.column(1)):
                at = minimisers(words, window)
                row = np.searchsorted(words.first, at, "right") - 1
                fits = at + first <= words.first[row + 1]
                at, row = at[fits], row[fits]
                long = at + length <= words.first[row + 1]
                whole = np.zeros(len(at), dtype=np.int64)
                whole[long] = _prefix(words.code, at[long], length, 32).view(np.int64)
                keys = pa.array(_prefix(words.code, at, first, 31).view(np.int64))
                places = [pa.array(ids[words.row0 + row]), pa.array((at - words.first[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([keys, pa.array(whole, mask=~long), *places], ["key", "whole", "doc", "pos"])

    return run


def _before(length: int, window: int):
    """Rows (doc, text, spots): windows of length words that begin 1 .. window - 1 words before each spot."""
    shifts = np.arange(1, window)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            spots = batch.column(2)
            values, ends = spots.values.to_numpy(), spots.offsets.to_numpy()
            for words in word_slices(batch.column(1)):
                rows = np.arange(words.row0, words.row0 + len(words.row_start) - 1)
                counts = ends[rows + 1] - ends[rows]
                own = values[ends[rows[0]] : ends[rows[-1] + 1]].astype(np.int64)
                at = (own[:, None] - shifts[None, :]).ravel()
                row = np.repeat(np.repeat(np.arange(len(rows)), counts), len(shifts))
                fits = (at >= 0) & (at + words.first[row] + length <= words.first[row + 1])
                at, row = at[fits], row[fits]
                yield pa.RecordBatch.from_arrays([pa.array(_prefix(words.code, at + words.first[row], length, 32).view(np.int64)), pa.array(ids[words.row0 + row]), pa.array(at.astype(np.int32))], ["key", "doc", "pos"])

    return run


SHAPE = "key long, doc long, pos int"


def _word_counts():
    def run(batches):
        for batch in batches:
            counts = [np.diff(words.first) for words in word_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], ["doc", "n_words"])

    return run


@scoped
def shared_suffixes(texts: DataFrame, length: int, window: int) -> DataFrame:
    """(key, whole, doc, pos, again, is_first): the suffixes of texts (doc, text) whose key several places have, and whether their first length words
    occur elsewhere, or occur here first. One shuffle: suffixes that agree in more words agree in fewer."""
    told = texts.mapInArrow(_suffixes(length, window), "key long, whole long, doc long, pos int")
    found = repeats(told, ["key"], ["doc", "pos"]).select("key", "whole", "doc", "pos").distinct()
    alike, place = Window.partitionBy("key", "whole"), F.struct("doc", "pos")
    again = F.col("whole").isNotNull() & (F.min(place).over(alike) < F.max(place).over(alike))
    return found.select("*", again.alias("again"), (F.min(place).over(alike) == place).alias("is_first"))


@scoped
def places_to_extend(found: DataFrame, reach: int) -> DataFrame:
    """(doc, spots): the suffixes before which shared runs can begin, or behind which they can end before a whole window does.

    All places that share a suffix may share its neighbour too, at the same distance of at most reach words. Only at a group's first suffix can
    runs begin between suffixes, and only at its last can they end early.
    """
    by = Window.partitionBy("doc").orderBy("pos")
    beside = lambda at, name: {name: at("key", 1).over(by), f"{name}_gap": F.abs(F.col("pos") - at("pos", 1).over(by))}
    members = found.select("key", "whole", "doc", "pos").withColumns(beside(F.lag, "before") | beside(F.lead, "after"))
    alike = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    one = lambda name: F.when(alike(name) & alike(f"{name}_gap") & (F.max(f"{name}_gap") <= reach), F.min(name)).alias(name)
    told = cut(members.groupBy("key").agg(F.count("*").alias("n"), alike("whole").alias("ahead"), one("before"), one("after")))
    sizes = lambda name: told.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"))
    told = told.join(sizes("before"), "before", "left").join(sizes("after"), "after", "left")
    begins = ~F.coalesce(F.col("n") == F.col("n_before"), F.lit(False))
    ends = ~F.col("ahead") & ~F.coalesce(F.col("n") == F.col("n_after"), F.lit(False))
    need = found.select("key", "doc", "pos").join(told.where(begins | ends).select("key"), "key", "left_semi")
    return need.groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("spots"))


@scoped
def repeated_windows(docs: DataFrame, length: int = 50, window: int = 16) -> DataFrame:
    """(doc_id, pos, is_first): windows of length words, from word pos on, that occur elsewhere too, enough of them to cover every
    word of every such window. is_first marks a window's first occurrence by doc_id and place.

    Words part at 0x20 and 0x09-0x0D, with A-Z lower-cased. Null or shorter texts have no window; rows with a null doc_id
    take no part; of rows with equal doc_id, windows of either text count, at that doc_id.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    found = shared_suffixes(texts, length, window)
    right = found.where("again").select("doc", "pos", "is_first")
    at_need = texts.join(places_to_extend(found, length - window + 1), "doc").select("doc", "text", "spots")
    left = repeats(at_need.mapInArrow(_before(length, window), SHAPE), ["key"], ["doc", "pos"]).select("doc", "pos", "is_first")
    return right.unionByName(left).groupBy("doc", "pos").agg(F.min("is_first").alias("is_first")).withColumnRenamed("doc", "doc_id")


@scoped
def repeated_spans(docs: DataFrame, length: int = 50, window: int = 16) -> DataFrame:
    """One row per doc_id that shares a run of at least length words: doc_id, n_words, n_repeated (words in such runs), n_removable
    (those in runs that occur earlier, by doc_id and place), repeated and removable (arrays of [start, end) in words).

    Texts without repeats have no row. See repeated_windows for nulls and repeated rows.
    """
    told = repeated_windows(docs, length, window).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + length).alias("end"), "is_first")
    spans = lambda t: union_spans(t, ["doc_id"]).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    every, later = spans(told), spans(told.where("not is_first"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    counts = texts.mapInArrow(_word_counts(), "doc long, n_words long").groupBy(F.col("doc").alias("doc_id")).agg(F.max("n_words").alias("n_words"))
    out = every.withColumnRenamed("n", "n_repeated").withColumnRenamed("spans", "repeated").join(later.withColumnRenamed("n", "n_removable").withColumnRenamed("spans", "removable"), "doc_id", "left").join(counts, "doc_id")
    return out.select("doc_id", "n_words", "n_repeated", F.coalesce("n_removable", F.lit(0)).alias("n_removable"), "repeated", F.coalesce("removable", F.array().cast("array<struct<start:int,end:int>>")).alias("removable"))
