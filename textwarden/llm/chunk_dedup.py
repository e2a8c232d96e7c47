"""Substring dedup with content-defined chunks.

A gear hash rolls over the bytes: h = 2 h + G[byte] modulo 2**32, whose lower half depends on the last 16 bytes alone. A chunk ends where
that half is the largest within `reach` bytes on both sides, never inside a UTF-8 character. Boundaries thus depend on
nearby bytes only: an insertion shifts the chunks behind it without changing them. Chunks are grouped by a 128-bit digest;
repeated chunks that touch unite to spans. Spans of some words or bytes count, and copies of whole texts. The chunks are small and the
words few, so that what a shared run of 50 words loses at its ends leaves a span that counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, scoped
from .hashing import _BASE, _BYTE_VALUES, _INVERSE, SPACES, _power, mix, raw_slices
from .spans import repeats, union_spans

GEAR = (_BYTE_VALUES >> np.uint64(13)).astype(np.uint32)
WINDOW = 32
#: How many of the last bytes the lower half of the hash depends on.
SEEN = 16
#: Bytes from which a span of fewer words counts, as texts without spaces have.
FEW_WORDS_LEAST = 160


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash after each byte, by doubling: two halves of a window make the whole."""
    h, done = GEAR[data], 1
    while done < WINDOW:
        longer = h.copy()
        longer[done:] += h[:-done] << np.uint32(done)
        h, done = longer, 2 * done
    return h


def _sliding_max(x: np.ndarray, reach: int) -> np.ndarray:
    """The largest of each value and its `reach` neighbours on both sides."""
    size, n = 2 * reach + 1, len(x)
    out = np.concatenate((np.zeros(reach, x.dtype), x, np.zeros(reach, x.dtype)))
    done = 1
    while done < size:
        step = min(done, size - done)
        out = np.maximum(out[:-step], out[step:])
        done += step
    return out[:n]


def boundaries(data: np.ndarray, rows: np.ndarray, reach: int) -> np.ndarray:
    """Sorted offsets at which chunks begin or end; each row's start and the end of the data are among them."""
    if not len(data):
        return np.unique(rows)
    h = gear_hashes(data) << np.uint32(WINDOW - SEEN)
    follows = np.zeros(len(data), dtype=bool)
    follows[:-1] = (data[1:] & 0xC0) == 0x80
    h[follows] = 0
    # hashes that reach over a row's start are not a matter of its text
    starts = rows[:-1]
    near = (starts[:, None] + np.arange(SEEN - 1)[None, :]).ravel()
    near = near[near < len(data)]
    h[near] = 0
    top = (h == _sliding_max(h, reach)) & (h > 0)
    return np.union1d(np.flatnonzero(top) + 1, rows)


def _chunks(reach: int):
    def run(batches):
        for batch in batches:
            ids, apart = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row0, data, rows in raw_slices(batch.column(2)):
                if not len(data):
                    continue
                at = boundaries(data, rows, reach)
                begin, end = at[:-1], at[1:]
                size = (end - begin).astype(np.uint64)
                back = _power(_INVERSE, len(data))[begin]
                digests = []
                for seed in (1, 2):
                    values = _BYTE_VALUES if seed == 1 else mix(_BYTE_VALUES, 41)
                    digests.append(mix(np.add.reduceat(values[data] * _power(_BASE, len(data)), begin) * back + size, seed))
                words = np.add.reduceat(SPACES[data].astype(np.int64), begin)
                row = np.searchsorted(rows, begin, "right") - 1
                yield pa.RecordBatch.from_arrays([*(pa.array(d.view(np.int64)) for d in digests), pa.array(ids[row0 + row]), pa.array(apart[row0 + row]), pa.array((begin - rows[row]).astype(np.int64)), pa.array((end - rows[row]).astype(np.int64)), pa.array(words)], ["key", "check", "doc", "text_hash", "start", "end", "words"])

    return run


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with text_hash (long): 0, or for a doc_id with several texts a hash that tells them apart, so that spans belong to a text. Rows that
    are equal in doc_id and text are one document."""
    own = F.xxhash64("text")
    several = cut(docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("several")).agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low < high").select("several"))
    told = docs.join(checked_broadcast(several), docs["doc_id"] == F.col("several"), "left")
    return told.select(*(docs[c] for c in docs.columns), F.when(F.col("several").isNotNull(), F.xxhash64(docs["text"])).otherwise(F.lit(0)).alias("text_hash"))


def repeated_chunks(docs: DataFrame, reach: int = 10) -> DataFrame:
    """(doc, text_hash, start, end, words, is_first): the chunks of docs (doc_id, text_hash, text), in bytes, that occur more than once; words counts
    their spaces, and is_first marks the first by doc_id, text and place. Null texts have no chunks and rows with a null doc_id take no part."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text_hash", "text")
    pieces = texts.mapInArrow(_chunks(reach), "key long, check long, doc long, text_hash long, start long, end long, words long")
    return repeats(pieces, ["key", "check"], ["doc", "text_hash", "start"]).select("doc", "text_hash", "start", "end", "words", "is_first")


@scoped
def repeated_spans(docs: DataFrame, reach: int = 10, least: int | None = None, words: int = 12) -> DataFrame:
    """One row per doc_id and text with a repeated span: doc_id, text_hash (see told_apart), n_repeated and n_removable (bytes), repeated and removable
    (arrays of [start, end) byte offsets in the UTF-8 text). Removable spans consist of chunks that occur earlier.

    A span counts if it has at least `words` spaces or FEW_WORDS_LEAST bytes, or is a whole text, however short, that is another document's too. If `least` is given, all spans of
    at least so many bytes count instead, and no others. Null texts and null doc_ids have no spans; other columns are ignored."""
    texts = told_apart(docs.select("doc_id", "text"))
    of = ["doc_id", "text_hash"]
    found = cut(repeated_chunks(texts, reach).withColumnRenamed("doc", "doc_id"))
    short = texts.where("doc_id is not null and octet_length(text) > 0").where(F.octet_length("text") < FEW_WORDS_LEAST)
    short = short.select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"), F.md5("text").alias("digest"))
    copies = cut(repeats(short, ["digest"], of).drop("digest")) if least is None else None

    def counting(which: str) -> DataFrame:
        if least is not None:
            return union_spans(found.where(which), of, least)
        united = union_spans(found.where(which), of, total="words")
        enough = united.where((F.col("words") >= words) | (F.col("end") - F.col("start") >= FEW_WORDS_LEAST))
        return union_spans(enough.drop("words").unionByName(copies.where(which).drop("is_first")), of)

    spans = lambda which: counting(which).groupBy(*of).agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    every = spans("true").withColumnRenamed("n", "n_repeated").withColumnRenamed("spans", "repeated")
    later = spans("not is_first").withColumnRenamed("n", "n_removable").withColumnRenamed("spans", "removable")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return every.join(later, of, "left").select(*of, "n_repeated", F.coalesce("n_removable", F.lit(0)).alias("n_removable"), "repeated", F.coalesce("removable", none).alias("removable"))


def _cut_out():
    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, parts, at = (text or "").encode(), [], 0
                for s in spans:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                texts.append(b"".join([*parts, raw[at:]]).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def dedup_substrings(docs: DataFrame, reach: int = 10, least: int | None = None, words: int = 12) -> DataFrame:
    """(doc_id, text) of the rows that have removable spans, with these cut out; each text loses its own spans only. Other rows stay as they are and have no row here."""
    spans = repeated_spans(docs, reach, least, words).where("n_removable > 0").select("doc_id", "text_hash", "removable")
    return told_apart(docs.select("doc_id", "text")).join(spans, ["doc_id", "text_hash"]).select("doc_id", "text", "removable").mapInArrow(_cut_out(), "doc_id long, text string")
