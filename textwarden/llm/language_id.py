"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of orders 0 to ORDER. After a context that has been seen n times, with u distinct
successors, a successor that was seen c times has the probability c / (n + u), and the escape to the context without its oldest
byte has u / (n + u) (method C, without exclusions); below the empty context all bytes are equally likely. After training the
statistics are frozen, and the trees unfold to sparse tables by n-gram: the exact code length of an n-gram's last byte after the
others, escapes included, and the cost of escaping from the n-gram as a context. A text's code length is a sum of entries; the
shortest code wins. Before its first byte, a text counts as having line ends.

Training takes whole documents of each language, those of smallest hash, up to `sample` of them and up to `sample_bytes` in
all. The bounds keep the model's cost independent of the corpus; every document is scored, in full. Languages are taken in groups,
whose tables are of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_broadcast, cut, fold_of, scoped
from .hashing import mix, raw_slices

ORDER = 4
#: Languages whose tables are looked up together.
GROUP = 8
#: Bytes of a text that are scored at once.
PIECE = 1 << 20
_BEFORE = np.full(ORDER, 10, dtype=np.uint8)


class Table:
    """From n-grams of one length, packed into integers, to rows of costs; open addressing, probed for all n-grams at once."""

    def __init__(self, grams: np.ndarray):
        self.bits = max(8, int(2 * len(grams)).bit_length())
        slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(grams), dtype=np.int32), self._first(grams)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]
            stay = slots[at] != left
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)
        self.slots, self.grams = slots, np.append(grams, np.int64(-1))

    def _first(self, grams: np.ndarray) -> np.ndarray:
        return (mix(grams.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """The rows of the n-grams, -1 where there is none."""
        at = self._first(grams)
        out = self.slots[at]
        open_ = np.flatnonzero((self.grams[out] != grams) & (out >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.slots[at[open_]]
            open_ = open_[(self.grams[out[open_]] != grams[open_]) & (out[open_] >= 0)]
        return out


def _packed(data: np.ndarray, size: int) -> np.ndarray:
    """The n-grams of the bytes, by their first byte."""
    out = np.zeros(len(data) - size + 1, dtype=np.int64)
    for k in range(size):
        out = (out << 8) | data[k : len(data) - size + 1 + k]
    return out


class Model:
    """Costs in bits: last[n][row, language] of an n-gram's last byte after the others, and leave[n][row, language] of the escape from the n-gram."""

    def __init__(self, by: dict[str, list[bytes]]):
        self.names = sorted(by, key=lambda x: x.encode())
        counts = [[Counted(_grams(by[x], n)) for x in self.names] for n in range(1, ORDER + 2)]
        self.last, self.leave, self.tables = [], [], []
        below = None
        for n in range(1, ORDER + 2):
            own = counts[n - 1]
            grams = np.arange(256) if n == 1 else np.unique(np.concatenate([c.grams for c in own]))
            seen = np.stack([c.of(grams) for c in own], 1)
            contexts = grams >> 8
            totals, kinds = np.stack([c.after(contexts)[0] for c in own], 1), np.stack([c.after(contexts)[1] for c in own], 1)
            lower = np.full((256, len(own)), 8.0) if n == 1 else below[self.tables[-1].rows(grams & ((1 << 8 * (n - 1)) - 1))]
            with np.errstate(divide="ignore", invalid="ignore"):
                known = np.log2((totals + kinds) / seen)
                escape = np.where(totals > 0, np.log2((totals + kinds) / kinds), 0.0)
            below = np.where(seen > 0, known, escape + lower)
            self.tables.append(Table(grams))
            self.last.append(below.astype(np.float32))
            if n <= ORDER:
                total, kind = (np.stack(x, 1) for x in zip(*(c.after(grams) for c in counts[n]), strict=True))
                with np.errstate(divide="ignore", invalid="ignore"):
                    self.leave.append(np.where(total > 0, np.log2((total + kind) / kind), 0.0).astype(np.float32))

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits by byte and language of the bytes from ORDER on."""
        out = np.zeros((len(data) - ORDER, len(self.names)), dtype=np.float32)
        left = np.arange(len(out))
        for n in range(ORDER + 1, 0, -1):
            grams = _packed(data[ORDER + 1 - n :], n)
            row = self.tables[n - 1].rows(grams[left])
            found = row >= 0
            out[left[found]] += self.last[n - 1][row[found]]
            left = left[~found]
            if not len(left):
                break
            context = self.tables[n - 2].rows(grams[left] >> 8)
            known = context >= 0
            out[left[known]] += self.leave[n - 2][context[known]]
        return out


class Counted:
    """How often n-grams occur, and what follows the contexts they begin with."""

    def __init__(self, grams: np.ndarray):
        self.grams, self.n = np.unique(grams, return_counts=True)
        self.contexts, first = np.unique(self.grams >> 8, return_index=True)
        self.totals = np.add.reduceat(self.n, first) if len(first) else np.zeros(0, np.int64)
        self.kinds = np.diff(np.append(first, len(self.grams)))

    def of(self, grams: np.ndarray) -> np.ndarray:
        return _looked_up(self.grams, self.n, grams)

    def after(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _looked_up(self.contexts, self.totals, contexts), _looked_up(self.contexts, self.kinds, contexts)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _grams(texts: list[bytes], n: int) -> np.ndarray:
    """The n-grams that end in each byte of the texts."""
    each = [_packed(np.concatenate((_BEFORE[: n - 1], np.frombuffer(t, dtype=np.uint8))), n) for t in texts if t]
    return np.concatenate(each) if each else np.zeros(0, dtype=np.int64)


def _pieces(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes with ORDER bytes of context before each part, places of the parts' own bytes, rows they belong to): short texts together, long ones by parts."""
    parts: list[np.ndarray] = []
    of: list[int] = []
    held = 0
    for k, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        for x in range(a, b, PIECE):
            before = _BEFORE if x == a else data[x - ORDER : x] if x - a >= ORDER else np.concatenate((_BEFORE, data[a:x]))[-ORDER:]
            parts += [before, data[x : min(b, x + PIECE)]]
            of.append(k)
            held += len(parts[-1])
            if held >= PIECE:
                yield _joined(parts, of)
                parts, of, held = [], [], 0
    if of:
        yield _joined(parts, of)


def _joined(parts: list[np.ndarray], of: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) for p in parts]).reshape(-1, 2)
    return np.concatenate(parts), ends, np.array(of)


def _score(model, told: list[str]):
    """Rows (*told, text, has_letter): told, the best language of the model's, its bits, and how many times its probability all of them have."""

    def run(batches):
        m: Model = model.value
        kinds = np.array(m.names, dtype=object)
        for batch in batches:
            bits = np.zeros((len(batch), len(m.names)))
            has = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool)
            for row0, data, rows in raw_slices(batch.column("text")):
                for joined, ends, of in _pieces(data, rows):
                    # costs of the bytes of context before a part are not a matter of the text: they lie between the parts
                    cost = np.concatenate((np.zeros((1, len(m.names))), np.cumsum(m.costs(joined), axis=0, dtype=np.float64)))
                    np.add.at(bits, row0 + of, cost[ends[:, 1] - ORDER] - cost[ends[:, 0] - ORDER])
            best = bits.argmin(1)
            least = bits.min(1)
            share = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            lang = np.where(has, kinds[best], "und")
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in told), pa.array(lang, pa.string()), pa.array(np.where(has, least, 0.0)), pa.array(share)], [*told, "lang_pred", "bits", "share"])

    return run


def chosen(docs: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """(lang, text) of the documents (key, text, lang) to learn from: keys are chosen by narrow rows, then their texts are read."""
    told = docs.where("lang is not null and text <> ''").select("lang", "key", F.xxhash64("key").alias("h"), F.xxhash64("text").alias("t"), F.octet_length("text").alias("size"))
    order = Window.partitionBy("lang").orderBy("h", "key", "t")
    few = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
    few = few.withColumn("bytes", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("bytes") <= sample_bytes) | (F.col("rank") == 1))
    few = checked_broadcast(cut(few.select("lang", "key", "t").distinct()))
    return docs.select("lang", "key", "text", F.xxhash64("text").alias("t")).join(few, ["lang", "key", "t"], "left_semi").select("lang", "text").distinct()


def _texts(table: DataFrame) -> dict[str, list[bytes]]:
    by: dict[str, list[bytes]] = {}
    rows = table.toArrow()
    for lang, text in sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
        by.setdefault(lang, []).append(text.encode())
    return by


@scoped
def identify(docs: DataFrame, folds: int = 5, held: int = 0, sample: int = 400, sample_bytes: int = 2_000_000) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out (crc32 of doc_id as text, modulo folds, is held), lang_pred, score.

    Only rows that are not held out and have a lang are learnt from: of each language up to sample different whole texts with up to sample_bytes in
    all, though one at least. score is the share of the predicted language if each is as likely as its code is short. Texts that are null or have no
    letter are `und` with score 0, as are all texts if nothing could be learnt. A null doc_id is held out, and equal codes go to the
    smaller name. Repeated rows get a row each. Other columns are ignored.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(True))
    samples = cut(chosen(docs.where(~held_out).select(F.col("doc_id").alias("key"), "text", "lang"), sample, sample_bytes))
    names = sorted((r["lang"] for r in samples.select("lang").distinct().collect()), key=lambda x: x.encode())
    kind = dict(docs.dtypes)["doc_id"]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    told = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), letters)
    if not names:
        return told.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    groups = [names[k : k + GROUP] for k in range(0, len(names), GROUP)]
    models = [spark.sparkContext.broadcast(Model(_texts(samples.where(F.col("lang").isin(g))))) for g in groups]
    shape = f"doc_id {kind}, held_out boolean, lang_pred string, bits double, share double"
    if len(groups) == 1:
        out = told.mapInArrow(_score(models[0], ["doc_id", "held_out"]), shape)
        return out.select("doc_id", "held_out", "lang_pred", F.when(F.col("lang_pred") == "und", 0.0).otherwise(1 / F.col("share")).alias("score"))
    told = cut(told.withColumn("row", F.monotonically_increasing_id()))
    each = [told.mapInArrow(_score(m, ["row", "doc_id", "held_out"]), "row long, " + shape) for m in models]
    every = each[0]
    for x in each[1:]:
        every = every.unionByName(x)
    best = F.min_by(F.struct("doc_id", "held_out", "lang_pred"), F.struct("bits", F.col("lang_pred"))).alias("b")
    parts = every.groupBy("row").agg(best, F.min("bits").alias("least"), F.collect_list(F.struct("bits", "share")).alias("parts"))
    share = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["share"] * F.pow(F.lit(2.0), F.greatest(F.col("least") - p["bits"], F.lit(-1000.0))))
    return parts.select("b.*", F.when(F.col("b.lang_pred") == "und", 0.0).otherwise(1 / share).alias("score"))
