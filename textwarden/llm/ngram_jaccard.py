"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct word n-grams. Two sets with Jaccard similarity of at least num / den differ in at
most D = (den - num)(a + b) / (den + num) elements, a and b being their sizes. Sets are sketched by XOR:

* the symbols: elements fall into K blocks by their hash, and a block's symbol is the XOR of its elements. An element in
  one set only changes one symbol, so the number of unequal symbols (a Hamming distance) is at most the symmetric
  difference. With K = D + 1 + E + C blocks, similar sets agree in more than E + C symbols (pigeonhole), so in more than C that are not
  empty unless both sets leave more than E blocks empty. Sets that do are sketched again under other seeds, and if all
  seeds fail, their empty symbols are keys too: no pair is lost.
* of its symbols, each set leaves out the C that most sets have. Similar sets agree in more than C, and the rarest of these is among
  the C most common of neither, so that it stays in both: passages which many documents share bring no sets together.
* parity bit sketches of 512 bits, and of at least two bits an element, whose Hamming distances are at most the symmetric difference
  as well; they discard pairs before any set is shipped, so that long texts with passages in common cost little.

D and K belong to size bands, so wide that a partner's size is in the same band or the one below; each set has keys in its
own band and the next. Equal sets are merged first. In a bucket of equal keys, each set is tried against the bucket's
smallest id only; exact verification and connected components follow. Then the second and the third smallest of each bucket
are tried against later members of other components, and at last all pairs across the components that a bucket still
holds, each pair only if sizes and bit sketches let it be similar. A group of copies thus never becomes all its pairs, and every
link between different sets is found or implied.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_broadcast, cut, scoped
from .components import connected_components
from .hashing import mix, word_slices

SKETCH_LONGS = 8
SEEDS = 3
#: Of D symbols, one in so many more is made, and left out where it is the most common.
COMMON = 4
#: Low bits of a key: the seed's number in two, the band's in the others.
SLOT_BITS = 14
#: Edges that one copy of a pivot's set serves.
EDGES_PER_SALT = 500
#: Members of a bucket that are tried against the later ones in turn, after the first, before all remaining pairs are.
PIVOTS = 3
NOTHING = np.zeros(0, dtype=np.uint64)


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; shorter texts with words have one element."""
    for words in word_slices(column):
        codes, ok = words.windows(n)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= n:
                own = codes[a:b][ok[a:b]]
                own.sort()
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                short = words.code[a:b] * np.arange(3, 3 + 2 * (b - a), 2, dtype=np.uint64)
                yield mix(short.sum(keepdims=True, dtype=np.uint64), 1000 + b - a)
            else:
                yield NOTHING


class Bands:
    """Size bands and their numbers of blocks for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]
        self.known: dict[int, tuple[int, int, int]] = {}

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, -(-self.den * self.starts[-1] // self.num)))
        return bisect_right(self.starts, size) - 1

    def blocks(self, band: int) -> tuple[int, int, int]:
        """(K, E, C) of a band: blocks, those that may be empty, and the common symbols that are left out."""
        if band not in self.known:
            self.known[band] = self._blocks(band)
        return self.known[band]

    def _blocks(self, band: int) -> tuple[int, int, int]:
        while len(self.starts) < band + 2:
            self.of(self.starts[-1])
        most = self.starts[band + 1] - 1
        apart = (self.den - self.num) * 2 * most // (self.den + self.num)
        if not apart:
            return 1, 0, 0
        # as many blocks may be empty as the smallest sets that have keys in the band are likely to leave
        least, common, empty = max(1, self.num * self.starts[band] // self.den), apart // COMMON, 1
        while empty <= apart // 2:
            k = apart + 1 + empty + common
            mean = k * math.exp(-least / k)
            needed = math.ceil(mean + 2 * math.sqrt(mean))
            if needed <= empty:
                break
            empty = needed
        return apart + 1 + empty + common, empty, common

    def commons(self, size: int = 1 << 31) -> list[int]:
        """C of each band, up to that of the size."""
        return [self.blocks(b)[2] for b in range(self.of(size) + 2)]

    def keys(self, own: np.ndarray) -> list[np.ndarray]:
        """The join keys of a set: a hash of a symbol above the number of its band and seed."""
        band, out = self.of(len(own)), []
        for b in (band, band + 1):
            if b > band and self.den * len(own) < self.num * self.starts[b]:
                continue
            k, empty, _ = self.blocks(b)
            for seed in range(SEEDS):
                placed = own if not seed else np.sort(mix(own, 50 + seed))
                block = ((placed >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
                at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                symbol = np.bitwise_xor.reduceat(mix(placed, 7), at)
                out.append(_slotted(mix(symbol ^ mix(block[at] + np.uint64(b << 40), 11 + seed)), b, seed))
                if k - len(at) <= empty:
                    break
            else:
                rest = np.setdiff1d(np.arange(k, dtype=np.uint64), block[at])
                out.append(_slotted(mix(rest + np.uint64(b << 40), 99), b, SEEDS))
        return out


def _slotted(hashes: np.ndarray, band: int, seed: int) -> np.ndarray:
    return (hashes << np.uint64(SLOT_BITS)) | np.uint64((band << 2 | seed) & (1 << SLOT_BITS) - 1)


def _wide(own: np.ndarray) -> np.ndarray:
    """The parity sketch of a set with at least two bits an element, a power of two of them, packed."""
    bits = max(512, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 512
    return np.packbits((np.bincount((mix(own, 6) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def _near(num: int, den: int):
    """Of rows (src, dst, m, n, a, b) the pairs whose wide sketches a and b, the longer one folded by XOR, are not too far apart."""

    def run(batches):
        for batch in batches:
            keep = []
            for m, n, a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = sorted((np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (a, b)), key=len)
                apart = int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())
                keep.append(apart * (den + num) <= (m + n) * (den - num))
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["src", "dst"])

    return run


def _stats(n: int):
    def run(batches):
        for batch in batches:
            size, a, b, sketch, wide = [], [], [], [], []
            for own in sets_of(batch.column(1), n):
                size.append(len(own))
                a.append(mix(own, 3).sum(dtype=np.uint64))
                b.append(mix(own, 4).sum(dtype=np.uint64))
                bits = np.bincount((mix(own, 5) & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
                sketch.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                wide.append(_wide(own).tobytes())
            longs = np.array(sketch, dtype=np.int64).reshape(-1, SKETCH_LONGS)
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(longs[:, k])) for k in range(SKETCH_LONGS)] + [pa.array(wide, pa.binary())], [*STATS_NAMES, "wide"])

    return run


STATS_NAMES = ["id", "n_shingles", "digest_a", "digest_b", *(f"s{k}" for k in range(SKETCH_LONGS))]
MEASURES = ["n_shingles", *STATS_NAMES[4:]]


def _keys(n: int, num: int, den: int):
    def run(batches):
        bands = Bands(num, den)
        for batch in batches:
            ids, rows, keys, counts = batch.column(0).to_numpy(zero_copy_only=False), [], [], []
            for row, own in enumerate(sets_of(batch.column(1), n)):
                if len(own):
                    got = bands.keys(own)
                    keys += got
                    rows.append(row)
                    counts.append(sum(map(len, got)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids[rows], counts))], ["key", "id"])

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets_of(batch.column(1), n)], pa.binary())], ["id", "elements"])

    return run


def _verify(num: int, den: int):
    """Rows (pivot, salt, id, elements), each pivot's own row (id null) before the others: the pairs that are similar."""

    def run(batches):
        at, own = None, []
        for batch in batches:
            pivots, ids, sets = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            a, b = [], []
            for k, (pivot, other) in enumerate(zip(pivots, ids, strict=True)):
                x = np.frombuffer(sets[k].as_buffer(), dtype=np.uint64)
                if other is None:
                    own = [*own, x.copy()] if at == pivot else [x.copy()]
                    at = pivot
                elif at == pivot:
                    for y in own:
                        both = np.concatenate((x, y))
                        both.sort()
                        shared = int((both[1:] == both[:-1]).sum())
                        if den * shared >= num * (len(x) + len(y) - shared):
                            a.append(pivot)
                            b.append(other)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

    return run


def _may_be_similar(a, b, num: int, den: int):
    """Whether sizes and bit sketches, by name in a and b, leave the pair a chance."""
    apart = reduce(lambda x, y: x + y, (F.bit_count(a(f"s{k}").bitwiseXOR(b(f"s{k}"))) for k in range(SKETCH_LONGS)))
    m, n = a("n_shingles"), b("n_shingles")
    return (F.least(m, n) * den >= F.greatest(m, n) * num) & (apart * (den + num) <= (m + n) * (den - num))


@scoped
def _similar(pairs: DataFrame, texts: DataFrame, stats: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (src, dst) that are similar: first by sizes and bit sketches, then by their sets."""
    side = lambda p: stats.select(F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in MEASURES))
    near = _may_be_similar(lambda c: F.col(f"src_{c}"), lambda c: F.col(f"dst_{c}"), num, den)
    pairs = cut(pairs.join(side("src"), "src").join(side("dst"), "dst").where(near).select("src", "dst"))
    wide = lambda p, size, sketch: stats.select(F.col("id").alias(p), F.col("n_shingles").alias(size), F.col("wide").alias(sketch))
    pairs = pairs.join(wide("src", "m", "a"), "src").join(wide("dst", "n", "b"), "dst").select("src", "dst", "m", "n", "a", "b")
    pairs = cut(pairs.mapInArrow(_near(num, den), "src long, dst long"))
    salts = pairs.groupBy("src").agg(F.count("*").alias("n")).select("src", F.ceil(F.col("n") / EDGES_PER_SALT).cast("int").alias("salts"))
    needed = cut(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct())
    sets = cut(texts.join(checked_broadcast(needed), "id", "left_semi").mapInArrow(_sets(n), "id long, elements binary"))
    salt = lambda x, many: F.pmod(F.xxhash64(x), many).cast("int")
    others = pairs.join(salts, "src").join(sets.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("pivot"), salt(F.col("dst"), F.col("salts")).alias("salt"), F.col("dst").alias("id"), "elements")
    pivots = salts.join(sets.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("id"), "elements")
    together = others.unionByName(pivots).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("id").asc_nulls_first())
    return together.mapInArrow(_verify(num, den), "src long, dst long")


def _buckets(keys: DataFrame, commons: list[int]) -> DataFrame:
    """(key, id, pivot, rank) of the keys (key, id) that several rows have, without the most common ones of each set: pivot is a bucket's smallest id."""
    bucket = Window.partitionBy("key")
    shared = keys.select("key", "id", F.count(F.lit(1)).over(bucket).alias("n")).where("n > 1")
    slot = F.col("key").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    place = F.row_number().over(Window.partitionBy("id", "slot").orderBy(F.col("n").desc(), "key"))
    rare = cut(shared.withColumn("slot", slot)).withColumn("place", place).where(F.col("place") > F.element_at(F.array(*map(F.lit, commons)), (F.shiftright("slot", 2) + 1).cast("int")))
    ranked = rare.select("key", "id", F.count(F.lit(1)).over(bucket).alias("n"), F.min("id").over(bucket).alias("pivot"), (F.row_number().over(bucket.orderBy("id")) - 1).alias("rank"))
    return ranked.where("n > 1").select("key", "id", "pivot", "rank")


def _still_open(members: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """(key, id, rank, component) of the members from rank turn on, of the buckets in which these are of several components."""
    inside = members.where(F.col("rank") >= turn).join(found, "id", "left").select("key", "id", "rank", F.coalesce("component", "id").alias("component"))
    open_keys = inside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return inside.join(open_keys, "key", "left_semi")


@scoped
def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_shingles (long, the size of its set), class_id (smallest id with an equal set),
    component_id (smallest id that links reach, itself included).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; a text of fewer than n words is one
    element; one without words, or null, is empty and linked with nothing. Rows of equal id count as one document: what
    links to one of them links to all. A row whose id is null is its own class, with null component. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stats = cut(texts.mapInArrow(_stats(n), "id long, n_shingles long, digest_a long, digest_b long, " + ", ".join(f"s{k} long" for k in range(SKETCH_LONGS)) + ", wide binary"))
    content = ["n_shingles", "digest_a", "digest_b"]
    classes = stats.where("n_shingles > 0").groupBy(content).agg(F.min("id").alias("class_id"))
    told = cut(stats.join(classes, content, "left").select("id", "n_shingles", F.coalesce("class_id", "id").alias("class_id")))
    by_id = told.groupBy("id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
    copies = cut(by_id.where("high < id").select("id"))
    first = stats.where("id is not null and n_shingles > 0").dropDuplicates(["id", *content])
    unequal = texts.where("id is not null").join(checked_broadcast(copies), "id", "left_anti")
    members = cut(_buckets(unequal.mapInArrow(_keys(n, num, den), "key long, id long"), Bands(num, den).commons()))
    stars = members.where("rank > 0 and pivot <> id").select(F.col("pivot").alias("src"), F.col("id").alias("dst")).distinct()
    # a doc_id with several texts ties their classes together
    ties = told.join(by_id.where("low < high").select("id"), "id", "left_semi").where("id <> class_id").select(F.col("id").alias("src"), F.col("class_id").alias("dst"))
    links = _similar(stars, texts, first, n, num, den).unionByName(ties)
    found = connected_components(links)
    for turn in range(1, PIVOTS + 1):
        rest = cut(_still_open(members, found, turn).join(first.select("id", *MEASURES), "id"))
        if not rest.limit(1).count():
            break
        a, b = rest.alias("a"), rest.alias("b")
        by = F.expr("a.key = b.key and a.rank < b.rank and a.component <> b.component") & _may_be_similar(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), num, den)
        across = (a.where(f"a.rank = {turn}") if turn < PIVOTS else a).join(b, by).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()
        links = links.unionByName(_similar(across, texts, first, n, num, den))
        found = connected_components(links)
    return told.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select(F.col("id").alias(id_col), "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs (doc_id, text, ...) of which none of smaller doc_id is in the same component; rows without words,
    or with a null doc_id, stay. Repeated rows of one doc_id stay together."""
    apart = jaccard_components(docs, n, num, den)
    gone = cut(apart.where("component_id < doc_id").select("doc_id").distinct())
    return docs.join(checked_broadcast(gone), "doc_id", "left_anti")
