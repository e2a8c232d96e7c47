"""Exact nearest neighbours of sparse vectors: the k best by products of blocks, all above a limit by score bounds over an inverted index.

For a limit, items are split into classes of like size, since a term weighs the more the fewer others an item has. The index has the postings, and for each
list (the postings of one term in one class) its length and largest weight. Lists whose bounds together stay well below the limit are not needed to find an
item that gets there, so that they are never joined: for each class the longest lists with the smallest bounds. Items found in the others keep their partial
score, and those that cannot get there even with the bound of all lists left out fall away. Only for the rest are those lists looked up, by item and term.

Nothing is approximate: bounds are sums of products of largest weights, or, by Cauchy-Schwarz, the length of the query's part, whichever is
less. Vectors must have weights of 0 or more and unit length at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import kept, scoped

#: Classes of item sizes for each doubling of the number of terms.
CLASSES = 4
#: Postings, of its shortest lists, that a query scores first.
SEED = 48
#: The share of the score to reach that the bounds of lists left out may add up to.
SKIP = 0.75
#: Postings of queries that a task holds at once, postings of items that it meets them with at a time, and those that are stored as one row.
QUERY_BLOCK, ITEM_BLOCK, STORED = 2_000_000, 8_000_000, 1_000_000
#: Scores that a task holds at once, and products of postings that it adds to them at a time.
SCORES, PRODUCTS = 2_000_000, 1_000_000
#: Terms that are multiplied as whole rows at most, the weights that these have at most, and how many times the postings' products such a row may take.
OFTEN, TABLE, OFTEN_FROM = 512, 8_000_000, 100
#: Scores are compared in billionths; bounds leave room for that.
ROOM = 3e-9
#: Billionths added before they are cut, so that sums that only the order of adding tells apart are equal where they are round, as of equal texts.
EVEN = 1e-4

LIST = ["side", "size", "term"]


def postings_of(items: DataFrame) -> DataFrame:
    """(side, size, id, term, w) of sparse vectors (id, term, w), or (id, side, term, w): size is the item's class."""
    side = F.col("side") if "side" in items.columns else F.lit("")
    many = F.count("*").over(Window.partitionBy("id"))
    return items.select(side.alias("side"), F.floor(F.log2(many) * CLASSES).cast("int").alias("size"), "id", "term", "w")


def lists_of(postings: DataFrame) -> DataFrame:
    """(side, size, term, most, n): each list's largest weight and length."""
    return postings.groupBy(*LIST).agg(F.max("w").alias("most"), F.count("*").alias("n"))


def scores(pairs: DataFrame, terms: DataFrame, postings: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (query_id, side, id) with sim: the products of the query's terms (..., term, q), joined by keys, with the item's weights. Pairs that share none are left out."""
    return pairs.join(terms, keys).join(postings.select("id", "term", "w"), ["id", "term"]).groupBy("query_id", "side", "id").agg(F.sum(F.col("q") * F.col("w")).alias("sim"))


def ranked(sims: DataFrame, k: int) -> DataFrame:
    """sims (query_id, side, id, sim) with rank: the k highest of each query and side, ties in billionths to the smaller id."""
    order = Window.partitionBy("query_id", "side").orderBy(F.floor(F.col("sim") * 1e9 + EVEN).desc(), "id")
    return sims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reached(found: DataFrame, queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query_id, side, reach): the score that k of the items found (query_id, side, id) have; no row where there are fewer."""
    best = ranked(scores(found, queries, postings, ["query_id"]), k)
    return best.groupBy("query_id", "side").agg(F.count("*").alias("n"), F.min("sim").alias("reach")).where(F.col("n") == k).drop("n")


def first_items(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, side, id): the items of each query's shortest lists."""
    shortest = Window.partitionBy("query_id", "side").orderBy("n", "size", "term").rowsBetween(Window.unboundedPreceding, -1)
    first = asked.withColumn("before", F.coalesce(F.sum("n").over(shortest), F.lit(0))).where((F.col("before") + F.col("n") <= SEED) | (F.col("before") == 0))
    return first.join(postings.select(*LIST, "id"), LIST).select("query_id", "side", "id").distinct()


def needed(asked: DataFrame, reach: Column) -> DataFrame:
    """asked (query_id, side, size, term, q, most, n) with `left_out`, and `rest`: what all lists left out of a query and class may add at most.

    Lists that bring little for their length are left out first. Classes none of whose items can get to `reach` have no rows.
    """
    own = Window.partitionBy("query_id", "side", "size")
    told = asked.withColumn("reach", reach).withColumn("bound", F.col("q") * F.col("most"))
    so_far = own.orderBy(F.col("bound") / F.col("n"), "term").rowsBetween(Window.unboundedPreceding, 0)
    at_most = lambda w: F.least(F.sum("bound").over(w), F.sqrt(F.sum(F.col("q") * F.col("q")).over(w)))
    told = told.withColumns({"summed": at_most(so_far), "all": at_most(own)}).where(F.col("all") >= F.col("reach") - ROOM)
    told = told.withColumn("left_out", F.col("summed") < F.col("reach") * SKIP)
    return told.withColumn("rest", F.coalesce(F.max(F.when(F.col("left_out"), F.col("summed"))).over(own), F.lit(0.0))).drop("summed", "all", "bound")


def candidates(lists: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, side, size, id, sim): the items of needed lists that may get to the score to reach, with what these lists give."""
    met = lists.where("not left_out").join(postings, LIST).groupBy("query_id", "side", "size", "id")
    summed = met.agg(F.sum(F.col("q") * F.col("w")).alias("sim"), F.first("rest").alias("rest"), F.first("reach").alias("reach"))
    return summed.where(F.col("sim") + F.col("rest") >= F.col("reach") - ROOM).drop("reach")


def completed(found: DataFrame, lists: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, side, id, sim) of candidates, with what the lists left out give to them."""
    more = scores(found.drop("sim"), lists.where("left_out").select("query_id", "side", "size", "term", "q"), postings, ["query_id", "side", "size"])
    return found.join(more.withColumnRenamed("sim", "more"), ["query_id", "side", "id"], "left").select("query_id", "side", "id", (F.col("sim") + F.coalesce("more", F.lit(0.0))).alias("sim"))


def asked_of(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """(query_id, side, size, term, q, most, n): each query's terms with every list that there is of them."""
    return queries.join(lists, "term")


def terms_of(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").alias("query_id"), "term", F.col("w").alias("q"))


def packed(vectors: DataFrame, dealt: bool = False) -> DataFrame:
    """(id, side, terms, ws): sparse vectors (id, term, w), or (id, side, term, w), a row each; packed ones as they are. dealt: all rows of an id are in one partition already."""
    side = F.col("side") if "side" in vectors.columns else F.lit("")
    if "terms" in vectors.columns:
        return vectors.select("id", side.alias("side"), "terms", "ws")
    rows = vectors.select("id", side.alias("side"), F.struct("term", "w").alias("x"))
    rows = rows if dealt else rows.repartition(F.col("id"))
    return rows.groupBy("id", "side").agg(F.collect_list("x").alias("x")).select("id", "side", F.col("x.term").alias("terms"), F.col("x.w").alias("ws"))


class _Asked:
    """A block of queries, by the places of their terms among all terms of the block, with what each query and side has reached."""

    def __init__(self, rows: pa.Table, k: int):
        lists = rows["terms"].combine_chunks()
        self.ids, self.ends = rows["id"].to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        self.terms, places = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        self.places, self.ws = places.astype("int32"), rows["ws"].combine_chunks().flatten().to_numpy()
        self.k, self.reach, self.best = k, {}, {}

    def met(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """(query_id, side, id, sim): of the items, those that may be among the k best of a query and side."""
        rows = rows.sort_by([("side", "ascending"), ("id", "ascending")])
        lists = rows["terms"].combine_chunks()
        ids, sides = rows["id"].to_numpy(), np.array(rows["side"].to_pylist(), dtype=object)
        names, starts = np.unique(sides.astype(str), return_index=True)
        spans = list(zip(names, starts, [*starts[1:], len(ids)], strict=True))
        found = {name: ([], [], []) for name in names}
        postings = self._postings(lists.flatten().to_numpy(), np.repeat(np.arange(len(ids), dtype="int32"), pc.list_value_length(lists).to_numpy()), rows["ws"].combine_chunks().flatten().to_numpy())
        few = max(1, SCORES // len(ids))
        often = self._often(np.diff(postings[2]), len(ids))
        table = self._table(often, postings, len(ids))
        for q in range(0, len(self.ids), few):
            to = min(q + few, len(self.ids))
            for k, sims in enumerate(self._scored(q, to, often, table, postings, len(ids)), q):
                for name, x, y in spans:
                    self._best(k, name, sims[x:y], x, found[name])
        for name, (queries, places, sims) in found.items():
            if queries:
                at_item = np.concatenate(places)
                n = [len(x) for x in places]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(self.ids[queries], n)), "side": pa.array([str(name)] * len(at_item)), "id": pa.array(ids[at_item]), "sim": pa.array(np.concatenate(sims))})

    def _postings(self, terms: np.ndarray, at: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, ws, ends) of the items' postings, in order of the block's terms; other terms are left out."""
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        own = np.flatnonzero(self.terms[place] == terms)
        own = own[np.argsort(place[own], kind="stable")]
        return at[own], ws[own], np.searchsorted(place[own], np.arange(len(self.terms) + 1))

    def _often(self, n: np.ndarray, items: int) -> np.ndarray:
        """The place in a table of whole rows of each of the block's terms, -1 for the others: the terms that take the most products of postings."""
        often = np.full(len(n), -1, dtype="int32")
        work = n * np.bincount(self.places, minlength=len(n))
        most = min(len(n), OFTEN, max(1, TABLE // items))
        top = np.argpartition(work, -most)[-most:]
        top = top[work[top] * OFTEN_FROM >= items * len(self.ids)]
        often[top] = np.arange(len(top))
        return often

    def _table(self, often: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], items: int) -> np.ndarray:
        at, ws, ends = postings
        out = np.zeros((int(often.max()) + 1, items))
        for term in np.flatnonzero(often >= 0):
            own = slice(ends[term], ends[term + 1])
            out[often[term], at[own]] = ws[own]
        return out

    def _scored(self, q: int, to: int, often: np.ndarray, table: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], items: int) -> np.ndarray:
        """The products of queries q to `to` with all items: of frequent terms by a matrix product, of others posting by posting."""
        at, ws, ends = postings
        own = slice(self.ends[q], self.ends[to])
        places, weights = self.places[own], self.ws[own]
        query = np.repeat(np.arange(to - q), np.diff(self.ends[q : to + 1]))
        whole = often[places] >= 0
        dense = np.zeros((to - q, len(table)))
        dense[query[whole], often[places[whole]]] = weights[whole]
        sims = dense @ table
        flat = sims.reshape(-1)
        n = np.where(whole, 0, ends[places + 1] - ends[places])
        rest = np.flatnonzero(n)
        sums = np.cumsum(n[rest])
        a = 0
        while a < len(rest):
            b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + PRODUCTS, "right")))
            some = rest[a:b]
            many = n[some]
            item = np.arange(many.sum()) + np.repeat(ends[places[some]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            np.add.at(flat, np.repeat(query[some] * items, many) + at[item], np.repeat(weights[some], many) * ws[item])
            a = b
        return sims

    def _best(self, q: int, side: str, sims: np.ndarray, offset: int, found: tuple[list, list, list]) -> None:
        """Adds a query's best items of a side to those found, unless k others are known to be better. Items are in order of ids, and ties go to the first."""
        reach = self.reach.get((q, side), 0)
        last = sims.max() if self.k == 1 else np.partition(sims, -self.k)[-self.k] if len(sims) > self.k else 0.0
        hit = np.flatnonzero(sims > max((reach - 1) / 1e9, last - ROOM, 0.0))
        told = np.floor(sims[hit] * 1e9 + EVEN).astype("int64")
        hit, told = hit[told >= reach], told[told >= reach]
        if len(hit) > self.k:
            order = told * len(sims) - hit
            top = np.argpartition(order, -self.k)[-self.k :]
            hit, told = hit[top], told[top]
        if len(hit):
            best = np.concatenate([self.best.get((q, side), told[:0]), told])
            if len(best) >= self.k:
                best = np.partition(best, -self.k)[-self.k :]
                self.reach[q, side] = int(best.min())
            self.best[q, side] = best
            found[0].append(q)
            found[1].append(hit + offset)
            found[2].append(sims[hit])


def _blocks(postings: int | None):
    """(ids, sides, ns, terms, ws) of packed vectors: a row for about that many postings, or for all of a task's without a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        for batch in batches if postings else [pa.Table.from_batches(some).combine_chunks().to_batches()[0] for some in [list(batches)] if some]:
            n = pc.list_value_length(batch.column("terms")).to_numpy()
            ends = np.concatenate([[0], np.cumsum(n)])
            cuts = [0]
            while cuts[-1] < len(n):
                cuts.append(len(n) if postings is None else max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + postings, "right")) - 1))
            bounds = pa.array(cuts, pa.int32())
            of_texts = lambda x: pa.ListArray.from_arrays(bounds, x)  # noqa: B023, E731
            out = {"ids": of_texts(batch.column("id")), "sides": of_texts(batch.column("side")), "ns": of_texts(pa.array(n.astype("int32")))}
            out |= {c: pa.ListArray.from_arrays(pa.array(ends[cuts].astype("int32")), batch.column(c).flatten()) for c in ("terms", "ws")}
            blocks = pa.RecordBatch.from_pydict(out)
            yield from (blocks.slice(at, 1) for at in range(blocks.num_rows))

    return run


BLOCK = "ids array<long>, sides array<string>, ns array<int>, terms array<long>, ws array<double>"


def _unpacked(block: pa.RecordBatch, prefix: str) -> pa.Table:
    """The packed vectors (id, side, terms, ws) of a block's row."""
    flat = lambda name: block.column(prefix + name).flatten()
    bounds = pa.array(np.concatenate([[0], np.cumsum(flat("ns").to_numpy())]).astype("int32"))
    return pa.table({"id": flat("ids"), "side": flat("sides"), "terms": pa.ListArray.from_arrays(bounds, flat("terms")), "ws": pa.ListArray.from_arrays(bounds, flat("ws"))})


class _Best:
    """A block of queries with the best of the items that it has met."""

    def __init__(self, queries: pa.Table, k: int):
        self.asked, self.k, self.waiting, self.n, self.found, self.rows = _Asked(queries, k), k, [], 0, [], 0

    def add(self, items: pa.Table) -> None:
        self.waiting.append(items)
        self.n += pc.sum(pc.list_value_length(items["terms"])).as_py() or 0
        if self.n >= ITEM_BLOCK:
            self.meet()

    def meet(self) -> None:
        if self.waiting:
            told = list(self.asked.met(pa.concat_tables(self.waiting).combine_chunks()))
            self.waiting, self.n = [], 0
            self.found += told
            self.rows += sum(b.num_rows for b in told)
            if self.rows > 2 * self.k * len(self.asked.ids):
                self.cut()

    def cut(self) -> None:
        """Leaves the k best of each query and side, ties in billionths to the smaller id."""
        rows = pa.Table.from_batches(self.found).combine_chunks()
        query, side, ids = rows["query_id"].to_numpy(), rows["side"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["id"].to_numpy()
        order = np.lexsort((ids, -np.floor(rows["sim"].to_numpy() * 1e9 + EVEN), side, query))
        query, side = query[order], side[order]
        starts = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (side[1:] != side[:-1])))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        self.found = rows.take(pa.array(order[place < self.k])).combine_chunks().to_batches()
        self.rows = sum(b.num_rows for b in self.found)

    def told(self) -> Iterator[pa.RecordBatch]:
        self.meet()
        if self.found:
            self.cut()
            yield from self.found


def _multiplied(k: int):
    """Over rows of a block of items and, as q_ids and so on, one of queries: the best items of the queries, over all blocks of items that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                name = row.column("block")[0].as_py()
                if name not in blocks:
                    blocks[name] = _Best(_unpacked(row, "q_"), k)
                blocks[name].add(_unpacked(row, ""))
        for block in blocks.values():
            yield from block.told()

    return run


@scoped
def top_items(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, sim, rank, side): the k items of each side that are most similar to each query, of those that share a term with it.

    queries (id, term, w) and items (id, term, w), or (id, side, term, w), are sparse vectors, or packed ones; ids are whole numbers, terms too, and without a side it is
    empty. Ties in billionths go to the smaller id. Queries without a term in common with any item have no row.

    Queries and items meet as blocks: a task has one block of queries and a share of the items, which stream by from where they are written, once. A pair of them is a sum
    in memory, never a row: what is shuffled are the queries, once, and k items for each query, side and share at most.
    """
    spark = items.sparkSession
    asked, there = kept(packed(queries)), kept(packed(items).mapInArrow(_blocks(STORED), BLOCK))
    size = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"]
    blocks, shares = max(1, -(-(size or 0) // QUERY_BLOCK)), spark.sparkContext.defaultParallelism
    own = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block").mapInArrow(_blocks(None), BLOCK)
    own = own.select(F.monotonically_increasing_id().alias("block"), *(F.col(c).alias(f"q_{c}") for c in own.columns))
    found = there.coalesce(shares).crossJoin(own).mapInArrow(_multiplied(k), "query_id long, side string, id long, sim double")
    return ranked(found, k).select("query_id", F.col("id").alias("item_id"), "sim", "rank", "side")


def _planned(queries: DataFrame, items: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The postings, the lists that each query needs or leaves out, and the queries' terms."""
    postings, asking = kept(postings_of(items)), kept(terms_of(queries))
    asked = kept(asked_of(asking, lists_of(postings)))
    reach = kept(reached(first_items(asked, postings), asking, postings, k))
    return postings, kept(needed(asked.join(reach, ["query_id", "side"], "left"), F.coalesce("reach", F.lit(0.0)))), asking


@scoped
def within(queries: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(query_id, item_id, sim): all items whose similarity to a query is `least` or more, in billionths. `least` is above 0."""
    postings, asking = kept(postings_of(items)), kept(terms_of(queries))
    lists = kept(needed(asked_of(asking, lists_of(postings)), F.lit(float(least))))
    sims = completed(kept(candidates(lists, postings)), lists, postings)
    return sims.where(F.floor(F.col("sim") * 1e9) >= round(least * 1e9)).select("query_id", F.col("id").alias("item_id"), "sim")


def joined_rows(queries: DataFrame, items: DataFrame, k: int) -> dict[str, int]:
    """How many postings the bounds of k best items leave to join, and how many all lists of the queries' terms have; for tests and reports."""
    lists = _planned(queries, items, k)[1]
    counted = lists_of(postings_of(items)).join(terms_of(queries), "term").agg(F.sum("n")).first()[0]
    return {"joined": lists.where("not left_out").agg(F.sum("n")).first()[0] or 0, "all": counted or 0}
