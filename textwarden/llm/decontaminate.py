"""Benchmark decontamination with a positional inverted index (built-in functions only).

1. Test items become windows of `size` words; an item of fewer words is one window.
2. Every term of the windows is counted over all training tokens. A window's two rarest words are its anchor and its guard.
3. The index stores the postings of all anchors and guards in all training documents: row, term, position. A posting of an
   anchor also keeps the words around it that a window can reach. A header posting per document holds its length.
4. A window's two lists, each read at its word's offset in the window, are joined: the starts that both lists name remain.
5. At those starts all words of the window must follow, word for word.

Lists are those of rare terms by choice, tokens are counted with map-side combining, and nothing is collected. Texts are
cut into overlapping pieces before tokens are told apart, so that no row of a token sees more than a piece. Tokens are never
shuffled: terms are broadcast, and more of them than a broadcast may hold are looked up in several passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, checked_broadcast, cut, lower_ascii, scoped

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text that are told apart in one row.
PIECE = 2000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, ASCII letters and other than ASCII characters; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id string, phrase array<string>) of the items (item_id, text); ids that are null, and texts without words, have none."""
    own = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1))))
    return own.select("item_id", "w", starts.alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("phrase")).distinct()


def anchored(windows: DataFrame, texts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(pid, phrase, anchor, anchor_at, guard, guard_at): each distinct window's rarest and second rarest word by their counts over texts(w).

    Windows with a word that no text has are left out; a window of one word has it as its guard, too.
    """
    phrases = cut(windows.select("phrase").distinct().withColumn("pid", F.monotonically_increasing_id()))
    each = phrases.select("pid", F.posexplode("phrase").alias("at", "term"))
    terms = cut(each.select("term").distinct())
    small = checked_broadcast(terms, broadcast_rows)
    tokens = texts.select(F.explode("w").alias("term"))
    if small is not terms:
        tokens = tokens.join(small, "term")
    counts = cut(tokens.groupBy("term").agg(F.count("*").alias("n")).join(small, "term", "left_semi"))
    known = each.join(checked_broadcast(counts, broadcast_rows), "term", "left")
    ranked = known.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at"))).alias("by"))
    first, second = F.col("by")[0], F.element_at("by", F.least(F.lit(2), F.size("by")))
    chosen = ranked.where(first["n"] > 0).select(
        "pid", first["term"].alias("anchor"), first["at"].alias("anchor_at"), second["term"].alias("guard"), second["at"].alias("guard_at")
    )
    return phrases.join(chosen, "pid")


def _told(texts: DataFrame, terms: DataFrame, reach: int, headers: bool) -> DataFrame:
    """The postings of the terms, which are broadcast, in texts; with each document's header if asked for."""
    begin = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(PIECE))
    before = lambda s: F.least(s, F.lit(reach))
    around = lambda s: F.slice("w", s - before(s) + 1, before(s) + PIECE + reach)
    pieces = texts.select("row", "doc_id", F.size("w").alias("n_words"), F.explode(F.transform(begin, lambda s: F.struct(s.alias("begin"), around(s).alias("around")))).alias("p"))
    pieces = pieces.select("row", "doc_id", "n_words", "p.begin", "p.around", before(F.col("p.begin")).alias("before"))
    tokens = pieces.select("*", F.posexplode_outer(F.slice("around", F.col("before") + 1, PIECE)).alias("k", "word"))
    pos = F.col("begin") + F.coalesce("k", F.lit(0))
    tokens = tokens.join(F.broadcast(terms.select(F.col("term").alias("word"), "leads")), "word", "left").withColumn("pos", pos)
    heads = F.lit(headers) & (F.col("pos") == 0)
    tokens = tokens.where(F.col("leads").isNotNull() | heads)
    lead = F.least("pos", F.lit(reach))
    near = F.when(F.col("leads"), F.slice("around", F.col("before") + F.col("k") - lead + 1, lead + reach + 1))
    posting = F.struct(F.col("word").alias("term"), F.col("pos"), lead.alias("lead"), near.alias("near"))
    header = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("pos"), F.lit(0).alias("lead"), F.lit(None).cast("array<string>").alias("near"))
    kept = F.array_compact(F.array(F.when(F.col("leads").isNotNull(), posting), F.when(heads, header)))
    return tokens.select("row", "doc_id", "n_words", F.explode(kept).alias("p")).select("row", "doc_id", F.when(F.col("p.term").isNull(), F.col("n_words")).alias("n_words"), "p.*")


def build_index(texts: DataFrame, terms: DataFrame, reach: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The stored postings (row, doc_id, n_words, term, pos, lead, near) of the terms (term, leads) in texts(row, doc_id, w).

    For terms that lead, near holds the words from pos - lead (at most `reach` before) to pos + reach. A posting without a term
    is a document's header. Terms beyond broadcast_rows are looked up in as many passes as it takes, over texts written once.
    """
    passes = max(1, -(-terms.count() // broadcast_rows))
    if passes == 1:
        return cut(_told(texts, terms, reach, True))
    texts = cut(texts)
    dealt = F.pmod(F.xxhash64("term"), F.lit(passes))
    return cut(reduce(DataFrame.unionByName, (_told(texts, terms.where(dealt == k), reach, k == 0) for k in range(passes))))


def phrase_matches(index: DataFrame, anchors: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, start, n, phrase): every place where a window stands, word for word.

    The starts that a window's anchor list gives are intersected with those of its guard list; the words are compared there.
    """
    postings = index.where("term is not null")

    def starts(word: str) -> DataFrame:
        of = checked_broadcast(anchors.select("pid", F.col(word).alias("term"), F.col(f"{word}_at").alias("at")), broadcast_rows)
        return postings.select("row", "term", "pos").join(of, "term").where("pos >= at").select("row", "pid", (F.col("pos") - F.col("at")).alias("start"))

    both = starts("anchor").join(starts("guard"), ["row", "pid", "start"], "left_semi")
    places = both.join(checked_broadcast(anchors.select("pid", "anchor", "anchor_at"), broadcast_rows), "pid")
    places = cut(places.select("row", "pid", "start", F.col("anchor").alias("term"), (F.col("start") + F.col("anchor_at")).alias("pos")))
    seen = postings.where("near is not null").join(checked_broadcast(places, broadcast_rows), ["row", "term", "pos"])
    at = F.col("lead") - F.col("anchor_at")
    told = seen.join(checked_broadcast(anchors.select("pid", "phrase", "anchor_at"), broadcast_rows), "pid")
    return told.where(F.slice("near", at + 1, F.size("phrase")) == F.col("phrase")).select("row", "start", F.size("phrase").alias("n"), "phrase")


def proximity_matches(docs: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, start): places where the first of the terms has all the others within so many words, on either side.

    The lists of the terms are joined by document and stretch of `within + 1` words, so that a place meets three stretches only.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    wanted = docs.sparkSession.createDataFrame([(t, False) for t in dict.fromkeys(terms)], "term string, leads boolean")
    postings = build_index(texts, wanted, 0).where("term is not null").select("row", "doc_id", "term", "pos")
    stretch = F.floor(F.col("pos") / (within + 1))
    first = postings.where(F.col("term") == terms[0]).select("row", "doc_id", F.col("pos").alias("start"))
    others = sorted(set(terms) - {terms[0]})
    if not others:
        return first.select("doc_id", "start")
    met = first.withColumn("stretch", F.explode(F.array(*(F.floor(F.col("start") / (within + 1)) + d for d in (-1, 0, 1)))))
    other = postings.where(F.col("term").isin(others)).select("row", "term", "pos", stretch.alias("stretch"))
    near = met.join(other, ["row", "stretch"]).where(F.abs(F.col("pos") - F.col("start")) <= within)
    return near.groupBy("row", "doc_id", "start").agg(F.count_distinct("term").alias("met")).where(F.col("met") == len(others)).select("doc_id", "start")


@scoped
def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): row, doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with
    occurring windows), items_sha256 (of their ids, sorted as strings and joined by commas), contaminated (n_hit > 0 and share * n_hit >= n_words).

    Null or empty texts have no words and are clean; repeated rows get a row each; a null doc_id stays null. Items whose id is null are ignored,
    repeated items count once, and no items at all leave every document clean. Other columns are ignored.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    windows = cut(item_windows(items, size))
    anchors = cut(anchored(windows, texts, broadcast_rows))
    led = anchors.select(F.explode(F.array(F.struct(F.col("anchor").alias("term"), F.lit(True).alias("leads")), F.struct(F.col("guard").alias("term"), F.lit(False).alias("leads")))).alias("t"))
    index = build_index(texts, cut(led.groupBy("t.term").agg(F.max("t.leads").alias("leads"))), size - 1, broadcast_rows)
    hits = cut(phrase_matches(index, anchors, broadcast_rows))
    until = F.col("start") + F.col("n")
    before = F.max(until).over(Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), until - F.greatest("start", F.coalesce(before, F.lit(0))))
    hit = hits.select("row", "start", "n").distinct().select("row", fresh.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    found = hits.select("row", "phrase").distinct().join(checked_broadcast(windows, broadcast_rows), "phrase").select("row", "item_id").distinct()
    found = found.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    told = index.where("term is null").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words")).join(hit, "row", "left").join(found, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return told.select(
        "row",
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs that are not contaminated. Where several rows share a doc_id and one is contaminated, all go; null doc_ids stay."""
    gone = cut(contamination(docs, items, size, share).where("contaminated and doc_id is not null").select("doc_id").distinct())
    return docs.join(checked_broadcast(gone), "doc_id", "left_anti")
