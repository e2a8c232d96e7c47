"""URL filter: rules first, then naive Bayes over the words of hosts and paths.

Host names run words together. Each run of letters is split by a unigram model: the split whose words have the largest product of probabilities, found
by dynamic programming along the run (Viterbi). Word counts come from whole texts; a word that no text has is the less likely the longer it is.
Substrings of runs are joined with the counted words, so that the vocabulary is never broadcast unless it is proven small.

Multinomial naive Bayes then scores the words, told apart by whether they stand in the host or the path. It learns from all URLs: a host with a word
of the caller's list of terms is an example to block, all others are examples to allow; other words gain weight by the company they keep. Weights are whole
millionths, so that sums don't depend on their order.

Hosts, and the letters of paths, are counted before anything is joined: a host with a third of all pages is one row until the last join,
which adaptive execution may split.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, light, lower_ascii, scoped

#: (host, path, verdict): a rule fits its host and all subdomains, for paths that start with its path. The longest rule wins.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words that mark a host as an example to block: adult content, gambling, unsolicited sales, trackers.
TERMS = "adult ads bet bets casino escort gambling jackpot lottery malware phishing pills poker porn sex spam tracker viagra warez xxx".split()
#: Letters of the shortest and longest word that is looked up.
SHORTEST, LONGEST = 2, 24
LETTERS = r"\p{L}+"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.when(F.contains(url, F.lit("://")), lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def runs_of(text: Column) -> Column:
    """The runs of letters in a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all runs of letters in whole texts (text), lower-cased, of lengths that are looked up."""
    words = texts.select(F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("word"))
    return words.where(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def best_split(run: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """The likeliest words of a run. found: (start, length, count) of its substrings that are words; total: of all counts.

    Other substrings of up to LONGEST letters count as 10 / 10^length words. Of equal splits, the one whose last words are longest.
    """
    count = {(at, length): n for at, length, n in found}
    unseen = [math.log(10) - length * math.log(10) for length in range(LONGEST + 1)]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        choice = None
        for start in range(max(0, end - LONGEST), end):
            n = count.get((start, end - start))
            reached = best[start][0] + (math.log(n) if n else unseen[end - start]) - math.log(max(total, 1))
            if choice is None or reached > choice[0]:
                choice = (reached, start)
        best.append(choice)
    out, end = [], len(run)
    while end:
        out.append(run[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segmented(runs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(run, words) of distinct runs (run), by the counts (word, n), which are `total` in all."""
    starts = runs.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("at"))
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("run") - F.col("at")))
    cut_out = starts.where(F.length("run") - F.col("at") >= SHORTEST).select("run", "at", F.explode(lengths).alias("length"))
    pieces = cut_out.withColumn("word", F.substr("run", F.col("at") + 1, F.col("length")))
    found = pieces.join(light(words), "word").groupBy("run").agg(F.collect_list(F.struct("at", "length", "n")).alias("found"))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([best_split(r, [] if f is None else [(x["at"], x["length"], x["n"]) for x in f], total) for r, f in zip(run, found)])

    return runs.join(found, "run", "left").select("run", split("run", "found").alias("words"))


def _run_weights(counted: DataFrame, runs: DataFrame) -> DataFrame:
    """(place, run, weight) by naive Bayes. counted: (place, run, block, allow), how often a run stands in a place in examples of each kind; runs: (run, words)."""
    spoken = cut(counted.join(light(runs), "run").select("place", "run", "block", "allow", F.explode("words").alias("word")))
    tokens = cut(spoken.groupBy("place", "word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    n, block, allow = (x or 0 for x in tokens.agg(F.count("*"), F.sum("block"), F.sum("allow")).first())
    likelier = F.log((F.col("block") + 1) / float(block + n)) - F.log((F.col("allow") + 1) / float(allow + n))
    weights = tokens.select("place", "word", F.floor(likelier * 1_000_000).alias("w"))
    return spoken.select("place", "run", "word").join(light(weights), ["place", "word"]).groupBy("place", "run").agg(F.sum("w").alias("weight"))


def _fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host that any rule's host fits, those rules, as structs of (length, rule, path, verdict)."""
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("of"))
    known = rules.select(F.col("host").alias("of"), F.struct(F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    return above.join(light(known), "of").groupBy("host").agg(F.collect_set("r").alias("rules"))


def rule_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


@scoped
def judge(pages: DataFrame, texts: DataFrame, rules: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """(page_id, host, path, rule, verdict, weight) of each row of pages (page_id, url).

    texts (text) give the word counts, rules (host, path, verdict) decide where they fit (the longest; of equally long ones the last by code point), and
    naive Bayes elsewhere: block where weight, the log odds in millionths, is over 0. rule is null where none fits. A null url, and one without ://, has an
    empty host and path, no rule, no words, and the odds of all hosts. Null page_ids and repeated rows are rows of their own. Hosts, paths and texts of
    any length are read whole; each letter run of a host or path is held by one task. Other columns are ignored; an empty table has no rows; without
    texts, runs of letters stay whole where that is likelier than any split.
    """
    own = cut(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    pattern = F.array_join(runs_of(F.col("path")), " ")
    pairs = cut(own.groupBy("host", pattern.alias("pattern")).agg(F.count("*").alias("pages")))
    hosts = cut(pairs.groupBy("host").agg(F.sum("pages").alias("pages")))
    patterns = cut(pairs.groupBy("pattern").agg(F.sum("pages").alias("pages")))
    host_runs = hosts.select("host", F.explode(runs_of(F.col("host"))).alias("run"))
    pattern_runs = patterns.where("pattern <> ''").select("pattern", F.explode(F.split("pattern", " ")).alias("run"))

    seeds = pages.sparkSession.createDataFrame([(t, 1) for t in terms], "word string, n long")
    words = cut(word_counts(texts).unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    runs = cut(segmented(host_runs.select("run").union(pattern_runs.select("run")).distinct(), words, total))
    bad = runs.select("run", F.arrays_overlap("words", F.array(*map(F.lit, terms))).alias("bad"))
    blocked = host_runs.join(light(bad), "run").groupBy("host").agg(F.max("bad").alias("bad"))
    labelled = cut(hosts.join(light(blocked), "host", "left").select("host", "pages", F.coalesce("bad", F.lit(False)).alias("bad")))

    def told(table: DataFrame, key: str, each: DataFrame, place: str) -> DataFrame:
        """Runs counted in examples to block and to allow; table: (key, block, allow), each: (key, run)."""
        return each.join(light(table), key).groupBy("run").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).select(F.lit(place).alias("place"), "run", "block", "allow")

    both = [F.when(F.col("bad"), F.col("pages")).otherwise(0).alias("block"), F.when(F.col("bad"), 0).otherwise(F.col("pages")).alias("allow")]
    by_pattern = pairs.join(light(labelled.select("host", "bad")), "host").select("pattern", *both).groupBy("pattern").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    counted = told(labelled.select("host", *both), "host", host_runs, "host").unionByName(told(by_pattern, "pattern", pattern_runs, "path"))
    weights = cut(_run_weights(counted, runs))
    block, allow = (x or 0 for x in labelled.select(*both).agg(F.sum("block"), F.sum("allow")).first())
    prior = math.floor(1_000_000 * math.log((block + 1) / (allow + 1)))

    def weighed(each: DataFrame, key: str, place: str) -> DataFrame:
        return each.join(light(weights.where(F.col("place") == place).select("run", "weight")), "run").groupBy(key).agg(F.sum("weight").alias(f"{place}_weight"))

    judged = cut(labelled.select("host").join(weighed(host_runs, "host", "host"), "host", "left").join(_fitting(hosts.select("host"), rules), "host", "left"))
    paths = cut(weighed(pattern_runs, "pattern", "path"))
    fits = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    weight = F.lit(prior) + F.coalesce("host_weight", F.lit(0)) + F.coalesce("path_weight", F.lit(0))
    met = own.withColumn("pattern", pattern).join(light(judged), "host").join(light(paths), "pattern", "left").select("page_id", "host", "path", fits.alias("fits"), weight.alias("weight"))
    learned = F.when(F.col("weight") > 0, "block").otherwise("allow")
    return met.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", learned).alias("verdict"), "weight")
