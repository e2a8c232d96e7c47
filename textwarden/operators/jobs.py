"""Offline jobs over the traces: each one pass, or one aggregate and one short top list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as L
from ..functions import text as T


def summary(traces: DataFrame) -> DataFrame:
    return traces.agg(
        F.count("*").alias("rows"), F.count_distinct("user").alias("users"), F.sum("tokens").alias("tokens"), F.count_if(F.col("feedback") == "down").alias("thumbs_down"),
        F.count_if(F.col("feedback") == "up").alias("thumbs_up"), F.count("t2_score").alias("tier2_ran"),
    )


def histogram(traces: DataFrame, column: str) -> DataFrame:
    return traces.groupBy(F.coalesce(column, F.lit("?")).alias(column)).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def cost_by_user(traces: DataFrame, top: int = 3) -> DataFrame:
    """The users with most tokens, ties to the smaller user, and their share of all tokens in percent."""
    by = traces.groupBy("user").agg(F.sum("tokens").alias("tokens"))
    share = T.half_up(F.col("tokens") / F.col("total") * 100, 1)
    total = by.agg(F.sum("tokens").alias("total"))
    return by.orderBy(F.col("tokens").desc(), "user").limit(top).crossJoin(F.broadcast(total)).select("user", "tokens", share.alias("share"))


def cost_headline(traces: DataFrame) -> DataFrame:
    early = F.col("action").isin("block", "block_and_route_hr") & F.col("t1_out_score").isNull()
    a = traces.agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens_total"), F.sum("retry_count").alias("retries"), F.count("t2_score").alias("t2"), F.count_if(early).alias("blocked_before_retrieval"))
    return a.select("requests", "tokens_total", T.half_up(F.col("tokens_total") / F.col("requests"), 1).alias("tokens_per_request"), "retries", T.half_up(F.col("t2") / F.col("requests") * 100, 1).alias("tier2_rate"), "blocked_before_retrieval")


def topic_counts(traces: DataFrame) -> DataFrame:
    """(topic, down, up): questions with thumbs by topic word, each word once a question."""
    each = traces.where(F.col("feedback").isin("down", "up")).select("feedback", F.explode(F.array_distinct(T.topic_words(F.col("question")))).alias("topic"))
    return each.groupBy("topic").agg(F.count_if(F.col("feedback") == "down").alias("down"), F.count_if(F.col("feedback") == "up").alias("up"))


def thumbs_clusters(traces: DataFrame, least: int = 2) -> DataFrame:
    """The five topics of the highest failure rate among the twenty with most thumbs down. Ties: most down, then the smaller word."""
    most = topic_counts(traces).where("down > 0").orderBy(F.col("down").desc(), "topic").limit(20).where(F.col("down") >= least)
    rate = F.col("down") / (F.col("down") + F.col("up"))
    return most.orderBy(rate.desc(), F.col("down").desc(), "topic").limit(5).select("topic", "down", "up", T.half_up(rate, 2).alias("failure_rate"))


def keyed(traces: DataFrame) -> DataFrame:
    return traces.select("thread", T.topic_key(F.col("question")).alias("key")).where("key <> ''")


def repeat_threads(traces: DataFrame, least: int = 3, top: int | None = None) -> DataFrame:
    """(thread, topic, asked) of the topics that a thread asks at least so often; with top, the first of them by thread and topic."""
    out = keyed(traces).groupBy("thread", "key").agg(F.count("*").alias("asked")).where(F.col("asked") >= least).select("thread", F.substring("key", 1, 48).alias("topic"), "asked")
    return out if top is None else out.orderBy("thread", "topic").limit(top)


def repeat_global(traces: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    most = keyed(traces).groupBy("key").agg(F.count("*").alias("asked")).orderBy(F.col("asked").desc(), "key").limit(top)
    return most.where(F.col("asked") >= least).select(F.substring("key", 1, 48).alias("topic"), "asked")


def conflict_rate(traces: DataFrame) -> DataFrame:
    a = traces.where("t2_score is not null").agg(F.count("*").alias("checked"), F.count_if("sources_disagreed").alias("disagreed"))
    return a.select("checked", "disagreed", T.half_up(F.col("disagreed") / F.greatest("checked", F.lit(1)), 2).alias("rate"))


def conflict_topics(traces: DataFrame, top: int = 5) -> DataFrame:
    each = traces.where("t2_score is not null and sources_disagreed").select(F.explode(F.array_distinct(T.topic_words(F.col("question")))).alias("topic"))
    return each.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "topic").limit(top)


def counterfactuals(rows: DataFrame, question: str = "question") -> DataFrame:
    """rows with (attribute, a, b, swapped) for each swap that applies to the question."""
    pairs = F.array(*(F.struct(F.lit(k).alias("attribute"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in L.SWAPS))
    applies = F.filter(pairs, lambda p: T.mentions(F.col(question), p["a"]))
    each = rows.select("*", F.explode(applies).alias("__p")).select(*rows.columns, "__p.*")
    return each.withColumn("swapped", T.swap(F.col(question), F.col("a"), F.col("b")))


def bias_pairs(traces: DataFrame, scorer: Callable[[Column], Column], sample: int | None = 50) -> DataFrame:
    """Counterfactual pairs scored on both sides by the same expression, which gives struct<risk_score, band, scores map>: (run_id, attribute, a, b, score_a, score_b, band_a, band_b, gap, moved).

    sample takes the first rows by ts and run_id, as a probe; None takes all.
    """
    rows = traces if sample is None else traces.orderBy("ts", "run_id").limit(sample)
    told = counterfactuals(rows.select("run_id", "question")).withColumn("x", scorer(F.col("question"))).withColumn("y", scorer(F.col("swapped")))
    moved = F.array_sort(F.filter(F.map_keys("x.scores"), lambda k: F.element_at("x.scores", k) != F.element_at("y.scores", k)))
    return told.select("run_id", "attribute", "a", "b", F.col("x.risk_score").alias("score_a"), F.col("y.risk_score").alias("score_b"), F.col("x.band").alias("band_a"), F.col("y.band").alias("band_b"), T.half_up(F.abs(F.col("x.risk_score") - F.col("y.risk_score")), 1).alias("gap"), moved.alias("moved"))


def bias_summary(pairs: DataFrame) -> DataFrame:
    differ = (F.col("gap") > 0) | (F.col("band_a") != F.col("band_b"))
    return pairs.agg(F.count("*").alias("pairs_tested"), F.count_if(differ).alias("pairs_that_differed"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"), F.coalesce(T.half_up(F.avg("gap"), 2), F.lit(0.0)).alias("mean_gap"))


def bias_blame(pairs: DataFrame) -> DataFrame:
    differ = (F.col("gap") > 0) | (F.col("band_a") != F.col("band_b"))
    return pairs.where(differ).select(F.explode("moved").alias("detector")).groupBy("detector").agg(F.count("*").alias("n"))


def queue_health(items: DataFrame, now: Column) -> DataFrame:
    waiting, done = F.col("status") == "waiting", F.col("status") == "reviewed"
    a = items.agg(F.count("*").alias("queued"), F.count_if(waiting).alias("waiting"), F.count_if(waiting & (now > F.col("due_at"))).alias("overdue"), F.count_if(done).alias("reviewed"), F.count_if(done & (F.col("verdict") == "over_flagged")).alias("over"))
    return a.select("queued", "waiting", "overdue", "reviewed", F.when(F.col("reviewed") > 0, T.half_up(F.col("over") / F.col("reviewed"), 2)).otherwise(F.lit(0.0)).alias("over_flag_rate"))


def labelled_data(items: DataFrame) -> DataFrame:
    """Reviewed items only: what training may use."""
    lessons = F.create_map(*(F.lit(x) for pair in L.LESSONS.items() for x in pair))
    return items.where("status = 'reviewed'").select("run_id", F.col("question").alias("text"), "answer", F.col("machine_action"), F.col("verdict").alias("human_verdict"), F.try_element_at(lessons, F.col("verdict")).alias("lesson"))


def review_priority(traces: DataFrame) -> DataFrame:
    """Thumbs down by the machine's own score: full where it let the answer pass, half elsewhere."""
    score = F.coalesce("t1_in_score", F.lit(0.0))
    priority = F.when(F.col("action").isin("allow", "auto_fix"), score).otherwise(score / 2)
    return traces.where("feedback = 'down'").select("run_id", F.substring("question", 1, 60).alias("question"), score.alias("machine_score"), "action", T.half_up(priority, 1).alias("priority"))


def confusion(cases: DataFrame) -> DataFrame:
    """(label, allow, suspicious, block) of cases (label, band)."""
    return cases.groupBy("label").agg(*(F.count_if(F.col("band") == b).alias(b) for b in ("allow", "suspicious", "block")))


def error_rates(cases: DataFrame) -> DataFrame:
    """(cases, legitimate, attacks, false_alarms, missed, false_alarm_rate, miss_rate) of cases (label, band): what is no attack should not be blocked, what is one not allowed.

    Rates have three places, and are 0 where there is nothing to get wrong.
    """
    attack, band = F.col("label") == "attack", F.col("band")
    a = cases.agg(F.count("*").alias("cases"), F.count_if(~attack).alias("legitimate"), F.count_if(attack).alias("attacks"), F.count_if(~attack & (band == "block")).alias("false_alarms"), F.count_if(attack & (band == "allow")).alias("missed"))
    rate = lambda n, of: T.half_up(F.col(n) / F.greatest(F.col(of), F.lit(1)), 3)
    return a.select("*", rate("false_alarms", "legitimate").alias("false_alarm_rate"), rate("missed", "attacks").alias("miss_rate"))


#: What a proposal would change, what it risks, and what it needs before it counts, by target.
PLANS = {
    "usage limits": ("a lower limit a day for users far above the others", "low", "shadow"),
    "retrieval": ("fetch more before the first answer", "low", "shadow"),
    "documents": ("audit the documents on this topic", "none", "owner"),
    "cache": ("answer this question from the cache", "low", "thumbs up"),
    "source trust": ("rank the policy above its copies", "medium", "review, then shadow"),
    "detector thresholds": ("review the detectors that moved", "high", "review, then shadow"),
}


def proposals(traces: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(target, subject, figure, change, reason, risk, needs): what the jobs' findings suggest. Nothing is applied."""

    def rows(df: DataFrame, target: str, subject: Column, figure: Column, *reason: str | Column) -> DataFrame:
        change, risk, needs = (F.lit(x) for x in PLANS[target])
        why = F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in reason))
        return df.select(F.lit(target).alias("target"), subject.alias("subject"), figure.cast("double").alias("figure"), change.alias("change"), why.alias("reason"), risk.alias("risk"), needs.alias("needs"))

    c = F.col
    head = cost_headline(traces)
    out = rows(cost_by_user(traces, 1).where("share > 40"), "usage limits", c("user").cast("string"), c("share"), "one user has ", c("tokens"), " tokens")
    out = out.unionByName(rows(head.where("retries > greatest(1, requests) * 0.1"), "retrieval", F.lit("retries"), c("retries"), c("retries"), " retries of ", c("requests"), " requests"))
    bad = thumbs_clusters(traces).orderBy(c("failure_rate").desc(), c("down").desc(), "topic").limit(2).where("failure_rate >= 0.6 and down >= 2")
    out = out.unionByName(rows(bad, "documents", c("topic"), c("failure_rate"), c("down"), " down, ", c("up"), " up"))
    repeated = repeat_global(traces, top=5).orderBy(c("asked").desc(), "topic").limit(2)
    out = out.unionByName(rows(repeated, "cache", c("topic"), c("asked"), "asked ", c("asked"), " times"))
    out = out.unionByName(rows(conflict_rate(traces).where("disagreed > 0"), "source trust", F.lit("conflicts"), c("disagreed"), "sources disagreed on ", c("disagreed"), " of ", c("checked"), " checked answers"))
    if pairs is not None:
        moved = bias_summary(pairs).where("pairs_that_differed > 0")
        out = out.unionByName(rows(moved, "detector thresholds", F.lit("bias"), c("pairs_that_differed"), c("pairs_that_differed"), " of ", c("pairs_tested"), " pairs differed"))
    return out


def shadow_plan(scored: DataFrame, current: float, step: float = 0.1, highest: float = 100.0) -> DataFrame:
    """(threshold, flagged, false_alarms, misses, outcome) for every threshold from 0 to the highest: what would come of it, against the current one.

    scored (score, wrong): a score, and whether the row should have been flagged (null if nobody said). A row is flagged from the threshold on; null scores never are.
    One pass counts scores in bins of a step, and sums run over the bins, which don't grow with the rows. outcome is "enable" for fewer misses or false
    alarms without more of the other, "roll back" for more of either, "as is" otherwise.
    """
    bins = round(highest / step)
    at = F.least(F.floor(F.col("score") / step + 1e-6), F.lit(bins))
    wrong, right = F.count_if(F.col("wrong")), F.count_if(~F.col("wrong"))
    counts = scored.groupBy(F.coalesce(F.when(F.col("score") >= 0, at), F.lit(-1)).alias("bin")).agg(F.count("*").alias("n"), wrong.alias("wrong"), right.alias("right"))
    all_bins = scored.sparkSession.range(-1, bins + 1).withColumnRenamed("id", "bin").join(counts, "bin", "left").fillna(0)
    up, below = Window.orderBy(F.col("bin").desc()), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    told = all_bins.select("bin", F.sum("n").over(up).alias("flagged"), F.sum("right").over(up).alias("false_alarms"), F.coalesce(F.sum("wrong").over(below), F.lit(0)).alias("misses")).where("bin >= 0")
    now = told.where(F.col("bin") == round(current / step)).select(F.col("false_alarms").alias("alarms_now"), F.col("misses").alias("misses_now"))
    more = (F.col("false_alarms") > F.col("alarms_now")) | (F.col("misses") > F.col("misses_now"))
    fewer = (F.col("false_alarms") < F.col("alarms_now")) | (F.col("misses") < F.col("misses_now"))
    outcome = F.when(more, "roll back").when(fewer, "enable").otherwise("as is")
    return told.crossJoin(F.broadcast(now)).select(T.half_up(F.col("bin") * step, 6).alias("threshold"), "flagged", "false_alarms", "misses", outcome.alias("outcome"))


def run_all(traces: DataFrame, scorer: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """Every job by name; lazy, so that a caller runs the ones it wants."""
    jobs = {"summary": summary(traces), "cost": cost_headline(traces), "thumbs": thumbs_clusters(traces), "repeats": repeat_global(traces), "conflicts": conflict_rate(traces)}
    if scorer is not None:
        jobs["bias"] = bias_summary(bias_pairs(traces, scorer))
    return jobs
