"""Queries on traces, reviews and histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import detectors as D
from ..operators import history as H
from ..operators import jobs as J
from ..sources import stores
from ..streaming import traces as ST
from ..streaming import usage as S
from ..tables import dealt, fresh_path, scoped
from . import text_queries as TQ
from . import views as V
from .text_queries import TOPICS, swaps_sql
from .views import sql_list, sql_text

#: Limits that the test tables reach; the defaults never fire on them.
LIMITS = {"per_minute": 1, "per_day": 3, "tokens_per_day": 300, "retries": 3, "repeat_ratio": 0.3}
NOW = 1_000_000_000.0


def on_traces(job):
    return lambda spark, sf_dir: job(V.traces(spark, sf_dir))


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join((V.TRACES, *more))} {body}"


def up(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


def _items(spark, sf_dir):
    return stores.stitch_verdicts(V.reviews(spark, sf_dir), V.verdicts(spark, sf_dir))


def trace_stitch(spark, sf_dir):
    """Traces with late feedback stitched on: what comes in for three runs in a row is meant for the first of them, and the last of it counts."""
    t = V.traces(spark, sf_dir)
    events = t.where("feedback is not null").select((F.col("run_id") - F.col("run_id") % 3).alias("run_id"), "feedback", F.col("run_id").alias("seq"))
    return stores.stitch_feedback(t, events).select("run_id", "user", "feedback")


def simple_score(question):
    """A scorer for counterfactuals that needs one text: injection, personal data, size, and a length-sensitive part, so that swaps can show."""
    length = F.pmod(F.length(question), F.lit(7)) / 10
    parts = {"injection": D.injection_structure(question)["score"], "pii": length}
    f = D.fuse(parts, {})
    return F.struct(f["risk_score"].alias("risk_score"), f["band"].alias("band"), F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v))).alias("scores"))


def bias_pairs(spark, sf_dir):
    return J.bias_pairs(V.traces(spark, sf_dir), simple_score, None)


def usage(spark, sf_dir):
    t = V.traces(spark, sf_dir).withColumn("retries", F.lit(0))
    return H.usage(t, ["ts", "run_id"], LIMITS)


def usage_rates(spark, sf_dir):
    return H.rates(V.traces(spark, sf_dir)).select("run_id", "per_minute", "per_day", "tokens_day")


@scoped
def attempt_number(spark, sf_dir):
    """Attempts in each thread; a question repeats one of the last ten if their vectors are near enough."""
    t = V.traces(spark, sf_dir).withColumn("question", V.spelled(F.col("question"), F.col("run_id")))
    near = H.like_before(t, ["ts", "run_id"], "run_id")
    told = H.attempts(t.join(near, "run_id"), ["ts", "run_id"], F.col("similarity").isNotNull())
    return told.select("run_id", T.half_up(F.col("similarity"), 6).alias("similarity"), "attempt", "strategy", "skip_cache")


_ATTEMPTS = f"""
t AS (SELECT * REPLACE ({V.SPELLED} AS question) FROM traces), texts AS (SELECT DISTINCT md5(question) AS id, question AS text FROM t), {V.grams_sql('g', 'texts', 'id', 'text')},
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM texts))::DOUBLE / (1 + count(DISTINCT id))) + 1 AS idf FROM g GROUP BY term), w AS ({V.weights_sql('g')}),
alike AS (SELECT x.id AS sig, y.id AS earlier, CASE WHEN x.id = y.id THEN 1.0::DOUBLE ELSE sum(x.w * y.w) END AS sim FROM w x JOIN w y USING (term) GROUP BY x.id, y.id HAVING floor(sum(x.w * y.w) * 1e9) >= {L.REPEAT_NEAR} * 1e9 OR x.id = y.id),
f AS (SELECT run_id, md5(question) AS sig, list(md5(question)) OVER (PARTITION BY thread ORDER BY ts, run_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seen FROM t),
near AS (SELECT run_id, max(sim) AS similarity FROM (SELECT run_id, sig, unnest(seen) AS earlier FROM f) JOIN alike USING (sig, earlier) GROUP BY run_id),
a AS (SELECT *, similarity IS NOT NULL OR coalesce(last_value(feedback IGNORE NULLS) OVER wp = 'down', false)
         OR len(list_filter({sql_list(L.PUSH_BACK)}, lambda p: contains(lower(question), p))) > 0 AS again, coalesce(lag(feedback) OVER wo = 'up', false) AS reset
      FROM t LEFT JOIN near USING (run_id) WINDOW wo AS (PARTITION BY thread ORDER BY ts, run_id), wp AS (PARTITION BY thread ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, sum(CASE WHEN NOT again OR reset THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM a),
c AS (SELECT run_id, similarity, row_number() OVER w + first_value(again::INT) OVER w AS attempt FROM b WINDOW w AS (PARTITION BY thread, island ORDER BY ts, run_id))
SELECT run_id, floor(similarity * 1000000 + 0.5) / 1000000 AS similarity, attempt::INT AS attempt, least(attempt, 3)::INT AS strategy, attempt >= 2 AS skip_cache FROM c"""


def shadow_plan(spark, sf_dir):
    """What every threshold would have done to the traces, against the one in force; thumbs say what should have been flagged."""
    t = V.traces(spark, sf_dir)
    return J.shadow_plan(t.select(F.col("t1_in_score").alias("score"), F.when(F.col("feedback").isNotNull(), F.col("feedback") == "down").alias("wrong")), 80.0)


_RATES = """
rates AS (SELECT run_id, count(*) OVER (PARTITION BY user ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING) AS per_minute,
  count(*) OVER (PARTITION BY user ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS per_day,
  coalesce(sum(tokens) OVER (PARTITION BY user ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_day FROM (SELECT *, epoch_us(ts) AS us FROM traces))"""
_REPEAT = """
seen AS (SELECT run_id, list(substr(lower(trim(question)), 1, 200)) OVER (PARTITION BY thread ORDER BY ts, run_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS s FROM traces),
repeats AS (SELECT run_id, CASE WHEN len(s) >= 4 THEN 1 - len(list_distinct(s))::DOUBLE / len(s) ELSE 0.0::DOUBLE END AS repeat_ratio FROM seen)"""


def _part(value: str, limit: float) -> str:
    return f"CASE WHEN {value} > {limit} THEN 0.45::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, ({value} - {limit})::DOUBLE / {limit}::DOUBLE) ELSE 0.0::DOUBLE END"


def _cases(spark, sf_dir):
    """Requests (label, band): what their planted sentence is, and what the injection detector says of the whole question."""
    r = dealt(V.requests(spark, sf_dir).select("run_id", "question", "format_given"))
    at = (F.floor(F.col("run_id") / 1000) * 31 + F.col("run_id") % 1000) % len(V.PLANTS)
    label = F.when(at.isin(V.ATTACKS), "attack").when(at.isin(V.TRICKY), "tricky").otherwise("safe")
    return r.select(label.alias("label"), D.injection(F.col("question"), F.col("format_given"))["band"].alias("band"))


def eval_confusion(spark, sf_dir):
    return J.confusion(_cases(spark, sf_dir))


def eval_rates(spark, sf_dir):
    return J.error_rates(_cases(spark, sf_dir))


def trace_export(spark, sf_dir):
    t = V.traces(spark, sf_dir).withColumns({"run_id": F.col("run_id").cast("string"), "answer": F.lit("a"), "trust_label": F.lit(None).cast("string"), "strict_mode": F.lit(False), "detectors": F.create_map(F.lit("pii"), F.lit(0.5)), "t2_scores": F.create_map(F.lit("groundedness"), F.lit(0.25))})
    x = stores.exported(t)
    return x.select("id", "name", F.col("inputs.question").alias("question"), F.col("metadata.user").alias("user"), F.col("metadata.band").alias("band"), F.element_at("scores", "detector.pii").alias("detector_pii"), F.element_at("scores", "tier2.groundedness").alias("tier2_groundedness"), F.get("feedback", 0)["score"].alias("thumbs"))


def _events(spark, sf_dir):
    """The events' files as a stream, with a closing row."""
    path = f"{sf_dir}/events.parquet"
    return ST.closed(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"), "ts").withColumn("ts", F.col("ts").cast("timestamp"))


@scoped
def stream_usage(spark, sf_dir):
    """Usage rates of the events, as a stream read from their files."""
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("run_id"), F.col("user_id").alias("user"), "ts", H.micros(F.col("ts")).alias("us"), F.floor("value").cast("long").alias("tokens"))
    return ST.replayed(S.usage_rates(rows).where(F.col("run_id") != ST.CLOSING))


@scoped
def stream_attempts(spark, sf_dir):
    """Attempts by pushed-back rows and thumbs, as a stream read from the events' files; a thread is a user's day, and so never quiet for a day."""
    kind = F.col("event_type")
    thread = F.col("user_id") * 1000 + F.dayofyear("ts")
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("run_id"), thread.alias("thread"), "ts", H.micros(F.col("ts")).alias("us"), (kind == "click").alias("pushed_back"), F.when(kind == "error", "down").when(kind == "purchase", "up").alias("feedback"))
    return ST.replayed(S.attempts(rows).where(F.col("run_id") != ST.CLOSING))


def _told(spark, sf_dir):
    """Streams of the events as traces (run_id, user, ts), and as late feedback (run_id, at, seq, feedback), meant as in trace_stitch."""
    thumbs = F.when(F.col("event_type") == "error", "down").when(F.col("event_type") == "purchase", "up")
    traces = _events(spark, sf_dir).select(F.col("event_id").alias("run_id"), F.col("user_id").alias("user"), "ts")
    feedback = _events(spark, sf_dir).select(F.when(F.col("event_id") == ST.CLOSING, F.col("event_id")).otherwise(F.col("event_id") - F.col("event_id") % 3).alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), thumbs.alias("feedback"))
    return traces, feedback.where(F.col("feedback").isNotNull() | (F.col("seq") == ST.CLOSING))


@scoped
def stream_feedback(spark, sf_dir):
    """trace_stitch, as a join of two streams in event time."""
    traces, feedback = _told(spark, sf_dir)
    return ST.replayed(ST.with_feedback(traces, feedback)).where(F.col("run_id") != ST.CLOSING).select("run_id", "user", "feedback")


@scoped
def stream_stored(spark, sf_dir):
    """trace_stitch, of a store that one stream of both kinds has been written to."""
    traces, feedback = _told(spark, sf_dir)
    both = traces.select("run_id", "user", "ts", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("feedback"), F.lit("trace").alias("kind"))
    both = both.unionByName(feedback.select("run_id", F.lit(None).cast("long").alias("user"), F.col("at").alias("ts"), "seq", "feedback", F.lit("feedback").alias("kind")))
    folder = fresh_path(spark)
    ST.store_kinds(both.where(F.col("run_id") != ST.CLOSING), folder, fresh_path(spark)).awaitTermination()
    stored = spark.read.parquet(folder)
    return stores.stitch_feedback(stored.where("kind = 'trace'").drop("seq"), stored.where("kind = 'feedback'").select("run_id", "feedback", "seq")).select("run_id", "user", "feedback")


QUERIES = {
    "trace_stitch": trace_stitch,
    "trace_summary": on_traces(J.summary),
    "trace_bands": on_traces(lambda t: J.histogram(t, "t1_in_band")),
    "trace_actions": on_traces(lambda t: J.histogram(t, "action")),
    "trace_export": trace_export,
    "cost_by_user": on_traces(J.cost_by_user),
    "cost_headline": on_traces(J.cost_headline),
    "topic_counts": on_traces(J.topic_counts),
    "thumbs_clusters": on_traces(J.thumbs_clusters),
    "repeat_threads": on_traces(J.repeat_threads),
    "repeat_global": on_traces(J.repeat_global),
    "conflict_rate": on_traces(J.conflict_rate),
    "conflict_topics": on_traces(J.conflict_topics),
    "bias_pairs": lambda s, d: bias_pairs(s, d).drop("moved"),
    "bias_summary": lambda s, d: J.bias_summary(bias_pairs(s, d)),
    "bias_blame": lambda s, d: J.bias_blame(bias_pairs(s, d)),
    "proposals": on_traces(J.proposals),
    "shadow_plan": shadow_plan,
    "queue_stitch": lambda s, d: _items(s, d).select("run_id", "status", "verdict", "reviewer"),
    "queue_health": lambda s, d: J.queue_health(_items(s, d), F.lit(NOW)),
    "labelled_data": lambda s, d: J.labelled_data(_items(s, d)),
    "review_priority": on_traces(J.review_priority),
    "eval_confusion": eval_confusion,
    "eval_rates": eval_rates,
    "usage_rates": usage_rates,
    "repeat_ratio": on_traces(lambda t: H.repeat_ratio(t, ["ts", "run_id"]).select("run_id", "repeat_ratio")),
    "usage_score": lambda s, d: usage(s, d).select("run_id", T.half_up(F.col("usage_score"), 6).alias("usage_score"), "usage_action"),
    "attempt_number": attempt_number,
    "stream_usage": stream_usage,
    "stream_attempts": stream_attempts,
    "stream_feedback": stream_feedback,
    "stream_stored": stream_stored,
}
_KEYED = f"keyed AS (SELECT thread, array_to_string(list_sort(list_distinct({TOPICS('question')})), ' ') AS key FROM traces)"
_TOPIC = f"topics AS (SELECT *, unnest(list_distinct({TOPICS('question')})) AS topic FROM traces)"
_COUNTS = "counts AS (SELECT topic, count(*) FILTER (WHERE feedback = 'down') AS down, count(*) FILTER (WHERE feedback = 'up') AS up FROM topics WHERE feedback IS NOT NULL GROUP BY topic)"
_CLUSTERS = "most AS (SELECT * FROM counts WHERE down > 0 ORDER BY down DESC, topic LIMIT 20), clusters AS (SELECT topic, down, up, " + up("down / (down + up)", 2) + " AS failure_rate FROM most WHERE down >= 2 ORDER BY down / (down + up) DESC, down DESC, topic LIMIT 5)"
_REPEATED = "most_asked AS (SELECT key, count(*) AS asked FROM keyed WHERE key <> '' GROUP BY key ORDER BY asked DESC, key LIMIT 5)"
_TOP = "by_user AS (SELECT user, sum(tokens)::BIGINT AS tokens FROM traces GROUP BY user), top AS (SELECT user, tokens, " + up("tokens / (SELECT sum(tokens) FROM traces) * 100", 1) + " AS share FROM by_user ORDER BY tokens DESC, user LIMIT 3)"
_SCORE = lambda c: f"floor(greatest((len({c}) % 7)::DOUBLE / 10 * 20, (len({c}) % 7)::DOUBLE / 10 * 100) * 10 + 0.5) / 10"
_BIAS = rf"""swaps AS ({swaps_sql('traces')}),
swapped AS (SELECT s.*, t.question FROM swaps s JOIN traces t USING (run_id)),
scored AS (SELECT *, {_SCORE('question')} AS score_a, {_SCORE('swapped')} AS score_b FROM swapped),
bias AS (SELECT run_id, attribute, a, b, score_a, score_b, CASE WHEN score_a >= 80 THEN 'high_risk' WHEN score_a >= 40 THEN 'cautious' ELSE 'normal' END AS band_a,
  CASE WHEN score_b >= 80 THEN 'high_risk' WHEN score_b >= 40 THEN 'cautious' ELSE 'normal' END AS band_b, floor(abs(score_a - score_b) * 10 + 0.5) / 10 AS gap FROM scored)"""
_HEAD = "head AS (SELECT count(*) AS requests, sum(tokens)::BIGINT AS tokens_total, " + up("sum(tokens) / count(*)", 1) + " AS tokens_per_request, sum(retry_count)::BIGINT AS retries, " + up("count(t2_score) / count(*) * 100", 1) + " AS tier2_rate, count(*) FILTER (WHERE action = 'block' AND t1_out_score IS NULL) AS blocked_before_retrieval FROM traces)"
_RATE = "rate AS (SELECT count(*) AS checked, count(*) FILTER (WHERE sources_disagreed) AS disagreed, " + up("count(*) FILTER (WHERE sources_disagreed) / greatest(count(*), 1)", 2) + " AS rate FROM traces WHERE t2_score IS NOT NULL)"
_HISTORY = "CASE WHEN per_day > 0 THEN greatest(" + ", ".join([_part("per_minute", 1), _part("per_day", 3), _part("tokens_day", 300), "CASE WHEN repeat_ratio > 0.3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"]) + ") ELSE 0.0::DOUBLE END"
SQL = {
    "trace_stitch": sql("SELECT t.run_id, t.user, f.feedback FROM traces t LEFT JOIN (SELECT run_id - run_id % 3 AS r, arg_max(feedback, run_id) AS feedback FROM traces WHERE feedback IS NOT NULL GROUP BY r) f ON f.r = t.run_id"),
    "trace_summary": sql("SELECT count(*) AS rows, count(DISTINCT user) AS users, sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE feedback = 'down') AS thumbs_down, count(*) FILTER (WHERE feedback = 'up') AS thumbs_up, count(t2_score) AS tier2_ran FROM traces"),
    "trace_bands": sql("SELECT t1_in_band, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM traces GROUP BY t1_in_band"),
    "trace_actions": sql("SELECT action, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM traces GROUP BY action"),
    "trace_export": sql("SELECT run_id::VARCHAR AS id, 'request' AS name, question, user, t1_in_band AS band, 0.5::DOUBLE AS detector_pii, 0.25::DOUBLE AS tier2_groundedness, CASE feedback WHEN 'up' THEN 1 WHEN 'down' THEN 0 END AS thumbs FROM traces"),
    "cost_by_user": sql("SELECT * FROM top", _TOP),
    "cost_headline": sql("SELECT * FROM head", _HEAD),
    "topic_counts": sql("SELECT * FROM counts", _TOPIC, _COUNTS),
    "thumbs_clusters": sql("SELECT * FROM clusters", _TOPIC, _COUNTS, _CLUSTERS),
    "repeat_threads": sql("SELECT thread, substr(key, 1, 48) AS topic, count(*) AS asked FROM keyed WHERE key <> '' GROUP BY thread, key HAVING count(*) >= 3", _KEYED),
    "repeat_global": sql("SELECT substr(key, 1, 48) AS topic, asked FROM most_asked WHERE asked >= 3", _KEYED, _REPEATED),
    "conflict_rate": sql("SELECT * FROM rate", _RATE),
    "conflict_topics": sql("SELECT topic, count(*) AS n FROM topics WHERE t2_score IS NOT NULL AND sources_disagreed GROUP BY topic ORDER BY n DESC, topic LIMIT 5", _TOPIC),
    "bias_pairs": sql("SELECT * FROM bias", _BIAS),
    "bias_summary": sql("SELECT count(*) AS pairs_tested, count(*) FILTER (WHERE gap > 0 OR band_a <> band_b) AS pairs_that_differed, coalesce(max(gap), 0.0) AS max_gap, coalesce(" + up("avg(gap)", 2) + ", 0.0) AS mean_gap FROM bias", _BIAS),
    "bias_blame": sql("SELECT 'pii' AS detector, count(*) AS n FROM bias WHERE gap > 0 HAVING count(*) > 0", _BIAS),
    "proposals": sql(
        " UNION ALL ".join(f"SELECT {sql_text(target)} AS target, {subject} AS subject, {figure}::DOUBLE AS figure, {sql_text(J.PLANS[target][0])} AS change, {reason} AS reason, {sql_text(J.PLANS[target][1])} AS risk, {sql_text(J.PLANS[target][2])} AS needs FROM {source}" for target, subject, figure, reason, source in (
            ("usage limits", "user::VARCHAR", "share", "'one user has ' || tokens || ' tokens'", "(SELECT * FROM top ORDER BY tokens DESC, user LIMIT 1) WHERE share > 40"),
            ("retrieval", "'retries'", "retries", "retries || ' retries of ' || requests || ' requests'", "head WHERE retries > greatest(1, requests) * 0.1"),
            ("documents", "topic", "failure_rate", "down || ' down, ' || up || ' up'", "(SELECT * FROM clusters ORDER BY failure_rate DESC, down DESC, topic LIMIT 2) WHERE failure_rate >= 0.6 AND down >= 2"),
            ("cache", "topic", "asked", "'asked ' || asked || ' times'", "(SELECT substr(key, 1, 48) AS topic, asked FROM most_asked WHERE asked >= 3 ORDER BY asked DESC, topic LIMIT 2)"),
            ("source trust", "'conflicts'", "disagreed", "'sources disagreed on ' || disagreed || ' of ' || checked || ' checked answers'", "rate WHERE disagreed > 0"),
        )),
        _TOP, _HEAD, _TOPIC, _COUNTS, _CLUSTERS, _KEYED, _REPEATED, _RATE,
    ),
    "shadow_plan": sql(
        """SELECT floor(bin * 0.1::DOUBLE * 1000000 + 0.5) / 1000000 AS threshold, flagged, false_alarms, misses,
  CASE WHEN false_alarms > fa OR misses > mi THEN 'roll back' WHEN false_alarms < fa OR misses < mi THEN 'enable' ELSE 'as is' END AS outcome FROM plan, (SELECT false_alarms AS fa, misses AS mi FROM plan WHERE bin = 800)""",
        "binned AS (SELECT least(floor(t1_in_score / 0.1::DOUBLE + 1e-6)::BIGINT, 1000) AS cell, feedback FROM traces)",
        """plan AS (SELECT bin, (SELECT count(*) FROM binned WHERE cell >= bin) AS flagged, (SELECT count(*) FROM binned WHERE cell >= bin AND feedback = 'up') AS false_alarms,
  (SELECT count(*) FROM binned WHERE cell < bin AND feedback = 'down') AS misses FROM range(1001) r(bin))""",
    ),
    "queue_stitch": f"WITH {V.REVIEWS} SELECT run_id, status, verdict, reviewer FROM items",
    "queue_health": f"WITH {V.REVIEWS} SELECT count(*) AS queued, count(*) FILTER (WHERE status = 'waiting') AS waiting, count(*) FILTER (WHERE status = 'waiting' AND {NOW} > due_at) AS overdue, count(*) FILTER (WHERE status = 'reviewed') AS reviewed, "
    + up("count(*) FILTER (WHERE verdict = 'over_flagged') / count(*) FILTER (WHERE status = 'reviewed')", 2) + " AS over_flag_rate FROM items",
    "labelled_data": f"WITH {V.REVIEWS} SELECT run_id, question AS text, answer, machine_action, verdict AS human_verdict, CASE verdict " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in L.LESSONS.items()) + " END AS lesson FROM items WHERE status = 'reviewed'",
    "review_priority": sql("SELECT run_id, substr(question, 1, 60) AS question, t1_in_score AS machine_score, action, " + up("CASE WHEN action IN ('allow', 'auto_fix') THEN t1_in_score ELSE t1_in_score / 2 END", 1) + " AS priority FROM traces WHERE feedback = 'down'"),
    "usage_rates": sql("SELECT * FROM rates", _RATES),
    "repeat_ratio": sql("SELECT * FROM repeats", _REPEAT),
    "usage_score": sql("SELECT run_id, floor(s * 1000000 + 0.5) / 1000000 AS usage_score, CASE WHEN s >= 0.8 THEN 'block' WHEN s >= 0.4 THEN 'throttle' ELSE 'allow' END AS usage_action FROM (SELECT run_id, " + _HISTORY + " AS s FROM rates JOIN repeats USING (run_id))", _RATES, _REPEAT),
}
SQL["attempt_number"] = f"WITH {V.TRACES}, {_ATTEMPTS}"
_listed = lambda places: ", ".join(map(str, places))
_CASES = f"""WITH {V.REQUESTS}, p AS ({TQ.SQL['injection_phrase_score']}), i AS ({TQ.SQL['injection_structure_score']}),
told AS (SELECT (run_id // 1000 * 31 + run_id % 1000) % {len(V.PLANTS)} AS place, greatest(p.score, i.score) AS score FROM requests JOIN p USING (run_id) JOIN i USING (run_id)),
cases AS (SELECT CASE WHEN place IN ({_listed(V.ATTACKS)}) THEN 'attack' WHEN place IN ({_listed(V.TRICKY)}) THEN 'tricky' ELSE 'safe' END AS label,
  CASE WHEN score >= 0.7 THEN 'block' WHEN score >= 0.4 THEN 'suspicious' ELSE 'allow' END AS band FROM told)"""
SQL["eval_confusion"] = f"""{_CASES} SELECT label, count(*) FILTER (WHERE band = 'allow') AS allow, count(*) FILTER (WHERE band = 'suspicious') AS suspicious, count(*) FILTER (WHERE band = 'block') AS block FROM cases GROUP BY label"""
SQL["eval_rates"] = f"""{_CASES}, n AS (SELECT count(*) AS cases, count(*) FILTER (WHERE label <> 'attack') AS legitimate, count(*) FILTER (WHERE label = 'attack') AS attacks,
  count(*) FILTER (WHERE label <> 'attack' AND band = 'block') AS false_alarms, count(*) FILTER (WHERE label = 'attack' AND band = 'allow') AS missed FROM cases)
SELECT *, {up("false_alarms / greatest(legitimate, 1)", 3)} AS false_alarm_rate, {up("missed / greatest(attacks, 1)", 3)} AS miss_rate FROM n"""
_DAY = "OVER (PARTITION BY user ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)"
SQL["stream_usage"] = f"""WITH e AS (SELECT event_id AS run_id, user_id AS user, epoch_us(ts) AS us, floor(value)::BIGINT AS tokens FROM events)
SELECT run_id, user, count(*) OVER (PARTITION BY user ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING) AS per_minute, count(*) {_DAY} AS per_day, coalesce(sum(tokens) {_DAY}, 0)::BIGINT AS tokens_day FROM e"""
SQL["stream_feedback"] = SQL["stream_stored"] = SQL["trace_stitch"]
SQL["stream_attempts"] = """WITH e AS (SELECT event_id AS run_id, user_id * 1000 + dayofyear(ts) AS thread, event_type = 'click' AS pushed_back, CASE event_type WHEN 'error' THEN 'down' WHEN 'purchase' THEN 'up' END AS feedback FROM events),
a AS (SELECT *, pushed_back OR coalesce(last_value(feedback IGNORE NULLS) OVER (PARTITION BY thread ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'down', false) AS again,
        coalesce(lag(feedback) OVER (PARTITION BY thread ORDER BY run_id) = 'up', false) AS settled FROM e),
g AS (SELECT *, count(*) FILTER (WHERE NOT again OR settled) OVER (PARTITION BY thread ORDER BY run_id) AS island FROM a)
SELECT run_id, thread, 1 + count(*) FILTER (WHERE again) OVER (PARTITION BY thread, island ORDER BY run_id) AS attempt FROM g"""
