"""Queries on detectors that need examples or a corpus, on evidence, on answers, and on whole requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import classifier as C
from ..operators import detectors as D
from ..operators import encoder as EN
from ..operators import evidence as E
from ..operators import history as H
from ..operators import retrieval as RE
from ..operators import rewrite as R
from ..operators import vectors as VE
from ..operators import verify as Y
from ..tables import dealt, kept, scoped, spread
from . import text_queries as TQ
from . import views as V
from .views import grams_sql, sql_list, sql_text, weights_sql

#: The similarities of a question to its best piece, of pieces on one topic, and of a question with unknown words to its nearest passage, that the test tables' drawn prose reaches; the defaults never fire on it.
FLOOR, TOPIC_NEAR, SCOPE = 0.04, 0.05, 0.06
PARTLY = "Parts of this answer could not be checked."

# --- TF-IDF ---


def _texts(r):
    return r.select(F.col("run_id").alias("id"), F.col("question").alias("text"))


def _closest(spark, sf_dir, k, asked=None):
    """The corpus, and the k nearest passages of each request, or of those asked: query_id, item_id, sim, rank."""
    c = V.corpus(spark, sf_dir)
    queries, items = VE.between(_texts(V.requests(spark, sf_dir) if asked is None else asked), spread(c.select("id", "text")))
    return c, RE.top_items(queries, items, k).drop("side")


def tfidf_vocab(spark, sf_dir):
    return VE.vocabulary(V.corpus(spark, sf_dir).select("id", "text")).select("term", "df", T.half_up(F.col("idf"), 6).alias("idf"))


@scoped
def tfidf_topk(spark, sf_dir):
    top = _closest(spark, sf_dir, 3)[1]
    return top.select("query_id", "item_id", "rank", T.half_up(F.col("sim"), 6).alias("sim"))


def _sides(spark, sf_dir, rows=None, text="question"):
    """Requests, or other rows (run_id, ...), with their similarity to the nearest risky and calm example."""
    ex = V.examples(spark, sf_dir)
    rows = (V.requests(spark, sf_dir) if rows is None else rows).withColumn("id", F.col("run_id"))
    best = RE.top_items(*VE.between(rows.select("id", F.col(text).alias("text")), ex.select("id", "side", "text")), 1)
    return VE.two_sided(rows, best, ex.select(F.col("id").alias("item_id"), "category"), "risky", "calm")


def _near(spark, sf_dir, rows=None, text="question"):
    """_sides with what they say of unsafe intent and high stakes."""
    near = [F.col(c) for c in ("risky_sim", "calm_sim", "risky_category", text)]
    return _sides(spark, sf_dir, rows, text).withColumns({"unsafe": D.unsafe_intent(*near, L.UNSAFE_CUTS["tfidf"]), "stakes": D.high_stakes(*near, L.STAKES_CUTS["tfidf"])})


@scoped
def unsafe_intent(spark, sf_dir):
    return _near(spark, sf_dir).select("run_id", T.half_up(F.col("risky_sim"), 6).alias("unsafe_sim"), T.half_up(F.col("calm_sim"), 6).alias("safe_sim"), "unsafe.score", "unsafe.category", "unsafe.action")


@scoped
def stakes(spark, sf_dir):
    return _near(spark, sf_dir).select("run_id", "stakes.score", "stakes.category", "stakes.strict_mode")


@scoped
def two_set_nn_dense(spark, sf_dir):
    """Each twentieth vector's nearest neighbour by cosine on either side, labels 0 to 4 against 5 to 9; queries are a stated set, candidates all others."""
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") < 5).alias("side"), VE.unit(F.col("embedding")).alias("v"))
    best = EN.nearest(e.where("id % 20 = 0").select("id", "v"), e, others=True)
    return best.select("query_id", F.col("side").alias("low"), F.col("item_id").alias("vec_id"), "sim")


@scoped
def encoder_projection(spark, sf_dir):
    """Examples, projected by their terms' signs: what the dense encoder is fitted from."""
    vocab, items = VE.fit(V.examples(spark, sf_dir))
    each = EN.projected(items, vocab).select("id", F.posexplode("parts").alias("k", "x"))
    return each.select("id", "k", T.half_up(F.col("x"), 6).alias("x"))


@scoped
def intent_dense(spark, sf_dir):
    """Unsafe intent and high stakes of requests by the dense encoder, fitted on all examples, with its own cut-offs."""
    ex, r = V.examples(spark, sf_dir), V.requests(spark, sf_dir).withColumn("id", F.col("run_id"))
    dense = EN.encoded_texts(ex.select("id", "text"), r.select("id", F.col("question").alias("text")))
    best = EN.nearest(dense.where("asked").select("id", "v"), dense.where("not asked").select("id", "v").join(ex.select("id", "side"), "id"))
    near = VE.two_sided(r, best, ex.select(F.col("id").alias("item_id"), "category"), "risky", "calm")
    told = [F.col(c) for c in ("risky_sim", "calm_sim", "risky_category", "question")]
    near = near.withColumns({"u": D.unsafe_intent(*told, L.UNSAFE_CUTS["dense"]), "h": D.high_stakes(*told, L.STAKES_CUTS["dense"])})
    return near.select("run_id", "risky_sim", "calm_sim", F.col("u.score").alias("unsafe_score"), "u.category", "u.action", F.col("h.score").alias("stakes_score"), "h.strict_mode")


def _toxic_model(spark, sf_dir):
    """Labelled documents (doc_id, text, label, held_out) and a model of those that are not held out."""
    d = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    d = d.select("doc_id", "text", (F.col("toxic") == 1).alias("label"), held.alias("held_out"))
    return d, kept(C.fit(d.where("not held_out")))


@scoped
def toxic_learned(spark, sf_dir):
    """Labelled documents, scored by a classifier that four fifths of them have taught."""
    d, model = _toxic_model(spark, sf_dir)
    told = C.scored(d, model)
    return told.select("doc_id", "held_out", T.half_up(F.col("learned"), 6).alias("score"), (F.col("learned") >= 0.5).alias("predicted"))


@scoped
def injection_layered(spark, sf_dir):
    """Requests by all three layers of injection, with the classifier of toxic_learned in the third one's slot."""
    r = C.scored(V.requests(spark, sf_dir), _toxic_model(spark, sf_dir)[1], "question")
    told = r.select("run_id", "learned", D.injection(F.col("question"), F.col("format_given"), C.layer(F.col("learned"))).alias("i"))
    return told.select("run_id", T.half_up(C.layer(F.col("learned")), 2).alias("classifier"), T.half_up(F.col("i.score"), 2).alias("score"), "i.band", "i.phrase")


def tfidf_sql(corpus_cte: str, corpus: str, asked: str = "requests", text: str = "question") -> str:
    return f"""{corpus_cte}, {grams_sql('cg', corpus, 'id', 'text')}, {grams_sql('qg', asked, 'run_id', text)},
vocab AS (SELECT term, count(DISTINCT id) AS df, ln((1 + (SELECT count(*) FROM {corpus}))::DOUBLE / (1 + count(DISTINCT id))) + 1 AS idf FROM cg GROUP BY term),
cw AS ({weights_sql('cg')}), qw AS ({weights_sql('qg')}),
sims AS (SELECT q.id AS query_id, c.id AS item_id, sum(q.w * c.w) AS sim FROM qw q JOIN cw c USING (term) GROUP BY ALL)"""


def sides_sql(asked: str = "requests", text: str = "question") -> str:
    """CTEs sides, unsafe (run_id, u, s, score, kind, action) and stakes (run_id, score, kind) of a CTE's rows."""
    listed = lambda words: f"len(list_filter({sql_list(words)}, lambda k: contains(lower({text}), k))) > 0"
    return f"""{tfidf_sql(V.EXAMPLES, 'examples', asked, text)},
near AS (SELECT query_id, side, max(struct_pack(s := floor(sim * 1e9), i := -item_id, sim := sim, category := category)) AS b FROM sims JOIN examples ON id = item_id GROUP BY ALL),
sides AS (SELECT r.run_id, r.{text}, coalesce(u.b.sim, 0) AS u, coalesce(s.b.sim, 0) AS s, u.b.category AS category FROM {asked} r LEFT JOIN near u ON u.query_id = r.run_id AND u.side = 'risky' LEFT JOIN near s ON s.query_id = r.run_id AND s.side = 'calm'),
ub AS (SELECT *, (CASE WHEN u < 0.16 THEN 0 WHEN s >= u THEN 0.1 WHEN u - s >= 0.1 AND u >= 0.3 THEN 0.85 WHEN u - s >= 0.04 THEN 0.6 ELSE 0.4 END)::DOUBLE AS base, CASE WHEN u >= 0.16 AND s < u THEN category END AS kind FROM sides),
un AS (SELECT *, CASE WHEN base >= 0.3 AND {listed(L.UNSAFE_KEYWORDS)} THEN greatest(base, 0.45::DOUBLE) ELSE base END AS score FROM ub),
unsafe AS (SELECT run_id, u, s, score, kind, CASE WHEN kind = 'self_harm' AND score >= 0.4 THEN 'care' WHEN kind = 'harassment' AND score >= 0.8 THEN 'block_and_route_hr' WHEN kind IS NOT NULL AND score >= 0.8 THEN 'block' ELSE 'allow' END AS action FROM un),
sb AS (SELECT *, (CASE WHEN u < 0.14 OR s >= u THEN 0 WHEN u - s >= 0.03 AND u >= 0.26 THEN 0.65 WHEN u - s >= 0.03 THEN 0.45 ELSE 0.25 END)::DOUBLE AS base, CASE WHEN u >= 0.14 AND s < u THEN category END AS kind FROM sides),
stakes AS (SELECT run_id, CASE WHEN base >= 0.2 AND {listed(L.ESCALATORS)} THEN least(0.65::DOUBLE, base + 0.2::DOUBLE) ELSE base END AS score, kind FROM sb)"""


_SIDES = f"WITH {V.REQUESTS}, {sides_sql()}"

# --- evidence ---


def scope_missing_terms(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return E.missing_terms(r.select(F.col("run_id").alias("id"), "question"), V.corpus(spark, sf_dir)).select("id", F.array_join("missing", " ").alias("missing"))


@scoped
def rerank_boosted(spark, sf_dir):
    c, near = _closest(spark, sf_dir, L.FETCH)
    wide = near.join(c.select(F.col("id").alias("item_id"), "source_type", "year"), "item_id")
    return E.rerank(wide).select("query_id", "item_id", "place", "rerank_score")


def _questions(spark, sf_dir):
    return V.requests(spark, sf_dir).select(F.col("run_id").alias("id"), "question")


@scoped
def conflict_groups(spark, sf_dir):
    """The figures that the pieces retrieved for a request state on one topic, where they differ, and which of them holds."""
    c = V.corpus(spark, sf_dir)
    pieces, _, items = E.pieces_for(_questions(spark, sf_dir), c, floor=FLOOR)
    return E.fights(pieces, items, c, TOPIC_NEAR).select("query_id", "resolved", "reason", "winner_id", F.array_join(F.transform("loser_ids", lambda x: x.cast("string")), ",").alias("losers"))


def _pack(spark, sf_dir, build=E.build):
    return build(_questions(spark, sf_dir), V.corpus(spark, sf_dir), floor=FLOOR, topic_near=TOPIC_NEAR, scope=SCOPE)


def evidence_pack(spark, sf_dir):
    """Each request's evidence, its texts on lines of their own, and the words that the corpus lacks."""
    return _pack(spark, sf_dir).select("id", F.array_join("evidence", "\n").alias("evidence"), "no_evidence", "sources_disagreed", F.array_join("missing", " ").alias("missing"))


@scoped
def near_dup_leaders(spark, sf_dir):
    """For each request's 25 nearest passages, how many remain once near duplicates are gone."""
    asked, shared, items = VE.between(_texts(V.requests(spark, sf_dir)), spread(V.corpus(spark, sf_dir).select("id", "text")), whole=True)
    near = RE.top_items(asked, shared, L.FETCH).drop("side")
    return E.without_duplicates(E.packed(near, items, "rank", L.DUPLICATE)).select("query_id", F.size("pieces").alias("kept"), "dropped")


def _asked(spark, sf_dir):
    """Traces as questions to a cache: id, at, question in three spellings, version of the documents at that time, and whether their answer may be stored."""
    t = V.traces(spark, sf_dir)
    version = F.concat(F.lit("v"), F.floor(F.dayofmonth("ts") / 10).cast("string"))
    may = H.storable(F.size(D.pii_findings(F.col("question"))) > 0, F.col("action") == "allow", F.col("feedback"))
    return t.select(F.col("run_id").alias("id"), H.micros(F.col("ts")).alias("at"), V.spelled(F.col("question"), F.col("run_id")).alias("question"), version.alias("version"), may.alias("may"))


@scoped
def cache_lookup_asof(spark, sf_dir):
    """Traces against the cached answers of those before them."""
    asked = _asked(spark, sf_dir)
    return H.cached_answers(asked.drop("may"), asked.where("may").select(F.col("id").alias("entry_id"), "at", "question", "version"))


# --- answers ---


def _evidence():
    return F.create_map(*(F.lit(x) for pair in V.EVIDENCE.items() for x in pair))


def _checked(spark, sf_dir):
    a = V.answers(spark, sf_dir).withColumn("claims", Y.judged_claims(F.col("answer"), _evidence()))
    return a.withColumn("g", Y.groundedness(F.col("claims"))).withColumn("c", Y.consistency(F.col("answer"), F.col("other"))).withColumn("s", Y.output_safety(F.col("answer"), F.col("strict")))


def groundedness(spark, sf_dir):
    return _checked(spark, sf_dir).select("run_id", "g.score", "g.claims", "g.supported", "g.unsure", "g.unsupported")


def self_consistency(spark, sf_dir):
    return _checked(spark, sf_dir).select("run_id", "c.score", "c.similarity", "c.facts_checked", F.array_join("c.conflicts", ",").alias("conflicts"))


def output_safety(spark, sf_dir):
    return _checked(spark, sf_dir).select("run_id", "s.score", F.array_join(F.transform("s.flags", lambda f: F.concat_ws(":", f["kind"], f["text"])), "|").alias("flags"))


def full_scan(spark, sf_dir, rows=None):
    """Requests, or some of them, with all five detectors of the first tier."""
    return D.scan(_near(spark, sf_dir, rows), "question", format_given=F.col("format_given"), unsafe=F.col("unsafe"), stakes=F.col("stakes"))


def _decided(spark, sf_dir):
    """Answers with their checks, the first tier's scan of the turn before them, and the decision."""
    a = _checked(spark, sf_dir).withColumn("t2", Y.tier2(F.col("g.score"), F.when(F.col("strict"), F.col("c.score")), F.col("s.score")))
    sure = D.certain({k: F.col(f"{k}.score") for k in ("injection", "unsafe", "pii", "usage")})
    before = V.answers(spark, sf_dir).select((F.col("run_id") - 1).alias("run_id"))
    asked = full_scan(spark, sf_dir, V.requests(spark, sf_dir).join(before, "run_id", "left_semi")).select((F.col("run_id") + 1).alias("run_id"), F.col("t1.risk_score").alias("t1_score"), F.col("t1.action").alias("t1_action"), sure.alias("t1_sure"))
    a = a.join(asked, "run_id", "left").fillna({"t1_score": 0.0, "t1_action": "allow", "t1_sure": False})
    retries = (F.col("run_id") % 2).cast("int")
    a = a.withColumn("d", Y.decision(F.col("t1_score"), F.col("t1_action"), F.col("t1_sure"), F.col("t2.risk_score"), F.col("g.unsupported"), retries, F.col("strict")))
    a = a.withColumns({"trust_label": Y.trust_label(F.col("d.action"), F.col("g.claims"), F.col("g.unsure"), F.col("g.unsupported")), "route": Y.decision_route(F.col("d.action"), retries)})
    return a


@scoped
def decided(spark, sf_dir):
    """Answers, decided by their checks and the first tier's scan of the turn before them."""
    a = _decided(spark, sf_dir)
    return a.select("run_id", F.col("t2.risk_score").alias("t2_score"), F.col("t2.weighted").alias("weighted"), F.array_join("t2.ran", ",").alias("ran"), F.col("d.action").alias("action"), F.col("d.severity").alias("severity"), F.col("d.confident").alias("confident"), "trust_label", "route")


@scoped
def retried(spark, sf_dir):
    """Decided answers, with those that were sent back answered and decided anew from the evidence for the turn before them."""
    a = kept(_decided(spark, sf_dir).select("run_id", "answer", "trust_label", "t1_score", "t1_action", "t1_sure", F.col("d.action").alias("action")))
    back = a.where("action = 'retry'").select("run_id", "t1_score", "t1_action", "t1_sure")
    asked = _with_evidence(spark, sf_dir, back.select((F.col("run_id") - 1).alias("run_id"))).select((F.col("run_id") + 1).alias("run_id"), "question", "evidence")
    again = R.second_pass(back.join(asked, "run_id", "left"))
    told = lambda df, fresh: df.select("run_id", F.lit(fresh).alias("regenerated"), "action", "trust_label", "answer")
    return told(a.where("action <> 'retry'"), False).unionByName(told(again, True))


@scoped
def tier1_full(spark, sf_dir):
    return full_scan(spark, sf_dir).select("run_id", "t1.risk_score", "t1.weighted", "t1.solo", "t1.band", "t1.action", "t1.strict_mode")


@scoped
def tier1_output(spark, sf_dir):
    """Answers, scanned in output mode, and whether they go on to the deep checks."""
    s = D.scan(_near(spark, sf_dir, V.answers(spark, sf_dir), "answer"), "answer", "output", unsafe=F.col("unsafe"))
    return s.select("run_id", "t1.risk_score", "t1.band", "t1.action", D.deep_check_route(F.col("strict"), F.col("t1.band")).alias("route"))


@scoped
def request_route(spark, sf_dir):
    """Where requests go after the cache, and those that miss it after the evidence."""
    r = V.requests(spark, sf_dir).select(F.col("run_id").alias("id"), F.col("run_id").alias("at"), "question", F.lit("v1").alias("version"))
    hits = H.cached_answers(r, r.withColumnRenamed("id", "entry_id"), slot=1_000_000)
    cached = hits.select("id", D.cache_route(F.col("hit")).alias("cache"))
    evidence = _pack(spark, sf_dir, E.chosen).select("id", D.evidence_route(F.col("item_ids").cast("array<string>")).alias("evidence"))
    return cached.join(evidence, "id").select("id", "cache", F.when(F.col("cache") == "miss", F.col("evidence")).alias("evidence"))


def judge_udf_slot(spark, sf_dir):
    """Claims that words cannot settle, settled by a judge in the slot; others keep their verdict."""
    each = _checked(spark, sf_dir).select("run_id", F.posexplode("claims").alias("k", "c"))
    judge = Y.judge_slot(lambda claim, cited: "supported" if set(claim.lower().split()) & set(cited.lower().split()) else "not_supported")
    unsure = each.where(F.col("c.verdict") == "unsure").select("run_id", "k", judge(F.col("c.text"), F.lit(" ".join(V.EVIDENCE.values()))).alias("verdict"))
    return each.where(F.col("c.verdict") != "unsure").select("run_id", "k", F.col("c.verdict").alias("verdict")).unionByName(unsure)


def fuzzy_leak(spark, sf_dir):
    """How much each planted sentence resembles the next one: a held-out set must stay below 0.75."""
    rows = spark.createDataFrame(list(zip(range(len(V.PLANTS)), V.PLANTS, V.PLANTS[1:] + V.PLANTS[:1], strict=True)), "k int, a string, b string")
    return rows.select("k", Y.fuzzy_ratio()(F.col("a"), F.col("b")).alias("ratio"))


def _with_evidence(spark, sf_dir, asked=None):
    """Requests (run_id, question, strict), or those whose run_id is asked for, with the texts of their three nearest passages, nearest first."""
    r = V.requests(spark, sf_dir).select("run_id", "question", (F.col("thread") % 2 == 0).alias("strict"))
    r = r if asked is None else r.join(asked, "run_id", "left_semi")
    c, near = _closest(spark, sf_dir, 3, r)
    near = near.hint("shuffle_hash").join(c.select(F.col("id").alias("item_id"), "text"), "item_id")  # texts aren't sorted, and so don't spill
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    told = near.groupBy(F.col("query_id").alias("run_id")).agg(F.transform(ranked, lambda x: x["text"]).alias("evidence"))
    return r.join(told, "run_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


@scoped
def extract_answers(spark, sf_dir):
    """Answers drawn from the sentences of each request's three nearest passages."""
    return _with_evidence(spark, sf_dir).select("run_id", Y.extract_answer(F.col("question"), F.col("evidence")).alias("answer"))


@scoped
def generate_answers(spark, sf_dir):
    """Answers of the model that needs none, with their citations checked; requests of even threads are strict."""
    told = R.generate(_with_evidence(spark, sf_dir))
    return told.select("run_id", "strict", "answer", "temperature", F.array_join("untagged", "|").alias("untagged"), "citations_ok", "reprompted", "calls")


@scoped
def delivered(spark, sf_dir):
    """The text that each decided answer is delivered as, with a reference id where it is withheld."""
    a = decided(spark, sf_dir).join(V.answers(spark, sf_dir).select("run_id", "answer"), "run_id")
    ref = Y.short_ref(F.substring(F.md5(F.col("run_id").cast("string")), 1, 12))
    caveat = F.when(F.col("trust_label") == "partly verified", PARTLY)
    return a.select("run_id", "action", ref.alias("ref"), Y.message(F.col("action"), F.col("answer"), caveat, ref).alias("message"))


# --- whole requests ---


def tier1_scan(spark, sf_dir):
    s = D.scan(dealt(V.requests(spark, sf_dir).select("run_id", "question", "format_given")), "question", format_given=F.col("format_given"))
    return s.select("run_id", "t1.risk_score", "t1.weighted", "t1.band", "t1.action", "t1.strict_mode", D.route(F.col("t1")).alias("route"), D.effective_action(F.col("t1")).alias("effective_action"), F.array_join("t1.reasons", ",").alias("reasons"))


def risk_overview(spark, sf_dir):
    """Requests by band and action."""
    s = D.scan(dealt(V.requests(spark, sf_dir).select("question", "format_given")), "question", format_given=F.col("format_given"))
    return s.groupBy("t1.band", "t1.action").agg(F.count("*").alias("n"), T.half_up(F.avg("t1.risk_score"), 6).alias("mean_score"))


_USAGE = f"CASE WHEN len(question) > 20000 THEN 0.85 WHEN len(question) > 4000 THEN 0.35 + 0.3 * least(1.0::DOUBLE, (len(question) - 4000) / 4000) ELSE 0 END"
_SCAN = f"""{TQ._pii_sql('input', V.REQUESTS, TQ.pii_texts(TQ.REQUEST_TEXTS))}, p AS ({TQ.SQL['injection_phrase_score']}), i AS ({TQ.SQL['injection_structure_score']}), f AS (SELECT run_id, max(score) AS score, max(CASE action WHEN 'mask' THEN 1 ELSE 0 END) AS rank FROM found GROUP BY run_id),
scores AS (SELECT r.run_id, greatest(p.score, i.score) AS inj, coalesce(f.score, 0.0::DOUBLE) AS pii, coalesce(f.rank, 0) AS rank, ({_USAGE})::DOUBLE AS usage FROM requests r JOIN p USING (run_id) JOIN i USING (run_id) LEFT JOIN f USING (run_id)),
fused AS (SELECT *, least(100.0::DOUBLE, inj * 40 + pii * 20 + usage * 20) AS weighted, greatest(inj * 100, pii * 100, usage * 100) AS solo FROM scores),
t1 AS (SELECT *, floor(greatest(weighted, solo) * 10 + 0.5) / 10 AS risk_score, CASE WHEN greatest(weighted, solo) >= 80 THEN 'high_risk' WHEN greatest(weighted, solo) >= 40 THEN 'cautious' ELSE 'normal' END AS band,
  CASE WHEN usage >= 0.8 THEN 'block' WHEN usage >= 0.4 THEN 'throttle' WHEN rank = 1 THEN 'mask' ELSE 'allow' END AS action FROM fused)"""
_FULL = f"""{_SCAN}, {sides_sql()},
full0 AS (SELECT c.*, n.score AS uns, n.action AS unsafe_action, k.score AS sta FROM scores c JOIN unsafe n USING (run_id) JOIN stakes k USING (run_id)),
full2 AS (SELECT *, least(100.0::DOUBLE, inj * 40 + uns * 40 + pii * 20 + sta * 20 + usage * 20) AS weighted, greatest(inj * 100, uns * 100, pii * 100, usage * 100) AS solo FROM full0),
full3 AS (SELECT *, floor(greatest(weighted, solo) * 10 + 0.5) / 10 AS risk_score, CASE WHEN greatest(weighted, solo) >= 80 THEN 'high_risk' WHEN greatest(weighted, solo) >= 40 THEN 'cautious' ELSE 'normal' END AS band FROM full2),
full1 AS (SELECT *, CASE WHEN unsafe_action = 'block' OR usage >= 0.8 THEN 'block' WHEN unsafe_action <> 'allow' THEN unsafe_action WHEN usage >= 0.4 THEN 'throttle' WHEN rank = 1 THEN 'mask' ELSE 'allow' END AS action,
  sta >= 0.4 OR band <> 'normal' AS strict_mode, greatest(inj, uns, pii, usage) >= 0.8 AS sure FROM full3)"""
_ACTIONS = "CASE max(CASE action WHEN 'block' THEN 5 WHEN 'redact' THEN 2 WHEN 'mask' THEN 1 ELSE 0 END) WHEN 5 THEN 'block' WHEN 2 THEN 'redact' WHEN 1 THEN 'mask' ELSE 'allow' END"
_OUTPUT = f"""{TQ._pii_sql('output', V.ANSWERS, TQ.pii_texts(f"SELECT run_id, {TQ._asciied('answer')} AS text FROM answers"))}, {sides_sql('answers', 'answer')},
f AS (SELECT run_id, max(score) AS score, {_ACTIONS} AS action FROM found GROUP BY run_id),
out0 AS (SELECT a.run_id, a.strict, n.score AS uns, n.action AS unsafe_action, coalesce(f.score, 0.0::DOUBLE) AS pii, coalesce(f.action, 'allow') AS pii_action FROM answers a JOIN unsafe n USING (run_id) LEFT JOIN f USING (run_id)),
out2 AS (SELECT *, greatest(least(100.0::DOUBLE, uns * 40 + pii * 20), uns * 100, pii * 100) AS final FROM out0),
out1 AS (SELECT run_id, strict, floor(final * 10 + 0.5) / 10 AS risk_score, CASE WHEN final >= 80 THEN 'high_risk' WHEN final >= 40 THEN 'cautious' ELSE 'normal' END AS band,
  CASE WHEN unsafe_action = 'block' OR pii_action = 'block' THEN 'block' WHEN unsafe_action <> 'allow' THEN unsafe_action ELSE pii_action END AS action FROM out2)"""
_GROUND = f"""WITH {V.ANSWERS}, evidence(tag, text) AS (VALUES {', '.join(f'({sql_text(k)}, {sql_text(v)})' for k, v in V.EVIDENCE.items())}),
{TQ.claims_sql('answers', 'run_id', 'answer')},
cited AS (SELECT run_id, k, text, tags, trim(coalesce((SELECT string_agg(coalesce(e.text, ''), chr(10) ORDER BY t.i) FROM (SELECT unnest(tags) AS tag, generate_subscripts(tags, 1) AS i) t LEFT JOIN evidence e USING (tag)), '')) AS cited FROM claims),
words AS (SELECT *, {TQ.CONTENT('text')} AS cw, {TQ.CONTENT('cited')} AS ew, {TQ.NUMBERS('text')} AS cn, {TQ.NUMBERS('cited')} AS en FROM cited),
judged AS (SELECT run_id, CASE WHEN len(tags) = 0 THEN 'no_source' WHEN cited = '' THEN 'bad_tag' WHEN len(list_filter(cn, lambda n: NOT list_contains(en, n))) > 0 THEN 'not_supported'
  WHEN len(cw) > 0 AND len(list_intersect(cw, ew)) / len(cw) >= 0.6 THEN 'supported' ELSE 'unsure' END AS verdict FROM words),
ground AS (SELECT a.run_id, count(verdict)::INT AS claims, count(*) FILTER (WHERE verdict = 'supported')::INT AS supported, count(*) FILTER (WHERE verdict = 'unsure')::INT AS unsure,
  count(*) FILTER (WHERE verdict IN ('no_source', 'bad_tag', 'not_supported'))::INT AS unsupported FROM answers a LEFT JOIN judged USING (run_id) GROUP BY a.run_id),
grounded AS (SELECT *, CASE WHEN claims > 0 THEN floor(least(1.0::DOUBLE, (unsupported + 0.4::DOUBLE * unsure) / claims) * 100 + 0.5) / 100 ELSE 0.0::DOUBLE END AS score FROM ground)"""
_differ = lambda x, y: f"(len(list_filter({x}, lambda v: NOT list_contains({y}, v))) + len(list_filter({y}, lambda v: NOT list_contains({x}, v))) > 0)"
_CONSISTENT = f"""facts AS (SELECT run_id, strict, {TQ.NUMBERS('answer')} AS na, {TQ.NUMBERS('other')} AS nb, {TQ.DURATIONS('answer')} AS da, {TQ.DURATIONS('other')} AS db, {TQ.CONTENT('answer')} AS wa, {TQ.CONTENT('other')} AS wb FROM answers),
told AS (SELECT run_id, strict, {_differ('na', 'nb')} AS n, {_differ('da', 'db')} AS d, len(list_distinct(na || nb)) + len(list_distinct(da || db)) AS checked, CASE WHEN len(list_distinct(wa || wb)) > 0 THEN len(list_intersect(wa, wb)) / len(list_distinct(wa || wb)) ELSE 1.0::DOUBLE END AS alike FROM facts),
consistent AS (SELECT run_id, (CASE WHEN n OR d THEN 0.85 WHEN checked >= 2 THEN 0 WHEN alike < 0.2 THEN 0.55 ELSE 0 END)::DOUBLE AS score, floor(alike * 100 + 0.5) / 100 AS similarity, checked::INT AS facts_checked, concat_ws(',', CASE WHEN n THEN 'numbers' END, CASE WHEN d THEN 'durations' END) AS conflicts FROM told)"""
_U, _A, _O = rf"(?i)\b(?:{L.GROUPS})\b\s+(?:{L.SWEEPS})\b".replace("'", "''"), rf"(?i)\b(?:{L.UNSAFE_ADVICE})\b", rf"(?i)\b(?:{L.OVERCLAIMS})\b"
_SAFE = f"""safe AS (SELECT run_id, greatest(CASE WHEN regexp_matches(answer, '{_U}') THEN 0.8 ELSE 0 END, CASE WHEN regexp_matches(answer, '{_A}') THEN 0.9 ELSE 0 END, CASE WHEN regexp_matches(answer, '{_O}') THEN CASE WHEN strict THEN 0.55 ELSE 0.3 END ELSE 0 END)::DOUBLE AS score,
  array_to_string(list_concat(list_transform(regexp_extract_all(answer, '{_U}'), lambda m: 'unfair_generalisation:' || m), list_transform(regexp_extract_all(answer, '{_A}'), lambda m: 'unsafe_advice:' || m), list_transform(regexp_extract_all(answer, '{_O}'), lambda m: 'overclaim:' || m)), '|') AS flags FROM answers)"""
_DECIDED = f"""{_FULL}, {_GROUND.removeprefix('WITH ')}, {_CONSISTENT}, {_SAFE},
t2 AS (SELECT g.run_id, g.claims, g.unsure, g.unsupported, a.strict, CASE WHEN a.strict THEN (g.score * 50 + c.score * 30 + s.score * 20) / 100 * 100 ELSE (g.score * 50 + s.score * 20) / 70 * 100 END AS w,
  greatest(g.score * 100, CASE WHEN a.strict THEN c.score * 100 ELSE 0 END, s.score * 100) AS solo FROM grounded g JOIN consistent c USING (run_id) JOIN safe s USING (run_id) JOIN answers a USING (run_id)),
x AS (SELECT t2.*, floor(greatest(w, t2.solo) * 10 + 0.5) / 10 AS t2_score, floor(w * 10 + 0.5) / 10 AS weighted, coalesce(q.risk_score, 0.0::DOUBLE) AS t1, coalesce(q.action, 'allow') AS t1_action, coalesce(q.sure, false) AS t1_sure FROM t2 LEFT JOIN (SELECT run_id + 1 AS run_id, risk_score, action, sure FROM full1) q USING (run_id)),
y AS (SELECT *, greatest(t1, t2_score) AS sev, greatest(t1, t2_score) >= 80 OR t1_sure AS confident FROM x),
z AS (SELECT *, CASE WHEN t1_action IN ('block', 'block_and_route_hr', 'care') THEN t1_action WHEN unsupported > 0 AND run_id % 2 = 0 THEN 'retry' WHEN unsupported > 0 THEN 'abstain' WHEN sev >= 80 AND confident THEN 'block'
  WHEN sev >= 40 AND NOT confident THEN CASE WHEN strict THEN 'escalate' ELSE 'allow_with_note' END WHEN sev >= 40 THEN CASE WHEN strict THEN 'escalate' ELSE 'auto_fix' END ELSE 'allow' END AS action FROM y)"""

QUERIES = {
    "risk_overview": risk_overview,
    "tier1_scan": tier1_scan,
    "tier1_full": tier1_full,
    "tier1_output": tier1_output,
    "request_route": request_route,
    "tfidf_vocab": tfidf_vocab,
    "tfidf_topk": tfidf_topk,
    "unsafe_intent": unsafe_intent,
    "stakes_nn": stakes,
    "two_set_nn_dense": two_set_nn_dense,
    "encoder_projection": encoder_projection,
    "intent_dense": intent_dense,
    "toxic_learned": toxic_learned,
    "injection_layered": injection_layered,
    "near_dup_leaders": near_dup_leaders,
    "scope_missing_terms": scope_missing_terms,
    "rerank_boosted": rerank_boosted,
    "conflict_groups": conflict_groups,
    "evidence_pack": evidence_pack,
    "cache_lookup_asof": cache_lookup_asof,
    "groundedness": groundedness,
    "self_consistency": self_consistency,
    "output_safety": output_safety,
    "decide": decided,
    "retried": retried,
    "extract_answers": extract_answers,
    "generate_answers": generate_answers,
    "delivered": delivered,
    "judge_udf_slot": judge_udf_slot,
    "fuzzy_leak": fuzzy_leak,
}
_TFIDF = f"WITH {V.REQUESTS}, {tfidf_sql(V.CORPUS, 'corpus')}"
_BOOSTS = " ".join(f"WHEN {sql_text(k)} THEN {v}" for k, v in L.TRUST_BOOST.items())
_RANKS = " ".join(f"WHEN {sql_text(k)} THEN {v}" for k, v in L.TRUST_RANK.items())
_DRAWN = rf"""{_TFIDF.replace('{', '{{').replace('}', '}}')}, r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY floor(sim * 1e9) DESC, item_id) AS rank FROM sims QUALIFY rank <= 3),
e AS (SELECT query_id AS run_id, rank, thread, question, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) > 12) AS s
  FROM r JOIN corpus ON id = item_id JOIN requests ON run_id = query_id),
w AS (SELECT run_id, thread, 'S' || rank AS tag, list_distinct(regexp_extract_all(lower(question), '[a-z]{{{{4,}}}}')) AS q, unnest(CASE WHEN len(s) > 0 THEN s ELSE [text] END) AS s FROM e),
o AS (SELECT run_id, thread, tag, s, CASE WHEN len(q) > 0 THEN len(list_intersect(q, regexp_extract_all(lower(s), '[a-z]{{{{4,}}}}')))::DOUBLE / len(q) ELSE 0 END AS o FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY o DESC, tag DESC, s DESC) AS k FROM o QUALIFY k <= {{keep}}),
drawn AS (SELECT run_id, coalesce(string_agg(rtrim(s, '.') || ' [' || tag || '].', ' ' ORDER BY k) FILTER (WHERE o > 0.05), {sql_text(Y.NOTHING_FOUND)}) AS answer FROM requests LEFT JOIN p USING (run_id) GROUP BY run_id)"""
SQL = {
    "risk_overview": f"{_SCAN} SELECT band, action, count(*) AS n, floor(avg(risk_score) * 1000000 + 0.5) / 1000000 AS mean_score FROM t1 GROUP BY band, action",
    "tier1_scan": f"""{_SCAN} SELECT run_id, risk_score, floor(weighted * 10 + 0.5) / 10 AS weighted, band, action, band <> 'normal' AS strict_mode, CASE WHEN action = 'block' THEN 'blocked' ELSE 'rewrite' END AS route,
  CASE WHEN band = 'high_risk' THEN 'block' ELSE action END AS effective_action,
  concat_ws(',', CASE WHEN inj > 0 THEN 'injection=' || floor(inj * 100 + 0.5) / 100 END, CASE WHEN pii > 0 THEN 'pii=' || floor(pii * 100 + 0.5) / 100 END, CASE WHEN usage > 0 THEN 'usage_guard=' || floor(usage * 100 + 0.5) / 100 END) AS reasons FROM t1""",
    "tfidf_vocab": f"{_TFIDF} SELECT term, df, floor(idf * 1000000 + 0.5) / 1000000 AS idf FROM vocab",
    "tfidf_topk": f"{_TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(sim * 1e9) DESC, item_id)::INT AS rank FROM sims) SELECT query_id, item_id, rank, floor(sim * 1000000 + 0.5) / 1000000 AS sim FROM r WHERE rank <= 3",
    "unsafe_intent": f"{_SIDES} SELECT run_id, floor(u * 1000000 + 0.5) / 1000000 AS unsafe_sim, floor(s * 1000000 + 0.5) / 1000000 AS safe_sim, score, kind AS category, action FROM unsafe",
    "stakes_nn": f"{_SIDES} SELECT run_id, score, kind AS category, score >= 0.4 AS strict_mode FROM stakes",
    "tier1_full": f"""{_FULL} SELECT run_id, risk_score, floor(weighted * 10 + 0.5) / 10 AS weighted, floor(solo * 10 + 0.5) / 10 AS solo, band, action, strict_mode FROM full1""",
    "tier1_output": f"""{_OUTPUT} SELECT run_id, risk_score, band, action, CASE WHEN strict OR band <> 'normal' THEN 'deep' ELSE 'skip' END AS route FROM out1""",
    "two_set_nn_dense": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label < 5 AS low FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.low, c.vec_id, floor(list_cosine_similarity(q.v, c.v) * 1000000 + 0.5) / 1000000 AS sim FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, low, vec_id, sim FROM p QUALIFY row_number() OVER (PARTITION BY query_id, low ORDER BY sim DESC, vec_id) = 1""",
    "encoder_projection": f"""WITH {V.EXAMPLES}, {grams_sql('cg', 'examples', 'id', 'text')},
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM examples))::DOUBLE / (1 + count(DISTINCT id))) + 1 AS idf FROM cg GROUP BY term), cw AS ({weights_sql('cg')}),
signed AS (SELECT id, w, ('0x' || substr(md5(term), 1, 8))::BIGINT AS bits FROM cw)
SELECT id, k::INT AS k, floor(sum(w * (((bits >> k) & 1) * 2 - 1)) * 1000000 + 0.5) / 1000000 AS x FROM signed, range({EN.DIMS}) r(k) GROUP BY id, k""",
    "scope_missing_terms": f"""WITH {V.REQUESTS}, {V.CORPUS}, v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text || ' ' || title), '[a-z]{{4,}}')) AS v FROM corpus),
w AS (SELECT run_id AS id, unnest(regexp_extract_all(lower(question), '[a-z]{{5,}}')) AS term, generate_subscripts(regexp_extract_all(lower(question), '[a-z]{{5,}}'), 1) AS i FROM requests),
m AS (SELECT * FROM w WHERE NOT list_contains({sql_list(L.GENERIC_WORDS)}, term) AND NOT EXISTS (SELECT 1 FROM v WHERE substr(v.v, 1, 5) = substr(w.term, 1, 5)) AND NOT EXISTS (SELECT 1 FROM v WHERE len(v.v) = 4 AND v.v = substr(w.term, 1, 4)))
SELECT id, string_agg(term, ' ' ORDER BY i) AS missing FROM m GROUP BY id""",
    "rerank_boosted": f"""{_TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(sim * 1e9) DESC, item_id) AS rank FROM sims QUALIFY rank <= 25),
b AS (SELECT r.*, floor((sim + ((CASE source_type {_BOOSTS} ELSE -0.05 END)::DOUBLE + (CASE WHEN 2026 - year <= 1 THEN 0.05 ELSE 0 END)::DOUBLE)) * 1000 + 0.5) / 1000 AS rerank_score FROM r JOIN corpus ON id = item_id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS place FROM b QUALIFY place <= 5)
SELECT query_id, item_id, place::INT AS place, rerank_score FROM p QUALIFY max(floor(sim * 1000 + 0.5) / 1000) OVER (PARTITION BY query_id) >= 0.12""",
    "cache_lookup_asof": f"""WITH {V.TRACES}, asked AS (SELECT run_id, epoch_us(ts) AS at, {V.SPELLED} AS question,
  'v' || day(ts) // 10 AS version, action = 'allow' AND coalesce(feedback = 'up', false) AS may FROM traces),
texts AS (SELECT question AS text, md5(question) AS id, max(run_id) FILTER (WHERE may) IS NOT NULL AS stored FROM asked GROUP BY question), entries AS (SELECT * FROM texts WHERE stored),
{grams_sql('cg', 'entries', 'id', 'text')}, {grams_sql('qg', 'texts', 'id', 'text')},
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM entries))::DOUBLE / (1 + count(DISTINCT id))) + 1 AS idf FROM cg GROUP BY term), cw AS ({weights_sql('cg')}), qw AS ({weights_sql('qg')}),
alike AS (SELECT q.id AS of, c.id AS sig, floor(sum(q.w * c.w) * 1e9) AS s FROM qw q JOIN cw c USING (term) GROUP BY ALL HAVING floor(sum(q.w * c.w) * 1e9) >= {L.CACHE_NEAR} * 1e9),
b AS (SELECT a.run_id AS id, arg_max(e.run_id, (s, -e.run_id)) AS entry, arg_max(e.version, (s, -e.run_id)) AS version FROM asked a JOIN alike ON of = md5(a.question) JOIN asked e ON e.may AND md5(e.question) = sig AND e.at < a.at GROUP BY a.run_id)
SELECT run_id AS id, coalesce(b.version = asked.version, false) AS hit, CASE WHEN b.version = asked.version THEN entry END AS entry_id FROM asked LEFT JOIN b ON b.id = run_id""",
    "near_dup_leaders": f"""{_TFIDF.replace("WITH", "WITH RECURSIVE", 1)}, r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY floor(sim * 1e9) DESC, item_id) AS rank FROM sims QUALIFY rank <= {L.FETCH}),
alike AS (SELECT a.id AS item_id, list(b.id) AS near FROM (SELECT x.id, y.id AS other FROM cw x JOIN cw y ON x.term = y.term AND x.id <> y.id GROUP BY ALL HAVING sum(x.w * y.w) > {L.DUPLICATE}::DOUBLE) a JOIN corpus b ON b.id = a.other GROUP BY ALL),
kept AS (SELECT DISTINCT query_id, 0::BIGINT AS k, []::BIGINT[] AS ids FROM r UNION ALL
  SELECT kept.query_id, k + 1, CASE WHEN len(list_intersect(ids, coalesce(near, []::BIGINT[]))) > 0 THEN ids ELSE list_append(ids, r.item_id) END FROM kept JOIN r ON r.query_id = kept.query_id AND r.rank = k + 1 LEFT JOIN alike ON alike.item_id = r.item_id)
SELECT query_id, len(ids)::INT AS kept, (k - len(ids))::INT AS dropped FROM kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1""",
    "extract_answers": f"{_DRAWN.format(keep='3')} SELECT run_id, answer FROM drawn",
    "generate_answers": rf"""{_DRAWN.format(keep='CASE WHEN thread % 2 = 0 THEN 2 ELSE 3 END')},
parts AS (SELECT run_id, list_filter(list_transform(string_split_regex(regexp_replace(trim(answer), '([.!?])\s+|\n+', '\1' || chr(1), 'g'), '\x01+'), lambda x: trim(x)),
  lambda x: len(x) >= 12 AND NOT regexp_matches(x, '\[([A-Za-z]?\d+)\]')) AS u FROM drawn),
told AS (SELECT run_id, thread % 2 = 0 AS strict, answer, run_id IN (SELECT query_id FROM r) AS found, u FROM requests JOIN drawn USING (run_id) JOIN parts USING (run_id))
SELECT run_id, strict, answer, CASE WHEN strict THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END AS temperature, CASE WHEN found THEN array_to_string(u, '|') ELSE '' END AS untagged,
       NOT found OR len(u) = 0 AS citations_ok, found AND strict AND len(u) > 0 AS reprompted, CASE WHEN NOT found THEN 0 WHEN strict AND len(u) > 0 THEN 2 ELSE 1 END AS calls FROM told""",
    "groundedness": f"{_GROUND} SELECT run_id, score, claims, supported, unsure, unsupported FROM grounded",
    "self_consistency": f"WITH {V.ANSWERS}, {_CONSISTENT} SELECT * FROM consistent",
    "output_safety": f"WITH {V.ANSWERS}, {_SAFE} SELECT * FROM safe",
    "decide": f"""{_DECIDED} SELECT run_id, t2_score, weighted, CASE WHEN strict THEN 'groundedness,output_safety,self_consistency' ELSE 'groundedness,output_safety' END AS ran, action, floor(sev * 10 + 0.5) / 10 AS severity, confident,
  CASE WHEN action IN ('block', 'abstain', 'block_and_route_hr') THEN 'could not verify' WHEN unsupported > 0 THEN 'could not verify' WHEN unsure > 0 THEN 'partly verified' WHEN claims > 0 THEN 'verified against your documents' ELSE 'not checked in depth' END AS trust_label,
  CASE WHEN action = 'retry' THEN 'regenerate' WHEN action = 'escalate' THEN 'human' ELSE 'finalize' END AS route FROM z""",
}
_PACKED = f"""{_TFIDF.replace("WITH", "WITH RECURSIVE", 1)},
wide AS (SELECT query_id, item_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY floor(sim * 1e9) DESC, item_id) AS rank FROM sims QUALIFY rank <= {L.FETCH}),
twins AS (SELECT a.id AS item_id, list(b.id) AS near FROM cw a JOIN cw b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) > {L.DUPLICATE}::DOUBLE),
twin AS (SELECT item_id, flatten(list(near)) AS near FROM twins GROUP BY item_id),
lead AS (SELECT DISTINCT query_id, 0::BIGINT AS k, []::BIGINT[] AS ids FROM wide UNION ALL
  SELECT lead.query_id, k + 1, CASE WHEN len(list_intersect(ids, coalesce(near, []::BIGINT[]))) > 0 THEN ids ELSE list_append(ids, w.item_id) END
  FROM lead JOIN wide w ON w.query_id = lead.query_id AND w.rank = k + 1 LEFT JOIN twin ON twin.item_id = w.item_id),
own AS (SELECT query_id, arg_max(ids, k) AS ids FROM lead GROUP BY query_id),
b AS (SELECT w.*, source_id, source_type, year, text, floor((sim + ((CASE source_type {_BOOSTS} ELSE -0.05 END)::DOUBLE + (CASE WHEN 2026 - year <= 1 THEN 0.05 ELSE 0 END)::DOUBLE)) * 1000 + 0.5) / 1000 AS rerank_score
  FROM wide w JOIN own ON own.query_id = w.query_id AND list_contains(own.ids, w.item_id) JOIN corpus ON id = w.item_id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS place FROM b QUALIFY place <= {L.KEEP}),
held AS (SELECT * FROM p QUALIFY max(floor(sim * 1000 + 0.5) / 1000) OVER (PARTITION BY query_id) >= {FLOOR}),
told AS (SELECT query_id, item_id, source_id, CASE source_type {_RANKS} END AS trust, year, place, {TQ.NUMBERS('text')} AS numbers FROM held),
num AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM told WHERE len(numbers) > 0),
couples AS (SELECT DISTINCT x.item_id AS x, y.item_id AS y FROM num x JOIN num y ON x.query_id = y.query_id AND x.item_id <> y.item_id),
alike AS (SELECT x, y FROM couples JOIN cw a ON a.id = x JOIN cw c ON c.id = y AND c.term = a.term GROUP BY x, y HAVING sum(a.w * c.w) >= {TOPIC_NEAR}::DOUBLE),
topic AS (SELECT x, list(y) AS near FROM alike GROUP BY x),
heads AS (SELECT DISTINCT query_id, 0::BIGINT AS k, []::BIGINT[] AS found, NULL::BIGINT AS item_id, NULL::BIGINT AS head FROM num UNION ALL
  SELECT query_id, k, CASE WHEN h IS NULL THEN list_append(found, item_id) ELSE found END, item_id, coalesce(h, item_id)
  FROM (SELECT s.query_id, s.k + 1 AS k, s.found, m.item_id, list_filter(s.found, lambda z: list_contains(coalesce(t.near, []::BIGINT[]), z))[1] AS h
        FROM heads s JOIN num m ON m.query_id = s.query_id AND m.n = s.k + 1 LEFT JOIN topic t ON t.x = m.item_id)),
memb AS (SELECT num.*, heads.head AS cluster FROM num JOIN heads ON heads.query_id = num.query_id AND heads.item_id = num.item_id),
g AS (SELECT query_id, cluster, numbers, max(struct_pack(trust := trust, year := year, p := -place, i := item_id)) AS b, count(DISTINCT source_id) AS sources, min(place) AS first, list(item_id) AS ids FROM memb GROUP BY ALL),
several AS (SELECT query_id, cluster, min(first) AS first FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT query_id, cluster FROM several QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first) = 1),
ranked AS (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY b.trust DESC, b.year DESC, sources DESC, first) AS k FROM g JOIN c USING (query_id, cluster)),
d AS (SELECT x.query_id, CASE WHEN x.b.trust > z.b.trust THEN 'trust' WHEN x.b.year > z.b.year THEN 'year' WHEN x.sources > z.sources THEN 'sources' ELSE 'none' END AS reason, x.b.i AS winner
  FROM ranked x JOIN ranked z ON x.query_id = z.query_id AND x.k = 1 AND z.k = 2),
lost AS (SELECT query_id, unnest(ids) AS item_id FROM ranked JOIN d USING (query_id) WHERE k > 1 AND reason <> 'none')"""
SQL["conflict_groups"] = f"""{_PACKED}, losers AS (SELECT query_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS losers FROM lost GROUP BY query_id)
SELECT query_id, reason <> 'none' AS resolved, reason, CASE WHEN reason <> 'none' THEN winner END AS winner_id, coalesce(losers, '') AS losers FROM d LEFT JOIN losers USING (query_id)"""
_EVIDENCE = f"""{_PACKED}, miss AS ({SQL['scope_missing_terms']}), near AS (SELECT query_id AS id, max(sim) AS nearest FROM wide GROUP BY query_id),
ev AS (SELECT query_id AS id, string_agg(text, chr(10) ORDER BY place) AS evidence FROM held h WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.query_id = h.query_id AND l.item_id = h.item_id) GROUP BY query_id),
parts AS (SELECT run_id AS id, evidence, coalesce(reason = 'none', false) AS open, missing, missing IS NOT NULL AND coalesce(nearest, 0) < {SCOPE} AS away
  FROM requests LEFT JOIN ev ON ev.id = run_id LEFT JOIN miss ON miss.id = run_id LEFT JOIN near ON near.id = run_id LEFT JOIN d ON d.query_id = run_id)"""
SQL["evidence_pack"] = f"""{_EVIDENCE} SELECT id, CASE WHEN away THEN '' ELSE coalesce(evidence, '') END AS evidence, away OR evidence IS NULL AS no_evidence, open AND NOT away AS sources_disagreed, coalesce(missing, '') AS missing FROM parts"""
SQL["request_route"] = f"""{_EVIDENCE}, texts AS (SELECT question AS text, md5(question) AS id FROM requests GROUP BY question), {grams_sql('tg', 'texts', 'id', 'text')},
tv AS (SELECT term, ln((1 + (SELECT count(*) FROM texts))::DOUBLE / (1 + count(DISTINCT id))) + 1 AS idf FROM tg GROUP BY term), tw AS ({weights_sql('tg', 'tv')}),
same AS (SELECT x.id AS x, y.id AS y FROM tw x JOIN tw y USING (term) GROUP BY x.id, y.id HAVING floor(sum(x.w * y.w) * 1e9) >= {L.CACHE_NEAR} * 1e9),
hits AS (SELECT DISTINCT r.run_id FROM requests r JOIN same ON x = md5(r.question) JOIN requests e ON md5(e.question) = y AND e.run_id < r.run_id)
SELECT id, CASE WHEN h.run_id IS NULL THEN 'miss' ELSE 'hit' END AS cache, CASE WHEN h.run_id IS NULL THEN CASE WHEN away OR evidence IS NULL THEN 'none' ELSE 'ok' END END AS evidence FROM parts LEFT JOIN hits h ON h.run_id = parts.id"""
_ACTED = " ".join(f"WHEN action {test} THEN {text}" for test, text in (
    ("= 'abstain'", sql_text(Y.ABSTAINED)), ("IN ('block', 'block_and_route_hr')", sql_text(Y.STOPPED) + " || ref || '.'"),
    ("= 'care'", sql_text(Y.CARE)), ("= 'escalate'", sql_text(Y.HANDED_ON) + " || ref || '.'")))
SQL["delivered"] = f"""WITH {V.ANSWERS}, d AS ({SQL['decide']}), n AS (SELECT run_id, action, trust_label, answer, substr(md5(run_id::VARCHAR), 1, 4) || '-' || substr(md5(run_id::VARCHAR), 5, 2) AS ref FROM d JOIN answers USING (run_id))
SELECT run_id, action, ref, (CASE {_ACTED} ELSE answer END) || CASE WHEN trust_label = 'partly verified' AND action NOT IN ('block', 'abstain', 'block_and_route_hr') THEN chr(10) || chr(10) || {sql_text(PARTLY)} ELSE '' END AS message FROM n"""
_LABEL = """CASE WHEN action IN ('block', 'abstain', 'block_and_route_hr') OR unsupported > 0 THEN 'could not verify' WHEN unsure > 0 THEN 'partly verified' WHEN claims > 0 THEN 'verified against your documents' ELSE 'not checked in depth' END"""
SQL["retried"] = rf"""WITH {V.ANSWERS}, first AS ({_DECIDED} SELECT run_id, action, t1, t1_action, t1_sure, {_LABEL} AS trust_label FROM z),
second AS ({_DRAWN.format(keep='2')},
  ev AS (SELECT run_id + 1 AS run_id, 'S' || rank AS tag, text FROM e),
  fresh AS (SELECT f.run_id, f.t1, f.t1_action, f.t1_sure, true AS strict, coalesce(d.answer, {sql_text(Y.NOTHING_FOUND)}) AS answer FROM first f LEFT JOIN drawn d ON d.run_id + 1 = f.run_id WHERE f.action = 'retry'),
  {TQ.claims_sql('fresh', 'run_id', 'answer')},
  each_tag AS (SELECT run_id, k, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM claims),
  cited AS (SELECT c.run_id, c.k, c.text, c.tags, trim(coalesce(string_agg(coalesce(ev.text, ''), chr(10) ORDER BY i), '')) AS cited
            FROM claims c LEFT JOIN each_tag t ON t.run_id = c.run_id AND t.k = c.k LEFT JOIN ev ON ev.run_id = c.run_id AND ev.tag = t.tag GROUP BY c.run_id, c.k, c.text, c.tags),
  words AS (SELECT *, {TQ.CONTENT('text')} AS cw, {TQ.CONTENT('cited')} AS ew, {TQ.NUMBERS('text')} AS cn, {TQ.NUMBERS('cited')} AS en FROM cited),
  judged AS (SELECT run_id, CASE WHEN len(tags) = 0 OR cited = '' OR len(list_filter(cn, lambda n: NOT list_contains(en, n))) > 0 THEN 'bad' WHEN len(cw) > 0 AND len(list_intersect(cw, ew)) / len(cw) >= 0.6 THEN 'good' ELSE 'unsure' END AS v FROM words),
  counted AS (SELECT f.run_id, count(v) AS claims, count(*) FILTER (WHERE v = 'unsure') AS unsure, count(*) FILTER (WHERE v = 'bad') AS unsupported FROM fresh f LEFT JOIN judged USING (run_id) GROUP BY f.run_id),
  {_SAFE.replace('FROM answers', 'FROM fresh')},
  scored AS (SELECT c.*, f.answer, f.t1, f.t1_action, f.t1_sure, CASE WHEN claims > 0 THEN floor(least(1.0::DOUBLE, (unsupported + 0.4::DOUBLE * unsure) / claims) * 100 + 0.5) / 100 ELSE 0.0::DOUBLE END AS g, s.score AS s
             FROM counted c JOIN fresh f USING (run_id) JOIN safe s USING (run_id)),
  weighed AS (SELECT *, greatest(t1, floor(greatest((g * 50 + s * 20) / 70 * 100, g * 100, s * 100) * 10 + 0.5) / 10) AS sev FROM scored),
  acted AS (SELECT *, CASE WHEN t1_action IN ('block', 'block_and_route_hr', 'care') THEN t1_action WHEN unsupported > 0 THEN 'abstain' WHEN sev >= 80 THEN 'block' WHEN sev >= 40 THEN 'escalate' ELSE 'allow' END AS action FROM weighed)
  SELECT run_id, true AS regenerated, action, {_LABEL} AS trust_label, answer FROM acted)
SELECT run_id, false AS regenerated, action, trust_label, answer FROM first JOIN answers USING (run_id) WHERE action <> 'retry' UNION ALL SELECT * FROM second"""
