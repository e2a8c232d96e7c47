"""Risk detectors on one text column, and their fusion. All are expressions inside a projection: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

TIER_OF = {phrase: tier for tier, phrases in L.PHRASES.items() for phrase in phrases}
ORDERED = sorted(TIER_OF, key=len, reverse=True)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def injection_phrases(text: Column, format_given: Column) -> Column:
    """struct<score, phrase, target>: the worst phrase, of equal scores in plain text before leet, then the longest (earliest in the list)."""
    phrases = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(p.replace(" ", "")).alias("joined"), F.lit(TIER_OF[p]).alias("tier"), F.lit(k).alias("at")) for k, p in enumerate(ORDERED)))
    scores = L.PHRASE_SCORES

    def scored(normal: Column, variant: int) -> Column:
        hits = _let(T.compact(normal), lambda joined: F.filter(phrases, lambda x: F.contains(joined, x["joined"])))

        def one(x: Column) -> Column:
            area = T.following(normal, F.call_function("locate", x["p"], normal), F.length(x["p"]))
            return _let(
                F.struct(T.first_of(L.ATTACK_TARGETS, area).alias("attack"), T.first_of(L.SAFE_TARGETS, area).alias("safe")),
                lambda t: F.struct(
                    F.when(x["tier"] == "always", scores["always"]).when(t["attack"].isNotNull(), scores["attack"]).when(t["safe"].isNotNull(), scores["safe"])
                    .when(x["tier"] == "encoding", scores["encoding"]).when(x["tier"] == "weak", scores["weak"]).when(format_given, scores["strong_after_format"]).otherwise(scores["strong"]).alias("score"),
                    (-(x["at"] + variant * len(ORDERED))).alias("order"),
                    x["p"].alias("phrase"),
                    F.when(x["tier"] == "always", None).otherwise(F.coalesce(t["attack"], t["safe"])).alias("target"),
                ),
            )

        return F.transform(hits, one)

    plain = _let(T.normalize(text), lambda n: scored(n, 0))
    leet = _let(T.normalize(text, leet=True), lambda n: scored(n, 1))
    best = F.array_max(F.concat(plain, leet))
    # bound, as inside another expression Spark would find the best once for each field
    return _let(best, lambda b: F.struct(F.coalesce(b["score"], F.lit(0.0)).alias("score"), b["phrase"].alias("phrase"), b["target"].alias("target")))


def injection_structure(text: Column) -> Column:
    """struct<score, signals>: signals that wording does not change."""
    found = F.struct(T.invisible_count(text).alias("hidden"), _let(F.lower(text), lambda t: T.first_of(L.ROLE_MARKERS, t)).alias("marker"), text.rlike("[A-Za-z0-9+/]{30,}={0,2}").alias("blob"), text.rlike(r"(.)\1{80,}").alias("repeat"))
    s = L.STRUCTURE_SCORES
    when = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))

    def told(x: Column) -> Column:
        hidden, marker, blob, repeat = (x[c] for c in ("hidden", "marker", "blob", "repeat"))
        score = F.greatest(when(hidden > 0, s["invisible"]), when(blob, s["blob"]), when(marker.isNotNull(), s["marker"]), when(repeat, s["repeat"]))
        signals = F.array_compact(F.array(F.when(hidden > 0, F.concat(F.lit("invisible_chars("), hidden.cast("string"), F.lit(")"))), F.when(blob, F.lit("encoded_blob")), F.when(marker.isNotNull(), F.concat(F.lit("role_marker("), marker, F.lit(")"))), F.when(repeat, F.lit("long_repeat"))))
        return F.struct(score.alias("score"), signals.alias("signals"))

    return _let(found, told)


def injection(text: Column, format_given: Column, learned: Column | None = None) -> Column:
    """struct<score, band, phrase, target, signals>; it names no action of its own. learned is a third layer's score, see operators.classifier."""
    text = F.coalesce(text, F.lit(""))
    both = F.struct(injection_phrases(text, format_given).alias("p"), injection_structure(text).alias("s"))
    third = F.lit(0.0) if learned is None else F.coalesce(learned, F.lit(0.0))
    score = lambda b: F.greatest(b["p"]["score"], b["s"]["score"], third)
    return _let(both, lambda b: F.struct(score(b).alias("score"), band(score(b), 0.70, 0.40).alias("band"), b["p"]["phrase"].alias("phrase"), b["p"]["target"].alias("target"), b["s"]["signals"].alias("signals")))


def band(score: Column, high: float, low: float) -> Column:
    return F.when(score >= high, "block").when(score >= low, "suspicious").otherwise("allow")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of a pattern's matches, 0-based. Places come from the lengths of what splits leave."""
    pattern = "(?U)" + pattern
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    ends = lambda b: T.running(F.transform(b["m"], lambda m, i: F.length(F.get(b["g"], i)) + F.length(m)))

    def places(b: Column) -> Column:
        one = lambda m, end: F.struct(m.alias("text"), (end - F.length(m)).alias("start"), end.alias("end"))
        return _let(ends(b), lambda e: F.zip_with(b["m"], e, one))

    return _let(both, places)


VALID = {"AADHAAR": T.verhoeff_valid, "PAN": T.pan_valid, "GSTIN": T.gstin_valid, "CREDIT_CARD": T.luhn_valid}
#: Patterns without word boundaries, which any match of a kind's pattern has within: most texts are told apart by these, which take a fraction of the time.
_FOUR = "[0-9]{4}"
GATES = {
    "AADHAAR": _FOUR, "PAN": _FOUR, "GSTIN": _FOUR, "CREDIT_CARD": "[0-9](?:[ -]?[0-9]){11}", "IFSC": "[A-Z]{4}0", "BANK_ACCOUNT": _FOUR, "UPI_ID": "@", "INDIAN_PHONE": _FOUR, "EMAIL": "@", "VEHICLE_REG": _FOUR,
    "PASSPORT_IN": _FOUR,
}
PII_TYPE = "array<struct<kind:string,text:string,start:int,end:int,score:double,context:boolean,action:string>>"


def partial_judge(judge, *fixed):
    """judge of one argument: Spark counts a lambda's parameters."""
    return lambda m: judge(m, *fixed)


def pii_findings(text: Column, mode: str = "input") -> Column:
    """Findings of personal data by start: pattern, checksum, then the words within 40 characters. Overlapping findings are all kept."""
    if mode not in ("input", "output"):
        raise ValueError("mode is input or output")
    found = []
    for kind, pattern, base, act_in, act_out in L.PII_PATTERNS:

        def judge(m: Column, kind: str, base: float, action: str) -> Column:
            left = F.greatest(m["start"] - L.PII_WINDOW, F.lit(0))
            around = F.lower(F.substring(text, left + 1, m["end"] + L.PII_WINDOW - left))
            return _let(F.struct(around.alias("around"), F.regexp_replace(m["text"], r"[\s-]", "").alias("clean")), lambda x: told(m, x["around"], x["clean"], kind, base, action))

        def told(m: Column, around: Column, clean: Column, kind: str, base: float, action: str) -> Column:
            context = F.exists(T.strings(L.PII_CONTEXT[kind]), lambda w: F.contains(around, w)) if kind in L.PII_CONTEXT else F.lit(False)
            negative = F.exists(T.strings(L.PII_NEGATIVE), lambda w: F.contains(around, w))
            allowed = F.array_contains(T.strings(L.PII_ALLOWED), F.lower(F.trim(m["text"]))) | F.array_contains(T.strings(L.PII_ALLOWED), F.lower(clean))
            valid = VALID[kind](clean) if kind in VALID else F.lit(True)
            keep = ~allowed & valid & (context | ((F.lit(kind) != "BANK_ACCOUNT") & ~negative))
            score = F.when(context, F.lit(round(min(1.0, base + L.PII_BOOST), 2))).otherwise(F.lit(base))
            return F.when(keep, F.struct(F.lit(kind).alias("kind"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), score.alias("score"), context.alias("context"), F.lit(action).alias("action")))

        judged = partial_judge(judge, kind, base, act_in if mode == "input" else act_out)
        gate = F.contains(text, F.lit("@")) if GATES[kind] == "@" else text.rlike(GATES[kind])
        found.append(F.when(gate & text.rlike("(?U)" + pattern), F.transform(spans(text, pattern), judged)).otherwise(F.array().cast(PII_TYPE)))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(F.lit(0))
    some = text.rlike("|".join(dict.fromkeys(GATES.values())))
    return F.when(some, F.array_sort(F.array_compact(F.concat(*found)), order)).otherwise(F.array().cast(PII_TYPE))


def pii_summary(text: Column, findings: Column) -> Column:
    """struct<score, action, count, types, masked_text> of a text's findings. Masks replace the findings from the last to the first."""
    rank = {"allow": 0, "mask": 1, "redact": 2, "block": 3}
    ranks = F.transform(findings, lambda f: F.when(f["action"] == "block", 3).when(f["action"] == "redact", 2).when(f["action"] == "mask", 1).otherwise(0))
    action = F.get(T.strings(sorted(rank, key=rank.get)), F.coalesce(F.array_max(ranks), F.lit(0)))
    masked = F.aggregate(F.reverse(F.filter(findings, lambda f: f["action"] != "allow")), text, lambda t, f: F.concat(F.substring(t, F.lit(1), f["start"]), F.lit("["), f["kind"], F.lit("]"), F.substring(t, f["end"] + 1, F.lit(2**31 - 1))))
    return F.struct(
        F.coalesce(F.array_max(F.transform(findings, lambda f: f["score"])), F.lit(0.0)).alias("score"), action.alias("action"), F.size(findings).alias("count"),
        F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["kind"]))).alias("types"), masked.alias("masked_text"),
    )


def ratio(value: Column, limit: float | Column) -> Column:
    """0 up to the limit, 1 from twice the limit on."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - limit) / limit))


def usage_size(text: Column) -> Column:
    """struct<chars, lines, run, score>: what one request shows."""
    measured = F.struct(F.length(text).alias("chars"), T.line_count(text).alias("lines"), T.longest_run(text).alias("run"))
    u = L.USAGE

    def scored(m: Column) -> Column:
        chars = F.when(m["chars"] > u["chars_hard"], F.lit(0.85)).when(m["chars"] > u["chars_soft"], 0.35 + 0.3 * ratio(m["chars"], u["chars_soft"])).otherwise(F.lit(0.0))
        score = F.greatest(chars, F.when(m["lines"] > u["lines_hard"], F.lit(0.60)).otherwise(F.lit(0.0)), F.when(m["run"] > u["repeat_run"], F.lit(0.55)).otherwise(F.lit(0.0)))
        return F.struct(m["chars"].alias("chars"), m["lines"].alias("lines"), m["run"].alias("run"), score.alias("score"))

    return _let(measured, scored)


def usage_history(prior: Column, per_minute: Column, per_day: Column, tokens_day: Column, retries: Column, repeat_ratio: Column, limits: dict | None = None) -> Column:
    """Score of a request's history: 0 while a user has none."""
    u = L.USAGE | (limits or {})
    part = lambda v, limit: F.when(ratio(v, limit) > 0, 0.45 + 0.5 * ratio(v, limit)).otherwise(F.lit(0.0))
    worst = F.greatest(part(per_minute, u["per_minute"]), part(per_day, u["per_day"]), part(tokens_day, u["tokens_per_day"]), part(retries, u["retries"]), F.when(repeat_ratio > u["repeat_ratio"], F.lit(0.50)).otherwise(F.lit(0.0)))
    return F.when(prior > 0, worst).otherwise(F.lit(0.0))


def usage_action(score: Column) -> Column:
    return F.when(score >= 0.80, "block").when(score >= 0.40, "throttle").otherwise("allow")


def unsafe_intent(unsafe: Column, safe: Column, category: Column, text: Column, cuts: dict) -> Column:
    """struct<score, category, action> from the similarities to the nearest risky and the nearest safe example."""
    margin = unsafe - safe
    far, safer = unsafe < cuts["floor"], safe >= unsafe
    base = F.when(far, F.lit(0.0)).when(safer, F.lit(0.10)).when((margin >= cuts["big"]) & (unsafe >= cuts["strong"]), F.lit(0.85)).when(margin >= cuts["small"], F.lit(0.60)).otherwise(F.lit(0.40))
    kind = F.when(far | safer, F.lit(None).cast("string")).otherwise(category)
    nudged = F.when((base >= 0.30) & F.exists(T.strings(L.UNSAFE_KEYWORDS), lambda w: F.contains(F.lower(text), w)), F.greatest(base, F.lit(0.45))).otherwise(base)
    action = F.when((kind == "self_harm") & (nudged >= 0.40), "care").when((kind == "harassment") & (nudged >= 0.80), "block_and_route_hr").when(kind.isNotNull() & (nudged >= 0.80), "block").otherwise("allow")
    return F.struct(nudged.alias("score"), kind.alias("category"), action.alias("action"))


def high_stakes(high: Column, low: Column, category: Column, text: Column, cuts: dict) -> Column:
    """struct<score, category, strict_mode> from the similarities to the nearest high-stakes and low-stakes example. It never blocks."""
    margin = high - low
    none = (high < cuts["floor"]) | (low >= high)
    base = F.when(none, F.lit(0.0)).when((margin >= cuts["margin"]) & (high >= cuts["strong"]), F.lit(0.65)).when(margin >= cuts["margin"], F.lit(0.45)).otherwise(F.lit(0.25))
    lifted = F.when((base >= 0.20) & F.exists(T.strings(L.ESCALATORS), lambda e: F.contains(F.lower(text), e)), F.least(F.lit(L.STAKES_MOST), base + 0.20)).otherwise(base)
    return F.struct(lifted.alias("score"), F.when(none, F.lit(None).cast("string")).otherwise(category).alias("category"), (lifted >= 0.40).alias("strict_mode"))


def fuse(scores: dict[str, Column], actions: dict[str, Column], strict: Column | None = None) -> Column:
    """struct<risk_score, weighted, solo, band, action, strict_mode, reasons> of detectors' scores and actions.

    solo leaves high stakes out. The action of the highest rank wins; of equal ranks, the earliest detector's.
    """
    weighted = F.least(F.lit(100.0), sum((s * L.DETECTOR_WEIGHTS[k] for k, s in scores.items()), F.lit(0.0)))
    solo = F.greatest(F.lit(0.0), *(s * 100 for k, s in scores.items() if k != "high_stakes"), F.lit(0.0))
    final = F.greatest(weighted, solo)
    ranks = F.create_map(*(F.lit(x) for pair in L.ACTION_RANK.items() for x in pair))
    ranked = F.array(*(F.struct(F.element_at(ranks, a).alias("rank"), F.lit(-k).alias("order"), a.alias("action")) for k, a in enumerate(actions.values())), F.struct(F.lit(0).alias("rank"), F.lit(-99).alias("order"), F.lit("allow").alias("action")))
    level = F.when(final >= 80, "high_risk").when(final >= 40, "cautious").otherwise("normal")
    reasons = F.array_compact(F.array(*(F.when(s > 0, F.concat(F.lit(f"{k}="), T.half_up(s, 2).cast("string"))) for k, s in scores.items())))
    calm = F.lit(False) if strict is None else F.coalesce(strict, F.lit(False))
    return F.struct(T.half_up(final, 1).alias("risk_score"), T.half_up(weighted, 1).alias("weighted"), T.half_up(solo, 1).alias("solo"), level.alias("band"), F.array_max(ranked)["action"].alias("action"), (calm | (level != "normal")).alias("strict_mode"), reasons.alias("reasons"))


def scan(df: DataFrame, text: str, mode: str = "input", format_given: Column | None = None, unsafe: Column | None = None, stakes: Column | None = None, learned: Column | None = None) -> DataFrame:
    """df with the columns injection, pii, usage and t1: the detectors of one text, and the fusion of all that are given.

    unsafe and stakes are the results of unsafe_intent and high_stakes, which need examples (see operators.vectors); learned is the third layer of injection.
    In output mode only unsafe intent and personal data count. Null texts scan as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    given = F.lit(False) if format_given is None else format_given
    out = df.withColumn("__findings", pii_findings(t, mode)).withColumn("pii", pii_summary(t, F.col("__findings"))).drop("__findings")
    scores, actions = {}, {}
    if mode == "input":
        out = out.withColumn("injection", injection(t, given, learned)).withColumn("usage", usage_size(t))
        scores["injection"] = F.col("injection.score")
    if unsafe is not None:
        scores["unsafe_intent"], actions["unsafe_intent"] = unsafe["score"], unsafe["action"]
    scores["pii"], actions["pii"] = F.col("pii.score"), F.col("pii.action")
    if mode == "output":
        return out.withColumn("t1", fuse(scores, actions))
    if stakes is not None:
        scores["high_stakes"] = stakes["score"]
    scores["usage_guard"], actions["usage_guard"] = F.col("usage.score"), usage_action(F.col("usage.score"))
    return out.withColumn("t1", fuse(scores, actions, None if stakes is None else stakes["strict_mode"]))


def route(t1: Column) -> Column:
    """Where a scanned request goes: only an action stops it, whatever its band (effective_action does otherwise)."""
    return F.when(t1["action"].isin("block", "block_and_route_hr", "care"), "blocked").otherwise("rewrite")


def effective_action(t1: Column) -> Column:
    """The action, or block where the band is high_risk although no detector asked for more than a mask."""
    return F.when((t1["band"] == "high_risk") & t1["action"].isin("allow", "mask", "redact", "throttle"), "block").otherwise(t1["action"])


def certain(t1_scores: dict[str, Column]) -> Column:
    """Whether a detector other than high stakes is at 0.80 or more."""
    return F.greatest(F.lit(0.0), *(s for k, s in t1_scores.items() if k != "high_stakes")) >= 0.80


def deep_check_route(strict: Column, out_band: Column) -> Column:
    """Clean answers go straight out; risky ones, and all in strict mode, are checked in depth."""
    return F.when(strict | (out_band != "normal"), "deep").otherwise("skip")


def cache_route(hit: Column) -> Column:
    return F.when(hit, "hit").otherwise("miss")


def evidence_route(evidence: Column) -> Column:
    """Without evidence there is nothing to answer from."""
    return F.when(F.size(F.coalesce(evidence, F.array().cast("array<string>"))) == 0, "none").otherwise("ok")
