"""Queries on the scalar text functions, personal data and injection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import detectors as D
from ..operators import spans as SP
from ..operators import rewrite as R
from ..tables import kept, scoped
from . import views as V
from .views import sql_list, sql_text

TODAY = "2026-08-26"


def q(*names):
    """A query that selects from the requests: (name, function of the question column) pairs."""

    def run(spark, sf_dir):
        r = V.requests(spark, sf_dir)
        return r.select("run_id", *(f(F.col("question")).alias(name) for name, f in names))

    return run


def over_requests(*columns: str) -> str:
    return f"WITH {V.REQUESTS} SELECT run_id, {', '.join(columns)} FROM requests"


_NORMAL = r"trim(regexp_replace(regexp_replace({}, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_PLAIN = _NORMAL.format("lower(strip_accents(question))")
_LEET = _NORMAL.format("translate(lower(strip_accents(question)), '10345@', 'ioeasa')")
_CONTENT = f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda w: len(w) > 2 AND NOT list_contains({sql_list(L.CLAIM_STOP)}, w)), lambda w: regexp_replace(w, '^(.{{{{3,}}}}?)({L.SUFFIXES})$', '\\1'))))"
_TOPICS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z]+'), lambda w: len(w) > 3 AND NOT list_contains({sql_list(L.TOPIC_STOP)}, w))"
CONTENT = lambda c: _CONTENT.format(c)
TOPICS = lambda c: _TOPICS.format(c)
NUMBERS = lambda c: rf"list_sort(list_distinct(regexp_extract_all({c}, '\b\d+(?:[.,]\d+)?\b')))"
DURATIONS = lambda c: rf"list_sort(list_distinct(list_transform(regexp_extract_all({c}, '(?i)\b\d{{1,2}}\s*(?:days?|months?|weeks?|years?|hours?)\b'), lambda d: trim(lower(d)))))"


def claims_sql(source: str, key: str, text: str) -> str:
    """CTEs ending in claims(key, k, text, tags): the fragments of each text, tags of bare fragments given to the claim before."""
    return rf"""
parts AS (SELECT {key}, generate_subscripts(p, 1) AS i, trim(unnest(p)) AS part FROM (
  SELECT {key}, string_split_regex(regexp_replace(trim({text}), '([.!?])\s+|\n+', '\1' || chr(1), 'g'), '\x01+') AS p FROM {source})),
clean AS (SELECT {key}, i, trim(regexp_replace(part, '\[([A-Za-z]?\d+)\]', '', 'g'), ' .') AS t, regexp_extract_all(part, '\[([A-Za-z]?\d+)\]', 1) AS tags FROM parts WHERE part <> ''),
kept AS (SELECT *, len(t) >= 12 AND NOT (len(tags) > 0 AND t = '') AS is_claim, len(tags) > 0 AND t = '' AS bare FROM clean),
numbered AS (SELECT *, count(*) FILTER (WHERE is_claim) OVER (PARTITION BY {key} ORDER BY i) AS k FROM kept),
claims AS (SELECT {key}, k, any_value(t) FILTER (WHERE is_claim) AS text, flatten(list(tags ORDER BY i)) AS tags FROM numbered WHERE k > 0 AND (is_claim OR bare) GROUP BY {key}, k)"""


def claim_split(spark, sf_dir):
    a = V.answers(spark, sf_dir).select("run_id", F.posexplode(T.claims(F.col("answer"))).alias("k", "c"))
    return a.select("run_id", (F.col("k") + 1).cast("bigint").alias("k"), F.col("c.text").alias("text"), F.array_join("c.tags", ",").alias("tags"))


def relative_dates(spark, sf_dir):
    return V.requests(spark, sf_dir).select("run_id", T.absolute_dates(F.col("question"), F.lit(TODAY).cast("date")).alias("rewritten"))


def rewrite_query(spark, sf_dir):
    """Each request rewritten whole, with the request before it in its thread."""
    before = F.lag("question").over(Window.partitionBy("thread").orderBy("seq"))
    told = R.rewrite(V.requests(spark, sf_dir).withColumn("previous", before), F.lit(TODAY).cast("date"))
    joined = (F.array_join(c, "|").alias(c) for c in ("changes", "assumptions", "split"))
    return told.select("run_id", "rewritten", *joined, "changed")


def twice(text: str, pattern: str, by: str) -> str:
    """SQL that replaces all matches of a pattern which takes the characters around a word with it: words next to each other share one, so that a single pass leaves every second one."""
    return f"regexp_replace(regexp_replace({text}, '{pattern}', '{by}', 'g'), '{pattern}', '{by}', 'g')"


def rewrite_sql() -> str:
    """CTEs of one step each: q is the text so far, ch and asm the changes and assumptions."""
    word = lambda w: rf"(?i)(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])"
    steps = ["p AS (SELECT run_id, question, lag(question) OVER (PARTITION BY thread ORDER BY seq) AS previous FROM requests)",
             "s0 AS (SELECT *, question AS q, []::VARCHAR[] AS ch, []::VARCHAR[] AS asm FROM p)"]
    spans = zip(("last month", "this month", "last year"), (x.strip("'") for x in _month), strict=True)
    for phrase, new, dated in [*((a, b, False) for a, b in L.SHORT_FORMS.items()), *((a, b, True) for a, b in spans)]:
        met, k = f"regexp_matches(q, '{word(phrase)}')", len(steps) - 1
        asm = f"CASE WHEN {met} THEN list_append(asm, '{phrase} is taken as {new}') ELSE asm END" if dated else "asm"
        steps.append(rf"s{k} AS (SELECT run_id, question, previous, {twice('q', word(phrase), rf'\1{new}\2')} AS q, CASE WHEN {met} THEN list_append(ch, '{phrase} -> {new}') ELSE ch END AS ch, {asm} AS asm FROM s{k - 1})")
    last = len(steps) - 2
    subject = "regexp_extract_all(previous, '[A-Za-z]{5,}')[-1]"
    refers = f"subject IS NOT NULL AND regexp_matches(q, '{word('(it|that|this|those|they)')}')"
    replaced = rf"regexp_replace(q, '{word('(it|that|this)')}', '\1' || subject || '\3')"
    halves = rf"regexp_replace(regexp_replace(q, '{_WORDISH}and($|[^\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g'), '{_WORDISH}and($|[^\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g')"
    steps += [f"r AS (SELECT *, {subject} AS subject FROM s{last})",
              f"u AS (SELECT run_id, question, asm, CASE WHEN {refers} THEN {replaced} ELSE q END AS q, CASE WHEN {refers} THEN list_append(ch, 'pronoun -> ' || subject) ELSE ch END AS ch FROM r)",
              rf"v AS (SELECT *, list_filter(list_transform(string_split_regex({halves}, '\x01|\?'), lambda x: trim(x)), lambda x: len(x) > 12) AS parts FROM u)"]
    ends = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return f"""WITH {V.REQUESTS}, {', '.join(steps)}
SELECT run_id, {ends('q')} AS rewritten, array_to_string(CASE WHEN len(parts) > 1 THEN list_append(ch, 'split into ' || len(parts) || ' questions') ELSE ch END, '|') AS changes,
       array_to_string(asm, '|') AS assumptions, CASE WHEN len(parts) > 1 THEN array_to_string(parts, '|') ELSE '' END AS split, {ends('q')} <> {ends('question')} AS changed FROM v"""


def counterfactual_pairs(spark, sf_dir):
    from ..operators import jobs

    return jobs.counterfactuals(V.requests(spark, sf_dir).select("run_id", "question")).select("run_id", "attribute", "a", "b", "swapped")


def swaps_sql(source: str, adjacent: bool = False) -> str:
    """SELECT run_id, question, attribute, a, b, swapped: one branch a swap, as constant patterns are compiled once. adjacent: the text may have a name twice in a row."""
    before, after = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    swapped = lambda a, b: twice("question", f"(?i){before}{a}{after}", rf"\1{b}\2") if adjacent else rf"regexp_replace(question, '(?i){before}{a}{after}', '\1{b}\2', 'g')"
    each = (rf"SELECT run_id, {sql_text(k)} AS attribute, {sql_text(a)} AS a, {sql_text(b)} AS b, {swapped(a, b)} AS swapped FROM {source} WHERE regexp_matches(question, '(?i){before}{a}{after}')" for k, a, b in L.SWAPS)
    return " UNION ALL ".join(each)


def _texts(spark, sf_dir):
    """Requests and documents, under ids below 0: run_id, text."""
    d = V.requests(spark, sf_dir).select("run_id", F.col("question").alias("text"))
    return d.unionByName(V.table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("run_id"), "text"))


def pii(spark, sf_dir, mode="input"):
    return _texts(spark, sf_dir).withColumn("f", D.pii_findings(F.col("text"), mode))


def pii_findings(spark, sf_dir):
    # exploded where they are found: of a column, Spark would ask first whether it is null or empty, and find it anew for each
    found = _texts(spark, sf_dir).select("run_id", F.explode(D.pii_findings(F.col("text"))).alias("x"))
    return found.select("run_id", "x.kind", "x.text", "x.start", "x.end", "x.score", "x.context", "x.action")


def pii_action(spark, sf_dir):
    s = pii(spark, sf_dir, "output").select("run_id", D.pii_summary(F.col("text"), F.col("f")).alias("s"))
    return s.select("run_id", "s.score", "s.action", "s.count", F.array_join("s.types", ",").alias("types"))


def pii_mask(spark, sf_dir):
    """Texts with their findings masked; overlapping findings splice from the last to the first."""
    s = pii(spark, sf_dir).where(F.size("f") > 0).select("run_id", D.pii_summary(F.col("text"), F.col("f")).alias("s"))
    return s.select("run_id", "s.masked_text")


def _names(spark, sf_dir):
    """Spans of entities, as a second finder has them: run_id, kind, text, start, end. Looking at the first letter before the word boundary takes a fraction of the time."""
    texts = _texts(spark, sf_dir).select("run_id", F.explode(D.spans(F.col("text"), "(?=[A-Z])" + T.ENTITY)).alias("x"))
    return texts.select("run_id", F.lit("NAME").alias("kind"), "x.text", "x.start", "x.end")


@scoped
def pii_spans_merged(spark, sf_dir):
    """Findings of personal data, and the names that overlap none of them."""
    found = kept(pii_findings(spark, sf_dir).select("run_id", "kind", "text", "start", "end"))
    return SP.merged(found, _names(spark, sf_dir), ["run_id"])


def _valid_sql(kind: str) -> str:
    luhn = "len(c) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN (len(c) - i) % 2 = 1 THEN (2 * c[i]::INT) // 10 + (2 * c[i]::INT) % 10 ELSE c[i]::INT END)) % 10 = 0"
    verhoeff = f"list_reduce(list_prepend(0, range(0, 12)), lambda s, i: ({sql_list(L.VERHOEFF_PRODUCT)}[s + 1])[({sql_list(L.VERHOEFF_PERMUTATION)}[i % 8 + 1])[reverse(c)[i + 1]::INT + 1]::INT + 1]::BIGINT) = 0"
    return {"AADHAAR": verhoeff, "PAN": f"substr(c, 4, 1) IN ({', '.join(map(sql_text, L.PAN_HOLDERS))})", "GSTIN": "substr(c, 1, 2)::INT BETWEEN 1 AND 38", "CREDIT_CARD": luhn}.get(kind, "true")


def _asciied(text: str) -> str:
    """SQL for a text of equal length in which letters, digits and marks beyond ASCII are _ and others |: DuckDB's word boundaries are those of ASCII."""
    return rf"regexp_replace(regexp_replace({text}, '[^\p{{L}}\p{{N}}\p{{M}}\x00-\x7F]', '|', 'g'), '[^\x00-\x7F]', '_', 'g')"


def pii_texts(*sources: str) -> str:
    return f"texts AS ({' UNION ALL '.join(sources)})"


REQUEST_TEXTS = f"SELECT run_id, {_asciied('question')} AS text FROM requests"


def _pii_sql(mode: str, views: str = V.REQUESTS, texts: str = pii_texts(REQUEST_TEXTS, f"SELECT -1 - doc_id, {_asciied('text')} FROM documents")) -> str:
    parts = []
    for kind, pattern, base, act_in, act_out in L.PII_PATTERNS:
        context = f"len(list_filter({sql_list(L.PII_CONTEXT[kind])}, lambda w: contains(around, w))) > 0" if kind in L.PII_CONTEXT else "false"
        keep = "ctx" if kind == "BANK_ACCOUNT" else f"(ctx OR len(list_filter({sql_list(L.PII_NEGATIVE)}, lambda w: contains(around, w))) = 0)"
        rx = sql_text(pattern)
        parts.append(f"""
  SELECT run_id, {sql_text(kind)} AS kind, m AS text, s::INT AS start, (s + len(m))::INT AS "end", CASE WHEN ctx THEN {round(min(1.0, base + L.PII_BOOST), 2)} ELSE {base} END::DOUBLE AS score, ctx AS context, {sql_text(act_in if mode == 'input' else act_out)} AS action
  FROM (SELECT *, {context} AS ctx FROM (
    SELECT run_id, m, s, regexp_replace(m, '[\\s-]', '', 'g') AS c, lower(substr(text, greatest(s - 40, 0) + 1, s + len(m) + 40 - greatest(s - 40, 0))) AS around FROM (
      SELECT run_id, text, ms[i] AS m, (list_sum(list_transform(gs[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::BIGINT AS s
      FROM (SELECT run_id, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT run_id, text, regexp_extract_all(text, {rx}) AS ms, string_split_regex(text, {rx}) AS gs FROM texts)))))
  WHERE lower(trim(m)) NOT IN ({', '.join(map(sql_text, L.PII_ALLOWED))}) AND lower(c) NOT IN ({', '.join(map(sql_text, L.PII_ALLOWED))}) AND {keep} AND {_valid_sql(kind)}""")
    return f"WITH {views}, {texts}, found AS ({' UNION ALL '.join(parts)})"


def injection_phrase_score(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return r.select("run_id", D.injection_phrases(F.col("question"), F.col("format_given")).alias("p")).select("run_id", "p.score", "p.phrase", "p.target")


_ROWS = ", ".join(f"({k}, {sql_text(p)}, {sql_text(D.TIER_OF[p])})" for k, p in enumerate(D.ORDERED))
_S = L.PHRASE_SCORES
INJECTION_PHRASES_SQL = f"""WITH {V.REQUESTS},
phrases(k, p, tier) AS (VALUES {_ROWS}),
normal AS (SELECT run_id, format_given, 0 AS v, {_PLAIN} AS n FROM requests UNION ALL SELECT run_id, format_given, 1, {_LEET} FROM requests),
hits AS (SELECT run_id, format_given, v, k, p, tier, CASE WHEN strpos(n, p) = 0 THEN n ELSE array_to_string(string_split_regex(trim(substr(n, strpos(n, p) + len(p))), ' +')[1:10], ' ') END AS area
         FROM normal JOIN phrases ON contains(replace(n, ' ', ''), replace(p, ' ', ''))),
judged AS (SELECT *, list_filter({sql_list(L.ATTACK_TARGETS)}, lambda t: contains(area, t))[1] AS attack, list_filter({sql_list(L.SAFE_TARGETS)}, lambda t: contains(area, t))[1] AS safe FROM hits),
scored AS (SELECT *, (CASE WHEN tier = 'always' THEN {_S['always']} WHEN attack IS NOT NULL THEN {_S['attack']} WHEN safe IS NOT NULL THEN {_S['safe']} WHEN tier = 'encoding' THEN {_S['encoding']}
                      WHEN tier = 'weak' THEN {_S['weak']} WHEN format_given THEN {_S['strong_after_format']} ELSE {_S['strong']} END)::DOUBLE AS score, CASE WHEN tier <> 'always' THEN coalesce(attack, safe) END AS target FROM judged),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, v, k) = 1)
SELECT r.run_id, coalesce(b.score, 0.0::DOUBLE) AS score, b.p AS phrase, b.target FROM requests r LEFT JOIN best b USING (run_id)"""


def injection_structure_score(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return r.select("run_id", D.injection_structure(F.col("question")).alias("s")).select("run_id", "s.score", F.array_join("s.signals", ",").alias("signals"))


_MARK = f"list_filter({sql_list(L.ROLE_MARKERS)}, lambda m: contains(lower(question), m))[1]"
_BLOB = "regexp_matches(question, '[A-Za-z0-9+/]{30,}={0,2}')"
#: longest run of one character, without backreferences: characters that differ from their left neighbour begin runs
_RUN = "list_max(list_transform(list_filter(range(1, len({0}) + 1), lambda i: i = 1 OR ({0})[i] <> ({0})[i - 1]), lambda s: len(regexp_extract(substr({0}, s), '^' || regexp_escape(({0})[s]) || '+'))))"
_LONG = "len(regexp_extract_all(question, 'a{81,}')) > 0"
STRUCTURE_SQL = f"""WITH {V.REQUESTS},
s AS (SELECT run_id, {_MARK} AS mark, {_BLOB} AS blob, {_LONG} AS run FROM requests)
SELECT run_id, greatest(CASE WHEN mark IS NOT NULL THEN 0.75 ELSE 0 END, CASE WHEN blob THEN 0.6 ELSE 0 END, CASE WHEN run THEN 0.5 ELSE 0 END)::DOUBLE AS score,
       array_to_string(list_filter([CASE WHEN blob THEN 'encoded_blob' END, 'role_marker(' || mark || ')', CASE WHEN run THEN 'long_repeat' END], lambda x: x IS NOT NULL), ',') AS signals FROM s"""


def long_run(spark, sf_dir):
    return V.requests(spark, sf_dir).select("run_id", T.longest_run(F.col("question")).cast("bigint").alias("run"))


def cards(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\b(?:[0-9][ -]?){12,19}\b"), F.lit(0))).alias("m"))
    c = F.regexp_replace("m", r"[\s-]", "")
    return d.select("doc_id", c.alias("digits"), T.luhn_valid(c).alias("valid"))


def numeric_ids(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("2"), F.lpad((F.col("o_orderkey") * 7919 % 100000000000).cast("string"), 11, "0")).alias("digits"))
    return o.select("o_orderkey", "digits", T.verhoeff_valid(F.col("digits")).alias("valid"))


def pan_gstin(spark, sf_dir):
    k = F.col("c_custkey")
    pan = F.concat(F.lit("ABC"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (k % 26 + 1).cast("int"), F.lit(1)), F.lit("E"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F"))
    gst = F.concat(F.lpad((k % 45).cast("string"), 2, "0"), pan, F.lit("1Z5"))
    return V.table(spark, sf_dir, "customer").select("c_custkey", T.pan_valid(pan).alias("pan"), T.gstin_valid(gst).alias("gstin"))


_PAN = "'ABC' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (c_custkey % 26 + 1)::INT, 1) || 'E' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F'"
_month = "'2026-07-01 to 2026-07-31'", "'2026-08-01 to 2026-08-26'", "'2025-01-01 to 2025-12-31'"
_REL = "question"
for _phrase, _span in zip(("last month", "this month", "last year"), _month, strict=True):
    _REL = rf"regexp_replace({_REL}, '(?i)\b{_phrase}\b', {_span}, 'g')"
_SHORT = "question"
for _a, _b in L.SHORT_FORMS.items():
    _SHORT = twice(_SHORT, rf"(?i)(^|[^\p{{L}}\p{{N}}_]){_a}($|[^\p{{L}}\p{{N}}_])", rf"\1{_b}\2")

QUERIES = {
    "text_normalize": q(("plain", lambda c: T.normalize(c)), ("leet", lambda c: T.normalize(c, True))),
    "longest_run": long_run,
    "claim_split": claim_split,
    "content_words": q(("words", lambda c: F.array_join(T.content_words(c), " "))),
    "topic_key": q(("topic", T.topic_key)),
    "number_facts": q(("numbers", lambda c: F.array_join(T.numbers(c), " "))),
    "duration_facts": q(("durations", lambda c: F.array_join(T.durations(c), "|"))),
    "tag_extract": lambda s, d: V.answers(s, d).select("run_id", F.array_join(T.tags(F.col("answer")), ",").alias("tags")),
    "untagged_sentences": lambda s, d: V.answers(s, d).select("run_id", F.array_join(T.untagged_sentences(F.col("answer")), "|").alias("untagged")),
    "rewrite_short_forms": q(("rewritten", T.expand_short_forms)),
    "relative_dates": relative_dates,
    "rewrite_query": rewrite_query,
    "compound_split": q(("parts", lambda c: F.array_join(T.split_questions(c), "|"))),
    "counterfactual_pairs": counterfactual_pairs,
    "luhn_cards": cards,
    "verhoeff_ids": numeric_ids,
    "pan_gstin_valid": pan_gstin,
    "pii_findings": pii_findings,
    "pii_action": pii_action,
    "pii_mask": pii_mask,
    "pii_spans_merged": pii_spans_merged,
    "injection_phrase_score": injection_phrase_score,
    "injection_structure_score": injection_structure_score,
}
_WORDISH = r"(^|[^\p{L}\p{N}_])"
SQL = {
    "text_normalize": over_requests(f"{_PLAIN} AS plain", f"{_LEET} AS leet"),
    "longest_run": over_requests(f"coalesce({_RUN.format('question')}, 0)::BIGINT AS run"),
    "claim_split": f"WITH {V.ANSWERS}, {claims_sql('answers', 'run_id', 'answer')} SELECT run_id, k::BIGINT AS k, text, array_to_string(tags, ',') AS tags FROM claims",
    "content_words": over_requests(f"array_to_string({CONTENT('question')}, ' ') AS words"),
    "topic_key": over_requests(f"array_to_string(list_sort(list_distinct({TOPICS('question')})), ' ') AS topic"),
    "number_facts": over_requests(f"array_to_string({NUMBERS('question')}, ' ') AS numbers"),
    "duration_facts": over_requests(f"array_to_string({DURATIONS('question')}, '|') AS durations"),
    "tag_extract": rf"WITH {V.ANSWERS} SELECT run_id, array_to_string(regexp_extract_all(answer, '\[([A-Za-z]?\d+)\]', 1), ',') AS tags FROM answers",
    "untagged_sentences": rf"""WITH {V.ANSWERS}, parts AS (SELECT run_id, generate_subscripts(p, 1) AS i, trim(unnest(p)) AS part FROM (
  SELECT run_id, string_split_regex(regexp_replace(trim(answer), '([.!?])\s+|\n+', '\1' || chr(1), 'g'), '\x01+') AS p FROM answers))
SELECT run_id, coalesce(string_agg(part, '|' ORDER BY i) FILTER (WHERE len(part) >= 12 AND NOT regexp_matches(part, '\[([A-Za-z]?\d+)\]')), '') AS untagged FROM parts GROUP BY run_id""",
    "rewrite_short_forms": over_requests(f"{_SHORT} AS rewritten"),
    "relative_dates": over_requests(f"{_REL} AS rewritten"),
    "rewrite_query": rewrite_sql(),
    "compound_split": rf"""WITH {V.REQUESTS}, p AS (SELECT run_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(question, '{_WORDISH}and($|[^\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g'), '{_WORDISH}and($|[^\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g'), '\x01|\?'), lambda x: trim(x)), lambda x: len(x) > 12) AS p FROM requests)
SELECT run_id, CASE WHEN len(p) > 1 THEN array_to_string(p, '|') ELSE '' END AS parts FROM p""",
    "counterfactual_pairs": f"WITH {V.REQUESTS} {swaps_sql('requests', adjacent=True)}",
    "luhn_cards": rf"""SELECT doc_id, c AS digits, {_valid_sql('CREDIT_CARD')} AS valid FROM (SELECT doc_id, regexp_replace(m, '[\s-]', '', 'g') AS c
FROM (SELECT doc_id, unnest(regexp_extract_all({_asciied('text')}, '\b(?:[0-9][ -]?){{12,19}}\b')) AS m FROM documents))""",
    "verhoeff_ids": f"SELECT o_orderkey, c AS digits, {_valid_sql('AADHAAR')} AS valid FROM (SELECT o_orderkey, '2' || lpad((o_orderkey * 7919 % 100000000000)::VARCHAR, 11, '0') AS c FROM orders)",
    "pan_gstin_valid": f"SELECT c_custkey, substr(p, 4, 1) IN ({', '.join(map(sql_text, L.PAN_HOLDERS))}) AS pan, c_custkey % 45 BETWEEN 1 AND 38 AS gstin FROM (SELECT c_custkey, {_PAN} AS p FROM customer)",
    "pii_findings": _pii_sql("input") + ' SELECT run_id, kind, text, start, "end", score, context, action FROM found',
    "pii_spans_merged": _pii_sql("input") + f""", names AS (SELECT run_id, ms[i] AS text, (list_sum(list_transform(gs[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::INT AS s
  FROM (SELECT run_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT run_id, regexp_extract_all(text, {sql_text(T.ENTITY)}) AS ms, string_split_regex(text, {sql_text(T.ENTITY)}) AS gs FROM texts)))
SELECT run_id, kind, text, start, "end" FROM found UNION ALL
SELECT run_id, 'NAME', text, s, (s + len(text))::INT FROM names n WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.run_id = n.run_id AND f.start < n.s + len(n.text) AND f."end" > n.s)""",
    "pii_mask": _pii_sql("input").replace("WITH", "WITH RECURSIVE", 1) + f""", raw AS (SELECT run_id, question AS text FROM requests UNION ALL SELECT -1 - doc_id, text FROM documents),
masks AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY start DESC, list_position({sql_list([p[0] for p in L.PII_PATTERNS])}, kind) DESC) AS k FROM found WHERE action <> 'allow'),
steps AS (SELECT run_id, 0::BIGINT AS k, text FROM raw WHERE run_id IN (SELECT run_id FROM found) UNION ALL
  SELECT s.run_id, s.k + 1, substr(s.text, 1, m.start) || '[' || m.kind || ']' || substr(s.text, m."end" + 1) FROM steps s JOIN masks m ON m.run_id = s.run_id AND m.k = s.k + 1)
SELECT run_id, arg_max(text, k) AS masked_text FROM steps GROUP BY run_id""",
    "pii_action": _pii_sql("output")
    + """ SELECT t.run_id, coalesce(max(score), 0.0::DOUBLE) AS score, CASE max(CASE action WHEN 'block' THEN 3 WHEN 'redact' THEN 2 WHEN 'mask' THEN 1 ELSE 0 END) WHEN 3 THEN 'block' WHEN 2 THEN 'redact' WHEN 1 THEN 'mask' ELSE 'allow' END AS action,
  count(kind)::INT AS count, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS types FROM texts t LEFT JOIN found f ON f.run_id = t.run_id GROUP BY t.run_id""",
    "injection_phrase_score": INJECTION_PHRASES_SQL,
    "injection_structure_score": STRUCTURE_SQL,
}
