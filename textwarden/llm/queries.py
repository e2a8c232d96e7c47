"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, decontaminate, importance, language_id, license_scan, line_dedup, mixing, quality_rules, suffix_dedup, topk_search, url_filter, whitening
from .ngram_jaccard import jaccard_components

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce({LOWER}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT w.doc_id, count(sh.s) AS n_shingles FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n_shingles + q.n_shingles - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT n.doc_id, n.n_shingles, min(reach.y) AS component_id FROM n JOIN reach ON reach.x = n.doc_id GROUP BY ALL
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, as files in folders of a thousand below their source. A null doc_id is a file named "none"."""
    docs = table(spark, sf_dir, "documents")
    folder = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), folder, F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    found = license_scan.scan(docs.select(path.alias("path"), "text"), license_scan.templates(spark))
    return found.select(F.substring_index("path", "/", -1).try_cast("long").alias("doc_id"), "license", "how", "score")


def license_sql(files: str, answer: str, templates: list[tuple[str, str]] = license_scan.TEMPLATES, threshold: float = 0.6) -> str:
    """SQL for a scan of the rows (path, text) that the SQL `files` gives; answer is what to select of path, license, how, score."""
    known = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in templates)
    stop = ", ".join(f"'{w}'" for w in license_scan.STOP_WORDS)
    return rf"""
WITH t(license, text) AS (VALUES {known}),
bag AS (SELECT license, term, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(text), '{license_scan.TERM}')) AS term FROM t) WHERE term NOT IN ({stop}) GROUP BY ALL),
many AS (SELECT 1 + count(DISTINCT license) AS many FROM t),
v AS (SELECT term, ln((SELECT many FROM many)::DOUBLE / (1 + count(*))) + 1 AS idf FROM bag GROUP BY term),
u AS (SELECT license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS w FROM bag JOIN v USING (term)),
d AS (SELECT row_number() OVER () AS row, path, text, regexp_replace(path, '(^|/)[^/]*$', '') AS folder FROM ({files})),
p AS (SELECT row, unnest(list_prepend(text, string_split(text, chr(10)))) AS part, unnest(range(0, len(string_split(text, chr(10))) + 1)) AS line FROM d WHERE text IS NOT NULL),
q AS (SELECT row, line, term, count(*) AS tf FROM (SELECT row, line, unnest(regexp_extract_all(lower(part), '{license_scan.TERM}')) AS term FROM p) WHERE term NOT IN ({stop}) GROUP BY ALL),
z AS (SELECT row, line, q.term, tf * coalesce(idf, ln((SELECT many FROM many)::DOUBLE) + 1) AS q FROM q LEFT JOIN v ON v.term = q.term),
size AS (SELECT row, line, sqrt(sum(q * q)) AS length FROM z GROUP BY ALL),
dots AS (SELECT row, line, license, sum(q * w) AS dot FROM z JOIN u ON u.term = z.term GROUP BY ALL),
near AS (SELECT row, CASE WHEN line = 0 THEN 'file' ELSE 'header' END AS how, license, floor(dot / length * 1e6 + 0.5) / 1e6 AS score FROM dots JOIN size USING (row, line)),
best AS (SELECT * FROM near WHERE score >= {threshold}::DOUBLE QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, how, license) = 1),
own AS (SELECT d.row, path, folder, license, how, score FROM d LEFT JOIN best USING (row)),
spoken AS (SELECT folder, license AS above FROM own WHERE license IS NOT NULL AND path IS NOT NULL AND (how = 'file' OR regexp_matches(path, '{license_scan.LICENCE_NAMES}'))
           QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, license) = 1),
up AS (SELECT row, unnest(range(0, len(string_split(folder, '/')) + 1)) AS k, folder FROM own WHERE license IS NULL AND path IS NOT NULL),
heir AS (SELECT up.row, spoken.above FROM up JOIN spoken ON spoken.folder = array_to_string(string_split(up.folder, '/')[1 : k], '/') QUALIFY row_number() OVER (PARTITION BY up.row ORDER BY k DESC) = 1),
found AS (SELECT path, coalesce(license, above) AS license, coalesce(how, CASE WHEN above IS NOT NULL THEN 'inherited' END) AS how, score FROM own LEFT JOIN heir USING (row))
SELECT {answer} FROM found
"""


OP2_SQL = license_sql(
    "SELECT coalesce(source, 'none') || '/' || coalesce((doc_id // 1000)::VARCHAR, 'none') || '/' || coalesce(doc_id::VARCHAR, 'none') AS path, text FROM documents",
    "TRY_CAST(string_split(path, '/')[-1] AS BIGINT) AS doc_id, license, how, score",
)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, and in how many parts; both are counted over what the splitting tree has placed in shards."""
    placed = F.filter("parts", lambda p: p["shard"].between(0, 63))
    taken = F.aggregate(placed, F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("taken")
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), shards=64)
    return mixed.select("doc_id", "size", "source_size", "target", taken, F.size(placed).cast("long").alias("n_parts"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS w, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
g AS (SELECT *, ((sid - 1) % 3 + 1)::BIGINT AS k FROM s),
r AS (SELECT *, (sum(w) OVER () - coalesce(sum(3 * w) OVER (ORDER BY 3 * w / k, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
             (sum(k) OVER (ORDER BY 3 * w / k, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS shares,
             row_number() OVER (ORDER BY 3 * w / k, sid) AS step FROM g),
f AS (SELECT min(step) AS stop FROM r WHERE rest::HUGEINT * k <= 3::HUGEINT * w * shares),
l AS (SELECT f.stop, r.rest, r.shares FROM r, f WHERE r.step = f.stop),
t AS (SELECT r.source, r.sid, r.w, r.n, CASE WHEN r.step >= l.stop THEN (l.rest * r.k)::DOUBLE / l.shares::DOUBLE ELSE (3 * r.w)::DOUBLE END AS target FROM r, l),
q AS (SELECT *, least(round(target)::BIGINT, 3 * w) AS quota, greatest(16, ceil(n / 5000))::BIGINT AS blocks FROM t),
c AS (SELECT *, CASE WHEN w > 0 THEN quota // w ELSE 0 END AS copies, CASE WHEN w > 0 THEN quota % w ELSE 0 END AS part FROM q),
o AS (SELECT d.doc_id, d.size, c.w, c.target, c.copies, c.part,
             coalesce(sum(d.size) OVER (PARTITION BY c.sid ORDER BY d.h % c.blocks, d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, w AS source_size, target, copies * size + greatest(0, least(size, part - gone)) AS taken,
       CASE WHEN size > 0 THEN copies ELSE 0 END + CASE WHEN least(size, part - gone) > 0 THEN 1 ELSE 0 END AS n_parts FROM o
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the runs of two lines or more that occur earlier."""
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "lines_removed", F.md5("text").alias("text_md5"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, i, row_number() OVER (PARTITION BY l[i], l[i + 1] ORDER BY doc_id, i) > 1 AS again FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM d)),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i, TRUE AS gone FROM p WHERE again),
x AS (SELECT doc_id, i, l[i] AS t, coalesce(gone, FALSE) AS gone FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d) LEFT JOIN g USING (doc_id, i)),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(t, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS lines_removed, CASE WHEN text IS NOT NULL THEN md5(coalesce(kept, '')) END AS text_md5 FROM documents LEFT JOIN r USING (doc_id)
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 50 words or more that repeat, by document."""
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row)
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 20
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document consists of benchmark passages."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


_OP8_WORDS = rf"list_filter(regexp_split_to_array(coalesce({LOWER}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP8_SQL = rf"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, {_OP8_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
      FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_OP8_WORDS} AS w FROM documents),
x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT DISTINCT x.doc_id, x.n, x.i, p.item_id FROM x JOIN p USING (phrase)),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document."""
    return quality_rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of bytes that repeat, by document."""
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each page by its URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), url_filter.rule_table(spark))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the documents, drawn towards the benchmark."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_CRC_BYTE = "list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
OP12_SQL = rf"""
WITH tab AS (SELECT list({_CRC_BYTE} ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS row, doc_id, {_OP8_WORDS} AS w FROM documents),
b AS (SELECT {_OP8_WORDS} AS w FROM benchmark),
n(k) AS (VALUES (1), (2), (3)),
f AS (SELECT row, array_to_string(w[i : i + k - 1], ' ') AS f FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, n WHERE len(w) >= k)),
g AS (SELECT array_to_string(w[i : i + k - 1], ' ') AS f FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, n WHERE len(w) >= k)),
u AS (SELECT DISTINCT f FROM (SELECT f FROM f UNION ALL SELECT f FROM g)),
x AS (SELECT f, hex(encode(f)) AS x FROM u),
c AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
        lambda a, y: xor(a // 256, t[xor(a % 256, y) + 1]))) % 10000 AS bucket FROM x, tab),
s AS (SELECT bucket, count(*) AS s FROM f JOIN c USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN c USING (f) GROUP BY bucket),
gain AS (SELECT r.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE)))::BIGINT AS gain
         FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN c USING (f) JOIN gain USING (bucket) GROUP BY row),
e AS (SELECT row, doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN w USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id, row) AS rank, count(*) OVER () AS n FROM e WHERE doc_id IS NOT NULL AND n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END::BIGINT AS rank FROM e LEFT JOIN r USING (row)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of each vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_license_scan": op2_license_scan,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_topk_search": op7_topk_search,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_rules": op9_quality_rules,
    "op10_chunk_dedup": op10_chunk_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_importance": op12_importance,
    "op13_whitening": op13_whitening,
}
SQL = {
    "op1_ngram_jaccard": OP1_SQL,
    "op2_license_scan": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op7_topk_search": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op12_importance": OP12_SQL,
}
