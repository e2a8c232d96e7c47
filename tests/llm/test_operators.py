"""Each operator against brute force on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import chunk_dedup, components, decontaminate, hashing, language_id, license_scan, line_dedup, mixing, ngram_jaccard, quality_rules, suffix_dedup, topk_search
from textwarden.llm.queries import license_sql, op2_license_scan

from .conftest import WORDS, odd_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [(i, t) for i, t, *_ in odd_rows()]


def spaced(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def test_jaccard(docs, empty):
    got = ngram_jaccard.jaccard_components(docs, 4, 85, 100).collect()
    sets = defaultdict(list)
    for i, t in TEXTS:
        w = spaced(t)
        sets[i].append(frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset())
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(s)) for i, own in sets.items() for s in own)
    top = {i: i for i in sets if i is not None}
    find = lambda x: x if top[x] == x else find(top[x])
    for a in top:
        for b in top:
            if a < b and any(s and t and 100 * len(s & t) >= 85 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: find(i) for i in top}
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_jaccard_bands_lose_no_pair():
    """Random pairs at the threshold share a key, for small and large sets."""
    r = np.random.Generator(np.random.PCG64(1))
    bands = ngram_jaccard.Bands(85, 100)
    for n in [1, 2, 5, 7, 8, 12, 13, 20, 33, 60, 150, 400, 1500]:
        for _ in range(40):
            every = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            gone = int(r.integers(0, n + 1))
            a, b = np.sort(every[:n]), np.sort(np.concatenate((every[gone // 2 : n], every[n : n + gone - gone // 2])))
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= 85 * (len(a) + len(b) - shared):
                assert set(np.concatenate(bands.keys(a)).tolist()) & set(np.concatenate(bands.keys(b)).tolist())


def test_near_copies_go(docs):
    left = [r["doc_id"] for r in ngram_jaccard.drop_near_copies(docs).collect()]
    assert 1 in left and 2 not in left and 3 not in left and left.count(12) == 2 and {6, 7, 10, None} <= set(left) and 9 not in left


def test_components(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(None, 3), (5, 5)]
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = components.connected_components(spark.createDataFrame(links, "src long, dst long"))
    assert {x["id"]: x["component"] for x in got.collect()} == {x: find(x) for x in top}


def test_windows_of_words():
    import pyarrow as pa

    texts = ["A b  c", None, "", "b C\nd", "é x"]
    w = next(hashing.word_slices(pa.array(texts)))
    assert np.diff(w.first).tolist() == [3, 0, 0, 3, 2] and w.code[1] == w.code[3] and w.code[2] == w.code[4] and len(set(w.code.tolist())) == 6


def test_suffixes(docs, empty):
    length = 20
    counts, places = Counter(), defaultdict(set)
    for i, t in TEXTS:
        if i is not None and t is not None:
            w = spaced(t)
            for k in range(len(w) - length + 1):
                places[tuple(w[k : k + length])].add((i, k))
    counts = {k: min(v) for k, v in places.items() if len(v) > 1}
    want = {}
    for i, t in TEXTS:
        w = spaced(t) if i is not None else []
        marks, later = set(), set()
        for k in range(len(w) - length + 1):
            if (key := tuple(w[k : k + length])) in counts:
                marks |= set(range(k, k + length))
                later |= set(range(k, k + length)) if counts[key] != (i, k) else set()
        if marks:
            want[i] = (len(w), len(marks), len(later))
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"], r["n_removable"]) for r in suffix_dedup.repeated_spans(docs, length, 6).collect()}
    assert got == want
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_chunks(docs, empty):
    spans = {r["doc_id"]: r for r in chunk_dedup.repeated_spans(docs, least=100).collect()}
    assert {1, 2, 3, 4, 5, 14, 15, 16} <= set(spans) and not set(spans) & set(range(20, 60)) and not {6, 7, 8, 10, 11} & set(spans)
    assert spans[1]["n_removable"] == 0 < spans[2]["n_removable"]
    texts = dict((i, t) for i, t in TEXTS if i is not None)
    for r in chunk_dedup.dedup_substrings(docs, least=100).collect():
        assert len(r["text"].encode()) == len(texts[r["doc_id"]].encode()) - spans[r["doc_id"]]["n_removable"]
    assert chunk_dedup.repeated_spans(empty).count() == 0


def test_chunks_of_short_words_and_short_copies(spark):
    """Passages of 51 short words, and copies of a few bytes, are found."""
    r = random.Random(8)
    some = lambda n, most: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, most))) for _ in range(n))
    rows = []
    for k in range(100):
        passage = some(51, 3 if k % 2 else 5)
        rows += [(2 * k, f"{some(40, 9)} {passage} {some(30, 9)}"), (2 * k + 1, f"{some(25, 9)} {passage} {some(35, 9)}")]
    rows += [(300, "short copy"), (301, "short copy"), (302, "x"), (303, "x"), (304, "short alone"), (305, "ab cd"), (305, "ab cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in chunk_dedup.repeated_spans(df).collect()}
    assert set(got) == {*range(200), 300, 301, 302, 303}
    assert got[301]["removable"] == [(0, 10)] and got[300]["n_removable"] == 0 and got[303]["n_removable"] == 1
    assert {x["doc_id"]: x["text"] for x in chunk_dedup.dedup_substrings(df).where("doc_id >= 300").collect()} == {301: "", 303: ""}


def test_gear_hash():
    data = np.frombuffer(prose(random.Random(1), 60).encode(), dtype=np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunk_dedup.gear_hashes(data).tolist() == want


def test_lines(docs, empty):
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(TEXTS) and set(docs.columns) < set(rows[0].asDict())

    seen, want = set(), {}
    for i, t in sorted((x for x in set(TEXTS) if x[0] is not None and x[1] is not None)):
        lines, gone = t.split("\n"), set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            gone |= {k, k + 1} if pair in seen else set()
            seen.add(pair)
        want[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in rows if r["doc_id"] is not None and r["text"] is not None}
    assert got == want and any(g for _, g in want.values())
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_chunks(spark):
    """Chunks are the local minima of a rolling hash, far enough apart; they come back after lines put in before; copies beyond one task's are all found."""
    r = random.Random(3)
    lines = [prose(r, 4) for _ in range(300)]
    cases = [(0, lines), (1, ["new line", *lines]), (2, ["only"]), (3, [""]), (4, ["same"] * 40)]
    df = spark.createDataFrame([(k, "\n".join(x)) for k, x in cases], "doc_id long, text string").select("doc_id", F.split("text", "\n").alias("lines"))
    spans = {x["doc_id"]: [tuple(s) for s in x["s"]] for x in df.select("doc_id", line_dedup.chunk_spans(F.col("lines"), 2).alias("s")).collect()}
    for k, x in cases:
        assert spans[k][0][0] == 1 and spans[k][-1][1] == len(x) and all(a[1] + 1 == b[0] for a, b in zip(spans[k], spans[k][1:]))
        assert all(b - a >= 2 for a, b in spans[k][1:-1])
    moved = {(a - 1, b - 1) for a, b in spans[1]}
    assert len(moved & set(spans[0])) >= len(spans[0]) - 2 > 30 and spans[2] == spans[3] == [(1, 1)]
    docs = spark.createDataFrame([(k, "\n".join(lines[k % 7 : 9] + [f"own {k}"])) for k in range(60)], "doc_id long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "SALT_ROWS", 4)
        salted = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    assert salted == sorted(map(tuple, line_dedup.dedup_lines(docs, reach=5).collect()))
    assert [(k, n) for k, _, n in salted] == [(k, 0 if k == 0 else 9 - k % 7) for k in range(60)]


def test_contamination(spark, docs, empty):
    texts = dict((i, t) for i, t in TEXTS if i is not None)
    items = [("p", " ".join(texts[4].split()[45:75])), ("q", "nowhere to be seen at all in any of these texts here or there"), ("s", "x Y, z"), ("p", None), (None, "one"), ("e", ""), ("d", texts[1])]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("phrase", F.lit(1))
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER)) if w]
    windows = [(i, tuple(w[k : k + 13])) for i, t in items if i is not None and (w := words(t)) for k in range(max(1, len(w) - 12))]
    want = []
    for i, t in TEXTS:
        w = words(t)
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(item)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = [tuple(r) for r in decontaminate.contamination(docs, bench).drop("row").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[-1] for r in got) >= 5
    # Terms and windows beyond a broadcast, and texts of several pieces, give the same rows.
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "PIECE", 16)
        again = [tuple(r) for r in decontaminate.contamination(docs, bench, broadcast_rows=20).drop("row").collect()]
    assert sorted(again, key=repr) == sorted(want, key=repr)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not decontaminate.contamination(docs, bench.where("false")).where("contaminated").count()
    first, other, third = (texts[4].split()[k] for k in (50, 53, 48))
    for terms, within in (([first, other], 5), ([first, other, third], 3), ([first, other], 1), ([first], 4)):
        places = []
        for i, t in TEXTS:
            w = words(t)
            places += [(i, k) for k, x in enumerate(w) if x == first and all(o in w[max(0, k - within) : k + within + 1] for o in terms[1:])]
        assert sorted(map(tuple, decontaminate.proximity_matches(docs, terms, within).collect()), key=repr) == sorted(places, key=repr)


def test_mixing(docs, empty):
    mixed = mixing.mix_sources(docs, shards=4)
    rows = mixed.collect()
    assert len(rows) == len(TEXTS) and sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(docs, shards=4).collect()))
    by = defaultdict(list)
    for r in rows:
        assert r["taken"] == sum(p["words"] for p in r["parts"]) <= 3 * r["size"]
        assert all(0 <= p["shard"] < 4 for p in r["parts"])
        by[r["source"]].append(r)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(spaced(t))) for i, t in TEXTS)
    total = sum(r["size"] for r in rows)
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, target, open_ = {s: k % 3 + 1 for k, s in enumerate(order)}, dict.fromkeys(order, 0.0), set(order)
    while True:
        rest = total - sum(3 * sizes[s] for s in order if s not in open_)
        for s in order:
            target[s] = rest * weights[s] / sum(weights[x] for x in open_) if s in open_ else 3.0 * sizes[s]
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
    for s, own in by.items():
        assert abs(own[0]["target"] - target[s]) < 1e-6 and abs(sum(r["taken"] for r in own) - target[s]) <= 1
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_shards(spark):
    """Shards hold equal numbers of the blocks placed, but for one a level of the tree; rows without doc_id are dealt over the blocks."""
    rows = [(None if k % 3 == 0 else k, "w " * (k % 9 + 1) + str(k), f"s{k % 4}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, shards=8).collect()
    placed = {(r["source"], p["copy"], p["shard"]) for r in got for p in r["parts"]}
    assert {p[2] for p in placed} == set(range(8))
    blocks = mixing.LEAST_BLOCKS * len({p[:2] for p in placed})
    words = Counter()
    for r in got:
        for p in r["parts"]:
            words[p["shard"]] += p["words"]
    mean = sum(words.values()) / 8
    assert all(abs(n - mean) <= 5 * mean * 8 / blocks for n in words.values())
    by_shard = Counter(p["shard"] for r in got if r["doc_id"] is None for p in r["parts"])
    assert len(by_shard) == 8 and max(by_shard.values()) < 3 * min(by_shard.values())


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([(1, 100), (2, 7), (3, 0), (4, 33)], "sid int, blocks long")
    ends = {r["sid"]: r["ends"] for r in mixing.splitting_tree(quotas, 8, "s").collect()}
    assert {k: v[-1] for k, v in ends.items()} == {1: 100, 2: 7, 3: 0, 4: 33} and all(len(v) == 8 and sorted(v) == v for v in ends.values())
    totals = np.diff([0, *np.sum(list(ends.values()), axis=0)])
    assert totals.max() - totals.min() <= 3


def test_languages(spark, docs, empty):
    r = random.Random(4)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(n))
    rows = [(k, make("abcdefg" if k % 2 else "nopqrstéé", 30), "x" if k % 2 else "y") for k in range(200)] + [(900, "123 !?", "x"), (901, None, "y"), (902, "", "x"), (None, make("abc", 9), None)]
    got = {x["doc_id"]: x for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:200]) and all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902))
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, *_ in rows[:200]) and all(0 <= x["score"] <= 1 for x in got.values())
    assert language_id.identify(docs).count() == len(TEXTS) and language_id.identify(empty).count() == 0


def test_top_k(spark):
    r = np.random.Generator(np.random.PCG64(3))
    rows = [(k, r.normal(0, 0.2, 16).tolist(), 0) for k in range(300)] + [(300, None, 0), (320, [None] * 16, 0), (340, [float("nan")] * 16, 0), (360, [float("inf")] * 16, 0), (None, [0.1] * 16, 0), (301, [0.5] * 4, 0), (7, [0.5] * 16, 0), (380, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    fine = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in fine:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in fine if j != i)[:20]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect())) == sorted(want)
    assert topk_search.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Rows of one vec_id are each other's candidates; equal rows are answered each."""
    rows = [(20, [0.5, 0.5]), (20, [0.9, 0.1]), (40, [0.1, 0.1]), (40, [0.1, 0.1]), (3, [0.2, 0.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=2).collect()
    whole = [[int(np.floor(64 * x)) for x in v] for _, v in rows]
    want = []
    for a, (i, _) in enumerate(rows):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(whole[a], whole[b])), rows[b][0]) for b in range(len(rows)) if b != a)[:2]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 8 and (20, 1, 20, whole[0][0] * whole[1][0] + whole[0][1] * whole[1][1]) in want


def test_quality(spark, docs, empty):
    r = random.Random(6)
    rows = [(k, prose(r, 40).upper() + " ###" if k % 4 == 0 else prose(r, 40)) for k in range(400)]
    df = spark.createDataFrame([*rows, (None, "x"), (999, None), (998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality_rules.classify(df, labels).collect()}
    assert sum(got[k]["predicted"] == int(k % 4 > 0) for k in range(400)) >= 395 and all(0 <= x["score"] <= 1 for x in got.values())
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(400))
    assert quality_rules.classify(docs, labels.where("false")).count() == len(TEXTS) and quality_rules.classify(empty, labels).count() == 0


def test_licences(spark, empty):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "code\n" + prose(random.Random(1), 30)), ("a/b/d.py", "# Licensed under the Apache License, Version 2.0.\n" + prose(random.Random(2), 50)),
        ("e/f.py", "nothing here"), ("a/x", None), (None, "Released under the MIT License."), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("g", ""), ("e/f.py", "nothing here"),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit("extra"))
    got = Counter((r["path"], r["license"], r["how"]) for r in license_scan.scan(df, license_scan.templates(spark)).collect())
    assert got == Counter([("a/LICENSE", "MIT", "file"), ("a/b/c.py", "GPL-3.0", "inherited"), ("a/b/d.py", "Apache-2.0", "header"), ("e/f.py", None, None), ("e/f.py", None, None), ("a/x", "MIT", "inherited"), (None, "MIT", "file"), ("a/b/COPYING", "GPL-3.0", "file"), ("g", None, None)])
    assert license_scan.scan(df.where("false"), license_scan.templates(spark)).count() == 0
    assert license_scan.scan(df, license_scan.templates(spark).where("false")).where("license is not null").count() == 0


def test_licences_against_sql(spark):
    """A tree of files with licence files at several depths, notices, ties, a long text, nulls and repeated rows, against SQL."""
    r = random.Random(6)
    notices = [text for _, text in license_scan.TEMPLATES]
    rows = [("deep/a/b/c/d/e.py", prose(r, 40)), (None, notices[0]), (None, None), ("x", None), ("x/LICENSE", notices[1]), ("x/COPYING", notices[2]), ("x/y/z", ""), ("long.txt", prose(r, 5000) + "\n" + notices[3].upper() + "\n" + prose(r, 5000))]
    for k in range(120):
        path = "/".join(r.choice("abc") for _ in range(r.randrange(4)))
        name = r.choice(["LICENSE", "COPYING.txt", "notice", f"f{k}.py", f"g{k}.md", "same.py"])
        lines = [prose(r, r.randrange(12)) for _ in range(r.randrange(1, 6))]
        if name[0] in "LCn":
            lines = [r.choice(notices)] * r.randrange(1, 3)
        elif r.random() < 0.3:
            lines.insert(r.randrange(len(lines)), r.choice(["# ", ""]) + r.choice(notices) + r.choice(["", " the the", " MIT", " more words of our own"]))
        rows.append((f"{path}/{name}" if path else name, "\n".join(lines)))
    df = spark.createDataFrame(rows, "path string, text string").repartition(3)
    got = license_scan.scan(df, license_scan.templates(spark)).select("path", "license", "how", "score").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE files (path VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO files VALUES (?, ?)", rows)
    want = con.sql(license_sql("SELECT * FROM files", "path, license, how, score")).fetchall()
    assert Counter(map(tuple, got)) == Counter(want)
    assert {x["how"] for x in got} == {"file", "header", "inherited", None}


def test_licences_of_documents_without_ids(spark, tmp_path):
    """The query takes rows whose doc_id or source is null."""
    rows = [(None, license_scan.TEMPLATES[1][1], None), (5, "plain words", None), (None, None, "web"), (7, None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(x["doc_id"], x["license"], x["how"]) for x in op2_license_scan(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter([(None, "MIT", "file"), (5, None, None), (None, None, None), (7, None, None)])


def test_words_are_words():
    assert len(WORDS) == len(set(WORDS))


def test_jaccard_of_ids_with_several_texts(spark):
    """A doc_id with two texts ties what each of them links to."""
    r = random.Random(3)
    a, b = prose(r, 60), prose(r, 60)
    rows = [(1, a), (2, b), (5, a), (5, b + " more"), (6, prose(r, 50)), (5, None)]
    got = {(x["doc_id"], x["component_id"]) for x in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 1), (2, 1), (6, 6)} <= got and {c for i, c in got if i == 5} == {1}


def test_jaccard_against_passages_that_many_share(spark):
    """Documents that share most of a passage but not enough, and near copies among them, are told apart exactly."""
    r = random.Random(12)
    passage, rows = prose(r, 30).split(), []
    for k in range(120):
        own = prose(r, r.choice([4, 8, 20, 60])).split()
        rows.append((3 * k, " ".join([*own, *passage])))
        if k % 3 == 0:
            own[r.randrange(len(own))] = "changed"
            rows.append((3 * k + 1, " ".join([*own, *passage])))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = {i: i for i in sets}
    for _ in sets:
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert links and {x["doc_id"]: x["component_id"] for x in got} == want


def test_tables_on_the_way_are_deleted(spark, docs):
    import os

    folder = f"{spark.conf.get('spark.checkpoint.dir')}/textwarden".removeprefix("file://")
    before = set(os.listdir(folder))
    out = ngram_jaccard.jaccard_components(docs)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() == len(TEXTS)


def _share_left(x: np.ndarray, is_query: np.ndarray, k: int = 20) -> float:
    """The share of pairs that get exact products, when each query knows its k-th best score."""
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    turned = topk_search._turned(x, axes)
    scores = np.where(np.eye(len(x), dtype=bool), -np.inf, x @ x.T)[is_query]
    reached = np.partition(scores, -k, axis=1)[:, -k]
    by = [topk_search._summary(turned, sizes) for sizes in topk_search.levels(x.shape[1])]
    left = topk_search.survivors([s[is_query] for s in by], by, reached, np.isfinite(scores))
    assert (left >= (scores >= reached[:, None])).all()
    return left.mean()


def test_levels_prune(spark):
    """Of clustered vectors few survive the levels; of the test tables', which have no direction of their own, one in eight."""
    r = np.random.Generator(np.random.PCG64(11))
    centres = r.normal(0, 20, (12, 64))
    clustered = np.floor(centres[r.integers(0, 12, 1500)] + r.normal(0, 3, (1500, 64)))
    assert _share_left(clustered, np.arange(1500) % 20 == 0) < 0.1
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    table = np.floor(64 * np.array([x["embedding"] for x in rows], dtype=float))
    assert _share_left(table, np.array([x["vec_id"] % 20 == 0 for x in rows])) < 0.13


def test_top_k_of_many_blocks(spark, monkeypatch):
    """Thresholds carried from the first block of candidates to the others change no result, whole numbers beyond 2**53 included."""
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 10)
    r = np.random.Generator(np.random.PCG64(5))
    for scale in (1.0, 3e6):
        v = [[float(x) for x in row] for row in r.integers(-3, 4, (250, 6)) * scale]
        df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
        whole = [[int(np.floor(x * 64)) for x in row] for row in v]
        want = []
        for i in range(0, 250, 10):
            best = sorted((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in range(250) if j != i)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
        assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 10 == 0).collect())) == sorted(want)


def test_languages_in_groups(spark, monkeypatch):
    """Languages beyond one group's number are told apart as well, and learning is bounded in bytes."""
    monkeypatch.setattr(language_id, "GROUP", 3)
    r = random.Random(4)
    letters = ["abc", "defg", "hijk", "lmno", "pqrs", "tuvw", "xyzé"]
    make = lambda k: " ".join("".join(r.choice(letters[k]) for _ in range(r.randrange(2, 8))) for _ in range(30))
    rows = [(i, make(i % 7), f"l{i % 7}") for i in range(210)] + [(500, None, None), (501, "...", "l1"), (502, "abc" * 500_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language_id.identify(df, sample_bytes=2000).collect()}
    assert len(got) == len(rows) and all(got[i]["lang_pred"] == f"l{i % 7}" and got[i]["score"] > 0.9 for i in range(210))
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[502]["lang_pred"] == "l0"
    assert language_id.chosen(df.select(F.col("doc_id").alias("key"), "text", "lang"), 400, 2000).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).where("n > 2000").count() == 0


def test_language_costs_by_hand():
    """Code lengths equal a plain walk from the longest context down."""
    r = random.Random(2)
    by = {"a": [bytes(r.choice(b"xyz ") for _ in range(200)), b"zz"], "b": [bytes(r.choice(b"yzw.") for _ in range(150))]}
    model = language_id.Model(by)
    text = bytes(r.choice(b"wxyz .!") for _ in range(80))
    for k, name in enumerate(model.names):
        counts = Counter()
        for t in by[name]:
            t = b"\n" * 4 + t
            for i in range(4, len(t)):
                for n in range(5):
                    counts[t[i - n : i], t[i]] += 1
        total, kinds = Counter(), Counter()
        for (context, _), n in counts.items():
            total[context] += n
            kinds[context] += 1
        want, padded = [], b"\n" * 4 + text
        for i in range(4, len(padded)):
            bits = 0.0
            for n in range(4, -1, -1):
                context = padded[i - n : i]
                if counts[context, padded[i]]:
                    bits += np.log2((total[context] + kinds[context]) / counts[context, padded[i]])
                    break
                bits += np.log2((total[context] + kinds[context]) / kinds[context]) if total[context] else 0.0
            else:
                bits += 8.0
            want.append(bits)
        assert np.allclose(model.costs(np.frombuffer(padded, dtype=np.uint8))[:, k], want, atol=1e-4)


def test_held_out_accuracy_on_the_test_tables(spark):
    """Languages and quality of documents that nothing was learnt from."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.98
    told = quality_rules.classify(docs, labels).where("held_out").join(labels, "doc_id")
    assert told.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] >= 0.95


def test_substrings_of_ids_with_several_texts(spark):
    """A text loses its own repeats only, whatever other texts its doc_id has; rows equal in doc_id and text are one document."""
    r = random.Random(21)
    shared, own, other = prose(r, 80), prose(r, 120), prose(r, 60)
    rows = [(1, shared), (7, own), (7, f"{other} {shared}"), (8, other + " once"), (8, other + " once"), (None, shared), (9, None), (10, "")]
    got = chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got} == {7, 8} and own not in [x["text"] for x in got]
    left = next(x["text"] for x in got if x["doc_id"] == 7)
    assert left.startswith(other) and len(left) < len(other) + len(shared) / 4


def test_chunk_spans_by_brute_force(spark):
    """Spans of a small corpus against chunks cut byte by byte and compared as bytes."""
    r = random.Random(30)
    passages = [prose(r, 45) for _ in range(4)]
    texts = [" ".join(r.choice(passages) if r.random() < 0.4 else prose(r, 25) for _ in range(r.randrange(1, 7))) for _ in range(60)] + ["", "é" * 300, "short", "short"]

    def chunks(text: bytes):
        h, hashes = 0, []
        for k, b in enumerate(text):
            h = (2 * h + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
            low = h << (chunk_dedup.WINDOW - chunk_dedup.SEEN) & 0xFFFFFFFF
            inside = k + 1 < len(text) and text[k + 1] & 0xC0 == 0x80
            hashes.append(0 if inside or k < chunk_dedup.SEEN - 1 else low)
        ends = [k + 1 for k, x in enumerate(hashes) if x and x == max(hashes[max(0, k - 10) : k + 11])] + [len(text)]
        return [(a, b) for a, b in zip([0, *ends], ends) if a < b]

    places = defaultdict(list)
    for i, t in enumerate(texts):
        for a, b in chunks(t.encode()):
            places[t.encode()[a:b]].append((i, a))

    def spans(i: int, raw: bytes, later: bool):
        out = []
        for a, b in chunks(raw):
            at = places[raw[a:b]]
            if len(at) > 1 and not (later and min(at) == (i, a)):
                out = [*out[:-1], (out[-1][0], b)] if out and out[-1][1] == a else [*out, (a, b)]
        out = [(a, b) for a, b in out if sum(c in b" \t\n" for c in raw[a:b]) >= 12 or b - a >= 160]
        same = [k for k, t in enumerate(texts) if t.encode() == raw]
        if 0 < len(raw) < 160 and len(same) > 1 and not (later and same[0] == i):
            out = [(0, len(raw))]
        return out

    want = {i: (spans(i, t.encode(), False), spans(i, t.encode(), True)) for i, t in enumerate(texts) if spans(i, t.encode(), False)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: ([tuple(y) for y in x["repeated"]], [tuple(y) for y in x["removable"]]) for x in chunk_dedup.repeated_spans(df).collect()}
    assert want and got == want
