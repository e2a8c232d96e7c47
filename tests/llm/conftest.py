import random

import pytest

WORDS = "the of and to a in is that it for was on with as be by this are at from lake stone river birch copper violet thunder meadow lantern harbour".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, shared passages, and repeated rows."""
    r = random.Random(5)
    base, passage = prose(r, 120), prose(r, 70)
    words = base.split()
    rows = [(1, base), (2, base), (3, " ".join(words[:60] + ["changed"] + words[61:])), (4, prose(r, 40) + " " + passage + " " + prose(r, 30)), (5, prose(r, 20) + "\n" + passage), (6, None), (7, ""), (8, "one"), (9, "one"), (10, "  \n "), (11, prose(r, 20_000)), (None, base), (12, "x y z"), (12, "x y z"), (13, "é üß " * 30), (14, "\n".join(prose(r, 8) for _ in range(12)))]
    lines = rows[-1][1].split("\n")
    rows += [(15, "\n".join(["first line here", *lines[2:]])), (16, "\n".join([*lines, "last line"]))]
    for k in range(20, 60):
        rows.append((k, prose(r, r.randrange(1, 90))))
    return [(i, t, ["en", "de", None][(i or 0) % 3], [None, "a", "b", "B"][(i or 0) % 4], len(t or "")) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The odd rows, with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    for name in ("row", "id", "key", "n", "pos", "term", "h", "block", "size", "rank", "label", "spans", "component_id", "score"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
