"""Fixtures of the corpus operators: a small awkward table, and results as plain rows."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, id int, sha string, k string, size double, score string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like operators' own."""
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "x", "the", "of", "end."]
    extra = (True, "r", 1, "s", "kk", 2.0, "sc")
    rows = []
    for i in range(120):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))
        rows.append((i, text, "en", f"src{i % 4}", len(text), *extra))
    base = rows[5][1]
    rows += [(200, base, "en", "src0", 1, *extra), (201, base.replace(" ", "  ", 3), "en", "src0", 1, *extra),
             (202, base + " tail", None, None, None, None, None, None, None, None, None, None),
             (203, None, None, "src1", None, *extra), (204, "", "en", None, 0, *extra), (205, " \t\n\x0b\x0c\r ", "en", "src2", 7, *extra),
             (206, "long " * 30000, "en", "src3", 150000, *extra), (207, "y" * 50000, "en", "src3", 50000, *extra),
             (208, "a b 　c\x1cd", "en", "src1", 9, *extra), (None, "no id here", "en", "src1", 10, *extra),
             (None, None, None, None, None, *extra), (210, "same row", "en", "src2", 8, *extra), (210, "same row", "en", "src2", 8, *extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(120)] + [(None, 1, 0), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture()
def rows():
    def collect(df):
        return [r.asDict(recursive=True) for r in df.collect()]

    return collect


def squeeze(text):
    """A text without ASCII white space."""
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def closure(n, linked):
    """Smallest index reachable from each of n items."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [find(i) for i in range(n)]
