import re
from collections import Counter

import pytest

SF_DIR = "/root/testdata/sf0.001"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def least_reachable(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def document_rows(spark, texts, first=1):
    """Documents with an extra column of a name that operators use themselves."""
    from pyspark.sql import functions as F

    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).withColumn("digest", F.lit("x")).withColumn("n", F.lit(1)).withColumn("part", F.lit(None).cast("int"))


PROSE = [f"w{i}" for i in range(400)]


def prose(start, n=60):
    return " ".join(PROSE[start:start + n])


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, symbols only, very long, repeated."""
    long = " ".join(f"x{i % 977}y{i % 13}" for i in range(60_000))
    return [None, "", " \t\n", "word", "!!! ###", long, prose(0), prose(0), prose(0).upper(), "a b c d", "\n\n\n", "z" * 200_000]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    rows = document_rows(spark, odd_texts)
    return rows.union(rows.where("doc_id = 7")).union(rows.where("doc_id = 4").selectExpr("cast(null as long)", "text", "cast(null as string)", "source",
                                                                                        "n_chars", "digest", "n", "part"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


def counted(rows):
    return Counter(tuple(r) for r in rows)
