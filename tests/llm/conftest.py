"""Small tables for the operators' tests: plain documents and every awkward case at once."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = {
    "aa": ["stone", "river", "walking", "house", "under", "bright", "morning", "gather", "light", "paper", "window", "through"],
    "bb": ["kivi", "joki", "talon", "alla", "kirkas", "aamu", "kerätä", "valo", "paperi", "ikkuna", "läpi", "kävellä"],
}


@pytest.fixture(scope="session")
def rows():
    """Two languages, copies, near copies, nulls in every column, empty and blank texts, one very long text, a repeated row."""
    rng = random.Random(7)
    out = [(i, prose(rng, rng.randint(55, 120), WORDS[lang]), lang, "s", 1) for i in range(60) for lang in [("aa", "bb")[i % 2]]]
    near = out[0][1].split()
    near[40] = "changed"
    out += [(100, out[0][1], "aa", "s", 1), (101, " ".join(near), "aa", "s", 1)]
    out += [(200, None, None, None, None), (201, "", "aa", "s", 0), (202, " \n\t ", "aa", "s", 4), (203, "12 345 ... 6", None, "s", 1), (None, "a row without an id", "aa", None, None)]
    out += [(300, prose(rng, 30_000, WORDS["aa"]), "aa", "s", 1), (301, "z" * 50_000, "bb", "s", 1), (302, "one", None, "s", 1)]
    out += [(400, "the same line twice\n" * 40, "aa", "s", 1), (5, *out[5][1:])]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with an added column whose name operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine")).withColumn("bucket", F.lit(1)).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    marks = [(i, int(i % 4 != 0), 0) for i in range(60)] + [(7, 1, 0), (8, None, 0), (None, 1, 1), (9, 1, 0), (9, 0, 0)]
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def ordered(values):
    return sorted(values, key=lambda r: [(v is None, str(v)) for v in r])
