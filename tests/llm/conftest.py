import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string, key string, row_key string"
FOLDER = "/root/testdata/sf0.001"


def rows_of():
    """Nulls, empty and long texts, ties, copies, secrets, licences and shared lines and passages."""
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    base, passage = prose(120), prose(30)
    texts = [None, "", "   \n\t ", "one", "two words", base, base, base + " end", prose(60) + " " + passage + " " + prose(60), passage + " " + prose(70)]
    texts += ["Shared Line \n" + prose(55) + f"\nshared line\nown {i}\n" for i in range(12)]
    texts += ['password = "abcdef123" and token: short secret:abc', "AKIA" + "Z" * 30 + " x AKIA12 " + "deadbeef" * 4, "é" * 40 + ' API_KEY="ké" apikey=abcdefgh' + "f" * 30]
    texts += ["# $ % " * 40, "a b c " * 60, prose(20000), "Released under the MIT License.\n" + prose(80), "line\n" * 40 + prose(60)]
    rows = [(i * 3, t, random.choice(["en", "de", None]), random.choice(["src0", "src1", "src12"]), len(t or ""), "x", "y", "z", "k") for i, t in enumerate(texts)]
    rows += [(None, base, "en", "src0", 5, "x", "y", "z", "k"), rows[5], (rows[8][0], "another text under the same id", "en", None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return rows_of()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def real(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
