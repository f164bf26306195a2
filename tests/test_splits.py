"""Quoted and nested files cut into many ranges read as in one piece."""

import csv
import io
import json
import random

import pytest
from folioscope.sources.files import flatten_structs, import_article_data

CELLS = ["plain", "", "with, comma", 'a "quoted" word', "two\nlines", "\n\nthree\n", '"', '""', 'ends with "', "é ñ ü", "x" * 70, "a,b\n\"c\"\nd", "12", " 7 ", "{[\"]}"]


@pytest.fixture
def small_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, n) for k in held]
    for k, v in held.items():
        spark.conf.set(k, v)


def table(seed, rows=60):
    rng = random.Random(seed)
    return [["title", "Abstract text", "n", "Year"]] + [[rng.choice(CELLS) or "t", rng.choice(CELLS), str(k), rng.choice(["2020", "", "1999"])] for k in range(rows)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size", [700, 17])
@pytest.mark.parametrize("kind, separator, end", [("csv", ",", "\n"), ("tsv", "\t", "\r\n"), ("txt", "\t", "\n")])
def test_quoted_tables(spark, tmp_path, small_ranges, size, kind, separator, end):
    rows = table(size)
    text = io.StringIO()
    csv.writer(text, delimiter=separator, lineterminator=end).writerows(rows)
    path = tmp_path / f"a.{kind}"
    path.write_bytes(text.getvalue().encode())
    whole = spark.read.options(header=True, inferSchema=True, multiLine=True, escape='"', sep=separator).csv(str(path))
    want, schema = rows_of(whole), whole.dtypes
    small_ranges(size)
    got = import_article_data(spark, str(path))
    assert size > 1000 or got.rdd.getNumPartitions() >= min(4, len(text.getvalue()) // size // 8)
    assert got.dtypes == schema and rows_of(got) == want and len(want) == 60


def test_a_quotation_longer_than_ranges_and_files_in_order(spark, tmp_path, small_ranges):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(3):
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows([["title", "year"], [f"short {k}", 2000 + k], ["long\n" * 300 + str(k), 1990 + k], ["last", 2010 + k]])
        (folder / f"p{k}.csv").write_text(text.getvalue())
    small_ranges(50)
    got = import_article_data(spark, str(folder), position="place").orderBy("place").collect()
    assert [r.year for r in got] == [y + k for k in range(3) for y in (2000, 1990, 2010)]
    assert all(got[3 * k + 1].title == "long\n" * 300 + str(k) for k in range(3))


def test_a_quote_inside_an_unquoted_field_is_a_letter(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('title,size\na 5" pipe,1\nb,2"\n"c ""d"" e\nf",3\n' * 1 + 'g,4\n')
    small_ranges(16)
    assert [(r.title, r.size) for r in import_article_data(spark, str(tmp_path / "a.csv"), position="p").orderBy("p").collect()] == [('a 5" pipe', "1"), ("b", '2"'), ('c "d" e\nf', "3"), ("g", "4")]


@pytest.mark.parametrize("size", [200, 23])
@pytest.mark.parametrize("indent, lines", [(None, False), (2, False), (None, True)])
def test_nested_files(spark, tmp_path, small_ranges, size, indent, lines):
    rng = random.Random(size)
    rows = [{"title": rng.choice(CELLS), "meta": {"k": k, "tags": [rng.choice(CELLS), "}{"], "deep": {"x": 'q"}\\'}}, **({"year": 2000 + k} if k % 3 else {})} for k in range(40)]
    text = "\n".join(map(json.dumps, rows)) if lines else json.dumps(rows, indent=indent, ensure_ascii=False)
    path = tmp_path / "a.json"
    path.write_text(text)
    whole = flatten_structs(spark.read.json(str(path), multiLine=not lines))
    want, schema = rows_of(whole), whole.dtypes
    small_ranges(size)
    got = import_article_data(spark, str(path))
    assert got.dtypes == schema and rows_of(got) == want and len(want) == 40
    ordered = import_article_data(spark, str(path), position="p").orderBy("p").collect()
    assert [r["meta.k"] for r in ordered] == list(range(40))
