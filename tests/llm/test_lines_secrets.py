import hashlib
import re
from collections import Counter

import pytest
from folioscope.llm.line_dedup import dedup_lines, line_digests
from folioscope.llm.queries import op7_secrets, op8_line_dedup
from folioscope.llm.secrets import findings_by_path, secret_digests, update_ledger
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute_lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    seen = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    out = []
    for doc, lines in split:
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def brute_secrets(rows):
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = []
    for doc, text in rows:
        text = text or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        n = Counter(x[2] for x in spans)
        out.append((doc, n["assign"], n["access"], n["hex"], sha(joined), joined))
    return sorted(out, key=str)


def found(df, n):
    return sorted((tuple(r)[:n] for r in df.collect()), key=str)


def test_lines_of_real_documents(spark, folder, real):
    assert found(op8_line_dedup(spark, folder), 4) == brute_lines(real)


@pytest.mark.parametrize("least", [2, 10])
def test_lines_of_edge_rows(docs, no_docs, rows, least):
    distinct = brute_lines([r[:2] for r in rows], least)
    assert found(line_digests(docs, least), 4) == distinct
    assert dedup_lines(docs).columns == docs.columns and dedup_lines(docs).count() == len(rows)
    assert line_digests(no_docs).count() == 0


def test_first_line_can_stay(spark):
    df = spark.createDataFrame([(1, "a\nx\nA "), (2, "y\na")], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(df, 2, keep_first=True).collect()) == ["a\nx", "y"]


def test_clashing_columns(spark):
    rows = [(k, f"shared\nown {k}", "1", "2", "3", "4") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, KEY string, dedup_bitmap string, dedup_dropped string")
    out = dedup_lines(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted((k, f"own {k}", *r) for k, _, *r in rows)


def test_a_line_that_most_documents_have(spark):
    rows = [(k, f"common\nown {k}\n" + ("rare" if k % 20 == 0 else "")) for k in range(300)]
    got = found(line_digests(spark.createDataFrame(rows, "doc_id long, text string"), 10), 4)
    assert got == brute_lines(rows)


def test_a_stored_ledger_grows(spark, tmp_path):
    store = f"file://{tmp_path}/ledger"
    first = [(1, "token=abcdefg"), (2, "plain")]
    second = [(3, "token=abcdefg"), (4, "deadbeef" * 4), (2, "plain")]
    for rows in (first, second):
        got = secret_digests(spark.createDataFrame(rows, "doc_id long, text string"), store=store)
        assert found(got, 6) == brute_secrets(rows)
    assert spark.read.parquet(store).groupBy("blob_id", "kind").count().where("count > 1").count() == 0


def test_secrets_of_real_documents(spark, folder, real):
    assert found(op7_secrets(spark, folder), 6) == brute_secrets(real)


def test_secrets_of_edge_rows(docs, no_docs, rows):
    got = brute_secrets([r[:2] for r in rows])
    assert any(x[1] for x in got) and any(x[2] for x in got) and any(x[3] for x in got)
    assert found(secret_digests(docs), 6) == got
    assert secret_digests(no_docs).count() == 0


def test_ledger_scans_unseen_blobs_only(spark):
    first = spark.createDataFrame([(1, "token=abcdefg"), (2, "plain")], "doc_id long, text string")
    _, ledger = update_ledger(first)
    second = spark.createDataFrame([(3, "token=abcdefg"), (4, "deadbeef" * 4)], "doc_id long, text string")
    paths, gained = update_ledger(second, ledger)
    assert gained.select("blob_id").distinct().count() == 1
    both = {r.doc_id: r.found for r in findings_by_path(paths, ledger.select(*gained.columns).union(gained)).collect()}
    assert [x.kind for x in both[3]] == ["assign"] and [x.kind for x in both[4]] == ["hex"]


def test_a_blob_that_stands_twice_in_the_ledger_counts_once(spark, tmp_path):
    """Two scans at once append the same pairs; one of them may have seen nothing yet."""
    store = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, 'password = "abcdef123"'), (2, 'password = "abcdef123"'), (3, "deadbeef" * 4)], "doc_id long, text string")
    want = sorted(secret_digests(docs).collect())
    _, gained = update_ledger(docs)
    for _ in range(2):
        gained.write.mode("append").parquet(store)
    gained.withColumn("spans", F.slice("spans", 1, 0)).write.mode("append").parquet(store)
    assert sorted(secret_digests(docs, store=store).collect()) == want and [r.n_assign for r in want] == [1, 1, 0]
    # The next run opens the ledger that this one left.
    assert sorted(secret_digests(docs, store=store).collect()) == want
    assert spark.read.parquet(store).count() == 3 * gained.count()
