import base64
import hashlib
import re

import pytest
from folioscope.llm import decontaminate
from folioscope.llm.decontaminate import build_index, contamination_digests, drop_contaminated
from folioscope.llm.queries import op2_warc, op6_decontaminate
from folioscope.llm.warc import WarcError, archive, frames, parse_record, record, round_trip

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_pages(rows):
    last = {}
    for page, html in rows:
        last[html or ""] = max(page if page is not None else -1, last.get(html or "", -1))
    out = []
    for page, html in rows:
        raw, top = (html or "").encode(), last[html or ""]
        response = page == top or top == -1
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


def test_real_pages(spark, folder):
    pages = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()]
    assert sorted((tuple(r)[:5] for r in op2_warc(spark, folder).collect()), key=str) == brute_pages(pages)


def test_edge_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u\r\nX: y", "<é>\r\n\r\n"), (4, "v", "<é>\r\n\r\n"), (None, "w", "<é>\r\n\r\n"), (9, "z", "x" * 500_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    assert sorted((tuple(r) for r in round_trip(pages).collect()), key=str) == brute_pages([(p, h) for p, _, h in rows])
    assert round_trip(pages.limit(0)).count() == 0


def test_reader_refuses_damage():
    whole = archive([record(i, "u", f"page {i}".encode() * 50, None, "2026-01-01T00:00:00Z") for i in range(20)])
    assert [parse_record(f)[0] for f in frames(whole)] == list(range(20))
    with pytest.raises(WarcError):
        list(frames(whole[:-3]))
    with pytest.raises(WarcError):
        parse_record(record(1, "u", b"abc", None, "d").replace(b"abc", b"abd"))
    with pytest.raises(WarcError):
        parse_record(record(1, "u", b"abc", None, "d") + b"x")


def brute_items(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= own
        joined = ",".join(sorted(str(x) for x in names if x is not None))
        out.append((doc, len(w), len(hit), len(names - {None}), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def brute_near(docs, items, width=10, slop=2):
    """How often a window's first word is in place, all others within ``slop`` of theirs, and not all in place."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for _, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(w[i], set()).add(tuple(w[i : i + width]))
    out = []
    for doc, text in docs:
        w, n = words(text), 0
        for s, first in enumerate(w):
            for win in windows.get(first, ()):
                if tuple(w[s : s + len(win)]) != win and all(t in w[max(0, s + k - slop) : s + k + slop + 1] for k, t in enumerate(win) if k):
                    n += 1
        out.append((doc, n))
    return sorted(out, key=str)


def test_near_matches(spark):
    item = " ".join(f"t{i}" for i in range(14))
    swapped = item.split()
    swapped[4], swapped[5] = swapped[5], swapped[4]
    gap = item.split()
    gap.insert(6, "extra")
    rows = [(1, "a b " + item), (2, " ".join(swapped) + " z"), (3, " ".join(gap) + " " + item), (4, "t0 t1"), (5, None), (6, " ".join(reversed(item.split()))), (7, "x1 t3 t3 t3")]
    items = [(1, item), (2, "t3 t3 t3"), (3, "t1")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_near(rows, items)
    assert sum(n for _, n in want) > 5
    for block in (200_000, 3):
        found = contamination_digests(df, bench, width=10, block_windows=block)
        assert sorted(((r.doc_id, r.n_near) for r in found.collect()), key=str) == want
        assert sorted((tuple(r)[:6] for r in found.collect()), key=str) == brute_items(rows, items)


def test_an_index_serves_many_items(spark, docs, rows, tmp_path):
    index = build_index(docs, f"file://{tmp_path}/index")
    text = rows[9][1]
    for items in ([(1, text)], [(2, "two words"), (None, "one")]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = sorted((tuple(r)[:6] for r in contamination_digests(docs, bench, width=10, index=index).collect()), key=str)
        assert got == brute_items([r[:2] for r in rows], items)


def test_pieces_of_a_long_item_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 5)
    text = " ".join(f"t{i % 40}" for i in range(90))
    pieces = [tuple(r) for r in decontaminate.item_pieces(spark.createDataFrame([(1, text), (2, "one"), (3, "")], "item_id long, text string"), 10).collect()]
    found = decontaminate.Windows([(i, bytes(w)) for i, w in pieces], 10)
    terms = list(found.terms)
    got = {tuple(terms[t].decode() for t in w) for w in found.rows}
    assert got == {tuple(text.split()[i : i + 10]) for i in range(81)} | {("one",)}


def test_real_items(spark, folder, real):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = brute_items(real, items)
    assert any(x[5] for x in want)
    found = op6_decontaminate(spark, folder).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == want
    assert sorted(((r.doc_id, r.n_near) for r in found), key=str) == brute_near(real, items)


def test_edge_items(spark, docs, no_docs, rows):
    text = rows[9][1]
    items = [(1, " ".join(text.split()[3:20])), (2, "one"), (3, None), (4, "  "), (10, " ".join(text.split()[5:16]).upper()), (None, "two words"), (1, "w1 w2")]
    bench = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, doc_id string")
    want = brute_items([r[:2] for r in rows], items)
    assert sorted((tuple(r)[:6] for r in contamination_digests(docs, bench, width=10).collect()), key=str) == want
    assert sorted((tuple(r)[:6] for r in contamination_digests(docs, bench, width=10, block_windows=5).collect()), key=str) == want
    assert contamination_digests(no_docs, bench, width=10).count() == 0
    assert contamination_digests(docs, bench.limit(0), width=10).where("contaminated").count() == 0
    kept = drop_contaminated(docs, bench, width=10)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
