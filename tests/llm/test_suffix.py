import hashlib
import random

import numpy as np
import pytest
from folioscope.llm import suffix_dedup, suffix_sort
from folioscope.llm.queries import op9_suffix_dedup
from folioscope.llm.suffix_dedup import Segments, Spool, named_runs, passages, remove_repeats, repeat_digests, repeated_spans, sorted_spans, varied_segments


def brute(rows, width=50):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1 if doc is not None else 0):
            g = raw[i : i + width]
            first[g] = min(doc, first.get(g, doc))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1 if doc is not None else 0):
            if first[raw[i : i + width]] < doc:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("memory, block", [(64, 3), (500, 7), (1 << 20, 1 << 16)])
def test_suffixes_match_a_plain_sort(memory, block, monkeypatch):
    monkeypatch.setattr(suffix_sort, "BLOCK", block)
    random.seed(memory)
    for _ in range(60):
        n, symbols = random.randint(1, 70), random.choice([1, 2, 3, 200])
        text = np.array([random.randrange(symbols) for _ in range(n)], np.uint16)
        blocks = list(suffix_sort.sorted_suffixes(text, memory, 20))
        order, prefix = (np.concatenate(x).tolist() for x in zip(*blocks))
        plain = text.tolist()
        assert order == sorted(range(n), key=lambda i: plain[i:])[::-1]
        for a, b, shared in zip(order, order[1:], prefix[1:]):
            k = 0
            while k < 20 and max(a, b) + k < n and plain[a + k] == plain[b + k]:
                k += 1
            assert k == shared


def test_real_documents(spark, folder, real):
    assert found(op9_suffix_dedup(spark, folder)) == brute(real)


def test_edge_rows_and_small_memory(docs, rows):
    assert found(repeat_digests(docs, memory=20_000, shards=3)) == brute([r[:2] for r in rows])


def brute_texts(rows, width=50):
    """The rows' texts without repeats, a character going whole where it loses a byte."""
    first, out = {}, []
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1 if doc is not None else 0):
            first[raw[i : i + width]] = min(doc, first.get(raw[i : i + width], doc))
    for doc, text in rows:
        raw = (text or "").encode()
        gone = set()
        for i in range(len(raw) - width + 1 if doc is not None else 0):
            if first[raw[i : i + width]] < doc:
                gone.update(range(i, i + width))
        out.append((doc, None if text is None else bytes(b for i, b in enumerate(raw) if i not in gone).decode(errors="ignore")))
    return sorted(out, key=str)


def test_operator_gives_the_texts_that_are_left(spark, docs, no_docs, rows):
    out = remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute_texts([r[:2] for r in rows])
    assert remove_repeats(no_docs).collect() == []


def test_clashing_columns(spark):
    passage = "é" + " ".join(f"word{i}" for i in range(20))
    rows = [(i, f"own {i} " + passage + f" tail {i}", "a", "b", "c", "d") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, KEY string, spans string, s string")
    out = remove_repeats(df)
    assert out.columns == df.columns
    got = sorted(out.collect())
    assert [r.text for r in got] == [t for _, t in brute_texts([r[:2] for r in rows])]
    assert {tuple(r)[2:] for r in got} == {("a", "b", "c", "d")}


def made_segments(rng, names, n, width=50):
    """Segments in packs as tasks send them: few names, and texts that share beginnings and ends."""
    heads = ["".join(rng.choice("ab") for _ in range(20)) for _ in range(3)]
    tails = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(6)]
    packs, rows = [], []
    for pack in range(n):
        texts = []
        for _ in range(40):
            name, doc, at, gram = rng.randrange(names), rng.randrange(300), rng.randrange(1000), rng.randint(0, 20)
            text = rng.choice(heads)[20 - gram :] + f"{name:012d}" + rng.choice(tails)
            texts.append((name, doc, at, gram, text[: 50 + rng.randint(0, gram)].encode()))
        rows += [(pack, *t) for t in texts]
        columns = [np.array(c) for c in zip(*(t[:4] for t in texts))]
        raw = np.frombuffer(b"".join(t[4] for t in texts), np.uint8)
        size = np.array([len(t[4]) for t in texts])
        name, doc, at, gram = columns
        packs.append(Segments(name, doc, gram, size, np.ones(len(size), np.int64), doc * 10 + pack, at, raw))
    return packs, rows


@pytest.mark.parametrize("names", [1, 5, 1000])
def test_a_shard_far_larger_than_memory(names):
    """What is sorted and settled in small memory is what all pairs of segments say."""
    rng = random.Random(names)
    packs, rows = made_segments(rng, names, 30)
    total = sum(p.nbytes for p in packs)
    spool = Spool(total // 12)
    for pack in packs:
        spool.add(pack)
    got = set()
    for bucket in spool.buckets():
        assert bucket.nbytes <= total // 12 or len(set(bucket.name.tolist())) == 1
        varied, spans = varied_segments(bucket, 50)
        for s in [spans] if spans else []:
            got |= covered(s)
        if varied is not None:
            for s in sorted_spans(varied, 50, 1000):
                got |= covered(s)
    for s in spool.spans:
        got |= covered(s)
    first, want = {}, set()
    for _, _, doc, _, _, text in rows:
        for i in range(len(text) - 49):
            first[text[i : i + 50]] = min(doc, first.get(text[i : i + 50], doc))
    for pack, _, doc, at, _, text in rows:
        for i in range(len(text) - 49):
            if first[text[i : i + 50]] < doc:
                want |= {(doc, doc * 10 + pack, at + i + k) for k in range(50)}
    assert got == want


def covered(spans):
    return {(d, r, x) for d, r, b, e in zip(*(c.tolist() for c in spans)) for x in range(b, e)}


def test_equal_hashes_do_not_merge_different_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MIX", np.zeros(3, np.uint64))
    raw = np.frombuffer(b"".join(bytes([65 + k % 3]) * 60 for k in range(9)), np.uint8)
    size = np.full(9, 60)
    rep = suffix_dedup.first_equals(raw, np.cumsum(size) - size, size, np.arange(9)[::-1])
    assert all(rep[k] == k or raw[60 * rep[k]] == raw[60 * k] for k in range(9))


def near_copies(rng, n=12):
    """One task each: copies of a long text, some with changed, lost or repeated bytes."""
    base = "".join(rng.choice("abcdé \n") for _ in range(9000))
    rows = [(n, base), (n, base), (n, base[::-1])]
    for i in range(n):
        text = base
        for _ in range(i % 4):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "x", text[at - 300 : at]]) + text[at + rng.randrange(3) :]
        rows.append((i, text))
    return rows


def test_passages_hold_every_string_once():
    rng = random.Random(4)
    texts = [t.encode() for _, t in near_copies(rng)] + [b"", b"short", b"a" * 5000, b"b" * 50]
    rng.shuffle(texts)
    raw, of, begin, end = passages(texts, 50)
    base = np.cumsum([0, *map(len, texts)])
    for k, t in enumerate(texts):
        own = sorted((b - base[k], e - base[k]) for b, e in zip(begin[of == k], end[of == k]))
        assert [a for b, e in own for a in range(b, e - 49)] == list(range(len(t) - 49))
        assert all(0 <= b and e <= len(t) for b, e in own)
    # They do not depend on what stands about a text.
    cut = lambda t: [(b, e) for _, b, e in zip(*(x.tolist() for x in passages([t], 50)[1:]))]
    assert cut(texts[0]) == [(b, e) for k, b, e in zip(of, begin, end) if k == 0]


def test_copies_return_no_more_rows_from_more_shards(spark):
    """A document that another repeats at length came back once from every shard."""
    rows = near_copies(random.Random(3))
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    assert found(repeat_digests(df, shards=7)) == brute(rows)
    made = {r.doc: len(r.spans) for r in repeated_spans(df, shards=200).collect()}
    # Copies without a change, the one with the smallest id apart, and all of them.
    assert set(made) == set(range(1, 13)) and all(made[d] <= 2 for d in (4, 8, 12)), made
    assert sum(made.values()) <= 120, made


def test_a_string_has_one_name_and_gram_wherever_it_stands():
    """Of equal grams another one was taken where places passed a multiple of 65,536."""
    rng = random.Random(8)
    shared = b"0123456789 " + b"thble " * 12 + b"of of of of of of of of of of of of of of "
    pad = bytes(rng.randrange(97, 123) for _ in range(65_600))

    def named(before):
        raw, _, first, n, name, gram = named_runs([(0, 0, pad[:before] + shared + pad[:60])], 50)
        held = {f + k: (x, f + g - before) for f, c, x, g in zip(*(y.tolist() for y in (first, n, name, gram))) for k in range(c)}
        assert sorted(held) == list(range(len(raw) - 49))
        return [held[before + k] for k in range(len(shared) - 49)]

    for before in [1, *range(32_600, 32_780, 7), *range(65_390, 65_590, 7)]:
        assert named(before) == named(0)
