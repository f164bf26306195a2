import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from folioscope.llm import spelling
from folioscope.llm.queries import op12_spelling
from folioscope.llm.spelling import Automaton, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows, least_length=5, least=3, damage=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= least and len(w) >= least_length}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(n):
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    form, found = {}, {}
    for w in n:
        found[w] = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        best = min(found[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def shown(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made(seed, size=700):
    """Words over few letters, so that runs of one letter, shared halves and many near words are usual."""
    random.seed(seed)
    words = ["".join(random.choice("abé") for _ in range(random.randint(4, 9))) for _ in range(size)]
    words += ["a" * k for k in range(5, 12)] + ["prefix" + w for w in words[:200]] + [w + "suffix" for w in words[:100]]
    return [(i, " ".join(random.choices(words, k=400)).replace("a", "A", 30)) for i in range(25)] + [(None, None), (7, ""), (8, "12 -- \n"), (None, "x" * 3000 + " " + "x" * 2999 + " " + " prefixa")] * 3


@pytest.mark.parametrize("crowd", [10_000, 20])
def test_made_words(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rows = made(crowd)
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, word string").repartition(4)
    want = brute(words_of(rows))
    assert len(want) > 500 and any(r[2] not in (r[0], r[1]) for r in want)
    assert shown(spelling_variants(df, damage=97)) == want


def test_edge_rows(spark, docs, no_docs, rows):
    assert shown(spelling_variants(docs, least=2, damage=97)) == brute(words_of([r[:2] for r in rows], least=2))
    assert spelling_variants(no_docs).count() == 0
    assert shown(spelling_variants(docs)) == brute(words_of([r[:2] for r in rows], damage=None))


def test_real_documents(spark, folder, real):
    want = brute(words_of(real))
    assert shown(op12_spelling(spark, folder)) == want and any(r[1] for r in want)


def test_automaton_is_minimal_and_numbers_its_words():
    random.seed(2)
    words = sorted({"".join(random.choice("abc") for _ in range(random.randint(1, 7))) for _ in range(600)})
    automaton = Automaton(words)
    assert [automaton.walk(automaton.start, 0, w, 0, len(w)) for w in words] == [(s, k) for k, w in enumerate(words) for s in [automaton.walk(automaton.start, 0, w, 0, len(w))[0]]]
    rights = {frozenset(w[k:] for w in words if w.startswith(p)) for p in {w[:j] for w in words for j in range(len(w) + 1)} for k in [len(p)]}
    assert len(automaton.arcs) == len(rights)
    for w in words[::7]:
        assert {words[k] for k in automaton.one_error(w, 0)} == {v for v in words if near(w, v)}
    assert Automaton([]).one_error("abc", 1) == set()
