import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from folioscope.llm.mixing import Level, Mix, mix_sources, select_tokens
from folioscope.llm.quality import RULES, binomial_tail, judge, quality_filter
from folioscope.llm.queries import op3_mixing, op10_quality


def counts(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blank:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(line.strip(blank)) and line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def base(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def check(df, rows):
    got = sorted((tuple(r)[:7] for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    assert got == sorted(((d, *counts(t), base(counts(t))) for d, t in rows), key=str)
    assert df.where("base_failed AND kept").count() == 0


def test_features_of_real_documents(spark, folder, real):
    check(op10_quality(spark, folder), real)


def test_features_of_edge_rows(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(3, 1), (None, 1), (6, None), (9, 0), (9, 1)], "doc_id long, quality int")
    check(judge(docs, labels), [r[:2] for r in rows])
    assert quality_filter(docs, labels).columns == docs.columns
    assert judge(no_docs, labels).count() == 0 and quality_filter(docs, labels.limit(0)).count() > 0


@pytest.mark.parametrize("n, p", [(10, 0.3), (200, 0.01)])
def test_binomial_tail(n, p):
    for x in (0, 1, n // 2, n):
        plain = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))
        assert binomial_tail(x, n, p) == pytest.approx(plain, rel=1e-9)


def test_certified_cutoffs_reject_few_good_documents(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", 1) for i in range(20_000)]
    junk = [(100_000 + i, " ".join(f"#{i}${k}%" for k in range(60)), "en", 0) for i in range(50)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, quality int")
    found = judge(df.drop("quality"), df.select("doc_id", "quality"))
    assert found.where("doc_id >= 100000 AND kept").count() == 0
    assert found.where("doc_id < 100000 AND NOT kept").count() <= 200
    # With few labels nothing can be certified, so only the base rule holds.
    few = judge(df.drop("quality"), df.where("doc_id < 100").select("doc_id", "quality"))
    assert few.where("NOT kept AND NOT base_failed").count() == 0
    assert set(RULES) == {"symbols_per_word", "marks_per_word", "capital_share", "repeat_share", "dup_line_share", "chars_per_word"}


def fill(budget, children):
    """Children as weight and room; what a full child leaves goes to the others by weight."""
    given, live = {k: 0.0 for k in children}, {k for k, (w, r) in children.items() if w > 0 and r > 0}
    while live and budget > 1e-9:
        total = sum(children[k][0] for k in live)
        share = {k: budget * children[k][0] / total for k in live}
        full = {k for k in live if given[k] + share[k] >= children[k][1] - 1e-9}
        if not full:
            for k in live:
                given[k] += share[k]
            break
        for k in full:
            budget -= children[k][1] - given[k]
            given[k] = children[k][1]
        live -= full
    return given


def test_budgets_follow_the_tree(spark):
    rows = []
    for source, n in (("src0", 40), ("src1", 5), ("src2", 60), ("src10", 30)):
        rows += [(len(rows) + i, " ".join(["w"] * 10), "en" if i % 3 else "de", source) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = Mix(bucket_docs=4)
    taken = defaultdict(int)
    for r in select_tokens(df, mix).collect():
        taken[r.domain, r.lang, r.source] += r.full_epochs * r.n_tokens + r.last_epoch_tokens
    domain = {"src0": "crawl", "src1": "curated", "src2": "curated", "src10": "reference"}
    supply = Counter()
    for _, t, lang, source in rows:
        supply[domain[source], lang, source] += 10
    weights = {"crawl": 2, "curated": 5, "reference": 3}
    room = lambda *p: sum(2 * n for k, n in supply.items() if k[: len(p)] == p)
    want = {}
    top = fill(0.75 * sum(supply.values()), {d: (w, room(d)) for d, w in weights.items()})
    for d, given in top.items():
        for lang, g in fill(given, {x: ({"en": 4, "de": 2}[x], room(d, x)) for x in ("en", "de")}).items():
            sources = {k[2] for k in supply if k[:2] == (d, lang)}
            for source, tokens in fill(g, {s: (1, room(d, lang, s)) for s in sources}).items():
                want[d, lang, source] = math.floor(tokens + 1e-6)
    assert dict(taken) == {k: v for k, v in want.items() if v}


def brute_selection(rows, budget, seed, epochs=2):
    """Per leaf (source): whole epochs, and of the last one the documents in seeded order until the budget ends."""
    out, leaves = {}, defaultdict(list)
    for doc, text, source in rows:
        leaves[source].append((doc, len(text.split())))
    for source, docs in leaves.items():
        supply = sum(n for _, n in docs)
        full, rest = divmod(budget[source], supply)
        place = lambda d: int(hashlib.md5(f"{seed}:{full}:{d}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        for doc, n in sorted(docs, key=lambda x: place(x[0])):
            part = max(0, min(n, rest))
            rest -= part
            if full or part:
                out[doc] = full, part
    return out


def test_selection_is_the_seeded_prefix(spark):
    rng = random.Random(2)
    rows = [(i, " \n".join(f"w{i}x{k}" for k in range(rng.randint(1, 30))), rng.choice(["a", "b", "c"])) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, doc string, key string")
    mix = Mix(levels=(Level("source", "source", "CASE source WHEN 'a' THEN 6 WHEN 'b' THEN 1 ELSE 2 END"),), bucket_docs=7)
    supply = Counter()
    for _, text, source in rows:
        supply[source] += len(text.split())
    given = fill(0.75 * sum(supply.values()), {s: ({"a": 6, "b": 1, "c": 2}[s], 2 * n) for s, n in supply.items()})
    want = brute_selection(rows, {s: math.floor(g + 1e-6) for s, g in given.items()}, mix.seed)
    assert {r.doc_id: (r.full_epochs, r.last_epoch_tokens) for r in select_tokens(df, mix).collect()} == want
    out = mix_sources(df, mix)
    assert out.columns == [*df.columns, "full_epochs", "last_epoch_tokens", "last_epoch_text"]
    texts, partial = {r[0]: r[1] for r in rows}, 0
    for r in out.collect():
        whole = texts[r.doc_id]
        assert (r.full_epochs, r.last_epoch_tokens) == want[r.doc_id] and (r.doc, r.key) == ("x", "y")
        cut_off = 0 < r.last_epoch_tokens < len(whole.split())
        partial += cut_off
        assert (r.last_epoch_text is not None) == cut_off
        if cut_off:
            assert whole.startswith(r.last_epoch_text) and len(r.last_epoch_text.split()) == r.last_epoch_tokens
        assert r.text == (r.last_epoch_text if cut_off and not r.full_epochs else whole)
    assert 0 < partial <= 3


def test_mix_is_seeded_and_keeps_rows(spark, folder, docs, no_docs):
    once = sorted(map(tuple, op3_mixing(spark, folder).collect()), key=str)
    assert once == sorted(map(tuple, op3_mixing(spark, folder).collect()), key=str)
    other = Mix(levels=(Level("source", "source"),), share=0.5, seed="other")
    out = mix_sources(docs, other)
    assert out.columns[: len(docs.columns)] == docs.columns and 0 < out.count() <= docs.count()
    assert select_tokens(no_docs).count() == 0 and mix_sources(no_docs).count() == 0
