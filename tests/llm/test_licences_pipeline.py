import random
import re
import textwrap
import time

import corpus_pipeline
import pytest
from folioscope.llm.common import written
from folioscope.llm.licenses import IDS, LICENCE_TEXTS, RULES, match_rules, scan_licences, scan_text
from folioscope.llm.queries import QUERIES, op5_licences

LAYOUTS = {
    "as it is": lambda t: t,
    "one line": lambda t: " ".join(re.sub(r"(?m)^\d+\. ", "", t).split()),
    "wrapped anew": lambda t: "\n\n".join(textwrap.fill(" ".join(p.split()), 50) for p in t.split("\n\n")),
    "hashes": lambda t: "\n".join("# " + x if x else "#" for x in t.split("\n")),
    "slashes": lambda t: "\n".join("// " + x for x in t.split("\n")),
    "stars": lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */",
    "upper case": lambda t: t.upper(),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_known_licences_are_found(layout):
    for licence, form, text in LICENCE_TEXTS:
        made = "Some words before it here.\n\n" + LAYOUTS[layout](text) + "\n\nAnd after."
        found = {m[0] for m in scan_text(made)[0]}
        assert licence in found, (licence, form)
        # A text holds no other licence but one whose whole text is part of it.
        assert found <= {licence, *PARTS.get(licence, ())}, (licence, form, found)


#: Licences whose whole text is part of another.
PARTS = {"BSD-3-Clause": ("BSD-2-Clause",)}


def test_unknown_sentences_are_counted():
    assert scan_text("This has nothing to do with it.")[0] == []
    assert scan_text("You need a fishing licence from the council.")[2] == 1
    many = "You need a licence here. " * 20_000 + "Licensed under the MIT License. " * 20_000
    began = time.perf_counter()
    licences, known, unknown = scan_text(many)
    assert (len(licences), len(known), unknown) == (20_000, 20_000, 20_000) and time.perf_counter() - began < 20


def brute_match(found, gap=3):
    """Rules from the longest on; each takes the earliest free sentences that follow one another closely enough."""
    free, out = set(range(len(found))), []
    for licence, form, sequence in RULES:
        for first in range(len(found)):
            chosen = []
            for wanted in sequence:
                options = [k for k in sorted(free) if found[k][2] == wanted and (k == first if not chosen else chosen[-1] < k <= chosen[-1] + 1 + gap)]
                if not options:
                    break
                chosen.append(options[0])
            if len(chosen) == len(sequence):
                free -= set(chosen)
                out.append((licence, form, found[chosen[0]][0], found[chosen[-1]][1]))
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def test_rules_match_by_brute_force():
    rng, sequences = random.Random(6), [r[2] for r in RULES]
    for _ in range(200):
        ids = []
        for _ in range(rng.randint(1, 6)):
            for x in rng.choice(sequences):
                ids += [x] * (rng.random() < 0.9) + [rng.randrange(len(IDS)) for _ in range(rng.choice([0, 0, 1, 4]))]
        found = [(10 * k, 10 * k + 9, x) for k, x in enumerate(ids)]
        assert match_rules(found) == brute_match(found)


def test_licences_of_edge_rows(spark, docs, no_docs, rows, folder):
    found = scan_licences(docs).collect()
    assert len(found) == len(rows) and [r.licences for r in found if r.licences] == [["MIT"]]
    assert scan_licences(no_docs).count() == 0
    real = {r.doc_id: r.licences for r in op5_licences(spark, folder).collect()}
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert all("MIT" in real[r.doc_id] for r in texts if "\nReleased under the MIT License." in r.text)


def test_queries_cover_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def brute_stages(spark, folder):
    """What each stage keeps, from the operators' own brute-force versions."""
    from collections import Counter

    from tests.llm.test_lines_secrets import LOWER
    from tests.llm.test_quality_mix import base, counts
    from tests.llm.test_warc_items import brute_items

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = {d: t for d, t in docs.items() if not base(counts(t))}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for t in kept.values() for k in {key(x) for x in t.split("\n")} if k)
    lines = {d: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for d, t in kept.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, t.encode().lower().split()) for d, t in lines.items())}
    parent = {d: d for d in lines}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in lines:
        for b in lines:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    single = {d for d in lines if root(d) == d}
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {x[0] for x in brute_items([(d, lines[d]) for d in single], items) if not x[5]}
    return set(kept), lines, single, clean


def test_pipeline_matches_its_stages(spark, folder):
    kept, lines, single, clean = brute_stages(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        seen.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and all(d.columns == columns for d in seen[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    # With 87 labels no cutoff can be certified, so the base rule decides.
    assert ids[0] == kept
    assert {r.doc_id: r.text for r in seen[1].collect()} == lines
    assert ids[2] == single
    assert ids[3] == clean
    assert ids[4] <= clean and len(ids[4]) > 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids[4]
