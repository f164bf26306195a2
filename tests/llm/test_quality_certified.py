import math
import random

from folioscope.llm.quality import RULES, certified_cutoffs, judge, quality_features
from pyspark.sql import functions as F


def corpus(spark, n, share):
    """``n`` good documents, of which one in ``share`` has symbols in every word, and some junk."""
    plain = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    junk = lambda i: " ".join(f"#{i}${k}%" for k in range(60))
    rows = [(i, junk(i) if share and i % share == 0 else plain(i), "en", 1) for i in range(n)]
    rows += [(100_000 + i, junk(i), "en", 0) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_some_hundred_labels_certify_cutoffs(spark):
    df = corpus(spark, 500, 0)
    found = judge(df.drop("quality"), df.select("doc_id", "quality"))
    assert found.where("doc_id >= 100000 AND kept").count() == 0
    assert found.where("doc_id < 100000 AND NOT kept").count() == 0


def test_a_step_that_rejects_too_many_ends_the_sequence(spark):
    df = corpus(spark, 500, 50)
    found = judge(df.drop("quality"), df.select("doc_id", "quality"))
    assert found.where("NOT kept AND NOT base_failed").count() == 0


def test_all_rules_together_stay_under_alpha(spark):
    df = corpus(spark, 2000, 250)
    features = quality_features(df).join(df.select("doc_id", (df["quality"] == 1).alias("good")), "doc_id")
    rows = certified_cutoffs(features).collect()
    assert {r.rule for r in rows} == set(RULES) and {(r.n_good, r.n_rejected) for r in rows} == {(2000, 8)}


def test_a_null_stratum_is_its_own(spark):
    """Good labels of the empty name certify nothing for documents without a name."""
    df = corpus(spark, 400, 0)
    rows = df.withColumn("lang", F.when(F.col("doc_id") >= 100_010, F.lit(None)).otherwise("")).drop("quality")
    found = judge(rows, df.select("doc_id", "quality"))
    assert {r.doc_id for r in found.where("kept").collect() if r.doc_id >= 100_000} == set(range(100_010, 100_020))


def test_verdict_by_brute_force(spark):
    """Cutoffs are those of the last step, in the fixed sequence, at which few enough good documents are rejected."""
    rng, rows = random.Random(4), []
    for i in range(1500):
        lang = rng.choice(["en", "de", None])
        words = [f"w{i}x{k}" + ("!" if rng.random() < (i % 7) / 40 else "") + ("#" if rng.random() < (i % 11 == 0) / 20 else "") for k in range(60)]
        rows.append((i, " ".join(words), lang, int(i % 5 > 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    features = {r.doc_id: r.asDict() for r in quality_features(df).collect()}
    value = lambda doc, rule: (lambda a, b: features[doc][a] / features[doc][b])(*RULES[rule][0].split(" / "))
    steps = [(rule, cutoffs[k]) for k in range(10) for rule, (_, cutoffs) in RULES.items()]
    want = {}
    for lang in ("en", "de", None):
        good = [d for d, _, x, q in rows if x == lang and q]
        held, gone = {}, set()
        for rule, cutoff in steps:
            gone |= {d for d in good if value(d, rule) > cutoff}
            tail = sum(math.comb(len(good), i) * 0.01**i * 0.99 ** (len(good) - i) for i in range(len(gone) + 1))
            if len(gone) > len(good) * 0.01 or tail > 0.05 / 3:
                break
            held[rule] = cutoff
        for d, _, x, _ in rows:
            if x == lang:
                want[d] = [r for r in RULES if r in held and value(d, r) > held[r]]
    assert any(want.values())
    assert {r.doc_id: r.rejected_by for r in judge(df.drop("quality"), df.select("doc_id", "quality")).collect()} == want
