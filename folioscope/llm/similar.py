"""Near-duplicate documents by word shingles, with SimHash and MinHash as the candidate search.

A SimHash of five-word shingles puts documents with a similarity of 0.8 seven to
fourteen bits apart, which no covering of 64 bits can search.  Candidates are the
documents whose words' SimHashes lie within two bits (:func:`folioscope.llm.simhash.links`), and
those that meet in a MinHash band of their shingle sets.  The bands bear the guarantee, whatever the
edit; how they are searched without making all pairs of a band, and how a candidate is tested
by its odd sketch and confirmed on the full sets, is told in :mod:`folioscope.llm.odd_sketch`.

Defined results
---------------
* null, empty or blank text: one empty shingle set; such documents are copies of each other.
* fewer words than a shingle: the whole word sequence is the one shingle.
* rows with a null ``doc_id`` stay and take no part.
* rows that share a ``doc_id`` are one document with each of its texts; they stay or go together.
* ids may be of any type with an order.
* other columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, fresh_names, settle, spread_join
from folioscope.llm.odd_sketch import component_ids, linked_components, named, sketched, text_key
from folioscope.llm.simhash import components, fingerprints, links


def simhash_pairs(rows: DataFrame, nodes: DataFrame, radius: int = 2) -> DataFrame:
    """``u, v`` texts whose words' fingerprints lie within ``radius`` bits: each with the smallest of its fingerprint, and those of linked ones."""
    prints = fingerprints(rows.select(F.struct(*text_key(F.col("text"))).alias("doc_id"), "text"), 1)
    prints = prints.groupBy(F.col("doc_id.a").alias("a"), F.col("doc_id.b").alias("b")).agg(F.first("fp").alias("fp"))
    held = cut(prints.join(nodes.where("n > 0").select("a", "b", "node").hint("merge"), ["a", "b"]).select("node", "fp"))
    firsts = cut(held.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    equal = spread_join(held, firsts.select("fp", "first"), ["fp"], firsts.select("fp", "n")).where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    first = firsts.select("fp", "first")
    met = links(firsts.select("fp"), radius)
    far = met.join(first.toDF("u", "a").hint("merge"), "u").join(first.toDF("v", "b").hint("merge"), "v")
    return cut(equal.union(far.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).distinct())


def _tied(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``u, v``: texts that belong together whatever they are: blank ones, and those of one document."""
    blank = nodes.where("n = 0").select("node")
    tied = blank.join(F.broadcast(blank.agg(F.min("node").alias("u"))), F.col("node") != F.col("u")).select("u", F.col("node").alias("v"))
    key = F.struct(*text_key(F.col("text")))
    several = rows.select("doc_id", key.alias("k")).groupBy("doc_id").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x <> y").select("doc_id")
    held = rows.join(several.hint("merge"), "doc_id").select("doc_id", *text_key(F.col("text")))
    held = cut(held.distinct().join(nodes.select("a", "b", "node").hint("merge"), ["a", "b"]))
    first = held.groupBy("doc_id").agg(F.min("node").alias("u"))
    return tied.union(held.join(first.hint("merge"), "doc_id").where("node <> u").select("u", F.col("node").alias("v")))


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, component_id`` of every row with a ``doc_id``."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    nodes = sketched(rows, shingle, percent)
    met = simhash_pairs(rows, nodes)
    settle(docs.sparkSession)
    roots = linked_components(rows, nodes, shingle, percent, met)
    # The whole texts were dealt out in there; nothing that follows needs it.
    settle(docs.sparkSession)
    tied = cut(_tied(rows, nodes))
    if not tied.isEmpty():
        # Only the components of their ends have to be joined.
        root = cut(named(tied.select(F.col("u").alias("node")).union(tied.select("v")).distinct(), roots))
        between = tied.join(root.toDF("u", "root_u").hint("merge"), "u").join(root.toDF("v", "root_v").hint("merge"), "v").where("root_u <> root_v")
        higher = components(between.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")).distinct()).toDF("root", "higher")
        every = roots.union(root.join(roots.select("node").hint("merge"), "node", "left_anti"))
        roots = cut(every.join(higher.hint("merge"), "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
    told = cut(component_ids(nodes.select("node", "a", "b", "low", "rows"), roots))
    keyed = rows.select("doc_id", *text_key(F.col("text")))
    return spread_join(keyed, told.select("a", "b", "component_id"), ["a", "b"], told.select("a", "b", F.col("rows").alias("n"))).select("doc_id", "component_id")


def similar_documents(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, component_id`` of the documents in a group of two or more."""
    every = cut(_grouped(docs, shingle, percent).distinct())
    groups = every.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread_join(every, groups.drop("n"), ["component_id"], groups).select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, same columns, with the smallest ``doc_id`` of every group."""
    (gone_id,) = fresh_names(docs.columns, "gone")
    gone = cut(_grouped(docs, shingle, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct())
    settle(docs.sparkSession)
    return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti").select(*docs.columns)
