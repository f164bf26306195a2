"""Line dedup by range-partitioned line hashes (DataFrame functions only).

Every line becomes a 128-bit hash of its key.  The hashes are range-partitioned
on (hash, document, position) and sorted within partitions, so a hash that a
third of all documents share is spread over many partitions; each sorted run is
pre-aggregated where it lies to its first occurrence and its number of documents,
and only that one row per hash and partition is shuffled again.  What comes back
is a run-length keep bitmap per document, never text.

Defined results
---------------
* null or empty text: one empty line; its key is empty and is never dropped.
* each row is a document of its own: equal rows count as several documents.
* rows with a null ``doc_id`` are handled like any other.
* columns other than ``doc_id`` and ``text`` are ignored.
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import BLANKS, ascii_lower, cut, fresh_names, sha256_hex, spread_join


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, n_lines, a, b``: two 64-bit hashes per line, null where the key is empty.

    ``row_key`` tells rows of one ``doc_id`` with different texts apart.
    """
    keys = docs.select(
        "doc_id",
        F.xxhash64("text").alias("row_key"),
        F.transform(split_lines(ascii_lower(F.col("text"))), lambda x: F.btrim(x, F.lit(BLANKS))).alias("keys"),
    )
    return keys.select(
        "doc_id",
        "row_key",
        F.size("keys").alias("n_lines"),
        F.transform("keys", lambda k: F.when(k != "", F.xxhash64(k))).alias("a"),
        F.transform("keys", lambda k: F.when(k != "", F.xxhash64(F.lit("second"), k))).alias("b"),
    )


def first_occurrences(hashes: DataFrame, min_docs: int) -> DataFrame:
    """``a, b, n_docs, first_doc, first_pos`` of the keys found in at least ``min_docs`` documents."""
    entry = F.sort_array(
        F.filter(
            F.transform(
                F.sequence(F.lit(0), F.col("n_lines") - 1),
                lambda i: F.struct(F.get("a", i).alias("a"), F.get("b", i).alias("b"), i.alias("pos")),
            ),
            lambda x: x["a"].isNotNull(),
        )
    )
    once = (
        hashes.select("doc_id", "row_key", entry.alias("e"))
        .select(
            "doc_id",
            "row_key",
            F.explode(
                F.filter(
                    "e",
                    lambda x, i: (i == 0)
                    | (F.get("e", i - 1)["a"] != x["a"])
                    | (F.get("e", i - 1)["b"] != x["b"]),
                )
            ).alias("x"),
        )
        .select("x.a", "x.b", "doc_id", "row_key", "x.pos")
    )
    order = ["a", "b", "doc_id", "row_key", "pos"]
    runs = once.repartitionByRange(*order).sortWithinPartitions(*order)
    return (
        runs.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "row_key", "pos")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
        .select(
            "a",
            "b",
            "n_docs",
            F.col("first.doc_id").alias("first_doc"),
            F.col("first.row_key").alias("first_key"),
            F.col("first.pos").alias("first_pos"),
        )
    )


def keep_bitmap(n_lines: Column, dropped: Column) -> Column:
    """Run lengths of kept and dropped lines in turn, beginning with kept ones.

    ``dropped`` must be a column of sorted, distinct positions, possibly empty.
    """
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1))
    pairs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    edges = F.flatten(F.transform(pairs, lambda p: F.array(p["s"], p["e"] + 1)))
    bounds = F.concat(F.array(F.lit(0)), edges, F.array(n_lines))
    return F.zip_with(F.slice(bounds, 1, F.size(bounds) - 1), F.slice(bounds, 2, F.size(bounds) - 1), lambda x, y: y - x)


def apply_bitmap(text: Column, bitmap: Column) -> Column:
    """The kept lines of ``text``, joined by a line feed."""
    flags = F.flatten(F.transform(bitmap, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.filter(F.zip_with(split_lines(text), flags, lambda line, f: F.when(f, line)), lambda x: x.isNotNull())
    return F.array_join(kept, "\n")


def line_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """``doc_id, row_key, n_lines, n_dropped, bitmap`` of the documents that lose a line.

    A key found in ``min_docs`` documents or more loses all its lines, or with
    ``keep_first`` all but the first in order of document and position.
    """
    hashes = cut(line_hashes(docs))
    frequent = cut(first_occurrences(hashes, min_docs))
    lines = hashes.select(
        "doc_id", "row_key", "n_lines", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "x")
    ).select("doc_id", "row_key", "n_lines", "pos", "x.a", "x.b")
    # The keys of most lines are dealt to several tasks.
    hit = spread_join(lines.where(F.col("a").isNotNull()), frequent, ["a", "b"], frequent.withColumnRenamed("n_docs", "n"))
    if keep_first:
        first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("row_key") == F.col("first_key"))
        hit = hit.where(~(first & (F.col("pos") == F.col("first_pos"))))
    gone = hit.groupBy("doc_id", "row_key", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return gone.select(
        "doc_id",
        "row_key",
        "n_lines",
        F.size("dropped").alias("n_dropped"),
        keep_bitmap(F.col("n_lines"), F.col("dropped")).alias("bitmap"),
    )


def with_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """``docs`` with ``dedup_bitmap`` and ``dedup_dropped`` (numbered if ``docs`` has those), null for documents that keep all lines."""
    doc, key, n, bitmap = fresh_names(docs.columns, "doc", "key", "dedup_dropped", "dedup_bitmap")
    found = line_bitmaps(docs, min_docs, keep_first).select(
        F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("n_dropped").alias(n), F.col("bitmap").alias(bitmap)
    )
    on = docs["doc_id"].eqNullSafe(found[doc]) & (F.xxhash64(docs["text"]) == found[key])
    return docs.join(found, on, "left").drop(doc, key)


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """``docs``, same columns, without the dropped lines; a text that loses every line becomes empty."""
    marked = with_bitmaps(docs, min_docs, keep_first)
    bitmap = F.col(marked.columns[-1])
    text = F.when(bitmap.isNull(), F.col("text")).otherwise(apply_bitmap(F.col("text"), bitmap))
    return marked.withColumn("text", text).select(*docs.columns)


def line_digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The contract's digest columns per document."""
    marked = with_bitmaps(docs.select("doc_id", "text"), min_docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.when(F.col("dedup_bitmap").isNull(), text).otherwise(apply_bitmap(text, F.col("dedup_bitmap")))
    return marked.select(
        "doc_id",
        F.size(split_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.col("dedup_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        sha256_hex(kept).alias("kept_sha256"),
        F.coalesce(F.col("dedup_bitmap"), F.array(F.size(split_lines(text)))).alias("keep_bitmap"),
    )
