"""Quotation linking for conversations (DataFrame functions only).

Lines are parsed into nested quote levels and text, and runs of lines of one level
become passages.  A passage is normalised (case and white space, so that a quotation
that was wrapped anew is still the same) and its ``WORDS``-word windows are hashed to 128
bits; a shorter passage is one window.  A window quoted at level ``n`` is joined to the
latest earlier message of the conversation that has it at level ``n - 1``: that message
is what is answered.  The message with the most such windows becomes the parent, the
latest one on ties; a message without a linked quotation answers the one before.
Messages then follow their parents, depth first, and quotations are taken out.

No step holds a conversation in one task.  "The latest earlier" is a running maximum over
ranges of turns and over the ranges' own maxima.  A run of messages that each answer the
one before is one branch; the order of branches is their rank in the tour of the tree,
found by doubling the reach of each pointer, so rounds grow with the logarithm of the
number of branches.  A conversation is written as one sequence in chunks of about
``CHUNK`` bytes.

Defined results
---------------
* null text: an empty message.  A message that is all quotation becomes empty.
* rows with a null ``conv_id`` or ``turn`` are conversations of one message each.
* rows that share a ``conv_id`` and a ``turn`` are one turn; they answer the same
  message and are ordered by role and text.
* turns are ordered by their number, whatever the gaps between them.
* null role: rendered as ``unknown``.
* columns other than the four are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut

#: Words in a window of a passage.
WORDS = 5
CHUNK = 1 << 20
#: A line that introduces a quotation, in the four languages of the corpus.
ATTRIBUTION = r"^\s*(On|Am|Le|El)\b.{3,120}\b(wrote|schrieb|a écrit|escribió)\b.{0,40}:\s*$"
QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
#: Control characters that mark passages and their levels; text loses them when it is normalised.
PASSAGE, LEVEL = "\x01", "\x02"


def parsed_lines(text: Column) -> Column:
    """An array of level and text, in order."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, QUOTE, "").alias("body"),
        ),
    )


def own_text(lines: Column) -> Column:
    """The lines without a quotation and without the line that introduces one, outer blank lines dropped."""
    kept = F.filter(
        lines,
        lambda x, i: (x["level"] == 0)
        & ~(x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)),
    )
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"^(?:[ \t]*\n)+|\s+$", "")


def normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[\s\p{Z}\x01\x02]+", " "))


def passages(lines: Column) -> Column:
    """Level and text of every run of lines of one level, as ``level LEVEL text``; ``lines`` must be a column."""
    begins = lambda x, i: (i == 0) | (F.get(lines, i - 1)["level"] != x["level"])
    parts = F.transform(
        lines,
        lambda x, i: F.concat(F.when(begins(x, i), F.concat(F.lit(PASSAGE), x["level"], F.lit(LEVEL))).otherwise(" "), normal(x["body"])),
    )
    return F.slice(F.split(F.array_join(parts, ""), PASSAGE), 2, F.size(lines))


def quoted_windows(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, a, b``: hashed windows of all passages of conversations that quote anything."""
    keys = ["conv_id", "turn", "level"]
    quoting = messages.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id").distinct()
    inside = messages.join(quoting, "conv_id", "left_semi")
    runs = inside.select("conv_id", "turn", F.explode(passages(F.col("lines"))).alias("p")).select(
        "conv_id", "turn", F.split_part("p", F.lit(LEVEL), F.lit(1)).cast("int").alias("level"), normal(F.split_part("p", F.lit(LEVEL), F.lit(2))).alias("form")
    )
    words = runs.where("form <> ''").select(*keys, F.split("form", " ").alias("w"))
    windows = words.select(
        *keys,
        F.explode(
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WORDS + 1)), lambda i: F.array_join(F.slice("w", i, WORDS), " "))
        ).alias("form"),
    )
    # A short line can be quoted by itself.
    short = inside.select("conv_id", "turn", F.explode("lines").alias("x")).select("conv_id", "turn", F.col("x.level").alias("level"), normal(F.col("x.body")).alias("form"))
    short = short.where((F.col("form") != "") & (F.regexp_count("form", F.lit(" ")) < WORDS - 1))
    # A line inside a quotation is no window of its own: only what is quoted must be found, not every part of it.
    both = windows.withColumn("whole", F.lit(True)).unionByName(short.withColumn("whole", F.lit(False)))
    return (
        both.groupBy(*keys, F.xxhash64("form").alias("a"), F.xxhash64(F.lit("second"), "form").alias("b"))
        .agg(F.max("whole").alias("whole"))
    )


def running_max(df: DataFrame, keys: list[str], order: str, value: Column, name: str, reach: str) -> DataFrame:
    """Adds the largest ``value`` of the rows that come before in ``order`` among rows with equal ``keys``.

    ``reach``: "earlier" leaves out all rows of the same ``order``, "row" the row itself, "here" none.
    Rows are dealt to tasks by ranges of the keys and the order, so a key may be as large as it likes.
    """
    laid = cut(df.withColumn("_value", value).repartitionByRange(*keys, order).withColumn("_block", F.spark_partition_id()))
    here = Window.partitionBy(*keys, "_block").orderBy(order)
    first = Window.unboundedPreceding
    here = {"earlier": lambda: here.rangeBetween(first, -1), "row": lambda: here.rowsBetween(first, -1), "here": lambda: here.rangeBetween(first, 0)}[reach]()
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(first, -1)
    tops = laid.groupBy(*keys, "_block").agg(F.max("_value").alias("_top"))
    tops = tops.select(*keys, "_block", F.max("_top").over(before).alias("_before")).where("_before IS NOT NULL")
    return (
        laid.withColumn("_inside", F.max("_value").over(here))
        .join(tops, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_inside", "_before"))
        .drop("_value", "_block", "_inside", "_before")
    )


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, parent, n_linked`` of the turns with a linked quotation; ``messages`` has parsed ``lines``."""
    hashed = cut(quoted_windows(messages))
    keys = ["conv_id", "level", "a", "b"]
    asked = hashed.where("level > 0 AND whole").withColumn("level", F.col("level") - 1)
    # Only windows that someone quotes can answer.
    known = hashed.join(asked.select(*keys).distinct(), keys, "left_semi").withColumn("original", F.lit(True))
    events = known.unionByName(asked.withColumn("original", F.lit(False)))
    sourced = running_max(events, keys, "turn", F.when(F.col("original"), F.col("turn")), "parent", "earlier")
    votes = (
        sourced.where("NOT original AND parent IS NOT NULL")
        .groupBy("conv_id", "turn", "parent")
        .agg(F.count(F.lit(1)).alias("n_linked"))
    )
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n_linked", "parent")).alias("best")).select(
        "conv_id", "turn", "best.parent", "best.n_linked"
    )


def branch_ranks(branches: DataFrame) -> DataFrame:
    """``conv_id, branch, later``: how many branches of a conversation stand from each one on, in depth-first order.

    ``branches`` has ``conv_id, branch, up, left``: the branch above (null at the root) and
    the turn that it leaves from.  Branches that leave later come first, then those that begin earlier.
    """
    ordered = branches.withColumn("place", F.struct((-F.col("left")).alias("left"), "branch"))
    below = ordered.where("up IS NOT NULL")
    firsts = below.groupBy("conv_id", "up").agg(F.min("place").alias("first")).select("conv_id", F.col("up").alias("branch"), F.col("first.branch").alias("child"))
    nexts = running_max(below, ["conv_id", "up"], "place", F.col("place"), "previous", "row").where("previous IS NOT NULL")
    nexts = nexts.select("conv_id", F.col("previous.branch").alias("branch"), F.col("branch").alias("sibling"))
    enter = branches.join(firsts, ["conv_id", "branch"], "left").select(
        "conv_id", "branch", F.lit(False).alias("out"), F.lit(1).cast("long").alias("n"), F.coalesce("child", "branch").alias("to"), F.col("child").isNull().alias("to_out")
    )
    leave = branches.join(nexts, ["conv_id", "branch"], "left").select(
        "conv_id", "branch", F.lit(True).alias("out"), F.lit(0).cast("long").alias("n"), F.coalesce("sibling", "up").alias("to"), F.col("sibling").isNull().alias("to_out")
    )
    tour = cut(enter.unionByName(leave))
    while not tour.where("to IS NOT NULL").isEmpty():
        ahead = tour.select("conv_id", F.col("branch").alias("to"), F.col("out").alias("to_out"), F.col("n").alias("more"), F.col("to").alias("then"), F.col("to_out").alias("then_out"))
        tour = cut(
            tour.join(ahead, ["conv_id", "to", "to_out"], "left").select(
                "conv_id", "branch", "out", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("then").alias("to"), F.col("then_out").alias("to_out")
            )
        )
    return tour.where("NOT out").select("conv_id", "branch", F.col("n").alias("later"))


def reply_order(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, n_linked, branch, later`` per turn; messages stand by ``later`` downwards, then by turn."""
    turns = messages.select("conv_id", "turn").distinct()
    before = running_max(turns, ["conv_id"], "turn", F.col("turn"), "previous", "earlier")
    linked = cut(
        before.join(quote_links(messages), ["conv_id", "turn"], "left").select(
            "conv_id",
            "turn",
            F.coalesce("parent", "previous").alias("reply_to"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            (F.col("previous").isNull() | (F.coalesce("parent", "previous") != F.col("previous"))).alias("starts"),
        )
    )
    # Conversations of one branch are in order as they are.
    forked = cut(linked.where("starts AND reply_to IS NOT NULL").select("conv_id").distinct())
    straight = linked.join(forked, "conv_id", "left_anti").select("conv_id", "turn", "reply_to", "n_linked", F.lit(None).cast("long").alias("branch"), F.lit(0).cast("long").alias("later"))
    if forked.isEmpty():
        return straight
    several = linked.join(forked, "conv_id", "left_semi")
    placed = cut(running_max(several, ["conv_id"], "turn", F.when(F.col("starts"), F.col("turn")), "branch", "here"))
    above = placed.select("conv_id", F.col("turn").alias("reply_to"), F.col("branch").alias("up"))
    branches = placed.where("starts").select("conv_id", "branch", "reply_to").join(above, ["conv_id", "reply_to"], "left")
    ranks = branch_ranks(cut(branches.select("conv_id", "branch", "up", F.col("reply_to").alias("left"))))
    return straight.unionByName(placed.drop("starts").join(ranks, ["conv_id", "branch"]).select(*straight.columns))


def link_messages(conversations: DataFrame) -> DataFrame:
    """Per message row: ``conv_id, turn, role, text`` without quotations, ``reply_to, branch, later, n_quoted, n_linked``."""
    parsed = conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        parsed_lines(F.col("text")).alias("lines"),
    )
    whole = cut(parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL"))
    columns = ["conv_id", "turn", "role", "lines", "reply_to", "n_linked", "branch", "later"]
    linked = whole.join(reply_order(whole), ["conv_id", "turn"]).select(*columns)
    none = F.lit(0).cast("long")
    alone = parsed.where("conv_id IS NULL OR turn IS NULL").select(
        *columns[:4], F.lit(None).cast("long").alias("reply_to"), none.alias("n_linked"), F.col("turn").alias("branch"), none.alias("later")
    )
    return linked.union(alone).select(
        "conv_id",
        "turn",
        "role",
        own_text(F.col("lines")).alias("text"),
        "reply_to",
        "branch",
        "later",
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        "n_linked",
    )


def with_parts(messages: DataFrame, chunk: int) -> DataFrame:
    """Adds ``part``: the number of whole ``chunk`` bytes that stand before a message in its conversation."""
    sized = cut(messages.withColumn("_bytes", F.octet_length("text") + F.octet_length("role") + 24).withColumn("_row", F.monotonically_increasing_id()))
    large = cut(sized.where("_alone IS NULL").groupBy("conv_id").agg(F.sum("_bytes").alias("n")).where(F.col("n") > chunk).select("conv_id"))
    one = sized.join(large, "conv_id", "left_anti").withColumn("part", F.lit(0).cast("long"))
    if large.isEmpty():
        return one
    order = [F.col("later").desc(), F.col("turn"), F.col("role"), F.col("text"), F.col("_row")]
    long = sized.where("_alone IS NULL").join(large, "conv_id", "left_semi")
    long = cut(long.repartitionByRange("conv_id", *order).withColumn("_block", F.spark_partition_id()))
    first = Window.unboundedPreceding
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(first, -1)
    tops = long.groupBy("conv_id", "_block").agg(F.sum("_bytes").alias("n"))
    tops = tops.select("conv_id", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(first, -1)
    inside = long.withColumn("_inside", F.coalesce(F.sum("_bytes").over(here), F.lit(0))).join(tops, ["conv_id", "_block"])
    return one.unionByName(inside.withColumn("part", F.floor((F.col("_before") + F.col("_inside")) / chunk)).select(*one.columns))


def chats(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Conversations in reply order: ``conv_id, part, n_messages, n_quoted, n_linked, replies, chat``.

    ``part`` numbers the chunks of a conversation longer than ``chunk`` bytes; read in
    order they are one depth-first sequence.  ``replies`` lists turn>parent; ``chat`` is
    the rendered text.
    """
    # A message without a conversation or a turn is a group of its own.
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    messages = link_messages(conversations).withColumn("_alone", F.when(alone, F.monotonically_increasing_id()))
    grouped = with_parts(messages, chunk).groupBy("conv_id", "part", "_alone").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("later")).alias("later"), "turn", "role", "text", "reply_to"))).alias("m"),
        F.sum("n_quoted").alias("n_quoted"),
        F.sum("n_linked").alias("n_linked"),
    )
    reply = F.transform("m", lambda x: F.concat_ws(">", x["turn"].cast("string"), x["reply_to"].cast("string")))
    turn = F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n<|end|>")))
    return grouped.select(
        "conv_id",
        "part",
        F.size("m").cast("long").alias("n_messages"),
        "n_quoted",
        "n_linked",
        F.array_join(reply, ",").alias("replies"),
        F.array_join(turn, "\n").alias("chat"),
    )
