"""Quotation linking against a brute-force version, on threads with deep, wide, wrapped and sparse quotations."""

import random
import re

import pytest
from folioscope.llm.chat import ATTRIBUTION, QUOTE, WORDS, chats, link_messages
from folioscope.llm.queries import op4_chat

THREAD = [
    (1, 0, "user", "Where is it?\nI need it."),
    (1, 1, "assistant", "On the shelf."),
    (1, 2, "user", "> Where is it?\nAnswering the first."),
    (1, 3, "user", "On 3 May, Ann wrote:\n> on  the SHELF.\nWhich shelf?"),
    (1, 4, "assistant", ">> On the shelf.\n> Which shelf?\nThe top one."),
    (2, 0, None, None),
    (None, 5, "user", "> alone"),
    (3, None, "user", "no turn"),
    (4, 1, "user", "same turn"),
    (4, 1, "user", "same turn"),
]


def table(spark, rows=THREAD):
    made = [(*r, "e", "f", 1) for r in rows]
    return spark.createDataFrame(made, "conv_id long, turn long, role string, text string, path string, lines string, part long").repartition(3)


def squeeze(text):
    return re.sub(r"\s+", " ", text.lower()).strip()


def parse(text):
    out = []
    for line in re.split("\r?\n", text or ""):
        mark = re.match(QUOTE, line)
        out.append((mark[1].count(">") if mark else 0, re.sub(QUOTE, "", line)))
    return out


def windows(lines):
    """Windows by level: those of whole passages, and short lines besides."""
    whole, short, at = set(), set(), 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end][0] == lines[at][0]:
            end += 1
        words = squeeze(" ".join(b for _, b in lines[at:end])).split()
        whole |= {(lines[at][0], " ".join(words[i : i + WORDS])) for i in range(max(1, len(words) - WORDS + 1)) if words}
        short |= {(level, squeeze(b)) for level, b in lines[at:end] if 0 < len(squeeze(b).split()) < WORDS}
        at = end
    return whole, whole | short


def brute(rows):
    """Per conversation: the messages in reply order as turn and parent, and the linked windows per turn."""
    by_conv = {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            by_conv.setdefault(conv, {}).setdefault(turn, []).append(parse(text))
    out = {}
    for conv, turns in by_conv.items():
        order, parent, linked = sorted(turns), {}, {}
        kinds = {t: (set().union(*(windows(x)[0] for x in turns[t])), set().union(*(windows(x)[1] for x in turns[t]))) for t in order}
        for k, turn in enumerate(order):
            votes = {}
            for level, form in kinds[turn][0]:
                source = next((t for t in reversed(order[:k]) if level and (level - 1, form) in kinds[t][1]), None)
                if source is not None:
                    votes[source] = votes.get(source, 0) + 1
            best = max(((n, t) for t, n in votes.items()), default=(0, order[k - 1] if k else None))
            linked[turn], parent[turn] = best
        children = {}
        for turn in order:
            children.setdefault(parent[turn], []).append(turn)
        seen, stack = [], [None]
        while stack:
            turn = stack.pop()
            seen += [turn] if turn is not None else []
            stack += reversed(children.get(turn, []))
        out[conv] = ([f"{t}>{parent[t]}" if parent[t] is not None else f"{t}" for t in seen for _ in turns[t]], linked)
    return out


def replies(df):
    got = {}
    for r in sorted(df.where("conv_id IS NOT NULL").collect(), key=lambda r: (r.conv_id, r.part)):
        got.setdefault(r.conv_id, []).extend(r.replies.split(","))
    return got


def wrapped(rng, text, mark):
    words, lines = text.split(), []
    while words:
        n = rng.randint(3, 9)
        lines.append(mark + " ".join(words[:n]))
        words = words[n:]
    return "\n".join(lines)


def threads(rng, shape, n):
    """``n`` messages of one conversation: each quotes an earlier one, part of it, or nothing."""
    rows, own, quoted = [], {}, {}
    step = {"sparse": 1_000_003, "late": 1}.get(shape, 1)
    turn = 1_700_000_000 if shape == "sparse" else 0
    for k in range(n):
        own[k] = " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(6, 25)))
        parts = []
        source = None if not k else k - 2 if shape == "deep" and k > 1 else 0 if shape == "wide" else rng.randrange(k) if rng.random() < 0.7 else None
        if source is not None:
            text = own[source]
            if rng.random() < 0.3:
                words = text.split()
                text = " ".join(words[rng.randrange(len(words) // 2) :])
            parts = ["On Monday the 4th, Ann wrote:", wrapped(rng, text, "> ")]
            if quoted.get(source) and rng.random() < 0.5:
                parts.insert(1, wrapped(rng, quoted[source], ">> "))
            quoted[k] = text
        rows.append((turn, "user" if k % 2 else "assistant", "\n".join([*parts, own[k], *(["Thanks,"] if rng.random() < 0.5 else [])])))
        turn += step * rng.randint(1, 3)
    return rows


def test_quotations_link_to_their_originals(spark):
    got = {(r.conv_id, r.turn): r for r in link_messages(table(spark)).collect()}
    assert [got["1", k].reply_to for k in range(5)] == [None, 0, 0, 1, 3]
    assert [got["1", k].text for k in range(5)] == ["Where is it?\nI need it.", "On the shelf.", "Answering the first.", "Which shelf?", "The top one."]
    assert got["1", 4].n_quoted == 2 and got["1", 4].n_linked == 2
    assert got["2", 0].role == "unknown" and got[None, 5].reply_to is None


def test_conversations_stand_in_reply_order(spark):
    got = chats(table(spark)).collect()
    first = next(r for r in got if r.conv_id == "1")
    assert first.replies == "0,1>0,3>1,4>3,2>0" and "> " not in first.chat
    assert sum(r.n_messages for r in got) == len(THREAD)
    assert chats(table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1 << 20, 900])
def test_generated_threads(spark, chunk):
    rng, rows = random.Random(11), []
    for conv, (shape, n) in enumerate([("any", 40), ("any", 7), ("deep", 60), ("wide", 50), ("sparse", 30), ("any", 1), ("late", 25)]):
        rows += [(conv, *r) for r in threads(rng, shape, n)]
    rows += rows[5:9]
    want = brute(rows)
    got = chats(table(spark, rows), chunk)
    assert replies(got) == {str(c): order for c, (order, _) in want.items()}
    parts = got.collect()
    assert (max(r.part for r in parts) > 3) == (chunk == 900)
    assert all(len(r.chat.encode()) < chunk + 2000 for r in parts)
    linked = {(r.conv_id, r.turn): r.n_linked for r in link_messages(table(spark, rows)).collect()}
    assert linked == {(str(c), t): n for c, (_, x) in want.items() for t, n in x.items()} and sum(linked.values()) > 500


def test_attributions_are_taken_out():
    assert re.match(ATTRIBUTION, "Am 3. Mai 2024 um 10:00 schrieb Ann:") and not re.match(ATTRIBUTION, "On the shelf.")


def test_every_message_is_in_some_conversation(spark, folder):
    n = spark.read.parquet(f"{folder}/conversations.parquet").count()
    assert sum(r.n_messages for r in op4_chat(spark, folder).collect()) == n
