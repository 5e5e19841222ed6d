"""Conversation repair against a search of all edits; nulls, ties, repeated rows, dropped and long conversations, empty tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import conversations, queries

ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """(initial, fault) of each turn -> (cost, audit): Dijkstra over (turns read, roles so far by the grammar), all edits."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, at = heapq.heappop(queue)
        if (i, at) in seen:
            continue
        seen.add((i, at))
        if i == len(turns) and at in ("", "a"):
            return cost, audit
        for s in "ua":
            if (at, s) in step:
                heapq.heappush(queue, (cost + 5, audit + "I", i, step[at, s]))
        if i < len(turns):
            initial, fault = turns[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, at))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if (at, initial) in step:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, step[at, initial]))
                for s in "ua":
                    if (at, s) in step:
                        heapq.heappush(queue, (cost + 1 + extra, audit + "R", i + 1, step[at, s]))


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        turns, seen, faults = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in kept:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            turns.append((role[:1], fault))
        given = [t for t, _, _ in kept if t is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = cheapest(turns)
        lines, i, last = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else kept[i][1:]
            i += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        roles = "".join(x[0] for x in lines)
        assert re.fullmatch("(s?(ua)+)?", roles)
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, tmp_path, more=()):
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in more})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, got.select(*names).collect()), key=str)


def test_against_a_search(spark, tmp_path):
    rnd = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "Ä", "ux"]
    texts = ["Fine.", "Well!", "So?", "cut", "cut off \n", "end. \x0b", "", " ", None, "é", " ", "x ", "Ok. "]
    rows = []
    for conv in range(250):
        order = [rnd.randrange(12) for _ in range(rnd.randrange(1, 14))] if conv % 2 else list(range(rnd.randrange(1, 14)))
        for turn in order:
            rows.append((conv, None if rnd.random() < 0.05 else turn * (1 if conv % 5 else -7), rnd.choice(roles), rnd.choice(texts)))
    for conv in range(250, 400):
        rows += [(conv, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(rnd.randrange(1, 9))]
    rows += [(None, 1, "user", "Null."), (None, None, None, None), (-3, None, "user", "All null."), (-3, None, "assistant", "All null."), (-4, 2**62, "user", "a."), (-4, -(2**62), "user", "b.")]
    assert found(spark, rows, tmp_path, ("digest", "audit", "dropped", "a.b")) == plain(rows)


def test_long_conversations(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(1, t, rnd.choice(["user", "assistant", "tool"]), rnd.choice([f"Text {t}.", "cut", "Same."])) for t in range(3000)]
    rows += [(2, t, "tool", f"Text {t}.") for t in range(1500)] + [(3, t, "user", "") for t in range(700)] + [(4, 5, "user", "word " * 100_000 + ".")]
    assert found(spark, rows, tmp_path) == plain(rows)


def test_dropped_and_empty(spark, tmp_path):
    gone = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert len(gone) > 3
    want = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone]
    assert found(spark, gone, tmp_path / "a") == sorted(want, key=str)
    assert found(spark, [], tmp_path / "b") == []


@pytest.mark.parametrize("length", range(6))
def test_every_short_conversation(length):
    kinds = [(i, f) for i in "sua " for f in ("", "blank", "truncated")]
    some = list(itertools.product(kinds, repeat=length))
    for turns in some if length < 4 else random.Random(length).sample(some, 1500):
        p = conversations.Parse()
        for initial, fault in turns:
            p.turn(initial, {"": 0, "blank": conversations.BLANK, "truncated": conversations.CUT}[fault])
        assert p.end() == cheapest(turns)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "More."), (1, 2, "user", "cut"), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, ROWS)
    got = conversations.repaired(df, conversations.parse(df)).collect()
    assert [(r["conv_id"], r["step"], r["edit"], r["turn"], r["role"], r["text"]) for r in sorted(got, key=lambda r: (r["conv_id"], r["step"]))] == [(1, 0, "R", 0, "user", "Hello."), (1, 1, "K", 1, "assistant", "More.")]
