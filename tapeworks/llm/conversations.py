"""Repair of damaged conversations: a generalised LR parse of their roles, with weighted edits.

The roles of a repaired conversation are (s?(ua)+)?: nothing, or an optional system turn and pairs of user and assistant. An LR
automaton of that grammar reads a conversation's turns; its stacks form a graph, as each is a linked list that shares what lies
below with those it came from. At each turn every stack is continued by Keep, Rerole and Delete, and between turns by Insert;
where two come to the same top state, the smaller (cost, audit) stays: what may follow depends on the top alone, since all that
lies below a top of this grammar is a beginning that asks for nothing more. So a turn has five tops at most.

Parsing reads no texts: a turn is its role's initial and its fault. A conversation's turns are streamed, in order, through one
task; the audit's beginning that all stacks share leaves the stacks, and stacks that cost more than any way of catching up are
given up, so that what is held is short whatever the conversation's length. A second pass streams the texts past the audit.
Only these streams are sequential (as is a hash over a whole conversation); repeated turns are found by a window over a digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What it costs at most to go on as another stack does: an inserted pair and a system turn deleted.
CATCH_UP = 2 * INSERT + DELETE
BLANK, DUPLICATE, CUT = 1, 2, 3
WHITE = r"\x20\x09-\x0D"

# Grammar: conversation C -> nothing | s P | P; pairs P -> T | P T; pair T -> u a.
#: State of the LR automaton and symbol -> next state.
GOTO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (0, "T"): 4, (1, "T"): 4, (0, "P"): 5, (1, "P"): 6, (5, "u"): 2, (6, "u"): 2, (5, "T"): 7, (6, "T"): 7}
#: State -> what is reduced in it, and the number of symbols popped.
REDUCE = {3: ("T", 2), 4: ("P", 1), 7: ("P", 2)}
#: States in which a conversation may end.
ENDS = {0, 5, 6}


@cache
def pushed(stack: tuple, symbol: str) -> tuple | None:
    """A stack (state, stack below) after a shift and all reductions; None if the symbol can't follow."""
    if (state := GOTO.get((stack[0], symbol))) is None:
        return None
    stack = (state, stack)
    while (rule := REDUCE.get(stack[0])) is not None:
        for _ in range(rule[1]):
            stack = stack[1]
        stack = (GOTO[stack[0], rule[0]], stack)
    return stack


class Parse:
    """The stacks of one conversation: top state -> (cost, audit since `audit`, stack)."""

    def __init__(self):
        self.audit, self.turns, self.tops = [], 0, {}
        self.close([(0, "", (0, None))])

    def close(self, found: list[tuple]) -> None:
        """Merges equal tops, and inserts as long as that gives a new or a cheaper top."""
        tops: dict[int, tuple] = {}
        while found:
            more = []
            for top in found:
                state = top[2][0]
                if state not in tops or top[:2] < tops[state][:2]:
                    tops[state] = top
                    more += [(top[0] + INSERT, top[1] + "I", nxt) for symbol in ROLES if (nxt := pushed(top[2], symbol)) is not None]
            found = more
        least = min(t[0] for t in tops.values())
        self.tops = {s: t for s, t in tops.items() if t[0] <= least + CATCH_UP}

    def turn(self, initial: str, fault: int) -> None:
        found, extra = [], TRUNCATED if fault == CUT else 0
        for cost, audit, stack in self.tops.values():
            found.append((cost + DELETE, audit + "D", stack))
            if fault in (BLANK, DUPLICATE):
                continue
            if initial in ("s", "u", "a") and (nxt := pushed(stack, initial)) is not None:
                found.append((cost + KEEP + extra, audit + "K", nxt))
            found += [(cost + REROLE + extra, audit + "R", nxt) for symbol in ROLES if (nxt := pushed(stack, symbol)) is not None]
        self.close(found)
        self.turns += 1
        if self.turns % 64 == 0:
            self.settle()

    def settle(self) -> None:
        """Moves the beginning that all audits share."""
        a, b = min(t[1] for t in self.tops.values()), max(t[1] for t in self.tops.values())
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        self.audit.append(a[:n])
        self.tops = {s: (cost, audit[n:], stack) for s, (cost, audit, stack) in self.tops.items()}

    def end(self) -> tuple[int, str]:
        cost, audit, _ = min(t for s, t in self.tops.items() if s in ENDS)
        return cost, "".join(self.audit) + audit


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turn, role, text, dropped), damaged by crc32(`conv_id:turn`) % 20.

    Nulls are one space, in that key as well as in role and text (conv_id and turn stay null). 0 drops the row, which stays here as
    dropped; 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 gives it the role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def first_fault(text: Column, nth: Column) -> Column:
    """Blank, a turn seen earlier, or one whose last character that isn't white space is none of `.!?`; else 0."""
    blank = ~text.rlike(f"[^{WHITE}]")
    return F.when(blank, BLANK).when(nth > 1, DUPLICATE).when(~text.rlike(rf"[.!?][{WHITE}]*\z"), CUT).otherwise(0)


def parse(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text[, dropped]) -> (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): a row for each conversation.

    Turns are in order, null first; those of one turn by role and the text's MD5. Dropped rows only name their conversation: one without
    others has zeros and an empty audit. A null conv_id is a conversation; nulls in role and text count as one space, and an empty role
    has no initial and fits nowhere. Gaps are of turns that aren't null. An empty table gives an empty one.
    """
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    base = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("digest"), dropped.alias("dropped"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy("turn"))
    turns = base.select("conv_id", "turn", "role", "digest", "dropped", first_fault(F.col("text"), F.lit(0)).alias("own")).withColumn("nth", nth)
    turns = turns.select("conv_id", "turn", "role", "digest", "nth", "dropped", F.substring("role", 1, 1).alias("initial"), F.when((F.col("own") != BLANK) & (F.col("nth") > 1), DUPLICATE).otherwise(F.col("own")).alias("fault"))
    fields = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])

    def one(conv_id, own) -> dict:
        p, faults, illegal, before, low, high, distinct = Parse(), [0, 0, 0, 0], 0, None, None, None, 0
        for _, turn, initial, fault, gone in own:
            if gone:
                continue
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
            faults[fault] += 1
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            p.turn(initial, fault)
        cost, audit = p.end()
        gaps = 0 if low is None else min(high - low + 1 - distinct, 2**63 - 1)
        return {"conv_id": conv_id, "gaps": gaps, "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[CUT], "illegal": illegal, "cost": cost, "audit": audit}

    def parsed(batches) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "initial", "fault", "dropped"))))
        held, size = [], 0
        for conv_id, own in groupby(each, lambda r: r[0]):
            held.append(one(conv_id, own))
            size += 100 + len(held[-1]["audit"])
            if size > 1_000_000:
                yield pa.RecordBatch.from_pylist(held, fields)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, fields)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "nth")
    return ordered.select("conv_id", "turn", "initial", "fault", "dropped").mapInArrow(parsed, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: (conv_id, step, edit, turn, role, text), in order within a partition, a conversation in one.

    step counts a conversation's repaired turns from 0; an inserted turn has no turn number and an empty text. rows and their order as for
    parse(), whose audits say what becomes of each. A conversation that keeps nothing has no row here.
    """
    here = rows.where("not dropped") if "dropped" in rows.columns else rows
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    none = lambda kind: F.lit(None).cast(kind)
    both = here.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("digest"), none("string").alias("audit")).union(parsed.select("conv_id", none("long"), none("string"), none("string"), none("string"), "audit"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").asc_nulls_last(), "turn", "role", "digest").drop("digest")
    fields = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def edits(batches) -> Iterator[pa.RecordBatch]:
        audit, at, step, stack = "", 0, 0, (0, None)
        for b in batches:
            out = []

            def placed(conv_id, edit, symbol, turn, role, text, out=out):
                nonlocal step, stack
                if symbol is None:  # the one of the two roles that can follow
                    symbol = next(s for s in ROLES if pushed(stack, s) is not None)
                    role = ROLES[symbol]
                stack = pushed(stack, symbol)
                out.append((conv_id, step, edit, turn, role, text))
                step += 1

            for conv_id, turn, role, text, whole in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "audit"))):
                if whole is not None:
                    audit, at, step, stack = whole, 0, 0, (0, None)
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        placed(conv_id, edit, role[0] if edit == "K" else None, turn, role, text)
                while at < len(audit) and audit[at] == "I":
                    placed(conv_id, "I", None, None, None, "")
                    at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), fields)], schema=fields)

    return ordered.mapInArrow(edits, "conv_id long, step long, edit string, turn long, role string, text string")


def conversation_hashes(turns: DataFrame) -> DataFrame:
    """repaired() rows -> (conv_id, sha256): of a conversation's `role:text`, joined by line feeds; one pass over each partition as it is."""
    import hashlib

    def hashed(batches) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text"))))
        held = []
        for conv_id, own in groupby(each, lambda r: r[0]):
            h = hashlib.sha256()
            for k, (_, role, text) in enumerate(own):
                h.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            held.append((conv_id, h.hexdigest()))
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held])], ["conv_id", "sha256"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held])], ["conv_id", "sha256"])

    return turns.mapInArrow(hashed, "conv_id long, sha256 string")
