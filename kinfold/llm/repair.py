"""Conversation structure repair: a generalised LR parse that may edit what it reads.

The roles of a conversation should follow a grammar: perhaps a system turn, then
user and assistant in turn.  The LR automaton of that grammar is driven over a
conversation's turns with weighted edits: keep a turn, rerole it, delete it, insert
one.  All parses advance together as a graph-structured stack, whose nodes share
what lies below them; stacks with an equal top have the same future, so of those the
one with the smallest (cost, audit) stays.  The audit is the string of the edits'
initials, and the cheapest one says how to rebuild the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinfold.plans.staging import stage

WHITE = " \t\n\x0b\f\r"
#: The role grammar: left side and right side of each rule, the start first.
RULES = (("C", ""), ("C", "B"), ("C", "sB"), ("B", "T"), ("B", "BT"), ("T", "ua"))
END = "$"
TOKENS = {"s", "u", "a"}
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What a truncated turn costs that is not deleted.
TRUNCATED = 3
NAMES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
#: A stack this much dearer than the cheapest is in no cheapest repair: with two
#: insertions and by deleting a leading system turn that one does whatever it can.
FAR = 2 * INSERT + DELETE


# --- the automaton --------------------------------------------------------------------


def _closure(items: frozenset) -> frozenset:
    found, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        want = RULES[rule][1][dot : dot + 1]
        for k, (left, _) in enumerate(RULES):
            if left == want and (k, 0) not in found:
                found.add((k, 0))
                todo.append((k, 0))
    return frozenset(found)


def _follow() -> dict[str, set[str]]:
    """The terminals that may stand after each left side (no rule but the start's is empty)."""
    lefts = {x for x, _ in RULES}
    first = lambda x: {x} if x not in lefts else {t for l, r in RULES if l == x and r and r[0] != x for t in first(r[0])}  # noqa: E731, E741
    after: dict[str, set[str]] = {x: set() for x in lefts}
    after[RULES[0][0]].add(END)
    for _ in RULES:  # as often as a chain of rules is long
        for left, right in RULES:
            for k, x in enumerate(right):
                if x in lefts:
                    after[x] |= first(right[k + 1]) if k + 1 < len(right) else after[left]
    return after


@lru_cache(1)
def automaton() -> tuple[list[dict[str, int]], list[dict[str, int]]]:
    """(shifts and gotos, reductions) of every state: symbol to state, and lookahead to rule."""
    start = _closure(frozenset((k, 0) for k, (left, _) in enumerate(RULES) if left == RULES[0][0]))
    states, moves, follow = [start], [], _follow()
    for state in states:
        out = {}
        for x in sorted({RULES[r][1][d] for r, d in state if d < len(RULES[r][1])}):
            to = _closure(frozenset((r, d + 1) for r, d in state if RULES[r][1][d : d + 1] == x))
            if to not in states:
                states.append(to)
            out[x] = states.index(to)
        moves.append(out)
    reductions = [
        {t: r for r, d in state if d == len(RULES[r][1]) for t in follow[RULES[r][0]]} for state in states
    ]
    return moves, reductions


# --- the graph-structured stack ----------------------------------------------------------

#: A stack is (state, the stack below); equal stacks are one object, so nodes are shared.
Stack = tuple


@lru_cache(None)  # an LR stack of this grammar is at most four states deep
def advance(stack: Stack, token: str) -> Stack | None:
    """The stack after reductions and the shift of ``token``; at the END, any stack that accepts; None if it can't be."""
    moves, reductions = automaton()
    while True:
        if token in moves[stack[0]] and token != END:
            return (moves[stack[0]][token], stack)
        rule = reductions[stack[0]].get(token)
        if rule is None:
            return None
        left, right = RULES[rule]
        for _ in right:
            stack = stack[1]
        if left == RULES[0][0]:
            return stack
        stack = (moves[stack[0]][left], stack)


START: Stack = (0, None)

#: The stack tops of one moment in order of their audits: (stack, cost above the cheapest).
Tops = tuple


def _merge(found: dict, stack: Stack, entry: tuple) -> bool:
    """Of equal tops the smallest (cost, parent, letters) stays."""
    if stack[0] in found and found[stack[0]][1] <= entry:
        return False
    found[stack[0]] = (stack, entry)
    return True


def _inserted(tops: Tops) -> dict:
    """State to (stack, (cost, parent, letters)): the tops and what insertions lead to."""
    found: dict = {}
    todo = []
    for k, (stack, cost) in enumerate(tops):
        if _merge(found, stack, (cost, k, "")):
            todo.append(stack)
    while todo:
        stack, (cost, k, letters) = found[todo.pop(0)[0]]
        for role in NAMES:
            if (to := advance(stack, role)) and _merge(found, to, (cost + INSERT, k, letters + "I")):
                todo.append(to)
    return found


@lru_cache(1 << 16)
def step(tops: Tops, role: str, fault: str) -> tuple[Tops, tuple, int]:
    """(tops after a turn, (number of its parent, letters) of each, what the cheapest rose by).

    Audits of different tops at one moment have as many letters for turns and end in
    one, so none begins with another, and their order decides between their
    extensions before any letter does.
    """
    found: dict = {}
    for stack, (cost, k, letters) in _inserted(tops).values():
        _merge(found, stack, (cost + DELETE, k, letters + "D"))
        if fault in ("blank", "duplicate"):
            continue
        cost += TRUNCATED if fault == "truncated" else 0
        if role in TOKENS and (to := advance(stack, role)):
            _merge(found, to, (cost + KEEP, k, letters + "K"))
        for own in NAMES:
            if to := advance(stack, own):
                _merge(found, to, (cost + REROLE, k, letters + "R"))
    order = sorted(found.values(), key=lambda x: x[1][1:])
    least = min(e[0] for _, e in order)
    order = [x for x in order if x[1][0] <= least + FAR]
    return tuple((s, e[0] - least) for s, e in order), tuple(e[1:] for _, e in order), least


@lru_cache(1 << 12)
def finish(tops: Tops) -> tuple[int, int, str]:
    """(cost, parent, letters) of the smallest ending."""
    return min(e for s, e in _inserted(tops).values() if advance(s, END))


class Parse:
    """The parse of one conversation, fed turn by turn; of the past it keeps shared lists of letters alone."""

    def __init__(self) -> None:
        self.tops, self.past, self.cost = ((START, 0),), [None], 0

    def feed(self, role: str, fault: str) -> None:
        self.tops, made, rise = step(self.tops, role, fault)
        self.past = [(self.past[k], letters) for k, letters in made]
        self.cost += rise

    def result(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair, ties to the smallest audit in ASCII."""
        cost, k, last = finish(self.tops)
        letters, node = [last], self.past[k]
        while node:
            letters.append(node[1])
            node = node[0]
        return self.cost + cost, "".join(reversed(letters))


# --- over tables ------------------------------------------------------------------------------


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def faulty_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, times: Column) -> DataFrame:
    """(conv, turn, role, text, n, fault): equal rows are one with their number ``n``, the sum of ``times``.

    Null roles and texts are one space.  ``fault`` is the first that holds of the
    row's first copy: blank, duplicate, truncated, or empty; other copies repeat it.
    A turn is a duplicate if its role and text stand in an earlier turn.  Rows with
    ``n`` 0 are absent and only name their conversation.
    """
    rows = stage(
        turns.select(
            F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), _filled(F.col(role_col)).alias("role"),
            _filled(F.col(text_col)).alias("text"), times.cast("long").alias("n"),
        ).groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")),
        "turns",
    )
    # only what stands in several turns is looked up again; nulls of a struct come first, as they should
    said = F.md5("text").alias("said")
    repeated = (
        rows.where("n > 0").select("conv", "role", said, F.struct("turn").alias("at")).groupBy("conv", "role", "said")
        .agg(F.count("*").alias("uses"), F.min("at").alias("first")).where("uses > 1")
        .select(F.col("conv").alias("c2"), F.col("role").alias("r2"), F.col("said").alias("s2"), "first")
    )
    met = rows.withColumn("said", said).join(
        repeated, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("r2")) & (F.col("said") == F.col("s2")), "left"
    )
    bare = F.rtrim("text", F.lit(WHITE))
    fault = (
        F.when(F.length(bare) == 0, "blank")
        .when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    )
    return met.select("conv", "turn", "role", "text", "n", fault.alias("fault"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Conversation by conversation, each whole in one partition and sorted: a task streams them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv").sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "role", "text")


def _copies(fault: str, n: int) -> Iterator[str]:
    """The faults of n equal turns in a row: blank ones are blank each, of others all but the first are duplicates."""
    for k in range(n):
        yield fault if k == 0 or fault == "blank" else "duplicate"


#: What makes a number apart from every conversation's id.
_NONE = object()


def _by_conversation(batches: Iterator[pa.RecordBatch], open_: Callable, row: Callable, close: Callable) -> Iterator[list]:
    """Runs through sorted rows and yields what close() gives for every conversation, some thousand at a time."""
    now, state, out = _NONE, None, []
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns]):
            if r[0] != now or now is _NONE:
                if now is not _NONE:
                    out += close(now, state)
                now, state = r[0], open_()
            out += row(state, r) or ()
            if len(out) >= 2048:
                yield out
                out = []
    if now is not _NONE:
        out += close(now, state)
    if out:
        yield out


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {"su", "ua", "au"}


def repairs(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit): one row a conversation of faulty_turns().

    A conversation is read as a stream in order of turns, nulls first; turns of
    the same number go by role and text.  Nothing of it is kept but the stack tops and
    the letters of the audit.  One without a turn has zeros and an empty audit.
    """
    kind = rows.schema["conv"].dataType.simpleString()

    class State:
        def __init__(self) -> None:
            self.parse, self.counts, self.illegal, self.last = Parse(), dict.fromkeys(FAULTS, 0), 0, None
            self.low = self.high = None
            self.numbers = 0

    def feed(s: State, r: tuple) -> None:
        _, turn, role, n, fault = r
        if n and turn is not None and (s.high is None or turn != s.high):
            s.low, s.high, s.numbers = turn if s.low is None else s.low, turn, s.numbers + 1
        for f in _copies(fault, n):
            s.counts[f] += 1
            if s.last is not None and s.last + role[:1] not in LEGAL:
                s.illegal += 1
            s.last = role[:1]
            s.parse.feed(role[:1], f)

    def close(conv, s: State) -> list[tuple]:
        cost, audit = s.parse.result()
        gaps = s.high - s.low + 1 - s.numbers if s.numbers else 0
        return [(conv, gaps, *[s.counts[f] for f in FAULTS[1:]], s.illegal, cost, audit)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _by_conversation(batches, State, feed, close):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    ddl = f"conv {kind}, {SUMMARY}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return _in_order(rows).select("conv", "turn", "role", "n", "fault").mapInArrow(parse, ddl)


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, edit, turn, role, text): the turns of every repaired conversation, in order.

    Edits are K for a turn that was kept, R for one with another role and I for one that
    was inserted, with an empty text and no turn number.  The audit goes ahead of the
    conversation's rows in the sort and is replayed over them.  Partitions hold whole
    conversations and are in order of place.
    """
    none = lambda t: F.lit(None).cast(t)
    turn_type = rows.schema["turn"].dataType.simpleString()
    both = rows.where("n > 0").select("conv", F.lit(1).alias("part"), "turn", "role", "text", "n", none("string").alias("audit")).unionByName(
        found.select("conv", F.lit(0).alias("part"), none(turn_type).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    )
    kind = rows.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, place long, edit string, turn {turn_type}, role string, text string"

    class State:
        def __init__(self) -> None:
            self.audit, self.at, self.place, self.odd = "", 0, 0, True

    def put(s: State, conv, edit: str, turn, role: str, text: str) -> tuple:
        if edit != "K":
            role = NAMES["u" if s.odd else "a"]
        s.odd = role[:1] != "u"
        s.place += 1
        return (conv, s.place - 1, edit, turn, role, text)

    def inserts(s: State, conv) -> list[tuple]:
        out = []
        while s.audit[s.at : s.at + 1] == "I":
            s.at += 1
            out.append(put(s, conv, "I", None, "", ""))
        return out

    def feed(s: State, r: tuple) -> list[tuple]:
        conv, part, turn, role, text, n, audit = r
        if part == 0:
            s.audit = audit
            return []
        out = []
        for _ in range(n):
            out += inserts(s, conv)
            edit = s.audit[s.at]
            s.at += 1
            if edit != "D":
                out.append(put(s, conv, edit, turn, role, text))
        return out

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _by_conversation(batches, State, feed, lambda conv, s: inserts(s, conv)):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return _in_order(both, "part").select("conv", "part", "turn", "role", "text", "n", "audit").mapInArrow(replay, ddl)


def turn_digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of ``role:text`` joined by newlines, straight from repaired_turns(): a running hash, no text is gathered."""
    kind = repaired.schema["conv"].dataType.simpleString()

    def feed(s: list, r: tuple) -> None:
        s[0].update(("\n" if s[1] else "").encode() + f"{r[1]}:{r[2]}".encode())
        s[1] = True

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _by_conversation(batches, lambda: [hashlib.sha256(), False], feed, lambda conv, s: [(conv, s[0].hexdigest())]):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    ddl = f"conv {kind}, sha256 string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return repaired.select("conv", "role", "text").mapInArrow(digest, ddl)


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(repairs(), repaired_turns()) of a table of turns.

    ``times`` says how often a row stands there, once by default; a conversation
    whose rows all stand there 0 times is reported as empty.

    Defined cases: a null conversation is one of its own; null roles and texts are one
    space, which makes a text blank and a role one that can't be kept; a null turn comes
    first and counts for no gap; rows of the same turn go by role and text; rows that
    repeat are duplicates; an empty table gives empty tables.  Extra columns stay out.

    A conversation is never gathered: it passes through one task as a sorted stream, as
    its audit and its text's digest are sequences, with memory for the audit's letters
    alone.  Copies are counted before the shuffle, and duplicates are found by a join on
    digests that Spark can split.
    """
    rows = stage(faulty_turns(turns, conv_col, turn_col, role_col, text_col, F.lit(1) if times is None else times), "faults")
    found = stage(repairs(rows), "repairs")
    return found, repaired_turns(rows, found)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """(turns with planted faults, how often each stands there), by crc32 of 'conv_id:turn' modulo 20.

    0 drops a turn, 1 empties its text, 2 takes its . ! ? away, 3 repeats it and 4 makes
    its role user; nulls are one space.
    """
    case = F.crc32(F.concat_ws(":", _filled(F.col("conv_id")), _filled(F.col("turn")))) % 20
    text = F.when(F.col("__case") == 1, "").when(F.col("__case") == 2, F.translate(_filled(F.col("text")), ".!?", "")).otherwise(_filled(F.col("text")))
    role = F.when(F.col("__case") == 4, "user").otherwise(_filled(F.col("role")))
    out = turns.select("conv_id", "turn", "role", "text", case.alias("__case")).select("conv_id", "turn", role.alias("role"), text.alias("text"), "__case")
    return out, F.when(F.col("__case") == 0, 0).when(F.col("__case") == 3, 2).otherwise(1)
