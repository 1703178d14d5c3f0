"""Conversation repair against an exhaustive search of edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kinfold.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\f\r"
KINDS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired turns): the cheapest edits, by search over whole audits."""
    bad = faults(rows)
    todo, best = [(0, "", 0, ())], None
    while todo:
        cost, audit, k, out = heapq.heappop(todo)
        if best and cost > best[0]:
            break
        roles = "".join(r[:1] for r, _ in out)
        if k == len(rows) and GRAMMAR.fullmatch(roles) and all(len(r) > 0 for r, _ in out):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        if len(out) < 2 * len(rows) + 2:
            for name in ("user", "assistant"):
                heapq.heappush(todo, (cost + 3, audit + "I", k, (*out, (name, ""))))
        if k == len(rows):
            continue
        _, role, text = rows[k]
        heapq.heappush(todo, (cost + 4, audit + "D", k + 1, out))
        if bad[k] in ("blank", "duplicate"):
            continue
        more = 3 if bad[k] == "truncated" else 0
        if role[:1] in ("s", "u", "a"):
            heapq.heappush(todo, (cost + more, audit + "K", k + 1, (*out, (role, text))))
        for name in ("user", "assistant"):
            heapq.heappush(todo, (cost + 3 + more, audit + "R", k + 1, (*out, (name, text))))
    return best


def dealt(rows):
    """Rows of one conversation, with nulls as one space, in order."""
    fill = lambda v: " " if v is None else v
    own = [(t, fill(r), fill(x)) for t, r, x in rows]
    return sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def expected(rows):
    own = dealt(rows)
    if not own:
        return (0, 0, 0, 0, 0, 0, "", EMPTY)
    f = faults(own)
    numbers = {t for t, _, _ in own if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    cost, audit, out = brute(own)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *[f.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)


def conversations(seed, n, longest=6):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "Tutor", "$", "unit"]
    texts = ["Yes.", "No", "why?", "", " \t", None, "Fine!\n", "Étude. ", "a.b", " "]
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, longest + 1)):
            turn = None if rng.random() < 0.05 else t if rng.random() < 0.8 else rng.randrange(9)
            out.append((c if c else None, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(99)}."))
    return out


def collect(df, key="conv"):
    return {r[key]: tuple(r[1:]) for r in df.collect()}


def test_against_all_edits(spark):
    rows = conversations(1, 150)
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    odd = df.withColumns({c: F.lit("x") for c in ("conv", "n", "said", "fault", "audit", "part", "first", "at", "c2", "__case")})
    for table in (df, odd):
        found, turns = repair.repair_conversations(table)
        got, digests = collect(found), collect(repair.turn_digests(turns))
        assert len(got) == 150
        for conv in got:
            want = expected([r[1:] for r in rows if r[0] == conv])
            assert (*got[conv], digests.get(conv, (EMPTY,))[0]) == want, (conv, [r for r in rows if r[0] == conv])


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "No end"), (1, 2, "user", "Fine."), (2, 5, "system", "Be."), (2, 7, "user", "What?")]
    found, turns = repair.repair_conversations(spark.createDataFrame(rows, KINDS))
    got = collect(found)
    assert got[1][0] == 0 and got[2][0] == 1 and got[2][-1] == "KKI"
    told = [tuple(r) for r in turns.orderBy("conv", "place").collect()]
    assert [r for r in told if r[0] == 2] == [(2, 0, "K", 5, "system", "Be."), (2, 1, "K", 7, "user", "What?"), (2, 2, "I", None, "assistant", "")]
    for conv in (1, 2):
        assert GRAMMAR.fullmatch("".join(r[4][:1] for r in told if r[0] == conv))


def test_equal_turns_and_long_conversations(spark):
    """A turn that stands there thousands of times, and a conversation of many turns, in linear time."""
    rows = [(1, 0, "user", "Again.")] * 4000 + [(2, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(20000)]
    found, turns = repair.repair_conversations(spark.createDataFrame(rows, KINDS))
    got = collect(found)
    assert got[1][2] == 3999 and got[1][5] == 4 * 3999 + 3 and got[1][6] == "K" + "D" * 3999 + "I"
    assert got[2] == (0, 0, 0, 0, 0, 0, "K" * 20000)
    assert turns.where("conv = 2").count() == 20000


def test_the_automaton():
    moves, _ = repair.automaton()
    assert len(moves) == 8
    for text in ("", "s", "su", "sua", "ua", "uaua", "u", "a", "us", "suaua", "sus", "uau"):
        stack = repair.START
        for x in text:
            stack = stack and repair.advance(stack, x)
        assert bool(stack and repair.advance(stack, repair.END)) == bool(GRAMMAR.fullmatch(text))


def test_query(spark, tmp_path):
    rows = conversations(2, 120, 7)
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = collect(queries.op13_repair_conversations(spark, str(tmp_path)), "conv_id")
    by = {}
    for c, t, role, text in rows:
        own = by.setdefault(c, [])
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own += [(t, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    assert got == {c: expected(own) for c, own in by.items()}
    assert any(not own for own in by.values())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(5, None, "user", None)]])
def test_empty_and_nulls(spark, rows):
    found, turns = repair.repair_conversations(spark.createDataFrame(rows, KINDS))
    assert found.count() == len(rows) and turns.count() == 0
    assert all(r["audit"] == "D" and r["blank"] == 1 for r in found.collect())
