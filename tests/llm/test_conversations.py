"""Conversation repair against brute force: Dijkstra against enumerated edits, the whole job against a loop over rows."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import conversations

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(symbols: str) -> tuple[int, str]:
    """Every node's least pair of cost and audit, layer by layer: another order than a heap's."""
    layer = {0: (0, "")}

    def inserted(layer):
        for _ in range(4):
            for s, (c, a) in list(layer.items()):
                t, new = (2 if s == 2 else 1), (c + 5, a + "I")
                t = {0: "u", 1: "u", 2: "a", 3: "u"}[s]
                t = {"u": 2, "a": 3}[t]
                if t not in layer or new < layer[t]:
                    layer[t] = new
        return layer

    for x in symbols:
        after: dict = {}
        for s, (c, a) in inserted(layer).items():
            ways = [(s, 2, "D")]
            if x != "x":
                more = 5 if x.isupper() else 0
                role = x.lower()
                if role == "s" and s == 0:
                    ways.append((1, more, "K"))
                if role == "u" and s != 2:
                    ways.append((2, more, "K"))
                if role == "a" and s == 2:
                    ways.append((3, more, "K"))
                ways.append((3 if s == 2 else 2, 1 + more, "R"))
            for t, w, letter in ways:
                new = (c + w, a + letter)
                if t not in after or new < after[t]:
                    after[t] = new
        layer = after
    layer = inserted(layer)
    return min(layer[s] for s in (0, 3) if s in layer)


def enumerated(symbols: str, most: int) -> tuple[int, str]:
    """All audits up to a length, tried one by one."""
    best = (10**9, "")
    for n in range(most + 1):
        for audit in itertools.product("DIKR", repeat=n):
            row, said, cost = 0, "", 0
            for x in audit:
                if x == "I":
                    said += "a" if said[-1:] == "u" else "u"
                    cost += 5
                    continue
                if row == len(symbols) or (x != "D" and symbols[row] == "x"):
                    break
                c = symbols[row]
                row += 1
                if x == "D":
                    cost += 2
                    continue
                cost += (5 if c.isupper() else 0) + (x == "R")
                said += c.lower() if x == "K" else "a" if said[-1:] == "u" else "u"
            else:
                pairs = said[1:] if said[:1] == "s" else said
                if row == len(symbols) and (not said or (pairs and pairs == "ua" * (len(pairs) // 2))):
                    best = min(best, (cost, "".join(audit)))
    return best


def test_search_against_enumeration():
    for n in range(4):
        for symbols in map("".join, itertools.product("suaoUAx", repeat=n)):
            assert conversations.whole(symbols) == enumerated(symbols, n + 2) == cheapest(symbols), symbols


def test_search_against_layers():
    rng = random.Random(3)
    for _ in range(4000):
        symbols = "".join(rng.choice("suauauaoSUAUAOx") for _ in range(rng.randrange(40)))
        assert conversations.whole(symbols) == cheapest(symbols), symbols
    assert conversations.whole("ua" * 1500)[1] == "K" * 3000


def expected(rows: list[tuple]) -> dict:
    """Each conversation by a loop over its rows; ``rows`` are conv_id, turn, role, text."""
    spell = lambda x: " " if x is None else str(x)
    by: dict = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        fault = zlib.crc32(f"{spell(conv)}:{spell(turn)}".encode()) % 20
        role, text = spell(role), spell(text)
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        counts, symbols, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
        for _, role, text in own:
            bare = text.rstrip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            c = role[0] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[0] for r in own if r[0] is not None}
        cost, audit = cheapest(symbols)
        left, rest = [], iter(own)
        for x in audit:
            u = "assistant" if left and left[-1][:1] == "u" else "user"
            if x == "I":
                left.append(u + ":")
                continue
            _, role, text = next(rest)
            left += [] if x == "D" else [f"{role if x == 'K' else u}:{text}"]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def sample(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No", "what? ", "", " \t", "Hello there!", "a.b", "x\n", "ünï.", None, "L" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]
    rows = [(c, rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randrange(12))]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 300}.") for t in range(900)]  # much larger than the rest
    return rows + rows[:5]


@pytest.mark.parametrize("most_rows", [3, 1024])
def test_whole_job(spark, most_rows):
    rows = sample(most_rows)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(5)
    got = conversations.repair(conversations.damage(table), most_rows=most_rows)
    found = {r[0]: tuple(r[1:]) for r in got.collect()}
    want = expected(rows)
    assert found.keys() == want.keys() and got.count() == len(want)
    for conv in want:
        assert found[conv] == want[conv], conv
    turns = conversations.repaired_turns(conversations.damage(table), most_rows=most_rows)
    said = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "place", F.concat("role", F.lit(":"), "text").alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    assert {r.conv_id: hashlib.sha256(r.t.encode()).hexdigest() for r in said.collect()} == {c: w[-1] for c, w in want.items() if w[-1] != hashlib.sha256(b"").hexdigest()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(empty)).collect() == []
