"""Conversation structure repair: cheapest edits by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a number of rows read and a state of the wanted order of roles (an
optional system row, then pairs of user and assistant). Keeping, reroling or deleting a row
leads to the next row, inserting one stays there. A heap runs forward from the start and one
backward from the end; they stop when no crossing of equal cost is left, and among all
crossings the least concatenated audit wins.

Rows are dealt out by ranges of conversation and turn, so one of any size is spread over
tasks; it is cut into blocks of bounded size. A block that is a whole conversation is solved
at once. Of others, every pair of states at the ends is solved, and the cheapest way through
a conversation's blocks is put together from those costs; inserted rows stand before a row
of a block, or after the last block, so that audits of equal cost are never the beginning of
each other, and the least of each block makes the least of the whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sized, written

BLANKS = " \t\n\x0b\x0c\r"
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 22
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state to which a user or assistant row leads, and that row's role.
STEP = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
KINDS, LEGAL = ("s", "u", "a"), ("su", "ua", "au")
PAIRS = [(s, t) for s in range(4) for t in range(4)]
#: What ends a conversation in each state: cost and audit.
CLOSING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def row_edges(symbol: str) -> list[tuple[int, int, int, str]]:
    """State before, state after, cost and letter of every edit of a row.

    Its symbol is the initial of its role (o for others), a capital if it is truncated, x if it has to go.
    """
    edges = [(s, s, DELETE, "D") for s in range(4)]
    if symbol != "x":
        more = CUT_OFF if symbol.isupper() else 0
        edges += [(s, t, more, "K") for (s, initial), t in KEPT.items() if initial == symbol.lower()]
        edges += [(s, t, REROLE + more, "R") for s, t in STEP.items()]
    return edges


FORWARD = {c: [[(t, w, x) for s, t, w, x in row_edges(c) if s == own] for own in range(4)] for c in "suaoSUAOx"}
BACKWARD = {c: [[(s, w, x) for s, t, w, x in row_edges(c) if t == own] for own in range(4)] for c in "suaoSUAOx"}
BEFORE = [[s for s, t in STEP.items() if t == own] for own in range(4)]


def shortest(symbols: str, start: int, ends: tuple[int, ...], insert_last: bool = True) -> tuple[int, str] | None:
    """Least cost and least audit of that cost from ``start`` to one of ``ends``; None if there is no way. ``insert_last`` allows inserted rows after the last row."""
    n = len(symbols)
    seen: list[dict] = [{(0, start): (0, "")}, {(n, t): (0, "") for t in ends}]  # node: cost, least audit so far
    heaps = [[(0, 0, start)], [(0, -n, t) for t in ends]]
    done: list[set] = [set(), set()]
    best = min((0 for node in seen[0] if node in seen[1]), default=inf)
    # Among equal costs nodes come in the order of rows, so all ways to a node are known when it is settled.
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, i, state = heappop(heaps[side])
        i = abs(i)
        if (i, state) in done[side]:
            continue
        done[side].add((i, state))
        audit = seen[side][i, state][1]
        if side == 0:
            edges = [(i + 1, t, w, audit + x) for t, w, x in FORWARD[symbols[i]][state]] if i < n else []
            if i < n or insert_last:
                edges.append((i, STEP[state], INSERT, audit + "I"))
        else:
            edges = [(i - 1, s, w, x + audit) for s, w, x in BACKWARD[symbols[i - 1]][state]] if i else []
            if i < n or insert_last:
                edges += [(i, s, INSERT, "I" + audit) for s in BEFORE[state]]
        for j, s, w, a in edges:
            new = (cost + w, a)
            old = seen[side].get((j, s))
            if old is None or new < old:
                if old is None or new[0] < old[0]:
                    heappush(heaps[side], (new[0], j if side == 0 else -j, s))
                seen[side][j, s] = new
                if other := seen[1 - side].get((j, s)):
                    best = min(best, new[0] + other[0])
    if best == inf:
        return None
    audits = [a + seen[1][node][1] for node, (cost, a) in seen[0].items() if node in seen[1] and cost + seen[1][node][0] == best]
    return best, min(audits)


@lru_cache(maxsize=20_000)
def whole(symbols: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return shortest(symbols, START, (START, ASSISTANT))


@lru_cache(maxsize=500)
def between(symbols: str) -> list:
    """Of a block inside a conversation: cost and audit from each state to each state, state by state."""
    return [shortest(symbols, s, (t,), insert_last=False) for s, t in PAIRS]


def replay(audit: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], list[str]]:
    """Roles and texts that the edits of an audit leave."""
    to_roles, to_texts = [], []
    row = 0
    for x in audit:
        if x == "I":
            state = STEP[state]
            to_roles.append(ROLE[state])
            to_texts.append("")
            continue
        role, text = roles[row], texts[row]
        row += 1
        if x == "K":
            state = KEPT[state, role[:1]]
        elif x == "R":
            state = STEP[state]
            role = ROLE[state]
        else:
            continue
        to_roles.append(role)
        to_texts.append(text)
    return to_roles, to_texts


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, absent``: the rows of a conversation table with faults put in by a hash of conversation and turn.

    One row in twenty each is dropped (``absent``, its text and role null), emptied, freed of
    ``.!?``, repeated, or said to be the user's. Nulls count as one blank.
    """
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).when(F.col("fault") != 0, text)
    return (
        rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))
        .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").when(F.col("fault") != 0, role).alias("role"), hurt.alias("text"), (F.col("fault") == 0).alias("absent"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
        .drop("copy")
    )


STATS = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]
_BLOCK = "part int, seq int, whole boolean, symbols string, roles array<string>, texts array<string>, first string, last string, " + ", ".join(f"{k} long" for k in STATS)


def _judged(rows: DataFrame) -> DataFrame:
    """The rows in order, dealt out by ranges: ``conv, turn, role, text, fault``."""
    there = ~F.coalesce("absent", F.lit(False)) if "absent" in rows.columns else F.lit(True)
    trimmed = F.rtrim("text", F.lit(BLANKS))
    # Numbered and written: equal rows are told apart, and stay so when a task runs again.
    own = written(
        rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(there, F.coalesce("role", F.lit(" "))).alias("role"), F.when(there, F.coalesce("text", F.lit(" "))).alias("text"))
        .withColumns({"blank": trimmed == "", "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "sha": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "id": F.monotonically_increasing_id()}),
        "turns",
    )
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("id").alias("c"))
    again = written(own.filter("not blank").groupBy("conv", "role", "sha").agg(F.count("*").alias("n"), F.min(order)["c"].alias("first")).filter("n > 1").drop("n"), "turns-again")
    key = own["conv"].eqNullSafe(again["conv"]) & (own["role"] == again["role"]) & (own["sha"] == again["sha"]) & ~own["blank"]
    fault = F.when(own["role"].isNull(), "absent").when(own["blank"], "blank").when(again["first"] != own["id"], "duplicate").when(own["cut"], "truncated")
    marked = own.join(again, key, "left").select(own["conv"], "turn", own["role"], "text", fault.alias("fault"), own["sha"], "id")
    by = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "sha", "id")]
    return marked.repartitionByRange(*by).sortWithinPartitions(*by).select("conv", "turn", "role", "text", "fault", F.spark_partition_id().alias("part"))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _blocks(judged: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """One row for each block: its symbols, counts, roles and texts; ``whole`` if it surely is all of its conversation."""

    def run(batches):
        conv = block = schema = None
        seq, opened, out, held = 0, False, [], 0

        def done(closed: bool):
            block["symbols"] = "".join(block["symbols"])
            out.append(block | {"conv": conv, "seq": seq, "whole": closed and opened})

        for b in sized(batches, 3):
            schema = pa.schema([("conv", b.schema.field(0).type), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("symbols", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), *((k, pa.int64()) for k in STATS)])
            for of, turn, role, text, fault, part in zip(*(b.column(i).to_pylist() for i in range(6))):
                if block is None or of != conv or len(block["symbols"]) >= most_rows or block["chars"] >= most_chars:
                    if block is not None:
                        done(of != conv)
                        seq += 1
                        held += block["chars"] + 200
                        if held > most_chars:
                            yield _batch(out, schema)
                            out, held = [], 0
                    opened = block is not None and of != conv  # what stood before it in this task was another one
                    conv, block = of, {"part": part, "symbols": [], "roles": [], "texts": [], "first": None, "last": None, "chars": 0, "low": None, "high": None} | dict.fromkeys(STATS[:5], 0)
                if fault == "absent":
                    continue
                if turn is not None:
                    block["turns"] += turn != block["high"]
                    block["high"] = turn
                    block["low"] = turn if block["low"] is None else block["low"]
                initial = role[:1]
                if block["last"] is None:
                    block["first"] = initial
                else:
                    block["illegal"] += block["last"] + initial not in LEGAL
                block["last"] = initial
                if fault:
                    block[fault] += 1
                goes = fault in ("blank", "duplicate")
                letter = initial if initial in KINDS else "o"
                block["symbols"].append("x" if goes else letter.upper() if fault else letter)
                block["roles"].append(role)
                block["texts"].append("" if goes else text)
                block["chars"] += len(text)
        if block is not None:
            done(False)
            yield _batch(out, schema)

    return judged.mapInArrow(run, f"conv {_kind(judged)}, {_BLOCK}")


def _kind(blocks: DataFrame) -> str:
    return blocks.schema["conv"].dataType.simpleString()


def _solved(blocks: DataFrame) -> DataFrame:
    """Blocks that are whole conversations, with ``from_state, audit, edit_cost``."""
    at = blocks.columns.index("symbols")

    def solve(batches):
        for b in batches:
            found = [whole(s) for s in b.column(at).to_pylist()]
            more = [pa.array([START] * b.num_rows, pa.int32()), pa.array([x for _, x in found], pa.string()), pa.array([c for c, _ in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "from_state", "audit", "edit_cost"])

    return blocks.mapInArrow(solve, f"conv {_kind(blocks)}, {_BLOCK}, from_state int, audit string, edit_cost long")


def _put_together(blocks: DataFrame) -> DataFrame:
    """Other blocks, with their part of the cheapest edits of their conversation: ``from_state, audit, edit_cost``."""

    def solve(batches):
        for b in batches:
            for own in (b.slice(at, 50) for at in range(0, b.num_rows, 50)):
                found = [between(s) for s in own.column(3).to_pylist()]
                costs = [[x[0] if x else -1 for x in f] for f in found]
                ranks = [[sorted({y[1] for y in f if y}).index(x[1]) if x else -1 for x in f] for f in found]
                audits = [[x[1] if x else None for x in f] for f in found]
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))], names=["conv", "part", "seq", "costs", "ranks", "audits"])

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "seq"])
        every = [[(s, t, c, r) for (s, t), c, r in zip(PAIRS, costs, ranks) if c >= 0] for costs, ranks in zip(group["costs"], group["ranks"])]
        rest, after = [CLOSING[s][0] for s in range(4)], []
        for ways in reversed(every):
            after.append(rest)
            rest = [min((c + rest[t] for s, t, c, _ in ways if s == own), default=inf) for own in range(4)]
        state, picks = START, []
        for ways, rest in zip(every, reversed(after)):
            _, _, t, cost = min((c + rest[t], r, t, c) for s, t, c, r in ways if s == state)
            picks.append([4 * state + t, state, cost, ""])
            state = t
        picks[-1][2] += CLOSING[state][0]
        picks[-1][3] = CLOSING[state][1]
        return pd.DataFrame(picks, columns=["pair", "from_state", "edit_cost", "closing"]).assign(part=group["part"].to_numpy(), seq=group["seq"].to_numpy())[["part", "seq", "pair", "from_state", "edit_cost", "closing"]]

    pairs = written(blocks.select("conv", "part", "seq", "symbols").mapInArrow(solve, f"conv {_kind(blocks)}, part int, seq int, costs array<long>, ranks array<int>, audits array<string>"), "turns-pairs")
    # A thousandth of the rows: costs and ranks of blocks, without audits or texts.
    picks = pairs.groupBy("conv").applyInPandas(chosen, "part int, seq int, pair int, from_state int, edit_cost long, closing string")
    ways = pairs.join(picks, ["part", "seq"]).select("part", "seq", "from_state", F.concat(F.expr("audits[pair]"), "closing").alias("audit"), "edit_cost")
    return blocks.join(ways, ["part", "seq"])


def repaired_blocks(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """Blocks that are whole conversations, and those of other conversations, in the order of ``part, seq``: with counts, ``from_state``, ``audit`` and ``edit_cost``, and the roles and texts before the edits."""
    ship(rows.sparkSession)
    blocks = written(_blocks(_judged(rows), most_rows, most_chars), "turns-blocks")
    columns = [*blocks.columns, "from_state", "audit", "edit_cost"]
    return _solved(blocks.filter("whole")), _put_together(blocks.filter("not whole")).select(columns)


def repaired_turns(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """``conv_id, part, seq, place, role, text``: the rows that the cheapest edits leave, in the order of ``part, seq, place``; rows as for ``repair``."""

    def run(batches):
        for b in batches:
            schema = pa.schema([("conv_id", b.schema.field(0).type), ("part", pa.int32()), ("seq", pa.int32()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string())])
            for own in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                left = zip(*replay(own["audit"], own["roles"], own["texts"], own["from_state"]))
                yield _batch([{"conv_id": own["conv"], "part": own["part"], "seq": own["seq"], "place": at, "role": r, "text": t} for at, (r, t) in enumerate(left)], schema)

    alone, others = repaired_blocks(rows, most_rows, most_chars)
    names = ["conv", "part", "seq", "from_state", "audit", "roles", "texts"]
    ddl = f"conv_id {_kind(alone)}, part int, seq int, place int, role string, text string"
    return alone.select(names).unionByName(others.select(names)).mapInArrow(run, ddl)


def repair(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` has ``conv_id, turn, role, text`` and perhaps ``absent``: such a row only names
    its conversation. Rows stand by turn, nulls first; those of one turn by role and by a hash
    of the text, so that the result does not hang on how the table is stored. A null role or
    text is one blank, null conversations are one of their own, equal rows count as repeats,
    very long texts are taken whole; an empty table gives an empty one, other columns are not
    read. The rows of a conversation are spread over tasks; its hash alone, which needs all
    its text in order, is made in one, block by block.
    """
    kept = ["conv", "audit", "edit_cost", "first", "last", *STATS]

    def chunks(batches):
        for b in batches:
            own = b.slice(0, 0)
            for own in (b.slice(k, 1) for k in range(b.num_rows)):
                r = own.to_pylist()[0]
                left = replay(r["audit"], r["roles"], r["texts"], r["from_state"])
                chunk = "\n".join([f"{role}:{text}" for role, text in zip(*left)]) if left[0] else None
                yield pa.RecordBatch.from_arrays([own.column(n) for n in ("part", "seq", *kept)] + [pa.array([chunk], pa.string())], names=["part", "seq", *kept, "chunk"])

    def fold(batches):
        c = schema = None
        for b in sized(batches, len(kept) + 2):
            schema = pa.schema([("conv_id", b.schema.field(2).type), *((k, pa.int64()) for k in ("gaps", *STATS[:4], "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for r in b.to_pylist():
                if c is None or r["conv"] != c["conv_id"]:
                    if c:
                        out.append(_finished(c))
                    c = {"conv_id": r["conv"], "cost": 0, "parts": [], "hash": hashlib.sha256(), "lines": 0, "last": None, "low": None, "high": None} | dict.fromkeys(STATS[:5], 0)
                for k in STATS[:5]:
                    c[k] += r[k]
                c["cost"] += r["edit_cost"]
                c["parts"].append(r["audit"])
                if r["first"] is not None:
                    c["illegal"] += c["last"] is not None and c["last"] + r["first"] not in LEGAL
                    c["last"] = r["last"]
                if r["low"] is not None:
                    c["turns"] -= r["low"] == c["high"]
                    c["low"] = r["low"] if c["low"] is None else c["low"]
                    c["high"] = r["high"]
                if r["chunk"] is not None:
                    c["hash"].update(("\n" * (c["lines"] > 0) + r["chunk"]).encode("utf-8", "surrogatepass"))
                    c["lines"] += 1
            yield _batch(out, schema)
        if c:
            yield _batch([_finished(c)], schema)

    alone, others = repaired_blocks(rows, most_rows, most_chars)
    long = lambda names: ", ".join(f"{n} long" for n in names)
    wide = f"part int, seq int, conv {_kind(alone)}, audit string, edit_cost long, first string, last string, {long(STATS)}, chunk string"
    ready = [x.mapInArrow(chunks, wide) for x in (alone, others)]
    ready[1] = ready[1].repartition("conv").sortWithinPartitions("conv", "part", "seq")
    result = f"conv_id {_kind(alone)}, gaps long, {long(STATS[:4])}, cost long, audit string, repaired_sha256 string"
    return ready[0].mapInArrow(fold, result).unionByName(ready[1].mapInArrow(fold, result))


def _finished(c: dict) -> dict:
    gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]
    return c | {"gaps": gaps, "audit": "".join(c["parts"]), "repaired_sha256": c["hash"].hexdigest()}
