"""Conversation repair against an exhaustive search written from the rules, over the whole small table and odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reeltable.llm import conversations as C
from tests.compare import DATA

NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]], dict]:
    """(cost, audit, repaired rows, counts) of (role, text) rows in order."""
    faults = []
    for i, (role, text) in enumerate(rows):
        said = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in rows[:i] else "truncated" if said[-1] not in ".!?" else "")
    counts = {k: faults.count(k) for k in ("blank", "duplicate", "truncated")}
    counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, seen, n = [(0, "", 0, "", ())], set(), len(rows)
    while True:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(out), counts
        last = roles[-1:]
        if not re.match("(s|s?(ua)*u?)$", roles) or (i, last) in seen:
            continue  # of two audits that cost as much up to a node neither begins the other, so the less stays the less
        seen.add((i, last))
        put = lambda c, initial, rows_done, role=None, text="": heapq.heappush(heap, (cost + c, audit + initial, i + rows_done, roles + role[:1] if role is not None else roles, (*out, (role, text)) if role is not None else out))  # noqa: E731, B023
        for role in ("user", "assistant"):
            put(3, "I", 0, role)
        if i < n:
            put(4, "D", 1)
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if rows[i][0]:
                    put(extra, "K", 1, rows[i][0], rows[i][1])
                for role in ("user", "assistant"):
                    put(3 + extra, "R", 1, role, rows[i][1])


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(original: list[tuple], rows: list[tuple]) -> list[tuple]:
    found = []
    for conv in {r[0] for r in original}:
        own = sorted((r[1] is not None, r[1] or 0, r[2], r[3]) for r in rows if r[0] == conv)
        cost, audit, out, counts = cheapest([(r[2], r[3]) for r in own])
        turns = [r[1] for r in own if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        found.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, sha))
    return sorted(found, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ODD = [
    (1, None, "user", "Hello there."), (1, 0, "assistant", "Hi."), (1, 0, "assistant", "Hi."), (1, 7, "tool", "x!"), (1, 3, None, None), (1, 4, "", "Why?"), (None, 1, "user", "Alone."), (None, 1, "assistant", "Not."),
    (2, 0, "system", "S."), (2, 1, "system", "S."), (2, 2, "assistant", "A. \n\t"), (2, 3, "assistant", "no end"), (2, 4, "user", " "), (3, 9, "system", "only."), (4, None, None, None), (5, 2, "user", "a?" * 50_000), (5, 5, "usher", "U."), (6, -4, "assistant", "A."), (6, 4, "user", "U\n."),
]


def test_query_equals_search(spark):
    original = [tuple(r.values()) for r in pq.read_table(f"{DATA}/conversations.parquet").to_pylist()]
    found = C.op12_conversation_repair(spark, DATA)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(original, damage(original))


def test_query_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    df.withColumns({"n": F.lit("x"), "piece": F.lit(1), "audit": F.lit(None).cast("int")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in C.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == expected(ODD, damage(ODD))
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert C.op12_conversation_repair(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("piece_rows", [1, 3, 2048])
def test_long_conversations_in_pieces(spark, piece_rows):
    """A conversation that is in many pieces and tasks, with rows that repeat thousands of times, and the repaired rows themselves."""
    rnd = random.Random(5)
    rows = [(c, rnd.randrange(200), rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["a.", "b", "c!", " ", "d?"]) + str(rnd.randrange(60)) + rnd.choice([".", ""])) for c in (7, 7, 7, 8) for _ in range(60)]
    rows += [(9, 0, "user", "again.")] * 1_300
    repair = C.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), piece_rows)
    facts = {r["conv_id"]: r for r in repair.summary().collect()}
    shas = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests().collect()}
    got = sorted(((c, *(facts[c][k] for k in COLUMNS[1:-1]), shas[c]) for c in facts), key=str)
    assert got == expected(rows, rows)
    lines: dict = {}
    for r in sorted(repair.repaired().collect(), key=lambda r: (r["piece"], r["position"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} | {c: NOTHING for c in shas if c not in lines} == shas


def test_random_lattices():
    rnd, texts = random.Random(2), {C.BLANK: "", C.CUT: "x{}", C.FINE: "x{}."}
    for _ in range(1_500):
        cells = [(rnd.choice(["system", "user", "user", "assistant", "assistant", "tool"]), rnd.choice([C.BLANK, C.CUT, C.FINE, C.FINE])) for _ in range(rnd.randrange(9))]
        cost, audit, _, _ = cheapest([(r, texts[f].format(i)) for i, (r, f) in enumerate(cells)])
        costs, traces = C.priced([(r[:1], f) for r, f in cells])
        assert (costs[C.NONE], C.traced(traces)[0]) == (cost, audit)
