"""Conversation structure repair: the cheapest edits that give each conversation the turns `(system? (user assistant)+)?`.

A row is kept (0), given the role user or assistant (3) or deleted (4); a row of user or assistant without text may be
inserted anywhere (3). Blank rows and duplicates have to be deleted; a truncated row that stays adds 3. So the edits of a
conversation are a path over a lattice: a node is a number of rows done and the role before (none, system, user,
assistant), an arc is an edit. The auction algorithm finds the shortest path: it holds a path and a price for each node,
with no price over an arc's cost and the price behind it. The path's end is extended to the node that is cheapest where
its price says so, else the price rises to that and the path gives up its last node. At the end the arcs of all
shortest paths are tight (cost = difference of prices); the edits are traced along tight arcs that lead to the end, least
initial first (D, I, K, R), which is the ASCII-least of the cheapest audits, as each node has one arc an initial.

Lattices are priced in blocks of BLOCK rows from the last to the first, each with the prices of its successor as its end,
so the work is linear in the rows. Blocks that look alike (roles' initials, faults, end prices) are priced once.

Rows are grouped by (conversation, turn, role, text) with their count, so repeated rows are one on the map side. They are
dealt by ranges of (conversation, turn, role, text) and sorted, so a conversation of any length is many tasks'. A task cuts its
rows into pieces of at most PIECE_ROWS rows; a conversation that isn't the first or last of its task is whole there. For the
others, the pieces' tables of costs (4 x 4) pass from the last piece to the first and the roles reached from the first to the
last, in scans that hold one row. Only the digest of a long conversation's text, a chain by nature, reads its rows in a task,
piece by piece.

Defined results: nulls in role and text are one space; a null conv_id is a conversation of its own, null turns come first. Rows
of one turn are in order of role (its first 32 characters), text (its first 64), then digest. A role counts by its first character; rows with other roles than
system, user and assistant can't be kept. An empty role has an empty initial. Repeated rows are duplicates, but for the first.
A conversation without rows has zeros, an empty audit and no rows. A very long text is held once, in its piece. An empty table
gives an empty result. Only conv_id, turn, role and text are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltable.llm.common import own_names, table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NAMES = ("", "system", "user", "assistant")
#: The role that has to follow each role, if it isn't system after none.
NEXT = (USER, USER, ASSISTANT, USER)
FOREVER = 1 << 40
ENDS = (0, FOREVER, FOREVER, 0)  # a conversation ends without a turn or behind the assistant
BLOCK, PIECE_ROWS, PIECE_CHARS, COPIES = 16, 2_048, 1 << 20, 512
#: Faults, the first of a row in this order: blank, duplicate, truncated; none.
BLANK, AGAIN, CUT, FINE = range(4)


def arcs(cell: tuple[str, int] | None, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, rows done, role) of the edits at a node before this row (None: behind the last), least initial first."""
    found = [("I", INSERT, 0, NEXT[state])]
    if cell is None:
        return found
    role, fault = cell
    found.insert(0, ("D", DELETE, 1, state))
    if fault in (BLANK, AGAIN):
        return found
    more = TRUNCATED if fault == CUT else 0
    to = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role)
    if to is not None and (to == NEXT[state] or (state, to) == (NONE, SYSTEM)):
        found.append(("K", KEEP + more, 1, to))
    found.append(("R", REROLE + more, 1, NEXT[state]))
    return found


@functools.lru_cache(maxsize=1 << 16)
def block_prices(cells: tuple[tuple[str, int], ...], ends: tuple[int, ...]) -> tuple[tuple[int, ...], tuple]:
    """Least cost from each role before these rows to the end, where it costs `ends` by the role behind them; and for each
    role the edits that a trace takes from there: (initials, role behind). What is inserted behind the rows belongs to the block
    behind; a conversation's last block has no rows, only such insertions."""
    n, last = len(cells), (len(cells) + 1, 0)
    ways: dict = {last: []}
    for i in range(n, -1, -1):
        for s in STATES:
            here = [(initial, cost, (i + done, to)) for initial, cost, done, to in arcs(cells[i] if i < n else None, s)] if i < n or not n else []
            ways[i, s] = ([("", ends[s], last)] if i == n and ends[s] < FOREVER else []) + here
    able = {last}  # from where the end can be reached
    for i in range(n, -1, -1):
        for _ in STATES:  # insertions lead from role to role
            able |= {(i, s) for s in STATES if any(to in able for _, _, to in ways[i, s])}
    ways = {node: [w for w in out if w[2] in able] for node, out in ways.items() if node in able}
    forced = [0] * (n + 1)  # what the rows that are left cost at least; prices that start there break no arc
    for i in range(n - 1, -1, -1):
        forced[i] = forced[i + 1] + (DELETE if cells[i][1] in (BLANK, AGAIN) else TRUNCATED if cells[i][1] == CUT else 0)
    price = {node: forced[node[0]] + min(ends) for node in ways if node != last} | {last: 0}
    for origin in STATES:
        path = [(0, origin)]
        while path[-1] != last and (0, origin) in able:
            node = path[-1]
            cost, best = min((cost + price[to], to) for _, cost, to in ways[node])
            if price[node] < cost:
                price[node] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)
    tight = {node: [(initial, to) for initial, cost, to in out if cost + price[to] == price[node]] for node, out in ways.items()}
    live = {last: True}

    def leads(node) -> bool:
        """Whether tight arcs lead from here to the end. They make no circle, as one of insertions costs more than nothing."""
        if node not in live:
            live[node] = any(leads(to) for _, to in tight[node])
        return live[node]

    def trace(node) -> tuple[str, int]:
        said = []
        while True:
            initial, to = next(x for x in tight[node] if leads(x[1]))
            if to == last:
                return "".join(said), node[1]
            said.append(initial)
            node = to

    origins = [(0, s) for s in STATES]
    return tuple(price[o] if o in able else FOREVER for o in origins), tuple(trace(o) if o in able else None for o in origins)


#: What it costs from each role behind the last row, and the insertions there.
CLOSED = block_prices((), ENDS)


def priced(cells: list[tuple[str, int]], ends: tuple[int, ...] = ENDS) -> tuple[tuple[int, ...], list[tuple]]:
    """Costs from each role before the rows, and the blocks' traces, first to last. With ENDS, the conversation ends here."""
    ends, found = (CLOSED[0], [CLOSED[1]]) if ends == ENDS else (ends, [])
    for at in range((len(cells) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        low = min(ends)
        costs, traces = block_prices(tuple(cells[at : at + BLOCK]), tuple(e - low if e < FOREVER else FOREVER for e in ends))
        ends = tuple(min(c + low, FOREVER) for c in costs)
        found.append(traces)
    return ends, found[::-1]


def traced(traces: list[tuple], state: int = NONE) -> tuple[str, int]:
    said = []
    for t in traces:
        part, state = t[state]
        said.append(part)
    return "".join(said), state


def matrix(cells: list[tuple[str, int]]) -> list[int]:
    """Cost from each role before the rows to each role behind them, row by row."""
    columns = [priced(cells, tuple(0 if s == to else FOREVER for s in STATES))[0] for to in STATES]
    return [min(columns[to][s], FOREVER) for s in STATES for to in STATES]


def edited(audit: str, roles: list[str], texts: list[str], state: int = NONE) -> Iterator[tuple[str, str, str]]:
    """(initial, role, text) for each edit but deletions."""
    at = 0
    for initial in audit:
        if initial == "D":
            at += 1
            continue
        if initial == "I":
            state = NEXT[state]
            yield initial, NAMES[state], ""
            continue
        role = roles[at]
        state = NEXT[state] if initial == "R" else {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        yield initial, NAMES[state] if initial == "R" else role, texts[at]
        at += 1


def faulted(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n copies) by turn and content, with their first copy's fault and how many copies there are."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    first = same.groupBy("conv_id", "role", F.md5("text").alias("_t")).agg(F.min(turn).alias("_first")).select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role")), "_t", "_first")
    joined = same.join(first, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.md5("text") == F.col("_t")))
    later = F.col("_first") != turn
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(later, AGAIN).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(FINE)
    told = joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))
    # The first copy is a row; the others follow in rows of at most COPIES copies each.
    more = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")), lambda i: F.struct(i.alias("copy"), F.least(F.lit(COPIES).cast("long"), F.col("n") - i).alias("n"), F.when(F.col("fault") == BLANK, BLANK).otherwise(AGAIN).alias("fault")))).otherwise(F.array().cast("array<struct<copy:bigint,n:bigint,fault:int>>"))
    copies = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("copy"), F.lit(1).cast("long").alias("n"), F.col("fault"))), more)
    return told.select("conv_id", "turn", "role", "text", F.explode(copies).alias("_c")).select("conv_id", "turn", "role", "text", "_c.*")


PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int8()))])
PIECES_SQL = "conv_id long, piece long, whole boolean, roles array<string>, texts array<string>, faults array<tinyint>"


def pieces_of(cells: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows in order, in pieces; whole: all rows of the conversation."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base = 0, TaskContext.get().partitionId() << 40
        conv, roles, texts, faults, held, parts, first = object(), [], [], [], 0, 0, True
        out: list[tuple] = []

        def close(more: bool) -> None:
            nonlocal number, roles, texts, faults, held, parts, first
            if roles:
                out.append((conv, base + number, not (first or more or parts), roles, texts, faults))
                number, parts = number + 1, parts + 1
            roles, texts, faults, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(PIECES)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

        size = 0
        for batch in batches:
            for c, role, text, n, fault in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text", "n", "fault")), strict=True):
                if c != conv:
                    close(False)
                    first = first and not number  # the task's first conversation may have begun before
                    conv, parts = c, 0
                elif roles and (len(roles) + n > piece_rows or held + n * len(text) > PIECE_CHARS):
                    close(True)
                roles += [role] * n
                texts += [text] * n
                faults += [fault] * n
                held += n * len(text)
                size += n * len(text)
                if size > 1 << 23:
                    yield flush()
                    size = 0
        close(True)  # the last one may go on in the next task
        yield flush()

    # Ranges are found from a sample of keys on the driver, so those have a bounded length.
    keyed = cells.withColumns({"_r": F.left("role", F.lit(32)), "_t": F.left("text", F.lit(64)), "_d": F.md5(F.concat_ws("\x00", "role", "text"))})
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("_r"), F.asc("_t"), F.asc("_d"), F.asc("copy")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "n", "fault").mapInArrow(cut, PIECES_SQL)


FACTS = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("state", pa.int32())])
FACTS_SQL = "conv_id long, piece long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, state int"
LEGAL = {"su", "ua", "au"}


def counted(roles: list[str], faults: list[int]) -> tuple[int, int, int, int]:
    initials = [r[:1] for r in roles]
    return faults.count(BLANK), faults.count(AGAIN), faults.count(CUT), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def whole_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, piece, roles, faults in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "roles", "faults")), strict=True):
            costs, traces = priced([(r[:1], f) for r, f in zip(roles, faults, strict=True)])
            rows.append((conv, piece, *counted(roles, faults), costs[NONE], traced(traces)[0], NONE))
        yield batch_of(rows, FACTS)


def scanned(df: DataFrame, descending: bool, step, schema: str) -> DataFrame:
    """step(row, carried) -> (row's values, carried) over each conversation's pieces in order; None is carried into the first."""
    fields = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, state = row["conv_id"], None
                values, state = step(row, state)
                rows.append(dict(zip(fields, values, strict=True)))
            yield pa.RecordBatch.from_pylist(rows, kinds)

    kinds = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (x.split(" ") for x in schema.split(", "))])
    order = F.desc("piece") if descending else F.asc("piece")
    return df.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), order).mapInArrow(scan, schema)


def split_facts(parts: DataFrame) -> DataFrame:
    """Facts of the pieces of conversations that lie in more than one, each with its own part of cost and audit."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, p, matrix([(r[:1], f) for r, f in zip(roles, faults, strict=True)])) for c, p, roles, faults in zip(*(b.column(x).to_pylist() for x in ("conv_id", "piece", "roles", "faults")), strict=True)]
            yield batch_of(rows, pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("costs", pa.list_(pa.int64()))]))

    def back(row, after):
        behind = CLOSED[0] if after is None else after
        here = [min(row["costs"][4 * s + to] + behind[to] for to in STATES) for s in STATES]
        return (row["conv_id"], row["piece"], list(ENDS) if after is None else after), here

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each role before a piece, the role behind it and the audit between."""
        for b in batches:
            rows = []
            for c, p, roles, faults, ends in zip(*(b.column(x).to_pylist() for x in ("conv_id", "piece", "roles", "faults", "ends")), strict=True):
                costs, traces = priced([(r[:1], f) for r, f in zip(roles, faults, strict=True)], tuple(ends))
                found = [traced(traces, s) for s in STATES]
                rows.append((c, p, *counted(roles, faults), [costs[s] - (0 if tuple(ends) == ENDS else ends[found[s][1]]) for s in STATES], [x[0] for x in found], [x[1] for x in found], roles[0][:1], roles[-1][:1]))
            yield batch_of(rows, WAYS)

    WAYS = pa.schema([*list(FACTS)[:6], ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("behind", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string())])

    def forth(row, before):
        state, last = (NONE, None) if before is None else before
        crossed = 0 if last is None else int(last + row["first"] not in LEGAL)
        return (row["conv_id"], row["piece"], state, crossed), (row["behind"][state], row["last"])

    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["piece"] == b["piece"])
    costs = parts.select("conv_id", "piece", "roles", "faults").mapInArrow(tables, "conv_id long, piece long, costs array<long>")
    ends = scanned(costs, True, back, "conv_id long, piece long, ends array<long>")
    told = parts.join(ends, same(parts, ends)).select(parts["conv_id"], parts["piece"], "roles", "faults", "ends")
    found = written(told.mapInArrow(ways, "conv_id long, piece long, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>, behind array<long>, first string, last string"))
    states = scanned(found.select("conv_id", "piece", "behind", "first", "last"), False, forth, "conv_id long, piece long, state int, crossed int")
    both = found.join(states, same(found, states))
    at = lambda c: F.element_at(c, F.col("state") + 1)
    return both.select(found["conv_id"], found["piece"], "blank", "duplicate", "truncated", (F.col("illegal") + F.col("crossed")).alias("illegal"), at("costs").alias("cost"), at("audits").alias("audit"), "state")


def plain_rows(conversations: DataFrame) -> DataFrame:
    named = own_names(conversations, "conv_id", "turn", "role", "text")
    return named.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


class Repair:
    """A table of conversations' pieces with their facts, of which the results are made."""

    def __init__(self, rows: DataFrame, piece_rows: int = PIECE_ROWS):
        """rows: conv_id, turn, role, text and n, the number of copies that follow one another."""
        self.rows = rows
        self.pieces = written(pieces_of(faulted(rows), piece_rows))
        whole = self.pieces.where("whole").select("conv_id", "piece", "roles", "faults").mapInArrow(whole_facts, FACTS_SQL)
        self.facts = written(whole.unionByName(split_facts(self.pieces.where("not whole"))))

    def told(self) -> DataFrame:
        """The pieces with their facts."""
        f = self.facts.select(F.col("conv_id").alias("_c"), F.col("piece").alias("_p"), "audit", "state")
        return self.pieces.join(f, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p"))).drop("_c", "_p")

    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation that has rows."""
        turns = self.rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        audits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "").alias("audit")
        facts = self.facts.groupBy(F.col("conv_id").alias("_c")).agg(*sums, audits)
        return turns.join(facts, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def repaired(self) -> DataFrame:
        """conv_id, piece, position (in the piece), edit, role and text of the repaired rows; (piece, position) is their order."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("position", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            for b in batches:
                for r in b.to_pylist():
                    yield batch_of([(r["conv_id"], r["piece"], i, *x) for i, x in enumerate(edited(r["audit"], r["roles"], r["texts"], r["state"]))], kinds)

        return self.told().select("conv_id", "piece", "roles", "texts", "audit", "state").mapInArrow(rows, "conv_id long, piece long, position int, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """conv_id and the SHA-256 of the repaired rows as `role:text` lines."""

        def lines(r) -> bytes:
            return "\n".join(f"{role}:{text}" for _, role, text in edited(r["audit"], r["roles"], r["texts"], r["state"])).encode()

        kinds = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield batch_of([(r["conv_id"], hashlib.sha256(lines(r)).hexdigest()) for r in b.to_pylist()], kinds)

        def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, held, empty = object(), None, True
            for b in batches:
                out = []
                for r in b.to_pylist():
                    if held is None or r["conv_id"] != conv:
                        if held is not None:
                            out.append((conv, held.hexdigest()))
                        conv, held, empty = r["conv_id"], hashlib.sha256(), True
                    said = lines(r)
                    if said:
                        held.update(said if empty else b"\n" + said)
                        empty = False
                yield batch_of(out, kinds)
            if held is not None:
                yield batch_of([(conv, held.hexdigest())], kinds)

        told = self.told().select("conv_id", "piece", "whole", "roles", "texts", "audit", "state")
        done = told.where("whole").mapInArrow(whole, "conv_id long, repaired_sha256 string")
        parts = told.where("not whole").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "piece")
        return done.unionByName(parts.mapInArrow(chained, "conv_id long, repaired_sha256 string"))


def repair_conversations(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> Repair:
    """conversations: conv_id, turn, role, text."""
    return Repair(plain_rows(conversations).withColumn("n", F.lit(1).cast("long")), piece_rows)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without ends of sentences, repeated or given to the user, by a checksum of conversation and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = plain_rows(conversations).withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repair = Repair(damaged(conversations))
    ids = own_names(conversations, "conv_id").select(F.col("conv_id").cast("long")).distinct()
    facts = repair.summary().withColumnRenamed("conv_id", "_c")
    digests = repair.digests().withColumnRenamed("conv_id", "_d")
    joined = ids.join(facts, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
