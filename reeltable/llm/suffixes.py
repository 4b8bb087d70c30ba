"""Substring dedup by distributed prefix doubling: bytes that a string of LENGTH bytes covers which starts anywhere else too.

Doubling ranks strings of growing length: two are equal if the ranks of a shorter part are and what stands at the offset behind it
is, so each round sorts pairs of rank and what is added, gives new ranks, and drops positions whose pair is alone, until
the length is reached. All positions of a corpus don't fit such rounds, so they go together as long as they can:

* Of the windows of LENGTH bytes, those whose least hash stands at the same byte, the anchor, are a run; equal windows have equal
  anchors. There is about a run for 64 bytes. A run has one position in a round: windows are told by their distance
  o to the anchor, and a node is a range of o, 128 of them at first, then 16, 4 and 1.
* A node's core is what all its windows hold: 73 bytes from the anchor at first, then 185, 197 and 200. A core's rank is the pair of
  the rank of the core before, which it holds, and a digest of what it adds on both sides. A core that is alone has
  no window that stands twice: its position is dropped.
* A node's hull is what any of the run's windows in it holds. Where all hulls of a rank are equal, and there are two, all their windows stand twice:
  they are told, and needn't go on. Only ranks with different hulls do, which are those at the edges of copies; of equal hulls
  among them one goes on, with their number.

Ranks are 64-bit digests, chained; what is removed rests on two digests or more, of core and hull.

Shuffles are by rank, pre-aggregated, and joins back on it, which Spark splits where a rank is hot; no group is collected but a
document's own runs. Rows are told apart as in `cdc`: `uid` is the doc_id where no other row has it, else a number of the row's own. Tables and shuffle files that are done with are deleted on the way.

Defined results: a null text is empty; it and texts of fewer than LENGTH bytes have no window and lose nothing. A null doc_id stays null; repeated
rows each have a result, and all their windows stand twice. A very long text is cut into sections of windows, which overlap in bytes,
not in windows. An empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltable.llm.cdc import identified
from reeltable.llm.common import Stored, carried, own_names, table

LENGTH = 200
HASHED = 32  # bytes that the choice of anchors sees, or the core's if it has fewer
SECTION, PLACE_BITS = 1 << 20, 21
_x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
SCATTERED = (_x ^ (_x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)


def spans_of(length: int) -> list[int]:
    """Widths of nodes, round by round: about two thirds of the length, an eighth of that, then quarters down to one."""
    found = [1 << max(0, (length * 2 // 3).bit_length() - 1)]
    while found[-1] > 1:
        found.append(max(1, found[-1] // (8 if len(found) == 1 else 4)))
    return found


def runs_of(raw: bytes, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each run of a section."""
    core = length - span + 1
    data = np.frombuffer(raw, dtype=np.uint8)
    h, width = SCATTERED[data], 1
    while 2 * width <= min(HASHED, core):  # of so many bytes up to each, by their age
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    low = np.uint64(PLACE_BITS)
    h = (h[width - 1 : len(raw) - core + width] * np.uint64(0x94D049BB133111EB)) >> low << low
    h |= np.arange(len(h), dtype=np.uint64)  # the first of equal ones
    rows = np.concatenate((h, np.full(-len(h) % span, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, span)
    ahead, behind = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(raw) - length + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return first, np.diff(np.append(first, windows)), (least[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def signed(digests: list[int]) -> np.ndarray:
    return np.array(digests, dtype=np.uint64).view(np.int64)


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])


def record(columns: list, schema: str) -> pa.RecordBatch:
    fields = arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


#: A run: the document, its first window and how many, the first window's distance to the anchor, and digests of core and hull.
RUNS = "uid long, start int, windows short, off short, rank long, hull long"


def runs(known: DataFrame, length: int) -> DataFrame:
    """known: uid, text."""
    span = spans_of(length)[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, core = xxhash.xxh3_64_intdigest, length - span + 1
        for batch in batches:
            found, held = [], 0
            for uid, text in zip(*batch.columns, strict=True):
                whole = (text.as_py() or "").encode()
                for base in range(0, len(whole) - length + 1, SECTION):
                    raw = whole[base : base + SECTION + length - 1]
                    first, count, anchor = runs_of(raw, length, span)
                    off = anchor - first
                    ranks = signed([digest(raw[a : a + core]) for a in anchor.tolist()])
                    hulls = signed([digest(raw[a : a + n + length - 1], o) for a, n, o in zip(first.tolist(), count.tolist(), off.tolist(), strict=True)])
                    found.append((np.full(len(first), uid.as_py(), dtype=np.int64), first + base, count, off, ranks, hulls))
                held += len(whole)
                if held > 1 << 22 and found:
                    yield record([np.concatenate(c) for c in zip(*found, strict=True)], RUNS)
                    found, held = [], 0
            if found:
                yield record([np.concatenate(c) for c in zip(*found, strict=True)], RUNS)

    return known.select("uid", "text").mapInArrow(cut, RUNS)


def ranked(positions: DataFrame, keys: list[str], weight: str | None = None) -> Stored:
    """positions whose rank isn't alone, with `mixed`: whether hulls of the rank differ. With a weight, those that stand for several are
    known already; a rank of such ones alone has nothing left to tell. Ranks are a table, so that Spark sees the join's sides as they
    are and splits a hot rank's."""
    n = F.sum(weight) if weight else F.count("*")
    still = F.max((F.col(weight) == 1).cast("int")) if weight else F.lit(1)
    of_rank = positions.groupBy(*keys).agg(n.alias("_n"), F.min("hull").alias("_low"), F.max("hull").alias("_high"), still.alias("_open")).where("_n > 1 AND _open = 1")
    ranks = Stored(of_rank.select(*keys, (F.col("_low") != F.col("_high")).alias("mixed")))
    found = Stored(positions.join(ranks.df, keys))
    ranks.drop()
    return found


#: A node of a round: the run it is of, how many runs that stands for, the node's number, its windows, rank before, digest of what the core adds, of the hull.
NODES = "uid long, start int, weight long, node int, first int, windows int, rank long, added long, hull long"


def nodes(cores: DataFrame, length: int, wide: int, narrow: int) -> DataFrame:
    """Nodes of width `narrow` inside those of width `wide`. cores: uid, start, windows, off, weight, raw (the run's bytes), open (node and rank)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                raw, off = r["raw"], r["off"]
                least = off - r["windows"] + 1  # windows are at distances least .. off
                for x in r["open"]:
                    above = (off - x["node"] * wide, off - (x["node"] + 1) * wide + 1 + length)
                    for k in range(max(least, x["node"] * wide) // narrow, min(off, (x["node"] + 1) * wide - 1) // narrow + 1):
                        here = (off - k * narrow, off - (k + 1) * narrow + 1 + length)
                        far, near = min(off, (k + 1) * narrow - 1), max(least, k * narrow)
                        added = digest(raw[above[1] : here[1]], digest(raw[here[0] : above[0]], k))
                        out.append((r["uid"], r["start"], r["weight"], k, r["start"] + off - far, far - near + 1, x["rank"], added, digest(raw[off - far : off - near + length], far)))
                if len(out) > 100_000:
                    yield told(out)
                    out = []
            yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 9
        return record([*columns[:7], signed(list(columns[7])), signed(list(columns[8]))], NODES)

    return cores.mapInArrow(split, NODES)


RAW = "uid long, start int, windows short, off short, weight long, rank long, raw binary"


def bytes_of(known: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs `wanted` (uid, start, windows, off, weight, rank)."""
    lists = wanted.groupBy(F.col("uid").alias("_uid")).agg(F.collect_list(F.struct("start", "windows", "off", "weight", "rank")).alias("runs"))  # a document's own

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for uid, text, own in zip(*batch.columns, strict=True):
                whole, uid = text.as_py().encode(), uid.as_py()
                for r in own.as_py():
                    out.append((uid, r["start"], r["windows"], r["off"], r["weight"], r["rank"], whole[r["start"] : r["start"] + r["windows"] - 1 + length]))
                    held += length
                if held > 1 << 23:
                    yield record(list(zip(*out, strict=True)), RAW)
                    out, held = [], 0
            if out:
                yield record(list(zip(*out, strict=True)), RAW)

    return known.join(lists, known["uid"] == lists["_uid"]).select("uid", "text", "runs").mapInArrow(cut, RAW)


def forget(spark: SparkSession, *tables: Stored) -> None:
    """Deletes tables that are done with. Spark deletes shuffle files when the driver's garbage has been collected."""
    for t in tables:
        t.drop()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_windows(known: DataFrame, length: int = LENGTH) -> DataFrame:
    """known: uid (a row's own), text. uid, start and how many: windows that stand anywhere else too."""
    spark, spans = known.sparkSession, spans_of(length)
    ranges = lambda df, first="start": df.select("uid", F.col(first).cast("long").alias("start"), F.col("windows").cast("long").alias("windows"))

    every = Stored(runs(known, length))
    shared = ranked(every.df, ["rank"])
    forget(spark, every)
    mixed = shared.df.where("mixed")
    one = mixed.groupBy("rank", "hull").agg(F.count("*").alias("weight"), F.min(F.struct("uid", "start", "windows", "off")).alias("x")).select("rank", "hull", "weight", "x.*")
    one = Stored(one)
    found = [Stored(ranges(shared.df.where("not mixed").unionByName(mixed.join(one.df.where("weight > 1"), ["rank", "hull"], "left_semi"), allowMissingColumns=True)))]
    forget(spark, shared)

    raw = Stored(bytes_of(known, one.df, length))
    forget(spark, one)
    root = F.array(F.struct(F.lit(0).alias("node"), "rank"))
    cores = raw.df.select("uid", "start", "windows", "off", "weight", "raw", root.alias("open"))
    before = None
    for wide, narrow in zip(spans, spans[1:], strict=False):
        each = Stored(nodes(cores, length, wide, narrow))
        told = ranked(each.df, ["rank", "added"], "weight")
        forget(spark, each, *([before] if before else []))
        found.append(Stored(ranges(told.df.where("not mixed and weight = 1"), "first")))
        again = told.df.where("mixed").groupBy("uid", "start").agg(F.collect_list(F.struct("node", F.xxhash64("rank", "added").alias("rank"))).alias("open"))  # a run's own nodes
        cores = raw.df.join(again, ["uid", "start"]).select("uid", "start", "windows", "off", "weight", "raw", "open")
        before = told
    forget(spark, raw, *([before] if before else []))
    every_range = found[0].df
    for f in found[1:]:
        every_range = every_range.unionByName(f.df)
    return every_range


def spans_from(ranges: list | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["start"] + r["windows"] - 1 + length) for r in (() if ranges is None else ranges)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def with_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`_row` (the row whole), doc_id, text and `ranges`, the windows of each row that stand elsewhere too."""
    rows = identified(carried(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}))
    found = repeated_windows(rows.select("uid", "text"), length)
    lists = found.groupBy(F.col("uid").alias("_uid")).agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))  # a document's own
    return rows.join(lists, rows["uid"] == lists["_uid"], "left").select("_row", "doc_id", "text", "ranges")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with `spans` (byte ranges that stand elsewhere too) and `kept`, the bytes that are left; a cut may fall inside a character."""

    def cut(texts, ranges):
        import pandas as pd

        out = []
        for text, own in zip(texts, ranges, strict=True):
            whole, spans = (text or "").encode(), spans_from(own, length)
            ends = [0, *(e for _, e in spans)]
            out.append({"spans": [{"start": a, "end": b} for a, b in spans], "kept": b"".join(whole[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(whole)], strict=True))})
        return pd.DataFrame(out, columns=["spans", "kept"])

    told = F.pandas_udf(cut, "spans array<struct<start:long,end:long>>, kept binary")("text", "ranges")
    return with_ranges(docs, length).select("_row", told.alias("_x")).select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in ("spans", "kept")), "_x.spans", "_x.kept")


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that are left."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, ranges in zip(*batch.columns, strict=True):
                whole, spans, at, held = (text.as_py() or "").encode(), spans_from(ranges.as_py(), length), 0, hashlib.sha256()
                for a, b in spans:
                    held.update(whole[at:a])
                    at = b
                held.update(whole[at:])
                out.append((doc_id.as_py(), len(whole), sum(b - a for a, b in spans), len(spans), held.hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], [x.split()[0] for x in schema.split(", ")])

    return with_ranges(own_names(docs, "doc_id", "text"), length).select("doc_id", "text", "ranges").mapInArrow(digest, schema)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
