"""Chains in time: an interval ends with the first row at or past its length after the last end.

Which rows are ends hangs on all ends before, so a plain scan takes a key's rows in one task. Here a key is cut into time buckets,
each at least as wide as the interval. In a bucket, the row that follows any of its rows as an end is found from the bucket's rows,
those of the next bucket's first interval, and the first row after both, so each row that may be the bucket's first end (one in
its first interval, or the first behind that) is told with the next bucket's first end that comes of it and the ends
between: a jump. Jumps are squared until they lead past the last bucket, and the way from a key's first row along them, longest first,
marks each bucket's true first end and its number. Then the buckets are scanned once more, all at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reeltable.functions.tables import Stored, dealt
from reeltable.operators.overlap import frame_starts

SPREAD = 64  # intervals in a bucket


def groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key of sorted batches."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(pdf):
            starts = frame_starts(pdf, keys)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield pdf.iloc[a:b]
            rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


JUMPS = "_k string, _b long, entry long, next long, steps long"


def jumps(ticks: DataFrame, interval: int, width: int) -> DataFrame:
    """ticks: distinct _k, _b (bucket), at. What may be a bucket's first end, the first end of a later bucket that follows (or null), and how
    many ends on that is."""
    start = F.col("_b") * width
    by_bucket = ticks.groupBy("_k", "_b").agg(F.min("at").alias("_low"), F.min(F.when(F.col("at") >= start + interval, F.col("at"))).alias("_late"))  # a row a bucket
    w = Window.partitionBy("_k").orderBy("_b")
    beside = F.lead("_b").over(w) == F.col("_b") + 1
    after = F.when(beside, F.coalesce(F.lead("_late").over(w), F.lead("_low", 2).over(w))).otherwise(F.lead("_low").over(w))
    behind = by_bucket.select("_k", "_b", after.alias("_after"))  # the first row that lies an interval or more behind the bucket
    halo = ticks.where(F.col("at") < start + interval).select("_k", (F.col("_b") - 1).alias("_b"), "at", F.lit(False).alias("own"))
    rows = ticks.withColumn("own", F.lit(True)).unionByName(halo).join(behind, ["_k", "_b"])

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ("_k", "_b")):
            at = g["at"].to_numpy(dtype=np.int64)
            n, k, b, last = int(g["own"].sum()), g["_k"].iloc[0], int(g["_b"].iloc[0]), g["_after"].iloc[0]
            follows = np.searchsorted(at, at[:n] + interval).tolist()
            ends, steps = [0] * n, [1] * n
            for i in range(n - 1, -1, -1):
                j = follows[i]
                if j < n:
                    ends[i], steps[i] = ends[j], steps[j] + 1
                else:
                    ends[i] = int(at[j]) if j < len(at) else None if pd.isna(last) else int(last)
            may = min(n, int(np.searchsorted(at[:n], b * width + interval)) + 1)
            yield pd.DataFrame({"_k": k, "_b": b, "entry": at[:may], "next": pd.array(ends[:may], dtype="Int64"), "steps": steps[:may]})

    return dealt(rows, "_k", "_b").sortWithinPartitions("_k", "_b", "at").mapInPandas(told, JUMPS)


def first_ends(ticks: DataFrame, interval: int, width: int) -> Stored:
    """_k, entry, number, here: the first end in each bucket that has one, how many ends come before it and how many the bucket has. A key's first tick is its first end."""
    level = Stored(jumps(ticks, interval, width).select("_k", "entry", "next", "steps"))
    levels = [level]
    while not level.df.where("next is not null").isEmpty():
        far = level.df.select("_k", F.col("entry").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        level = Stored(level.df.where("next is not null").join(far, ["_k", "next"]).select("_k", "entry", F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps")))
        levels.append(level)
    found = Stored(ticks.groupBy("_k").agg(F.min("at").alias("entry")).withColumn("number", F.lit(0).cast("long")))
    for jump in reversed(levels):
        on = found.df.join(jump.df.where("next is not null"), ["_k", "entry"]).select("_k", F.col("next").alias("entry"), (F.col("number") + F.col("steps")).alias("number"))
        both = Stored(found.df.unionByName(on))
        found.drop()
        found = both
    here = Stored(found.df.join(levels[0].df, ["_k", "entry"]).select("_k", "entry", "number", F.col("steps").alias("here")))
    for table in (found, *levels):
        table.drop()
    return here


def with_interval_numbers(df: DataFrame, keys: Sequence[str], at: str, interval: int, order: Sequence[str] = (), from_zero: bool = False, spread: int = SPREAD) -> DataFrame:
    """df with `interval_no`, from 0 for each key: a row that is `interval` or more after the last end ends an interval and is its last
    row; the first interval begins at the key's first row, or at 0. `at` is a whole number; of rows at one time the first by `order` ends
    it. Rows without a time are left out."""
    if interval < 1:
        raise ValueError("an interval is 1 at least")
    width = interval * spread
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = df.where(F.col(at).isNotNull()).withColumns({"_k": key, "_at": F.col(at).cast("long")}).withColumn("_b", F.floor(F.col("_at") / width))
    ticks = rows.select("_k", "_b", F.col("_at").alias("at"))
    if from_zero:
        ticks = ticks.unionByName(rows.select("_k", F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("at")))
    ticks = Stored(ticks.distinct())
    ends = first_ends(ticks.df, interval, width)
    buckets = ticks.df.select("_k", "_b").distinct()  # a row a bucket
    at_bucket = ends.df.select("_k", F.floor(F.col("entry") / width).alias("_b"), "entry", "number", "here")
    known = buckets.join(at_bucket, ["_k", "_b"], "left")
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    known = known.select("_k", "_b", F.col("entry").alias("_entry"), F.col("number").alias("_number"), F.coalesce(F.max(F.col("number") + F.col("here") - 1).over(before), F.lit(0)).alias("_before"))
    joined = rows.join(known, ["_k", "_b"])
    out = df.schema.fieldNames()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", interval_no long"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, start, number, entry = None, None, 0, None
        for pdf in batches:
            numbers = np.empty(len(pdf), dtype=np.int64)
            for i, (k, b, t, e, n, before) in enumerate(zip(*(pdf[c] for c in ("_k", "_b", "_at", "_entry", "_number", "_before")), strict=True)):
                if (k, b) != bucket:
                    bucket, start, number, entry = (k, b), None, int(before), None if pd.isna(e) else int(e)
                numbers[i] = number
                if start is None:
                    if entry is not None and t >= entry:
                        start, number = entry, int(n)
                        if t > entry:  # the first end is no row's, but where the key begins
                            numbers[i] = number
                            if t - start >= interval:
                                start, number = t, number + 1
                elif t - start >= interval:
                    start, number = t, number + 1
            yield pdf[out].assign(interval_no=numbers)

    # Only a key's first end can have no row of its own, where it begins at 0.
    return dealt(joined, "_k", "_b").sortWithinPartitions("_k", "_b", "_at", *order).mapInPandas(scan, schema)
