"""Sampling, batching and windows over frames. i counts a stream's frames from 0.

Where a table already has `frame_num`, counting needs no sort: pass index=F.col("frame_num").
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reeltable.functions.tables import dealt

STREAM = ("stream_id",)


def frame_index(keys: Sequence[str] = STREAM, order: Sequence[str] = ("pts",)) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1


def sample_interval(df: DataFrame, n: int, index: Column | None = None) -> DataFrame:
    """Each n-th frame, the first among them."""
    return df.withColumn("_i", frame_index() if index is None else index).where(F.col("_i") % n == 0).drop("_i")


def pass_drop(df: DataFrame, passed: int, dropped: int, gap: bool = False, index: Column | None = None) -> DataFrame:
    """`passed` frames pass, `dropped` don't, again and again; with gap, the dropped stay as gap rows."""
    keep = F.col("_i") % (passed + dropped) < passed
    out = df.withColumn("_i", frame_index() if index is None else index)
    return (out.withColumn("is_gap", ~keep) if gap else out.where(keep)).drop("_i")


def rate_adjust(df: DataFrame, num: int, den: int, keys: Sequence[str] = ("stream_id", "object_id"), order: Sequence[str] = ("frame_num",)) -> DataFrame:
    """Keeps ceil(k num / den) of each key's first k rows."""
    k = F.col("_i") + 1
    up = lambda c: F.floor((c * num + den - 1) / den)
    return df.withColumn("_i", frame_index(keys, order)).where(up(k) > up(k - 1)).drop("_i")


def sample_fps(df: DataFrame, fps: float, rate: float, index: Column | None = None) -> DataFrame:
    """About `rate` of `fps` frames a second: each ceil(fps / rate)-th, counted from 1; a rate of 0 keeps all."""
    if not rate:
        return df
    return df.withColumn("_i", frame_index() if index is None else index).where((F.col("_i") + 1) % math.ceil(fps / rate) == 0).drop("_i")


def chunk_frames(df: DataFrame, size: int, index: Column | None = None) -> DataFrame:
    """Full chunks of so many frames, as lists, stamped with the last frame's pts."""
    rows = df.withColumn("_i", frame_index() if index is None else index).withColumn("chunk", F.floor(F.col("_i") / size))
    lists = rows.groupBy("stream_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("_i", "frame_id", "pts"))).alias("_f"))  # of at most `size`
    full = lists.where(F.size("_f") == size)
    return full.select("stream_id", "chunk", F.transform("_f", lambda x: x["frame_id"]).alias("frame_ids"), F.element_at("_f", -1)["pts"].alias("pts"))


def sliding_tensor(df: DataFrame, n: int, keys: Sequence[str] = STREAM, order: Sequence[str] = ("frame_num",), data: str = "data") -> DataFrame:
    """At each frame, the last n tensors in one; the first n - 1 are shorter."""
    return df.withColumn(data, F.flatten(F.collect_list(data).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0))))


def smooth_gaps(df: DataFrame, value: Sequence[str] = ("label", "attr_value"), keys: Sequence[str] = ("stream_id", "object_id"), order: Sequence[str] = ("frame_num",)) -> DataFrame:
    """A gap row of a tracked object takes the last metadata known of it; is_gap stays where none is.

    Untracked rows (object_id null or 0) are left alone, and out of the window: they'd be one huge group."""
    tracked = F.coalesce(F.col("object_id"), F.lit(0)) != 0
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(~F.col("is_gap"), F.struct(*value)), ignorenulls=True).over(w)
    filled = df.where(tracked).withColumn("_k", known)
    filled = filled.withColumns({**{c: F.when(F.col("is_gap"), F.col(f"_k.{c}")).otherwise(F.col(c)) for c in value}, "is_gap": F.col("is_gap") & F.col("_k").isNull()}).drop("_k")
    return filled.unionByName(df.where(~tracked).withColumns({c: F.when(~F.col("is_gap"), F.col(c)) for c in value}))


def needs_reclassify(df: DataFrame, interval: int = 1, keys: Sequence[str] = ("stream_id", "object_id"), order: str = "frame_num") -> DataFrame:
    """df with `classify`: an object's first time, then (interval 0: never again) when `interval` frames have gone by since
    the last time; untracked rows always. The scan goes on over Arrow batches of sorted partitions, an object's state being
    the frame of its last time, so an object of any length is never held whole."""
    tracked = F.coalesce(F.col("object_id"), F.lit(0)) != 0
    keyed = df.where(tracked)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, done = None, None
        for pdf in batches:
            flags = []
            for row in zip(*(pdf[k] for k in keys), pdf[order], strict=True):
                key, frame = row[:-1], row[-1]
                if key != last_key:
                    last_key, done = key, None
                due = done is None or (interval > 0 and frame - done >= interval)
                if due:
                    done = frame
                flags.append(due)
            yield pdf.assign(classify=flags)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", classify boolean"
    scanned = dealt(keyed, *keys).sortWithinPartitions(*keys, order).mapInPandas(scan, schema)
    return scanned.unionByName(df.where(~tracked).withColumn("classify", F.lit(True)))


def fill_classifications(df: DataFrame, value: str = "attr_value", keys: Sequence[str] = ("stream_id", "object_id"), order: str = "frame_num", layer: str | None = None) -> DataFrame:
    """A tracked object's rows without a result take its last one (of their layer, if a column tells it), with how many frames ago
    that was made in `frames_ago`; rows with a result of their own have none. Untracked rows (object_id null or 0) stay as they are."""
    tracked = F.coalesce(F.col("object_id"), F.lit(0)) != 0
    w = Window.partitionBy(*keys, *([layer] if layer else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(order).alias("at"))), ignorenulls=True).over(w)
    filled = df.where(tracked).withColumn("_l", last)
    filled = filled.withColumns({"frames_ago": F.when(F.col(value).isNull(), F.col(order) - F.col("_l.at")), value: F.coalesce(F.col(value), F.col("_l.v"))}).drop("_l")
    return filled.unionByName(df.where(~tracked), allowMissingColumns=True)


def loop_frames(df: DataFrame, n_in: int, n_out: int, index: Column | None = None) -> DataFrame:
    """The first n_in - 1 frames pass; then frames 1 to n_in are replayed in turn for max(1, n_out - n_in) rows, each a frame's time after the one before."""
    rows = df.withColumn("_i", frame_index() if index is None else index).where(F.col("_i") < n_in)
    passed = rows.where(F.col("_i") < n_in - 1).select("stream_id", "frame_id", "pts", F.col("_i").alias("out_num"))
    replays = max(1, n_out - n_in)
    w = Window.partitionBy("stream_id")
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("pts"))).over(w)  # noqa: E731  of n_in rows a stream
    held = rows.withColumns({"_full": F.max("_i").over(w) == n_in - 1, "_last": at(n_in - 2), "_delta": at(n_in - 1) - at(n_in - 2)}).where("_full")
    turns = F.explode(F.sequence(F.col("_i"), F.lit(replays - 1).cast("long"), F.lit(n_in).cast("long")))
    again = held.where(F.col("_i") < replays).withColumn("_k", turns)
    again = again.select("stream_id", "frame_id", (F.col("_last") + (F.col("_k") + 1) * F.col("_delta")).alias("pts"), (F.col("_k") + n_in - 1).alias("out_num"))
    return passed.unionByName(again)
