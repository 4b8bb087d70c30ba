"""Throughput, latency and counts over frames and traces."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reeltable.functions.tables import Stored
from reeltable.operators.chains import with_interval_numbers


def fps_by_interval(df: DataFrame, interval_ns: int = 1_000_000_000, starting_frame: int = 0) -> DataFrame:
    """Frames a second between ends of intervals over all streams, and of each stream on average.

    An interval ends with the first time at or past its length after the last end; those ends are found in time buckets from
    one row for each distinct time. Frames without a time are left out."""
    counted = Stored(df.where((F.col("frame_num") >= starting_frame) & F.col("pts").isNotNull()).groupBy("pts").agg(F.count("*").alias("frames"), F.collect_set("stream_id").alias("streams"))).df
    numbered = with_interval_numbers(counted.select("pts"), (), "pts", interval_ns)
    sums = numbered.join(counted, "pts").groupBy("interval_no").agg(F.sum("frames").alias("frames"), F.min("pts").alias("first"), F.max("pts").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("streams")))).alias("streams"))
    sums = Stored(sums).df  # a row an interval
    before = sums.select((F.col("interval_no") + 1).alias("interval_no"), F.col("end").alias("begin"))
    out = sums.join(before, "interval_no", "left").withColumn("seconds", (F.col("end") - F.coalesce("begin", "first")) / 1e9).where("seconds > 0")
    return out.select("interval_no", "frames", "streams", "seconds", (F.col("frames") / F.col("seconds")).alias("fps"), (F.col("frames") / F.col("seconds") / F.col("streams")).alias("fps_per_stream"))


def fps_tumbling(df: DataFrame, ts: str = "ts", interval: str = "1 second") -> DataFrame:
    """Frames, streams and frames a stream in tumbling windows; works on a stream with a watermark too."""
    return df.groupBy(F.window(ts, interval).alias("w"), "stream_id").agg(F.count("*").alias("frames")).select(F.col("w.start").alias("start"), "stream_id", "frames")


def fps_overall(df: DataFrame) -> DataFrame:
    """Frames by the time from first to last, for each stream; null under a tenth of a second."""
    sums = df.groupBy("stream_id").agg(F.count("*").alias("frames"), ((F.max("pts") - F.min("pts")) / 1e9).alias("seconds"))
    return sums.withColumn("fps", F.when(F.col("seconds") >= 0.1, F.col("frames") / F.col("seconds")))


def frame_interval_stddev(df: DataFrame, at: str = "pts") -> DataFrame:
    """Sample standard deviation of the gaps between a stream's frames, in ms; 0 for under two gaps or over 1000 ms."""
    gap = (F.col(at) - F.lag(at).over(Window.partitionBy("stream_id").orderBy(at))) / 1e6
    sd = df.select("stream_id", gap.alias("gap")).groupBy("stream_id").agg(F.count("gap").alias("gaps"), F.stddev_samp("gap").alias("sd"))
    return sd.select("stream_id", F.when((F.col("gaps") < 2) | (F.col("sd") > 1000), F.lit(0.0)).otherwise(F.col("sd")).alias("stddev_ms"))


def mean_frame_latency(df: DataFrame, observed: str = "observed", timecode: str = "pts") -> DataFrame:
    """Mean of observed less timecode, overall (stream_id null) and for each stream."""
    return df.rollup("stream_id").agg(F.avg(F.col(observed) - F.col(timecode)).alias("latency"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, bucket: int, parts: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with each of parts (name: sum, min, max or count, of a column) over its key's rows so far.

    A key is sorted in buckets of `at` (a whole number that grows with the order), so its sort is many tasks'; a row a bucket
    brings what the buckets before add up to."""
    return carried_on(df.withColumn("_b", F.floor(at / bucket)), keys, order, parts)


def running_by_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: dict[str, tuple[str, Column]], rows: int = 1 << 20) -> DataFrame:
    """As `running`, in buckets of about so many rows by measured ranges of keys and order, so it is the same to it how rows lie in time and which
    keys have them. The rows are dealt and written once; rows equal in keys and order stay together."""
    n = max(1, math.ceil(df.count() / rows))
    if n == 1:
        return carried_on(df.withColumn("_b", F.lit(0)), keys, order, parts)
    ranges = [F.asc_nulls_first(c) for c in (*keys, *order)]
    return carried_on(Stored(df.repartitionByRange(n, *ranges).withColumn("_b", F.spark_partition_id())).df, keys, order, parts)


def carried_on(rows: DataFrame, keys: Sequence[str], order: Sequence[str], parts: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with parts over its key's rows so far; `_b` numbers buckets that follow one another in order."""
    keys, combine = list(keys), {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    make = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}
    here = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_b").agg(*(make[how](c).alias(f"_{n}") for n, (how, c) in parts.items()))
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), *(combine[how](f"_{n}").over(before).alias(f"_{n}") for n, (how, _) in parts.items()))
    near = rows.withColumns({n: make[how](c).over(here) for n, (how, c) in parts.items()})
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = near.join(sums, same, "left").withColumns({n: join[how](F.col(f"_{n}"), F.col(n)) for n, (how, _) in parts.items()})
    return both.drop("_b", "_kb", *(f"_k{i}" for i in range(len(keys))), *(f"_{n}" for n in parts))


HOUR = 3_600


def latency_running(trace: DataFrame, keys: Sequence[str] = ("element",), order: Sequence[str] = ("src_ts", "frame_id"), rows: int = 1 << 20) -> DataFrame:
    """Each element's latency with its mean, least and most so far, and the number of frames, in buckets of about so many rows."""
    v = F.col("latency_ms")
    out = running_by_count(trace, keys, order, {"_sum": ("sum", v), "_n": ("count", v), "min_ms": ("min", v), "max_ms": ("max", v), "frame_num": ("count", F.lit(1))}, rows)
    return out.withColumn("avg_ms", F.col("_sum") / F.col("_n")).drop("_sum", "_n")


def pipeline_latency_running(trace: DataFrame, keys: Sequence[str] = ("stream_id",), order: Sequence[str] = ("src_ts", "frame_id"), rows: int = 1 << 20) -> DataFrame:
    """latency_running, with the mean time between outputs so far and the frames a second that it gives."""
    first = trace.groupBy(*(F.col(k).alias(f"_f{i}") for i, k in enumerate(keys))).agg(F.min(F.unix_micros("src_ts")).alias("_first"))  # a row a key
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_f{i}"))
    out = latency_running(trace, keys, order, rows).join(first, same)
    out = out.withColumn("interval_ms", (F.unix_micros("src_ts") - F.col("_first")) / 1000 / F.col("frame_num")).drop("_first", *(f"_f{i}" for i in range(len(keys))))
    return out.withColumn("fps", F.when(F.col("interval_ms") > 0, 1000 / F.col("interval_ms")))


def latency_by_interval(trace: DataFrame, interval_ms: float = 1000, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Mean, least, most of each element's latency by interval; an interval ends with the first row at or past its length."""
    rows = trace.select(*keys, F.unix_micros("src_ts").alias("at"), "frame_id", "latency_ms")
    numbered = with_interval_numbers(rows, keys, "at", math.ceil(interval_ms * 1000), ("frame_id",))
    return numbered.groupBy(*keys, "interval_no").agg(F.count("*").alias("frames"), F.avg("latency_ms").alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), (F.max("at") / 1000).alias("end_ms"))


def element_hops(trace: DataFrame, keys: Sequence[str] = ("stream_id", "frame_id")) -> DataFrame:
    """Time from the previous element's push of the same frame, in ms."""
    before = F.lag("src_ts").over(Window.partitionBy(*keys).orderBy("src_ts", "element"))
    return trace.withColumn("hop_ms", (F.unix_micros("src_ts") - F.unix_micros(before)) / 1000)


def buffer_occupancy(events: DataFrame, bucket_s: int = HOUR) -> DataFrame:
    """Of +1 and -1 events (element, ts, delta, buffer_id): buffers in flight, their mean over time, distinct ones in and out.

    The time integral of what is in flight is a sum over events: each delta counts until the element's last event."""
    t = F.unix_micros("ts").cast("double") / 1e6
    ends = events.groupBy(F.col("element").alias("_e")).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))  # a row an element
    timed = events.join(ends, F.col("element").eqNullSafe(F.col("_e")))
    return timed.groupBy("element").agg(
        F.sum("delta").alias("in_flight"), (F.sum(F.col("delta") * (F.col("_last") - t)) / F.first(F.col("_last") - F.col("_first"))).alias("mean_in_flight"),
        F.countDistinct(F.when(F.col("delta") > 0, F.col("buffer_id"))).alias("buffers_in"), F.countDistinct(F.when(F.col("delta") < 0, F.col("buffer_id"))).alias("buffers_out"))


def count_objects(dets: DataFrame, by: Sequence[str] = ("label",), cube: bool = False, tracks: str | None = None, approximate: bool = False) -> DataFrame:
    """Objects, and distinct tracks, by frame, label, stream or time, or by all combinations of them."""
    grouped = dets.cube(*by) if cube else dets.groupBy(*by)
    distinct = [(F.approx_count_distinct(tracks) if approximate else F.countDistinct(tracks)).alias("tracks")] if tracks else []
    return grouped.agg(F.count("*").alias("objects"), *distinct)


def object_sketches(dets: DataFrame, tracks: str, by: Sequence[str] = ("stream_id", "label"), lg_k: int = 12) -> DataFrame:
    """Objects and a mergeable sketch of the distinct tracks by group, to be stored: coarser groups are counted from it, without the rows."""
    return dets.groupBy(*by).agg(F.count("*").alias("objects"), F.hll_sketch_agg(tracks, lg_k).alias("sketch"))


def count_sketched(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Objects and, within the sketch's error (1.04 / sqrt(2^lg_k) is one standard deviation), distinct tracks of coarser groups."""
    return sketches.groupBy(*by).agg(F.sum("objects").alias("objects"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("tracks"))


def color_histogram(images: DataFrame, bins: int = 8, slices_x: int = 1, slices_y: int = 1) -> DataFrame:
    """RGB histogram of each slice of a grid, row by row, each pixel weighted by a Gaussian about the slice's centre; bin
    B*(B*r + g) + b of channel values by 256 // B. images: frame key, height, width, pixels (binary, RGB interleaved)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                img = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3).astype(np.int64) // (256 // bins)
                index = bins * (bins * img[..., 0] + img[..., 1]) + img[..., 2]
                h, w = r.height // slices_y, r.width // slices_x
                dy, dx = (0.5 * h - np.arange(h)) / (0.5 * h), (0.5 * w - np.arange(w)) / (0.5 * w)
                weight = np.exp(-0.5 * (dy[:, None] ** 2 + dx[None, :] ** 2)).ravel()
                for y in range(slices_y):
                    for x in range(slices_x):
                        block = index[y * h : (y + 1) * h, x * w : (x + 1) * w]
                        out.append((r.stream_id, r.frame_id, y * slices_x + x, np.bincount(block.ravel(), weights=weight, minlength=bins**3).tolist()))
            yield pd.DataFrame(out, columns=["stream_id", "frame_id", "slice", "histogram"])

    return images.select("stream_id", "frame_id", "height", "width", "pixels").mapInPandas(count, "stream_id int, frame_id long, slice int, histogram array<double>")
