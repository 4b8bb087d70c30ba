"""Audio: windows over blocks of 16 kHz samples (stream_id, block, samples), labels, chunks for transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltable.operators.chains import with_interval_numbers
from reeltable.operators.monitor import running

RATE = 16_000
BLOCKS = 4_096  # blocks of a stream that are summed up in one go
NS = 62_500  # a sample's nanoseconds


def audio_windows(blocks: DataFrame, length: int, slide_s: float = 1.0, block_size: int = 1_600) -> DataFrame:
    """Windows of `length` samples; the hop is slide_s, cut to whole blocks, and the window's length if that is less.

    Each block goes to the windows that it meets, so a stream is never gathered; windows at the end that aren't full go."""
    hop = int(slide_s * RATE + 0.5)
    hop = length if hop >= length else max(block_size, hop // block_size * block_size)
    first = F.col("block") * block_size
    low = F.greatest(F.lit(0), F.ceil((first - length + 1) / F.lit(hop)))
    spread = blocks.select("stream_id", "block", "samples", F.explode(F.sequence(low.cast("long"), F.floor((first + F.size("samples") - 1) / hop).cast("long"))).alias("window")).where(F.col("window") * hop < first + F.size("samples"))
    start = F.col("window") * hop
    lo = F.greatest(F.lit(0), start - first)
    part = F.slice("samples", (lo + 1).cast("int"), F.greatest(F.lit(0), F.least(F.size("samples"), start + length - first) - lo).cast("int"))
    lists = spread.select("stream_id", "window", F.struct("block", part.alias("p")).alias("_p")).groupBy("stream_id", "window").agg(F.array_sort(F.collect_list("_p")).alias("_parts"))
    whole = lists.select("stream_id", "window", F.flatten(F.transform("_parts", lambda p: p["p"])).alias("samples")).where(F.size("samples") == length)
    return whole.withColumns({"start_ns": F.col("window") * hop * NS, "end_ns": F.col("window") * hop * NS + length * NS})


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalize_audio(windows: DataFrame) -> DataFrame:
    """(x - mean) / (population standard deviation + 1e-15)."""
    w = windows.withColumn("samples", F.col("samples").cast("array<double>")).withColumn("_m", _sum(F.col("samples")) / F.size("samples"))
    w = w.withColumn("_s", F.sqrt(_sum(F.transform("samples", lambda x: (x - F.col("_m")) * (x - F.col("_m")))) / F.size("samples")))
    return w.withColumn("samples", F.transform("samples", lambda x: (x - F.col("_m")) / (F.col("_s") + 1e-15))).drop("_m", "_s")


def audio_events(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """The best class of each window where it is at or above its label's threshold. labels: label_id (class + 1), label, threshold."""
    best = scores.withColumn("confidence", F.array_max("scores").cast("double")).withColumn("label_id", F.array_position("scores", F.array_max("scores")).cast("int"))
    return best.join(labels, "label_id").where(F.col("confidence") >= F.col("threshold")).drop("scores", "threshold")


def transcribe_chunks(blocks: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Blocks by chunk: a chunk ends with the block that makes it longer than so many seconds. Samples as shares of full scale.

    The samples up to each block are a running sum in buckets of blocks; on that scale chunks are intervals from 0, whose ends
    are found in buckets too. A chunk's blocks are put together at its end; what is left of a stream goes."""
    limit = int(seconds * RATE)
    sizes = blocks.where("block is not null").select("stream_id", "block", F.size("samples").alias("size"))
    summed = running(sizes, ("stream_id",), ("block",), F.col("block"), BLOCKS, {"_until": ("sum", F.col("size").cast("long"))})
    numbered = with_interval_numbers(summed, ("stream_id",), "_until", limit + 1, ("block",), from_zero=True).select(F.col("stream_id").alias("_s"), F.col("block").alias("_b"), "size", F.col("interval_no").alias("chunk"))
    joined = blocks.select("stream_id", "block", "samples").join(numbered, F.col("stream_id").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    lists = joined.groupBy("stream_id", "chunk").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("block", "samples"))).alias("_b"))  # of at most a chunk
    return lists.where(F.col("size") > limit).select("stream_id", "chunk", "size", F.transform(F.flatten(F.transform("_b", lambda b: b["samples"])), lambda x: x / F.lit(32768.0)).alias("samples"))
