"""Overlap, suppression and merging of the boxes of one frame.

Joins are on the frame, and suppression is a fold over its list of boxes. Merging takes whole Arrow batches of sorted
frames; a frame that goes on in the next batch is finished there. A frame has few boxes, whatever the number of frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltable.functions.tables import dealt
from reeltable.operators.detections import FRAME


def intersection(a: str, b: str) -> Column:
    """Shared area of the pixel boxes of two aliases."""
    side = lambda at, size: F.greatest(F.lit(0).cast("long"), F.least(F.col(f"{a}.{at}") + F.col(f"{a}.{size}"), F.col(f"{b}.{at}") + F.col(f"{b}.{size}")).cast("long") - F.greatest(F.col(f"{a}.{at}"), F.col(f"{b}.{at}")))
    return side("x", "w") * side("y", "h")


def area(a: str) -> Column:
    return F.col(f"{a}.w").cast("long") * F.col(f"{a}.h")


CELL = 512  # pixels


def overlapping(df: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) of a frame's boxes that share an area, roi_a <> roi_b. Boxes meet in the cells of a grid that they lie in, and a pair counts
    where its shared part begins, so a crowded frame costs what its overlaps are, not the square of its boxes."""
    box = df.where("w > 0 AND h > 0").select(*FRAME, "roi_id", "x", "y", "w", "h")
    lies = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size) - 1) / cell))
    spread = box.withColumn("_cx", F.explode(lies("x", "w"))).withColumn("_cy", F.explode(lies("y", "h")))
    a, b = spread.alias("a"), spread.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*FRAME, "_cx", "_cy")]
    begins = lambda at: F.floor(F.greatest(F.col(f"a.{at}"), F.col(f"b.{at}")) / cell)
    return a.join(b, [*same, F.col("a.roi_id") != F.col("b.roi_id")]).where((begins("x") == F.col("a._cx")) & (begins("y") == F.col("a._cy")) & (intersection("a", "b") > 0))


def iou_pairs(df: DataFrame, min_iou: float = 0.0) -> DataFrame:
    """Pairs (roi_a < roi_b) of a frame's boxes with IoU above min_iou (0 or more). Boxes without area make no pair."""
    shared = intersection("a", "b")
    pairs = overlapping(df).where("a.roi_id < b.roi_id")
    return pairs.select("a.stream_id", "a.frame_id", F.col("a.roi_id").alias("roi_a"), F.col("b.roi_id").alias("roi_b"), (shared / (area("a") + area("b") - shared)).alias("iou")).where(F.col("iou") > min_iou)


def occlusion_ratio(df: DataFrame) -> DataFrame:
    """Of each box, the largest share that another box of the frame covers; 0 of a box without area."""
    most = overlapping(df).groupBy(*(F.col(f"a.{k}").alias(k) for k in (*FRAME, "roi_id"))).agg(F.max(intersection("a", "b") / area("a")).alias("occlusion"))
    return df.select(*FRAME, "roi_id").distinct().join(most, [*FRAME, "roi_id"], "left").withColumn("occlusion", F.coalesce("occlusion", F.lit(0.0)))


def filter_in_boundary(df: DataFrame, min_ratio: float = 0.75) -> DataFrame:
    """Boxes of which at least that share lies in the frame; of a box without area, none does."""
    seen = lambda at, size, frame: F.greatest(F.lit(0), F.least(F.col(at) + F.col(size), F.col(frame)) - F.greatest(F.col(at), F.lit(0)))
    inside = seen("x", "w", "width").cast("long") * seen("y", "h", "height")
    return df.where(F.coalesce(F.try_divide(inside, F.col("w").cast("long") * F.col("h")), F.lit(0.0)) >= min_ratio)


def frame_starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Where rows of another key begin; equal nulls are one key."""
    new = np.zeros(len(pdf), dtype=bool)
    new[:1] = True
    for k in keys:
        v = pd.factorize(pdf[k], use_na_sentinel=False)[0]
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def frames_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel over each key's rows, in order; one shuffle by key."""
    keys = list(keys)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            starts = frame_starts(pdf, keys)
            rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
            done = [kernel(pdf.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if rest is not None and len(rest):
            yield kernel(rest)

    return dealt(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(scan, schema)


def _suppress(df: DataFrame, limit: float, inclusive: int = 0, denominator: str = "union", per_class: bool = False) -> DataFrame:
    """The greedy rule over a frame's list of boxes, best first: a box is kept if no kept one is over it. A frame has few boxes, so its
    list is short; it goes through built-in functions, with the rest of its rows beside it."""
    score, roi = F.coalesce(F.col("confidence").cast("double"), F.lit(float("-inf"))), F.coalesce(F.col("roi_id"), F.lit(-1))
    box = F.struct(score.alias("score"), roi.alias("roi"), *(F.col(c).cast("double").alias(c) for c in "xywh"), (F.col("label_id") if per_class else F.lit(None).cast("int")).alias("label"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))

    def over(a: Column, b: Column) -> Column:
        side = lambda at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]) + inclusive)
        area = lambda v: (v["w"] + inclusive) * (v["h"] + inclusive)
        shared = side("x", "w") * side("y", "h")
        below = F.least(area(a), area(b)) if denominator == "min" else area(a) + area(b) - shared
        hit = shared / F.when(below > 0, below).otherwise(1.0) > limit
        return hit & a["label"].eqNullSafe(b["label"]) if per_class else hit

    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["roi"] < b["roi"], -1).when(a["roi"] > b["roi"], 1).otherwise(0)
    lists = df.groupBy(*FRAME).agg(F.array_sort(F.collect_list(box), order).alias("_boxes"))
    kept = F.aggregate("_boxes", F.slice("_boxes", 1, 0), lambda k, b: F.when(F.exists(k, lambda o: over(o, b)), k).otherwise(F.concat(k, F.array(b))))
    return lists.select(F.explode(kept).alias("_k")).select("_k.row.*")


def nms(df: DataFrame, iou_threshold: float = 0.5, per_class: bool = False) -> DataFrame:
    """Non-maximum suppression: best confidence first (ties by roi_id), later boxes with IoU above the threshold go."""
    return _suppress(df, iou_threshold, per_class=per_class)


def nms_union_min(df: DataFrame, mode: str = "union", threshold: float = 0.5) -> DataFrame:
    """nms with inclusive pixels, by the union or by the smaller box."""
    return _suppress(df, threshold, inclusive=1, denominator=mode)


def merged(boxes: list[list[float]]) -> list[list[float]]:
    """Boxes (x, y, w, h) after absorbing what overlaps or touches, until nothing does."""
    todo, again = [[x, y, x + w, y + h] for x, y, w, h in boxes], True
    while again:
        again, out = False, []
        for b in todo:
            for o in out:
                if b[0] <= o[2] and o[0] <= b[2] and b[1] <= o[3] and o[1] <= b[3]:
                    o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3])]
                    again = True
                    break
            else:
                out.append(b)
        todo = out
    return [[a, b, c - a, d - b] for a, b, c, d in todo]


def merge_overlapping(df: DataFrame) -> DataFrame:
    """One row for each bounding union of a frame's boxes that overlap or touch. A batch's boxes are lists that a frame is cut from; a frame that goes on in the next
    batch is held until there."""
    columns = ("stream_id", "frame_id", "roi_id", "x", "y", "w", "h")

    def unions(streams: list, frames: list, boxes: list[list[float]], starts: list[int]) -> pd.DataFrame:
        out = [(streams[a], frames[a], i, *r) for a, b in zip(starts[:-1], starts[1:], strict=True) for i, r in enumerate(sorted(merged(boxes[a:b])) if b - a > 1 else boxes[a:b])]
        return pd.DataFrame(out, columns=columns).astype({"stream_id": "Int64", "frame_id": "Int64", **dict.fromkeys("xywh", int)})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(pdf):
                starts = frame_starts(pdf, FRAME).tolist()
                rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
                yield told(pdf, starts)
        if rest is not None and len(rest):
            yield told(rest, [0, len(rest)])

    def told(pdf: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        keys = ([None if pd.isna(v) else int(v) for v in pdf[k]] if pdf[k].isna().any() else pdf[k].tolist() for k in FRAME)
        return unions(*keys, pdf[["x", "y", "w", "h"]].to_numpy(dtype=float).tolist(), starts)

    return dealt(df.select(*FRAME, "roi_id", "x", "y", "w", "h"), *FRAME).sortWithinPartitions(*FRAME, "roi_id").mapInPandas(scan, "stream_id int, frame_id long, roi_id int, x int, y int, w int, h int")


def peaks_of(heat: np.ndarray, min_distance: float, threshold: float) -> list[tuple[int, int, float]]:
    """(x, y, value) of strict 4-neighbour maxima above threshold, in x order (then y), none nearer than min_distance to a kept one before it."""
    p = np.pad(np.where(heat > threshold, heat, 0), 1)
    c = p[1:-1, 1:-1]
    top = (c > 0) & (c > p[:-2, 1:-1]) & (c > p[2:, 1:-1]) & (c > p[1:-1, :-2]) & (c > p[1:-1, 2:])
    kept: list[tuple[int, int, float]] = []
    for x, y in sorted((int(x), int(y)) for y, x in np.argwhere(top)):
        if all((x - a) ** 2 + (y - b) ** 2 >= min_distance**2 for a, b, _ in kept):
            kept.append((x, y, float(heat[y, x])))
    return kept


def find_peaks(heat_maps: DataFrame, min_distance: float, threshold: float = 0.1) -> DataFrame:
    """Peaks of each heat map (frame key, map_id, rows, cols, data), numbered from 0."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(r.stream_id, r.frame_id, r.map_id, i, *p) for r in pdf.itertuples() for i, p in enumerate(peaks_of(np.asarray(r.data, dtype=float).reshape(r.rows, r.cols), min_distance, threshold))],
                               columns=["stream_id", "frame_id", "map_id", "peak_id", "x", "y", "score"])

    return heat_maps.mapInPandas(scan, "stream_id int, frame_id long, map_id int, peak_id int, x int, y int, score double")
