"""Decoding raw model outputs (frame key, layer_name, dims, data) into detections, labels and texts.

Array functions on one row where they can say it; grids of cells are NumPy over Arrow batches, a row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reeltable.functions.columns import let
from reeltable.operators.detections import FRAME

BOXES = "stream_id int, frame_id long, roi_id int, x_min double, y_min double, x_max double, y_max double, confidence double, label_id int"


def rows_of(data: Column, width: int) -> Column:
    """data cut into rows of so many values."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(data) / width).cast("int") - 1), lambda i: F.slice(data, i * width + 1, width))


def decode_ssd(t: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of image id, label, confidence and corners; a negative image id ends the list."""
    rows = t.where(F.size("data") >= 7).withColumn("_rows", rows_of(F.col("data"), 7))
    end = F.array_position(F.transform("_rows", lambda r: r[0] < 0), True)
    live = rows.withColumn("_rows", F.when(end > 0, F.slice("_rows", F.lit(1), (end - 1).cast("int"))).otherwise(F.col("_rows")))
    each = live.select(*FRAME, F.posexplode("_rows").alias("roi_id", "r"))
    return each.where(F.col("r")[2] >= threshold).select(*FRAME, "roi_id", *(F.col("r")[i].alias(c) for i, c in ((3, "x_min"), (4, "y_min"), (5, "x_max"), (6, "y_max"), (2, "confidence"))), F.col("r")[1].cast("int").alias("label_id"))


def decode_boxes(boxes: DataFrame, labels: DataFrame | None = None, scores: DataFrame | None = None, input_w: float = 1.0, input_h: float = 1.0, threshold: float = 0.5, softmax: bool = False) -> DataFrame:
    """Boxes of x_min, y_min, x_max, y_max and (but with scores) confidence; with a labels layer, or with class scores
    whose greatest, times the box's own value, is the confidence."""
    width = 5
    each = boxes.where(F.size("data") >= width).select(*FRAME, F.posexplode(rows_of(F.col("data"), width)).alias("roi_id", "r"))
    conf, label = F.col("r")[4], F.lit(0)
    if labels is not None:
        each = each.join(labels.select(*FRAME, F.col("data").alias("_labels")), [*FRAME])
        label = F.get("_labels", F.col("roi_id")).cast("int")
    if scores is not None:
        s = scores.select(*FRAME, F.col("data").alias("_s"), F.col("dims").alias("_d"))
        each = each.join(s, [*FRAME]).withColumn("_n", F.element_at("_d", -1)).withColumn("_own", F.slice("_s", F.col("roi_id") * F.col("_n") + 1, F.col("_n")))
        each = each.withColumn("_own", softmaxed(F.col("_own"))) if softmax else each
        conf, label = F.array_max("_own") * F.col("r")[4], (F.array_position("_own", F.array_max("_own")) - 1).cast("int")
    size = (input_w, input_h, input_w, input_h)
    out = each.select(*FRAME, "roi_id", *((F.col("r")[i] / size[i]).alias(c) for i, c in enumerate(("x_min", "y_min", "x_max", "y_max"))), conf.alias("confidence"), label.alias("label_id"))
    return out.where(F.col("confidence") >= threshold)


def _grid(t: DataFrame, decode: Callable[[np.ndarray, Sequence[int]], np.ndarray], rotated: bool = False, input_w: float = 1.0, input_h: float = 1.0) -> DataFrame:
    """decode(data, dims) gives rows of cx, cy, w, h, confidence, label (and rotation) for each tensor; boxes are numbered in its
    order, and their corners are shares of the model's input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [decode(np.asarray(data, dtype=float), [int(x) for x in dims]) for data, dims in zip(pdf["data"], pdf["dims"], strict=True)]
            counts = np.array([len(b) for b in found], dtype=np.int64)
            if not counts.sum():
                continue
            cx, cy, w, h, conf, label = (b := np.concatenate([f for f in found if len(f)])).T[:6]
            own = np.repeat(np.arange(len(counts)), counts)  # the tensor of each box
            turned = {"rotation": b.T[6]} if rotated else {}
            keys = {k: pdf[k].take(own).reset_index(drop=True) for k in FRAME}
            yield pd.DataFrame({**keys, "roi_id": np.arange(len(own)) - (np.cumsum(counts) - counts)[own], "x_min": (cx - w / 2) / input_w, "y_min": (cy - h / 2) / input_h, "x_max": (cx + w / 2) / input_w, "y_max": (cy + h / 2) / input_h, "confidence": conf, "label_id": label.astype(int), **turned})

    return t.select(*FRAME, "dims", "data").mapInPandas(run, BOXES + ", rotation double" * rotated)


def decode_yolo_v8(t: DataFrame, threshold: float = 0.5, obb: bool = False, input_w: float = 1.0, input_h: float = 1.0) -> DataFrame:
    """[4 + C, N], transposed: centre and size in pixels of the input and class scores; the greatest must be above the threshold. obb: one row more, the angle, given as `rotation`."""

    def decode(data, dims):
        m = data.reshape(dims[-2], dims[-1]).T
        scores = m[:, 4 : m.shape[1] - obb]
        best = scores.argmax(axis=1)
        conf = scores[np.arange(len(m)), best]
        keep = conf > threshold
        return np.column_stack([m[:, :4], conf, best, *([m[:, -1]] if obb else [])])[keep]

    return _grid(t, decode, obb, input_w, input_h)


def decode_yolo_v7(t: DataFrame, threshold: float = 0.5, input_w: float = 1.0, input_h: float = 1.0) -> DataFrame:
    """[N, 5 + C], boxes in pixels of the input: objectness, and times the greatest class score, at or above the threshold."""

    def decode(data, dims):
        m = data.reshape(-1, dims[-1])
        return _scored(m[:, :4], m, threshold)

    return _grid(t, decode, input_w=input_w, input_h=input_h)


def _scored(boxes: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    best = m[:, 5:].argmax(axis=1)
    conf = m[:, 4] * m[np.arange(len(m)), 5 + best]
    keep = (m[:, 4] >= threshold) & (conf >= threshold)
    return np.column_stack([boxes, conf, best])[keep]


def decode_yolo_x(t: DataFrame, input_w: int, input_h: int, threshold: float = 0.5, strides: Sequence[int] = (8, 16, 32)) -> DataFrame:
    """[N, 5 + C] over the cells of each stride: centre = (value + cell) * stride, size = exp(value) * stride, as shares of the input."""
    cells = np.concatenate([np.stack([*np.meshgrid(np.arange(input_w // s), np.arange(input_h // s)), np.full((input_h // s, input_w // s), s)], axis=-1).reshape(-1, 3) for s in strides])

    def decode(data, dims):
        m = data.reshape(-1, dims[-1])[: len(cells)]
        g = cells[: len(m)]
        return _scored(np.column_stack([(m[:, :2] + g[:, :2]) * g[:, 2:], np.exp(m[:, 2:4]) * g[:, 2:]]), m, threshold)

    return _grid(t, decode, input_w=input_w, input_h=input_h)


def decode_yolo_grid(t: DataFrame, anchors: Sequence[float], classes: int, input_w: int, input_h: int, masks: Sequence[int] | None = None, threshold: float = 0.5, sigmoid: bool = True, softmax: bool = False) -> DataFrame:
    """[A * (5 + C), rows, cols]: a box for each cell and anchor, its centre in the cell, its size exp(value) * anchor; shares of the input."""
    pairs = np.array(anchors, dtype=float).reshape(-1, 2)
    pairs = pairs[list(masks)] if masks is not None else pairs
    squash = (lambda v: 1 / (1 + np.exp(-v))) if sigmoid else (lambda v: v)

    def decode(data, dims):
        rows, cols = dims[-2:]
        m = data.reshape(len(pairs), 5 + classes, rows, cols).transpose(2, 3, 0, 1)
        at = np.stack(np.meshgrid(np.arange(cols), np.arange(rows)), axis=-1)[:, :, None, :]
        centre = (squash(m[..., :2]) + at) / np.array([cols, rows])
        size = np.exp(m[..., 2:4]) * pairs / np.array([input_w, input_h])
        scores = np.exp(m[..., 5:] - m[..., 5:].max(axis=-1, keepdims=True)) if softmax else squash(m[..., 5:])
        scores = scores / scores.sum(axis=-1, keepdims=True) if softmax else scores
        flat = np.concatenate([centre, size, squash(m[..., 4:5]), scores], axis=-1).reshape(-1, 5 + classes)
        return _scored(flat[:, :4], flat, threshold)

    return _grid(t, decode)


def decode_yolo_v10(t: DataFrame, classes: int, threshold: float = 0.5, input_w: float = 1.0, input_h: float = 1.0) -> DataFrame:
    """Rows of corners in pixels of the input, confidence (above the threshold) and label modulo the number of classes."""
    each = t.where(F.size("data") >= 6).select(*FRAME, F.posexplode(rows_of(F.col("data"), 6)).alias("roi_id", "r"))
    return each.where(F.col("r")[4] > threshold).select(*FRAME, "roi_id", *((F.col("r")[i] / (input_w, input_h, input_w, input_h, 1.0)[i]).alias(c) for i, c in enumerate(("x_min", "y_min", "x_max", "y_max", "confidence"))), (F.col("r")[5].cast("int") % classes).alias("label_id"))


def regress_boxes(rois: DataFrame, regression: DataFrame, probability: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Regions whose score (the second of a pair) is at or above the threshold, their corners moved by regression * size."""
    keys = [*FRAME, "roi_id"]
    joined = rois.join(regression.select(*keys, F.col("data").alias("_r")), keys).join(probability.select(*keys, F.col("data").alias("_p")), keys).where(F.col("_p")[1] >= threshold)
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    moved = {c: F.col(c) + F.col("_r")[i] * (w if c[0] == "x" else h) for i, c in enumerate(("x_min", "y_min", "x_max", "y_max"))}
    return joined.withColumns({**moved, "confidence": F.col("_p")[1]}).drop("_r", "_p")


def softmaxed(data: Column) -> Column:
    """Each part is computed once a row, so the work is linear in the number of classes."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double"))
    shifted = let(F.array_max(data), lambda most: F.transform(data, lambda v: F.exp(v - most)))
    return let(shifted, lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def _spaced(words: Column) -> Column:
    """Words that aren't empty, with a space between unless one ends in white space already."""
    joined = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) == 0, a).when((F.length(a) == 0) | a.rlike(r"\s$"), F.concat(a, w)).otherwise(F.concat(a, F.lit(" "), w)))
    return joined


def classify(t: DataFrame, labels: Sequence[str], method: str = "max", threshold: float = 0.5) -> DataFrame:
    """t with label, label_id and confidence by the method: max, softmax, compound (label pairs: at or above the threshold
    the first, else above 0 the second), multi, softmax_multi or index (labels in a row until one is out of range)."""
    names = F.array(*map(F.lit, labels))
    name = lambda i: F.coalesce(F.get(names, i.cast("int")), F.lit(""))
    out = t.withColumn("_v", softmaxed(F.col("data").cast("array<double>")) if method.startswith("softmax") else F.col("data").cast("array<double>"))
    v, none = F.col("_v"), F.lit(None).cast("int")
    if method in ("max", "softmax"):
        at = F.array_position(v, F.array_max(v)) - 1
        found = {"label": name(at), "label_id": at.cast("int"), "confidence": F.array_max(v)}
    elif method == "compound":
        words = F.transform(v, lambda x, j: F.when(x >= threshold, name(j * 2)).when(x > 0, name(j * 2 + 1)).otherwise(F.lit("")))
        found = {"label": _spaced(words), "label_id": none, "confidence": F.greatest(F.array_max(v), F.lit(0.0))}
    elif method in ("multi", "softmax_multi"):
        words = F.transform(v, lambda x, j: F.when(x >= threshold, name(j)).otherwise(F.lit("")))
        found = {"label": _spaced(words), "label_id": none, "confidence": F.greatest(F.array_max(v), F.lit(0.0))}
    elif method == "index":
        whole = F.transform(v, lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.lit(-1)))
        bad = F.array_position(F.transform(whole, lambda x: (x < 0) | (x >= len(labels))), True)
        used = F.when(bad > 0, F.slice(whole, F.lit(1), (bad - 1).cast("int"))).otherwise(whole)
        found = {"label": F.when(F.array_max(used) > 0, F.array_join(F.transform(used, name), "")), "label_id": none, "confidence": F.lit(None).cast("double")}
    else:
        raise ValueError(f"no method {method}")
    return out.withColumns(found).drop("_v")


def tensor_to_text(t: DataFrame, scale: float = 1.0, precision: int = 2) -> DataFrame:
    """The values times scale, with so many decimals, joined by a comma and a space."""
    return t.withColumn("text", F.array_join(F.transform(F.col("data"), lambda v: F.format_string(f"%.{precision}f", v.cast("double") * F.lit(float(scale)))), ", "))


def _best_classes(t: DataFrame) -> DataFrame:
    """t with `_best`, the class of the greatest value of each step; dims [steps, classes]."""
    steps = F.transform(F.sequence(F.lit(0), F.element_at("dims", -2) - 1), lambda i: F.slice("data", i * F.element_at("dims", -1) + 1, F.element_at("dims", -1)))
    return t.withColumn("_best", F.transform(steps, lambda r: F.array_position(r, F.array_max(r)).cast("int") - 1))


def decode_text_steps(t: DataFrame, charset: Sequence[str], min_length: int = 3, max_length: int = 32) -> DataFrame:
    """dims [steps, classes]: the best class k of each step as charset[k], none where charset ends before k; repeats stay. At most
    max_length characters; texts of min_length or fewer are blank."""
    chars = F.array(*map(F.lit, charset))
    text = F.substring(F.array_join(F.transform("_best", lambda k: F.coalesce(F.get(chars, k), F.lit(""))), ""), 1, max_length)
    return _best_classes(t).withColumn("text", F.when(F.length(text) > min_length, text).otherwise("")).drop("_best")


def most_common_text(t: DataFrame, n: int, keys: Sequence[str] = ("stream_id", "object_id"), order: Sequence[str] = ("pts",), text: str = "text") -> DataFrame:
    """Each row's text becomes the most common of the last n readings of its key; of equally common ones the first in the alphabet."""
    last = F.collect_list(text).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0))  # at most n
    counted = let(last, lambda texts: F.array_sort(F.transform(F.array_distinct(texts), lambda x: F.struct((-F.size(F.filter(texts, lambda y: y == x))).alias("n"), x.alias("text")))))
    return t.withColumn(text, F.get(counted, F.lit(0))["text"])


def decode_text_ctc(t: DataFrame, charset: Sequence[str], min_length: int = 3) -> DataFrame:
    """dims [steps, classes]: the best class of each step, without class 0 and without repeats of the step before; texts
    under min_length are blank. Class k is charset[k - 1]."""
    rows = _best_classes(t)
    kept = F.filter("_best", lambda k, i: (k != 0) & ((i == 0) | (k != F.get("_best", i - 1))))
    text = F.array_join(F.transform(kept, lambda k: F.coalesce(F.get(F.array(*map(F.lit, charset)), k - 1), F.lit(""))), "")
    return rows.withColumn("text", F.when(F.length(text) >= min_length, text).otherwise("")).drop("_best")


def normalize_tensor(t: DataFrame, low: float = 0.0, high: float = 1.0, mean: Sequence[float] = (0.0,), std: Sequence[float] = (1.0,)) -> DataFrame:
    """Bytes to [low, high], then channel by channel (innermost) times std and plus mean."""
    n = len(mean)
    pick = lambda values, i: F.get(F.array(*map(F.lit, map(float, values))), (i % n).cast("int"))
    return t.withColumn("data", F.transform("data", lambda v, i: (v * F.lit((high - low) / 255) + F.lit(low)) * pick(std, i) + pick(mean, i)))


def create_batches(df: DataFrame, n: int, order: Sequence[str] = ("pts",), keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Rows by n: a batch's tensors in one, with the places they came from."""
    no = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / n)
    rows = df.withColumn("batch", no).withColumn("_at", F.struct(*order, "frame_id", "data"))
    lists = rows.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list("_at")).alias("_rows"))  # at most n
    return lists.select(*keys, "batch", F.transform("_rows", lambda r: r["frame_id"]).alias("frame_ids"), F.flatten(F.transform("_rows", lambda r: r["data"])).alias("data"))


def split_batch(t: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """The rows of a batched tensor, each at its own frame."""
    n = F.floor(F.size("data") / F.size("frame_ids")).cast("int")
    return t.withColumn("_n", n).select(*keys, "batch", "_n", "data", F.posexplode("frame_ids").alias("place", "frame_id")).withColumn("data", F.slice("data", F.col("place") * F.col("_n") + 1, F.col("_n"))).drop("_n")
