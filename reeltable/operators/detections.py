"""Filters and projections on detections: one row a region of interest, keyed by (stream_id, frame_id, roi_id).

Boxes are x_min, y_min, x_max, y_max as shares of the frame, or x, y, w, h in pixels. All are expressions on one row,
but for the lookups (small dimension tables) and the joins named in their docstrings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CORNERS = ("x_min", "y_min", "x_max", "y_max")
FRAME = ("stream_id", "frame_id")


def rounded(v: Column) -> Column:
    """v to the nearest whole pixel, halves up."""
    return F.floor(v + 0.5).cast("int")


def truncated(v: Column) -> Column:
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("int")


def unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def filter_confidence(df: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    return df.where(F.col("confidence") > threshold if strict else F.col("confidence") >= threshold)


def filter_object_class(df: DataFrame, classes: Sequence[str] = ()) -> DataFrame:
    """Rows of these labels; no classes, all rows."""
    return df.where(F.col("label").isin(*classes)) if classes else df


def filter_valid_roi(df: DataFrame) -> DataFrame:
    return df.where("w > 1 AND h > 1")


def split_rois(frames: DataFrame, dets: DataFrame, classes: Sequence[str] = (), emit_gaps: bool = True) -> DataFrame:
    """A row for each region of a frame that passes (unlabelled, or labelled as listed), numbered `is_last_roi`; a gap row where none does."""
    passed = dets.where(F.col("label").isNull() | F.col("label").isin(*classes)) if classes else dets
    last = F.lead("roi_id").over(Window.partitionBy(*FRAME).orderBy("roi_id")).isNull()
    rois = passed.select(*FRAME, "roi_id", "label", "x", "y", "w", "h", last.alias("is_last_roi"))
    joined = frames.select(*FRAME, "pts").join(rois, [*FRAME], "left" if emit_gaps else "inner")
    return joined.withColumns({"is_gap": F.col("roi_id").isNull(), "is_last_roi": F.coalesce("is_last_roi", F.lit(True))})


def normalize_boxes(df: DataFrame, input_w: float, input_h: float) -> DataFrame:
    """Corners given in the model's pixels become shares of its input; they are pixels if any of the four is 2 or more."""
    pixels = F.greatest(*CORNERS) >= 2
    return df.withColumns({c: F.when(pixels, F.col(c) / (input_w if c[0] == "x" else input_h)).otherwise(F.col(c)) for c in CORNERS})


def clip_boxes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: unit(F.col(c)) for c in CORNERS})


def to_absolute(df: DataFrame) -> DataFrame:
    """x, y, w, h in pixels from the corners."""
    return df.withColumns({
        "x": rounded(F.col("x_min") * F.col("width")), "y": rounded(F.col("y_min") * F.col("height")),
        "w": rounded((F.col("x_max") - F.col("x_min")) * F.col("width")), "h": rounded((F.col("y_max") - F.col("y_min")) * F.col("height"))})


def undo_preprocess(df: DataFrame, transforms: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Corners back from the model's input to the region's own shares: times input size, less padding, plus crop, by
    scale, by region size. Rows whose keys have no transform stay as they are. transforms has in_w, in_h, pad_x, pad_y, crop_x, crop_y, scale_x, scale_y, roi_w, roi_h by keys."""
    joined = df.join(transforms, [*keys], "left")
    back = lambda c, a, s: ((F.col(c) * F.col(f"in_{s}") - F.col(f"pad_{a}") + F.col(f"crop_{a}")) / F.col(f"scale_{a}")) / F.col(f"roi_{s}")
    out = joined.withColumns({c: F.when(F.col("in_w").isNull(), F.col(c)).otherwise(back(c, *(("x", "w") if c[0] == "x" else ("y", "h")))) for c in CORNERS})
    return out.select(*df.columns)


def roi_to_full_frame(dets: DataFrame, parents: DataFrame) -> DataFrame:
    """Corners that are shares of a parent region become shares of the frame; rows join their parent by frame and parent_id."""
    p = parents.select(*FRAME, F.col("roi_id").alias("parent_id"), *(F.col(c).alias(f"_p{c}") for c in "xywh"))
    joined = dets.join(p, [*FRAME, "parent_id"])
    full = lambda c, at, size, frame: (F.col(f"_p{at}") + F.col(f"_p{size}") * F.col(c)) / F.col(frame)
    return joined.withColumns({c: full(c, *(("x", "w", "width") if c[0] == "x" else ("y", "h", "height"))) for c in CORNERS}).drop("_px", "_py", "_pw", "_ph")


def apply_affine(df: DataFrame, matrix: str = "matrix") -> DataFrame:
    """Both corners through the row's 2x3 matrix (array of 6), then clipped and in pixels."""
    m = lambda i: F.get(matrix, F.lit(i))
    at = lambda k, x, y: m(3 * k) * F.col(x) + m(3 * k + 1) * F.col(y) + m(3 * k + 2)
    moved = df.withColumns({"x_min": at(0, "x_min", "y_min"), "y_min": at(1, "x_min", "y_min"), "x_max": at(0, "x_max", "y_max"), "y_max": at(1, "x_max", "y_max")})
    return to_absolute(clip_boxes(moved))


def scale_roi(df: DataFrame, roi_scale: float) -> DataFrame:
    """Corners grown or shrunk about the centre."""
    out = {}
    for a in "xy":
        lo, hi = F.col(f"{a}_min"), F.col(f"{a}_max")
        grow = (hi - lo) * (roi_scale - 1) / 2
        out |= {f"{a}_min": lo - grow, f"{a}_max": hi + grow}
    return df.withColumns(out)


def rescale_rois(df: DataFrame, out_w: int, out_h: int) -> DataFrame:
    """x, y, w, h from a branch of size (width, height) to an output of another size: clipped to the frame, truncated.

    Regions of a branch of the output's own size stay as they are; those of a branch without size have no place (null)."""
    same = (F.col("width") == out_w) & (F.col("height") == out_h)
    share = lambda a, size: F.try_divide(F.col(a), F.col(size))
    x, y = unit(share("x", "width")), unit(share("y", "height"))
    w, h = F.least(F.greatest(share("w", "width"), F.lit(0.0)), 1 - x), F.least(F.greatest(share("h", "height"), F.lit(0.0)), 1 - y)
    new = {"x": x * out_w, "y": y * out_h, "w": w * out_w, "h": h * out_h}
    return df.withColumns({c: F.when(same, F.col(c)).otherwise(truncated(F.round(v, 9))) for c, v in new.items()})


def add_region(frames: DataFrame, regions: Sequence[tuple], normalized: bool = False, label: str | None = None, confidence: float = 0.0) -> DataFrame:
    """Static regions (x, y, w, h) on every frame, clipped to it; no regions, the whole frame."""
    if not regions:
        regions, normalized = [(0.0, 0.0, 1.0, 1.0)], True
    boxes = F.array(*(F.struct(*(F.lit(float(v)).alias(c) for c, v in zip("xywh", r, strict=True))) for r in regions))
    out = frames.select("*", F.posexplode(boxes).alias("region", "_r"))
    size = {"x": "width", "y": "height", "w": "width", "h": "height"}
    px = {c: truncated(F.col(f"_r.{c}") * F.col(size[c])) if normalized else truncated(F.col(f"_r.{c}")) for c in "xywh"}
    out = out.withColumns({"x": F.least(F.greatest(px["x"], F.lit(0)), F.col("width")), "y": F.least(F.greatest(px["y"], F.lit(0)), F.col("height"))})
    out = out.withColumns({"w": F.least(px["w"], F.col("width") - F.col("x")), "h": F.least(px["h"], F.col("height") - F.col("y"))})
    out = out.withColumns({"x_min": F.try_divide("x", "width"), "y_min": F.try_divide("y", "height"), "x_max": F.try_divide(F.col("x") + F.col("w"), F.col("width")), "y_max": F.try_divide(F.col("y") + F.col("h"), F.col("height"))})
    return out.withColumns({"label": F.lit(label).cast("string"), "confidence": F.lit(float(confidence))}).drop("_r")


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """label from labels (label_id, label), empty where the id isn't in it. A label file is a small dimension; AQE decides how to join."""
    return df.drop("label").join(labels, "label_id", "left").withColumn("label", F.coalesce("label", F.lit("")))


def add_attributes(df: DataFrame, name: str, params: dict[str, str]) -> DataFrame:
    pairs = [F.lit(str(x)) for kv in params.items() for x in kv]
    return df.withColumn(name, F.create_map(*pairs))


def remove_regions(df: DataFrame, which: Column | DataFrame) -> DataFrame:
    """Without the rows that a condition holds for, or whose (frame, roi_id) is in another table."""
    if isinstance(which, DataFrame):
        return df.join(which, [*FRAME, "roi_id"], "left_anti")
    return df.where(~F.coalesce(which, F.lit(False)))


def compose_captions(cls: DataFrame) -> DataFrame:
    """One caption a region from its attributes (attribute, data): gender by the second value, age as 100 times the first,
    others by their label; joined by spaces in the attributes' order (`position`)."""
    data = F.col("data")
    word = F.when(F.col("attribute") == "gender", F.when(F.get(data, F.lit(1)) > 0.5, F.lit("M")).otherwise(F.lit("F")))
    word = word.when(F.col("attribute") == "age", truncated(F.get(data, F.lit(0)) * 100).cast("string"))
    word = word.otherwise(F.get("labels", (F.array_position(data, F.array_max(data)) - 1).cast("int")))
    rows = cls.select(*FRAME, "roi_id", F.struct("position", word.alias("word")).alias("_w"))
    words = F.transform(F.array_sort(F.collect_list("_w")), lambda x: x["word"])  # a region's few attributes
    return rows.groupBy(*FRAME, "roi_id").agg(F.array_join(words, " ").alias("caption"))
