"""Joins of frames with metadata of other branches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reeltable.functions.tables import Stored
from reeltable.operators.detections import FRAME, rescale_rois
from reeltable.operators.nearest import dot, nearest, total

SECOND = 1_000_000_000


def attach_rois_by_timestamp(frames: DataFrame, rois: DataFrame, order: str = "entry") -> DataFrame:
    """rois whose pts is the frame's own; of several entries with one pts the first counts."""
    first = rois.withColumn("_n", F.row_number().over(Window.partitionBy("stream_id", "pts").orderBy(order))).where("_n = 1").drop("_n")
    return frames.join(first, ["stream_id", "pts"], "left")


def attach_rois_in_order(frames: DataFrame, entries: DataFrame, loop: bool = False) -> DataFrame:
    """The n-th frame takes the n-th of entries (entry from 0); with loop they are taken in turn. Past the end, nothing."""
    n = entries.count() if loop else 0
    place = F.col("frame_num") % F.lit(max(n, 1)) if loop else F.col("frame_num")
    return frames.withColumn("entry", place).join(entries, "entry", "left")


def with_last(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, bucket: int, into: str = "last") -> DataFrame:
    """left with the last row of right at or before it in `into` (a struct of right's columns but keys; null where there is none).

    A key is sorted in time buckets, so its sort is many tasks'. A row before its bucket's first right row takes the last one of
    the buckets before; of those, one row each is sorted by key. `at` is a number; of right rows at one time the greatest counts."""
    keys = list(keys)
    value = F.struct(F.col(at), *(F.col(c) for c in right.columns if c not in (*keys, at)))
    slot = F.floor(F.col(at) / bucket)
    r = right.select(*keys, at, value.alias(into), slot.alias("_b"), F.lit(0).alias("_side"))
    both = left.withColumns({"_b": slot, "_side": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy(at, "_side", into).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn(into, F.last(into, ignorenulls=True).over(w)).where("_side = 1").drop("_side")
    marks = r.groupBy(*keys, "_b").agg(F.max(into).alias(into)).unionByName(left.select(*keys, slot.alias("_b")).distinct(), allowMissingColumns=True).groupBy(*keys, "_b").agg(F.max(into).alias(into))  # a row a bucket
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*keys, "_b", F.last(into, ignorenulls=True).over(before).alias("_before"))
    return near.join(carried, [*keys, "_b"], "left").withColumn(into, F.coalesce(into, "_before")).drop("_b", "_before")


def merge_meta_asof(frames: DataFrame, metas: DataFrame, bucket_ns: int = 60 * SECOND) -> DataFrame:
    """Each metadata row goes to the first frame of its stream at or after its pts; gap rows go nowhere, and rows after the last
    frame are left out. Counted backwards from the end, that frame is the last one at or before the row."""
    f = frames.select("stream_id", (-F.col("pts")).alias("_back"), F.col("pts"), F.col("frame_id").alias("id"))
    m = metas.where(~F.coalesce("is_gap", F.lit(False))).withColumn("_back", -F.col("pts"))
    out = with_last(m, f, ["stream_id"], "_back", bucket_ns, "_to").where("_to is not null")
    return out.withColumns({"frame_id": F.col("_to.id"), "frame_pts": F.col("_to.pts")}).drop("_to", "_back")


def attach_tensors_to_rois(dets: DataFrame, tensors: DataFrame) -> DataFrame:
    """Each tensor with the region it is of (roi_id), or with the frame (roi_id null or 0)."""
    keyed = tensors.withColumn("roi_id", F.when(F.col("roi_id") != 0, F.col("roi_id")))
    return keyed.join(dets, [*FRAME, "roi_id"], "left")


def dyadic(low: Column, high: Column) -> Column:
    """The fewest nodes of the binary tree over whole numbers, (level, place), that make up [low, high]: two a level at most."""
    end, up = high + 1, F.lit(-1)
    over = lambda l: F.call_function("shiftright", up * low, l) * up  # noqa: E731, E741  rounded up
    under = lambda l: F.call_function("shiftright", end, l)  # noqa: E731, E741
    node = lambda there, l, place: F.when(there, F.array(F.struct(l.alias("level"), place.alias("place")))).otherwise(F.array().cast("array<struct<level:int,place:bigint>>"))  # noqa: E731, E741
    at = lambda l: F.concat(node((over(l) < under(l)) & (F.pmod(over(l), F.lit(2)) == 1), l, over(l)), node((over(l) < under(l)) & (F.pmod(under(l), F.lit(2)) == 1), l, under(l) - 1))  # noqa: E731, E741
    levels = F.sequence(F.lit(0), F.floor(F.log2((end - low).cast("double")) + 1e-9).cast("int"))
    return F.flatten(F.transform(levels, at))


def in_nodes(df: DataFrame, low: str, high: str, cell_ns: int, names: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """df with the cell of `low` and a row for each node of [low, high] (first, level and place as named), written, and the levels that there are: at most 63."""
    cell = lambda c: F.floor(F.col(c) / cell_ns).cast("long")
    first, level, place = names
    rows = df.withColumns({first: cell(low), "_node": F.explode(dyadic(cell(low), cell(high)))}).withColumns({level: F.col("_node.level"), place: F.col("_node.place")}).drop("_node")
    rows = Stored(rows).df
    return rows, sorted(r[0] for r in rows.select(level).distinct().collect())


def meeting(frames: tuple[DataFrame, list[int]], closed: tuple[DataFrame, list[int]]) -> DataFrame:
    """Pairs of frames and closed intervals of a stream (by `in_nodes`) whose cells of time overlap, each pair once.

    Both are told in nodes of a tree over the cells, so an interval has about two rows for each doubling of its length. Of two that overlap, one has a node
    inside a node of the other: each side asks the levels that the other has above its own nodes. The pair counts where the smaller node
    holds the cell in which both have begun."""
    (f, f_levels), (m, m_levels) = frames, closed
    above = lambda df, own, place, of: df.withColumn("_l", F.explode(F.array(*map(F.lit, of)) if of else F.array().cast("array<int>"))).where(F.col("_l") >= F.col(own)).withColumn("_p", F.call_function("shiftright", F.col(place), F.col("_l") - F.col(own)))
    begun = F.greatest("_f0", "_m0")
    met = above(f, "_fl", "_fp", m_levels).join(m.withColumns({"_l": F.col("_ml"), "_p": F.col("_mp")}), ["stream_id", "_l", "_p"]).where(F.call_function("shiftright", begun, F.col("_fl")) == F.col("_fp"))
    if f_levels and m_levels and max(f_levels) > min(m_levels):  # else no frame has a node above an interval's
        outer = above(m, "_ml", "_mp", f_levels).where("_l > _ml").join(f.withColumns({"_l": F.col("_fl"), "_p": F.col("_fp")}), ["stream_id", "_l", "_p"]).where(F.call_function("shiftright", begun, F.col("_ml")) == F.col("_mp"))
        met = met.unionByName(outer)
    return met.drop("_l", "_p", "_f0", "_m0", "_fl", "_fp", "_ml", "_mp")


def merge_branches_interval(frames: DataFrame, metas: DataFrame, out_w: int | None = None, out_h: int | None = None, bucket_ns: int = SECOND) -> DataFrame:
    """Metadata whose interval meets a frame's: end >= start of the frame and start < its end. Rows without an end hold until
    the next row of their stream and branch starts, so a frame has those of the last start at or before it, and those that
    start in it. Rows with an end meet frames at nodes of a tree over time buckets; held ones are found by the last start, so both
    cost little however long they last. All joins are on equal keys."""
    f = frames.select("stream_id", "frame_id", "pts", (F.col("pts") + F.col("duration")).alias("_f_end"))
    closed = metas.where(F.col("end").isNotNull() & (F.col("start") <= F.col("end")))
    told = in_nodes(f, "pts", "_f_end", bucket_ns, ("_f0", "_fl", "_fp"))
    met = meeting(told, in_nodes(closed, "start", "end", bucket_ns, ("_m0", "_ml", "_mp"))).where((F.col("end") >= F.col("pts")) & (F.col("start") < F.col("_f_end"))).drop("_f_end")
    held = metas.where(F.col("end").isNull())
    starts = metas.select("stream_id", "branch", "start").distinct()
    cell = F.floor(F.col("start") / bucket_ns).cast("long")
    begun = meeting(told, (starts.withColumns({"_m0": cell, "_ml": F.lit(0), "_mp": cell}), [0])).where((F.col("start") > F.col("pts")) & (F.col("start") < F.col("_f_end"))).select("stream_id", "branch", "start", "frame_id", "pts")
    branches = held.select("stream_id", "branch").distinct()  # few of a stream
    asked = f.join(branches, "stream_id").select("stream_id", "branch", "frame_id", F.col("pts").alias("at"), "pts")
    last = with_last(asked, starts.withColumn("at", F.col("start")), ["stream_id", "branch"], "at", 60 * bucket_ns, "_l").where("_l is not null")
    shown = last.select("stream_id", "branch", F.col("_l.start").alias("start"), "frame_id", "pts").unionByName(begun)
    out = met.unionByName(held.join(shown, ["stream_id", "branch", "start"]))
    return rescale_rois(out, out_w, out_h) if out_w and out_h else out


def match_same_region(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of regions of a frame with equal label, x, y, w, h; equal nulls match."""
    c = [(F.col(f"a.{k}") == F.col(f"b.{k}")) for k in FRAME] + [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("label", "x", "y", "w", "h")]
    return a.alias("a").join(b.alias("b"), c).select("a.stream_id", "a.frame_id", F.col("a.roi_id").alias("roi_a"), F.col("b.roi_id").alias("roi_b"))


def parent_child(dets: DataFrame) -> DataFrame:
    """Each region with its parent region of the same frame."""
    p = dets.select(*FRAME, F.col("roi_id").alias("parent_id"), F.col("label").alias("parent_label"))
    return dets.join(p, [*FRAME, "parent_id"])


def feature_distance(a, b, metric: str = "cosine"):
    """Cosine distance of vectors, or Bhattacharyya's of histograms: one less the coefficient. 1 where lengths differ or one is empty or zero."""
    if metric == "cosine":
        d = F.coalesce(1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(1.0))
    else:
        mixed = total(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))))
        d = F.when((total(a) > 1e-4) & (total(b) > 1e-4), 1 - mixed / F.sqrt(total(a) * total(b))).otherwise(F.lit(1.0))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(1.0))


def match_features(query: DataFrame, gallery: DataFrame, block: Sequence[str] = ("class_id",), metric: str = "cosine", max_distance: float = 0.2) -> DataFrame:
    """The nearest gallery feature of each query row, within its block (class, stream), and at most max_distance away; equal
    distances go to the smallest gallery_id.

    Distances under 1 are found by an inverted file (`nearest`). From 1 on also features without likeness match, so all of a block's pairs are looked at."""
    if max_distance < 1:
        return nearest(query, gallery, block, metric, max_distance)
    g = gallery.select(*block, F.col("roi_id").alias("gallery_id"), F.col("feature").alias("_g"))
    pairs = query.join(g, [*block]).select(*block, "roi_id", F.struct(feature_distance(F.col("feature"), F.col("_g"), metric).alias("distance"), "gallery_id").alias("_m"))
    best = pairs.groupBy(*block, "roi_id").agg(F.min("_m").alias("_m"))
    return best.select(*block, "roi_id", F.col("_m.gallery_id").alias("gallery_id"), F.col("_m.distance").alias("distance")).where(F.col("distance") <= max_distance)


def gate_by_trigger(controlled: DataFrame, triggers: DataFrame, label: str, order: str = "pts", bucket: int = 60 * SECOND) -> DataFrame:
    """Controlled frames pass while the last object seen before has the label; of a trigger frame's objects the last decides."""
    t = triggers.groupBy("stream_id", order).agg(F.max_by("label", "roi_id").alias("label"))
    return with_last(controlled, t, ["stream_id"], order, bucket, "_l").where(F.col("_l.label") == label).drop("_l")
