"""Joins that don't grow with the square or the length of what they join, against plain loops; rows that are degenerate."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reeltable.operators import decode, detections, joins, nearest, overlap, tracking
from reeltable.sources import frames as sources

BOX = "stream_id int, frame_id long, roi_id int, x int, y int, w int, h int, label string, width int, height int"


def shared(a, b):
    return max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) * max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))


def test_crowded_frames_equal_all_pairs(spark):
    rnd = random.Random(1)
    rows = [(1, f, i, rnd.randrange(-700, 3_000), rnd.randrange(-50, 2_000), rnd.choice([0, 1, 30, 200, 900]), rnd.choice([0, 1, 40, 513, 1_024]), "a", 0, 0) for f in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, BOX)
    pairs = {(a[1], a[2], b[2]): shared(a, b) / (a[5] * a[6] + b[5] * b[6] - shared(a, b)) for a in rows for b in rows if a[1] == b[1] and a[2] < b[2] and shared(a, b)}
    got = [((r["frame_id"], r["roi_a"], r["roi_b"]), r["iou"]) for r in overlap.iou_pairs(df).collect()]
    assert len(got) == len(pairs) and dict(got) == pytest.approx(pairs) and len(pairs) > 300
    most = {a[1:3]: max((shared(a, b) / (a[5] * a[6]) for b in rows if b[1] == a[1] and b[2] != a[2] and a[5] * a[6]), default=0.0) for a in rows}
    assert {(r["frame_id"], r["roi_id"]): r["occlusion"] for r in overlap.occlusion_ratio(df).collect()} == pytest.approx(most)


def test_dyadic_nodes_make_up_the_interval(spark):
    cases = [(0, 0), (5, 5), (0, 7), (1, 6), (3, 17), (-9, 4), (-1, 0), (-8, -1), (1_000_003, 5_000_000), (7, 8)]
    df = spark.createDataFrame(cases, "a long, b long").select("a", "b", joins.dyadic(F.col("a"), F.col("b")).alias("n"))
    for r in df.collect():
        parts = sorted((n["place"] << n["level"], (n["place"] + 1) << n["level"]) for n in r["n"])
        assert parts[0][0] == r["a"] and parts[-1][1] == r["b"] + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * math.log2(r["b"] - r["a"] + 2) + 1


def test_intervals_of_all_lengths_equal_all_pairs(spark):
    rnd = random.Random(2)
    second = 1_000_000_000
    frames = [(s, i, at, rnd.choice([0, second // 30, 5 * second, 900 * second])) for s in (1, 2) for i, at in enumerate(sorted(rnd.randrange(0, 2_000 * second) for _ in range(60)))]
    metas = []
    for i in range(150):
        start = rnd.randrange(-50, 2_050) * second + rnd.choice([0, 1, 17])
        metas.append((rnd.choice([1, 2]), "c", i, start, start + rnd.choice([0, 1, second, 50 * second, 10**6 * second, -second]), 1, 1, 1, 1, 10, 10))
    f = spark.createDataFrame(frames, "stream_id int, frame_id long, pts long, duration long")
    m = spark.createDataFrame(metas, "stream_id int, branch string, meta_id int, start long, end long, x int, y int, w int, h int, width int, height int")
    want = sorted((a[0], a[1], b[2]) for a in frames for b in metas if a[0] == b[0] and b[3] <= b[4] and b[4] >= a[2] and b[3] < a[2] + a[3])
    got = sorted((r["stream_id"], r["frame_id"], r["meta_id"]) for r in joins.merge_branches_interval(f, m).collect())
    assert got == want and len(want) > 1_000


@pytest.mark.parametrize("metric, limit", [("cosine", 0.05), ("cosine", 0.9), ("bhattacharyya", 0.2)])
def test_nearest_equals_all_pairs(spark, metric, limit):
    """Clusters, equal vectors, zero vectors, vectors of another length, few centres."""
    rnd = random.Random(3)
    seeds = [[rnd.random() for _ in range(6)] for _ in range(12)]
    def one(i):  # noqa: E306
        v = [max(0.0, x + rnd.gauss(0, 0.05)) for x in rnd.choice(seeds)]
        return (i, i % 2, [0.0] * 6 if i % 37 == 0 else v[:4] if i % 29 == 0 else seeds[0] if i % 11 == 0 else v)
    rows = [one(i) for i in range(400)]
    df = spark.createDataFrame(rows, "roi_id int, class_id int, feature array<double>").repartition(3)
    q, g = df.where("roi_id % 10 = 0"), df.where("roi_id % 10 <> 0")
    pairs = q.alias("q").join(g.alias("g"), "class_id").select("class_id", "q.roi_id", F.col("g.roi_id").alias("gallery_id"), joins.feature_distance(F.col("q.feature"), F.col("g.feature"), metric).alias("d"))
    want = {}
    for r in pairs.collect():
        want.setdefault(r["roi_id"], []).append((r["d"], r["gallery_id"]))
    want = {k: min(v)[0] for k, v in want.items() if min(v)[0] <= limit}
    for cells in (1, 7, 1_024):
        got = {r["roi_id"]: (r["distance"], r["gallery_id"]) for r in nearest.nearest(q, g, ["class_id"], metric, limit, cells).collect()}
        assert {k: v[0] for k, v in got.items()} == pytest.approx(want, abs=1e-12) and len(want) > 10
    far = joins.match_features(q, g, metric=metric, max_distance=1.0)
    assert far.count() == 40
    assert joins.match_features(q, g.limit(0)).collect() == []


def test_degenerate_rows_stop_no_job(spark):
    rows = [(1, 1, i, 0, 0, w, h, "a", 0, 0) for i, (w, h) in enumerate([(0, 0), (0, 5), (4, 4), (0, 0), (None, 3)])]
    df = spark.createDataFrame(rows, BOX)
    for boxes in (df, df.limit(0)):
        n = boxes.count()
        assert overlap.iou_pairs(boxes).collect() == []
        assert [r["occlusion"] for r in overlap.occlusion_ratio(boxes).collect()] == [0.0] * n
        assert overlap.filter_in_boundary(boxes).collect() == []
        assert detections.rescale_rois(boxes, 640, 480).count() == n
        scored = boxes.withColumns({"confidence": F.lit(0.5), "label_id": F.lit(1)})
        assert overlap.nms(scored).count() >= (n > 0) and overlap.nms_union_min(scored, "min").count() >= (n > 0)
        tracks = boxes.where("w is not null").withColumnsRenamed({"roi_id": "track_id"}).withColumn("waited", F.lit(0.0))
        assert tracking.association_cost(boxes, tracks).count() >= n
        assert tracking.assign_ids_by_iou(boxes, tracks).count() == n
        assert detections.add_region(boxes.select("stream_id", "frame_id", "width", "height"), []).count() == n
        at = boxes.withColumn("pts", F.col("roi_id").cast("long"))
        for follow in (tracking.track_zero_term, tracking.track_short_term, tracking.track_deep_sort, tracking.motion_track):
            follow(at, at.select("stream_id", "pts").distinct()).collect()
    doc = '{"resolution": {"width": 0, "height": 0}, "objects": [{"x": 1, "y": 2, "w": 3, "h": 4}]}'
    docs = spark.createDataFrame([(doc,)], "t string").select(F.from_json("t", sources.FRAME).alias("d")).select("d.*")
    (row,) = sources.explode_objects(docs).collect()
    assert (row["x"], row["x_min"]) == (1, None)
    assert decode.__doc__
