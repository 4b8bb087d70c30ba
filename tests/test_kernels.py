"""Kernels against plain versions of their rules, and what must hold of any result."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reeltable.operators import decode, joins, overlap, tracking

BOX = st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(2, 40), st.integers(2, 40))


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(0, w) * max(0, h)
    return shared / (a[2] * a[3] + b[2] * b[3] - shared)


@pytest.mark.parametrize("per_class", [False, True])
def test_greedy_suppression(spark, per_class):
    """Random frames against a loop."""
    rng = np.random.default_rng(11)
    frames = [[(*map(int, rng.integers((0, 0, 2, 2), (60, 60, 40, 40))), int(rng.integers(0, 2)), float(rng.integers(0, 6)) / 5) for _ in range(int(rng.integers(0, 14)))] for _ in range(150)]
    rows = [(0, f, i, x, y, w, h, label, c) for f, boxes in enumerate(frames) for i, (x, y, w, h, label, c) in enumerate(boxes)]
    df = spark.createDataFrame(rows, "stream_id int, frame_id long, roi_id int, x int, y int, w int, h int, label_id int, confidence double").repartition(3)
    want = set()
    for f, boxes in enumerate(frames):
        kept = []
        for i in sorted(range(len(boxes)), key=lambda i: (-boxes[i][5], i)):
            if all(iou(boxes[i][:4], boxes[j][:4]) <= 0.5 or per_class and boxes[i][4] != boxes[j][4] for j in kept):
                kept.append(i)
        want |= {(f, i) for i in kept}
    assert {(r["frame_id"], r["roi_id"]) for r in overlap.nms(df, 0.5, per_class).collect()} == want


@given(st.lists(BOX, max_size=10))
@settings(max_examples=60, deadline=None)
def test_merged_boxes_neither_touch_nor_lose_area(boxes):
    out = overlap.merged([list(map(float, b)) for b in boxes])
    for a, b in itertools.combinations(out, 2):
        assert a[0] > b[0] + b[2] or b[0] > a[0] + a[2] or a[1] > b[1] + b[3] or b[1] > a[1] + a[3]
    for x, y, w, h in boxes:
        assert any(x >= a and y >= b and x + w <= a + c and y + h <= b + d for a, b, c, d in out)


@given(st.integers(1, 5), st.integers(0, 3), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_assignment_is_optimal(n, extra, seed):
    cost = (np.random.default_rng(seed).random((n, n + extra)) * 4 - 3).round(2)
    got = tracking.assign(cost)
    assert len(set(got.tolist())) == n
    best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(n + extra), n))
    assert sum(cost[i, c] for i, c in enumerate(got)) == pytest.approx(best)


def test_peaks():
    heat = np.zeros((8, 8))
    heat[2, 2], heat[2, 3], heat[5, 6], heat[7, 7] = 0.9, 0.5, 0.8, 0.05
    assert overlap.peaks_of(heat, 2.0, 0.1) == [(2, 2, 0.9), (6, 5, 0.8)]
    heat[4, 6] = 0.8  # equal neighbours are no strict maxima
    assert overlap.peaks_of(heat, 2.0, 0.1) == [(2, 2, 0.9)]


def drive(tracker, frames):
    return [tracker.step(int(i * 33_333_333), np.array([b for b in f if b is not None], dtype=float).reshape(-1, 4), ["car"] * sum(b is not None for b in f), [k for k, b in enumerate(f) if b is not None], [np.eye(4)[k] for k, b in enumerate(f) if b is not None]) for i, f in enumerate(frames)]


def paths(n, k=2):
    return [[(50 + 4 * i + 500 * o, 60 + 2 * i, 80, 120) for o in range(k)] for i in range(n)]


@pytest.mark.parametrize("make", [tracking.AssociationTracker, lambda: tracking.AssociationTracker(keep_predicting=True), tracking.DeepSortTracker])
def test_straight_paths_keep_their_ids(make):
    out = drive(make(), paths(30))
    of = {}
    for frame in out[5:]:
        assert len({r[1] for r in frame}) == len(frame) == 2  # ids are unique in a frame
        for r in frame:
            of.setdefault(r[0], set()).add(r[1])
    assert [len(v) for v in of.values()] == [1, 1]


def test_zero_term_states():
    frames = paths(4, 1) + [[None]] * 5 + paths(1, 1)
    out = drive(tracking.AssociationTracker(), frames)
    assert [r[2] for f in out[:4] for r in f] == ["new", "new", "tracked", "tracked"]
    assert all(not f for f in out[4:9])
    tracker = tracking.AssociationTracker()
    drive(tracker, [[(10, 10, 50, 50)], [None]])
    assert not tracker.tracks  # a new track that is missed once is dead
    drive(tracker, paths(4, 1) + [[None]] * 120)
    assert tracker.tracks
    drive(tracker, [[None]] * 1)
    assert not tracker.tracks


def test_short_term_predicts_where_nothing_is_detected():
    out = drive(tracking.AssociationTracker(keep_predicting=True), paths(10, 1) + [[None]] * 3)
    assert [len(f) for f in out[-3:]] == [1, 1, 1]
    assert out[-1][0][0] is None and out[-1][0][3] > out[-3][0][3]


def test_deep_sort_needs_features_and_confirms_after_three():
    out = drive(tracking.DeepSortTracker(), paths(4, 1))
    assert [len(f) for f in out] == [0, 0, 1, 1]


def test_motion_track_smooths_and_persists():
    t = tracking.MotionTracker()
    a, b = (np.array([[0, 0, 20, 20]], float), np.array([[4, 0, 20, 20]], float))
    assert t.step(0, a, [], []) == []
    assert t.step(1, b, [], [])[0][3:] == (2.0, 0.0, 20.0, 20.0)
    assert t.step(2, np.zeros((0, 4)), [], []) == []


def test_motion_regions_follow_the_square():
    dark = np.full((36, 64), 10, np.uint8)
    bright = dark.copy()
    bright[8:24, 24:40] = 240
    (x, y, w, h), = tracking.motion_regions(dark, bright)
    assert x <= 24 and y <= 8 and x + w >= 40 and y + h >= 24
    assert tracking.motion_regions(dark, dark) == []


def test_softmax_of_many_classes(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.sin(i + F.col("id"))).alias("data"))
    got = df.select(F.aggregate(decode.softmaxed(F.col("data")), F.lit(0.0), lambda a, x: a + x).alias("s"), decode.softmaxed(F.col("data"))[3].alias("p"), "data").collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in got)
    v = np.array(got[7]["data"])
    assert abs(got[7]["p"] - np.exp(v)[3] / np.exp(v).sum()) < 1e-12


def test_rows_without_keys_are_one_frame(spark):
    rows = [(None, None, 1, 0, 0, 10, 10, 0.9), (None, None, 2, 1, 0, 10, 10, 0.8), (1, 1, 1, 0, 0, 10, 10, None), (1, 1, 2, 1, 0, 10, 10, 0.1)]
    df = spark.createDataFrame(rows, "stream_id int, frame_id long, roi_id int, x int, y int, w int, h int, confidence double")
    kept = overlap.nms(df).collect()
    assert sorted((r["stream_id"] or 0, r["roi_id"]) for r in kept) == [(0, 1), (1, 2)]
    assert len(overlap.merge_overlapping(df).collect()) == 2


def test_the_last_row_before_goes_over_empty_buckets(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 95, "b"), (1, 205, "c"), (2, 50, "d"), (1, 10, "tie")], "k int, t long, name string")
    right = spark.createDataFrame([(1, 10, 7), (1, 30, 8), (1, 200, 9)], "k int, t long, v int")
    got = {r["name"]: r["l"]["v"] if r["l"] else None for r in joins.with_last(left, right, ["k"], "t", 20, "l").collect()}
    assert got == {"a": None, "tie": 7, "b": 8, "c": 9, "d": None}


def test_few_pairs_equal_many():
    """Assignments on plain numbers and on arrays, and the least costs by pair and by table, are the same."""
    rnd = np.random.default_rng(5)
    for _ in range(200):
        n, m = sorted(rnd.integers(1, 7, 2).tolist())
        cost = rnd.integers(-3, 9, (n, m)) / 2
        assert tracking.assign_few(cost) == tracking.assign(cost).tolist()
    boxes = [[*map(float, rnd.integers(0, 300, 2)), *map(float, rnd.integers(0, 80, 2))] for _ in range(12)]
    tracks = [tracking.Track(i, "ab"[i % 2], tracking.Motion(b), box=b, waited=0.1 * i) for i, b in enumerate([*boxes[::2], *([x + 3, y - 4, w + 1, h] for x, y, w, h in boxes)])]
    labels = ["ab"[i % 2] for i in range(12)]
    table = tracking.pair_costs(np.array(boxes), np.array([t.box for t in tracks]), np.array([t.waited for t in tracks]))
    want = {(d, t): table[d, t] for d in range(12) for t in range(len(tracks)) if table[d, t] < tracking.LIMIT and labels[d] == tracks[t].label}
    got = tracking.near_pairs(boxes, labels, tracks, True, None)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 10


def test_many_planes_at_once():
    rnd = np.random.default_rng(6)
    before, now = rnd.integers(0, 60, (2, 9, 20, 37), dtype=np.uint8)
    hot, boxes = tracking.moving_blocks(before, now, 8, 10)
    assert hot.shape == (9, len(boxes)) and hot.any()
    assert all((tracking.moving_blocks(a, b, 8, 10)[0] == h).all() for a, b, h in zip(before, now, hot, strict=True))
