"""Values known beforehand."""

import json

import pytest
from pyspark.sql import functions as F

from reeltable.jobs import registry
from reeltable.functions import user
from reeltable.operators import audio, decode, detections, joins, sampling
from reeltable.sources import frames as S


def frame(spark, **more):
    base = {"stream_id": 0, "frame_id": 1, "pts": 0, "width": 640, "height": 480} | more
    return spark.createDataFrame([tuple(base.values())], "stream_id int, frame_id long, pts long, width int, height int")


@pytest.mark.parametrize(("branch", "out", "box", "want"), [((320, 240), (640, 480), (150, 150, 50, 50), (300, 300, 100, 100)), ((640, 480), (320, 240), (300, 300, 100, 100), (150, 150, 50, 50)), ((320, 240), (320, 240), (7, 7, 900, 9), (7, 7, 900, 9))])
def test_branch_scaling(spark, branch, out, box, want):
    df = spark.createDataFrame([(*branch, *box)], "width int, height int, x int, y int, w int, h int")
    assert tuple(detections.rescale_rois(df, *out).select("x", "y", "w", "h").first()) == want


def test_oversize_rois_end_inside(spark):
    df = spark.createDataFrame([(320, 240, 300, 200, 500, 500)], "width int, height int, x int, y int, w int, h int")
    x, y, w, h = detections.rescale_rois(df, 640, 480).select("x", "y", "w", "h").first()
    assert x + w <= 640 and y + h <= 480


def test_detection_json(spark):
    det = spark.createDataFrame([(0, 1, 5, 188, 261, 72, 191, 0.29375, 0.54375, 0.40625, 0.94167, 0.8, 0, "person", 0, -1, "not json")], "stream_id int, frame_id long, roi_id int, x int, y int, w int, h int, x_min double, y_min double, x_max double, y_max double, confidence double, label_id int, label string, object_id int, parent_id int, extra_params string")
    cls = spark.createDataFrame([(0, 1, 5, "color", "l1", "m", "red", 2, 0.9), (0, 1, None, None, "scene", "m2", "street", 1, 0.7)], "stream_id int, frame_id long, roi_id int, attribute_name string, layer_name string, model_name string, label string, label_id int, confidence double")
    got = json.loads(S.frames_to_json(frame(spark), det, cls, source="test_src", tags={"tag_key": "tag_val"}).first()["json"])
    assert got["resolution"] == {"width": 640, "height": 480} and got["source"] == "test_src" and got["tags"] == {"tag_key": "tag_val"} and got["timestamp"] == 0
    first, whole = got["objects"]
    assert "id" not in first and "parent_id" not in first and "extra_params" not in first
    assert first["color"] == {"label": "red", "model": {"name": "m"}, "confidence": 0.9, "label_id": 2}
    assert first["detection"]["bounding_box"]["x_min"] == 0.29375
    assert whole == {"x": 0, "y": 0, "w": 640, "h": 480, "scene": {"label": "street", "model": {"name": "m2"}, "confidence": 0.7, "label_id": 1}}
    empty = det.limit(0)
    assert S.frames_to_json(frame(spark), empty).count() == 0
    bare = json.loads(S.frames_to_json(frame(spark), empty, add_empty_results=True).first()["json"])
    assert set(bare) == {"resolution", "timestamp"}


def test_extra_params_and_tensors(spark):
    det = spark.createDataFrame([(0, 1, 5, 1, 2, 3, 4, 0.0, 0.0, 0.5, 0.5, 0.8, 0, "", 7, 3, '{"a": 1}')], "stream_id int, frame_id long, roi_id int, x int, y int, w int, h int, x_min double, y_min double, x_max double, y_max double, confidence double, label_id int, label string, object_id int, parent_id int, extra_params string")
    t = spark.createDataFrame([(0, 1, 5, "FP32", "NC", [1, 2], "t", "", "l", None, "", 0.5, 1, [0.1, 0.2]), (0, 1, None, "U8", "", [1], "f", "", "", None, "x", None, None, [3.0])], "stream_id int, frame_id long, roi_id int, precision string, layout string, dims array<int>, name string, model_name string, layer_name string, format string, label string, confidence double, label_id int, data array<double>")
    got = json.loads(S.frames_to_json(frame(spark), det, tensors=t, add_tensor_data=True).first()["json"])
    assert got["objects"][0]["id"] == 7 and got["objects"][0]["parent_id"] == 3 and got["objects"][0]["extra_params"] == {"a": 1} and "roi_type" not in got["objects"][0]
    assert got["objects"][0]["tensors"][0]["data"] == [0.1, 0.2] and got["tensors"][0]["label"] == "x"
    with pytest.raises(Exception, match="precision Q78"):
        t.withColumn("precision", F.lit("Q78")).select(F.to_json(S.tensor_struct())).collect()


def test_json_files_round_trip(spark, tmp_path):
    df = frame(spark).select(F.to_json(F.struct(F.struct("width", "height").alias("resolution"), F.col("pts").alias("timestamp"))).alias("json"))
    two = df.union(df).coalesce(1)
    S.write_json_lines(two, str(tmp_path / "lines"))
    S.write_json_array(two, str(tmp_path / "array"))
    (tmp_path / "lines" / "blank.txt").write_text("\n\n")
    assert S.read_frames_jsonl(spark, str(tmp_path / "lines")).count() == 2
    assert S.read_frames_json_array(spark, str(tmp_path / "array")).count() == 2


def test_audio_event_json(spark):
    e = spark.createDataFrame([(0, 0, 2_200_000_000, 3_200_000_000, "Speech", 0.999, 53)], "stream_id int, block_id long, start long, end long, event_type string, confidence double, label_id int")
    got = json.loads(S.audio_events_to_json(e).first()["json"])
    assert got["channels"] == 1 and got["rate"] == 16000
    assert got["events"][0]["detection"] == {"segment": {"start_timestamp": 2_200_000_000, "end_timestamp": 3_200_000_000}, "confidence": 0.99, "label_id": 53, "label": "Speech"}


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.678901",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert df.select(S.system_timestamp(F.col("t"))).first()[0] == "2024-01-02T03:04:05.678Z"
    assert df.select(S.system_timestamp(F.col("t"), True, "Asia/Kolkata")).first()[0] == "2024-01-02T08:34:05.678901:+0530"


@pytest.mark.parametrize(("frames", "interval", "want"), [([0, 1], 3, [True, False]), ([0, 1, 2, 3, 4], 4, [True, False, False, False, True]), ([0, 5, 9], 0, [True, False, False]), ([0, 1, 2], 1, [True, True, True])])
def test_reclassify_rules(spark, frames, interval, want):
    df = spark.createDataFrame([(0, 1, f) for f in frames], "stream_id int, object_id int, frame_num long")
    assert [r["classify"] for r in sampling.needs_reclassify(df, interval).orderBy("frame_num").collect()] == want


@pytest.mark.parametrize(("num", "den"), [(1, 3), (2, 5), (3, 3)])
def test_rate_adjust_keeps_the_rate(spark, num, den):
    df = spark.createDataFrame([(0, 1, f) for f in range(23)], "stream_id int, object_id int, frame_num long")
    kept = [r["frame_num"] for r in sampling.rate_adjust(df, num, den).collect()]
    for k in range(1, 24):
        assert sum(f < k for f in kept) == -(-k * num // den)


def test_dropping_frames_equals_dropping_metadata(spark):
    f = spark.createDataFrame([(0, i, i * 10, i) for i in range(12)], "stream_id int, frame_id long, pts long, frame_num long")
    m = f.select("stream_id", F.col("frame_id").alias("meta_id"), "pts", F.lit(False).alias("is_gap"))
    half = sampling.pass_drop(f, 1, 1)
    a = joins.merge_meta_asof(half, m.where("meta_id % 2 = 0")).select("meta_id", "frame_id")
    b = joins.merge_meta_asof(f, sampling.pass_drop(m, 1, 1)).select("meta_id", "frame_id")
    assert sorted(a.collect()) == sorted(b.collect())


def test_ssd_list_ends_at_a_bad_row(spark):
    data = [0, 1, 0.9, 0, 0, 1, 1, -1, 1, 0.9, 0, 0, 1, 1, 0, 1, 0.9, 0, 0, 1, 1]
    t = spark.createDataFrame([(0, 1, [float(v) for v in data])], "stream_id int, frame_id long, data array<double>")
    assert decode.decode_ssd(t).count() == 1


def test_grid_decoders_put_boxes_in_cells(spark):
    rows = spark.createDataFrame([(0, 1, [5, 6], [0.5, 0.5, 0.0, 0.0, 1.0, 1.0] + [0.0] * 24)], "stream_id int, frame_id long, dims array<int>, data array<double>")
    r = decode.decode_yolo_x(rows, 16, 16, 0.5, (8, 16)).first()
    assert (r["x_min"], r["y_min"], r["x_max"], r["y_max"], r["confidence"]) == (0.0, 0.0, 0.5, 0.5, 1.0)
    grid = [0.0] * (6 * 4)
    grid[4 * 4 + 3] = 9.0  # objectness of the last of 2 x 2 cells
    grid[5 * 4 + 3] = 9.0
    t = spark.createDataFrame([(0, 1, [6, 2, 2], grid)], "stream_id int, frame_id long, dims array<int>, data array<double>")
    r = decode.decode_yolo_grid(t, (16, 32), 1, 64, 64).first()
    assert (r["x_min"], r["y_min"], r["x_max"], r["y_max"]) == pytest.approx((0.625, 0.5, 0.875, 1.0))


def test_oriented_boxes_have_their_angle(spark):
    # Two boxes of two classes: rows are cx, cy, w, h, two scores, angle.
    data = [4.0, 9.0, 5.0, 9.0, 2.0, 2.0, 4.0, 4.0, 0.2, 0.1, 0.9, 0.3, 1.5, 0.5]
    t = spark.createDataFrame([(0, 1, [7, 2], data)], "stream_id int, frame_id long, dims array<int>, data array<double>")
    (r,) = decode.decode_yolo_v8(t, obb=True).collect()
    assert (r["x_min"], r["y_min"], r["x_max"], r["y_max"], r["confidence"], r["label_id"], r["rotation"]) == (3.0, 3.0, 5.0, 7.0, 0.9, 1, 1.5)


@pytest.mark.parametrize(("softmax", "want"), [(False, 0.72), (True, 0.8 / (1 + 2.718281828459045**-0.8))])
def test_boxes_with_class_scores(spark, softmax, want):
    boxes = spark.createDataFrame([(0, 1, [0.0, 0.0, 10.0, 20.0, 0.8])], "stream_id int, frame_id long, data array<double>")
    scores = spark.createDataFrame([(0, 1, [1, 2], [0.1, 0.9])], "stream_id int, frame_id long, dims array<int>, data array<double>")
    (r,) = decode.decode_boxes(boxes, scores=scores, input_w=20, input_h=40, softmax=softmax).collect()
    assert (r["x_max"], r["y_max"], r["label_id"], r["confidence"]) == (0.5, 0.5, 1, pytest.approx(want))


def test_short_texts_of_ctc_are_blank(spark):
    step = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    make = lambda ks: (0, len(ks), [len(ks), 4], [v for k in ks for v in step(k)])
    t = spark.createDataFrame([make([1, 1, 0, 1, 2]), make([1, 1, 2])], "stream_id int, frame_id long, dims array<int>, data array<double>")
    assert {r["frame_id"]: r["text"] for r in decode.decode_text_ctc(t, list("abc")).collect()} == {5: "aab", 3: ""}


def test_captions_and_regions(spark):
    f = frame(spark)
    got = detections.add_region(f, [(0.0, 0.1, 0.3, 0.5)], normalized=True).select("x", "y", "w", "h").first()
    assert tuple(got) == (0, 48, 192, 240)
    assert tuple(detections.add_region(f, []).select("x", "y", "w", "h").first()) == (0, 0, 640, 480)


def test_windows_of_blocks(spark):
    blocks = spark.createDataFrame([(0, b, list(range(b * 1600, b * 1600 + 1600))) for b in range(12)], "stream_id int, block long, samples array<int>")
    w = audio.audio_windows(blocks, 8000, 0.25).orderBy("window").collect()
    assert [r["samples"][0] for r in w] == [0, 3200, 6400, 9600]
    assert all(r["samples"] == list(range(r["samples"][0], r["samples"][0] + 8000)) for r in w)
    assert w[1]["start_ns"] == 3200 * 62_500 and w[1]["end_ns"] == w[1]["start_ns"] + 8000 * 62_500


def test_user_code(spark, tmp_path):
    import sys

    (tmp_path / "mine.py").write_text("class Keep:\n    def __init__(self, least):\n        self.least = least\n    def process_frame(self, frame):\n        frame['pts'] += 1\n        return frame['pts'] > self.least\n")
    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "mine.py"))
    f = frame(spark).union(frame(spark, pts=10))
    got = user.apply_python(f, "mine", cls="Keep", kwargs={"least": 5}).collect()
    assert [r["pts"] for r in got] == [11]


def test_audio_windows_sql_has_every_window():
    """The SQL counts windows of a stream of any length; it stopped at 10,000."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 0::BIGINT AS user_id, 'view' AS event_type, 1.0 AS value FROM range(0, 320032) AS t(i)")
    con.sql("CREATE TABLE orders (o_custkey BIGINT, o_orderkey BIGINT)")
    con.sql("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_shipdate TIMESTAMP)")
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, label INT, embedding FLOAT[])")
    assert con.sql(f'SELECT count(*), max("window") FROM ({registry.ORACLES["audio_windows"]})').fetchall() == [(10_000, 9_999)]
    con.sql("INSERT INTO events SELECT i, TIMESTAMP '2024-01-01' + to_seconds(i), 0, 'view', 1.0 FROM range(320032, 320064) AS t(i)")
    assert con.sql(f'SELECT count(*), max("window") FROM ({registry.ORACLES["audio_windows"]})').fetchall() == [(10_001, 10_000)]


def test_json_lines_are_compressed(spark, tmp_path):
    df = frame(spark).select(F.to_json(F.struct(F.struct("width", "height").alias("resolution"), F.col("pts").alias("timestamp"))).alias("json"))
    S.write_json_lines(df, str(tmp_path / "lines"))
    assert {p.suffix for p in (tmp_path / "lines").glob("part-*")} == {".gz"} and S.read_frames_jsonl(spark, str(tmp_path / "lines")).count() == 1
