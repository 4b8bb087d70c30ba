"""Queries of the decoders, labels, audio and the per-frame JSON."""

from pyspark.sql import functions as F

from reeltable.jobs.detections_queries import dets, nms_sql, wanted
from reeltable.jobs.registry import query
from reeltable.operators import audio as U
from reeltable.operators import decode as D
from reeltable.operators import overlap as N
from reeltable.sources import frames as S
from reeltable.sources.views import view

VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def vectors(s, d):
    """Embeddings as model outputs: 64 values."""
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.select((F.col("vec_id") % 16).cast("int").alias("stream_id"), F.col("vec_id").cast("long").alias("frame_id"), F.col("embedding").cast("array<double>").alias("data"))


def ssd(s, d):
    """Seven values a region, written by inverting the rules; region 9 ends the list."""
    row = F.array(F.when(F.col("roi_id") == 9, -1.0).otherwise(0.0), F.col("label_id").cast("double"), F.col("confidence"), "x_min", "y_min", "x_max", "y_max")
    return dets(s, d).groupBy("stream_id", "frame_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("roi_id", row.alias("r")))), lambda x: x["r"])).alias("data"))


BOXCOLS = "round(x_min + 1e-9, 6) AS x_min, round(y_max + 1e-9, 6) AS y_max, round(confidence + 1e-9, 6) AS confidence"


def boxcols():
    return [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("x_min", "y_max", "confidence")]


@query("decode_ssd", f"SELECT stream_id, frame_id, roi_id - 1 AS roi_id, {BOXCOLS}, label_id FROM detections WHERE roi_id < 9 AND confidence >= 0.5")
def decode_ssd(s, d):
    return D.decode_ssd(ssd(s, d)).select("stream_id", "frame_id", "roi_id", *boxcols(), "label_id")


@query("decode_boxes", f"SELECT stream_id, frame_id, roi_id - 1 AS roi_id, {BOXCOLS}, label_id FROM detections WHERE confidence >= 0.5")
def decode_boxes(s, d):
    x = dets(s, d)
    row = F.array("x_min", "y_min", "x_max", "y_max", "confidence")
    layer = lambda c: x.groupBy("stream_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("roi_id", c.alias("r")))), lambda v: v["r"]).alias("data"))
    boxes = layer(row).withColumn("data", F.flatten("data"))
    return D.decode_boxes(boxes, labels=layer(F.col("label_id").cast("double"))).select("stream_id", "frame_id", "roi_id", *boxcols(), "label_id")


@query("decode_yolo_v10", f"SELECT stream_id, frame_id, roi_id - 1 AS roi_id, {BOXCOLS}, label_id % 3 AS label_id FROM detections WHERE confidence > 0.5")
def decode_yolo_v10(s, d):
    row = F.array("x_min", "y_min", "x_max", "y_max", "confidence", F.col("label_id").cast("double"))
    t = dets(s, d).groupBy("stream_id", "frame_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("roi_id", row.alias("r")))), lambda x: x["r"])).alias("data"))
    return D.decode_yolo_v10(t, 3).select("stream_id", "frame_id", "roi_id", *boxcols(), "label_id")


@query("decode_yolo_v8", f"""SELECT stream_id, frame_id, CAST(row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY roi_id) - 1 AS INT) AS roi_id, {BOXCOLS}, label_id FROM detections WHERE confidence > 0.5""")
def decode_yolo_v8(s, d):
    scores = [F.when(F.col("label_id") == k, F.col("confidence")).otherwise(0.0) for k in range(4)]
    row = F.array((F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2, F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), *scores)
    t = dets(s, d).groupBy("stream_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("roi_id", row.alias("r")))), lambda x: x["r"]).alias("_rows"))
    t = t.select("stream_id", "frame_id", F.array(F.lit(8), F.size("_rows")).alias("dims"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform("_rows", lambda r: F.get(r, k)))).alias("data"))
    return D.decode_yolo_v8(t).select("stream_id", "frame_id", "roi_id", *boxcols(), "label_id")


@query("decode_yolo_v7", f"""SELECT stream_id, frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY i) - 1 AS INT) AS roi_id, round(m[1] - m[3] / 2 + 1e-9, 6) AS x_min, round(m[2] + m[4] / 2 + 1e-9, 6) AS y_max, round(conf + 1e-9, 6) AS confidence, CAST(list_position(m[6:8], list_max(m[6:8])) - 1 AS INT) AS label_id
FROM (SELECT *, m[5] * list_max(m[6:8]) AS conf FROM (SELECT CAST(vec_id % 16 AS INT) AS stream_id, vec_id AS frame_id, i, list_transform(v[i * 8 + 1:i * 8 + 8], lambda x: abs(x) * 8) AS m FROM (SELECT vec_id, {VEC} AS v FROM embeddings), range(0, 8) AS t(i))) WHERE m[5] >= 0.3 AND conf >= 0.3""")
def decode_yolo_v7(s, d):
    t = vectors(s, d).withColumns({"data": F.transform("data", lambda v: F.abs(v) * 8), "dims": F.array(F.lit(8), F.lit(8))})
    return D.decode_yolo_v7(t, 0.3).select("stream_id", "frame_id", "roi_id", *boxcols(), "label_id")


ARGMAX = "CAST(list_position({0}, list_max({0})) - 1 AS INT)"


@query("decode_yolo_x", f"""SELECT stream_id, frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY i) - 1 AS INT) AS roi_id, round(((m[1] + gx) * s - exp(m[3]) * s / 2) / 16 + 1e-9, 6) AS x_min, round(((m[2] + gy) * s + exp(m[4]) * s / 2) / 24 + 1e-9, 6) AS y_max,
round(conf + 1e-9, 6) AS confidence, {ARGMAX.format("m[6:8]")} AS label_id FROM (SELECT *, m[5] * list_max(m[6:8]) AS conf, CASE WHEN i < 6 THEN 8 ELSE 12 END AS s, CASE WHEN i < 6 THEN i % 2 ELSE 0 END AS gx, CASE WHEN i < 6 THEN i // 2 ELSE i - 6 END AS gy
FROM (SELECT CAST(vec_id % 16 AS INT) AS stream_id, vec_id AS frame_id, i, list_transform(v[i * 8 + 1:i * 8 + 8], lambda x: abs(x) * 5) AS m FROM (SELECT vec_id, {VEC} AS v FROM embeddings), range(0, 8) AS t(i))) WHERE m[5] >= 0.1 AND conf >= 0.1""")
def decode_yolo_x(s, d):
    """Eight cells of eight values: six of stride 8 and two of stride 12 over an input of 16 by 24."""
    t = vectors(s, d).withColumns({"data": F.transform("data", lambda v: F.abs(v) * 5), "dims": F.array(F.lit(8), F.lit(8))})
    return D.decode_yolo_x(t, 16, 24, 0.1, (8, 12)).select("stream_id", "frame_id", "roi_id", *boxcols(), "label_id")


@query("decode_yolo_grid", f"""SELECT stream_id, frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY n) - 1 AS INT) AS roi_id, round((q[1] + x) / 2 - exp(z[3]) * aw / 64 / 2 + 1e-9, 6) AS x_min, round((q[2] + y) / 2 + exp(z[4]) * ah / 64 / 2 + 1e-9, 6) AS y_max,
round(conf + 1e-9, 6) AS confidence, {ARGMAX.format("q[6:8]")} AS label_id FROM (SELECT *, q[5] * list_max(q[6:8]) AS conf FROM (SELECT *, list_transform(z, lambda c: 1 / (1 + exp(-c))) AS q FROM (
SELECT CAST(vec_id % 16 AS INT) AS stream_id, vec_id AS frame_id, n, n // 4 AS y, n // 2 % 2 AS x, CASE n % 2 WHEN 0 THEN 10 ELSE 16 END AS aw, CASE n % 2 WHEN 0 THEN 13 ELSE 30 END AS ah,
  list_transform(range(0, 8), lambda k: v[((n % 2 * 8 + k) * 2 + n // 4) * 2 + n // 2 % 2 + 1]) AS z FROM (SELECT vec_id, {VEC} AS v FROM embeddings), range(0, 8) AS t(n)))) WHERE q[5] >= 0.2 AND conf >= 0.2""")
def decode_yolo_grid(s, d):
    """Two anchors of 5 values and 3 classes in 2 by 2 cells."""
    t = vectors(s, d).withColumn("dims", F.array(F.lit(16), F.lit(2), F.lit(2)))
    return D.decode_yolo_grid(t, (10, 13, 16, 30), 3, 64, 64, threshold=0.2).select("stream_id", "frame_id", "roi_id", *boxcols(), "label_id")


@query("regress_boxes", """SELECT stream_id, frame_id, roi_id, round(x_min + 0.1 * (x_max - x_min) + 1e-9, 5) AS x_min, round(y_max - 0.2 * (y_max - y_min) + 1e-9, 5) AS y_max, confidence FROM detections WHERE confidence >= 0.7""")
def regress_boxes(s, d):
    x = dets(s, d)
    key = ["stream_id", "frame_id", "roi_id"]
    reg = x.select(*key, F.array(*map(F.lit, (0.1, 0.0, 0.0, -0.2))).alias("data"))
    prob = x.select(*key, F.array(1 - F.col("confidence"), F.col("confidence")).alias("data"))
    return D.regress_boxes(x.drop("confidence"), reg, prob).select(*key, F.round(F.col("x_min") + 1e-9, 5).alias("x_min"), F.round(F.col("y_max") + 1e-9, 5).alias("y_max"), "confidence")


LABELS = [f"c{i}" for i in range(64)]


@query("classify_max", f"SELECT vec_id AS frame_id, 'c' || CAST(list_position(v, list_max(v)) - 1 AS VARCHAR) AS label, CAST(list_position(v, list_max(v)) - 1 AS INT) AS label_id, round(list_max(v), 6) AS confidence FROM (SELECT vec_id, {VEC} AS v FROM embeddings)")
def classify_max(s, d):
    return D.classify(vectors(s, d), LABELS, "max").select("frame_id", "label", "label_id", F.round("confidence", 6).alias("confidence"))


@query("classify_softmax", f"""SELECT vec_id AS frame_id, 'c' || CAST(list_position(v, list_max(v)) - 1 AS VARCHAR) AS label, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS confidence FROM (SELECT vec_id, {VEC} AS v FROM embeddings)""")
def classify_softmax(s, d):
    return D.classify(vectors(s, d), LABELS, "softmax").select("frame_id", "label", F.round("confidence", 6).alias("confidence"))


@query("classify_multi", f"""SELECT vec_id AS frame_id, array_to_string(list_transform(list_filter(range(1, 65), lambda i: v[i] >= 0.2), lambda i: 'c' || CAST(i - 1 AS VARCHAR)), ' ') AS label, round(greatest(list_max(v), 0), 6) AS confidence FROM (SELECT vec_id, {VEC} AS v FROM embeddings)""")
def classify_multi(s, d):
    return D.classify(vectors(s, d), LABELS, "multi", 0.2).select("frame_id", "label", F.round("confidence", 6).alias("confidence"))


@query("classify_compound", f"""SELECT vec_id AS frame_id, array_to_string(list_transform(list_filter(range(1, 65), lambda i: v[i] > 0), lambda i: CASE WHEN v[i] >= 0.1 THEN 'is' ELSE 'maybe' END || CAST(i - 1 AS VARCHAR)), ' ') AS label FROM (SELECT vec_id, {VEC} AS v FROM embeddings)""")
def classify_compound(s, d):
    return D.classify(vectors(s, d), [f"{w}{i}" for i in range(64) for w in ("is", "maybe")], "compound", 0.1).select("frame_id", "label")


@query("classify_index", f"""SELECT vec_id AS frame_id, CASE WHEN list_max(u) > 0 THEN array_to_string(list_transform(u, lambda x: chr(CAST(97 + x AS INT))), '') END AS label FROM (
  SELECT vec_id, CASE WHEN list_position(b, true) > 0 THEN list_slice(w, 1, list_position(b, true) - 1) ELSE w END AS u FROM (
    SELECT vec_id, w, list_transform(w, lambda x: x < 0 OR x >= 8) AS b FROM (SELECT vec_id, list_transform({VEC}, lambda x: CASE WHEN x * 40 >= 0 THEN floor(x * 40) WHEN x > -0.05 THEN 0 ELSE -1 END) AS w FROM embeddings)))""")
def classify_index(s, d):
    t = vectors(s, d).withColumn("data", F.transform("data", lambda v: F.when((v < 0) & (v > -0.05), 0.0).otherwise(v * 40)))
    return D.classify(t, list("abcdefgh"), "index").select("frame_id", "label")


@query("tensor_to_text", f"SELECT vec_id AS frame_id, array_to_string(list_transform({VEC}, lambda x: format('{{:.2f}}', round(x * 10 + 100.001, 2))), ', ') AS text FROM embeddings")
def tensor_to_text(s, d):
    t = vectors(s, d).withColumn("data", F.transform("data", lambda v: F.round(v * 10 + 100.001, 2)))
    return D.tensor_to_text(t).select("frame_id", "text")


@query("decode_text_ctc", f"""SELECT vec_id AS frame_id, CASE WHEN len(t) >= 3 THEN t ELSE '' END AS text FROM (SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 17), lambda i: b[i] <> 0 AND (i = 1 OR b[i] <> b[i - 1])), lambda i: substr('xyz', CAST(b[i] AS INT), 1)), '') AS t FROM (
  SELECT vec_id, list_transform(range(0, 16), lambda i: list_position(v[i * 4 + 1:i * 4 + 4], list_max(v[i * 4 + 1:i * 4 + 4])) - 1) AS b FROM (SELECT vec_id, {VEC} AS v FROM embeddings)))""")
def decode_text_ctc(s, d):
    return D.decode_text_ctc(vectors(s, d).withColumn("dims", F.array(F.lit(16), F.lit(4))), list("xyz")).select("frame_id", "text")


@query("decode_text_steps", f"""SELECT vec_id AS frame_id, CASE WHEN len(t) > 3 THEN t ELSE '' END AS text FROM (SELECT vec_id, substr(array_to_string(list_transform(b, lambda k: CASE WHEN k < 3 THEN substr('xyz', CAST(k + 1 AS INT), 1) ELSE '' END), ''), 1, 32) AS t FROM (
  SELECT vec_id, list_transform(range(0, 16), lambda i: list_position(v[i * 4 + 1:i * 4 + 4], list_max(v[i * 4 + 1:i * 4 + 4])) - 1) AS b FROM (SELECT vec_id, {VEC} AS v FROM embeddings)))""")
def decode_text_steps(s, d):
    return D.decode_text_steps(vectors(s, d).withColumn("dims", F.array(F.lit(16), F.lit(4))), list("xyz")).select("frame_id", "text")


@query("most_common_text", """, w AS (SELECT stream_id, frame_num, frame_id, unnest(list(label) OVER (PARTITION BY stream_id, object_id ORDER BY frame_num ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS label FROM objects),
c AS (SELECT stream_id, frame_id, label, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY n DESC, label) AS k FROM c)
SELECT stream_id, frame_id, label FROM r WHERE k = 1""")
def most_common_text(s, d):
    return D.most_common_text(view(s, d, "objects"), 5, order=("frame_num",), text="label").select("stream_id", "frame_id", "label")


@query("normalize_tensor", f"""SELECT vec_id AS frame_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i] / 255 * CASE i % 2 WHEN 1 THEN 2.0 ELSE 3.0 END + CASE i % 2 WHEN 1 THEN 0.5 ELSE 0.25 END)), 6) AS total FROM (SELECT vec_id, {VEC} AS v FROM embeddings)""")
def normalize_tensor(s, d):
    t = D.normalize_tensor(vectors(s, d), mean=(0.5, 0.25), std=(2.0, 3.0))
    return t.select("frame_id", F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("create_batches", """SELECT stream_id, frame_num // 4 AS batch, array_to_string(list(frame_id ORDER BY pts), ',') AS frame_ids, CAST(sum(frame_num) AS DOUBLE) AS total FROM frames GROUP BY ALL""")
def create_batches(s, d):
    t = view(s, d, "frames").withColumn("data", F.array(F.col("frame_num").cast("double")))
    return D.create_batches(t, 4).select("stream_id", "batch", F.array_join(F.col("frame_ids").cast("array<string>"), ",").alias("frame_ids"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("split_batch", "SELECT stream_id, frame_id, CAST(frame_num AS DOUBLE) AS value FROM frames")
def split_batch(s, d):
    t = view(s, d, "frames").withColumn("data", F.array(F.col("frame_num").cast("double"), F.lit(0.0)))
    return D.split_batch(D.create_batches(t, 4)).select("stream_id", "frame_id", F.col("data")[0].alias("value"))


def blocks(s, d):
    """events as audio: 16 values a block, for each of 8 streams."""
    o = view(s, d, "objects").select("stream_id", "frame_num", (F.col("frame_id") % 97).cast("smallint").alias("v"))
    return o.groupBy("stream_id", F.floor(F.col("frame_num") / 16).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_num", "v"))), lambda x: x["v"]).alias("samples")).where(F.size("samples") == 16)


SAMPLES = """, full_ AS (SELECT stream_id, frame_num // 16 AS block FROM objects GROUP BY ALL HAVING count(*) = 16), smp AS (SELECT o.stream_id, o.frame_num AS i, CAST(o.frame_id % 97 AS DOUBLE) AS v FROM objects o JOIN full_ f ON o.stream_id = f.stream_id AND o.frame_num // 16 = f.block)"""


@query("audio_windows", SAMPLES + """ SELECT s.stream_id, k AS "window", sum(v) AS total, k * 32 * 62500 AS start_ns, k * 32 * 62500 + 40 * 62500 AS end_ns FROM (SELECT stream_id, i, v, i // 32 - j AS k FROM smp, range(0, 2) AS t(j)) s WHERE k >= 0 AND i < k * 32 + 40 GROUP BY ALL HAVING count(*) = 40""")
def audio_windows(s, d):
    w = U.audio_windows(blocks(s, d), 40, 0.0021, 16)
    return w.select("stream_id", "window", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"), "start_ns", "end_ns")


@query("normalize_audio", SAMPLES + """, m AS (SELECT stream_id, i // 16 AS "window", avg(v) AS m, stddev_pop(v) AS sd, max(v) AS top FROM smp GROUP BY ALL) SELECT stream_id, "window", round((top - m) / (sd + 1e-15), 5) AS top FROM m""")
def normalize_audio(s, d):
    w = U.normalize_audio(blocks(s, d).select("stream_id", F.col("block").alias("window"), "samples"))
    return w.select("stream_id", "window", F.round(F.array_max("samples"), 5).alias("top"))


@query("audio_events", f"""SELECT vec_id AS frame_id, CAST(k AS INT) AS label_id, 'c' || CAST(k - 1 AS VARCHAR) AS label, round(top, 6) AS confidence FROM (SELECT vec_id, list_position(v, list_max(v)) AS k, list_max(v) AS top FROM (SELECT vec_id, {VEC} AS v FROM embeddings)) WHERE top >= CASE k % 2 WHEN 0 THEN 0.2 ELSE 0.3 END""")
def audio_events(s, d):
    labels = s.createDataFrame([(i + 1, f"c{i}", 0.3 if i % 2 == 0 else 0.2) for i in range(64)], "label_id int, label string, threshold double")
    return U.audio_events(vectors(s, d).withColumnRenamed("data", "scores"), labels).select("frame_id", "label_id", "label", F.round("confidence", 6).alias("confidence"))


@query("transcribe_chunks", """, full_ AS (SELECT stream_id, frame_num // 16 AS block, sum(frame_id % 97) AS v FROM objects GROUP BY ALL HAVING count(*) = 16), n AS (SELECT stream_id, (row_number() OVER (PARTITION BY stream_id ORDER BY block) - 1) // 4 AS chunk, v FROM full_)
SELECT stream_id, chunk, 64 AS size, round(sum(v) / 32768, 8) AS total FROM n GROUP BY ALL HAVING count(*) = 4""")
def transcribe_chunks(s, d):
    c = U.transcribe_chunks(blocks(s, d), 0.0035)
    return c.select("stream_id", "chunk", F.col("size").cast("int").alias("size"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 8).alias("total"))


DOCUMENT = """SELECT stream_id, frame_id, width, height, pts, roi_id, label, label_id, x, y, w, h, round(x_min + 1e-9, 6) AS x_min, round(y_min + 1e-9, 6) AS y_min, round(x_max + 1e-9, 6) AS x_max, round(y_max + 1e-9, 6) AS y_max, confidence, CAST(row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY roi_id) - 1 AS INT) AS position FROM best"""


def documents(s, d):
    """De-duplicated persons and vehicles of each frame as JSON."""
    return S.frames_to_json(view(s, d, "frames"), N.nms(wanted(s, d)))


@query("frames_json", nms_sql(DOCUMENT))
def frames_json(s, d):
    """The documents' values, read from their text."""
    from reeltable.schemas import FRAME

    docs = documents(s, d).select("stream_id", "frame_id", F.from_json("json", FRAME).alias("d")).select("stream_id", "frame_id", "d.resolution.width", "d.resolution.height", F.col("d.timestamp").alias("pts"), F.posexplode("d.objects").alias("position", "o"))
    box = F.col("o.detection.bounding_box")
    return docs.select("stream_id", "frame_id", "width", "height", "pts", "position", F.col("o.region_id").alias("roi_id"), F.col("o.roi_type").alias("label"), "o.detection.label_id", *(F.col(f"o.{c}").alias(c) for c in "xywh"),
                       *(F.round(box[c] + 1e-9, 6).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")), "o.detection.confidence")


@query("explode_objects", """SELECT stream_id, frame_id, roi_id, label, confidence, round(x_max + 1e-9, 6) AS x_max FROM detections""")
def explode_objects(s, d):
    """Documents made from the detections and read again give the detections."""
    from reeltable.schemas import FRAME

    docs = S.frames_to_json(view(s, d, "frames"), dets(s, d)).select("stream_id", "frame_id", F.from_json("json", FRAME).alias("d")).select("stream_id", "frame_id", "d.*")
    return S.explode_objects(docs).select("stream_id", "frame_id", F.col("region_id").alias("roi_id"), "label", "confidence", F.round(F.col("x_max") + 1e-9, 6).alias("x_max"))


@query("audio_events_json", """SELECT stream_id, frame_num // 64 AS block_id, frame_num * 1000 AS start, frame_num * 1000 + 100 AS end_, label, object_id AS label_id, trunc(attr_value * 100) / 100 AS confidence, 1 AS channels, 16000 AS rate FROM objects WHERE attr_value IS NOT NULL""")
def audio_events_json(s, d):
    """The documents' values, read from their text."""
    o = view(s, d, "objects").where("attr_value is not null")
    e = o.select("stream_id", F.floor(F.col("frame_num") / 64).alias("block_id"), (F.col("frame_num") * 1000).alias("start"), (F.col("frame_num") * 1000 + 100).alias("end"), F.col("label").alias("event_type"), F.col("attr_value").alias("confidence"), F.col("object_id").alias("label_id"))
    schema = "channels int, rate int, events array<struct<event_type string, detection struct<segment struct<start_timestamp long, end_timestamp long>, confidence double, label_id int, label string>>>"
    docs = S.audio_events_to_json(e).select("stream_id", "block_id", F.from_json("json", schema).alias("d")).select("stream_id", "block_id", "d.channels", "d.rate", F.explode("d.events").alias("e"))
    return docs.select("stream_id", "block_id", "channels", "rate", F.col("e.detection.segment.start_timestamp").alias("start"), F.col("e.detection.segment.end_timestamp").alias("end_"), "e.detection.label", "e.detection.label_id", "e.detection.confidence")


@query("transcripts_json", """SELECT stream_id, frame_id, label AS text, attr_value AS confidence, frame_num AS timestamp FROM objects WHERE attr_value > 1e-6""")
def transcripts_json(s, d):
    """The documents' values, read from their text."""
    o = view(s, d, "objects").withColumns({"roi_id": F.lit(None).cast("int"), "confidence": F.col("attr_value"), "pts": F.col("frame_num")})
    return S.transcripts_to_json(o).select("stream_id", "frame_id", F.from_json("json", "text string, confidence double, timestamp long").alias("d")).select("stream_id", "frame_id", "d.*")


@query("system_timestamp", "SELECT frame_id, strftime(src_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ms, strftime(src_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS us FROM trace")
def system_timestamp(s, d):
    t = view(s, d, "trace").withColumn("src_ts", F.col("src_ts").cast("timestamp"))
    return t.select("frame_id", S.system_timestamp(F.col("src_ts")).alias("ms"), S.system_timestamp(F.col("src_ts"), True).alias("us"))


@query("tensor_struct", f"""SELECT vec_id AS frame_id, '{{"precision":"FP32","dims":[1,64],"layer_name":"out","confidence":0.5}}' AS json FROM embeddings""")
def tensor_struct(s, d):
    t = vectors(s, d).select("frame_id", F.lit("FP32").alias("precision"), F.lit("").alias("layout"), F.array(F.lit(1), F.lit(64)).alias("dims"), F.lit("").alias("name"), F.lit("").alias("model_name"), F.lit("out").alias("layer_name"), F.lit(None).cast("string").alias("format"), F.lit("").alias("label"), F.lit(0.5).alias("confidence"), F.lit(None).cast("int").alias("label_id"), "data")
    return t.select("frame_id", F.to_json(S.tensor_struct(data=False)).alias("json"))


@query("merge_streams", "SELECT stream_id, frame_id, CASE WHEN stream_id % 2 = 1 THEN frame_num END AS extra FROM frames")
def merge_streams(s, d):
    """Two tables that hold the even and the odd streams, one with a column more."""
    f = view(s, d, "frames").select("stream_id", "frame_id", "frame_num")
    odd = F.col("stream_id") % 2 == 1
    return S.merge_streams(f.where(~odd).drop("frame_num"), f.where(odd).withColumnRenamed("frame_num", "extra"))


@query("pretty_json", """SELECT stream_id, frame_id, '{' || chr(10) || '  "width" : ' || width || ',' || chr(10) || '  "height" : ' || height || chr(10) || '}' AS json FROM frames""")
def pretty_json(s, d):
    return view(s, d, "frames").select("stream_id", "frame_id", S.pretty_json(F.struct("width", "height")).alias("json"))


@query("kafka_rows", """SELECT CAST(stream_id AS VARCHAR) AS key, '{"frame_id":' || frame_id || '}' AS value FROM frames""")
def kafka_rows(s, d):
    return S.kafka_rows(view(s, d, "frames").withColumn("json", F.to_json(F.struct("frame_id"))))
