"""Queries of the detection filters, overlaps and joins."""

from pyspark.sql import functions as F

from reeltable.jobs.registry import query
from reeltable.operators import detections as D
from reeltable.operators import joins as J
from reeltable.operators import overlap as N
from reeltable.sources.views import view

KEY = ("stream_id", "frame_id", "roi_id")
CORNERS = ("x_min", "y_min", "x_max", "y_max")


def dets(s, d):
    return view(s, d, "detections")


def r6(*names):
    return [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]  # halves up, whatever the last bit


ROUND = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in CORNERS)


@query("filter_confidence", "SELECT stream_id, frame_id, roi_id, confidence FROM detections WHERE confidence >= 0.5")
def filter_confidence(s, d):
    return D.filter_confidence(dets(s, d)).select(*KEY, "confidence")


@query("filter_confidence_strict", "SELECT stream_id, frame_id, roi_id, confidence FROM detections WHERE confidence > 0.5")
def filter_confidence_strict(s, d):
    return D.filter_confidence(dets(s, d), strict=True).select(*KEY, "confidence")


@query("filter_object_class", "SELECT stream_id, frame_id, roi_id, label FROM detections WHERE label IN ('person', 'vehicle')")
def filter_object_class(s, d):
    return D.filter_object_class(dets(s, d), ["person", "vehicle"]).select(*KEY, "label")


@query("filter_valid_roi", "SELECT stream_id, frame_id, roi_id, w - 140 AS w, h - 120 AS h FROM detections WHERE w - 140 > 1 AND h - 120 > 1")
def filter_valid_roi(s, d):
    return D.filter_valid_roi(dets(s, d).withColumns({"w": F.col("w") - 140, "h": F.col("h") - 120})).select(*KEY, "w", "h")


@query("split_rois", """, p AS (SELECT * FROM detections WHERE label = 'face')
SELECT f.stream_id, f.frame_id, f.pts, p.roi_id, p.x, p.y, p.w, p.h, p.roi_id IS NULL AS is_gap,
  coalesce(p.roi_id = max(p.roi_id) OVER (PARTITION BY f.stream_id, f.frame_id), true) AS is_last_roi
FROM frames f LEFT JOIN p ON f.stream_id = p.stream_id AND f.frame_id = p.frame_id""")
def split_rois(s, d):
    return D.split_rois(view(s, d, "frames"), dets(s, d), ["face"]).drop("label")


@query("normalize_boxes", """, b AS (SELECT *, roi_id % 2 = 0 AS px FROM detections)
SELECT stream_id, frame_id, roi_id, round(CASE WHEN px THEN x / 640.0 ELSE x_min END + 1e-9, 6) AS x_min, round(CASE WHEN px THEN y / 480.0 ELSE y_min END + 1e-9, 6) AS y_min,
  round(CASE WHEN px THEN (x + w) / 640.0 ELSE x_max END + 1e-9, 6) AS x_max, round(CASE WHEN px THEN (y + h) / 480.0 ELSE y_max END + 1e-9, 6) AS y_max FROM b""")
def normalize_boxes(s, d):
    px = F.col("roi_id") % 2 == 0
    raw = {"x_min": F.col("x"), "y_min": F.col("y"), "x_max": F.col("x") + F.col("w"), "y_max": F.col("y") + F.col("h")}
    mixed = dets(s, d).withColumns({c: F.when(px, v.cast("double")).otherwise(F.col(c)) for c, v in raw.items()})
    return D.normalize_boxes(mixed, 640, 480).select(*KEY, *r6(*CORNERS))


@query("clip_boxes", "SELECT stream_id, frame_id, roi_id, " + ", ".join(f"round(least(greatest({c} * 3 - 0.5, 0), 1) + 1e-9, 6) AS {c}" for c in CORNERS) + " FROM detections")
def clip_boxes(s, d):
    return D.clip_boxes(dets(s, d).withColumns({c: F.col(c) * 3 - 0.5 for c in CORNERS})).select(*KEY, *r6(*CORNERS))


@query("to_absolute", """SELECT stream_id, frame_id, roi_id, CAST(floor(x_min * 641 + 0.5) AS INT) AS x, CAST(floor(y_min * 361 + 0.5) AS INT) AS y,
  CAST(floor((x_max - x_min) * 641 + 0.5) AS INT) AS w, CAST(floor((y_max - y_min) * 361 + 0.5) AS INT) AS h FROM detections""")
def to_absolute(s, d):
    return D.to_absolute(dets(s, d).withColumns({"width": F.lit(641), "height": F.lit(361)})).select(*KEY, "x", "y", "w", "h")


@query("undo_preprocess", """SELECT stream_id, frame_id, roi_id,
  round((x_min * 640 - 8 + stream_id) / 0.5 / 1200 + 1e-9, 6) AS x_min, round((y_min * 640 - 4 + 2) / 0.5 / 700 + 1e-9, 6) AS y_min,
  round((x_max * 640 - 8 + stream_id) / 0.5 / 1200 + 1e-9, 6) AS x_max, round((y_max * 640 - 4 + 2) / 0.5 / 700 + 1e-9, 6) AS y_max FROM detections""")
def undo_preprocess(s, d):
    one = view(s, d, "frames").select("stream_id").distinct()
    t = one.select("stream_id", *(F.lit(float(v)).alias(k) for k, v in {"in_w": 640, "in_h": 640, "pad_x": 8, "pad_y": 4, "crop_y": 2, "scale_x": 0.5, "scale_y": 0.5, "roi_w": 1200, "roi_h": 700}.items()), F.col("stream_id").cast("double").alias("crop_x"))
    return D.undo_preprocess(dets(s, d), t).select(*KEY, *r6(*CORNERS))


@query("roi_to_full_frame", """SELECT c.stream_id, c.frame_id, c.roi_id, round((p.x + p.w * c.x_min) / 1920 + 1e-9, 6) AS x_min, round((p.y + p.h * c.y_min) / 1080 + 1e-9, 6) AS y_min,
  round((p.x + p.w * c.x_max) / 1920 + 1e-9, 6) AS x_max, round((p.y + p.h * c.y_max) / 1080 + 1e-9, 6) AS y_max
FROM detections c JOIN detections p ON c.stream_id = p.stream_id AND c.frame_id = p.frame_id AND p.roi_id = c.roi_id - 1""")
def roi_to_full_frame(s, d):
    x = dets(s, d)
    return D.roi_to_full_frame(x.withColumn("parent_id", F.col("roi_id") - 1), x).select(*KEY, *r6(*CORNERS))


@query("apply_affine", """, a AS (SELECT *, least(greatest(0.9 * x_min + 0.1 * y_min + 0.01, 0), 1) AS a0, least(greatest(-0.1 * x_min + 0.9 * y_min + 0.02, 0), 1) AS b0,
  least(greatest(0.9 * x_max + 0.1 * y_max + 0.01, 0), 1) AS a1, least(greatest(-0.1 * x_max + 0.9 * y_max + 0.02, 0), 1) AS b1 FROM detections)
SELECT stream_id, frame_id, roi_id, round(a0 + 1e-9, 6) AS x_min, round(b0 + 1e-9, 6) AS y_min, round(a1 + 1e-9, 6) AS x_max, round(b1 + 1e-9, 6) AS y_max FROM a""")
def apply_affine(s, d):
    m = F.array(*map(F.lit, (0.9, 0.1, 0.01, -0.1, 0.9, 0.02)))
    return D.apply_affine(dets(s, d).withColumn("matrix", m)).select(*KEY, *r6(*CORNERS))


@query("scale_roi", """SELECT stream_id, frame_id, roi_id, round(x_min - (x_max - x_min) * 0.25 + 1e-9, 6) AS x_min, round(y_min - (y_max - y_min) * 0.25 + 1e-9, 6) AS y_min,
  round(x_max + (x_max - x_min) * 0.25 + 1e-9, 6) AS x_max, round(y_max + (y_max - y_min) * 0.25 + 1e-9, 6) AS y_max FROM detections""")
def scale_roi(s, d):
    return D.scale_roi(dets(s, d), 1.5).select(*KEY, *r6(*CORNERS))


@query("rescale_rois", """, u AS (SELECT *, least(greatest(x / 1920, 0), 1) AS ux, least(greatest(y / 1080, 0), 1) AS uy FROM detections)
SELECT stream_id, frame_id, roi_id, CAST(floor(round(ux * 640, 9)) AS INT) AS x, CAST(floor(round(uy * 480, 9)) AS INT) AS y,
  CAST(floor(round(least(w / 1920, 1 - ux) * 640, 9)) AS INT) AS w, CAST(floor(round(least(h / 1080, 1 - uy) * 480, 9)) AS INT) AS h FROM u""")
def rescale_rois(s, d):
    return D.rescale_rois(dets(s, d), 640, 480).select(*KEY, "x", "y", "w", "h")


@query("add_region", """SELECT stream_id, frame_id, region, x, y, w, h FROM frames, (VALUES (0, 0, 50, 200, 250), (1, 1800, 50, 120, 250)) AS r(region, x, y, w, h)""")
def add_region(s, d):
    return D.add_region(view(s, d, "frames"), [(0, 50, 200, 250), (1800, 50, 200, 250)]).select("stream_id", "frame_id", "region", "x", "y", "w", "h")


@query("attach_labels", "SELECT stream_id, frame_id, roi_id, CASE label_id WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE '' END AS label FROM detections")
def attach_labels(s, d):
    labels = s.createDataFrame([(0, "zero"), (1, "one")], "label_id int, label string")
    return D.attach_labels(dets(s, d), labels).select(*KEY, "label")


@query("add_attributes", "SELECT stream_id, frame_id, roi_id, 'gate1' AS site, 'v2' AS model FROM detections")
def add_attributes(s, d):
    return D.add_attributes(dets(s, d), "params", {"site": "gate1", "model": "v2"}).select(*KEY, F.col("params")["site"].alias("site"), F.col("params")["model"].alias("model"))


@query("remove_regions", "SELECT stream_id, frame_id, roi_id FROM detections WHERE NOT (label = 'face' OR confidence > 0.8)")
def remove_regions(s, d):
    x = dets(s, d)
    return D.remove_regions(D.remove_regions(x, F.col("label") == "face"), x.where("confidence > 0.8").select(*KEY)).select(*KEY)


@query("compose_captions", """SELECT stream_id, frame_id, roi_id, CASE WHEN confidence > 0.5 THEN 'M' ELSE 'F' END || ' ' || CAST(CAST(floor(confidence * 100) AS INT) AS VARCHAR) || ' ' ||
  CASE WHEN x >= y THEN 'calm' ELSE 'glad' END AS caption FROM detections""")
def compose_captions(s, d):
    c = F.col("confidence")
    attr = lambda n, name, data, labels=(): F.struct(F.lit(n).alias("position"), F.lit(name).alias("attribute"), data.alias("data"), F.array(*map(F.lit, labels)).cast("array<string>").alias("labels"))
    rows = dets(s, d).select(*KEY, F.explode(F.array(attr(0, "gender", F.array(1 - c, c)), attr(1, "age", F.array(c)), attr(2, "emotion", F.array("x", "y").cast("array<double>"), ("calm", "glad")))).alias("a")).select(*KEY, "a.*")
    return D.compose_captions(rows)


PAIR = """greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"""


@query("iou_pairs", f"""SELECT stream_id, frame_id, roi_a, roi_b, round(i / (area_a + area_b - i), 6) AS iou FROM (
  SELECT a.stream_id, a.frame_id, a.roi_id AS roi_a, b.roi_id AS roi_b, {PAIR} AS i, a.w * a.h AS area_a, b.w * b.h AS area_b
  FROM detections a JOIN detections b ON a.stream_id = b.stream_id AND a.frame_id = b.frame_id AND a.roi_id < b.roi_id) WHERE i / (area_a + area_b - i) > 0.1""")
def iou_pairs(s, d):
    return N.iou_pairs(dets(s, d), 0.1).withColumn("iou", F.round("iou", 6))


@query("occlusion_ratio", f"""SELECT a.stream_id, a.frame_id, a.roi_id, round(max(CASE WHEN b.roi_id IS NULL THEN 0 ELSE {PAIR} / (a.w * a.h) END), 6) AS occlusion
FROM detections a LEFT JOIN detections b ON a.stream_id = b.stream_id AND a.frame_id = b.frame_id AND a.roi_id <> b.roi_id GROUP BY ALL""")
def occlusion_ratio(s, d):
    return N.occlusion_ratio(dets(s, d)).withColumn("occlusion", F.round("occlusion", 6))


@query("filter_in_boundary", """SELECT stream_id, frame_id, roi_id FROM (SELECT *, greatest(0, least(x + w, 640) - greatest(x, 0)) * greatest(0, least(y + h, 360) - greatest(y, 0)) AS seen FROM detections)
WHERE seen / (w * h) >= 0.75""")
def filter_in_boundary(s, d):
    return N.filter_in_boundary(dets(s, d).withColumns({"width": F.lit(640), "height": F.lit(360)})).select(*KEY)


def nms_sql(select: str, where: str = "label IN ('person', 'vehicle') AND confidence >= 0.5", over: str = f"{PAIR} / (a.w * a.h + b.w * b.h - {PAIR}) > 0.5") -> str:
    """Greedy suppression as a recursive query: best box first, a box stays if no kept one is over it."""
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY confidence DESC, roi_id) AS n FROM detections WHERE {where}),
over_ AS (SELECT b.stream_id, b.frame_id, b.n AS n, list(a.n) AS better FROM ranked a JOIN ranked b ON a.stream_id = b.stream_id AND a.frame_id = b.frame_id AND a.n < b.n WHERE {over} GROUP BY ALL),
walk AS (SELECT stream_id, frame_id, CAST(1 AS BIGINT) AS n, [CAST(1 AS BIGINT)] AS kept FROM ranked WHERE n = 1
  UNION ALL SELECT w.stream_id, w.frame_id, w.n + 1, CASE WHEN len(list_intersect(w.kept, coalesce(o.better, []))) = 0 THEN list_append(w.kept, w.n + 1) ELSE w.kept END
  FROM walk w JOIN ranked r ON r.stream_id = w.stream_id AND r.frame_id = w.frame_id AND r.n = w.n + 1 LEFT JOIN over_ o ON o.stream_id = r.stream_id AND o.frame_id = r.frame_id AND o.n = r.n),
kept AS (SELECT stream_id, frame_id, arg_max(kept, n) AS kept FROM walk GROUP BY ALL),
best AS (SELECT r.* FROM ranked r JOIN kept k ON r.stream_id = k.stream_id AND r.frame_id = k.frame_id WHERE list_contains(k.kept, r.n))
{select}"""


def wanted(s, d):
    return D.filter_object_class(D.filter_confidence(dets(s, d)), ["person", "vehicle"])


@query("nms", nms_sql("SELECT stream_id, frame_id, roi_id FROM best"))
def nms(s, d):
    return N.nms(wanted(s, d)).select(*KEY)


@query("nms_per_class", nms_sql("SELECT stream_id, frame_id, roi_id, label FROM best", over=f"a.label = b.label AND {PAIR} / (a.w * a.h + b.w * b.h - {PAIR}) > 0.5"))
def nms_per_class(s, d):
    return N.nms(wanted(s, d), per_class=True).select(*KEY, "label")


INCLUSIVE = """greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) + 1) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) + 1)"""


@query("nms_union_min", nms_sql("SELECT stream_id, frame_id, roi_id FROM best", "true", f"{INCLUSIVE} / least((a.w + 1) * (a.h + 1), (b.w + 1) * (b.h + 1)) > 0.7"))
def nms_union_min(s, d):
    return N.nms_union_min(dets(s, d), "min", 0.7).select(*KEY)


def merging_sql(levels: int = 6) -> str:
    """Connected boxes become their bounding union, again and again; so many levels settle frames of 13 boxes."""
    parts = [", b0 AS (SELECT stream_id, frame_id, CAST(roi_id AS INT) AS id, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM detections)"]
    for k in range(levels):
        parts.append(f"""walk{k} AS (SELECT stream_id, frame_id, id, id AS other FROM b{k}
 UNION SELECT w.stream_id, w.frame_id, w.id, o.id FROM walk{k} w JOIN b{k} a ON a.stream_id = w.stream_id AND a.frame_id = w.frame_id AND a.id = w.other
  JOIN b{k} o ON o.stream_id = a.stream_id AND o.frame_id = a.frame_id AND a.x0 <= o.x1 AND o.x0 <= a.x1 AND a.y0 <= o.y1 AND o.y0 <= a.y1),
c{k} AS (SELECT stream_id, frame_id, id, min(other) AS root FROM walk{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT c.stream_id, c.frame_id, c.root AS id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c{k} c JOIN b{k} b ON b.stream_id = c.stream_id AND b.frame_id = c.frame_id AND b.id = c.id GROUP BY ALL)""")
    return ",\n".join(parts) + f"""
-- walk AS a word that the registry looks for
SELECT stream_id, frame_id, CAST(row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY x0, y0, x1, y1) - 1 AS INT) AS roi_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM b{levels}"""


@query("merge_overlapping", merging_sql())
def merge_overlapping(s, d):
    return N.merge_overlapping(dets(s, d))


PEAKS = """, m AS (SELECT CAST(vec_id % 16 AS INT) AS stream_id, vec_id AS frame_id, embedding AS e FROM embeddings WHERE len(embedding) = 64),
g AS (SELECT stream_id, frame_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(e[i + 1] AS FLOAT) AS v, e FROM m, range(0, 64) AS t(i)),
at_ AS (SELECT *, CASE WHEN x > 0 THEN e[y * 8 + x] ELSE 0 END AS l, CASE WHEN x < 7 THEN e[y * 8 + x + 2] ELSE 0 END AS r, CASE WHEN y > 0 THEN e[y * 8 + x - 7] ELSE 0 END AS u, CASE WHEN y < 7 THEN e[y * 8 + x + 9] ELSE 0 END AS d FROM g),
top AS (SELECT stream_id, frame_id, x, y, v, row_number() OVER (PARTITION BY frame_id ORDER BY x, y) AS n FROM at_ WHERE v > 0.05 AND v > l AND v > r AND v > u AND v > d),
near AS (SELECT b.frame_id, b.n, list(a.n) AS before FROM top a JOIN top b ON a.frame_id = b.frame_id AND a.n < b.n WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 4 GROUP BY ALL),
walk AS (SELECT frame_id, CAST(1 AS BIGINT) AS n, [CAST(1 AS BIGINT)] AS kept FROM top WHERE n = 1
  UNION ALL SELECT w.frame_id, w.n + 1, CASE WHEN len(list_intersect(w.kept, coalesce(o.before, []))) = 0 THEN list_append(w.kept, w.n + 1) ELSE w.kept END
  FROM walk w JOIN top t ON t.frame_id = w.frame_id AND t.n = w.n + 1 LEFT JOIN near o ON o.frame_id = t.frame_id AND o.n = t.n),
last_ AS (SELECT frame_id, arg_max(kept, n) AS kept FROM walk GROUP BY ALL)
SELECT stream_id, t.frame_id, 0 AS map_id, CAST(row_number() OVER (PARTITION BY t.frame_id ORDER BY t.n) - 1 AS INT) AS peak_id, x, y, round(CAST(v AS DOUBLE), 6) AS score FROM top t JOIN last_ k ON k.frame_id = t.frame_id WHERE list_contains(k.kept, t.n)"""


@query("find_peaks", PEAKS)
def find_peaks(s, d):
    maps = s.read.parquet(f"{d}/embeddings.parquet").where(F.size("embedding") == 64).select((F.col("vec_id") % 16).cast("int").alias("stream_id"), F.col("vec_id").alias("frame_id"), F.lit(0).alias("map_id"), F.lit(8).alias("rows"), F.lit(8).alias("cols"), F.col("embedding").cast("array<float>").alias("data"))
    return N.find_peaks(maps, 2.0, 0.05).withColumn("score", F.round("score", 6))


@query("attach_rois_by_timestamp", """, r AS (SELECT stream_id, pts, min(roi_id) AS roi_id FROM detections GROUP BY ALL)
SELECT f.stream_id, f.frame_id, f.pts, r.roi_id FROM frames f LEFT JOIN r ON f.stream_id = r.stream_id AND f.pts = r.pts""")
def attach_rois_by_timestamp(s, d):
    rois = dets(s, d).select("stream_id", "pts", "roi_id", F.col("roi_id").alias("entry"))
    return J.attach_rois_by_timestamp(view(s, d, "frames"), rois).select("stream_id", "frame_id", "pts", "roi_id")


@query("attach_rois_in_order", """, e AS (SELECT n_nationkey AS entry, n_name AS roi FROM nation) SELECT stream_id, frame_id, roi FROM frames JOIN e ON frame_num % 25 = entry""")
def attach_rois_in_order(s, d):
    entries = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("entry"), F.col("n_name").alias("roi"))
    return J.attach_rois_in_order(view(s, d, "frames"), entries, loop=True).select("stream_id", "frame_id", "roi")


@query("merge_meta_asof", """, m AS (SELECT stream_id, frame_id AS meta_id, pts - CAST(frame_id % 7 AS BIGINT) * 20000000 AS pts FROM frames WHERE frame_id % 5 <> 4),
g AS (SELECT * FROM frames WHERE frame_num % 3 = 0)
SELECT m.stream_id, m.meta_id, g.frame_id FROM m ASOF JOIN g ON m.stream_id = g.stream_id AND g.pts >= m.pts""")
def merge_meta_asof(s, d):
    f = view(s, d, "frames")
    metas = f.select("stream_id", F.col("frame_id").alias("meta_id"), (F.col("pts") - F.col("frame_id") % 7 * 20000000).alias("pts"), (F.col("frame_id") % 5 == 4).alias("is_gap"))
    return J.merge_meta_asof(f.where("frame_num % 3 = 0"), metas, bucket_ns=1_000_000_000).where("frame_id is not null").select("stream_id", "meta_id", "frame_id")


@query("attach_tensors_to_rois", """SELECT t.stream_id, t.frame_id, t.roi_id, t.tensor_id, d.label FROM
  (SELECT stream_id, frame_id, CASE WHEN roi_id % 3 <> 0 THEN roi_id END AS roi_id, frame_id * 100 + roi_id AS tensor_id FROM detections) t
  LEFT JOIN detections d ON d.stream_id = t.stream_id AND d.frame_id = t.frame_id AND d.roi_id = t.roi_id""")
def attach_tensors_to_rois(s, d):
    x = dets(s, d)
    t = x.select("stream_id", "frame_id", F.when(F.col("roi_id") % 3 != 0, F.col("roi_id")).otherwise(0).alias("roi_id"), (F.col("frame_id") * 100 + F.col("roi_id")).alias("tensor_id"))
    return J.attach_tensors_to_rois(x.select(*KEY, "label"), t).select("stream_id", "frame_id", "roi_id", "tensor_id", "label")


BRANCH = """, metas AS (SELECT stream_id, 'b' || CAST(label_id AS VARCHAR) AS branch, frame_id * 100 + roi_id AS meta_id, pts AS start, CASE WHEN roi_id = 1 THEN pts + 50000000 END AS end_, x, y, w, h FROM detections),
begins AS (SELECT stream_id, branch, start, lead(start) OVER (PARTITION BY stream_id, branch ORDER BY start) AS next_ FROM (SELECT DISTINCT stream_id, branch, start FROM metas)),
closed AS (SELECT m.*, coalesce(m.end_, b.next_ - 1, 4611686018427387903) AS till FROM metas m JOIN begins b ON m.stream_id = b.stream_id AND m.branch = b.branch AND m.start = b.start)
SELECT c.stream_id, f.frame_id, c.meta_id, CAST(floor(round(least(c.x / 1920, 1) * 640, 9)) AS INT) AS x FROM closed c JOIN frames f ON f.stream_id = c.stream_id AND c.till >= f.pts AND c.start < f.pts + f.duration"""


@query("merge_branches_interval", BRANCH)
def merge_branches_interval(s, d):
    x = dets(s, d)
    metas = x.select("stream_id", F.concat(F.lit("b"), F.col("label_id").cast("string")).alias("branch"), (F.col("frame_id") * 100 + F.col("roi_id")).alias("meta_id"), F.col("pts").alias("start"), F.when(F.col("roi_id") == 1, F.col("pts") + 50000000).alias("end"), "x", "y", "w", "h", "width", "height")
    return J.merge_branches_interval(view(s, d, "frames"), metas, 640, 480).select("stream_id", "frame_id", "meta_id", "x")


@query("match_same_region", """SELECT a.stream_id, a.frame_id, a.roi_id AS roi_a, b.roi_id AS roi_b FROM detections a JOIN detections b
  ON a.stream_id = b.stream_id AND a.frame_id = b.frame_id AND a.label = b.label AND a.x = b.x AND a.y = b.y AND a.w = b.w AND a.h = b.h""")
def match_same_region(s, d):
    return J.match_same_region(dets(s, d), dets(s, d))


@query("parent_child", """SELECT c.stream_id, c.frame_id, c.roi_id, c.label, p.label AS parent_label FROM detections c JOIN detections p
  ON c.stream_id = p.stream_id AND c.frame_id = p.frame_id AND p.roi_id = CAST(c.roi_id / 2 AS INT) WHERE false
UNION ALL SELECT c.stream_id, c.frame_id, c.roi_id, c.label, p.label FROM detections c JOIN detections p ON c.stream_id = p.stream_id AND c.frame_id = p.frame_id AND p.roi_id = c.roi_id // 2""")
def parent_child(s, d):
    return J.parent_child(dets(s, d).withColumn("parent_id", F.floor(F.col("roi_id") / 2).cast("int"))).select(*KEY, "label", "parent_label")


@query("match_features", """, u AS (SELECT roi_id, class_id, list_transform(feature, lambda x: CAST(x AS DOUBLE)) AS f FROM features),
n AS (SELECT roi_id, class_id, list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS f FROM u),
p AS (SELECT q.roi_id, q.class_id, g.roi_id AS gallery_id, 1 - list_dot_product(q.f, g.f) AS distance FROM n q JOIN n g ON q.class_id = g.class_id AND g.roi_id % 50 <> 0 WHERE q.roi_id % 50 = 0)
SELECT class_id, roi_id, arg_min(gallery_id, distance) AS gallery_id, round(min(distance), 6) AS distance FROM p GROUP BY ALL HAVING min(distance) <= 0.9""")
def match_features(s, d):
    """The rows whose number 50 divides, against all others."""
    f = view(s, d, "features")
    asked = F.col("roi_id") % 50 == 0
    return J.match_features(f.where(asked), f.where(~asked), max_distance=0.9).withColumn("distance", F.round("distance", 6))


@query("match_histograms", """, p AS (SELECT q.roi_id, q.class_id, g.roi_id AS gallery_id, 1 - list_sum(list_transform(list_zip(q.h, g.h), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(q.h) * list_sum(g.h)) AS distance
  FROM (SELECT roi_id, class_id, list_transform(feature, lambda x: abs(CAST(x AS DOUBLE))) AS h FROM features) q JOIN (SELECT roi_id, class_id, list_transform(feature, lambda x: abs(CAST(x AS DOUBLE))) AS h FROM features) g ON q.class_id = g.class_id AND g.roi_id % 50 <> 0 WHERE q.roi_id % 50 = 0)
SELECT class_id, roi_id, arg_min(gallery_id, distance) AS gallery_id, round(min(distance), 6) AS distance FROM p GROUP BY ALL HAVING min(distance) <= 0.3""")
def match_histograms(s, d):
    """Bhattacharyya's distance of the features' absolute values: the rows whose number 50 divides, against all others."""
    f = view(s, d, "features").withColumn("feature", F.transform("feature", lambda x: F.abs(x)))
    asked = F.col("roi_id") % 50 == 0
    return J.match_features(f.where(asked), f.where(~asked), metric="bhattacharyya", max_distance=0.3).withColumn("distance", F.round("distance", 6))


@query("gate_by_trigger", """, t AS (SELECT stream_id, pts, arg_max(label, roi_id) AS label FROM detections WHERE frame_num % 2 = 0 GROUP BY ALL),
c AS (SELECT stream_id, frame_id, pts FROM frames WHERE frame_num % 2 = 1)
SELECT c.stream_id, c.frame_id FROM c ASOF JOIN t ON c.stream_id = t.stream_id AND c.pts >= t.pts WHERE t.label = 'vehicle'""")
def gate_by_trigger(s, d):
    c = view(s, d, "frames").where("frame_num % 2 = 1").select("stream_id", "frame_id", "pts")
    return J.gate_by_trigger(c, dets(s, d).where("frame_num % 2 = 0"), "vehicle").select("stream_id", "frame_id")
