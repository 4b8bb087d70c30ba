"""Queries of sampling, windows over frames, throughput and latency."""

from pyspark.sql import functions as F

from reeltable.functions.tables import Stored
from reeltable.jobs.registry import query
from reeltable.operators import monitor as A
from reeltable.operators import sampling as W
from reeltable.sources.views import view


def frames(s, d):
    return view(s, d, "frames")


def objects(s, d):
    return view(s, d, "objects")


def utc(df, c="src_ts"):
    return df.withColumn(c, F.col(c).cast("timestamp"))


ID = ("stream_id", "frame_id")


@query("sample_interval", "SELECT stream_id, frame_id FROM frames WHERE frame_num % 4 = 0")
def sample_interval(s, d):
    return W.sample_interval(frames(s, d), 4, F.col("frame_num")).select(*ID)


@query("pass_drop", "SELECT stream_id, frame_id, frame_num % 5 >= 2 AS is_gap FROM frames")
def pass_drop(s, d):
    return W.pass_drop(frames(s, d), 2, 3, gap=True).select(*ID, "is_gap")


@query("rate_adjust", """, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id, object_id ORDER BY frame_num) AS k FROM objects)
SELECT stream_id, object_id, frame_id FROM n WHERE ceil(k * 2 / 5) > ceil((k - 1) * 2 / 5)""")
def rate_adjust(s, d):
    return W.rate_adjust(objects(s, d), 2, 5).select("stream_id", "object_id", "frame_id")


@query("sample_fps", "SELECT stream_id, frame_id FROM frames WHERE (frame_num + 1) % 8 = 0")
def sample_fps(s, d):
    return W.sample_fps(frames(s, d), 30, 4, F.col("frame_num")).select(*ID)


@query("chunk_frames", """SELECT stream_id, frame_num // 8 AS chunk, array_to_string(list(frame_id ORDER BY frame_num), ',') AS frame_ids, max(pts) AS pts FROM frames GROUP BY ALL HAVING count(*) = 8""")
def chunk_frames(s, d):
    return W.chunk_frames(frames(s, d), 8).withColumn("frame_ids", F.array_join(F.col("frame_ids").cast("array<string>"), ","))


@query("sliding_tensor", """SELECT stream_id, frame_id, array_to_string(list(CAST(frame_num AS VARCHAR)) OVER (PARTITION BY stream_id ORDER BY frame_num ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') AS data FROM frames""")
def sliding_tensor(s, d):
    return W.sliding_tensor(frames(s, d).withColumn("data", F.array(F.col("frame_num").cast("string"))), 4).select(*ID, F.array_join("data", ",").alias("data"))


@query("smooth_gaps", """, k AS (SELECT *, max(CASE WHEN NOT is_gap THEN frame_num END) OVER (PARTITION BY stream_id, object_id ORDER BY frame_num) AS at FROM objects WHERE object_id <> 0)
SELECT k.stream_id, k.frame_id, CASE WHEN k.is_gap THEN o.label ELSE k.label END AS label, k.is_gap AND o.frame_id IS NULL AS is_gap FROM k LEFT JOIN objects o ON o.stream_id = k.stream_id AND o.frame_num = k.at
UNION ALL SELECT stream_id, frame_id, CASE WHEN NOT is_gap THEN label END, is_gap FROM objects WHERE object_id = 0""")
def smooth_gaps(s, d):
    return W.smooth_gaps(objects(s, d)).select(*ID, "label", "is_gap")


@query("needs_reclassify", """, o AS (SELECT *, row_number() OVER (PARTITION BY stream_id, object_id ORDER BY frame_num) AS n FROM objects WHERE object_id <> 0),
walk AS (SELECT stream_id, object_id, n, frame_id, frame_num AS done, true AS classify FROM o WHERE n = 1
 UNION ALL SELECT o.stream_id, o.object_id, o.n, o.frame_id, CASE WHEN o.frame_num - w.done >= 400 THEN o.frame_num ELSE w.done END, o.frame_num - w.done >= 400
 FROM walk w JOIN o ON o.stream_id = w.stream_id AND o.object_id = w.object_id AND o.n = w.n + 1)
SELECT stream_id, frame_id, classify FROM walk UNION ALL SELECT stream_id, frame_id, true FROM objects WHERE object_id = 0""")
def needs_reclassify(s, d):
    return W.needs_reclassify(objects(s, d), 400).select(*ID, "classify")


@query("fill_classifications", """, k AS (SELECT *, max(CASE WHEN attr_value IS NOT NULL THEN frame_num END) OVER (PARTITION BY stream_id, object_id, label ORDER BY frame_num) AS at_ FROM objects WHERE object_id <> 0)
SELECT k.stream_id, k.frame_id, coalesce(k.attr_value, o.attr_value) AS attr_value, CASE WHEN k.attr_value IS NULL THEN k.frame_num - k.at_ END AS frames_ago
FROM k LEFT JOIN objects o ON o.stream_id = k.stream_id AND o.frame_num = k.at_
UNION ALL SELECT stream_id, frame_id, attr_value, NULL FROM objects WHERE object_id = 0 OR object_id IS NULL""")
def fill_classifications(s, d):
    return W.fill_classifications(objects(s, d), layer="label").select(*ID, "attr_value", "frames_ago")


@query("loop_frames", """, h AS (SELECT stream_id, frame_id, frame_num, pts FROM frames WHERE frame_num < 10), full_ AS (SELECT stream_id FROM h GROUP BY 1 HAVING count(*) = 10)
SELECT stream_id, frame_id, pts, frame_num AS out_num FROM h WHERE frame_num < 9
UNION ALL SELECT h.stream_id, h.frame_id, CAST(8 + k + 1 AS BIGINT) * 33333333, CAST(k + 9 AS BIGINT) FROM h JOIN full_ USING (stream_id), range(0, 25) AS t(k) WHERE k % 10 = h.frame_num""")
def loop_frames(s, d):
    return W.loop_frames(frames(s, d), 10, 35)


@query("fps_by_interval", """, t AS (SELECT pts, count(*) AS frames, list(DISTINCT stream_id) AS streams, row_number() OVER (ORDER BY pts) AS n FROM frames GROUP BY pts),
walk AS (SELECT n, pts, frames, streams, pts AS beg, 0 AS no, false AS close FROM t WHERE n = 1
  UNION ALL SELECT t.n, t.pts, t.frames, t.streams, CASE WHEN w.close THEN w.pts ELSE w.beg END, CASE WHEN w.close THEN w.no + 1 ELSE w.no END, t.pts - (CASE WHEN w.close THEN w.pts ELSE w.beg END) >= 1000000000 FROM walk w JOIN t ON t.n = w.n + 1),
s AS (SELECT CAST(no AS BIGINT) AS interval_no, CAST(sum(frames) AS BIGINT) AS frames, CAST(len(list_distinct(flatten(list(streams)))) AS INT) AS streams, (max(pts) - min(beg)) / 1e9 AS seconds FROM walk GROUP BY no)
SELECT interval_no, frames, streams, round(seconds, 6) AS seconds, round(frames / seconds, 6) AS fps, round(frames / seconds / streams, 6) AS fps_per_stream FROM s WHERE seconds > 0""")
def fps_by_interval(s, d):
    return A.fps_by_interval(frames(s, d)).withColumns({c: F.round(c, 6) for c in ("seconds", "fps", "fps_per_stream")})


@query("fps_tumbling", """SELECT stream_id, time_bucket(INTERVAL 1 HOUR, src_ts) AS start, count(*) AS frames FROM trace GROUP BY ALL""")
def fps_tumbling(s, d):
    return A.fps_tumbling(view(s, d, "trace"), "src_ts", "1 hour")


@query("fps_overall", """SELECT stream_id, count(*) AS frames, round((max(pts) - min(pts)) / 1e9, 6) AS seconds, round(CASE WHEN (max(pts) - min(pts)) / 1e9 >= 0.1 THEN count(*) / ((max(pts) - min(pts)) / 1e9) END, 6) AS fps FROM frames GROUP BY 1""")
def fps_overall(s, d):
    return A.fps_overall(frames(s, d)).withColumns({"seconds": F.round("seconds", 6), "fps": F.round("fps", 6)})


@query("frame_interval_stddev", """, g AS (SELECT stream_id, (pts + frame_id % 5 * 1000000 - lag(pts + frame_id % 5 * 1000000) OVER (PARTITION BY stream_id ORDER BY pts + frame_id % 5 * 1000000)) / 1e6 AS gap FROM frames)
SELECT stream_id, round(CASE WHEN count(gap) < 2 OR stddev_samp(gap) > 1000 THEN 0 ELSE stddev_samp(gap) END, 6) AS stddev_ms FROM g GROUP BY 1""")
def frame_interval_stddev(s, d):
    f = frames(s, d).withColumn("pts", F.col("pts") + F.col("frame_id") % 5 * 1000000)
    return A.frame_interval_stddev(f).withColumn("stddev_ms", F.round("stddev_ms", 6))


@query("mean_frame_latency", """SELECT stream_id, round(avg(frame_id % 97), 6) AS latency FROM frames GROUP BY ROLLUP (stream_id)""")
def mean_frame_latency(s, d):
    return A.mean_frame_latency(frames(s, d).withColumn("observed", F.col("pts") + F.col("frame_id") % 97)).withColumn("latency", F.round("latency", 6))


RUN = "OVER (PARTITION BY {k} ORDER BY src_ts, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
RUNE, RUNS = RUN.format(k="element"), RUN.format(k="stream_id")


@query("latency_running", f"SELECT element, frame_id, round(avg(latency_ms) {RUNE}, 5) AS avg_ms, min(latency_ms) {RUNE} AS min_ms, max(latency_ms) {RUNE} AS max_ms, count(*) {RUNE} AS frame_num FROM trace")
def latency_running(s, d):
    return A.latency_running(view(s, d, "trace")).select("element", "frame_id", F.round("avg_ms", 5).alias("avg_ms"), "min_ms", "max_ms", "frame_num")


@query("pipeline_latency_running", f"""SELECT stream_id, frame_id, round(avg(latency_ms) {RUNS}, 5) AS avg_ms, count(*) {RUNS} AS frame_num,
  round((epoch_us(src_ts) - min(epoch_us(src_ts)) {RUNS}) / 1000 / (count(*) {RUNS}), 5) AS interval_ms FROM trace""")
def pipeline_latency_running(s, d):
    return A.pipeline_latency_running(utc(view(s, d, "trace"))).select(*ID, F.round("avg_ms", 5).alias("avg_ms"), "frame_num", F.round("interval_ms", 5).alias("interval_ms"))


@query("latency_by_interval", """, t AS (SELECT element, epoch_us(src_ts) / 1000 AS tick, frame_id, latency_ms, row_number() OVER (PARTITION BY element ORDER BY src_ts, frame_id) AS n FROM trace),
walk AS (SELECT element, n, tick, latency_ms, tick AS beg, 0 AS no, false AS close FROM t WHERE n = 1
  UNION ALL SELECT t.element, t.n, t.tick, t.latency_ms, CASE WHEN w.close THEN w.tick ELSE w.beg END, CASE WHEN w.close THEN w.no + 1 ELSE w.no END, t.tick - (CASE WHEN w.close THEN w.tick ELSE w.beg END) >= 86400000
  FROM walk w JOIN t ON t.element = w.element AND t.n = w.n + 1)
SELECT element, CAST(no AS BIGINT) AS interval_no, count(*) AS frames, round(avg(latency_ms), 6) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms FROM walk GROUP BY ALL""")
def latency_by_interval(s, d):
    return A.latency_by_interval(utc(view(s, d, "trace")), 86400000).select("element", "interval_no", "frames", F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms")


@query("element_hops", """SELECT stream_id, frame_id // 4 AS frame_id, element, (epoch_us(src_ts) - lag(epoch_us(src_ts)) OVER (PARTITION BY stream_id, frame_id // 4 ORDER BY src_ts, element)) / 1000 AS hop_ms FROM trace""")
def element_hops(s, d):
    return A.element_hops(utc(view(s, d, "trace")).withColumn("frame_id", F.floor(F.col("frame_id") / 4))).select(*ID, "element", "hop_ms")


@query("buffer_occupancy", """, e AS (SELECT element, src_ts AS ts, frame_id AS buffer_id, 1 AS delta FROM trace UNION ALL SELECT element, src_ts + INTERVAL 1 MINUTE * CAST(ceil(latency_ms) AS INT), frame_id, -1 FROM trace),
h AS (SELECT *, sum(delta) OVER (PARTITION BY element ORDER BY ts, buffer_id, delta ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, (epoch_us(lead(ts) OVER (PARTITION BY element ORDER BY ts, buffer_id, delta)) - epoch_us(ts)) / 1e6 AS dt FROM e)
SELECT element, CAST(sum(delta) AS BIGINT) AS in_flight, round(sum(n * dt) / sum(dt), 5) AS mean_in_flight, count(DISTINCT buffer_id) FILTER (delta > 0) AS buffers_in, count(DISTINCT buffer_id) FILTER (delta < 0) AS buffers_out FROM h GROUP BY 1""")
def buffer_occupancy(s, d):
    t = utc(view(s, d, "trace"))
    came = t.select("element", F.col("src_ts").alias("ts"), F.col("frame_id").alias("buffer_id"), F.lit(1).alias("delta"))
    left = t.select("element", F.timestamp_micros(F.unix_micros("src_ts") + F.ceil("latency_ms") * 60000000).alias("ts"), F.col("frame_id").alias("buffer_id"), F.lit(-1).alias("delta"))
    return A.buffer_occupancy(came.unionByName(left)).withColumn("mean_in_flight", F.round("mean_in_flight", 5))


@query("count_objects", "SELECT stream_id, label, count(*) AS objects, count(DISTINCT frame_id) AS tracks FROM detections GROUP BY CUBE (stream_id, label)")
def count_objects(s, d):
    return A.count_objects(view(s, d, "detections"), ("stream_id", "label"), cube=True, tracks="frame_id")


@query("count_objects_sketched", """, k AS (SELECT *, pts // 60000000000 AS minute FROM detections)
SELECT stream_id, label, minute, count(*) AS objects, true AS close FROM k GROUP BY ALL UNION ALL SELECT stream_id, label, NULL, count(*), true FROM k GROUP BY ALL UNION ALL SELECT stream_id, NULL, NULL, count(*), true FROM k GROUP BY ALL UNION ALL SELECT NULL, NULL, NULL, count(*), true FROM k""")
def count_objects_sketched(s, d):
    """Distinct frames from stored sketches at four levels: whether each is within four standard deviations of the exact count."""
    k = view(s, d, "detections").withColumn("minute", F.floor(F.col("pts") / 60_000_000_000))
    full = ("stream_id", "label", "minute")
    sketches = Stored(A.object_sketches(k, "frame_id", full)).df
    levels = []
    for by in (full, full[:2], full[:1], ()):
        exact = k.groupBy(*by).agg(F.countDistinct("frame_id").alias("exact")).withColumn("_one", F.lit(1))
        found = A.count_sketched(sketches, by).withColumn("_one", F.lit(1)).join(exact, [*by, "_one"])
        close = F.abs(F.col("tracks") - F.col("exact")) <= 4 * 1.04 / 64 * F.col("exact") + 1
        levels.append(found.select(*(F.col(c) if c in by else F.lit(None).cast(k.schema[c].dataType).alias(c) for c in full), "objects", close.alias("close")))
    return levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3])


PIXELS = """, hx AS (SELECT stream_id, frame_id, md5(CAST(frame_id AS VARCHAR) || 'a') || md5(CAST(frame_id AS VARCHAR) || 'b') || md5(CAST(frame_id AS VARCHAR) || 'c') AS h FROM frames),
px AS (SELECT stream_id, frame_id, i % 4 AS x, i // 4 AS y, list_transform([0, 2, 4], lambda k: CAST('0x' || substr(h, i * 6 + k + 1, 2) AS INT) // 128) AS c FROM hx, range(0, 16) AS t(i)),
wt AS (SELECT stream_id, frame_id, CAST(y // 2 * 2 + x // 2 AS INT) AS slice, 2 * (2 * c[1] + c[2]) + c[3] AS bin, exp(-0.5 * (pow(1 - x % 2, 2) + pow(1 - y % 2, 2))) AS w FROM px)
SELECT stream_id, frame_id, slice, CAST(bin AS INT) AS bin, round(sum(w), 6) AS weight FROM wt GROUP BY ALL"""


@query("color_histogram", PIXELS)
def color_histogram(s, d):
    """4 x 4 pixels that the frame's number gives, in 2 x 2 slices; bins that have any."""
    pixels = F.unhex(F.concat(*(F.md5(F.concat(F.col("frame_id").cast("string"), F.lit(c))) for c in "abc")))
    images = frames(s, d).select("stream_id", "frame_id", F.lit(4).alias("height"), F.lit(4).alias("width"), pixels.alias("pixels"))
    bins = A.color_histogram(images, 2, 2, 2).select("stream_id", "frame_id", "slice", F.posexplode("histogram").alias("bin", "weight"))
    return bins.where("weight > 0").withColumn("weight", F.round("weight", 6))
