"""The media tables as views over the raw star-schema tables. The same text runs in Spark and in other SQL engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "frames": """
  SELECT CAST(o_custkey % 16 AS INT) AS stream_id, o_orderkey AS frame_id,
         CAST(row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1 AS BIGINT) AS frame_num,
         CAST(row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1 AS BIGINT) * 33333333 AS pts,
         CAST(33333333 AS BIGINT) AS duration, 1920 AS width, 1080 AS height
  FROM orders""",
    "boxes": """
  SELECT l_orderkey,
         CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS INT) AS roi_id,
         CAST(l_partkey % 4 AS INT) AS label_id,
         CASE l_partkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'vehicle'
                            WHEN 2 THEN 'bike' ELSE 'face' END AS label,
         round(l_discount * 10, 2) AS confidence,
         CAST((l_partkey % 20) * 40 AS INT) AS x, CAST((l_suppkey % 10) * 40 AS INT) AS y,
         CAST(120 + l_quantity AS INT) AS w, CAST(100 + l_linenumber * 10 AS INT) AS h
  FROM lineitem""",
    "detections": """
  SELECT f.stream_id, f.frame_id, f.frame_num, f.pts, f.width, f.height,
         d.roi_id, d.label_id, d.label, d.confidence, d.x, d.y, d.w, d.h,
         CAST(d.x AS DOUBLE) / 1920 AS x_min, CAST(d.y AS DOUBLE) / 1080 AS y_min,
         CAST(d.x + d.w AS DOUBLE) / 1920 AS x_max, CAST(d.y + d.h AS DOUBLE) / 1080 AS y_max
  FROM boxes d JOIN frames f ON f.frame_id = d.l_orderkey""",
    "objects": """
  SELECT CAST(user_id % 8 AS INT) AS stream_id, CAST(user_id AS INT) AS object_id,
         event_id AS frame_id,
         CAST(row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_num,
         ts, event_type AS label,
         CASE WHEN event_id % 3 = 0 THEN value END AS attr_value,
         CAST(event_id % 5 = 4 AS BOOLEAN) AS is_gap
  FROM events""",
    "trace": """
  SELECT event_type AS element, CAST(user_id % 8 AS INT) AS stream_id,
         event_id AS frame_id, ts AS src_ts, value AS latency_ms
  FROM events""",
    "features": """
  SELECT vec_id AS roi_id, label AS class_id, embedding AS feature FROM embeddings""",
}
NEEDS = {"frames": ("orders",), "boxes": ("lineitem",), "detections": ("orders", "lineitem"), "objects": ("events",), "trace": ("events",), "features": ("embeddings",)}


def with_views(sql: str) -> str:
    """sql behind the views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({v})" for n, v in VIEWS.items()) + "\n" + sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = ["boxes", "frames"] if name == "detections" else []
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in parts)
    sql = (f"WITH {ctes} " if ctes else "") + VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NEEDS[name]}
    return spark.sql(reduce(lambda s, t: s.replace(f"FROM {t}", f"FROM {{{t}}}"), tables, sql), **tables)
