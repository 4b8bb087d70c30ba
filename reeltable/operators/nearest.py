"""Nearest features by an inverted file, without losing any.

Features become vectors of length one, so that both distances are half the square of the distance between points: 1 - cosine, and for histograms
1 - Bhattacharyya's coefficient, which is the cosine of their square roots. Points belong to the nearest of at most CELLS centres, which are
fitted on a bounded sample; whatever they are, the result is the same. A query first meets its own cell, which bounds how far its
nearest point can be. By the triangle inequality, only cells whose centre is no farther than that bound and the cell's radius
can hold a nearer one, and of those only points whose distance to the centre differs from the query's by no more than the bound.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltable.functions.columns import let
from reeltable.functions.tables import Stored

#: Centres at most, rows that they are fitted on at most, rounds of fitting.
CELLS, SAMPLE, FITS = 1_024, 16_384, 4
SLACK = 1e-9


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def point(v: Column, metric: str) -> Column:
    """The vector of length one that stands for a feature; null where it has none."""
    if metric == "cosine":
        return let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))
    return let(total(F.transform(v, lambda x: x.cast("double"))), lambda n: F.when(n > 1e-4, F.transform(v, lambda x: F.sqrt(x.cast("double") / n))))


def centres_of(points: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centres for points (`_v`) of the most frequent length, from a bounded sample that hangs on the points alone."""
    sizes = points.groupBy(F.size("_v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0))
    wanted = max(1, min(cells, int(np.sqrt(sizes[0]["rows"]))))
    rows = points.where(F.size("_v") == sizes[0]["n"]).orderBy(F.xxhash64("_v")).select("_v").limit(min(sample, 16 * wanted)).collect()
    data = np.array([r["_v"] for r in rows])
    centres = data[:wanted]
    for _ in range(FITS):
        near = (data @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))[:, None]
        np.add.at(sums, near, data)
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def far_from(vectors: pd.Series, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors have the centres' length, and those' distances to all centres."""
    fits = np.array([len(v) == centres.shape[1] for v in vectors], dtype=bool)
    data = np.array([v for v, f in zip(vectors, fits, strict=True) if f], dtype=float).reshape(-1, centres.shape[1])
    square = (data**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * data @ centres.T
    return fits, np.sqrt(np.maximum(square, 0))


def in_cells(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """points with `_cell` and `_far`, the distance to its centre. Vectors of another length have a cell a length."""

    @F.pandas_udf("_cell int, _far double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        fits, far = far_from(vectors, centres)
        cell, d = np.array([-len(v) for v in vectors], dtype=np.int32), np.zeros(len(vectors))
        if fits.any():
            cell[fits] = far.argmin(axis=1)
            d[fits] = far.min(axis=1)
        return pd.DataFrame({"_cell": cell, "_far": d})

    return points.withColumn("_x", nearest("_v")).select("*", "_x._cell", "_x._far").drop("_x")


def nearest(query: DataFrame, gallery: DataFrame, block: Sequence[str], metric: str, max_distance: float, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """block, roi_id, gallery_id, distance of each query's nearest gallery row of its block at most max_distance (under 1) away; of equal ones the smallest
    gallery_id. query and gallery: block, roi_id, feature."""
    block = list(block)
    named = lambda df, name: df.select(*block, F.col("roi_id").alias(name), point(F.col("feature"), metric).alias("_v")).where("_v is not null")
    g0 = named(gallery, "gallery_id")
    centres = centres_of(g0.select("_v"), cells, sample)
    if not centres.size:
        return query.limit(0).select(*block, "roi_id", F.col("roi_id").alias("gallery_id"), F.lit(0.0).alias("distance"))
    points, asked = Stored(in_cells(g0, centres)).df, Stored(in_cells(named(query, "roi_id"), centres)).df
    radius = np.full(len(centres), -1.0)
    for r in points.where("_cell >= 0").groupBy("_cell").agg(F.max("_far").alias("r")).collect():  # at most CELLS rows
        radius[r["_cell"]] = r["r"]
    held = points.select(*block, "_cell", "gallery_id", F.col("_v").alias("_g"), F.col("_far").alias("_g_far"))
    match = F.struct((1 - dot(F.col("_v"), F.col("_g"))).alias("distance"), "gallery_id").alias("_m")
    own = asked.join(held, [*block, "_cell"]).where(F.size("_v") == F.size("_g")).select(*block, "roi_id", match).groupBy(*block, "roi_id").agg(F.min("_m.distance").alias("_near"))
    bound = F.sqrt(2 * F.greatest(F.least(F.coalesce("_near", F.lit(max_distance)), F.lit(max_distance)), F.lit(0.0)) + SLACK) + SLACK

    @F.pandas_udf("array<struct<cell:int,far:double>>")
    def reached(vectors: pd.Series, bounds: pd.Series) -> pd.Series:
        fits, far = far_from(vectors, centres)
        out: list = [[{"cell": -len(v), "far": 0.0}] for v in vectors]
        for i, d, b in zip(np.flatnonzero(fits), far, bounds[fits], strict=True):
            out[i] = [{"cell": int(c), "far": float(d[c])} for c in np.flatnonzero((radius >= 0) & (d <= radius + b))]
        return pd.Series(out)

    bounded = asked.join(own, [*block, "roi_id"], "left").withColumn("_bound", bound)
    spread = bounded.select(*block, "roi_id", "_v", "_bound", F.explode(reached("_v", "_bound")).alias("_c")).select(*block, "roi_id", "_v", "_bound", F.col("_c.cell").alias("_cell"), F.col("_c.far").alias("_far"))
    pairs = spread.join(held, [*block, "_cell"]).where((F.abs(F.col("_far") - F.col("_g_far")) <= F.col("_bound")) & (F.size("_v") == F.size("_g")))
    best = pairs.select(*block, "roi_id", match).groupBy(*block, "roi_id").agg(F.min("_m").alias("_m"))
    return best.select(*block, "roi_id", F.col("_m.gallery_id").alias("gallery_id"), F.col("_m.distance").alias("distance")).where(F.col("distance") <= max_distance)
