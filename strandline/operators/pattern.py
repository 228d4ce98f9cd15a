"""Point patterns: density, k-means, hulls, ellipses, nearest-neighbour index, affine fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def density(points: DataFrame, bandwidth: float, cell: float, reach: float = 3.0) -> DataFrame:
    """``(gx, gy, density)``: Gaussian kernel density at cell centres, from the points within ``reach`` bandwidths.

    A point adds to the cells around it only; sums combine on the map side.
    """
    r = int(math.ceil(reach * bandwidth / cell))
    n = points.count()
    span = F.sequence(F.lit(-r), F.lit(r))
    rows = points.select("x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).withColumn("i", F.explode(span)).withColumn("j", F.explode(span))
    gx, gy = F.col("cx") + F.col("i"), F.col("cy") + F.col("j")
    dx, dy = (gx + 0.5) * cell - F.col("x"), (gy + 0.5) * cell - F.col("y")
    d2 = dx * dx + dy * dy
    near = rows.select(gx.alias("gx"), gy.alias("gy"), d2.alias("d2")).where(F.col("d2") <= (reach * bandwidth) ** 2)
    weight = F.exp(-F.col("d2") / (2 * bandwidth**2)) / (2 * math.pi * bandwidth**2 * max(1, n))
    return near.groupBy("gx", "gy").agg(F.sum(weight).alias("density"))


def kmeans(points: DataFrame, ks: range = range(2, 7), seed: int = 1, tries: int = 5) -> tuple[DataFrame, DataFrame]:
    """(points with ``cluster`` at the best silhouette, table of k, cost and silhouette)."""
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(points.dropna(subset=["x", "y"]))
    table, best = [], None
    for k in ks:
        fits = [KMeans(k=k, seed=seed + t, featuresCol="features", predictionCol="cluster").fit(vectors) for t in range(tries)]
        model = min(fits, key=lambda m: m.summary.trainingCost)
        found = model.transform(vectors)
        s = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(found)
        table.append((k, float(model.summary.trainingCost), float(s)))
        if best is None or s > best[0]:
            best = s, found
    return best[1].drop("features"), points.sparkSession.createDataFrame(table, "k int, cost double, silhouette double")


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, anticlockwise (monotone chain)."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hulls(points: DataFrame, key: str) -> DataFrame:
    """``(key, corner, x, y, area)`` of each group's convex hull.

    Each task reduces its part of a group to a hull before the shuffle, so a group
    gathers corners and not points.
    """
    kind = points.schema[key].dataType.simpleString()

    def partial(frames):
        for f in frames:
            for own, part in f.groupby(key):
                h = _hull(part[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({key: own, "x": h[:, 0], "y": h[:, 1]})

    def final(f: pd.DataFrame) -> pd.DataFrame:
        h = _hull(f[["x", "y"]].to_numpy(float))
        x, y = h[:, 0], h[:, 1]
        area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2 if len(h) > 2 else 0.0
        return pd.DataFrame({key: f[key].iloc[0], "corner": np.arange(1, len(h) + 1), "x": x, "y": y, "area": area})

    known = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    return known.mapInPandas(partial, f"{key} {kind}, x double, y double").groupBy(key).applyInPandas(final, f"{key} {kind}, corner int, x double, y double, area double")


def ellipses(points: DataFrame, key: str) -> DataFrame:
    """``(key, n, cx, cy, angle, major, minor)``: the standard deviational ellipse of each group."""
    m = points.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("a"), F.var_pop("y").alias("c"), F.covar_pop("x", "y").alias("b"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    angle = F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2
    return m.select(key, "n", "cx", "cy", angle.alias("angle"), F.sqrt(half + root).alias("major"), F.sqrt(F.greatest(half - root, F.lit(0.0))).alias("minor"))


def nearest_neighbour_index(distances: DataFrame, area: float) -> DataFrame:
    """``(n, mean_distance, expected, index)`` of nearest distances ``d`` in a window of ``area``."""
    expected = 0.5 * F.sqrt(F.lit(float(area)) / F.count("*"))
    return distances.agg(F.count("*").alias("n"), F.avg("d").alias("mean_distance"), expected.alias("expected"), F.try_divide(F.avg("d"), expected).alias("index"))


def hull_window_index(points: DataFrame, distances: DataFrame) -> DataFrame:
    """``nearest_neighbour_index`` of nearest distances ``d`` with the convex hull of ``points`` as the window."""
    area = hulls(points.select(F.lit(0).alias("window"), "x", "y"), "window").agg(F.coalesce(F.max("area"), F.lit(0.0)).alias("area"))
    n, mean = F.count("*"), F.avg("d")
    found = distances.agg(n.alias("n"), mean.alias("mean_distance")).crossJoin(area)  # one row each
    expected = 0.5 * F.sqrt(F.try_divide(F.col("area"), F.col("n")))
    return found.select("n", "mean_distance", expected.alias("expected"), F.try_divide(F.col("mean_distance"), expected).alias("index"))


def affine_fit(pairs: DataFrame, key: str) -> DataFrame:
    """Affine map from (sx, sy) to (tx, ty) for each group by least squares: six coefficients, RMSE, largest residual.

    The normal equations are sums, which combine on the map side; each group is
    solved from nine of them.  Groups with fewer than three points in general
    position are left out.
    """
    m = pairs.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("sx", "sy", "tx", "ty")], F.covar_pop("sx", "sx").alias("xx"), F.covar_pop("sx", "sy").alias("xy"), F.covar_pop("sy", "sy").alias("yy"),
        F.covar_pop("sx", "tx").alias("xu"), F.covar_pop("sy", "tx").alias("yu"), F.covar_pop("sx", "ty").alias("xv"), F.covar_pop("sy", "ty").alias("yv"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda p, q: ((p * F.col("yy") - q * F.col("xy")) / det, (q * F.col("xx") - p * F.col("xy")) / det)
    (a, b_), (c, d_) = solve(F.col("xu"), F.col("yu")), solve(F.col("xv"), F.col("yv"))
    fit = m.where(det > 1e-12).select(key, "n", a.alias("a"), b_.alias("b"), (F.col("tx") - a * F.col("sx") - b_ * F.col("sy")).alias("e"), c.alias("c"), d_.alias("d"), (F.col("ty") - c * F.col("sx") - d_ * F.col("sy")).alias("f"))
    return _with_errors(pairs, fit, key)


def similarity_fit(pairs: DataFrame, key: str) -> DataFrame:
    """As ``affine_fit``, but only turned, scaled by one factor and moved: a = d and b = -c.

    Least squares over all pairs; two different points are enough.
    """
    m = pairs.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("sx", "sy", "tx", "ty")], (F.var_pop("sx") + F.var_pop("sy")).alias("spread"),
        (F.covar_pop("sx", "tx") + F.covar_pop("sy", "ty")).alias("along"), (F.covar_pop("sx", "ty") - F.covar_pop("sy", "tx")).alias("across"))
    p, q = F.col("along") / F.col("spread"), F.col("across") / F.col("spread")
    fit = m.where("spread > 1e-12").select(key, "n", p.alias("a"), (-q).alias("b"), (F.col("tx") - p * F.col("sx") + q * F.col("sy")).alias("e"), q.alias("c"), p.alias("d"), (F.col("ty") - q * F.col("sx") - p * F.col("sy")).alias("f"))
    return _with_errors(pairs, fit, key)


def _with_errors(pairs: DataFrame, fit: DataFrame, key: str) -> DataFrame:
    rows = pairs.join(fit, key)
    u, v = F.col("a") * F.col("sx") + F.col("b") * F.col("sy") + F.col("e") - F.col("tx"), F.col("c") * F.col("sx") + F.col("d") * F.col("sy") + F.col("f") - F.col("ty")
    errors = rows.groupBy(key).agg(F.sqrt(F.avg(u * u + v * v)).alias("rmse"), F.sqrt(F.max(u * u + v * v)).alias("max_residual"))
    return fit.join(errors, key)
