"""Neighbour graphs of points: k nearest and distance bands, by grid cells.

No join is over all pairs.  The k-nearest search joins each open place to those
of the nine cells around it and closes it once its k-th distance is within the cell
size, which proves that no nearer one lies outside; places that stay open go on with
cells twice as wide.  Each place starts with cells of a size that follows from how dense a
bounded sample is around it, so that neither towns nor outliers put many points in one
cell, and points at one place count as one: only their k + 1 smallest ids can be neighbours.
A band that holds much of the points has about as many pairs as there are; what is summed over
them (``band_sums``) is summed where they meet, without a table of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import checkpointed

#: Points of the sample that tells how dense places are, the finest cells (halvings of the bounds), and those told apart at once.
SAMPLE, FINEST, SALTS = 50_000, 44, 64
#: Share of a cell's size within which neighbours are proven; the rest is for rounding in the finest cells.
SURE = 0.9
#: For sums over bands: places of a tile on average, of a tile that one task asks for and that it meets at once, and pairs measured at once.
WANTED, ASKED, MET, PAIRS = 2_000, 25_000, 200_000, 1 << 20


def _around(frame: DataFrame, size: float, *kept: str) -> DataFrame:
    """``frame`` once for each of the nine cells around its point."""
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return frame.select(*kept, F.explode(shifts).alias("s"), cx.alias("cx"), cy.alias("cy")).select(*kept, (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))


def _cells(points: DataFrame, size: float) -> DataFrame:
    return points.select(
        F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"), F.col("id").alias("to_id"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )


def _d2():
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return dx * dx + dy * dy


def _known(points: DataFrame, id_col: str) -> DataFrame:
    # adding zero makes one zero of both
    return checkpointed(points.select(F.col(id_col).alias("id"), (F.col("x").cast("double") + 0.0).alias("x"), (F.col("y").cast("double") + 0.0).alias("y")).dropna())


def _places(known: DataFrame, most: int) -> DataFrame:
    """``(x, y, to_id)``: the ``most`` smallest ids at each place, found salt by salt so that a crowded place is split."""
    salted = known.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = Window.partitionBy("x", "y", "salt").orderBy("id")
    whole = Window.partitionBy("x", "y").orderBy("id")
    some = salted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= most)
    return checkpointed(some.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= most).select("x", "y", F.col("id").alias("to_id")))


def _with_levels(places: DataFrame, crowd: DataFrame, wanted: int, bounds: tuple[float, float, float, float]) -> DataFrame:
    """``places`` ``(x, y, ...)`` with ``level``: how often to halve the bounds for cells that hold some ``wanted`` of ``crowd``.

    The driver gets a bounded sample of ``crowd`` (``x, y``); what it says bears on the cost only.
    """
    x0, y0, width, n = bounds
    every = max(1, int(n // SAMPLE))
    some = crowd.where(F.pmod(F.xxhash64("x", "y"), F.lit(every)) == 0).select("x", "y").limit(4 * SAMPLE).toPandas().to_numpy(float)
    least = max(2, wanted if every == 1 else 4)

    def keys(xy: np.ndarray, level: int) -> np.ndarray:
        at = np.floor((xy - [x0, y0]) * (2.0**level / width)).astype(np.int64)
        with np.errstate(over="ignore"):
            return at[:, 0] * np.int64(-7046029254386353131) + at[:, 1]  # cells that meet by chance only start too fine

    tables = []
    for level in range(FINEST + 1):
        found, counts = np.unique(keys(some, level), return_counts=True)
        if not (counts >= least).any():
            break
        tables.append((found[counts >= least], counts[counts >= least]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(float) for c in ("x", "y")], axis=1)
            level = np.zeros(len(xy), np.int32)
            for i, (cells, counts) in enumerate(tables):
                own = keys(xy, i)
                at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
                finer = np.floor(np.log2(np.maximum(counts * every / max(1, 2 * wanted), 1)) / 2).astype(np.int32) if every > 1 else np.zeros(len(counts), np.int32)
                level = np.where(cells[at] == own, np.minimum(i + finer[at], FINEST), level)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(level.astype(np.int32))], [*batch.schema.names, "level"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema.fields)
    return checkpointed(places.mapInArrow(run, f"{kinds}, level int"))


def _bounds(frame: DataFrame) -> tuple[float, float, float, float]:
    n, x0, x1, y0, y1 = frame.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return x0 or 0.0, y0 or 0.0, max((x1 or 0.0) - (x0 or 0.0), (y1 or 0.0) - (y0 or 0.0), 1e-9) * 1.0000001, n


def _cell(axis: str, low: float, width: float) -> Column:
    return F.floor((F.col(axis) - low) * (F.pow(F.lit(2.0), F.col("level")) / width))


def _round(open_: DataFrame, crowd: DataFrame, bounds: tuple[float, float, float, float], *kept: str) -> DataFrame:
    """Places of ``open_`` (with ``level``) met with those of ``crowd`` ``(x, y, ...)`` in the nine cells around them.

    A place of level 0 meets all: its nine cells hold the bounds.
    """
    x0, y0, width, _ = bounds
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    here = open_.select(*kept, "level", _cell("x", x0, width).alias("cx"), _cell("y", y0, width).alias("cy"), F.explode(shifts).alias("s"))
    here = here.select(*kept, "level", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    levels = open_.select("level").distinct()  # at most FINEST rows
    rest = [c for c in crowd.columns if c not in ("x", "y")]
    there = crowd.join(F.broadcast(levels)).select("level", _cell("x", x0, width).alias("cx"), _cell("y", y0, width).alias("cy"), F.col("x").alias("x2"), F.col("y").alias("y2"), *rest)
    return here.join(there, ["level", "cx", "cy"])


def knn(points: DataFrame, k: int, id_col: str = "point_id") -> DataFrame:
    """``(from_id, to_id, d, rank)``: the k nearest other points, ties by id; all others if there are no more than k.

    Coincident points are neighbours at distance 0.  Rows with a null id or
    coordinate are left out.
    """
    known = _known(points, id_col)
    bounds = _bounds(known)
    n, width = bounds[3], bounds[2]
    k = min(k, n - 1)
    kind = known.schema["id"].dataType.simpleString()
    if k < 1:
        return points.sparkSession.createDataFrame([], f"from_id {kind}, to_id {kind}, d double, rank int")
    crowd = _places(known, k + 1)
    open_, parts = _with_levels(crowd.select("x", "y").distinct(), crowd, k + 1, bounds), []
    w = Window.partitionBy("x", "y").orderBy("d2", "to_id")
    while True:
        met = _round(open_, crowd, bounds, "x", "y").withColumn("d2", _d2())
        found = checkpointed(met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1).select("x", "y", "level", "to_id", "d2", "rank"))
        size = F.lit(width) / F.pow(F.lit(2.0), F.col("level"))
        proven = found.where(F.col("rank") == k + 1).where((F.col("level") == 0) | (F.sqrt("d2") <= SURE * size)).select("x", "y")
        parts.append(found.join(proven, ["x", "y"], "left_semi").drop("level"))
        open_ = checkpointed(open_.join(proven, ["x", "y"], "left_anti").withColumn("level", F.greatest(F.col("level") - 1, F.lit(0))))
        if open_.isEmpty():
            break
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    own = Window.partitionBy("id").orderBy("d2", "to_id")
    out = known.join(near.drop("rank"), ["x", "y"]).where("id <> to_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select(F.col("id").alias("from_id"), "to_id", F.sqrt("d2").alias("d"), "rank")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once: ``(from_id, to_id, d)``."""
    both = edges.select("from_id", "to_id", "d").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "d"))
    return both.groupBy("from_id", "to_id").agg(F.min("d").alias("d"))


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each edge of a symmetric graph, from the smaller id to the larger."""
    return edges.where("from_id < to_id")


def edge_lines(edges: DataFrame, points: DataFrame, id_col: str = "point_id") -> DataFrame:
    """``(from_id, to_id, d, wkt)``: each undirected edge once, as a line in well-known text, ready for a text or vector writer."""
    ends = lambda side, n: points.select(F.col(id_col).alias(side), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias(f"p{n}"))
    joined = undirected(edges).join(ends("from_id", 1), "from_id").join(ends("to_id", 2), "to_id")
    return joined.select("from_id", "to_id", "d", F.concat(F.lit("LINESTRING ("), "p1", F.lit(", "), "p2", F.lit(")")).alias("wkt"))


def within(points: DataFrame, band: float, id_col: str = "point_id") -> DataFrame:
    """``(from_id, to_id, d)``: pairs no further apart than ``band``, in both directions."""
    known = points.select(F.col(id_col).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    pairs = _around(known, band, "id", "x", "y").join(_cells(known, band), ["cx", "cy"]).where("id <> to_id").withColumn("d", F.sqrt(_d2())).where(F.col("d") <= band)
    return pairs.select(F.col("id").alias("from_id"), "to_id", "d")


def _strip_sums(asked: np.ndarray, met: np.ndarray, columns: np.ndarray, band: float) -> np.ndarray:
    """Sums of the ``columns`` of those ``met`` that are within ``band``, for each of ``asked``; rows are x, y.

    Those met are cut into strips and sorted by x.  What is surely inside is a range
    of each strip, summed by differences of running sums; only what is at the rim is
    measured.  With strips of the best height the time grows with the root of the density.
    """
    out = np.zeros((len(asked), columns.shape[1]))
    if not len(asked) or not len(met):
        return out
    low, span = met.min(axis=0), np.ptp(met, axis=0)
    height = max(np.sqrt(6 * np.prod(np.maximum(span, band)) / len(met)), span[1] / 1000)
    strip = ((met[:, 1] - low[1]) / height).astype(np.int64)
    order = np.lexsort((met[:, 0], strip))
    strip, x, y, columns = strip[order], met[order, 0], met[order, 1], columns[order]
    running = np.vstack([np.zeros((1, columns.shape[1])), np.cumsum(columns, axis=0)])
    begins = np.flatnonzero(np.diff(strip, prepend=-1))
    by_y = np.argsort(asked[:, 1], kind="stable")
    ax, ay = asked[by_y, 0], asked[by_y, 1]
    # margins wider than any error of rounding: what lies within them is measured
    tiny, reach, more, less = 1e-15 * max(np.abs(met).max(), np.abs(asked).max()), band * (1 + 1e-9), band * band * (1 + 1e-12), band * band * (1 - 1e-12)
    for a, z in zip(begins, [*begins[1:], len(x)], strict=True):
        y0, y1, own = y[a:z].min(), y[a:z].max(), x[a:z]
        i, j = np.searchsorted(ay, y0 - reach - tiny), np.searchsorted(ay, y1 + reach + tiny, "right")
        if i == j:
            continue
        qx, qy = ax[i:j], ay[i:j]
        near, far = np.maximum(np.maximum(y0 - qy, qy - y1), 0), np.maximum(np.abs(qy - y0), np.abs(qy - y1))
        wide, sure = np.sqrt(np.maximum(more - near * near, 0)) + tiny, np.sqrt(np.maximum(less - far * far, 0)) - tiny
        first, last = a + np.searchsorted(own, qx - wide), a + np.searchsorted(own, qx + wide, "right")
        inside = np.where(sure > 0, a + np.searchsorted(own, qx - sure), first)
        outside = np.where(sure > 0, a + np.searchsorted(own, qx + sure, "right"), first)
        sums = running[outside] - running[inside]
        starts, counts = np.concatenate([first, outside]), np.concatenate([inside - first, last - outside])
        ends = np.cumsum(counts)
        for part in np.split(np.arange(len(counts)), np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS))):
            who = np.repeat(part, counts[part])
            if not len(who):
                continue
            at = starts[who] + np.arange(len(who)) - (ends[who] - counts[who] - (ends[part[0]] - counts[part[0]]))
            who %= j - i
            dx, dy = x[at] - qx[who], y[at] - qy[who]
            hit = np.sqrt(dx * dx + dy * dy) <= band
            for c in range(columns.shape[1]):
                sums[:, c] += np.bincount(who[hit], columns[at[hit], c], j - i)
        out[by_y[i:j]] += sums
    return out


def band_sums(places: DataFrame, band: float, columns: list[str], keys: list[str]) -> DataFrame:
    """``(*keys, x, y, *columns)``: the sums of ``columns`` over the places of equal keys within ``band`` of each place, itself included.

    ``places`` has one row for each ``(*keys, x, y)``, all finite.  No pair leaves the task that
    meets it.  Places are dealt out by tiles no smaller than the band; crowded tiles are
    dealt into several tasks, by those that ask and those that are met.
    """
    n, x0, x1, y0, y1 = places.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max(band, math.sqrt(max(x1 - x0, band) * max(y1 - y0, band) * WANTED / n)) if n else band
    tile = lambda axis, low, by=0.0: F.floor((F.col(axis) + by - (low or 0.0)) / side)
    reach = band * (1 + 1e-9)
    around = lambda axis, low: F.explode(F.sequence(tile(axis, low, -reach), tile(axis, low, reach)))
    values = [F.col(c).cast("double").alias(c) for c in columns]
    asked = places.select(*keys, "x", "y", tile("x", x0).alias("tx"), tile("y", y0).alias("ty"))
    met = places.select(*keys, "x", "y", *values, around("x", x0).alias("tx")).select("*", around("y", y0).alias("ty"))
    by = [*keys, "tx", "ty"]
    sizes = asked.groupBy(*by).agg(F.ceil(F.count("*") / ASKED).alias("n_a")).join(met.groupBy(*by).agg(F.ceil(F.count("*") / MET).alias("n_m")), by)
    sizes = checkpointed(sizes)
    blocks = sizes.agg(F.sum(F.col("n_a") * F.col("n_m"))).first()[0] or 1
    some = lambda parts: F.pmod(F.xxhash64("x", "y"), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    asking = asked.join(sizes, by).select(*by, "x", "y", *[F.lit(None).cast("double").alias(c) for c in columns], F.lit(True).alias("asks"), some("n_a").alias("a"), each("n_m").alias("m"))
    meeting = met.join(sizes, by).select(*by, "x", "y", *columns, F.lit(False).alias("asks"), each("n_a").alias("a"), some("n_m").alias("m"))
    dealt = asking.unionByName(meeting).repartition(int(min(blocks, 1024)), *by, "a", "m")
    kept = [*keys, "x", "y"]

    def run(block: pa.Table) -> pa.Table:
        mask = block.column("asks")
        own, others = block.filter(mask), block.filter(pc.invert(mask))
        matrix = lambda table, names: np.stack([table.column(c).to_numpy() for c in names], axis=1)
        sums = _strip_sums(matrix(own, ["x", "y"]), matrix(others, ["x", "y"]), matrix(others, columns), band)
        return pa.Table.from_arrays([*(own.column(c) for c in kept), *(pa.array(sums[:, i]) for i in range(len(columns)))], [*kept, *columns])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.select(*kept).schema.fields)
    found = dealt.groupBy(*by, "a", "m").applyInArrow(run, f"{kinds}, {', '.join(f'`{c}` double' for c in columns)}")
    return found.groupBy(*keys, "x", "y").agg(*[F.sum(c).alias(c) for c in columns])


def diagnostics(points: DataFrame, edges: DataFrame, id_col: str = "point_id", far: tuple[float, ...] = (2.0, 5.0)) -> DataFrame:
    """One row: edges, isolates, degrees, edge lengths, and edges longer than each of ``far``."""
    degree = points.select(F.col(id_col).alias("from_id")).join(edges.groupBy("from_id").agg(F.count("*").alias("n")), "from_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    by_point = degree.agg(
        F.count("*").alias("n_points"), F.count_if(F.col("n") == 0).alias("n_isolates"), F.avg("n").alias("mean_degree"), F.median("n").alias("median_degree"), F.max("n").alias("max_degree")
    )
    p = lambda q: F.percentile("d", F.lit(q))
    by_edge = undirected(edges).agg(
        F.count("*").alias("n_edges"), F.min("d").alias("min_d"), F.median("d").alias("median_d"), p(0.90).alias("p90_d"), p(0.95).alias("p95_d"), p(0.99).alias("p99_d"), F.max("d").alias("max_d"),
        *[F.count_if(F.col("d") > f).alias(f"n_beyond_{i + 1}") for i, f in enumerate(far)],
    )
    return by_point.crossJoin(by_edge)  # one row each


def nearest_distance(points: DataFrame, others: DataFrame, id_col: str = "point_id") -> DataFrame:
    """``(id, d)``: distance from each point to the nearest of ``others``; cells widen until one is proven nearest."""
    a, z = _known(points, id_col), checkpointed(_known(others, id_col).select("x", "y").distinct())
    kind = a.schema["id"].dataType.simpleString()
    if z.isEmpty() or a.isEmpty():
        return points.sparkSession.createDataFrame([], f"id {kind}, d double")
    bounds = _bounds(a.select("x", "y").unionByName(z))
    open_, parts = _with_levels(a, z, 1, bounds), []
    while True:
        size = F.lit(bounds[2]) / F.pow(F.lit(2.0), F.col("level"))
        near = checkpointed(_round(open_, z, bounds, "id", "x", "y").groupBy("id", "level").agg(F.sqrt(F.min(_d2())).alias("d")))
        done = near.where((F.col("level") == 0) | (F.col("d") <= SURE * size)).select("id", "d")
        parts.append(done)
        open_ = checkpointed(open_.join(done, "id", "left_anti").withColumn("level", F.greatest(F.col("level") - 1, F.lit(0))))
        if open_.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hausdorff(left: DataFrame, right: DataFrame, id_col: str = "point_id") -> DataFrame:
    """``(left_to_right, right_to_left, hausdorff)`` of two sets of vertices, and the share of each that meets the other exactly."""
    a, z = nearest_distance(left, right, id_col), nearest_distance(right, left, id_col)
    one = a.agg(F.max("d").alias("left_to_right"), F.avg((F.col("d") == 0).cast("int")).alias("left_matched"))
    two = z.agg(F.max("d").alias("right_to_left"), F.avg((F.col("d") == 0).cast("int")).alias("right_matched"))
    return one.crossJoin(two).withColumn("hausdorff", F.greatest("left_to_right", "right_to_left"))  # one row each
