"""Joins of points with polygons, grids and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Landform codes of the national map by class.
LANDFORM_CLASSES = {
    "山地斜面等": ["10101", "11201", "11202", "11203", "11204", "1010101"],
    "崖・段丘崖": ["10202", "10204", "2010201"],
    "地すべり地形": ["10205", "10206"],
    "台地・段丘": ["10301", "10302", "10303", "10304", "10305", "10306", "10307", "10308", "10310", "10312", "10314", "10508", "2010101"],
    "山麓堆積地形": ["10401", "10402", "10403", "10404", "10406", "10407", "3010101"],
    "扇状地": ["10501", "10502", "3020101"],
    "自然堤防": ["10503", "3040101"],
    "天井川等": ["10506", "10507", "10801"],
    "砂州・砂丘": ["10504", "10505", "10512", "3050101"],
    "凹地・浅い谷": ["10601", "2010301"],
    "氾濫平野・海岸平野": ["10701", "10702", "10705", "3030101"],
    "後背低地・湿地": ["10703", "10804", "3030201"],
    "旧河道": ["10704", "3040201", "3040202"],
    "落堀": ["3040301"],
    "河川敷・浜": ["10802", "10803", "10807", "10808"],
    "水部": ["10805", "10806", "10901", "10903", "5010201"],
    "旧水部": ["10904", "5010301"],
    "切土地": ["11001", "11003", "11009", "11011", "4010301"],
    "農耕平坦化地": ["11002"],
    "干拓地": ["11008", "4010101"],
    "盛土地・埋立地": ["11004", "11005", "11006", "11007", "11014", "4010201"],
    "改変工事中": ["11010"],
}
#: The first 17 are natural landforms; the rest is made land.
NATURAL_CLASSES = tuple(LANDFORM_CLASSES)[:17]


def landform_legend(spark) -> DataFrame:
    """``(landform_code, landform_class, natural)``."""
    rows = [(code, name, name in NATURAL_CLASSES) for name, codes in LANDFORM_CLASSES.items() for code in codes]
    return spark.createDataFrame(rows, "landform_code string, landform_class string, natural boolean")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: whether (x, y) lies in a ring, an array of (x, y) structs, closed or not."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i)

    def crosses(i: Column) -> Column:
        a, z = at(i), at(F.when(i == n, F.lit(1)).otherwise(i + 1))
        straddles = (a["y"] > y) != (z["y"] > y)
        return F.when(straddles, x < (z["x"] - a["x"]) * (y - a["y"]) / (z["y"] - a["y"]) + a["x"]).otherwise(F.lit(False))

    count = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda c, i: c + crosses(i).cast("int"))
    return count % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings, so that holes are outside."""
    hits = F.aggregate(rings, F.lit(0), lambda c, ring: c + in_ring(x, y, ring).cast("int"))
    return hits % 2 == 1


def ring_area(ring: Column) -> Column:
    """Unsigned area of a ring (shoelace)."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i)
    term = lambda i: at(i)["x"] * at(F.when(i == n, F.lit(1)).otherwise(i + 1))["y"] - at(F.when(i == n, F.lit(1)).otherwise(i + 1))["x"] * at(i)["y"]
    return F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + term(i))) / 2


def representative_point(ring: Column) -> Column:
    """A point (x, y) inside a ring: its centroid if that is inside, else the middle of the widest part of the line across half its height."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i)
    nxt = lambda i: at(F.when(i == n, F.lit(1)).otherwise(i + 1))
    cross = lambda i: at(i)["x"] * nxt(i)["y"] - nxt(i)["x"] * at(i)["y"]
    steps = F.sequence(F.lit(1), n)
    total = lambda term: F.aggregate(steps, F.lit(0.0), lambda s, i: s + term(i))
    area = total(cross)
    cx, cy = (total(lambda i, a=a: (at(i)[a] + nxt(i)[a]) * cross(i)) / (3 * area) for a in ("x", "y"))
    ys = F.transform(ring, lambda p: p["y"])
    y = (F.array_min(ys) + F.array_max(ys)) / 2
    hits = F.transform(steps, lambda i: F.when((at(i)["y"] > y) != (nxt(i)["y"] > y), (nxt(i)["x"] - at(i)["x"]) * (y - at(i)["y"]) / (nxt(i)["y"] - at(i)["y"]) + at(i)["x"]))
    xs = F.sort_array(F.filter(hits, lambda h: h.isNotNull()))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs) - 1, F.lit(1)), F.lit(2)), lambda k: F.struct((F.try_element_at(xs, k + 1) - F.try_element_at(xs, k)).alias("w"), ((F.try_element_at(xs, k + 1) + F.try_element_at(xs, k)) / 2).alias("x")))
    inside = F.struct(cx.alias("x"), cy.alias("y"))
    return F.when((area != 0) & in_ring(cx, cy, ring), inside).otherwise(F.struct(F.array_max(spans)["x"].alias("x"), y.alias("y")))


def reject_invalid(polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(polygons all of whose rings are valid, counts of rejected ones by code); nothing is repaired."""
    ok = F.forall(F.col("rings"), valid_ring) & (F.size("rings") > 0)
    bad = polygons.where(~F.coalesce(ok, F.lit(False)))
    return polygons.where(ok), bad.groupBy("landform_code").agg(F.count("*").alias("n_rejected"))


def valid_ring(ring: Column) -> Column:
    """At least three different corners, none with a null; what else may be wrong is not repaired."""
    return (F.size(F.array_distinct(ring)) >= 3) & ~F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull())


def _bounds(rings: Column) -> dict[str, Column]:
    flat = F.flatten(rings)
    pick = lambda f, axis: f(F.transform(flat, lambda p: p[axis]))
    return {"__x0": pick(F.array_min, "x"), "__x1": pick(F.array_max, "x"), "__y0": pick(F.array_min, "y"), "__y1": pick(F.array_max, "y")}


def _cover(polygons: DataFrame, cell: float) -> DataFrame:
    """``polygons`` once for each grid cell that its bounds touch."""
    span = lambda a, z: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(z) / cell))
    boxed = polygons.withColumns(_bounds(F.col("rings")))
    return boxed.withColumn("__cx", F.explode(span("__x0", "__x1"))).withColumn("__cy", F.explode(span("__y0", "__y1")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, id_col: str = "point_id", how: str = "inner") -> DataFrame:
    """Every pair of a point and a polygon (column ``rings``) that holds it.

    Both sides meet on grid cells of size ``cell``, which should be of the order of a
    polygon's bounds; no point is tested against a polygon elsewhere.
    """
    keyed = points.withColumns({"__cx": F.floor(F.col("x") / cell), "__cy": F.floor(F.col("y") / cell)})
    x, y = F.col("x"), F.col("y")
    joined = keyed.join(_cover(polygons, cell), ["__cx", "__cy"])
    boxed = joined.where(x.between(F.col("__x0"), F.col("__x1")) & y.between(F.col("__y0"), F.col("__y1")))
    hits = boxed.where(in_polygon(x, y, F.col("rings"))).drop("__cx", "__cy", "__x0", "__x1", "__y0", "__y1", "rings")
    if how == "inner":
        return hits
    return points.join(hits.drop(*[c for c in points.columns if c != id_col]), id_col, "left")


def match_status(points: DataFrame, hits: DataFrame, legend: DataFrame, id_col: str = "point_id") -> DataFrame:
    """One row for each point: counts, codes and classes joined by ``;``, and one of ten statuses.

    ``points`` has ``coordinate_ok`` and ``tile_status`` (ok, download_failed,
    empty_or_read_failed or null); ``hits`` has ``landform_code`` for each polygon hit.
    """
    classed = hits.join(F.broadcast(legend), "landform_code", "left")  # the legend is a fixed table
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ";")
    found = classed.groupBy(id_col).agg(
        F.count("*").alias("feature_n"), F.countDistinct("landform_code").alias("code_n"), F.countDistinct("landform_class").alias("class_n"), text("landform_code").alias("codes"), text("landform_class").alias("classes")
    )
    joined = points.join(found, id_col, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    status = (
        F.when(~F.col("coordinate_ok"), "invalid_coordinate").when(F.col("tile_status") == "download_failed", "tile_download_failed")
        .when(F.col("tile_status") == "empty_or_read_failed", "tile_empty_or_read_failed").when(F.col("tile_status").isNull(), "tile_unavailable")
        .when(n("feature_n") == 0, "no_feature_match").when(F.col("code_n") == 0, "matched_without_code").when(F.col("code_n") > 1, "multiple_codes")
        .when(F.col("class_n") == 0, "matched_unmapped_code").when(F.col("class_n") > 1, "multiple_classes").otherwise("matched")
    )
    blank = lambda c: F.nullif(c, F.lit(""))
    return joined.select(id_col, n("feature_n").alias("feature_match_n"), n("code_n").alias("unique_code_n"), blank(F.col("codes")).alias("landform_code"), blank(F.col("classes")).alias("landform_class"), status.alias("match_status"))


def edges_of(polygons: DataFrame, id_col: str = "polygon_id") -> DataFrame:
    """``(id_col, x1, y1, x2, y2)``: the edges of all rings."""
    ring = F.col("ring")
    nxt = lambda i: F.element_at(ring, F.when(i + 1 == F.size(ring), F.lit(1)).otherwise(i + 2))
    pairs = F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), nxt(i)["x"].alias("x2"), nxt(i)["y"].alias("y2")))
    return polygons.select(id_col, F.explode("rings").alias("ring")).select(id_col, F.explode(pairs).alias("e")).select(id_col, "e.*")


def label_polygons(labels: DataFrame, polygons: DataFrame, cell: float, id_col: str = "label_id") -> DataFrame:
    """For each label the smallest polygon that holds it, else the one with the nearest edge (``how``); ties by id.

    The nearest corner bounds how far the nearest edge can be.  Labels are sorted by that
    reach into classes that double from ``cell`` on, and meet the edges on cells of their class,
    so a far label does not widen the search of the others.
    """
    area = F.aggregate("rings", F.lit(0.0), lambda s, r: F.greatest(s, ring_area(r))).cast("float")  # areas that differ by rounding are equal
    inside = points_in_polygons(labels, polygons.withColumn("__area", area), cell, id_col)
    first = inside.groupBy(id_col).agg(F.min(F.struct("__area", "polygon_id"))["polygon_id"].alias("polygon_id"))
    rest = labels.join(first, id_col, "left_anti")
    edges = edges_of(polygons)
    from strandline.operators.neighbours import nearest_distance

    far = nearest_distance(rest.select(id_col, "x", "y"), edges.select(F.lit(0).alias(id_col), F.col("x1").alias("x"), F.col("y1").alias("y")), id_col).withColumnRenamed("id", id_col)
    step = F.greatest(F.ceil(F.log2(F.greatest(F.col("d") / cell, F.lit(1e-9)))), F.lit(0)).cast("int")
    near = rest.join(far, id_col).select(id_col, "x", "y", step.alias("step"))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("step"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = near.select(id_col, "x", "y", "step", F.explode(around).alias("s"))
    keyed = spread.select(id_col, "x", "y", "step", (F.floor(F.col("x") / size) + F.col("s.i")).alias("cx"), (F.floor(F.col("y") / size) + F.col("s.j")).alias("cy"))
    touched = lambda a, z: F.explode(F.sequence(F.floor(F.least(a, z) / size), F.floor(F.greatest(a, z) / size)))
    steps = near.select("step").distinct()  # a row for each doubling
    covered = edges.join(F.broadcast(steps)).withColumn("cx", touched("x1", "x2")).withColumn("cy", touched("y1", "y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.when(dx * dx + dy * dy > 0, ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / (dx * dx + dy * dy)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    gap = F.hypot(F.col("x1") + t * dx - F.col("x"), F.col("y1") + t * dy - F.col("y"))
    met = keyed.join(covered, ["step", "cx", "cy"]).groupBy(id_col, "polygon_id").agg(F.min(gap).alias("gap"))
    second = met.groupBy(id_col).agg(F.min(F.struct(F.round("gap", 12).alias("gap"), "polygon_id"))["polygon_id"].alias("polygon_id"))
    return first.withColumn("how", F.lit("contains")).unionByName(second.withColumn("how", F.lit("nearest")))


def rasterise(polygons: DataFrame, cell: float) -> DataFrame:
    """``(row, col, polygon_id)``: cells whose centre a polygon holds; of several polygons the smallest id wins."""
    boxed = polygons.withColumns(_bounds(F.col("rings")))
    span = lambda a, z: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(z) / cell))
    cells = boxed.withColumn("col", F.explode(span("__x0", "__x1"))).withColumn("row", F.explode(span("__y0", "__y1")))
    x, y = (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell
    return cells.where(in_polygon(x, y, F.col("rings"))).groupBy("row", "col").agg(F.min("polygon_id").alias("polygon_id"))


def combine_rasters(basins: DataFrame, classes: DataFrame, factor: int = 1000) -> DataFrame:
    """``(row, col, value)`` with value basin * ``factor`` + class, where both are known."""
    joined = basins.select("row", "col", F.col("polygon_id").alias("b")).join(classes.select("row", "col", F.col("polygon_id").alias("c")), ["row", "col"])
    return joined.select("row", "col", (F.col("b") * factor + F.col("c")).alias("value"))


def dissolve(cells: DataFrame, key: str, cell: float) -> DataFrame:
    """``(key, n_cells, area, sources)`` of raster cells with a ``source``."""
    return cells.groupBy(key).agg(F.count("*").alias("n_cells"), (F.count("*") * cell * cell).alias("area"), F.array_join(F.sort_array(F.collect_set("source")), ";").alias("sources"))


def split_slivers(polygons: DataFrame, least: float = 100.0, by_code: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, slivers) by area, with a threshold of its own for some codes."""
    limit = F.lit(least)
    for code, value in (by_code or {}).items():
        limit = F.when(F.col("landform_code") == code, value).otherwise(limit)
    sized = polygons.withColumn("area", F.aggregate("rings", F.lit(0.0), lambda s, r: s + ring_area(r)))
    return sized.where(F.col("area") >= limit), sized.where(F.col("area") < limit)


def bbox_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 for empty ones."""
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    both = width * height
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    either = size(a) + size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def bbox_expand(a: tuple[Column, ...], ratio: float) -> list[Column]:
    dx, dy = (a[2] - a[0]) * ratio, (a[3] - a[1]) * ratio
    return [a[0] - dx, a[1] - dy, a[2] + dx, a[3] + dy]


def bbox_subdivide(frame: DataFrame, n: int, overlap: float = 0.0) -> DataFrame:
    """``frame`` with columns x0, y0, x1, y1 once for each of n x n parts, which overlap by a share of their size."""
    parts = F.sequence(F.lit(0), F.lit(n - 1))
    rows = frame.withColumn("i", F.explode(parts)).withColumn("j", F.explode(parts))
    w, h = (F.col("x1") - F.col("x0")) / n, (F.col("y1") - F.col("y0")) / n
    return rows.withColumns(
        {
            "px0": F.greatest(F.col("x0") + w * (F.col("i") - overlap), F.col("x0")), "px1": F.least(F.col("x0") + w * (F.col("i") + 1 + overlap), F.col("x1")),
            "py0": F.greatest(F.col("y0") + h * (F.col("j") - overlap), F.col("y0")), "py1": F.least(F.col("y0") + h * (F.col("j") + 1 + overlap), F.col("y1")),
        }
    )


def regex_join(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, most: int = 10_000) -> DataFrame:
    """Every pair of a text and a pattern found in it; ``patterns`` is a short table, which is checked."""
    n = patterns.count()
    if n > most:
        raise ValueError(f"{n} patterns; a pattern is tried on every text, so there may be {most} at most")
    return texts.join(F.broadcast(patterns), F.expr(f"`{text}` RLIKE `{pattern}`"))


def keep_last(frame: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``; ties are broken by all columns, so reruns agree."""
    rest = [c for c in frame.columns if c != key]
    last = F.max(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *rest)).alias("__r")
    return frame.groupBy(key).agg(last).select(key, *[F.col("__r")[c].alias(c) for c in rest])


def with_rank(frame: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
