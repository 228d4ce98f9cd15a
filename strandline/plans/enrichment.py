"""Keys, point-in-polygon joins, rasters, dictionaries and addresses over the driver tables.

Points of the embeddings are set on the globe by an affine shift; boxes and triangles
of a 5 x 5 grid over the points stand for polygons, parts for addresses.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandline.functions import codes, tiles
from strandline.functions import flags as fl
from strandline.functions import numeric as num
from strandline.operators import address, enrich, radiocarbon
from strandline.plans import bindings as b
from strandline.plans.registry import query

_GLOBE = "g AS (SELECT vec_id, 139.5::DOUBLE + embedding[1]::DOUBLE AS lon, 35.5::DOUBLE + embedding[2]::DOUBLE AS lat FROM embeddings)"


def _globe(spark, d):
    e = b.table(spark, d, "embeddings")
    return e.select("vec_id", (F.col("embedding")[0].cast("double") + 139.5).alias("lon"), (F.col("embedding")[1].cast("double") + 35.5).alias("lat"))


# G1, X15
@query(
    "tile_key",
    f"""WITH {_GLOBE}, t AS (SELECT vec_id, least(greatest(floor((lon + 180) / 360 * 16384), 0), 16383)::INT AS tx, least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384), 0), 16383)::INT AS ty FROM g)
    SELECT vec_id, tx, ty, '14/' || tx || '/' || ty AS tile_id FROM t""",
)
def tile_key(spark, d):
    x, y = tiles.tile(F.col("lon"), F.col("lat"), 14)
    return _globe(spark, d).select("vec_id", x.alias("tx"), y.alias("ty"), tiles.tile_id(x, y, 14).alias("tile_id"))


# Tiles of a box with a buffer of one, and their bounds
@query(
    "tile_bbox",
    f"""WITH {_GLOBE}, bx AS (SELECT floor((min(lon) + 180) / 360 * 256)::INT - 1 AS x0, floor((max(lon) + 180) / 360 * 256)::INT + 1 AS x1, floor((1 - ln(tan(radians(max(lat))) + 1 / cos(radians(max(lat)))) / pi()) / 2 * 256)::INT - 1 AS y0, floor((1 - ln(tan(radians(min(lat))) + 1 / cos(radians(min(lat)))) / pi()) / 2 * 256)::INT + 1 AS y1 FROM g),
    t AS (SELECT unnest(range(x0, x1 + 1)) AS tx, y0, y1 FROM bx), u AS (SELECT tx, unnest(range(y0, y1 + 1)) AS ty FROM t)
    SELECT tx::INT AS tx, ty::INT AS ty, round(tx / 256.0::DOUBLE * 360 - 180, 6) AS west, round((tx + 1) / 256.0::DOUBLE * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * ty / 256.0::DOUBLE)))), 6) AS north, round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 256.0::DOUBLE)))), 6) AS south FROM u""",
)
def tile_bbox(spark, d):
    box = _globe(spark, d).agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    x0, y0 = tiles.tile(F.col("w"), F.col("n"), 8)
    x1, y1 = tiles.tile(F.col("e"), F.col("s"), 8)
    keys = box.select(F.explode(F.sequence(x0 - 1, x1 + 1)).alias("tx"), (y0 - 1).alias("a"), (y1 + 1).alias("z")).select("tx", F.explode(F.sequence("a", "z")).alias("ty"))
    return keys.select(
        "tx", "ty", F.round(tiles.tile_west(F.col("tx"), 8), 6).alias("west"), F.round(tiles.tile_west(F.col("tx") + 1, 8), 6).alias("east"), F.round(tiles.tile_north(F.col("ty"), 8), 6).alias("north"), F.round(tiles.tile_north(F.col("ty") + 1, 8), 6).alias("south")
    )


_MESH = """m AS (SELECT *, lat * 1.5 AS ls FROM g), m1 AS (SELECT *, floor(ls)::INT AS p, floor(lon)::INT - 100 AS q, (ls - floor(ls)) * 8 AS la, (lon - floor(lon)) * 8 AS lo FROM m), m2 AS (SELECT *, (la - floor(la)) * 10 AS lb, (lo - floor(lo)) * 10 AS lp FROM m1), m3 AS (SELECT *, (lb - floor(lb)) * 10 AS lc, (lp - floor(lp)) * 10 AS lq FROM m2),
mesh AS (SELECT vec_id, lpad(p::VARCHAR, 2, '0') || lpad(q::VARCHAR, 2, '0') || floor(la)::INT || floor(lo)::INT || floor(lb)::INT || floor(lp)::INT || floor(lc)::INT || floor(lq)::INT AS mesh FROM m3)"""


# G4
@query("mesh100", f"WITH {_GLOBE}, {_MESH} SELECT vec_id, mesh FROM mesh")
def mesh100(spark, d):
    return _globe(spark, d).select("vec_id", tiles.mesh100(F.col("lon"), F.col("lat")).alias("mesh"))


# Attributes by mesh code
@query("mesh_join", f"WITH {_GLOBE}, {_MESH}, a AS (SELECT DISTINCT mesh FROM mesh WHERE vec_id % 3 = 0) SELECT vec_id, mesh, CASE WHEN a.mesh IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM mesh LEFT JOIN a USING (mesh)")
def mesh_join(spark, d):
    keyed = _globe(spark, d).select("vec_id", tiles.mesh100(F.col("lon"), F.col("lat")).alias("mesh"))
    attributes = keyed.where("vec_id % 3 = 0").select("mesh", F.lit("matched").alias("hit")).distinct()
    return keyed.join(attributes, "mesh", "left").select("vec_id", "mesh", F.coalesce("hit", F.lit("unmatched")).alias("status"))


# G5
@query("web_mercator", f"WITH {_GLOBE} SELECT vec_id, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y FROM g")
def web_mercator(spark, d):
    x, y = tiles.web_mercator(F.col("lon"), F.col("lat"))
    return _globe(spark, d).select("vec_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _plane_sql() -> str:
    f = tiles.GRS80_F
    n = f / (2 - f)
    e = 2 * math.sqrt(n) / (1 + n)
    a = tiles.GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * tiles.IX_SCALE
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    s0 = math.sin(math.radians(tiles.IX_LAT))
    xi0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    north0 = a * (xi0 + sum(c * math.sin(2 * j * xi0) for j, c in enumerate(al, 1)))
    east = "eta" + "".join(f" + {c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(al, 1))
    north = "xi" + "".join(f" + {c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(al, 1))
    return f"""WITH {_GLOBE}, s AS (SELECT vec_id, radians(lon - {tiles.IX_LON!r}::DOUBLE) AS dl, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t FROM g),
    u AS (SELECT vec_id, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM s) SELECT vec_id, round({a!r}::DOUBLE * ({east}), 3) AS x, round({a!r}::DOUBLE * ({north}) - {north0!r}::DOUBLE, 3) AS y FROM u"""


@query("plane_coordinates", _plane_sql())
def plane_coordinates(spark, d):
    x, y = tiles.transverse_mercator(F.col("lon"), F.col("lat"))
    return _globe(spark, d).select("vec_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# PF1, PF11
@query("coordinate_status", "SELECT vec_id, CASE WHEN vec_id % 11 = 0 AND vec_id % 7 = 0 THEN 'missing_both' WHEN vec_id % 11 = 0 THEN 'missing_lon' WHEN vec_id % 7 = 0 THEN 'missing_lat' WHEN vec_id % 5 = 0 THEN 'non_numeric' WHEN vec_id % 3 = 0 THEN 'out_of_range' ELSE 'valid' END AS status FROM embeddings")
def coordinate_status(spark, d):
    i = F.col("vec_id")
    lon = F.when(i % 11 == 0, F.when(i % 2 == 0, "  ")).when(i % 5 == 0, "abc").when(i % 3 == 0, "999").otherwise(F.col("lon").cast("string"))
    lat = F.when(i % 7 == 0, F.when(i % 2 == 0, "")).otherwise(F.col("lat").cast("string"))
    return _globe(spark, d).select("vec_id", fl.coordinate_status(lon, lat).alias("status"))


def _boxes(spark):
    """25 unit-size boxes with an overlap to the right, over the range of the points, and their codes."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    i, j = F.col("i"), F.col("j")
    x0, y0, x1, y1 = -0.5 + 0.2 * i, -0.5 + 0.2 * j, -0.5 + 0.2 * i + 0.25, -0.5 + 0.2 * j + 0.2
    ring = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))
    legend = F.array(*map(F.lit, ("10101", "10202", "10301", "99999", "10503")))
    grid = spark.range(25).select(F.col("id").alias("polygon_id"), (F.col("id") % 5).alias("i"), F.floor(F.col("id") / 5).alias("j"))
    return grid.select("polygon_id", F.element_at(legend, (F.col("polygon_id") % 5 + 1).cast("int")).alias("landform_code"), F.array(ring).alias("rings"))


_BOX = f"""WITH {b.SQL_POINT}, bx AS (SELECT i AS polygon_id, (['10101','10202','10301','99999','10503'])[i % 5 + 1] AS landform_code, -0.5::DOUBLE + 0.2::DOUBLE * (i % 5) AS x0, -0.5::DOUBLE + 0.2::DOUBLE * (i // 5) AS y0, -0.5::DOUBLE + 0.2::DOUBLE * (i % 5) + 0.25::DOUBLE AS x1, -0.5::DOUBLE + 0.2::DOUBLE * (i // 5) + 0.2::DOUBLE AS y1 FROM range(25) t(i)),
hit AS (SELECT point_id, polygon_id, landform_code FROM point JOIN bx ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)"""


# J8
@query("point_in_polygon", f"{_BOX} SELECT point_id, polygon_id FROM hit")
def point_in_polygon(spark, d):
    return enrich.points_in_polygons(b.points(spark, d), _boxes(spark), 0.2).select("point_id", "polygon_id")


# J9, G6, G7
@query(
    "landform_match",
    f"""{_BOX}, lg AS (SELECT * FROM (VALUES ('10101','山地斜面等'),('10202','崖・段丘崖'),('10301','台地・段丘'),('10503','自然堤防')) t(landform_code, landform_class)), a AS (SELECT point_id, count(*) AS n, count(DISTINCT landform_code) AS cn, count(DISTINCT landform_class) AS kn, string_agg(DISTINCT landform_code, ';' ORDER BY landform_code) AS codes, string_agg(DISTINCT landform_class, ';' ORDER BY landform_class) AS classes FROM hit LEFT JOIN lg USING (landform_code) GROUP BY 1)
    SELECT p.point_id, coalesce(n, 0) AS feature_match_n, coalesce(cn, 0) AS unique_code_n, codes AS landform_code, classes AS landform_class, CASE WHEN p.point_id % 13 = 0 THEN 'invalid_coordinate' WHEN p.point_id % 17 = 0 THEN 'tile_download_failed' WHEN p.point_id % 19 = 0 THEN 'tile_unavailable'
    WHEN n IS NULL THEN 'no_feature_match' WHEN cn > 1 THEN 'multiple_codes' WHEN kn = 0 THEN 'matched_unmapped_code' ELSE 'matched' END AS match_status FROM point p LEFT JOIN a USING (point_id)""",
)
def landform_match(spark, d):
    p = b.points(spark, d)
    i = F.col("point_id")
    told = p.select("point_id", (i % 13 != 0).alias("coordinate_ok"), F.when(i % 17 == 0, "download_failed").when(i % 19 != 0, "ok").alias("tile_status"))
    hits = enrich.points_in_polygons(p, _boxes(spark), 0.2)
    return enrich.match_status(told, hits, enrich.landform_legend(spark))


# J12
@query(
    "label_polygons",
    f"""{_BOX}, ev AS (SELECT * FROM bx WHERE polygon_id % 2 = 0), inn AS (SELECT point_id, min(polygon_id) AS polygon_id FROM hit WHERE polygon_id % 2 = 0 GROUP BY 1),
    far AS (SELECT point_id, polygon_id, row_number() OVER (PARTITION BY point_id ORDER BY round(sqrt(greatest(x0 - x, 0, x - x1) ** 2 + greatest(y0 - y, 0, y - y1) ** 2), 12), polygon_id) AS k FROM point CROSS JOIN ev WHERE point_id NOT IN (SELECT point_id FROM inn))
    SELECT point_id AS label_id, polygon_id, 'contains' AS how FROM inn UNION ALL SELECT point_id, polygon_id, 'nearest' FROM far WHERE k = 1""",
)
def label_polygons(spark, d):
    labels = b.points(spark, d).select(F.col("point_id").alias("label_id"), "x", "y")
    return enrich.label_polygons(labels, _boxes(spark).where("polygon_id % 2 = 0"), 0.2)


# G12, G13, A21, G9
@query(
    "raster_overlay",
    f"""{_BOX}, c AS (SELECT r.i AS row, k.i AS col FROM range(-10, 12) r(i) CROSS JOIN range(-10, 12) k(i)), o AS (SELECT row, col, min(polygon_id) * 1000 + min(polygon_id % 5) AS value FROM c JOIN bx ON (col + 0.5) * 0.05::DOUBLE > x0 AND (col + 0.5) * 0.05::DOUBLE < x1 AND (row + 0.5) * 0.05::DOUBLE > y0 AND (row + 0.5) * 0.05::DOUBLE < y1 GROUP BY ALL)
    SELECT value, count(*) AS n_cells, round(count(*) * 0.0025::DOUBLE, 6) AS area, string_agg(DISTINCT 'tile' || (row % 2), ';' ORDER BY 'tile' || (row % 2)) AS sources FROM o GROUP BY 1""",
)
def raster_overlay(spark, d):
    basins = enrich.rasterise(_boxes(spark), 0.05)
    classes = enrich.rasterise(_boxes(spark).withColumn("polygon_id", F.col("polygon_id") % 5), 0.05)
    combined = enrich.combine_rasters(basins, classes).withColumn("source", F.concat(F.lit("tile"), F.col("row") % 2))
    return enrich.dissolve(combined, "value", 0.05).withColumn("area", F.round("area", 6))


# G11
@query("sliver_filter", "SELECT i AS polygon_id, (['10101','10202','10301','99999','10503'])[i % 5 + 1] AS landform_code, 0.05::DOUBLE AS area, CASE WHEN i % 5 = 1 THEN 'sliver' ELSE 'kept' END AS side FROM range(25) t(i)")
def sliver_filter(spark, d):
    kept, slivers = enrich.split_slivers(_boxes(spark), 0.04, {"10202": 0.06})
    both = kept.withColumn("side", F.lit("kept")).unionByName(slivers.withColumn("side", F.lit("sliver")))
    return both.select("polygon_id", "landform_code", F.round("area", 6).alias("area"), "side")


# Only valid rings go on, and each has a point for its label
@query("polygon_labels", "SELECT i AS polygon_id, round(-0.5::DOUBLE + 0.2::DOUBLE * (i % 5) + 0.125, 6) AS x, round(-0.5::DOUBLE + 0.2::DOUBLE * (i // 5) + 0.1, 6) AS y FROM range(25) t(i)")
def polygon_labels(spark, d):
    valid, _ = enrich.reject_invalid(_boxes(spark))
    p = enrich.representative_point(F.col("rings")[0])
    return valid.select("polygon_id", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


# G17
@query(
    "bbox_operations",
    f"{_BOX} SELECT a.polygon_id AS left_id, z.polygon_id AS right_id, round(greatest(least(a.x1, z.x1) - greatest(a.x0, z.x0), 0) * greatest(least(a.y1, z.y1) - greatest(a.y0, z.y0), 0) / (0.05 + 0.05 - greatest(least(a.x1, z.x1) - greatest(a.x0, z.x0), 0) * greatest(least(a.y1, z.y1) - greatest(a.y0, z.y0), 0)), 6) AS iou FROM bx a JOIN bx z ON z.polygon_id = a.polygon_id + 1",
)
def bbox_operations(spark, d):
    ring = F.col("rings")[0]
    boxes = _boxes(spark).select("polygon_id", ring[0]["x"].alias("x0"), ring[0]["y"].alias("y0"), ring[2]["x"].alias("x1"), ring[2]["y"].alias("y1"))
    left = boxes.select(F.col("polygon_id").alias("left_id"), (F.col("polygon_id") + 1).alias("right_id"), *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    both = left.join(boxes.withColumnRenamed("polygon_id", "right_id"), "right_id")
    iou = enrich.bbox_iou(tuple(F.col(f"a{c}") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    return both.select("left_id", "right_id", F.round(iou, 6).alias("iou"))


# J16
@query("regex_dictionary", "SELECT p_partkey, k.kind FROM part JOIN (VALUES ('metal','STEEL|BRASS|COPPER|TIN|NICKEL'),('large','^LARGE'),('plated','PLATED')) k(kind, pat) ON regexp_matches(p_type, pat)")
def regex_dictionary(spark, d):
    patterns = spark.createDataFrame([("metal", "STEEL|BRASS|COPPER|TIN|NICKEL"), ("large", "^LARGE"), ("plated", "PLATED")], "kind string, pat string")
    return enrich.regex_join(b.table(spark, d, "part").select("p_partkey", "p_type"), patterns, "p_type", "pat").select("p_partkey", "kind")


# Addresses are part names with a number, areas are brands
def _addresses(spark, d):
    p = b.table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.lit(" １丁目")).when(F.col("p_partkey") % 4 == 2, F.lit("－３")).otherwise(F.lit(" annex"))
    lead = F.when(F.col("p_partkey") % 9 == 8, F.lit("old ")).when(F.col("p_partkey") % 10 == 7, F.lit("near ")).otherwise("")
    return p.select(F.col("p_partkey").alias("address_id"), F.col("p_brand").alias("area"), F.concat(lead, F.col("p_type"), tail).alias("address"))


_ADDRESS = """a AS (SELECT p_partkey AS address_id, p_brand AS area, (CASE WHEN p_partkey % 9 = 8 THEN 'old ' WHEN p_partkey % 10 = 7 THEN 'near ' ELSE '' END) || p_type || (CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' 1丁目' WHEN 2 THEN '-3' ELSE ' annex' END) AS address FROM part),
n AS (SELECT DISTINCT p_brand AS area, p_type AS name, replace(p_type, ' ', '') AS k FROM part)"""


@query(
    "address_cascade",
    f"""WITH {_ADDRESS}, s AS (SELECT *, replace(address, ' ', '') AS body FROM a),
    c AS (SELECT address_id, k, name, CASE WHEN address = name THEN 1 WHEN body = k THEN 2 WHEN starts_with(body, k) THEN 3 WHEN starts_with(body, 'old' || k) THEN 4 WHEN contains(body, k) THEN 5 END AS m FROM s JOIN n USING (area)),
    r AS (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY m, length(name) DESC, name) AS i FROM c WHERE m IS NOT NULL)
    SELECT a.address_id, CASE WHEN m = 5 THEN k ELSE name END AS name, coalesce((['exact', 'normalised', 'partial', 'alias', 'dictionary'])[m], 'unresolved') AS method FROM a LEFT JOIN r ON r.address_id = a.address_id AND i = 1""",
)
def address_cascade(spark, d):
    p = b.table(spark, d, "part")
    names = p.select(F.col("p_brand").alias("area"), F.col("p_type").alias("name")).distinct()
    aliases = names.select("area", F.concat(F.lit("old "), "name").alias("old_name"), "name")
    return address.cascade(_addresses(spark, d), names, aliases)


# no name of an area stands inside or across another here, so each that occurs is found at its first place
@query("longest_dictionary_match", f"WITH {_ADDRESS} SELECT address_id, name, strpos(address, name) - 1 AS start FROM a JOIN n USING (area) WHERE contains(address, name)")
def longest_dictionary_match(spark, d):
    p = b.table(spark, d, "part")
    words = p.select(F.col("p_brand").alias("area"), F.explode(F.split("p_type", " ")).alias("name")).unionByName(p.select(F.col("p_brand").alias("area"), F.col("p_type").alias("name"))).distinct()
    return address.longest_matches(_addresses(spark, d), words)


# K9, K17
@query("address_check")
def address_check(spark, d):
    found = address_cascade(spark, d)
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("address_id"), "p_brand", F.col("p_type").alias("own"))
    joined = p.join(found.hint("merge"), "address_id")  # as many rows on either side, whatever the size of the file
    i = F.col("address_id")
    areas = F.when(i % 6 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    recorded = F.when(i % 5 == 0, "other").otherwise(F.col("p_brand"))
    lgc = address.lgc_check(i % 7 != 0, areas, recorded)
    town = address.town_check(i % 7 != 0, areas, F.col("name"), F.array("own"))
    checked = joined.select((i + 1).alias("row_number"), lgc.alias("lgc_check"), town.alias("town_check"), F.concat_ws("; ", "name", "own").alias("candidates"))
    return checked.withColumn("overall", address.overall_check(F.col("lgc_check"), F.col("town_check"))).where("overall <> 'OK'")


# X1, X7, X16, PF7
@query(
    "code_normalisation",
    "SELECT s_suppkey, lpad(s_nationkey::VARCHAR, 5, '0') AS code, 'S_' || trim(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN s_nationkey % 4 > 0 THEN 'B_' || s_nationkey || '_' || (s_suppkey % 10) END AS composite FROM supplier",
)
def code_normalisation(spark, d):
    s = b.table(spark, d, "supplier")
    part = F.when(F.col("s_nationkey") % 4 > 0, F.col("s_nationkey").cast("string"))
    return s.select(
        "s_suppkey", codes.plain_code(F.concat(F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(".0 ")), 5).alias("code"), F.concat(F.lit("S_"), codes.safe_name(F.col("s_name"))).alias("slug"), codes.composite("B_", part, (F.col("s_suppkey") % 10).cast("string")).alias("composite")
    )


# X3
@query("nfkc", "SELECT p_partkey, nfc_normalize(p_type) AS plain, p_partkey::VARCHAR AS folded FROM part")
def nfkc(spark, d):
    wide = F.translate(F.col("p_partkey").cast("string"), "0123456789", "０１２３４５６７８９")
    return b.table(spark, d, "part").select("p_partkey", codes.nfkc_where_needed(F.col("p_type")).alias("plain"), codes.nfkc_where_needed(wide).alias("folded"))


# X10
@query("number_parsing", "SELECT c_custkey, (c_custkey % 1000)::DOUBLE AS from_text, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS finite FROM customer")
def number_parsing(spark, d):
    c = b.table(spark, d, "customer")
    text = F.concat(F.lit("about "), (F.col("c_custkey") % 1000).cast("string"), F.lit(" m, 7"))
    dirty = F.when(F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 2 == 0, "NaN").otherwise("n/a")).otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string")))
    return c.select("c_custkey", num.number_in(text).alias("from_text"), num.finite(dirty).alias("finite"))


# X13, SRC5
@query("json_attributes", "SELECT event_type, count(*) AS n, round(avg((props::JSON ->> '$.k')::DOUBLE), 6) AS mean_k, count(DISTINCT props::JSON ->> '$.k') AS n_values FROM events GROUP BY 1")
def json_attributes(spark, d):
    e = b.table(spark, d, "events").select("event_type", F.from_json("props", "map<string,string>")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("k").try_cast("double")), 6).alias("mean_k"), F.countDistinct("k").alias("n_values"))


# X14
@query("content_hash", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def content_hash(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"))


# SRC6, SNK6: last record of a key wins
@query("sessionless_checkpoint_dedupe", "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def sessionless_checkpoint_dedupe(spark, d):
    e = b.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return enrich.keep_last(e, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


# P5: dates and a curve made of the tables; the published curve is the caller's to supply
def _dates(spark, d):
    c = b.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("date_id"), (F.col("c_acctbal") / 4 + 3000).alias("age"), (20 + F.col("c_custkey") % 40).cast("double").alias("error"), F.col("c_nationkey").alias("site"))


def _curve(spark):
    bp = F.col("id") * 5
    return spark.range(200, 1400).select(bp.cast("double").alias("cal_bp"), (bp * 0.93 + 40 * F.sin(bp / 150)).alias("c14_age"), F.lit(12.0).alias("c14_error"))


@query(
    "radiocarbon_summed_density",
    """WITH d AS (SELECT c_custkey AS date_id, c_acctbal / 4 + 3000 AS age, (20 + c_custkey % 40)::DOUBLE AS error, c_nationkey AS site FROM customer), cu AS (SELECT (i * 5)::DOUBLE AS bp, i * 5 * 0.93::DOUBLE + 40 * sin(i * 5 / 150::DOUBLE) AS c14 FROM range(200, 1400) t(i)),
    raw AS (SELECT date_id, bp, exp(-(c14 - age) * (c14 - age) / (2 * (error * error + 144))) / sqrt(2 * pi() * (error * error + 144)) AS p FROM d JOIN cu ON floor(c14 / 100) BETWEEN floor((age - 6 * sqrt(error * error + 144)) / 100) AND floor((age + 6 * sqrt(error * error + 144)) / 100)),
    cal AS (SELECT date_id, bp, p / sum(p) OVER (PARTITION BY date_id) AS density FROM raw WHERE p > 1e-12), st AS (SELECT *, coalesce((age - lag(age) OVER (PARTITION BY site ORDER BY age, date_id) > 100)::INT, 0) AS new FROM d),
    bn AS (SELECT date_id, site || '_' || sum(new) OVER (PARTITION BY site ORDER BY age, date_id) AS bin FROM st), sz AS (SELECT bin, count(*) AS n FROM bn GROUP BY 1), tot AS (SELECT bp, sum(density / n) AS density FROM cal JOIN bn USING (date_id) JOIN sz USING (bin) GROUP BY 1)
    SELECT bp AS cal_bp, round(density, 7) AS density, round(avg(density) OVER (ORDER BY bp RANGE BETWEEN 250 PRECEDING AND 250 FOLLOWING), 7) AS running_mean FROM tot""",
)
def radiocarbon_summed_density(spark, d):
    dates = _dates(spark, d)
    found = radiocarbon.summed(radiocarbon.calibrate(dates, _curve(spark)), radiocarbon.bins(dates))
    return found.withColumns({"density": F.round("density", 7), "running_mean": F.round("running_mean", 7)})


@query("radiocarbon_intervals")
def radiocarbon_intervals(spark, d):
    return radiocarbon.highest_density(radiocarbon.calibrate(_dates(spark, d), _curve(spark)))
