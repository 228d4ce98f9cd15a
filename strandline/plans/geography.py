"""Neighbour graphs, spatial statistics and point patterns over the embedding points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import neighbours as nb
from strandline.operators import pattern, spatial
from strandline.operators import sequence as seq
from strandline.plans import bindings as b
from strandline.plans.registry import query
from strandline.session import checkpointed

K, KS, BANDS = 4, (4, 8, 12), (0.1, 0.25, 0.5)


def _knn_sql(k: int, name: str = "", table: str = "point") -> str:
    return f"""d{name} AS (SELECT a.point_id AS from_id, z.point_id AS to_id, sqrt((z.x - a.x) * (z.x - a.x) + (z.y - a.y) * (z.y - a.y)) AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY (z.x - a.x) * (z.x - a.x) + (z.y - a.y) * (z.y - a.y), z.point_id) AS rank FROM {table} a JOIN {table} z ON a.point_id <> z.point_id),
    near{name} AS (SELECT * FROM d{name} WHERE rank <= {k}), edge{name} AS (SELECT from_id, to_id, min(d) AS d FROM (SELECT from_id, to_id, d FROM near{name} UNION ALL SELECT to_id, from_id, d FROM near{name}) GROUP BY 1, 2)"""


def _edges(spark, d, k: int = K) -> DataFrame:
    return checkpointed(nb.symmetric(nb.knn(b.points(spark, d), k)))


def _model(edges: DataFrame, name: str) -> DataFrame:
    return edges.withColumn("model_id", F.lit(name))


# J14, G18
@query("knn_edges", f"WITH {b.SQL_POINT}, {_knn_sql(K)} SELECT from_id, to_id, round(d, 6) AS d, rank FROM near")
def knn_edges(spark, d):
    return nb.knn(b.points(spark, d), K).withColumn("d", F.round("d", 6))


# G19, G36
@query("edge_table", f"WITH {b.SQL_POINT}, {_knn_sql(K)} SELECT from_id, to_id, round(d, 6) AS d, round(a.x, 6) AS x1, round(a.y, 6) AS y1, round(z.x, 6) AS x2, round(z.y, 6) AS y2 FROM edge JOIN point a ON a.point_id = from_id JOIN point z ON z.point_id = to_id WHERE from_id < to_id")
def edge_table(spark, d):
    p = b.points(spark, d)
    ends = lambda side, n: p.select(F.col("point_id").alias(side), F.round("x", 6).alias(f"x{n}"), F.round("y", 6).alias(f"y{n}"))
    return nb.undirected(_edges(spark, d)).join(ends("from_id", 1), "from_id").join(ends("to_id", 2), "to_id").withColumn("d", F.round("d", 6))


# Lines in millionths
@query("edge_lines", f"WITH {b.SQL_POINT}, {_knn_sql(K)} SELECT from_id, to_id, round(d, 6) AS d, 'LINESTRING (' || floor(a.x * 1000000)::BIGINT || ' ' || floor(a.y * 1000000)::BIGINT || ', ' || floor(z.x * 1000000)::BIGINT || ' ' || floor(z.y * 1000000)::BIGINT || ')' AS wkt FROM edge JOIN point a ON a.point_id = from_id JOIN point z ON z.point_id = to_id WHERE from_id < to_id")
def edge_lines(spark, d):
    whole = b.points(spark, d).select("point_id", F.floor(F.col("x") * 1000000).alias("x"), F.floor(F.col("y") * 1000000).alias("y"))
    return nb.edge_lines(_edges(spark, d), whole).withColumn("d", F.round("d", 6))


# G20
@query(
    "neighbour_diagnostics",
    f"""WITH {b.SQL_POINT}, {_knn_sql(K)}, deg AS (SELECT point_id, count(from_id) AS n FROM point LEFT JOIN edge ON from_id = point_id GROUP BY 1), u AS (SELECT d FROM edge WHERE from_id < to_id)
    SELECT * FROM (SELECT count(*) AS n_points, count(*) FILTER (n = 0) AS n_isolates, round(avg(n), 6) AS mean_degree, median(n)::DOUBLE AS median_degree, max(n) AS max_degree FROM deg),
    (SELECT count(*) AS n_edges, round(min(d), 6) AS min_d, round(median(d), 6) AS median_d, round(quantile_cont(d, 0.9), 6) AS p90_d, round(quantile_cont(d, 0.95), 6) AS p95_d, round(quantile_cont(d, 0.99), 6) AS p99_d, round(max(d), 6) AS max_d, count(*) FILTER (d > 2) AS n_beyond_1, count(*) FILTER (d > 5) AS n_beyond_2 FROM u)""",
)
def neighbour_diagnostics(spark, d):
    found = nb.diagnostics(b.points(spark, d), _edges(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_degree", "min_d", "median_d", "p90_d", "p95_d", "p99_d", "max_d")})


# J15, G25
@query("distance_band_degree", f"WITH {b.SQL_POINT}, e AS (SELECT a.point_id AS from_id, t.band FROM point a JOIN point z ON a.point_id <> z.point_id CROSS JOIN (VALUES (0.1::DOUBLE),(0.25::DOUBLE),(0.5::DOUBLE)) t(band) WHERE sqrt((z.x - a.x) * (z.x - a.x) + (z.y - a.y) * (z.y - a.y)) <= band) SELECT band, from_id, count(*) AS degree FROM e GROUP BY ALL")
def distance_band_degree(spark, d):
    p = b.points(spark, d)
    parts = [nb.within(p, band).groupBy("from_id").agg(F.count("*").alias("degree")).withColumn("band", F.lit(band)) for band in BANDS]
    return reduce(DataFrame.unionByName, parts)


def _moran_sql(edges: str, values: str) -> str:
    """Moran's I from tables ``ed(model_id, from_id, to_id)`` and ``va(model_id, id, x)``."""
    return f"""ed AS ({edges}), va AS ({values}), mo AS (SELECT model_id, count(*) AS n, avg(x) AS mean, var_pop(x) AS m2, count(DISTINCT x) AS k FROM va GROUP BY 1), ce AS (SELECT va.model_id, id, x - mean AS z FROM va JOIN mo USING (model_id)),
    m4 AS (SELECT model_id, avg(z ** 4) AS m4 FROM ce GROUP BY 1), dg AS (SELECT model_id, from_id, count(*) AS n FROM ed GROUP BY 1, 2), w AS (SELECT ed.model_id, ed.from_id, ed.to_id, 1.0::DOUBLE / n AS w FROM ed JOIN dg USING (model_id, from_id)),
    su AS (SELECT w.model_id, sum(w.w) AS s0, sum((w.w + coalesce(r.w, 0)) ** 2) / 2 AS s1, sum(w.w * a.z * c.z) AS cr FROM w LEFT JOIN w r ON r.model_id = w.model_id AND r.from_id = w.to_id AND r.to_id = w.from_id JOIN ce a ON a.model_id = w.model_id AND a.id = w.from_id JOIN ce c ON c.model_id = w.model_id AND c.id = w.to_id GROUP BY 1),
    s2 AS (SELECT model_id, sum(t * t) AS s2 FROM (SELECT model_id, id, sum(w) AS t FROM (SELECT model_id, from_id AS id, w FROM w UNION ALL SELECT model_id, to_id, w FROM w) GROUP BY 1, 2) GROUP BY 1),
    al AS (SELECT model_id, n::DOUBLE AS n, k, m2, m4 / (m2 * m2) AS ku, s0, s1, s2, cr FROM mo JOIN m4 USING (model_id) JOIN su USING (model_id) JOIN s2 USING (model_id))
    SELECT model_id, n::BIGINT AS n_points, round(n / s0 * cr / (n * m2), 6) AS moran_i, round(-1 / (n - 1), 6) AS expectation,
    round((n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - ku * (n * (n - 1) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / ((n - 1) * (n - 1)), 8) AS variance FROM al"""


def _moran(edges, values):
    return _rounded(spatial.global_moran(edges, values))


def _rounded(found):
    return found.select("model_id", "n_points", F.round("moran_i", 6).alias("moran_i"), F.round("expectation", 6).alias("expectation"), F.round("variance", 8).alias("variance"))


# X, y and the label on the k-nearest graph
_METRICS = ("x", "y", "label")


def _metric_models(spark, d, edges):
    p = b.points(spark, d)
    values = reduce(DataFrame.unionByName, [p.select(F.lit(m).alias("model_id"), F.col("point_id").alias("id"), F.col(m).cast("double").alias("x")) for m in _METRICS])
    return reduce(DataFrame.unionByName, [_model(edges, m) for m in _METRICS]), values


@query(
    "global_moran",
    f"WITH {b.SQL_POINT}, {_knn_sql(K)}, " + _moran_sql("SELECT m AS model_id, from_id, to_id FROM edge CROSS JOIN (VALUES ('x'),('y'),('label')) t(m)", "SELECT 'x' AS model_id, point_id AS id, x FROM point UNION ALL SELECT 'y', point_id, y FROM point UNION ALL SELECT 'label', point_id, label FROM point"),
)
def global_moran(spark, d):
    return _moran(*_metric_models(spark, d, _edges(spark, d)))


@query(
    "moran_by_k",
    f"WITH {b.SQL_POINT}, {', '.join(_knn_sql(k, str(k)) for k in KS)}, "
    + _moran_sql(" UNION ALL ".join(f"SELECT 'k{k}' AS model_id, from_id, to_id FROM edge{k}" for k in KS), " UNION ALL ".join(f"SELECT 'k{k}' AS model_id, point_id AS id, label AS x FROM point" for k in KS)),
)
def moran_by_k(spark, d):
    p = b.points(spark, d)
    edges = reduce(DataFrame.unionByName, [_model(_edges(spark, d, k), f"k{k}") for k in KS])
    values = reduce(DataFrame.unionByName, [p.select(F.lit(f"k{k}").alias("model_id"), F.col("point_id").alias("id"), F.col("label").alias("x")) for k in KS])
    return _moran(edges, values)


@query(
    "moran_distance_band",
    f"WITH {b.SQL_POINT}, " + _moran_sql("SELECT 'band' AS model_id, a.point_id AS from_id, z.point_id AS to_id FROM point a JOIN point z ON a.point_id <> z.point_id WHERE sqrt((z.x - a.x) * (z.x - a.x) + (z.y - a.y) * (z.y - a.y)) <= 0.25", "SELECT 'band' AS model_id, point_id AS id, label AS x FROM point"),
)
def moran_distance_band(spark, d):
    p = b.points(spark, d)
    return _rounded(spatial.band_moran(p, p.select(F.lit("band").alias("model_id"), F.col("point_id").alias("id"), F.col("label").alias("x")), 0.25))


# The graph is rebuilt on each active subset
def _active(spark, d):
    """Points joined to places by id: (phase_pair, id, x, y, transition) of active transitions."""
    t = seq.transitions(b.place_states(spark, d)).where("transition <> 'apparent_absence_continue'")
    p = b.points(spark, d)
    return t.join(p, t.place_id == p.point_id).select("phase_pair", F.col("point_id").alias("id"), "x", "y", "transition")


_TWO = ("Pa->Jo", "He->Me")
_EVENTS = ("continue", "drop", "new")


@query(
    "active_universe_moran",
    f"""WITH {b.SQL_PRESENCE}, {b.SQL_POINT}, tr AS (SELECT a.place_id, a.phase_code || '->' || z.phase_code AS pair, CASE WHEN a.presence = 1 AND z.presence = 1 THEN 'continue' WHEN a.presence = 1 THEN 'drop' ELSE 'new' END AS event FROM presence a JOIN presence z ON z.place_id = a.place_id AND z.phase_order = a.phase_order + 1 WHERE a.presence + z.presence > 0),
    {', '.join(f"point{i} AS (SELECT point.*, event FROM point JOIN tr ON place_id = point_id WHERE pair = '{p}'), {_knn_sql(K, str(i), f'point{i}')}" for i, p in enumerate(_TWO))}, """
    + _moran_sql(
        " UNION ALL ".join(f"SELECT '{p}|{e}' AS model_id, from_id, to_id FROM edge{i}" for i, p in enumerate(_TWO) for e in _EVENTS),
        " UNION ALL ".join(f"SELECT '{p}|{e}' AS model_id, point_id AS id, (event = '{e}')::INT AS x FROM point{i}" for i, p in enumerate(_TWO) for e in _EVENTS),
    ),
)
def active_universe_moran(spark, d):
    active = _active(spark, d).where(F.col("phase_pair").isin(*_TWO))
    models, values = [], []
    for pair in _TWO:
        own = active.where(F.col("phase_pair") == pair)
        edges = nb.symmetric(nb.knn(own, K, "id"))
        for event in _EVENTS:
            models.append(_model(edges, f"{pair}|{event}"))
            values.append(own.select(F.lit(f"{pair}|{event}").alias("model_id"), "id", (F.col("transition") == event).cast("int").alias("x")))
    return _moran(reduce(DataFrame.unionByName, models), reduce(DataFrame.unionByName, values))


def _label_events(spark, d):
    return b.points(spark, d).select(F.lit("label0").alias("model_id"), F.col("point_id").alias("id"), (F.col("label") == 0).cast("int").alias("x"))


# G26
@query(
    "lisa_quadrant",
    f"""WITH {b.SQL_POINT}, {_knn_sql(K)}, s AS (SELECT point_id AS id, x, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z, count(*) OVER () AS n FROM point), l AS (SELECT from_id AS id, avg(z) AS lag FROM edge JOIN s ON s.id = to_id GROUP BY 1)
    SELECT id, round(z, 6) AS z, round(lag, 6) AS lag, round(z * lag * n / (n - 1), 6) AS local_i, CASE WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z < 0 AND lag < 0 THEN 'LL' WHEN z > 0 AND lag < 0 THEN 'HL' WHEN z < 0 AND lag > 0 THEN 'LH' ELSE 'undefined' END AS quadrant FROM s JOIN l USING (id)""",
)
def lisa_quadrant(spark, d):
    p = b.points(spark, d)
    found = spatial.local_moran(_model(_edges(spark, d), "x"), p.select(F.lit("x").alias("model_id"), F.col("point_id").alias("id"), "x"))
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("z", "lag", "local_i")], "quadrant")


@query("lisa_permutation")
def lisa_permutation(spark, d):
    p = b.points(spark, d)
    return spatial.lisa_permutation(_model(_edges(spark, d), "x"), p.select(F.lit("x").alias("model_id"), F.col("point_id").alias("id"), "x"))


# G27
@query("join_count_bb", f"WITH {b.SQL_POINT}, {_knn_sql(K)} SELECT p.point_id AS id, (p.label = 0)::INT AS x, CASE WHEN p.label = 0 THEN count(z.point_id) ELSE 0 END AS bb FROM point p LEFT JOIN edge ON from_id = p.point_id LEFT JOIN point z ON z.point_id = to_id AND z.label = 0 GROUP BY p.point_id, p.label")
def join_count_bb(spark, d):
    return spatial.join_count(_model(_edges(spark, d), "label0"), _label_events(spark, d)).select("id", F.col("x").cast("int").alias("x"), "bb")


# G28, G30
@query(
    "gstar_z",
    f"""WITH {b.SQL_POINT}, {_knn_sql(K)}, v AS (SELECT point_id AS id, (label = 0)::INT::DOUBLE AS x FROM point), a AS (SELECT from_id AS id, sum(v.x) AS s, count(*) AS k FROM edge JOIN v ON v.id = to_id GROUP BY 1), m AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM v)
    SELECT id, k AS n_neighbours, round((s + x - mu * (k + 1)) / (sd * sqrt((n * (k + 1) - (k + 1) * (k + 1)) / (n - 1))), 6) AS g_z FROM v JOIN a USING (id) CROSS JOIN m""",
)
def gstar_z(spark, d):
    return spatial.gstar(_model(_edges(spark, d), "label0"), _label_events(spark, d)).select("id", "n_neighbours", F.round("g_z", 6).alias("g_z"))


@query("local_event_tests")
def local_event_tests(spark, d):
    return spatial.binary_permutation(_model(_edges(spark, d), "label0"), _label_events(spark, d))


# G29, G31
@query("prevalence_route", "SELECT 'label' || t.l AS model_id, round(avg((label <= t.l)::INT), 6) AS prevalence, CASE WHEN avg((label <= t.l)::INT) IN (0, 1) THEN 'not_tested_no_contrast' WHEN avg((label <= t.l)::INT) <= 0.5 THEN 'local_join_count' ELSE 'local_getis_ord_gstar' END AS method FROM embeddings CROSS JOIN (VALUES (0),(4),(9),(7)) t(l) GROUP BY t.l")
def prevalence_route(spark, d):
    levels = F.array(*map(F.lit, (0, 4, 9, 7)))
    rows = b.points(spark, d).withColumn("l", F.explode(levels)).select(F.concat(F.lit("label"), "l").alias("model_id"), (F.col("label") <= F.col("l")).cast("int").alias("x"))
    return spatial.route(rows).withColumn("prevalence", F.round("prevalence", 6))


@query(
    "domain_universe",
    f"""WITH {b.SQL_DOMAIN}, p AS (SELECT a.activity_domain, a.place_id, a.phase_code || '->' || z.phase_code AS pair, a.presence AS s, z.presence AS e FROM domain a JOIN domain z ON z.place_id = a.place_id AND z.activity_domain = a.activity_domain AND z.phase_order = a.phase_order + 1),
    v AS (SELECT activity_domain || '|' || pair AS model_id, (s = 0 AND e = 1)::INT AS x FROM p WHERE s IS NOT NULL AND e IS NOT NULL AND s + e > 0)
    SELECT model_id, count(*) AS n_points, sum(x)::BIGINT AS n_events, CASE WHEN count(*) < 20 THEN 'not_analyzed_few_points' WHEN sum(x) < 5 THEN 'not_analyzed_few_events' WHEN count(*) - sum(x) < 5 THEN 'not_analyzed_few_non_events' ELSE 'analyzed' END AS status FROM v GROUP BY 1""",
)
def domain_universe(spark, d):
    t = seq.transitions(b.domain_states(spark, d)).where("transition <> 'apparent_absence_continue'")
    rows = t.select(F.concat_ws("|", "activity_domain", "phase_pair").alias("model_id"), (F.col("transition") == "new").cast("int").alias("x"))
    return spatial.universe_status(rows)


# One graph and all local tests for each domain, on the first pair of phases
@query("domain_local_tests")
def domain_local_tests(spark, d):
    t = seq.transitions(b.domain_states(spark, d)).where("transition <> 'apparent_absence_continue' AND phase_pair = 'Pa->Jo'")
    p = b.points(spark, d)
    own = t.join(p, t.place_id == p.point_id).select("activity_domain", F.col("point_id").alias("id"), "x", "y", (F.col("transition") == "new").cast("int").alias("event"))
    models, values = [], []
    for name in ("1-URGENT", "5-LOW"):
        rows = own.where(F.col("activity_domain") == name)
        models.append(_model(nb.symmetric(nb.knn(rows, K, "id")), name))
        values.append(rows.select(F.lit(name).alias("model_id"), "id", F.col("event").alias("x")))
    return spatial.binary_permutation(reduce(DataFrame.unionByName, models), reduce(DataFrame.unionByName, values))


# One column for each label
@query("gstar_wide", f"WITH {b.SQL_POINT}, {_knn_sql(K)}, c AS (SELECT from_id AS id, z.label, count(*) AS n FROM edge JOIN point z ON z.point_id = to_id GROUP BY ALL) SELECT id, coalesce(max(n) FILTER (label = 0), 0) AS near_0, coalesce(max(n) FILTER (label = 1), 0) AS near_1, coalesce(max(n) FILTER (label = 2), 0) AS near_2 FROM c GROUP BY id")
def gstar_wide(spark, d):
    p = b.points(spark, d).select(F.col("point_id").alias("to_id"), F.concat(F.lit("near_"), "label").alias("name"))
    return _edges(spark, d).join(p, "to_id").groupBy(F.col("from_id").alias("id")).pivot("name", ["near_0", "near_1", "near_2"]).agg(F.count(F.lit(1))).fillna(0)


# Sensitivity to merging points of a cell
@query(
    "aggregation_sensitivity",
    f"WITH {b.SQL_POINT}, merged AS (SELECT min(point_id) AS point_id, round(x, 1) AS x, round(y, 1) AS y, avg(label) AS label FROM point GROUP BY round(x, 1), round(y, 1)), {_knn_sql(K, '1')}, {_knn_sql(K, '2', 'merged')}, "
    + _moran_sql("SELECT 'all_points' AS model_id, from_id, to_id FROM edge1 UNION ALL SELECT 'merged', from_id, to_id FROM edge2", "SELECT 'all_points' AS model_id, point_id AS id, label::DOUBLE AS x FROM point UNION ALL SELECT 'merged', point_id, label FROM merged"),
)
def aggregation_sensitivity(spark, d):
    p = b.points(spark, d)
    merged = p.groupBy(F.round("x", 1).alias("gx"), F.round("y", 1).alias("gy")).agg(F.min("point_id").alias("point_id"), F.avg("label").alias("label")).select("point_id", F.col("gx").alias("x"), F.col("gy").alias("y"), "label")
    parts = []
    for name, frame in (("all_points", p), ("merged", merged)):
        edges = _model(nb.symmetric(nb.knn(frame, K)), name)
        parts.append(_moran(edges, frame.select(F.lit(name).alias("model_id"), F.col("point_id").alias("id"), F.col("label").alias("x"))))
    return parts[0].unionByName(parts[1])


# Connected areas of like points
@query(
    "like_areas",
    f"""WITH RECURSIVE {b.SQL_POINT}, {_knn_sql(K)}, inside AS (SELECT from_id, to_id FROM edge JOIN point a ON a.point_id = from_id JOIN point z ON z.point_id = to_id WHERE a.x > 0 AND z.x > 0),
    walk AS (SELECT point_id AS id, point_id AS reached FROM point WHERE x > 0 UNION SELECT walk.id, to_id FROM walk JOIN inside ON from_id = reached), c AS (SELECT id, min(reached) AS area_id FROM walk GROUP BY 1)
    SELECT id, area_id, count(*) OVER (PARTITION BY area_id) AS n_points, count(*) OVER (PARTITION BY area_id) >= 20 AS named FROM c""",
)
def like_areas(spark, d):
    classed = b.points(spark, d).select(F.col("point_id").alias("id"), F.when(F.col("x") > 0, "high").otherwise("low").alias("class"))
    return spatial.areas(_edges(spark, d), classed, "high")


# J21
@query("nearest_distance", f"WITH {b.SQL_POINT} SELECT a.point_id AS id, round(min(sqrt((z.x - a.x) * (z.x - a.x) + (z.y - a.y) * (z.y - a.y))), 6) AS d FROM point a JOIN point z ON a.label = 0 AND z.label = 1 GROUP BY 1")
def nearest_distance(spark, d):
    p = b.points(spark, d)
    return nb.nearest_distance(p.where("label = 0"), p.where("label = 1")).withColumn("d", F.round("d", 6))


# Vertex comparison of two outlines
@query(
    "vertex_hausdorff",
    f"""WITH {b.SQL_POINT}, m AS (SELECT a.point_id AS i, z.point_id AS j, sqrt((z.x - a.x) * (z.x - a.x) + (z.y - a.y) * (z.y - a.y)) AS d FROM point a JOIN point z ON a.label <= 4 AND z.label >= 4), l AS (SELECT i, min(d) AS d FROM m GROUP BY 1), r AS (SELECT j, min(d) AS d FROM m GROUP BY 1)
    SELECT round((SELECT max(d) FROM l), 6) AS left_to_right, round((SELECT avg((d = 0)::INT) FROM l), 6) AS left_matched, round((SELECT max(d) FROM r), 6) AS right_to_left, round((SELECT avg((d = 0)::INT) FROM r), 6) AS right_matched, round(greatest((SELECT max(d) FROM l), (SELECT max(d) FROM r)), 6) AS hausdorff""",
)
def vertex_hausdorff(spark, d):
    p = b.points(spark, d)
    found = nb.hausdorff(p.where("label <= 4"), p.where("label >= 4"))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


# J11
@query("grid_cell_count", f"WITH {b.SQL_POINT} SELECT floor(x / 0.2)::BIGINT AS gx, floor(y / 0.2)::BIGINT AS gy, count(*) AS n, count(DISTINCT label) AS n_labels FROM point GROUP BY 1, 2")
def grid_cell_count(spark, d):
    return b.points(spark, d).groupBy(F.floor(F.col("x") / 0.2).alias("gx"), F.floor(F.col("y") / 0.2).alias("gy")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


# P1
@query(
    "kernel_density",
    f"""WITH {b.SQL_POINT}, n AS (SELECT count(*) AS n FROM point), o AS (SELECT unnest(range(-6, 7)) AS i), c AS (SELECT floor(x / 0.1) + a.i AS gx, floor(y / 0.1) + z.i AS gy, x, y FROM point CROSS JOIN o a CROSS JOIN o z),
    e AS (SELECT gx, gy, ((gx + 0.5) * 0.1::DOUBLE - x) ** 2 + ((gy + 0.5) * 0.1::DOUBLE - y) ** 2 AS d2 FROM c) SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, round(sum(exp(-d2 / (2 * 0.2 ** 2)) / (2 * pi() * 0.2 ** 2 * n)), 5) AS density FROM e CROSS JOIN n WHERE d2 <= 0.36 - 1e-9 GROUP BY 1, 2""",
)
def kernel_density(spark, d):
    return pattern.density(b.points(spark, d), 0.2, 0.1).withColumn("density", F.round("density", 5))


# P2
@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return pattern.kmeans(b.points(spark, d), range(2, 5), tries=2)[0]


# P3
@query(
    "convex_hulls",
    f"""WITH {b.SQL_POINT}, e AS (SELECT a.label, a.x, a.y, z.x AS x2, z.y AS y2 FROM point a JOIN point z ON a.label = z.label AND (a.x <> z.x OR a.y <> z.y) WHERE NOT EXISTS (SELECT 1 FROM point k WHERE k.label = a.label AND (z.x - a.x) * (k.y - a.y) - (z.y - a.y) * (k.x - a.x) < 0))
    SELECT label, round(x, 6) AS x, round(y, 6) AS y, round(sum(x * y2 - x2 * y) OVER (PARTITION BY label) / 2, 6) AS area FROM e""",
)
def convex_hulls(spark, d):
    found = pattern.hulls(b.points(spark, d), "label")
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("x", "y", "area")])


@query(
    "standard_ellipses",
    f"""WITH {b.SQL_POINT}, m AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM point GROUP BY 1) SELECT label, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(atan2(2 * b, a - c) / 2, 5) AS angle,
    round(sqrt((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b)), 6) AS major, round(sqrt(greatest((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 0)), 6) AS minor FROM m""",
)
def standard_ellipses(spark, d):
    return pattern.ellipses(b.points(spark, d), "label").select("label", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("angle", 5).alias("angle"), F.round("major", 6).alias("major"), F.round("minor", 6).alias("minor"))


# P4
@query("nearest_neighbour_index", f"WITH {b.SQL_POINT}, {_knn_sql(1)} SELECT count(*) AS n, round(avg(d), 6) AS mean_distance, round(0.5 * sqrt(4.0::DOUBLE / count(*)), 6) AS expected, round(avg(d) / (0.5 * sqrt(4.0::DOUBLE / count(*))), 6) AS index FROM near")
def nearest_neighbour_index(spark, d):
    found = pattern.nearest_neighbour_index(nb.knn(b.points(spark, d), 1), 4.0)
    return found.withColumns({c: F.round(c, 6) for c in ("mean_distance", "expected", "index")})


# The convex hull as window
@query("nearest_neighbour_hull")
def nearest_neighbour_hull(spark, d):
    p = b.points(spark, d)
    return pattern.hull_window_index(p, nb.knn(p, 1))


# K14
@query("similarity_fit", f"WITH {b.SQL_POINT}, p AS (SELECT label, 1.2 * x - 0.5 * y + label AS tx, 0.5 * x + 1.2 * y - 3 AS ty FROM point) SELECT label, count(*) AS n, 1.2::DOUBLE AS a, -0.5::DOUBLE AS b, label::DOUBLE AS e, 0.5::DOUBLE AS c, 1.2::DOUBLE AS d, -3.0::DOUBLE AS f, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS max_residual FROM p GROUP BY label")
def similarity_fit(spark, d):
    x, y = F.col("x"), F.col("y")
    pairs = b.points(spark, d).select("label", x.alias("sx"), y.alias("sy"), (1.2 * x - 0.5 * y + F.col("label")).alias("tx"), (0.5 * x + 1.2 * y - 3).alias("ty"))
    return pattern.similarity_fit(pairs, "label").select("label", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("a", "b", "e", "c", "d", "f", "rmse", "max_residual")])


@query("affine_fit", f"WITH {b.SQL_POINT}, p AS (SELECT label, x AS sx, y AS sy, 2 * x - 0.5 * y + label AS tx, 0.25 * x + 1.5 * y - 3 AS ty FROM point) SELECT label, count(*) AS n, 2.0::DOUBLE AS a, -0.5::DOUBLE AS b, label::DOUBLE AS e, 0.25::DOUBLE AS c, 1.5::DOUBLE AS d, -3.0::DOUBLE AS f, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS max_residual FROM p GROUP BY label")
def affine_fit(spark, d):
    x, y = F.col("x"), F.col("y")
    pairs = b.points(spark, d).select("label", x.alias("sx"), y.alias("sy"), (2 * x - 0.5 * y + F.col("label")).alias("tx"), (0.25 * x + 1.5 * y - 3).alias("ty"))
    return pattern.affine_fit(pairs, "label").select("label", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("a", "b", "e", "c", "d", "f", "rmse", "max_residual")])
