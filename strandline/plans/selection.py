"""Availability and selection over nations (basins) and market segments (landforms).

Area is the value of orders; an order whose key is a multiple of 20 lies outside the
surveyed part of its basin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import select as sel
from strandline.operators import sequence as seq
from strandline.plans import bindings as b
from strandline.plans.registry import query

_KNOWN = "o_orderkey % 20 <> 0"
_AREA = f"""area AS (SELECT unit_basin AS basin, landform, o_totalprice AS area, {_KNOWN} AS known FROM orders JOIN place ON place_id = o_custkey),
avail AS (SELECT basin, landform, sum(area) AS area, sum(area) / sum(sum(area)) OVER (PARTITION BY basin) AS share_basin, sum(area) / sum(sum(area)) OVER () AS share_all FROM area WHERE known GROUP BY basin, landform),
cov AS (SELECT basin, sum(area) AS area, sum(CASE WHEN known THEN area ELSE 0 END) AS known_area, sum(CASE WHEN known THEN area ELSE 0 END) / sum(area) AS coverage FROM area GROUP BY basin)"""
_OBS = f"""WITH {b.SQL_PRESENCE}, {b.SQL_PLACE}, {_AREA},
obs AS (SELECT phase_order, unit_basin AS basin, landform, count(*) AS n FROM presence JOIN place USING (place_id) WHERE presence = 1 GROUP BY ALL),
unit AS (SELECT t.phase_order, t.basin, a.landform, coalesce(o.n, 0) AS observed, t.total * a.share_basin AS expected FROM (SELECT phase_order, basin, sum(n) AS total FROM obs GROUP BY ALL) t JOIN avail a ON a.basin = t.basin LEFT JOIN obs o ON o.phase_order = t.phase_order AND o.basin = t.basin AND o.landform = a.landform)"""
_DESC = "round(observed / expected, 6) AS selection_ratio, round(log2((observed + 0.5) / (expected + 0.5)), 6) AS log2_selection_ratio, round((observed - expected) / sqrt(expected), 6) AS pearson_residual, CASE WHEN expected >= 5 THEN 'expected_ge_5' WHEN expected >= 1 THEN 'expected_1_to_5' ELSE 'expected_lt_1' END AS expected_status"


def _cells(spark, d):
    # orders shrink to sums by customer before they meet the places
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("place_id"), F.expr(_KNOWN).alias("known"), "o_totalprice").groupBy("place_id", "known").agg(F.sum("o_totalprice").alias("area"))
    return o.join(b.places(spark, d), "place_id").select(F.col("unit_basin").alias("basin"), "landform", "area", "known")


def _available(spark, d):
    return sel.availability(_cells(spark, d).where("known"))


def _observed(spark, d):
    rows = seq.long(b.places(spark, d).join(b.place_states(spark, d), "place_id")).where("presence = 1")
    return rows.groupBy("phase_order", F.col("unit_basin").alias("basin"), "landform").agg(F.count("*").alias("n"))


def _unit(spark, d):
    return sel.expected_by_basin(_observed(spark, d), _available(spark, d), "phase_order")


def _rounded(frame):
    return frame.withColumns({c: F.round(c, 6) for c in ("expected", "selection_ratio", "log2_selection_ratio", "pearson_residual")})


# C9, A21, G14
@query("availability", f"WITH {b.SQL_PLACE}, {_AREA} SELECT basin, landform, round(area, 2) AS area, round(share_basin, 8) AS share_basin, round(share_all, 8) AS share_all FROM avail")
def availability(spark, d):
    return _available(spark, d).select("basin", "landform", F.round("area", 2).alias("area"), F.round("share_basin", 8).alias("share_basin"), F.round("share_all", 8).alias("share_all"))


@query("coverage_thresholds", f"WITH {b.SQL_PLACE}, {_AREA} SELECT threshold, count(*) AS n_basins, count(*) FILTER (coverage >= threshold) AS n_eligible, round(sum(known_area) / sum(area), 8) AS area_coverage FROM cov CROSS JOIN (VALUES (0.90::DOUBLE),(0.95::DOUBLE),(0.99::DOUBLE)) t(threshold) GROUP BY threshold")
def coverage_thresholds(spark, d):
    return sel.eligible(sel.coverage(_cells(spark, d), F.col("known"))).withColumn("area_coverage", F.round("area_coverage", 8))


# C10, C11
@query(
    "observed_availability_audit",
    f"{_OBS} SELECT phase_order, count(*) AS n_units, sum(n)::BIGINT AS n_records, count(a.landform) AS n_matched_units, coalesce(sum(n) FILTER (a.landform IS NOT NULL), 0)::BIGINT AS n_matched_records FROM obs o LEFT JOIN avail a ON a.basin = o.basin AND a.landform = o.landform GROUP BY phase_order",
)
def observed_availability_audit(spark, d):
    known = _available(spark, d).select("basin", "landform", F.lit(1).alias("hit"))
    joined = sel.require_rows(_observed(spark, d), "observed places").join(known, ["basin", "landform"], "left")
    return joined.groupBy("phase_order").agg(
        F.count("*").alias("n_units"), F.sum("n").alias("n_records"), F.count("hit").alias("n_matched_units"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("n_matched_records")
    )


# Area-based expectation
@query(
    "area_selection",
    f"""{_OBS}, s AS (SELECT landform, sum(share_all) AS p FROM avail GROUP BY 1), tot AS (SELECT phase_order, sum(n) AS total FROM obs GROUP BY 1), o AS (SELECT phase_order, landform, sum(n)::BIGINT AS n FROM obs GROUP BY ALL),
    cell AS (SELECT t.phase_order, s.landform, coalesce(n, 0) AS observed, total * p AS expected FROM tot t CROSS JOIN s LEFT JOIN o ON o.phase_order = t.phase_order AND o.landform = s.landform) SELECT phase_order, landform, observed, round(expected, 6) AS expected, {_DESC} FROM cell""",
)
def area_selection(spark, d):
    return _rounded(sel.describe(sel.expected_by_area(_observed(spark, d), _available(spark, d), "phase_order")))


# Basin-conditioned expectation
@query("selection_ratio", f"{_OBS}, cell AS (SELECT phase_order, landform, sum(observed)::BIGINT AS observed, sum(expected) AS expected FROM unit GROUP BY ALL) SELECT phase_order, landform, observed, round(expected, 6) AS expected, {_DESC} FROM cell")
def selection_ratio(spark, d):
    return _rounded(sel.describe(sel.over_basins(_unit(spark, d), "phase_order")))


# C14
@query("expected_by_basin", f"{_OBS} SELECT phase_order, basin, landform, observed, round(expected, 6) AS expected, {_DESC} FROM unit WHERE expected > 0")
def expected_by_basin(spark, d):
    return _rounded(sel.describe(_unit(spark, d).where("expected > 0")))


@query("selection_chi_square", f"{_OBS}, cell AS (SELECT phase_order, landform, sum(observed)::BIGINT AS observed, sum(expected) AS expected FROM unit GROUP BY ALL) SELECT phase_order, round(sum((observed - expected) ** 2 / expected), 6) AS chi_square, count(*) AS n_cells FROM cell WHERE expected > 0 GROUP BY 1")
def selection_chi_square(spark, d):
    return sel.chi_square(sel.over_basins(_unit(spark, d), "phase_order"), "phase_order").withColumn("chi_square", F.round("chi_square", 6))


@query("selection_monte_carlo")
def selection_monte_carlo(spark, d):
    unit = _unit(spark, d)
    return sel.signals(sel.over_basins(unit, "phase_order"), sel.monte_carlo(unit, "phase_order"), "phase_order")


@query("area_selection_monte_carlo")
def area_selection_monte_carlo(spark, d):
    cells = sel.expected_by_area(_observed(spark, d), _available(spark, d), "phase_order")
    return sel.signals(cells, sel.monte_carlo(cells, "phase_order", basin=None), "phase_order")


# C15
_THRESHOLD = f"""{_OBS}, cell AS (SELECT threshold, phase_order, landform, sum(observed)::BIGINT AS observed, sum(expected) AS expected FROM unit JOIN cov USING (basin) CROSS JOIN (VALUES (0.90::DOUBLE),(0.95::DOUBLE),(0.99::DOUBLE)) t(threshold) WHERE coverage >= threshold GROUP BY ALL)"""


def _by_threshold(spark, d):
    cov = sel.coverage(_cells(spark, d), F.col("known")).select("basin", "coverage")
    rows = _unit(spark, d).join(cov, "basin").withColumn("threshold", F.explode(F.array(*map(F.lit, sel.THRESHOLDS)))).where("coverage >= threshold")
    return sel.describe(rows.groupBy("threshold", "phase_order", "landform").agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected")))


@query("threshold_sensitivity", f"{_THRESHOLD} SELECT threshold, phase_order, landform, observed, round(expected, 6) AS expected, {_DESC} FROM cell")
def threshold_sensitivity(spark, d):
    return _rounded(_by_threshold(spark, d))


@query(
    "threshold_stability",
    f"{_THRESHOLD}, v AS (SELECT *, log2((observed + 0.5) / (expected + 0.5)) AS l FROM cell) SELECT phase_order, landform, count(*) AS n_thresholds, min(sign(round(l, 9))) = max(sign(round(l, 9))) AS direction_stable, round(max(l) - min(l), 6) AS value_range FROM v GROUP BY ALL",
)
def threshold_stability(spark, d):
    return sel.stability(_by_threshold(spark, d), ["phase_order", "landform"]).withColumn("value_range", F.round("value_range", 6))


# C16
@query(
    "selection_change",
    f"""{_OBS}, cell AS (SELECT phase_order, landform, sum(observed)::BIGINT AS observed, sum(expected) AS expected FROM unit GROUP BY ALL), v AS (SELECT phase_order, landform, log2((observed + 0.5) / (expected + 0.5)) AS l FROM cell),
    p AS (SELECT a.phase_order, a.landform, a.l AS la, z.l AS lz, rank() OVER (PARTITION BY a.phase_order ORDER BY a.l) AS ra, rank() OVER (PARTITION BY a.phase_order ORDER BY z.l) AS rz FROM v a JOIN v z ON z.phase_order = a.phase_order + 1 AND z.landform = a.landform)
    SELECT phase_order, count(*) AS n_classes, round(corr(ra, rz), 6) AS spearman, round(avg(abs(lz - la)), 6) AS mean_abs_change, round(sqrt(avg((lz - la) ** 2)), 6) AS rms_change FROM p GROUP BY 1""",
)
def selection_change(spark, d):
    found = sel.change(sel.describe(sel.over_basins(_unit(spark, d), "phase_order")), "phase_order")
    return found.withColumns({c: F.round(c, 6) for c in ("spearman", "mean_abs_change", "rms_change")})


# C17
@query(
    "domain_selection",
    f"""WITH {b.SQL_DOMAIN}, {b.SQL_PLACE}, {_AREA}, obs AS (SELECT activity_domain, phase_order, unit_basin AS basin, landform, count(*) AS n FROM domain JOIN place USING (place_id) WHERE presence = 1 GROUP BY ALL),
    tot AS (SELECT activity_domain, phase_order, basin, sum(n) AS total FROM obs GROUP BY ALL), ok AS (SELECT activity_domain, phase_order FROM obs GROUP BY ALL HAVING sum(n) >= 20)
    SELECT t.activity_domain, t.phase_order, a.landform, sum(coalesce(o.n, 0))::BIGINT AS observed, round(sum(total * share_basin), 6) AS expected FROM tot t JOIN ok USING (activity_domain, phase_order) JOIN avail a ON a.basin = t.basin
    LEFT JOIN obs o ON o.activity_domain = t.activity_domain AND o.phase_order = t.phase_order AND o.basin = t.basin AND o.landform = a.landform GROUP BY ALL""",
)
def domain_selection(spark, d):
    rows = seq.long(b.places(spark, d).join(b.domain_states(spark, d), "place_id")).where("presence = 1")
    key = F.concat_ws("|", "activity_domain", "phase_order").alias("key")
    observed = rows.groupBy(key, F.col("unit_basin").alias("basin"), "landform").agg(F.count("*").alias("n"))
    enough = observed.groupBy("key").agg(F.sum("n").alias("t")).where("t >= 20").select("key")
    cells = sel.over_basins(sel.expected_by_basin(observed.join(enough, "key", "left_semi"), _available(spark, d), "key"), "key")
    part = F.split("key", r"\|")
    return cells.select(part[0].alias("activity_domain"), part[1].cast("int").alias("phase_order"), "landform", "observed", F.round("expected", 6).alias("expected"))


# C18, C20
@query(
    "selection_map_status",
    f"""{_OBS}, g AS (SELECT p.phase_order, a.basin, a.landform, a.area FROM phase p CROSS JOIN avail a), m AS (SELECT g.*, coverage, observed, expected FROM g JOIN cov USING (basin) LEFT JOIN unit u ON u.phase_order = g.phase_order AND u.basin = g.basin AND u.landform = g.landform),
    s AS (SELECT phase_order, area, CASE WHEN coverage < 0.95 THEN 'below_coverage' WHEN expected IS NULL THEN 'no_observation' ELSE 'evaluated' END AS status, greatest(least(log2((observed + 0.5) / (expected + 0.5)), 3), -3) AS l FROM m)
    SELECT phase_order, status, count(*) AS n_units, round(sum(area) / sum(sum(area)) OVER (PARTITION BY phase_order), 6) AS area_share, round(min(CASE WHEN status = 'evaluated' THEN l END), 6) AS min_log2, round(max(CASE WHEN status = 'evaluated' THEN l END), 6) AS max_log2 FROM s GROUP BY phase_order, status""",
)
def selection_map_status(spark, d):
    from pyspark.sql import Window

    grid = _available(spark, d).select("basin", "landform", "area").withColumn("phase_order", F.explode(F.sequence(F.lit(1), F.lit(len(seq.PHASES)))))
    cov = sel.coverage(_cells(spark, d), F.col("known")).select("basin", "coverage")
    m = grid.join(cov, "basin").join(sel.describe(_unit(spark, d)), ["phase_order", "basin", "landform"], "left")
    status = F.when(F.col("coverage") < 0.95, "below_coverage").when(F.col("expected").isNull(), "no_observation").otherwise("evaluated")
    held = F.when(status == "evaluated", F.greatest(F.least("log2_selection_ratio", F.lit(3.0)), F.lit(-3.0)))
    sums = m.groupBy("phase_order", status.alias("status")).agg(F.count("*").alias("n_units"), F.sum("area").alias("a"), F.min(held).alias("lo"), F.max(held).alias("hi"))
    return sums.select("phase_order", "status", "n_units", F.round(F.col("a") / F.sum("a").over(Window.partitionBy("phase_order")), 6).alias("area_share"), F.round("lo", 6).alias("min_log2"), F.round("hi", 6).alias("max_log2"))


# C19
@query("area_audit", f"WITH {b.SQL_PLACE}, {_AREA}, l AS (SELECT landform, sum(area) AS la FROM area GROUP BY 1), r AS (SELECT landform, sum(area) AS ra FROM area WHERE known GROUP BY 1) SELECT landform, round(la, 2) AS left_area, round(ra, 2) AS right_area, round(la - ra, 2) AS difference, abs(la - ra) <= 1 AS within FROM l FULL JOIN r USING (landform)")
def area_audit(spark, d):
    cells = _cells(spark, d)
    left = cells.groupBy("landform").agg(F.sum("area").alias("area"))
    right = cells.where("known").groupBy("landform").agg(F.sum("area").alias("area"))
    return sel.audit_areas(left, right, "landform", "area").withColumns({c: F.round(c, 2) for c in ("left_area", "right_area", "difference")})


# Strongest cells of each phase
@query(
    "selection_top_units",
    f"{_OBS}, k AS (SELECT phase_order, basin, landform, row_number() OVER (PARTITION BY phase_order ORDER BY round(abs((observed - expected) / sqrt(expected)), 6) DESC, basin, landform) AS place FROM unit WHERE expected >= 1) SELECT * FROM k WHERE place <= 30",
)
def selection_top_units(spark, d):
    from pyspark.sql import Window

    cells = sel.describe(_unit(spark, d)).where("expected >= 1")
    w = Window.partitionBy("phase_order").orderBy(F.round(F.abs("pearson_residual"), 6).desc(), "basin", "landform")
    return cells.withColumn("place", F.row_number().over(w)).where("place <= 30").select("phase_order", "basin", "landform", "place")
