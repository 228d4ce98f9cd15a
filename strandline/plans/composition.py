"""Composition of phases over landscape units."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import compose
from strandline.operators import sequence as seq
from strandline.plans import bindings as b
from strandline.plans.registry import query

_PROFILE = f"""WITH {b.SQL_PRESENCE}, {b.SQL_PLACE}, cnt AS (SELECT scheme, phase_order, unit_id, count(DISTINCT place_id) AS presence_count FROM presence JOIN member USING (place_id) WHERE unit_id IS NOT NULL AND presence = 1 GROUP BY ALL),
prof AS (SELECT *, sum(presence_count) OVER (PARTITION BY scheme, phase_order)::BIGINT AS known_total, presence_count / sum(presence_count) OVER (PARTITION BY scheme, phase_order)::DOUBLE AS phase_share FROM cnt)"""


def _profile(spark, d):
    rows = seq.long(b.membership(spark, d).join(b.place_states(spark, d), "place_id"))
    return compose.profile(rows, ["scheme", "phase_order"], "unit_id")


# C1
@query("phase_profile", f"{_PROFILE} SELECT scheme, phase_order, unit_id, presence_count, known_total, round(phase_share, 8) AS phase_share FROM prof")
def phase_profile(spark, d):
    return _profile(spark, d).withColumn("phase_share", F.round("phase_share", 8))


# C2
@query(
    "profile_breadth",
    f"{_PROFILE} SELECT scheme, phase_order, count(*) AS active_groups, round(CASE WHEN count(*) > 1 THEN sum(-phase_share * ln(phase_share)) / ln(count(*)) ELSE 0 END, 6) AS normalised_entropy, round(max(phase_share), 6) AS max_share FROM prof GROUP BY scheme, phase_order",
)
def profile_breadth(spark, d):
    return compose.breadth(_profile(spark, d), ["scheme", "phase_order"]).withColumns({"normalised_entropy": F.round("normalised_entropy", 6), "max_share": F.round("max_share", 6)})


# C3
@query(
    "relative_concentration",
    f"""{_PROFILE}, bl AS (SELECT scheme, unit_id, count(DISTINCT place_id) / sum(count(DISTINCT place_id)) OVER (PARTITION BY scheme)::DOUBLE AS bs FROM member WHERE unit_id IS NOT NULL AND place_id IN (SELECT place_id FROM presence WHERE presence = 1) GROUP BY scheme, unit_id)
    SELECT scheme, phase_order, unit_id, round(phase_share / bs, 6) AS relative_concentration, CASE WHEN phase_share / bs >= 1.25 THEN 'relatively_concentrated' WHEN phase_share / bs <= 0.8 THEN 'relatively_sparse' ELSE 'near_baseline' END AS concentration_class FROM prof JOIN bl USING (scheme, unit_id)""",
)
def relative_concentration(spark, d):
    sample = b.place_states(spark, d).where(F.array_contains("states", 1)).select("place_id")
    counts = b.membership(spark, d).join(sample, "place_id", "left_semi").groupBy("scheme", "unit_id").agg(F.countDistinct("place_id").alias("n"))
    base = counts.select("scheme", "unit_id", (F.col("n") / F.sum("n").over(Window.partitionBy("scheme"))).alias("baseline_share"))
    found = compose.concentration(_profile(spark, d), base, ["scheme", "phase_order"], "unit_id")
    return found.select("scheme", "phase_order", "unit_id", F.round("relative_concentration", 6).alias("relative_concentration"), "concentration_class")


# C4, J5
@query(
    "profile_matrix",
    f"{_PROFILE} SELECT g.scheme, g.unit_id, p.phase_order, coalesce(presence_count, 0) AS presence_count FROM (SELECT DISTINCT scheme, unit_id FROM prof) g CROSS JOIN phase p LEFT JOIN prof f ON f.scheme = g.scheme AND f.unit_id = g.unit_id AND f.phase_order = p.phase_order",
)
def profile_matrix(spark, d):
    prof = _profile(spark, d)
    grid = prof.select("scheme", "unit_id").distinct().withColumn("phase_order", F.explode(F.sequence(F.lit(1), F.lit(len(seq.PHASES)))))
    return grid.join(prof, ["scheme", "unit_id", "phase_order"], "left").select("scheme", "unit_id", "phase_order", F.coalesce("presence_count", F.lit(0)).alias("presence_count"))


def _distance_sql(condition: str) -> str:
    return f"""{_PROFILE}, g AS (SELECT DISTINCT scheme, unit_id FROM prof), full_p AS (SELECT g.scheme, g.unit_id, p.phase_order, coalesce(phase_share, 0) AS s FROM g CROSS JOIN phase p LEFT JOIN prof f ON f.scheme = g.scheme AND f.unit_id = g.unit_id AND f.phase_order = p.phase_order),
    pr AS (SELECT a.scheme, a.phase_order AS from_order, z.phase_order AS to_order, a.s AS p, z.s AS q, (a.s + z.s) / 2 AS m FROM full_p a JOIN full_p z ON a.scheme = z.scheme AND a.unit_id = z.unit_id AND {condition})
    SELECT scheme, from_order, to_order, round(sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2), 6) AS js_divergence,
    round(sqrt(sum((sqrt(p) - sqrt(q)) ** 2) / 2), 6) AS hellinger_distance, round(sum(abs(p - q)) / 2, 6) AS bray_curtis FROM pr GROUP BY ALL"""


def _rounded(frame):
    return frame.withColumns({c: F.round(c, 6) for c in ("js_divergence", "hellinger_distance", "bray_curtis")})


# C5, C6
@query("jsd_adjacent", _distance_sql("z.phase_order = a.phase_order + 1"))
def jsd_adjacent(spark, d):
    return _rounded(compose.distances(_profile(spark, d), "scheme", "phase_order", "unit_id"))


@query("jsd_all_pairs", _distance_sql("z.phase_order > a.phase_order"))
def jsd_all_pairs(spark, d):
    return _rounded(compose.distances(_profile(spark, d), "scheme", "phase_order", "unit_id", adjacent=False))


# C7
def _counts(spark, d):
    return _profile(spark, d).where("scheme = 'watershed_x_landform'")


@query("ca_phase_coordinates")
def ca_phase_coordinates(spark, d):
    return compose.correspondence(_counts(spark, d), "phase_order", "unit_id", "presence_count")[0]


@query("ca_unit_coordinates")
def ca_unit_coordinates(spark, d):
    return compose.correspondence(_counts(spark, d), "phase_order", "unit_id", "presence_count")[1]


@query("ca_inertia")
def ca_inertia(spark, d):
    return compose.correspondence(_counts(spark, d), "phase_order", "unit_id", "presence_count")[2]


# The inertia of all axes is chi-square over n
@query(
    "ca_total_inertia",
    f"""{_PROFILE}, t AS (SELECT phase_order AS p, unit_id AS u, presence_count::DOUBLE AS n FROM prof WHERE scheme = 'watershed_x_landform'), m AS (SELECT n, sum(n) OVER (PARTITION BY p) AS r, sum(n) OVER (PARTITION BY u) AS c FROM t)
    SELECT round(sum(n * n / (r * c)) - 1, 8) AS total_inertia FROM m""",
)
def ca_total_inertia(spark, d):
    return ca_inertia(spark, d).agg(F.round(F.sum("inertia"), 8).alias("total_inertia"))


# C8
@query(
    "domain_geography",
    f"""WITH {b.SQL_DOMAIN}, {b.SQL_PLACE}, cnt AS (SELECT activity_domain, phase_order, unit_id, count(DISTINCT place_id) AS n FROM domain JOIN member USING (place_id) WHERE scheme = 'unit_basin' AND unit_id IS NOT NULL AND presence = 1 GROUP BY ALL)
    SELECT activity_domain, phase_order, unit_id, n AS presence_count, round(n / sum(n) OVER (PARTITION BY activity_domain, phase_order)::DOUBLE, 6) AS phase_share FROM cnt""",
)
def domain_geography(spark, d):
    rows = seq.long(b.membership(spark, d).where("scheme = 'unit_basin'").join(b.domain_states(spark, d), "place_id"))
    return compose.profile(rows, ["activity_domain", "phase_order"], "unit_id").drop("known_total").withColumn("phase_share", F.round("phase_share", 6))
