"""How the driver's tables stand for places, phases, domains and landscape units.

place: customer; phase: year of the order, 1995 to 2001; presence: an urgent order in
the year; activity domain: order priority; unresolved: only orders of status P;
water system, basin, landform: region, nation, market segment; points: the first two
coordinates of an embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import sequence as seq

URGENT = "1-URGENT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, phase_order, activity_domain, o_orderstatus) of each order in the seven years."""
    phase = F.year("o_orderdate") - 1994
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_custkey").alias("place_id"), phase.alias("phase_order"), F.col("o_orderpriority").alias("activity_domain"), "o_orderstatus")
        .where(F.col("phase_order").between(1, len(seq.PHASES)))
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, watersystem, unit_basin, landform); nations and regions are 25 and 5 rows by definition."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dims = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("unit_basin"), F.col("r_name").alias("watersystem"))
    customer = table(spark, sf_dir, "customer")
    return customer.join(F.broadcast(dims), customer.c_nationkey == dims.n_nationkey, "left").select(
        F.col("c_custkey").alias("place_id"), "watersystem", "unit_basin", F.col("c_mktsegment").alias("landform")
    )


def place_states(spark: SparkSession, sf_dir: str, any_order: bool = False) -> DataFrame:
    """(place_id, states): presence of every customer over the seven phases."""
    facts = order_facts(spark, sf_dir)
    if not any_order:  # pushed to the scan
        facts = facts.where(F.col("activity_domain") == URGENT)
    found = seq.flag_states(facts, ["place_id"], "phase_order", F.lit(True))
    return seq.complete(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id")), found, "place_id")


def domain_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, activity_domain, states): 1 with an order not of status P, null with such orders only, else 0."""
    facts = order_facts(spark, sf_dir)
    found = seq.states(facts, ["place_id", "activity_domain"], "phase_order", F.when(F.col("o_orderstatus") != "P", 1))
    domains = facts.select("activity_domain").distinct()  # the five priorities
    grid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id")).crossJoin(F.broadcast(domains))
    absent = F.array(*[F.lit(0)] * len(seq.PHASES))
    return grid.join(found, ["place_id", "activity_domain"], "left").withColumn("states", F.coalesce("states", absent))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, scheme, unit_id) under the three landscape schemes; units with a null part are left out."""
    return landscape_membership(places(spark, sf_dir))


def landscape_membership(found: DataFrame) -> DataFrame:
    whole = F.when(F.col("watersystem").isNotNull() & F.col("landform").isNotNull(), F.concat("watersystem", F.lit("_"), "landform"))
    schemes = {"watersystem": F.concat(F.lit("WS_"), "watersystem"), "unit_basin": F.concat(F.lit("B_"), "unit_basin"), "watershed_x_landform": whole}
    pairs = F.array(*[F.struct(F.lit(k).alias("scheme"), v.alias("unit_id")) for k, v in schemes.items()])
    return found.select("place_id", F.explode(pairs).alias("m")).select("place_id", "m.scheme", "m.unit_id").where("unit_id IS NOT NULL")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, x, y, label)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label"
    )


# The same bindings as DuckDB common table expressions.

SQL_PHASE = "phase AS (SELECT * FROM (VALUES (1,'Pa'),(2,'Jo'),(3,'Ya'),(4,'Ko'),(5,'Na'),(6,'He'),(7,'Me')) t(phase_order, phase_code))"
SQL_PRESENCE = f"""{SQL_PHASE},
seen AS (SELECT DISTINCT o_custkey AS place_id, year(o_orderdate) - 1994 AS phase_order FROM orders WHERE o_orderpriority = '{URGENT}'),
presence AS (SELECT c.c_custkey AS place_id, p.phase_order, p.phase_code, CASE WHEN s.place_id IS NULL THEN 0 ELSE 1 END AS presence
  FROM customer c CROSS JOIN phase p LEFT JOIN seen s ON s.place_id = c.c_custkey AND s.phase_order = p.phase_order)"""


def sql_metrics(presence: str = "presence", keys: str = "place_id") -> str:
    """Runs, gaps and one row of metrics by ``keys``, from a table like ``presence`` without nulls."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    on_g = on.replace("b.", "g.")
    return f"""
island AS (SELECT *, phase_order - row_number() OVER (PARTITION BY {keys} ORDER BY phase_order) AS isl FROM {presence} WHERE presence = 1),
runs AS (SELECT {keys}, min(phase_order) AS run_start, max(phase_order) AS run_end, count(*) AS run_length,
  row_number() OVER (PARTITION BY {keys} ORDER BY min(phase_order)) AS run_number FROM island GROUP BY {keys}, isl),
led AS (SELECT *, lead(run_start) OVER (PARTITION BY {keys} ORDER BY run_start) AS next_start FROM runs),
gaps AS (SELECT {keys}, run_number AS gap_number, run_end + 1 AS gap_start, next_start - 1 AS gap_end, next_start - run_end - 1 AS gap_length FROM led WHERE next_start IS NOT NULL),
basic AS (SELECT {keys}, sum(presence)::BIGINT AS pc, min(CASE WHEN presence = 1 THEN phase_order END) AS first_order, max(CASE WHEN presence = 1 THEN phase_order END) AS last_order FROM {presence} GROUP BY {keys}),
rs AS (SELECT {keys}, count(*) AS run_count, max(run_length) AS longest, avg(run_length) AS mean_run FROM runs GROUP BY {keys}),
gs AS (SELECT {keys}, count(*) AS gap_count, sum(gap_length)::BIGINT AS gap_phases, max(gap_length) AS max_gap, avg(gap_length) AS mean_gap FROM gaps GROUP BY {keys}),
base AS (SELECT a.*, coalesce(last_order - first_order + 1, 0) AS span, coalesce(run_count, 0) AS run_count, coalesce(longest, 0) AS longest, coalesce(mean_run, 0) AS mean_run,
  coalesce(gap_count, 0) AS gap_count, coalesce(gap_phases, 0) AS gap_phases, coalesce(max_gap, 0) AS max_gap, coalesce(mean_gap, 0) AS mean_gap
  FROM basic a LEFT JOIN rs b ON {on} LEFT JOIN gs g ON {on_g}),
pen AS (SELECT *, CASE WHEN span > 1 THEN gap_phases / (span - 1.0::DOUBLE) ELSE 0.0 END AS penalty FROM base),
metrics AS (SELECT *, span / 7.0::DOUBLE * (1 - least(greatest(penalty, 0), 1)) AS gap_free, CASE WHEN pc <= 1 THEN 0.0 ELSE least(greatest(penalty, 0), 1) END AS intermittency,
  CASE WHEN pc = 0 THEN 0 WHEN pc = 1 THEN 1 WHEN gap_count = 0 AND longest = 2 THEN 2 WHEN gap_count = 0 AND longest IN (3, 4) THEN 3 WHEN gap_count = 0 AND longest >= 5 THEN 4 WHEN gap_count = 1 THEN 5 ELSE 6 END AS class_code
  FROM pen),
scored AS (SELECT *, CASE WHEN pc = 0 THEN 0.0 ELSE least(greatest(0.35 * pc / 7.0::DOUBLE + 0.40 * longest / 7.0::DOUBLE + 0.25 * gap_free, 0), 1) END AS continuity,
  (['no_presence','single_phase','continuous_2phase','continuous_3_4phase','continuous_5_7phase','intermittent_gap1','intermittent_gap2plus'])[class_code + 1] AS sequence_class FROM metrics)"""


SQL_SEQ = f"WITH {SQL_PRESENCE}, {sql_metrics()}"
SQL_DOMAIN = f"""{SQL_PHASE},
cell AS (SELECT o_custkey AS place_id, year(o_orderdate) - 1994 AS phase_order, o_orderpriority AS activity_domain, max(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS state FROM orders GROUP BY ALL),
dom AS (SELECT DISTINCT o_orderpriority AS activity_domain FROM orders),
domain AS (SELECT c.c_custkey AS place_id, d.activity_domain, p.phase_order, p.phase_code, CASE WHEN s.place_id IS NULL THEN 0 ELSE s.state END AS presence
  FROM customer c CROSS JOIN dom d CROSS JOIN phase p LEFT JOIN cell s ON s.place_id = c.c_custkey AND s.activity_domain = d.activity_domain AND s.phase_order = p.phase_order)"""
SQL_PLACE = """place AS (SELECT c_custkey AS place_id, r_name AS watersystem, n_name AS unit_basin, c_mktsegment AS landform FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
member AS (SELECT place_id, 'watersystem' AS scheme, 'WS_' || watersystem AS unit_id FROM place UNION ALL SELECT place_id, 'unit_basin', 'B_' || unit_basin FROM place
  UNION ALL SELECT place_id, 'watershed_x_landform', watersystem || '_' || landform FROM place)"""
SQL_POINT = "point AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"
