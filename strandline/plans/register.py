"""Register curation: flags, exclusions, recodes and scopes, over orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import flags as fl
from strandline.operators import address, recover
from strandline.plans import bindings as b
from strandline.plans.registry import query
from strandline.sources import readers, writers

_WORDS = {"Cu": ["COPPER"], "St": ["STEEL"], "An": ["ECONOMY", "PROMO"], "No": [], "Un": ["STANDARD"]}


# PF3, PF4, PF6
@query(
    "period_flags",
    "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '  ' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS t FROM part) SELECT p_partkey, coalesce(t LIKE '%COPPER%', false)::INT AS Cu, coalesce(t LIKE '%STEEL%', false)::INT AS St, coalesce(t LIKE '%ECONOMY%' OR t LIKE '%PROMO%', false)::INT AS An, 0 AS No, (coalesce(t LIKE '%STANDARD%', false) OR trim(coalesce(t, '')) = '')::INT AS Un FROM p",
)
def period_flags(spark, d):
    p = b.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "  ").when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("t"))
    return fl.with_period_flags(p, "t", _WORDS).drop("t")


# PF2
@query("drop_erased", "SELECT p_partkey FROM part WHERE p_type IS NULL OR p_type NOT LIKE '%BRUSHED%'")
def drop_erased(spark, d):
    return b.table(spark, d, "part").where(~F.coalesce(F.col("p_type").contains("BRUSHED"), F.lit(False))).select("p_partkey")


# PF5: customers by year, with low orders only
_FLAG_SQL = "f AS (SELECT o_custkey AS place_id, year(o_orderdate) AS y, sum((o_orderpriority = '5-LOW')::INT) AS low, sum((o_orderpriority = '1-URGENT')::INT) AS urgent, sum((o_orderpriority IN ('2-HIGH', '3-MEDIUM'))::INT) AS mid FROM orders GROUP BY 1, 2)"


def _flagged(spark, d):
    o = b.table(spark, d, "orders")
    p = F.col("o_orderpriority")
    return o.groupBy(F.col("o_custkey").alias("place_id"), F.year("o_orderdate").alias("y")).agg(F.count_if(p == "5-LOW").alias("low"), F.count_if(p == "1-URGENT").alias("urgent"), F.count_if(p.isin("2-HIGH", "3-MEDIUM")).alias("mid"))


@query("only_low_excluded", f"WITH {_FLAG_SQL} SELECT low > 0 AND urgent = 0 AND mid = 0 AS excluded, count(*) AS n_places FROM f GROUP BY 1")
def only_low_excluded(spark, d):
    return _flagged(spark, d).groupBy(fl.only_flag("low", ["low", "urgent", "mid"]).alias("excluded")).agg(F.count("*").alias("n_places"))


# PF8, PF9
@query("display_recode", "SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Unknown segment' ELSE c_mktsegment END AS display, c_mktsegment AS raw, CASE WHEN c_mktsegment LIKE '%MOBILE%' THEN 'vehicle' WHEN c_mktsegment LIKE 'M%' OR c_mktsegment LIKE '%BUILD%' THEN 'works' ELSE 'other' END AS category FROM customer")
def display_recode(spark, d):
    s = F.col("c_mktsegment")
    return b.table(spark, d, "customer").select(
        "c_custkey", F.when(s == "HOUSEHOLD", "Unknown segment").otherwise(s).alias("display"), s.alias("raw"), F.when(s.contains("MOBILE"), "vehicle").when(s.startswith("M") | s.contains("BUILD"), "works").otherwise("other").alias("category")
    )


# PF10, PF13
@query("scope_filter", f"WITH {b.SQL_PRESENCE} SELECT place_id, sum(presence)::BIGINT AS n_phases FROM presence WHERE phase_code IN ('Jo', 'Ya', 'Ko') GROUP BY 1 HAVING sum(presence) > 0")
def scope_filter(spark, d):
    inside = F.filter(F.col("states"), lambda x, i: i.isin(1, 2, 3) & (x == 1))
    return b.place_states(spark, d).select("place_id", F.size(inside).cast("long").alias("n_phases")).where("n_phases > 0")


# PF12
@query("tri_state_parse", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS state FROM customer")
def tri_state_parse(spark, d):
    text = F.when(F.col("c_custkey") % 5 == 0, F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("NA")).otherwise(F.col("c_acctbal").cast("string"))
    return b.table(spark, d, "customer").select("c_custkey", fl.tri_state(text).alias("state"))


# PF17: an older rule that excludes special tokens, kept as an option
@query("legacy_token_exclusion", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_type, '(^| )TIN($| )')")
def legacy_token_exclusion(spark, d):
    return b.table(spark, d, "part").where(~F.col("p_type").rlike(r"(^| )TIN($| )")).select("p_partkey")


# PF18
@query("area_code_priority", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lpad(c_nationkey::VARCHAR, 5, '0') WHEN c_custkey % 3 = 1 THEN substr('12345' || c_nationkey, 1, 5) ELSE '13' || lpad(c_nationkey::VARCHAR, 3, '0') END AS lgc FROM customer")
def area_code_priority(spark, d):
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    c = b.table(spark, d, "customer").select(
        "c_custkey", F.when(i % 3 == 0, F.lpad(n.cast("string"), 5, "0")).otherwise(" ").alias("LGC"), F.when(i % 3 == 1, F.concat(F.lit("12345"), n)).alias("KEY_CODE"), F.lit("13").alias("PREF"), n.alias("CITY")
    )
    return address.area_code(c).select("c_custkey", "lgc")


# K10
@query("key_overlap", "SELECT round(count(*) FILTER (n IN (SELECT s_nationkey FROM supplier)) / count(*)::DOUBLE, 6) AS share FROM (SELECT DISTINCT c_nationkey AS n FROM customer)")
def key_overlap(spark, d):
    share = address.overlap_gate(b.table(spark, d, "customer").select(F.col("c_nationkey").alias("n")), b.table(spark, d, "supplier").select(F.col("s_nationkey").alias("n")), "n", least=0.0)
    return spark.createDataFrame([(round(share, 6),)], "share double")


# K11
@query(
    "merged_sources",
    "SELECT user_id, first(event_type ORDER BY ts, event_id) AS source_first_seen, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS source_hits, count(DISTINCT event_type) AS n_sources FROM events GROUP BY 1",
)
def merged_sources(spark, d):
    e = b.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    found = recover.merge_points(e, "user_id", F.struct("ts", "event_id"), "event_type")
    return found.select("user_id", "source_first_seen", "source_hits", "n_sources")


@query(
    "attempt_log",
    "WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, CASE WHEN value > 50 THEN 'ok' ELSE 'failed' END AS status FROM events) SELECT user_id, count(*) AS n_attempts, count(*) FILTER (status <> 'ok') AS n_failed, arg_max(status, attempt) AS last_status, bool_or(status = 'ok') AS recovered FROM a GROUP BY 1",
)
def attempt_log(spark, d):
    e = b.table(spark, d, "events").select("user_id", F.col("event_id").alias("attempt"), F.when(F.col("value") > 50, "ok").otherwise("failed").alias("status"))
    return recover.attempt_log(e, "user_id")


# K12
_OFFSETS = [(f"offset_{m}_{n}", m * e, m * u) for m in (5, 10, 20) for n, e, u in (("E", 1, 0), ("W", -1, 0), ("N", 0, 1), ("S", 0, -1))]


@query(
    "retry_points",
    "WITH g AS (SELECT vec_id AS id, 139.5::DOUBLE + embedding[1]::DOUBLE AS lon, 35.5::DOUBLE + embedding[2]::DOUBLE AS lat FROM embeddings) "
    + " UNION ALL ".join(f"SELECT id, 'segment_{f}' AS method, round((lon + 0.001) - 0.001 * {f}, 8) AS lon, round((lat - 0.002) + 0.002 * {f}, 8) AS lat FROM g" for f in (0.25, 0.5, 0.75))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT id, '{m}', round(lon + {e} / 111320.0::DOUBLE / cos(radians(lat)), 8), round(lat + {u} / 111320.0::DOUBLE, 8) FROM g" for m, e, u in _OFFSETS),
)
def retry_points(spark, d):
    e = b.table(spark, d, "embeddings")
    lon, lat = F.col("embedding")[0].cast("double") + 139.5, F.col("embedding")[1].cast("double") + 35.5
    return recover.retry_points(e.select(F.col("vec_id").alias("id"), lon.alias("lon"), lat.alias("lat"), (lon + 0.001).alias("proxy_lon"), (lat - 0.002).alias("proxy_lat"))).withColumns({"lon": F.round("lon", 8), "lat": F.round("lat", 8)})


# K13
@query(
    "validated_table",
    "WITH f AS (SELECT c_custkey - (c_custkey % 5 = 0)::INT AS no, c_mktsegment AS name FROM customer), g AS (SELECT no, count(*) AS n, min(name) AS name FROM f GROUP BY 1), e AS (SELECT c_custkey + 3 AS no FROM customer) SELECT no, CASE WHEN n IS NULL THEN 'missing' WHEN e.no IS NULL THEN 'extra' WHEN n > 1 THEN 'repeated' WHEN name <> 'BUILDING' THEN 'name_differs' ELSE 'ok' END AS \"check\" FROM g FULL JOIN e USING (no)",
)
def validated_table(spark, d):
    c = b.table(spark, d, "customer")
    found = c.select((F.col("c_custkey") - (F.col("c_custkey") % 5 == 0).cast("int")).alias("no"), F.col("c_mktsegment").alias("name"))
    expected = c.select((F.col("c_custkey") + 3).alias("no"), F.lit("BUILDING").alias("name"))
    return recover.validate_table(found, expected, "no", "name")


# K18
@query(
    "window_assignment",
    """WITH p AS (SELECT p_partkey // 20 AS unit, p_partkey % 20 AS place, p_type || '/' || p_brand AS label FROM part), l AS (SELECT unit AS block, place - 5 AS p, label FROM p WHERE place BETWEEN 5 AND 14),
    h AS (SELECT block, unit, place - l.p AS shift, count(DISTINCT l.p) AS hits FROM l JOIN p USING (label) GROUP BY ALL), n AS (SELECT block, count(DISTINCT p) AS n FROM l GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY hits DESC, unit, shift) AS k FROM h) SELECT block, unit, hits / n::DOUBLE AS share FROM r JOIN n USING (block) WHERE k = 1 AND hits / n::DOUBLE >= 0.9""",
)
def window_assignment(spark, d):
    p = b.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("unit"), (F.col("p_partkey") % 20).alias("place"), F.concat_ws("/", "p_type", "p_brand").alias("label"))
    blocks = p.where("place BETWEEN 5 AND 14").select(F.col("unit").alias("block"), (F.col("place") - 5).alias("place"), "label")
    return recover.assign_windows(blocks, p)


# SNK3: one row for each flag that is set
@query("split_by_flags", f"WITH {_FLAG_SQL} SELECT flag, count(*) AS n_rows FROM (SELECT 'low' AS flag FROM f WHERE low = 1 UNION ALL SELECT 'urgent' FROM f WHERE urgent = 1 UNION ALL SELECT 'mid' FROM f WHERE mid = 1) GROUP BY 1")
def split_by_flags(spark, d):
    return writers.split_by_flags(_flagged(spark, d), ["low", "urgent", "mid"]).groupBy("flag").agg(F.count("*").alias("n_rows"))


# SRC15: what a manifest leaves to do
@query("pending_work", "SELECT c_custkey AS place_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending_work(spark, d):
    manifest = b.table(spark, d, "orders").select(F.col("o_custkey").alias("place_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"))
    return readers.pending(b.table(spark, d, "customer").select(F.col("c_custkey").alias("place_id")), manifest, "place_id")


# SRC4, SRC11: fields of payloads under several names
@query("payload_fields", "SELECT event_id, props::JSON ->> '$.k' AS number FROM events")
def payload_fields(spark, d):
    fields = readers.json_fields(F.col("props"), {"number": ["id", "k"], "name": ["name", "title"]})
    return b.table(spark, d, "events").select("event_id", fields["number"].alias("number"))
