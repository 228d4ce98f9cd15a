"""Tallies, joins, sorts and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import flags as fl
from strandline.functions import numeric as num
from strandline.operators import tally
from strandline.plans.bindings import table
from strandline.plans.registry import query

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_FLAGS = ("urgent", "high", "medium", "unspecified", "low")


def _flagged(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", *[(F.col("o_orderpriority") == p).cast("int").alias(f) for p, f in zip(_PRIORITIES, _FLAGS, strict=True)])


_SQL_FLAGS = "fo AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, " + ", ".join(f"(o_orderpriority = '{p}')::INT AS {f}" for p, f in zip(_PRIORITIES, _FLAGS, strict=True)) + " FROM orders)"


# A1, A2
@query("status_share", "SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM orders GROUP BY 1")
def status_share(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.select("o_orderstatus", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


# A3
@query("flag_totals", f"WITH {_SQL_FLAGS} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, sum({f})::BIGINT AS n FROM fo" for f in _FLAGS))
def flag_totals(spark, d):
    return tally.flag_totals(_flagged(spark, d), list(_FLAGS))


# A4, A18, J1
@query(
    "flag_crosstab",
    f"WITH {_SQL_FLAGS} SELECT c_custkey, c_name, " + ", ".join(f"coalesce(sum({f}), 0)::BIGINT AS {f}" for f in _FLAGS) + " FROM customer LEFT JOIN fo ON o_custkey = c_custkey GROUP BY 1, 2",
)
def flag_crosstab(spark, d):
    master = table(spark, d, "customer").select("c_custkey", "c_name")
    return tally.crosstab(_flagged(spark, d).withColumnRenamed("o_custkey", "c_custkey"), master, "c_custkey", list(_FLAGS))


# A6, A7
@query(
    "order_statistics",
    """SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_places, round(min(o_totalprice), 2) AS min_price, round(max(o_totalprice), 2) AS max_price, round(avg(o_totalprice), 4) AS mean_price, round(stddev_samp(o_totalprice), 4) AS sd_price,
    round(median(o_totalprice), 4) AS median_price, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1""",
)
def order_statistics(spark, d):
    p = lambda q: F.round(F.percentile("o_totalprice", F.lit(q)), 4)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.countDistinct("o_custkey").alias("n_places"), F.round(F.min("o_totalprice"), 2).alias("min_price"), F.round(F.max("o_totalprice"), 2).alias("max_price"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
        F.round(F.stddev_samp("o_totalprice"), 4).alias("sd_price"), F.round(F.median("o_totalprice"), 4).alias("median_price"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"),
    )


# Irregular subtotals over overlapping groups of nations; a group with a member without suppliers is null
_GROUPS = [("all", k) for k in range(25)] + [("even", k) for k in range(0, 25, 2)] + [("first", k) for k in range(3)] + [("beyond", k) for k in (1, 2, 99)]


@query(
    "irregular_subtotals",
    "WITH m AS (SELECT * FROM (VALUES " + ",".join(f"('{g}',{k})" for g, k in _GROUPS) + """) t(group_id, nation)), n AS (SELECT s_nationkey AS nation, count(*) AS n_suppliers FROM supplier GROUP BY 1)
    SELECT group_id, CASE WHEN count(*) = count(n_suppliers) THEN sum(n_suppliers)::BIGINT END AS n_suppliers, count(n_suppliers) AS n_known FROM m LEFT JOIN n USING (nation) GROUP BY 1""",
)
def irregular_subtotals(spark, d):
    members = spark.createDataFrame(_GROUPS, "group_id string, nation int")
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return tally.subtotals(counts, members, "nation", "n_suppliers")


@query("null_poison_sum", "SELECT o_orderpriority, CASE WHEN count(*) = count(v) THEN round(sum(v), 2) END AS total FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 1000 = 7 AND o_orderpriority LIKE '2%' THEN NULL ELSE o_totalprice END AS v FROM orders) GROUP BY 1")
def null_poison_sum(spark, d):
    v = F.when(~((F.col("o_orderkey") % 1000 == 7) & F.col("o_orderpriority").startswith("2")), F.col("o_totalprice"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(fl.poisoned_sum(v), 2).alias("total"))


# J3, A10, A22
@query(
    "reconcile_counts",
    """WITH a AS (SELECT c_nationkey AS nation, count(*) AS n_customers FROM customer WHERE c_nationkey < 20 GROUP BY 1), z AS (SELECT s_nationkey AS nation, count(*) AS n_suppliers FROM supplier WHERE s_nationkey > 4 GROUP BY 1)
    SELECT nation, n_customers, n_suppliers, n_customers - n_suppliers AS difference, CASE WHEN n_customers IS NULL THEN 'only_right' WHEN n_suppliers IS NULL THEN 'only_left' WHEN n_customers = n_suppliers THEN 'equal' ELSE 'different' END AS status FROM a FULL JOIN z USING (nation)""",
)
def reconcile_counts(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    z = table(spark, d, "supplier").where("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return tally.reconcile(a, z, ["nation"], "n_customers", "n_suppliers")


@query("sorted_distinct_labels", "SELECT p_brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1")
def sorted_distinct_labels(spark, d):
    types = F.sort_array(F.collect_set("p_type"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(types, ";").alias("types"), F.size(types).alias("n_types"))


# Deterministic mode, the smallest label of the most frequent
@query("modal_label", "SELECT p_brand, p_type AS modal_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY 1, 2) WHERE k = 1")
def modal_label(spark, d):
    n = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    ranked = n.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type")))
    return ranked.where("k = 1").select("p_brand", F.col("p_type").alias("modal_type"), "n")


# A12, A15, A16
@query("weighted_mean", "SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted_discount FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.try_divide(F.sum(F.col("l_quantity") * F.col("l_discount")), F.sum("l_quantity")), 6).alias("weighted_discount"))


@query("group_centroid", "SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y FROM embeddings GROUP BY 1")
def group_centroid(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("x"), F.round(F.avg(F.col("embedding")[1].cast("double")), 6).alias("y"))


@query("contingency_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def contingency_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


# A17
@query("box_statistics", "SELECT c_mktsegment, " + ", ".join(f"round(quantile_cont(log10(c_acctbal), {q}), 6) AS {n}" for n, q in (("low", 0.0), ("q1", 0.25), ("mid", 0.5), ("q3", 0.75), ("high", 1.0))) + ", count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def box_statistics(spark, d):
    q = F.percentile(F.log10("c_acctbal"), F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q")
    found = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(q, F.count("*").alias("n"))
    return found.select("c_mktsegment", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("low", "q1", "mid", "q3", "high"))], "n")


# A19, A20, J20
@query("keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def keep_first(spark, d):
    # a minimum of structs combines on the map side; no partition is sorted
    first = F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(first.alias("f")).select("o_custkey", "f.o_orderkey", "f.o_totalprice")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return tally.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


# A22
@query(
    "completeness",
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS priority, CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS price FROM orders), n AS (SELECT count(*) AS n_rows, count(o_orderkey) AS a, count(nullif(priority, '')) AS b, count(price) AS c FROM o) "
    "SELECT t.field, CASE t.field WHEN 'o_orderkey' THEN a WHEN 'priority' THEN b ELSE c END AS n_known, n_rows, round(CASE t.field WHEN 'o_orderkey' THEN a WHEN 'priority' THEN b ELSE c END / n_rows::DOUBLE, 6) AS share_known FROM n CROSS JOIN (VALUES ('o_orderkey'),('priority'),('price')) t(field)",
)
def completeness(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("price"))
    return tally.completeness(o, ["o_orderkey", "priority", "price"]).withColumn("share_known", F.round("share_known", 6))


# A23
@query("area_weighted_coverage", "SELECT l_linestatus, round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS coverage, round(avg((l_discount > 0.05)::INT), 6) AS plain_coverage FROM lineitem GROUP BY 1")
def area_weighted_coverage(spark, d):
    known = F.col("l_discount") > 0.05
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.try_divide(F.sum(F.when(known, F.col("l_quantity")).otherwise(0)), F.sum("l_quantity")), 6).alias("coverage"), F.round(F.avg(known.cast("int")), 6).alias("plain_coverage")
    )


# A24, A28
@query(
    "equal_count_classes",
    """WITH q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS b FROM part) SELECT class, count(*) AS n, round(min(p_retailprice), 2) AS low, round(max(p_retailprice), 2) AS high
    FROM (SELECT p_retailprice, len(list_filter(b, lambda x: p_retailprice > x)) + 1 AS class FROM part, q) GROUP BY 1""",
)
def equal_count_classes(spark, d):
    part = table(spark, d, "part").select("p_retailprice")
    breaks = tally.equal_count_breaks(part, "p_retailprice", 5)  # one row
    return part.crossJoin(F.broadcast(breaks)).groupBy(tally.class_of(F.col("p_retailprice"), F.col("breaks")).alias("class")).agg(
        F.count("*").alias("n"), F.round(F.min("p_retailprice"), 2).alias("low"), F.round(F.max("p_retailprice"), 2).alias("high")
    )


# A25
@query(
    "tri_state_any",
    "SELECT o_custkey, CASE WHEN max(s) = 1 THEN 1 WHEN count(*) > count(s) THEN NULL ELSE 0 END AS any_state FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN (o_totalprice > 300000)::INT ELSE 0 END AS s FROM orders) GROUP BY 1",
)
def tri_state_any(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", (F.col("o_totalprice") > 300000).cast("int")).when(F.col("o_orderstatus") == "O", 0)
    return table(spark, d, "orders").groupBy("o_custkey").agg(fl.any_state(s).alias("any_state"))


# A26, K19
@query(
    "observed_phase_list",
    "SELECT o_custkey, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ';' ORDER BY year(o_orderdate)::VARCHAR) AS phases, count(DISTINCT year(o_orderdate)) AS n_phases FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
)
def observed_phase_list(spark, d):
    years = F.sort_array(F.collect_set(F.year("o_orderdate").cast("string")))
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.array_join(years, ";").alias("phases"), F.size(years).alias("n_phases"))


# What each request of a harvest adds: requests are days, items are users
@query(
    "harvest_statistics",
    """WITH hit AS (SELECT date_trunc('day', ts) AS request, user_id, count(*) AS hits FROM events GROUP BY 1, 2), first AS (SELECT user_id, min(request) AS first_request FROM hit GROUP BY 1),
    s AS (SELECT request, count(*) AS n_items, count(*) FILTER (request = first_request) AS n_new, sum(hits)::BIGINT AS source_hits FROM hit JOIN first USING (user_id) GROUP BY 1)
    SELECT strftime(request, '%Y-%m-%d') AS request, n_items, n_new, n_items - n_new AS n_overlap, source_hits, sum(n_new) OVER (ORDER BY request)::BIGINT AS cumulative_unique, sum((n_new = 0)::INT) OVER (ORDER BY request)::BIGINT AS zero_new FROM s""",
)
def harvest_statistics(spark, d):
    hits = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("request"), "user_id").agg(F.count("*").alias("hits"))
    firsts = hits.groupBy("user_id").agg(F.min("request").alias("first_request"))
    per = hits.join(firsts, "user_id").groupBy("request").agg(F.count("*").alias("n_items"), F.count_if(F.col("request") == F.col("first_request")).alias("n_new"), F.sum("hits").alias("source_hits"))
    upto = Window.orderBy("request").rowsBetween(Window.unboundedPreceding, 0)  # one row for each request
    return per.select(
        F.date_format("request", "yyyy-MM-dd").alias("request"), "n_items", "n_new", (F.col("n_items") - F.col("n_new")).alias("n_overlap"), "source_hits", F.sum("n_new").over(upto).alias("cumulative_unique"),
        F.sum((F.col("n_new") == 0).cast("int")).over(upto).alias("zero_new"),
    )


# Mapping to systems, then counts by system and period
@query("system_period_counts", "SELECT r_name, year(o_orderdate) AS period, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def system_period_counts(spark, d):
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")  # 25 rows
    # orders shrink to a count by customer and year before they meet the customers
    per = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("period")).agg(F.count("*").alias("n"))
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return per.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "period").agg(F.sum("n").alias("n"))


# J4, J23
@query("one_to_one_join", "SELECT n_name, r_name, n_regionkey::VARCHAR AS code FROM nation JOIN region ON n_regionkey = r_regionkey")
def one_to_one_join(spark, d):
    left = table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("double").alias("code"))
    right = table(spark, d, "region").select("r_name", F.col("r_regionkey").alias("code"))
    return tally.join_many_to_one(*tally.aligned(left, right, "code"), ["code"], "inner")


# J6, J7
@query("unmatched_audit", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unmatched_audit(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("semi_filter", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)")
def semi_filter(spark, d):
    keys = table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", "s_name").join(keys, "s_suppkey", "left_semi")


# Groups of equal coordinates
@query(
    "dup_coordinate_groups",
    """WITH p AS (SELECT vec_id, round(embedding[1]::DOUBLE, 1) AS x, round(embedding[2]::DOUBLE, 1) AS y FROM embeddings), g AS (SELECT x, y, count(*) AS n, dense_rank() OVER (ORDER BY x, y) AS k FROM p GROUP BY 1, 2)
    SELECT vec_id, 'CG' || lpad(k::VARCHAR, 5, '0') AS coordinate_group, n AS n_in_group, n > 1 AS duplicated FROM p JOIN g USING (x, y)""",
)
def dup_coordinate_groups(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 1).alias("x"), F.round(F.col("embedding")[1].cast("double"), 1).alias("y"))
    groups = e.groupBy("x", "y").agg(F.count("*").alias("n"))
    ids = tally.numbered(groups, [F.col("x"), F.col("y")], "k")
    return e.join(ids, ["x", "y"]).select("vec_id", F.concat(F.lit("CG"), F.lpad(F.col("k").cast("string"), 5, "0")).alias("coordinate_group"), F.col("n").alias("n_in_group"), (F.col("n") > 1).alias("duplicated"))


# W9, W12, W13
@query("fill_label", "SELECT p_partkey, first_value(lbl IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label FROM (SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN p_type END AS lbl FROM part)")
def fill_label(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("lbl"))
    first = F.min(F.when(F.col("lbl").isNotNull(), F.struct("p_partkey", "lbl")))["lbl"]
    return part.join(part.groupBy("p_brand").agg(first.alias("label")), "p_brand").select("p_partkey", "label")


@query("zscore", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand)) / stddev_samp(p_retailprice) OVER (PARTITION BY p_brand), 5) AS z FROM part")
def zscore(spark, d):
    from strandline.functions.stats import zscore as z

    return table(spark, d, "part").select("p_partkey", F.round(z("p_retailprice", "p_brand"), 5).alias("z"))


@query("running_mean", "SELECT o_custkey, y AS period, round(avg(n) OVER (PARTITION BY o_custkey ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS running_mean FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2)")
def running_mean(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("period")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("period").rangeBetween(-2, 2)
    return n.select("o_custkey", "period", F.round(F.avg("n").over(w), 6).alias("running_mean"))


# T1, T3, T5, T6, T7
@query("top_n_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber, k FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(l_extendedprice - 30000) DESC, l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_quantity >= 1) WHERE k <= 30")
def top_n_per_group(spark, d):
    # Spark keeps only 30 rows of a group in each task before the shuffle (WindowGroupLimit)
    w = Window.partitionBy("l_returnflag").orderBy(F.abs(F.col("l_extendedprice") - 30000).desc(), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").where("l_quantity >= 1").withColumn("k", F.row_number().over(w)).where("k <= 30").select("l_returnflag", "l_orderkey", "l_linenumber", "k")


@query("natural_order", "SELECT label, row_number() OVER (ORDER BY split_part(label, '-', 1)::INT, split_part(label, '-', 2)::INT) AS place FROM (SELECT DISTINCT (s_suppkey % 17)::VARCHAR || '-' || (s_nationkey)::VARCHAR AS label FROM supplier)")
def natural_order(spark, d):
    from strandline.functions.codes import site_sort_key

    s = table(spark, d, "supplier").select(F.concat_ws("-", F.col("s_suppkey") % 17, "s_nationkey").alias("label")).distinct()
    return tally.numbered(s, site_sort_key(F.col("label")), "place")


@query("top_units_preview", "SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5) ORDER BY n DESC, c_custkey LIMIT 30")
def top_units_preview(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n >= 5")
    return n.orderBy(F.desc("n"), "c_custkey").limit(30)


# U1 to U5
@query("harmonise_sources", "SELECT name, nation, balance, coalesce(segment, 'none') AS segment FROM (SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier)")
def harmonise_sources(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True).fillna({"segment": "none"})


@query("key_set_compare", "SELECT nation, CASE WHEN a IS NULL THEN 'missing' WHEN z IS NULL THEN 'extra' ELSE 'common' END AS side FROM (SELECT DISTINCT c_nationkey AS nation, 1 AS a FROM customer WHERE c_nationkey < 15) FULL JOIN (SELECT DISTINCT s_nationkey AS nation, 1 AS z FROM supplier WHERE s_nationkey > 9) USING (nation)")
def key_set_compare(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 15").select(F.col("c_nationkey").alias("nation"))
    return tally.set_compare(a, table(spark, d, "supplier").where("s_nationkey > 9").select(F.col("s_nationkey").alias("nation")), "nation")


@query("key_intersection", "(SELECT DISTINCT c_nationkey AS nation, 'both' AS side FROM customer WHERE c_nationkey < 15 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 9)) UNION ALL (SELECT DISTINCT c_nationkey, 'left' FROM customer WHERE c_nationkey < 15 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 9))")
def key_intersection(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 15").select(F.col("c_nationkey").alias("nation"))
    z = table(spark, d, "supplier").where("s_nationkey > 9").select(F.col("s_nationkey").alias("nation"))
    return a.intersect(z).withColumn("side", F.lit("both")).unionByName(a.subtract(z).withColumn("side", F.lit("left")))


# PF14 to PF16, X8
@query(
    "numeric_buckets",
    "SELECT p_partkey, (floor(p_size / 10) * 10)::INT AS decade, floor(log10(p_retailprice) * 10) * 10 AS log_class, round(p_retailprice / nullif(p_size, 0)::DOUBLE, 4) AS density, least(greatest((p_size - 10) / 30.0::DOUBLE, 0), 1) AS clamped FROM part",
)
def numeric_buckets(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", num.decade("p_size").alias("decade"), num.log10_class("p_retailprice").alias("log_class"), F.round(num.share("p_retailprice", "p_size"), 4).alias("density"), num.clamp01((F.col("p_size") - 10) / 30.0).alias("clamped")
    )


# K16
@query(
    "id_coverage",
    "WITH k AS (SELECT DISTINCT l_suppkey AS s, (l_partkey % 400)::BIGINT AS n FROM lineitem WHERE l_partkey % 400 > 0) SELECT s AS l_suppkey, max(n) AS largest, count(*) AS n_found, round(count(*) / max(n)::DOUBLE, 6) AS coverage, count(*) / max(n)::DOUBLE < 0.9 AND max(n) >= 20 AS failed FROM k GROUP BY 1",
)
def id_coverage(spark, d):
    k = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 400).alias("n"))
    return tally.id_coverage(k, "n", "l_suppkey").drop("missing_spans").withColumn("coverage", F.round("coverage", 6))
