"""Audits and diagnostics over the driver tables: summaries, files, outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import tally
from strandline.plans import bindings as b
from strandline.plans.registry import query
from strandline.session import scratch
from strandline.sources import diagnose, readers, writers


#: Order keys of a file
_SPAN = 10_000


# K8: CSV texts made from all orders, with planted faults; a folder for each status, with a file for each span of keys
def _files(spark, d):
    o = b.table(spark, d, "orders").withColumn("part", F.floor(F.col("o_orderkey") / _SPAN))
    broken = F.when(F.col("o_orderkey") % 200 == 1, "x").when(F.col("o_orderkey") % 200 == 51, "999").when(F.col("o_orderkey") % 200 == 101, "")
    line = F.concat_ws(",", "o_orderkey", F.coalesce(broken, F.lit("139.5")), F.lit("35.5"))
    texts = o.groupBy("o_orderstatus", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return texts.select(F.concat("o_orderstatus", F.lit(".csv/"), "part").alias("path"), F.encode(F.concat(F.lit("JASID,Lon,Lat\n"), "t"), "UTF-8").alias("content"))


@query(
    "csv_diagnostics",
    """SELECT o_orderstatus || '.csv' AS path, CASE o_orderkey % 200 WHEN 1 THEN 'coordinate_not_numeric' WHEN 51 THEN 'coordinate_out_of_range' ELSE 'coordinate_missing' END AS category, count(*) AS n FROM orders WHERE o_orderkey % 200 IN (1, 51, 101) GROUP BY 1, 2
    UNION ALL SELECT DISTINCT o_orderstatus || '.csv', 'missing_column', 1 FROM orders""",
)
def csv_diagnostics(spark, d):
    issues = diagnose.inspect(_files(spark, d), ["JASID", "LGC"]).withColumn("path", F.substring_index("path", "/", 1))
    # an issue of the header, in each file of a folder, counts once
    once = F.countDistinct(F.when(F.col("record_number").isNull(), F.struct("column_name", "message", "value")))
    return issues.groupBy("path", "category").agg((F.count("record_number") + once).alias("n"))


# SRC3: of each span of orders a file in each encoding: with a mark, in the older Japanese one, and broken
_MARKS = {"F": ("EFBBBF", ""), "O": ("", "82A0"), "P": ("", "81FF")}


@query(
    "encoding_sniff",
    """SELECT o_orderstatus || '.csv/' || (o_orderkey // 10000) AS path, CASE o_orderstatus WHEN 'F' THEN 'utf-8-sig' WHEN 'O' THEN 'cp932' WHEN 'P' THEN 'unknown' ELSE 'utf-8' END AS encoding, o_orderstatus = 'F' AS bom FROM orders GROUP BY ALL
    UNION ALL SELECT DISTINCT o_orderstatus || '.plain/' || (o_orderkey // 10000), 'utf-8', false FROM orders""",
)
def encoding_sniff(spark, d):
    files = _files(spark, d)
    head, tail = F.lit(b""), F.lit(b"")
    for status, (before, after) in _MARKS.items():
        head = F.when(F.col("path").startswith(status), F.unhex(F.lit(before))).otherwise(head)
        tail = F.when(F.col("path").startswith(status), F.unhex(F.lit(after))).otherwise(tail)
    plain = files.withColumn("path", F.regexp_replace("path", r"\.csv/", ".plain/"))
    return readers.sniff_encodings(files.withColumn("content", F.concat(head, "content", tail)).unionByName(plain))


# One long table of summaries
@query(
    "long_audit",
    "SELECT 'orders' AS summary_type, 'n' AS item, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'orders', 'n_customers', count(DISTINCT o_custkey)::VARCHAR FROM orders UNION ALL SELECT 'nations', 'n', count(*)::VARCHAR FROM nation",
)
def long_audit(spark, d):
    orders = b.table(spark, d, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"))
    return writers.long_audit({"orders": orders, "nations": b.table(spark, d, "nation").agg(F.count("*").alias("n"))})


# Keys that must be unique
@query("unique_key_audit", "SELECT 'orders' AS table_name, count(*) - count(DISTINCT o_orderkey) AS n_repeated FROM orders UNION ALL SELECT 'customer', count(*) - count(DISTINCT c_custkey) FROM customer")
def unique_key_audit(spark, d):
    parts = []
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        found = tally.duplicate_keys(b.table(spark, d, name), key).agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n_repeated"))
        parts.append(found.select(F.lit(name).alias("table_name"), "n_repeated"))
    return parts[0].unionByName(parts[1])


# SNK10, SNK11: a folder for each status that was written, and the status that never is
@query("output_audit", "SELECT 'o_orderstatus=' || o_orderstatus AS name, true AS found FROM orders GROUP BY 1 UNION ALL SELECT 'o_orderstatus=X', false")
def output_audit(spark, d):
    counts = b.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    folder = scratch(spark, "audit")
    counts.write.partitionBy("o_orderstatus").parquet(folder)
    expected = [f"o_orderstatus={r[0]}" for r in counts.select("o_orderstatus").collect()]  # three statuses
    return writers.output_audit(spark, [*expected, "o_orderstatus=X"], folder)
