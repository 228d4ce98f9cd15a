"""Bookkeeping of a harvest: merging, retry points, tables against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_points(found: DataFrame, key: str, order: Column, source: str) -> DataFrame:
    """One row for each key: the fields of its first record, its first source, all sources and their number."""
    rest = [c for c in found.columns if c not in (key, source)]
    first = F.min(F.struct(order.alias("__o"), F.col(source).alias("__s"), *rest)).alias("f")
    names = F.sort_array(F.collect_set(source))
    merged = found.groupBy(key).agg(first, names.alias("__all"))
    return merged.select(key, *[F.col("f")[c].alias(c) for c in rest], F.col("f.__s").alias("source_first_seen"), F.array_join("__all", ";").alias("source_hits"), F.size("__all").alias("n_sources"))


def union_fields(parts: list[DataFrame], preferred: list[str]) -> DataFrame:
    """All rows with the union of all columns, preferred ones first; absent values are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    first = [c for c in preferred if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def attempt_log(attempts: DataFrame, key: str) -> DataFrame:
    """``(key, n_attempts, n_failed, last_status, recovered)``."""
    last = F.max(F.struct("attempt", "status"))["status"]
    return attempts.groupBy(key).agg(F.count("*").alias("n_attempts"), F.count_if(F.col("status") != "ok").alias("n_failed"), last.alias("last_status"), (F.max((F.col("status") == "ok").cast("int")) == 1).alias("recovered"))


def retry_points(frame: DataFrame, offsets: tuple[float, ...] = (5.0, 10.0, 20.0), fractions: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Points to ask again for each row ``(id, lon, lat, proxy_lon, proxy_lat)``, equal ones (to 1e-9) once.

    Along the way from the proxy to the centre, and around the centre at ``offsets``
    metres to the four sides.
    """
    metre = 1 / 111_320.0
    along = [F.struct(F.lit(f"segment_{f:g}").alias("method"), (F.col("proxy_lon") + (F.col("lon") - F.col("proxy_lon")) * f).alias("x"), (F.col("proxy_lat") + (F.col("lat") - F.col("proxy_lat")) * f).alias("y")) for f in fractions]
    around = []
    for m in offsets:
        for name, east, north in (("E", m, 0.0), ("W", -m, 0.0), ("N", 0.0, m), ("S", 0.0, -m)):
            x = F.col("lon") + east * metre / F.cos(F.radians("lat"))
            around.append(F.struct(F.lit(f"offset_{m:g}_{name}").alias("method"), x.alias("x"), (F.col("lat") + north * metre).alias("y")))
    rows = frame.select("id", F.posexplode(F.array(*along, *around)).alias("i", "p"))
    key = [F.round("p.x", 9).alias("kx"), F.round("p.y", 9).alias("ky")]
    return rows.groupBy("id", *key).agg(F.min(F.struct("i", "p"))["p"].alias("p")).select("id", "p.method", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def validate_table(found: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, check)``: missing, extra, repeated, name_differs or ok, against a table of expected names."""
    counts = found.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("__found"))
    joined = counts.join(expected.select(key, F.col(value).alias("__want"), F.lit(1).alias("__e")), key, "outer")
    check = F.when(F.col("n").isNull(), "missing").when(F.col("__e").isNull(), "extra").when(F.col("n") > 1, "repeated").when(F.col("__want").isNotNull() & ~F.col("__found").eqNullSafe(F.col("__want")), "name_differs").otherwise("ok")
    return joined.select(key, check.alias("check"))


def assign_windows(labels: DataFrame, expected: DataFrame, least: float = 0.9) -> DataFrame:
    """``(block, unit, share)``: the unit whose ordered list has a window that best matches a block of labels.

    ``labels`` has ``(block, place, label)`` and ``expected`` ``(unit, place, label)``.
    A block lies on a unit at a shift; labels that meet at the same shift count, so
    one equality join replaces the search over windows.  Ties go to the smaller unit
    and shift; shares below ``least`` give no row.
    """
    met = labels.select("block", F.col("place").alias("p"), "label").join(expected.select("unit", F.col("place").alias("q"), "label"), "label")
    hits = met.groupBy("block", "unit", (F.col("q") - F.col("p")).alias("shift")).agg(F.countDistinct("p").alias("hits"))
    sizes = labels.groupBy("block").agg(F.countDistinct("place").alias("n"))
    best = hits.groupBy("block").agg(F.min(F.struct((-F.col("hits")).alias("h"), "unit", "shift")).alias("b")).join(sizes, "block")
    return best.select("block", "b.unit", (-F.col("b.h") / F.col("n")).alias("share")).where(F.col("share") >= least)
