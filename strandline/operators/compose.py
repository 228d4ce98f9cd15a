"""Composition of phases over groups: profiles, breadth, concentration, distances, correspondence analysis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.numeric import share


def profile(members: DataFrame, keys: list[str], group: str, place: str = "place_id", state: str = "presence") -> DataFrame:
    """``(*keys, group, presence_count, known_total, phase_share)`` from one row for each place, phase and group.

    Counts places with state 1; groups without any have no row.
    """
    counts = members.where(F.col(state) == 1).groupBy(*keys, group).agg(F.countDistinct(place).alias("presence_count"))
    total = F.sum("presence_count").over(Window.partitionBy(*keys))
    return counts.select(*keys, group, "presence_count", total.alias("known_total"), share("presence_count", total).alias("phase_share"))


def breadth(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Active groups, entropy over log of the number of positive shares (0 for one or none), and the largest share."""
    p = F.when(F.col("phase_share") > 0, F.col("phase_share"))
    n = F.count(p)
    entropy = F.sum(-p * F.ln(p))
    return profiles.groupBy(*keys).agg(
        n.alias("active_groups"), F.when(n > 1, entropy / F.ln(n)).otherwise(0.0).alias("normalised_entropy"), F.max("phase_share").alias("max_share")
    )


def concentration(profiles: DataFrame, baseline: DataFrame, keys: list[str], group: str, high: float = 1.25, low: float = 0.80) -> DataFrame:
    """Share of a group in a phase over its share in the whole sample (``baseline_share``), and the class of that ratio."""
    joined = profiles.join(baseline, [k for k in keys if k in baseline.columns] + [group], "left")
    ratio = share("phase_share", "baseline_share")
    kind = F.when(ratio.isNull(), "undefined").when(ratio >= high, "relatively_concentrated").when(ratio <= low, "relatively_sparse").otherwise("near_baseline")
    return joined.withColumns({"relative_concentration": ratio, "concentration_class": kind})


def distances(profiles: DataFrame, scheme: str, order: str, group: str, adjacent: bool = True) -> DataFrame:
    """Jensen-Shannon divergence (base 2), Hellinger and Bray-Curtis distance between phases of a scheme.

    Each group's shares over the phases become one array, so that every pair of
    phases is compared on one row; sums over groups follow.
    """
    tops = profiles.select(order).distinct().orderBy(order).collect()  # the phases
    phases = [r[0] for r in tops]
    wide = profiles.groupBy(scheme, group).agg(*[F.coalesce(F.max(F.when(F.col(order) == i, F.col("phase_share"))), F.lit(0.0)).alias(f"__{i}") for i in phases])
    pairs = list(zip(phases, phases[1:], strict=False)) if adjacent else [(a, b) for a in phases for b in phases if a < b]
    if not pairs:
        return profiles.sparkSession.createDataFrame([], f"{scheme} string, from_order int, to_order int, js_divergence double, hellinger_distance double, bray_curtis double")
    kl = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = []
    for i, j in pairs:
        p, q = F.col(f"__{i}"), F.col(f"__{j}")
        m = (p + q) / 2
        parts.append(F.struct(F.lit(i).alias("from_order"), F.lit(j).alias("to_order"), ((kl(p, m) + kl(q, m)) / 2).alias("js"), ((F.sqrt(p) - F.sqrt(q)) ** 2).alias("he"), F.abs(p - q).alias("l1")))
    rows = wide.select(scheme, F.explode(F.array(*parts)).alias("d")).select(scheme, "d.*")
    return rows.groupBy(scheme, "from_order", "to_order").agg(
        F.sum("js").alias("js_divergence"), F.sqrt(F.sum("he") / 2).alias("hellinger_distance"), (F.sum("l1") / 2).alias("bray_curtis")
    )


def correspondence(counts: DataFrame, row: str, column: str, n: str, axes: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row coordinates, column coordinates, inertia) of a table with few rows and any number of columns.

    The matrix of standardised residuals is never gathered: its product with itself,
    of the size rows times rows, is summed in Spark, decomposed on the driver, and
    the column coordinates are projected in Spark.  Each axis has the sign that
    makes its first non-zero row loading positive.
    """
    spark = counts.sparkSession
    names = [r[0] for r in counts.where(F.col(n) > 0).select(row).distinct().orderBy(row).collect()]
    if not names:
        empty = spark.createDataFrame([], "axis int, inertia double, share double")
        return empty, empty, empty
    wide = counts.groupBy(column).agg(*[F.coalesce(F.sum(F.when(F.col(row) == v, F.col(n))), F.lit(0)).cast("double").alias(f"__{i}") for i, v in enumerate(names)])
    total_of = wide.agg(*[F.sum(f"__{i}") for i in range(len(names))]).first()
    totals = np.array(total_of, float)
    grand = totals.sum()
    r = totals / grand
    c = sum((F.col(f"__{i}") for i in range(1, len(names))), F.col("__0")) / float(grand)
    wide = wide.withColumn("__c", c).where("__c > 0")
    s = [(F.col(f"__{i}") / float(grand) - float(r[i]) * F.col("__c")) / F.sqrt(float(r[i]) * F.col("__c")) for i in range(len(names))]
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = wide.agg(*[F.sum(s[i] * s[j]) for i, j in upper]).first()
    gram = np.zeros((len(names), len(names)))
    for (i, j), v in zip(upper, sums, strict=True):
        gram[i, j] = gram[j, i] = v
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    for k in range(vectors.shape[1]):
        lead = np.nonzero(np.abs(vectors[:, k]) > 1e-9)[0]
        if len(lead) and vectors[lead[0], k] < 0:
            vectors[:, k] *= -1
    kept = min(axes, max(1, len(names) - 1))
    coords = vectors[:, :kept] * np.sqrt(values[:kept]) / np.sqrt(r)[:, None]
    kind = counts.schema[row].dataType.simpleString()
    rows = spark.createDataFrame([(v, *map(float, coords[i])) for i, v in enumerate(names)], f"{row} {kind}, " + ", ".join(f"axis{k + 1} double" for k in range(kept)))
    project = [sum((s[i] * float(vectors[i, k]) for i in range(1, len(names))), s[0] * float(vectors[0, k])) / F.sqrt("__c") for k in range(kept)]
    columns = wide.select(column, *[p.alias(f"axis{k + 1}") for k, p in enumerate(project)])
    whole = values.sum() or 1.0
    inertia = spark.createDataFrame([(k + 1, float(v), float(v / whole)) for k, v in enumerate(values[: len(names) - 1])], "axis int, inertia double, share double")
    return rows, columns, inertia
