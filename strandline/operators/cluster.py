"""Clusters of presence patterns: binary Jaccard distance, average linkage.

A pattern of n phases has at most 2**n - 1 forms with presence (127 of 7), however
many places there are.  Spark counts the patterns; what follows is on that small
table, on the driver, with numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import sequence as seq

SEED = 20260809


def jaccard(patterns: np.ndarray) -> np.ndarray:
    """1 - |both| / |either| for every pair of 0/1 rows; 0 for two empty ones."""
    both = patterns @ patterns.T
    size = patterns.sum(axis=1)
    either = size[:, None] + size[None, :] - both
    return np.where(either > 0, 1 - both / np.maximum(either, 1), 0.0)


def average_linkage(distance: np.ndarray) -> list[tuple[int, int]]:
    """Merges of an average-linkage tree; node n + i is the i-th merge.  The first of equal pairs merges first."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((name[i], name[j]))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
    return out


def cut(merges: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    """Labels from 1, in the order of first appearance, of a tree cut into ``k`` clusters."""
    members = {i: [i] for i in range(n)}
    for step, (a, b) in enumerate(merges[: n - k]):
        members[n + step] = members.pop(a) + members.pop(b)
    label = np.zeros(n, int)
    for number, rows in enumerate(sorted(members.values(), key=min), 1):
        label[rows] = number
    return label


def silhouettes(distance: np.ndarray, label: np.ndarray) -> np.ndarray:
    names = np.unique(label)
    means = np.stack([distance[:, label == c].sum(axis=1) for c in names], axis=1)
    counts = np.array([(label == c).sum() for c in names])
    own = np.searchsorted(names, label)
    rows = np.arange(len(label))
    a = means[rows, own] / np.maximum(counts[own] - 1, 1)
    others = means / counts
    others[rows, own] = np.inf
    b = others.min(axis=1)
    return np.where(counts[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    index, ra, rb, total = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), len(a) * (len(a) - 1) / 2
    expected, most = ra * rb / total if total else 0.0, (ra + rb) / 2
    return 1.0 if most == expected else float((index - expected) / (most - expected))


def choose_k(patterns: np.ndarray, weight: np.ndarray, candidates=range(2, 11), repeats: int = 50, fraction: float = 0.8, seed: int = SEED) -> tuple[int, list[dict]]:
    """Best number of clusters by weighted silhouette, then stability, then fewest; and the table of all candidates."""
    distance, n = jaccard(patterns), len(patterns)
    merges = average_linkage(distance)
    rng = np.random.default_rng(seed)
    samples = [np.sort(rng.choice(n, max(2, int(round(n * fraction))), replace=False)) for _ in range(repeats)]
    trees = [average_linkage(distance[np.ix_(s, s)]) for s in samples]
    table = []
    for k in candidates:
        if k >= n:
            break
        label = cut(merges, n, k)
        s = silhouettes(distance, label)
        ari = [adjusted_rand(label[rows], cut(tree, len(rows), k)) for rows, tree in zip(samples, trees, strict=True) if k < len(rows)]
        table.append({"k": k, "silhouette": float(s.mean()), "weighted_silhouette": float(np.average(s, weights=weight)), "stability": float(np.mean(ari)) if ari else 0.0})
    if not table:
        return 1, table
    return min(table, key=lambda t: (-round(t["weighted_silhouette"], 9), -round(t["stability"], 9), t["k"]))["k"], table


def sequence_clusters(frame: DataFrame) -> DataFrame:
    """``(sequence, n_places, cluster_id, subcluster_id)`` of every pattern with presence.

    If one cluster holds half of all places and three patterns or more, it is split
    again (k from 2 to 6); others have subcluster 1.
    """
    spark = frame.sparkSession
    sequence = seq.sequence_string(F.col("states"))
    counts = frame.groupBy(sequence.alias("sequence")).agg(F.count("*").alias("n")).where(F.col("sequence").contains("1") & ~F.col("sequence").contains("N"))
    rows = sorted((r["sequence"], r["n"]) for r in counts.collect())  # at most 2**phases - 1
    schema = "sequence string, n_places long, cluster_id int, subcluster_id int"
    if not rows:
        return spark.createDataFrame([], schema)
    patterns = np.array([[int(c) for c in s] for s, _ in rows])
    weight = np.array([n for _, n in rows], float)
    k, _ = choose_k(patterns, weight)
    label = cut(average_linkage(jaccard(patterns)), len(rows), k)
    sub = np.ones(len(rows), int)
    totals = np.bincount(label, weights=weight)
    big = int(totals.argmax())
    inside = np.nonzero(label == big)[0]
    if totals[big] / weight.sum() >= 0.5 and len(inside) >= 3:
        k2, _ = choose_k(patterns[inside], weight[inside], range(2, 7))
        sub[inside] = cut(average_linkage(jaccard(patterns[inside])), len(inside), k2)
    return spark.createDataFrame([(s, int(n), int(c), int(u)) for (s, n), c, u in zip(rows, label, sub, strict=True)], schema)


def profile(measured: DataFrame, clusters: DataFrame) -> DataFrame:
    """Size, mean index and runs, most frequent pattern and presence rate by phase of each cluster."""
    named = measured.withColumn("sequence", seq.sequence_string(F.col("states"))).join(F.broadcast(clusters), "sequence")  # at most 127 rows
    top = clusters.groupBy("cluster_id").agg(F.max(F.struct("n_places", "sequence"))["sequence"].alias("modal_sequence"))
    rates = [F.avg(F.element_at("states", i)).alias(f"rate_{p}") for i, p in enumerate(seq.PHASES, 1)]
    return named.groupBy("cluster_id").agg(F.count("*").alias("n_places"), F.avg("continuity_index").alias("mean_continuity"), F.avg("run_count").alias("mean_runs"), *rates).join(top, "cluster_id")
