"""Connected components by alternating large-star and small-star steps, or in one task where edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.session import checkpointed

#: Up to so many edges one task joins in memory, instead of a dozen shuffles a round.
LOCAL = 200_000


def _ordered(node) -> tuple:
    """A node as Spark orders it: null first, structs by their fields."""
    if isinstance(node, dict):
        return tuple(_ordered(v) for v in node.values())
    return (node is not None, node)


def _joined_in_task(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of few edges ``(u, v)``, by union and find in one task."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[tuple, tuple] = {}
        names: dict[tuple, object] = {}

        def find(n: tuple) -> tuple:
            while above[n] != n:
                above[n] = n = above[above[n]]
            return n

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = _ordered(u), _ordered(v)
                for key, node in ((a, u), (b, v)):
                    names.setdefault(key, node)
                    above.setdefault(key, key)
                low, high = sorted((find(a), find(b)))
                above[high] = low
        keys = list(names)
        for at in range(0, len(keys), 10_000):
            part = keys[at : at + 10_000]
            columns = [[names[k] for k in part], [names[find(k)] for k in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(kind)) for c in columns], ["node", "root"])

    plain = kind.simpleString()
    return checkpointed(edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {plain}, root {plain}"))


def _stamp(edges: DataFrame) -> tuple:
    """Row count and an order-free hash sum; equal stamps mean equal edge sets."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, left: str, right: str, local: int = LOCAL) -> DataFrame:
    """Component of every node that has an edge to another node.

    Returns ``(node, root)``; ``root`` is the smallest node of the component
    (roots are listed too).  Null end points and loops are ignored; an edge may be
    given in either or both directions.  Up to ``local`` edges one task joins them; beyond
    it, each round rewrites the edge set with
    map-side combined minima, so that a node with very many edges is never
    gathered; the edge set never grows beyond its start.
    """
    u, v = F.col(left), F.col(right)
    current = checkpointed(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    stamp = _stamp(current)
    if stamp[0] <= local:
        return _joined_in_task(current)
    while stamp[0]:
        # large star: hang every larger neighbour of u below u's smallest neighbour
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join deals it anew and a node with very many neighbours can be split
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = (
            current.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(low, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .distinct()
        )
        # small star: hang u and its smaller neighbours below the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(small_low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        current = checkpointed(small)
        after = _stamp(current)
        if after == stamp:
            break
        stamp = after
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
