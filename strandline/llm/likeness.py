"""Texts alike by exact Jaccard likeness of their sets of five-word shingles.

Candidates come from MinHash: BANDS keys of ROWS minima each; a pair of likeness 0.8
has a common key in 998 of 1,000 cases.  Texts with a common key form a bucket.  First
each meets one of its bucket, the text whose keys are the most common (of lightly
edited copies that is the text they were made from).  Buckets that this doesn't join
into one component are compared in tiles: every member outside the bucket's largest
component meets every member, so that no pair of a bucket is passed over at any size.
Every link is verified on the whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_batches, raw, sliced, words_of
from strandline.session import checkpointed, let_go

#: Words of a shingle, keys of a text and minima in a key.
WIDE, BANDS, ROWS = 5, 16, 5
#: Least share of common shingles of near-duplicates.
LIKE = 0.8
#: Bytes of shingles on either side of a tile.
TILE = 4 << 20

_PLACE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(42).integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles_of(text: bytes, width: int = WIDE) -> np.ndarray:
    """Sorted hashes of the different shingles of ``width`` words; of a shorter text, of all its words."""
    known: dict[bytes, int] = {}
    parts, last = [], np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for words in words_of(text.lower()):
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w, 43)
            hashes = np.concatenate([last, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))])
            last = hashes[max(0, len(hashes) - width + 1) :]
            if len(hashes) >= width:
                gram = hashes[: len(hashes) - width + 1]
                for i in range(1, width):
                    gram = gram * _PLACE + hashes[i : len(hashes) - width + 1 + i]
                parts.append(np.unique(_mix(gram)))
        if len(last) and not parts:
            gram = last[0]
            for h in last[1:]:
                gram = gram * _PLACE + h
            parts = [_mix(np.array([gram + np.uint64(len(last))], np.uint64))]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles, each a hash of ROWS minima; none of an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            z = shingles[at : at + 1024, None] * _FACTORS[0]
            z = (z ^ (z >> np.uint64(32))) * _FACTORS[1]
            least = np.minimum(least, z.min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    """Likeness of two sorted sets; 0 for two empty ones."""
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common / max(1, len(one) + len(two) - common)


def tiles(rows: DataFrame, payload: DataFrame, weight: Column, limit: int, compare: Callable) -> DataFrame:
    """Edges ``(a, b)`` that ``compare`` finds between members of one bucket and different ``mark``.

    ``rows`` has ``bucket``, ``member``, ``mark`` (the component of a member, hashed) and what ``weight``
    reads, ``payload`` a row for each ``member`` or each ``(bucket, member)``.  In each bucket, members
    outside the component of the most ``weight`` are dealt to chunks, all members to blocks, of about
    ``limit`` weight each, and every chunk meets every block in a task.  ``compare`` gets two dicts of
    arrays by column, and returns two arrays of member names (unsigned).
    """
    weighed = rows.withColumn("weight", weight.cast("long"))
    parts = weighed.groupBy("bucket", "mark").agg(F.sum("weight").alias("w"))
    whole = parts.groupBy("bucket").agg(F.sum("w").alias("w"), F.max(F.struct("w", "mark")).alias("main")).where("w > main.w")
    grid = checkpointed(
        whole.select("bucket", F.col("main.mark").alias("main"), F.ceil((F.col("w") - F.col("main.w")) / limit).alias("chunks"), F.ceil(F.col("w") / limit).alias("blocks"))
    )
    met = rows.select("bucket", "member", "mark").join(grid, "bucket").withColumn("place", F.xxhash64("member", F.lit(3)))
    keys = [c for c in payload.columns if c in ("bucket", "member")]
    met = met.join(payload, keys)
    columns = ["member", *[c for c in payload.columns if c not in keys]]

    # a member outside the main component stands on both sides of the grid
    sides = F.filter(F.array(F.when(F.col("mark") != F.col("main"), F.lit(0)), F.lit(1)), lambda x: x.isNotNull())
    both = met.withColumn("side", F.explode(sides))
    on_left = F.col("side") == 0
    own, other = (F.when(on_left, F.col(x)).otherwise(F.col(y)) for x, y in (("chunks", "blocks"), ("blocks", "chunks")))
    both = both.withColumn("own", F.pmod("place", own)).withColumn("across", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    pair = F.when(on_left, F.struct(F.col("own").alias("l"), F.col("across").alias("r"))).otherwise(F.struct(F.col("across").alias("l"), F.col("own").alias("r")))
    both = both.select(F.xxhash64("bucket", pair).alias("tile"), "side", "mark", *columns)
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}

    def values(column: pa.Array, name: str):
        if kinds[name] == "binary":
            return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mark", *columns]
        held: list[tuple[int, pa.RecordBatch]] = []  # pieces of one tile

        def close() -> pa.RecordBatch | None:
            table = pa.Table.from_batches([b for _, b in held]).combine_chunks()
            side = table.column("side").to_numpy()
            cut = int(np.searchsorted(side, 1))
            if not cut or cut == len(side):
                return None
            halves = [{n: values(t.column(n).combine_chunks(), n) for n in names} for t in (table.slice(0, cut), table.slice(cut))]
            a, b = compare(*halves)
            return pa.RecordBatch.from_pydict({"a": np.ascontiguousarray(a, np.uint64).view(np.int64), "b": np.ascontiguousarray(b, np.uint64).view(np.int64)})

        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.nonzero(np.diff(tile))[0] + 1, [len(tile)]])
            for at, end in zip(starts[:-1], starts[1:], strict=True):
                if held and held[0][0] != tile[at]:
                    if (found := close()) is not None:
                        yield found
                    held.clear()
                held.append((int(tile[at]), batch.slice(at, end - at)))
        if held and (found := close()) is not None:
            yield found

    return both.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(run, "a long, b long")


def _alike(like: float) -> Callable:
    def compare(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in right["set"]])
        values, ids = np.unique(np.concatenate(right["set"]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        held, a, b = np.zeros(len(values), np.int64), [], []
        for name, mark, own in zip(left["member"], left["mark"], left["set"], strict=True):
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            at = at[values[at] == own]
            held[at] = 1
            common = np.add.reduceat(held[ids], starts)
            held[at] = 0
            hit = (common >= like * (len(own) + sizes - common)) & (right["mark"] != mark) & (common > 0)
            _, first = np.unique(right["mark"][hit], return_index=True)  # one link to each component is enough
            a.append(np.full(len(first), name))
            b.append(right["member"][hit][first])
        return np.concatenate(a), np.concatenate(b)

    return compare


def similar(single: DataFrame, texts: DataFrame, rooted: Callable[[], DataFrame], like: float = LIKE, limit: int = TILE) -> Iterator[DataFrame]:
    """Edges ``(a, b)`` between values ``fp``, in two steps; ``rooted()`` tells ``(fp, root)`` at either.

    ``single`` has ``(h, fp, id, keys)`` for each different text: its hash, fingerprint, the id of a row that
    has it and its keys; ``texts`` has ``(h, id, text)`` rows.
    """
    names = single.select("h", "fp")
    labels = lambda: names.join(rooted(), "fp").select("h", F.xxhash64("root").alias("mark"))
    marked = single.join(rooted(), "fp").select("h", F.xxhash64("root").alias("mark"), F.explode("keys").alias("bucket"))
    open_ = marked.groupBy("bucket").agg(F.count("*").alias("n"), F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi")
    rows = checkpointed(marked.join(checkpointed(open_.select("bucket", "n")), "bucket"))

    def sets(batch: pa.RecordBatch) -> dict:
        found = [shingles_of(t) for t in raw(batch.column(1))]
        return {"h": batch.column(0), "set": pa.array([s.tobytes() for s in found], pa.binary()), "size": pa.array(map(len, found), pa.int64())}

    needed = checkpointed(rows.select("h").distinct().join(single.select("h", "id"), "h").select(F.col("h").alias("g"), F.col("id").alias("one")))
    found = texts.join(needed, (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("one")), "left_semi").select("h", "text")
    held = checkpointed(map_batches(found, sets, "h long, set binary, size long", "text"))
    if held.count() > needed.count():  # rows that repeat id and text
        held = checkpointed(held.dropDuplicates(["h"]))

    let_go(single.sparkSession)
    # a text whose keys many others have is met by all that have one
    score = rows.groupBy("h").agg(F.sum("n").alias("score"))
    hubs = rows.join(score, "h").groupBy("bucket").agg(F.max(F.struct("score", F.xxhash64("h").alias("o"), "h", "mark")).alias("hub"))
    hubs = checkpointed(hubs.select("bucket", F.col("hub.h").alias("g"), F.col("hub.mark").alias("other")))
    rest = checkpointed(rows.select("bucket", "h", "mark").join(hubs, "bucket").where("h <> g"))
    sizes = held.select("h", "size")
    pairs = rest.where("mark <> other").select("h", "g").distinct()
    pairs = pairs.join(sizes, "h").join(sizes.select(F.col("h").alias("g"), F.col("size").alias("size2")), "g")
    pairs = pairs.where((F.least("size", "size2") >= like * F.greatest("size", "size2"))).select("h", "g")
    both = pairs.join(held.select("h", "set"), "h").join(held.select(F.col("h").alias("g"), F.col("set").alias("set2")), "g")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "set"):
            one, two = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            hit = pa.array([jaccard(x, y) >= like for x, y in zip(one, two, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(hit), "b": batch.column(1).filter(hit)})

    def by_print(edges: DataFrame) -> DataFrame:
        left = names.select(F.col("h").alias("a"), F.col("fp").alias("fa"))
        right = names.select(F.col("h").alias("b"), F.col("fp").alias("fb"))
        return edges.join(left, "a").join(right, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))

    yield by_print(both.select("h", "g", "set", "set2").mapInArrow(verified, "a long, b long"))
    rest = checkpointed(rest.select("bucket", "h").join(labels(), "h").join(sizes, "h").withColumnRenamed("h", "member"))
    yield by_print(tiles(rest, held.select(F.col("h").alias("member"), "set"), 8 * F.col("size"), limit, _alike(like)))
