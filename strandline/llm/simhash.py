"""SimHash near-duplicates by covering locality-sensitive hashing.

Two fingerprints of 64 bits are linked if they differ in at most ``RADIUS`` bits.
A covering family (Pagh, "CoveringLSH", 2016) finds every link: each bit position
gets a non-zero vector of RADIUS + 1 bits, and for each non-zero vector v the mask
of v keeps the positions whose vector has odd overlap with v.  The vectors of any
RADIUS differing positions leave some v orthogonal to all of them, so the pair
agrees on the mask of that v.  A bucket with more than ``BUCKET`` different
fingerprints is never gathered: its members move on to buckets under a further
covering of the bits that the first mask left free.  After three coverings at most
eight bits are free, so the third level holds no bucket over 2**8 members and the
search is exact at any size.

Three bits of 64 mean nearly equal texts: a few changed words among some hundred move
more.  To find texts that share four fifths of their shingles of five words, a stage
adds word prints: independent fingerprints over the different words of a text, which
an edit moves much less.  Print by print they go through the same covering; a link
also needs fingerprints of shingles that are close, so that texts which merely use the
same words stay apart.  Texts with a changed, added or cut passage come by their shingles
(``likeness.py``).  Components are built over (id, fingerprint) pairs, so that the least
of a component carries its smallest id and no group is ever brought together for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_batches, raw, words_of
from strandline.llm.likeness import LIKE, band_keys, shingles_of, similar, tiles
from strandline.operators.components import connected_components
from strandline.session import checkpointed, let_go

BITS, RADIUS, LEVELS = 64, 3, 3
#: Most different fingerprints that a bucket compares directly.
BUCKET = 2048
#: Word prints of a text, and the most bits by which the fingerprints of two texts that these link differ.
SLOTS, NEAR = 6, 13
#: Pairs of members of a bucket of word prints compared at a time.
TILE = 1 << 24
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_PLACE = (np.arange(8) * 256).astype(np.int64)


def covering(free: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the positions ``free``; any ``radius`` of them are all outside some mask."""
    top = (1 << (radius + 1)) - 1
    vector = {position: i % top + 1 for i, position in enumerate(free)}
    return [
        reduce(or_, (1 << p for p in free if (vector[p] & v).bit_count() % 2), 0) for v in range(1, top + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=8)
def _refinements(level: int) -> list[tuple[int, int]]:
    """(mask, finer mask) pairs that lead from ``level`` to the next one."""
    masks = {0}
    for _ in range(level):
        masks = {m | c for m in masks for c in covering([p for p in range(BITS) if not m >> p & 1])}
    return sorted({(m, m | c) for m in masks for c in covering([p for p in range(BITS) if not m >> p & 1])})


def simhash(text: bytes, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint over shingles of ``width`` words, repeats included."""
    ones, total, last = np.zeros(BITS, np.int64), 0, []
    for words in words_of(text.lower()):
        words = last + words
        last = words[max(0, len(words) - width + 1) :]
        shingles = zip(*(words[i:] for i in range(width)), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles], np.uint64)
        if len(hashes):
            total += len(hashes)
            bytes_ = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_PLACE
            counts = np.bincount(bytes_.ravel(), minlength=2048).reshape(8, 256)
            ones += (counts @ _BIT_OF_BYTE).ravel()
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(last), 42) if last else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def word_prints(text: bytes, slots: int) -> np.ndarray:
    """``slots`` independent fingerprints over the different words of a text, each word once."""
    words = {w for part in words_of(text.lower()) for w in part}
    if not words:
        return np.zeros(slots, np.uint64)
    hashes = np.array(sorted(xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64)
    out = np.zeros(slots, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(slots):
            z = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
            counts = np.bincount((z.view(np.uint8).reshape(-1, 8) + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
            ones = (counts @ _BIT_OF_BYTE).ravel()
            out[i] = np.packbits(2 * ones > len(z), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, slots: int = 0, keys: bool = False) -> DataFrame:
    """``(id, fp, s0, s1, ..., keys)``, a row for each input row: the fingerprint and ``slots`` word prints as signed longs.

    With ``keys``, also the list of ``likeness.band_keys``.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = raw(batch.column(1))
        fps = np.fromiter((simhash(t, width) for t in texts), np.uint64, batch.num_rows)
        prints = np.stack([word_prints(t, slots) for t in texts]) if slots else np.zeros((len(texts), 0), np.uint64)
        named = {f"s{i}": pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(slots)}
        if keys:
            named["keys"] = pa.array([band_keys(shingles_of(t)) for t in texts], pa.list_(pa.int64()))
        return {"id": batch.column(0), "fp": pa.array(fps.view(np.int64))} | named

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, fp long" + "".join(f", s{i} long" for i in range(slots)) + ", keys array<long>" * keys
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema, "text")


def _forest(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest linked member) within a bucket, by a breadth-first search."""
    rest, above, root = np.sort(members), [], []
    while len(rest) > 1:
        seed, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for part in range(0, len(front), 256):
                apart = np.bitwise_count(front[part : part + 256, None] ^ rest[None, :])
                near |= (apart <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            above.append(front)
            root.append(np.full(len(front), seed, rest.dtype))
    empty = [np.zeros(0, members.dtype)]
    return np.concatenate(above or empty), np.concatenate(root or empty)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between the different values ``fp`` of ``fps``.

    The edges join all and only those values that chains of links within RADIUS
    join; pairs that a bucket already joins through a third value are left out.
    """

    def run(batch: pa.RecordBatch) -> dict:
        found = batch.column(0)
        starts, values = found.offsets.to_numpy(), found.values.to_numpy()
        out = [_forest(values[a:b].view(np.uint64), RADIUS) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        sides = [np.concatenate([o[i] for o in out]).view(np.int64) for i in (0, 1)]
        return {"a": pa.array(sides[0]), "b": pa.array(sides[1])}

    spark = fps.sparkSession
    rows, parts = fps.select("fp", F.lit(0).cast("long").alias("mask")), []
    for level in range(LEVELS):
        # a table of 15, 225 or 3,375 pairs of masks, whatever the input
        steps = spark.createDataFrame(
            [(_signed(m), _signed(f)) for m, f in _refinements(level)], "mask long, finer long"
        )
        rows = rows.join(F.broadcast(steps), "mask").select(
            "fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")
        )
        small = rows
        if level < LEVELS - 1:
            large = checkpointed(
                rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).drop("n")
            )
            if large.isEmpty():
                rows = None
            else:
                small = rows.join(large, ["mask", "key"], "left_anti")
                rows = rows.join(large, ["mask", "key"], "left_semi").drop("key")
        gathered = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        parts.append(map_batches(gathered.select("fps"), run, "a long, b long"))
        if rows is None:
            break
    return reduce(DataFrame.unionByName, parts)


def _forest_of_both(fps: np.ndarray, prints: np.ndarray, radius: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_forest`` on ``fps``, where both the prints and the fingerprints must be close."""
    rest, above, root = np.arange(len(fps)), [], []
    while len(rest) > 1:
        seed, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            hit, step = np.zeros(len(rest), bool), max(1, TILE // len(rest))
            for part in range(0, len(front), step):
                f = front[part : part + step, None]
                close = (np.bitwise_count(prints[f] ^ prints[rest]) <= radius) & (np.bitwise_count(fps[f] ^ fps[rest]) <= near)
                hit |= close.any(axis=0)
            front, rest = rest[hit], rest[~hit]
            above.append(fps[front])
            root.append(np.full(len(front), fps[seed], np.uint64))
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(above or empty), np.concatenate(root or empty)


def word_links(items: DataFrame, radius: int = RADIUS, near: int = NEAR, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame | None]:
    """Edges ``(a, b)`` between fingerprints ``fp`` of ``(fp, s0, s1, ...)``, and what ``wide_links`` has to compare.

    Two texts are linked if one of their word prints differs in at most ``radius``
    bits and their fingerprints in at most ``near``.  Every such pair meets in a
    bucket of some covering mask.  Rows ``(bucket, fp, s)`` of large buckets (told from
    one item in sixteen: that bears on the cost only) are returned, or None if there are none.
    """

    def edges_of(bucket_ids: np.ndarray, fps: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.nonzero(np.concatenate([[True], bucket_ids[1:] != bucket_ids[:-1]]))[0]
        sizes = np.diff(np.concatenate([starts, [len(bucket_ids)]]))
        two = starts[sizes == 2]
        close = (np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius) & (np.bitwise_count(fps[two] ^ fps[two + 1]) <= near)
        left, right = [fps[two[close]]], [fps[two[close] + 1]]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            a, b = _forest_of_both(fps[at : at + n], prints[at : at + n], radius, near)
            left.append(a)
            right.append(b)
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on in the next batch
            if cut:
                a, b = edges_of(held[0][:cut], held[1][:cut].view(np.uint64), held[2][:cut].view(np.uint64))
                held = [h[cut:] for h in held]
                yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})
        if len(held[0]):
            a, b = edges_of(held[0], np.ascontiguousarray(held[1]).view(np.uint64), np.ascontiguousarray(held[2]).view(np.uint64))
            yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    prints_ = F.array(*[c for c in items.columns if c != "fp"])
    masks = F.explode(F.array(*[F.lit(_signed(m)) for m in covering(list(range(BITS)), radius)])).alias("mask")
    rows = items.select("fp", F.posexplode(prints_).alias("slot", "s")).select("fp", "slot", "s", masks)
    rows = rows.select(F.xxhash64("slot", "mask", F.col("s").bitwiseAND(F.col("mask"))).alias("bucket"), "fp", "s")
    some = rows.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(16)) == 0)
    large = checkpointed(some.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket / 32).drop("n"))
    wide = None
    if not large.isEmpty():
        rows, wide = rows.join(large, "bucket", "left_anti"), checkpointed(rows.join(large, "bucket", "left_semi"))
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "fp", "s")
    return dealt.mapInArrow(run, "a long, b long"), wide


def _close(radius: int, near: int) -> Column:
    """Whether the rows ``fp, s`` and ``fp2, s2`` are linked."""
    return (F.bit_count(F.col("s").bitwiseXOR(F.col("s2"))) <= radius) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= near)


def star_links(rows: DataFrame, radius: int = RADIUS, near: int = NEAR) -> DataFrame:
    """Edges between the members of each bucket of ``(bucket, fp, s)`` and one of them."""
    one = checkpointed(rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("fp").alias("o"), "fp", "s")).alias("one")))
    met = rows.join(one.select("bucket", F.col("one.fp").alias("fp2"), F.col("one.s").alias("s2")), "bucket")
    return met.where(_close(radius, near)).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))


def wide_links(rows: DataFrame, labels: DataFrame, radius: int = RADIUS, near: int = NEAR, limit: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` in buckets ``(bucket, fp, s)`` of any size, between fingerprints of different ``labels`` ``(fp, root)``.

    Each tile of ``likeness.tiles`` is one comparison of at most some ``limit`` by ``limit`` members.
    """

    def run(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        for i in range(len(left["mark"])):
            hit = (np.bitwise_count(left["s"][i] ^ right["s"]) <= radius) & (np.bitwise_count(left["member"][i] ^ right["member"]) <= near) & (right["mark"] != left["mark"][i])
            _, first = np.unique(right["mark"][hit], return_index=True)  # one link to each component is enough
            a.append(np.full(len(first), left["member"][i]))
            b.append(right["member"][hit][first])
        return np.concatenate(a), np.concatenate(b)

    members = rows.join(labels.select("fp", F.xxhash64("root").alias("mark")), "fp").select("bucket", F.col("fp").alias("member"), "mark")
    return tiles(members, rows.select("bucket", F.col("fp").alias("member"), "s").distinct(), F.lit(1), limit, run)


def _rooted(firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, root)`` for every ``(fp, node)`` of ``firsts``: the least node that ``edges`` between values ``fp`` join to its own."""
    left, right = (firsts.select(F.col("fp").alias(side), F.col("node").alias(f"n{side}")) for side in "ab")
    roots = connected_components(edges.where("a <> b").join(left, "a").join(right, "b"), "na", "nb")
    return checkpointed(firsts.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root")))


def _joined(rooted: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, root)`` after further ``edges`` between values ``fp``."""
    left, right = (rooted.select(F.col("fp").alias(side), F.col("root").alias(f"n{side}")) for side in "ab")
    edges = checkpointed(edges.where("a <> b").distinct().join(left, "a").join(right, "b").where("na <> nb").select("na", "nb").distinct())
    if edges.isEmpty():
        return rooted
    more = connected_components(edges, "na", "nb").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return checkpointed(rooted.join(more, "root", "left").select("fp", F.coalesce("top", "root").alias("root")))


def grouped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bucket: int = BUCKET, slots: int = 0, like: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(id, h, fp, ...)``, a row for each row of ``docs``, and ``(fp, root)`` for each different ``fp``.

    ``h`` is a hash of the text.  ``root`` is a struct ``(none, id, fp)``: the smallest id of the
    component (``none`` tells that there is no id), and the fingerprint of its row.
    """
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("id"), F.col(text_col).alias("text"))
    own = fingerprints(texts, "id", "text", width, slots, like is not None)
    own = checkpointed(own.select("id.id", "id.h", *own.columns[1:]))
    ids = own.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("f"))
    firsts = checkpointed(ids.select("fp", F.struct("f.none", "f.id", "fp").alias("node")))
    edges, wide = links(firsts.select("fp"), bucket), None
    if slots:
        prints = [f"s{i}" for i in range(slots)]
        more, wide = word_links(own.select("fp", *prints).distinct(), bucket=bucket)
        edges = edges.unionByName(more)
        if wide is not None:
            edges = edges.unionByName(star_links(wide))
    rooted = _rooted(firsts, edges)
    let_go(docs.sparkSession)
    if wide is not None:
        rooted = _joined(rooted, wide_links(wide, rooted, limit=bucket))
    if like is not None:
        # one row stands for each text: that of its smallest id
        ids = own.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("f"))
        ones = own.join(checkpointed(ids), "h").where(F.col("id").eqNullSafe(F.col("f.id")))
        single = checkpointed(ones.select("h", "fp", "id", "keys").dropDuplicates(["h"]))
        for edges in similar(single, texts.select("id.h", "id.id", "text"), lambda: rooted, like):
            rooted = _joined(rooted, edges)
            let_go(docs.sparkSession)
    return own, rooted


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, fingerprint, component_id)``, one row for each row of ``docs``.

    ``fingerprint``: 16 hex digits.  ``component_id``: the smallest id that chains
    of fingerprints at most three bits apart reach, the row's own included.
    Null and blank texts have fingerprint zero, which links like any other; null
    ids keep their row but are no component id unless their whole group has none;
    repeated rows each stay; an empty table gives an empty result; other columns
    are not read.  With the option ``slots`` (word prints of a text), links of
    ``word_links`` count too, and with ``like`` those of ``likeness.similar``.
    """
    own, rooted = grouped(docs, id_col, text_col, **options)
    named = rooted.select("fp", F.col("root.id").alias("component_id"))
    return own.select("id", "fp").join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, like: float | None = LIKE, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of its smallest id.

    Groups are those of ``near_duplicates`` with ``slots`` word prints and with links
    between texts that share ``like`` of their different shingles of five words.
    Where an id repeats with texts of different groups, a row of each stays.  A group
    without any id keeps one row too.  Of rows with the same id and fingerprint, the text
    with the least hash stays, and of rows that repeat it the first in the order of
    their JSON form.
    """
    own, rooted = grouped(docs, id_col, text_col, slots=slots, like=like, **options)
    tops = rooted.where("fp = root.fp").select("fp", F.col("root.id").alias("top"))
    found = own.select("id", "h", "fp").join(tops, "fp").where(F.col("id").eqNullSafe(F.col("top")))
    one = found.groupBy("fp", "id", "h").agg(F.count("*").alias("n")).groupBy("fp", "id").agg(F.min(F.struct("h", "n")).alias("one"))
    one = checkpointed(one.select(F.col("id").alias("__id"), F.col("one.h").alias("__h"), F.col("one.n").alias("__n")))
    same = lambda keys: docs[id_col].eqNullSafe(keys["__id"]) & (F.xxhash64(docs[text_col]) == keys["__h"])
    once = one.where("__n = 1")
    kept = docs.join(once, same(once), "left_semi")
    again = one.where("__n > 1")
    if again.isEmpty():
        return kept
    whole = F.struct(*[docs[c] for c in docs.columns])
    repeated = docs.join(again, same(again), "left_semi").groupBy(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"))
    return kept.unionByName(repeated.agg(F.min_by(whole, F.to_json(whole)).alias("__row")).select("__row.*"))
