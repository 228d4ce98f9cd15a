"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken, 2003).

Every k-gram of code points gets a rolling hash; of each window of ``WINDOW``
consecutive hashes the smallest is chosen, the rightmost on ties, and kept with its
position.  Two texts that share a passage of ``K + WINDOW - 1`` code points share a
chosen hash.  A text with fewer than K code points is one gram; one with fewer than
WINDOW grams is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.llm.common import sliced

K, WINDOW = 16, 16
#: Rows of a block of consecutive ids, and the most blocks (beyond it blocks grow; they are streamed).
ROWS, BLOCKS = 1024, 10_000
#: Grams hashed at a time; positions within one run must fit the low bits of a key.
RUN = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_HIGH = np.uint64(24)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k-gram, by doubling: a 2n-gram is two n-grams side by side."""
    with np.errstate(over="ignore"):
        whole, base, have = None, np.uint64(1), 0
        power, step, size = points.astype(np.uint64) + np.uint64(1), _BASE, 1
        while True:
            if k & size:
                n = len(points) - have - size + 1
                whole = power[: len(points) - size + 1] if whole is None else whole[:n] * step + power[have : have + n]
                have += size
            size *= 2
            if size > k:
                break
            half = size // 2
            power = power[:-half] * step + power[half:]
            step = step * step
        whole = whole ^ (whole >> np.uint64(31))
        whole = whole * np.uint64(0xBF58476D1CE4E5B9)
        return whole ^ (whole >> np.uint64(29))


def _slide_min(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum over every run of ``window`` keys, by doubling."""
    have = 1
    while have * 2 <= window:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    rest = window - have
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen 40-bit hashes and their positions (code points from 0), in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(points):
        return none
    k = min(k, len(points))
    grams = len(points) - k + 1
    window = min(window, grams)
    found: list[np.ndarray] = []
    places: list[np.ndarray] = []
    for at in range(0, grams - window + 1, RUN):
        stop = min(grams, at + RUN + window - 1)
        hashes = _gram_hashes(points[at : stop + k - 1], k)
        keys = (hashes >> _HIGH << _HIGH) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
        chosen = _slide_min(keys, window)
        chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
        found.append(chosen >> _HIGH)
        places.append((_LOW - (chosen & _LOW)).astype(np.int64) + at)
    hashes, positions = np.concatenate(found), np.concatenate(places)
    first = np.concatenate([[True], positions[1:] != positions[:-1]])  # a run's last choice may be the next run's first
    return hashes[first], positions[first]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the different chosen hashes that both have (Jaccard); 1 for two empty texts."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def digest(hashes: np.ndarray) -> str:
    """The chosen hashes in order, ten hex digits each; empty for an empty text."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``(id_col, hashes, positions)``: the winnowed fingerprint of each text, a row for each row of ``docs``.

    Null and empty texts have none; ids may be null or repeat; an empty table gives an
    empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = [winnow(t or "", k, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: batch.column(0),
                    "hashes": pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                    "positions": pa.array([p for _, p in found], pa.list_(pa.int64())),
                }
            )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, hashes array<long>, positions array<long>"
    )


def _order(ids: pa.Array) -> np.ndarray:
    """Ids as integers to sort by; null comes first."""
    return pc.fill_null(ids.cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)


def _blocks(place: np.ndarray, mark: np.ndarray, bounds: np.ndarray, inner: dict[int, np.ndarray]) -> np.ndarray:
    """Block of each row: how many (place, mark) bounds it reaches; ``inner`` has the marks that split one place."""
    found = np.searchsorted(bounds, place, side="right")
    for value, marks in inner.items():
        own, above = place == value, place > value
        found[own] += np.searchsorted(marks, mark[own], side="right")
        found[above] += len(marks)
    return found


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_block: int = ROWS, most: int = BLOCKS) -> DataFrame:
    """Rows ``(block, ends, place, mark, id, text)`` such that each block holds consecutive ids.

    ``place`` and ``mark`` (a hash of the text) order a block; the first row of a block is
    copied, with ``ends`` true, into the block before it, whose last row it follows.  The
    first block follows the last.  Block bounds are quantiles of the ids (at most ``most``
    numbers), and equal shares of the hashes where an id, or null, repeats more often than
    a block has rows; a text is shuffled once, but for those copies.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark"), F.coalesce(text_col, F.lit("")).alias("text"))
    ids = rows.select(F.col("id").cast("long").alias("id"), "mark")
    total = ids.count()
    count = min(most, max(1, total // rows_per_block))
    size = max(rows_per_block, total // most)
    cuts = ids.approxQuantile("id", [i / count for i in range(1, count)], 0.1 / count) if count > 1 else []
    bounds = np.array(sorted({int(c) for c in cuts}), np.int64)
    often = ids.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * size).collect()  # fewer than there are blocks
    inner = {}
    for value, n in often:
        shares = n // size
        inner[-(1 << 63) if value is None else value] = np.array([-(1 << 63) + (i << 64) // shares for i in range(1, shares)], np.int64)

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, mark = _order(batch.column(0)), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_pydict({"block": _blocks(place, mark, bounds, inner), "place": place, "mark": mark})

    heads = ids.mapInArrow(block_of, "block long, place long, mark long").groupBy("block").agg(F.min(F.struct("place", "mark")).alias("head"))
    firsts = sorted((r["block"], r["head"]["place"], r["head"]["mark"]) for r in heads.collect())  # a row for each block
    before = {(place, mark): firsts[i - 1][0] for i, (_, place, mark) in enumerate(firsts)}
    starts = np.array(sorted({place for place, _ in before}), np.int64)
    kind = rows.schema["id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            place, mark = _order(batch.column(0)), batch.column(1).to_numpy()
            again = [i for i in np.nonzero(np.isin(place, starts))[0].tolist() if (int(place[i]), int(mark[i])) in before]
            take = np.concatenate([np.arange(len(place)), np.array(again, np.int64)])
            copies = np.array([before[int(place[i]), int(mark[i])] for i in again], np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": np.concatenate([_blocks(place, mark, bounds, inner), copies]),
                    "ends": np.arange(len(take)) >= len(place),
                    "place": place[take],
                    "mark": mark[take],
                    "id": batch.column(0).take(pa.array(take)),
                    "text": batch.column(2).take(pa.array(take)),
                }
            )

    return rows.mapInArrow(deal, f"block long, ends boolean, place long, mark long, id {kind}, text string")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compare_edited(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, rows_per_block: int = ROWS
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Returns ``(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, positions)``, one row for each row of ``docs``; ``positions``
    are those of the fingerprint's hashes, in code points from 0.  The next document
    is the next by integer id, null ids first and repeated ids by a hash of the text; the
    first follows the last, so a lone document follows itself.  Null texts are empty: an
    empty fingerprint, alike only to another empty one.  An empty table gives an
    empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = with_next(docs, id_col, text_col, rows_per_block).repartition("block")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in sliced(batches, "text"):
            out: list[tuple] = []
            columns = (batch.column(n).to_pylist() for n in ("block", "ends", "id", "text"))
            for block, ends, own_id, text in zip(*columns, strict=True):
                if ends and (last is None or last[0] != block):
                    continue  # a further copy of a repeated first row
                own, places = winnow(text, k, window)
                if last and last[0] == block:
                    _, before_id, before, hashes, positions = last
                    changed = edited(before, text)
                    others = winnow(changed, k, window)[0]
                    sha = hashlib.sha256(changed.encode()).hexdigest()
                    near = likeness(hashes, others), likeness(hashes, own)
                    out.append((before_id, len(before), sha, digest(hashes), digest(others), *near, positions))
                last = None if ends else (block, own_id, text, own, places)
            if out:
                kinds = [pa_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    pa_kind = to_arrow_type(docs.schema[id_col].dataType)
    return dealt.sortWithinPartitions("block", "ends", "place", "mark", "text").mapInArrow(
        run,
        f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, positions array<long>",
    )
