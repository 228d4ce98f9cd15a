"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream of its documents in shuffled order, cut into blocks of equal
numbers of words.  The mix is a sequence of slots; slot i maps the point
frac((i + 1) * golden ratio) through the cumulative target weights to a source, so
that every stretch of the mix holds the sources in nearly their target shares.  The
slots of a source are ranked, and slot r takes block r of its stream, which starts
over at its end; the last block is trimmed to the target, and a source that the
sequence left short by a block or two gets its last slots at the end.

Running sums are taken in two steps, over cells that split a source and then within a
cell, so that a source with a third of all rows is never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import checkpointed

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
GOLDEN = (math.sqrt(5) - 1) / 2
#: Words of a block, at any size of corpus.
BLOCK = 512
#: Rows of a cell, on average.
CELL = 1024
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size, mark)`` of each row: its words, and a hash that tells texts apart."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_col).alias("mark"),
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(number, source, source_size, target)``, a row for each source.

    Sources in code-point order, null last, get the weights in turn and share
    ``share`` of all words; no target exceeds ``cap`` times its source, and what is
    cut off is shared again by weight until none does.  That fixes one level L with
    target = min(cap * size, L * weight): sources are capped in the order of size
    over weight, and the level follows from how many are.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row for each source
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("number", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(turn, (F.col("number") % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    upto, beyond = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        (share * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0))).alias("left"),
        F.sum("weight").over(beyond).alias("open"),
    ).withColumn("level", F.col("left") / F.col("open"))
    # the first source, in that order, that the level leaves uncapped sets the level of all that follow
    fits = F.col("level") * F.col("weight") <= cap * F.col("source_size")
    marked = level.withColumn("first", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "number", "level"))).over(everything))
    capped = F.col("first").isNull() | (
        F.struct(F.col("source_size") / F.col("weight"), "number").cast("struct<a:double,b:int>")
        < F.struct(F.col("first.col1"), F.col("first.number")).cast("struct<a:double,b:int>")
    )
    return marked.select(
        "number", "source", "source_size", F.when(capped, cap * F.col("source_size")).otherwise(F.col("first.level") * F.col("weight")).alias("target")
    )


def _running(rows: DataFrame, keys: list[str], cell: str, order: list, value, name: str, depth: int = 1) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before, within ``keys``, by ``cell`` and then ``order``.

    What stands before each cell is summed in the same way, over 1,024 cells at a time.
    """
    cells = rows.groupBy(*keys, cell).agg(F.sum(value).alias("__sum"))
    if depth:
        wide = cells.withColumn("__wide", F.shiftright(cell, 10))
        starts = _running(wide, keys, "__wide", [cell], F.col("__sum"), "__start", depth - 1).select(*keys, cell, "__start")
    else:
        before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        starts = cells.select(*keys, cell, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [*keys, cell])
    return summed.withColumn("__both", F.col("__start") + F.col("__own")).drop("__start", "__own").withColumnRenamed("__both", name)


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """``(slot, number, rank, block, words, pass_)``: which block each slot of the mix takes.

    ``block`` counts within the source's stream and ``pass_`` how often it has
    started over; ``words`` is what the slot takes of the block, less than its
    length only where the source's target is reached.
    """
    spark = sources.sparkSession
    goals = sources.select("number", "source_size", "target", F.round("target").cast("long").alias("goal"))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    spans = goals.where("goal > 0").select("*", blocks.alias("blocks"))
    # one pass has `blocks` slots, the last of them short; the passes before the goal are whole
    passes, rest = F.floor(F.col("goal") / F.col("source_size")), F.col("goal") % F.col("source_size")
    spans = spans.withColumn("needed", (passes * F.col("blocks") + F.ceil(rest / block)).cast("long"))
    by_number = Window.orderBy("number")
    ends = spans.select(
        "number", "source_size", "goal", "blocks", "needed",
        F.sum("needed").over(by_number).alias("high"), (F.sum("needed").over(by_number) - F.col("needed")).alias("low"),
    )
    ends = checkpointed(ends)  # a row for each source
    total = ends.agg(F.sum("needed")).first()[0] or 0
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    slots = spark.range(total).select(F.col("id").alias("slot"), ((point - F.floor(point)) * total).alias("point"))
    # equal cells of the unit interval turn the range join into an equi-join; a cell lists the few sources that touch it
    cells = 1024
    width = max(total / cells, 1e-9)
    touching = ends.select("*", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("cell"))
    placed = slots.withColumn("cell", F.floor(F.col("point") / width)).join(touching, "cell").where("point >= low AND point < high")
    placed = placed.select("slot", "number", (F.col("slot") / (16 * CELL)).cast("long").alias("part"))
    ranked = _running(placed, ["number"], "part", ["slot"], F.lit(1), "rank").drop("part").join(ends, "number")
    kept = ranked.where("rank < needed").select("slot", "number", "rank", "source_size", "goal", "blocks")
    # what the sequence left short goes to the end of the mix
    met = ranked.groupBy("number").agg(F.count("*").alias("met"))
    short = ends.join(met, "number", "left").withColumn("met", F.coalesce("met", F.lit(0))).where("met < needed")
    late = short.select("*", F.explode(F.sequence("met", F.col("needed") - 1)).alias("rank")).select(
        (F.lit(total) + F.col("low") + F.col("rank")).alias("slot"), "number", "rank", "source_size", "goal", "blocks"
    )
    every = kept.unionByName(late)
    number, around = F.col("rank") % F.col("blocks"), F.floor(F.col("rank") / F.col("blocks"))
    begin = around * F.col("source_size") + number * block
    stop = F.least(begin + block, (around + 1) * F.col("source_size"), F.col("goal"))
    return every.select("slot", "number", "rank", number.alias("block"), (stop - begin).alias("words"), around.alias("pass_"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 29,
    block: int = BLOCK,
    marked: bool = False,
) -> DataFrame:
    """``(id_col, size, source_size, target, taken)``, one row for each row of ``docs``.

    ``taken``: the words of the row that the mix takes, repeats counted.  The order
    of a stream follows from a hash of id and text, so reruns agree; rows that
    repeat both stand side by side in it.  A null source is a source of its own;
    null and blank texts have size 0 and nothing is taken of them; ids may be null;
    an empty table gives an empty result; other columns are not read.  ``marked``
    adds ``mark``, a hash of the text, and ``source``.
    """
    sized = checkpointed(sizes(docs, id_col, text_col, source_col))
    rows = sized.count()
    sources = checkpointed(targets(sized, weights, share, cap))
    slots = schedule(sources, block)
    # one entry for each pass, of which there are no more than `cap`, rounded up
    used = slots.groupBy("number", "block").agg(F.collect_list("words").alias("takes"))

    cells = 1 << max(0, math.ceil(math.log2(max(1, rows / CELL))))
    # as many rows as there are sources; small enough to send along wherever it is
    named = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop(sources.source)
    place = F.xxhash64("id", "mark", F.lit(seed))
    streamed = named.withColumn("place", place).withColumn("cell", F.shiftrightunsigned("place", 64 - int(math.log2(cells))) if cells > 1 else F.col("number").cast("long") * 0)
    begun = _running(streamed, ["number"], "cell", ["place", "id", "mark", "size"], F.col("size"), "begin")
    keyed = checkpointed(begun.withColumn("row", F.monotonically_increasing_id()))
    last = F.col("begin") + F.col("size")
    touched = keyed.where("size > 0").select(
        "row", "number", "begin", last.alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((last - 1) / block))).alias("block")
    )
    low, high = F.greatest(F.col("begin") - F.col("block") * block, F.lit(0)), F.least(F.col("end") - F.col("block") * block, F.lit(block))
    overlap = F.aggregate("takes", F.lit(0).cast("long"), lambda acc, t: acc + F.greatest(F.least(high, t) - low, F.lit(0)))
    taken = touched.join(used, ["number", "block"]).groupBy("row").agg(F.sum(overlap).alias("taken"))
    extra = ["mark", "source"] if marked else []
    return keyed.join(taken, "row", "left").select(
        *extra, F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, in whole documents: rows of ``docs``, left out or repeated.

    A row comes as often as ``mix`` takes its words, rounded; rows that repeat each
    other share what is taken of them.  Texts without a word have no part in a mix; null
    ids and sources are values like others; an empty table gives an empty one; other
    columns are handed on.
    """
    found = mix(docs, id_col, text_col, source_col, marked=True, **options)
    copies = (
        found.groupBy("mark", F.col(id_col).alias("__id"), F.col("source").alias("__source"))
        .agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
        .where("size > 0")
        .select(F.col("mark").alias("__mark"), "__id", "__source", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("__copies"))
        .where("__copies > 0")
    )
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    same = (
        (F.xxhash64(docs[text_col]) == copies["__mark"]) & docs[id_col].eqNullSafe(copies["__id"]) & docs[source_col].eqNullSafe(copies["__source"])
    )
    return docs.join(copies, same).select(*[docs[c] for c in docs.columns])
