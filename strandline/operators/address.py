"""Resolution of addresses against dictionaries of place names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.codes import digits_of_kanji, narrow

#: Most names that are sent to all executors.
FEW = 50_000


def normalised(text: Column) -> Column:
    """An address for comparison: ASCII digits and signs, kanji digits read one by one, no blanks."""
    return F.regexp_replace(digits_of_kanji(narrow(F.coalesce(text, F.lit("")))), r"\s+", "")


def _placed(names: DataFrame, n: int) -> DataFrame:
    """``names``, ``n`` in all, for a join with addresses: sent to all if few, else sorted and merged.

    Spark guesses sizes from those of files, by which it takes millions of short
    addresses for a table to broadcast; so it is told.
    """
    return F.broadcast(names) if n <= FEW else names.hint("merge")


def longest_matches(addresses: DataFrame, names: DataFrame, most: int = 200_000) -> DataFrame:
    """``(address_id, name, start)``: names found in an address, longer ones first, none overlapping another.

    ``addresses`` has ``(address_id, area, address)``, ``names`` has ``(area, name)``.
    A name is looked for once in an address, at its first free place.  Each address
    meets the names of its own area only, gathered into one array, of which there
    are as many as an area has names (checked against ``most``).
    """
    lists = names.where(F.col("name") != "").groupBy("area").agg(F.sort_array(F.collect_set(F.struct((-F.length("name")).alias("n"), "name"))).alias("names"))
    told = lists.agg(F.max(F.size("names")).alias("widest"), F.sum(F.size("names")).alias("n")).first()
    if (told["widest"] or 0) > most:
        raise ValueError(f"an area has {told['widest']} names; {most} at most")
    joined = addresses.join(_placed(lists, told["n"] or 0), "area", "left").select("address_id", F.coalesce("address", F.lit("")).alias("address"), F.transform("names", lambda x: x["name"]).alias("names"))
    kind = addresses.schema["address_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, (text, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                taken: list[tuple[int, int]] = []
                for name in own or ():
                    at = text.find(name)
                    while at >= 0 and any(at < b and a < at + len(name) for a, b in taken):
                        at = text.find(name, at + 1)
                    if at >= 0:
                        taken.append((at, at + len(name)))
                        rows.append((row, name, at))
            if rows:
                place, name, start = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"address_id": batch.column(0).take(pa.array(place)), "name": pa.array(name), "start": pa.array(start, pa.int32())})

    return joined.mapInArrow(run, f"address_id {kind}, name string, start int")


def cascade(addresses: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(address_id, name, method)``: the first method that resolves an address, methods in order.

    exact, normalised, partial (the address begins with the name), alias (it begins
    with an old name of a current one), dictionary (longest match anywhere), else
    unresolved.  Cheap methods are equality joins, and only what they leave open
    goes on to the dictionary.  Of several names the longest, then the first, wins.
    """
    body = addresses.withColumn("__n", normalised(F.col("address")))
    named = names.withColumn("__n", normalised(F.col("name"))).distinct()
    old = aliases.select("area", normalised(F.col("old_name")).alias("__n"), F.col("name"))
    entries = named.select("area", "__n", "name", F.lit(False).alias("old")).unionByName(old.withColumn("old", F.lit(True)))
    # beginnings of an address (as long as some entry, up to the whole) meet entries by equality
    told = entries.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("__n"))).alias("lengths")).first()
    size = F.length("__n")
    lengths = F.filter(F.array(*map(F.lit, told["lengths"])).cast("array<int>"), lambda i: (i <= size) & ((i > 0) | (size == 0)))
    begun = body.select("address_id", "area", "address", "__n", F.explode(lengths).alias("i")).select(
        "address_id", "area", F.substring("__n", F.lit(1), F.col("i")).alias("__n"), (F.col("i") == size).alias("whole"), F.when(F.col("i") == size, F.col("address")).alias("address")
    )
    method = F.when(F.col("old"), 4).when(F.col("address") == F.col("name"), 1).when(F.col("whole"), 2).otherwise(3)
    best = F.min(F.struct("m", (-F.length("name")).alias("n"), "name")).alias("b")
    early = begun.join(_placed(entries, told["n"]), ["area", "__n"]).select("address_id", "name", method.alias("m")).groupBy("address_id").agg(best)
    left = body.join(early, "address_id", "left_anti").select("address_id", "area", F.col("__n").alias("address"))
    late = longest_matches(left, named.select("area", F.col("__n").alias("name"))).select("address_id", "name", F.lit(5).alias("m")).groupBy("address_id").agg(best)
    found = early.unionByName(late).select("address_id", "b.name", "b.m")
    methods = F.array(*map(F.lit, ("exact", "normalised", "partial", "alias", "dictionary")))
    return addresses.select("address_id").join(found, "address_id", "left").select("address_id", "name", F.when(F.col("m").isNull(), "unresolved").otherwise(F.element_at(methods, F.coalesce("m", F.lit(1)))).alias("method"))


def lgc_check(coordinate_ok: Column, areas: Column, own: Column) -> Column:
    """Whether the areas at a point include the one on record."""
    return F.when(~coordinate_ok, "InvalidCoordinate").when(F.size(areas) == 0, "Unresolved").when(F.array_contains(areas, own), "Match").otherwise("Mismatch")


def town_check(coordinate_ok: Column, areas: Column, town: Column, towns: Column) -> Column:
    """Whether the resolved town is among those at the point."""
    return F.when(~coordinate_ok | (F.size(areas) == 0), "NotEvaluated").when(town.isNull(), "Unresolved").when(F.array_contains(towns, town), "Match").otherwise("Mismatch")


def overall_check(lgc: Column, town: Column) -> Column:
    return (
        F.when(lgc == "InvalidCoordinate", "InvalidCoordinate").when((lgc == "Match") & (town == "Match"), "OK").when((lgc == "Mismatch") | (town == "Mismatch"), "Check").otherwise("Unresolved")
    )


def overlap_gate(records: DataFrame, boundaries: DataFrame, key: str, least: float = 0.5) -> float:
    """Share of the records' different keys that the boundaries have; raises below ``least``."""
    own = records.select(key).where(F.col(key).isNotNull()).distinct()
    row = own.join(boundaries.select(key, F.lit(1).alias("__hit")).distinct(), key, "left").agg(F.count("*").alias("n"), F.count("__hit").alias("hit")).first()
    share = row["hit"] / row["n"] if row["n"] else 0.0
    if share < least:
        raise ValueError(f"only {share:.0%} of the keys have a boundary")
    return share


def area_code(frame: DataFrame) -> DataFrame:
    """``frame`` with ``lgc``: from LGC, else the first five of KEY_CODE, else PREF and CITY, else JCODE; raises if none of these columns exists."""
    has = set(frame.columns)
    options = []
    if "LGC" in has:
        options.append(F.nullif(F.trim(F.col("LGC").cast("string")), F.lit("")))
    if "KEY_CODE" in has:
        options.append(F.nullif(F.substring(F.trim(F.col("KEY_CODE").cast("string")), 1, 5), F.lit("")))
    if {"PREF", "CITY"} <= has:
        options.append(F.concat(F.lpad(F.col("PREF").cast("string"), 2, "0"), F.lpad(F.col("CITY").cast("string"), 3, "0")))
    if "JCODE" in has:
        options.append(F.nullif(F.trim(F.col("JCODE").cast("string")), F.lit("")))
    if not options:
        raise ValueError("no column to take an area code from")
    return frame.withColumn("lgc", F.coalesce(*options))
