"""Presence sequences: states of a place over an ordered, short list of phases.

The states of a place are one array column, so that runs, gaps, indices and
transitions are expressions on a row: one aggregation builds the array, and nothing
else is shuffled.  A state is 1 (present), 0 (apparently absent) or null (unresolved);
null is never taken for 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.numeric import clamp01

#: Phases in order, and the weight sets of the continuity index (fixed values).
PHASES = ("Pa", "Jo", "Ya", "Ko", "Na", "He", "Me")
WEIGHT_SETS = (
    ("baseline", 0.35, 0.40, 0.25),
    ("balanced", 1 / 3, 1 / 3, 1 / 3),
    ("coverage_heavy", 0.50, 0.30, 0.20),
    ("run_heavy", 0.25, 0.55, 0.20),
    ("gap_span_heavy", 0.30, 0.30, 0.40),
)
CLASSES = ("no_presence", "single_phase", "continuous_2phase", "continuous_3_4phase", "continuous_5_7phase", "intermittent_gap1", "intermittent_gap2plus")


def states(facts: DataFrame, keys: list[str], phase_order: str, state: Column, n: int = len(PHASES)) -> DataFrame:
    """``(*keys, states)`` from facts with a phase order from 1 to ``n``.

    ``state`` is the state that a fact speaks for, 1, 0 or null; the largest of a
    phase counts, and null where all are null.  Phases without facts give 0.
    One aggregation, combined on the map side.
    """
    here = lambda i, v: F.max(F.when(F.col(phase_order) == i, v))
    cells = facts.groupBy(*keys).agg(*[here(i, F.lit(1)).alias(f"__seen{i}") for i in range(1, n + 1)], *[here(i, state).alias(f"__state{i}") for i in range(1, n + 1)])
    return cells.select(*keys, F.array(*[F.when(F.col(f"__seen{i}") == 1, F.col(f"__state{i}").cast("int")).otherwise(0) for i in range(1, n + 1)]).alias("states"))


def flag_states(facts: DataFrame, keys: list[str], phase_order: str, flag: Column, n: int = len(PHASES)) -> DataFrame:
    """``(*keys, states)`` of plain 0/1 presence: 1 where any fact of the phase has ``flag``.  One aggregation."""
    cells = facts.groupBy(*keys).agg(*[F.max(F.when((F.col(phase_order) == i) & flag, 1).otherwise(0)).alias(f"__{i}") for i in range(1, n + 1)])
    return cells.select(*keys, F.array(*[F.col(f"__{i}") for i in range(1, n + 1)]).alias("states"))


def complete(dimension: DataFrame, found: DataFrame, key: str, n: int = len(PHASES)) -> DataFrame:
    """Every row of ``dimension`` with its states; all absent where there are none."""
    absent = F.array(*[F.lit(0)] * n)
    return dimension.join(found, key, "left").withColumn("states", F.coalesce("states", absent))


def long(frame: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """One row for each phase: ``phase_order``, ``phase_code``, ``presence`` in place of ``states``."""
    names = F.array(*map(F.lit, phases))
    kept = [c for c in frame.columns if c != "states"]
    found = frame.select(*kept, F.posexplode("states").alias("__at", "presence"))
    return found.select(*kept, (F.col("__at") + 1).alias("phase_order"), F.element_at(names, F.col("__at") + 1).alias("phase_code"), "presence")


def sequence_string(s: Column) -> Column:
    """States as a string such as ``0110000``; ``N`` stands for null."""
    return F.array_join(F.transform(s, lambda x: F.coalesce(x.cast("string"), F.lit("N"))), "")


def phase_list(s: Column, phases: tuple[str, ...] = PHASES) -> Column:
    """Codes of the phases present, joined by ``-``; ``none`` without any."""
    names = F.filter(F.transform(s, lambda x, i: F.when(x == 1, F.element_at(F.array(*map(F.lit, phases)), i + 1))), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.array_join(names, "-")).otherwise("none")


def _ones(s: Column) -> Column:
    return F.filter(F.transform(s, lambda x, i: F.when(x == 1, i + 1)), lambda x: x.isNotNull())


def runs(s: Column) -> Column:
    """Array of (start, end) of the maximal stretches of 1, positions from 1."""
    at = lambda i: F.coalesce(F.get(s, i), F.lit(0))
    starts = F.filter(_ones(s), lambda p: at(p - 2) != 1)
    ends = F.filter(_ones(s), lambda p: at(p) != 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def gaps(run: Column) -> Column:
    """Array of (start, end) between consecutive ``runs``."""
    n = F.size(run)
    before, after = F.slice(run, 1, F.greatest(n - 1, F.lit(0))), F.slice(run, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(before, after, lambda a, b: F.struct((a["end"] + 1).alias("start"), (b["start"] - 1).alias("end")))


def _length(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["end"] - p["start"] + 1)


def _mean(lengths: Column) -> Column:
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(lengths) > 0, total / F.size(lengths)).otherwise(0.0)


def metrics(frame: DataFrame, n: int = len(PHASES)) -> DataFrame:
    """``frame`` with the run, gap, span and index columns of its ``states``.

    A series with an unresolved phase has ``sequence_resolution``
    ``temporally_unresolved`` and null in all metrics but the counts of
    unresolved and confirmed phases.
    """
    s = F.col("states")
    with_runs = frame.withColumn("__runs", runs(s)).withColumn("__gaps", gaps(F.col("__runs")))
    run_lengths, gap_lengths = _length(F.col("__runs")), _length(F.col("__gaps"))
    count = lambda test: F.size(F.filter(s, test))
    unresolved, present = count(lambda x: x.isNull()), count(lambda x: x == 1)
    known = unresolved == 0
    only = lambda c: F.when(known, c)
    first, last = F.array_min(_ones(s)), F.array_max(_ones(s))
    span = F.coalesce(last - first + 1, F.lit(0))
    gap_phases = F.aggregate(gap_lengths, F.lit(0), lambda a, x: a + x)
    longest = F.coalesce(F.array_max(run_lengths), F.lit(0))
    penalty = F.when(span > 1, gap_phases / (span - 1)).otherwise(0.0)
    gap_free = span / n * (1 - clamp01(penalty))
    gap_count = F.size("__gaps")
    code = (
        F.when(present == 0, 0).when(present == 1, 1).when((gap_count == 0) & (longest == 2), 2).when((gap_count == 0) & longest.between(3, 4), 3)
        .when((gap_count == 0) & (longest >= 5), 4).when(gap_count == 1, 5).when(gap_count >= 2, 6)
    )
    return with_runs.select(
        *frame.columns,
        F.when(known, "resolved").otherwise("temporally_unresolved").alias("sequence_resolution"),
        unresolved.alias("unresolved_phase_count"),
        present.alias("confirmed_presence_phase_count"),
        only(present).alias("presence_phase_count"),
        only(first).alias("first_presence_order"),
        only(last).alias("last_presence_order"),
        only(span).alias("observed_span_phase_count"),
        only(F.size("__runs")).alias("run_count"),
        only(longest).alias("longest_run_length"),
        only(_mean(run_lengths)).alias("mean_run_length"),
        only(gap_count).alias("gap_count"),
        only(gap_phases).alias("gap_phase_count"),
        only(F.coalesce(F.array_max(gap_lengths), F.lit(0))).alias("max_gap_length"),
        only(_mean(gap_lengths)).alias("mean_gap_length"),
        only(F.when(span > 0, present / span).otherwise(0.0)).alias("presence_density_in_span"),
        only(penalty).alias("gap_penalty"),
        only(gap_free).alias("gap_free_span_component"),
        only(F.when(present <= 1, 0.0).otherwise(clamp01(penalty))).alias("intermittency_index"),
        only(code).alias("sequence_class_code"),
    ).withColumns({"sequence_class": F.when(F.col("sequence_class_code").isNotNull(), F.element_at(F.array(*map(F.lit, CLASSES)), F.coalesce("sequence_class_code", F.lit(0)) + 1)), "continuity_index": continuity(*WEIGHT_SETS[0][1:], n)})


def continuity(w_presence, w_run, w_gap, n: int = len(PHASES)) -> Column:
    """Continuity index of a row with ``metrics``: 0 without presence, null if unresolved."""
    parts = w_presence * F.col("presence_phase_count") / n + w_run * F.col("longest_run_length") / n + w_gap * F.col("gap_free_span_component")
    return F.when(F.col("presence_phase_count") == 0, 0.0).otherwise(clamp01(parts))


def run_events(frame: DataFrame, key: str, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """One row for each run: ids ``<place>_R<i>``, orders, phase codes, length."""
    name = lambda i: F.element_at(F.array(*map(F.lit, phases)), i)
    found = frame.select(key, F.posexplode(runs(F.col("states"))).alias("__i", "r"))
    return found.select(
        key, F.concat(F.col(key).cast("string"), F.lit("_R"), F.col("__i") + 1).alias("run_id"), (F.col("__i") + 1).alias("run_number"),
        F.col("r.start").alias("run_start_order"), F.col("r.end").alias("run_end_order"), name(F.col("r.start")).alias("run_start_phase"),
        name(F.col("r.end")).alias("run_end_phase"), (F.col("r.end") - F.col("r.start") + 1).alias("run_length"),
    )


def gap_events(frame: DataFrame, key: str, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """One row for each gap between runs: ids ``<place>_G<i>``, orders, phase codes, the runs on both sides."""
    name = lambda i: F.element_at(F.array(*map(F.lit, phases)), i)
    found = frame.select(key, F.posexplode(gaps(runs(F.col("states")))).alias("__i", "g"))
    return found.select(
        key, F.concat(F.col(key).cast("string"), F.lit("_G"), F.col("__i") + 1).alias("gap_id"), (F.col("__i") + 1).alias("gap_number"),
        F.col("g.start").alias("gap_start_order"), F.col("g.end").alias("gap_end_order"), name(F.col("g.start")).alias("gap_start_phase"),
        name(F.col("g.end")).alias("gap_end_phase"), (F.col("g.end") - F.col("g.start") + 1).alias("gap_length"),
        (F.col("__i") + 1).alias("from_run"), (F.col("__i") + 2).alias("to_run"),
    )


def transitions(frame: DataFrame, phases: tuple[str, ...] = PHASES, unresolved: bool = False) -> DataFrame:
    """One row for each pair of neighbouring phases, with its type; ``states`` is dropped.

    continue 1-1, drop 1-0, new 0-1, apparent_absence_continue 0-0; a null on either
    side gives ``temporally_unresolved_transition`` (or no row, unless ``unresolved``).
    """
    kept = [c for c in frame.columns if c != "states"]
    s, n = F.col("states"), len(phases)
    pairs = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.struct(i.alias("at"), F.element_at(s, i).alias("a"), F.element_at(s, i + 1).alias("b")))
    name = lambda i: F.element_at(F.array(*map(F.lit, phases)), i)
    rows = frame.select(*kept, F.explode(pairs).alias("t"))
    a, b = F.col("t.a"), F.col("t.b")
    kind = (
        F.when(a.isNull() | b.isNull(), "temporally_unresolved_transition").when((a == 1) & (b == 1), "continue")
        .when((a == 1) & (b == 0), "drop").when((a == 0) & (b == 1), "new").otherwise("apparent_absence_continue")
    )
    out = rows.select(
        *kept, F.col("t.at").alias("phase_pair_order"), F.concat(name(F.col("t.at")), F.lit("->"), name(F.col("t.at") + 1)).alias("phase_pair"),
        a.alias("from_state"), b.alias("to_state"), kind.alias("transition"),
    )
    return out if unresolved else out.where(F.col("transition") != "temporally_unresolved_transition")
