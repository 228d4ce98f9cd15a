import itertools

import pytest
from pyspark.sql import functions as F

from strandline.operators import breaks, cluster
from strandline.operators import sequence as seq

CASES = [
    ("0000000", 0, 0, 0, 0, 0.0, 0.0, "no_presence"),
    ("0100000", 1, 1, 1, 0, 0.142857, 0.0, "single_phase"),
    ("0110000", 2, 1, 2, 0, 0.285714, 0.0, "continuous_2phase"),
    ("0111100", 4, 1, 4, 0, 0.571429, 0.0, "continuous_3_4phase"),
    ("1111111", 7, 1, 7, 0, 1.0, 0.0, "continuous_5_7phase"),
    ("0101000", 2, 2, 1, 1, 0.210714, 0.5, "intermittent_gap1"),
    ("0110110", 4, 2, 2, 1, 0.448214, 0.25, "intermittent_gap1"),
    ("1100011", 4, 2, 2, 1, 0.439286, 0.5, "intermittent_gap1"),
    ("1010101", 4, 4, 1, 3, 0.382143, 0.5, "intermittent_gap2plus"),
    ("01N1000", None, None, None, None, None, None, None),
]


def frame(spark, patterns):
    rows = [(i, [None if c == "N" else int(c) for c in p]) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "place_id long, states array<int>")


def test_fixtures(spark):
    got = {r.place_id: r for r in seq.metrics(frame(spark, [c[0] for c in CASES])).collect()}
    for i, (_, present, runs, longest, gaps, index, broken, name) in enumerate(CASES):
        r = got[i]
        assert (r.presence_phase_count, r.run_count, r.longest_run_length, r.gap_count, r.sequence_class) == (present, runs, longest, gaps, name)
        assert r.continuity_index == (None if index is None else pytest.approx(index, abs=1e-6))
        assert r.intermittency_index == (None if broken is None else pytest.approx(broken))
    assert got[9].sequence_resolution == "temporally_unresolved" and got[9].unresolved_phase_count == 1 and got[9].confirmed_presence_phase_count == 2


def test_runs_and_gaps_tile_the_span_of_every_pattern(spark):
    patterns = ["".join(p) for p in itertools.product("01", repeat=7)]
    states = frame(spark, patterns)
    runs, gaps = {}, {}
    for r in seq.run_events(states, "place_id").collect():
        runs.setdefault(r.place_id, []).append((r.run_start_order, r.run_end_order))
    for r in seq.gap_events(states, "place_id").collect():
        gaps.setdefault(r.place_id, []).append((r.gap_start_order, r.gap_end_order))
    for i, p in enumerate(patterns):
        ones = {x for a, b in runs.get(i, []) for x in range(a, b + 1)}
        zeros = {x for a, b in gaps.get(i, []) for x in range(a, b + 1)}
        assert ones == {k + 1 for k, c in enumerate(p) if c == "1"}
        assert ones | zeros == (set(range(min(ones), max(ones) + 1)) if ones else set())


def test_null_is_never_zero(spark):
    t = seq.transitions(frame(spark, ["1N01111"]), unresolved=True).collect()
    assert [r.transition for r in sorted(t, key=lambda r: r.phase_pair_order)] == ["temporally_unresolved_transition"] * 2 + ["new"] + ["continue"] * 3
    assert seq.transitions(frame(spark, ["1N01111"])).count() == 4
    assert seq.sequence_string(F.col("states")) is not None


def test_states_from_facts(spark):
    facts = spark.createDataFrame([(1, 1, "F"), (1, 2, "P"), (1, 2, "P"), (1, 3, "P"), (1, 3, "F")], "place_id long, phase_order int, s string")
    got = seq.states(facts, ["place_id"], "phase_order", F.when(F.col("s") != "P", 1)).first()
    assert got.states == [1, None, 1, 0, 0, 0, 0]


def test_breaks(spark):
    rows = [("a", i, f"p{i}", v) for i, v in enumerate([1.0, 1.0, 1.0, 5.0, 5.0, 5.0])] + [("b", i, "x", 2.0) for i in range(5)] + [("c", i, "x", 1.0 * i) for i in range(3)] + [("a", 9, "gone", None)]
    found = breaks.candidates(spark.createDataFrame(rows, "k string, at int, label string, value double"), ["k"])
    best = {r.k: r for r in breaks.best(found, ["k"]).collect()}
    assert set(best) == {"a", "b"}
    assert best["a"].candidate_order == 3 and best["a"].change_score == pytest.approx(1) and (best["a"].left_label, best["a"].right_label) == ("p2", "p3")
    assert best["b"].candidate_order == 2 and best["b"].change_score == 0


def test_clusters(spark):
    import numpy as np

    d = np.array([[0, 1, 5, 6], [1, 0, 5, 6], [5, 5, 0, 2], [6, 6, 2, 0]], float)
    assert cluster.cut(cluster.average_linkage(d), 4, 2).tolist() == [1, 1, 2, 2]
    assert cluster.adjusted_rand(np.array([1, 1, 2, 2]), np.array([2, 2, 1, 1])) == 1
    assert cluster.silhouettes(d, np.array([1, 1, 2, 2])).min() > 0.5
    states = frame(spark, ["1100000", "1110000", "0000011", "0000111", "0000000"])
    labels = {r.sequence: r.cluster_id for r in cluster.sequence_clusters(states).collect()}
    assert labels["1100000"] == labels["1110000"] != labels["0000011"] == labels["0000111"] and "0000000" not in labels
    assert cluster.sequence_clusters(frame(spark, ["0000000"])).collect() == []
