"""What must hold whatever the size of a table: plans that do not take rows of data for a small table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import address, spatial
from strandline.operators import neighbours as nb
from strandline.plans import enrichment, geography, registry
from tests.conftest import SF
from tests.oracle import compare, connection


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_addresses_are_not_broadcast(spark):
    # the file of a million short addresses is small, their beginnings are not
    assert "BuildLeft" not in plan(enrichment.address_cascade(spark, SF))


@pytest.mark.parametrize("few", [0, 50_000])
def test_names_sent_to_all_or_merged(spark, monkeypatch, few):
    monkeypatch.setattr(address, "FEW", few)
    names = spark.createDataFrame([("1", "本町"), ("1", "本町二丁目"), ("1", "本町2丁目"), ("1", "南"), ("2", ""), (None, "西")], "area string, name string")
    aliases = spark.createDataFrame([("1", "旧町", "南"), ("1", "本", "南")], "area string, old_name string, name string")
    rows = [(1, "1", "本町"), (2, "1", "本町 ２丁目"), (3, "1", "本町5"), (4, "1", "旧町9"), (5, "1", "東 南"), (6, "2", None), (7, None, "西"), (8, "1", "本町二丁目"), (9, "1", "本所"), (10, "2", "本町"), (11, "1", "")]
    a = spark.createDataFrame(rows, "address_id int, area string, address string")
    frame = address.cascade(a, names, aliases)
    got = {r.address_id: (r.name, r.method) for r in frame.collect()}
    assert got == {
        1: ("本町", "exact"), 2: ("本町2丁目", "normalised"), 3: ("本町", "partial"), 4: ("南", "alias"), 5: ("南", "dictionary"), 6: ("", "normalised"),
        7: (None, "unresolved"), 8: ("本町二丁目", "exact"), 9: ("南", "alias"), 10: (None, "unresolved"), 11: (None, "unresolved"),
    }
    assert ("BroadcastHashJoin [area" in plan(frame)) == (few > 0)
    assert address.cascade(a, names.limit(0), aliases.limit(0)).where(F.col("method") == "unresolved").count() == len(rows)


def test_checked_addresses_are_not_broadcast(spark):
    frame = enrichment.address_check(spark, SF)
    assert "BuildLeft" not in plan(frame)
    con = connection(SF)
    con.sql(f"CREATE TABLE found AS {registry.ORACLES['address_cascade']}")
    sql = """WITH j AS (SELECT p_partkey AS i, p_type AS own, name FROM part JOIN found ON address_id = p_partkey),
    c AS (SELECT i + 1 AS row_number, CASE WHEN i % 7 = 0 THEN 'InvalidCoordinate' WHEN i % 6 = 0 THEN 'Unresolved' WHEN i % 5 = 0 THEN 'Mismatch' ELSE 'Match' END AS lgc_check,
      CASE WHEN i % 7 = 0 OR i % 6 = 0 THEN 'NotEvaluated' WHEN name IS NULL THEN 'Unresolved' WHEN name = own THEN 'Match' ELSE 'Mismatch' END AS town_check, concat_ws('; ', name, own) AS candidates FROM j)
    SELECT *, CASE WHEN lgc_check = 'InvalidCoordinate' THEN lgc_check WHEN 'Mismatch' IN (lgc_check, town_check) THEN 'Check' ELSE 'Unresolved' END AS overall FROM c WHERE lgc_check <> 'Match' OR town_check <> 'Match'"""
    assert compare(frame, con, sql) is None


def test_a_band_needs_no_table_of_pairs(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a band can hold most pairs")

    monkeypatch.setattr(nb, "within", never)
    assert compare(geography.moran_distance_band(spark, SF), connection(SF), registry.ORACLES["moran_distance_band"]) is None


def test_strip_sums_are_exact(monkeypatch):
    rng = np.random.default_rng(5)
    grid = np.array([(i / 4, j / 4) for i in range(12) for j in range(12)])  # many distances are the band itself
    clouds = [rng.normal(0, 1, (400, 2)), np.round(rng.normal(0, 1, (300, 2)), 1), grid, np.vstack([rng.normal(0, 1e-3, (200, 2)), rng.uniform(-500, 500, (200, 2))]), np.stack([rng.uniform(0, 5, 200), np.zeros(200)], axis=1), grid * 1e6 + 1e9]
    for pairs in (1 << 20, 7):
        monkeypatch.setattr(nb, "PAIRS", pairs)
        for xy in clouds:
            columns = np.stack([np.ones(len(xy)), rng.normal(0, 1, len(xy))], axis=1)
            for band in (0.25, 1.0, 3.0, 1000.0, 250_000.0):
                d = xy[None, :, :] - xy[:, None, :]
                inside = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1]) <= band
                got = nb._strip_sums(xy, xy, columns, band)
                assert (got[:, 0] == inside.sum(axis=1)).all() and np.allclose(got[:, 1], inside @ columns[:, 1], atol=1e-9)
    assert nb._strip_sums(grid, grid[:0], np.ones((0, 1)), 1.0).tolist() == [[0.0]] * len(grid)


def test_band_moran_is_that_of_the_edges(spark, monkeypatch):
    monkeypatch.setattr(nb, "WANTED", 20)
    monkeypatch.setattr(nb, "ASKED", 30)
    monkeypatch.setattr(nb, "MET", 40)
    rng = random.Random(6)
    rows = [(i, rng.choice([rng.gauss(0, 0.3), rng.uniform(-9, 9)]), rng.uniform(-1, 1)) for i in range(300)]
    rows += [(300 + i, 0.5, 0.25 * (i % 3)) for i in range(60)] + [(400, 99.0, 0.0), (401, None, 0.0), (402, float("nan"), 0.0), (403, float("inf"), 0.0)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double")
    values = [("a", i, rng.gauss(0, 2)) for i, _, _ in rows] + [("b", i, float(i % 5)) for i, _, _ in rows if i % 3] + [("a1", i, 1.0) for i, _, _ in rows] + [("far", i, i / 2) for i in (0, 400, 401, 402, 403)] + [("b", 900, 2.0), ("b", 901, None)]
    values = spark.createDataFrame(values, "model_id string, id long, x double")
    pairs = nb.within(points.where("point_id <> 403"), 0.25)  # which takes no infinite coordinate
    edges = pairs.crossJoin(spark.createDataFrame([(m,) for m in ("a", "b", "a1", "far")], "model_id string"))
    want = {r.model_id: r for r in spatial.global_moran(edges, values).collect()}
    got = {r.model_id: r for r in spatial.band_moran(points, values, 0.25).collect()}
    assert set(got) == set(want) and got["far"].moran_i is None and got["a1"].moran_i is None
    for m, r in want.items():
        assert got[m].n_points == r.n_points
        for c in ("moran_i", "expectation", "variance", "statistic", "p_value"):
            assert got[m][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-9)), (m, c)
    none = spatial.band_moran(points.limit(0), values, 0.25).collect()
    assert len(none) == 4 and all(r.moran_i is None for r in none)
