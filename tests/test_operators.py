import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import codes, numeric, stats, text, tiles
from strandline.functions import flags as fl
from strandline.operators import address, compose, enrich, pattern, recover, select, spatial, tally
from strandline.operators import neighbours as nb
from strandline.operators.components import connected_components


def test_two_kinds_of_division(spark):
    f = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (1.0, None)], "a double, b double")
    rows = f.select(numeric.share("a", "b").alias("s"), numeric.ratio("a", "b").alias("r")).collect()
    assert [r.s for r in rows] == [0.5, None, None, None] and [r.r for r in rows] == [0.5, None, -0.5, None]


def test_numbers(spark):
    f = spark.createDataFrame([("about 1,200 m",), ("-3.5e2x",), ("none",), (None,)], "t string")
    assert [r[0] for r in f.select(numeric.number_in("t")).collect()] == [1200.0, -350.0, None, None]
    z = spark.createDataFrame([(0.0,), (1.96,), (-1.0,)], "z double").select(numeric.normal_upper("z")).collect()
    assert [r[0] for r in z] == pytest.approx([0.5, 0.0249979, 0.8413447], abs=1e-6)


def test_bh_ignores_nulls_and_takes_ties(spark):
    p = [0.01, 0.04, 0.03, None, 0.04, 0.9]
    got = {r.i: r.q for r in spark.createDataFrame(list(enumerate(p)), "i int, p double").select("i", stats.bh("p").alias("q")).collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    low, want = 1.0, {3: None}
    for rank in range(len(known), 0, -1):
        v, i = known[rank - 1]
        low = min(low, v * len(known) / rank)
        want[i] = low
    assert got == {i: None if v is None else pytest.approx(v) for i, v in want.items()}
    large = stats.with_bh(spark.createDataFrame([(*r, "g") for r in enumerate(p)], "i int, p double, g string"), "p", "q", "g").collect()
    assert {r.i: r.q for r in large} == got


def test_flags(spark):
    f = spark.createDataFrame([("縄文・弥生",), ("奈良",), ("  ",), (None,), ("貝塚 不明",)], "Chronology string")
    rows = fl.with_period_flags(f, "Chronology").collect()
    named = [{k for k, v in r.asDict().items() if v == 1} for r in rows]
    assert named == [{"Jo", "Ya"}, {"An", "Na"}, {"Un"}, {"Un"}, {"Un"}]
    assert list(rows[0].asDict())[1:] == list(fl.FLAG_WORDS)


def test_coordinates_and_tri_state(spark):
    f = spark.createDataFrame([("139", "35"), ("", " "), (None, "35"), ("139", None), ("x", "35"), ("nan", "1"), ("181", "0")], "a string, b string")
    got = [r[0] for r in f.select(fl.coordinate_status(F.col("a"), F.col("b"))).collect()]
    assert got == ["valid", "missing_both", "missing_lon", "missing_lat", "non_numeric", "non_numeric", "out_of_range"]
    t = spark.createDataFrame([("2",), ("0",), ("-1",), ("",), ("NA",), (None,)], "t string")
    assert [r[0] for r in t.select(fl.tri_state(F.col("t"))).collect()] == [1, 0, 0, None, None, None]


def test_codes(spark):
    f = spark.createDataFrame([("13101.0",), (" 123 ",), (None,), ("a.0",)], "c string")
    assert [r[0] for r in f.select(codes.plain_code(F.col("c"), 5)).collect()] == ["13101", "00123", "", "a"]
    s = spark.createDataFrame([("12-3",), ("２－１０",), ("2-9",), ("x",), (None,), ("12",)], "s string")
    assert [r.s for r in s.orderBy(*codes.site_sort_key(F.col("s"))).collect()] == ["2-9", "２－１０", "12", "12-3", None, "x"]
    n = spark.createDataFrame([("ｶﾞ①",), ("plain",), (None,)], "s string").select(codes.nfkc_where_needed(F.col("s")).alias("n")).collect()
    assert [r.n for r in n] == ["ガ1", "plain", None]
    c = spark.createDataFrame([("a", "b"), ("a", None), ("a", " ")], "x string, y string").select(codes.composite("K_", F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in c] == ["K_a_b", None, None]


def test_tokens(spark):
    rows = ["集落（町屋・道路跡）・古墳?", "a/b,c b", None, "x(y(z,w),v),u", "一　二", "（開"]
    f = spark.createDataFrame([(r,) for r in rows], "t string")
    nested = [r[0] for r in f.select(text.tokens_nested(F.col("t"))).collect()]
    assert nested == [["集落(町屋・道路跡)", "古墳"], ["a", "b", "c"], [], ["x(y(z,w),v)", "u"], ["一", "二"], ["(開"]]
    flat = [r[0] for r in f.select(text.tokens_flat(F.col("t"))).collect()]
    assert flat[:3] == nested[:3] and flat[4] == nested[4]
    seg = spark.createDataFrame([("[縄文] 住居 [古墳]円墳",), ("no tag",), (None,), ("[a]",)], "t string").select(text.tagged_segments(F.col("t")).alias("s")).collect()
    assert [[(s.tag, s.body) for s in r.s] for r in seg] == [[("縄文", "住居"), ("古墳", "円墳")], [], [], [("a", "")]]


def test_tiles_and_plane(spark):
    f = spark.createDataFrame([(139.767125, 35.681236), (-180.0, 89.9), (180.0, -89.9)], "lon double, lat double")
    x, y = tiles.tile(F.col("lon"), F.col("lat"), 14)
    assert [tuple(r) for r in f.select(x, y).collect()] == [(14552, 6451), (0, 0), (16383, 16383)]
    e, n = tiles.transverse_mercator(F.col("lon"), F.col("lat"))
    first = f.limit(1).select(e.alias("e"), n.alias("n"), tiles.mesh100(F.col("lon"), F.col("lat")).alias("m")).first()
    origin = spark.createDataFrame([(139 + 50 / 60, 36.0)], "lon double, lat double").select(*tiles.transverse_mercator(F.col("lon"), F.col("lat"))).first()
    assert origin[0] == pytest.approx(0, abs=1e-6) and origin[1] == pytest.approx(0, abs=1e-6)
    # scale on the meridian of the origin: metres of a minute of arc there
    assert first.e == pytest.approx(-5992.7, abs=2) and first.n == pytest.approx(-35363.2, abs=5) and first.m[:4] == "5339" and len(first.m) == 10
    outside = spark.createDataFrame([(99.9, 35.0), (139.0, 66.7)], "lon double, lat double").select(tiles.mesh100(F.col("lon"), F.col("lat"))).collect()
    assert [r[0] for r in outside] == [None, None]


def test_tally(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, n int")
    members = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("z", "gone")], "group_id string, k string")
    assert {r.group_id: r.n for r in tally.subtotals(counts, members, "k", "n").collect()} == {"x": 3, "y": None, "z": None}
    with pytest.raises(ValueError):
        tally.assert_unique(members, "group_id")
    with pytest.raises(ValueError):
        tally.require_columns(counts, "k", "missing")
    gaps = tally.id_coverage(spark.createDataFrame([(1,), (2,), (5,), (5,)], "n int"), "n").first()
    assert (gaps.largest, gaps.n_found) == (5, 3) and [(s["first"], s["last"]) for s in gaps.missing_spans] == [(3, 4)]


def test_numbered(spark):
    rows = list(range(500))
    random.Random(1).shuffle(rows)
    got = tally.numbered(spark.createDataFrame([(i,) for i in rows], "i int").repartition(5), [F.col("i").desc()], "n").collect()
    assert all(r.n == 500 - r.i for r in got) and len(got) == 500


def test_address(spark):
    names = spark.createDataFrame([("1", "本町"), ("1", "本町二丁目"), ("1", "南"), ("2", "西")], "area string, name string")
    aliases = spark.createDataFrame([("1", "旧町", "南")], "area string, old_name string, name string")
    rows = [(1, "1", "本町"), (2, "1", "本町 ２丁目"), (3, "1", "本町5"), (4, "1", "旧町9"), (5, "1", "東 南"), (6, "2", "本町"), (7, "1", None)]
    a = spark.createDataFrame(rows, "address_id int, area string, address string")
    got = {r.address_id: (r.name, r.method) for r in address.cascade(a, names, aliases).collect()}
    assert got == {1: ("本町", "exact"), 2: ("本町二丁目", "normalised"), 3: ("本町", "partial"), 4: ("南", "alias"), 5: ("南", "dictionary"), 6: (None, "unresolved"), 7: (None, "unresolved")}
    found = sorted((r.name, r.start) for r in address.longest_matches(spark.createDataFrame([(1, "1", "本町二丁目本町南")], "address_id int, area string, address string"), names).collect())
    assert found == [("南", 7), ("本町", 5), ("本町二丁目", 0)]
    with pytest.raises(ValueError):
        address.overlap_gate(names, spark.createDataFrame([("9",)], "area string"), "area")


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def test_polygons(spark):
    concave = ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    holed = [ring((10, 0), (14, 0), (14, 4), (10, 4)), ring((11, 1), (13, 1), (13, 3), (11, 3))]
    polygons = spark.createDataFrame([(1, [concave], "10101"), (2, holed, "x"), (3, [ring((0, 0), (1, 0), (1, 1), (0, 1))], None)], "polygon_id int, rings array<array<struct<x:double,y:double>>>, landform_code string")
    points = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 3.0), (3, 12.0, 2.0), (4, 10.5, 2.0), (5, 0.5, 0.5), (6, None, 1.0)], "point_id int, x double, y double")
    got = sorted((r.point_id, r.polygon_id) for r in enrich.points_in_polygons(points, polygons, 2.0).collect())
    assert got == [(1, 1), (4, 2), (5, 1), (5, 3)]
    areas = [r[0] for r in polygons.select(enrich.ring_area(F.col("rings")[0])).collect()]
    assert areas == [10.0, 16.0, 1.0]
    told = points.select("point_id", F.lit(True).alias("coordinate_ok"), F.lit("ok").alias("tile_status"))
    status = {r.point_id: (r.feature_match_n, r.match_status) for r in enrich.match_status(told, enrich.points_in_polygons(points, polygons, 2.0), enrich.landform_legend(spark)).collect()}
    assert status == {1: (1, "matched"), 2: (0, "no_feature_match"), 3: (0, "no_feature_match"), 4: (1, "matched_unmapped_code"), 5: (2, "matched"), 6: (0, "no_feature_match")}
    labels = points.where("x IS NOT NULL").withColumnRenamed("point_id", "label_id")
    near = {r.label_id: (r.polygon_id, r.how) for r in enrich.label_polygons(labels, polygons, 2.0).collect()}
    assert near[5] == (3, "contains") and near[1] == (1, "contains") and near[2] == (1, "nearest") and near[3] == (2, "nearest")
    assert enrich.rasterise(polygons.where("polygon_id = 2"), 1.0).count() == 12
    assert len(enrich.LANDFORM_CLASSES) == 22 and len(enrich.NATURAL_CLASSES) == 17


def make_points(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([rng.gauss(0, 0.01), rng.uniform(-50, 50)]), rng.uniform(-1, 1)) for i in range(n)] + [(n, 0.5, 0.5), (n + 1, 0.5, 0.5), (n + 2, None, 1.0)]
    return spark.createDataFrame(rows, "point_id long, x double, y double"), [r for r in rows if r[1] is not None]


@pytest.mark.parametrize("k", [1, 5])
def test_knn_is_exact(spark, k):
    points, rows = make_points(spark, 200)
    got = {}
    for r in nb.knn(points, k).collect():
        got.setdefault(r.from_id, []).append((r.rank, r.to_id))
    for i, x, y in rows:
        near = sorted(((a - x) * (a - x) + (b - y) * (b - y), j) for j, a, b in rows if j != i)[:k]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]
    few = points.where("point_id < 3")
    assert nb.knn(few, 8).count() == 6 and nb.knn(points.limit(0), 3).count() == 0


def test_bands_and_nearest(spark):
    points, rows = make_points(spark, 120, 2)
    far = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and far(a, b) <= 2}
    assert {(r.from_id, r.to_id) for r in nb.within(points, 2.0).collect()} == want
    some = points.where("point_id % 10 = 0")
    got = {r.id: r.d for r in nb.nearest_distance(points, some).collect()}
    assert all(got[a[0]] == pytest.approx(min(far(a, b) for b in rows if b[0] % 10 == 0)) for a in rows)


def test_moran_matches_dense_formula(spark):
    points, rows = make_points(spark, 60, 3)
    edges = nb.symmetric(nb.knn(points, 4)).withColumn("model_id", F.lit("m")).unionByName(nb.symmetric(nb.knn(points, 4)).withColumn("model_id", F.lit("flat")))
    values = points.where("x IS NOT NULL").select(F.lit("m").alias("model_id"), F.col("point_id").alias("id"), F.col("y").alias("x"))
    flat = values.withColumn("model_id", F.lit("flat")).withColumn("x", F.lit(1.0))
    got = {r.model_id: r for r in spatial.global_moran(edges, values.unionByName(flat)).collect()}
    ids = [r[0] for r in rows]
    w = np.zeros((len(ids), len(ids)))
    for e in edges.where("model_id = 'm'").collect():
        w[ids.index(e.from_id), ids.index(e.to_id)] = 1
    w /= w.sum(axis=1, keepdims=True)
    z = np.array([r[2] for r in rows])
    z = z - z.mean()
    n, s0 = len(z), w.sum()
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(axis=1) + w.sum(axis=0)) ** 2).sum()
    i = n / s0 * (z @ w @ z) / (z @ z)
    b2 = n * (z**4).sum() / (z @ z) ** 2
    ei = -1 / (n - 1)
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - ei**2
    assert got["m"].moran_i == pytest.approx(i) and got["m"].variance == pytest.approx(var) and got["m"].expectation == pytest.approx(ei)
    assert got["flat"].moran_i is None and got["flat"].n_points == len(ids)


def test_permutations_do_not_depend_on_partitions(spark):
    points, rows = make_points(spark, 80, 4)
    edges = nb.symmetric(nb.knn(points, 4)).withColumn("model_id", F.lit("m"))
    events = points.where("x IS NOT NULL").select(F.lit("m").alias("model_id"), F.col("point_id").alias("id"), (F.col("x") > 0).cast("int").alias("x"))
    flat = lambda f: sorted(map(str, f.withColumn("g_z", F.round("g_z", 9)).collect()))
    one = flat(spatial.binary_permutation(edges, events, draws=99))
    two = flat(spatial.binary_permutation(edges.repartition(7), events.repartition(3), draws=99))
    assert one == two
    rows = spatial.binary_permutation(edges, events, draws=99).collect()
    assert all((r.p_join is None) == (r.x == 0) for r in rows) and all(0 < r.p_g <= 1 for r in rows)
    none = spatial.binary_permutation(edges, events.withColumn("x", F.lit(0)), draws=9).collect()
    assert all(r.p_g is None and r.class_g == "not_tested" for r in none)
    values = points.where("x IS NOT NULL").select(F.lit("m").alias("model_id"), F.col("point_id").alias("id"), "x")
    lisa = spatial.lisa_permutation(edges, values, draws=99).collect()
    assert len(lisa) == len(rows) and all(0 < r.p_raw <= 1 for r in lisa)


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, local):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(5, None), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b", local).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_structs(spark, local):
    edges = [((True, None, 4), (False, 9, 1)), ((False, 9, 1), (False, 10, -5)), ((True, None, 7), (True, None, 6))]
    node = "struct<none:boolean,id:bigint,fp:bigint>"
    got = connected_components(spark.createDataFrame(edges, f"a {node}, b {node}"), "a", "b", local).collect()
    assert {tuple(r.node): tuple(r.root) for r in got} == {n: (False, 9, 1) for n in (*edges[0], *edges[1])} | {n: (True, None, 6) for n in edges[2]}
    assert connected_components(spark.createDataFrame([], f"a {node}, b {node}"), "a", "b", local).collect() == []


def test_composition(spark):
    rows = [("s", 1, "a", 3), ("s", 1, "b", 1), ("s", 2, "a", 1), ("s", 2, "c", 1), ("s", 3, "c", 5)]
    counts = spark.createDataFrame(rows, "scheme string, phase_order int, unit_id string, presence_count int")
    from pyspark.sql import Window

    prof = counts.withColumn("phase_share", F.col("presence_count") / F.sum("presence_count").over(Window.partitionBy("scheme", "phase_order")))
    d = {(r.from_order, r.to_order): r for r in compose.distances(prof, "scheme", "phase_order", "unit_id", adjacent=False).collect()}
    assert d[1, 3].js_divergence == pytest.approx(1) and d[1, 3].bray_curtis == pytest.approx(1) and d[1, 3].hellinger_distance == pytest.approx(1)
    assert d[1, 2].bray_curtis == pytest.approx(0.5)
    b = {r.phase_order: r for r in compose.breadth(prof, ["phase_order"]).collect()}
    assert b[2].normalised_entropy == pytest.approx(1) and b[3].normalised_entropy == 0 and b[3].active_groups == 1
    table = np.array([[3, 1, 0], [1, 0, 1], [0, 0, 5]], float)
    p = table / table.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    rows_, columns, inertia = compose.correspondence(counts, "phase_order", "unit_id", "presence_count")
    values = np.linalg.svd(s)[1] ** 2
    assert [x.inertia for x in inertia.orderBy("axis").collect()] == pytest.approx(values[:2].tolist())
    # masses times squared coordinates of either side give the inertia of an axis
    f = np.array([x.axis1 for x in rows_.orderBy("phase_order").collect()])
    g = np.array([x.axis1 for x in columns.orderBy("unit_id").collect()])
    assert (r * f**2).sum() == pytest.approx(values[0]) and (c * g**2).sum() == pytest.approx(values[0])


def test_selection_monte_carlo(spark):
    rows = [(1, "b1", "l1", 30, 15.0), (1, "b1", "l2", 0, 15.0), (1, "b2", "l1", 5, 5.0), (1, "b2", "l2", 5, 5.0), (2, "b1", "l1", 10, 10.0)]
    unit = spark.createDataFrame(rows, "k int, basin string, landform string, observed int, expected double")
    a = sorted(map(str, select.monte_carlo(unit, "k", draws=199).collect()))
    assert a == sorted(map(str, select.monte_carlo(unit.repartition(4), "k", draws=199).collect()))
    got = {(r.k, r.landform): r for r in select.signals(select.over_basins(unit, "k"), select.monte_carlo(unit, "k", draws=199), "k").collect()}
    assert got[1, "l1"].selection_signal == "over_represented" and got[1, "l2"].selection_signal == "under_represented" and got[2, "l1"].monte_carlo_p == 1


def test_patterns(spark):
    square = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 0.0), ("a", 2.0, 2.0), ("a", 0.0, 2.0), ("a", 1.0, 1.0), ("a", 1.0, 0.0), ("b", 1.0, 1.0)], "k string, x double, y double")
    hull = pattern.hulls(square.repartition(3), "k").collect()
    assert len([r for r in hull if r.k == "a"]) == 4 and {r.area for r in hull if r.k == "a"} == {4.0}
    total = pattern.density(square, 0.5, 0.1).agg(F.sum("density")).first()[0] * 0.01
    assert total == pytest.approx(1, abs=0.02)


def test_recovery(spark):
    one = spark.createDataFrame([(1, 139.0, 35.0, 139.0, 35.0)], "id int, lon double, lat double, proxy_lon double, proxy_lat double")
    got = recover.retry_points(one).collect()
    assert len(got) == 13 and sum(r.method.startswith("segment") for r in got) == 1
    labels = spark.createDataFrame([("x", i, c) for i, c in enumerate("bcdz")] + [("y", 0, "q")], "block string, place int, label string")
    expected = spark.createDataFrame([("u", i, c) for i, c in enumerate("abcde")], "unit string, place int, label string")
    assert [(r.block, r.unit, r.share) for r in recover.assign_windows(labels, expected, 0.7).collect()] == [("x", "u", 0.75)]


def test_representative_points_and_rejects(spark):
    u = ring((0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3))
    rows = [(1, [u], "a"), (2, [ring((0, 0), (2, 0), (2, 2), (0, 2))], "a"), (3, [ring((0, 0), (1, 1))], "a"), (4, [], "b")]
    polygons = spark.createDataFrame(rows, "polygon_id int, rings array<array<struct<x:double,y:double>>>, landform_code string")
    valid, rejected = enrich.reject_invalid(polygons)
    got = {r.polygon_id: (r.p.x, r.p.y, r.ok) for r in valid.select("polygon_id", enrich.representative_point(F.col("rings")[0]).alias("p"), F.col("rings")[0].alias("r")).select("polygon_id", "p", enrich.in_ring(F.col("p.x"), F.col("p.y"), F.col("r")).alias("ok")).collect()}
    assert set(got) == {1, 2} and all(v[2] for v in got.values()) and got[2][:2] == (1.0, 1.0)
    assert {r.landform_code: r.n_rejected for r in rejected.collect()} == {"a": 1, "b": 1}


def test_radiocarbon(spark):
    from strandline.operators import radiocarbon as rc

    curve = spark.createDataFrame([(float(y), float(y), 0.0) for y in range(2000, 4001, 5)], "cal_bp double, c14_age double, c14_error double")
    dates = spark.createDataFrame([(1, 3000.0, 30.0, "s"), (2, 3050.0, 30.0, "s"), (3, 3500.0, 30.0, "s")], "date_id int, age double, error double, site string")
    cal = rc.calibrate(dates, curve)
    sums = {r.date_id: (r.s, r.m) for r in cal.groupBy("date_id").agg(F.sum("density").alias("s"), F.sum(F.col("density") * F.col("cal_bp")).alias("m")).collect()}
    assert sums[1][0] == pytest.approx(1) and sums[1][1] == pytest.approx(3000, abs=0.5)
    spans = {r.date_id: r for r in rc.highest_density(cal).collect()}
    assert spans[1].from_bp - spans[1].to_bp == pytest.approx(120, abs=10) and spans[1].probability >= 0.954
    binned = rc.bins(dates)
    assert {r.date_id: r.bin for r in binned.collect()} == {1: "s_1", 2: "s_1", 3: "s_2"}
    assert rc.summed(cal, binned).agg(F.sum("density")).first()[0] == pytest.approx(2)


def test_hausdorff(spark):
    make = lambda rows: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "point_id long, x double, y double")
    r = nb.hausdorff(make([(0, 0), (1, 0), (5, 0)]), make([(0, 0), (1, 1)])).first()
    assert r.left_to_right == pytest.approx(math.hypot(4, 1)) and r.right_to_left == 1 and r.left_matched == pytest.approx(1 / 3)


def test_radiocarbon_intervals_of_every_customer(spark):
    import math

    from strandline.plans.catalogue import QUERIES
    from tests.conftest import SF

    customers = spark.read.parquet(f"{SF}/customer.parquet").collect()
    got = {}
    for r in QUERIES["radiocarbon_intervals"](spark, SF).collect():
        got.setdefault(r.date_id, []).append(r)
    assert set(got) == {c.c_custkey for c in customers}
    curve = [(i * 5.0, i * 5 * 0.93 + 40 * math.sin(i * 5 / 150)) for i in range(200, 1400)]
    for c in customers:
        age, variance = float(c.c_acctbal) / 4 + 3000, (20 + c.c_custkey % 40) ** 2 + 144
        p = {bp: math.exp(-((c14 - age) ** 2) / (2 * variance)) / math.sqrt(2 * math.pi * variance) for bp, c14 in curve}
        total, held, kept = sum(p.values()), 0.0, []
        for bp in sorted(p, key=lambda x: (-p[x], x)):
            if held >= 0.954:
                break
            held += p[bp] / total
            kept.append(bp)
        rows = got[c.c_custkey]
        assert (min(r.to_bp for r in rows), max(r.from_bp for r in rows)) == (min(kept), max(kept))
        assert abs(sum(r.probability for r in rows) - held) < 1e-6


def _crowded(rng):
    town = [(rng.gauss(5, 1e-4), rng.gauss(5, 1e-4)) for _ in range(540)]
    here = [(5.0, 5.0)] * 40
    around = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(59)]
    xy = town + here + around + [(1e6, -3.0)]
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]


@pytest.mark.parametrize("sample", [50_000, 60])
def test_nearest_neighbours_of_a_town_and_an_outlier(spark, monkeypatch, sample):
    monkeypatch.setattr(nb, "SAMPLE", sample)
    rows = _crowded(random.Random(3))
    points = spark.createDataFrame(rows, "point_id long, x double, y double")
    got = {}
    for r in nb.knn(points, 4).collect():
        got.setdefault(r.from_id, []).append((r["rank"], r.to_id, r.d))
    d2 = lambda a, z: (z[1] - a[1]) ** 2 + (z[2] - a[2]) ** 2
    for a in rows:
        want = sorted((d2(a, z), z[0]) for z in rows if z[0] != a[0])[:4]
        assert [t for _, t, _ in sorted(got[a[0]])] == [t for _, t in want]
    others = spark.createDataFrame(rows[::7], "point_id long, x double, y double")
    for r in nb.nearest_distance(points, others).collect():
        assert abs(r.d - min(d2(rows[r.id], z) for z in rows[::7]) ** 0.5) < 1e-9


def test_crowded_cells_do_not_meet_all_pairs(spark):
    rows = _crowded(random.Random(4))
    points = spark.createDataFrame([(i + 600 * j, x + 1e-9 * j, y) for i, x, y in rows for j in range(10)], "point_id long, x double, y double")
    known = nb._known(points, "point_id")
    crowd = nb._places(known, 5)
    bounds = nb._bounds(known)
    levelled = nb._with_levels(crowd.select("x", "y").distinct(), crowd, 5, bounds)
    assert nb._round(levelled, crowd, bounds, "x", "y").count() < 60 * 6400


def test_local_permutation_agrees_with_all_permutations(spark):
    values = [0.0, 1.0, 1.0, 2.5, 4.0, 4.5, 9.0, 11.0, 3.0]
    edges = [(i, j) for i in range(9) for j in range(9) if i != j and abs(i - j) <= 2]
    e = spark.createDataFrame([("m", a, b) for a, b in edges], "model_id string, from_id long, to_id long")
    v = spark.createDataFrame([("m", i, x) for i, x in enumerate(values)], "model_id string, id long, x double")
    draws = 4999
    for most in (1 << 20, 8):
        got = {r.id: r.p_raw for r in spatial.lisa_permutation(e, v, draws=draws, most=most).collect()}
        if most == 8:  # values rounded to eight parts of the range
            assert all(0 < p <= 1 for p in got.values())
            continue
        mean = sum(values) / 9
        for i in range(9):
            near = [values[b] - mean for a, b in edges if a == i]
            rest = [x - mean for j, x in enumerate(values) if j != i]
            own, z = sum(near) * (values[i] - mean), values[i] - mean
            every = [sum(c) * z for c in itertools.combinations(rest, len(near))]
            above, below = (sum(s >= own - 1e-9 for s in every) / len(every), sum(s <= own + 1e-9 for s in every) / len(every))
            assert abs(got[i] - min(1.0, 2 * min(above, below))) < 0.05


def test_draws_are_sets_of_others():
    got = spatial.draw_others(np.random.default_rng(1), 6, 3, 20_000, 2)
    assert all(len(set(row)) == 3 and 2 not in row and set(row) <= set(range(6)) for row in got.tolist())
    counts = Counter(tuple(sorted(row)) for row in got.tolist())
    assert len(counts) == 10 and all(abs(n / 2000 - 1) < 0.15 for n in counts.values())


def test_binary_permutation_agrees_with_the_hypergeometric_tail(spark):
    n, marks = 40, [1] * 12 + [0] * 28
    edges = [("m", i, (i + s) % n) for i in range(n) for s in (1, 2, 3, -1, -2, -3)]
    e = spark.createDataFrame(edges, "model_id string, from_id long, to_id long")
    v = spark.createDataFrame([("m", i, x) for i, x in enumerate(marks)], "model_id string, id long, x int")
    for r in spatial.binary_permutation(e, v, draws=9999).where("x = 1").collect():
        tail = sum(math.comb(11, j) * math.comb(28, 6 - j) for j in range(r.bb, 7)) / math.comb(39, 6)
        assert abs(r.p_join - tail) < 0.02


def test_labels_go_to_the_nearest_edge_not_corner(spark):
    ring = lambda x0, y0, x1, y1: [[{"x": x0, "y": y0}, {"x": x1, "y": y0}, {"x": x1, "y": y1}, {"x": x0, "y": y1}]]
    polygons = spark.createDataFrame([(1, ring(-100.0, 0.0, 100.0, 1.0)), (2, ring(-1.0, 4.0, 1.0, 5.0))], "polygon_id int, rings array<array<struct<x:double,y:double>>>")
    labels = spark.createDataFrame([(1, 0.0, 2.0), (2, 0.0, 3.5), (3, 0.0, 0.5), (4, 5e4, 0.0), (5, 0.0, -1e3)], "label_id int, x double, y double")
    got = {r.label_id: (r.polygon_id, r.how) for r in enrich.label_polygons(labels, polygons, 2.0).collect()}
    assert got == {1: (1, "nearest"), 2: (2, "nearest"), 3: (1, "contains"), 4: (1, "nearest"), 5: (1, "nearest")}


def test_similarity_fit_is_the_least_squares_one(spark):
    rng = np.random.default_rng(5)
    s = rng.normal(size=(12, 2)) * 10
    t = s @ np.array([[2.0, 0.3], [-0.3, 2.0]]) + [4, -7] + rng.normal(size=(12, 2))
    pairs = spark.createDataFrame([("g", *map(float, (*p, *q))) for p, q in zip(s, t)] + [("one", 1.0, 1.0, 2.0, 2.0)], "g string, sx double, sy double, tx double, ty double")
    (got,) = pattern.similarity_fit(pairs, "g").collect()
    rows = np.concatenate([np.stack([s[:, 0], -s[:, 1], np.ones(12), np.zeros(12)], 1), np.stack([s[:, 1], s[:, 0], np.zeros(12), np.ones(12)], 1)])
    p, q, e, f = np.linalg.lstsq(rows, np.concatenate([t[:, 0], t[:, 1]]), rcond=None)[0]
    assert [got.a, got.b, got.e, got.c, got.d, got.f] == pytest.approx([p, -q, e, q, p, f])
    gap = np.hypot(p * s[:, 0] - q * s[:, 1] + e - t[:, 0], q * s[:, 0] + p * s[:, 1] + f - t[:, 1])
    assert [got.rmse, got.max_residual] == pytest.approx([np.sqrt((gap**2).mean()), gap.max()])


def test_hull_window_and_edge_lines(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 4.0, 2.0), (4, 0.0, 2.0), (5, 1.0, 1.0)], "point_id long, x double, y double")
    near = nb.knn(points, 1)
    (got,) = pattern.hull_window_index(points, near).collect()
    mean = (3 * 2**0.5 + 2 + 2) / 5
    assert [got.n, got.expected, got["index"]] == pytest.approx([5, 0.5 * (8 / 5) ** 0.5, mean / (0.5 * (8 / 5) ** 0.5)])
    lines = {(r.from_id, r.to_id): r.wkt for r in nb.edge_lines(nb.symmetric(near), points).collect()}
    assert lines[1, 5] == "LINESTRING (0.0 0.0, 1.0 1.0)" and set(lines) == {(1, 5), (2, 3), (4, 5)}
