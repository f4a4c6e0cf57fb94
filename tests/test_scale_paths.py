"""The ways that are taken for many points, against brute force, with how much they look at."""

import bisect
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loxodrome.operators import clustering, models, neighbours, pair_tree, ranking, resample


def scattered(n, seed=0, clustered=0.3):
    rng = np.random.default_rng(seed)
    z, lon = rng.uniform(-1, 1, n), rng.uniform(-180, 180, n)
    lat = np.degrees(np.arcsin(z))
    tight = rng.random(n) < clustered
    lat[tight], lon[tight] = 10 + rng.normal(0, 2, tight.sum()), 20 + rng.normal(0, 2, tight.sum())
    return lat, lon


def frame(spark, lat, lon, **more):
    columns = {"id": range(len(lat)), "latitude": lat.tolist(), "longitude": lon.tolist(), **more}
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} {'long' if c in ('id', 'rep') else 'double'}" for c in columns))


def brute(lat, lon, radii):
    d = neighbours.haversine_matrix(lat, lon, lat, lon)
    d = d[~np.eye(len(d), dtype=bool)]
    return {r: int((d <= r).sum()) for r in radii}


@pytest.mark.parametrize("radii", [(50.0, 400.0, 2500.0), (10.0, 1e9), (100.0,)])
def test_tree_counts_pairs(spark, radii):
    lat, lon = scattered(700)
    lat[:200], lon[:200] = 5.0, 5.0  # a third of the points in one place
    lat[200:204], lon[200:204] = [90, 90, -90, -90], [0, 77, 0, 5]
    found = clustering.pair_counts(frame(spark, lat, lon), radii, broadcast_rows=0)
    assert {r.radius_km: r.pairs for r in found.collect()} == brute(lat, lon, radii)


def test_tree_counts_each_key_and_small_leaves(spark):
    radii = (100.0, 800.0)
    lat, lon = scattered(300, 4)
    rep = [i % 3 for i in range(300)]
    df = frame(spark, lat, lon, rep=rep)
    counts = pair_tree.tree_counts(df, radii, ("rep",), leaf=4).groupBy("rep", "radius_km").agg(F.sum("c").alias("c"))
    got = Counter()
    for r in counts.collect():
        for x in radii:
            got[r.rep, x] += r.c if r.radius_km <= x else 0
    for k in range(3):
        own = np.array(rep) == k
        assert {x: got[k, x] for x in radii} == brute(lat[own], lon[own], radii)
    none = frame(spark, lat, lon).filter("false")
    assert pair_tree.tree_counts(none, radii).count() == 0
    assert pair_tree.tree_counts(frame(spark, lat[:1], lon[:1]), radii).count() == 0


def test_tree_compares_a_falling_share_of_pairs(spark):
    shares = []
    for n in (2000, 8000):
        lat, lon = scattered(n, 1, 0.0)
        seen = []
        got = {r.radius_km: r.c for r in pair_tree.tree_counts(frame(spark, lat, lon), (500.0, 1500.0), leaf=256, watch=seen).collect()}
        want = brute(lat, lon, (500.0, 1500.0))
        assert got[500.0] == want[500.0] and sum(got.values()) == want[1500.0]
        shares.append(sum(c for *_, c in seen) / n**2)
    assert shares[1] < 0.7 * shares[0] < 0.35


def kernel_sums(x, y, lon, lat):
    n = len(x)
    cov = np.cov(np.vstack([x, y])) * n ** (-1 / 3)
    inverse, out = np.linalg.inv(cov), np.empty(len(lon))
    for i, (a, b) in enumerate(zip(lon, lat, strict=True)):
        u = np.vstack([a - x, b - y])
        out[i] = np.exp(-0.5 * (u * (inverse @ u)).sum(0)).sum()
    return out / (n * 2 * math.pi * math.sqrt(np.linalg.det(cov))), 1 / (2 * math.pi * math.sqrt(np.linalg.det(cov)))


@pytest.mark.parametrize("tiles", [clustering.KernelTiles(), clustering.KernelTiles(6, 0.5, 3.0), clustering.KernelTiles(8, 1.0, 2.5), clustering.KernelTiles(3, 0.25, 4.0)])
def test_density_is_within_its_error(spark, tiles):
    lat, lon = scattered(400, 3, 0.6)
    lat[:150], lon[:150] = -30.0, 100.0
    df = frame(spark, lat, lon).unionByName(spark.createDataFrame([(9999, None, 1.0)], "id long, latitude double, longitude double"))
    rows = clustering.kernel_density(df, 10.0, tiles=tiles).orderBy("latitude", "longitude").collect()
    assert len(rows) == 37 * 19
    want, peak = kernel_sums(lon, lat, [r.longitude for r in rows], [r.latitude for r in rows])
    wrong = np.abs(np.array([r.density for r in rows]) - want).max() / peak
    assert wrong <= tiles.error() + 1e-13
    if tiles == clustering.KernelTiles():
        assert tiles.error() < 1e-13
        exact = clustering.kernel_density(df, 10.0, exact=True).orderBy("latitude", "longitude").collect()
        assert np.allclose([r.density for r in exact], want, rtol=1e-9, atol=1e-18)
    else:
        assert wrong > 1e-9  # the coarse ones do err


def test_density_of_close_points_far_from_most_nodes(spark):
    lat, lon = scattered(50, 5, 1.0)
    rows = clustering.kernel_density(frame(spark, lat, lon), 20.0).collect()
    assert len(rows) == 19 * 10 and sum(r.density == 0 for r in rows) > 100
    with pytest.raises(ValueError, match="line"):
        clustering.kernel_density(frame(spark, np.zeros(3), np.arange(3.0)))


def test_designs_fitted_together_are_those_fitted_alone(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3))
    y, z = (x[:, 0] + rng.normal(size=500) > 1).astype(int), (x @ [1, -1, 2] > 0).astype(int)
    rows = [(*map(float, a), int(b), int(c), 0, i % 4) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))]
    d = spark.createDataFrame(rows, "a double, b double, c double, y int, z int, none int, fold int")
    groups = models._conditions(4)
    designs = [models.Design(("a",), "y", 0), models.Design(("c", "a", "b"), "z", 4), models.Design(("b", "c"), "y", 2), models.Design(("a", "b"), "none", 1)]
    for design, m in zip(designs, models.fit_designs(d, designs, groups), strict=True):
        alone = models.fit_logistic(d, list(design.columns), design.label, [groups[design.group]])[0]
        assert m["n"] == alone["n"] and m["intercept"] == pytest.approx(alone["intercept"], abs=1e-8)
        assert np.allclose(m["coef"], alone["coef"], atol=1e-8)
        assert design.label != "none" or not m["coef"].any()


def test_ablation_by_fold(spark):
    rng = random.Random(3)
    rows = [(i, -88.0 + 176.0 * i / 599, rng.random(), rng.random() if i % 50 else None, int(rng.random() < 0.3)) for i in range(600)]
    d = spark.createDataFrame(rows, "cell_id long, lat_centre double, p double, q double, has_hotspot int")
    sets = {"both": ["p", "q"], "one": ["p"], "null": ["p", "q"]}
    folds = models.ablation_folds(d, sets).collect()
    assert {(r.feature_set, r.fold) for r in folds} == {(s, k) for s in sets for k in range(4)}
    alone = {r.fold: r.asDict() for r in models.fold_metrics(models.cross_validated(ranking.median_filled(d, ["p", "q"]), ["p", "q"], "has_hotspot")[0]).collect()}
    for r in folds:
        if r.feature_set == "both":
            assert all(r[c] == pytest.approx(alone[r.fold][c], abs=1e-9) for c in ("auc_roc", "pr_auc", "brier", "n_test"))
    shuffled = sum(r.n_positive_test for r in folds if r.feature_set == "null")
    assert shuffled == sum(r[-1] for r in rows)
    table = {r.feature_set: r for r in models.ablation(d, sets).collect()}
    assert table["one"].auc_roc_mean == pytest.approx(np.mean([r.auc_roc for r in folds if r.feature_set == "one"]))
    assert table["one"].auc_roc_std == pytest.approx(np.std([r.auc_roc for r in folds if r.feature_set == "one"]))


def test_running_totals_of_narrow_and_single_groups(spark):
    rng = random.Random(9)
    rows = [("wide", rng.random() * 1e6, 1) for _ in range(500)] + [("narrow", 5 + i * 1e-9, 2) for i in range(500)] + [("one", 3.0, 7), (None, 1.0, 1), (None, 2.0, 4)]
    d = ranking.running(spark.createDataFrame(rows, "g string, k double, n long"), "k", {"n": "before"}, buckets=8, by=("g",))
    got = {(r.g, r.k): r.before for r in d.collect()}
    assert len(got) == len(rows)
    assert all(got[g, k] == sum(m for h, j, m in rows if h == g and j < k) for g, k, _ in rows[:60] + rows[480:560] + rows[-3:])


def star(cx, cy, spikes, far, near, turn=0.0):
    points = []
    for k in range(2 * spikes):
        r, a = (far if k % 2 else near), turn + math.pi * k / spikes
        points.append((cx + r * math.cos(a), cy + 0.5 * r * math.sin(a)))
    return points


def polygons_of(spark):
    layers = [("wide", [star(0, 0, 40, 150, 90)]), ("holed", [star(-60, 10, 9, 60, 30), [(-75.0, 0.0), (-45.0, 0.0), (-45.0, 20.0), (-75.0, 20.0)]]), ("box", [[(20.0, -30.0), (100.0, -30.0), (100.0, 30.0), (20.0, 30.0)]]), ("sliver", [[(-170.0, 79.0), (170.0, 80.0), (-170.0, 80.5)]])]
    rows = [(n, i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, (n, rings) in enumerate(layers)]
    return spark.createDataFrame(rows, "unit_name string, polygon_seq long, rings array<array<struct<x: double, y: double>>>")


@pytest.mark.parametrize("bucket", [2.5, 10.0, 400.0])
def test_polygons_by_tiles(spark, bucket):
    rng = random.Random(4)
    cells = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(3000)] + [(9000 + i, 20.0 + 10 * i, -30.0 + 10 * i) for i in range(7)] + [(9100, 100.0, 0.0), (9101, -45.0, 10.0)]
    c = spark.createDataFrame(cells, "cell_id long, lon_centre double, lat_centre double")
    few = neighbours.assign_polygons(c, polygons_of(spark)).select("cell_id", "geology_unit")
    many = neighbours.assign_polygons(c, polygons_of(spark), bucket=bucket, broadcast_rows=0).select("cell_id", "geology_unit")
    want = dict(map(tuple, few.collect()))
    assert dict(map(tuple, many.collect())) == want and set(want.values()) == {"wide", "holed", "box", "sliver", "UNKNOWN"}


def test_most_tiles_of_large_polygons_need_no_edge(spark):
    from loxodrome.functions import geo

    p = polygons_of(spark).select(F.col("unit_name").alias("_unit"), F.col("polygon_seq").alias("_seq"), F.flatten(F.transform("rings", geo.ring_edges)).alias("_edges"))
    tiles = neighbours.polygon_tiles(p, 2.5).filter("_unit = 'box'")
    r = tiles.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_whole").cast("int")).alias("whole"), F.max(F.size("_edges")).alias("most")).first()
    assert r.whole > 0.85 * r.n and r.most <= 3
    wide = neighbours.polygon_tiles(p, 2.5).filter("_unit = 'wide'").agg(F.avg(F.when(~F.col("_whole"), F.size("_edges"))).alias("e"), F.avg(F.col("_whole").cast("int")).alias("w")).first()
    assert wide.e < 20 and wide.w > 0.3  # of 80 edges; the spikes are narrow


@pytest.mark.parametrize("order", [None, ["s", "v"], ["v", "s"]])
def test_numbered_in_ranges(spark, order):
    from loxodrome.operators import resample

    rng = random.Random(1)
    rows = [(rng.choice([None, 1.5, -2.0, float(rng.randrange(100))]), rng.choice([None, "", "abcd", "abcde", f"x{rng.random()}"])) for _ in range(400)]
    got = resample.numbered(spark.createDataFrame(rows, "v double, s string").repartition(7), order).collect()
    key = lambda x: (x is not None, x if x is not None else 0)
    by = order or ["v", "s"]
    put = sorted(got, key=lambda r: r.row_seq)
    assert [r.row_seq for r in put] == list(range(400))
    assert put == sorted(put, key=lambda r: [(x is not None, str(x) if c == "s" else (x or 0.0)) for c, x in ((c, r[c]) for c in by)]) and key(None) < key(1)
    assert resample.numbered(spark.createDataFrame([], "v double, s string"), order).count() == 0


def test_folds_of_a_single_class_have_no_curves(spark):
    d = spark.createDataFrame([(i, -80.0 + i, float(i), int(i == 3)) for i in range(160)], "cell_id long, lat_centre double, p double, has_hotspot int")
    folds = {(r.feature_set, r.fold): r for r in models.ablation_folds(d, {"one": ["p"]}).collect()}
    assert folds["one", 0].auc_roc is not None and all(folds["one", k].auc_roc is None and folds["one", k].pr_auc is None for k in (1, 2, 3))
    assert models.ablation(d, {"one": ["p"]}).first().auc_roc_mean == folds["one", 0].auc_roc


# --- resamples as counts --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (7, 0.01), (40, 0.5), (40, 0.999), (900, 0.3), (3000, 0.7)])
def test_binomial_draws_invert_the_distribution(n, p):
    exact, total, a = [], 0, round(1000 * p)  # whole numbers: p is a in a thousand
    for k in range(n + 1):
        total += math.comb(n, k) * a**k * (1000 - a) ** (n - k)
        exact.append(total / 1000**n)
    u = np.random.default_rng(5).random(200)
    got = resample.binomial_inverse(np.full(200, n, dtype=np.int64), p, u)
    assert got.tolist() == [min(bisect.bisect_right(exact, x), n) for x in u.tolist()]


def test_binomial_draws_of_certain_and_no_shares():
    n, u = np.array([0, 3, 9], dtype=np.int64), np.array([0.1, 0.5, 0.999999])
    assert resample.binomial_inverse(n, 1.0, u).tolist() == [0, 3, 9] and resample.binomial_inverse(n, 0.0, u).tolist() == [0, 0, 0]
    assert resample.binomial_inverse(n[:0], 0.5, u[:0]).tolist() == []


def test_multinomial_counts(spark):
    weights = {None: 3, "hot": 4000, **{f"k{i:04d}": 1 + i % 4 for i in range(700)}}  # more keys than a node has children
    df = spark.createDataFrame(list(weights.items()), "key string, w long")
    n, reps = sum(weights.values()), 60
    rows = [(r["rep"], r["key"], r["count"]) for r in resample.multinomial(df, "key", "w", reps).collect()]
    assert len({r[:2] for r in rows}) == len(rows) and all(c > 0 for *_, c in rows)
    per_rep = Counter()
    mean = Counter()
    for rep, key, c in rows:
        per_rep[rep] += c
        mean[key] += c / reps
    assert per_rep == {r: n for r in range(reps)} and set(mean) <= set(weights)
    for key, w in weights.items():
        assert abs(mean[key] - w) < 5 * math.sqrt(w / reps), key
    hot = [c for _, key, c in rows if key == "hot"]
    share = weights["hot"] / n
    assert 0.5 < np.var(hot) / (n * share * (1 - share)) < 1.7
    again = [(r["rep"], r["key"], r["count"]) for r in resample.multinomial(df.repartition(7), "key", "w", reps).collect()]
    assert set(again) == set(rows)


def test_multinomial_of_nothing_and_of_one_key(spark):
    empty = spark.createDataFrame([], "key long, w long")
    assert resample.multinomial(empty, "key", "w", 3).count() == 0
    one = spark.createDataFrame([(7, 5), (8, 0)], "key long, w long")
    assert sorted(tuple(r) for r in resample.multinomial(one, "key", "w", 3).collect()) == [(0, 7, 5), (1, 7, 5), (2, 7, 5)]


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_jackknife_rows_are_those_of_least_hash(spark, n):
    points = spark.range(n).select((F.col("id") * 0.01).alias("longitude"), F.col("id").alias("row_seq"))
    got = defaultdict(set)
    for r in resample.without_replacement(points, (0.9, 0.25), 2).collect():
        assert r["row_seq"] not in got[r["fraction_retained"], r["rep"]]
        got[r["fraction_retained"], r["rep"]].add(r["row_seq"])
    want = {}
    for f in (0.9, 0.25) if n else ():
        for rep in range(2):
            order = sorted(range(n), key=lambda i: (hashlib.md5(f"42:{f}:{rep}:{i}".encode()).hexdigest(), i))
            want[f, rep] = set(order[: max(1, round(f * n))])
    assert got == want


# --- quantiles by selection -----------------------------------------------------------------------------------------


def test_quantiles_by_selection(spark):
    rng = random.Random(4)
    groups = {"hot": [round(rng.gauss(0, 1), 3) for _ in range(20_000)], "narrow": [1e6 + rng.random() for _ in range(500)], "ties": [2.0] * 300 + [3.0], "one": [5.0], None: [1.0, 2.0], "unknown": [None, None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    named = {"least": 0.0, "lo": 0.025, "mid": 0.5, "hi": 0.975, "most": 1.0}
    got = {r["g"]: r for r in ranking.quantiles(df, ["g"], "v", named).collect()}
    assert set(got) == set(groups) and all(got["unknown"][n] is None for n in named)
    for g, vs in groups.items():
        if g != "unknown":
            assert [got[g][n] for n in named] == pytest.approx(np.quantile(vs, list(named.values())).tolist(), rel=1e-12)
    whole = ranking.quantiles(df, [], "v", named).first()
    assert [whole[n] for n in named] == pytest.approx(np.quantile([v for vs in groups.values() for v in vs if v is not None], list(named.values())).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert ranking.quantiles(empty, ["g"], "v", {"mid": 0.5}).count() == 0
    assert ranking.quantiles(empty, [], "v", {"mid": 0.5}).first()["mid"] is None


# --- findings of round 3 ----------------------------------------------------------------------------------------------


def test_pairs_of_leaves_on_radii_and_copies(spark):
    radii = tuple(10.0 * k for k in range(1, 120))  # many radii through every pair of leaves
    lat, lon = scattered(900, 7)
    lat[:30], lon[:30] = 0.0, np.arange(30.0)  # distances that differ by rounding only
    lat[30:60], lon[30:60] = lat[60:90], lon[60:90]
    on = tuple(neighbours.haversine_matrix(lat[:1], lon[:1], lat[1:30], lon[1:30])[0].tolist())  # radii that pairs lie on
    for steps in (radii, on):
        for parts in (1, 3):
            got = {r.radius_km: r.c for r in pair_tree.tree_counts(frame(spark, lat, lon), steps, parts=parts).collect()}
            want, total = brute(lat, lon, steps), 0
            for r in sorted(steps):
                total += got.get(r, 0)
                assert total == want[r]


def test_simulations_are_counted_without_tables_of_levels(spark, monkeypatch):
    written = []
    monkeypatch.setattr(pair_tree, "saved", lambda df: written.append(df.columns) or df)
    k = clustering.csr_envelope(spark, 300, (100.0, 900.0), sims=3).collect()
    assert len(k) == 2 and written == [["rep", "band", "c"]]  # counts, never pairs of cubes
    lat, lon = ([r[c] for r in resample.sphere_points(spark, 300, 1).collect()] for c in ("latitude", "longitude"))
    n = brute(np.array(lat), np.array(lon), (900.0,))[900.0]
    own = clustering.pair_counts(resample.sphere_points(spark, 300, 1), (900.0,), ("rep",)).first()
    assert own.pairs == n


def test_leakage_of_a_label_or_feature_that_is_constant(spark):
    d = spark.createDataFrame([(float(i), 2.0, float(i % 7), 1, int(i % 3 == 0)) for i in range(40)], "a double, b double, c double, all int, some int")
    one = {r.feature: r for r in models.leakage_audit(d, ["a", "b", "c"], "all").collect()}
    assert all(math.isnan(r.pearson_r) and math.isnan(r.spearman_r) and abs(r.lr_coef) < 1e-9 for r in one.values())
    assert all(r.suspected_leakage and r.flag_reason == "|r|=nan ≥ 0.6" for r in one.values())
    two = {r.feature: r for r in models.leakage_audit(d, ["a", "b", "c"], "some").collect()}
    assert math.isnan(two["b"].pearson_r) and two["b"].suspected_leakage and not two["c"].suspected_leakage
    x = np.array([(i, int(i % 3 == 0)) for i in range(40)], float)
    assert two["a"].pearson_r == pytest.approx(np.corrcoef(x.T)[0, 1])


def test_models_of_a_single_class_are_certain_of_it(spark):
    d = spark.createDataFrame([(float(i), 1, 0) for i in range(30)], "a double, all int, none int")
    for label, p in (("all", 1.0), ("none", 0.0)):
        m = models.fit_logistic(d, ["a"], label, [F.lit(True), F.col("a") < 0])
        got = d.withColumn("p", models.probability(["a"], m[0])).agg(F.min("p"), F.max("p")).first()
        assert got[0] == pytest.approx(p, abs=1e-15) and got[1] == pytest.approx(p, abs=1e-15)
        assert m[1]["n"] == 0 and m[1]["intercept"] == 0.0  # without rows nothing is known


def test_nearest_others_of_many_points_meet_few(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "pairs_within", lambda *a, **k: pytest.fail("all pairs are met"))
    lat, lon = scattered(900, 9)
    lat[:5], lon[:5] = lat[5:10], lon[5:10]
    lat[10:12], lon[10:12] = [90.0, -90.0], [0.0, 50.0]
    lat[12:20], lon[12:20] = 40.0 + np.arange(8) * 1e-7, -100.0  # close together, far closer than the others
    radii = (1e-5, 5.0, 60.0, 200.0)
    d = neighbours.haversine_matrix(lat, lon, lat, lon)
    np.fill_diagonal(d, np.inf)
    got = {r.radius_km: r.nn_cdf_observed for r in clustering.nearest_neighbour_cdf(frame(spark, lat, lon), radii, broadcast_rows=0).collect()}
    assert got == {r: pytest.approx((d.min(axis=1) <= r).mean()) for r in radii}


def test_exact_density_is_dealt_to_tasks(spark):
    lat, lon = scattered(4500, 3)
    k = clustering.kernel_density(frame(spark, lat, lon), 30.0, exact=True)
    plan = k._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    cov = np.cov(np.stack([lon, lat])) * len(lat) ** (-1 / 3)
    inv, scale = np.linalg.inv(cov), 1 / (len(lat) * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    rows = k.collect()
    assert len(rows) == 13 * 7
    for r in rows:
        v = np.stack([r.longitude - lon, r.latitude - lat])
        assert r.density == pytest.approx(np.exp(-0.5 * (v * (inv @ v)).sum(axis=0)).sum() * scale, rel=1e-9, abs=1e-18)


def test_simulated_points_are_drawn_where_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(resample, "sphere_points", lambda *a, **k: pytest.fail("points are made to be shuffled"))
    n, sims, radii = 240, 5, (150.0, 600.0, 2000.0)
    draws = [resample.sphere_block(r, 0, n) for r in range(sims)]
    k = np.array([[brute(*p, radii)[x] for x in radii] for p in draws]) * (4 * math.pi * 1821.6**2) / n**2
    for r in clustering.csr_envelope(spark, n, radii, sims=sims).collect():
        own = k[:, radii.index(r.radius_km)]
        assert (r.k_env_lo, r.k_env_hi) == pytest.approx(tuple(np.quantile(own, (0.025, 0.975))), rel=1e-12)
    for block in (240, 100, 7):  # more blocks are met in pairs, each once
        got = Counter()
        for r in pair_tree.drawn_counts(spark, n, sims, resample.sphere_block, radii, block=block).collect():
            for x in radii:
                got[r.rep, x] += r.c if r.radius_km <= x else 0
        assert got == {(i, x): c for i, p in enumerate(draws) for x, c in brute(*p, radii).items()}


def test_drawn_blocks_are_the_points_of_the_table(spark):
    for seed in (42, 7):
        rows = resample.sphere_points(spark, 50, 3, seed).collect()
        for rep in range(3):
            own = sorted((r for r in rows if r.rep == rep), key=lambda r: r.id)
            lat, lon = resample.sphere_block(rep, 10, 50, seed)
            assert lat.tolist() == pytest.approx([r.latitude for r in own[10:]], rel=1e-14) and lon.tolist() == [r.longitude for r in own[10:]]


@pytest.mark.parametrize("r_max", [0.0, 40.0, 1500.0, 1e9])
def test_pairs_within_meet_as_blocks(spark, r_max):
    lat, lon = scattered(300, 5)
    lat[:40], lon[:40] = 5.0, 5.0  # more in one place than a block holds
    lat[40:43], lon[40:43] = [90, 90, -90], [0, 77, 0]
    rep = [i % 2 for i in range(300)]
    points = frame(spark, lat, lon, rep=rep)
    out = neighbours.pairs_within(points, r_max, ("rep",), block=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "asin" not in plan.lower()  # pairs are met as matrices, not as rows of a join
    d = neighbours.haversine_matrix(lat, lon, lat, lon)
    want = {(i, j): d[i, j] for i in range(300) for j in range(300) if i != j and rep[i] == rep[j] and d[i, j] <= r_max}
    rows = out.collect()
    assert len(rows) == len(want) and all(r.rep == rep[r.i] and r.d == pytest.approx(want[r.i, r.j], abs=1e-9) for r in rows)
    names = points.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), "latitude", F.when(F.col("id") != 299, F.col("longitude")).alias("longitude"))
    got = {(r.i, r.j) for r in neighbours.pairs_within(names, min(r_max, 1500.0)).collect()}  # names as ids, a point without a place
    assert got == {(f"p{i}", f"p{j}") for i in range(299) for j in range(299) if i != j and d[i, j] <= min(r_max, 1500.0)}
