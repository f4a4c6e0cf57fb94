import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loxodrome.config import RADIUS_KM, Grid
from loxodrome.functions import geo, special, stats
from loxodrome.operators import asymmetry, clustering, hypotheses, models, neighbours, ranking, rates, resample
from loxodrome.operators import grid as gridding
from loxodrome.plans import features, scenes
from loxodrome.sources import polygons
from loxodrome.streaming import incremental

POINTS = "name string, longitude double, latitude double"
SMALL = Grid(10.0)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_base_grid(spark):
    g = gridding.base_grid(spark)
    assert g.count() == 64800 == g.select("cell_id").distinct().count()
    off = F.abs(F.col("lon_max") - F.col("lon_min") - 1) + F.abs((F.col("lon_max") + F.col("lon_min")) / 2 - F.col("lon_centre")) + F.abs(F.col("lat_max") - F.col("lat_min") - 1)
    assert g.filter(off > 1e-6).count() == 0
    first = g.orderBy("cell_id").first()
    assert (first["lon_centre"], first["lat_centre"]) == (-179.5, -89.5)


def test_assign_points(spark):
    cells = gridding.base_grid(spark)
    pts = spark.createDataFrame([("A", 0.2, 0.2), ("B", 0.7, 0.7), ("Edge", 180.0, 90.0), (None, 5.5, 5.5)], POINTS)
    out = gridding.assign_points(cells, pts).filter("hotspot_count > 0").orderBy("cell_id").collect()
    assert [(r["hotspot_count"], r["hotspot_names"], r["has_hotspot"]) for r in out] == [(2, "A;B", 1), (1, "Edge", 1)] and out[1]["cell_id"] == 64799
    assert gridding.assign_points(cells, pts.filter("false")).agg(F.sum("hotspot_count")).first()[0] == 0


def test_assign_power(spark):
    pts = spark.createDataFrame([("a", -10.4, -75.4, 10.0), ("b", -10.2, -75.2, 30.0), ("c", 5.1, 25.2, 5.0), ("zero", 10.0, 25.0, 0.0), ("null", 20.0, 25.0, None)], POINTS + ", power_gw double")
    r = gridding.assign_power(gridding.base_grid(spark), pts).filter("power_count > 0").orderBy("cell_id").collect()
    assert [(x["lon_centre"], x["lat_centre"], x["power_count"], x["primary_power_gw"], x["mean_power_gw"], x["sum_power_gw"]) for x in r] == [(-10.5, -75.5, 2, 30.0, 20.0, 40.0), (5.5, 25.5, 1, 5.0, 5.0, 5.0)]
    assert r[0]["log_primary_power"] == pytest.approx(math.log1p(30)) and r[0]["power_names"] == "a;b"


def test_distances(spark):
    d = lambda *a: value(spark, geo.haversine_km(*a))
    assert d(10, 20, 10, 20) == 0 and d(0, 0, 0, 180) == pytest.approx(math.pi * RADIUS_KM, rel=1e-3) and d(90, 0, -90, 0) == pytest.approx(math.pi * RADIUS_KM)
    cells = gridding.base_grid(spark, SMALL)
    pts = spark.createDataFrame([("p", 45.0, 35.0)], POINTS)
    out = neighbours.nearest_great_circle(cells, pts)
    assert out.filter("lon_centre = 45 and lat_centre = 35").first()["dist_nearest_hotspot_km"] == 0
    assert out.columns[:-1] == cells.columns
    assert neighbours.nearest_great_circle(cells, pts.filter("false")).first()["dist_nearest_hotspot_km"] == math.inf
    many = spark.range(300).select(F.lit("x").alias("name"), (F.rand(1) * 360 - 180).alias("longitude"), (F.rand(2) * 180 - 90).alias("latitude")).cache()
    a, b = (neighbours.nearest_great_circle(cells, many, broadcast_rows=n).select("cell_id", F.round("dist_nearest_hotspot_km", 6)) for n in (0, 1000))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_polygons_are_open_and_first_wins(spark):
    polys = polygons.boxes(spark, [("A", 0.0, 15.0, 0.0, 20.0), ("B", 0.0, 40.0, 0.0, 40.0)])
    for rows in (0, 100):
        out = {(r["lon_centre"], r["lat_centre"]): r["geology_unit"] for r in neighbours.assign_polygons(gridding.base_grid(spark, SMALL), polys, broadcast_rows=rows).collect()}
        assert out[5.0, 5.0] == "A" and out[15.0, 5.0] == "B" and out[-5.0, 5.0] == "UNKNOWN" and out[35.0, 35.0] == "B"
    holed = spark.createDataFrame([("H", [[(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)], [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]])], "unit_name string, rings array<array<struct<x:double,y:double>>>")
    out = {(r["lon_centre"], r["lat_centre"]): r["geology_unit"] for r in neighbours.assign_polygons(gridding.base_grid(spark, SMALL), holed).collect()}
    assert out[5.0, 5.0] == "H" and out[15.0, 15.0] == "UNKNOWN"


def test_special_functions(spark):
    assert value(spark, stats.chi2_sf1(3.841458820694124)) == pytest.approx(0.05, abs=1e-12)
    for x in (0.0, 0.3, 2.5, 20.0, 60.0):
        assert value(spark, stats.chi2_sf1(x)) == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=1e-14)
    p = lambda k, n: value(spark, stats.binomial_half_p(F.lit(k), F.lit(n)))
    assert p(10, 20) == 1.0 and p(70, 172) == pytest.approx(0.017834, abs=1e-6) and p(0, 0) is None
    low, high = special.exact_interval(10, 20)
    assert (low, high) == (pytest.approx(0.27196, abs=1e-5), pytest.approx(0.72804, abs=1e-5)) and special.exact_interval(0, 5)[0] == 0.0
    assert special.correlation_p(0.5, 10) == pytest.approx(0.1411, abs=1e-4)


def fm(spark):
    d = gridding.base_grid(spark, SMALL).withColumn("has_hotspot", (F.pmod(F.xxhash64("cell_id"), F.lit(9)) == 0).cast("int"))
    unit = F.element_at(F.array(*map(F.lit, ("Fb", "Fd", "Fu", "Prb", "UNKNOWN"))), (F.col("cell_id") % 5 + 1).cast("int"))
    r = lambda k: F.pmod(F.xxhash64("cell_id", F.lit(k)), F.lit(10007)) / 10007.0
    d = d.withColumns({"geology_unit": unit, "geology_encoded": (F.col("cell_id") % 5).cast("int"), "tidal_heating_flux": r(1), "dist_nearest_hotspot_km": F.when(F.col("has_hotspot") == 1, 10 * r(2)).otherwise(500 + 4000 * r(2)), "dist_tidal_stress_max_km": 5000 * r(3)})
    return d.cache()


def test_enrichment_and_coverage(spark):
    f = fm(spark)
    e = rates.enrichment(f).collect()
    assert len(e) == 5 and all(0 <= r["p_bonferroni"] <= 1 and r["wilson_lo"] <= r["observed_rate"] <= r["wilson_hi"] for r in e)
    assert sum(r["n_cells"] for r in e) == 648 and [r["enrichment_ratio"] for r in e] == sorted((r["enrichment_ratio"] for r in e), reverse=True)
    with pytest.raises(ValueError):
        rates.enrichment(f.withColumn("has_hotspot", F.lit(0)))
    with pytest.raises(KeyError):
        rates.enrichment(f.drop("geology_unit"))
    c = rates.coverage(f).collect()
    assert len(c) == 4 and all(0 <= r["observed_cells"] <= r["total_cells"] and r["raw_rate"] >= 0 for r in c) and c[0]["lat_band"] == "-90° to -45°"
    assert rates.coverage(f.drop("geology_unit")).count() == 0


def test_asymmetry(spark):
    lons = [0, 10, 20, 30, 40, 50, 60, 70, 80, 89, 95, 100, 120, 140, 150, 160, 170, -170, -150, -100]
    pts = spark.createDataFrame([(f"p{i}", float(x), 0.0) for i, x in enumerate(lons)], POINTS)
    r = asymmetry.asymmetry(pts, n_boot=20)
    t = r["binomial_tests"][0]
    assert (t["n_a"], t["n_b"], t["p_binom"]) == (10, 10, 1.0) and r["n_hotspots"] == 20
    assert all(h.agg(F.sum("count")).first()[0] == 20 for h in (r["lon_histogram"], r["lat_histogram"]))
    assert asymmetry.binomial_tests(pts.filter("false"))[0]["interpretation"] == "no data"


def test_uniform_points_stay_in_the_envelope(spark):
    pts = resample.sphere_points(spark, 60, 1, seed=99).drop("rep")
    radii = clustering.RADII_KM[:10]
    table, summary = clustering.spatial_stats(pts, radii, sims=39)
    rows = table.collect()
    assert sum(r["k_env_lo"] <= r["k_observed"] <= r["k_env_hi"] for r in rows) >= 0.6 * len(rows) and summary["n_points"] == 60
    assert [r["k_observed"] for r in rows] == sorted(r["k_observed"] for r in rows)
    with pytest.raises(ValueError):
        clustering.ripley_k(pts.limit(1))


def test_patterns_and_hypotheses(spark):
    g = hypotheses.attach_patterns(gridding.base_grid(spark, SMALL))
    w = F.cos(F.radians("lat_centre"))
    m = g.agg(*[(F.sum(F.col(f"tidal_template_{n}") * w) / F.sum(w)).alias(n) for n in stats.PATTERNS]).first()
    assert all(v == pytest.approx(1.0, abs=1e-9) for v in m)
    polar = g.groupBy((F.abs("lat_centre") > 60).alias("p")).agg(F.avg("tidal_template_deep_mantle").alias("d"), F.avg("tidal_template_asthenosphere").alias("a"))
    v = {r["p"]: r for r in polar.collect()}
    assert v[True]["d"] > v[False]["d"] and v[True]["a"] < v[False]["a"]
    out = hypotheses.compare(fm(spark).withColumn("has_hotspot", (F.col("cell_id") % 5 == 0).cast("int"))).collect()
    assert out[0]["template"] == "geology_insample" and out[0]["delta_aic"] == 0
    with pytest.raises(KeyError):
        stats.pattern("none", "a", "b")


def test_stability_and_bootstrap(spark):
    f = fm(spark)
    pts = f.filter("has_hotspot = 1").select(F.col("lon_centre").alias("longitude"), F.col("lat_centre").alias("latitude"))
    s = resample.jackknife(f, pts, (0.9, 0.5), 6, grid=SMALL).collect()
    assert {r["fraction_retained"] for r in s} == {0.9, 0.5} and all(0 <= r["survival_rate"] <= 1 for r in s) and sum(r["metric"].startswith("binomial_") for r in s) == 6
    b = resample.bootstrap_enrichment(f, pts, 12, grid=SMALL).collect()
    assert all(r["boot_lo"] <= r["boot_mean"] <= r["boot_hi"] for r in b) and len(b) == 5


def test_folds(spark):
    d = spark.range(181).select((F.col("id") - 90.0).alias("lat_centre"))
    cv = models.LatitudeBands()
    folds = [(a.count(), b.count()) for a, b in cv.split(d)]
    assert folds == [(136, 45), (136, 45), (136, 45), (136, 45)] and cv.n_splits == 4  # latitude 90 is in no test fold
    assert cv.describe(d).count() == 4
    with pytest.raises(ValueError, match="groups"):
        list(cv.split(d, None))


def test_models_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) * [3, 1] + [1, -2]
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 3).astype(int)
    d = spark.createDataFrame([(float(a), float(b), int(c), float(a - 2 * b + e)) for (a, b), c, e in zip(x, y, rng.normal(size=300), strict=True)], "a double, b double, y int, t double").cache()
    m = models.fit_logistic(d, ["a", "b"], "y", [F.lit(True)])[0]
    z = np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0)])
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    beta = np.array([m["intercept"], *m["coef"]])
    p = 1 / (1 + np.exp(-z @ beta))
    assert np.abs(z.T @ (w * (p - y)) + beta * [0, 1, 1]).max() < 1e-6
    t = np.array([r["t"] for r in d.collect()])
    zs = z[:, 1:]
    ridge = models.fit_linear(d, ["a", "b"], "t", [F.lit(True)], alpha=2.0)[0]
    assert np.allclose(ridge["coef"], np.linalg.solve(zs.T @ zs + 2 * np.eye(2), zs.T @ (t - t.mean())))
    net = models.fit_linear(d, ["a", "b"], "t", [F.lit(True)], alpha=0.5, kind="elasticnet")[0]
    g = -zs.T @ (t - t.mean() - zs @ net["coef"]) / 300 + 0.4 * net["coef"] + 0.1 * np.sign(net["coef"])
    assert np.abs(g).max() < 1e-9
    with pytest.raises(ValueError):
        models.fit_linear(d, ["a"], "t", [F.lit(True)], kind="other")


def test_training_and_leakage(spark, tmp_path):
    f = fm(spark)
    model, folds, audit = models.train(f)
    assert folds.count() == 4 and all(r["auc_roc"] > 0.95 for r in folds.collect())
    assert {a[0] for a in audit if a[2]} <= {"dist_nearest_hotspot_km"}
    models.save_model(model, str(tmp_path / "m.json"))
    again = models.load_model(str(tmp_path / "m.json"))
    assert models.score_surface(f, again).agg(F.max("probability")).first()[0] <= 1
    a = {r["feature"]: r for r in models.leakage_audit(f).collect()}
    assert a["dist_nearest_hotspot_km"]["suspected_leakage"] and len(a) == 4
    t = {r["feature_set"]: r for r in models.ablation(f, {"all": ["dist_nearest_hotspot_km"], "null": ["tidal_heating_flux"]}).collect()}
    assert t["all"]["auc_roc_mean"] > 0.95 and abs(t["null"]["auc_roc_mean"] - 0.5) < 0.2


def test_power_regression(spark):
    f = fm(spark)
    power = f.select("cell_id", "lat_centre", "lon_centre", F.lit(1).cast("long").alias("power_count"), (10 + 100 * F.col("tidal_heating_flux")).alias("primary_power_gw"))
    power = power.withColumns({"mean_power_gw": F.col("primary_power_gw"), "sum_power_gw": F.col("primary_power_gw"), "log_primary_power": F.log1p("primary_power_gw"), "power_names": F.lit("x")})
    r = models.power_regression(f, power.drop("lat_centre", "lon_centre"))
    assert r["overall_oof"]["r2"] > 0.8 and len(r["folds"]) == 4 and r["residuals"].count() == 648
    with pytest.raises(ValueError, match="leakage"):
        models.power_regression(f, power, ["dist_nearest_hotspot_km"])
    suite = rates.power_suite(f, power)
    assert set(suite) == {"latitude", "geology", "outlier_sensitivity", "polar_sensitivity"} and suite["latitude"].count() == 6
    with pytest.raises(ValueError):
        rates.power_by_latitude(power.drop("power_count"))


def test_scenes(spark):
    rows = [(i, -1.5 + i % 4, [-60.5, -59.5, 0.5, 60.5][i // 4], i % 3, "Fb" if i % 2 else "UNKNOWN", float(i)) for i in range(16)]
    f = spark.createDataFrame(rows, "cell_id long, lon_centre double, lat_centre double, geology_encoded int, geology_unit string, tidal_heating_flux double")
    p = [1.0, 5.0, 10.0, 100.0, 300.0]
    power = spark.createDataFrame([(i, r[1], r[2], int(i < 5), p[i] if i < 5 else 0.0, p[i] if i < 5 else 0.0, f"n{i}") for i, r in enumerate(rows)], "cell_id long, lon_centre double, lat_centre double, power_count long, primary_power_gw double, sum_power_gw double, power_names string")
    power = power.withColumn("log_primary_power", F.log1p("primary_power_gw"))
    s = scenes.scene(f, power)
    assert s["points"].count() == 5 and s["insights"].first()["strongest_power_gw"] == 300
    two = scenes.scene(f, power, least=50.0)["insights"].first()
    assert (two["visible_hotspots"], two["visible_power_gw"]) == (2, 400.0)
    assert all(3.0 <= r["size"] <= 14.5 for r in s["points"].collect())
    assert f.count() == scenes.surface(f, "thermal_intensity", power).count() == scenes.surface(f, "geology").count()
    r = scenes.surface(f, "natural_io", uncertainty=True).agg(F.min("surface"), F.max("surface")).first()
    assert r[0] >= 0 and r[1] <= 1
    assert scenes.rows_by_latitude(scenes.surface(f)).count() == 4 and scenes.polar_rings(spark).count() == 722
    assert scenes.insights(scenes.power_points(power, 1e9)).first()["strongest_name"] == "none"
    many = spark.range(60).select(F.col("id").alias("cell_id"), F.lit(1).alias("power_count"), F.col("id").cast("double").alias("primary_power_gw"))
    assert [scenes.viewer_points(many, 0.0, a, b).count() for a, b in ((False, False), (True, False), (False, True))] == [45, 60, 10]


def test_ranking(spark):
    d = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 5.0), (4, None), (5, -1.0)], "id long, v double")
    assert {r["id"]: r["r"] for r in ranking.midranks(d, "v", "r", buckets=3).collect()} == {1: 2.5, 2: 2.5, 3: 4.0, 4: None, 5: 1.0}
    k = spark.createDataFrame([(float(x), float(x * x)) for x in (0, 1, 3, 4)], "x double, y double")
    got = [r["g"] for r in ranking.gradient(k, "x", "y", "g").orderBy("x").collect()]
    assert got == pytest.approx(list(np.gradient([0, 1, 9, 16], [0, 1, 3, 4])))
    h = ranking.histogram(spark.createDataFrame([(0.0,), (10.0,), (9.99,), (11.0,)], "v double"), "v", 0, 10, 2)
    assert {r["bin"]: r["count"] for r in h.collect()} == {0: 1, 1: 2}


def test_feature_matrix(spark):
    pts = spark.createDataFrame([("A", 5.0, 5.0), ("B", -100.0, 40.0)], POINTS)
    m = features.feature_matrix(spark, pts, grid=SMALL)
    assert m.count() == 648 and {"hotspot_count", "tidal_heating_flux", "geology_unit", "dist_nearest_hotspot_km", "dist_tidal_stress_max_km"} <= set(m.columns)
    assert features.null_report(m).agg(F.sum("n_null")).first()[0] == 0 and features.overview(m).first()["n_positive"] == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    kinds = "name string, longitude double, latitude double, power_gw double"
    spark.createDataFrame([("a", 1.0, 1.0, 2.0), ("b", 1.2, 1.2, 3.0)], kinds).write.parquet(src)
    for _ in range(2):
        incremental.start_cell_power(spark.readStream.schema(kinds).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("c", 1.1, 1.1, 7.0)], kinds).write.mode("append").parquet(src)
    r = incremental.merged(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert [(x["power_count"], x["primary_power_gw"], x["sum_power_gw"]) for x in r] == [(3, 7.0, 12.0)]
