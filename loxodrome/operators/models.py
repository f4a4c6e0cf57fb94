"""Spatially blocked cross-validation, linear models from moments, exact metrics, leakage audit, ablation.

Models need only sums over rows: a ridge or elastic net is solved from one pass of second moments, a logistic
regression takes a pass for each Newton step, for all folds at once. What reaches the driver are matrices of the number of
features, whatever the number of rows.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.config import ANALYTICAL, COEFFICIENT_LIMIT, CORRELATION_LIMIT, CV_BANDS, FEATURES, SEED, TARGET_DERIVED
from loxodrome.functions import geo, special, stats
from loxodrome.functions.checks import require_columns
from loxodrome.functions.shared import saved
from loxodrome.operators import ranking, resample
from loxodrome.operators.rates import band_label
from loxodrome.sources import sinks


class LatitudeBands:
    """Folds by half-open latitude bands: a band is tested on what the others teach. Latitude 90 is in no test fold."""

    def __init__(self, bands=CV_BANDS):
        self.bands = tuple(bands)

    @property
    def n_splits(self) -> int:
        return len(self.bands)

    def assign(self, df: DataFrame, lat: str | None = "lat_centre", out: str = "fold") -> DataFrame:
        if lat is None or lat not in df.columns:
            raise ValueError("groups: a latitude column is needed to assign folds")
        return df.withColumn(out, F.coalesce(geo.band_of(lat, self.bands), F.lit(-1)))

    def split(self, df: DataFrame, lat: str | None = "lat_centre"):
        """Pairs of (train, test); an empty band is still yielded."""
        marked = self.assign(df, lat, "_fold")
        for k in range(self.n_splits):
            yield marked.filter(F.col("_fold") != k).drop("_fold"), marked.filter(F.col("_fold") == k).drop("_fold")

    def describe(self, df: DataFrame, lat: str = "lat_centre") -> DataFrame:
        """``fold, lat_band, n_cells, pct`` for each band."""
        counts = self.assign(df, lat).groupBy("fold").agg(F.count(F.lit(1)).alias("n_cells"))
        rows = [(k, band_label(*b[:2])) for k, b in enumerate(self.bands)]
        d = df.sparkSession.createDataFrame(rows, "fold int, lat_band string").join(counts, "fold", "left").na.fill(0, ["n_cells"])
        total = df.count()
        return d.withColumn("pct", F.col("n_cells") * 100.0 / max(total, 1)).orderBy("fold")


def _moments(df: DataFrame, columns: list[str], groups: list[Column]) -> list[dict]:
    """Count, means and population deviations of columns over the rows of each condition, in one pass."""
    aggs = []
    for g, cond in enumerate(groups):
        aggs.append(F.count(F.when(cond, F.lit(1))).alias(f"n_{g}"))
        for i, c in enumerate(columns):
            aggs += [F.avg(F.when(cond, F.col(c))).alias(f"m_{g}_{i}"), F.stddev_pop(F.when(cond, F.col(c))).alias(f"s_{g}_{i}")]
    r = df.agg(*aggs).first()
    return [{"n": r[f"n_{g}"], "mean": np.array([r[f"m_{g}_{i}"] or 0.0 for i in range(len(columns))]), "std": np.array([r[f"s_{g}_{i}"] or 1.0 for i in range(len(columns))])} for g in range(len(groups))]


def _scaled(columns: list[str], m: dict) -> list[Column]:
    return [(F.col(c) - F.lit(float(a))) / F.lit(float(s)) for c, a, s in zip(columns, m["mean"], m["std"], strict=True)]


def _conditions(folds: int) -> list[Column]:
    """Training rows of each fold, then all rows."""
    return [F.col("fold") != k for k in range(folds)] + [F.lit(True)]


#: Log odds at which a probability is certain in double precision: those of a model that saw a single class.
CERTAIN = 40.0


class Design(NamedTuple):
    """A logistic model to be fitted: which columns, which label, and the number of the condition that its rows meet."""

    columns: tuple[str, ...]
    label: str
    group: int


def fit_logistic(df: DataFrame, columns: list[str], label: str, groups: list[Column], c: float = 1.0, balanced: bool = True, steps: int = 60, tol: float = 1e-10) -> list[dict]:
    """One model for each condition of ``groups``, by :func:`fit_designs`."""
    return fit_designs(df, [Design(tuple(columns), label, k) for k in range(len(groups))], groups, c, balanced, steps, tol)


def fit_designs(df: DataFrame, designs: list[Design], groups: list[Column], c: float = 1.0, balanced: bool = True, steps: int = 60, tol: float = 1e-10) -> list[dict]:
    """L2-penalised logistic regressions on standardised columns, all of them in the same passes over the rows.

    Minimises C times the weighted log loss plus half the squared coefficients; the intercept is free. Newton's
    method with halved steps where the loss would rise; a pass serves every model that hasn't settled, whatever its columns,
    label and rows. Classes weigh the same with ``balanced``. The free
    intercept of a model of a single class goes to ``CERTAIN`` for that class, where the loss has its limit; its coefficients are 0.
    """
    names, labels = (list(dict.fromkeys(x)) for x in ([c for d in designs for c in d.columns], [d.label for d in designs]))
    parts = [F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(names)] + [F.col(x).cast("double").alias(f"y{i}") for i, x in enumerate(labels)]
    rows = df.select(*parts, *[g.alias(f"g{k}") for k, g in enumerate(groups)]).cache()
    try:
        inside = [F.col(f"g{k}") for k in range(len(groups))]
        moments = _moments(rows, [f"x{i}" for i in range(len(names))], inside)
        counts = rows.agg(*[F.sum(F.when(g, F.col(f"y{i}"))).alias(f"{k}_{i}") for k, g in enumerate(inside) for i in range(len(labels))]).first()
        models = []
        for d in designs:
            at, m = [names.index(x) for x in d.columns], moments[d.group]
            pos, size = counts[f"{d.group}_{labels.index(d.label)}"] or 0, len(at) + 1
            w = (m["n"] / (2.0 * pos), m["n"] / (2.0 * (m["n"] - pos))) if balanced and 0 < pos < m["n"] else (1.0, 1.0)
            start = {"beta": np.zeros(size), "tried": np.zeros(size), "size": 1.0, "loss": math.inf, "done": not 0 < pos < m["n"], "w": w}
            if start["done"] and m["n"]:
                start["beta"][0] = CERTAIN if pos else -CERTAIN
            models.append(start | {"at": at, "label": labels.index(d.label), "group": d.group, "n": m["n"], "mean": m["mean"][at], "std": m["std"][at]})
        for _ in range(steps):
            todo = {k: m for k, m in enumerate(models) if not m["done"]}
            if not todo:
                break
            for k, sums in _newton_sums(rows, todo, moments, len(names), len(labels)).items():
                _newton_step(models[k], sums, c, tol)
    finally:
        rows.unpersist()
    return [{"mean": m["mean"], "std": m["std"], "intercept": float(m["beta"][0]), "coef": m["beta"][1:], "n": m["n"]} for m in models]


def _newton_step(m: dict, sums: np.ndarray, c: float, tol: float) -> None:
    """Take the step that was tried, or go back half of it, by the sums of loss, gradient and Hessian at the tried point."""
    size = len(m["beta"])
    penalty = m["tried"].copy()
    penalty[0] = 0.0
    loss = c * sums[0] + 0.5 * penalty @ penalty
    if loss > m["loss"] + 1e-12 * max(1.0, abs(loss)) and m["size"] > 1e-6:
        m["size"] /= 2  # back towards the last good point
        m["tried"] = m["beta"] + m["size"] * m["step"]
        return
    m["beta"], m["loss"] = m["tried"], loss
    hessian = np.zeros((size, size))
    hessian[np.tril_indices(size)] = c * sums[size + 1 :]
    hessian = hessian + np.tril(hessian, -1).T + np.diag([1e-12, *[1.0] * (size - 1)])
    m["step"], m["size"] = -np.linalg.solve(hessian, c * sums[1 : size + 1] + penalty), 1.0
    m["done"] = bool(np.abs(m["step"]).max() < tol)
    m["tried"] = m["beta"] + m["step"]


def _newton_sums(rows: DataFrame, todo: dict[int, dict], moments: list[dict], n_columns: int, n_labels: int) -> dict[int, np.ndarray]:
    """Loss, gradient and lower half of the Hessian of each model: a partial sum a task, added up by Spark."""
    asked = {k: (m["at"], m["label"], m["group"], m["tried"], m["w"]) for k, m in todo.items()}
    scales = {m["group"]: (moments[m["group"]]["mean"], moments[m["group"]]["std"]) for m in todo.values()}

    def run(batches):
        total = {k: 0.0 for k in asked}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x, y = np.column_stack([np.ones(batch.num_rows), *columns[:n_columns]]), columns[n_columns : n_columns + n_labels]
            for g, (mean, std) in scales.items():
                mask = columns[n_columns + n_labels + g].astype(bool)
                scaled = x[mask]
                scaled[:, 1:] = (scaled[:, 1:] - mean) / std
                for k, (at, label, group, beta, (w1, w0)) in asked.items():
                    if group != g:
                        continue
                    own, t = scaled[:, [0, *(i + 1 for i in at)]], y[label][mask]
                    z = own @ beta
                    p, w = 1 / (1 + np.exp(-np.clip(z, -700, 700))), np.where(t == 1, w1, w0)
                    hessian = (own * (w * p * (1 - p))[:, None]).T @ own
                    total[k] = total[k] + np.concatenate([[(w * (np.logaddexp(0, z) - t * z)).sum()], own.T @ (w * (p - t)), hessian[np.tril_indices(len(beta))]])
        known = {k: v for k, v in total.items() if not np.isscalar(v)}
        if known:
            k, i = np.concatenate([np.full(len(v), k) for k, v in known.items()]), np.concatenate([np.arange(len(v)) for v in known.values()])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(np.concatenate(list(known.values())))], names=["k", "i", "v"])

    out = {k: np.zeros(1 + (n := len(m["beta"])) + n * (n + 1) // 2) for k, m in todo.items()}
    for r in rows.mapInArrow(run, "k long, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        out[r["k"]][r["i"]] = r["v"]
    return out


def probability(columns: list[str], model: dict) -> Column:
    """The model's probability; unknown values count as 0 before scaling only if the caller filled them so.

    The log odds are rounded to nine digits: rows that the model can't tell apart tie, whatever the order of the sums.
    """
    z = sum((F.lit(float(b)) * v for b, v in zip(model["coef"], _scaled(columns, model), strict=True)), F.lit(model["intercept"]))
    return 1.0 / (1.0 + F.exp(-F.round(z, 9)))


def fit_linear(df: DataFrame, columns: list[str], target: str, groups: list[Column], alpha: float = 1.0, kind: str = "ridge", l1_ratio: float = 0.2) -> list[dict]:
    """Ridge or elastic net on standardised columns, from second moments: two passes for all groups.

    Ridge: squared error plus alpha times squared coefficients. Elastic net: half the mean squared error plus alpha
    times (l1_ratio times absolute plus half of the rest times squared coefficients). The intercept is free.
    """
    if kind not in ("ridge", "elasticnet"):
        raise ValueError("model_type must be 'ridge' or 'elasticnet'")
    d, models = len(columns), _moments(df, columns, groups)
    aggs = []
    for k, g in enumerate(groups):
        x = _scaled(columns, models[k])
        on = lambda v, g=g: F.coalesce(F.sum(F.when(g, v)), F.lit(0.0))
        y = F.col(target).cast("double")
        aggs.append(F.array(on(y), *[on(a * y) for a in x], *[on(x[i] * x[j]) for i in range(d) for j in range(i + 1)]).alias(str(k)))
    row = df.agg(*aggs).first()
    out = []
    for k, m in enumerate(models):
        v, n = np.array(row[str(k)], float), max(m["n"], 1)
        gram = np.zeros((d, d))
        gram[np.tril_indices(d)] = v[d + 1 :]
        gram = gram + np.tril(gram, -1).T
        xy, mean = v[1 : d + 1], v[0] / n  # columns have mean 0, so the centred product is the plain one
        if kind == "ridge":
            beta = np.linalg.solve(gram + alpha * np.eye(d), xy)
        else:
            beta, a1, a2 = np.zeros(d), alpha * l1_ratio, alpha * (1 - l1_ratio)
            for _ in range(10_000):
                old = beta.copy()
                for j in range(d):
                    r = (xy[j] - gram[j] @ beta + gram[j, j] * beta[j]) / n
                    beta[j] = math.copysign(max(abs(r) - a1, 0.0), r) / (gram[j, j] / n + a2) if gram[j, j] / n + a2 > 0 else 0.0
                if np.abs(beta - old).max() < 1e-13:
                    break
        out.append({"mean": m["mean"], "std": m["std"], "intercept": float(mean), "coef": beta, "n": m["n"]})
    return out


def linear(columns: list[str], model: dict) -> Column:
    return sum((F.lit(float(b)) * v for b, v in zip(model["coef"], _scaled(columns, model), strict=True)), F.lit(model["intercept"]))


def _by_score(df: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """Distinct scores of each group with their counts and what stands above and below them."""
    counts = df.groupBy(F.col(by).alias("g"), F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(label).cast("long")).alias("tp"))
    return ranking.running(counts, "s", {"c": "below", "tp": "tp_below"}, by=("g",))


def ranking_metrics(df: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """Per group: AUC by midranks and average precision by steps, exact under ties; null for a single class."""
    s = _by_score(df, score, label, by)
    totals = s.groupBy("g").agg(F.sum("tp").alias("p"), F.sum("c").alias("n"))
    d = s.join(F.broadcast(totals), "g")
    above, tp_above = F.col("n") - F.col("below"), F.col("p") - F.col("tp_below")
    d = d.groupBy("g").agg(
        F.first("p").alias("p"),
        F.first("n").alias("n"),
        F.sum(F.col("tp") * (F.col("below") + (F.col("c") + 1) / 2.0)).alias("rank_sum"),
        F.sum(F.col("tp") / F.nullif("p", F.lit(0)) * tp_above / above).alias("pr_auc"),
    )
    neg = F.col("n") - F.col("p")
    auc = (F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * neg, F.lit(0))
    both = (F.col("p") > 0) & (neg > 0)
    return d.select(F.col("g").alias(by), F.when(both, auc).alias("auc_roc"), F.when(both, F.col("pr_auc")).alias("pr_auc"))


def class_metrics(df: DataFrame, score: str, label: str, by: str, inclusive: bool = False) -> DataFrame:
    """Per group: counts, precision, recall, F1, Brier score and Matthews correlation at one half."""
    said = F.col(score) >= 0.5 if inclusive else F.col(score) > 0.5
    y = F.col(label) == 1
    n = lambda c: F.sum(c.cast("long"))
    d = df.groupBy(by).agg(n(said & y).alias("tp"), n(said & ~y).alias("fp"), n(~said & y).alias("fn"), n(~said & ~y).alias("tn"), F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return d.select(
        by,
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_test"),
        (F.col("tp") + F.col("fn")).alias("n_positive_test"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        "brier",
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def fold_metrics(df: DataFrame, score: str = "probability", label: str = "has_hotspot", by: str = "fold") -> DataFrame:
    return class_metrics(df, score, label, by).join(ranking_metrics(df, score, label, by), by, "left").orderBy(by)


def calibration(df: DataFrame, score: str, label: str, by: str, bins: int = 10) -> DataFrame:
    """Per group and quantile bin: mean score and share of positives. Equal edges make one bin; empty bins are left out."""
    named = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = ranking.quantiles(df, [by], score, named).select(by, F.array_distinct(F.array(*named)).alias("_e"))
    d = df.join(F.broadcast(edges), by)  # a row for each group
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    d = d.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(score))))
    return d.groupBy(by, "bin").agg(F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("fraction_positive"), F.count(F.lit(1)).alias("n")).orderBy(by, "bin")


def precision_recall(df: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """``by, threshold, precision, recall`` at every distinct score."""
    s = _by_score(df, score, label, by)
    totals = s.groupBy("g").agg(F.sum("tp").alias("p"), F.sum("c").alias("n"))
    d = s.join(F.broadcast(totals), "g")
    hits = F.col("p") - F.col("tp_below")
    return d.select(F.col("g").alias(by), F.col("s").alias("threshold"), (hits / (F.col("n") - F.col("below"))).alias("precision"), (hits / F.nullif("p", F.lit(0))).alias("recall"))


def cross_validated(df: DataFrame, columns: list[str], label: str, cv: LatitudeBands | None = None) -> tuple[DataFrame, list[dict]]:
    """Rows of all test folds with ``fold`` and out-of-fold ``probability``; the folds' models and the one of all rows."""
    cv = cv or LatitudeBands()
    marked = cv.assign(df.withColumns({c: F.col(c).cast("double") for c in columns}))
    models = fit_logistic(marked.select("fold", label, *columns), columns, label, _conditions(cv.n_splits))
    p = None
    for k, m in enumerate(models[:-1]):
        p = F.when(F.col("fold") == k, probability(columns, m)) if p is None else p.when(F.col("fold") == k, probability(columns, m))
    return marked.filter("fold >= 0").withColumn("probability", p), models


def train(df: DataFrame, columns=FEATURES, label: str = "has_hotspot", cv: LatitudeBands | None = None) -> tuple[dict, DataFrame, list[tuple[str, float, bool]]]:
    """The model of all rows, metrics by fold, and coefficients (greatest first) with those that look like leakage.

    Null features aren't filled here: they raise.
    """
    columns = list(columns)
    require_columns(df, [*columns, label, "lat_centre"], "feature matrix")
    held = saved(df.select(*dict.fromkeys([*columns, label, "lat_centre"])))
    bad = held.filter(sum(((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in columns), F.lit(0)) > 0)
    if bad.limit(1).count():
        raise ValueError("features hold unknown values")
    rows, models = cross_validated(held, columns, label, cv)
    final = models[-1] | {"columns": columns}
    audit = sorted(((c, float(b), abs(b) >= COEFFICIENT_LIMIT) for c, b in zip(columns, final["coef"], strict=True)), key=lambda r: -r[1])
    metrics = fold_metrics(rows, label=label)
    metrics = df.sparkSession.createDataFrame(metrics.collect(), metrics.schema)  # a row for each fold
    return final, metrics, audit


def validate(df: DataFrame, columns=FEATURES, label: str = "has_hotspot", cv: LatitudeBands | None = None) -> dict[str, DataFrame]:
    """Per fold Brier and Matthews scores (null with a note for a single class), calibration and precision-recall."""
    rows, _ = cross_validated(ranking.median_filled(df, list(columns)), list(columns), label, cv)
    rows = rows.cache()
    m = class_metrics(rows, "probability", label, "fold", inclusive=True)
    both = (F.col("n_positive_test") > 0) & (F.col("n_positive_test") < F.col("n_test"))
    scores = m.select("fold", F.when(both, F.col("brier")).alias("brier"), F.when(both, F.col("mcc")).alias("mcc"), F.when(~both, F.lit("single-class test fold")).alias("note"))
    usable = rows.join(F.broadcast(m.filter(both).select("fold")), "fold")
    return {"scores": scores.orderBy("fold"), "calibration": calibration(usable, "probability", label, "fold"), "precision_recall": precision_recall(usable, "probability", label, "fold")}


def feature_sets(columns=FEATURES) -> dict[str, list[str]]:
    free = [c for c in columns if c not in TARGET_DERIVED]
    return {"all": list(columns), "no_leakage": free, "geology_only": ["geology_encoded"], "tidal_only": ["tidal_heating_flux"], "null": list(free)}


_SUMMED = ("precision", "recall", "f1", "auc_roc", "pr_auc")


def ablation_folds(df: DataFrame, sets: dict[str, list[str]] | None = None, label: str = "has_hotspot", key: str = "cell_id", seed: int = SEED, cv: LatitudeBands | None = None) -> DataFrame:
    """``feature_set, fold`` with the metrics of each test fold. ``null`` learns shuffled labels.

    The models of all sets and folds are fitted in one loop, and all their metrics come from the same passes.
    """
    cv, sets = cv or LatitudeBands(), sets or feature_sets()
    used = sorted({c for s in sets.values() for c in s})
    d, shuffled = saved(cv.assign(df.select(*dict.fromkeys([key, label, "lat_centre", *used])))), f"{label}_shuffled"
    if "null" in sets:
        d = saved(resample.permuted(d.withColumn(shuffled, F.col(label)), shuffled, key, seed))
    filled = ranking.median_filled(d, used)
    label_of = {n: shuffled if n == "null" else label for n in sets}
    designs = [Design(tuple(c), label_of[n], k) for n, c in sets.items() for k in range(cv.n_splits)]
    models = fit_designs(filled, designs, _conditions(cv.n_splits)[:-1])
    scored = []
    for i, (name, columns) in enumerate(sets.items()):
        p = F.lit(None).cast("double")
        for k in range(cv.n_splits):
            p = F.when(F.col("fold") == k, probability(columns, models[i * cv.n_splits + k])).otherwise(p)
        scored.append(F.struct(F.lit(i * cv.n_splits).alias("set"), F.col(label_of[name]).cast("int").alias("y"), p.alias("p")))
    rows = filled.filter("fold >= 0").select("fold", F.inline(F.array(*scored)))
    rows = saved(rows.select((F.col("set") + F.col("fold")).alias("model"), "y", "p"))
    found = fold_metrics(rows, "p", "y", "model").collect()  # a row for each set and fold
    names = list(sets)
    measures = [c for c in found[0].asDict() if c != "model"] if found else [*_SUMMED]
    table = [(names[r["model"] // cv.n_splits], r["model"] % cv.n_splits, *[r[c] for c in measures]) for r in found]
    kinds = ", ".join(f"{c} {'long' if c.startswith('n_') else 'double'}" for c in measures)
    return df.sparkSession.createDataFrame(table, f"feature_set string, fold int, {kinds}")


def ablation(df: DataFrame, sets: dict[str, list[str]] | None = None, label: str = "has_hotspot", key: str = "cell_id", seed: int = SEED, cv: LatitudeBands | None = None) -> DataFrame:
    """``feature_set`` with each metric's mean and population deviation over folds, without those that a fold doesn't have."""
    folds = ablation_folds(df, sets, label, key, seed, cv)
    out = folds.groupBy("feature_set").agg(*[f(c).alias(f"{c}_{n}") for c in _SUMMED for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return out.withColumns({"is_leaky_baseline": F.col("feature_set") == "all", "is_null_sanity_check": F.col("feature_set") == "null"})


def variability(table: DataFrame) -> DataFrame:
    """The ablation table as a report: AUC and its spread, one row for each set."""
    return table.select("feature_set", *[f"{c}_{n}" for c in ("auc_roc", "pr_auc", "f1") for n in ("mean", "std")], "is_leaky_baseline", "is_null_sanity_check")


def leakage_audit(df: DataFrame, columns=FEATURES, label: str = "has_hotspot", corr_limit: float = CORRELATION_LIMIT, coef_limit: float = COEFFICIENT_LIMIT) -> DataFrame:
    """Per feature: where it comes from, both correlations with the label, its coefficient, and why it is suspect.

    Correlations are NaN where the feature or the label is constant. That clears no feature: it is suspect, as in SQL, where NaN is above all limits.
    """
    columns = list(columns)
    rows, df = [], df.select(label, *columns).cache()
    filled = ranking.median_filled(df, columns)
    model = fit_logistic(filled.select(label, *columns), columns, label, [F.lit(True)])[0]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.expr(f"try_cast(`{c}` as double)").alias("x")) for c in columns])
    known = df.select(F.inline(pairs), F.col(label).cast("double").alias("y")).filter("x is not null and not isnan(x) and y is not null")
    sums = {r["feature"]: r for r in known.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), stats.correlation("x", "y").alias("r")).collect()}
    usable = {c for c, r in sums.items() if r["n"] >= 2}
    rhos = {r["feature"]: r["rho"] for r in ranking.spearman(known.filter(F.col("feature").isin(*usable)), "x", "y", by=("feature",)).collect()} if usable else {}
    for c, b in zip(columns, model["coef"], strict=True):  # a few features
        r, rho = (sums[c]["r"], rhos[c]) if c in usable else (None, None)
        why = ["target-derived by construction"] * (c in TARGET_DERIVED)
        why += [f"|r|={abs(r):.2f} ≥ {corr_limit}"] * (r is not None and not abs(r) < corr_limit)
        why += [f"|coef|={abs(b):.2f} ≥ {coef_limit}"] * bool(abs(b) >= coef_limit)
        origin = "target-derived (from hotspot catalogue)" if c in TARGET_DERIVED else "analytical proxy (not observed)" if c in ANALYTICAL else "observed / external"
        rows.append((c, origin, r, rho, float(b), abs(float(b)), bool(why), "; ".join(why)))
    kinds = "feature string, derivation_source string, pearson_r double, spearman_r double, lr_coef double, abs_coef double, suspected_leakage boolean, flag_reason string"
    return df.sparkSession.createDataFrame(rows, kinds).orderBy(F.col("abs_coef").desc(), "feature")


def regression_metrics(df: DataFrame, y: str, p: str) -> dict:
    """R², RMSE, MAE and rank correlation with its p-value."""
    m = _regression_metrics(df, y, p)[()]
    return {k: v for k, v in m.items() if k != "n"}


def _regression_metrics(df: DataFrame, y: str, p: str, by: tuple[str, ...] = ()) -> dict[tuple, dict]:
    """The metrics of each group, all groups in the same passes."""
    d = df.select(*by, F.col(y).alias("y"), F.col(p).alias("p"))
    e = F.col("y") - F.col("p")
    sums = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y").alias("v")).collect()
    key = lambda r: tuple(r[c] for c in by)
    rhos = {key(r): r["rho"] for r in ranking.spearman(d, "y", "p", buckets=16, by=by).collect()} if any(s["n"] > 1 for s in sums) else {}
    out = {}
    for s in sums:
        if not s["n"]:
            out[key(s)] = {"n": 0} | dict.fromkeys(("r2", "rmse", "mae", "spearman", "spearman_p"), math.nan)
            continue
        rho = rhos.get(key(s)) if s["n"] > 1 else None
        rho = math.nan if rho is None else rho
        r2 = math.nan if s["n"] < 2 else (1.0 - s["mse"] / s["v"] if s["v"] else (1.0 if s["mse"] == 0 else 0.0))
        out[key(s)] = {"n": s["n"], "r2": r2, "rmse": math.sqrt(s["mse"]), "mae": s["mae"], "spearman": rho, "spearman_p": special.correlation_p(rho, s["n"])}
    return out


_POWER = ("cell_id", "power_count", "primary_power_gw", "mean_power_gw", "sum_power_gw", "log_primary_power")


def power_regression(fm: DataFrame, power: DataFrame, columns=None, model_type: str = "ridge", alpha: float = 1.0, cv: LatitudeBands | None = None) -> dict:
    """Log power from features that don't leak, tested by latitude band: fold metrics, overall metrics, residuals."""
    columns = list(columns or [c for c in FEATURES if c not in TARGET_DERIVED])
    leaky = sorted(set(columns) & set(TARGET_DERIVED))
    if leaky:
        raise ValueError(f"refusing leakage features: {', '.join(leaky)}")
    if model_type not in ("ridge", "elasticnet"):
        raise ValueError("model_type must be 'ridge' or 'elasticnet'")
    require_columns(power, _POWER, "power grid")
    require_columns(fm, ["cell_id", *columns], "feature matrix")
    place = [c for c in ("lat_centre", "lon_centre", "geology_unit") if c in fm.columns]
    extra = [c for c in power.columns if c in (*_POWER, "power_names")]
    d = power.filter("power_count > 0").select(*extra).join(fm.select("cell_id", *dict.fromkeys([*place, *columns])), "cell_id")
    if not d.limit(1).count():
        raise ValueError("no cells with power and features")
    cv = cv or LatitudeBands()
    d = saved(cv.assign(ranking.median_filled(d, columns)))
    models = fit_linear(d, columns, "log_primary_power", _conditions(cv.n_splits)[:-1], alpha, model_type)
    p = None
    for k, m in enumerate(models):
        here = (F.col("fold") == k) & F.lit(m["n"] > 0)
        p = F.when(here, linear(columns, m)) if p is None else p.when(here, linear(columns, m))
    out = d.withColumn("predicted_log_power", p).filter("predicted_log_power is not null").withColumnRenamed("log_primary_power", "observed_log_power")
    out = out.withColumn("residual_log_power", F.col("observed_log_power") - F.col("predicted_log_power"))
    out = saved(out)  # every figure reads it
    found = {k: m for (k,), m in _regression_metrics(out, "observed_log_power", "predicted_log_power", ("fold",)).items()}
    if not found:
        raise ValueError("spatial folds gave no residuals")
    folds = []
    for k in sorted(found):
        n_test = found[k].pop("n")
        folds.append(found[k] | {"fold": k, "lat_band": band_label(*cv.bands[k][:2]), "n_train": int(models[k]["n"]), "n_test": n_test})
    summary = {}
    for key in ("r2", "rmse", "mae", "spearman"):
        v = [f[key] for f in folds if math.isfinite(f[key])]
        summary[key] = {"mean": float(np.mean(v)) if v else math.nan, "std": float(np.std(v)) if v else math.nan}
    return {
        "model_type": model_type,
        "alpha": alpha,
        "target": "log1p(primary_power_gw)",
        "features": columns,
        "excluded_leakage_features": list(TARGET_DERIVED),
        "n_observed_power_cells": d.count(),
        "folds": folds,
        "summary": summary,
        "overall_oof": regression_metrics(out, "observed_log_power", "predicted_log_power"),
        "residuals": out,
    }


def save_model(model: dict, path: str) -> None:
    """As JSON, wherever Spark's file systems reach."""
    text = json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in model.items()}, indent=2)
    sinks.text_file(SparkSession.active(), text, str(path))


def load_model(path: str) -> dict:
    read = json.loads(sinks.read_text(SparkSession.active(), str(path)))
    return {k: np.array(v) if k in ("mean", "std", "coef") else v for k, v in read.items()}


def score_surface(df: DataFrame, model: dict, out: str = "probability") -> DataFrame:
    """Cells with the model's probability; unknown features count as 0."""
    columns = model["columns"]
    zero = df.withColumns({f"_f_{c}": F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in columns})
    return zero.withColumn(out, probability([f"_f_{c}" for c in columns], model)).drop(*[f"_f_{c}" for c in columns])
