"""Estimators as grouped maps over Spark frames: LASSO by coordinate descent, network neighbours, consensus of layers, OLS.

A group is one target under one fold; its rows are the experiment's conditions. Thousands of small fits are one job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyomics.operators import matrix, stats

MAX_ITER = 10_000


def own_feature_ols(xy: DataFrame, fold: DataFrame) -> DataFrame:
    """fold, target, slope, intercept, n of y on x over the rows of other folds; null for fewer than three, or x with sd below 1e-12.

    ``xy``: condition_key, target, x, y. The sums of a fold are those of all rows minus its own, so no row is read once per fold."""
    z = xy.where("x is not null and y is not null").join(fold, "condition_key")
    moments = {"n": F.count("*"), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(F.col("x") * F.col("x")), "sxy": F.sum(F.col("x") * F.col("y"))}
    own = z.groupBy("fold", "target").agg(*[e.alias(k) for k, e in moments.items()])
    total = own.groupBy("target").agg(*[F.sum(k).alias(f"t_{k}") for k in moments])
    t = fold.select("fold").distinct().join(F.broadcast(total)).join(own, ["fold", "target"], "left")
    t = t.select("fold", "target", *[(F.col(f"t_{k}") - F.coalesce(k, F.lit(0))).alias(k) for k in moments])
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    sound = (F.col("n") >= stats.LEAST_PAIRS) & (F.sqrt(F.greatest(vx, F.lit(0.0)) / F.col("n")) >= stats.CONSTANT)
    slope = F.when(sound, F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), vx))
    return t.withColumn("slope", slope).select("fold", "target", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), "n")


def _descend(gram: np.ndarray, xy: np.ndarray, alpha: float, b: np.ndarray, tol: float) -> bool:
    """Cyclic coordinate descent on ``b`` in place, from the means of products of scaled features and with the target."""
    live = np.flatnonzero(np.diag(gram) > 0)
    rest = xy - gram @ b
    for _ in range(MAX_ITER):
        most = 0.0
        for j in live:
            old, g = b[j], gram[j, j]
            rho = rest[j] + g * old
            b[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / g
            if b[j] != old:
                rest += gram[j] * (old - b[j])
                most = max(most, abs(b[j] - old))
        if most <= tol * max(1.0, np.abs(b).max(initial=0.0)):
            return True
    return False


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mu, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    return (x - mu) / sd, mu, sd


def _path(gram: np.ndarray, xy: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Penalties from the largest of use down to ``least`` and the coefficients at each, between which the optimum is linear.

    As the penalty falls, coefficients move along the direction that keeps the correlations of those in use equal to it, until another
    joins or one of them passes 0."""
    k = len(xy)
    b, c = np.zeros(k), xy.astype(float).copy()
    alpha = np.abs(c).max(initial=0.0)
    alphas, betas = [alpha], [b.copy()]
    used = np.zeros(k, bool)
    if alpha > 0:
        used[np.abs(c).argmax()] = True
    left = -1
    for _ in range(8 * k + 8):
        if alpha <= least or not used.any():
            break
        d = np.zeros(k)
        d[used] = np.linalg.lstsq(gram[np.ix_(used, used)], np.sign(c[used]), rcond=1e-12)[0]
        a = gram @ d
        with np.errstate(divide="ignore", invalid="ignore"):
            joins = np.minimum(*(np.where(g > 1e-12, g, np.inf) for g in ((alpha - c) / (1 - a), (alpha + c) / (1 + a))))
            ends = np.where(used & (d * b < 0), -b / d, np.inf)
        joins[used | ~np.isfinite(joins)] = np.inf
        if left >= 0:
            joins[left] = np.inf
        step = min(joins.min(), ends.min(), alpha - least)
        b, c, alpha = b + step * d, c - step * a, alpha - step
        left = -1
        if step == ends.min():
            left = int(ends.argmin())
            b[left], used[left] = 0.0, False
        elif step == joins.min():
            used[joins.argmin()] = True
        alphas.append(alpha)
        betas.append(b.copy())
    return np.array(alphas), np.array(betas)


def _at(path: tuple[np.ndarray, np.ndarray], alpha: float) -> np.ndarray:
    alphas, betas = path
    i = int(np.searchsorted(-alphas, -alpha))
    if i == 0 or i == len(alphas):
        return betas[min(i, len(alphas) - 1)].copy()
    span = alphas[i - 1] - alphas[i]
    share = (alphas[i - 1] - alpha) / span if span > 0 else 1.0
    return betas[i - 1] + share * (betas[i] - betas[i - 1])


def lasso(x: np.ndarray, y: np.ndarray, alpha: float, tol: float = 1e-10) -> tuple[np.ndarray, float, bool]:
    """Coefficients on scaled features, intercept and whether it converged: least squares / 2n + alpha * L1, on features of mean 0 and
    population sd 1. Constant features get 0. What the path gives is checked, and mended where features are alike, by coordinate descent."""
    z, _, _ = _scaled(x)
    gram, xy = z.T @ z / len(y), z.T @ (y - y.mean()) / len(y)
    b = _at(_path(gram, xy, alpha), alpha)
    b[np.diag(gram) <= 0] = 0.0
    return b, float(y.mean()), _descend(gram, xy, alpha, b, tol)


def chosen_alpha(x: np.ndarray, y: np.ndarray, parts: int, n_alphas: int = 100, eps: float = 1e-3) -> float:
    """Of ``n_alphas`` penalties on a logarithmic scale from the smallest that leaves no feature, the one of least squared error over
    contiguous folds."""
    top = np.abs(_scaled(x)[0].T @ (y - y.mean())).max() / len(y)
    if top <= 0:
        return 1e-3
    grid, error = np.geomspace(top, top * eps, n_alphas), np.zeros(n_alphas)
    for test in np.array_split(np.arange(len(y)), parts):
        train = np.setdiff1d(np.arange(len(y)), test)
        z, mu, sd = _scaled(x[train])
        c = y[train].mean()
        path = _path(z.T @ z / len(train), z.T @ (y[train] - c) / len(train), grid[-1])
        b = np.array([_at(path, a) for a in grid])
        error += (((y[test] - c)[:, None] - (x[test] - mu) / sd @ b.T) ** 2).sum(0)
    return float(grid[int(error.argmin())])


def fit_lasso(x: np.ndarray, y: np.ndarray, alpha: float | None = None, cv_max: int = 3, min_for_cv: int = 5) -> tuple[np.ndarray, float, str | None]:
    """As :func:`lasso`, the penalty chosen by cross-validation where there are enough rows; the third is what went wrong, if it did."""
    a = alpha if alpha is not None else chosen_alpha(x, y, min(cv_max, len(y))) if len(y) >= min_for_cv else 1e-3
    b, c, ok = lasso(x, y, a)
    return b, c, None if ok else f"no convergence in {MAX_ITER} rounds at alpha {a:.3g}"


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by group over all shuffle partitions: they are few bytes but much work, so they must not be put together for their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def neighbour_lasso(features: DataFrame, targets: DataFrame, edges: DataFrame, fold: DataFrame, alpha: float | None = None, most: int = 200) -> DataFrame:
    """arm, fold, condition_key, target, y, y_hat, error: each target from its network neighbours, per arm and fold.

    ``features`` and ``targets``: condition_key, molecule_id, value; ``edges``: arm, target, feature. A target uses the ``most``
    neighbours of largest variance over the training rows (ties by id); missing features count 0; fewer than three finite targets give
    no model. y_hat is null where there is none, error says why: ``few`` or no convergence. Leaky arms are fitted like any other."""
    f = features.select("condition_key", F.col("molecule_id").alias("feature"), F.col("value").alias("x"))
    var = f.join(fold, "condition_key").groupBy("fold", "feature").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("x").alias("n"))
    total = var.groupBy("feature").agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"), F.sum("n").alias("tn"))
    every = fold.select("fold").distinct()
    v = total.join(F.broadcast(every)).join(var, ["fold", "feature"], "left")
    n, s, q = (F.col(f"t{c}") - F.coalesce(c, F.lit(0)) for c in ("n", "s", "q"))
    v = v.select("fold", "feature", (F.try_divide(q, n) - F.pow(F.try_divide(s, n), 2)).alias("variance"))
    w = Window.partitionBy("arm", "fold", "target").orderBy(F.col("variance").desc_nulls_last(), "feature")
    used = edges.select("arm", "target", "feature").distinct().join(v, "feature").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    x = used.join(f, "feature").groupBy("arm", "fold", "target", "condition_key").agg(F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("x"))
    y = targets.select("condition_key", F.col("molecule_id").alias("target"), F.col("value").alias("y"))
    rows = x.join(y, ["condition_key", "target"], "left").join(fold.withColumnRenamed("fold", "own"), "condition_key").withColumn("test", F.col("own") == F.col("fold"))
    kind = dict(targets.dtypes)["molecule_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("condition_key")
        names = sorted({k for m in pdf["x"] for k in m})
        m = np.array([[r.get(k) if r.get(k) is not None else 0.0 for k in names] for r in pdf["x"]], float)
        m[~np.isfinite(m)] = 0.0
        t, test = pdf["y"].to_numpy(float), pdf["test"].to_numpy(bool)
        train = ~test & np.isfinite(t)
        out = pdf.loc[test, ["arm", "fold", "condition_key", "target", "y"]].assign(y_hat=None, error="few")
        if train.sum() >= 3:
            b, c, error = fit_lasso(m[train], t[train], alpha)
            sd = m[train].std(0)
            if error is None:
                out["y_hat"] = c + (m[test] - m[train].mean(0)) / np.where(sd > 0, sd, 1.0) @ b
            out["error"] = error
        return out

    rows = _spread(rows, "arm", "fold", "target")
    return rows.groupBy("arm", "fold", "target").applyInPandas(one, f"arm string, fold {dict(fold.dtypes)['fold']}, condition_key string, target {kind}, y double, y_hat double, error string")


def coefficients(features: DataFrame, targets: DataFrame, edges: DataFrame, alpha: float | None = None) -> DataFrame:
    """arm, target, feature, coefficient: the non-zero coefficients on scaled features of each target's fit over all conditions, largest
    first."""
    f = features.select("condition_key", F.col("molecule_id").alias("feature"), F.col("value").alias("x"))
    x = edges.select("arm", "target", "feature").distinct().join(f, "feature").groupBy("arm", "target", "condition_key").agg(F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("x"))
    rows = x.join(targets.select("condition_key", F.col("molecule_id").alias("target"), F.col("value").alias("y")), ["condition_key", "target"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf["y"].to_numpy(float))].sort_values("condition_key")
        if len(pdf) < 3:
            return pd.DataFrame()
        names = sorted({k for m in pdf["x"] for k in m})
        m = np.nan_to_num(np.array([[r.get(k) if r.get(k) is not None else 0.0 for k in names] for r in pdf["x"]], float))
        b, _, error = fit_lasso(m, pdf["y"].to_numpy(float), alpha)
        out = pd.DataFrame({"arm": pdf["arm"].iloc[0], "target": pdf["target"].iloc[0], "feature": names, "coefficient": b})
        return out[(out["coefficient"] != 0) & (error is None)]

    t = dict(targets.dtypes)["molecule_id"]
    fits = rows.groupBy("arm", "target").applyInPandas(one, f"arm string, target {t}, feature {dict(features.dtypes)['molecule_id']}, coefficient double")
    return fits.orderBy("arm", "target", F.abs("coefficient").desc(), "feature")


def metabolite_edges(targets: DataFrame, measured: DataFrame, enzymes: DataFrame | None, arm: str) -> DataFrame:
    """arm, target, feature: each metabolite with its measured enzymes; with all measured molecules where it has none, or without a
    map. ``targets``: target; ``measured``: molecule_id; ``enzymes``: metabolite, enzyme. Both sides are axes, not data."""
    m = measured.select(F.col("molecule_id").alias("feature")).distinct()
    t = targets.select("target").distinct()
    if enzymes is None:
        return t.join(F.broadcast(m)).select(F.lit(arm).alias("arm"), "target", "feature")
    own = enzymes.select(F.col("metabolite").alias("target"), F.col("enzyme").alias("feature")).distinct().join(m, "feature", "left_semi").join(t, "target", "left_semi")
    free = t.join(own, "target", "left_anti").join(F.broadcast(m))
    return own.select("target", "feature").unionByName(free.select("target", "feature")).select(F.lit(arm).alias("arm"), "target", "feature")


def metabolome_module(targets: DataFrame, proteins: DataFrame, transcripts: DataFrame, core: DataFrame, fold: DataFrame, enzymes: DataFrame | None = None, alpha: float | None = None) -> DataFrame:
    """The columns of :func:`neighbour_lasso`: core metabolites (``core``: molecule_id) from proteins, arm ``core``, all others from
    transcripts, arm ``noncore``. The three layers: condition_key, molecule_id, value; ``enzymes`` restricts features as in
    :func:`metabolite_edges`."""
    names = targets.select(F.col("molecule_id").alias("target")).distinct()
    c = core.select(F.col("molecule_id").alias("target")).distinct()
    each = []
    for arm, features, own in (("core", proteins, names.join(c, "target", "left_semi")), ("noncore", transcripts, names.join(c, "target", "left_anti"))):
        y = targets.join(own.withColumnRenamed("target", "molecule_id"), "molecule_id", "left_semi")
        each.append(neighbour_lasso(features, y, metabolite_edges(own, features, enzymes, arm), fold, alpha))
    return each[0].unionByName(each[1])


def starting_profiles(long: DataFrame, conditions: DataFrame, strategy: str, strain: str = "", media: DataFrame | None = None) -> DataFrame:
    """condition_key, molecule_id, value: the state a prediction starts from.

    ``non_specific``: the mean of the profiles of ``strain`` on LB or M9 without stress or perturbation (:func:`matrix.strict_wild_type`;
    ``media``: medium_id, base_medium, description); without any, or without ``media``, that of the condition with the most profiles,
    ties to the smaller key. ``specific``: that of the profiles with the condition's strain and medium; ``same_batch``: that of its own
    key; where one of these two finds no profile the mean of all serves. ``conditions``: condition_key; ``long`` are training rows only."""
    part = lambda k: F.split_part("condition_key", F.lit("."), F.lit(k))
    keys = conditions.select("condition_key").distinct().withColumn("place", F.concat_ws(".", part(1), part(2)))
    rows = long.withColumn("place", F.concat_ws(".", part(1), part(2)))
    mean = F.avg("value").alias("own")
    if strategy == "non_specific":
        wild = None if media is None else matrix.strict_wild_type(long, strain, media)
        if wild is None or wild.isEmpty():
            most = long.groupBy("condition_key").agg(F.count_distinct("profile_id").alias("n")).agg(F.min(F.struct(-F.col("n"), F.col("condition_key")))["condition_key"].alias("condition_key"))
            wild = long.join(most, "condition_key", "left_semi")
        return keys.crossJoin(wild.groupBy("molecule_id").agg(mean)).select("condition_key", "molecule_id", F.col("own").alias("value"))  # conditions by the axis
    by = {"specific": "place", "same_batch": "condition_key"}[strategy]
    found = keys.join(rows.select(by).distinct(), by, "left_semi")
    own = found.join(rows.groupBy(by, "molecule_id").agg(mean), by).select("condition_key", "molecule_id", F.col("own").alias("value"))
    every = long.groupBy("molecule_id").agg(F.avg("value").alias("value"))
    return own.unionByName(keys.join(found, "condition_key", "left_anti").crossJoin(every).select("condition_key", "molecule_id", "value"))


def consensus_weights(vectors: DataFrame, fold: DataFrame, inner: int = 3, seed: int = 0) -> DataFrame:
    """fold, layer, weight, condition_key, y, y_hat: per outer fold the layers' predictions of its conditions with their weights.

    ``vectors``: layer, condition_key, y, values. A layer is fitted on complete training rows (at least four); its weight is the mean
    correlation over shuffled inner folds (from six rows), at least 0. Weights are normalised over layers, equal if all are 0; the
    consensus is :func:`stats.consensus` of what this gives."""
    rows = vectors.join(fold.withColumnRenamed("fold", "own"), "condition_key").join(F.broadcast(fold.select("fold").distinct())).withColumn("test", F.col("own") == F.col("fold"))

    def pcc(a: np.ndarray, b: np.ndarray) -> float:
        return float(np.corrcoef(a, b)[0, 1]) if len(a) >= 3 and a.std() > 1e-12 and b.std() > 1e-12 else 0.0

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("condition_key")
        x = np.array([[np.nan if v is None else v for v in r] for r in pdf["values"]], float)
        y, test = pdf["y"].to_numpy(float), pdf["test"].to_numpy(bool)
        full = np.isfinite(x).all(1)
        train = np.flatnonzero(~test & full & np.isfinite(y))
        out = pdf.loc[test, ["fold", "layer", "condition_key", "y"]].assign(y_hat=np.nan, raw_weight=0.0)
        if len(train) >= 4:
            def predict(fit: np.ndarray, to: np.ndarray) -> np.ndarray:
                b, c, _ = fit_lasso(x[fit], y[fit], None, 4)
                sd = x[fit].std(0)
                return c + (x[to] - x[fit].mean(0)) / np.where(sd > 0, sd, 1.0) @ b

            hat = np.full(len(pdf), np.nan)
            ok = np.flatnonzero(test & full)
            hat[ok] = predict(train, ok) if len(ok) else []
            out["y_hat"] = hat[test]
            if len(train) >= 6:
                parts = np.array_split(np.random.RandomState(seed).permutation(len(train)), inner)
                scores = [pcc(y[train[p]], predict(np.delete(train, p), train[p])) for p in parts]
                out["raw_weight"] = max(float(np.mean(scores)), 0.0)
        return out.astype(object).where(out.notna(), None)

    keep = ["fold", "layer", "condition_key", "y", "values", "test"]
    p = _spread(rows.select(*keep), "fold", "layer").groupBy("fold", "layer").applyInPandas(one, f"fold {dict(fold.dtypes)['fold']}, layer string, condition_key string, y double, y_hat double, raw_weight double")
    per = p.groupBy("fold", "layer").agg(F.max("raw_weight").alias("raw"))
    total = Window.partitionBy("fold")
    weight = F.when(F.sum("raw").over(total) > 0, F.col("raw") / F.sum("raw").over(total)).otherwise(1 / F.count("*").over(total))
    return p.drop("raw_weight").join(per.withColumn("weight", weight).drop("raw"), ["fold", "layer"])


def growth_calibration(pairs: DataFrame, by: list[str]) -> DataFrame:
    """slope and intercept of growth on biomass per ``by``, from at least three pairs whose biomass spans 1e-12; else null. Predict with
    :func:`calibrated`."""
    n = F.regr_count("growth", "biomass")
    sound = (n >= 3) & (F.max(F.when(F.col("growth").isNotNull(), F.col("biomass"))) - F.min(F.when(F.col("growth").isNotNull(), F.col("biomass"))) >= 1e-12)
    return pairs.groupBy(*by).agg(F.when(sound, F.regr_slope("growth", "biomass")).alias("slope"), F.when(sound, F.regr_intercept("growth", "biomass")).alias("intercept"))


def calibrated(biomass: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """growth_hat: at least 0, null where biomass is."""
    hat = F.col("slope") * F.col("biomass") + F.col("intercept")
    return biomass.join(fit, by).withColumn("growth_hat", F.when(hat.isNotNull(), F.greatest(F.lit(0.0), hat))).drop("slope", "intercept")
