"""Matrix, statistics, cross-validation, normalisation, networks: literal frames and NumPy definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyomics.operators import cv, matrix, networks, normalize, pairs, skew, stats

LONG = "profile_id bigint, condition_key string, molecule_id bigint, value double"


def long_of(spark, m, keys=None):
    rows = [(i, (keys or ["a.b.c.none"] * len(m))[i], j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v is not None and math.isfinite(v)]
    return spark.createDataFrame(rows, LONG)


def vectors_of(spark, m, keys=None):
    rows = [(i, (keys or ["a.b.c.none"] * len(m))[i], [None if v is None or not math.isfinite(v) else float(v) for v in r]) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, "profile_id bigint, condition_key string, values array<double>")


def test_vectors_and_long(spark):
    axis = spark.createDataFrame([(0, "g0"), (1, "g1"), (2, "g2")], "idx int, molecule_id string")
    v = spark.createDataFrame([(1, [1.0, None, float("nan")]), (2, [None, 2.0, 3.0])], "profile_id int, values array<double>")
    long = matrix.to_long(v, axis)
    assert sorted(tuple(r) for r in long.select("profile_id", "molecule_id", "value").collect()) == [(1, "g0", 1.0), (2, "g1", 2.0), (2, "g2", 3.0)]
    assert {r["profile_id"]: r["values"] for r in matrix.to_vectors(long, axis, ["profile_id"]).collect()} == {1: [1.0, None, None], 2: [None, 2.0, 3.0]}
    with pytest.raises(Exception, match="(?i)duplicate"):
        matrix.to_vectors(long.unionByName(long), axis, ["profile_id"]).collect()


def test_alignment(spark):
    p = spark.createDataFrame([("t", "x"), ("t", "y"), ("p", "x"), ("m", "x"), ("m", "y"), ("p", None)], "layer string, condition_key string")
    assert [r[0] for r in matrix.shared_conditions(p, ["t", "p", "m"]).collect()] == ["x"]
    assert {(r[0], r[1]): r[2] for r in matrix.overlaps(p).collect()}["t", "m"] == 2
    c = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 9)], "s string, m int")
    assert sorted(tuple(r) for r in matrix.testable(c, ["s", "m"]).collect()) == [("a", 1)]
    w = spark.createDataFrame([("K.M1.none.none",), ("K.M2.none.none",), ("K.M1.heat.none",), ("X.M1.none.none",), ("K.M1.none.b1(KO)",)], "condition_key string")
    media = spark.createDataFrame([("M1", "LB", None), ("M2", "other", "rich")], "medium_id string, base_medium string, description string")
    assert [r[0] for r in matrix.strict_wild_type(w, "K", media).collect()] == ["K.M1.none.none"]


def test_missingness_keeps_the_limit(spark):
    m = np.full((10, 3), np.nan)
    m[:3, 0], m[:2, 1], m[:, 2] = 1, 1, 1  # 70 %, 80 % and 0 % missing
    long = long_of(spark, m)
    everything = long_of(spark, np.ones((10, 3)))
    kept = {r["molecule_id"] for r in matrix.missingness_filter(long, everything, everything, 0.70).collect()}
    assert kept == {0, 2}


def test_fallback_and_variance(spark):
    long = long_of(spark, [[1.0, 5.0], [3.0, None]], ["x", "y"])
    got = {(r["condition_key"], r["molecule_id"]): r["value"] for r in matrix.fallback_mean(long, long).collect()}
    assert got == {("x", 0): 1.0, ("x", 1): 5.0, ("y", 0): 3.0, ("y", 1): 5.0}
    top = matrix.top_variance(long_of(spark, [[1, 1, 1], [2, 3, 2]]), [], 2).collect()
    assert [(r["molecule_id"], r["rank"]) for r in top] == [(1, 1), (0, 2)]
    assert matrix.shared_genes(spark.createDataFrame([("p", 1), ("q", 1), ("p", 2)], "platform string, molecule_id int"), "platform").count() == 2
    with pytest.raises(ValueError, match="shared genes"):
        matrix.shared_genes(spark.createDataFrame([("p", 1), ("q", 2)], "platform string, molecule_id int"), "platform")


def test_pearson_guards(spark):
    sets = {
        "few": ([1, 2], [1, 2], None), "flat": ([1, 1, 1], [1, 2, 3], None), "tiny": ([0, 1e-12, 0], [1, 2, 3], None), "plus": ([1, 2, 3], [2, 4, 6], 1.0), "minus": ([1, 2, 3], [3, 2, 1], -1.0), "gap": ([1, 2, 3, 9, None], [2, 4, 6, None, 1], 1.0),
    }
    rows = [(k, i, None if a is None else float(a), None if b is None else float(b)) for k, (x, y, _) in sets.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    d = spark.createDataFrame(rows, "molecule_id string, profile_id int, y double, y_hat double")
    got = {r["molecule_id"]: r["pcc"] for r in stats.pcc_by(d, "molecule_id").collect()}
    for k, (_, _, want) in sets.items():
        assert got[k] is None if want is None else math.isclose(got[k], want)
    assert -1 <= got["minus"] and got["plus"] <= 1
    s = d.groupBy("molecule_id").agg(stats.slope("y", "y_hat").alias("s"))
    assert {r[0]: r[1] for r in s.collect()}["plus"] == 0.5


def test_pcc_is_affine_invariant(spark):
    rng = np.random.default_rng(0)
    y, h = rng.normal(size=50), rng.normal(size=50)
    d = spark.createDataFrame([(k, float(a), float(b * s + o)) for k, (s, o) in {"a": (1, 0), "b": (7, -3)}.items() for a, b in zip(y, h, strict=True)], "molecule_id string, y double, y_hat double")
    a, b = (r["pcc"] for r in stats.pcc_by(d, "molecule_id").collect())
    assert math.isclose(a, b, abs_tol=1e-9) and math.isclose(a, np.corrcoef(y, h)[0, 1], abs_tol=1e-9)


def test_suppression(spark):
    for n, shown in ((14, False), (15, True)):
        rows = [(i, f"c{i}", j, float(i * j + j), float(i * j)) for i in range(n) for j in range(3)]
        m = stats.evaluate(spark.createDataFrame(rows, "profile_id int, condition_key string, molecule_id int, y double, y_hat double"), [], F.count_distinct("condition_key"))
        assert {r["axis"]: r["shown"] for r in m.collect()} == {"molecule": shown, "profile": True}


def test_rank_sum(spark):
    a, b = [1, 2, 2, 5, 9], [2, 3, 3, 8]
    d = spark.createDataFrame([(float(v), "a") for v in a] + [(float(v), "b") for v in b] + [(None, "a")], "v double, g string")
    r = stats.rank_sum(d, "v", "g", "a", "b", []).withColumn("p", stats.two_sided_p("z")).collect()[0]
    every = sorted(a + b)
    mid = {v: np.mean([i + 1 for i, x in enumerate(every) if x == v]) for v in every}
    z = (sum(mid[v] for v in a) - 5 * 10 / 2) / math.sqrt(5 * 4 * 10 / 12)
    assert math.isclose(r["z"], z) and math.isclose(r["p"], math.erfc(abs(z) / math.sqrt(2))) and (r["n1"], r["n2"]) == (5, 4)
    assert stats.rank_sum(d.where("v < 3"), "v", "g", "a", "b", []).collect()[0]["z"] is None
    same = spark.createDataFrame([(float(v), g) for v in range(4) for g in "ab"], "v double, g string")
    assert stats.rank_sum(same, "v", "g", "a", "b", []).collect()[0]["z"] == 0


def quantile(mat):
    """The definition: interpolate sorted columns to a common grid, average, interpolate back at average ranks."""
    cols = [np.sort(c[np.isfinite(c)]) for c in mat.T]
    m = max(map(len, cols))
    grid = np.linspace(0, 1, m)
    target = np.mean([np.interp(grid, np.linspace(0, 1, len(c)), c) for c in cols if len(c)], axis=0)
    out = np.full(mat.shape, np.nan)
    for j, c in enumerate(cols):
        base = np.interp(np.linspace(0, 1, len(c)), grid, target) if len(c) else None
        for i, v in enumerate(mat[:, j]):
            if np.isfinite(v):
                out[i, j] = np.interp(np.flatnonzero(c == v).mean(), np.arange(len(c)), base)
    return out


@pytest.mark.parametrize("case", ["ties", "unequal", "random"])
def test_quantile_normalize(spark, case):
    rng = np.random.default_rng(1)
    mat = {"ties": np.array([[1.0, 4], [1, 3], [3, 2], [4, 1]]), "unequal": np.array([[1.0, 9, np.nan], [5, np.nan, np.nan], [2, 4, np.nan], [8, np.nan, np.nan], [3, 7, np.nan]]), "random": np.round(rng.lognormal(size=(40, 6)), 1)}[case]
    if case == "random":
        mat[rng.random(mat.shape) < 0.2] = np.nan
    got = np.full(mat.shape, np.nan)
    for r in stats.quantile_normalize(long_of(spark, mat.T).withColumn("platform", F.lit("p")), ["platform"]).collect():
        got[r["molecule_id"], r["profile_id"]] = r["value"]
    np.testing.assert_allclose(got, quantile(mat), atol=1e-12)
    if case == "ties":
        assert got[0, 0] == got[1, 0] == 1.25


def test_scaling(spark):
    long = spark.createDataFrame([(1, "k", 0, 2.0), (2, "k", 0, 4.0), (1, "k", 1, 5.0), (2, "k", 1, 5.0)], LONG)
    assert sorted(r["value"] for r in stats.minmax(long, long).collect()) == [0.0, 0.0, 0.0, 1.0]
    z = stats.platform_zscore(long.withColumn("platform", F.lit(1)), ["platform"]).agg(F.avg("value"), F.stddev_pop("value")).collect()[0]
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-6
    assert stats.target_scale(long.limit(0)).collect()[0][0] == 1.0
    c = spark.createDataFrame([("s", "g", 1), ("s", "h", 3), ("t", "g", 0)], "sample string, gene string, n bigint")
    assert {(r[0], r[1]): r[2] for r in stats.counts_per_million(c, log=False).collect()} == {("s", "g"): 250000.0, ("s", "h"): 750000.0, ("t", "g"): 0.0}


def test_consensus_and_ensemble(spark):
    p = spark.createDataFrame([("a", "l", "k", 1.0), ("b", "m", "k", 3.0), ("b", "m", "j", 3.0), ("x_LEAKY", "n", "k", 99.0), ("a", "l", "i", None)], "arm string, layer string, condition_key string, y_hat double")
    w = spark.createDataFrame([("l", 0.75), ("m", 0.25), ("n", 0.0)], "layer string, weight double")
    assert {r[0]: r[1] for r in stats.consensus(p, w, ["condition_key"]).collect()} == {"k": 1.5, "j": 3.0}
    assert {r[0]: r[1] for r in stats.ensemble(p, ["condition_key"]).collect()} == {"k": 2.0, "j": 3.0, "i": None}
    none = spark.createDataFrame([("l", 0.0), ("m", 0.0), ("n", 0.0)], "layer string, weight double")
    assert {r[1] for r in stats.consensus(p, none, ["condition_key"]).collect()} == {None}


def test_folds_and_baselines(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(24, 5))
    m[rng.random(m.shape) < 0.1] = np.nan
    keys = [f"s.m.x.{'none' if i % 6 == 0 else f'b{i % 6}(KO)'}" for i in range(24)]
    long, vec = long_of(spark, m, keys), vectors_of(spark, m, keys)
    fold = {r[0]: r[1] for r in cv.folds(long, 3, seed=4).collect()}
    want = np.random.default_rng(4).permutation(6)
    assert {k: i % 3 for i, k in enumerate(np.array(sorted(set(keys)))[want])} == fold
    f = cv.folds(long, 3, seed=4)
    base = {(r["fold"], r["molecule_id"]): r["y_hat"] for r in cv.mean_baseline(long, f).collect()}
    wild = {(r["fold"], r["molecule_id"]): r["y_hat"] for r in cv.wild_type_baseline(long, f).collect()}
    own = np.array([fold[k] for k in keys])
    wt = np.array([k.endswith("none") for k in keys])
    for k in range(3):
        train = own != k
        np.testing.assert_allclose([base[k, j] for j in range(5)], np.nanmean(m[train], 0), atol=1e-12)
        rows = train & wt if (train & wt).any() else train
        np.testing.assert_allclose([wild[k, j] for j in range(5)], np.nanmean(m[rows], 0), atol=1e-12)
    r = {(x["fold"], x["idx"]): x["y_hat"] for x in cv.random_baseline(vec, f, 20, 10, 1).collect()}
    for k in range(3):
        g, t, s = np.random.default_rng(1 + k), m[own != k], 0
        for _ in range(20):
            s = s + np.nanmean(t[g.choice(len(t), size=10, replace=False)], axis=0)
        np.testing.assert_allclose([r[k, j] for j in range(5)], s / 20, atol=1e-12)
    m = {(r["predictor"], r["axis"]): r for r in cv.run_loco(lambda d, k: cv.predictions(d, k, cv.mean_baseline(d, k)), long, cv.folds(long, 3, seed=4)).collect()}
    assert len(m) == 6 and m["model", "profile"]["rmse"] == m["mean", "profile"]["rmse"] and abs(m["mean", "profile"]["z"]) < 0.5 and m["model", "molecule"]["p"] is None


def test_random_baseline_in_blocks(spark):
    """No task gets a fold's training rows: blocks of seven rows give what NumPy draws from all of them, missing cells and all."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 3))
    m[rng.random(m.shape) < 0.2] = np.nan
    m[:, 2] = np.where(np.arange(90) < 80, np.nan, m[:, 2])
    keys = [f"c{i % 4}" for i in range(90)]
    rows = [(i, keys[i], [None if np.isnan(x) else float(x) for x in m[i]]) for i in rng.permutation(90).tolist()]
    vec = spark.createDataFrame(rows, "profile_id bigint, condition_key string, values array<double>")
    f = cv.folds(vec, None)
    one = {(x["fold"], x["idx"]): x["y_hat"] for x in cv.random_baseline(vec, f, 30, 10, 1, block_rows=7).collect()}
    assert len(one) == 12
    own = np.arange(90) % 4
    for k in range(4):
        g, t = np.random.default_rng(1 + k), m[own != k]
        means = np.array([np.nanmean(t[g.choice(len(t), size=10, replace=False)], axis=0) for _ in range(30)])
        np.testing.assert_allclose([one[k, j] for j in range(2)], means.mean(0)[:2], atol=1e-12)
        assert (one[k, 2] is None) == bool(np.isnan(means[:, 2]).any())


def test_random_baseline_query_draws_as_the_operator(spark):
    from polyomics.plans import bindings, pipeline

    d = "/root/testdata/sf0.001"
    v = bindings.vectors(spark, d)
    want = {(r["fold"], r["idx"]): r["y_hat"] for r in cv.random_baseline(v, cv.folds(v, None), draws=1000).collect()}
    got = {(r["fold"], r["idx"]): r["y_hat"] for r in pipeline.random_baseline(spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)



def knn(mat, k):
    out = mat.copy()
    seen = np.isfinite(mat)
    for i in range(len(mat)):
        gaps = np.flatnonzero(~seen[i])
        own = np.nanmean(mat[i]) if seen[i].any() else 0.0
        near = []
        for j in range(len(mat)):
            both = seen[i] & seen[j]
            if j != i and len(gaps) and seen[j][gaps].any() and both.any():
                near.append((math.sqrt(((mat[i] - mat[j])[both] ** 2).mean()), j))
        for g in gaps:
            v = [mat[j][g] for _, j in sorted(near)[:k] if seen[j][g]]
            out[i, g] = np.mean(v) if v else own
    return out


def test_knn_impute(spark):
    rng = np.random.default_rng(3)
    genes = rng.normal(size=(4, 1)) @ rng.normal(size=(1, 12)) + rng.normal(size=(4, 12)) * 0.1
    genes = np.vstack([genes, genes + rng.normal(size=genes.shape) * 0.2, np.full((1, 12), np.nan)])
    genes[rng.random(genes.shape) < 0.2] = np.nan
    for k in (3, 50):
        got = np.zeros(genes.shape)
        for r in pairs.knn_impute(vectors_of(spark, genes.T), k).collect():
            got[r["idx"], r["profile_id"]] = r["value"]
            assert r["imputed"] == int(not np.isfinite(genes[r["idx"], r["profile_id"]]))
        np.testing.assert_allclose(got, knn(genes, k), atol=1e-9)


def test_coexpression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 6))
    x[:, 1] = x[:, 0] + rng.normal(size=30) * 0.3
    x[:, 2] = -x[:, 0]
    x[:, 5] = 1.0
    got = {(r["i"], r["j"]): r["r"] for r in pairs.coexpression(vectors_of(spark, x).repartition(3)).collect()}
    assert set(got) == {(0, 1)} and math.isclose(got[0, 1], np.corrcoef(x[:, 0], x[:, 1])[0, 1], abs_tol=1e-9)


def test_complete_columns_and_grid(spark):
    x = np.array([[1.0, 2, 1], [2, 4, 2], [3, 6, np.nan], [4, 8, 4]])
    assert {(r["i"], r["j"]) for r in pairs.coexpression(vectors_of(spark, x)).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert {(r["i"], r["j"]) for r in pairs.coexpression(vectors_of(spark, x), complete=True).collect()} == {(0, 1)}
    g = spark.createDataFrame([(0.1, 0.9), (0.2, 0.8), (-0.1, 0.0), (None, 1.0)], "x double, y double")
    assert sorted(tuple(r) for r in stats.grid(g, "x", "y", 0.5, []).collect()) == [(-1, 0, 1), (0, 1, 2)]
    p = spark.createDataFrame([(a, i, f"c{i}", j, float(i * j), h) for i in range(3) for j in range(3) for a, h in (("a", float(i * j)), ("b_LEAKY", 0.0))], "arm string, profile_id int, condition_key string, molecule_id int, y double, y_hat double")
    m = stats.ablation(p, {"one": ["a"], "both": ["a", "b_LEAKY"]}, ["profile_id", "condition_key", "molecule_id"]).where("axis = 'profile'").collect()
    assert {r["variant"]: round(r["slope"], 6) for r in m} == {"one": 1.0, "both": 2.0}


def test_networks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "c"), (None, "a"), ("c", None)], "src string, dst string")
    s = networks.symmetric(e)
    assert sorted(tuple(r) for r in s.collect()) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]
    assert tuple(networks.statistics(s).collect()[0]) == (3, 2)
    assert networks.restrict(s, spark.createDataFrame([("a",), ("b",)], "molecule_id string")).count() == 2
    raw = spark.createDataFrame([("b1474;", "b0001"), ("citB", "b1474"), ("what", "b0001"), ("b0001", "b0001")], "a string, b string")
    r = networks.parse_report(raw, F.create_map(F.lit("citb"), F.lit("b0002"))).collect()[0]
    assert (r["rows"], r["kept"], r["self_loops"], r["dropped"], r["dropped_tokens"]) == (4, 2, 1, 1, ["what"])
    arms = spark.createDataFrame([("x", "a", "b"), ("x_LEAKY", "a", "b")], "arm string, src string, dst string")
    assert networks.arms(arms).count() == 1 and networks.arms(arms, True).count() == 2


def nearest_loess(x, y, at, span):
    """Brute force: the k nearest by distance, left first, tricube, weighted line."""
    out = []
    k = max(3, math.ceil(span * len(x)))
    for q in np.clip(at, x.min(), x.max()):
        near = np.argsort(np.abs(x - q), kind="stable")[:k]
        d = np.abs(x[near] - q)
        w = (1 - (d / (d.max() or 1.0)) ** 3) ** 3
        if w.sum() <= 0:
            out.append(y[near].mean())
            continue
        mx, my = np.average(x[near], weights=w), np.average(y[near], weights=w)
        sxx = (w * (x[near] - mx) ** 2).sum()
        out.append(my + ((w * (x[near] - mx) * (y[near] - my)).sum() / sxx if sxx > 1e-12 else 0.0) * (q - mx))
    return np.array(out)


def test_loess():
    rng = np.random.default_rng(5)
    x = np.r_[rng.random(200), 8 + 2 * rng.random(20)]
    y = np.sin(x) + rng.normal(size=220) * 0.1
    at = np.r_[rng.random(20), 0.99, 5, -3, 99, x[3]]
    np.testing.assert_allclose(normalize.loess(x, y, at, 0.2), nearest_loess(np.sort(x), y[np.argsort(x)], at, 0.2), atol=1e-9)
    assert np.isnan(normalize.loess(np.array([]), np.array([]), np.array([1.0]))).all()
    assert normalize.loess(np.array([1.0, 2, 3]), np.array([1.0, 2, 6]), np.array([9.0]))[0] == 3.0
    twice = np.repeat(np.arange(6.0), 3)
    np.testing.assert_allclose(normalize.loess(twice, 2 * twice, np.array([2.5]), 0.5), [5.0])


def test_noise(spark):
    rng = np.random.default_rng(6)
    m = np.r_[rng.normal(2, 0.3, (150,)), rng.normal(8, 1.0, (150,))]
    rows = np.vstack([m, m[::-1] + 0.5])
    rows = np.vstack([rows, np.r_[np.arange(5.0), np.full(295, np.nan)]])
    long = long_of(spark, rows)
    fits = normalize.noise_fits(long).collect()
    assert {f["profile_id"] for f in fits} == {0, 1} and all(f["converged"] for f in fits)
    f = next(f for f in fits if f["profile_id"] == 0)
    assert abs(f["mu_noise"] - 2) < 0.1 and abs(f["mu_signal"] - 8) < 0.3 and abs(f["pi_noise"] - 0.5) < 0.05
    d = {(r["profile_id"], r["molecule_id"]): r["value"] for r in normalize.denoise(long, normalize.noise_fits(long)).collect()}
    assert all(v >= 0 for (p, _), v in d.items() if p < 2) and d[2, 4] == 4.0 and d[0, 0] < 1 and d[0, 299] > 5


def swept(z, rounds=10, tol=1e-4):
    """Median polish of a matrix of probes by arrays, NaN being a gap: the array effects with the overall term."""
    fit = np.zeros_like(z)
    for _ in range(rounds):
        before = fit.copy()
        for axis in (1, 0):
            fit = fit + np.nanmedian(z - fit, axis=axis, keepdims=True)
        if np.abs(fit - before).max() < tol / 2:
            break
    row = fit[:, :1] - np.median(fit[:, 0])
    return (fit - row)[0]


def test_polish_and_background(spark):
    z = np.add.outer(np.array([0.0, 1, 5, 2]), np.array([3.0, 7, 4])) + 10
    np.testing.assert_allclose(np.diff(swept(z)), [4, -3], atol=1e-9)
    z[0, 0] = np.nan
    assert np.isfinite(swept(z)).all()
    rng = np.random.default_rng(7)
    o = rng.exponential(200, 20000) + rng.normal(100, 15, 20000)
    b = normalize.background(o)
    alpha, mu, sigma = normalize.background_parameters(o)
    assert (b > 0).all() and (np.diff(b[np.argsort(o)]) > -1e-6).all() and abs(mu - 100) < 40
    s = np.linspace(0, 1500, 300_001)  # the expectation by its definition: signal density times that of the background
    for i in np.argsort(o)[[50, 5000, 10000, 19000]]:
        w = np.exp(-alpha * s - 0.5 * ((o[i] - mu - s) / sigma) ** 2)
        assert math.isclose(b[i], np.trapezoid(s * w) / np.trapezoid(w), rel_tol=1e-5)
    np.testing.assert_allclose(normalize._log_cdf(np.array([-35.0, -29.0, 0.0, 3.0])), [-616.97510117, -424.78532063, math.log(0.5), -0.00135080996], rtol=1e-4)
    assert normalize.mode(np.array([])) == 0 and normalize.mode(np.array([4.0])) == 4 and abs(normalize.mode(rng.normal(3, 1, 5000)) - 3) < 0.4


def test_rma_and_correction(spark):
    rng = np.random.default_rng(8)
    m = np.exp(rng.normal(5, 1, (6, 40)))
    long = long_of(spark, m)
    layout = spark.createDataFrame([(j // 4, j) for j in range(40)], "probeset int, molecule_id bigint")
    r = normalize.rma(long.select("profile_id", "molecule_id", "value"), layout)
    assert r.count() == 60 and r.where("value is null or isnan(value)").count() == 0
    p = long.select(F.when(F.col("profile_id") < 3, "x").otherwise("y").alias("platform"), "profile_id", "molecule_id", F.log2("value").alias("value"))
    z = normalize.correct_platform_bias(p).groupBy("platform").agg(F.avg("value"), F.stddev_pop("value")).collect()
    assert all(abs(x[1]) < 1e-9 and abs(x[2] - 1) < 1e-6 for x in z)
    ref = spark.createDataFrame([(j, 10.0**j) for j in range(20)], "molecule_id bigint, copies double")
    a = normalize.absolute(p.drop("platform"), ref)
    assert a.count() == 240 and a.where("value is null").count() == 0
    few = normalize.absolute(p.drop("platform"), ref.limit(7))
    assert few.where("value is not null").count() == 0
    life = spark.createDataFrame([(j, "short" if j % 2 else "long") for j in range(40)], "molecule_id bigint, life string")
    assert normalize.half_life_control(p, life).collect()[0]["n1"] == 20


def test_join_groups(spark):
    """Every group taken for a hot one, and none: the same as a plain left join; null keys find nothing."""
    rows = spark.createDataFrame([(i, "h" if i % 3 else f"k{i % 5}", i) for i in range(300)] + [(999, None, 1)], "id bigint, k string, v bigint")
    g = rows.where("k <> 'k0'").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    want = sorted((r["id"], r["first"]) for r in rows.join(g, "k", "left").collect() if r["first"] is not None)
    for hot in (1, 50, 10**6):
        out = skew.join_groups(rows, g, ["k"], "n", "id", hot)
        assert out.columns == ["k", "id", "v", "first"] and out.count() == 301
        assert sorted((r["id"], r["first"]) for r in out.collect() if r["first"] is not None) == want


def test_median_polish_in_aggregations(spark):
    """Each set as NumPy polishes it, with gaps, an even number of arrays, and without a task that gets all cells of a set."""
    rng = np.random.default_rng(12)
    m = rng.normal(8, 2, (3, 5, 14))
    m[rng.random(m.shape) < 0.15] = np.nan
    m[2] = rng.normal(size=5)[:, None] + rng.normal(size=14)  # settles at once
    rows = [(s, p, a, None if np.isnan(m[s, p, a]) else float(m[s, p, a])) for s in range(3) for p in range(5) for a in range(14)]
    r = normalize.median_polish(spark.createDataFrame(rows, "probeset int, probe bigint, profile_id bigint, value double"))
    assert "InPandas" not in r._jdf.queryExecution().toString()
    got = {(x["probeset"], x["profile_id"]): x["value"] for x in r.collect()}
    assert len(got) == 42
    for s in range(3):
        np.testing.assert_allclose([got[s, a] for a in range(14)], swept(m[s]), atol=1e-9)


def test_exact_ranks_and_percentiles(spark):
    from polyomics.operators import ranks

    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g, n in (("a", 2000), ("b", 7), ("c", 1)) for v in np.round(rng.exponential(size=n), 2)] + [("a", None), ("b", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    of = {g: sorted(v for h, v in rows if h == g and v is not None and v == v) for g in "abc"}
    got = {r["g"]: (r["lo"], r["hi"], r["n"]) for r in ranks.quantiles(df, ["g"], "v", {"lo": 0.25, "hi": 0.999}, 100).collect()}
    assert got.keys() == of.keys()
    for g, v in of.items():
        np.testing.assert_allclose(got[g], (np.quantile(v, 0.25), np.quantile(v, 0.999), len(v)))
    whole = [v for x in of.values() for v in x]
    np.testing.assert_allclose(ranks.quantiles(df, [], "v", {"m": 0.5}).collect()[0]["m"], np.median(whole))
    assert ranks.quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == ranks.quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0
    counted = df.where("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count("*").alias("k"))
    for by in ([], ["g"]):
        c = counted if by else counted.groupBy("v").agg(F.sum("k").alias("k"))
        for r in ranks.cumulative(c, by, "v", "k", 5).collect():
            assert r["before"] == sum(x < r["v"] for x in (of[r["g"]] if by else whole))


def test_testable_and_agreement(spark):
    c = spark.createDataFrame([("k1", "a", "x"), ("k2", "a", "y"), ("k3", "b", "x"), ("k4", "a", "x"), ("k5", None, "x"), ("k4", "a", "x")], "condition_key string, s string, m string")
    assert sorted(r["condition_key"] for r in matrix.testable(c, ["s", "m"]).collect()) == ["k1", "k4"]
    a = spark.createDataFrame([(i, float(i)) for i in range(5)], "i int, value double")
    r = stats.agreement(a, a.withColumn("value", F.col("value") * 2 + 1), ["i"], []).collect()[0]
    assert r["n"] == 5 and r["pcc"] == 1.0 and r["max_diff"] == 5.0


def test_salted_joins_are_joins(spark):
    from polyomics.operators import skew

    a = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(90)], "a int, k int")
    b = spark.createDataFrame([(i, 0 if i < 40 else i % 4) for i in range(60)], "b int, k int")
    want = sorted((r["a"], r["b"]) for r in a.join(b, "k").collect())
    for hot in (5, 1000):
        assert sorted((r["a"], r["b"]) for r in skew.join_salted(a, b, ["k"], "a", hot).collect()) == want
