"""Statistics of long prediction and measurement frames: correlations on two axes, slopes, ranks, scaling, normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from polyomics.operators.ranks import cumulative, quantiles

#: A side whose population standard deviation is below this is constant; fewer pairs than LEAST_PAIRS say nothing.
CONSTANT = 1e-12
LEAST_PAIRS = 3
#: Conditions below which a per-molecule correlation is suppressed.
LEAST_CONDITIONS = 15


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation over the rows that have both, clipped to [-1, 1]; null for fewer than three, or a constant side."""
    n, sxx, syy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x)
    sound = (n >= LEAST_PAIRS) & (F.sqrt(sxx / n) >= CONSTANT) & (F.sqrt(syy / n) >= CONSTANT)
    return F.when(sound, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(F.regr_sxy(y, x), F.sqrt(sxx * syy)))))


def slope(truth: str, predicted: str) -> Column:
    """Aggregate: slope of truth on prediction; null for fewer than three pairs or a constant prediction."""
    n = F.regr_count(truth, predicted)
    return F.when((n >= LEAST_PAIRS) & (F.sqrt(F.regr_sxx(truth, predicted) / n) >= CONSTANT), F.regr_slope(truth, predicted))


def pcc_by(pairs: DataFrame, axis: str, *by: str) -> DataFrame:
    """``axis``, pcc, n: the correlation of y and y_hat along ``molecule_id`` or ``profile_id`` (one value per member of the axis)."""
    return pairs.groupBy(*by, axis).agg(pearson("y", "y_hat").alias("pcc"), F.regr_count("y", "y_hat").alias("n"))


def evaluate(pairs: DataFrame, by: list[str], n_conditions: Column) -> DataFrame:
    """Metrics of predictions (profile_id, molecule_id, y, y_hat) per group of ``by``, one row per axis: axis, mean, sd, sem, n, above_03,
    above_05, rmse, slope, n_conditions, shown. sd is that of the population; shown is whether enough conditions back the axis
    per molecule. Cells where either side is missing count nowhere."""
    both = pairs.where("y is not null and y_hat is not null")
    whole = both.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("y_hat"), 2))).alias("rmse"), slope("y", "y_hat").alias("slope"), n_conditions.alias("n_conditions"))
    axes = [pcc_by(both, a, *by).withColumn("axis", F.lit(a.removesuffix("_id"))).drop(a) for a in ("molecule_id", "profile_id")]
    p = axes[0].unionByName(axes[1]).groupBy(*by, "axis").agg(
        F.avg("pcc").alias("mean"), F.stddev_pop("pcc").alias("sd"), F.try_divide(F.stddev_pop("pcc"), F.sqrt(F.count("pcc"))).alias("sem"), F.count("pcc").alias("n"),
        F.avg(F.when(F.col("pcc").isNotNull(), (F.col("pcc") > 0.3).cast("int"))).alias("above_03"), F.avg(F.when(F.col("pcc").isNotNull(), (F.col("pcc") > 0.5).cast("int"))).alias("above_05"),
    )
    joined = p.join(whole, by) if by else p.join(F.broadcast(whole))
    return joined.withColumn("shown", (F.col("axis") != "molecule") | (F.col("n_conditions") >= LEAST_CONDITIONS))


def rank_sum(df: DataFrame, value: str, group: str, first: str, second: str, by: list[str]) -> DataFrame:
    """``by``, n1, n2, z: Wilcoxon rank-sum of ``first`` against ``second`` with mid-ranks and no tie correction; z null if either has
    fewer than three. Equal values are counted before they are ranked, and ranks are taken within ranges of values, so that no task holds a
    group."""
    d = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    c = d.groupBy(*by, value).agg(F.sum((F.col(group) == first).cast("bigint")).alias("k1"), F.count("*").alias("k"))
    c = cumulative(c, by, value, "k").withColumn("mid", F.col("before") + (F.col("k") + 1) / 2)
    s = c.groupBy(*by).agg(F.sum("k1").alias("n1"), (F.sum("k") - F.sum("k1")).alias("n2"), F.sum(F.col("k1") * F.col("mid")).alias("r1"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    z = (F.col("r1") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return s.select(*by, "n1", "n2", F.when((n1 >= 3) & (n2 >= 3), z).alias("z"))


@F.pandas_udf(DoubleType())
def two_sided_p(z):
    """Normal two-sided p of z; Spark has no error function."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def minmax(long: DataFrame, truth: DataFrame) -> DataFrame:
    """value scaled by the range of ``truth`` per molecule_id; a range of zero divides by 1."""
    r = truth.groupBy("molecule_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = (F.col("value") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return long.join(r, "molecule_id").withColumn("value", scaled).drop("lo", "hi")


def target_scale(train: DataFrame, q: float = 0.999) -> DataFrame:
    """One row, scale: the q-th percentile of all training cells; 1 if that is 0 or there is none."""
    found = quantiles(train, [], "value", {"s": q}).agg(F.max("s").alias("s"))
    return found.select(F.when(F.col("s") != 0, F.col("s")).otherwise(1.0).alias("scale"))


def scaled_targets(long: DataFrame, scale: DataFrame) -> DataFrame:
    """value / scale clipped to [0, 1], and clipped: whether it was outside."""
    x = F.col("value") / F.col("scale")
    return long.join(F.broadcast(scale)).select(*[c for c in long.columns if c != "value"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).alias("value"), ((x < 0) | (x > 1)).alias("clipped"))


def unscaled(predicted: DataFrame, scale: DataFrame) -> DataFrame:
    """Predictions of scaled targets on the scale of the targets again; what was clipped stays clipped."""
    return predicted.join(F.broadcast(scale)).withColumn("y_hat", F.col("y_hat") * F.col("scale")).drop("scale")  # one row


def agreement(ours: DataFrame, theirs: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``by``, n, pcc, rmse, max_diff of two results (``keys``, value) over the cells both have a value for."""
    j = ours.select(*keys, F.col("value").alias("_a")).join(theirs.select(*keys, F.col("value").alias("_b")), keys).where("_a is not null and _b is not null")
    d = F.col("_a") - F.col("_b")
    return j.groupBy(*by).agg(F.count("*").alias("n"), pearson("_a", "_b").alias("pcc"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_diff"))


def platform_zscore(long: DataFrame, by: list[str]) -> DataFrame:
    """(value - mean) / (population sd + 1e-9) over the block ``by``: the platform, or platform and molecule. The block's moments are
    aggregated and joined back."""
    m = long.groupBy(*by).agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"))
    return long.join(m, by).withColumn("value", (F.col("value") - F.col("_mu")) / (F.col("_sd") + 1e-9)).drop("_mu", "_sd")


def counts_per_million(counts: DataFrame, log: bool = True, prior: float = 1.0) -> DataFrame:
    """sample, gene, value: counts per million of the sample, log2 with a prior; a sample without counts divides by 1."""
    size = counts.groupBy("sample").agg(F.sum("n").alias("size"))
    x = F.col("n") / F.when(F.col("size") > 0, F.col("size")).otherwise(1) * 1e6
    return counts.join(size, "sample").select("sample", "gene", (F.log2(x + prior) if log else x).alias("value"))


def quantile_normalize(long: DataFrame, by: list[str]) -> DataFrame:
    """Every profile of a block ``by`` gets the block's mean distribution; ties get the target at their average rank.

    Sorted profiles of different lengths are interpolated onto a grid as long as the longest, averaged there, and interpolated back.
    A profile is as long as its axis, so its sort is bounded; the mean distribution is one array per block."""
    keys = [*by, "profile_id"]
    s = long.where("value is not null").groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("s"))
    m = s.groupBy(*by).agg(F.max(F.size("s")).alias("m")) if by else s.agg(F.max(F.size("s")).alias("m"))
    s = s.join(F.broadcast(m), by) if by else s.join(F.broadcast(m))

    def at(array: Column, position: Column) -> Column:
        low = F.floor(position).cast("int")
        high = F.least(low + 1, F.size(array) - 1)
        return F.get(array, low) + (position - low) * (F.get(array, high) - F.get(array, low))

    step = lambda i, a, b: F.when(b > 1, i * (a - 1) / F.when(b > 1, b - 1)).otherwise(F.lit(0.0))
    grid = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda g: at(F.col("s"), step(g, F.size("s"), F.col("m"))))
    target = s.select(*by, F.posexplode(grid).alias("g", "x")).groupBy(*by, "g").agg(F.avg("x").alias("x"))
    target = (target.groupBy(*by) if by else target.groupBy()).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "x"))), lambda e: e["x"]).alias("target"))
    w = Window.partitionBy(*keys)
    r = long.where("value is not null").withColumns({
        "_n": F.count("*").over(w),
        "_r": F.rank().over(w.orderBy("value")) - 1 + (F.count("*").over(Window.partitionBy(*keys, "value")) - 1) / 2,
    })
    r = r.join(F.broadcast(target), by) if by else r.join(F.broadcast(target))
    base = lambda i: at(F.col("target"), step(i, F.size("target"), F.col("_n")))
    low, high = F.floor("_r"), F.ceil("_r")
    out = base(low) + (F.col("_r") - low) * (base(high) - base(low))
    return r.withColumn("value", out).drop("_n", "_r", "target")


def score_by_condition(pairs: DataFrame) -> DataFrame:
    """condition_key, pcc, n: truth and prediction scaled by the truth's range per molecule, averaged per condition, correlated
    across molecules. ``pairs``: condition_key, molecule_id, y, y_hat."""
    r = pairs.groupBy("molecule_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    d = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    p = pairs.join(r, "molecule_id").groupBy("condition_key", "molecule_id").agg(F.avg((F.col("y") - F.col("lo")) / d).alias("y"), F.avg((F.col("y_hat") - F.col("lo")) / d).alias("y_hat"))
    return pcc_by(p, "condition_key")


def consensus(predictions: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean of y_hat over the layers that have one; weights are renormalised over them; null if none has a weight."""
    p = predictions.where("y_hat is not null").join(F.broadcast(weights), "layer")
    return p.groupBy(*by).agg(F.try_divide(F.sum(F.col("weight") * F.col("y_hat")), F.sum("weight")).alias("y_hat"))


def ensemble(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Mean of y_hat over the arms whose name doesn't end in _LEAKY."""
    return predictions.where(~F.col("arm").endswith("_LEAKY")).groupBy(*by).agg(F.avg("y_hat").alias("y_hat"))


def coverage(predictions: DataFrame, by: list[str]) -> DataFrame:
    """How many molecules have a finite prediction, per group."""
    return predictions.where("y_hat is not null").groupBy(*by).agg(F.count_distinct("molecule_id").alias("covered"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: list[str]) -> DataFrame:
    """bin 0 .. bins-1 and n; the last bin has its upper edge; values outside are left out."""
    x = F.col(value)
    b = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("bigint")
    return df.where((x >= lo) & (x <= hi)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def grid(df: DataFrame, x: str, y: str, cell: float, by: list[str]) -> DataFrame:
    """gx, gy, n: how many rows fall into each square of side ``cell``; rows where either is missing count nowhere."""
    at = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, at(x).alias("gx"), at(y).alias("gy")).agg(F.count("*").alias("n"))


def ablation(predictions: DataFrame, sets: dict[str, list[str]], by: list[str]) -> DataFrame:
    """variant and the metrics of :func:`evaluate` of the mean over each named set of arms, leaky ones where a set names them.
    ``predictions``: arm, ``by`` (with profile_id, molecule_id, condition_key), y, y_hat. The sets are some names, hence broadcast; one pass
    serves all variants."""
    s = predictions.sparkSession.createDataFrame([(v, a) for v, arms in sets.items() for a in arms], "variant string, arm string")
    mean = predictions.join(F.broadcast(s), "arm").groupBy("variant", *by).agg(F.max("y").alias("y"), F.avg("y_hat").alias("y_hat"))
    return evaluate(mean, ["variant"], F.count_distinct("condition_key"))


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """value and share of rows at most it. Equal values are counted first; sums are taken within ranges of values."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    total = c.groupBy(*by).agg(F.sum("n").alias("total"))
    return cumulative(c, by, value, "n").join(total, by).select(*by, value, ((F.col("before") + F.col("n")) / F.col("total")).alias("share"))


def diagnostics(long: DataFrame, by: list[str], cells: Column) -> DataFrame:
    """median, q1, q3 and missing share of a block of ``cells`` cells, per group (groups with a null in ``by`` have no quartiles)."""
    missing = long.groupBy(*by).agg((1 - F.count("value") / cells).alias("missing"))
    q = quantiles(long, by, "value", {"median": 0.5, "q1": 0.25, "q3": 0.75}).drop("n")
    return missing.join(q, by, "left").select(*by, "median", "q1", "q3", "missing")
