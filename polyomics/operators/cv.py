"""Leave-one-condition-out: folds, baselines, and running an estimator over folds as grouped maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyomics.functions.canon import is_wild_type
from polyomics.operators import stats
from polyomics.operators.ranks import cumulative
from polyomics.session import materialize

#: Rows of a block within which the drawn rows of the random baseline are looked up.
BLOCK_ROWS = 1_000


def folds(conditions: DataFrame, n_folds: int | None, seed: int = 0, label: Callable[[Column], Column] | None = None) -> DataFrame:
    """condition_key, fold. ``label`` names a condition's group (its medium, its strain), all of which is held out together; without it
    every condition is a group of its own.

    Without ``n_folds``, or with no fewer than there are groups, every group is its own fold, numbered in order by ranges of it. Else the
    sorted groups are permuted by NumPy's default_rng and dealt out in turn; for that, and only then, the groups, some thousands, are
    ordered on the driver, because the permutation must be NumPy's."""
    own = F.col("condition_key") if label is None else label(F.col("condition_key"))
    c = conditions.select("condition_key").where("condition_key is not null").distinct().withColumn("label", own)
    labels = c.select("label").distinct()
    if n_folds is not None and labels.limit(n_folds + 1).count() > n_folds:
        names = sorted(r[0] for r in labels.collect())
        order = np.random.default_rng(seed).permutation(len(names)).tolist()
        numbered = conditions.sparkSession.createDataFrame([(names[k], i % n_folds) for i, k in enumerate(order)], "label string, fold bigint")
    else:
        numbered = cumulative(labels.withColumn("one", F.lit(1).cast("bigint")), [], "label", "one").select("label", F.col("before").alias("fold"))
    return c.join(numbered, "label").select("condition_key", "fold")


def mean_baseline(long: DataFrame, fold: DataFrame) -> DataFrame:
    """fold, molecule_id, y_hat: the mean of the training rows, as all minus held out, so that no row is read once per fold."""
    h = long.join(fold, "condition_key").groupBy("fold", "molecule_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    t = h.groupBy("molecule_id").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    every = fold.select("fold").distinct().join(F.broadcast(t))
    h = every.join(h, ["fold", "molecule_id"], "left")
    n = F.col("tn") - F.coalesce("n", F.lit(0))
    return h.select("fold", "molecule_id", F.try_divide(F.col("ts") - F.coalesce("s", F.lit(0.0)), n).alias("y_hat"))


def wild_type_baseline(long: DataFrame, fold: DataFrame) -> DataFrame:
    """As :func:`mean_baseline` over the wild-type training rows; for a fold that leaves none of these, the mean of all its rows."""
    wt = mean_baseline(long.where(is_wild_type(F.col("condition_key"))), fold).withColumnRenamed("y_hat", "wt")
    some = wt.groupBy("fold").agg(F.max(F.col("wt").isNotNull()).alias("some"))
    both = mean_baseline(long, fold).join(wt, ["fold", "molecule_id"], "left").join(some, "fold", "left")
    return both.select("fold", "molecule_id", F.when(F.coalesce("some", F.lit(False)), F.col("wt")).otherwise(F.col("y_hat")).alias("y_hat"))


def random_baseline(vectors: DataFrame, fold: DataFrame, draws: int = 1000, k: int = 10, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """fold, idx, y_hat: the mean of ``draws`` means of min(k, n) training rows drawn without replacement, default_rng(seed + fold).

    ``vectors``: profile_id, condition_key, values. NumPy's draw needs just the number n of a fold's training rows, so only their ranks
    are drawn, ``draws`` x k integers per fold. Rows are in the order of profile_id, in blocks of about ``block_rows``; a rank is looked
    up in the block that has it, where the sums of a draw are taken, so that no row is copied per fold and no task has more than a
    block and the ranks that fall into it. y_hat is null where a draw has no value at that position."""
    rows = vectors.select("profile_id", "condition_key", "values").join(fold, "condition_key").select("profile_id", "fold", "values")
    blocks = max(1, -(-rows.count() // block_rows))
    rows = materialize(rows.repartitionByRange(blocks, "profile_id").withColumn("block", F.spark_partition_id()), "blocks")
    own = rows.groupBy("block", "fold").agg(F.count("*").alias("own"))
    size = own.groupBy("block").agg(F.sum("own").alias("n"))
    every = size.join(F.broadcast(fold.select("fold").distinct())).join(own, ["block", "fold"], "left")
    trains = every.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("block", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")))).alias("b"))

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, ids, counts in zip(pdf["fold"], pdf["ids"], pdf["counts"], strict=True):
                ends = np.cumsum(counts)
                n, rng = int(ends[-1]), np.random.default_rng(seed + int(f))
                if n:
                    drawn = np.concatenate([rng.choice(n, size=min(k, n), replace=False) for _ in range(draws)])
                    at = np.searchsorted(ends, drawn, "right")
                    yield pd.DataFrame({"block": np.asarray(ids)[at], "fold": f, "draw": np.repeat(np.arange(draws), min(k, n)), "rank": drawn - (ends - counts)[at]})

    def look_up(pdf: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("profile_id", kind="stable"), []
        if len(pdf) and len(drawn):
            m = np.array([[np.nan if v is None else v for v in r] for r in pdf["values"]], float)
            of, seen = pdf["fold"].to_numpy(), ~np.isnan(m)
            m = np.where(seen, m, 0.0)
            for f, g in drawn.groupby("fold"):
                g = g.sort_values("draw", kind="stable")
                at = np.flatnonzero(of != f)[g["rank"].to_numpy()]
                draw, first = np.unique(g["draw"].to_numpy(), return_index=True)
                out.append(pd.DataFrame({"fold": f, "draw": draw, "s": list(np.add.reduceat(m[at], first)), "n": list(np.add.reduceat(seen[at].astype("i8"), first))}))
        return pd.concat(out) if out else pd.DataFrame({"fold": [], "draw": [], "s": [], "n": []})

    trains = trains.select("fold", F.col("b.block").alias("ids"), F.col("b.n").alias("counts"))
    drawn = trains.mapInPandas(ranks, "block int, fold bigint, draw bigint, rank bigint")
    sums = rows.groupBy("block").cogroup(drawn.groupBy("block")).applyInPandas(look_up, "fold bigint, draw bigint, s array<double>, n array<bigint>")
    cell = sums.select("fold", "draw", F.posexplode(F.arrays_zip("s", "n")).alias("idx", "c")).groupBy("fold", "draw", "idx").agg(F.sum("c.s").alias("s"), F.sum("c.n").alias("n"))
    mean = F.when(F.min("n") > 0, F.avg(F.try_divide("s", "n")))
    return cell.groupBy("fold", F.col("idx").cast("bigint").alias("idx")).agg(mean.alias("y_hat"))


def predictions(long: DataFrame, fold: DataFrame, baseline: DataFrame) -> DataFrame:
    """fold, profile_id, condition_key, molecule_id, y, y_hat of the held-out rows under a fold's prediction per molecule."""
    held = long.join(fold, "condition_key")
    return held.join(baseline, ["fold", "molecule_id"], "left").select("fold", "profile_id", "condition_key", "molecule_id", F.col("value").alias("y"), "y_hat")


def out_of_fold_baselines(long: DataFrame, fold: DataFrame, min_train: int = 2) -> DataFrame:
    """predictor and the columns of :func:`predictions` of the mean and the wild-type baseline, for a layer without a model. Folds that leave
    fewer than ``min_train`` profiles to train on are left out."""
    n = long.join(fold, "condition_key").groupBy("fold").agg(F.count_distinct("profile_id").alias("own"))
    total = n.agg(F.sum("own").alias("total"))
    good = n.crossJoin(F.broadcast(total)).where(F.col("total") - F.col("own") >= min_train).select("fold")  # one row
    kept = fold.join(good, "fold", "left_semi")
    each = [predictions(long, kept, base(long, fold)).select(F.lit(n).alias("predictor"), "*") for n, base in (("mean", mean_baseline), ("wild_type", wild_type_baseline))]
    return each[0].unionByName(each[1])


def run_loco(fit_predict: Callable[[DataFrame, DataFrame], DataFrame], long: DataFrame, fold: DataFrame) -> DataFrame:
    """predictor, the metrics of :func:`stats.evaluate` on both axes, and z and p of the model's correlations per molecule against those of
    each baseline (rank-sum; null for the model itself).

    ``fit_predict(long, fold)`` gives the columns of :func:`predictions` for the held-out rows of every fold, as a frame: the folds are
    fitted together, as aggregations or grouped maps, not one after the other by the driver."""
    model = fit_predict(long, fold).select(F.lit("model").alias("predictor"), "fold", "profile_id", "condition_key", "molecule_id", "y", "y_hat")
    every = materialize(model.unionByName(out_of_fold_baselines(long, fold)), "predictions")
    pcc = stats.pcc_by(every, "molecule_id", "predictor")
    tests = [stats.rank_sum(pcc, "pcc", "predictor", "model", n, []).select(F.lit(n).alias("predictor"), "z") for n in ("mean", "wild_type")]
    return compare(every).join(tests[0].unionByName(tests[1]).withColumn("p", stats.two_sided_p("z")), "predictor", "left")


def compare(pairs: DataFrame, by: str = "predictor") -> DataFrame:
    """Metrics of each predictor on both axes (see :func:`stats.evaluate`)."""
    return stats.evaluate(pairs, [by], F.count_distinct("condition_key"))
