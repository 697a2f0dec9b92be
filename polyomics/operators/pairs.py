"""Pairwise-complete sums over all pairs of an axis, and what follows from them: co-expression and nearest-neighbour imputation.

The pairs are those of the axis, some thousand molecules, not of the profiles: each partition of profiles adds up its own sums as
matrix products, and only these, whose size doesn't depend on the number of profiles, are shuffled and added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy", "d2"]


def pair_sums(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, i, j, n, sx, sy, sxx, syy, sxy, d2 for i < j: sums over the profiles that have both positions; d2 that of squared
    differences. ``vectors``: ``by``, values (null or NaN: no reading; all of one length within a group)."""
    by = by or []

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, g in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                x = np.array([[np.nan if v is None else v for v in r] for r in g["values"]], float)
                m = np.isfinite(x).astype(float)
                x = np.where(m > 0, x, 0.0)
                n, sx, sxx, sxy = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
                d2 = np.zeros_like(n)
                for i in range(x.shape[1]):  # the sum of squares would lose digits for like rows
                    d2[i] = (((x - x[:, [i]]) ** 2) * m * m[:, [i]]).sum(0)
                i, j = np.triu_indices(x.shape[1], 1)
                out = pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i], "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j], "d2": d2[i, j]})
                for k, v in zip(by, key if isinstance(key, tuple) else (key,), strict=True):
                    out.insert(0, k, v)
                yield out[[*by, "i", "j", *SUMS]]

    types = dict(vectors.dtypes)
    schema = ", ".join([*(f"`{b}` {types[b]}" for b in by), "i bigint", "j bigint", *(f"{s} double" for s in SUMS)])
    partial = vectors.select(*by, "values").where("values is not null").mapInPandas(add, schema)
    return partial.groupBy(*by, "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def coexpression(vectors: DataFrame, least: float = 0.7, by: list[str] | None = None, complete: bool = False) -> DataFrame:
    """``by``, i, j, r: pairs of positions whose correlation is above ``least`` (signed), from at least three common profiles, neither
    side constant over them. ``complete``: only positions that every profile has a reading of."""
    by = by or []
    p = pair_sums(vectors, by).where("n >= 3")
    if complete:
        total = vectors.where("values is not null").groupBy(*by).agg(F.count("*").alias("all"))
        p = (p.join(F.broadcast(total), by) if by else p.join(F.broadcast(total))).where("n = all")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    sound = (vx / F.col("n") > 1e-18) & (vy / F.col("n") > 1e-18)
    r = F.when(sound, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(vx * vy)))))
    return p.select(*by, "i", "j", r.alias("r")).where(F.col("r") > least)


def knn_impute(vectors: DataFrame, k: int = 3) -> DataFrame:
    """profile_id, idx, value, imputed: every cell, gaps filled from the k nearest positions.

    Candidates of a position are those with a reading in at least one of its gaps and a common profile; the distance is the root of
    the mean squared difference over common profiles, ties by position. A gap gets the mean of the k neighbours that have a reading
    in its profile, else the position's own mean, 0 if it has no reading at all. Readings only are averaged, never filled cells.
    ``vectors``: profile_id, values of one length."""
    cells = vectors.select("profile_id", F.posexplode("values").alias("idx", "value"))
    cells = cells.withColumn("value", F.when(~F.isnan("value"), F.col("value").cast("double"))).withColumn("idx", F.col("idx").cast("bigint"))
    half = pair_sums(vectors).where("n > 0").select("i", "j", F.sqrt(F.col("d2") / F.col("n")).alias("distance"))
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    serves = vectors.select(
        F.explode(F.filter(F.transform("values", lambda v, i: F.when(v.isNull() | F.isnan(v), i)), lambda i: i.isNotNull())).alias("i"),
        F.filter(F.transform("values", lambda v, i: F.when(v.isNotNull() & ~F.isnan(v), i)), lambda i: i.isNotNull()).alias("js"),
    ).select("i", F.explode("js").alias("j")).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).distinct()
    w = Window.partitionBy("i").orderBy("distance", "j")
    near = both.join(serves, ["i", "j"], "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("i").agg(F.collect_list("j").alias("near"))
    own = cells.groupBy("idx").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("own"))
    table = own.join(near, own.idx == near.i, "left").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct("own", "near").alias("v")))).alias("near_of"))
    v = vectors.join(F.broadcast(table))  # one row, as long as the axis
    read = lambda j: F.get("values", j.cast("int"))
    ok = lambda x: x.isNotNull() & ~F.isnan(x)

    def fill(i):
        entry = F.try_element_at("near_of", i.cast("bigint"))
        seen = F.filter(F.transform(F.coalesce(entry["near"], F.array().cast("array<bigint>")), read), ok)
        mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)
        return F.when(F.size(seen) > 0, mean).otherwise(entry["own"])

    cell = F.transform("values", lambda x, i: F.struct(i.cast("bigint").alias("idx"), F.when(ok(x), x.cast("double")).otherwise(fill(i)).alias("value"), (~ok(x)).cast("int").alias("imputed")))
    return v.select("profile_id", F.explode(cell).alias("c")).select("profile_id", "c.idx", "c.value", "c.imputed")
