"""Exact ranks and percentiles of groups of any size, a third of all rows or all of them, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyomics.operators.skew import join_groups
from polyomics.session import materialize

#: On either side of a percentile the part of a group that is sorted to find the exact value.
MARGIN = 0.005


def cumulative(counted: DataFrame, by: list[str], value: str, size: str, parts: int | None = None) -> DataFrame:
    """``counted`` (``by``, ``value`` distinct within it, ``size``, other columns) with ``before``: the sum of ``size`` over the smaller
    values of the group.

    Rows are put into ranges of (``by``, ``value``), written, and summed within a range; the totals of the ranges before, one row per
    range and group in it, are added. So a group of any size is spread over as many ranges as it fills."""
    order = [*by, value]
    r = counted.repartitionByRange(parts, *order) if parts else counted.repartitionByRange(*order)
    r = materialize(r.withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = r.groupBy("_part", *by).agg(F.sum(size).alias("_total"))
    if not by:  # as many rows as ranges
        totals = totals.withColumn("_all", F.lit(0))
    start = F.coalesce(F.sum("_total").over(earlier(Window.partitionBy(*(by or ["_all"])).orderBy("_part"))), F.lit(0))
    totals = totals.select("_part", *by, start.alias("_start"))
    inside = F.coalesce(F.sum(size).over(earlier(Window.partitionBy("_part", *by).orderBy(value))), F.lit(0))
    return r.withColumn("_inside", inside).join(totals, ["_part", *by]).withColumn("before", F.col("_start") + F.col("_inside")).drop("_part", "_inside", "_start")


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """``by``, a column per entry of ``at`` with that exact percentile of ``value`` (interpolated between neighbours), and n, the readings.

    Nulls and NaN are no readings; a group without any has no row. A sketch, which combines before the shuffle, gives two edges around
    each percentile; rows are counted per stretch between edges; only the stretches that hold the ranks asked for, about MARGIN of a
    group on either side, are counted by value and ordered. The result is exact however far off the sketch is."""
    v = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    near = sorted({min(max(q + s * MARGIN, 0.0), 1.0) for q in at.values() for s in (-1, 1)})
    edges = F.array_sort(F.array_distinct(F.percentile_approx("_v", near, accuracy)))
    e = materialize((v.groupBy(*by) if by else v.groupBy()).agg(edges.alias("_edges"), F.count("*").alias("n")).where("n > 0"), "edges")
    spread = lambda rows, g: join_groups(rows, g.withColumn("_size", F.col("n")), by, "_size", "_v") if by else rows.join(F.broadcast(g))
    stretch = F.size(F.filter("_edges", lambda x: x < F.col("_v"))).alias("_at")
    counts = spread(v, e.select(*by, "_edges", "n")).groupBy(*by, "n", stretch).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by, "n").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0)))
    ranks = []
    for name, q in at.items():
        p = (F.col("n") - 1) * q
        ranks += [F.struct(F.lit(name).alias("name"), r.cast("bigint").alias("rank"), (1 - F.abs(p - r)).alias("share")) for r in (F.floor(p), F.floor(p) + 1)]
    held = lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_k")) & (r["share"] > 0)
    needed = counts.withColumn("_ranks", F.filter(F.array(*ranks), held)).where("size(_ranks) > 0")
    needed = materialize(needed.select(*by, "n", "_at", "_before", "_ranks"), "stretches")
    which = e.select(*by, "_edges", "n").join(needed.groupBy(*by).agg(F.collect_set("_at").alias("_needed")), by) if by else e.select("_edges", "n").join(F.broadcast(needed.agg(F.collect_set("_at").alias("_needed"))))
    rows = spread(v, which).withColumn("_at", F.size(F.filter("_edges", lambda x: x < F.col("_v")))).where(F.array_contains("_needed", F.col("_at")))
    c = rows.groupBy(*by, "_at", "_v").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by, "_at").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_inside", F.coalesce(F.sum("_k").over(w), F.lit(0))).join(needed, [*by, "_at"])
    low = F.col("_before") + F.col("_inside")
    c = c.withColumn("_ranks", F.filter("_ranks", lambda r: (r["rank"] >= low) & (r["rank"] < low + F.col("_k")))).select(*by, "n", "_v", F.explode("_ranks").alias("_r"))
    return c.groupBy(*by, "n").agg(*[F.sum(F.when(F.col("_r.name") == name, F.col("_v") * F.col("_r.share"))).alias(name) for name in at])


def median_of(sorted_values: Column) -> Column:
    """The median of a sorted array without nulls; null if it is empty."""
    n = F.size(sorted_values)
    at = lambda k: F.get(sorted_values, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
