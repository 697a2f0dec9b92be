"""Profiles as long rows and as vectors: conversion, condition averages, alignment of layers, selections.

A long frame has profile_id, condition_key, molecule_id, value (null or no row where there is no reading); a vector frame has
profile_id, condition_key, values, whose positions are an axis (idx, molecule_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyomics.functions.canon import is_wild_type
from polyomics.operators.ranks import cumulative


def finite(c: Column) -> Column:
    """The value, null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def to_long(vectors: DataFrame, axis: DataFrame | None = None, values: str = "values") -> DataFrame:
    """Vector to long rows without the cells that hold no reading. Without an axis the molecule_id is the position."""
    rest = [c for c in vectors.columns if c != values]
    long = vectors.select(*rest, F.posexplode(values).alias("idx", "value")).withColumn("value", finite(F.col("value").cast("double"))).where("value is not null")
    if axis is None:
        return long.withColumnRenamed("idx", "molecule_id")
    keys = ["layer", "idx"] if "layer" in axis.columns and "layer" in rest else ["idx"]
    return long.join(F.broadcast(axis.select(*keys, "molecule_id")), keys).drop("idx")


def to_vectors(long: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows to vectors over ``axis`` (idx from 0, molecule_id), null where there is no row; a duplicate cell is an error."""
    size = axis.agg((F.max("idx") + 1).cast("int").alias("_size"))
    cells = long.join(F.broadcast(axis.select("idx", "molecule_id")), "molecule_id").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), "value"))).alias("_cells"))
    values = F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: F.try_element_at("_cells", i))
    return cells.join(F.broadcast(size)).select(*keys, values.alias("values"))


def average_by_condition(long: DataFrame, *by: str) -> DataFrame:
    """Mean of the readings of each molecule under each condition (and ``by``)."""
    return long.groupBy(*by, "condition_key", "molecule_id").agg(F.avg("value").alias("value"))


def shared_conditions(profiles: DataFrame, layers: list[str]) -> DataFrame:
    """condition_key of the conditions that every one of the layers has: one aggregation, whatever the number of layers."""
    some = profiles.where(F.col("layer").isin(layers) & F.col("condition_key").isNotNull())
    return some.groupBy("condition_key").agg(F.collect_set("layer").alias("l")).where(F.size("l") == len(set(layers))).select("condition_key")


def aligned(long: DataFrame, layers: list[str], ordered: bool = False) -> DataFrame:
    """condition_key, layer, molecule_id, value: condition means of the layers over the conditions they share; ``ordered``: sorted by
    them, for a hand-over to code outside Spark."""
    means = average_by_condition(long.where(F.col("layer").isin(layers)), "layer")
    a = means.join(shared_conditions(long, layers), "condition_key", "left_semi")
    return a.orderBy("condition_key", "layer", "molecule_id") if ordered else a


def condition_index(profiles: DataFrame) -> DataFrame:
    """condition_key, profile_id, place: each condition's profiles in order, counted from 0. Rows, not one array per condition, as a
    condition may have any number of profiles; a null key has no place."""
    d = profiles.where("condition_key is not null and profile_id is not null").groupBy("condition_key", "profile_id").agg(F.lit(1).cast("bigint").alias("one"))
    return cumulative(d, ["condition_key"], "profile_id", "one").select("condition_key", "profile_id", F.col("before").alias("place"))


def average_probes(long: DataFrame, genes: DataFrame) -> DataFrame:
    """profile_id, gene, value: the mean over the probes of each gene. ``genes``: molecule_id (the probe), gene; probes without one are left
    out."""
    return long.join(genes.select("molecule_id", "gene").distinct(), "molecule_id").groupBy("profile_id", "gene").agg(F.avg("value").alias("value"))


def overlaps(profiles: DataFrame) -> DataFrame:
    """layer_a, layer_b, shared: how many conditions each pair of layers shares, the diagonal being their own. Pairs are made within
    a condition's set of layers, which is as long as the list of layers at most."""
    sets = profiles.where("condition_key is not null").groupBy("condition_key").agg(F.collect_set("layer").alias("l"))
    return sets.select(F.explode("l").alias("layer_a"), "l").select("layer_a", F.explode("l").alias("layer_b")).groupBy("layer_a", "layer_b").agg(F.count("*").alias("shared"))


def subset(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("condition_key").distinct(), "condition_key", "left_semi")


def strict_wild_type(df: DataFrame, strain: str, media: DataFrame) -> DataFrame:
    """Rows of the strain on LB or M9 without stress or perturbation. ``media``: medium_id, base_medium, description."""
    lb = lambda c: F.upper(F.trim(F.coalesce(c, F.lit("")))).rlike("^(LB|M9)")
    ids = media.where(lb(F.col("base_medium")) | lb(F.col("description"))).select("medium_id").distinct()
    part = lambda k: F.split_part("condition_key", F.lit("."), F.lit(k))
    d = df.withColumn("medium_id", part(2)).where((part(1) == strain) & part(3).isin("none", "na", "") & is_wild_type(F.col("condition_key")))
    return d.join(ids, "medium_id", "left_semi").drop("medium_id")


def testable(conditions: DataFrame, attributes: list[str]) -> DataFrame:
    """The distinct rows of ``conditions`` each of whose ``attributes`` occurs in another one too; null attributes don't.

    All attributes are counted in one aggregation of (attribute, value), with map-side combining; the values that occur once, which are
    the ones that fail a row, are each one row's, so that their join meets no hot key."""
    c = conditions.distinct().withColumn("_row", F.struct(*conditions.columns))
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])).alias("p")
    rare = c.select("_row", pair).groupBy("p.attribute", "p.value").agg(F.count("*").alias("n"), F.min("_row").alias("_row")).where("n = 1")
    nulls = reduce(lambda x, y: x | y, [F.col(a).isNull() for a in attributes])
    return c.where(~nulls).join(rare.select("_row"), "_row", "left_anti").select(*conditions.columns)


def fallback_mean(targets: DataFrame, long: DataFrame) -> DataFrame:
    """condition_key, molecule_id, value: the condition's own mean, else the molecule's mean over all profiles."""
    own = average_by_condition(long)
    overall = long.groupBy("molecule_id").agg(F.avg("value").alias("overall"))
    grid = targets.select("condition_key").distinct().crossJoin(F.broadcast(overall))  # by the axis
    return grid.join(own, ["condition_key", "molecule_id"], "left").select("condition_key", "molecule_id", F.coalesce("value", "overall").alias("value"))


def missingness_filter(long: DataFrame, genes: DataFrame, profiles: DataFrame, most: float = 0.70) -> DataFrame:
    """The cells of genes that miss at most ``most`` of all profiles, then of profiles that miss at most that of the genes kept.
    Denominators are the whole axes, not the rows that are there."""
    n = profiles.select("profile_id").distinct().agg(F.count("*").alias("n"))
    kept = long.groupBy("molecule_id").agg(F.count("value").alias("k")).join(F.broadcast(n)).where(1 - F.col("k") / F.col("n") <= most).select("molecule_id")
    g = genes.select("molecule_id").distinct().join(kept, "molecule_id", "left_semi")
    m = g.agg(F.count("*").alias("m"))
    some = long.join(g, "molecule_id", "left_semi")
    good = some.groupBy("profile_id").agg(F.count("value").alias("k")).join(F.broadcast(m)).where(1 - F.col("k") / F.col("m") <= most).select("profile_id")
    return some.join(good, "profile_id", "left_semi")


def shared_genes(long: DataFrame, group: str, least: int = 1) -> DataFrame:
    """The cells of the genes that every group (platform, sample) has; an error if they are fewer than ``least``."""
    n = long.agg(F.count_distinct(group).alias("n"))
    genes = long.groupBy("molecule_id").agg(F.count_distinct(group).alias("k")).join(F.broadcast(n)).where("k = n").select("molecule_id")
    if least and genes.limit(least).count() < least:
        raise ValueError(f"fewer than {least} shared genes")
    return long.join(genes, "molecule_id", "left_semi")


def top_variance(long: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k molecules of each group of ``by`` with the largest population variance; ties by molecule_id. Those without readings come last."""
    v = long.groupBy(*by, "molecule_id").agg(F.var_pop("value").alias("variance"))
    order = [F.col("variance").desc_nulls_last(), F.col("molecule_id")]
    v = v if by else v.orderBy(*order).limit(k).withColumn("_all", F.lit(0))  # then the window below has k rows
    w = Window.partitionBy(*(by or ["_all"])).orderBy(*order)
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_all")
