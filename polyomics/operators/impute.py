"""Problem 3: gaps in layer profiles filled from similar profiles, every gap marked.

Hierarchical group statistics: a condition key is filled by the mode of its run, a cell by the median of the finest group with
enough support: the run, then all profiles of the layer under the same condition key. Profiles stay vectors and are shuffled once;
only groups of more than GROUP profiles are taken apart into cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyomics.operators.ranks import median_of, quantiles
from polyomics.operators.skew import LISTED, join_groups
from polyomics.session import materialize

#: Profiles of a (layer, condition key) up to which its vectors are one row; those of larger groups are joined with medians.
GROUP = 1_000

#: What a cell's flag says, by its code.
FLAGS = ["read", "run", "condition", "unfilled"]

# Parts of a condition key that say nothing, and readings instruments write for "no reading".
UNKNOWN_PART = ["", "?", "n/d", "nd", "na", "n/a", "nan", "null", "unknown", "unk", "tbd"]
NO_READING = [-999.0, -9999.0, -99999.0, -999999.0]


def full_key(key: Column) -> Column:
    """The key if it has exactly four parts and each says something, else null. ``none`` (no stress, wild type) says something."""
    parts = F.split(key, r"\.", -1)
    known = F.forall(parts, lambda p: ~F.lower(F.trim(p)).isin(UNKNOWN_PART))
    return F.when((F.size(parts) == 4) & known, F.array_join(F.transform(parts, lambda v: F.trim(v)), "."))


def readings(cells: Column) -> Column:
    """Cells with null for each that holds no reading: null, NaN, infinite, a marker such as -9999. All null where no reading
    differs from 0 (a placeholder profile). A null array stays null."""
    r = F.transform(cells, lambda x: F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) & ~x.isin(NO_READING), x))
    some = F.exists(r, lambda x: x.isNotNull() & (x != 0))
    return F.when(F.coalesce(some, F.lit(False)), r).otherwise(F.transform(r, lambda x: F.lit(None).cast("double")))


def fill_keys(matrix: DataFrame) -> DataFrame:
    """profile_id, layer, run_id, values (null without reading), condition_key (full or null), key_filled (0/1) of each row of ``matrix``.

    A missing or incomplete key becomes the full key most frequent among the profiles of the same layer and run (ties: the smaller key).
    A null profile_id is left out; a null run fills nothing. Rows that come again (same profile_id) stay, but count once towards the
    mode; :func:`fill_cells` drops them. A run of any size is reduced to its distinct keys by partial aggregation, and only the rows
    whose key is missing are joined with the modes, hot runs salted."""
    m = matrix.where("profile_id is not null").select("profile_id", "layer", "run_id", full_key(F.col("condition_key")).alias("_own"), F.col("cell_values").alias("values"))
    counted = m.where("run_id is not null").groupBy("layer", "run_id", "profile_id").agg(F.max("_own").alias("_own"))
    counts = counted.groupBy("layer", "run_id", "_own").agg(F.count("*").alias("n"))
    mode = F.min(F.when(F.col("_own").isNotNull(), F.struct(-F.col("n"), F.col("_own")))).getField("_own")
    modes = counts.groupBy("layer", "run_id").agg(mode.alias("_mode"), F.coalesce(F.sum(F.when(F.col("_own").isNull(), F.col("n"))), F.lit(0)).alias("_gaps")).where("_gaps > 0 and _mode is not null")
    found = join_groups(m.where("_own is null"), modes, ["layer", "run_id"], "_gaps", "profile_id")
    filled = found.select("profile_id", "layer", "run_id", readings(F.col("values")).alias("values"), F.col("_mode").alias("condition_key"), F.lit(1).alias("key_filled"))
    own = m.where("_own is not null").select("profile_id", "layer", "run_id", readings(F.col("values")).alias("values"), F.col("_own").alias("condition_key"), F.lit(0).alias("key_filled"))
    return own.unionByName(filled)


def _position_medians(rows: Column, least: int) -> Column:
    """The median at each position of the ``values`` of ``rows``, null where fewer than ``least`` have a reading."""
    at = F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))["values"]) - 1)
    sorted_at = lambda i: F.array_sort(F.array_compact(F.transform(rows, lambda r: F.get(r["values"], i))))
    return F.transform(at, lambda i: F.get(F.transform(F.array(sorted_at(i)), lambda s: F.when(F.size(s) >= least, median_of(s))), F.lit(0)))


def _filled(values: Column, run: Column, condition: Column) -> Column:
    """array of struct(value, flag): each position's own reading, else the run's median, else the condition's; flag is its code."""
    def cell(x: Column, i: Column) -> Column:
        r, c = F.get(run, i), F.get(condition, i)
        flag = F.when(x.isNotNull(), 0).when(r.isNotNull(), 1).when(c.isNotNull(), 2).otherwise(3).cast("tinyint")
        return F.struct(F.coalesce(x, r, c).alias("value"), flag.alias("flag"))

    return F.transform(values, cell)


_OUT = ["profile_id", "layer", "condition_key", "axis", "cells"]


def _small_groups(p: DataFrame, min_support: int) -> DataFrame:
    """One shuffle by (layer, condition_key); runs, then the condition, are rows of arrays within it."""
    one = p.repartition("layer", "condition_key").groupBy("layer", "condition_key", "run_id", "profile_id").agg(F.max("values").alias("values"), F.max("axis").alias("axis"))
    runs = one.groupBy("layer", "condition_key", "run_id").agg(F.collect_list(F.struct("profile_id", "values")).alias("rows"), F.max("axis").alias("axis"))
    runs = runs.withColumn("med", F.when(F.col("run_id").isNotNull(), _position_medians(F.col("rows"), min_support)))
    groups = runs.groupBy("layer", "condition_key").agg(F.collect_list(F.struct("rows", "med")).alias("runs"), F.max("axis").alias("axis"))
    groups = groups.withColumn("med", _position_medians(F.flatten(F.transform("runs", lambda u: u["rows"])), 1))
    each = groups.select("layer", "condition_key", "axis", "med", F.explode("runs").alias("u")).select("layer", "condition_key", "axis", "med", F.col("u.med").alias("run_med"), F.explode("u.rows").alias("r"))
    return each.select(F.col("r.profile_id").alias("profile_id"), "layer", "condition_key", "axis", _filled(F.col("r.values"), F.col("run_med"), F.col("med")).alias("cells"))


def _large_groups(p: DataFrame, min_support: int) -> DataFrame:
    """The same for groups of any size: exact medians of their cells, as arrays joined to the profiles with hot groups salted."""
    one = p.groupBy("layer", "condition_key", "profile_id").agg(F.max(F.struct("run_id", "values", "axis")).alias("r")).select("layer", "condition_key", "profile_id", "r.*")
    cells = one.select("layer", "condition_key", "run_id", "profile_id", F.posexplode("values").alias("at", "value"))

    def medians(by: list[str], least: int, name: str) -> DataFrame:
        q = quantiles(cells.where("run_id is not null") if "run_id" in by else cells, [*by, "at"], "value", {name: 0.5})
        q = q.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", F.when(F.col("n") >= least, F.col(name)).alias("v")))).alias("m"))
        wide = p.groupBy("layer").agg(F.max(F.size("values")).alias("width"))
        size = one.groupBy(*by).agg(F.count("*").alias("_size"))
        arrays = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.try_element_at("m", i))
        return q.join(wide, "layer").join(size, by).select(*by, arrays.alias(name), "_size")

    condition, run = ["layer", "condition_key"], ["layer", "condition_key", "run_id"]
    j = join_groups(one, medians(condition, 1, "med"), condition, "_size", "profile_id")
    j = join_groups(j, medians(run, min_support, "run_med"), run, "_size", "profile_id")
    return j.select("profile_id", "layer", "condition_key", "axis", _filled(F.col("values"), F.coalesce("run_med", F.lit(None).cast("array<double>")), F.coalesce("med", F.lit(None).cast("array<double>"))).alias("cells"))


def fill_vectors(profiles: DataFrame, axis: DataFrame, min_support: int = 2, group: int = GROUP) -> DataFrame:
    """One row per profile: profile_id, layer, condition_key, axis (molecule ids) and cells, an array of struct(value, flag) along it.

    See :func:`fill_cells`. ``profiles`` comes from :func:`fill_keys`; its keys are read once more to find the groups of more than
    ``group`` profiles, whose number is that of all profiles through ``group`` at most."""
    a = axis.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("idx", "molecule_id"))).alias("axis"))
    along = F.transform("axis", lambda m: F.get("values", m["idx"].cast("int")))
    p = profiles.join(F.broadcast(a), "layer").select("profile_id", "layer", "run_id", "condition_key", along.alias("values"), F.transform("axis", lambda m: m["molecule_id"]).alias("axis"))
    keyed = p.where("condition_key is not null")
    large = materialize(profiles.where("condition_key is not null").groupBy("layer", "condition_key").agg(F.count("*").alias("_n")).where(F.col("_n") > group), "large")
    n = large.count()
    free = p.where("condition_key is null").groupBy("profile_id", "layer").agg(F.max("values").alias("values"), F.max("axis").alias("axis"))
    free = free.select("profile_id", "layer", F.lit(None).cast("string").alias("condition_key"), "axis", _filled(F.col("values"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")).alias("cells"))
    if not n:
        return _small_groups(keyed, min_support).select(*_OUT).unionByName(free)
    marked = keyed.join(F.broadcast(large), ["layer", "condition_key"], "left") if n <= LISTED else join_groups(keyed, large.withColumn("_size", F.col("_n")), ["layer", "condition_key"], "_size", "profile_id")
    small, big = marked.where("_n is null").drop("_n"), marked.where("_n is not null").drop("_n")
    return _small_groups(small, min_support).select(*_OUT).unionByName(_large_groups(materialize(big, "big"), min_support).select(*_OUT)).unionByName(free)


def _cells(vectors: DataFrame, cells: Column) -> DataFrame:
    names = F.array(*map(F.lit, FLAGS))
    c = vectors.select("profile_id", "layer", "condition_key", F.explode(cells).alias("c"))
    return c.select("profile_id", "layer", "condition_key", "c.molecule_id", "c.value", F.get(names, F.col("c.flag").cast("int")).alias("flag"))


def _named() -> Column:
    return F.zip_with("axis", "cells", lambda m, c: F.struct(m.alias("molecule_id"), c["value"].alias("value"), c["flag"].alias("flag")))


def fill_cells(profiles: DataFrame, axis: DataFrame, min_support: int = 2, group: int = GROUP) -> DataFrame:
    """One row per profile and molecule of its layer: profile_id, layer, condition_key, molecule_id, value, flag.

    flag is ``read`` (own reading), ``run`` or ``condition`` (the group whose median it is) or ``unfilled`` (value null). The run
    serves if ``min_support`` of its profiles under the key have a reading, else the condition if any has. Profiles without a key
    have only ``read`` and ``unfilled`` cells. An array that is null or too short leaves its missing cells as gaps; cells beyond
    the axis are ignored. Rows that come again (same profile_id, layer, run and key) count once. ``axis`` has layer, idx,
    molecule_id; a layer without axis has no cells.
    """
    return _cells(fill_vectors(profiles, axis, min_support, group), _named())


def gaps(profiles: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per gap: profile_id, field_name (``condition_key`` or a molecule_id), outcome (the key, ``filled``, ``unfilled``).

    ``vectors`` comes from :func:`fill_vectors`; only the cells that were gaps are taken out of it."""
    keys = profiles.where("key_filled = 1").groupBy("profile_id").agg(F.max("condition_key").alias("condition_key"))
    keys = keys.select("profile_id", F.lit("condition_key").alias("field_name"), F.coalesce("condition_key", F.lit("unfilled")).alias("outcome"))
    cells = _cells(vectors, F.filter(_named(), lambda c: c["flag"] > 0))
    return keys.unionByName(cells.select("profile_id", F.col("molecule_id").alias("field_name"), F.when(F.col("flag") == "unfilled", "unfilled").otherwise("filled").alias("outcome")))
