"""Constraint-based flux: levels and bounds of reactions from genes, media and expression, as Columns and joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyomics.functions.canon import strip


def gene_rule(rule: str | None, levels: Column) -> Column:
    """The level of a Boolean gene rule over a map gene -> level: ``and`` is the least and binds tighter, ``or`` the greatest of what is
    measured; null if nothing is. Unbalanced brackets are closed or ignored. The rule becomes an expression, evaluated in the JVM."""
    tokens = re.findall(r"\(|\)|[^\s()]+", rule or "")
    at = 0

    def joined(f, parts: list[Column]) -> Column | None:
        return None if not parts else parts[0] if len(parts) == 1 else f(*parts)

    def either() -> Column | None:
        nonlocal at
        parts = [both()]
        while at < len(tokens) and tokens[at].lower() == "or":
            at += 1
            parts.append(both())
        return joined(F.greatest, [p for p in parts if p is not None])

    def both() -> Column | None:
        nonlocal at
        parts = []
        while at < len(tokens) and tokens[at].lower() != "or" and tokens[at] != ")":
            t = tokens[at]
            at += 1
            if t == "(":
                parts.append(either())
                at += at < len(tokens) and tokens[at] == ")"
            elif t.lower() != "and":
                parts.append(F.try_element_at(levels, F.lit(t)))
        return joined(F.least, [p for p in parts if p is not None])

    out = either()
    while at < len(tokens):  # a bracket too many
        at += 1
        more = either()
        out = more if out is None else out if more is None else F.least(out, more)
    return F.lit(None).cast("double") if out is None else out


def reaction_levels(reactions: DataFrame, levels: DataFrame) -> DataFrame:
    """condition_key, reaction, level: the mean over a reaction's measured genes. ``reactions``: reaction, genes (array); ``levels``:
    condition_key, gene, layer, value. A protein's value is used before a transcript's; without any the reaction has no row."""
    best = levels.groupBy("condition_key", "gene").agg(F.coalesce(F.avg(F.when(F.col("layer") == "proteome", F.col("value"))), F.avg(F.when(F.col("layer") != "proteome", F.col("value")))).alias("v"))
    return best.join(F.broadcast(reactions.select("reaction", F.explode("genes").alias("gene"))), "gene").groupBy("condition_key", "reaction").agg(F.avg("v").alias("level"))


def bounds_from_expression(lb: Column, level: Column, threshold: float) -> Column:
    """Uptake is closed where the level is at most the threshold, else no tighter than 0; unmeasured bounds stay."""
    return F.when(level.isNull(), lb).when(level <= threshold, 0.0).otherwise(F.least(lb, F.lit(0.0)))


def medium_bounds(reactions: DataFrame, conditions: DataFrame, media: DataFrame) -> DataFrame:
    """condition_key, reaction, lb, ub: the model's bounds, the lower replaced where the condition's medium states one. ``reactions``:
    reaction, lb, ub; ``conditions``: condition_key, medium_id; ``media``: medium_id, reaction, bound. An unknown medium changes nothing."""
    grid = conditions.join(F.broadcast(reactions.select("reaction", "lb", "ub")))
    m = media.withColumnRenamed("bound", "stated")
    return grid.join(F.broadcast(m), ["medium_id", "reaction"], "left").select("condition_key", "reaction", F.coalesce("stated", "lb").alias("lb"), "ub")


def mappable(candidates: DataFrame, model: DataFrame) -> DataFrame:
    """reaction -> model_reaction: the first of the id, its upper case, and with ``_`` for ``-`` that the model has."""
    forms = F.posexplode(F.array("reaction", F.upper("reaction"), F.translate("reaction", "-", "_"))).alias("rank", "model_reaction")
    return candidates.select("reaction", forms).join(model.select(F.col("reaction").alias("model_reaction")).distinct(), "model_reaction", "left_semi").groupBy("reaction").agg(F.min_by("model_reaction", "rank").alias("model_reaction"))


def identified(reactions: DataFrame, column: str) -> DataFrame:
    """The rows whose identifier says something: neither null nor ``na``."""
    return reactions.where(F.col(column).isNotNull() & (F.lower(strip(F.col(column))) != "na"))


def rescaled(fluxes: DataFrame, uptake: str = "EX_glc__D_e") -> DataFrame:
    """Fluxes per 100 of glucose uptake; a condition whose uptake is within 1e-9 of 0 stays as it is."""
    g = fluxes.where(F.col("reaction") == uptake).groupBy("condition_key").agg(F.max(F.abs("flux")).alias("g"))
    return fluxes.join(g, "condition_key", "left").withColumn("flux", F.when(F.col("g") > 1e-9, F.col("flux") / F.col("g") * 100).otherwise(F.col("flux"))).drop("g")


def viable(predicted: DataFrame, by: list[str], least: float = 1e-6) -> DataFrame:
    """``by``, viable: whether at least half of the conditions have biomass above ``least``."""
    one = predicted.groupBy(*by, "condition_key").agg(F.max("biomass").alias("b"))
    return one.groupBy(*by).agg((F.avg((F.coalesce("b", F.lit(0.0)) > least).cast("int")) >= 0.5).alias("viable"))
