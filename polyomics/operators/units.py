"""Problem 1: quantities recorded in different units, brought to each component's common unit.

Pure SQL: the number and the unit come out of the text by ``regexp_extract``, unit spellings are normalised by a join with the
alias table, the unit is the first there is of text, unit field and the statement of the medium, then factor and offset apply.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyomics.functions.quantity import QUANTITY, UNIT_IN_PROSE, or_null, plain_text, unit_text, with_number, with_unit
from polyomics.operators.skew import join_groups, join_salted
from polyomics.session import materialize

#: Two quantities are the same if they differ by at most this part of the larger.
TOLERANCE = 0.02
#: Media whose description states a unit, up to which they are broadcast (some dozen bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def same_name(c: Column) -> Column:
    """Component names compare without case, outer blanks and repeated blanks."""
    return F.regexp_replace(plain_text(c), r"\s+", " ")


def quantities(components: DataFrame, media: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per delivered mc_id: mc_id, medium_id, component (as in ``reference``), number, unit, unit_from, value, common_unit, outcome.

    outcome is ``converted``; ``no_number`` (no quantity is stated: blank, presence, strength, unknown); ``no_unit`` (a number
    without any unit); ``unknown_unit`` (a unit nobody knows, or one that can't be brought to the common unit: a molar statement of
    a mixture, % by volume without a density); ``unknown_component``. value is null unless converted.
    Rows that come again (same mc_id) count once; rows without mc_id are left out, as nothing can refer to them. A medium without
    a row, or with a null description, states no default. Empty tables give no rows. Columns other than those named are ignored.
    ``reference`` is the fixed list of components, some dozens of rows, and broadcast; media that state a unit are counted and broadcast
    while few, else joined with hot ones salted.
    """
    # What the texts say is read before the shuffle, so that two lean stages follow each other instead of one too large to be compiled.
    c = components.where("mc_id is not null").select("mc_id", "medium_id", same_name(F.col("component")).alias("_name"), "component", plain_text(F.col("raw")).alias("_raw"), F.col("amount").cast("double").alias("amount"), "unit")
    c = c.withColumns({"_text_unit": F.regexp_extract("_raw", QUANTITY, 2), "_n": F.regexp_extract("_raw", QUANTITY, 1), "_blank": F.coalesce(F.col("_raw") == "", F.lit(True))})
    c = with_number(c.withColumns({"_text_unit": unit_text(F.col("_text_unit")), "_unit": unit_text(F.col("unit"))}), "_n", "_stated_number")
    c = c.select("mc_id", "medium_id", "_name", "component", "_text_unit", "_unit", "_blank", F.when(F.col("_blank"), F.col("amount")).otherwise(F.col("_stated_number")).alias("number"))
    c = c.repartition("mc_id").dropDuplicates(["mc_id"])  # so it is sorted once, not before and after the shuffle
    m = media.groupBy("medium_id").agg(F.max("description").alias("description"))
    m = or_null(m.select("medium_id", unit_text(F.regexp_extract(plain_text(F.col("description")), UNIT_IN_PROSE, 1)).alias("_stated")), "_stated").where("_stated is not null")
    m = materialize(m, "stated")
    r = reference.groupBy(same_name(F.col("component")).alias("_name")).agg(
        F.max("component").alias("_ref"), F.max("molar_mass").alias("molar_mass"), F.max("density_g_ml").alias("density"), F.max("common_unit").alias("common_unit")
    )
    if m.count() <= BROADCAST_ROWS:
        c = c.join(F.broadcast(m), "medium_id", "left")
    else:
        m = m.join(components.where("mc_id is not null").groupBy("medium_id").agg(F.count("*").alias("_size")), "medium_id")
        c = join_groups(c, m, ["medium_id"], "_size", "mc_id")
    c = or_null(c.join(F.broadcast(r), "_name", "left"), "_text_unit", "_unit")
    blank = F.col("_blank")
    c = c.withColumns({
        "unit": F.when(blank, F.col("_unit")).otherwise(F.coalesce("_text_unit", "_unit", "_stated")),
        "unit_from": F.when(~blank & F.col("_text_unit").isNotNull(), "text").when(F.col("_unit").isNotNull(), "field").when(~blank & F.col("_stated").isNotNull(), "medium"),
    })
    c = with_unit(c, "unit")
    base = F.col("number") * F.col("u_factor") + F.col("u_offset")
    grams = F.when(F.col("u_kind") == "mass", base).when(F.col("u_kind") == "v/v", base * F.col("density"))
    value = F.when(F.col("common_unit") == "mM", F.when(F.col("u_kind") == "molar", base).otherwise(grams * 1000 / F.col("molar_mass"))).when(
        F.col("common_unit") == "g/L", F.coalesce(grams, F.when(F.col("u_kind") == "molar", base * F.col("molar_mass") / 1000))
    )
    ok = F.col("number").isNotNull() & ~F.isnan("number")
    outcome = F.when(~ok, "no_number").when(F.col("unit").isNull(), "no_unit").when(F.col("_ref").isNull(), "unknown_component").when(value.isNull(), "unknown_unit").otherwise("converted")
    return c.select(
        "mc_id", "medium_id", F.coalesce("_ref", F.col("component")).alias("component"), F.when(ok, F.col("number")).alias("number"), "unit", "unit_from",
        F.when(ok, value).alias("value"), "common_unit", outcome.alias("outcome"),
    )


def same_quantity(q: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs mc_id_a < mc_id_b of a medium and component whose non-zero values differ by at most ``tolerance`` of the larger.

    A band join: values fall into logarithmic bins as wide as the tolerance, so that partners lie in the same or the next bin, each
    row is looked for in its own and the one above, and the equi-join on (medium, component, bin) never sees the other rows of a group. A bin that very many rows share is split over
    tasks, as its pairs are as many as its rows squared. ``q`` is computed once and written. Null media or components pair with nothing.
    """
    width = -math.log1p(-tolerance)
    v = q.where("value > 0 and medium_id is not null and component is not null").select("mc_id", "medium_id", "component", "value", F.floor(F.log("value") / width).alias("bin"))
    v = materialize(v, "values")
    side = F.explode(F.array(F.struct(F.col("bin").alias("bin"), F.lit(True).alias("same")), F.struct((F.col("bin") + 1).alias("bin"), F.lit(False).alias("same")))).alias("s")
    a = v.select(F.col("mc_id").alias("a"), "medium_id", "component", F.col("value").alias("x"), side).select("a", "medium_id", "component", "x", "s.bin", "s.same")
    b = v.select(F.col("mc_id").alias("b"), "medium_id", "component", F.col("value").alias("y"), "bin")
    near = F.abs(F.col("x") - F.col("y")) <= tolerance * F.greatest("x", "y")
    pairs = join_salted(a, b, ["medium_id", "component", "bin"], "a").where(near & (~F.col("same") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("mc_id_a"), F.greatest("a", "b").alias("mc_id_b"))
