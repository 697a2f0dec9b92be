"""Problem 4: attribute-value rows into one typed row per entity.

Each entity's resolved pairs are aggregated into a map attribute -> cell, from which known attributes are projected into typed
columns; what could not be settled stays in the cell as its outcome, with the values in conflict and the texts that couldn't be cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyomics.functions.quantity import NUMBER, with_number
from polyomics.operators.units import TOLERANCE, quantities

# The spellings of a flag, what says nothing, the names of months.
TRUE = ["yes", "y", "true", "t", "1", "+", "pos", "positive", "present"]
FALSE = ["no", "n", "false", "f", "0", "-", "none", "neg", "negative", "absent"]
SILENT = ["", "na", "?"]
SILENT_UNLESS_FLAG = ["no", "none", "-"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

SQL_TYPE = {"flag": "boolean", "integer": "bigint", "decimal": "double", "category": "string", "day": "date"}


def name_key(c: Column) -> Column:
    """Letters and digits in lower case: how spellings of an accession or attribute compare."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


# How days are written, with the groups that hold year, month and day, and whether the month is a name.
DAY_FORMS = [
    (r"^(\d{4})([-/.]?)(\d{2})\2(\d{2})$", (1, 3, 4), False),
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", (1, 3, 4), False),
    (r"^(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})$", (3, 2, 1), False),
    (r"^(\d{1,2})\.?[\s-]+([a-z]{3,9})\.?,?[\s-]+(\d{4})$", (3, 2, 1), True),
    (r"^([a-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})$", (3, 1, 2), True),
]
STATED = rf"^(?:(?:[~=≈]|ca\.?|approx\.?|about|circa)\s*)?({NUMBER})\s*(.*)$"


def _day(t: str) -> Column:
    """year-month-day as text if column ``t`` has one of the forms, whether or not that day exists."""
    forms = []
    for pattern, groups, named in DAY_FORMS:
        y, m, d = (F.regexp_extract(t, pattern, k) for k in groups)
        m = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(m, 1, 3)).cast("string") if named else m
        forms.append(F.when(F.col(t).rlike(pattern), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))))
    return F.coalesce(*forms)


def with_typed(df: DataFrame, value: str, kind: str, unit: str) -> DataFrame:
    """Adds says (does the value say something) and text (the value of the declared type as canonical text, null if unreadable).

    A number may have a sign of approximation before it and the declared unit after it; an integer must be whole; a day complete
    and existing. The steps are columns of their own, so that no expression is evaluated twice."""
    df = df.withColumn("_t", F.trim(F.lower(F.translate(value, "\u00a0\t\r\n", "    "))))
    is_number = F.col(kind).isin("integer", "decimal")
    df = df.withColumns({"_n": F.when(is_number, F.regexp_extract("_t", STATED, 1)), "_rest": F.when(is_number, F.regexp_extract("_t", STATED, 2)), "_d": F.when(F.col(kind) == "day", _day("_t"))})
    df = with_number(df, "_n", "_x")
    df = df.withColumn("_x", F.when((F.col("_rest") == "") | (F.col("_rest") == F.lower(F.coalesce(F.col(unit), F.lit("")))), F.col("_x")))
    flag = F.when(F.col("_t").isin(TRUE), "true").when(F.col("_t").isin(FALSE), "false")
    whole = F.when((F.col("_x") == F.floor("_x")) & (F.abs("_x") < 9e15), F.col("_x").cast("bigint").cast("string"))
    day = F.when(F.col("_d").try_cast("date").isNotNull(), F.col("_d"))
    k = F.col(kind)
    text = F.when(k == "flag", flag).when(k == "integer", whole).when(k == "decimal", F.col("_x").cast("string")).when(k == "day", day).when(k == "category", F.col("_t"))
    says = F.col("_t").isNotNull() & ~F.col("_t").isin(SILENT) & ((k == "flag") | ~F.col("_t").isin(SILENT_UNLESS_FLAG))
    return df.withColumns({"says": says, "text": text}).drop("_t", "_n", "_rest", "_d", "_x")


def _typed_rows(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """sf_id, entity, attribute, value, says, text of the rows that have a known strain and feature; of definitions spelt alike the first
    in order counts."""
    d = definitions.groupBy(name_key(F.col("feature")).alias("_key")).agg(F.min(F.struct(F.col("feature").alias("attribute"), "value_type", "unit")).alias("d")).select("_key", "d.*")
    r = rows.select("sf_id", "strain", "feature", "value").where("strain is not null").repartition("sf_id").dropDuplicates(["sf_id"])  # sorted once
    r = r.select("sf_id", F.upper(name_key(F.col("strain"))).alias("entity"), name_key(F.col("feature")).alias("_key"), "value").where("entity <> ''")
    return with_typed(r.join(F.broadcast(d), "_key"), "value", "value_type", "unit")


def failures(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """sf_id, entity, attribute, value: every row that says something which isn't a value of the declared type."""
    failed = F.when(F.col("says") & F.col("text").isNull(), F.array("value"))  # no filter, which would be copied into every step below
    return _typed_rows(rows, definitions).select("sf_id", "entity", "attribute", F.explode(failed).alias("value"))


def strain_cells(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per strain: entity and cells, a map attribute -> struct(value, outcome, lowest, highest, failed, n_failed) of the attributes
    its rows mention.

    ``rows``: sf_id, strain, feature, value; ``definitions``: feature, value_type, unit. Spellings of strain and feature compare by
    letters and digits; the entity is the accession so spelt, in upper case. Rows that come again (same sf_id) count once. outcome:
    ``value``, ``conflict`` (rows state different values, lowest and highest among them; value null), ``unreadable`` (some say something,
    none has a value), ``silent`` (none says anything). failed is the first in order of the n_failed texts that couldn't be cast, whatever
    the outcome; :func:`failures` lists all. Unknown features, and null strains or features, give no cell. All rows of a cell, however
    many, are folded by partial aggregation; the map of an entity is as long as the list of definitions at most.
    """
    said, failed = F.when(F.col("says"), F.col("text")), F.when(F.col("says") & F.col("text").isNull(), F.col("value"))
    c = _typed_rows(rows, definitions).groupBy("entity", "attribute").agg(F.min(said).alias("lo"), F.max(said).alias("hi"), F.max("says").alias("says"), F.min(failed).alias("failed"), F.count(failed).alias("n_failed"))
    outcome = F.when(F.col("lo").isNull(), F.when(F.col("says"), "unreadable").otherwise("silent")).when(F.col("lo") != F.col("hi"), "conflict").otherwise("value")
    return _maps(c.select("entity", "attribute", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"), outcome.alias("outcome"), F.col("lo").alias("lowest"), F.col("hi").alias("highest"), "failed", "n_failed"))


def medium_cells(components: DataFrame, media: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per medium: entity and cells, as :func:`strain_cells`, from the quantities of problem 1.

    value is the smallest of the non-zero quantities in the common unit if all agree within 2 %, as text; else ``conflict``, between lowest
    and highest. A cell without any non-zero quantity is ``silent``. failed is the smallest number that couldn't be brought to the common
    unit. Null media and unknown components give no cell.
    """
    q = quantities(components, media, reference).where("medium_id is not null and outcome <> 'unknown_component' and component is not null")
    q = q.join(F.broadcast(reference.select("component").distinct()), "component", "left_semi")
    v = F.when(F.col("value") > 0, F.col("value"))
    failed = F.when(F.col("outcome").isin("no_unit", "unknown_unit"), F.col("number"))  # a number, so that the aggregation needs no sort
    c = q.groupBy(F.col("medium_id").alias("entity"), F.col("component").alias("attribute")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.min(failed).alias("failed"), F.count(failed).alias("n_failed"))
    apart = F.col("hi") - F.col("lo") > TOLERANCE * F.col("hi")
    outcome = F.when(F.col("lo").isNull(), "silent").when(apart, "conflict").otherwise("value")
    text = lambda x: x.cast("string")
    return _maps(c.select("entity", "attribute", text(F.when(~apart, F.col("lo"))).alias("value"), outcome.alias("outcome"), text(F.col("lo")).alias("lowest"), text(F.col("hi")).alias("highest"), text(F.col("failed")).alias("failed"), "n_failed"))


def _maps(cells: DataFrame) -> DataFrame:
    pairs = F.collect_list(F.struct("attribute", F.struct("value", "outcome", "lowest", "highest", "failed", "n_failed").alias("cell")))
    return cells.groupBy("entity").agg(F.map_from_entries(pairs).alias("cells"))


def project(maps: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The wide table: entity, one column per entry of ``columns`` (attribute -> value_type), and in order of the attribute the arrays
    conflicts (attribute, lowest, highest), unreadable (attributes without a readable value) and failures (attribute, failed, n_failed: the
    first text that couldn't be cast and how many there are). An attribute without a cell is null."""
    cols = [F.col("cells")[a].getField("value").try_cast(SQL_TYPE[k]).alias(a) for a, k in columns.items()]
    some = lambda keep: F.array_sort(F.filter(F.map_entries("cells"), lambda e: keep(e["value"])))
    conflicts = F.transform(some(lambda c: c["outcome"] == "conflict"), lambda e: F.struct(e["key"].alias("attribute"), e["value"]["lowest"].alias("lowest"), e["value"]["highest"].alias("highest")))
    failed = F.transform(some(lambda c: c["n_failed"] > 0), lambda e: F.struct(e["key"].alias("attribute"), e["value"]["failed"].alias("failed"), e["value"]["n_failed"].alias("n_failed")))
    unreadable = F.transform(some(lambda c: c["outcome"] == "unreadable"), lambda e: e["key"])
    return maps.select("entity", *cols, conflicts.alias("conflicts"), unreadable.alias("unreadable"), failed.alias("failures"))


def unsettled(maps: DataFrame, kind: str) -> DataFrame:
    """entity_kind, entity, attribute, outcome of the cells of the map that their rows don't settle."""
    m = maps.select("entity", F.explode("cells").alias("attribute", "cell"))
    return m.where("cell.outcome in ('conflict', 'unreadable')").select(F.lit(kind).alias("entity_kind"), "entity", "attribute", F.col("cell.outcome").alias("outcome"))
