"""Queries of the general data problems 1, 3 and 4 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyomics.operators import impute, units, wide
from polyomics.plans import problem_sql
from polyomics.plans.registry import table
from polyomics.session import materialize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.same_quantity(_quantities(spark, d))


def p1_quantities(spark: SparkSession, d: str) -> DataFrame:
    return _quantities(spark, d).withColumns({c: F.round(c, 6) for c in ("number", "value")})


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    return units.quantities(table(spark, d, "medium_component"), table(spark, d, "medium"), table(spark, d, "component_ref"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    profiles = impute.fill_keys(table(spark, d, "layer_matrix"))
    return impute.gaps(profiles, impute.fill_vectors(profiles, table(spark, d, "layer_axis")))


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    f = impute.fill_cells(impute.fill_keys(table(spark, d, "layer_matrix")), table(spark, d, "layer_axis"))
    return f.withColumn("value", F.round("value", 6))


def _strain_cells(spark: SparkSession, d: str) -> DataFrame:
    return wide.strain_cells(table(spark, d, "strain_feature"), table(spark, d, "feature_def"))


def _medium_cells(spark: SparkSession, d: str) -> DataFrame:
    return wide.medium_cells(table(spark, d, "medium_component"), table(spark, d, "medium"), table(spark, d, "component_ref"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.unsettled(_strain_cells(spark, d), "strain").unionByName(wide.unsettled(_medium_cells(spark, d), "medium"))


def p4_strains(spark: SparkSession, d: str) -> DataFrame:
    """One row per strain; the columns are the fixed list of definitions (some dozens of rows read by the driver)."""
    columns = {r["feature"]: r["value_type"] for r in table(spark, d, "feature_def").orderBy("feature").collect()}
    return wide.project(_strain_cells(spark, d), columns)


def p4_failures(spark: SparkSession, d: str) -> DataFrame:
    """Every text that is no value of its attribute's type."""
    return wide.failures(table(spark, d, "strain_feature"), table(spark, d, "feature_def"))


def p4_media(spark: SparkSession, d: str) -> DataFrame:
    columns = {r["component"]: "decimal" for r in table(spark, d, "component_ref").orderBy("component").collect()}
    return wide.project(_medium_cells(spark, d), columns)


QUERIES = {"p1_found": p1_found, "p1_quantities": p1_quantities, "p3_found": p3_found, "p3_filled": p3_filled, "p4_found": p4_found, "p4_strains": p4_strains, "p4_failures": p4_failures, "p4_media": p4_media}

UNKNOWN = ", ".join(f"'{u}'" for u in impute.UNKNOWN_PART)
MISSING = ", ".join(str(m) for m in impute.NO_READING)
#: The same by windows and lists, for one machine.
_GAPS = f"""WITH m AS (SELECT DISTINCT ON (profile_id) profile_id, layer, run_id, condition_key, cell_values FROM layer_matrix ORDER BY profile_id, loaded_at),
k AS (SELECT *, CASE WHEN len(string_split(condition_key, '.')) = 4 AND len(list_filter(string_split(condition_key, '.'), lambda p: lower(trim(p)) IN ({UNKNOWN}))) = 0 THEN trim(condition_key) END AS own,
list_transform(cell_values, lambda v: CASE WHEN isfinite(v) AND v NOT IN ({MISSING}) THEN v END) AS v FROM m),
r AS (SELECT *, len(list_filter(v, lambda x: x <> 0)) > 0 AS live FROM k),
n AS (SELECT layer, run_id, own, count(*) AS n FROM r WHERE own IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL), b AS (SELECT DISTINCT ON (layer, run_id) layer, run_id, own AS mode FROM n ORDER BY layer, run_id, n DESC, own),
f AS (SELECT r.*, coalesce(own, mode) AS key FROM r LEFT JOIN b USING (layer, run_id)),
c AS (SELECT profile_id, layer, key, molecule_id, CASE WHEN live THEN v[idx + 1] END AS x FROM f JOIN layer_axis USING (layer)),
h AS (SELECT layer, key, molecule_id, count(x) AS h FROM c WHERE key IS NOT NULL GROUP BY ALL)"""
SQL: dict[str, str] = problem_sql.SQL | {
    "p3_found": f"""{_GAPS}
SELECT profile_id, 'condition_key' AS field_name, coalesce(key, 'unfilled') AS outcome FROM f WHERE own IS NULL
UNION ALL SELECT profile_id, molecule_id, CASE WHEN coalesce(h, 0) > 0 THEN 'filled' ELSE 'unfilled' END FROM c LEFT JOIN h USING (layer, key, molecule_id) WHERE x IS NULL""",
    "p3_filled": f"""{_GAPS}, c2 AS (SELECT c.*, run_id FROM c JOIN f USING (profile_id)),
byrun AS (SELECT layer, key, molecule_id, run_id, median(x) AS mr, count(x) AS nr FROM c2 WHERE key IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL), bykey AS (SELECT layer, key, molecule_id, median(x) AS mc FROM c2 WHERE key IS NOT NULL GROUP BY ALL)
SELECT profile_id, layer, key AS condition_key, molecule_id, round(coalesce(x, CASE WHEN nr >= 2 THEN mr END, mc), 6) AS value, CASE WHEN x IS NOT NULL THEN 'read' WHEN nr >= 2 THEN 'run' WHEN mc IS NOT NULL THEN 'condition' ELSE 'unfilled' END AS flag
FROM c2 LEFT JOIN byrun USING (layer, key, molecule_id, run_id) LEFT JOIN bykey USING (layer, key, molecule_id)""",
}
