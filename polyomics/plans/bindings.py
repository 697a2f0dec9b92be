"""The driver's tables in the roles of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyomics.operators.impute import readings
from polyomics.plans.registry import table

#: SQL of the same bindings, to be put before an oracle's query.
CELLS = "e AS (SELECT vec_id AS profile_id, CAST(label AS VARCHAR) AS condition_key, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS molecule_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
FACTS = """f AS (SELECT l_orderkey AS profile_id, concat_ws('.', o_orderstatus, o_orderpriority, c_mktsegment, r_name) AS condition_key, p_brand AS molecule_id, l_quantity AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
LAYERS = "l AS (SELECT event_id AS profile_id, event_type AS layer, user_id AS condition_key, value FROM events)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """embeddings: profile = vec_id, condition = label, molecule = position."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("profile_id"), F.col("label").cast("string").alias("condition_key"), F.posexplode("embedding").alias("p", "v")).select(
        "profile_id", "condition_key", F.col("p").cast("bigint").alias("molecule_id"), F.col("v").cast("double").alias("value")
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("profile_id"), F.col("label").cast("string").alias("condition_key"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its dimensions: profile = order, condition = status.priority.segment.region, molecule = brand."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    key = F.concat_ws(".", "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name")
    return j.select(F.col("l_orderkey").alias("profile_id"), key.alias("condition_key"), F.col("p_brand").alias("molecule_id"), F.col("l_quantity").alias("value"))


def layers(spark: SparkSession, d: str) -> DataFrame:
    """events: layer = event type, condition = user, profile = event."""
    return table(spark, d, "events").select(F.col("event_id").alias("profile_id"), F.col("event_type").alias("layer"), F.col("user_id").alias("condition_key"), "value")


def matrix(spark: SparkSession, d: str, layer: str) -> DataFrame:
    """layer_matrix of one layer: profile_id, condition_key, values with null where there is no reading; a profile once."""
    m = table(spark, d, "layer_matrix").where(F.col("layer") == layer).dropDuplicates(["profile_id"])
    return m.select("profile_id", "condition_key", readings(F.col("cell_values")).alias("values"))


def axis(spark: SparkSession, d: str, layer: str) -> DataFrame:
    return table(spark, d, "layer_axis").where(F.col("layer") == layer).select("idx", "molecule_id")
