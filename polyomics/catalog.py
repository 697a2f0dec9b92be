"""The compendium: tables of strains, media, conditions, profiles and measurements, written as Parquet and queried as views.

``build`` takes the deliveries and gives the tables; ``write`` stores them, measurements partitioned by layer and in both layouts, long
rows and vectors; ``register`` makes views, so that ``spark.sql`` answers ad-hoc questions.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyomics.functions import canon, parse
from polyomics.operators import impute, matrix

TABLES = ["strain", "strain_feature", "medium", "medium_component", "stress", "perturbation", "condition", "condition_perturbation", "molecule", "reaction", "profile", "measurement", "vector", "flux", "phenotype", "source", "build_info"]
LAYERS = ["transcriptome", "proteome", "metabolome", "fluxome", "phenome"]


def _latest(df: DataFrame, keys: list[str], at: str = "loaded_at") -> DataFrame:
    """Last wins: of rows with the same keys the one loaded last, ties by content."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("r")).select(*keys, "r.*")


def build(deliveries: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The seventeen tables from strain, strain_feature, medium, medium_component, layer_matrix and layer_axis.

    Keys are the condition key itself, so that a rebuild gives the same ids. Missing cells are not stored."""
    d = deliveries
    t: dict[str, DataFrame] = {}
    t["strain"] = _latest(d["strain"].select("accession", "name", "link", "pmid", "alternate_names", "loaded_at"), ["accession"]).drop("loaded_at")
    t["strain_feature"] = _latest(d["strain_feature"].select("strain", "feature", "value", "loaded_at"), ["strain", "feature"]).select("strain", "feature", "value", parse.marker_present(F.col("value")).cast("int").alias("present"))
    t["medium"] = _latest(d["medium"].select("medium_id", "base_medium", "description", "link", "pmid", "defined", "loaded_at"), ["medium_id"]).drop("loaded_at")
    m = _latest(d["medium_component"].select("medium_id", canon.strip(F.col("component")).alias("component"), "raw", "loaded_at"), ["medium_id", "component"]).withColumn("a", parse.parse_amount(F.col("raw")))
    named = (F.col("raw") == "?") & ~F.col("a.present") & parse.named_in(F.col("component"), F.col("base_medium"), F.col("description"))
    m = m.join(t["medium"].select("medium_id", "base_medium", "description"), "medium_id", "left")
    t["medium_component"] = m.select("medium_id", "component", "raw", "a.amount", "a.unit", (F.col("a.present") | F.coalesce(named, F.lit(False))).cast("int").alias("present"))
    p = impute.fill_keys(d["layer_matrix"]).where("condition_key is not null").dropDuplicates(["profile_id"])
    key = p.select("condition_key").distinct().withColumn("k", canon.parse_condition(F.col("condition_key"), strict=False)).where("k is not null")
    t["condition"] = key.select("condition_key", "k.*", canon.is_wild_type(F.col("condition_key")).cast("int").alias("is_wildtype"))
    gp = t["condition"].select("condition_key", F.explode(canon.split_gp(F.col("gp"))).alias("p")).select("condition_key", F.concat("p.gene", F.lit("("), "p.type", F.lit(")")).alias("perturbation_id"), "p.gene", "p.type")
    t["condition_perturbation"] = gp.select("condition_key", "perturbation_id")
    t["perturbation"] = gp.select("perturbation_id", "gene", "type").distinct()
    t["profile"] = p.select("profile_id", F.col("run_id").alias("source_id"), "layer", "condition_key", F.lit(0).alias("is_averaged"))
    axis = d["layer_axis"].select("layer", "idx", "molecule_id")
    long = matrix.to_long(p.select("profile_id", "layer", "values"), axis)
    t["measurement"] = long.where("layer not in ('fluxome', 'phenome')").select("profile_id", "molecule_id", "value", "layer")
    t["vector"] = p.select("profile_id", "layer", "condition_key", "values").where("values is not null and exists(values, x -> x is not null)")
    t["flux"] = long.where("layer = 'fluxome'").select("profile_id", F.col("molecule_id").alias("reaction_id"), "value")
    t["phenotype"] = long.where("layer = 'phenome'").groupBy("profile_id").agg(*[F.max(F.when(F.col("molecule_id") == c, F.col("value"))).alias(c) for c in ("lag_time", "growth_rate", "final_od")])
    t["molecule"] = axis.where("layer <> 'fluxome'").groupBy("molecule_id").agg(F.min("layer").alias("kind"))
    t["reaction"] = axis.where("layer = 'fluxome'").select(F.col("molecule_id").alias("reaction_id")).distinct()
    stress = t["condition"].select("condition_key", F.explode(canon.split_stress(F.col("stress"))).alias("stress"))
    n = stress.join(t["profile"], "condition_key").groupBy("stress").agg(F.count("*").alias("n"))
    t["stress"] = stress.select("stress").distinct().join(n, "stress", "left").select("stress", F.coalesce("n", F.lit(0)).alias("n_profiles"))
    spark = d["layer_axis"].sparkSession
    t["source"] = spark.createDataFrame([(k, ",".join(v.columns)) for k, v in sorted(d.items())], "name string, note string")
    t["build_info"] = spark.range(1).select(F.lit("built_utc").alias("key"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("value"))
    return t


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Parquet, measurements partitioned by layer and sorted by profile within files, so that layer and profile predicates skip data."""
    for name, df in tables.items():
        w = df.sortWithinPartitions("profile_id").write if name in ("measurement", "vector") else df.write
        (w.partitionBy("layer") if name in ("measurement", "vector", "profile") else w).mode("overwrite").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in TABLES}


def register(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Views of all tables, and the two derived ones, under ``prefix`` + name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    condition_layers(tables).createOrReplaceTempView(prefix + "condition_layers")
    layer_summary(tables).createOrReplaceTempView(prefix + "layer_summary")


def condition_layers(t: dict[str, DataFrame]) -> DataFrame:
    """The layers each condition has; flags are null where it has no profile."""
    keys = ["condition_key", "strain", "medium_id", "stress", "gp"]
    j = t["condition"].select(*keys).join(t["profile"].select("condition_key", "profile_id", "layer"), "condition_key", "left")
    return j.groupBy(*keys).agg(*[F.max((F.col("layer") == n).cast("int")).alias(f"has_{n}") for n in LAYERS], F.count_distinct("profile_id").alias("n_profiles"))


def layer_summary(t: dict[str, DataFrame]) -> DataFrame:
    return t["profile"].groupBy("layer").agg(F.count("*").alias("n_profiles"), F.count_distinct("condition_key").alias("n_conditions"))


def integrity(t: dict[str, DataFrame]) -> DataFrame:
    """rule, violations: references that lead nowhere and repeated cells."""
    def orphans(rule: str, child: str, key: str, parent: str, parent_key: str) -> DataFrame:
        c = t[child].select(F.col(key).alias("_k")).where("_k is not null").join(t[parent].select(F.col(parent_key).alias("_k")), "_k", "left_anti")
        return c.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    twice = t["measurement"].groupBy("profile_id", "molecule_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit("one cell per profile and molecule").alias("rule"), "violations")
    checks = [
        orphans("a profile's condition exists", "profile", "condition_key", "condition", "condition_key"),
        orphans("a measurement's profile exists", "measurement", "profile_id", "profile", "profile_id"),
        orphans("a flux's reaction exists", "flux", "reaction_id", "reaction", "reaction_id"),
        orphans("a bridge's perturbation exists", "condition_perturbation", "perturbation_id", "perturbation", "perturbation_id"),
        orphans("a condition's medium exists", "condition", "medium_id", "medium", "medium_id"),
    ]
    out = twice
    for c in checks:
        out = out.unionByName(c)
    return out


def perturbations(t: dict[str, DataFrame], key: str) -> DataFrame:
    """perturbation_id, gene, type of a condition; an unknown key is an error."""
    if t["condition"].where(F.col("condition_key") == key).isEmpty():
        raise KeyError(key)
    return t["condition_perturbation"].where(F.col("condition_key") == key).join(t["perturbation"], "perturbation_id").select("perturbation_id", "gene", "type")


def growth_rates(t: dict[str, DataFrame]) -> DataFrame:
    """condition_key, growth_rate: of a condition measured more than once the profile with the largest id counts."""
    g = t["phenotype"].where("growth_rate is not null").join(t["profile"].select("profile_id", "condition_key"), "profile_id")
    return g.groupBy("condition_key").agg(F.max_by("growth_rate", "profile_id").alias("growth_rate"))


def save_json(df: DataFrame, path: str) -> None:
    """A small metric frame as one JSON document, keys in order."""
    Path(path).write_text(json.dumps([json.loads(r) for r in df.toJSON().collect()], indent=1, sort_keys=True), encoding="utf-8")


def save_predictions(predictions: DataFrame, folder: str) -> None:
    """Predictions (predictor, fold, profile_id, condition_key, molecule_id, y, y_hat) as Parquet, a folder per predictor, so that several
    models lie side by side. A predictor saved again replaces its own folder only."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("predictor").parquet(folder)


def saved_predictions(spark: SparkSession, folder: str, predictors: list[str] | None = None) -> DataFrame:
    """What :func:`save_predictions` stored, of the named predictors or all."""
    p = spark.read.parquet(folder)
    return p if predictors is None else p.where(F.col("predictor").isin(predictors))
