"""Condition encoder: a condition key as one vector of strain markers, medium components, stresses and perturbations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyomics.functions.canon import split_gp, split_stress
from polyomics.operators.skew import join_groups
from polyomics.operators.wide import name_key
from polyomics.session import materialize

# What parts the members of a list of names in one text.
LIST = r"[;|\n]|\s+/\s+|,\s+"


def vocabulary(spark_df: DataFrame, column: str) -> list[str]:
    """The ordered distinct values of a metadata column: a vocabulary, read by the driver."""
    return [r[0] for r in spark_df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def multi_hot(members: Column, words: list[str]) -> Column:
    """1 for each of ``words`` among ``members``, which are bound first: inside the inner lambda they would be split anew per word."""
    each = lambda m: F.transform(F.array(*map(F.lit, words)), lambda w: F.array_contains(m, w).cast("double"))
    return F.get(F.transform(F.array(members), each), F.lit(0)) if words else F.array().cast("array<double>")


def median_filled(amounts: DataFrame) -> DataFrame:
    """medium_id, component, amount: a missing amount becomes the component's median, 0 without any."""
    m = amounts.groupBy("component").agg(F.median("amount").alias("m"))
    return amounts.join(F.broadcast(m), "component").select("medium_id", "component", F.coalesce("amount", "m", F.lit(0.0)).alias("amount"))


def block(rows: DataFrame, key: str, feature: str, value: Column, words: list[str]) -> DataFrame:
    """key, vec: one dense block per entity over the vocabulary; 0 for what it doesn't mention."""
    g = rows.groupBy(key, F.col(feature).alias("_f")).agg(F.max(value).alias("_v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_f", "_v"))).alias("_m"))
    return g.select(key, F.transform(F.array(*map(F.lit, words)), lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0.0))).alias("vec"))


def strain_markers(markers: DataFrame, strains: DataFrame, conditions: DataFrame) -> DataFrame:
    """strain, feature, present: the markers under the strain as the keys of ``conditions`` spell it, and under every accession.

    ``markers``: strain (an accession), feature, present; ``strains``: accession, name, alternate_names; ``conditions``: condition_key.
    Accessions and names compare by letters and digits. A key's strain has the records that bear it as accession, name or alternate
    name; a marker is present if one of them has it. The accessions stay, so that the vocabulary is that of all markers."""
    accession = lambda c: F.upper(name_key(F.col(c)))
    m = markers.groupBy(accession("strain").alias("accession"), "feature").agg(F.max("present").alias("present")).where("accession <> ''")
    names = F.concat(F.array("accession", "name"), F.split(F.coalesce("alternate_names", F.lit("")), LIST))
    named = strains.select(accession("accession").alias("accession"), F.explode(names).alias("name")).select("accession", name_key(F.col("name")).alias("_name")).where("_name <> ''").distinct()
    spelt = conditions.select(F.split_part("condition_key", F.lit("."), F.lit(1)).alias("strain")).distinct().withColumn("_name", name_key(F.col("strain")))
    own = spelt.join(named, "_name").join(m, "accession").groupBy("strain", "feature").agg(F.max("present").alias("present"))
    return own.unionByName(m.withColumnRenamed("accession", "strain"))


class ConditionEncoder:
    """fit() reads the vocabularies; transform() adds ``features`` = strain | medium | stress | perturbation to a frame with
    condition_key. Unknown strains and media are zeros; unknown stresses and perturbations set nothing. ``medium_kind``: present,
    amount or both (both blocks one after the other)."""

    def __init__(self, medium_kind: str = "present") -> None:
        if medium_kind not in ("present", "amount", "both"):
            raise ValueError(medium_kind)
        self.medium_kind = medium_kind

    def fit(self, markers: DataFrame, components: DataFrame, conditions: DataFrame) -> ConditionEncoder:
        """``markers``: strain, feature, present; ``components``: medium_id, component, present, amount; ``conditions``: condition_key."""
        key = lambda k: F.split_part("condition_key", F.lit("."), F.lit(k))
        self.features, self.components = vocabulary(markers, "feature"), vocabulary(components, "component")
        self.stresses = vocabulary(conditions.select(F.explode(split_stress(key(3))).alias("s")), "s")
        shown = F.transform(split_gp(key(4)), lambda p: F.concat(p["gene"], F.lit("("), p["type"], F.lit(")")))
        self.perturbations = vocabulary(conditions.select(F.explode(shown).alias("p")), "p")
        self.strain_block = block(markers, "strain", "feature", F.col("present").cast("double"), self.features)
        present = block(components, "medium_id", "component", F.col("present").cast("double"), self.components)
        amount = block(median_filled(components), "medium_id", "component", F.col("amount"), self.components)
        both = present.join(amount.withColumnRenamed("vec", "a"), "medium_id").select("medium_id", F.concat("vec", "a").alias("vec"))
        self.medium_block = {"present": present, "amount": amount, "both": both}[self.medium_kind]
        return self

    def widths(self) -> dict[str, int]:
        """Block name -> width; the blocks follow each other in this order."""
        return {"strain": len(self.features), "medium": len(self.components) * (2 if self.medium_kind == "both" else 1), "stress": len(self.stresses), "perturbation": len(self.perturbations)}

    def transform(self, df: DataFrame) -> DataFrame:
        key = lambda k: F.split_part("condition_key", F.lit("."), F.lit(k))
        w = self.widths()
        d = df.withColumns({"_strain": key(1), "_medium": key(2)})
        d = d.join(self.strain_block.withColumnRenamed("vec", "_s"), F.col("_strain") == self.strain_block["strain"], "left").drop("strain")
        d = d.join(self.medium_block.withColumnRenamed("vec", "_m"), F.col("_medium") == self.medium_block["medium_id"], "left").drop("medium_id")
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        shown = F.transform(split_gp(key(4)), lambda p: F.concat(p["gene"], F.lit("("), p["type"], F.lit(")")))
        vec = F.concat(F.coalesce("_s", zeros(w["strain"])), F.coalesce("_m", zeros(w["medium"])), multi_hot(split_stress(key(3)), self.stresses), multi_hot(shown, self.perturbations))
        return d.withColumn("features", vec).drop("_strain", "_medium", "_s", "_m")


def _hashed(encoded: DataFrame) -> DataFrame:
    return encoded.select("condition_key", F.xxhash64("features").alias("h1"), F.xxhash64(F.lit(1), "features").alias("h2"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("s")).distinct()


def collisions(encoded: DataFrame) -> DataFrame:
    """keys, n: the groups of distinct condition keys that have the same vector. Vectors compare by a 128-bit hash with their sum. A
    group is one array; where groups may be large use :func:`collision_rows`."""
    return _hashed(encoded).groupBy("h1", "h2", "s").agg(F.array_sort(F.collect_list("condition_key")).alias("keys"), F.count("*").alias("n")).where("n > 1").select("keys", "n")


def collision_rows(encoded: DataFrame) -> DataFrame:
    """h1, h2, condition_key, n: one row per distinct condition key whose vector n > 1 keys have; h1 and h2 are the vector's hash.

    Groups are as in :func:`collisions` but never held whole; hot ones are salted in the join."""
    h = materialize(_hashed(encoded), "encoded")
    groups = h.groupBy("h1", "h2", "s").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
    return join_groups(h, groups, ["h1", "h2", "s"], "size", "condition_key").where("n is not null").select("h1", "h2", "condition_key", "n")


def build_encoder(tables: dict[str, DataFrame], medium_kind: str = "both") -> ConditionEncoder:
    """An encoder fitted on the tables of :func:`polyomics.catalog.build`: markers by letters and digits, components in lower case."""
    markers = tables["strain_feature"].select("strain", F.lower(F.regexp_replace("feature", "[^A-Za-z0-9]", "")).alias("feature"), "present")
    markers = strain_markers(markers, tables["strain"], tables["condition"])
    components = tables["medium_component"].select("medium_id", F.lower("component").alias("component"), "present", "amount")
    return ConditionEncoder(medium_kind).fit(markers, components, tables["condition"])
