"""Problem 5: records that differ only by notation, collapsed by a canonical form.

Characters, case, blanks, punctuation and the order of members are canonicalised in Columns, the canonical text is hashed to
128 bits, and copies are counted by aggregation with map-side combining. A third, independent fingerprint checks for collisions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from polyomics.session import materialize

# The comparable spellings of wild type and of no stress.
WILD_TYPE = ["", "none", "na", "wt", "nawt", "wtna", "nan", "null"]
NO_STRESS = ["", "none", "na", "nan", "null"]

#: A type's letters, with or without dots, and the signs that set it off from the gene.
_TYPE = r"(?i:k\.?o|o\.?e|i\.?n|v\.?a\.?r|r\.?m|e\.?x)\.?"
TYPE_LAST = rf"^(.*?\S)\s*[_:(\[\-\s]\s*({_TYPE})\s*[)\]]*\s*$"
TYPE_FIRST = rf"^\s*[(\[]*\s*({_TYPE})\s*[)\]]*[_:\-\s]\s*(\S.*)$"

HASHES = ["h1", "h2"]


@F.pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def canonical_characters(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in compatibility form with case folded: full-width letters, ligatures and combined accents as their plain forms.

    Only rows with a character beyond ASCII need that, for which Spark has no function; they alone pass through Python, in batches."""
    odd = F.concat_ws("", *columns).rlike(r"[^\x00-\x7f]")
    return df.where(~odd).unionByName(df.where(odd).withColumns({c: _compatible(c) for c in columns}))


def letters_digits(c: Column) -> Column:
    """Only letters and digits, in lower case; null as blank."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def member_set(members: Column, nothing: list[str]) -> Column:
    """Canonical text of a list of members: distinct, ordered, without those that say nothing."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(members, lambda m: ~m.isin(nothing)))), ";")


def stress_set(c: Column) -> Column:
    """``osmotic, Heat`` and ``heat;osmotic`` are one; every spelling of no stress is blank."""
    return member_set(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,|+/]"), letters_digits), NO_STRESS)


def _perturbation(m: Column) -> Column:
    """Gene and type of one member in one order. A member without a type is an ``ex``; one of type wild type is blank."""
    last, first = m.rlike(TYPE_LAST), m.rlike(TYPE_FIRST)
    gene = F.when(last, F.regexp_extract(m, TYPE_LAST, 1)).when(first, F.regexp_extract(m, TYPE_FIRST, 2)).otherwise(m)
    kind = F.when(last, F.regexp_extract(m, TYPE_LAST, 2)).when(first, F.regexp_extract(m, TYPE_FIRST, 1)).otherwise("ex")
    g = letters_digits(gene)
    return F.when(g.isin(WILD_TYPE), "").otherwise(F.concat_ws("|", g, letters_digits(kind)))


def perturbation_set(c: Column) -> Column:
    """``KO_b2`` and ``B2 (K.O.);`` are one; every spelling of wild type is blank."""
    return member_set(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,|+]"), _perturbation), WILD_TYPE)


def canonical_conditions(conditions: DataFrame) -> DataFrame:
    """id, canon of each record of ``conditions`` (record_id, layer, cond, strain, medium_id, stress, gp).

    A record with ``cond`` is read from its four dotted parts, without exactly four it is no record and left out; the others from
    their columns. canon is strain, medium, stresses and perturbations; a null part is blank. A null record_id is left out.
    """
    parts = F.split("cond", r"\.", -1)
    part = lambda k, name: F.when(F.col("cond").isNotNull(), F.get(parts, F.lit(k))).otherwise(F.col(name))
    c = conditions.where("record_id is not null").where(F.col("cond").isNull() | (F.size(parts) == 4))
    names = ["strain", "medium_id", "stress", "gp"]
    c = canonical_characters(c.select(F.col("record_id").alias("id"), *[part(k, n).alias(n) for k, n in enumerate(names)]), names)
    return c.select("id", F.concat_ws("\n", letters_digits(F.col("strain")), letters_digits(F.col("medium_id")), stress_set(F.col("stress")), perturbation_set(F.col("gp"))).alias("canon"))


def canonical_perturbations(perturbations: DataFrame) -> DataFrame:
    """id, canon of each of ``perturbations`` (pert_id, study_id, gene, type): study, and gene and type in either order. Null fields are blank."""
    pair = F.array_sort(F.array(letters_digits(F.col("gene")), letters_digits(F.col("type"))))
    p = canonical_characters(perturbations.where("pert_id is not null").select("pert_id", "study_id", "gene", "type"), ["study_id", "gene", "type"])
    return p.select(F.col("pert_id").alias("id"), F.concat_ws("\n", letters_digits(F.col("study_id")), F.array_join(pair, "|")).alias("canon"))


def hashed(records: DataFrame) -> DataFrame:
    """id and the 128 bits h1, h2 of the canonical text, with a fingerprint of its own (``mark``) against collisions."""
    mark = (F.crc32("canon").cast("bigint") * 65536) + (F.length("canon") % 65536)
    return records.select("id", F.xxhash64(F.lit(1), "canon").alias("h1"), F.xxhash64(F.lit(2), "canon").alias("h2"), mark.alias("mark"))


def groups(records: DataFrame) -> DataFrame:
    """h1, h2, mark, keep_id, copies: one row per distinct canonical text, keep_id the smallest id.

    ``mark`` in the key is the collision check: texts that share the 128 bits but not the mark stay apart. Counts and minima
    combine before the shuffle, so a text held by a third of all rows costs one row per input partition."""
    return records.groupBy(*HASHES, "mark").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))


def copies(records: DataFrame, hot: int = 100_000) -> DataFrame:
    """keep_id, copy_id for each record that repeats an earlier one. ``records``: id, h1, h2, mark, read twice, so materialise it.

    Groups of at least ``hot`` copies, and never more than a thousand of them, are joined by broadcast, so that no task gets
    their rows; all others by a shuffle on the hash.
    """
    g = materialize(groups(records).where("copies > 1"), "groups")
    total = g.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    limit = max(hot, total // 1000)
    keys = [*HASHES, "mark"]
    big = F.broadcast(g.where(F.col("copies") >= limit).select(*keys, F.col("keep_id").alias("big_id")))
    r = records.join(big, keys, "left")
    of_big = r.where("big_id is not null").select(F.col("big_id").alias("keep_id"), F.col("id").alias("copy_id"))
    rest = r.where("big_id is null").drop("big_id").join(g.where(F.col("copies") < limit), keys).select("keep_id", F.col("id").alias("copy_id"))
    return of_big.unionByName(rest).where("copy_id > keep_id")


def collisions(records: DataFrame) -> DataFrame:
    """records, texts, collisions, in one row: how many rows and canonical texts there are, and how many pairs of hashes stand for more than
    one text by the third fingerprint, which keeps these apart in :func:`groups`."""
    g = records.groupBy(*HASHES, "mark").agg(F.count("*").alias("n")).groupBy(*HASHES).agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.count_if(F.col("texts") > 1).alias("collisions"))
