"""Condition keys and perturbations in canonical form, as Column expressions.

A key is ``strain.medium_id.stress.gp``; gp is a ``;``-joined list of ``gene(TYPE)``. Everything here runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens of the wild type, tokens of no stress, perturbation types.
WILD_TYPE_TOKENS = ["", "none", "na", "wt", "na_wt", "wt_na", "nan", "null", "-"]
NO_STRESS_TOKENS = ["", "none", "na", "nan", "null", "-"]
GP_TYPES = ["KO", "OE", "IN", "VAR", "RM", "EX", "WT"]

# gene(TYPE), and the underscore dialect, in which either side may be the type.
GENE_TYPE = r"(?U)^\s*(.+?)\s*\(\s*([A-Za-z]+)\s*\)\s*$"
UNDERSCORE = r"(?U)^\s*(.+?)_([A-Za-z]+)\s*$"


def strip(c: Column) -> Column:
    """Without white space of any kind, tabs, line ends and hard blanks too, on either side."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def as_text(c: Column) -> Column:
    """Stripped text; null is blank."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def is_wild_type_token(c: Column) -> Column:
    return F.lower(strip(c)).isin(WILD_TYPE_TOKENS)


def parse_token(t: Column) -> Column:
    """struct(gene, type) of one perturbation token; the type in upper case. Null for a wild-type token.

    ``gene(TYPE)`` is read first, then ``gene_TYPE``, then ``TYPE_gene`` (whose gene is in upper case); a token of neither form is a
    gene of type EX."""
    side = F.upper(F.regexp_extract(t, UNDERSCORE, 1))
    other = F.upper(F.regexp_extract(t, UNDERSCORE, 2))
    swapped = ~other.isin(GP_TYPES) & side.isin(GP_TYPES)
    gene = (
        F.when(t.rlike(GENE_TYPE), F.regexp_extract(t, GENE_TYPE, 1))
        .when(t.rlike(UNDERSCORE), F.when(swapped, other).otherwise(F.regexp_extract(t, UNDERSCORE, 1)))
        .otherwise(strip(t))
    )
    kind = F.when(t.rlike(GENE_TYPE), F.upper(F.regexp_extract(t, GENE_TYPE, 2))).when(t.rlike(UNDERSCORE), F.when(swapped, side).otherwise(other)).otherwise("EX")
    drop = is_wild_type_token(t) | (kind == "WT") | is_wild_type_token(gene)
    return F.when(~drop, F.struct(gene.alias("gene"), kind.alias("type")))


def split_gp(gp: Column, symbols: Column | None = None) -> Column:
    """Distinct struct(gene, type) of a gp text, ordered by gene and type. ``symbols`` is a map lower-case symbol -> locus that
    renames genes; unknown symbols stay."""
    name = (lambda g: g) if symbols is None else (lambda g: F.coalesce(F.get(F.array(F.try_element_at(symbols, F.lower(g))), F.lit(0)), g))
    parsed = F.filter(F.transform(F.split(as_text(gp), ";"), lambda t: parse_token(strip(t))), lambda s: s.isNotNull())
    return F.array_sort(F.array_distinct(F.transform(parsed, lambda s: F.struct(name(s["gene"]).alias("gene"), s["type"].alias("type")))))


def canonical_gp(gp: Column, symbols: Column | None = None) -> Column:
    """``b0688(KO);b0008(KO)`` sorted by gene and type; ``none`` where nothing is perturbed. Null and blank are ``none``."""
    s = split_gp(gp, symbols)
    return F.when(F.size(s) == 0, "none").otherwise(F.array_join(F.transform(s, lambda p: F.concat(p["gene"], F.lit("("), p["type"], F.lit(")"))), ";"))


def perturbed_genes(gp: Column, symbols: Column | None = None) -> Column:
    return F.transform(split_gp(gp, symbols), lambda p: p["gene"])


def canonical_stress(c: Column) -> Column:
    """``none`` for every way to say no stress; otherwise the trimmed text, case and order kept."""
    t = as_text(c)
    return F.when(F.lower(t).isin(NO_STRESS_TOKENS), "none").otherwise(t)


def split_stress(c: Column) -> Column:
    """The distinct stresses of a text in order; empty for no stress."""
    members = F.filter(F.transform(F.split(canonical_stress(c), ";"), lambda v: strip(v)), lambda s: (s != "") & (s != "none"))
    return F.array_sort(F.array_distinct(members))


def make_key(strain: Column, medium_id: Column, stress: Column, gp: Column) -> Column:
    return F.concat_ws(".", as_text(strain), as_text(medium_id), canonical_stress(stress), canonical_gp(gp))


def parse_condition(cond: Column, strict: bool = True) -> Column:
    """struct(strain, medium_id, stress, gp), canonical, of a dotted text. Not exactly four parts: an error, or null if not strict."""
    p = F.split(cond, r"\.", -1)
    key = F.struct(strip(F.get(p, F.lit(0))).alias("strain"), strip(F.get(p, F.lit(1))).alias("medium_id"), canonical_stress(F.get(p, F.lit(2))).alias("stress"), canonical_gp(F.get(p, F.lit(3))).alias("gp"))
    bad = F.raise_error(F.concat(F.lit("a condition needs four dotted parts: "), cond)).cast("struct<strain:string,medium_id:string,stress:string,gp:string>") if strict else F.lit(None)
    return F.when(F.size(p) == 4, key).otherwise(bad) if strict else F.when(F.size(p) == 4, key)


def is_wild_type(key: Column) -> Column:
    """The broad sense: nothing perturbed."""
    return F.split_part(key, F.lit("."), F.lit(4)) == "none"


def dialects(df: DataFrame, gp: str) -> DataFrame:
    """canonical_gp, spellings, n: how many spellings and rows each canonical form has."""
    return df.groupBy(canonical_gp(F.col(gp)).alias("canonical_gp")).agg(F.count_distinct(F.coalesce(gp, F.lit("<null>"))).alias("spellings"), F.count("*").alias("n"))
