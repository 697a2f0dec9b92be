"""Small text rules of the metadata, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyomics.functions.canon import strip

# Markers of absence, and of a missing number.
ABSENT = ["no", "none", "na", "", "-", "?"]
NOT_A_NUMBER = ["", "NA", "NAN", "NULL"]
# How a number is written. The cast alone also takes Java's literals (1d, 2F, 0x1p3) and a signed NaN.
NUMERIC = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)$"
AMOUNT = r"^([0-9]*\.?[0-9]+)\s*([A-Za-z%/]*)$"
WORDED_AMOUNT = r"^[A-Za-z]+\s*\(\s*([^()]+?)\s*\)$"


def parse_amount(raw: Column) -> Column:
    """struct(amount, unit, present) of a published cell. Null and ``?``: nothing known, absent; ``0``, ``no``, blank: amount 0;
    ``yes``: present without an amount; number and unit, also wrapped in a word as in ``low(10nM)``; other text: present.
    Case-sensitive; present also means an amount other than 0."""
    t = strip(raw)
    inner = F.when(t.rlike(WORDED_AMOUNT), strip(F.regexp_extract(t, WORDED_AMOUNT, 1))).otherwise(t)
    x = F.when(inner.rlike(AMOUNT), F.regexp_extract(inner, AMOUNT, 1).try_cast("double"))
    unit = F.when(inner.rlike(AMOUNT), F.nullif(F.regexp_extract(inner, AMOUNT, 2), F.lit("")))
    amount = F.when(t.isin("", "0", "no", "-"), 0.0).when(t.isin("?", "unknown", "na", "yes", "y", "present"), None).otherwise(x)
    present = F.when(raw.isNull() | t.isin("", "0", "no", "-", "?", "unknown", "na"), False).when(t.isin("yes", "y", "present"), True).when(x.isNotNull(), x != 0).otherwise(True)
    return F.struct(amount.alias("amount"), F.when(amount.isNotNull(), unit).alias("unit"), present.alias("present"))


def named_in(component: Column, *texts: Column) -> Column:
    """Is the component a whole token of one of the texts, whatever the case? Its signs are taken literally."""
    c = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.lower(component), F.lit(r"\E([^a-z0-9]|$)"))
    return F.coalesce(F.exists(F.array(*texts), lambda t: F.rlike(F.lower(F.coalesce(t, F.lit(""))), c)), F.lit(False))


def numeric(c: Column) -> Column:
    """The number, null for the usual ways to say there is none and for what is no number. Never NaN."""
    t = strip(c)
    return F.when(~F.upper(t).isin(NOT_A_NUMBER) & t.rlike(NUMERIC), t.try_cast("double"))


def marker_present(c: Column) -> Column:
    """A strain marker is present unless its value says absence; null says absence."""
    return ~F.lower(strip(F.coalesce(c, F.lit("none")))).isin(ABSENT)


def modern_reaction_id(c: Column) -> Column:
    """Old exchange ids ``EX_glc(e)`` and stereo suffixes ``-D`` or ``_D`` in the modern form ``EX_glc__D_e``; idempotent."""
    t = F.regexp_replace(c, r"^(EX_.*)\(e\)$", "$1_e")
    body = F.regexp_replace(F.regexp_replace(t, r"^EX_", ""), r"_e$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"-([LDRS])$", "__$1"), r"(?<!_)_([LDRS])$", "__$1")
    body = F.when(body == "glc", "glc__D").otherwise(body)
    exchange = t.rlike(r"^EX_.*_e$")
    return F.when(exchange, F.concat(F.lit("EX_"), body, F.lit("_e"))).otherwise(F.regexp_replace(F.regexp_replace(t, r"-([LDRS])$", "__$1"), r"(?<!_)_([LDRS])$", "__$1"))


def locus(c: Column) -> Column:
    """The first locus tag ``b1234`` in a text, null without one."""
    return F.nullif(F.regexp_extract(c, r"(b\d{4})", 1), F.lit(""))


def repaired_token(c: Column, symbols: Column) -> Column:
    """A network token as a locus: ``b1474;`` trimmed, a symbol looked up in the map (lower case), ``sym_2`` by its stem; else null."""
    t = F.regexp_replace(strip(c), r"[;\s]+$", "")
    stem = F.regexp_replace(t, r"_\d+$", "")
    return F.when(t.rlike(r"^b\d{4}$"), t).otherwise(F.coalesce(F.try_element_at(symbols, F.lower(t)), F.try_element_at(symbols, F.lower(stem))))


def is_leaky(name: Column) -> Column:
    return name.endswith("_LEAKY")


def bounds_pairs(reactions: Column, bounds: Column) -> Column:
    """array of struct(reaction, bound) of two comma lists; empty if their lengths differ."""
    r, b = F.transform(F.split(reactions, ","), lambda v: strip(v)), F.transform(F.split(bounds, ","), lambda x: strip(x).try_cast("double"))
    return F.when(F.size(r) == F.size(b), F.zip_with(r, b, lambda x, y: F.struct(x.alias("reaction"), y.alias("bound")))).otherwise(F.array().cast("array<struct<reaction:string,bound:double>>"))


def pcc_text(mean: Column, sd: Column, n: Column, least: int = 15) -> Column:
    """``0.2224 ± 0.1297``, or ``n/a (3 cond)`` where too few conditions make it meaningless."""
    return F.when(n < least, F.format_string("n/a (%d cond)", n)).otherwise(F.format_string("%.4f ± %.4f", mean, sd))
