"""Numbers and units in free text as Column expressions, and the tables that give units their meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The spellings of units. kind: molar (per litre), mass, amount (moles), volume, w/v, v/v;
# factor: to mM, g, mmol, L, g/L, mL/L.
UNIT_ALIASES = [
    ("m", "molar", 1e3), ("molar", "molar", 1e3),
    ("mm", "molar", 1.0), ("millimolar", "molar", 1.0),
    ("um", "molar", 1e-3), ("micromolar", "molar", 1e-3),
    ("nm", "molar", 1e-6), ("nanomolar", "molar", 1e-6),
    ("pm", "molar", 1e-9), ("picomolar", "molar", 1e-9),
    ("kg", "mass", 1e3), ("g", "mass", 1.0), ("gr", "mass", 1.0), ("gram", "mass", 1.0), ("grams", "mass", 1.0),
    ("mg", "mass", 1e-3), ("milligram", "mass", 1e-3), ("milligrams", "mass", 1e-3),
    ("ug", "mass", 1e-6), ("mcg", "mass", 1e-6), ("microgram", "mass", 1e-6), ("micrograms", "mass", 1e-6),
    ("ng", "mass", 1e-9), ("nanogram", "mass", 1e-9),
    ("mol", "amount", 1e3), ("mole", "amount", 1e3), ("moles", "amount", 1e3),
    ("mmol", "amount", 1.0), ("umol", "amount", 1e-3), ("nmol", "amount", 1e-6), ("pmol", "amount", 1e-9),
    ("l", "volume", 1.0), ("liter", "volume", 1.0), ("litre", "volume", 1.0), ("liters", "volume", 1.0), ("litres", "volume", 1.0),
    ("dl", "volume", 0.1), ("cl", "volume", 0.01), ("ml", "volume", 1e-3), ("ul", "volume", 1e-6),
    ("%", "w/v", 10.0), ("percent", "w/v", 10.0), ("%w/v", "w/v", 10.0), ("%wt/vol", "w/v", 10.0), ("%m/v", "w/v", 10.0),
    ("%v/v", "v/v", 10.0), ("%vol/vol", "v/v", 10.0), ("%byvolume", "v/v", 10.0), ("%byvol", "v/v", 10.0), ("%vol", "v/v", 10.0),
]

NUMBER = (
    r"[-+]?(?:\d{1,3}(?:[ ']\d{3})+(?:[.,]\d+)?|\d{1,3}(?:,\d{3})+\.\d+|\d{1,3}(?:,\d{3}){2,}|\d+[.,]\d+|[.,]\d+|\d+)"
    r"(?:\s*[x*]\s*10\s*\^?\s*[-+]?\d+|e[-+]?\d+)?"
)
GROUPED = r"^[-+]?[1-9]\d{0,2}(,\d{3})+(\.\d+)?(e[-+]?\d+)?$"
#: Words before a number that leave its meaning: level, approximation, instruction.
QUALIFIER = r"(?:(?:low|high|medium|final|total|about|around|approx|approximately|ca|circa|conc|final conc|add|add to|adjust to)\b\.?\s*:?\s*|[~≈=]\s*)*"
#: Remarks after a quantity. A bracket that says w/v or v/v is part of the unit.
REMARK = r"(?:\s*(?:[;,]\s*[a-z][a-z -]*|\((?!\s*(?:w|v|wt|m|vol)\s*/\s*(?:v|vol)\s*\))[^()]*\)|\[[^\[\]]*\]|\bfinal(?: conc\.?)?))*"
QUANTITY = rf"^{QUALIFIER}\(?\s*({NUMBER})\s*(.*?)\s*\)?{REMARK}\s*$"


def plain_text(c: Column) -> Column:
    """Lower case, one kind of blank, micro sign and multiplication sign in ASCII; null stays null."""
    t = F.translate(c, "    　\t\r\n", " " * 8)
    return F.trim(F.lower(F.translate(t, "µμ×−’", "uux-'")))


def with_number(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the value of the NUMBER in column ``text`` (grouping blanks, apostrophes and commas, a decimal comma, powers of
    ten), null if it isn't one. A single comma is a decimal comma, unless exactly three digits follow it and one to three, not
    beginning with 0, precede it."""
    m = F.regexp_replace(F.lower(F.trim(text)), r"(?<=\d)[ '](?=\d{3})", "")
    m = F.regexp_replace(m, r"\s*[x*]\s*10\s*\^?\s*(?=[-+]?\d+$)", "e")
    m = F.when(m.rlike(GROUPED), F.translate(m, ",", "")).otherwise(F.translate(m, ",", "."))
    written = r"^[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?$"
    # The plain way to write a number needs none of the steps above.
    return df.withColumn(out, F.when(F.col(text).rlike(r"^[-+]?\d+(\.\d+)?$"), F.col(text).try_cast("double")).otherwise(F.when(m.rlike(written), m.try_cast("double"))))


def unit_text(c: Column) -> Column:
    """A unit's spelling made comparable: no blanks or brackets, one sign for *per*, ``l-1`` as ``/l``. A blank stays blank."""
    t = plain_text(c)
    worded = F.regexp_replace(F.regexp_replace(t, r"\s*(?:/|\bper\b|\bin\b)\s*", "/"), r"\s+(m|d|u)?l-1$", "/$1l")
    worded = F.regexp_replace(F.regexp_replace(worded, r"[\s()]+", ""), r"^percent(?=[wv])", "%")
    # Most spellings are one word, for which nothing of that acts but on the brackets.
    return F.when(t.contains(" ") | t.contains("per") | t.contains("in"), worded).otherwise(F.translate(t, " ()", ""))


def or_null(df: DataFrame, *columns: str) -> DataFrame:
    """The columns with null for blank. A step of its own, as an expression used twice in a CASE is evaluated twice."""
    return df.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in columns})


def aliases(spark: SparkSession) -> DataFrame:
    """alias, kind, factor, offset: value in the base unit = value * factor + offset."""
    rows = ", ".join(f"('{a}', '{k}', {f}D, 0.0D)" for a, k, f in UNIT_ALIASES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(alias, kind, factor, offset)")


def with_unit(df: DataFrame, unit: str) -> DataFrame:
    """Adds u_kind, u_factor, u_offset for the comparable spelling in column ``unit``; null where it means nothing.

    A quotient is taken apart into numerator, count and denominator, each normalised by a join with the alias table
    (under a hundred fixed rows, hence broadcast).
    """
    a = aliases(df.sparkSession)
    top = a.select(F.col("alias").alias("_top"), F.col("kind").alias("_tk"), F.col("factor").alias("_tf"), F.col("offset").alias("_to"))
    low = a.where("kind = 'volume'").select(F.col("alias").alias("_low"), F.col("factor").alias("_lf"))
    # numerator/count denominator, such as mg/100ml: taken apart by plain string functions, a third of the time of regular expressions.
    df = df.withColumn("_rest", F.when(F.col(unit).contains("/"), F.substring(unit, F.instr(unit, "/") + 1, F.length(unit))))
    df = df.withColumns({"_n": F.translate("_rest", "abcdefghijklmnopqrstuvwxyz", ""), "_low": F.translate("_rest", "0123456789", "")})
    is_part = F.coalesce((F.concat("_n", "_low") == F.col("_rest")) & (F.col("_low") != "") & ~F.startswith(F.col(unit), F.lit("%")), F.lit(False))
    df = df.withColumns({
        "_top": F.when(is_part, F.substring_index(unit, "/", 1)).otherwise(F.col(unit)),
        "_n": F.when(is_part, F.when(F.col("_n") == "", 1.0).otherwise(F.col("_n").try_cast("double"))),
        "_low": F.when(is_part, F.col("_low")),
    }).drop("_rest")
    df = df.join(F.broadcast(top), "_top", "left").join(F.broadcast(low), "_low", "left")
    per = F.col("_lf").isNotNull() & (F.col("_n") > 0)
    whole = F.col("_low").isNull() & F.col("_tk").isin("molar", "w/v", "v/v")
    kind = F.when(per & (F.col("_tk") == "mass"), "mass").when(per & (F.col("_tk") == "amount"), "molar").when(whole, F.when(F.col("_tk") == "w/v", "mass").otherwise(F.col("_tk")))
    return df.withColumns({
        "u_kind": kind,
        "u_factor": F.when(kind.isNotNull(), F.when(per, F.col("_tf") / (F.col("_n") * F.col("_lf"))).otherwise(F.col("_tf"))),
        "u_offset": F.when(kind.isNotNull(), F.col("_to")),
    }).drop("_top", "_low", "_n", "_tk", "_tf", "_to", "_lf")


#: A unit of concentration somewhere in a sentence, such as "values in uM" or "figures are g per litre".
UNIT_IN_PROSE = r"(?:^|[\s;,:(])((?:[mun]?m|(?:milli|micro|nano|pico)?molar)|(?:[mun]?mol|[mun]?g|mcg|grams?)\s*(?:/|per)\s*\d*\s*(?:ml|dl|l|liter|litre)|(?:[mun]?mol|[mun]?g|mcg)\s+l-1|(?:%|percent)(?:\s*\(?(?:w/v|v/v)\)?)?)(?=$|[\s;,.:)])"
