"""Readers of the file formats of the domain, each a plan over Spark's own text, CSV, JSON and binary sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyomics.functions.canon import canonical_gp, canonical_stress, parse_condition
from polyomics.functions.parse import ABSENT, bounds_pairs, numeric

#: More columns than any wide table has; Spark's own limit is higher than that of its CSV parser's default.
MAX_COLUMNS = 20_000


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def wide_text(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(profiles, axis) of a wide table whose molecules are the columns named ``m.<id>``.

    profiles: source_id, strain, medium_id, stress, gp, values (null where blank, NA or no number). A transcriptome table has ID and Cond,
    which needs four dotted parts, else it is an error; the others have Strain, MediumID, Stress, GP. The thousands of columns become
    one array at once, before anything else is planned over them."""
    raw = spark.read.csv(path, sep=sep, header=True, maxColumns=MAX_COLUMNS)
    molecules = [c for c in raw.columns if c.startswith("m.")]
    values = F.array(*[numeric(F.col(f"`{c}`")) for c in molecules]).alias("values")
    if "Cond" in raw.columns:
        k = parse_condition(F.col("Cond"))
        profiles = raw.select(F.col("ID").alias("source_id"), k.alias("k"), values).select("source_id", "k.*", "values")
    else:
        text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
        profiles = raw.select(F.lit(None).cast("string").alias("source_id"), text("Strain").alias("strain"), text("MediumID").alias("medium_id"), canonical_stress(F.col("Stress")).alias("stress"), canonical_gp(F.col("GP")).alias("gp"), values)
    return profiles, spark.createDataFrame([(i, c[2:]) for i, c in enumerate(molecules)], "idx int, molecule_id string")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Columns as maps: record (its place in the file), fields map<string,string> of a file that is one array of flat records. Keys that
    come twice stay twice; see :func:`merged_fields`."""
    whole = spark.read.text(path, wholetext=True).select("value")
    return records(whole, "value")


def records(df: DataFrame, column: str) -> DataFrame:
    """record, fields of a JSON array in ``column``: of records, or of an object that holds them in rows, data, records or its first
    entry. Headerless arrays and no records are errors; ``_id`` is dropped."""
    text = F.col(column)
    wrapped = F.from_json(text, "map<string,string>")
    inner = F.coalesce(*[F.try_element_at(wrapped, F.lit(k)) for k in ("rows", "data", "records")], F.get(F.map_values(wrapped), F.lit(0)))
    body = F.when(F.ltrim(text).startswith("{"), inner).otherwise(text)
    rows = F.from_json(body, "array<map<string,string>>")
    sound = F.when(F.ltrim(body).rlike(r"^\[\s*\["), F.raise_error(F.lit("records without column names")).cast("array<map<string,string>>")).when(
        rows.isNull() | (F.size(rows) == 0), F.raise_error(F.lit("expected a non-empty list of records")).cast("array<map<string,string>>")
    ).otherwise(rows)
    return df.select(F.posexplode(sound).alias("record", "fields")).withColumn("fields", F.map_filter("fields", lambda k, _: k != "_id"))


def merged_fields(recs: DataFrame) -> DataFrame:
    """record, key, value with repeated keys merged: the one value that says something, the first where none does; an error if two
    differ."""
    e = recs.select("record", F.posexplode(F.map_entries("fields")).alias("at", "e")).select("record", "at", "e.key", "e.value")
    says = ~F.lower(F.trim(F.coalesce("value", F.lit("none")))).isin(ABSENT)
    g = e.groupBy("record", "key").agg(F.collect_set(F.when(says, F.trim("value"))).alias("said"), F.min_by("value", "at").alias("first"))
    clash = F.raise_error(F.concat(F.lit("conflicting values of repeated column "), F.col("key")))
    return g.select("record", "key", F.when(F.size("said") > 1, clash).when(F.size("said") == 1, F.get("said", F.lit(0))).otherwise(F.col("first")).alias("value"))


def embedded_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """record, fields of the dataset ``var x = [...];`` inside each page; a page without one is an error."""
    body = F.regexp_extract(html, r"(?s)var\s+\w+\s*=\s*(\[.*?\])\s*;", 1)
    found = pages.select(F.when(body != "", body).otherwise(F.raise_error(F.lit("no embedded dataset"))).alias("body"))
    return records(found, "body")


def fluxes(recs: DataFrame) -> DataFrame:
    """record, reaction, value of the fields named R and digits; null and NA are missing and give no row."""
    e = recs.select("record", F.explode("fields").alias("reaction", "v")).where(r"reaction rlike '^R\\d+$'")
    return e.select("record", "reaction", numeric(F.col("v")).alias("value")).where("value is not null")


def phenotypes(recs: DataFrame) -> DataFrame:
    f = lambda k: F.try_element_at("fields", F.lit(k))
    return recs.select("record", f("Strain").alias("strain"), f("MediumID").alias("medium_id"), canonical_stress(f("Stress")).alias("stress"), canonical_gp(f("GP")).alias("gp"), numeric(f("LT")).alias("lag_time"), numeric(f("GR")).alias("growth_rate"), numeric(f("FOD")).alias("final_od"))


def verified(spark: SparkSession, path: str, sidecars: DataFrame) -> DataFrame:
    """name, bytes, sha256, ok of the files at ``path`` against ``sidecars`` (name, bytes, sha256); a file that isn't there is not ok."""
    b = spark.read.format("binaryFile").load(path).select(file_name(F.col("path")).alias("name"), F.col("length").alias("there"), F.sha2("content", 256).alias("sum"))
    return sidecars.join(b, "name", "left").select("name", "bytes", "sha256", F.coalesce((F.col("there") == F.col("bytes")) & (F.col("sum") == F.col("sha256")), F.lit(False)).alias("ok"))


def edge_sheet(spark: SparkSession, path: str, sep: str = "\t", headers: tuple[str, ...] = ()) -> DataFrame:
    """a, b: the first two columns of an exported interaction sheet, without title and header rows and blanks."""
    raw = spark.read.csv(path, sep=sep, header=False, maxColumns=MAX_COLUMNS)
    cols = raw.columns
    e = raw.select(F.trim(F.col(cols[0])).alias("a"), F.trim(F.col(cols[1])).alias("b")).where("a <> '' and b <> ''")
    return e.where(~F.lower("a").isin([h.lower() for h in headers])) if headers else e


def medium_bounds(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """medium_id, reaction, bound of a sheet whose columns 3, 5 and 6 are medium, reactions and lower bounds; unequal lists are skipped."""
    raw = spark.read.csv(path, sep=sep, header=False)
    c = raw.columns
    pairs = F.explode(bounds_pairs(F.col(c[4]), F.col(c[5]))).alias("p")
    return raw.select(F.trim(F.col(c[2])).alias("medium_id"), pairs).select("medium_id", "p.reaction", "p.bound").where("bound is not null")


def growth_phases(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """source_id, phase, exponential of a sheet with ID and Growth Phase; no phase is not exponential."""
    g = spark.read.csv(path, sep=sep, header=True)
    return g.select(F.trim("ID").alias("source_id"), F.col("Growth Phase").alias("phase"), F.coalesce(F.lower(F.trim("Growth Phase")).rlike("^(exp|mid-exp)"), F.lit(False)).alias("exponential"))


def enzyme_sheet(spark: SparkSession, path: str, metabolite: str, enzymes: str, sep: str = "\t") -> DataFrame:
    """metabolite, enzyme: the sheet's lists, parted by commas or blanks, one pair a row."""
    e = spark.read.csv(path, sep=sep, header=True).select(F.trim(metabolite).alias("metabolite"), F.explode(F.split(enzymes, r"[,\s]+")).alias("enzyme"))
    return e.where("metabolite <> '' and enzyme <> ''").distinct()


def cel(spark: SparkSession, path: str) -> DataFrame:
    """array_id, idx (y * columns + x), intensity, stdev, npix of ASCII arrays, version 3. Another format, or one without columns in its
    header or without intensities, is an error."""
    w = spark.read.text(path, wholetext=True).select(F.split_part(file_name(F.col("_metadata.file_path")), F.lit("."), F.lit(1)).alias("array_id"), F.regexp_replace("value", "\r", "").alias("t"))
    cols = F.regexp_extract("t", r"(?mi)^Cols=(\d+)", 1)
    body = F.regexp_extract("t", r"(?si)\[INTENSITY\]\n(.*?)(?:\n\[|$)", 1)
    sound = F.when(F.ltrim("t").startswith("[CEL]") & (cols != "") & (body != ""), body).otherwise(F.raise_error(F.concat(F.lit("not an ASCII array file: "), F.col("array_id"))))
    lines = w.select("array_id", cols.try_cast("int").alias("n"), F.explode(F.split(sound, "\n")).alias("line")).where(r"line rlike '^\\s*\\d+\\s+\\d+\\s+\\S'")
    p = F.split(F.trim("line"), r"\s+")
    num = lambda k: F.get(p, F.lit(k)).try_cast("double")
    return lines.select("array_id", (num(1) * F.col("n") + num(0)).cast("bigint").alias("idx"), num(2).alias("intensity"), num(3).alias("stdev"), num(4).alias("npix"))


def cdf(spark: SparkSession, path: str, pm_only: bool = True) -> DataFrame:
    """probeset, idx (from 0) of a layout with columns probeset, type, index (from 1)."""
    c = spark.read.csv(path, sep="\t", header=True)
    c = c.where("type = 'pm'") if pm_only else c
    return c.select("probeset", (F.col("index").cast("bigint") - 1).alias("idx"))


def htseq(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(counts: sample, gene, n; summary: sample, key, n). The sample is the file's name up to the first dot; lines without a number are
    skipped; names that begin with ``__`` are the summary."""
    t = spark.read.text(path).select(F.split_part(file_name(F.col("_metadata.file_path")), F.lit("."), F.lit(1)).alias("sample"), F.split("value", "\t").alias("p"))
    rows = t.select("sample", F.trim(F.get("p", F.lit(0))).alias("gene"), F.trim(F.get("p", F.lit(1))).try_cast("double").cast("bigint").alias("n")).where("n is not null")
    special = F.col("gene").startswith("__")
    return rows.where(~special), rows.where(special).withColumnRenamed("gene", "key")


def common_genes(counts: DataFrame) -> DataFrame:
    """The counts of the genes that every sample has."""
    n = counts.agg(F.count_distinct("sample").alias("samples"))
    g = counts.groupBy("gene").agg(F.count_distinct("sample").alias("k")).join(F.broadcast(n)).where("k = samples").select("gene")
    return counts.join(g, "gene", "left_semi")


def metabolic_model(spark: SparkSession, path: str, biomass: str = "BIOMASS") -> tuple[DataFrame, DataFrame]:
    """(stoichiometry: metabolite, reaction, coefficient; reactions: reaction, lb, ub, objective, rule, genes) of a model in JSON.
    Missing bounds are -1000 and 1000; without any objective the first reaction named for biomass is it."""
    schema = "reactions array<struct<id:string, metabolites:map<string,double>, lower_bound:double, upper_bound:double, objective_coefficient:double, gene_reaction_rule:string>>"
    r = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("reactions").alias("r")).select("r.*")
    s = r.select(F.explode("metabolites").alias("metabolite", "coefficient"), F.col("id").alias("reaction")).select("metabolite", "reaction", "coefficient")
    genes = F.array_distinct(F.filter(F.split(F.regexp_replace("gene_reaction_rule", r"[()]", " "), r"\s+"), lambda g: (g != "") & ~F.lower(g).isin("and", "or")))
    r = r.select(F.col("id").alias("reaction"), F.coalesce("lower_bound", F.lit(-1000.0)).alias("lb"), F.coalesce("upper_bound", F.lit(1000.0)).alias("ub"), F.coalesce("objective_coefficient", F.lit(0.0)).alias("o"), F.col("gene_reaction_rule").alias("rule"), genes.alias("genes"))
    any_goal = r.agg(F.max(F.abs("o")).alias("any"), F.min(F.when(F.upper("reaction").contains(biomass), F.col("reaction"))).alias("first"))
    goal = F.when(F.col("any") > 0, F.col("o")).otherwise((F.col("reaction") == F.col("first")).cast("double"))
    return s, r.join(F.broadcast(any_goal)).select("reaction", "lb", "ub", F.coalesce(goal, F.lit(0.0)).alias("objective"), "rule", "genes")


def symbol_map(spark: SparkSession, path: str) -> DataFrame:
    """symbol (lower case) -> locus of a gene list whose first column is ``eco:b0001`` and whose last begins with the symbols. The first
    locus in the file wins."""
    t = spark.read.text(path).withColumn("p", F.split("value", "\t")).where("size(p) >= 2")
    t = t.select(F.trim(F.element_at(F.split(F.get("p", F.lit(0)), ":"), -1)).alias("locus"), F.split(F.split_part(F.element_at("p", -1), F.lit(";"), F.lit(1)), ",").alias("s"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"))
    s = t.where(r"locus rlike '^b\\d{4}$'").select("locus", "b", "at", F.explode("s").alias("symbol")).select("locus", "b", "at", F.lower(F.trim("symbol")).alias("symbol"))
    return s.where("symbol <> '' and not contains(symbol, ' ')").groupBy("symbol").agg(F.min_by("locus", F.struct("b", "at", "locus")).alias("locus"))
