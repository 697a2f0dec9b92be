"""Queries of the problems on free text and corpora over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyomics.llm import bpe, dedup, mixture, names, split
from polyomics.session import materialize, prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "strain"), table(spark, d, "medium"), table(spark, d, "canon_list")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.match(*_names(spark, d))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return names.unmatched(*_names(spark, d))


def _records(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "condition_raw": dedup.hashed(dedup.canonical_conditions(table(spark, d, "condition_raw"))),
        "perturbation": dedup.hashed(dedup.canonical_perturbations(table(spark, d, "perturbation"))),
    }


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = [dedup.copies(materialize(r, name)).select(F.lit(name).alias("record_table"), "keep_id", "copy_id") for name, r in _records(spark, d).items()]
    return found[0].unionByName(found[1])


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record once: its smallest id and the number of its copies."""
    found = [dedup.groups(r).select(F.lit(name).alias("record_table"), "keep_id", "copies") for name, r in _records(spark, d).items()]
    return found[0].unionByName(found[1])


def p5_collisions(spark: SparkSession, d: str) -> DataFrame:
    """The collision check of both tables."""
    found = [dedup.collisions(r).withColumn("record_table", F.lit(name)) for name, r in _records(spark, d).items()]
    return found[0].unionByName(found[1])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the sources the target list names."""
    return table(spark, d, "documents").join(F.broadcast(table(spark, d, "mix_target").select("source").distinct()), "source", "left_semi")


def _mixture(spark: SparkSession, d: str, whole_corpus: bool) -> tuple[DataFrame, DataFrame]:
    streamed = materialize(mixture.stream(materialize(bpe.count(_named(spark, d)), "counted")), "streamed")
    planned = materialize(mixture.plan(streamed, table(spark, d, "mix_target"), whole_corpus=whole_corpus), "planned")
    return mixture.mix(streamed, planned), planned


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture as long as the corpus, small sources capped."""
    return _mixture(spark, d, True)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(*_mixture(spark, d, True))


def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The mixture as blocks of token ids."""
    return mixture.blocks(_mixture(spark, d, True)[0], bpe.encode(_named(spark, d)))


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    """The longest mixture in which every share is met; its length is set by the source that runs out first."""
    return _mixture(spark, d, False)[0]


def p7_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(*_mixture(spark, d, False))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split(table(spark, d, "documents"))


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched, "p5_found": p5_found, "p5_groups": p5_groups, "p5_collisions": p5_collisions, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_blocks": p7_blocks, "p7_exact": p7_exact, "p7_exact_shares": p7_exact_shares, "p8_pieces": p8_pieces}


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_PLAIN = r"lower(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_MEMBER = f"""CASE WHEN regexp_matches(m, '{dedup.TYPE_LAST}') THEN [regexp_extract(m, '{dedup.TYPE_LAST}', 1), regexp_extract(m, '{dedup.TYPE_LAST}', 2)]
WHEN regexp_matches(m, '{dedup.TYPE_FIRST}') THEN [regexp_extract(m, '{dedup.TYPE_FIRST}', 2), regexp_extract(m, '{dedup.TYPE_FIRST}', 1)] ELSE [m, 'ex'] END"""
_PAIR = f"CASE WHEN {_PLAIN.format('p[1]')} IN ({_quoted(dedup.WILD_TYPE)}) THEN '' ELSE {_PLAIN.format('p[1]')} || '|' || {_PLAIN.format('p[2]')} END"


def _set(column: str, split: str, each: str, nothing: list[str]) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({each.format(f'regexp_split_to_array(coalesce({column}, {chr(39)}{chr(39)}), {chr(39)}{split}{chr(39)})')}, lambda w: w NOT IN ({_quoted(nothing)})))), ';')"


_STRESSES = _set("stress", "[;,|+/]", f"list_transform({{}}, lambda m: {_PLAIN.format('m').replace('{', '{{').replace('}', '}}')})", dedup.NO_STRESS)
_GENES = _set("gp", "[;,|+]", f"list_transform(list_transform({{}}, lambda m: {_MEMBER.replace('{', '{{').replace('}', '}}')}), lambda p: {_PAIR.replace('{', '{{').replace('}', '}}')})", dedup.WILD_TYPE)
_PART = "CASE WHEN cond IS NOT NULL THEN string_split(cond, '.')[{}] ELSE {} END AS {}"
_CANON = f"""WITH r AS (SELECT record_id AS id, {_PART.format(1, 'strain', 's')}, {_PART.format(2, 'medium_id', 'm')}, {_PART.format(3, 'stress', 'stress')}, {_PART.format(4, 'gp', 'gp')}
FROM condition_raw WHERE cond IS NULL OR len(string_split(cond, '.')) = 4),
c AS (SELECT 'condition_raw' AS record_table, id, concat({_PLAIN.format('s')}, chr(10), {_PLAIN.format('m')}, chr(10), {_STRESSES}, chr(10), {_GENES}) AS canon FROM r
UNION ALL SELECT 'perturbation', pert_id, concat({_PLAIN.format('study_id')}, chr(10), array_to_string(list_sort([{_PLAIN.format('gene')}, {_PLAIN.format('type')}]), '|')) FROM perturbation)"""
#: The same by windows over whole groups, for one machine.
SQL: dict[str, str] = {
    "p5_found": f"{_CANON} SELECT record_table, keep_id, id AS copy_id FROM (SELECT *, min(id) OVER (PARTITION BY record_table, canon) AS keep_id FROM c) WHERE id > keep_id",
    "p5_collisions": f"{_CANON} SELECT record_table, count(*) AS records, count(DISTINCT canon) AS texts, 0 AS collisions FROM c GROUP BY 1",
    "p5_groups": f"{_CANON} SELECT record_table, min(id) AS keep_id, count(*) AS copies FROM c GROUP BY record_table, canon",
}
