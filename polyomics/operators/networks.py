"""Interaction networks as edge frames: (arm, src, dst), both directions, no self-loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyomics.functions.parse import is_leaky, repaired_token


def symmetric(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct edges in both directions without self-loops; null ends are dropped. Both directions come from one read."""
    by = by or []
    both = F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    return edges.where("src <> dst").select(*by, both).select(*by, "e.src", "e.dst").distinct()


def statistics(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_nodes and n_edges (undirected) of a symmetric edge frame."""
    return edges.groupBy(*(by or [])).agg(F.count_distinct("src").alias("n_nodes"), F.floor(F.count("*") / 2).cast("bigint").alias("n_edges"))


def restrict(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """The edges whose ends are both among ``genes`` (molecule_id)."""
    g = genes.select("molecule_id").distinct()
    return edges.join(g, edges.src == g.molecule_id, "left_semi").join(g, edges.dst == g.molecule_id, "left_semi")


def parse_report(raw: DataFrame, symbols: Column) -> DataFrame:
    """One row of counters over a two-column sheet (a, b): rows, kept, self_loops, dropped, and the dropped tokens in order."""
    r = raw.select("a", "b", repaired_token(F.col("a"), symbols).alias("src"), repaired_token(F.col("b"), symbols).alias("dst"))
    lost = F.array_compact(F.array(F.when(F.col("src").isNull(), F.col("a")), F.when(F.col("dst").isNull(), F.col("b"))))
    return r.agg(
        F.count("*").alias("rows"), F.count_if(F.col("src") != F.col("dst")).alias("kept"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"),
        F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("dropped"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(lost)))).alias("dropped_tokens"),
    )


def arms(edges: DataFrame, with_leaky: bool = False) -> DataFrame:
    """The edges of the arms to use: leaky ones only on request. An arm name is the first column of the frame."""
    return edges if with_leaky else edges.where(~is_leaky(F.col("arm")))


def neighbours(targets: DataFrame, edges: DataFrame, measured: DataFrame) -> DataFrame:
    """arm, target, feature: the measured neighbours of each target in each arm."""
    e = edges.select("arm", F.col("src").alias("target"), F.col("dst").alias("feature"))
    return e.join(targets.select("target").distinct(), "target", "left_semi").join(measured.select(F.col("molecule_id").alias("feature")).distinct(), "feature", "left_semi").distinct()


def regulators(sheet: DataFrame) -> DataFrame:
    """molecule_id: the transcription factors of a regulatory sheet (a, b), that is the loci in its first column."""
    return sheet.where(r"a rlike '^b\\d{4}$'").select(F.col("a").alias("molecule_id")).distinct()
