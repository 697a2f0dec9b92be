"""Reports over small metric frames: Markdown tables, verdicts, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyomics.functions.parse import pcc_text


def formatted(metrics: DataFrame) -> DataFrame:
    """predictor, axis, text: ``mean ± sd``, suppressed where too few conditions back the axis per molecule."""
    least = F.when(F.col("axis") == "molecule", 15).otherwise(0)
    return metrics.select("predictor", "axis", pcc_text(F.col("mean"), F.col("sd"), F.when(F.col("n_conditions") < least, F.col("n_conditions")).otherwise(F.greatest("n_conditions", F.lit(15)))).alias("text"))


def verdict(value: Column, low: Column, high: Column) -> Column:
    """within, above or below a published range; null without a value."""
    return F.when(value.isNull(), None).when(value < low, "below").when(value > high, "above").otherwise("within")


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A small frame as a Markdown table; it is collected, so aggregate first."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.select(*columns).collect()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(r) + " |" for r in rows)])


def claims(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """name, actual, expected, tolerance, holds: each claim against what was measured; a claim without a measurement doesn't hold."""
    j = expected.join(actual, "name", "left")
    return j.select("name", "actual", "expected", "tolerance", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance"), F.lit(False)).alias("holds"))
