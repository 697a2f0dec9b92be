"""Canonical forms and text rules, with every edge case of the inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from polyomics.functions import canon, parse


def test_gp(values):
    rows = ["na_WT", "WT_na", "none", "", None, "b0624_OE", "b0688(KO);b0008(KO)", "b1(KO);b1(KO)", "mevalonate-pw(IN)", "KO_talB", "foo", "x_y_KO", "wt", "-"]
    want = ["none", "none", "none", "none", "none", "b0624(OE)", "b0008(KO);b0688(KO)", "b1(KO)", "mevalonate-pw(IN)", "TALB(KO)", "foo(EX)", "x_y(KO)", "none", "none"]
    got = values(canon.canonical_gp, rows)
    assert got == want
    assert values(canon.canonical_gp, got) == want  # idempotent


def test_gp_with_symbols(values):
    symbols = F.create_map(F.lit("talb"), F.lit("b0008"))
    assert values(lambda c: canon.canonical_gp(c, symbols), ["TALB(KO)", "KO_talB", "other(OE)"]) == ["b0008(KO)", "b0008(KO)", "other(OE)"]


def test_gp_order_is_by_gene_then_type(values):
    assert values(canon.canonical_gp, ["b2(OE);b2(KO);b10(KO)"]) == ["b10(KO);b2(KO);b2(OE)"]
    assert values(canon.perturbed_genes, ["b2(OE);b10(KO)"]) == [["b10", "b2"]]


def test_stress(values):
    assert values(canon.canonical_stress, ["None", " na ", "-", None, "lactose-shift", "heat;osmotic", "osmotic;heat"]) == ["none", "none", "none", "none", "lactose-shift", "heat;osmotic", "osmotic;heat"]
    a, b, c = values(canon.split_stress, ["heat;osmotic", "osmotic; heat;heat", "none"])
    assert a == b == ["heat", "osmotic"] and c == []


def test_condition(values, spark):
    k = values(lambda c: canon.parse_condition(c, strict=False), ["MG.MD1.None.na_WT", "a.b.c", "a.b.c.d.e", None])
    assert tuple(k[0]) == ("MG", "MD1", "none", "none") and k[1:] == [None, None, None]
    with pytest.raises(Exception, match="four dotted parts"):
        values(canon.parse_condition, ["a.b.c"])
    assert values(canon.is_wild_type, ["a.b.c.none", "a.b.c.b1(KO)"]) == [True, False]


def test_amount(values):
    rows = ["0", "no", "?", "", None, "328mM", "0.40%", "8.2 mM", "low(10nM)", "high(0.3M)", "0.0", "yes", "weird text"]
    got = [tuple(r) for r in values(parse.parse_amount, rows)]
    assert got == [
        (0.0, None, False), (0.0, None, False), (None, None, False), (0.0, None, False), (None, None, False), (328.0, "mM", True), (0.4, "%", True), (8.2, "mM", True),
        (10.0, "nM", True), (0.3, "M", True), (0.0, None, False), (None, None, True), (None, None, True),
    ]


def test_small_rules(values, spark):
    assert values(parse.numeric, ["1.5", " NA ", "nan", "", "x", None]) == [1.5, None, None, None, None, None]
    assert values(parse.marker_present, ["relA1", "no", " None ", None, "-"]) == [True, False, False, False, False]
    ids = ["EX_glc(e)", "EX_lac-D(e)", "EX_ala_L_e", "EX_glc__D_e", "PGI"]
    once = values(parse.modern_reaction_id, ids)
    assert once == ["EX_glc__D_e", "EX_lac__D_e", "EX_ala__L_e", "EX_glc__D_e", "PGI"] and values(parse.modern_reaction_id, once) == once
    assert values(parse.locus, ["x_b0012_at b0013", "none"]) == ["b0012", None]
    symbols = F.create_map(F.lit("citb"), F.lit("b1111"), F.lit("ydba"), F.lit("b2222"))
    assert values(lambda c: parse.repaired_token(c, symbols), ["b1474;", "citB", "ydbA_2", "what"]) == ["b1474", "b1111", "b2222", None]
    assert values(parse.is_leaky, ["a_LEAKY", "a"]) == [True, False]
    named = spark.createDataFrame([("Na+", "with na+ added"), ("Na", "sodium naphthol"), ("C.D", "cxd"), ("x", None)], "c string, t string")
    assert [r[0] for r in named.select(parse.named_in(F.col("c"), F.col("t"))).collect()] == [True, False, False, False]
    pairs = spark.createDataFrame([("A, B", "-1,-2"), ("A", "1,2")], "r string, b string").select(parse.bounds_pairs(F.col("r"), F.col("b")).alias("p")).collect()
    assert [tuple(x) for x in pairs[0][0]] == [("A", -1.0), ("B", -2.0)] and pairs[1][0] == []
    t = spark.createDataFrame([(0.2224, 0.1297, 596), (0.1, 0.1, 14), (0.1, 0.1, 15)], "m double, s double, n int").select(parse.pcc_text(F.col("m"), F.col("s"), F.col("n"))).collect()
    assert [r[0] for r in t] == ["0.2224 ± 0.1297", "n/a (14 cond)", "0.1000 ± 0.1000"]


def test_numeric_hard_texts(values):
    texts = ["+23", "9.014000e+01", "-1E-3", ".5", "5.", "1d", "1f", "2D", "0x1p3", "1e", "--1", "1,5", "infinity", "-inf", "+NaN", "-nan"]
    inf = float("inf")
    assert values(parse.numeric, texts) == [23.0, 90.14, -0.001, 0.5, 5.0, None, None, None, None, None, None, None, inf, -inf, None, None]


def test_numeric_values_is_every_value(spark):
    from polyomics.plans import core

    def brute(v):
        try:
            return None if v is None or "_" in v or v.strip().upper() in parse.NOT_A_NUMBER else float(v)
        except ValueError:
            return None

    d = "/root/testdata/sf0.01"
    rows = core.numeric_values(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/strain_feature.parquet").select("value").distinct().count()
    assert [r["x"] for r in rows] == [brute(r["value"]) for r in rows]
