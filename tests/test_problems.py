"""Problems 1, 3 and 4: hand-made cases, nulls, empty tables, clashing columns, and brute force over a small delivered table."""

from __future__ import annotations

import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from polyomics.operators import impute, units, wide

SMALL = "/root/testdata/sf0.001"
C = "mc_id bigint, medium_id string, component string, raw string, amount double, unit string, loaded_at string, value string"
M = "medium_id string, base_medium string, description string, unit string"
R = "component string, molar_mass double, density_g_ml double, common_unit string"
REFERENCE = [("Glucose", 180.0, None, "mM"), ("Ethanol", 46.0, 0.8, "mM"), ("Agar", None, None, "g/L")]


def quantities(spark, rows, media=()):
    c = spark.createDataFrame([(i, *r, None, "clash") for i, r in enumerate(rows)], C)
    return units.quantities(c, spark.createDataFrame(list(media), M), spark.createDataFrame(REFERENCE, R))


CONVERTED = [
    ("Glucose", "1.8 g/L", None, None, 10.0), ("GLUCOSE ", "10mM", None, None, 10.0), ("Glucose", "low( 10000 µmol/l )", None, None, 10.0),
    ("Glucose", "0,18%", None, None, 10.0), ("Glucose", "0.18% (w/v)", None, None, 10.0), ("Glucose", "1 800 mg l-1", None, None, 10.0),
    ("Glucose", "1.8x10^3 mg per liter", None, None, 10.0), ("Glucose", "1.8 × 10^0 g/l", None, None, 10.0), ("Glucose", "1.8E+00G/L", None, None, 10.0),
    ("Glucose", "450 mg in 250 mL", None, None, 10.0), ("Glucose", "3.6 g / 2 L", None, None, 10.0), ("Glucose", "ca. .18 g/100 ml, sterile", None, None, 10.0),
    ("Glucose", "final conc. 10mM [added after 2 h]", None, None, 10.0), ("Glucose", "10 mM (pH 7)", None, None, 10.0), ("Glucose", "10mM final", None, None, 10.0),
    ("Glucose", "10", None, "millimolar", 10.0), ("Glucose", None, 10.0, "mM", 10.0), ("Glucose", " ", 10.0, "mM", 10.0), ("Glucose", "10mM", 99.0, "g/L", 10.0),
    ("Ethanol", "1% v/v", None, None, 8 / 46 * 1000), ("Ethanol", "1 % (vol/vol)", None, None, 8 / 46 * 1000), ("Agar", "1.5 percent", None, None, 15.0),
    ("Glucose", "0", None, "mM", 0.0),
]
NOT_CONVERTED = [
    ("Glucose", "?", None, None, "no_number"), ("Glucose", "1x", 1.0, "x", "unknown_unit"), ("Glucose", "trace", None, None, "no_number"), ("Glucose", None, None, None, "no_number"),
    ("Glucose", "10", None, None, "no_unit"), ("Glucose", None, 10.0, None, "no_unit"), ("Agar", "5 mM", None, None, "unknown_unit"), ("Glucose", "5% v/v", None, None, "unknown_unit"),
    ("What", "5 mM", None, None, "unknown_component"), (None, "5 mM", None, None, "unknown_component"), ("Glucose", "x" * 50_000, None, None, "no_number"), ("Glucose", "5 drops", None, None, "unknown_unit"),
]


def test_converted(spark):
    got = {r["mc_id"]: r for r in quantities(spark, [("M1", *c[:4]) for c in CONVERTED]).collect()}
    assert len(got) == len(CONVERTED)
    for i, case in enumerate(CONVERTED):
        assert got[i]["outcome"] == "converted" and math.isclose(got[i]["value"], case[4], rel_tol=1e-9, abs_tol=1e-12), (case, got[i])


def test_not_converted(spark):
    got = {r["mc_id"]: r for r in quantities(spark, [("M1", *c[:4]) for c in NOT_CONVERTED]).collect()}
    for i, case in enumerate(NOT_CONVERTED):
        assert got[i]["outcome"] == case[4] and got[i]["value"] is None, (case, got[i])


def test_statement_of_the_medium(spark):
    media = [("M1", None, "plate medium; values in uM", None), ("M2", None, "kept at 4 C in 2 L flasks", None), ("M3", None, None, None), ("M4", None, "figures are g per litre", None)]
    q = quantities(spark, [(m, "Glucose", "18", None, None) for m in ("M1", "M2", "M3", "M4")] + [("M1", "Glucose", None, 18.0, None)], media)
    got = {r["mc_id"]: r["value"] for r in q.collect()}
    assert math.isclose(got[0], 0.018) and got[1] is None and got[2] is None and math.isclose(got[3], 100.0) and got[4] is None


def test_same_quantity(spark):
    rows = [("M1", "Glucose", "10 mM", None, None), ("M1", "glucose", "1.8 g/L", None, None), ("M1", "Glucose", "10.3 mM", None, None), ("M2", "Glucose", "10 mM", None, None), ("M1", "Glucose", "0 mM", None, None), ("M1", "Glucose", "0 g/L", None, None), ("M1", "Glucose", "10.19 mM", None, None)]
    got = sorted(tuple(r) for r in units.same_quantity(quantities(spark, rows)).collect())
    assert got == [(0, 1), (0, 6), (1, 6), (2, 6)]
    twice = spark.createDataFrame([(1, "M1", "Glucose", "10 mM", None, None, t, "") for t in ("a", "b")], C)
    q = units.quantities(twice, spark.createDataFrame([], M), spark.createDataFrame(REFERENCE, R))
    assert q.count() == 1 and units.same_quantity(q).count() == 0
    assert units.same_quantity(units.quantities(spark.createDataFrame([], C), spark.createDataFrame([], M), spark.createDataFrame([], R))).count() == 0


def test_band_join_is_all_pairs_within_tolerance(spark):
    values = [1.02**k * j for k in range(12) for j in (1.0, 1.001, 1.0199, 0.9803)]
    q = spark.createDataFrame([(i, "M", "C", v) for i, v in enumerate(values)], "mc_id bigint, medium_id string, component string, value double")
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and abs(a - b) <= 0.02 * max(a, b)}
    got = [tuple(r) for r in units.same_quantity(q).collect()]
    assert set(got) == want and len(got) == len(want)


# ---- problem 3

L = "profile_id bigint, layer string, run_id string, condition_key string, cell_values array<double>, value string"
AXIS = [("t", 0, "g0"), ("t", 1, "g1"), ("t", 2, "g2")]
NAN = float("nan")


def filled(spark, rows, group=1000):
    p = impute.fill_keys(spark.createDataFrame([(*r, "clash") for r in rows], L))
    axis = spark.createDataFrame(AXIS, "layer string, idx bigint, molecule_id string")
    return p, impute.fill_cells(p, axis, group=group), impute.gaps(p, impute.fill_vectors(p, axis, group=group))


@pytest.mark.parametrize("group", [1000, 1])  # 1: every group taken for a large one
def test_fill(spark, group):
    key = "S 1.MD00000001.none.b1(KO)"
    rows = [
        (1, "t", "r1", key, [1.0, None, -9999.0]), (2, "t", "r1", None, [3.0, 4.0, NAN]), (3, "t", "r1", "S 1.?.none.b1(KO)", [5.0, 6.0, None]),
        (4, "t", "r2", key, [7.0, None, 9.0]), (5, "t", "r3", "n/d", [1.0, None, 2.0]), (6, "t", "r2", " " + key, None), (7, "t", "r2", key, [0.0, 0.0, None]), (8, "t", None, "", [1.0]),
    ]
    p, f, g = filled(spark, [*rows, rows[0], rows[4]], group)
    keys = {r["profile_id"]: r["condition_key"] for r in p.collect()}
    assert keys == {1: key, 2: key, 3: key, 4: key, 5: None, 6: key, 7: key, 8: None}
    cell = {(r["profile_id"], r["molecule_id"]): (r["value"], r["flag"]) for r in f.collect()}
    assert len(cell) == f.count() == 24
    assert cell[1, "g1"] == (5.0, "run") and cell[1, "g2"] == (9.0, "condition") and cell[4, "g1"] == (5.0, "condition") and cell[6, "g0"] == (4.0, "condition")
    assert cell[7, "g0"] == (4.0, "condition") and cell[5, "g1"] == (None, "unfilled") and cell[8, "g2"] == (None, "unfilled") and cell[8, "g0"] == (1.0, "read")
    assert g.count() == g.distinct().count()
    g = {(r["profile_id"], r["field_name"]): r["outcome"] for r in g.collect()}
    assert g[2, "condition_key"] == key and g[3, "condition_key"] == key and g[5, "condition_key"] == "unfilled" and (4, "condition_key") not in g
    assert g[6, "g2"] == "filled" and g[5, "g1"] == "unfilled"


def test_fill_empty(spark):
    assert [df.count() for df in filled(spark, [])] == [0, 0, 0]


def test_large_groups_are_filled_like_small_ones(spark):
    rng = random.Random(6)
    cell = lambda: rng.choice([None, NAN, round(rng.random(), 1), rng.random()])
    rows = [(i, "t", rng.choice(["r1", "r2", "r3", None]), rng.choice(["a.m.none.none", "b.m.none.none", None]), [cell() for _ in range(rng.randint(0, 3))]) for i in range(300)]
    small, large = ({(r["profile_id"], r["molecule_id"]): (r["condition_key"], r["value"], r["flag"]) for r in filled(spark, rows, g)[1].collect()} for g in (1000, 20))
    assert small.keys() == large.keys() and len(small) == 900
    assert all(small[k][::2] == large[k][::2] and small[k][1] == (large[k][1] and pytest.approx(large[k][1])) for k in small)


def test_gaps_against_brute_force(spark):
    if not os.path.exists(SMALL):
        pytest.skip("no test data")
    m = spark.read.parquet(f"{SMALL}/layer_matrix.parquet")
    axis = spark.read.parquet(f"{SMALL}/layer_axis.parquet")
    p = impute.fill_keys(m)
    got = {(r["profile_id"], r["field_name"], r["outcome"]) for r in impute.gaps(p, impute.fill_vectors(p, axis)).collect()}
    names = defaultdict(dict)
    for r in axis.collect():
        names[r["layer"]][r["idx"]] = r["molecule_id"]
    rows = {r["profile_id"]: r for r in m.collect()}

    def full(k):
        parts = (k or "").split(".")
        return k.strip() if len(parts) == 4 and all(x.strip().lower() not in impute.UNKNOWN_PART for x in parts) else None

    def read(r):
        cells = list(r["cell_values"] or [])
        cells += [None] * (len(names[r["layer"]]) - len(cells))
        cells = [None if c is None or c != c or c in impute.NO_READING or math.isinf(c) else c for c in cells]
        return cells if any(c for c in cells) else [None] * len(cells)

    runs = defaultdict(Counter)
    for r in rows.values():
        if full(r["condition_key"]):
            runs[r["layer"], r["run_id"]][full(r["condition_key"])] += 1
    want, has, keys = set(), Counter(), {}
    for i, r in rows.items():
        own, other = full(r["condition_key"]), runs[r["layer"], r["run_id"]]
        keys[i] = own or (min(other, key=lambda k: (-other[k], k)) if other else None)
        if not own:
            want.add((i, "condition_key", keys[i] or "unfilled"))
        for j, c in enumerate(read(r)):
            has[r["layer"], keys[i], j] += c is not None and keys[i] is not None
    for i, r in rows.items():
        want |= {(i, names[r["layer"]][j], "filled" if has[r["layer"], keys[i], j] else "unfilled") for j, c in enumerate(read(r)) if c is None}
    assert got == want


# ---- problem 4

DEFS = [("ampR", "flag", None), ("count_no", "integer", "bp"), ("size", "decimal", "Mb"), ("kind", "category", None), ("made_on", "day", None)]


def cells(spark, rows):
    r = spark.createDataFrame([(i, s, f, v, 1, "clash") for i, (s, f, v) in enumerate(rows)], "sf_id bigint, strain string, feature string, value string, present int, attribute string")
    m = wide.strain_cells(r, spark.createDataFrame(DEFS, "feature string, value_type string, unit string"))
    return m, {(x["entity"], a): (c["value"], c["outcome"]) for x in m.collect() for a, c in x["cells"].items()}


TYPED = [
    ("ampR", " Yes ", "true"), ("ampR", "+", "true"), ("ampR", "-", "false"), ("ampR", "none", "false"), ("ampR", "maybe", None), ("ampR", "2 of 3", None),
    ("count_no", "7'570", "7570"), ("count_no", "1,435", "1435"), ("count_no", "7 353 bp", "7353"), ("count_no", "044", "44"), ("count_no", "38.0", "38"), ("count_no", "3.5", None), ("count_no", "10x", None),
    ("count_no", "12-15", None), ("count_no", "+23", "23"), ("count_no", "5 Mb", None), ("size", "83,68", "83.68"), ("size", "9.014000e+01", "90.14"), ("size", "~5.1 Mb", "5.1"), ("size", "= 2.93Mb", "2.93"), ("size", "1.2.3", None), ("size", "fast (>2x)", None),
    ("size", "1,234.5", "1234.5"), ("kind", " F+ ", "f+"), ("made_on", "2005-05-28", "2005-05-28"), ("made_on", "20130809", "2013-08-09"), ("made_on", "5.3.2014", "2014-03-05"), ("made_on", "2 Dec 2002", "2002-12-02"),
    ("made_on", "Jun 20, 2018", "2018-06-20"), ("made_on", "12-JAN-2002", "2002-01-12"), ("made_on", "31.04.2012", None), ("made_on", "12/2014", None), ("made_on", "2019-13-04", None), ("made_on", "29.2.2012", "2012-02-29"),
]


def test_typed(spark):
    _, got = cells(spark, [(f"S{i}", feature, value) for i, (feature, value, _) in enumerate(TYPED)])
    for i, (feature, value, text) in enumerate(TYPED):
        assert got[f"S{i}", feature] == (text, "value" if text else "unreadable"), value


def test_cells(spark):
    rows = [
        ("SR-1", "size", "1.50"), (" SR1", "SIZE ", "1,5 Mb"), ("SR1", "count no", "5"), ("sr 1", "Count-No", "6"), ("SR1", "kind", "no"), ("SR1", "kind", None), ("SR1", "made_on", "soon"), ("SR1", "made_on", "2001/02/03"),
        ("SR1", "ampR", "?"), ("SR1", "ampR", "weak?"), (None, "ampR", "yes"), ("SR2", None, "yes"), ("SR2", "unheard of", "1"), ("", "size", "1"),
    ]
    m, got = cells(spark, rows)
    assert got == {("SR1", "size"): ("1.5", "value"), ("SR1", "count_no"): (None, "conflict"), ("SR1", "kind"): (None, "silent"), ("SR1", "made_on"): ("2001-02-03", "value"), ("SR1", "ampR"): (None, "unreadable")}
    u = sorted(tuple(r) for r in wide.unsettled(m, "strain").collect())
    assert u == [("strain", "SR1", "ampR", "unreadable"), ("strain", "SR1", "count_no", "conflict")]
    w = wide.project(m, {f: k for f, k, _ in DEFS})
    r = w.collect()[0]
    assert dict(w.dtypes)["size"] == "double" and dict(w.dtypes)["made_on"] == "date" and r["size"] == 1.5 and str(r["made_on"]) == "2001-02-03" and [tuple(c) for c in r["conflicts"]] == [("count_no", "5", "6")] and r["unreadable"] == ["ampR"]
    assert [tuple(c) for c in r["failures"]] == [("ampR", "weak?", 1), ("made_on", "soon", 1)]
    assert cells(spark, [])[0].count() == 0


def test_medium_cells(spark):
    rows = [("M1", "Glucose", "10 mM", None, None), ("M1", "glucose ", "1.8 g/L", None, None), ("M1", "Agar", "5 g/L", None, None), ("M1", "Agar", "1%", None, None), ("M2", "Agar", "0", None, "g/L"), ("M2", "Agar", "5 g/L", None, None), (None, "Agar", "5 g/L", None, None)]
    c = spark.createDataFrame([(i, *r, None, "clash") for i, r in enumerate(rows)], C)
    m = wide.medium_cells(c, spark.createDataFrame([], M), spark.createDataFrame(REFERENCE, R))
    got = {(x["entity"], a): k["outcome"] for x in m.collect() for a, k in x["cells"].items()}
    assert got == {("M1", "Glucose"): "value", ("M1", "Agar"): "conflict", ("M2", "Agar"): "value"}
    assert [tuple(r) for r in wide.unsettled(m, "medium").collect()] == [("medium", "M1", "Agar", "conflict")]
    assert wide.project(m, {"Glucose": "decimal"}).where(F.col("entity") == "M1").collect()[0]["Glucose"] == 10.0
