"""Models, flux, encoder, sources, compendium and reports."""

from __future__ import annotations

import hashlib
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyomics import catalog, report
from polyomics.operators import cv, encode, flux, models
from polyomics.sources import files

# ---- LASSO and consensus


def objective(x, y, b, alpha):
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    r = y - y.mean() - z @ b
    return (r @ r) / 2 / len(y) + alpha * np.abs(b).sum()


def test_lasso():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8)) * np.arange(1, 9)
    x[:, 7] = 3.0
    y = x[:, 0] * 2 - x[:, 3] * 0.5 + rng.normal(size=40) * 0.1
    for alpha in (1e-3, 0.2):
        b, c, ok = models.lasso(x, y, alpha)
        assert ok and c == y.mean() and b[7] == 0
        z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        g = z.T @ (y - c - z @ b) / 40  # the conditions of the optimum
        assert (np.abs(g) <= alpha + 1e-8).all() and np.allclose(g[b != 0], alpha * np.sign(b[b != 0]), atol=1e-8)
        assert all(objective(x, y, b, alpha) <= objective(x, y, b + rng.normal(size=8) * 0.01, alpha) for _ in range(50))
    b, _, error = models.fit_lasso(x, y)
    assert error is None and np.corrcoef((x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1) @ b, y)[0, 1] > 0.99


def test_neighbour_lasso(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=(30, 5))
    keys = [f"c{i:02}" for i in range(30)]
    feats = spark.createDataFrame([(keys[i], f"g{j}", float(f[i, j])) for i in range(30) for j in range(5)], "condition_key string, molecule_id string, value double")
    y = spark.createDataFrame([(keys[i], "t", float(2 * f[i, 0] - f[i, 1])) for i in range(30)] + [(keys[0], "u", 1.0), (keys[1], "u", 2.0)], "condition_key string, molecule_id string, value double")
    edges = spark.createDataFrame([("a", "t", "g0"), ("a", "t", "g1"), ("a", "t", "g2"), ("z_LEAKY", "t", "g4"), ("a", "u", "g0"), ("a", "t", "unmeasured")], "arm string, target string, feature string")
    p = models.neighbour_lasso(feats, y, edges, cv.folds(feats, 5), alpha=1e-3).cache()
    a = p.where("arm = 'a' and target = 't'").toPandas()
    assert len(a) == 30 and np.corrcoef(a.y, a.y_hat.astype(float))[0, 1] > 0.99 and a.error.isna().all()
    assert {r["error"] for r in p.where("target = 'u'").collect()} == {"few"} and p.where("arm = 'z_LEAKY'").count() == 30


def test_consensus(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3))
    y = x @ [1.0, -1.0, 0.5]
    rows = [("good", f"c{i:02}", float(y[i]), x[i].tolist()) for i in range(30)] + [("noise", f"c{i:02}", float(y[i]), rng.normal(size=3).tolist()) for i in range(30)]
    rows[3] = ("good", "c03", float(y[3]), [None, 1.0, 1.0])
    v = spark.createDataFrame(rows, "layer string, condition_key string, y double, values array<double>")
    p = models.consensus_weights(v, cv.folds(v, 3)).cache()
    w = p.groupBy("fold").pivot("layer", ["good", "noise"]).agg(F.max("weight")).collect()
    assert len(w) == 3 and all(math.isclose(r["good"] + r["noise"], 1) and r["good"] > r["noise"] >= 0 for r in w)
    assert p.where("condition_key = 'c03' and layer = 'good'").collect()[0]["y_hat"] is None
    few = models.consensus_weights(v.where("condition_key in ('c00', 'c01', 'c02')"), cv.folds(v.where("condition_key in ('c00', 'c01', 'c02')"), 3))
    assert {r["weight"] for r in few.collect()} == {0.5} and few.where("y_hat is not null").count() == 0


def test_ols_and_calibration(spark):
    xy = spark.createDataFrame([("a", "t", 1.0, 3.0), ("b", "t", 2.0, 5.0), ("c", "t", 3.0, 7.0), ("d", "t", 9.0, 0.0), ("a", "f", 1.0, 3.0), ("b", "f", 1.0, 5.0), ("c", "f", 1.0, 7.0), ("d", "f", 1.0, 0.0)], "condition_key string, target string, x double, y double")
    fold = xy.select("condition_key", F.col("condition_key").alias("fold")).distinct()
    got = {(r["fold"], r["target"]): (r["slope"], r["intercept"]) for r in models.own_feature_ols(xy, fold).collect()}
    assert math.isclose(got["d", "t"][0], 2) and math.isclose(got["d", "t"][1], 1) and got["d", "f"][0] is None
    g = spark.createDataFrame([("k", 1.0, 0.5), ("k", 2.0, 1.0), ("k", 3.0, 1.5), ("f", 1.0, 1.0), ("f", 1.0, 2.0), ("f", 1.0, 3.0)], "run string, biomass double, growth double")
    fit = models.growth_calibration(g, ["run"])
    hat = models.calibrated(spark.createDataFrame([("k", 4.0), ("k", -9.0), ("k", None), ("f", 1.0)], "run string, biomass double"), fit, ["run"])
    assert [r["growth_hat"] for r in hat.orderBy("run", "biomass").collect()] == [None, None, 0.0, 2.0]


# ---- flux


def test_gene_rules(spark):
    d = spark.createDataFrame([({"b1": 1.0, "b2": 3.0, "b3": 2.0},)], "m map<string,double>")
    cases = {"(b1 and b2) or b3": 2.0, "b1 and b2 or b3": 2.0, "b1 and (b2 or b3)": 1.0, "b9 and b2": 3.0, "b9": None, "": None, "(b1 and b2": 1.0, "b1 and b2)) or b3": 1.0}
    for rule, want in cases.items():
        assert d.select(flux.gene_rule(rule, F.col("m")).alias("v")).collect()[0]["v"] == want, rule


def test_bounds(spark):
    d = spark.createDataFrame([(-5.0, None), (-5.0, 0.1), (-5.0, 0.5), (2.0, 0.5)], "lb double, level double")
    assert [r[0] for r in d.select(flux.bounds_from_expression(F.col("lb"), F.col("level"), 0.1)).collect()] == [-5.0, 0.0, -5.0, 0.0]
    r = spark.createDataFrame([("r", -9.0, 9.0)], "reaction string, lb double, ub double")
    c = spark.createDataFrame([("k", "M1"), ("j", "M9")], "condition_key string, medium_id string")
    m = spark.createDataFrame([("M1", "r", -3.0)], "medium_id string, reaction string, bound double")
    assert {x["condition_key"]: x["lb"] for x in flux.medium_bounds(r, c, m).collect()} == {"k": -3.0, "j": -9.0}
    cand = spark.createDataFrame([("pgi",), ("A-b",), ("none",)], "reaction string")
    assert {tuple(x) for x in flux.mappable(cand, spark.createDataFrame([("PGI",), ("A_b",)], "reaction string")).collect()} == {("pgi", "PGI"), ("A-b", "A_b")}
    f = spark.createDataFrame([("k", "EX_glc__D_e", -5.0), ("k", "r", 2.0), ("j", "r", 2.0)], "condition_key string, reaction string, flux double")
    assert {(x[0], x[1]): x[2] for x in flux.rescaled(f).collect()} == {("k", "EX_glc__D_e"): -100.0, ("k", "r"): 40.0, ("j", "r"): 2.0}
    lv = spark.createDataFrame([("k", "b1", "proteome", 4.0), ("k", "b1", "transcriptome", 9.0), ("k", "b2", "transcriptome", 2.0)], "condition_key string, gene string, layer string, value double")
    rx = spark.createDataFrame([("r", ["b1", "b2", "b3"])], "reaction string, genes array<string>")
    assert flux.reaction_levels(rx, lv).collect()[0]["level"] == 3.0


# ---- encoder


def test_encoder(spark):
    markers = spark.createDataFrame([("S", "relA", 1), ("S", "recA", 0), ("T", "recA", 1)], "strain string, feature string, present int")
    comps = spark.createDataFrame([("M", "NaCl", 1, 5.0), ("N", "NaCl", 1, None), ("N", "Agar", 0, 0.0)], "medium_id string, component string, present int, amount double")
    c = spark.createDataFrame([("S.M.heat;cold.b1(KO)",), ("T.N.none.none",), ("X.Q.heat.b1(KO);b2(OE)",), ("Y.Q.heat.b2(OE);b1(KO)",)], "condition_key string")
    for kind, width in (("present", 2), ("amount", 2), ("both", 4)):
        e = encode.ConditionEncoder(kind).fit(markers, comps, c)
        assert e.widths() == {"strain": 2, "medium": width, "stress": 2, "perturbation": 2}
        got = {r["condition_key"]: r["features"] for r in e.transform(c).collect()}
        medium = {"present": [0.0, 1.0], "amount": [0.0, 5.0], "both": [0.0, 1.0, 0.0, 5.0]}[kind]
        assert got["S.M.heat;cold.b1(KO)"] == [0.0, 1.0, *medium, 1.0, 1.0, 1.0, 0.0]
        assert got["X.Q.heat.b1(KO);b2(OE)"] == [0.0] * (2 + width) + [0.0, 1.0, 1.0, 1.0]
    assert got["T.N.none.none"] == [1.0, 0.0, 0.0, 1.0, 0.0, 5.0, 0.0, 0.0, 0.0, 0.0]  # the missing amount is the median
    assert [r["keys"] for r in encode.collisions(e.transform(c)).collect()] == [["X.Q.heat.b1(KO);b2(OE)", "Y.Q.heat.b2(OE);b1(KO)"]]
    rows = [(r["condition_key"], r["n"]) for r in encode.collision_rows(e.transform(c)).collect()]
    assert sorted(rows) == [("X.Q.heat.b1(KO);b2(OE)", 2), ("Y.Q.heat.b2(OE);b1(KO)", 2)]


def test_strain_markers_reach_the_keys(spark):
    markers = spark.createDataFrame([("SR00000001", "reca", 1), ("SR-00000001", "rela", 1), ("sr00000002", "reca", 0), ("SR00000003", "laci", 1), (None, "x", 1)], "strain string, feature string, present int")
    strains = spark.createDataFrame([("SR00000001", "FGK-1589", None), ("SR00000002", "other", "our stock; rz5000"), ("SR00000003", "RZ 5000", "")], "accession string, name string, alternate_names string")
    c = spark.createDataFrame([("FGK1589.M.none.none",), ("RZ5000.M.none.none",), ("X.M.none.none",), ("Y.M.none.none",)], "condition_key string")
    comps = spark.createDataFrame([("M", "NaCl", 1, 5.0)], "medium_id string, component string, present int, amount double")
    e = encode.ConditionEncoder().fit(encode.strain_markers(markers, strains, c), comps, c)
    assert e.features == ["laci", "reca", "rela"]
    got = {r["condition_key"][0]: r["features"][:3] for r in e.transform(c).collect()}
    assert got == {"F": [0.0, 1.0, 1.0], "R": [1.0, 0.0, 0.0], "X": [0.0] * 3, "Y": [0.0] * 3}
    assert {(r["condition_key"][0], r["n"]) for r in encode.collision_rows(e.transform(c)).collect()} == {("X", 2), ("Y", 2)}


def test_encoder_queries_have_strain_markers(spark):
    """Conditions that differ only by strain: the vectors of the query differ where the strains' markers do."""
    from polyomics.plans import pipeline

    d = "/root/testdata/sf0.01"
    first = {r[0] for r in pipeline._encoded(spark, d).select(F.aggregate(F.slice("features", 1, 20), F.lit(0.0), lambda a, x: a + x)).collect()}
    assert max(first) > 0


# ---- sources


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_wide_text(spark, tmp_path):
    p, axis = files.wide_text(spark, put(tmp_path / "t.tsv", "ID\tCond\tm.b1\tm.b2\nT1\tS.M.None.na_WT\t1.5\tNA\nT2\tS.M.heat.b1_KO\t\t2\n"))
    assert [tuple(r) for r in p.orderBy("source_id").collect()] == [("T1", "S", "M", "none", "none", [1.5, None]), ("T2", "S", "M", "heat", "b1(KO)", [None, 2.0])]
    assert [tuple(r) for r in axis.orderBy("idx").collect()] == [(0, "b1"), (1, "b2")]
    q, _ = files.wide_text(spark, put(tmp_path / "p.csv", "Strain,MediumID,Medium,Stress,GP,m.x\nS,M,long name,na,WT_na,nan\n"), ",")
    assert [tuple(r) for r in q.collect()] == [(None, "S", "M", "none", "none", [None])]
    with pytest.raises(Exception, match="four dotted parts"):
        files.wide_text(spark, put(tmp_path / "bad.tsv", "ID\tCond\tm.b1\nT1\tS.M\t1\n"))[0].collect()


def test_records(spark, tmp_path):
    r = files.json_records(spark, put(tmp_path / "a.json", '[{"k": "no", "_id": "1", "k": "relA1"}, {"k": "none", "k": "no"}, {"k": "x", "k": "x", "z": null}]'))
    assert {(x["record"], x["key"]): x["value"] for x in files.merged_fields(r).collect()} == {(0, "k"): "relA1", (1, "k"): "none", (2, "k"): "x", (2, "z"): None}
    with pytest.raises(Exception, match="conflicting"):
        files.merged_fields(files.json_records(spark, put(tmp_path / "b.json", '[{"k": "a", "k": "b"}]'))).collect()
    for wrapped in ('{"rows": [{"a": 1}]}', '{"other": [{"a": 1}]}'):
        assert files.json_records(spark, put(tmp_path / f"{len(wrapped)}.json", wrapped)).collect()[0]["fields"] == {"a": "1"}
    for bad in ("[[1, 2]]", "[]"):
        with pytest.raises(Exception, match="records"):
            files.json_records(spark, put(tmp_path / f"{len(bad)}bad.json", bad)).collect()
    pages = spark.createDataFrame([('<script>var t = [{"a": "1"},\n{"a": "2"}] ;</script>',)], "html string")
    assert [x["fields"]["a"] for x in files.embedded_records(pages).orderBy("record").collect()] == ["1", "2"]
    with pytest.raises(Exception, match="no embedded"):
        files.embedded_records(spark.createDataFrame([("<p>",)], "html string")).collect()
    f = files.json_records(spark, put(tmp_path / "f.json", '[{"Strain": "S", "MediumID": "M", "Stress": null, "GP": "WT", "R1": 2.5, "R02": null, "RX": 1, "LT": "1", "GR": "NA"}]'))
    assert [tuple(x) for x in files.fluxes(f).collect()] == [(0, "R1", 2.5)]
    assert tuple(files.phenotypes(f).collect()[0]) == (0, "S", "M", "none", "none", 1.0, None, None)


def test_arrays_and_counts(spark, tmp_path):
    cel = "[CEL]\nVersion=3\n\n[HEADER]\nCols=2\nRows=2\nDatHeader=x Ecoli.1sq y\n\n[INTENSITY]\nNumberCells=3\nCellHeader=X\tY\tMEAN\tSTDV\tNPIXELS\n0\t0\t10.5\t1.0\t9\n1\t0\t20\t2\t9\n0\t1\t30\t3\t9\n\n[MASKS]\nNumberCells=1\n5\t5\t1\n"
    (tmp_path / "cel").mkdir()
    put(tmp_path / "cel" / "GSM1.CEL", cel.replace("\n", "\r\n"))
    got = [tuple(r) for r in files.cel(spark, str(tmp_path / "cel")).orderBy("idx").collect()]
    assert got == [("GSM1", 0, 10.5, 1.0, 9.0), ("GSM1", 1, 20.0, 2.0, 9.0), ("GSM1", 2, 30.0, 3.0, 9.0)]
    with pytest.raises(Exception, match="not an ASCII array"):
        files.cel(spark, put(tmp_path / "v4.cel", "binary")).collect()
    assert [tuple(r) for r in files.cdf(spark, put(tmp_path / "l.tsv", "probeset\ttype\tindex\tx\ty\np\tpm\t3\t0\t1\np\tmm\t4\t1\t1\n")).collect()] == [("p", 2)]
    (tmp_path / "ht").mkdir()
    put(tmp_path / "ht" / "GSM2_a.htcount.txt", "b1\t5\nb2\t0\nbad line\n__no_feature\t7\nb3\tx\n")
    put(tmp_path / "ht" / "GSM3_b.htcount.txt", "b1\t1.0\nb4\t2\n")
    counts, summary = files.htseq(spark, str(tmp_path / "ht"))
    assert sorted(tuple(r) for r in counts.collect()) == [("GSM2_a", "b1", 5), ("GSM2_a", "b2", 0), ("GSM3_b", "b1", 1), ("GSM3_b", "b4", 2)] and [tuple(r) for r in summary.collect()] == [("GSM2_a", "__no_feature", 7)]
    assert {r["gene"] for r in files.common_genes(counts).collect()} == {"b1"}


def test_sheets_models_and_checks(spark, tmp_path):
    g = put(tmp_path / "genes.tsv", "eco:b0001\tCDS\t1..2\tthrL, leader; x\neco:b0002\tCDS\t3\tthrA,thrL; y\neco:bad\tCDS\t3\tzzz; y\nshort\n")
    assert {r["symbol"]: r["locus"] for r in files.symbol_map(spark, g).collect()} == {"thrl": "b0001", "leader": "b0001", "thra": "b0002"}
    e = files.edge_sheet(spark, put(tmp_path / "e.tsv", "Regulator\tTarget\nb1\tb2\n\tb3\nb2\tb1\n"), headers=("regulator",))
    assert e.count() == 2
    b = files.medium_bounds(spark, put(tmp_path / "b.tsv", "1\tn\tM1\tx\tEX_a, EX_b\t-1,-2\n2\tn\tM2\tx\tEX_a\t1,2\n"))
    assert sorted(tuple(r) for r in b.collect()) == [("M1", "EX_a", -1.0), ("M1", "EX_b", -2.0)]
    p = files.growth_phases(spark, put(tmp_path / "g.tsv", "ID\tGrowth Phase\nT1\tMid-exponential\nT2\tstationary\nT3\t\n"))
    assert {r["source_id"]: r["exponential"] for r in p.collect()} == {"T1": True, "T2": False, "T3": False}
    z = files.enzyme_sheet(spark, put(tmp_path / "z.tsv", "Met\tEnz\nC1\tb1, b2 b1\n"), "Met", "Enz")
    assert z.count() == 2
    model = {"reactions": [{"id": "BIOMASS_x", "metabolites": {"a": -1.0}, "gene_reaction_rule": ""}, {"id": "R", "metabolites": {"a": 1.0}, "lower_bound": 0.0, "gene_reaction_rule": "(b1 and b2) or b1"}]}
    s, r = files.metabolic_model(spark, put(tmp_path / "m.json", json.dumps(model)))
    got = {x["reaction"]: x for x in r.collect()}
    assert s.count() == 2 and got["R"]["genes"] == ["b1", "b2"] and (got["R"]["lb"], got["R"]["ub"]) == (0.0, 1000.0) and got["BIOMASS_x"]["objective"] == 1.0 and got["R"]["objective"] == 0.0
    put(tmp_path / "art.bin", "content")
    side = spark.createDataFrame([("art.bin", 7, hashlib.sha256(b"content").hexdigest()), ("gone.bin", 1, "x")], "name string, bytes bigint, sha256 string")
    assert {x["name"]: x["ok"] for x in files.verified(spark, str(tmp_path / "art.bin"), side).collect()} == {"art.bin": True, "gone.bin": False}


# ---- compendium and reports


def deliveries(spark):
    t = "2020-01-0"
    return {
        "strain": spark.createDataFrame([("S1", "n", None, None, None, t + "1"), ("S1", "newer", None, None, None, t + "2")], "accession string, name string, link string, pmid string, alternate_names string, loaded_at string"),
        "strain_feature": spark.createDataFrame([("S1", "relA", "relA1", t + "1"), ("S1", "recA", "no", t + "1")], "strain string, feature string, value string, loaded_at string"),
        "medium": spark.createDataFrame([("M1", "LB", "with NaCl", None, None, 1, t + "1")], "medium_id string, base_medium string, description string, link string, pmid string, defined int, loaded_at string"),
        "medium_component": spark.createDataFrame([("M1", "NaCl", "?", t + "1"), ("M1", "Agar", "5%", t + "1"), ("M1", "MOPS", "?", t + "1")], "medium_id string, component string, raw string, loaded_at string"),
        "layer_matrix": spark.createDataFrame(
            [(1, "transcriptome", "r1", "S1.M1.none.none", [1.0, None], t), (2, "phenome", "r2", "S1.M1.heat;cold.b2(OE);b1(KO)", [0.5, 0.7, 1.0], t), (3, "fluxome", "r3", "S1.M9.heat.none", [2.0], t), (4, "phenome", "r4", "S1.M1.heat;cold.b2(OE);b1(KO)", [0.5, 0.9, 1.0], t)],
            "profile_id bigint, layer string, run_id string, condition_key string, cell_values array<double>, loaded_at string",
        ),
        "layer_axis": spark.createDataFrame([("transcriptome", 0, "b1"), ("transcriptome", 1, "b2"), ("phenome", 0, "final_od"), ("phenome", 1, "growth_rate"), ("phenome", 2, "lag_time"), ("fluxome", 0, "R1")], "layer string, idx bigint, molecule_id string"),
    }


def test_catalog(spark, tmp_path):
    built = catalog.build(deliveries(spark))
    assert set(built) == set(catalog.TABLES)
    catalog.write(built, str(tmp_path / "c"))
    t = catalog.read(spark, str(tmp_path / "c"))
    assert t["strain"].collect()[0]["name"] == "newer"
    assert {r["component"]: r["present"] for r in t["medium_component"].collect()} == {"NaCl": 1, "Agar": 1, "MOPS": 0}
    catalog.register(t, "t_")
    assert {tuple(r) for r in spark.sql("SELECT layer, n_profiles, n_conditions FROM t_layer_summary").collect()} == {("transcriptome", 1, 1), ("phenome", 2, 1), ("fluxome", 1, 1)}
    assert spark.sql("SELECT count(*) FROM t_condition_layers WHERE has_phenome = 1 AND has_fluxome = 0").collect()[0][0] == 1
    assert spark.sql("SELECT c.condition_key FROM t_condition_perturbation p JOIN t_condition c USING (condition_key) WHERE perturbation_id = 'b1(KO)'").count() == 1
    assert {r["stress"]: r["n_profiles"] for r in t["stress"].collect()} == {"heat": 3, "cold": 2}
    assert {r["rule"]: r["violations"] for r in catalog.integrity(t).collect()}["a condition's medium exists"] == 1
    assert [tuple(r) for r in catalog.growth_rates(t).collect()] == [("S1.M1.heat;cold.b2(OE);b1(KO)", 0.9)]
    assert {r[0] for r in catalog.perturbations(t, "S1.M1.heat;cold.b2(OE);b1(KO)").collect()} == {"b1(KO)", "b2(OE)"}
    with pytest.raises(KeyError, match="nowhere"):
        catalog.perturbations(t, "nowhere")
    catalog.save_json(t["stress"].orderBy("stress"), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())[0] == {"n_profiles": 2, "stress": "cold"}
    lone = catalog.condition_layers({**t, "profile": t["profile"].where("false")})
    assert {r["has_phenome"] for r in lone.collect()} == {None}


def test_reports(spark):
    m = spark.createDataFrame([("x", "molecule", 0.5, 0.1, 14), ("x", "profile", 0.5, 0.1, 14)], "predictor string, axis string, mean double, sd double, n_conditions bigint")
    f = report.formatted(m)
    assert {r["axis"]: r["text"] for r in f.collect()} == {"molecule": "n/a (14 cond)", "profile": "0.5000 ± 0.1000"}
    assert report.markdown(f.where("axis = 'profile'"), ["predictor", "text"]) == "| predictor | text |\n| --- | --- |\n| x | 0.5000 ± 0.1000 |"
    c = report.claims(spark.createDataFrame([("a", 1.0)], "name string, actual double"), spark.createDataFrame([("a", 1.05, 0.1), ("b", 1.0, 0.1)], "name string, expected double, tolerance double"))
    assert {r["name"]: r["holds"] for r in c.collect()} == {"a": True, "b": False}
    v = spark.createDataFrame([(None,), (0.1,), (0.5,), (0.9,)], "x double").select(report.verdict(F.col("x"), F.lit(0.3), F.lit(0.7)))
    assert [r[0] for r in v.collect()] == [None, "below", "within", "above"]


def test_more_of_the_models(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 3))
    feats = spark.createDataFrame([(f"c{i}", f"g{j}", float(x[i, j])) for i in range(20) for j in range(3)], "condition_key string, molecule_id string, value double")
    y = spark.createDataFrame([(f"c{i}", "t", float(3 * x[i, 1])) for i in range(20)], "condition_key string, molecule_id string, value double")
    targets = spark.createDataFrame([("t",), ("u",)], "target string")
    edges = models.metabolite_edges(targets, feats, spark.createDataFrame([("t", "g1"), ("t", "gone"), ("x", "g2")], "metabolite string, enzyme string"), "enzymes")
    assert {(r["target"], r["feature"]) for r in edges.collect()} == {("t", "g1"), ("u", "g0"), ("u", "g1"), ("u", "g2")}
    every = models.metabolite_edges(targets, feats, None, "all")
    c = {r["feature"]: r["coefficient"] for r in models.coefficients(feats, y, every, 0.01).collect()}
    assert max(c, key=lambda k: abs(c[k])) == "g1" and c["g1"] > 0
    kind = "profile_id int, condition_key string, molecule_id string, value double"
    long = spark.createDataFrame([(1, "S.M.none.none", "b", 1.0), (2, "S.M.x.b1(KO)", "b", 3.0), (3, "T.M.x.b1(KO)", "b", 8.0), (4, "T.M.x.b1(KO)", "b", 8.0)], kind)
    keys = spark.createDataFrame([("S.M.x.b1(KO)",), ("Q.Q.Q.Q",)], "condition_key string")
    media = spark.createDataFrame([("M", "LB", None)], "medium_id string, base_medium string, description string")
    for strategy, where, v, other in (("non_specific", media, 1.0, 1.0), ("non_specific", None, 8.0, 8.0), ("non_specific", media.limit(0), 8.0, 8.0), ("specific", None, 2.0, 5.0), ("same_batch", None, 3.0, 5.0)):
        got = {r["condition_key"]: r["value"] for r in models.starting_profiles(long, keys, strategy, "S", where).collect()}
        assert got == {"S.M.x.b1(KO)": v, "Q.Q.Q.Q": other}, strategy


def test_lasso_path_is_optimal():
    """The conditions of the optimum hold, also with features that are alike or constant."""
    rng = np.random.default_rng(0)
    for k in range(40):
        x = rng.normal(size=(rng.integers(5, 60), rng.integers(3, 40)))
        y = x[:, 0] + rng.normal(size=len(x))
        if k % 5 == 0:
            x[:, 1] = x[:, 0]
        if k % 7 == 0:
            x[:, -1] = 3.0
        alpha = 10 ** rng.uniform(-3, 0)
        b, _, ok = models.lasso(x, y, alpha)
        z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        r = z.T @ (y - y.mean() - z @ b) / len(y)
        assert ok and (np.abs(r) <= alpha + 1e-8).all() and np.allclose(r[b != 0], alpha * np.sign(b[b != 0]), atol=1e-8)


def test_folds_by_label(spark):
    keys = spark.createDataFrame([(f"s{i % 4}.m{i % 7}.none.none",) for i in range(28)] + [(None,)], "condition_key string")
    medium = lambda c: F.split_part(c, F.lit("."), F.lit(2))
    for n in (None, 3, 7):
        f = {r["condition_key"]: r["fold"] for r in cv.folds(keys, n, label=medium).collect()}
        groups = {}
        for key, fold in f.items():
            groups.setdefault(key.split(".")[1], set()).add(fold)
        assert len(f) == 28 and all(len(v) == 1 for v in groups.values()) and {min(v) for v in groups.values()} == set(range(n or 7))


def test_predictions_are_kept(spark, tmp_path):
    from polyomics import catalog

    kind = "profile_id int, condition_key string, molecule_id string, value double"
    long = spark.createDataFrame([(i, f"s.m.none.{'none' if i % 2 else 'b1(KO)'}", "g", float(i)) for i in range(6)], kind)
    fold = spark.createDataFrame([("s.m.none.none", 0), ("s.m.none.b1(KO)", 1)], "condition_key string, fold bigint")
    p = cv.out_of_fold_baselines(long, fold)
    assert cv.out_of_fold_baselines(long, fold, 4).count() == 0
    catalog.save_predictions(p, f"{tmp_path}/p")
    catalog.save_predictions(p.where("predictor = 'mean'"), f"{tmp_path}/p")
    back = catalog.saved_predictions(spark, f"{tmp_path}/p")
    assert back.count() == 12 and catalog.saved_predictions(spark, f"{tmp_path}/p", ["mean"]).count() == 6
    assert {(r["predictor"], r["fold"], r["y_hat"]) for r in back.collect()} == {("mean", 0, 2.0), ("mean", 1, 3.0), ("wild_type", 0, 2.0), ("wild_type", 1, 3.0)}
