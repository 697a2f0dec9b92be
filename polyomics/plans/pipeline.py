"""Queries of the iterative operators and of the compendium over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyomics import catalog
from polyomics.functions import canon, parse
from polyomics.operators import cv, encode, flux, impute, matrix, models, normalize, pairs, stats
from polyomics.plans import bindings as b
from polyomics.plans import problems
from polyomics.plans.core import _R, NO_STRESS, STRIP, amount_sql, canonical_sql, r6
from polyomics.plans.registry import table
from polyomics.session import materialize

QUERIES = {}
SQL: dict[str, str] = {}


def query(f=None, *, sql: str | None = None):
    def add(g):
        QUERIES[g.__name__] = g
        if sql:
            SQL[g.__name__] = sql
        return g

    return add(f) if f else add


def _long(spark: SparkSession, d: str, layer: str) -> DataFrame:
    return matrix.to_long(b.matrix(spark, d, layer), b.axis(spark, d, layer))


#: The profiles of layer_matrix in SQL: m (profile_id, layer, run_id, condition_key, key, v), key being the full key or that of the run, v
#: null where there is no reading; and long rows over the axis.
_M = f"""d AS (SELECT DISTINCT ON (profile_id) profile_id, layer, run_id, condition_key, cell_values FROM layer_matrix ORDER BY profile_id, loaded_at),
w AS (SELECT *, CASE WHEN len(string_split(condition_key, '.')) = 4 AND len(list_filter(string_split(condition_key, '.'), lambda p: lower(trim(p)) IN ({problems.UNKNOWN}))) = 0
THEN array_to_string(list_transform(string_split(condition_key, '.'), lambda p: trim(p)), '.') END AS own, list_transform(cell_values, lambda x: CASE WHEN isfinite(x) AND x NOT IN ({problems.MISSING}) THEN x END) AS r FROM d),
modes AS (SELECT DISTINCT ON (layer, run_id) layer, run_id, own AS mode FROM (SELECT layer, run_id, own, count(*) AS n FROM w WHERE own IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL) ORDER BY layer, run_id, n DESC, own),
m AS (SELECT profile_id, layer, w.run_id, condition_key, coalesce(own, mode) AS key, CASE WHEN len(list_filter(r, lambda x: x <> 0)) > 0 THEN r END AS v, cell_values IS NOT NULL AS given FROM w LEFT JOIN modes USING (layer, run_id)),
long AS (SELECT profile_id, layer, condition_key, key, molecule_id, v[idx + 1] AS value FROM m JOIN layer_axis USING (layer) WHERE v[idx + 1] IS NOT NULL)"""


# ---- normalisation


@query
def gmm_denoise(spark: SparkSession, d: str) -> DataFrame:
    """Noise removal over the transcriptome profiles."""
    long = _long(spark, d, "transcriptome")
    return normalize.denoise(long, normalize.noise_fits(long)).select("profile_id", "molecule_id", r6("value").alias("value"), "was_negative")


@query
def noise_fits(spark: SparkSession, d: str) -> DataFrame:
    return normalize.noise_fits(_long(spark, d, "transcriptome"))


@query
def median_polish(spark: SparkSession, d: str) -> DataFrame:
    """Every four neighbouring molecules of the proteome taken as the probes of a set."""
    m = matrix.to_long(b.matrix(spark, d, "proteome"))
    p = m.select("profile_id", F.col("molecule_id").alias("probe"), F.floor(F.col("molecule_id") / 4).alias("probeset"), "value")
    return normalize.median_polish(p).select("probeset", "profile_id", r6("value").alias("value"))


@query
def rma(spark: SparkSession, d: str) -> DataFrame:
    """The embedding vectors, shifted to intensities, as arrays of 64 cells; sets of four."""
    e = b.cells(spark, d).withColumn("value", F.pow(F.lit(2.0), 7 + 2 * F.col("value")))
    layout = e.select("molecule_id", F.floor(F.col("molecule_id") / 4).alias("probeset")).distinct()
    return normalize.rma(e.select("profile_id", "molecule_id", "value"), layout).select("probeset", "profile_id", r6("value").alias("value"))


@query(sql=f"""WITH {b.CELLS}, s AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY value) AS g FROM e), t AS (SELECT condition_key, g, avg(value) AS x FROM s GROUP BY 1, 2),
p AS (SELECT condition_key, profile_id, molecule_id, value AS x, t.x AS y FROM s JOIN t USING (condition_key, g)), d AS (SELECT a.profile_id, a.molecule_id, a.x AS x0, z.x, z.y, abs(z.x - a.x) AS dd,
row_number() OVER (PARTITION BY a.profile_id, a.molecule_id ORDER BY abs(z.x - a.x), z.x) AS o, greatest(3, ceil(0.35 * count(*) OVER (PARTITION BY a.profile_id, a.molecule_id))) AS k FROM p a JOIN p z USING (profile_id)),
w AS (SELECT *, pow(1 - pow(dd / h, 3), 3) AS w FROM (SELECT *, max(dd) OVER (PARTITION BY profile_id, molecule_id) AS h FROM d WHERE o <= k)),
c AS (SELECT profile_id, molecule_id, max(x0) AS x0, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY 1, 2),
v AS (SELECT profile_id, molecule_id, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy FROM w JOIN c USING (profile_id, molecule_id) GROUP BY 1, 2),
l AS (SELECT condition_key AS platform, profile_id, molecule_id, my + CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0 END * (c.x0 - mx) AS value FROM c JOIN v USING (profile_id, molecule_id) JOIN p USING (profile_id, molecule_id))
SELECT platform, profile_id, molecule_id, round((value - avg(value) OVER q) / (stddev_pop(value) OVER q + 1e-9), 5) AS value FROM l WINDOW q AS (PARTITION BY platform)""")
def platform_correction(spark: SparkSession, d: str) -> DataFrame:
    e = b.cells(spark, d).select(F.col("condition_key").alias("platform"), "profile_id", "molecule_id", "value")
    return normalize.correct_platform_bias(e).select("platform", "profile_id", "molecule_id", F.round("value", 5).alias("value"))


@query
def absolute_scale(spark: SparkSession, d: str) -> DataFrame:
    """Proteome profiles on the scale of a reference of half the molecules, made from their mean levels."""
    long = _long(spark, d, "proteome")
    ref = long.groupBy("molecule_id").agg(F.avg("value").alias("m")).where("abs(hash(molecule_id)) % 2 = 0").select("molecule_id", F.pow(F.lit(10.0), F.col("m") / 4).alias("copies"))
    return normalize.absolute(long, ref).select("profile_id", "molecule_id", r6("value").alias("value"), "extrapolated")


@query(sql=f"""WITH {_M}, t AS (SELECT * FROM long WHERE layer = 'transcriptome'), r AS (SELECT profile_id, min(value) AS lo, max(value) AS hi FROM t GROUP BY 1),
g AS (SELECT molecule_id, avg((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END) AS x FROM t JOIN r USING (profile_id) GROUP BY 1),
h AS (SELECT x, idx % 3 AS life FROM g JOIN layer_axis a ON a.molecule_id = g.molecule_id AND a.layer = 'transcriptome' WHERE idx % 3 < 2),
o AS (SELECT life, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS k FROM h), s AS (SELECT sum((life = 0)::INT)::BIGINT AS n1, sum((life = 1)::INT)::BIGINT AS n2, sum(CASE WHEN life = 0 THEN k END) AS r1 FROM o)
SELECT n1, n2, round((r1 - n1 * (n1 + n2 + 1) / 2.0) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12.0), 6) AS z FROM s""")
def half_life_control(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d, "transcriptome")
    groups = b.axis(spark, d, "transcriptome").select("molecule_id", F.when(F.col("idx") % 3 == 0, "short").when(F.col("idx") % 3 == 1, "long").alias("life")).where("life is not null")
    return normalize.half_life_control(long, groups).select("n1", "n2", r6("z").alias("z"))


@query(sql=f"""WITH {_M}, o AS (SELECT profile_id, idx, v[idx + 1] AS value, v[idx + 1] IS NOT NULL AS seen FROM m JOIN layer_axis USING (layer) WHERE layer = 'metabolome' AND given), s AS (SELECT * FROM o WHERE seen),
dist AS (SELECT a.idx AS i, z.idx AS j, sqrt(avg((a.value - z.value) ** 2)) AS dd FROM s a JOIN s z ON a.profile_id = z.profile_id AND a.idx <> z.idx GROUP BY 1, 2),
cand AS (SELECT DISTINCT g.idx AS i, s.idx AS j FROM o g JOIN s ON s.profile_id = g.profile_id WHERE NOT g.seen), near AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dd, j) AS k FROM dist JOIN cand USING (i, j)) WHERE k <= 3),
own AS (SELECT idx, avg(value) AS own FROM s GROUP BY 1), fill AS (SELECT g.profile_id, g.idx, avg(s.value) AS f FROM o g JOIN near ON near.i = g.idx JOIN s ON s.profile_id = g.profile_id AND s.idx = near.j WHERE NOT g.seen GROUP BY 1, 2)
SELECT profile_id, idx, round(CASE WHEN seen THEN value ELSE coalesce(f, own, 0) END, 6) AS value, CAST(NOT seen AS INT) AS imputed FROM o LEFT JOIN fill USING (profile_id, idx) LEFT JOIN own USING (idx)""")
def layer_knn_impute(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the metabolome profiles from the three nearest metabolites."""
    v = b.matrix(spark, d, "metabolome").where("values is not null")
    return pairs.knn_impute(v).select("profile_id", "idx", r6("value").alias("value"), "imputed")


# ---- models


@query
def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    v = b.vectors(spark, d)
    return cv.random_baseline(v, cv.folds(v, None)).select("fold", "idx", r6("y_hat").alias("y_hat"))


def _means(spark: SparkSession, d: str, layer: str) -> DataFrame:
    """Condition means of a layer over the filled keys."""
    p = impute.fill_keys(table(spark, d, "layer_matrix").where(F.col("layer") == layer)).where("condition_key is not null").dropDuplicates(["profile_id"])
    return matrix.average_by_condition(matrix.to_long(p.select("profile_id", "condition_key", "values"), b.axis(spark, d, layer)))


def _parts(spark: SparkSession, d: str, n: int) -> list[DataFrame]:
    """The condition means of the transcriptome in ``n`` parts by the place of the molecule, as layers that share all conditions; no two
    delivered layers share more than a few."""
    m = materialize(_means(spark, d, "transcriptome").join(F.broadcast(b.axis(spark, d, "transcriptome")), "molecule_id"), "means")
    return [m.where(F.col("idx") % n == k).select("condition_key", "molecule_id", "value") for k in range(n)]


@query
def lasso_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every transcript in an odd place from those in even places it is correlated with; five folds, the penalty by cross-validation; a
    second arm has those correlated by less."""
    x, y = _parts(spark, d, 2)
    pair = x.select("condition_key", F.col("molecule_id").alias("feature"), F.col("value").alias("u")).join(y.select("condition_key", F.col("molecule_id").alias("target"), F.col("value").alias("v")), "condition_key")
    near = pair.groupBy("target", "feature").agg(stats.pearson("u", "v").alias("r")).where("r is not null")
    arms = near.where("abs(r) > 0.2").select(F.lit("cpn").alias("arm"), "target", "feature").unionByName(near.where("abs(r) <= 0.2").select(F.lit("far_LEAKY").alias("arm"), "target", "feature"))
    p = models.neighbour_lasso(x, y, arms, cv.folds(x, 5))
    return p.select("arm", "fold", "condition_key", "target", r6("y").alias("y"), F.round("y_hat", 4).alias("y_hat"), "error")


@query
def network_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The mean over the honest arm, and with the leaky one, from the neighbour LASSO."""
    p = lasso_neighbours(spark, d).select("arm", "fold", F.col("condition_key"), F.col("condition_key").alias("profile_id"), F.col("target").alias("molecule_id"), "y", "y_hat")
    m = stats.ablation(p, {"honest": ["cpn"], "with_leak": ["cpn", "far_LEAKY"]}, ["profile_id", "condition_key", "molecule_id"])
    return m.select("variant", "axis", *[F.round(c, 3).alias(c) for c in ("mean", "sd", "rmse")], "n", "n_conditions", "shown")


@query
def phenome_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The first transcript of the axis, standing for growth, from three layers of all the others, weighted by an inner split; five folds."""
    first = b.axis(spark, d, "transcriptome").where("idx = 0").select("molecule_id")
    parts = _parts(spark, d, 3)
    y = parts[0].join(F.broadcast(first), "molecule_id", "left_semi").select("condition_key", F.col("value").alias("y"))

    def layer(name: str, m: DataFrame) -> DataFrame:
        m = m.join(F.broadcast(first), "molecule_id", "left_anti")
        overall = m.groupBy("molecule_id").agg(F.avg("value").alias("overall"))
        grid = m.select("condition_key").distinct().crossJoin(F.broadcast(overall))  # by the axis; a gap is the molecule's mean
        cell = F.struct("molecule_id", F.coalesce("value", "overall").alias("value"))
        v = grid.join(m, ["condition_key", "molecule_id"], "left").groupBy("condition_key").agg(F.array_sort(F.collect_list(cell)).alias("x"))
        return v.join(y, "condition_key").select(F.lit(name).alias("layer"), "condition_key", "y", F.transform("x", lambda e: e["value"]).alias("values"))

    three = [layer(n, m) for n, m in zip(("transcriptome", "proteome", "metabolome"), parts, strict=True)]
    p = models.consensus_weights(three[0].unionByName(three[1]).unionByName(three[2]), cv.folds(y, 5))
    found = p.where("y_hat is not null").groupBy("fold", "condition_key", "y").agg(F.try_divide(F.sum(F.col("weight") * F.col("y_hat")), F.sum("weight")).alias("y_hat"))
    return found.select("fold", "condition_key", r6("y").alias("y"), F.round("y_hat", 4).alias("y_hat"))


_STRICT = """lb AS (SELECT DISTINCT medium_id FROM medium WHERE regexp_matches(upper(trim(coalesce(base_medium, ''))), '^(LB|M9)') OR regexp_matches(upper(trim(coalesce(description, ''))), '^(LB|M9)')),
strict AS (SELECT * FROM t WHERE split_part(key, '.', 1) = 'Zebehorn86' AND split_part(key, '.', 2) IN (SELECT medium_id FROM lb) AND split_part(key, '.', 3) IN ('none', 'na', '') AND split_part(key, '.', 4) = 'none')"""


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    p = impute.fill_keys(table(spark, d, "layer_matrix").where("layer = 'transcriptome'")).where("condition_key is not null").dropDuplicates(["profile_id"])
    return matrix.to_long(p.select("profile_id", "condition_key", "values"), b.axis(spark, d, "transcriptome"))


@query(sql=f"""WITH r AS (SELECT * FROM condition_raw WHERE cond IS NULL), {canonical_sql('r')}, x AS (SELECT record_id, {STRIP.format("coalesce(strain, '')")} AS s, {STRIP.format("coalesce(medium_id, '')")} AS m, {STRIP.format("coalesce(stress, '')")} AS st, canonical FROM r JOIN k ON r.gp IS NOT DISTINCT FROM k.gp),
t AS (SELECT record_id, concat_ws('.', s, m, CASE WHEN lower(st) IN ({NO_STRESS}) THEN 'none' ELSE st END, canonical) AS key FROM x), {_STRICT} SELECT record_id, key AS condition_key FROM strict""")
def strict_wild_type(spark: SparkSession, d: str) -> DataFrame:
    """The delivered conditions of the commonest strain on LB or M9 without stress or perturbation."""
    r = table(spark, d, "condition_raw").where("cond is null")
    key = canon.make_key(F.col("strain"), F.col("medium_id"), F.col("stress"), F.col("gp"))
    return matrix.strict_wild_type(r.select("record_id", key.alias("condition_key")), "Zebehorn86", table(spark, d, "medium"))


@query(sql=f"""WITH {_M}, t AS (SELECT * FROM long WHERE layer = 'transcriptome' AND key IS NOT NULL), {_STRICT}, c AS (SELECT DISTINCT key FROM t), n AS (SELECT key, count(DISTINCT profile_id) AS n FROM t GROUP BY 1),
most AS (SELECT key FROM n ORDER BY n DESC, key LIMIT 1), base AS (SELECT * FROM strict UNION ALL SELECT * FROM t WHERE key = (SELECT key FROM most) AND NOT EXISTS (SELECT 1 FROM strict)),
s AS (SELECT 'non_specific' AS strategy, c.key, molecule_id, avg(value) AS v FROM c CROSS JOIN base GROUP BY ALL UNION ALL SELECT 'specific', c.key, molecule_id, avg(value) FROM c JOIN t ON split_part(c.key, '.', 1) = split_part(t.key, '.', 1) AND split_part(c.key, '.', 2) = split_part(t.key, '.', 2) GROUP BY ALL
UNION ALL SELECT 'same_batch', key, molecule_id, avg(value) FROM t GROUP BY ALL) SELECT strategy, key AS condition_key, molecule_id, round(v, 6) AS value FROM s""")
def starting_profiles(spark: SparkSession, d: str) -> DataFrame:
    """All three starting states of every transcriptome condition."""
    long = materialize(_transcripts(spark, d), "transcripts")
    each = [models.starting_profiles(long, long, s, "Zebehorn86", table(spark, d, "medium")).withColumn("strategy", F.lit(s)) for s in ("non_specific", "specific", "same_batch")]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("strategy", "condition_key", "molecule_id", r6("value").alias("value"))


@query
def metabolome_module(spark: SparkSession, d: str) -> DataFrame:
    """A third of the transcripts standing for metabolites, the others for proteins and transcripts; those in even places are core."""
    y, p, t = _parts(spark, d, 3)
    core = b.axis(spark, d, "transcriptome").where("idx % 2 = 0")
    out = models.metabolome_module(y, p, t, core, cv.folds(y, 5))
    return out.select("arm", "fold", "condition_key", "target", r6("y").alias("y"), F.round("y_hat", 4).alias("y_hat"), "error")


@query
def loco_own_feature(spark: SparkSession, d: str) -> DataFrame:
    """Each position of a vector from the next by least squares, against the baselines, every label held out in turn."""
    e = b.cells(spark, d)
    fold = e.select("condition_key", F.col("condition_key").alias("fold")).distinct()

    def fit_predict(long: DataFrame, fold: DataFrame) -> DataFrame:
        x = long.select("profile_id", "condition_key", F.pmod(F.col("molecule_id") - 1, F.lit(64)).alias("molecule_id"), F.col("value").alias("x"))
        xy = long.withColumnRenamed("value", "y").join(x, ["profile_id", "condition_key", "molecule_id"]).withColumnRenamed("molecule_id", "target")
        p = xy.join(fold, "condition_key").join(models.own_feature_ols(xy, fold), ["fold", "target"])
        return p.select("fold", "profile_id", "condition_key", F.col("target").alias("molecule_id"), "y", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y_hat"))

    m = cv.run_loco(fit_predict, e, fold)
    return m.select("predictor", "axis", *[r6(c).alias(c) for c in ("mean", "sd", "rmse", "slope", "z", "p")], "n", "n_conditions", "shown")


@query(sql=f"""WITH {b.CELLS}, x AS (SELECT profile_id, value AS x, lead(value) OVER (PARTITION BY profile_id ORDER BY molecule_id) AS y, molecule_id FROM e), p AS (SELECT * FROM x WHERE y IS NOT NULL),
n AS (SELECT profile_id, greatest(3, CAST(ceil(0.35 * count(*)) AS BIGINT)) AS k FROM p GROUP BY 1),
d AS (SELECT a.profile_id, a.molecule_id, a.x AS x0, z.x, z.y, abs(z.x - a.x) AS dd, row_number() OVER (PARTITION BY a.profile_id, a.molecule_id ORDER BY abs(z.x - a.x), z.x) AS o FROM p a JOIN p z USING (profile_id)),
w AS (SELECT *, pow(1 - pow(dd / h, 3), 3) AS w FROM (SELECT d.*, max(dd) OVER (PARTITION BY profile_id, molecule_id) AS h FROM d JOIN n USING (profile_id) WHERE o <= k)),
c AS (SELECT profile_id, molecule_id, max(x0) AS x0, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY 1, 2),
s AS (SELECT profile_id, molecule_id, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy FROM w JOIN c USING (profile_id, molecule_id) GROUP BY 1, 2)
SELECT profile_id, molecule_id, round(my + CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0 END * (c.x0 - mx), 5) AS value FROM c JOIN s USING (profile_id, molecule_id)""")
def loess_knn(spark: SparkSession, d: str) -> DataFrame:
    """Each position of a vector smoothed on the position before it."""
    v = b.vectors(spark, d)
    pairs_of = F.transform(F.sequence(F.lit(0), F.size("values") - 2), lambda i: F.struct(i.cast("bigint").alias("molecule_id"), F.get("values", i).alias("x"), F.get("values", i + 1).alias("y")))
    xy = v.select("profile_id", F.explode(pairs_of).alias("p")).select("profile_id", "p.*")
    return normalize.smooth(xy, ["profile_id"], "x", "y").select("profile_id", "molecule_id", F.round("value", 5).alias("value"))


@query(sql=f"""WITH {_M}, t AS (SELECT * FROM long WHERE layer = 'metabolome'), n AS (SELECT count(*) AS n FROM m WHERE layer = 'metabolome' AND v IS NOT NULL), g AS (SELECT molecule_id FROM t GROUP BY 1 HAVING count(*) >= 0.8 * (SELECT n FROM n)),
c AS (SELECT t.*, idx FROM t JOIN g USING (molecule_id) JOIN layer_axis a ON a.layer = 'metabolome' AND a.molecule_id = t.molecule_id), k AS (SELECT count(*) AS k FROM g), full_rows AS (SELECT profile_id FROM c GROUP BY 1 HAVING count(*) = (SELECT k FROM k)),
f AS (SELECT * FROM c WHERE profile_id IN (SELECT profile_id FROM full_rows)) SELECT a.idx AS i, z.idx AS j, round(least(1, greatest(-1, regr_sxy(a.value, z.value) / sqrt(regr_sxx(a.value, z.value) * regr_syy(a.value, z.value)))), 6) AS r
FROM f a JOIN f z ON a.profile_id = z.profile_id AND a.idx < z.idx GROUP BY 1, 2 HAVING count(*) >= 3 AND regr_sxy(a.value, z.value) / sqrt(regr_sxx(a.value, z.value) * regr_syy(a.value, z.value)) > 0.2""")
def coexpression_complete(spark: SparkSession, d: str) -> DataFrame:
    """Metabolites read in at least four fifths of the profiles, over the profiles that have all of them."""
    v = b.matrix(spark, d, "metabolome").where("values is not null and exists(values, x -> x is not null)").select("profile_id", "values")
    n = v.count()
    keep = [r[0] for r in v.select(F.posexplode("values").alias("i", "x")).where("x is not null").groupBy("i").count().where(F.col("count") >= 0.8 * n).orderBy("i").collect()]  # the axis
    w = v.select("profile_id", F.transform("values", lambda x, i: F.when(i.isin(keep), x)).alias("values"))
    full = w.where(F.size(F.filter("values", lambda x: x.isNotNull())) == len(keep))
    return pairs.coexpression(full, 0.2, complete=True).select("i", "j", r6("r").alias("r"))


@query(sql=f"WITH {b.CELLS} SELECT profile_id, 'g' || CAST(molecule_id // 4 AS VARCHAR) AS gene, round(avg(value), 6) AS value FROM e GROUP BY 1, 2")
def average_probes(spark: SparkSession, d: str) -> DataFrame:
    """Every four neighbouring positions taken as the probes of a gene."""
    e = b.cells(spark, d)
    genes = e.select("molecule_id").distinct().withColumn("gene", F.concat(F.lit("g"), F.floor(F.col("molecule_id") / 4).cast("string")))
    return matrix.average_probes(e, genes).select("profile_id", "gene", r6("value").alias("value"))


@query(sql=f"WITH {b.LAYERS} SELECT condition_key, profile_id, row_number() OVER (PARTITION BY condition_key ORDER BY profile_id) - 1 AS place FROM l WHERE condition_key IS NOT NULL")
def condition_index(spark: SparkSession, d: str) -> DataFrame:
    return matrix.condition_index(b.layers(spark, d))


@query(sql=f"""WITH {b.CELLS}, z AS (SELECT *, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9) AS z FROM e WINDOW w AS (PARTITION BY condition_key))
SELECT condition_key, count(*) AS n, round(corr(value, z), 6) AS pcc, round(sqrt(avg((value - z) ** 2)), 6) AS rmse, round(max(abs(value - z)), 6) AS max_diff FROM z GROUP BY 1""")
def normalisation_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Raw values against their z-scores, by platform."""
    e = b.cells(spark, d)
    a = stats.agreement(e, stats.platform_zscore(e, ["condition_key"]), ["condition_key", "profile_id", "molecule_id"], ["condition_key"])
    return a.select("condition_key", "n", *[r6(c).alias(c) for c in ("pcc", "rmse", "max_diff")])


@query(sql="SELECT accession, pmid FROM strain WHERE pmid IS NOT NULL AND lower(trim(pmid)) <> 'na'")
def identified_records(spark: SparkSession, d: str) -> DataFrame:
    """Strain records with a publication."""
    return flux.identified(table(spark, d, "strain"), "pmid").select("accession", "pmid")


@query(sql="""WITH s AS (SELECT DISTINCT molecule_id AS m FROM layer_axis), v AS (SELECT unnest(['EX_' || lower(m) || '-D(e)', 'EX_' || lower(m) || '(e)', m || '-L', m || '_R', m, 'EX_glc(e)', m || '__D']) AS id, unnest(['EX_' || lower(m) || '__D_e', 'EX_' || lower(m) || '_e', m || '__L', m || '__R', m, 'EX_glc__D_e', m || '__D']) AS modern FROM s)
SELECT DISTINCT id, modern FROM v""")
def modern_reaction_ids(spark: SparkSession, d: str) -> DataFrame:
    """The molecules of the axes in the old ways to write them."""
    m = F.col("molecule_id")
    ids = F.array(F.concat(F.lit("EX_"), F.lower(m), F.lit("-D(e)")), F.concat(F.lit("EX_"), F.lower(m), F.lit("(e)")), F.concat(m, F.lit("-L")), F.concat(m, F.lit("_R")), m, F.lit("EX_glc(e)"), F.concat(m, F.lit("__D")))
    return table(spark, d, "layer_axis").select(F.explode(ids).alias("id")).distinct().select("id", parse.modern_reaction_id(F.col("id")).alias("modern"))


@query(sql="SELECT gp, nullif(regexp_extract(gp, 'b[0-9]{4}'), '') AS locus FROM (SELECT DISTINCT gp FROM condition_raw)")
def loci(spark: SparkSession, d: str) -> DataFrame:
    """The first locus tag of every spelling of perturbations."""
    return table(spark, d, "condition_raw").select("gp").distinct().select("gp", parse.locus(F.col("gp")).alias("locus"))


# ---- fluxes


def _genes(spark: SparkSession, d: str) -> DataFrame:
    """reaction, genes: each reaction of the axis with the transcripts whose place leaves its own place when divided by their number."""
    a = table(spark, d, "layer_axis")
    r, g = a.where("layer = 'fluxome'").select("idx", F.col("molecule_id").alias("reaction")), a.where("layer = 'transcriptome'").select((F.col("idx") % 32).alias("idx"), F.col("molecule_id").alias("gene"))
    return r.join(g, "idx").groupBy("reaction").agg(F.array_sort(F.collect_list("gene")).alias("genes"))


def _gene_levels(spark: SparkSession, d: str) -> DataFrame:
    each = [_means(spark, d, n).select("condition_key", F.col("molecule_id").alias("gene"), F.lit(n).alias("layer"), "value") for n in ("transcriptome", "proteome")]
    return each[0].unionByName(each[1])


_LEVELS = f"""{_M}, gl AS (SELECT key AS condition_key, molecule_id AS gene, coalesce(avg(CASE WHEN layer = 'proteome' THEN value END), avg(CASE WHEN layer = 'transcriptome' THEN value END)) AS v
FROM long WHERE layer IN ('transcriptome', 'proteome') AND key IS NOT NULL GROUP BY 1, 2)"""
_RL = """rg AS (SELECT r.molecule_id AS reaction, t.molecule_id AS gene FROM layer_axis r JOIN layer_axis t ON r.layer = 'fluxome' AND t.layer = 'transcriptome' AND t.idx % 32 = r.idx),
rl AS (SELECT condition_key, reaction, avg(v) AS level FROM gl JOIN rg USING (gene) GROUP BY 1, 2)"""
_BOUNDS = """st AS (SELECT medium_id, 'R' || lpad(CAST(k AS VARCHAR), 4, '0') AS reaction, -min(amount) AS bound FROM medium_component JOIN (SELECT component, row_number() OVER (ORDER BY component) AS k FROM component_ref) USING (component) WHERE amount > 0 AND k <= 32 GROUP BY 1, 2),
fc AS (SELECT DISTINCT key AS condition_key, split_part(key, '.', 2) AS medium_id FROM m WHERE layer = 'fluxome' AND key IS NOT NULL),
mb AS (SELECT condition_key, f.molecule_id AS reaction, coalesce(bound, -10.0) AS lb, 1000.0 AS ub FROM fc CROSS JOIN (SELECT molecule_id FROM layer_axis WHERE layer = 'fluxome') f LEFT JOIN st ON st.medium_id = fc.medium_id AND st.reaction = f.molecule_id)"""


@query(sql=f"WITH {_LEVELS}, {_RL} SELECT condition_key, reaction, round(level, 6) AS level FROM rl")
def reaction_levels(spark: SparkSession, d: str) -> DataFrame:
    return flux.reaction_levels(_genes(spark, d), _gene_levels(spark, d)).select("condition_key", "reaction", r6("level").alias("level"))


def _medium_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Uptake of at most 10, or of the smallest amount of the component of the same number in the medium."""
    reactions = b.axis(spark, d, "fluxome").select(F.col("molecule_id").alias("reaction"), F.lit(-10.0).alias("lb"), F.lit(1000.0).alias("ub"))
    p = impute.fill_keys(table(spark, d, "layer_matrix").where("layer = 'fluxome'")).where("condition_key is not null")
    conditions = p.select("condition_key", F.split_part("condition_key", F.lit("."), F.lit(2)).alias("medium_id")).distinct()
    place = Window.partitionBy(F.lit(0)).orderBy("component")  # the fixed list of components
    r = table(spark, d, "component_ref").select("component", F.row_number().over(place).alias("k")).where("k <= 32")
    media = table(spark, d, "medium_component").where("amount > 0").join(F.broadcast(r), "component").groupBy("medium_id", F.format_string("R%04d", "k").alias("reaction")).agg((-F.min("amount")).alias("bound"))
    return flux.medium_bounds(reactions, conditions, media)


@query(sql=f"WITH {_M}, {_BOUNDS} SELECT condition_key, reaction, round(lb, 6) AS lb, ub FROM mb")
def medium_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _medium_bounds(spark, d).select("condition_key", "reaction", r6("lb").alias("lb"), "ub")


@query(sql=f"""WITH {_LEVELS}, {_RL}, {_BOUNDS} SELECT condition_key, reaction, round(CASE WHEN level IS NULL THEN lb WHEN level <= 7.5 THEN 0.0 ELSE least(lb, 0.0) END, 6) AS lb, ub FROM mb LEFT JOIN rl USING (condition_key, reaction)""")
def expression_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The bounds of medium and expression together."""
    j = _medium_bounds(spark, d).join(flux.reaction_levels(_genes(spark, d), _gene_levels(spark, d)), ["condition_key", "reaction"], "left")
    return j.select("condition_key", "reaction", r6(flux.bounds_from_expression(F.col("lb"), F.col("level"), 7.5)).alias("lb"), "ub")


@query(sql=f"""WITH {_LEVELS}, g AS (SELECT condition_key, max(CASE WHEN gene = 'b0020' THEN v END) AS a, max(CASE WHEN gene = 'b0022' THEN v END) AS b, max(CASE WHEN gene = 'b0033' THEN v END) AS c, max(CASE WHEN gene = 'b0091' THEN v END) AS d FROM gl GROUP BY 1)
SELECT condition_key, round(greatest(least(a, greatest(b, c)), d), 6) AS level FROM g""")
def gene_rule_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level of a rule with both operators under every condition."""
    level = F.coalesce(F.avg(F.when(F.col("layer") == "proteome", F.col("value"))), F.avg(F.when(F.col("layer") != "proteome", F.col("value"))))
    g = _gene_levels(spark, d).groupBy("condition_key", "gene").agg(level.alias("v")).groupBy("condition_key").agg(F.map_from_entries(F.collect_list(F.struct("gene", "v"))).alias("m"))
    return g.select("condition_key", r6(flux.gene_rule("b0020 and (b0022 or b0033) or b0091", F.col("m"))).alias("level"))


@query(sql="""WITH c AS (SELECT DISTINCT lower(molecule_id) AS reaction FROM layer_axis), m AS (SELECT DISTINCT molecule_id AS x FROM layer_axis WHERE layer IN ('fluxome', 'metabolome', 'phenome'))
SELECT reaction, CASE WHEN reaction IN (SELECT x FROM m) THEN reaction ELSE upper(reaction) END AS model_reaction FROM c WHERE reaction IN (SELECT x FROM m) OR upper(reaction) IN (SELECT x FROM m)""")
def mappable_reactions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "layer_axis")
    return flux.mappable(a.select(F.lower("molecule_id").alias("reaction")).distinct(), a.where("layer in ('fluxome', 'metabolome', 'phenome')").select(F.col("molecule_id").alias("reaction")))


@query(sql=f"""WITH {_M}, f AS (SELECT key AS condition_key, molecule_id AS reaction, avg(value) AS flux FROM long WHERE layer = 'fluxome' AND key IS NOT NULL GROUP BY 1, 2), g AS (SELECT condition_key, abs(flux) AS g FROM f WHERE reaction = 'R0001')
SELECT condition_key, reaction, round(CASE WHEN g > 1e-9 THEN flux / g * 100 ELSE flux END, 6) AS flux FROM f LEFT JOIN g USING (condition_key)""")
def rescaled_fluxes(spark: SparkSession, d: str) -> DataFrame:
    f = _means(spark, d, "fluxome").select("condition_key", F.col("molecule_id").alias("reaction"), F.col("value").alias("flux"))
    return flux.rescaled(f, "R0001").select("condition_key", "reaction", r6("flux").alias("flux"))


@query(sql=f"""WITH {_M}, p AS (SELECT key, split_part(key, '.', 2) AS medium_id, max(value) AS g FROM long WHERE layer = 'phenome' AND molecule_id = 'growth_rate' AND key IS NOT NULL GROUP BY 1, 2)
SELECT medium_id, avg(CAST(g > 0.5 AS INT)) >= 0.5 AS viable FROM (SELECT medium_id, g FROM p) GROUP BY 1""")
def viable_media(spark: SparkSession, d: str) -> DataFrame:
    """Media under which at least half of the conditions grow by more than 0.5."""
    p = _growth(spark, d)
    return flux.viable(p, ["medium_id"], 0.5)


def _growth(spark: SparkSession, d: str) -> DataFrame:
    p = impute.fill_keys(table(spark, d, "layer_matrix").where("layer = 'phenome'")).where("condition_key is not null")
    return p.select("condition_key", F.split_part("condition_key", F.lit("."), F.lit(2)).alias("medium_id"), F.get("values", F.lit(1)).alias("biomass")).where("biomass is not null")


@query(sql=f"""WITH {_M}, p AS (SELECT split_part(condition_key, '.', 3) AS stress, v[2] AS growth, v[3] AS biomass FROM m WHERE layer = 'phenome' AND given AND condition_key IS NOT NULL)
SELECT stress, round(CASE WHEN k THEN regr_slope(growth, biomass) END, 6) AS slope, round(CASE WHEN k THEN regr_intercept(growth, biomass) END, 6) AS intercept
FROM (SELECT *, regr_count(growth, biomass) OVER s >= 3 AND max(CASE WHEN growth IS NOT NULL THEN biomass END) OVER s - min(CASE WHEN growth IS NOT NULL THEN biomass END) OVER s >= 1e-12 AS k FROM p WINDOW s AS (PARTITION BY stress)) GROUP BY stress, k""")
def growth_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Growth on the final density per stress, over the phenome profiles."""
    p = b.matrix(spark, d, "phenome").where("values is not null and condition_key is not null").select(F.split_part("condition_key", F.lit("."), F.lit(3)).alias("stress"), F.get("values", F.lit(1)).alias("growth"), F.get("values", F.lit(2)).alias("biomass"))
    fit = models.growth_calibration(p, ["stress"])
    return fit.select("stress", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


# ---- encoder and compendium


def _deliveries(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("strain", "strain_feature", "medium", "medium_component", "layer_matrix", "layer_axis")}


def _encoder(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    t = catalog.build(_deliveries(spark, d))
    e = encode.build_encoder(t)
    return e.transform(t["condition"].select("condition_key")), e.widths()


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return _encoder(spark, d)[0]


_CONDITIONS = f"""p AS (SELECT * FROM m WHERE key IS NOT NULL), c0 AS (SELECT DISTINCT key, string_split(key, '.') AS kp FROM p), c1 AS (SELECT key, kp, kp[4] AS gp FROM c0), {canonical_sql('c1')},
conds AS (SELECT key AS condition_key, kp[1] AS strain, kp[2] AS medium_id, CASE WHEN lower({STRIP.format('kp[3]')}) IN ({NO_STRESS}) THEN 'none' ELSE {STRIP.format('kp[3]')} END AS stress, canonical AS gp FROM c1 JOIN k USING (gp)),
stresses AS (SELECT DISTINCT condition_key, {STRIP.format('s')} AS stress FROM (SELECT condition_key, unnest(string_split(stress, ';')) AS s FROM conds) WHERE {STRIP.format('s')} NOT IN ('', 'none'))"""
_COMPONENTS = f"""mc0 AS (SELECT DISTINCT ON (medium_id, component) medium_id, component, raw FROM (SELECT medium_id, {STRIP.format('component')} AS component, raw, loaded_at FROM medium_component) ORDER BY medium_id, component, loaded_at DESC NULLS LAST, raw DESC NULLS LAST),
md AS (SELECT DISTINCT ON (medium_id) medium_id, base_medium, description FROM medium ORDER BY medium_id, loaded_at DESC), {amount_sql("mc0")},
mc AS (SELECT medium_id, component, mc0.raw, amount, unit, CAST(present OR (mc0.raw = '?' AND (regexp_matches(lower(coalesce(base_medium, '')), '(^|[^a-z0-9])' || regexp_escape(lower(component)) || '([^a-z0-9]|$)')
OR regexp_matches(lower(coalesce(description, '')), '(^|[^a-z0-9])' || regexp_escape(lower(component)) || '([^a-z0-9]|$)'))) AS INT) AS present FROM mc0 LEFT JOIN am ON mc0.raw IS NOT DISTINCT FROM am.raw LEFT JOIN md USING (medium_id))"""
_PLAIN = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_ENCODED = rf"""WITH {_M}, {_CONDITIONS}, {_COMPONENTS},
sf AS (SELECT DISTINCT ON (strain, feature) strain, feature, value FROM strain_feature ORDER BY strain, feature, loaded_at DESC, value DESC NULLS LAST),
mk AS (SELECT {_PLAIN.format('strain')} AS acc, lower(regexp_replace(feature, '[^A-Za-z0-9]', '', 'g')) AS feature, max(CAST(lower({STRIP.format("coalesce(value, 'none')")}) NOT IN ('no', 'none', 'na', '', '-', '?') AS INT)) AS present FROM sf WHERE strain IS NOT NULL GROUP BY 1, 2),
st AS (SELECT DISTINCT ON (accession) accession, name, alternate_names FROM strain ORDER BY accession, loaded_at DESC),
nm AS (SELECT DISTINCT {_PLAIN.format('accession')} AS acc, {_PLAIN.format('n')} AS name FROM (SELECT accession, unnest(list_concat([accession, name], regexp_split_to_array(coalesce(alternate_names, ''), '[;|\n]|\s+/\s+|,\s+'))) AS n FROM st) WHERE {_PLAIN.format('n')} <> ''),
sm AS (SELECT DISTINCT c.strain, feature FROM (SELECT DISTINCT strain FROM conds) c JOIN nm ON nm.name = {_PLAIN.format('c.strain')} JOIN mk ON mk.acc = nm.acc WHERE present = 1
UNION SELECT upper(acc), feature FROM mk WHERE present = 1 AND acc <> ''),
cm AS (SELECT medium_id, lower(component) AS component, present, amount FROM mc WHERE component IS NOT NULL), md2 AS (SELECT component, median(amount) AS med FROM cm GROUP BY 1),
mv AS (SELECT medium_id, component, max(present) AS present, max(coalesce(amount, med, 0)) AS amount FROM cm JOIN md2 USING (component) GROUP BY 1, 2), mt AS (SELECT medium_id, sum(present) + sum(amount) AS t FROM mv GROUP BY 1)"""


@query(sql=f"""{_ENCODED}, width AS (SELECT (SELECT count(DISTINCT feature) FROM mk WHERE acc <> '') + 2 * (SELECT count(DISTINCT component) FROM cm) + (SELECT count(DISTINCT stress) FROM stresses) + (SELECT count(DISTINCT x) FROM (SELECT unnest(string_split(gp, ';')) AS x FROM conds WHERE gp <> 'none')) AS w),
ns AS (SELECT strain, count(*) AS t FROM sm GROUP BY 1), nt AS (SELECT condition_key, count(*) AS t FROM stresses GROUP BY 1)
SELECT c.condition_key, w AS width, round(coalesce(ns.t, 0) + coalesce(mt.t, 0) + coalesce(nt.t, 0) + CASE WHEN gp = 'none' THEN 0 ELSE len(string_split(gp, ';')) END, 6) AS total
FROM conds c CROSS JOIN width LEFT JOIN ns ON ns.strain = c.strain LEFT JOIN mt ON mt.medium_id = c.medium_id LEFT JOIN nt ON nt.condition_key = c.condition_key""")
def encoder_multihot(spark: SparkSession, d: str) -> DataFrame:
    e = _encoded(spark, d)
    return e.select("condition_key", F.size("features").alias("width"), r6(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(sql=f"""{_ENCODED}, ss AS (SELECT strain, string_agg(feature, ',' ORDER BY feature) AS a FROM sm GROUP BY 1), ms AS (SELECT medium_id, string_agg(component || ':' || present || ':' || amount, ',' ORDER BY component) AS b FROM mv WHERE present <> 0 OR amount <> 0 GROUP BY 1),
ts AS (SELECT condition_key, string_agg(stress, ',' ORDER BY stress) AS d FROM stresses GROUP BY 1),
g AS (SELECT c.condition_key, count(*) OVER (PARTITION BY coalesce(a, ''), coalesce(b, ''), coalesce(d, '')) AS n FROM conds c LEFT JOIN ss ON ss.strain = c.strain LEFT JOIN ms ON ms.medium_id = c.medium_id LEFT JOIN ts ON ts.condition_key = c.condition_key)
SELECT condition_key, n FROM g WHERE n > 1""")
def encoder_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions that strain, medium and stress don't tell apart: the perturbation block is left out."""
    e, widths = _encoder(spark, d)
    kept = sum(w for k, w in widths.items() if k != "perturbation")
    return encode.collision_rows(e.withColumn("features", F.slice("features", 1, kept))).select("condition_key", "n")


@query(sql=f"WITH {_M} SELECT layer, count(*) AS n_profiles, count(DISTINCT key) AS n_conditions FROM m WHERE key IS NOT NULL GROUP BY 1")
def compendium_layer_summary(spark: SparkSession, d: str) -> DataFrame:
    catalog.register(catalog.build(_deliveries(spark, d)), "c_")
    return spark.sql("SELECT layer, n_profiles, n_conditions FROM c_layer_summary")


@query(sql=f"""WITH {_M}, {_CONDITIONS} SELECT c.*, {", ".join(f"max(CAST(layer = '{n}' AS INT)) AS has_{n}" for n in catalog.LAYERS)}, count(*) AS n_profiles FROM conds c JOIN p ON p.key = c.condition_key GROUP BY ALL""")
def compendium_condition_layers(spark: SparkSession, d: str) -> DataFrame:
    return catalog.condition_layers(catalog.build(_deliveries(spark, d)))


@query(sql=f"""WITH {_M}, {_CONDITIONS} SELECT 'a condition''s medium exists' AS rule, count(*) AS violations FROM conds WHERE medium_id NOT IN (SELECT medium_id FROM medium)
UNION ALL SELECT 'one cell per profile and molecule', count(*) FROM (SELECT profile_id, molecule_id FROM long WHERE key IS NOT NULL AND layer NOT IN ('fluxome', 'phenome') GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'a profile''s condition exists', count(*) FROM p WHERE key NOT IN (SELECT condition_key FROM conds)
UNION ALL SELECT 'a flux''s reaction exists', count(*) FROM long WHERE layer = 'fluxome' AND molecule_id NOT IN (SELECT molecule_id FROM layer_axis WHERE layer = 'fluxome')
UNION ALL SELECT unnest(['a measurement''s profile exists', 'a bridge''s perturbation exists']), 0""")
def compendium_integrity(spark: SparkSession, d: str) -> DataFrame:
    return catalog.integrity(catalog.build(_deliveries(spark, d)))


@query(sql=f"WITH {_M} SELECT key AS condition_key, arg_max(value, profile_id) AS growth_rate FROM long WHERE layer = 'phenome' AND molecule_id = 'growth_rate' AND key IS NOT NULL GROUP BY 1")
def compendium_growth(spark: SparkSession, d: str) -> DataFrame:
    return catalog.growth_rates(catalog.build(_deliveries(spark, d)))


@query(sql=f"WITH {_COMPONENTS} SELECT medium_id, component, raw, amount, unit, present FROM mc")
def compendium_components(spark: SparkSession, d: str) -> DataFrame:
    return catalog.build(_deliveries(spark, d))["medium_component"]


@query(sql=f"WITH {_M}, {_CONDITIONS} SELECT s.stress, count(*) AS n_profiles FROM stresses s JOIN p ON p.key = s.condition_key GROUP BY 1")
def compendium_stress_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.build(_deliveries(spark, d))["stress"]


@query(sql=f"WITH {_M} SELECT profile_id, layer, key AS condition_key, len(v) AS width, round(list_sum(v), 6) AS total, len(list_filter(v, lambda x: x IS NOT NULL)) AS readings FROM m WHERE key IS NOT NULL AND v IS NOT NULL")
def compendium_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The mirror of the measurements as vectors."""
    v = catalog.build(_deliveries(spark, d))["vector"]
    read = F.filter("values", lambda x: x.isNotNull())
    return v.select("profile_id", "layer", "condition_key", F.size("values").alias("width"), r6(F.aggregate(read, F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size(read).alias("readings"))


@query(sql=f"""WITH t AS (SELECT pert_id, regexp_replace({STRIP.format('gene')}, '[;\\s]+$', '') AS t FROM perturbation), s AS (SELECT lower(molecule_id) AS symbol, min(molecule_id) AS locus FROM layer_axis WHERE layer IN ('transcriptome', 'proteome') GROUP BY 1)
SELECT pert_id, CASE WHEN regexp_full_match(t, 'b[0-9]{{4}}') THEN t ELSE coalesce(a.locus, z.locus) END AS locus FROM t LEFT JOIN s a ON a.symbol = lower(t) LEFT JOIN s z ON z.symbol = lower(regexp_replace(t, '_[0-9]+$', ''))""")
def repaired_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Genes of the declared perturbations as loci; the symbols are the molecules of the axes."""
    t = table(spark, d, "perturbation").select("pert_id", "gene")
    a = table(spark, d, "layer_axis").where("layer in ('transcriptome', 'proteome')").groupBy(F.lower("molecule_id").alias("symbol")).agg(F.min("molecule_id").alias("locus"))
    symbols = a.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "locus"))).alias("symbols"))  # one row, as long as the axis
    return t.crossJoin(F.broadcast(symbols)).select("pert_id", parse.repaired_token(F.col("gene"), F.col("symbols")).alias("locus"))


@query(sql=f"""WITH f0 AS (SELECT o_orderstatus AS status, concat_ws('.', o_orderpriority, c_mktsegment, r_name, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus || '(KO)' END) AS condition_key, r_name AS fold, p_brand AS molecule_id, l_quantity AS q
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
f AS (SELECT condition_key, fold, status, molecule_id, avg(q) AS y FROM f0 GROUP BY ALL), folds AS (SELECT DISTINCT fold FROM f),
base AS (SELECT 'mean' AS predictor, folds.fold, molecule_id, avg(y) AS y_hat FROM f JOIN folds ON f.fold <> folds.fold GROUP BY ALL UNION ALL SELECT 'wild_type', folds.fold, molecule_id, avg(y) FROM f JOIN folds ON f.fold <> folds.fold WHERE status = 'F' GROUP BY ALL),
p AS (SELECT predictor, condition_key, molecule_id, y, y_hat FROM f JOIN base USING (fold, molecule_id)),
c AS (SELECT predictor, 'molecule' AS axis, {_R} AS pcc FROM p GROUP BY predictor, molecule_id UNION ALL SELECT predictor, 'profile', {_R} FROM p GROUP BY predictor, condition_key),
w AS (SELECT predictor, sqrt(avg((y - y_hat) ** 2)) AS rmse, regr_slope(y, y_hat) AS slope, count(DISTINCT condition_key) AS k FROM p GROUP BY 1)
SELECT predictor, axis, round(avg(pcc), 6) AS mean, round(stddev_pop(pcc), 6) AS sd, round(stddev_pop(pcc) / sqrt(count(pcc)), 6) AS sem, round(max(rmse), 6) AS rmse, round(max(slope), 6) AS slope, count(pcc) AS n, max(k) AS n_conditions, axis <> 'molecule' OR max(k) >= 15 AS shown
FROM c JOIN w USING (predictor) GROUP BY predictor, axis""")
def predictor_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Mean against wild-type baseline on both axes, by region folds; wild type is status F."""
    part = lambda k: F.split_part("condition_key", F.lit("."), F.lit(k))
    gp = F.when(part(1) == "F", "none").otherwise(F.concat(part(1), F.lit("(KO)")))
    f = b.facts(spark, d).select(F.concat_ws(".", part(2), part(3), part(4), gp).alias("condition_key"), "molecule_id", "value").groupBy("condition_key", "molecule_id").agg(F.avg("value").alias("value"))
    f = materialize(f.withColumn("profile_id", F.col("condition_key")), "means")
    fold = f.select("condition_key", part(3).alias("fold")).distinct()
    each = [cv.predictions(f, fold, base(f, fold)).withColumn("predictor", F.lit(n)) for n, base in (("mean", cv.mean_baseline), ("wild_type", cv.wild_type_baseline))]
    m = stats.evaluate(each[0].unionByName(each[1]), ["predictor"], F.count_distinct("condition_key"))
    return m.select("predictor", "axis", *[r6(c).alias(c) for c in ("mean", "sd", "sem", "rmse", "slope")], "n", "n_conditions", "shown")
