"""Queries of the engine's own operators over the driver's tables, each with the same in SQL where SQL can say it.

Results are rounded to six places so that two engines' sums compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyomics.functions import canon, parse
from polyomics.operators import cv, matrix, networks, pairs, stats
from polyomics.plans import bindings as b
from polyomics.plans.registry import table

LAYERS = ["click", "purchase", "view"]
QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- layers and conditions


@query(f"WITH {b.LAYERS} SELECT layer, count(*) AS n_profiles, count(DISTINCT condition_key) AS n_conditions FROM l GROUP BY layer")
def layer_summary(spark: SparkSession, d: str) -> DataFrame:
    return b.layers(spark, d).groupBy("layer").agg(F.count("*").alias("n_profiles"), F.count_distinct("condition_key").alias("n_conditions"))


@query(f"""WITH {b.LAYERS} SELECT c_custkey AS condition_id, max(CAST(layer = 'click' AS INT)) AS has_click, max(CAST(layer = 'purchase' AS INT)) AS has_purchase,
max(CAST(layer = 'view' AS INT)) AS has_view, count(DISTINCT layer) AS n_layers FROM customer LEFT JOIN l ON c_custkey = condition_key GROUP BY c_custkey""")
def condition_layers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("condition_id"))
    j = c.join(b.layers(spark, d), F.col("condition_id") == F.col("condition_key"), "left")
    return j.groupBy("condition_id").agg(*[F.max((F.col("layer") == n).cast("int")).alias(f"has_{n}") for n in LAYERS], F.count_distinct("layer").alias("n_layers"))


@query(f"WITH {b.LAYERS} SELECT condition_key FROM l WHERE layer IN ('click', 'purchase', 'view') GROUP BY 1 HAVING count(DISTINCT layer) = 3")
def shared_conditions_kway(spark: SparkSession, d: str) -> DataFrame:
    return matrix.shared_conditions(b.layers(spark, d), LAYERS)


@query(f"""WITH {b.LAYERS}, u AS (SELECT DISTINCT layer, condition_key FROM l)
SELECT x.layer AS layer_a, y.layer AS layer_b, count(*) AS shared FROM u x JOIN u y USING (condition_key) GROUP BY 1, 2""")
def overlap_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix.overlaps(b.layers(spark, d))


@query(f"WITH {b.LAYERS} SELECT condition_key FROM (SELECT condition_key FROM l WHERE layer = 'click' INTERSECT SELECT condition_key FROM l WHERE layer = 'error')")
def overlap_intersect(spark: SparkSession, d: str) -> DataFrame:
    e = b.layers(spark, d)
    return e.where("layer = 'click'").select("condition_key").intersect(e.where("layer = 'error'").select("condition_key"))


@query(f"WITH {b.LAYERS} SELECT count(*) AS n FROM l WHERE layer = 'click' AND condition_key IN (SELECT condition_key FROM l WHERE layer = 'purchase')")
def growth_semi_join(spark: SparkSession, d: str) -> DataFrame:
    e = b.layers(spark, d)
    return e.where("layer = 'click'").join(e.where("layer = 'purchase'"), "condition_key", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS condition_key FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def heldout_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders that no event layer has."""
    e = b.layers(spark, d).select("condition_key")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("condition_key")).distinct().join(e, "condition_key", "left_anti")


@query("SELECT c_custkey, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS n_profiles FROM customer")
def stress_counts_scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_profiles"))


@query(f"""WITH {b.LAYERS}, x AS (SELECT *, unnest(['value', 'day']) AS molecule_id, unnest([value, day]) AS v FROM (SELECT l.*, CAST(dayofyear(ts) AS DOUBLE) AS day FROM l JOIN events ON event_id = profile_id) WHERE layer IN ('click', 'purchase', 'view')),
k AS (SELECT condition_key FROM x GROUP BY 1 HAVING count(DISTINCT layer) = 3) SELECT condition_key, layer, molecule_id, round(avg(v), 6) AS value FROM x JOIN k USING (condition_key) GROUP BY ALL""")
def aligned_layers(spark: SparkSession, d: str) -> DataFrame:
    """Two molecules an event: its value and the day of its year."""
    e = table(spark, d, "events")
    cells = F.explode(F.create_map(F.lit("value"), "value", F.lit("day"), F.dayofyear("ts").cast("double"))).alias("molecule_id", "value")
    long = e.select(F.col("event_id").alias("profile_id"), F.col("event_type").alias("layer"), F.col("user_id").alias("condition_key"), cells)
    return matrix.aligned(long, LAYERS).select("condition_key", "layer", "molecule_id", r6("value").alias("value"))


@query(f"""WITH {b.FACTS}, c AS (SELECT DISTINCT condition_key FROM f), p AS (SELECT condition_key, split_part(condition_key, '.', 1) AS a1, split_part(condition_key, '.', 2) AS a2,
split_part(condition_key, '.', 3) AS a3, split_part(condition_key, '.', 4) AS a4 FROM c)
SELECT condition_key FROM (SELECT *, count(*) OVER (PARTITION BY a1) AS n1, count(*) OVER (PARTITION BY a2) AS n2, count(*) OVER (PARTITION BY a3) AS n3, count(*) OVER (PARTITION BY a4) AS n4 FROM p)
WHERE n1 > 1 AND n2 > 1 AND n3 > 1 AND n4 > 1""")
def testable_conditions(spark: SparkSession, d: str) -> DataFrame:
    c = b.facts(spark, d).select("condition_key").distinct()
    names = ["a1", "a2", "a3", "a4"]
    c = c.select("condition_key", *[F.split_part("condition_key", F.lit("."), F.lit(k + 1)).alias(n) for k, n in enumerate(names)])
    return matrix.testable(c, names).select("condition_key")


@query(f"""WITH {b.FACTS}, own AS (SELECT condition_key, molecule_id, avg(value) AS v FROM f GROUP BY 1, 2), allm AS (SELECT molecule_id, avg(value) AS o FROM f GROUP BY 1)
SELECT condition_key, molecule_id, round(coalesce(v, o), 6) AS value FROM (SELECT DISTINCT condition_key FROM f) CROSS JOIN allm LEFT JOIN own USING (condition_key, molecule_id)""")
def expression_fallback(spark: SparkSession, d: str) -> DataFrame:
    f = b.facts(spark, d)
    return matrix.fallback_mean(f, f).select("condition_key", "molecule_id", r6("value").alias("value"))


# ---- averages, baselines and scores


@query(f"WITH {b.CELLS} SELECT condition_key, molecule_id, round(avg(value), 6) AS value FROM e GROUP BY 1, 2")
def condition_average(spark: SparkSession, d: str) -> DataFrame:
    return matrix.average_by_condition(b.cells(spark, d)).select("condition_key", "molecule_id", r6("value").alias("value"))


_LOCO = f"""WITH {b.CELLS}, h AS (SELECT condition_key AS fold, molecule_id, sum(value) AS s, count(value) AS n FROM e GROUP BY 1, 2), t AS (SELECT molecule_id, sum(s) AS ts, sum(n) AS tn FROM h GROUP BY 1),
m AS (SELECT fold, molecule_id, (ts - s) / (tn - n) AS y_hat FROM h JOIN t USING (molecule_id)),
p AS (SELECT fold, profile_id, condition_key, molecule_id, value AS y, y_hat FROM e JOIN m USING (molecule_id) WHERE e.condition_key = m.fold)"""
_R = """CASE WHEN regr_count(y, y_hat) >= 3 AND sqrt(regr_sxx(y, y_hat) / regr_count(y, y_hat)) >= 1e-12 AND sqrt(regr_syy(y, y_hat) / regr_count(y, y_hat)) >= 1e-12
THEN least(1.0, greatest(-1.0, regr_sxy(y, y_hat) / sqrt(regr_sxx(y, y_hat) * regr_syy(y, y_hat)))) END"""


def _each_condition(spark: SparkSession, d: str) -> DataFrame:
    """Every condition a fold of its own, named by its key."""
    return b.cells(spark, d).select("condition_key", F.col("condition_key").alias("fold")).distinct()


def _loco(spark: SparkSession, d: str) -> DataFrame:
    long, fold = b.cells(spark, d), _each_condition(spark, d)
    return cv.predictions(long, fold, cv.mean_baseline(long, fold))


@query(f"{_LOCO} SELECT fold, molecule_id, round(y_hat, 6) AS y_hat FROM m")
def loco_mean_baseline(spark: SparkSession, d: str) -> DataFrame:
    return cv.mean_baseline(b.cells(spark, d), _each_condition(spark, d)).select("fold", "molecule_id", r6("y_hat").alias("y_hat"))


@query(f"""WITH {b.FACTS}, g AS (SELECT split_part(condition_key, '.', 4) AS fold, * FROM f), w AS (SELECT fold, molecule_id, value FROM g WHERE split_part(condition_key, '.', 1) = 'F'),
fs AS (SELECT DISTINCT fold FROM g), t AS (SELECT molecule_id, sum(value) AS s, count(*) AS n FROM w GROUP BY 1), h AS (SELECT fold, molecule_id, sum(value) AS s, count(*) AS n FROM w GROUP BY 1, 2)
SELECT fs.fold, t.molecule_id, round((t.s - coalesce(h.s, 0)) / (t.n - coalesce(h.n, 0)), 6) AS y_hat FROM fs CROSS JOIN t LEFT JOIN h ON h.fold = fs.fold AND h.molecule_id = t.molecule_id""")
def loco_wildtype_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Wild type here: status F. Folds: regions."""
    f = b.facts(spark, d).withColumn("region", F.split_part("condition_key", F.lit("."), F.lit(4)))
    status = F.split_part("condition_key", F.lit("."), F.lit(1))
    keyed = f.withColumn("condition_key", F.concat_ws(".", F.lit("s"), "region", F.lit("none"), F.when(status == "F", "none").otherwise("b0001(KO)")))
    fold = keyed.select("condition_key", F.col("region").alias("fold")).distinct()
    return cv.wild_type_baseline(keyed, fold).select("fold", "molecule_id", r6("y_hat").alias("y_hat"))


@query(f"{_LOCO} SELECT molecule_id, round({_R}, 6) AS pcc, regr_count(y, y_hat) AS n FROM p GROUP BY 1")
def pcc_per_molecule(spark: SparkSession, d: str) -> DataFrame:
    return stats.pcc_by(_loco(spark, d), "molecule_id").select("molecule_id", r6("pcc").alias("pcc"), "n")


@query(f"{_LOCO} SELECT profile_id, round({_R}, 6) AS pcc, regr_count(y, y_hat) AS n FROM p GROUP BY 1")
def pcc_per_profile(spark: SparkSession, d: str) -> DataFrame:
    return stats.pcc_by(_loco(spark, d), "profile_id").select("profile_id", r6("pcc").alias("pcc"), "n")


@query(f"{_LOCO} SELECT fold, round(regr_slope(y, y_hat), 5) AS slope FROM p GROUP BY 1")
def calibration_slope(spark: SparkSession, d: str) -> DataFrame:
    return _loco(spark, d).groupBy("fold").agg(F.round(stats.slope("y", "y_hat"), 5).alias("slope"))


@query(f"""{_LOCO}, c AS (SELECT 'molecule' AS axis, {_R} AS pcc FROM p GROUP BY molecule_id UNION ALL SELECT 'profile', {_R} FROM p GROUP BY profile_id),
w AS (SELECT sqrt(avg((y - y_hat) ** 2)) AS rmse, regr_slope(y, y_hat) AS slope, count(DISTINCT condition_key) AS k FROM p)
SELECT axis, round(avg(pcc), 6) AS mean, round(stddev_pop(pcc), 6) AS sd, round(stddev_pop(pcc) / sqrt(count(pcc)), 6) AS sem, count(pcc) AS n, round(avg(CAST(pcc > 0.3 AS INT)), 6) AS above_03,
round(avg(CAST(pcc > 0.5 AS INT)), 6) AS above_05, round(max(rmse), 6) AS rmse, round(max(slope), 5) AS slope, max(k) AS n_conditions, axis <> 'molecule' OR max(k) >= 15 AS shown FROM c CROSS JOIN w GROUP BY axis""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = stats.evaluate(_loco(spark, d), [], F.count_distinct("condition_key"))
    return m.select("axis", *[r6(c).alias(c) for c in ("mean", "sd", "sem")], "n", *[r6(c).alias(c) for c in ("above_03", "above_05", "rmse")], F.round("slope", 5).alias("slope"), "n_conditions", "shown")


@query(f"""{_LOCO}, r AS (SELECT molecule_id, min(y) AS lo, max(y) AS hi FROM p GROUP BY 1), q AS (SELECT condition_key, molecule_id, avg((y - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END) AS y,
avg((y_hat - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END) AS y_hat FROM p JOIN r USING (molecule_id) GROUP BY 1, 2) SELECT condition_key, round({_R}, 6) AS pcc FROM q GROUP BY 1""")
def score_by_condition(spark: SparkSession, d: str) -> DataFrame:
    return stats.score_by_condition(_loco(spark, d)).select("condition_key", r6("pcc").alias("pcc"))


@query(f"""WITH {b.CELLS}, r AS (SELECT molecule_id, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1)
SELECT profile_id, molecule_id, round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS value FROM e JOIN r USING (molecule_id)""")
def minmax_by_gene(spark: SparkSession, d: str) -> DataFrame:
    e = b.cells(spark, d)
    return stats.minmax(e, e).select("profile_id", "molecule_id", r6("value").alias("value"))


@query(f"""WITH {b.FACTS}, s AS (SELECT quantile_cont(value, 0.999) AS s FROM f) SELECT profile_id, molecule_id, count(*) AS n, round(sum(greatest(0, least(1, value / s))), 6) AS value, sum(CAST(value > s OR value < 0 AS INT)) AS clipped
FROM f CROSS JOIN s GROUP BY 1, 2""")
def target_scaler(spark: SparkSession, d: str) -> DataFrame:
    f = b.facts(spark, d)
    t = stats.scaled_targets(f, stats.target_scale(f))
    return t.groupBy("profile_id", "molecule_id").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("value"), F.sum(F.col("clipped").cast("int")).alias("clipped"))


@query(f"WITH {b.LAYERS} SELECT profile_id, layer, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9), 6) AS value FROM l WINDOW w AS (PARTITION BY layer)")
def platform_zscore(spark: SparkSession, d: str) -> DataFrame:
    return stats.platform_zscore(b.layers(spark, d), ["layer"]).select("profile_id", "layer", r6("value").alias("value"))


@query(f"WITH {b.CELLS} SELECT profile_id, molecule_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9), 6) AS value FROM e WINDOW w AS (PARTITION BY condition_key, molecule_id)")
def platform_zscore_per_gene(spark: SparkSession, d: str) -> DataFrame:
    return stats.platform_zscore(b.cells(spark, d), ["condition_key", "molecule_id"]).select("profile_id", "molecule_id", r6("value").alias("value"))


@query("""WITH c AS (SELECT l_suppkey AS sample, l_partkey AS gene, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sample, sum(n) AS size FROM c GROUP BY 1)
SELECT sample, gene, round(log2(n / size * 1e6 + 1), 6) AS value FROM c JOIN s USING (sample)""")
def counts_to_cpm(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("gene")).agg(F.count("*").alias("n"))
    return stats.counts_per_million(c).select("sample", "gene", r6("value").alias("value"))


@query(f"""WITH {b.CELLS}, v AS (SELECT condition_key AS platform, profile_id, molecule_id, round(value, 1) AS v FROM e), s AS (SELECT platform, profile_id, v, row_number() OVER (PARTITION BY profile_id ORDER BY v) - 1 AS g FROM v),
t AS (SELECT platform, g, avg(v) AS x FROM s GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY profile_id ORDER BY v) - 1 + (count(*) OVER (PARTITION BY profile_id, v) - 1) / 2.0 AS r FROM v)
SELECT profile_id, molecule_id, round(a.x + (r - floor(r)) * (z.x - a.x), 6) AS value FROM r JOIN t a ON a.platform = r.platform AND a.g = floor(r) JOIN t z ON z.platform = r.platform AND z.g = ceil(r)""")
def quantile_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Values rounded to one place, so that profiles have ties; all are equally long."""
    e = b.cells(spark, d).select(F.col("condition_key").alias("platform"), "profile_id", "molecule_id", F.round("value", 1).alias("value"))
    return stats.quantile_normalize(e, ["platform"]).select("profile_id", "molecule_id", r6("value").alias("value"))


@query(f"""WITH {b.LAYERS}, x AS (SELECT layer, value, row_number() OVER (ORDER BY value) AS o, rank() OVER (ORDER BY value) AS k, count(*) OVER (PARTITION BY value) AS t FROM l WHERE layer IN ('click', 'view') AND value IS NOT NULL),
s AS (SELECT sum(CAST(layer = 'click' AS INT)) AS n1, sum(CAST(layer = 'view' AS INT)) AS n2, sum(CASE WHEN layer = 'click' THEN k + (t - 1) / 2.0 ELSE 0 END) AS r1 FROM x)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round((r1 - n1 * (n1 + n2 + 1) / 2.0) / sqrt(CAST(n1 AS DOUBLE) * n2 * (n1 + n2 + 1) / 12.0), 6) AS z FROM s""")
def ranksum_z(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_sum(b.layers(spark, d), "value", "layer", "click", "view", []).select("n1", "n2", r6("z").alias("z"))


@query()
def ranksum_p(spark: SparkSession, d: str) -> DataFrame:
    """Rank-sum p of the text length between two sources, per language."""
    docs = table(spark, d, "documents")
    return stats.rank_sum(docs, "n_chars", "source", "lab_list", "helpdesk", ["lang"]).withColumn("p", stats.two_sided_p("z"))


# ---- filters, neighbours, networks

_SPARSE = "s AS (SELECT profile_id, condition_key, molecule_id, CASE WHEN abs(value) >= 0.05 THEN value END AS value FROM e WHERE profile_id % 97 + molecule_id % 7 > 3)"


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    """The embedding cells with those near 0 taken for missing, and some never written."""
    return b.cells(spark, d).where("profile_id % 97 + molecule_id % 7 > 3").withColumn("value", F.when(F.abs("value") >= 0.05, F.col("value")))


@query(f"""WITH {b.CELLS}, {_SPARSE}, np AS (SELECT count(DISTINCT profile_id) AS n FROM e), g AS (SELECT molecule_id FROM s CROSS JOIN np GROUP BY molecule_id, n HAVING 1 - count(value) / n <= 0.3),
ng AS (SELECT count(*) AS m FROM g), p AS (SELECT profile_id FROM s JOIN g USING (molecule_id) CROSS JOIN ng GROUP BY profile_id, m HAVING 1 - count(value) / m <= 0.3)
SELECT profile_id, molecule_id, round(value, 6) AS value FROM s JOIN g USING (molecule_id) JOIN p USING (profile_id)""")
def missingness_filter(spark: SparkSession, d: str) -> DataFrame:
    e = b.cells(spark, d)
    return matrix.missingness_filter(_sparse(spark, d), e, e, 0.3).select("profile_id", "molecule_id", r6("value").alias("value"))


@query(f"WITH {b.CELLS}, v AS (SELECT condition_key, molecule_id, var_pop(value) AS v FROM e GROUP BY 1, 2) SELECT condition_key, molecule_id, round(v, 6) AS variance, rank FROM (SELECT *, row_number() OVER (PARTITION BY condition_key ORDER BY v DESC, molecule_id) AS rank FROM v) WHERE rank <= 20")
def topk_variance(spark: SparkSession, d: str) -> DataFrame:
    return matrix.top_variance(b.cells(spark, d), ["condition_key"], 20).select("condition_key", "molecule_id", r6("variance").alias("variance"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {b.CELLS} SELECT a.molecule_id AS i, z.molecule_id AS j, round(regr_sxy(a.value, z.value) / sqrt(regr_sxx(a.value, z.value) * regr_syy(a.value, z.value)), 6) AS r
FROM e a JOIN e z ON a.profile_id = z.profile_id AND a.molecule_id < z.molecule_id GROUP BY 1, 2 HAVING regr_sxy(a.value, z.value) / sqrt(regr_sxx(a.value, z.value) * regr_syy(a.value, z.value)) > 0.1""")
def coexpression_edges(spark: SparkSession, d: str) -> DataFrame:
    return pairs.coexpression(b.vectors(spark, d), 0.1).select("i", "j", r6("r").alias("r"))


@query(f"""WITH {b.CELLS}, o AS (SELECT profile_id, molecule_id, value, profile_id % 11 + molecule_id % 5 <> 4 AS seen FROM e), s AS (SELECT * FROM o WHERE seen),
dist AS (SELECT a.molecule_id AS i, z.molecule_id AS j, sqrt(avg((a.value - z.value) ** 2)) AS dd FROM s a JOIN s z ON a.profile_id = z.profile_id AND a.molecule_id <> z.molecule_id GROUP BY 1, 2),
cand AS (SELECT DISTINCT g.molecule_id AS i, s.molecule_id AS j FROM o g JOIN s ON s.profile_id = g.profile_id WHERE NOT g.seen),
near AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dd, j) AS k FROM dist JOIN cand USING (i, j)) WHERE k <= 3),
own AS (SELECT molecule_id, avg(value) AS own FROM s GROUP BY 1),
fill AS (SELECT g.profile_id, g.molecule_id, avg(s.value) AS v FROM o g JOIN near ON near.i = g.molecule_id JOIN s ON s.profile_id = g.profile_id AND s.molecule_id = near.j WHERE NOT g.seen GROUP BY 1, 2)
SELECT o.profile_id, o.molecule_id AS idx, round(CASE WHEN seen THEN o.value ELSE coalesce(v, own, 0) END, 6) AS value, CAST(NOT seen AS INT) AS imputed
FROM o LEFT JOIN fill USING (profile_id, molecule_id) LEFT JOIN own USING (molecule_id)""")
def knn_impute(spark: SparkSession, d: str) -> DataFrame:
    v = b.vectors(spark, d)
    gap = (F.col("profile_id") % 11).cast("int")
    v = v.withColumn("values", F.transform("values", lambda x, i: F.when(gap + i % 5 != 4, x)))
    return pairs.knn_impute(v).select("profile_id", "idx", r6("value").alias("value"), "imputed")


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 1000 AS dst FROM lineitem), s AS (SELECT src, dst FROM b WHERE src <> dst UNION SELECT dst, src FROM b WHERE src <> dst) SELECT src, dst FROM s""")
def edge_symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return networks.symmetric(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 1000).alias("dst")))


@query("""WITH b AS (SELECT l_returnflag AS arm, l_suppkey AS src, l_partkey % 1000 AS dst FROM lineitem), s AS (SELECT arm, src, dst FROM b WHERE src <> dst UNION SELECT arm, dst, src FROM b WHERE src <> dst)
SELECT arm, count(DISTINCT src) AS n_nodes, CAST(count(*) / 2 AS BIGINT) AS n_edges FROM s GROUP BY 1""")
def network_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 1000).alias("dst"))
    return networks.statistics(networks.symmetric(e, ["arm"]), ["arm"])


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 1000 AS dst FROM lineitem), s AS (SELECT src, dst FROM b WHERE src <> dst UNION SELECT dst, src FROM b WHERE src <> dst), g AS (SELECT s_suppkey AS m FROM supplier WHERE s_acctbal > 0)
SELECT src, dst FROM s WHERE src IN (SELECT m FROM g) AND dst IN (SELECT m FROM g)""")
def network_restrict(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("molecule_id"))
    return networks.restrict(edge_symmetrize(spark, d), rich)


# ---- models that are aggregations

_ARMS = """arms AS (SELECT * FROM (VALUES ('a', 'click', 0.5), ('b', 'view', 0.25), ('c', 'purchase', 0.0), ('d_LEAKY', 'error', 1.0)) t(arm, layer, weight)),
p AS (SELECT arm, layer, condition_key, weight, avg(value) AS y_hat FROM l JOIN arms USING (layer) GROUP BY ALL)"""
_WEIGHTS = [("a", "click", 0.5), ("b", "view", 0.25), ("c", "purchase", 0.0), ("d_LEAKY", "error", 1.0)]


def _arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    arms = spark.createDataFrame(_WEIGHTS, "arm string, layer string, weight double")
    p = b.layers(spark, d).join(F.broadcast(arms), "layer").groupBy("arm", "layer", "condition_key").agg(F.avg("value").alias("y_hat"))
    return p, arms.select("layer", "weight")


@query(f"WITH {b.LAYERS}, {_ARMS} SELECT condition_key, round(CASE WHEN sum(weight) > 0 THEN sum(weight * y_hat) / sum(weight) END, 6) AS y_hat FROM p WHERE y_hat IS NOT NULL GROUP BY 1")
def weighted_consensus(spark: SparkSession, d: str) -> DataFrame:
    p, w = _arms(spark, d)
    return stats.consensus(p, w, ["condition_key"]).select("condition_key", r6("y_hat").alias("y_hat"))


@query(f"WITH {b.LAYERS}, {_ARMS} SELECT condition_key, round(avg(y_hat), 6) AS y_hat FROM p WHERE NOT ends_with(arm, '_LEAKY') GROUP BY 1")
def ensemble_mean_no_leak(spark: SparkSession, d: str) -> DataFrame:
    return stats.ensemble(_arms(spark, d)[0], ["condition_key"]).select("condition_key", r6("y_hat").alias("y_hat"))


@query(f"WITH {b.LAYERS}, {_ARMS} SELECT arm, count(DISTINCT condition_key) AS covered FROM p WHERE y_hat IS NOT NULL GROUP BY 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage(_arms(spark, d)[0].withColumnRenamed("condition_key", "molecule_id"), ["arm"])


@query(f"""WITH {b.CELLS}, x AS (SELECT a.profile_id, a.condition_key, a.molecule_id AS target, a.value AS y, z.value AS x FROM e a JOIN e z ON a.profile_id = z.profile_id AND z.molecule_id = (a.molecule_id + 1) % 64),
f AS (SELECT DISTINCT condition_key AS fold FROM e), m AS (SELECT fold, target, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x JOIN f ON x.condition_key <> f.fold GROUP BY 1, 2)
SELECT fold, target, round(s, 6) AS slope, round(i, 6) AS intercept FROM m""")
def own_feature_ols(spark: SparkSession, d: str) -> DataFrame:
    from polyomics.operators import models

    e = b.cells(spark, d)
    x = e.withColumn("molecule_id", F.pmod(F.col("molecule_id") - 1, F.lit(64))).withColumnRenamed("value", "x")
    xy = e.withColumnRenamed("value", "y").join(x, ["profile_id", "condition_key", "molecule_id"]).withColumnRenamed("molecule_id", "target")
    return models.own_feature_ols(xy, _each_condition(spark, d)).select("fold", "target", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


# ---- text rules




# The rules once more for DuckDB, by string functions: the kind of a token is what its last brackets hold, or what follows its last
# underscore.
STRIP = r"regexp_replace({}, '^[\s\x0b\p{{Z}}\x85\x1c-\x1f]+|[\s\x0b\p{{Z}}\x85\x1c-\x1f]+$', '', 'g')"
_WILD = ", ".join(f"'{w}'" for w in canon.WILD_TYPE_TOKENS)
_TYPES = ", ".join(f"'{w}'" for w in canon.GP_TYPES)
NO_STRESS = ", ".join(f"'{w}'" for w in canon.NO_STRESS_TOKENS)


def canonical_sql(source: str) -> str:
    """CTEs up to ``k`` (gp, canonical) of the distinct gp of ``source``."""
    return f"""g0 AS (SELECT DISTINCT gp FROM {source}), t0 AS (SELECT gp, unnest(string_split(coalesce(gp, ''), ';')) AS t FROM g0), t1 AS (SELECT gp, {STRIP.format('t')} AS t FROM t0),
t2 AS (SELECT gp, t, {STRIP.format("regexp_extract(t, '[(]([^()]*)[)]$', 1)")} AS inner_kind, {STRIP.format("regexp_extract(t, '^(.+)[(][^()]*[)]$', 1)")} AS inner_gene,
string_split(t, '_')[-1] AS last, left(t, greatest(length(t) - length(string_split(t, '_')[-1]) - 1, 0)) AS front FROM t1),
t3 AS (SELECT gp, t, CASE WHEN inner_gene <> '' AND regexp_full_match(inner_kind, '[A-Za-z]+') THEN [inner_gene, upper(inner_kind)]
WHEN front <> '' AND regexp_full_match(last, '[A-Za-z]+') THEN CASE WHEN upper(last) NOT IN ({_TYPES}) AND upper(front) IN ({_TYPES}) THEN [upper(last), upper(front)] ELSE [front, upper(last)] END ELSE [t, 'EX'] END AS p FROM t2),
t4 AS (SELECT DISTINCT gp, p[1] AS gene, p[2] AS kind FROM t3 WHERE lower(t) NOT IN ({_WILD}) AND p[2] <> 'WT' AND lower({STRIP.format('p[1]')}) NOT IN ({_WILD})),
t5 AS (SELECT gp, string_agg(gene || '(' || kind || ')', ';' ORDER BY gene, kind) AS c FROM t4 GROUP BY 1),
k AS (SELECT g0.gp, coalesce(c, 'none') AS canonical FROM g0 LEFT JOIN t5 ON g0.gp IS NOT DISTINCT FROM t5.gp)"""


@query(f"WITH {canonical_sql('condition_raw')}, n AS (SELECT gp, count(*) AS n FROM condition_raw GROUP BY 1) SELECT k.gp, n, canonical FROM k JOIN n ON k.gp IS NOT DISTINCT FROM n.gp")
def canonical_gp(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling in condition_raw with its canonical form and how often it occurs."""
    return table(spark, d, "condition_raw").groupBy("gp").agg(F.count("*").alias("n")).withColumn("canonical", canon.canonical_gp(F.col("gp")))


@query(f"SELECT stress, CASE WHEN stress IS NULL OR lower({STRIP.format('stress')}) IN ({NO_STRESS}) THEN 'none' ELSE {STRIP.format('stress')} END AS canonical, count(*) AS n FROM condition_raw GROUP BY 1, 2")
def canonical_stress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "condition_raw").groupBy("stress").agg(F.count("*").alias("n")).withColumn("canonical", canon.canonical_stress(F.col("stress")))


@query(f"""WITH {canonical_sql('condition_raw')} SELECT canonical AS canonical_gp, count(DISTINCT coalesce(r.gp, '<null>')) AS spellings, count(*) AS n
FROM condition_raw r JOIN k ON r.gp IS NOT DISTINCT FROM k.gp GROUP BY 1""")
def gp_dialects(spark: SparkSession, d: str) -> DataFrame:
    return canon.dialects(table(spark, d, "condition_raw"), "gp")


@query(f"""WITH s AS (SELECT record_id, string_split(cond, '.') AS p FROM condition_raw WHERE cond IS NOT NULL), q AS (SELECT record_id, p, p[4] AS gp FROM s WHERE len(p) = 4), {canonical_sql('q')}
SELECT record_id, {STRIP.format('p[1]')} AS strain, {STRIP.format('p[2]')} AS medium_id, CASE WHEN lower({STRIP.format('p[3]')}) IN ({NO_STRESS}) THEN 'none' ELSE {STRIP.format('p[3]')} END AS stress, canonical AS gp
FROM q JOIN k USING (gp)""")
def parse_condition(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "condition_raw").select("record_id", canon.parse_condition(F.col("cond"), strict=False).alias("k")).where("k is not null")
    return c.select("record_id", "k.strain", "k.medium_id", "k.stress", "k.gp")


_AMOUNT = "'^([0-9]*\\.?[0-9]+)\\s*([A-Za-z%/]*)$'"
_RAW = STRIP.format("raw")
_INNER = f"CASE WHEN regexp_matches({_RAW}, '^[A-Za-z]+\\s*[(][^()]+[)]$') THEN {STRIP.format(f"regexp_extract({_RAW}, '[(]([^()]+)[)]$', 1)")} ELSE {_RAW} END"


def amount_sql(source: str) -> str:
    """CTEs up to ``am`` (raw, amount, unit, present) of the distinct raw of ``source``."""
    return f"""amt AS (SELECT DISTINCT raw, {_RAW} AS t, {_INNER} AS i FROM {source}), an AS (SELECT *, CASE WHEN regexp_matches(i, {_AMOUNT}) THEN CAST(regexp_extract(i, {_AMOUNT}, 1) AS DOUBLE) END AS x, nullif(regexp_extract(i, {_AMOUNT}, 2), '') AS u FROM amt),
am AS (SELECT raw, CASE WHEN t IN ('', '0', 'no', '-') THEN 0.0 WHEN t IN ('?', 'unknown', 'na', 'yes', 'y', 'present') THEN NULL ELSE x END AS amount,
CASE WHEN t IN ('', '0', 'no', '-', '?', 'unknown', 'na', 'yes', 'y', 'present') THEN NULL ELSE u END AS unit,
CASE WHEN raw IS NULL OR t IN ('', '0', 'no', '-', '?', 'unknown', 'na') THEN false WHEN t IN ('yes', 'y', 'present') THEN true ELSE coalesce(x <> 0, true) END AS present FROM an)"""


@query(f"WITH {amount_sql('medium_component')} SELECT raw, amount, unit, present FROM am")
def parse_amount(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "medium_component").select("raw").distinct().withColumn("a", parse.parse_amount(F.col("raw")))
    return t.select("raw", "a.amount", "a.unit", "a.present")


@query("""SELECT medium_id, component, bool_or(regexp_matches(lower(coalesce(base_medium, '')), '(^|[^a-z0-9])' || regexp_escape(lower(trim(component))) || '([^a-z0-9]|$)')
OR regexp_matches(lower(coalesce(description, '')), '(^|[^a-z0-9])' || regexp_escape(lower(trim(component))) || '([^a-z0-9]|$)')) AS named
FROM (SELECT DISTINCT medium_id, trim(component) AS component FROM medium_component) JOIN medium USING (medium_id) GROUP BY 1, 2""")
def named_in_medium(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "medium_component").select("medium_id", F.trim("component").alias("component")).distinct()
    m = table(spark, d, "medium").select("medium_id", "base_medium", "description")
    return c.join(m, "medium_id").select("medium_id", "component", parse.named_in(F.col("component"), F.col("base_medium"), F.col("description")).alias("named"))


@query(f"SELECT strain, count(*) AS n, sum(CAST(lower({STRIP.format("coalesce(value, 'none')")}) NOT IN ('no', 'none', 'na', '', '-', '?') AS BIGINT)) AS present FROM strain_feature GROUP BY 1")
def strain_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "strain_feature").groupBy("strain").agg(F.count("*").alias("n"), F.sum(parse.marker_present(F.col("value")).cast("bigint")).alias("present"))


_NUMBER = f"""CASE WHEN regexp_full_match({STRIP.format('value')}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST({STRIP.format('value')} AS DOUBLE)
WHEN regexp_full_match(upper({STRIP.format('value')}), '[+-]?INF(INITY)?') THEN CASE WHEN {STRIP.format('value')} LIKE '-%' THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END END"""


@query(f"SELECT value, {_NUMBER} AS x FROM (SELECT DISTINCT value FROM strain_feature)")
def numeric_values(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value."""
    return table(spark, d, "strain_feature").select("value").distinct().select("value", parse.numeric(F.col("value")).alias("x"))


@query(f"""WITH v AS (SELECT unnest([raw, unit]) AS value FROM medium_component) SELECT value, {_NUMBER} AS x FROM (SELECT DISTINCT value FROM v)""")
def numeric_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same over the texts and units of medium_component."""
    c = table(spark, d, "medium_component").select(F.explode(F.array("raw", "unit")).alias("value")).distinct()
    return c.select("value", parse.numeric(F.col("value")).alias("x"))


@query("SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return e.groupBy("event_type", "key").agg(F.count("*").alias("n"))


# ---- figures' data


@query(f"WITH {b.LAYERS} SELECT layer, CAST(least(floor(value / 500 * 60), 59) AS BIGINT) AS bin, count(*) AS n FROM l WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(b.layers(spark, d), "value", 0, 500, 60, ["layer"])


@query("SELECT l_returnflag, l_quantity, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def quantity_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return stats.ecdf(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", "l_quantity", r6("share").alias("share"))


@query(f"WITH {b.LAYERS} SELECT layer, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(1 - count(value) / count(*), 6) AS missing FROM l GROUP BY 1")
def step_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return stats.diagnostics(b.layers(spark, d), ["layer"], F.count("*")).select("layer", *[r6(c).alias(c) for c in ("median", "q1", "q3", "missing")])


@query(f"{_LOCO} SELECT CAST(floor(y / 0.05) AS BIGINT) AS gx, CAST(floor(y_hat / 0.05) AS BIGINT) AS gy, count(*) AS n FROM p GROUP BY 1, 2")
def calibration_grid(spark: SparkSession, d: str) -> DataFrame:
    return stats.grid(_loco(spark, d), "y", "y_hat", 0.05, [])
