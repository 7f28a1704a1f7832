"""The queries by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesgrove.functions import series as fn
from seriesgrove.operators import allocation, calibration, filters, reports, search, summaries, training, tree
from seriesgrove.plans.queries import BATCHES, COVERAGE, EVERY, K, LENGTH, PARTS, QUERIES, SQL, TAKE, TARGET, Tables, d2_sql, query, rounded, stats_sql

_ANSWERS = "SELECT query_id, series_id, leaf_id, rank, round(d2, 6) AS d2 FROM {0}"


# Search


@query(_ANSWERS.format("truth"))
def knn_bruteforce(t: Tables):
    return rounded(t.truth(), "d2")


@query("SELECT query_id, series_id, rank, round(d2, 6) AS d2 FROM (SELECT query_id, series_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id) AS rank FROM (SELECT query_id, series_id, " + d2_sql("q", "v") + f" AS d2 FROM queries, series)) WHERE rank <= {K}")
def knn_declarative(t: Tables):
    return rounded(search.top_k(search.distances(t.queries, t.series), K), "d2")


@query(_ANSWERS.format("truth"))
def knn_exact_index(t: Tables):
    index = search.build(t.series, tree.TreeSettings(leaf_size=50))
    found, _ = search.exact(t.queries, index, K, exclude_self=True)
    home = t.series.select("series_id", "leaf_id")
    return rounded(found.drop("leaf_id").join(home, "series_id").select("query_id", "series_id", "leaf_id", "rank", "d2"), "d2")


@query(_ANSWERS.format("approx"))
def knn_resident_leaf(t: Tables):
    return rounded(t.approximate(), "d2")


@query("SELECT query_id, count(*) FILTER (WHERE d2 <= 1.5) AS n_within FROM pairs GROUP BY query_id")
def radius_count(t: Tables):
    return search.within(t.queries, t.series, 1.5, exclude_self=True)


@query("SELECT query_id, series_id, round(d2, 6) AS d2 FROM pairs WHERE leaf_id = home")
def sq_euclidean(t: Tables):
    """All distances within a label."""
    home = t.series.select(F.col("series_id").alias("query_id"), "leaf_id")
    pairs = t.queries.withColumnRenamed("values", "q").join(home, "query_id").join(t.series, "leaf_id").where("query_id <> series_id")
    return pairs.select("query_id", "series_id", F.round(fn.sq_euclidean("q", "values"), 6).alias("d2"))


@query(f"SELECT query_id, round(max(d2), 6) AS bsf FROM truth GROUP BY query_id HAVING count(*) >= {K}")
def kth_distance(t: Tables):
    return rounded(search.kth(t.truth(), K).where("bsf IS NOT NULL"), "bsf")


@query("SELECT query_id, leaf_id, lb2, visit FROM visits")
def knn_visit_order(t: Tables):
    return tree.visit_order(t.bounds())


@query("SELECT query_id, leaf_id, visit, seen FROM (SELECT query_id, leaf_id, visit, sum(size) OVER (PARTITION BY query_id ORDER BY visit)::BIGINT AS seen FROM visits) WHERE visit <= 3")
def knn_budget_nodes(t: Tables):
    return training.within_budget(t.visits().select("query_id", "leaf_id", "visit", "size"), max_leaves=3).select("query_id", "leaf_id", "visit", "seen")


@query("SELECT query_id, leaf_id, visit, seen FROM (SELECT query_id, leaf_id, visit, sum(size) OVER (PARTITION BY query_id ORDER BY visit)::BIGINT AS seen, (SELECT count(*) // 3 FROM series) AS most FROM visits) WHERE seen <= most")
def knn_budget_series(t: Tables):
    return training.within_budget(t.visits().select("query_id", "leaf_id", "visit", "size"), max_series=t.series.count() // 3).select("query_id", "leaf_id", "visit", "seen")


@query("SELECT query_id, leaf_id, state, size FROM visits")
def leaf_states(t: Tables):
    return t.visits().select("query_id", "leaf_id", "state", "size")


@query("SELECT query_id, count(*) AS leaves, count(*) FILTER (WHERE state = 'bound') AS pruned FROM visits GROUP BY query_id")
def lb_pruning_power(t: Tables):
    return t.visits().groupBy("query_id").agg(F.count("*").alias("leaves"), F.count_if(F.col("state") == "bound").alias("pruned"))


@query("SELECT query_id, leaf_id FROM pex WHERE bsf IS NOT NULL AND pred > bsf")
def filter_pruned_leaves(t: Tables):
    return t.predicted().where("bsf IS NOT NULL AND pred > bsf").select("query_id", "leaf_id")


@query(f"SELECT query_id, series_id, leaf_id, rank, round(d2, 6) AS d2 FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id) AS rank FROM pairs p ANTI JOIN (SELECT query_id, leaf_id FROM pex WHERE bsf IS NOT NULL AND pred - 0.2 > bsf) x USING (query_id, leaf_id)) WHERE rank <= {K}")
def knn_filtered(t: Tables):
    """Search without the leaves whose lowered prediction is above the best so far."""
    pruned = t.predicted().where((F.col("bsf").isNotNull()) & (F.col("pred") - 0.2 > F.col("bsf"))).select("query_id", "leaf_id")
    pairs = search.distances(t.queries, t.series, exclude_self=True).join(t.series.select("series_id", "leaf_id"), "series_id")
    return rounded(search.top_k(pairs.join(pruned, ["query_id", "leaf_id"], "left_anti"), K), "d2")


# Scalars and summaries


@query(f"SELECT series_id, list_transform(v, lambda x: round((x::DOUBLE - m) / s, 6)) AS values FROM (SELECT series_id, v, list_avg(v::DOUBLE[]) AS m, list_aggregate(v::DOUBLE[], 'stddev_pop') AS s FROM series)")
def znormalize(t: Tables):
    return t.series.select("series_id", F.transform(fn.znormalize("values"), lambda x: fn.signed_round(x)).alias("values"))


@query("SELECT series_id, round(list_avg(v::DOUBLE[]), 6) AS mean, round(list_aggregate(v::DOUBLE[], 'stddev_pop'), 6) AS std FROM series")
def series_mean_std(t: Tables):
    return t.series.select("series_id", F.round(fn.mean("values"), 6).alias("mean"), F.round(fn.std("values"), 6).alias("std"))


@query("SELECT series_id, seg, start, len, round(mean, 6) AS mean, round(std, 6) AS std FROM seg")
def segment_stats(t: Tables):
    return rounded(summaries.eapca(t.series, parts=t.parts), "mean", "std")


_H = [(0, 64), (0, 32), (32, 32)]


def _eapca_sql(parts) -> str:
    rows = []
    for i, (a, n) in enumerate(parts):
        m, s = stats_sql(f"v[{a + 1} : {a + n}]")
        rows.append(f"SELECT series_id, {i}::BIGINT AS seg, {a}::BIGINT AS start, {n}::BIGINT AS len, round({m}, 6) AS mean, round({s}, 6) AS std FROM series")
    return " UNION ALL ".join(rows)


@query(_eapca_sql(_H))
def eapca_halves(t: Tables):
    return rounded(summaries.eapca(t.series, length=LENGTH), "mean", "std")


@query(_eapca_sql([(0, 16), (16, 8), (24, 8), (32, 16), (48, 16)]))
def eapca_refine(t: Tables):
    return rounded(summaries.eapca(t.series, parts=summaries.refine(t.parts, 1)), "mean", "std")


@query("SELECT leaf_id, seg, start, len, round(min_mean, 6) AS min_mean, round(max_mean, 6) AS max_mean, round(min_std, 6) AS min_std, round(max_std, 6) AS max_std, n FROM env")
def envelope_by_leaf(t: Tables):
    return rounded(t.envelopes(), "min_mean", "max_mean", "min_std", "max_std")


@query("SELECT query_id, leaf_id, lb2 FROM lb")
def lower_bound(t: Tables):
    return t.bounds()


@query("SELECT query_id, leaf_id, lb2 <= lnn + 1e-6 AS holds FROM lb JOIN lnn USING (query_id, leaf_id)")
def lower_bound_holds(t: Tables):
    return t.bounds().join(t.nearest(), ["query_id", "leaf_id"]).select("query_id", "leaf_id", (F.col("lb2") <= F.col("lnn") + 1e-6).alias("holds"))


@query("SELECT series_id, array_to_string(list_transform(v, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)::VARCHAR), ' ') AS text FROM series")
def array_text(t: Tables):
    whole = F.transform("values", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    return t.series.select("series_id", fn.to_text(whole).alias("text"))


# Tree


@query("SELECT leaf_id, seg, candidate::BIGINT AS candidate, kind, round(gain, 6) AS gain, round(break_at, 6) AS break_at FROM gains")
def split_gain_level1(t: Tables):
    return rounded(tree.split_gains(t.envelopes()).select("leaf_id", "seg", "candidate", "kind", "gain", "break_at"), "gain", "break_at")


@query("SELECT leaf_id, seg, kind, round(gain, 6) AS gain, round(break_at, 6) AS break_at FROM splits")
def best_split_level1(t: Tables):
    return rounded(tree.best_splits(tree.split_gains(t.envelopes())).select("leaf_id", "seg", "kind", "gain", "break_at"), "gain", "break_at")


_SIDE = f"SELECT series_id, s.leaf_id, CASE WHEN (CASE kind WHEN 'mean' THEN {stats_sql('v[p.start + 1 : p.start + p.len]')[0]} ELSE {stats_sql('v[p.start + 1 : p.start + p.len]')[1]} END) < break_at THEN 0 ELSE 1 END AS side FROM series s JOIN splits p ON s.leaf_id = p.leaf_id"


@query(_SIDE)
def route_level1(t: Tables):
    return tree.route_once(t.series, tree.best_splits(tree.split_gains(t.envelopes()))).select("series_id", "leaf_id", "side")


@query(f"SELECT leaf_id, side, count(*) AS n FROM ({_SIDE}) GROUP BY leaf_id, side")
def split_sizes_level1(t: Tables):
    routed = tree.route_once(t.series, tree.best_splits(tree.split_gains(t.envelopes())))
    return routed.groupBy("leaf_id", "side").agg(F.count("*").alias("n"))


@query("SELECT leaf_id, size FROM sizes")
def leaf_sizes(t: Tables):
    return t.sizes()


@query("SELECT count(*) AS series, count(DISTINCT series_id) AS members, true AS partitioned FROM series")
def tree_members(t: Tables):
    """Every series is in one leaf of the fitted tree."""
    members = search.build(t.series, tree.TreeSettings(leaf_size=50)).members
    return members.agg(F.count("*").alias("series"), F.countDistinct("series_id").alias("members"), F.every(F.col("leaf_id").isNotNull()).alias("partitioned"))


@query("SELECT query_id, home AS leaf_id FROM queries")
def resident_leaf(t: Tables):
    return t.queries.select("query_id").join(t.series.select(F.col("series_id").alias("query_id"), "leaf_id"), "query_id")


@query()
def tree_nodes(t: Tables):
    """The fitted tree as a table."""
    return tree.to_frame(t.spark, tree.fit_tree(t.series, tree.TreeSettings(leaf_size=50)))


# Training data


@query("SELECT query_id, leaf_id, lb2, lnn, visit, bsf FROM ex")
def training_examples(t: Tables):
    return t.examples().select("query_id", "leaf_id", "lb2", "lnn", "visit", "bsf")


@query("SELECT query_id, leaf_id, visit, bsf FROM ex WHERE bsf IS NOT NULL")
def bsf_before_visit(t: Tables):
    return t.examples().where("bsf IS NOT NULL").select("query_id", "leaf_id", "visit", "bsf")


@query("SELECT query_id, leaf_id, n FROM knn")
def knn_nodes_count(t: Tables):
    return t.knn()


_NOISE = "((series_id * 7919 + (i - 1) * 104729 + 12345) % 1000)::DOUBLE / 1000 - 0.5"
_SYNTH = f"SELECT series_id AS query_id, list(x ORDER BY i) AS v FROM (SELECT series_id, i, v[i]::DOUBLE + (0.1 + (0.4 - 0.1) * ((series_id * 31 + 7) % 100)::DOUBLE / 100) * ({_NOISE}) AS x FROM series, range(1, 65) t(i)) GROUP BY series_id"


@query(f"SELECT query_id, list_transform(v, lambda x: round((x - m) / s, 6)) AS values FROM (SELECT query_id, v, list_avg(v) AS m, list_aggregate(v, 'stddev_pop') AS s FROM ({_SYNTH})) WHERE s > 1e-5")
def synth_queries_portable(t: Tables):
    made = training.synthesize(t.series)
    return made.select("query_id", F.transform("values", lambda x: fn.signed_round(x)).alias("values"))


@query()
def synth_queries_random(t: Tables):
    return training.random_queries(t.series, 32, seed=7)


@query("SELECT query_id, leaf_id, rank FROM (SELECT l.query_id, l.leaf_id, row_number() OVER (PARTITION BY l.leaf_id ORDER BY l.query_id) AS rank FROM lnn l JOIN (SELECT leaf_id, avg(lnn) AS m, stddev_pop(lnn) AS s FROM lnn GROUP BY leaf_id) x ON x.leaf_id = l.leaf_id WHERE lnn <= m - s) WHERE rank <= 3")
def local_queries(t: Tables):
    found = t.nearest()
    return training.local_queries(found, training.leaf_statistics(found), 3).select("query_id", "leaf_id", "rank")


@query("SELECT leaf_id, round(avg(lnn), 4) AS lnn_mean, round(stddev_pop(lnn), 4) AS lnn_std, count(*) AS n FROM lnn GROUP BY leaf_id")
def leaf_nearest_statistics(t: Tables):
    # Four places: a mean of numbers of six places can lie just between two such.
    return training.leaf_statistics(t.nearest()).withColumns({c: F.round(c, 4) for c in ("lnn_mean", "lnn_std")})


@query("SELECT query_id, (row_number() OVER (ORDER BY query_id) - 1) < floor(count(*) OVER () * 0.9) AS is_train FROM queries")
def train_val_split(t: Tables):
    return training.split(t.queries.select("query_id"), 0.9)


@query("SELECT query_id, leaf_id, lnn, 'global' AS origin FROM lnn UNION ALL SELECT query_id, leaf_id, lnn, 'local' AS origin FROM lnn WHERE leaf_id % 2 = 0")
def examples_union(t: Tables):
    found = t.nearest()
    return found.withColumn("origin", F.lit("global")).unionByName(found.where(F.col("leaf_id") % 2 == 0).withColumn("origin", F.lit("local")))


@query(f"SELECT query_id, leaf_id, n / {K}.0::DOUBLE AS share FROM knn")
def navigator_targets(t: Tables):
    return training.navigator_targets(t.knn(), K)


@query("""SELECT query_id, leaf_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leaf_id) AS place FROM (SELECT query_id, leaf_id, round(0.2::DOUBLE * CASE WHEN hp > lp THEN (probability - lp) / (hp - lp) ELSE 0 END + 0.8::DOUBLE * (1 - CASE WHEN hb > lb THEN (lb2 - lb) / (hb - lb) ELSE 0 END), 6) AS score
  FROM (SELECT *, min(probability) OVER w AS lp, max(probability) OVER w AS hp, min(lb2) OVER w AS lb, max(lb2) OVER w AS hb FROM (SELECT p.query_id, p.leaf_id, 1 / (1 + pred) AS probability, lb2 FROM pex p) WINDOW w AS (PARTITION BY query_id)))""")
def navigator_blend(t: Tables):
    scores = t.predicted().select("query_id", "leaf_id", (1 / (1 + F.col("pred"))).alias("probability"), "lb2")
    return training.navigator_order(scores, 0.2).select("query_id", "leaf_id", "score", "place")


# Calibration


@query("SELECT query_id, batch_id FROM batches")
def calib_batches_uniform(t: Tables):
    return t.batches()


@query(f"""SELECT query_id, batch_id, part FROM (SELECT *, dense_rank() OVER (PARTITION BY batch_id ORDER BY ((part * 31 + batch_id * 17 + 1) % 101) * 1000 + part) AS r FROM (
  SELECT query_id, batch_id, CAST(least((row_number() OVER (PARTITION BY batch_id ORDER BY (query_id * 7919 + (batch_id + 1) * 104729 + 12345) % 10007, query_id) - 1) // greatest(1, count(*) OVER (PARTITION BY batch_id) // {PARTS}), {PARTS - 1}) AS BIGINT) AS part
  FROM queries, range({BATCHES}) b(batch_id))) WHERE r <= {TAKE}""")
def calib_batches_combinatorial(t: Tables):
    return calibration.combinatorial_batches(t.queries, BATCHES, PARTS, TAKE)


@query("SELECT leaf_id, batch_id, error FROM errors")
def residual_sentinels(t: Tables):
    return t.errors()


@query("SELECT leaf_id, batch_id, error_i, alpha FROM alphas")
def alphas_sorted(t: Tables):
    return t.alphas()


@query("SELECT leaf_id, batch_id, alpha FROM (SELECT *, count(*) OVER (PARTITION BY leaf_id, batch_id) AS c FROM alphas) WHERE error_i = least(floor(c * 0.95), c - 1)")
def alpha_at_confidence(t: Tables):
    return calibration.alpha_at(t.alphas(), ["leaf_id", "batch_id"])


@query("SELECT leaf_id, error_i, max(alpha) AS alpha FROM alphas GROUP BY leaf_id, error_i")
def alpha_max_by_position(t: Tables):
    return calibration.largest_alphas(t.alphas())


@query("SELECT batch_id, error_i, round(recall, 6) AS recall FROM recalls")
def batch_recall_by_quantile(t: Tables):
    return rounded(t.recalls(), "recall")


_PAIRS = "SELECT batch_id, error_i, recall, cume_dist() OVER (PARTITION BY error_i ORDER BY recall DESC) AS coverage FROM recalls"


@query(f"SELECT batch_id, error_i, round(recall, 6) AS recall, round(coverage, 6) AS coverage FROM ({_PAIRS})")
def recall_coverage_pairs(t: Tables):
    return rounded(calibration.recall_coverage(t.recalls()), "recall", "coverage")


@query("SELECT batch_id, error_i, round(min(recall - error_i * 1e-4) OVER (PARTITION BY batch_id ORDER BY error_i DESC) + error_i * 1e-4, 6) AS recall FROM recalls")
def monotone_recall(t: Tables):
    return rounded(calibration.rising(t.recalls(), ["batch_id"]), "recall")


_STEFFEN = """SELECT leaf_id, x, y, coalesce((sign(s0) + sign(s1)) * least(abs(s0), abs(s1), 0.5 * abs((s0 * h1 + s1 * h0) / (h0 + h1))), s1, s0) AS slope FROM (
  SELECT *, (y1 - y) / h1 AS s1, (y - y0) / h0 AS s0 FROM (SELECT leaf_id, x, y, lead(x) OVER w - x AS h1, x - lag(x) OVER w AS h0, lead(y) OVER w AS y1, lag(y) OVER w AS y0 FROM (
    SELECT leaf_id, error_i::DOUBLE AS x, max(alpha) AS y FROM alphas GROUP BY leaf_id, error_i) WINDOW w AS (PARTITION BY leaf_id ORDER BY x)))"""


@query(f"SELECT leaf_id, x, y, round(slope, 6) AS slope FROM ({_STEFFEN})")
def steffen_spline(t: Tables):
    points = calibration.largest_alphas(t.alphas()).select("leaf_id", F.col("error_i").cast("double").alias("x"), F.col("alpha").alias("y"))
    return rounded(calibration.steffen(points, ["leaf_id"], "x", "y"), "slope")


@query(f"""SELECT leaf_id, round(y * (1 + 2 * t) * (1 - t) * (1 - t) + slope * h * t * (1 - t) * (1 - t) + y1 * t * t * (3 - 2 * t) + m1 * h * t * t * (t - 1), 6) AS value FROM (
  SELECT *, x1 - x AS h, (1.25 - x) / (x1 - x) AS t FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(slope) OVER w AS m1 FROM ({_STEFFEN}) WINDOW w AS (PARTITION BY leaf_id ORDER BY x)) WHERE x <= 1.25 AND x1 > 1.25)""")
def alpha_by_spline(t: Tables):
    points = calibration.largest_alphas(t.alphas()).select("leaf_id", F.col("error_i").cast("double").alias("x"), F.col("alpha").alias("y"))
    return rounded(calibration.hermite(calibration.steffen(points, ["leaf_id"], "x", "y"), ["leaf_id"], "x", "y", 1.25), "value")


_COEFFICIENTS = [0.01, 0.2, 0.05, 0.1, 0.3, -0.02]


@query(f"SELECT batch_id, error_i, round(greatest(0, 0.01::DOUBLE + 0.2 * recall + 0.05 * coverage + 0.1 * recall * coverage + 0.3 * recall * recall + (-0.02) * coverage * coverage), 6) AS alpha FROM ({_PAIRS})")
def poly_alpha_predict(t: Tables):
    pairs = calibration.recall_coverage(t.recalls())
    coefficients = F.array(*(F.lit(c) for c in _COEFFICIENTS))
    return pairs.select("batch_id", "error_i", F.round(fn.polynomial(coefficients, F.col("recall"), F.col("coverage")), 6).alias("alpha"))


@query()
def calibrated_alphas(t: Tables):
    """Alphas for the target recall and coverage: batches, recalls, coverage, fit."""
    return calibration.calibrate(t.batches(), t.knn(), t.predicted(), t.alphas(), K, TARGET, COVERAGE)


@query("SELECT query_id, leaf_id, round(greatest(0, pred - 0.2::DOUBLE), 6) AS low, round(greatest(0, pred - 0.2::DOUBLE) * greatest(0, pred - 0.2::DOUBLE), 6) AS squared FROM preds")
def calibrated_prediction(t: Tables):
    p = t.predictions()
    return p.select("query_id", "leaf_id", F.round(fn.calibrated(F.col("pred"), F.lit(0.2)), 6).alias("low"), F.round(fn.calibrated(F.col("pred"), F.lit(0.2), square=True), 6).alias("squared"))


@query("SELECT query_id, leaf_id, round(pred - 0.2::DOUBLE, 6) AS lo, round(pred + 0.2::DOUBLE, 6) AS hi FROM preds")
def prediction_interval(t: Tables):
    p = t.predictions().select("query_id", "leaf_id", fn.interval(F.col("pred"), F.lit(0.2)).alias("i"))
    return rounded(p.select("query_id", "leaf_id", "i.lo", "i.hi"), "lo", "hi")


@query("SELECT leaf_id, round(sum((e - p) * (e - p)) / sum(e * e), 6) AS dw FROM (SELECT leaf_id, pred - lnn AS e, lag(pred - lnn) OVER (PARTITION BY leaf_id ORDER BY query_id) AS p FROM pex) GROUP BY leaf_id")
def durbin_watson(t: Tables):
    rows = t.predicted().withColumn("e", F.col("pred") - F.col("lnn"))
    return rounded(calibration.durbin_watson(rows, ["leaf_id"], "query_id", "e"), "dw")


# Allocation


@query("SELECT leaf_id, avg(CASE WHEN lb2 > bsf THEN 1.0::DOUBLE ELSE 0 END) AS bound_pruned FROM pex GROUP BY leaf_id")
def pruning_frequency(t: Tables):
    return allocation.bound_pruning(t.predicted())


_ALPHA95 = "SELECT leaf_id, max(alpha) AS alpha FROM alphas WHERE error_i = 1 GROUP BY leaf_id"
_MODEL = f"SELECT p.leaf_id, avg(CASE WHEN pred - alpha > bsf THEN 1.0::DOUBLE ELSE 0 END) AS model_pruned FROM pex p JOIN ({_ALPHA95}) a ON a.leaf_id = p.leaf_id GROUP BY p.leaf_id"


_MODEL_B = _MODEL.replace("pred - alpha", "3 * lb2 - alpha")


def _alpha_one(t: Tables):
    return t.alphas().where("error_i = 1").groupBy("leaf_id").agg(F.max("alpha").alias("alpha"))


@query(_MODEL)
def model_pruning(t: Tables):
    return allocation.model_pruning(t.predicted(), _alpha_one(t))


_GAIN = f"SELECT s.leaf_id, size, size * (1 - bound_pruned) * model_pruned * (2.0::DOUBLE - 10.0::DOUBLE / size) AS gain, 0.5::DOUBLE + (s.leaf_id % 3) * 0.25 AS memory_mb FROM sizes s JOIN (SELECT leaf_id, avg(CASE WHEN lb2 > bsf THEN 1.0::DOUBLE ELSE 0 END) AS bound_pruned FROM pex GROUP BY leaf_id) b ON b.leaf_id = s.leaf_id JOIN ({_MODEL}) m ON m.leaf_id = s.leaf_id"


def _gains(t: Tables):
    rows = t.sizes().join(allocation.bound_pruning(t.predicted()), "leaf_id").join(allocation.model_pruning(t.predicted(), _alpha_one(t)), "leaf_id")
    return allocation.gains(rows, 2.0, 10.0).withColumn("memory_mb", 0.5 + (F.col("leaf_id") % 3) * 0.25)


@query(f"SELECT leaf_id, round(gain, 6) AS gain FROM ({_GAIN})")
def gain_score(t: Tables):
    return rounded(_gains(t).select("leaf_id", "gain"), "gain")


_ALLOCATED = "SELECT leaf_id, sum(memory_mb) OVER w AS used_mb, sum(memory_mb) OVER w <= 4 AS active FROM ({0}) WINDOW w AS (ORDER BY {1} DESC, leaf_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(_ALLOCATED.format(f"SELECT leaf_id, round(gain, 6) AS gain, memory_mb FROM ({_GAIN})", "gain"))
def allocate_by_gain(t: Tables):
    return allocation.allocate(rounded(_gains(t), "gain"), 4.0, "gain").select("leaf_id", "used_mb", "active")


@query(_ALLOCATED.format(f"SELECT leaf_id, size, memory_mb FROM ({_GAIN})", "size"))
def allocate_by_size(t: Tables):
    return allocation.allocate(_gains(t), 4.0, "size").select("leaf_id", "used_mb", "active")


@query("SELECT leaf_id, size FROM sizes WHERE size >= greatest(80.0 / 2.0, 8)")
def eligible_leaves(t: Tables):
    return allocation.eligible(t.sizes(), allocation.size_threshold(80.0, 2.0, 8))


@query("SELECT leaf_id, size, place FROM (SELECT leaf_id, size, row_number() OVER (ORDER BY size DESC, leaf_id) - 1 AS place, greatest(1, count(*) OVER () // 4) AS step FROM sizes) WHERE place % step = 0 AND place // step < 4")
def trial_leaf_sample(t: Tables):
    return allocation.trial_leaves(t.sizes(), 4)


# Reports


@query(f"SELECT query_id, (SELECT count(*) FROM truth x JOIN approx a ON a.query_id = x.query_id AND a.series_id = x.series_id WHERE x.query_id = q.query_id) / {K}.0::DOUBLE AS recall FROM queries q")
def recall_per_query(t: Tables):
    return reports.recall_by_query(t.truth(), t.approximate(), K)


_RECALL = f"SELECT x.query_id, count(a.series_id) / {K}.0::DOUBLE AS recall FROM truth x LEFT JOIN approx a ON a.query_id = x.query_id AND a.series_id = x.series_id GROUP BY x.query_id"


@query(f"SELECT round(avg(recall), 6) AS recall FROM ({_RECALL})")
def recall_mean(t: Tables):
    return rounded(reports.recall_by_query(t.truth(), t.approximate(), K).agg(F.avg("recall").alias("recall")), "recall")


_BATCHED = f"SELECT (p // per)::BIGINT AS batch_id, avg(recall) AS recall, count(*) AS queries FROM (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS p, CAST(ceil(count(*) OVER () / 4.0) AS BIGINT) AS per FROM ({_RECALL})) GROUP BY p // per"


@query(f"SELECT batch_id, round(recall, 6) AS recall, queries FROM ({_BATCHED})")
def recall_batched(t: Tables):
    return rounded(reports.recall_by_batch(reports.recall_by_query(t.truth(), t.approximate(), K), 4), "recall")


@query(f"SELECT round(avg(recall), 6) AS mean_recall, round(avg(CASE WHEN recall >= 0.6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, count(*) AS batches FROM ({_BATCHED})")
def coverage_achieved(t: Tables):
    found = reports.recall_by_batch(reports.recall_by_query(t.truth(), t.approximate(), K), 4)
    return rounded(reports.achieved_coverage(found, 0.6), "mean_recall", "coverage")


@query("SELECT x.query_id, x.rank, x.series_id AS true_series, x.leaf_id AS true_leaf, round(x.d2, 6) AS true_d2, a.series_id AS found_series, a.leaf_id AS found_leaf, round(a.d2, 6) AS found_d2, EXISTS (SELECT 1 FROM truth y WHERE y.query_id = x.query_id AND y.series_id = a.series_id) AS is_match FROM truth x LEFT JOIN approx a ON a.query_id = x.query_id AND a.rank = x.rank")
def answer_comparison(t: Tables):
    return rounded(reports.compare(t.truth(), t.approximate()), "true_d2", "found_d2")


_SEEN = "state IN ('scanned', 'resident')"


@query(f"SELECT query_id, count(*) FILTER (WHERE {_SEEN}) AS visited_leaves, coalesce(sum(size) FILTER (WHERE {_SEEN}), 0)::BIGINT AS visited_series, count(*) FILTER (WHERE NOT {_SEEN}) AS pruned_leaves, coalesce(sum(size) FILTER (WHERE NOT {_SEEN}), 0)::BIGINT AS pruned_series, round(count(*) FILTER (WHERE NOT {_SEEN}) / count(*)::DOUBLE, 6) AS pruning_ratio FROM visits GROUP BY ROLLUP (query_id)")
def node_statistics(t: Tables):
    return rounded(reports.leaf_statistics(t.visits()), "pruning_ratio")


_WRONG = "CASE WHEN pruned AND n > 0 THEN 1.0::DOUBLE ELSE 0 END"


@query(f"SELECT batch_id, error_i, round(avg({_WRONG}), 6) AS wrong_pruned_ratio, round(avg(CASE WHEN has_filter THEN 0 ELSE 1.0::DOUBLE END), 6) AS no_filter_ratio, count(*) AS leaves FROM told GROUP BY batch_id, error_i")
def batch_pruning_stats(t: Tables):
    return rounded(reports.pruning_by_batch(t.told()), "wrong_pruned_ratio", "no_filter_ratio")


@query(f"SELECT batch_id, error_i, query_id, round(avg(CASE WHEN pruned THEN 0 ELSE 1.0::DOUBLE END), 6) AS accessed_ratio, round(avg({_WRONG}), 6) AS wrong_pruned_ratio, count(*) AS leaves FROM told GROUP BY batch_id, error_i, query_id")
def node_access_stats(t: Tables):
    return rounded(reports.access_by_query(t.told()), "accessed_ratio", "wrong_pruned_ratio")


@query("SELECT batch_id, error_i, round(avg(a) / (SELECT 2 * count(*) - 1 FROM sizes), 6) AS accessed_ratio, round(avg(w) / (SELECT 2 * count(*) - 1 FROM sizes), 6) AS wrong_pruned_ratio FROM (SELECT batch_id, error_i, query_id, count(*) FILTER (WHERE NOT pruned) AS a, count(*) FILTER (WHERE pruned AND n > 0) AS w FROM told GROUP BY batch_id, error_i, query_id) GROUP BY batch_id, error_i")
def batch_access_summary(t: Tables):
    return rounded(reports.access_by_batch(t.told(), 2 * t.sizes().count() - 1), "accessed_ratio", "wrong_pruned_ratio")


@query("SELECT leaf_id, batch_id, list(alpha ORDER BY error_i) AS alphas FROM alphas GROUP BY leaf_id, batch_id")
def error_summary_pivot(t: Tables):
    """The alphas of each filter and batch by place, all places."""
    return reports.along(t.alphas(), ["leaf_id", "batch_id"], "error_i", "alpha")


@query("SELECT error_i, list(round(recall, 6) ORDER BY batch_id) AS recalls FROM recalls GROUP BY error_i")
def recall_pivot(t: Tables):
    """The recall at each place by batch, all batches."""
    return reports.along(rounded(t.recalls(), "recall"), ["error_i"], "batch_id", "recall")


# Models


def _weights():
    w1 = [[((i * 7 + j * 3) % 11 - 5) / 20 for j in range(4)] for i in range(LENGTH)]
    return w1, [0.1, -0.2, 0.3, 0.0], [0.5, -0.4, 0.3, 0.2], 0.05


def _mlp_sql() -> str:
    w1, b1, w2, b2 = _weights()
    terms = []
    for j in range(4):
        z = f"({b1[j]}::DOUBLE + list_sum(list_transform(list_zip(q, {[row[j] for row in w1]}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)))"
        terms.append(f"{w2[j]}::DOUBLE * (CASE WHEN {z} > 0 THEN {z} ELSE 0.1 * {z} END)")
    return f"SELECT query_id, round({b2} + {' + '.join(terms)}, 6) AS pred FROM queries"


@query(_mlp_sql())
def mlp_inference_fixed(t: Tables):
    return t.queries.select("query_id", F.round(filters.mlp_expression(F.col("values"), *_weights()), 6).alias("pred"))


@query()
def filters_trained(t: Tables):
    """One MLP per leaf, trained on the queries' nearest distances."""
    from seriesgrove.functions.models import Training

    rows = t.nearest().join(t.queries, "query_id")
    return filters.train_filters(rows, "mlp_2_16", Training(epochs=60, rate=0.05)).select("leaf_id", "model", "loss", "examples", "memory_mb", "active")


# More of the same


@query("SELECT leaf_id, coalesce(sum(size) OVER (ORDER BY leaf_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, size FROM sizes")
def cumulative_leaf_sizes(t: Tables):
    return training.cumulative_sizes(t.sizes())


@query("SELECT series_id AS place, leaf_id FROM series s0, LATERAL (SELECT leaf_id FROM (SELECT leaf_id, size, sum(size) OVER (ORDER BY leaf_id) AS z FROM sizes) c WHERE s0.series_id >= c.z - c.size AND s0.series_id < c.z) x(leaf)".replace("SELECT series_id AS place, leaf_id", "SELECT series_id AS place, leaf AS leaf_id"))
def leaf_of_place(t: Tables):
    return training.leaf_of_place(t.series.select(F.col("series_id").alias("place")), t.sizes())


@query("SELECT count(*) FILTER (WHERE size > 40) * 3 AS n_queries FROM sizes")
def synthetic_query_count(t: Tables):
    return training.synthetic_query_count(t.sizes(), 40, 3)


_ORDER = f"SELECT query_id, leaf_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, leaf_id) AS place FROM knn"


@query(f"SELECT query_id, series_id, leaf_id, rank, round(d2, 6) AS d2 FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id) AS rank FROM pairs p SEMI JOIN (SELECT query_id, leaf_id FROM ({_ORDER}) WHERE place <= 2) o USING (query_id, leaf_id)) WHERE rank <= {K}")
def knn_navigated(t: Tables):
    """Search in each query's two best leaves, by the share of its nearest series."""
    from pyspark.sql import Window

    order = t.knn().withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "leaf_id")))
    pairs = search.distances(t.queries, t.series, exclude_self=True).join(t.series.select("series_id", "leaf_id"), "series_id")
    return rounded(search.top_k(training.navigated(order, pairs, 2), K), "d2")


@query("SELECT series_id, list_transform(v, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)::DOUBLE) AS values FROM series")
def text_array(t: Tables):
    """Numbers written as text and read back."""
    whole = F.transform("values", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    return t.series.select("series_id", fn.from_text(fn.to_text(whole)).alias("values"))


@query("SELECT a.query_id, a.leaf_id, abs(a.lnn - a.lb2) <= 1e-5 * greatest(1, abs(a.lnn), abs(a.lb2)) AS equal FROM ex a")
def almost_equal(t: Tables):
    return t.examples().select("query_id", "leaf_id", fn.almost_equal("lnn", "lb2").alias("equal"))


@query("SELECT query_id, leaf_id, round(sqrt(lnn), 6) AS root FROM lnn")
def square_roots(t: Tables):
    return t.nearest().select("query_id", "leaf_id", F.round(F.sqrt("lnn"), 6).alias("root"))


@query("SELECT query_id, series_id FROM truth INTERSECT SELECT query_id, series_id FROM approx")
def answers_intersected(t: Tables):
    return reports.hits(t.truth(), t.approximate()).select("query_id", "series_id")


_ONE = "SELECT error_i, avg(recall) AS recall FROM recalls GROUP BY error_i"


@query(f"SELECT leaf_id, CASE WHEN (SELECT min(recall) FROM ({_ONE})) > 0.7 THEN 0 ELSE alpha END AS alpha FROM (SELECT leaf_id, error_i, max(alpha) AS alpha FROM alphas GROUP BY leaf_id, error_i) WHERE error_i = coalesce((SELECT min(error_i) FROM ({_ONE}) WHERE recall >= 0.7), (SELECT max(error_i) FROM ({_ONE})))")
def alpha_for_recall(t: Tables):
    """Calibration to a recall alone, over all batches as one set."""
    recalls = t.recalls().groupBy("error_i").agg(F.avg("recall").alias("recall"))
    return calibration.alpha_for_recall(recalls, calibration.largest_alphas(t.alphas()), 0.7)


@query(f"SELECT model, round(avg(model_pruned), 6) AS model_pruned FROM (SELECT 'a' AS model, model_pruned FROM ({_MODEL}) UNION ALL SELECT 'b' AS model, model_pruned FROM ({_MODEL_B})) GROUP BY model")
def trial_pruning(t: Tables):
    """Two models: the second predicts from the bound alone."""
    one = allocation.model_pruning(t.predicted(), _alpha_one(t)).withColumn("model", F.lit("a"))
    two = allocation.model_pruning(t.predicted().withColumn("pred", 3 * F.col("lb2")), _alpha_one(t)).withColumn("model", F.lit("b"))
    return rounded(allocation.trial_pruning(one.unionByName(two)), "model_pruned")


@query(f"SELECT leaf_id, CASE WHEN ga >= gb THEN 'a' ELSE 'b' END AS model FROM (SELECT leaf_id, gain AS ga, gain / 2 + 0.001 AS gb FROM ({_GAIN})) WHERE abs(ga - gb) > 1e-9")
def best_model(t: Tables):
    rows = _gains(t)
    both = rows.select("leaf_id", F.lit("a").alias("model"), "gain").unionByName(rows.select("leaf_id", F.lit("b").alias("model"), (F.col("gain") / 2 + 0.001).alias("gain")))
    return allocation.best_models(both).select("leaf_id", "model")


def _points(t: Tables):
    pairs = calibration.recall_coverage(t.recalls())
    return pairs.join(t.alphas(), ["batch_id", "error_i"]).select("leaf_id", "batch_id", "recall", "coverage", "alpha")


@query()
def batch_surfaces(t: Tables):
    """The fit of each batch's own alphas."""
    return calibration.fit_batches(_points(t))


@query()
def bivariate_fits(t: Tables):
    """Linear or quadratic fits, chosen by the Durbin-Watson statistic."""
    return calibration.fit_bivariate(_points(t))


@query()
def cubic_spline(t: Tables):
    points = calibration.largest_alphas(t.alphas()).select("leaf_id", F.col("error_i").cast("double").alias("x"), F.col("alpha").alias("y"))
    return calibration.hermite(calibration.cubic(points, "x", "y"), ["leaf_id"], "x", "y", 1.25)


@query()
def navigator_trained(t: Tables):
    """query_id, leaf_id, probability of a navigator fitted to the shares of nearest series."""
    leaves = [r.leaf_id for r in t.sizes().orderBy("leaf_id").collect()]
    model = training.fit_navigator(t.queries, training.navigator_targets(t.knn(), K), leaves, 64, 50)
    return training.navigator_probabilities(model, t.queries)
