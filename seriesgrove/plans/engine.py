"""Queries that run the search engine over a fixed tree, fixed filters and a fixed navigator, and their SQL.

The tree is given as data: three levels, a vertical split (so that leaves have different segments), breaks on means and
on deviations. So SQL can repeat routing, envelopes, bounds, the order of visits, budgets and filters leaf by leaf.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesgrove.functions import models
from seriesgrove.operators import allocation, calibration, filters, reports, search, summaries, training, tree
from seriesgrove.plans.queries import EVERY, K, LENGTH, PARTS_SQL, Tables, d2_sql, query, rounded, stats_sql

_P4 = [(0, 16), (16, 16), (32, 16), (48, 16)]
_P5 = [(0, 16), (16, 8), (24, 8), (32, 16), (48, 16)]
#: node: (parent, segments, split): the split is (on deviation, start, length, break, children).
TREE = {
    0: (None, _P4, (False, 0, 16, 0.0, (1, 2))),
    1: (0, _P4, (True, 16, 8, 0.12, (3, 4))),
    2: (0, _P4, (False, 32, 16, 0.0, (5, 6))),
    3: (1, _P5, None),
    4: (1, _P5, None),
    5: (2, _P4, None),
    6: (2, _P4, (True, 48, 16, 0.122, (7, 8))),
    7: (6, _P4, None),
    8: (6, _P4, None),
}
LEAVES = [n for n, (_, _, split) in TREE.items() if split is None]
MOST_LEAVES, MOST_SHARE, ALPHA = 2, 3, 0.05


def nodes() -> list[tree.Node]:
    out = []
    for n, (parent, parts, split) in TREE.items():
        node = tree.Node(n, parent, 0 if parent is None else out[parent].depth + 1, parts)
        if split is not None:
            node.is_leaf, node.on_std, node.start, node.len, node.breaks, node.children = False, *split[:3], [split[3]], list(split[4])
        out.append(node)
    return out


def index(t: Tables) -> search.Index:
    return search.build(t.series.select("series_id", "values"), nodes=nodes())


# Fixed models: plain numbers from the places of the weights.


def weights(leaf: int) -> models.Weights:
    import numpy as np

    i, j = np.indices((LENGTH, 4))
    return {"w1": ((i * 7 + j * 3 + leaf) % 11 - 5) / 20.0, "b1": np.array([0.1, -0.2, 0.3, 0.0]), "w2": np.array([[0.5], [-0.4], [0.3], [0.2]]), "b2": np.array([1.1 + 0.02 * leaf])}


def fixed_filters(t: Tables):
    rows = [(leaf, "mlp_2_4", *models.flat(weights(leaf)), 0.0, 0, 0.1, True) for leaf in LEAVES if leaf != 4]  # leaf 4 has no filter
    return t.spark.createDataFrame(rows, filters.FILTERS)


def navigator() -> models.Navigator:
    import numpy as np

    n = models.Navigator(LENGTH, LEAVES, 3)
    i, j = np.indices((LENGTH, 3))
    a, b = np.indices((3, 3))
    c, d = np.indices((3, len(LEAVES)))
    n.weights = {"w1": ((i * 5 + j * 3) % 7 - 3) / 1.0, "b1": np.zeros(3), "w2": ((a * 2 + b * 3) % 5 - 2) * 1.5, "b2": np.zeros(3), "w3": ((c * 3 + d * 2) % 5 - 2) * 2.0, "b3": np.zeros(len(LEAVES))}
    return n


def _stat(part: str, on_std: bool) -> str:
    return stats_sql(part)[1 if on_std else 0]


def _case(n: int) -> str:
    """The leaf of v below a node."""
    split = TREE[n][2]
    if split is None:
        return str(n)
    on_std, a, m, at, (left, right) = split
    return f"CASE WHEN {_stat(f'v[{a + 1} : {a + m}]', on_std)} < {at} THEN {_case(left)} ELSE {_case(right)} END"


_PIECES = sorted({p for _, parts, _ in TREE.values() for p in parts})
_SEGMENTS = ", ".join(f"({leaf}, {i}, {a}, {m})" for leaf in LEAVES for i, (a, m) in enumerate(TREE[leaf][1]))
_WEIGHT = "list_sum(list_transform(range({n}), lambda i: q[i + 1]::DOUBLE * {w}))"


def _mlp(leaf: str) -> str:
    terms = []
    for j, (b, w) in enumerate(zip((0.1, -0.2, 0.3, 0.0), (0.5, -0.4, 0.3, 0.2), strict=True)):
        z = f"({b}::DOUBLE + {_WEIGHT.format(n=LENGTH, w=f'(((i * 7 + {j * 3} + {leaf}) % 11 - 5) / 20.0::DOUBLE)')})"
        terms.append(f"{w}::DOUBLE * (CASE WHEN {z} > 0 THEN {z} ELSE 0.1::DOUBLE * {z} END)")
    return f"1.1::DOUBLE + 0.02::DOUBLE * {leaf} + {' + '.join(terms)}"


def _sigmoid(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"


PARTS_SQL |= {
    "f_series": f"SELECT series_id, v, CAST({_case(0)} AS BIGINT) AS leaf_id FROM series",
    "f_stat": " UNION ALL ".join(f"SELECT series_id, {a} AS start, {m} AS len, {_stat(f'v[{a + 1} : {a + m}]', False)} AS mean, {_stat(f'v[{a + 1} : {a + m}]', True)} AS std FROM series" for a, m in _PIECES),
    "f_segments": f"SELECT * FROM (VALUES {_SEGMENTS}) t(leaf_id, seg, start, len)",
    "f_env": "SELECT s.leaf_id, p.seg, p.start, p.len, min(mean) AS min_mean, max(mean) AS max_mean, min(std) AS min_std, max(std) AS max_std, count(*) AS n FROM f_series s JOIN f_segments p ON p.leaf_id = s.leaf_id JOIN f_stat x ON x.series_id = s.series_id AND x.start = p.start AND x.len = p.len GROUP BY s.leaf_id, p.seg, p.start, p.len",
    "f_lb": f"SELECT x.series_id AS query_id, e.leaf_id, sum(e.len * (pow(greatest(0, min_mean - mean, mean - max_mean), 2) + pow(greatest(0, min_std - std, std - max_std), 2))) AS lb2 FROM f_stat x JOIN f_env e ON x.start = e.start AND x.len = e.len WHERE x.series_id % {EVERY} = 0 GROUP BY x.series_id, e.leaf_id",
    "f_home": f"SELECT series_id AS query_id, leaf_id AS home, v AS q FROM f_series WHERE series_id % {EVERY} = 0",
    "f_pairs": f"SELECT query_id, home, series_id, leaf_id, {d2_sql('q', 'v')} AS d2 FROM f_home, f_series WHERE query_id <> series_id",
    "f_sizes": "SELECT leaf_id, count(*) AS size FROM f_series GROUP BY leaf_id",
    "f_first": f"SELECT * FROM (SELECT query_id, series_id, leaf_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id) AS rank FROM f_pairs WHERE leaf_id = home) WHERE rank <= {K}",
    "f_bsf": f"SELECT query_id, max(d2) AS bsf FROM f_first GROUP BY query_id HAVING count(*) >= {K}",
    "f_pred": f"SELECT query_id, leaf_id, {_mlp('leaf_id')} AS pred FROM f_home, f_sizes WHERE leaf_id <> 4",
    "f_one": "SELECT query_id, j, " + _sigmoid(_WEIGHT.format(n=LENGTH, w="((i * 5 + j * 3) % 7 - 3)")) + " AS h FROM f_home, range(3) t(j)",
    "f_two": "SELECT query_id, k, " + _sigmoid("sum(h * (((j * 2 + k * 3) % 5 - 2) * 1.5::DOUBLE))") + " AS h FROM f_one, range(3) t(k) GROUP BY query_id, k",
    "f_prob": "SELECT query_id, CAST(leaf_id AS BIGINT) AS leaf_id, " + _sigmoid("sum(h * (((k * 3 + d * 2) % 5 - 2) * 2.0::DOUBLE))") + f" AS probability FROM f_two, (VALUES {', '.join(f'({leaf}, {d})' for d, leaf in enumerate(LEAVES))}) t(leaf_id, d) GROUP BY query_id, leaf_id",
    "f_told": "SELECT l.query_id, l.leaf_id, lb2, bsf, size, home, pred, probability, CASE WHEN l.leaf_id = home THEN 'resident' WHEN bsf IS NULL OR lb2 < bsf THEN 'scanned' ELSE 'bound' END AS plain FROM f_lb l JOIN f_home USING (query_id) JOIN f_sizes s ON s.leaf_id = l.leaf_id LEFT JOIN f_bsf USING (query_id) LEFT JOIN f_pred p ON p.query_id = l.query_id AND p.leaf_id = l.leaf_id LEFT JOIN f_prob n ON n.query_id = l.query_id AND n.leaf_id = l.leaf_id",
    "f_visits": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY plain <> 'resident', lb2, leaf_id) AS visit FROM f_told",
    "f_budget": f"SELECT *, CASE WHEN plain = 'scanned' AND count(*) FILTER (WHERE plain <> 'bound') OVER w > {MOST_LEAVES} THEN 'budget' ELSE plain END AS state FROM f_visits WINDOW w AS (PARTITION BY query_id ORDER BY visit)",
    "f_series_budget": f"SELECT *, CASE WHEN plain = 'scanned' AND sum(size) FILTER (WHERE plain <> 'bound') OVER w > (SELECT count(*) // {MOST_SHARE} FROM series) THEN 'budget' ELSE plain END AS state FROM f_visits WINDOW w AS (PARTITION BY query_id ORDER BY visit)",
    "f_filtered": f"SELECT *, CASE WHEN plain = 'scanned' AND bsf IS NOT NULL AND greatest(0, pred - {ALPHA}::DOUBLE) > bsf THEN 'filter' ELSE plain END AS state FROM f_visits",
    "f_navigated": f"SELECT * REPLACE (v AS visit), CASE WHEN plain = 'scanned' AND count(*) FILTER (WHERE plain <> 'bound') OVER w > {MOST_LEAVES} THEN 'budget' ELSE plain END AS state FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY plain <> 'resident', probability DESC, leaf_id) AS v FROM f_visits) WINDOW w AS (PARTITION BY query_id ORDER BY v)",
    "f_truth": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id) AS rank FROM f_pairs) WHERE rank <= {K}",
}


def _answers(visits: str) -> str:
    """Answers from the leaves that a table of visits scans."""
    return f"SELECT query_id, series_id, leaf_id, rank, round(d2, 6) AS d2 FROM (SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY d2, series_id) AS rank FROM f_pairs p JOIN {visits} x ON x.query_id = p.query_id AND x.leaf_id = p.leaf_id AND x.state IN ('scanned', 'resident')) WHERE rank <= {K}"


def _found(t: Tables, **how):
    found, _ = search.exact(t.queries, index(t), K, exclude_self=True, **how)
    return rounded(found.select("query_id", "series_id", "leaf_id", "rank", "d2"), "d2")


def _seen(t: Tables, **how):
    _, visits = search.exact(t.queries, index(t), K, exclude_self=True, **how)
    return rounded(visits.select("query_id", "leaf_id", "lb2", "visit", "state"), "lb2")


_VISITS = "SELECT query_id, leaf_id, round(lb2, 6) AS lb2, visit, {1} AS state FROM {0}"


# Tree


@query("SELECT series_id, leaf_id FROM f_series")
def tree_route(t: Tables):
    """The leaf of every series, by the engine's routing over three levels."""
    return tree.assign(t.series.select("series_id", "values"), nodes()).select("series_id", "leaf_id")


@query("SELECT leaf_id, CAST(seg AS BIGINT) AS seg, n, round(min_mean, 6) AS min_mean, round(max_mean, 6) AS max_mean, round(min_std, 6) AS min_std, round(max_std, 6) AS max_std FROM f_env")
def tree_envelopes(t: Tables):
    """The engine's envelopes, of leaves with different segments."""
    held = index(t)
    rows = [(leaf, i, held.sizes[leaf], *map(float, e[2:])) for leaf, each in held.envelopes.items() for i, e in enumerate(each)]
    return rounded(t.spark.createDataFrame(rows, "leaf_id bigint, seg bigint, n bigint, min_mean double, max_mean double, min_std double, max_std double"), "min_mean", "max_mean", "min_std", "max_std")


_SPLIT_ROWS = " UNION ALL ".join(
    f"SELECT g, {c + k} AS candidate, {str(up).lower()} AS vertical, '{kind}' AS kind, {a} AS start, {m} AS len, min(mean) AS lm, max(mean) AS hm, min(std) AS ls, max(std) AS hs FROM (SELECT {{0}} AS g, {_stat(f'v[{a + 1} : {a + m}]', False)} AS mean, {_stat(f'v[{a + 1} : {a + m}]', True)} AS std FROM series) GROUP BY g"
    for seg, (a0, n0) in enumerate(_P4)
    for c, up, a, m in ((10 * seg, False, a0, n0), (10 * seg + 2, True, a0, n0 // 2), (10 * seg + 4, True, a0 + n0 // 2, n0 - n0 // 2))
    for k, kind in ((0, "mean"), (1, "std"))
)


def _best(group: str) -> str:
    gains = "SELECT *, len * ((hm - lm) * (hm - lm) + hs * hs) - CASE kind WHEN 'mean' THEN len * ((hm - lm) / 2 * ((hm - lm) / 2) + hs * hs) ELSE (len * ((hm - lm) * (hm - lm) + hs * hs) + len * ((hm - lm) * (hm - lm) + (hs - (hs - ls) / 2) * (hs - (hs - ls) / 2))) / 2 END AS gain, CASE kind WHEN 'mean' THEN lm + (hm - lm) / 2 ELSE ls + (hs - ls) / 2 END AS break_at FROM (" + _SPLIT_ROWS.replace("{0}", group) + ")"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY gain / CASE WHEN vertical THEN 2 ELSE 1 END DESC, candidate) AS r FROM ({gains})) WHERE r = 1"


@query(f"SELECT g AS leaf_id, CAST(candidate AS BIGINT) AS candidate, vertical, kind, CAST(start AS BIGINT) AS start, CAST(len AS BIGINT) AS len, round(gain, 6) AS gain, round(break_at, 6) AS break_at FROM ({_best('leaf_id')})")
def best_split_all(t: Tables):
    """The best horizontal or vertical split of each label's series."""
    found = tree.all_splits(t.series, t.parts)
    return rounded(found.select("leaf_id", "candidate", "vertical", "kind", "start", "len", "gain", "break_at"), "gain", "break_at")


@query(f"""SELECT CAST(c AS BIGINT) AS node_id, CASE WHEN c = 0 THEN NULL ELSE 0 END::BIGINT AS parent_id, CASE c WHEN 0 THEN (SELECT count(*) FROM series) WHEN 1 THEN below ELSE (SELECT count(*) FROM series) - below END AS n, CASE WHEN c = 0 THEN round(break_at, 6) END AS break_at, CASE WHEN c = 0 THEN kind = 'std' ELSE false END AS on_std, CASE WHEN c = 0 THEN start ELSE 0 END::BIGINT AS start
  FROM (SELECT s.*, (SELECT count(*) FROM (SELECT CASE s.kind WHEN 'mean' THEN {stats_sql('v[s.start + 1 : s.start + s.len]')[0]} ELSE {stats_sql('v[s.start + 1 : s.start + s.len]')[1]} END AS x FROM series) WHERE x < s.break_at) AS below FROM ({_best('1')}) s), range(3) t(c)""")
def tree_root_split(t: Tables):
    """The tree that the engine fits, stopped after its first split: the root and two leaves."""
    fitted = tree.to_frame(t.spark, tree.fit_tree(t.series, tree.TreeSettings(leaf_size=50, max_leaves=2)))
    return fitted.select("node_id", "parent_id", "n", F.round(F.when(F.size("breaks") > 0, F.col("breaks")[0]), 6).alias("break_at"), "on_std", F.col("start").cast("long").alias("start"))


# Search


@query("SELECT query_id, series_id, leaf_id, rank, round(d2, 6) AS d2 FROM f_truth")
def search_exact(t: Tables):
    return _found(t)


@query(_VISITS.format("f_visits", "plain"))
def search_visits(t: Tables):
    return _seen(t)


@query("SELECT query_id, series_id, leaf_id, rank, round(d2, 6) AS d2 FROM f_first")
def search_approximate(t: Tables):
    return _found(t, approximate=True)


@query(_VISITS.format("f_visits", "CASE WHEN plain = 'resident' THEN plain ELSE 'skipped' END"))
def search_approximate_visits(t: Tables):
    return _seen(t, approximate=True)


@query(_answers("f_budget"))
def search_budget_leaves(t: Tables):
    return _found(t, max_leaves=MOST_LEAVES)


@query(_VISITS.format("f_budget", "state"))
def search_budget_leaves_visits(t: Tables):
    return _seen(t, max_leaves=MOST_LEAVES)


@query(_answers("f_series_budget"))
def search_budget_series(t: Tables):
    return _found(t, max_series=t.series.count() // MOST_SHARE)


def _prune(t: Tables):
    return filters.pruner(fixed_filters(t), dict.fromkeys(LEAVES, ALPHA))


@query(_answers("f_filtered"))
def search_filtered(t: Tables):
    """Filtered search end to end: models, alphas, pruning and scan by the engine."""
    return _found(t, prune=_prune(t))


@query(_VISITS.format("f_filtered", "state"))
def search_filtered_visits(t: Tables):
    return _seen(t, prune=_prune(t))


@query("SELECT query_id, leaf_id, round(pred, 6) AS pred FROM f_pred")
def filter_predictions(t: Tables):
    return rounded(filters.predict(fixed_filters(t), t.queries), "pred")


@query(f"SELECT query_id, leaf_id, round(pred, 6) AS pred, round(greatest(0, pred - {ALPHA}::DOUBLE), 6) AS low, round(pred - {ALPHA}::DOUBLE, 6) AS lo, round(pred + {ALPHA}::DOUBLE, 6) AS hi FROM f_pred")
def filter_inference_variants(t: Tables):
    alphas = t.spark.createDataFrame([(leaf, ALPHA) for leaf in LEAVES], "leaf_id bigint, alpha double")
    return rounded(filters.bounds_of(filters.predict(fixed_filters(t), t.queries), alphas), "pred", "low", "lo", "hi")


@query("SELECT query_id, leaf_id, round(probability, 6) AS probability FROM f_prob")
def navigator_probabilities(t: Tables):
    return rounded(training.navigator_probabilities(navigator(), t.queries), "probability")


@query(_answers("f_navigated"))
def search_navigated(t: Tables):
    """Search in the order of a navigator's own probabilities, with a budget."""
    return _found(t, order=training.Navigated(navigator()), max_leaves=MOST_LEAVES)


@query(_VISITS.format("f_navigated", "state"))
def search_navigated_visits(t: Tables):
    return _seen(t, order=training.Navigated(navigator()), max_leaves=MOST_LEAVES)


_SEEN = "plain IN ('scanned', 'resident')"


@query(f"SELECT query_id, count(*) FILTER (WHERE {_SEEN}) AS visited_leaves, coalesce(sum(size) FILTER (WHERE {_SEEN}), 0)::BIGINT AS visited_series, count(*) FILTER (WHERE NOT {_SEEN}) AS pruned_leaves, coalesce(sum(size) FILTER (WHERE NOT {_SEEN}), 0)::BIGINT AS pruned_series, round(count(*) FILTER (WHERE NOT {_SEEN}) / count(*)::DOUBLE, 6) AS pruning_ratio FROM f_visits GROUP BY ROLLUP (query_id)")
def search_statistics(t: Tables):
    """Visit counters of the engine's own search."""
    held = index(t)
    _, visits = search.exact(t.queries, held, K, exclude_self=True)
    sizes = t.spark.createDataFrame(list(held.sizes.items()), "leaf_id bigint, size bigint")
    return rounded(reports.leaf_statistics(visits.join(sizes, "leaf_id")), "pruning_ratio")


_F_RECALL = f"SELECT x.query_id, count(a.series_id) / {K}.0::DOUBLE AS recall FROM f_truth x LEFT JOIN ({_answers('f_filtered')}) a ON a.query_id = x.query_id AND a.series_id = x.series_id GROUP BY x.query_id"


@query(f"SELECT query_id, recall FROM ({_F_RECALL})")
def search_filtered_recall(t: Tables):
    """The self check: filtered against exact search in one run."""
    held = index(t)
    truth, _ = search.exact(t.queries, held, K, exclude_self=True)
    found, _ = search.exact(t.queries, held, K, exclude_self=True, prune=_prune(t))
    return reports.recall_by_query(truth, found, K)


# Bounds, distances and text


@query("SELECT q.series_id AS query_id, e.leaf_id, round(sum(e.len * (pow(greatest(abs(mean - min_mean), abs(mean - max_mean)), 2) + pow(std + max_std, 2))), 6) AS ub2 FROM seg q JOIN env e ON q.seg = e.seg WHERE q.series_id % 50 = 0 GROUP BY q.series_id, e.leaf_id")
def upper_bound(t: Tables):
    own = summaries.eapca(t.queries, "query_id", parts=t.parts)
    return rounded(summaries.upper_bounds(own, t.envelopes()), "ub2")


@query("SELECT query_id, series_id, CASE WHEN d2 <= 1.8 THEN round(d2, 6) END AS d2 FROM pairs WHERE leaf_id = home")
def sq_euclidean_abandoned(t: Tables):
    """Distances within a label, null as soon as they exceed a limit."""
    from seriesgrove.functions import series as fn

    home = t.series.select(F.col("series_id").alias("query_id"), F.col("leaf_id"))
    pairs = t.queries.withColumnRenamed("values", "q").join(home, "query_id").join(t.series, "leaf_id").where("query_id <> series_id")
    return pairs.select("query_id", "series_id", F.round(fn.sq_euclidean_within("q", "values", F.lit(1.8)), 6).alias("d2"))


@query("SELECT query_id, leaf_id, '[' || format('{:.6f}', round(pred, 3) - 0.2::DOUBLE) || ', ' || format('{:.6f}', round(pred, 3) + 0.2::DOUBLE) || ']' AS interval FROM preds")
def interval_text(t: Tables):
    from seriesgrove.functions import series as fn

    return t.predictions().select("query_id", "leaf_id", fn.interval_text(F.round("pred", 3), F.lit(0.2)).alias("interval"))


@query("SELECT count(DISTINCT leaf_id) AS filters, count(DISTINCT CASE WHEN leaf_id % 3 <> 0 THEN leaf_id END) AS active FROM sizes")
def filter_counts(t: Tables):
    made = filters.initialise(t.sizes(), "mlp_2_8").withColumn("weights", F.array(F.lit(1.0)))
    return filters.active_count(filters.activate(made, t.sizes().select("leaf_id", (F.col("leaf_id") % 3 != 0).alias("active"))))


@query("SELECT leaf_id, 'mlp_2_8' AS model, leaf_id % 3 <> 0 AND leaf_id <> 7 AS active FROM sizes")
def filters_deactivated(t: Tables):
    """Filters of all leaves, some active, one of them switched off for training."""
    made = filters.initialise(t.sizes(), "mlp_2_8").withColumn("weights", F.array(F.lit(1.0)))
    on = filters.activate(made, t.sizes().select("leaf_id", (F.col("leaf_id") % 3 != 0).alias("active")))
    return filters.deactivate(on, t.sizes().where("leaf_id = 7")).select("leaf_id", "model", "active")


# Examples with more than one neighbour


@query(f"""SELECT e.query_id, e.leaf_id, e.visit, (SELECT round(d2, 6) FROM (SELECT d2, row_number() OVER (ORDER BY d2) AS r FROM pairs p JOIN ex b ON b.query_id = p.query_id AND b.leaf_id = p.leaf_id WHERE b.query_id = e.query_id AND b.visit < e.visit) WHERE r = {K}) AS bsf FROM ex e""")
def bsf_of_k(t: Tables):
    """The k-th best so far before every visit."""
    nearest = training.leaf_nearest(t.queries, t.series, k=K).withColumn("lnn", F.round("lnn", 6))
    return rounded(training.examples(nearest, t.bounds(), K).select("query_id", "leaf_id", "visit", "bsf"), "bsf")


# Calibration and wide reports


@query(f"""SELECT batch_id, query_id, list(recall ORDER BY error_i) AS recalls FROM (
  SELECT b.batch_id, b.query_id, i.error_i, sum(CASE WHEN a.alpha IS NULL OR p.bsf IS NULL OR p.pred - a.alpha <= p.bsf THEN coalesce(k.n, 0) ELSE 0 END)::DOUBLE / {K}.0::DOUBLE AS recall
  FROM batches b LEFT JOIN knn k ON k.query_id = b.query_id LEFT JOIN pex p ON p.query_id = b.query_id AND p.leaf_id = k.leaf_id CROSS JOIN (SELECT DISTINCT error_i FROM alphas) i
  LEFT JOIN alphas a ON a.leaf_id = k.leaf_id AND a.batch_id = b.batch_id AND a.error_i = i.error_i GROUP BY b.batch_id, b.query_id, i.error_i) GROUP BY batch_id, query_id""")
def query_recall_by_batch(t: Tables):
    return reports.along(calibration.query_recall(t.batches(), t.knn(), t.predicted(), t.alphas(), K), ["batch_id", "query_id"], "error_i", "recall")


_PAIRED = "SELECT batch_id, error_i, recall, cume_dist() OVER (PARTITION BY error_i ORDER BY recall DESC) AS coverage FROM recalls"


@query(f"SELECT batch_id, list(round(recall, 6) ORDER BY error_i) AS recalls, list(round(coverage, 6) ORDER BY error_i) AS coverages FROM ({_PAIRED}) GROUP BY batch_id")
def recall_coverage_wide(t: Tables):
    """Recall and coverage of each batch by place, all places."""
    return reports.along(rounded(calibration.recall_coverage(t.recalls()), "recall", "coverage"), ["batch_id"], "error_i", "recall", "coverage")


@query(f"SELECT leaf_id, batch_id, list(round(recall, 6) ORDER BY error_i) AS recalls, list(round(coverage, 6) ORDER BY error_i) AS coverages, list(alpha ORDER BY error_i) AS alphas FROM alphas JOIN ({_PAIRED}) USING (batch_id, error_i) GROUP BY leaf_id, batch_id")
def filter_error_summary(t: Tables):
    """Of each filter and batch: recall, coverage and alpha by place."""
    told = reports.filter_summary(rounded(calibration.recall_coverage(t.recalls()), "recall", "coverage"), t.alphas())
    return reports.along(told, ["leaf_id", "batch_id"], "error_i", "recall", "coverage", "alpha")


@query(f"SELECT leaf_id, error_i, list(round(recall, 6) ORDER BY batch_id) AS recalls, list(alpha ORDER BY batch_id) AS alphas FROM alphas JOIN ({_PAIRED}) USING (batch_id, error_i) GROUP BY leaf_id, error_i")
def filter_recall_summary(t: Tables):
    """Of each filter and place: recall and alpha by batch."""
    told = reports.filter_summary(rounded(calibration.recall_coverage(t.recalls()), "recall", "coverage"), t.alphas())
    return reports.along(told, ["leaf_id", "error_i"], "batch_id", "recall", "alpha")


@query("SELECT leaf_id, 'TYPE_SIZE=8' || chr(10) || 'NUM_BATCHES=' || count(*) || chr(10) || string_agg('BATCH_' || i || '_SIZE=' || n || chr(10) || s, chr(10) ORDER BY batch_id) AS text FROM (SELECT leaf_id, batch_id, row_number() OVER (PARTITION BY leaf_id ORDER BY batch_id) - 1 AS i, count(*) AS n, string_agg(CAST(round(alpha * 1000)::BIGINT AS VARCHAR) || '.0', chr(10) ORDER BY error_i) AS s FROM alphas GROUP BY leaf_id, batch_id) GROUP BY leaf_id")
def alphas_as_text(t: Tables):
    from seriesgrove.sources import index_store

    whole = t.alphas().withColumn("alpha", F.round(F.col("alpha") * 1000).cast("long").cast("double"))  # whole numbers are written alike by all engines
    return index_store.alphas_text(whole)


_ONE = "SELECT error_i, avg(recall) AS recall FROM recalls GROUP BY error_i"
_LIFTED = f"SELECT error_i, min(recall - error_i * 1e-4) OVER (ORDER BY error_i DESC) + error_i * 1e-4 AS x FROM ({_ONE})"


@query(f"""WITH p AS (SELECT leaf_id, x, y, coalesce((sign(s0) + sign(s1)) * least(abs(s0), abs(s1), 0.5 * abs((s0 * h1 + s1 * h0) / (h0 + h1))), s1, s0) AS m FROM (
    SELECT *, (y1 - y) / h1 AS s1, (y - y0) / h0 AS s0 FROM (SELECT leaf_id, x, y, lead(x) OVER w - x AS h1, x - lag(x) OVER w AS h0, lead(y) OVER w AS y1, lag(y) OVER w AS y0 FROM (
      SELECT a.leaf_id, r.x, a.y FROM (SELECT leaf_id, error_i, max(alpha) AS y FROM alphas GROUP BY leaf_id, error_i) a JOIN ({_LIFTED}) r USING (error_i)) WINDOW w AS (PARTITION BY leaf_id ORDER BY x)))),
  v AS (SELECT leaf_id, y * (1 + 2 * t) * (1 - t) * (1 - t) + m * h * t * (1 - t) * (1 - t) + y1 * t * t * (3 - 2 * t) + m1 * h * t * t * (t - 1) AS value FROM (
    SELECT *, x1 - x AS h, (0.9 - x) / (x1 - x) AS t FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(m) OVER w AS m1 FROM p WINDOW w AS (PARTITION BY leaf_id ORDER BY x)) WHERE x <= 0.9 AND x1 > 0.9))
  SELECT e.leaf_id, round(CASE WHEN low > 0.9 THEN 0 WHEN value IS NULL THEN largest ELSE greatest(0, value) END, 6) AS alpha FROM (SELECT leaf_id, min(x) AS low, max(y) AS largest FROM p GROUP BY leaf_id) e LEFT JOIN v USING (leaf_id)""")
def alpha_by_recall_spline(t: Tables):
    """Calibration to a recall through the spline."""
    recalls = t.recalls().groupBy("error_i").agg(F.avg("recall").alias("recall"))
    return rounded(calibration.alpha_by_recall_spline(recalls, calibration.largest_alphas(t.alphas()), 0.9), "alpha")


@query("SELECT leaf_id, round(greatest(0, 0.1::DOUBLE + leaf_id * 0.01::DOUBLE * 0.9 + CASE WHEN leaf_id % 3 = 0 THEN 0.3::DOUBLE * 0.8 ELSE 0 END + CASE WHEN leaf_id % 3 = 1 THEN 0.2::DOUBLE * exp(-(0.4 * 0.4 + 0.3 * 0.3) / 0.125) - leaf_id * 0.01::DOUBLE * 0.9 ELSE 0 END), 6) AS alpha FROM sizes")
def bivariate_alphas(t: Tables):
    """Linear and kernel fits with fixed coefficients, evaluated at a recall and a coverage."""
    leaf = F.col("leaf_id")
    surface = F.array(F.lit(0.1), leaf * 0.01, F.when(leaf % 3 == 0, 0.3).otherwise(0.0), F.lit(0.0), F.lit(0.0))
    kernel = F.array(F.lit(0.1), F.lit(0.2))
    centres = F.array(F.struct(F.lit(0.5).alias("r"), F.lit(0.5).alias("c"), F.lit(0.25).alias("width")))
    fits = t.sizes().select("leaf_id", F.when(leaf % 3 == 1, "kernel").otherwise("linear").alias("kind"), F.when(leaf % 3 == 1, kernel).otherwise(surface).alias("coefficients"), centres.alias("centres"))
    return rounded(calibration.bivariate_alphas(fits, 0.9, 0.8), "alpha")


# Allocation


@query("SELECT leaf_id, sum(memory_mb) OVER w AS used_mb, sum(memory_mb) OVER w <= 3 AS active FROM (SELECT leaf_id, size, 0.5::DOUBLE + (leaf_id % 3) * 0.25 AS memory_mb FROM sizes WHERE leaf_id % 2 = 0) WINDOW w AS (ORDER BY size DESC, leaf_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def reassigned_by_size(t: Tables):
    """Reassignment on a loaded index: no gain above 0, so by size, and only leaves whose filters have weights."""
    made = filters.initialise(t.sizes(), "mlp_2_8").withColumn("memory_mb", 0.5 + (F.col("leaf_id") % 3) * 0.25)
    made = made.withColumn("weights", F.when(F.col("leaf_id") % 2 == 0, F.array(F.lit(1.0))))
    leaves = t.sizes().withColumn("gain", F.lit(-1.0))
    return allocation.reassign(leaves, made, 3.0).select("leaf_id", "used_mb", "active")
