"""Queries over the `embeddings` table, each an operator of this package, and their SQL.

Series are the embeddings, leaves their labels, queries all rows whose id is
divisible by 50, each searched against all rows but itself. Where a learned
prediction is needed, one and a half times the squared distance to the leaf's
centroid stands in for it, so that results can be compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesgrove.functions import series as fn
from seriesgrove.operators import calibration, search, summaries, training, tree
from seriesgrove.operators.lineage import cut

LENGTH, SEGMENTS, K, EVERY = 64, 4, 5, 50
BATCHES, PARTS, TAKE, TARGET, COVERAGE = 3, 4, 2, 0.9, 0.6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """What the queries share, made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.series = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("series_id"), F.col("label").cast("long").alias("leaf_id"), F.col("embedding").alias("values"))
        self.queries = self.series.where(F.col("series_id") % EVERY == 0).select(F.col("series_id").alias("query_id"), "values")
        self.parts = fn.segments(LENGTH, SEGMENTS)
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What several parts of a query read is worked out once."""
        if name not in self._made:
            self._made[name] = cut(make())
        return self._made[name]

    def summaries(self) -> DataFrame:
        return summaries.eapca(self.series, parts=self.parts).join(self.series.select("series_id", "leaf_id"), "series_id")

    def envelopes(self) -> DataFrame:
        return summaries.envelopes(self.summaries())

    def bounds(self) -> DataFrame:
        own = summaries.eapca(self.queries, "query_id", parts=self.parts)
        return summaries.lower_bounds(own, self.envelopes()).withColumn("lb2", F.round("lb2", 6))

    def nearest(self) -> DataFrame:
        return training.leaf_nearest(self.queries, self.series).select("query_id", "leaf_id", F.round("lnn", 6).alias("lnn"))

    def examples(self) -> DataFrame:
        return training.examples(self.nearest(), self.bounds())

    def predictions(self) -> DataFrame:
        cells = self.series.select("leaf_id", F.posexplode("values").alias("i", "x")).groupBy("leaf_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        centres = cells.groupBy("leaf_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c"))
        return self.queries.crossJoin(centres).select("query_id", "leaf_id", F.round(1.5 * fn.sq_euclidean("values", "c"), 6).alias("pred"))

    def predicted(self) -> DataFrame:
        return self._once("predicted", lambda: self.examples().join(self.predictions(), ["query_id", "leaf_id"]))

    def sizes(self) -> DataFrame:
        return self.series.groupBy("leaf_id").agg(F.count("*").alias("size"))

    def truth(self) -> DataFrame:
        return search.brute_force(self.queries, self.series, K, exclude_self=True)

    def approximate(self) -> DataFrame:
        """The best of each query's own label."""
        home = self.series.select(F.col("series_id").alias("query_id"), F.col("leaf_id").alias("home"))
        pairs = self.queries.join(home, "query_id").select("query_id", "home", F.col("values").alias("q")).join(self.series, F.col("home") == F.col("leaf_id")).where("query_id <> series_id")
        return search.top_k(pairs.select("query_id", "series_id", "leaf_id", fn.sq_euclidean("q", "values").alias("d2")), K)

    def batches(self) -> DataFrame:
        return calibration.uniform_batches(self.queries, BATCHES)

    def errors(self) -> DataFrame:
        """leaf_id, batch_id, error with sentinels."""
        told = calibration.residuals(self.predicted()).join(self.batches(), "query_id")
        return calibration.with_sentinels(told, ["leaf_id", "batch_id"]).withColumn("error", F.round("error", 6))

    def alphas(self) -> DataFrame:
        return self._once("alphas", lambda: calibration.sorted_alphas(self.errors(), ["leaf_id", "batch_id"]))

    def knn(self) -> DataFrame:
        return self._once("knn", lambda: training.knn_leaves(self.truth()))

    def recalls(self) -> DataFrame:
        return self._once("recalls", lambda: calibration.batch_recall(self.batches(), self.knn(), self.predicted(), self.alphas(), K))

    def visits(self) -> DataFrame:
        """query_id, leaf_id, lb2, visit, size, state by the bound of the approximate answers."""
        best = search.kth(self.approximate(), K)
        home = self.series.select(F.col("series_id").alias("query_id"), F.col("leaf_id").alias("home"))
        rows = tree.visit_order(self.bounds()).join(best, "query_id", "left").join(home, "query_id").join(self.sizes(), "leaf_id")
        state = F.when(F.col("leaf_id") == F.col("home"), "resident").when(F.col("bsf").isNull() | (F.col("lb2") < F.col("bsf")), "scanned").otherwise("bound")
        return rows.withColumn("state", state)

    def told(self) -> DataFrame:
        """batch_id, error_i, query_id, leaf_id, n, pruned, has_filter."""
        rows = self.batches().join(self.predicted(), "query_id").join(self.alphas(), ["leaf_id", "batch_id"]).join(self.knn(), ["query_id", "leaf_id"], "left")
        pruned = F.coalesce(F.col("pred") - F.col("alpha") > F.col("bsf"), F.lit(False))
        return rows.select("batch_id", "error_i", "query_id", "leaf_id", F.coalesce("n", F.lit(0)).alias("n"), pruned.alias("pruned"), (F.col("leaf_id") % 3 != 0).alias("has_filter"))


def d2_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def stats_sql(values: str) -> tuple[str, str]:
    return f"list_avg(({values})::DOUBLE[])", f"list_aggregate(({values})::DOUBLE[], 'stddev_pop')"


_MEAN, _STD = stats_sql("v[s * 16 + 1 : s * 16 + 16]")
#: Common tables of the SQL, in order; a query takes those it names and what they need.
PARTS_SQL = {
    "series": "SELECT vec_id AS series_id, CAST(label AS BIGINT) AS leaf_id, embedding AS v FROM embeddings",
    "queries": f"SELECT series_id AS query_id, leaf_id AS home, v AS q FROM series WHERE series_id % {EVERY} = 0",
    "pairs": f"SELECT query_id, home, series_id, leaf_id, {d2_sql('q', 'v')} AS d2 FROM queries, series WHERE query_id <> series_id",
    "seg": f"SELECT series_id, leaf_id, CAST(s AS BIGINT) AS seg, CAST(s * 16 AS BIGINT) AS start, CAST(16 AS BIGINT) AS len, {_MEAN} AS mean, {_STD} AS std FROM series, range(4) t(s)",
    "env": "SELECT leaf_id, seg, start, len, min(mean) AS min_mean, max(mean) AS max_mean, min(std) AS min_std, max(std) AS max_std, count(*) AS n FROM seg GROUP BY leaf_id, seg, start, len",
    "lb": f"SELECT q.series_id AS query_id, e.leaf_id, round(sum(e.len * (pow(greatest(0, min_mean - mean, mean - max_mean), 2) + pow(greatest(0, min_std - std, std - max_std), 2))), 6) AS lb2 FROM seg q JOIN env e ON q.seg = e.seg WHERE q.series_id % {EVERY} = 0 GROUP BY q.series_id, e.leaf_id",
    "lnn": "SELECT query_id, leaf_id, round(min(d2), 6) AS lnn FROM pairs GROUP BY query_id, leaf_id",
    "ex": "SELECT query_id, leaf_id, lb2, lnn, row_number() OVER w AS visit, min(lnn) OVER (PARTITION BY query_id ORDER BY lb2, leaf_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bsf FROM lnn JOIN lb USING (query_id, leaf_id) WINDOW w AS (PARTITION BY query_id ORDER BY lb2, leaf_id)",
    "centres": "SELECT leaf_id, list(m ORDER BY i) AS c FROM (SELECT leaf_id, i, avg(v[i]::DOUBLE) AS m FROM series, range(1, 65) t(i) GROUP BY leaf_id, i) GROUP BY leaf_id",
    "preds": f"SELECT query_id, leaf_id, round(1.5 * {d2_sql('q', 'c')}, 6) AS pred FROM queries, centres",
    "pex": "SELECT * FROM ex JOIN preds USING (query_id, leaf_id)",
    "sizes": "SELECT leaf_id, count(*) AS size FROM series GROUP BY leaf_id",
    "truth": f"SELECT * FROM (SELECT query_id, series_id, leaf_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id) AS rank FROM pairs) WHERE rank <= {K}",
    "approx": f"SELECT * FROM (SELECT query_id, series_id, leaf_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id) AS rank FROM pairs WHERE home = leaf_id) WHERE rank <= {K}",
    "knn": "SELECT query_id, leaf_id, count(DISTINCT series_id) AS n FROM truth GROUP BY query_id, leaf_id",
    "placed": "SELECT query_id, row_number() OVER (ORDER BY (query_id * 7919 + 104729 + 12345) % 10007, query_id) - 1 AS p, count(*) OVER () AS n FROM queries",
    "batches": f"SELECT query_id, CAST(least(p // greatest(1, n // greatest(1, least({BATCHES}, n // 3))), greatest(1, least({BATCHES}, n // 3)) - 1) AS BIGINT) AS batch_id FROM placed",
    "res": "SELECT p.*, batch_id, abs(pred - lnn) AS error FROM pex p JOIN batches USING (query_id) WHERE pred <> 0 AND pred > -1e6 AND pred < 1e6",
    "top": "SELECT leaf_id, batch_id, greatest(avg(error) + 3 * stddev_pop(error) + 1e-4, max(error) + 1e-4) AS error FROM res GROUP BY leaf_id, batch_id",
    "errors": "SELECT leaf_id, batch_id, round(error, 6) AS error FROM (SELECT leaf_id, batch_id, error FROM res UNION ALL SELECT leaf_id, batch_id, error FROM top UNION ALL SELECT leaf_id, batch_id, 0.0 FROM top)",
    "alphas": "SELECT leaf_id, batch_id, error_i, alpha FROM (SELECT leaf_id, batch_id, row_number() OVER (PARTITION BY leaf_id, batch_id ORDER BY error) - 1 AS error_i, error AS alpha, count(*) OVER (PARTITION BY leaf_id, batch_id) AS c FROM errors) WHERE c >= 3",
    "recalls": f"""SELECT h.batch_id, error_i, hits / ({K}.0::DOUBLE * q) AS recall FROM (
        SELECT b.batch_id, i.error_i, sum(CASE WHEN a.alpha IS NULL OR p.bsf IS NULL OR p.pred - a.alpha <= p.bsf THEN coalesce(k.n, 0) ELSE 0 END)::DOUBLE AS hits
        FROM batches b LEFT JOIN knn k ON k.query_id = b.query_id LEFT JOIN pex p ON p.query_id = b.query_id AND p.leaf_id = k.leaf_id CROSS JOIN (SELECT DISTINCT error_i FROM alphas) i
        LEFT JOIN alphas a ON a.leaf_id = k.leaf_id AND a.batch_id = b.batch_id AND a.error_i = i.error_i GROUP BY b.batch_id, i.error_i) h
        JOIN (SELECT batch_id, count(DISTINCT query_id) AS q FROM batches GROUP BY batch_id) s ON s.batch_id = h.batch_id""",
    "best": f"SELECT query_id, CASE WHEN count(*) >= {K} THEN max(d2) END AS bsf FROM approx GROUP BY query_id",
    "visits": "SELECT lb.query_id, lb.leaf_id, lb2, row_number() OVER (PARTITION BY lb.query_id ORDER BY lb2, lb.leaf_id) AS visit, size, CASE WHEN lb.leaf_id = home THEN 'resident' WHEN bsf IS NULL OR lb2 < bsf THEN 'scanned' ELSE 'bound' END AS state FROM lb JOIN queries USING (query_id) LEFT JOIN best USING (query_id) JOIN sizes ON sizes.leaf_id = lb.leaf_id",
    "told": "SELECT b.batch_id, a.error_i, b.query_id, p.leaf_id, coalesce(k.n, 0) AS n, coalesce(p.pred - a.alpha > p.bsf, false) AS pruned, p.leaf_id % 3 <> 0 AS has_filter FROM batches b JOIN pex p ON p.query_id = b.query_id JOIN alphas a ON a.leaf_id = p.leaf_id AND a.batch_id = b.batch_id LEFT JOIN knn k ON k.query_id = p.query_id AND k.leaf_id = p.leaf_id",
    "gains": "SELECT leaf_id, seg, start, len, seg * 2 + k AS candidate, CASE k WHEN 0 THEN 'mean' ELSE 'std' END AS kind, CASE k WHEN 0 THEN len * (w * w + max_std * max_std) - len * (w / 2 * (w / 2) + max_std * max_std) ELSE len * (w * w + max_std * max_std) - (len * (w * w + max_std * max_std) + len * (w * w + (max_std - (max_std - min_std) / 2) * (max_std - (max_std - min_std) / 2))) / 2 END AS gain, CASE k WHEN 0 THEN min_mean + w / 2 ELSE min_std + (max_std - min_std) / 2 END AS break_at FROM (SELECT *, max_mean - min_mean AS w FROM env), range(2) t(k)",
    "splits": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY gain DESC, candidate) AS r FROM gains) WHERE r = 1",
}


def with_parts(sql: str) -> str:
    """The query after the common tables that it needs."""
    needed, names = set(), list(PARTS_SQL)
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in names:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                todo.append(PARTS_SQL[name])
    held = ", ".join(f"{n} AS ({PARTS_SQL[n]})" for n in names if n in needed and f"{n} AS (SELECT" not in sql)  # the SQL of another query has its own
    if not held:
        return sql
    return f"WITH {held}, {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {held} {sql}"


def query(sql: str | None = None):
    """Registers a function of Tables as a query of its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_parts(sql)
        return f

    return register


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})
