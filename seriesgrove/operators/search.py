"""Nearest-neighbour search: brute force, resident leaf, exact over an index, budgets, filters, learned order.

All queries of a block are answered in one pass over the members: each task
keeps the best k of what it reads for each query, and only those are shuffled.
A block has at most `BLOCK` queries, so what is sent to the tasks does not grow
with the data; more queries are answered block by block.

Over an index, the first pass scans each query's resident leaf. Its k-th distance
is the best so far, one number a query, with which the second pass decides in the
tasks, leaf by leaf, which queries still want it. Only budgets and a learned
order need the places of all leaves; these are worked out in tasks, too, by a
few queries at a time, and only the leaves that are to be scanned come back.

Series that are null or hold a null have no distance to anything: brute_force()
and build() leave them out, and search refuses queries like that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesgrove.functions import series as fn
from seriesgrove.operators import tree

BLOCK = 4096
ANSWERS = "query_id bigint, series_id bigint, leaf_id bigint, d2 double"


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with their rank, from 1; ties go to the lower id."""
    w = Window.partitionBy("query_id").orderBy("d2", "series_id")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def kth(answers: DataFrame, k: int) -> DataFrame:
    """query_id and bsf, the k-th distance: null while there are fewer than k answers."""
    return answers.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("d2")).alias("bsf"))


def distances(queries: DataFrame, series: DataFrame, exclude_self: bool = False) -> DataFrame:
    """query_id, series_id, d2 of all pairs, as one declarative plan."""
    pairs = queries.select("query_id", F.col("values").alias("_q")).crossJoin(series.select("series_id", "values"))
    pairs = pairs.where("query_id <> series_id") if exclude_self else pairs
    return pairs.select("query_id", "series_id", fn.sq_euclidean("_q", "values").alias("d2"))


#: Which queries (by place) want a leaf, from a leaf: None for all.
Wanted = Callable[[int], np.ndarray]


def _scan(queries: np.ndarray, query_ids: np.ndarray, k: int, exclude_self: bool, wanted: Wanted | None, chunk: int = 2048):
    """For batches (series_id, leaf_id, values): each query's best k of a task. wanted: the queries of each leaf, or all."""

    def merge(best, q, ids, leaves, d):
        if q in best:
            ids, leaves, d = np.append(best[q][0], ids), np.append(best[q][1], leaves), np.append(best[q][2], d)
        at = np.lexsort((ids, d))[:k]
        best[q] = ids[at], leaves[at], d[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        asked: dict[int, np.ndarray] = {}
        norms = (queries * queries).sum(axis=1)
        for batch in batches:
            all_ids, all_leaves, all_x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), tree.matrix(batch.column(2))
            if wanted is None:
                groups = [(None, np.arange(len(all_ids)))]
            else:
                order = np.argsort(all_leaves, kind="stable")
                leaves, begins = np.unique(all_leaves[order], return_index=True)
                groups = list(zip(leaves.tolist(), np.split(order, begins[1:]), strict=True))
            for leaf, rows in groups:
                if leaf is not None and leaf not in asked:
                    asked[leaf] = wanted(leaf)
                own = np.arange(len(queries)) if leaf is None else asked[leaf]
                if not len(own):
                    continue
                for lo in range(0, len(rows), chunk):
                    part = rows[lo : lo + chunk]
                    ids, leaves, x = all_ids[part], all_leaves[part], all_x[part]
                    rough = norms[own][:, None] + (x * x).sum(axis=1)[None, :] - 2 * queries[own] @ x.T
                    slack = 1e-9 * (1 + np.abs(rough).max(axis=1, initial=0))
                    for i, q in enumerate(own.tolist()):
                        d = rough[i]
                        limit = np.inf if len(d) <= k + 1 else np.partition(d, k)[k] + slack[i]  # one more, for the query itself
                        if q in best and len(best[q][2]) == k:
                            limit = min(limit, best[q][2][-1] + slack[i])
                        at = np.flatnonzero(d <= limit)
                        if exclude_self:
                            at = at[ids[at] != query_ids[q]]
                        if len(at):
                            merge(best, q, ids[at], leaves[at], ((x[at] - queries[q]) ** 2).sum(axis=1))
        for q, (ids, leaves, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query_ids[q])), pa.array(ids), pa.array(leaves), pa.array(d)], names=["query_id", "series_id", "leaf_id", "d2"])

    return run


def blocks(queries: DataFrame, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and values of the queries, at most `size` at once, in order of a hash; where there are more, each block reads its own share."""
    size = size or BLOCK
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), "values")
    n = rows.count()
    parts = -(-n // max(1, size // 2)) if n > size else 1
    for i in range(parts):
        table = (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).toArrow()
        if not table.num_rows:
            continue
        order = np.argsort(table["query_id"].to_numpy())
        ids, x = table["query_id"].to_numpy()[order], tree.matrix(table["values"])[order]
        for lo in range(0, len(ids), size):
            yield ids[lo : lo + size], x[lo : lo + size]


def _all(made: list[DataFrame], spark, schema: str = ANSWERS) -> DataFrame:
    out = spark.createDataFrame([], schema) if not made else made[0]
    for frame in made[1:]:
        out = out.unionByName(frame)
    return out


def scan(members: DataFrame, ids: np.ndarray, x: np.ndarray, k: int, exclude_self: bool = False, wanted: Wanted | None = None, leaves: list[int] | None = None) -> DataFrame:
    """The best k of each task; only the listed leaves are read, where files or cached rows are ordered by leaf."""
    leaf = F.col("leaf_id") if "leaf_id" in members.columns else F.lit(0)
    rows = members if leaves is None else members.where(leaf.isin(leaves))
    return rows.select(F.col("series_id").cast("long"), leaf.cast("long").alias("leaf_id"), "values").mapInArrow(_scan(x, ids, k, exclude_self, wanted), ANSWERS)


def brute_force(queries: DataFrame, series: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """query_id, series_id, leaf_id, d2, rank: true nearest neighbours, without any bound."""
    series = tree.regular(series)
    made = [scan(series, ids, x, k, exclude_self) for ids, x in blocks(queries)]
    return top_k(_all(made, series.sparkSession), k)


@dataclass
class Index:
    """A fitted tree, its members (series_id, values, leaf_id) and, by leaf with members, their number and envelopes.

    What grows with the data is in members alone: there are at most max_leaves leaves. Series may carry a summary of
    their own in `sketch`, which then routes and bounds them in place of the values.
    """

    nodes: list[tree.Node]
    members: DataFrame
    envelopes: dict[int, np.ndarray]
    sizes: dict[int, int]
    sketched: bool = False

    @property
    def leaves(self) -> list[int]:
        return sorted(self.envelopes)

    def close(self) -> None:
        """Gives back what is held of the members."""
        self.members.unpersist()


def build(series: DataFrame, settings: tree.TreeSettings = tree.TreeSettings(), nodes: list[tree.Node] | None = None) -> Index:
    """Fits a tree, unless its nodes are given, routes every row and takes the envelopes of all rows.

    Members are held in the order of their leaves until close(), so that searches read the leaves that they want and
    nothing is routed twice. Save the index and load it for members that outlive the session.
    """
    sketched = "sketch" in series.columns
    by = "sketch" if sketched else "values"
    series = tree.regular(series, by).select("series_id", "values", *(["sketch"] if sketched else []))
    nodes = tree.fit_tree(series, settings, values=by) if nodes is None else nodes
    members = tree.assign(tree.regular(series), nodes, by)
    n = max(1, min(sum(node.is_leaf for node in nodes), int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    members = members.repartitionByRange(n, "leaf_id", "series_id").sortWithinPartitions("leaf_id").persist()
    envelopes, sizes = tree.leaf_envelopes(members, nodes, by)
    return Index(nodes, members, envelopes, sizes, sketched)


@dataclass(frozen=True)
class Limits:
    """Where a search stops: after so many scanned leaves, or before the leaf that would make it more than so many series. The first leaf is always scanned."""

    leaves: int | None = None
    series: int | None = None

    @property
    def any(self) -> bool:
        return self.leaves is not None or self.series is not None


#: Queries whose bounds to all leaves are held at once by a task.
CHUNK = 128
#: (query, leaf) pairs with a budget or a learned order that may come back from the tasks for a block.
PAIRS = 1 << 22
VISITS = "query_id bigint, leaf_id bigint, lb2 double, visit bigint, state string"
STATES = np.array(["resident", "scanned", "bound", "filter", "budget", "skipped"])
RESIDENT, SCANNED, BOUND, FILTER, BUDGET, SKIPPED = range(6)

Prune = Callable[[np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]
Order = Callable[[np.ndarray, list[int], np.ndarray], np.ndarray]


def _states(x: np.ndarray, s: np.ndarray, home: np.ndarray, bsf: np.ndarray, index: tuple, prune: Prune | None, order: Order | None, limits: Limits, approximate: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lb2, place (from 0) and state of each query (a row) and leaf (a column): x are values, s what the bounds are taken of."""
    leaves, envelopes, sizes = index
    lb = np.stack([tree.bound(s, envelopes[leaf]) for leaf in leaves], axis=1) if leaves else np.zeros((len(x), 0))
    state = np.where(lb < bsf[:, None], SCANNED, BOUND)
    if prune is not None:
        for j, leaf in enumerate(leaves):
            rows = np.flatnonzero((state[:, j] == SCANNED) & np.isfinite(bsf))
            if len(rows):
                state[rows[prune(x[rows], leaf, lb[rows, j], bsf[rows])], j] = FILTER
    at = np.array(leaves, np.int64)
    own = at[None, :] == home[:, None]
    state[own] = RESIDENT
    if approximate:
        state[~own] = SKIPPED
    score = lb if order is None else -order(x, leaves, lb)
    ranked = np.lexsort((np.broadcast_to(at, lb.shape), score, ~own), axis=1) if lb.size else np.zeros(lb.shape, int)
    if limits.any and lb.size:
        seen = np.take_along_axis(state <= SCANNED, ranked, axis=1)
        stop = np.zeros(seen.shape, bool)
        if limits.leaves is not None:
            stop |= np.cumsum(seen, axis=1) > limits.leaves
        if limits.series is not None:
            stop |= np.cumsum(np.where(seen, np.array([sizes[leaf] for leaf in leaves])[ranked], 0), axis=1) > limits.series
        stop &= np.cumsum(seen, axis=1) > 1
        back = np.empty_like(stop)
        np.put_along_axis(back, ranked, stop, axis=1)
        state[back & (state <= SCANNED)] = BUDGET
    return lb, np.argsort(ranked, axis=1), state


def _visits(index: Index, ids: np.ndarray, x: np.ndarray, s: np.ndarray, home: np.ndarray, bsf: np.ndarray, prune: Prune | None, order: Order | None, limits: Limits, approximate: bool) -> DataFrame:
    """VISITS of a block of queries, worked out by tasks, CHUNK queries at a time."""
    spark = index.members.sparkSession
    sent = spark.sparkContext.broadcast((ids, x, s, home, bsf, (index.leaves, index.envelopes, index.sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, s, home, bsf, held = sent.value
        leaves = np.array(held[0], np.int64)
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                at = slice(lo, lo + CHUNK)
                lb, place, state = _states(x[at], s[at], home[at], bsf[at], held, prune, order, limits, approximate)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], len(leaves))), pa.array(np.tile(leaves, len(lb))), pa.array(lb.ravel()), pa.array(place.ravel() + 1), pa.array(STATES[state.ravel()].tolist(), pa.string())], names=["query_id", "leaf_id", "lb2", "visit", "state"])

    n = -(-len(ids) // CHUNK)
    return spark.range(0, n * CHUNK, CHUNK, n).mapInArrow(run, VISITS)


def exact(
    queries: DataFrame, index: Index, k: int, exclude_self: bool = False, prune: Prune | None = None, max_leaves: int | None = None, max_series: int | None = None, approximate: bool = False, order: Order | None = None
) -> tuple[DataFrame, DataFrame]:
    """Answers (as brute_force) and visits (query_id, leaf_id, lb2, visit, state) over an index.

    Phase 1 scans each query's resident leaf; its k-th distance is the best so far. Phase 2 scans the other leaves whose
    bound is below it, unless `prune` (a learned filter: queries, leaf, bounds, best so far -> mask of pairs to skip)
    skips them or a budget of leaves or series is used up. Without k answers nothing is pruned. Leaves come in order of
    their bounds, or of falling `order` (queries, leaves, bounds -> scores), after the resident one. With `approximate`
    only that is scanned. Visits are worked out when they are read.
    """
    spark = index.members.sparkSession
    limits = Limits(max_leaves, max_series)
    found, visits = [], []
    size = BLOCK if not limits.any else max(1, min(BLOCK, PAIRS // max(1, min(len(index.leaves), max_leaves or len(index.leaves)))))
    for ids, x, s in _blocks(queries, size, index.sketched):
        home = tree.route(index.nodes, s)
        first = top_k(scan(index.members, ids, x, k, exclude_self, _resident(home), np.unique(home).tolist()), k)
        rows = first.select("query_id", "series_id", "leaf_id", "d2").toArrow()  # at most k rows a query of the block
        bsf = np.full(len(ids), np.inf)
        at, d2 = np.searchsorted(ids, rows["query_id"].to_numpy()), rows["d2"].to_numpy()
        counts = np.bincount(at, minlength=len(ids))
        most = np.full(len(ids), -np.inf)
        np.maximum.at(most, at, d2)
        bsf[counts >= k] = most[counts >= k]
        found.append(spark.createDataFrame(rows, ANSWERS))
        told = _visits(index, ids, x, s, home, bsf, prune, order, limits, approximate)
        visits.append(told)
        if approximate:
            continue
        if limits.any:  # which leaves are scanned depends on the others of a query
            pairs = told.where("state = 'scanned'").select("query_id", "leaf_id").toArrow()
            place, leaf = np.searchsorted(ids, pairs["query_id"].to_numpy()), pairs["leaf_id"].to_numpy()
            by = {at: place[leaf == at] for at in np.unique(leaf).tolist()}
            if by:
                found.append(scan(index.members, ids, x, k, exclude_self, _listed(by), list(by)))
        else:
            found.append(scan(index.members, ids, x, k, exclude_self, _below(x, s, home, bsf, index.envelopes, prune)))
    return top_k(_all(found, spark), k), _all(visits, spark, VISITS)


def _blocks(queries: DataFrame, size: int, sketched: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """blocks() with what bounds are taken of: the sketches, if the index has them, else the values."""
    if not sketched:
        for ids, x in blocks(queries, size):
            yield ids, x, x
        return
    both = queries.select("query_id", F.concat(fn.doubles("values"), fn.doubles("sketch")).alias("values"), F.size("sketch").alias("n"))
    n = both.agg(F.max("n")).first()[0] or 0
    for ids, x in blocks(both, size):
        yield ids, x[:, : x.shape[1] - n], x[:, x.shape[1] - n :]


def _resident(home: np.ndarray) -> Wanted:
    return lambda leaf: np.flatnonzero(home == leaf)


def _listed(by: dict[int, np.ndarray]) -> Wanted:
    return lambda leaf: by.get(leaf, np.zeros(0, np.int64))


def _below(x: np.ndarray, s: np.ndarray, home: np.ndarray, bsf: np.ndarray, envelopes: dict[int, np.ndarray], prune: Prune | None) -> Wanted:
    def wanted(leaf: int) -> np.ndarray:
        lb = tree.bound(s, envelopes[leaf])
        rows = np.flatnonzero((lb < bsf) & (home != leaf))
        if prune is not None and len(rows):
            told = rows[np.isfinite(bsf[rows])]
            rows = np.setdiff1d(rows, told[prune(x[told], leaf, lb[told], bsf[told])])
        return rows

    return wanted


def within(queries: DataFrame, series: DataFrame, radius2: float, exclude_self: bool = False) -> DataFrame:
    """query_id and the number of series at a squared distance of radius2 or less."""
    near = distances(queries, series, exclude_self).where(F.col("d2") <= radius2)
    return queries.select("query_id").join(near.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_within"))
