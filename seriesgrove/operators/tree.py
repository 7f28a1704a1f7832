"""The tree index: fitting, routing, leaves.

A node splits on the mean or the deviation of one segment (horizontal), or of
half a segment, which is then two segments for its children (vertical). The
split with the greatest gain in range is taken; of equal gains the first in the
order segment, mean, deviation, then the halves in the same way.

The tree is fitted on the driver from a bounded sample (`sample_rows`) and has
at most `max_leaves` leaves, so that its size does not grow with the data and it
can be sent to all tasks. Every row is then routed to a leaf, and the leaves'
envelopes are those of all their rows, so bounds hold for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesgrove.functions import series as fn


@dataclass(frozen=True)
class TreeSettings:
    leaf_size: int = 100
    children: int = 2
    vertical_factor: float = 2.0
    segments: int = 4
    sample_rows: int = 200_000
    max_leaves: int = 16_384


@dataclass
class Node:
    node_id: int
    parent_id: int | None
    depth: int
    segments: list[tuple[int, int]]
    n: int = 0
    is_leaf: bool = True
    on_std: bool = False
    start: int = 0
    len: int = 0
    breaks: list[float] = field(default_factory=list)
    children: list[int] = field(default_factory=list)


def gain_formulas(length: Column, w: Column, high: Column, low: Column, c: int) -> tuple[Column, Column]:
    """Gains of a split on the mean and on the deviation: w is the width of means, high and low bound the deviations."""
    whole = length * (w * w + high * high)
    on_mean = whole - length * ((w / c) * (w / c) + high * high)
    step = (high - low) / c
    on_std = whole - sum((length * (w * w + (high - i * step) * (high - i * step)) for i in range(c)), F.lit(0.0)) / c
    return on_mean, on_std


def split_gains(ranges: DataFrame, group: str = "leaf_id", c: int = 2) -> DataFrame:
    """Both gains of each group and segment, with the number of the candidate."""
    w = F.col("max_mean") - F.col("min_mean")
    on_mean, on_std = gain_formulas(F.col("len"), w, F.col("max_std"), F.col("min_std"), c)
    both = F.array(F.struct(F.lit("mean").alias("kind"), on_mean.alias("gain"), (F.col("min_mean") + w / c).alias("break_at")), F.struct(F.lit("std").alias("kind"), on_std.alias("gain"), (F.col("min_std") + (F.col("max_std") - F.col("min_std")) / c).alias("break_at")))
    return ranges.select(group, "seg", "start", "len", F.posexplode(both).alias("k", "s")).select(group, "seg", "start", "len", (F.col("seg") * 2 + F.col("k")).alias("candidate"), F.col("s.kind").alias("kind"), F.col("s.gain").alias("gain"), F.col("s.break_at").alias("break_at"))


def best_splits(gains: DataFrame, group: str = "leaf_id") -> DataFrame:
    """The candidate with the greatest gain of each group; of equal ones the first."""
    best = gains.groupBy(group).agg(F.max_by(F.struct("candidate", "seg", "start", "len", "kind", "gain", "break_at"), F.struct("gain", -F.col("candidate"))).alias("b"))
    return best.select(group, "b.*")


def all_splits(series: DataFrame, parts: list[tuple[int, int]], s: TreeSettings = TreeSettings(), group: str = "leaf_id", values: str = "values") -> DataFrame:
    """The best horizontal or vertical split of each group: group, candidate, vertical, kind, start, len, gain, score, break_at (the first of the breaks).

    Ranges of all segments and their halves are aggregated by group; a vertical split's gain is divided by the factor.
    Of equal scores the first candidate is taken, in the order segment, mean, deviation, then each half in the same way.
    """
    pieces = []
    for seg, (a, n) in enumerate(parts):
        pieces.append((10 * seg, False, a, n))
        if n >= 4:
            pieces += [(10 * seg + 2, True, a, n // 2), (10 * seg + 4, True, a + n // 2, n - n // 2)]
    stats = series.select(group, F.posexplode(fn.segment_stats(F.col(values), [(a, n) for _, _, a, n in pieces])).alias("i", "p"))
    ranges = stats.groupBy(group, "i").agg(F.first("p.start").cast("long").alias("start"), F.first("p.len").cast("long").alias("len"), F.min("p.mean").alias("lm"), F.max("p.mean").alias("hm"), F.min("p.std").alias("ls"), F.max("p.std").alias("hs"))
    known = F.create_map(*(F.lit(x) for i, (c, v, _, _) in enumerate(pieces) for x in (i, c)))
    upright = F.array(*(F.lit(v) for _, v, _, _ in pieces))
    w = F.col("hm") - F.col("lm")
    on_mean, on_std = gain_formulas(F.col("len"), w, F.col("hs"), F.col("ls"), s.children)
    both = F.array(F.struct(F.lit(0).alias("k"), F.lit("mean").alias("kind"), on_mean.alias("gain"), (F.col("lm") + w / s.children).alias("break_at")), F.struct(F.lit(1).alias("k"), F.lit("std").alias("kind"), on_std.alias("gain"), (F.col("ls") + (F.col("hs") - F.col("ls")) / s.children).alias("break_at")))
    rows = ranges.select(group, "start", "len", F.element_at(known, F.col("i")).alias("c"), upright[F.col("i")].alias("vertical"), F.explode(both).alias("s"))
    rows = rows.select(group, (F.col("c") + F.col("s.k")).cast("long").alias("candidate"), "vertical", F.col("s.kind").alias("kind"), "start", "len", F.col("s.gain").alias("gain"), F.when(F.col("vertical"), F.col("s.gain") / s.vertical_factor).otherwise(F.col("s.gain")).alias("score"), F.col("s.break_at").alias("break_at"))
    best = rows.where("score > 0").groupBy(group).agg(F.max_by(F.struct("candidate", "vertical", "kind", "start", "len", "gain", "score", "break_at"), F.struct("score", -F.col("candidate"))).alias("b"))
    return best.select(group, "b.*")


def route_once(series: DataFrame, splits: DataFrame, group: str = "leaf_id", values: str = "values") -> DataFrame:
    """Adds side (0 below the break, 1 else) by each group's split."""
    part = F.slice(values, F.col("start").cast("int") + 1, F.col("len").cast("int"))
    stat = F.when(F.col("kind") == "mean", fn.mean(part)).otherwise(fn.std(part))
    return series.join(splits, group).withColumn("side", F.when(stat < F.col("break_at"), 0).otherwise(1))


# Fitting


def _stats(x: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    part = x[:, start : start + n]
    return part.mean(axis=1), part.std(axis=1)


def _candidates(x: np.ndarray, node: Node, s: TreeSettings):
    """(gain, order, on_std, start, len, breaks, segments) of the best split of a node's rows, or None."""
    best = None

    def consider(gain, on_std, start, n, low, width, parts, vertical, limit):
        nonlocal best
        if gain > limit:
            breaks = [low + (i + 1) * width / s.children for i in range(s.children - 1)]
            best = (gain / s.vertical_factor if vertical else gain, on_std, start, n, breaks, parts)

    for i, (start, n) in enumerate(node.segments):
        for vertical, a, m in [(False, start, n), *((True, a, m) for a, m in ((start, n // 2), (start + n // 2, n - n // 2)) if n >= 4)]:
            means, stds = _stats(x, a, m)
            w, high, low = float(means.max() - means.min()), float(stds.max()), float(stds.min())
            whole = m * (w * w + high * high)
            step = (high - low) / s.children
            gains = whole - m * ((w / s.children) ** 2 + high * high), whole - sum(m * (w * w + (high - j * step) ** 2) for j in range(s.children)) / s.children
            parts = [*node.segments[:i], (start, n // 2), (start + n // 2, n - n // 2), *node.segments[i + 1 :]] if vertical else node.segments
            for on_std, gain in enumerate(gains):
                limit = best[0] if best else 0.0
                consider(gain, bool(on_std), a, m, low if on_std else float(means.min()), high - low if on_std else w, parts, vertical, limit * s.vertical_factor if vertical else limit)
    return best


def fit_rows(x: np.ndarray, s: TreeSettings, leaf_size: int) -> list[Node]:
    """The nodes of a tree over these rows; a group that no split divides stays one leaf, however large."""
    nodes = [Node(0, None, 0, fn.segments(x.shape[1], min(s.segments, x.shape[1])) if x.size else [], len(x))]
    todo, leaves = [(0, np.arange(len(x)))], 1
    while todo:
        todo.sort(key=lambda t: (-len(t[1]), t[0]))  # the largest first, for when max_leaves is reached
        at, rows = todo.pop(0)
        node = nodes[at]
        if len(rows) <= leaf_size or leaves + s.children - 1 > s.max_leaves:
            continue
        best = _candidates(x[rows], node, s)
        if best is None:
            continue
        _, on_std, start, n, breaks, parts = best
        side = np.searchsorted(breaks, _stats(x[rows], start, n)[on_std], "right")
        if (side == side[0]).all():
            continue
        node.is_leaf, node.on_std, node.start, node.len, node.breaks = False, on_std, start, n, [float(b) for b in breaks]
        for c in range(s.children):
            child = Node(len(nodes), node.node_id, node.depth + 1, list(parts), int((side == c).sum()))
            node.children.append(child.node_id)
            nodes.append(child)
            todo.append((child.node_id, rows[side == c]))
        leaves += s.children - 1
    return nodes


def fit_tree(series: DataFrame, s: TreeSettings = TreeSettings(), id_col: str = "series_id", values: str = "values") -> list[Node]:
    """A tree fitted on all rows, or on `sample_rows` of them in the order of a hash; leaves shrink in proportion."""
    n = series.count()
    rows = series.select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), F.col(values).alias("v"))
    if n > s.sample_rows:
        rows = rows.orderBy("h", "i").limit(s.sample_rows)
    table = rows.toArrow()
    if not table.num_rows:
        return [Node(0, None, 0, [])]
    order = np.lexsort([table["i"].to_numpy()])
    x = np.stack(table["v"].to_numpy()).astype(np.float64)[order]
    return fit_rows(x, s, max(1, s.leaf_size * len(x) // n))


def route(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        node = nodes[at]
        if node.is_leaf or not len(rows):
            out[rows] = at
            continue
        side = np.searchsorted(node.breaks, _stats(x[rows], node.start, node.len)[node.on_std], "right")
        todo += [(child, rows[side == c]) for c, child in enumerate(node.children)]
    return out


class Ragged(ValueError):
    """Series that are null, hold a null, or differ in length."""


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of arrays of one length. A null row, a null within a row, or another length is an error: there is no row to give."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    lengths = pc.list_value_length(column)
    if column.null_count or pc.min(lengths).as_py() != pc.max(lengths).as_py():
        raise Ragged("series must not be null and must have one length")
    flat = column.flatten()
    if flat.null_count:
        raise Ragged("a series holds a null")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def regular(series: DataFrame, values: str = "values") -> DataFrame:
    """The series without null ones and those that hold a null, which no distance is defined for."""
    return series.where(F.col(values).isNotNull() & ~F.exists(F.coalesce(F.col(values), F.array()), lambda x: x.isNull()))


def assign(series: DataFrame, nodes: list[Node], values: str = "values", into: str = "leaf_id") -> DataFrame:
    """Adds each row's leaf; no shuffle. The tree has at most max_leaves leaves and is sent to all tasks."""
    sent = series.sparkSession.sparkContext.broadcast(nodes)

    @F.arrow_udf("bigint")
    def run(v: pa.Array) -> pa.Array:
        return pa.array(route(sent.value, matrix(v)), pa.int64())

    return series.withColumn(into, run(F.col(values)))


def with_sizes(nodes: list[Node], sizes: dict[int, int]) -> list[Node]:
    """The same nodes, n being the series below each; sizes: of the leaves."""
    total = {n.node_id: sizes.get(n.node_id, 0) for n in nodes}
    for n in sorted(nodes, key=lambda n: -n.depth):
        if n.parent_id is not None:
            total[n.parent_id] += total[n.node_id]
    return [replace(n, n=total[n.node_id]) for n in nodes]


NODES = "node_id bigint, parent_id bigint, depth int, is_leaf boolean, n bigint, on_std boolean, start int, len int, breaks array<double>, children array<bigint>, segments array<struct<start:int,len:int>>"


def to_frame(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    """The nodes as a table."""
    rows = [{**asdict(n), "segments": [{"start": a, "len": m} for a, m in n.segments]} for n in nodes]
    names = [f.name for f in T._parse_datatype_string(NODES).fields]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], NODES)


def from_frame(frame: DataFrame) -> list[Node]:
    """The nodes of a table of at most 2 * max_leaves rows."""
    return [Node(r.node_id, r.parent_id, r.depth, [(p.start, p.len) for p in r.segments], r.n, r.is_leaf, r.on_std, r.start, r.len, list(r.breaks), list(r.children)) for r in frame.orderBy("node_id").collect()]


def leaf_envelopes(members: DataFrame, nodes: list[Node], values: str = "values", group: str = "leaf_id") -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """For each leaf with rows, its segments' (start, len, min_mean, max_mean, min_std, max_std) over all rows, and their number; partial ranges by task."""
    sent = members.sparkSession.sparkContext.broadcast({n.node_id: n.segments for n in nodes if n.is_leaf})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            leaf, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for at in np.unique(leaf).tolist():
                rows = x[leaf == at]
                found = []
                for a, m in sent.value[at]:
                    means, stds = _stats(rows, a, m)
                    found.append((means.min(), means.max(), stds.min(), stds.max()))
                e = np.array(found)
                if at in held:
                    n, o = held[at]
                    e = np.stack([np.minimum(o[:, 0], e[:, 0]), np.maximum(o[:, 1], e[:, 1]), np.minimum(o[:, 2], e[:, 2]), np.maximum(o[:, 3], e[:, 3])], axis=1)
                    held[at] = n + len(rows), e
                else:
                    held[at] = len(rows), e
        flat = [(at, seg, n, *e[seg].tolist()) for at, (n, e) in held.items() for seg in range(len(e))]
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 4]
        names = ["leaf_id", "seg", "n", "min_mean", "max_mean", "min_std", "max_std"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], k) for i, k in enumerate(kinds)], names=names)

    parts = members.select(F.col(group), F.col(values)).mapInArrow(run, "leaf_id bigint, seg int, n bigint, min_mean double, max_mean double, min_std double, max_std double")
    whole = parts.groupBy("leaf_id", "seg").agg(F.sum("n").alias("n"), F.min("min_mean").alias("a"), F.max("max_mean").alias("b"), F.min("min_std").alias("c"), F.max("max_std").alias("d")).toArrow()
    segments = {n.node_id: n.segments for n in nodes if n.is_leaf}
    out = {leaf: np.zeros((len(segments[leaf]), 6)) for leaf in set(whole["leaf_id"].to_pylist())}
    for r in whole.to_pylist():
        out[r["leaf_id"]][r["seg"]] = (*segments[r["leaf_id"]][r["seg"]], r["a"], r["b"], r["c"], r["d"])
    return out, {r["leaf_id"]: r["n"] for r in whole.to_pylist()}


def bound(x: np.ndarray, envelope: np.ndarray) -> np.ndarray:
    """lb2 of each row to an envelope."""
    out = np.zeros(len(x))
    for a, m, low_m, high_m, low_s, high_s in envelope:
        means, stds = _stats(x, int(a), int(m))
        out += m * (np.maximum(0, np.maximum(low_m - means, means - high_m)) ** 2 + np.maximum(0, np.maximum(low_s - stds, stds - high_s)) ** 2)
    return out


def visit_order(bounds: DataFrame) -> DataFrame:
    """Adds the place of each group in a query's order of visits: by bound, then id."""
    return bounds.withColumn("visit", F.row_number().over(Window.partitionBy("query_id").orderBy("lb2", "leaf_id")).cast("long"))
