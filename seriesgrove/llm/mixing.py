"""Operator 6, mixing sources to target weights by Sainte-Lague apportionment.

Each source's documents are dealt to shards of bounded size by a seeded hash
and form one stream of words per shard, in seeded order. The stream is cut into
blocks of equally many words. Blocks are apportioned to sources by the highest
quotients target / (2k + 1), and each source's blocks to its shards in the same
way by the shards' sizes. A shard with quota q of n blocks gives every block
q // n times, and q % n more blocks in a row from a seeded first one, around
the end; the documents lie there in seeded order, so this is a random choice
that cuts two documents at most.

Defined results: a null or empty text has size 0 and nothing is taken from it.
Null sources form one source, the last. No rows give no rows. Repeated rows are
counted each. Results depend on the rows alone, not on their order or
partitions: rows equal in id, source and text are alike, hence interchangeable.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesgrove.llm import textops
from seriesgrove.llm.lineage import cut


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in order; share is of all words; repeats bounds how often a source is taken.

    A block has block_words words, or fewer where that is more than one in 1024 of a source's mean share of the mix, so
    that small sources are not rounded away. max_sources bounds what the driver holds: one row per source. More sources
    stop the run; no row is dropped.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    share: Fraction = Fraction(3, 2)
    repeats: int = 2
    block_words: int = 64
    shard_words: int = 1 << 18
    slice_shards: int = 4096
    seed: int = 17
    max_sources: int = 1_000_000


def word_count(text):
    """The number of words of a text column; null gives 0."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        found = [np.diff(b.words()[2]) for b in textops.blocks(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())

    return run.asNondeterministic()(text)


def targets(sizes: list[int], mix: Mix) -> list[Fraction]:
    """Exact targets of the sources, in order: shares by weight, none above its limit, the excess shared anew."""
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    limit = [Fraction(mix.repeats * s) for s in sizes]
    out = [Fraction(0)] * len(sizes)
    left = min(mix.share * sum(sizes), sum(limit, Fraction(0)))
    heap = [(limit[i] / weights[i], i) for i in range(len(sizes))]
    heapq.heapify(heap)
    weight = sum(weights)
    while heap and heap[0][0] * weight <= left:  # the level at which the next source is full
        _, i = heapq.heappop(heap)
        out[i] = limit[i]
        left -= limit[i]
        weight -= weights[i]
    for _, i in heap:
        out[i] = left * weights[i] / weight
    return out


def sainte_lague(claims: list, seats: int, limits: list[int]) -> list[int]:
    """Seats by the highest quotients claim / (2k + 1), at most limits[i] each; ties go to the earlier one.

    Most seats are given at once: with a divisor d, those of quotient d or more are floor((claim / d + 1) / 2).
    """
    claims = [Fraction(c) for c in claims]
    seats = min(seats, sum(n for c, n in zip(claims, limits, strict=True) if c > 0))
    given = [0] * len(claims)
    if seats <= 0:
        return given
    at = lambda d: [min(n, int((c / d + 1) / 2)) for c, n in zip(claims, limits, strict=True)]
    high, low = 2 * max(claims), max(claims) / (2 * seats + 1)
    while sum(at(low)) < seats:
        low /= 2
    for _ in range(64):  # the divisor need only come near; the heap does the rest
        middle = (high + low) / 2
        middle = Fraction(float(middle)) if float(middle) > 0 and low < Fraction(float(middle)) < high else middle
        if sum(at(middle)) <= seats:
            high = middle
        else:
            low = middle
        if seats - sum(at(high)) <= len(claims):
            break
    given = at(high)
    heap = [(-c / (2 * g + 1), i) for i, (c, g, n) in enumerate(zip(claims, given, limits, strict=True)) if g < n and c > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < limits[i]:
            heapq.heappush(heap, (-claims[i] / (2 * given[i] + 1), i))
    return given


def _apportion(group: list[str], member: str, mix: Mix):
    """Deals `_quota` of a group to its members by their words; rows come in one group at a time."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(member)
        quotas = sainte_lague(table["_words"].to_pylist(), table["_quota"][0].as_py(), [mix.repeats * x for x in table["_blocks"].to_pylist()])
        return table.set_column(table.schema.get_field_index("_quota"), "_quota", pa.array(quotas, pa.int64()))

    return run


def order_key(id_col: str, text: str, mix: Mix):
    """A seeded digest of a row's id and text, by which rows are dealt and ordered."""
    return F.md5(F.concat_ws("\x1f", F.lit(str(mix.seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.md5(text), F.lit("-"))))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", mix: Mix = Mix(), carry: tuple[str, ...] | None = None, into: str = "mix") -> DataFrame:
    """The carried columns (all, if None) of every row, and under `into`, or the next free name, a struct:

    size, source_size, target, taken (words); rounds (times that the whole row is taken); and from_1, to_1, from_2,
    to_2, the ranges of the row's words that are taken once more (empty where equal).
    """
    spark = docs.sparkSession
    kept = list(docs.columns if carry is None else carry)
    into = textops.fresh(kept, into)
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row")
    facts = [F.col(source).alias("_name"), word_count(F.col(text)).alias("_size"), order_key(id_col, text, mix).alias("_order")]
    slim = text not in kept
    light = cut(docs.select(row, *facts) if slim else docs.select(*facts))  # texts are read once, or once more to be carried
    sized = light if slim else docs.select(row, *facts)
    found = light.groupBy(F.col("_name").alias("s")).agg(F.sum("_size").alias("n")).limit(mix.max_sources + 1).collect()
    if len(found) > mix.max_sources:
        raise ValueError(f"more than {mix.max_sources} sources")
    found.sort(key=lambda r: (r.s is None, r.s or ""))
    sizes = [r.n for r in found]
    goal = targets(sizes, mix)
    # Smaller blocks for a small corpus, so that a source's share is not rounded away.
    block = max(1, min(mix.block_words, int(mix.share * sum(sizes)) // (1024 * max(1, len(sizes)))))
    mix = replace(mix, block_words=block)
    quotas = sainte_lague(goal, round(sum(goal, Fraction(0)) / block), [mix.repeats * -(-n // block) for n in sizes])
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    shape = T.StructType([T.StructField("_name", docs.schema[source].dataType), *longs("_source", "_source_size", "_shards", "_quota"), T.StructField("_target", T.DoubleType())])
    known = F.broadcast(spark.createDataFrame([(r.s, i, sizes[i], max(1, -(-sizes[i] // mix.shard_words)), quotas[i], float(goal[i])) for i, r in enumerate(found)], shape))  # bounded by max_sources
    deal = F.pmod(F.conv(F.substring("_order", 1, 12), 16, 10).cast("long"), F.col("_shards")).alias("_shard")
    keyed = sized.withColumnRenamed("_name", "_own").join(known.drop("_quota"), F.col("_size").isNotNull() & F.col("_own").eqNullSafe(F.col("_name"))).select("_row", "_source", "_source_size", "_target", "_size", "_order", deal)
    # Shards, slices of shards, and their quotas.
    shards = light.select("_name", "_size", "_order").withColumnRenamed("_name", "_own").join(known, F.col("_own").eqNullSafe(F.col("_name"))).select("_source", "_quota", deal, "_size").groupBy("_source", "_shard").agg(F.sum("_size").alias("_words"), F.first("_quota").alias("_quota"))
    shards = shards.withColumn("_blocks", F.ceil(F.col("_words") / block).cast("long")).withColumn("_slice", F.floor(F.col("_shard") / mix.slice_shards).cast("long"))
    slices = shards.groupBy("_source", "_slice").agg(F.sum("_words").alias("_words"), F.sum("_blocks").alias("_blocks"), F.first("_quota").alias("_quota"))
    slices = slices.groupBy("_source").applyInArrow(_apportion(["_source"], "_slice", mix), slices.schema)
    shards = shards.drop("_quota").join(slices.select("_source", "_slice", "_quota"), ["_source", "_slice"])
    shards = shards.groupBy("_source", "_slice").applyInArrow(_apportion(["_source", "_slice"], "_shard", mix), shards.schema)
    spin = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(mix.seed)), "_source", "_shard")), 1, 12), 16, 10).cast("long")
    shards = shards.select("_source", "_shard", F.col("_words").alias("_total"), "_blocks", F.col("_quota").alias("_shard_quota"), F.when(F.col("_blocks") > 0, F.pmod(spin, F.col("_blocks"))).otherwise(0).alias("_first"))
    # The streams.
    stream = Window.partitionBy("_source", "_shard").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_before", F.coalesce(F.sum("_size").over(stream), F.lit(0))).join(shards, ["_source", "_shard"])
    rounds = F.when(F.col("_blocks") > 0, F.floor(F.col("_shard_quota") / F.col("_blocks"))).otherwise(0).cast("long")
    extra = F.when(F.col("_blocks") > 0, F.col("_shard_quota") % F.col("_blocks")).otherwise(0)
    clip = lambda at: F.greatest(F.lit(0), F.least(F.col("_size"), at - F.col("_before"))).cast("long")
    placed = placed.withColumn("_rounds", rounds).withColumn("_extra", extra)
    ends = {"from_1": clip(F.col("_first") * block), "to_1": clip((F.col("_first") + F.col("_extra")) * block), "from_2": F.lit(0).cast("long"), "to_2": clip(F.greatest(F.lit(0), F.col("_first") + F.col("_extra") - F.col("_blocks")) * block)}
    placed = placed.select("_row", "_size", "_source_size", "_target", "_rounds", *(v.alias(k) for k, v in ends.items()))
    taken = F.col("_rounds") * F.col("_size") + (F.col("to_1") - F.col("from_1")) + (F.col("to_2") - F.col("from_2"))
    fields = [F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), F.col("_rounds").alias("rounds"), *ends]
    return placed.select("_row.*", F.struct(*fields).alias(into))


def cut_words(text: str, lo: int, hi: int) -> str:
    """Words lo to hi of a text with what stands between them; with the first or last word also what stands outside of it."""
    b = next(textops.blocks(pa.array([text])))
    starts, ends, _ = b.words()
    return b.data[0 if lo <= 0 else int(starts[lo]) : len(b.data) if hi >= len(starts) else int(ends[hi - 1])].tobytes().decode()


def write_out(mixed: DataFrame, into: str, columns: list[str], text: str = "text", length: str | None = None) -> DataFrame:
    """One row for each time that a row of mix_sources() is taken: whole rows, and rows with the taken range of words as text.

    Only the texts that are cut, at most two of each shard, leave the JVM.
    """

    @F.arrow_udf("array<string>")
    def parts(texts: pa.Array, *ends: pa.Array) -> pa.Array:
        out = []
        for t, *at in zip(texts.to_pylist(), *(e.to_pylist() for e in ends), strict=True):
            out.append([] if t is None else [cut_words(t, x, w) for x, w in (at[2:], at[:2]) if w > x])
        return pa.array(out, pa.list_(pa.string()))

    at = lambda c: F.col(f"{into}.{c}")
    one, two = at("to_1") > at("from_1"), at("to_2") > at("from_2")
    whole = (at("to_1") == at("size")) & one & ((at("from_1") == 0) | two & (at("from_1") <= at("to_2")))  # the run may meet its own beginning
    whole = whole | two & (at("to_2") == at("size"))
    copies, name = textops.fresh([*columns, into], "parts"), textops.fresh([*columns, into, "parts"], "part")
    cut = parts(F.when((one | two) & ~whole, F.col(text)), *(at(c) for c in ("from_1", "to_1", "from_2", "to_2")))
    held = mixed.withColumn(copies, cut)
    rows = F.concat(F.array_repeat(text, (at("rounds") + whole.cast("long")).cast("int")), F.col(copies))
    made = held.withColumn(name, F.explode(rows))
    changed = {text: F.col(name)}
    if length:
        changed[length] = F.when(F.col(name) == F.col(text), F.col(length)).otherwise(F.length(name)).cast("long")
    return made.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs, carry=("doc_id",)).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


#: The same by listing every quotient; for corpora small enough for that.
OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS BIGINT) AS size,
    md5(concat_ws(chr(31), '17', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(md5(text), '-'))) AS o FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source
), r AS (SELECT source, n, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS i, [3, 1, 2][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s
), b AS (SELECT greatest(1, least(64, floor(1.5 * sum(n))::BIGINT // (1024 * greatest(1, count(*))))) AS block, 1.5 * sum(n)::DOUBLE AS share FROM r
), f AS (SELECT r.*, share - coalesce(sum(2 * n) OVER (ORDER BY 2 * n::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY 2 * n::DOUBLE / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM r, b
), g AS (SELECT min(struct_pack(q := 2 * n::DOUBLE / w, i := i, rest := rest, weight := weight)) AS m FROM f WHERE 2 * n::DOUBLE / w * weight > rest
), t AS (SELECT r.i, r.source, r.n, CASE WHEN m IS NULL OR 2 * n::DOUBLE / w < m.q OR (2 * n::DOUBLE / w = m.q AND r.i < m.i) THEN 2 * n::DOUBLE ELSE m.rest * w / m.weight END AS target,
    greatest(1, ceil(n / 262144)::BIGINT) AS shards, 2 * ceil(n / block)::BIGINT AS most FROM r, b, g
), quotas AS (SELECT i, count(*) AS quota FROM (SELECT i, row_number() OVER (ORDER BY q DESC, i) AS place FROM (SELECT i, target / (2 * k + 1) AS q FROM t, LATERAL (SELECT unnest(range(most)) AS k) WHERE target > 0)), (SELECT round_even(sum(target) / any_value(block), 0) AS seats FROM t, b) WHERE place <= seats GROUP BY i
), placed AS (SELECT d.*, t.i, t.n, t.target, CAST('0x' || substr(o, 1, 12) AS BIGINT) % shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), sh AS (SELECT i, shard, sum(size)::BIGINT AS words, ceil(sum(size) / any_value(block))::BIGINT AS blocks, shard // 4096 AS slice FROM placed, b GROUP BY i, shard
), sl AS (SELECT i, slice, sum(words) AS words, sum(blocks)::BIGINT AS blocks FROM sh GROUP BY i, slice
), slq AS (SELECT i, slice, count(*) AS quota FROM (SELECT i, slice, row_number() OVER (PARTITION BY i ORDER BY words / (2 * k + 1) DESC, slice) AS place FROM sl, LATERAL (SELECT unnest(range(2 * blocks)) AS k) WHERE words > 0) JOIN quotas USING (i) WHERE place <= quota GROUP BY i, slice
), shq AS (SELECT i, shard, count(*) AS quota FROM (SELECT i, slice, shard, row_number() OVER (PARTITION BY i, slice ORDER BY words / (2 * k + 1) DESC, shard) AS place FROM sh, LATERAL (SELECT unnest(range(2 * blocks)) AS k) WHERE words > 0) JOIN slq USING (i, slice) WHERE place <= quota GROUP BY i, shard
), x AS (
  SELECT p.*, sh.blocks, coalesce(shq.quota, 0) AS quota, b.block, CASE WHEN sh.blocks > 0 THEN CAST('0x' || substr(md5(concat_ws('/', '17', p.i, p.shard)), 1, 12) AS BIGINT) % sh.blocks ELSE 0 END AS first,
    coalesce(sum(size) OVER (PARTITION BY p.i, p.shard ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed p JOIN sh USING (i, shard) LEFT JOIN shq USING (i, shard), b
), y AS (SELECT *, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS rounds, CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS extra FROM x)
SELECT doc_id, size, n AS source_size, target, CAST(rounds * size
  + greatest(0, least(size, (first + extra) * block - before)) - greatest(0, least(size, first * block - before))
  + greatest(0, least(size, greatest(0, first + extra - blocks) * block - before)) AS BIGINT) AS taken FROM y
"""
