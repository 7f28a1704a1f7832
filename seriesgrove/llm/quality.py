"""Operator 4, a quality classifier by interpolated modified Kneser-Ney.

The model is one of 4-grams of characters (16 bits each, so that an n-gram is a
64-bit integer and its context and suffix are shifts of it), trained on trusted
text: documents labelled good and not toxic, but for the held-out share.

1. Counts: each task counts the n-grams of the trusted text that it reads; they
   are summed by n-gram. Lower orders count the different left neighbours.
   Counts over contexts give discounts, own shares and back-off weights: tables
   by n-gram and by context that grow with the corpus and stay sharded.
2. Probabilities: the different n-grams of all documents are joined to the
   tables, order by order. Nothing of the model is gathered or broadcast.
3. Scores: consecutive documents form shards of bounded size. The different
   n-grams of each shard are joined to their probabilities, and a shard's texts,
   compressed, meet its n-grams' bits: each document's are summed.

A document is kept if its perplexity is at most a threshold of its language: a
multiple of a quantile of held-out trusted documents' perplexity. The multiple is
the one that tells held-out trusted documents and those labelled bad apart with
the fewest errors, one of `factor` where none is labelled bad. Short texts are
drawn to their language's mean, as if they were longer by `prior` characters.

Defined results: a null or empty text has the perplexity of its language's mean
and is kept. Languages with fewer than `least` held-out documents, null included,
use the mean and the quantile of all. Where nothing trusted is held out, all
trusted documents are. Without any trusted text nothing is known, perplexity and
threshold are null and every row is kept. Labels may repeat: a document is
trusted if all its labels are good. Repeated rows get equal results. Code points
above 65534 count as one character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesgrove.llm import textops
from seriesgrove.llm.lineage import cut

ORDER, BITS = 4, 16
#: What stands before a text, and for the characters that 16 bits do not hold.
EDGE, REST = 0, 65535
#: Different n-grams that a task holds before it hands them on.
HELD = 1 << 20
#: Bytes of text in a shard, and in a row of it.
SHARD, BLOB = 16 << 20, 1 << 20
#: Trusted ids that may be sent to all tasks (8 bytes each); more of them meet the texts in a merge join.
SENT = 4_000_000


@dataclass(frozen=True)
class Rule:
    """The threshold is a multiple of the quantile of held-out trusted perplexities in a language: `factor`, unless labels of bad documents tell it. One in `held_out` trusted documents is held out."""

    quantile: float = 0.95
    factor: float = 1.15
    prior: int = 200
    held_out: int = 5
    least: int = 20


def grams(block: textops.Block) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of a block's texts, and the first character of each text (one more at the end)."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    kinds = np.minimum(points, REST).astype(np.uint64)
    heads = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=heads[1:])
    first = heads[block.bounds]
    code = kinds.copy()
    starts = first[:-1]
    for back in range(1, ORDER):
        before = np.full(len(kinds), EDGE, np.uint64)
        before[back:] = kinds[: len(kinds) - back]
        for lag in range(back):  # what would reach into the text before
            at = starts + lag
            before[at[at < first[1:]]] = EDGE
        code |= before << np.uint64(BITS * back)
    return code.view(np.int64), first


@textops.tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different n-grams and how often a task has read them, handed on in parts."""

    def out(total: pd.Series) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(total), 1 << 18):
            part = total.iloc[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.index.to_numpy()), pa.array(part.to_numpy())], names=["code", "n"])

    total = pd.Series(np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        for b in textops.blocks(batch.column(0)):
            place, found = pd.factorize(grams(b)[0])
            total = total.add(pd.Series(np.bincount(place, minlength=len(found)), found), fill_value=0).astype(np.int64)
            if len(total) > HELD:
                yield from out(total)
                total = total.iloc[:0]
    yield from out(total)


def count_grams(texts: DataFrame) -> DataFrame:
    """(code, n) of the highest order in a frame of one text column."""
    return texts.mapInArrow(_count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur once to four times; plain ones where these are too few."""
    one, two, three, four = n
    if not (one and two and three):
        return 0.5, 0.75, 0.9
    y = one / (one + 2 * two)
    clip = lambda x, most: min(max(x, 0.05), most)
    return clip(1 - 2 * y * two / one, 0.95), clip(2 - 3 * y * three / two, 1.9), clip(3 - 4 * y * four / three, 2.9)


def _last(code: str, n: int):
    """The last n characters of n-grams."""
    return F.col(code) if n >= ORDER else F.col(code).bitwiseAND(F.lit((1 << BITS * n) - 1))


def _context(code: str, order: int):
    """What stands before the last character of n-grams of an order."""
    return F.shiftrightunsigned(code, BITS).bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


@dataclass
class Model:
    """By order, from 1: (code, own) the seen n-grams' own shares; (context, back) the weights of the lower order; the number of different characters."""

    own: list[DataFrame]
    back: list[DataFrame]
    characters: int


def kneser_ney(counts: DataFrame) -> Model:
    """The model of counts of the highest order. Lower orders count the different left neighbours of an n-gram."""
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        tables.insert(0, cut(tables[0].groupBy(_last("code", order).alias("code")).agg(F.count("*").alias("n"))))
    own, back = [], []
    characters = tables[0].count()
    for order, table in enumerate(tables, 1):
        times = table.agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        d = discounts([int(x or 0) for x in times])
        cutoff = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        keyed = table.select("code", _context("code", order).alias("context"), "n", cutoff.alias("d"))
        contexts = keyed.groupBy("context").agg(F.sum("n").alias("all"), F.sum("d").alias("less"))
        own.append(keyed.join(contexts, "context").select("code", ((F.col("n") - F.col("d")) / F.col("all")).alias("own")))
        back.append(contexts.select("context", (F.col("less") / F.col("all")).alias("back")))
    return Model(own, back, characters)


def probabilities(codes: DataFrame, model: Model) -> DataFrame:
    """(code, p) of different n-grams of the highest order: p = own + back * p of the suffix, joined order by order."""
    wanted = [codes.select("code")]
    for order in range(ORDER - 1, 0, -1):
        wanted.insert(0, wanted[0].select(_last("code", order).alias("code")).distinct())
    below = None
    for order, (codes, own, back) in enumerate(zip(wanted, model.own, model.back, strict=True), 1):
        joined = codes.withColumn("context", _context("code", order)).join(own, "code", "left").join(back, "context", "left")
        lower = F.lit(1 / (model.characters + 1))  # all characters that were never seen share one place
        if below is not None:
            joined = joined.withColumn("suffix", _last("code", order - 1)).join(below.select(F.col("code").alias("suffix"), F.col("p").alias("lower")), "suffix")
            lower = F.col("lower")
        below = joined.select("code", (F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * lower).alias("p"))
    return cut(below)


# Scores


@textops.tidy
def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, rows): consecutive documents (id, language, text), compressed; a shard is what a task reads, up to a size."""
    at, size = TaskContext.get().partitionId() << 32, 0
    pack = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for batch in batches:
        for b in textops.blocks(batch.column(2), BLOB):
            if size and size + len(b.data) > SHARD:
                at, size = at + 1, 0
            size += len(b.data)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pack) as stream:
                stream.write_batch(batch.slice(b.first, len(b)))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["shard", "rows"])


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


@textops.tidy
def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards, in order of shard: the different n-grams of each."""

    def out(shard: int, held: list[np.ndarray]) -> pa.RecordBatch:
        codes = pd.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), shard)), pa.array(codes)], names=["shard", "code"])

    at, held = None, []
    for batch in batches:
        for shard, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if shard != at and held:
                yield out(at, held)
                held = []
            at = shard
            held += [pd.unique(grams(b)[0]) for b in textops.blocks(_unpacked(rows.as_py()).column(2))]
            if len(held) > 64:
                held = [pd.unique(np.concatenate(held))]
    if held:
        yield out(at, held)


@textops.tidy
def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different n-grams that a task reads, handed on in parts."""
    held, size = [], 0
    for batch in batches:
        for b in textops.blocks(batch.column(0)):
            held.append(pd.unique(grams(b)[0]))
            size += len(held[-1])
            if size > 4 * HELD:
                held = [pd.unique(np.concatenate(held))]
                size = len(held[0])
                if size > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0])], names=["code"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(pd.unique(np.concatenate(held)))], names=["code"])


def _score(key: tuple, shard: pa.Table, table: pa.Table) -> pa.Table:
    """Ids, languages, characters and bits of the documents of a shard."""
    places = pd.Index(table["code"].to_numpy())
    bits = table["bits"].to_numpy()
    out = []
    for rows in shard["rows"]:
        docs = _unpacked(rows.as_py())
        n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
        for b in textops.blocks(docs.column(2)):
            code, first = grams(b)
            place, found = pd.factorize(code)
            at = places.get_indexer(found)
            if len(found) and at.min() < 0:
                raise ValueError("an n-gram of a shard has no probability")
            sums = np.append(0.0, np.cumsum(bits[at][place]))
            n.append(np.diff(first))
            total.append(sums[first[1:]] - sums[first[:-1]])
        out.append(pa.table([*docs.columns[:2], pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(total), pa.float64())], names=["id", "lang", "n_chars", "bits"]))
    textops.give_back()
    return pa.concat_tables(out) if out else pa.table({"id": [], "lang": [], "n_chars": [], "bits": []})


def score(docs: DataFrame, p: DataFrame) -> DataFrame:
    """id, lang, n_chars and bits of docs (id, lang, text); p has all their n-grams."""
    kinds = [docs.schema.fields[i].dataType for i in (0, 1)]
    shards = docs.mapInArrow(_shards, "shard bigint, rows binary").repartition("shard")
    wanted = shards.sortWithinPartitions("shard").mapInArrow(_wanted, "shard bigint, code bigint")
    answers = wanted.join(p.select("code", (-F.log2("p")).alias("bits")).hint("merge"), "code").select("shard", "code", "bits")
    result = T.StructType([T.StructField("id", kinds[0]), T.StructField("lang", kinds[1]), T.StructField("n_chars", T.LongType()), T.StructField("bits", T.DoubleType())])
    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_score, result)


def fit_factor(rows: list[tuple[int, int, int]], default: float) -> float:
    """The multiple of the quantile, 1 or more, with the fewest trusted documents above it and bad ones up to it.

    rows: (thousandths of the quantile, trusted, bad). Of the best ones next to each other the middle; of several such the least.
    """
    if not any(bad for _, _, bad in rows):
        return default
    most = max(1000, *(at for at, _, _ in rows))
    good, bad = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)
    for at, g, b in rows:
        good[at] += g
        bad[at] += b
    errors = (good.sum() - np.cumsum(good) + np.cumsum(bad))[1000:]
    best = np.flatnonzero(errors == errors.min())
    run = best[: int(np.argmax(np.append(np.diff(best) > 1, True))) + 1]
    return 1 + float(run[0] + run[-1]) / 2000


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rule: Rule = Rule()) -> DataFrame:
    """id, language, n_chars, perplexity, threshold and kept of every row."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("_good"), F.max(F.col("quality") == 0).alias("_bad"))
    told = cut(good.where("_good OR _bad").select("_id", F.coalesce("_good", F.lit(False)).alias("_good"), (F.pmod(F.xxhash64("_id"), F.lit(rule.held_out)) == 0).alias("_held")))
    trusted = told.where("_good AND NOT _held").select("_id")
    base = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = base.select(F.col("id").alias("_id"), "text")
    count = lambda ids: cut(count_grams(known.join(F.broadcast(ids) if ids.count() <= SENT else ids.hint("merge"), "_id", "left_semi").select("text")))
    counts, held = count(trusted), F.col("_held")
    if counts.isEmpty():  # all that is trusted is held out, or nothing is trusted
        counts, held = count(told.where("_good").select("_id")), F.lit(True)
    elif told.where("_good AND _held").isEmpty():
        held = F.lit(True)
    if counts.isEmpty():
        none = F.lit(None).cast("double")
        return base.select(F.col("id").alias(id_col), F.col("lang").alias(lang), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    p = probabilities(cut(base.select("text").mapInArrow(_different, "code bigint").distinct()), kneser_ney(counts))
    scored = cut(score(base, p))
    labelled = scored.where("n_chars > 0").join(told, F.col("id") == F.col("_id")).where(~F.col("_good") | held).select("lang", "n_chars", "bits", "_good")
    own = cut(labelled)
    means = own.where("_good").groupBy("lang").agg(F.sum("bits").alias("b"), F.sum("n_chars").alias("c"), F.count("*").alias("m"))
    pooled = means.agg((F.sum("b") / F.sum("c")).alias("m")).first().m
    if pooled is None:  # no held-out text
        pooled = scored.agg(F.sum("bits") / F.sum("n_chars")).first()[0] or 0.0
    means = cut(means.where(F.col("m") >= rule.least).select(F.col("lang").alias("_lang"), (F.col("b") / F.col("c")).alias("_mean")))
    drawn = lambda f: f.join(means, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("perplexity", F.pow(F.lit(2.0), (F.col("bits") + rule.prior * F.coalesce("_mean", F.lit(pooled))) / (F.col("n_chars") + rule.prior)))
    at = F.percentile_approx("perplexity", rule.quantile, 10000)
    limits = cut(drawn(own.where("_good")).where("_mean IS NOT NULL").groupBy("lang").agg(at.alias("threshold")).select(F.col("lang").alias("_of"), "threshold"))
    every = drawn(own.where("_good")).agg(at.alias("t")).first().t
    every = 2.0**pooled if every is None else every
    limited = lambda f: drawn(f).join(limits, F.col("lang").eqNullSafe(F.col("_of")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(every)))
    share = F.ceil(F.least(F.col("perplexity") / F.col("threshold"), F.lit(4.0)) * 1000).cast("int")
    bins = limited(own).groupBy(share.alias("at")).agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"))
    factor = fit_factor([tuple(r) for r in bins.collect()], rule.factor)  # at most 4001 rows
    out = limited(scored).withColumn("threshold", F.col("threshold") * factor)
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang), "n_chars", "perplexity", "threshold", ((F.col("n_chars") == 0) | (F.col("perplexity") <= F.col("threshold"))).alias("kept"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return classify(docs, labels)
