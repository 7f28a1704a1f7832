"""Operator 9, MinHash near-dedup with HyperMinHash registers.

A text's set is that of its distinct 5-word shingles, lower-cased. A sketch has
128 buckets; of the least hash in a bucket it stores the number of leading
zeros and the next 10 bits after the first one, 16 bits in all. An empty bucket
takes the register of another one, drawn in a fixed random order, so that small
sets are compared as well as large ones. Four registers make a band.

1. Texts with equal sets form a class at once; classes are compared from here.
2. In each bucket of a band, each class is a candidate for the bucket's first
   class. Of its candidates each class keeps the one with the highest Jaccard
   estimate, corrected for chance collisions of registers; full sets confirm it.
3. Components of the confirmed links join most classes. Any two classes that
   share a bucket but are in different components still are candidates, so those
   of a bucket's largest component are sent to the others only. They get
   sketches of 512 buckets, where the least hashes are a sample of the union
   without replacement, for small sets nearly all of it; those whose corrected
   estimate is not well below the threshold are confirmed on full sets.
   Candidates within one component could not change it.

With 32 bands of 4, two sets at the threshold of 0.75 are missed with a
probability of about 5e-6.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing. Ids should be unique: rows that share an id count
as one document, links are confirmed on the longest of its texts, and each of
them gets its component. A null id is never a
component's id unless all its ids are null. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesgrove.llm import textops
from seriesgrove.llm.lineage import components, cut

BUCKET_BITS, MANTISSA = 7, 10
BUCKETS, ROWS = 1 << BUCKET_BITS, 4
BANDS = BUCKETS // ROWS
WORDS = 5
#: The similarity as a fraction of integers, and how many standard deviations an estimate may be below it.
OVER, UNDER, SIGMAS = 75, 100, 4.5
FINE_BITS = 9
NO_ID = (1 << 63) - 1


@cache
def _bounds(bits: int) -> np.ndarray:
    return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)


@cache
def lenders() -> np.ndarray:
    """For each bucket, the order in which it asks the others for a register."""
    rng = np.random.default_rng(20140601)
    order = np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])
    own = np.argmax(order == np.arange(BUCKETS)[:, None], axis=1)
    order[np.arange(BUCKETS), own] = order[:, 0]
    order[:, 0] = np.arange(BUCKETS)
    return order


def registers(hashes: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The registers (leading zeros, then mantissa) of a sorted array of distinct hashes that is not empty, and which buckets hold any."""
    at = np.searchsorted(hashes, _bounds(bits))
    filled = at < np.append(at[1:], len(hashes))
    least = hashes[np.minimum(at, len(hashes) - 1)] << np.uint64(bits)
    _, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint64)
    mantissa = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype("<u2"), filled


def sketch(hashes: np.ndarray) -> np.ndarray:
    """128 registers in 32 longs; empty buckets borrow."""
    out, filled = registers(hashes)
    if not filled.all():
        order = lenders()
        out = out[order[np.arange(BUCKETS), np.argmax(filled[order], axis=1)]]
    return out.view("<i8")


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    """512 registers, one more than their value; empty buckets have 0."""
    if not len(hashes):
        return np.zeros(1 << FINE_BITS, "<u2")
    out, filled = registers(hashes, FINE_BITS)
    return np.where(filled, out + np.uint16(1), np.uint16(0)).astype("<u2")


@cache
def chance(size: int) -> float:
    """The chance that the registers of one bucket agree for two unrelated sets of that size."""
    zeros = np.arange(0, 64 - BUCKET_BITS)
    low = 2.0 ** -(zeros + 1.0)
    edges = low[:, None] * (1 + np.arange((1 << MANTISSA) + 1) / (1 << MANTISSA))
    above = np.exp(size * np.log1p(-edges / BUCKETS))
    cells = above[:, :-1] - above[:, 1:]
    return float((cells**2).sum() / max(cells.sum(), 1e-300) ** 2)


def rounded(n: int) -> int:
    """A size to two binary digits, so that few sizes are worked out."""
    shift = max(0, n.bit_length() - 3)
    return n >> shift << shift


@textops.tidy
def _sign(batches: Iterator[pa.RecordBatch], lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in textops.blocks(batch.column(1)):
            starts, ends, first = b.words()
            hashes = textops.hash_words(b.data, starts, ends, lower)
            size, digest, chances, regs = [], [], [], []
            for k in range(len(b)):
                s = textops.shingles(hashes[first[k] : first[k + 1]], WORDS)
                size.append(len(s))
                if len(s):
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    chances.append(chance(rounded(len(s))))
                    regs.append(sketch(s).tolist())
                else:
                    digest.append(None)
                    chances.append(None)
                    regs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, len(b)), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(chances, pa.float64()), pa.array(regs, pa.list_(pa.int64()))], names=["id", "n", "digest", "chance", "regs"])


def signatures(docs: DataFrame, id_col: str, text: str, lower: bool = True) -> DataFrame:
    """id, n (set size), digest of the set, chance of a collision, regs (a band of four registers in each long)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_sign, lower=lower), "id bigint, n bigint, digest binary, chance double, regs array<bigint>")


def _folded(by: int):
    return lambda x: x.bitwiseOR(F.shiftrightunsigned(x, by))


def _lanes(longs):
    """How many 16-bit lanes of an array of longs are not 0."""
    for by in (8, 4, 2, 1):  # the lowest bit of a lane becomes 1 unless all its bits are 0
        longs = F.transform(longs, _folded(by))
    return F.aggregate(longs, F.lit(0), lambda s, x: s + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001))))


def estimate(a: str, b: str):
    """The Jaccard estimate of two sketches, corrected for the chance of collisions."""
    differ = _lanes(F.zip_with(f"{a}.regs", f"{b}.regs", lambda x, y: x.bitwiseXOR(y)))
    c = F.sqrt(F.col(f"{a}.chance") * F.col(f"{b}.chance"))
    return (1 - differ / BUCKETS - c) / (1 - c)


def possible(a: str, b: str):
    """True unless sizes or estimate rule a link out."""
    j = OVER / UNDER
    near = estimate(a, b) >= j - SIGMAS * (j * (1 - j) / BUCKETS) ** 0.5
    return sized(a, b) & near


def sized(a: str, b: str):
    return UNDER * F.least(f"{a}.n", f"{b}.n") >= OVER * F.greatest(f"{a}.n", f"{b}.n")


def finely_possible(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """False where the fine estimate rules a link out: the buckets that either fills are a sample of the union without replacement."""
    j = OVER / UNDER
    equal = np.count_nonzero(others == one, axis=1)
    empty = np.count_nonzero((others | one) == 0, axis=1)
    filled = len(one) - empty
    union = np.maximum(filled, (size + sizes) / (1 + j))  # of two sets at the threshold
    spread = np.sqrt(j * (1 - j) / filled * (1 - filled / (union + 1)))
    return (equal - empty) / filled >= j - SIGMAS * spread  # chance collisions only raise the share of equal registers


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of distinct shingles are similar enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and UNDER * both >= OVER * (len(a) + len(b) - both)


@textops.tidy
def _confirm(batches: Iterator[pa.RecordBatch], lower: bool) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, u's text, v's text): those whose full sets are similar enough."""
    for batch in batches:
        last: tuple[int, np.ndarray] | None = None
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            v = batch.column(1)[i].as_py()
            if last is None or last[0] != v:
                last = v, set_of(batch.column(3)[i].as_py(), lower)
            keep[i] = linked(set_of(batch.column(2)[i].as_py(), lower), last[1])
        yield batch.select([0, 1]).filter(pa.array(keep))


def set_of(text: str, lower: bool = True) -> np.ndarray:
    for b in textops.blocks(pa.array([text], pa.string())):
        starts, ends, _ = b.words()
        return textops.shingles(textops.hash_words(b.data, starts, ends, lower), WORDS)
    return np.zeros(0, np.uint64)


@textops.tidy
def _fine(batches: Iterator[pa.RecordBatch], lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fine_sketch(set_of(t.as_py(), lower)).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "fine"])


#: Classes of a bucket that are compared with each other in one place. Larger buckets are cut into blocks, each of which
#: meets each other one; blocks grow with the root of the bucket, up to MOST, so that classes are copied less often.
BLOCK, MOST = 1024, 32768


@textops.tidy
def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, i, j, block, id, label, n, regs, fine), sorted by the first four: pairs of different labels that may be links."""

    def of(g: np.ndarray, regs: np.ndarray, fine: np.ndarray) -> pa.RecordBatch | None:
        us, vs = [], []
        band, i, j = int(g[0, 0]), g[0, 2], g[0, 3]
        block, ids, labels, n = g[:, 4], g[:, 5], g[:, 6], g[:, 7]
        for a in np.flatnonzero(block == i):
            ok = (block == j) & (labels != labels[a]) & (UNDER * np.minimum(n, n[a]) >= OVER * np.maximum(n, n[a]))
            if i == j:
                ok &= ids > ids[a]
            at = np.flatnonzero(ok)
            if len(at):
                at = at[finely_possible(fine[a], fine[at], int(n[a]), n[at])]
                at = at[np.argmax(regs[at] == regs[a], axis=1) == band]  # in the first band that they share
                us.append(np.full(len(at), ids[a]))
                vs.append(ids[at])
        if not us:
            return None
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        g = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(8)], axis=1)
        fine = np.frombuffer(b"".join(batch.column(9).to_pylist()), "<u2")
        rows = g, batch.column(8).flatten().to_numpy().reshape(-1, BANDS), fine.reshape(-1, 1 << FINE_BITS)
        if held:
            rows = tuple(np.concatenate([x, y]) for x, y in zip(held.pop(), rows, strict=True))
        cuts = np.flatnonzero((rows[0][1:, :4] != rows[0][:-1, :4]).any(axis=1)) + 1
        lo = 0
        for hi in cuts.tolist():
            if hi - lo > 1 and (out := of(*(x[lo:hi] for x in rows))) is not None:
                yield out
            lo = hi
        held = [tuple(x[lo:] for x in rows)]
    for rows in held:
        if len(rows[0]) > 1 and (out := of(*rows)) is not None:
            yield out


def confirm(pairs: DataFrame, texts: DataFrame, lower: bool) -> DataFrame:
    """The pairs (u, v) that are links by their full sets."""
    one = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    two = one.join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
    return two.select("u", "v", "a", "b").mapInArrow(partial(_confirm, lower=lower), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lower: bool = True) -> DataFrame:
    """doc id, n_shingles, class_id (least id with an equal set), component_id, kept; one row for each row of docs."""
    signed = cut(signatures(docs, id_col, text, lower))
    classes = signed.where("n > 0").groupBy("digest").agg(F.min_by(F.struct("id", "n", "chance", "regs"), "id").alias("c")).select("digest", "c.*")
    classes = cut(classes)
    banded = classes.select("id", F.posexplode("regs").alias("band", "key"))
    # Tables of buckets are cut, so that a join with a hot bucket's members can be split.
    shared = cut(banded.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("id").alias("low")).where("m > 1"))
    near = cut(banded.join(shared, ["band", "key"]).select("band", "key", "id", "low"))
    # What may have links at all: their sketches and texts, once.
    some = near.select("id").distinct()
    sketches = cut(classes.drop("digest").join(some, "id"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    longest = F.struct(F.length(F.coalesce("text", F.lit(""))), F.col("text"))  # where rows share an id
    texts = cut(rows.join(some, "id").groupBy("id").agg(F.max_by("text", longest).alias("text")))
    side = lambda x: sketches.select(F.col("id").alias(x), F.struct("n", "chance", "regs").alias(f"s{x}"))
    first = near.where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()
    first = first.join(side("u"), "u").join(side("v"), "v").where(possible("su", "sv")).select("u", "v", estimate("su", "sv").alias("e"))
    best = first.groupBy("u").agg(F.max_by("v", F.struct("e", -F.col("v"))).alias("v"))
    sure = cut(confirm(best, texts, lower))
    # What is not joined yet.
    labels = components(sure)
    told = near.join(labels, "id", "left").select("band", "key", "id", F.coalesce("label", "id").alias("label"))
    counts = told.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    apart = counts.groupBy("band", "key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("m")).where("labels > 1")
    # Members of a bucket's most frequent component meet the others only: its blocks come first.
    fit = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), BLOCK / 64 * F.sqrt("m")))
    apart = apart.select("band", "key", "top", F.ceil(F.col("most") / fit).cast("int").alias("tops"), F.ceil((F.col("m") - F.col("most")) / fit).cast("int").alias("others"))
    told = cut(told.join(cut(apart), ["band", "key"]))
    some = told.select("id").distinct()
    fine = texts.join(some, "id").select("id", "text").mapInArrow(partial(_fine, lower=lower), "id bigint, fine binary")
    fine = cut(sketches.join(fine, "id").select("id", "n", "regs", "fine"))
    topped = F.col("label") == F.col("top")
    block = F.when(topped, F.pmod(F.xxhash64("id"), F.col("tops"))).otherwise(F.col("tops") + F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    placed = told.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.when(topped, F.col("tops")).otherwise(0), F.col("tops") + F.col("others") - 1)))
    placed = placed.select("band", "key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "label").join(fine, "id")
    placed = placed.select("band", "key", "i", "j", "block", "id", "label", "n", "regs", "fine").repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    others = confirm(placed.mapInArrow(_open_pairs, "u bigint, v bigint"), texts, lower)
    final = components(sure.unionByName(others))
    found = classes.select("digest", F.col("id").alias("class_id")).join(final.withColumnRenamed("id", "class_id"), "class_id", "left").select("digest", "class_id", F.coalesce("label", "class_id").alias("component"))
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    given = lambda c: F.when(F.col(c).isNull(), own).otherwise(F.when(F.col(c) != NO_ID, F.col(c)))
    out = signed.select("id", "n", F.coalesce("digest", F.encode(F.concat(F.lit("none "), F.col("id").cast("string")), "utf-8")).alias("digest")).join(found, "digest", "left")
    return out.select(own.alias(id_col), F.col("n").alias("n_shingles"), given("class_id").alias("class_id"), given("component").alias("component_id"), (own.eqNullSafe(given("component"))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with its columns: one of each component.

    Of rows with the same id and text one stays. Rows with the same id and different texts are one document, and stay
    or go together. Rows without an id are compared by their texts and stay only where no row with an id is like them.
    """
    key = textops.fresh(docs.columns, "row_id")
    digest = textops.fresh([*docs.columns, key], "text_digest")  # 128 bits of two seeds
    whole = F.coalesce(F.col(text), F.lit(""))
    made = F.shiftleft(F.lit(1).cast("long"), 62) + F.shiftrightunsigned(F.xxhash64(whole), 3)
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), made)).withColumn(digest, F.struct(F.xxhash64(whole), F.xxhash64(F.lit(7), whole)))
    kept = near_duplicates(keyed, key, text).where("kept").select(F.col(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key, digest]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS set FROM w
), n AS MATERIALIZED (SELECT doc_id, CAST(len(set) AS BIGINT) AS n FROM s), e AS MATERIALIZED (SELECT doc_id, unnest(set) AS x FROM s
), links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (SELECT doc_id AS id, doc_id AS r FROM n UNION SELECT reach.id, links.v FROM reach JOIN links ON links.u = reach.r
), c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), k AS (SELECT e.doc_id, md5(string_agg(x, chr(10) ORDER BY x)) AS k FROM e GROUP BY e.doc_id
), m AS (SELECT k, min(doc_id) AS class_id FROM k GROUP BY k)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept, coalesce(m.class_id, n.doc_id) AS class_id
FROM n JOIN c ON c.id = n.doc_id LEFT JOIN k ON k.doc_id = n.doc_id LEFT JOIN m ON m.k = k.k
"""
