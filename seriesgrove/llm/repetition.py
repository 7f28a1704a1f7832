"""Operator 10, quality rules by repetition coverage.

For several n-gram lengths, every window of n words gets a rolling hash in
numpy; windows found twice or more in the same text mark their words, and the
marked share of the text's word characters is the coverage of that length.
Lines equal to an earlier line are measured in the same way. A text is rejected
when it fails the base rules or when a coverage is above its limit.

Defined results: a null or empty text has no words, fails the base rule on the
word count and is rejected; its measures are 0. Repeated rows get equal
results. Other columns, nulls in them included, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesgrove.llm import textops

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """Most coverage by duplicated n-grams for each n, and by duplicated lines, as shares of the word characters.

    A window's first occurrence counts as well, so a line that stands twice in a short, otherwise good text weighs double;
    the limits leave room for it.
    """

    ngram: dict[int, float] = field(default_factory=lambda: {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20})
    lines: float = 0.30
    min_words: int = 10
    repeat_percent: int = 20


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, dup_line_chars bigint, ngram_chars array<bigint>"


def found_twice(hashes: np.ndarray) -> np.ndarray:
    """Marks the values that occur at least twice."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        order = np.argsort(hashes)
        s = hashes[order]
        same = s[1:] == s[:-1]
        if same.any():
            out[order[1:][same]] = True
            out[order[:-1][same]] = True
    return out


def covered(twice: np.ndarray, n: int, words: int) -> np.ndarray:
    """Marks the words inside marked windows of n words."""
    sums = np.zeros(words + n + 1, np.int64)
    np.cumsum(twice, out=sums[n + 1 : n + 1 + len(twice)])
    sums[n + 1 + len(twice) :] = sums[n + len(twice)]
    at = np.arange(words)
    return sums[at + n + 1] - sums[at + 1] > 0


def measure(texts: pa.Array, limits: Limits) -> dict[str, list]:
    """The columns of FIELDS for each text."""
    lengths = sorted(set(limits.ngram) | {5})
    out: dict[str, list] = {x.split()[0]: [] for x in FIELDS.split(", ")}
    for b in textops.blocks(texts):
        starts, ends, first = b.words()
        hashes = textops.hash_words(b.data, starts, ends)
        head = (b.data & 0xC0) != 0x80  # first bytes of code points
        points = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(head, out=points[1:])
        chars = points[ends] - points[starts]
        symbols = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(SYMBOLS[b.data], out=symbols[1:])
        breaks = np.flatnonzero(b.data == 0x0A)
        for k in range(len(b)):
            lo, hi = int(b.bounds[k]), int(b.bounds[k + 1])
            h, c = hashes[first[k] : first[k + 1]], chars[first[k] : first[k + 1]]
            words, total = len(h), int(c.sum())
            repeated, grams = 0, []
            for n in lengths:
                twice = found_twice(textops.windows(h, n))
                mark = covered(twice, n, words) if twice.any() else None
                if n == 5 and mark is not None:
                    repeated = int(mark.sum())
                if n in limits.ngram:
                    grams.append(0 if mark is None else int(c[mark].sum()))
            inner = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)]
            dup_lines = dup_chars = 0
            if len(inner):
                seen: set[bytes] = set()
                a, w = lo, int(first[k])
                for z in [*inner.tolist(), hi]:
                    v = int(np.searchsorted(starts, z)) if z < hi else int(first[k + 1])
                    if v > w:
                        line = b.data[a:z].tobytes()
                        if line in seen:
                            dup_lines += 1
                            dup_chars += int(chars[w:v].sum())
                        seen.add(line)
                    a, w = z + 1, v
            failed = words < limits.min_words or 100 * repeated > limits.repeat_percent * words
            good = not failed and dup_chars <= limits.lines * total and all(x <= limits.ngram[n] * total for x, n in zip(grams, sorted(limits.ngram), strict=True))
            row = (words, total, int(symbols[hi] - symbols[lo]), dup_lines, repeated, failed, good, dup_chars, grams)
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
    return out


def to_struct(columns: dict[str, list]) -> pa.StructArray:
    kinds = {"boolean": pa.bool_(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    types = {x.split()[0]: kinds[x.split()[1]] for x in FIELDS.split(", ")}
    return pa.StructArray.from_arrays([pa.array(v, types[k]) for k, v in columns.items()], names=list(columns))


def coverage(text, limits: Limits = Limits()):
    """The struct of FIELDS for a text column."""

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in FIELDS.split(', '))}>")
    def run(texts: pa.Array) -> pa.Array:
        out = to_struct(measure(texts, limits))
        textops.give_back()
        return out

    return run.asNondeterministic()(text)  # so that a filter on the result does not run it again


def repetition_rules(docs: DataFrame, text: str = "text", limits: Limits = Limits(), into: str = "rules") -> DataFrame:
    """Adds the struct of FIELDS under the name `into`, or the next free name; one scan, no shuffle."""
    return docs.withColumn(textops.fresh(docs.columns, into), coverage(F.col(text), limits))


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows that the rules keep, with the columns of docs."""
    name = textops.fresh(docs.columns, "rules")
    return repetition_rules(docs, text, limits, name).where(F.col(f"{name}.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_repetition_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repetition_rules(docs.select("doc_id", "text")).select("doc_id", "rules.*")


def _op10_sql(limits: Limits = Limits()) -> str:
    space = "[ \\t\\n\\x0B\\f\\r]+"
    lengths = sorted(limits.ngram)
    kept = " AND ".join(f"ngram_chars[{i + 1}] <= {limits.ngram[n]}::DOUBLE * word_chars" for i, n in enumerate(lengths))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda x: x <> '') AS words FROM documents
), g AS (SELECT doc_id, n, i, hash(array_to_string(words[i : i + n - 1], ' ')) AS h, array_to_string(words[i : i + n - 1], ' ') AS k FROM d, (SELECT unnest({lengths}) AS n), LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS i)
), twice AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, h, k) AS c FROM g) WHERE c > 1
), marked AS (SELECT DISTINCT doc_id, n, i + o AS i FROM twice, LATERAL (SELECT unnest(range(n)) AS o)
), covered AS (SELECT doc_id, n, count(*) AS w, sum(length(words[i])) AS c FROM marked JOIN d USING (doc_id) GROUP BY doc_id, n
), lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^ \\t\\x0B\\f\\r]')
), dup AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '{space}', '', 'g'))) AS dup_line_chars FROM lines WHERE r > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce((SELECT w FROM covered c WHERE c.doc_id = d.doc_id AND n = 5), 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
    [{", ".join(f"CAST(coalesce((SELECT c FROM covered c WHERE c.doc_id = d.doc_id AND n = {n}), 0) AS BIGINT)" for n in lengths)}] AS ngram_chars
  FROM d LEFT JOIN dup USING (doc_id)
), v AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= {limits.lines}::DOUBLE * word_chars AND {kept} AS kept FROM v
"""


OP10_SQL = _op10_sql()
