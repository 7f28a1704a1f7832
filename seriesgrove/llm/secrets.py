"""Operator 1, secret scans.

Base findings are three fixed patterns. The method adds spans: candidates are
maximal runs of a character class; a window slides over each candidate and its
Shannon entropy is kept by incremental counts (one character enters, one
leaves); windows at or above the class's threshold are merged into spans. The
allow list suppresses candidates that are known not to be secrets: base
findings stay in any case.

Defined results: a null text is an empty text and has no spans. Repeated rows
get equal results. Spans count code points, the end is exclusive. A method span
that lies inside a base span is not repeated. Out of the method's reach are keys
of letters alone, which are like words, and runs shorter than a class's window;
tests measure the share of random keys that each class finds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesgrove.llm import textops

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of hex digits shorter than 16 fail and never overlap longer ones, so they need not be found.
HEX = re.compile(r"[0-9a-f]{16,}")


@dataclass(frozen=True)
class CharClass:
    """Candidates are the runs of `run`; a window of `window` characters with `bits` of entropy or more, and so many digits, is secret-like."""

    kind: str
    run: str
    window: int
    bits: float
    digits: int = 0


#: A base-64 window must also mix letters of both cases with digits, since plain words have high entropy, too; those of one case must have digits.
CLASSES = (
    CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.7), CharClass("entropy_hexupper", r"[0-9A-F]{24,}", 24, 3.0),
    CharClass("entropy_lower", r"[a-z0-9]{20,}", 20, 3.7, 2), CharClass("entropy_upper", r"[A-Z0-9]{20,}", 20, 3.7, 2),
    CharClass("entropy_hexmixed", r"[0-9a-fA-F]{32,}", 32, 3.2, 4),
)
#: Whole candidates that are no secrets: UUIDs, digits only, words and paths with a short number at the end, well-known digests of nothing, the sample key of a well-known manual.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9=_+/-]+",
    r"[A-Za-z/_+=-]+[0-9]{0,4}",
    r"(?i:d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
)
#: Pieces of candidates that are no secrets, whatever else is joined to them.
PLACEHOLDER = re.compile(r"[A-Za-z0-9]*(?:example|placeholder|changeme|xxxxxxxx)[A-Za-z0-9]*", re.IGNORECASE)

ORDER = {"assign": 0, "access": 1, "hex": 2} | {c.kind: 3 + i for i, c in enumerate(CLASSES)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]]))


def high_windows(run: str, window: int, bits: float, digits: int = 0) -> list[tuple[int, int]]:
    """Merged ranges of the windows with that entropy or more, and that many digits.

    H = log2(w) - (1/w) * sum of c*log2(c); the sum is kept while the window moves, in units of 2**-32, so that it stays
    exact however long the run is.
    """
    if len(run) < window:
        return []
    unit = 1 << 32
    term = [0] + [round(c * math.log2(c) * unit) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    total = held = 0
    most = window * (math.log2(window) - bits) * unit + window
    out: list[tuple[int, int]] = []
    for i, ch in enumerate(run):
        if i >= window:
            old = run[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
            held -= "0" <= old <= "9"
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        held += "0" <= ch <= "9"
        if i >= window - 1 and total <= most and held >= digits:
            a = i - window + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def within(spans: list[tuple[int, int, str]]):
    """Whether a range lies inside one of the spans."""
    spans = sorted(spans)
    begins, reach = [x for x, _, _ in spans], list(accumulate((y for _, y, _ in spans), max))
    return lambda a, z: (i := bisect_right(begins, a)) > 0 and reach[i - 1] >= z


class Scanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = [(c, re.compile(c.run)) for c in classes]
        self.allow = re.compile("|".join(f"(?:{x})" for x in allow)) if allow else None

    def pieces(self, run: str) -> list[tuple[int, str]]:
        """What is left of a candidate without placeholders, with its place."""
        if not self.allow:
            return [(0, run)]
        out, at = [], 0
        for m in PLACEHOLDER.finditer(run):
            out.append((at, run[at : m.start()]))
            at = m.end()
        return [*out, (at, run[at:])]

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        found: list[tuple[int, int, str]] = []
        for c, pattern in self.classes:
            added, held = [], within(found)
            for m in pattern.finditer(text):
                if self.allow and self.allow.fullmatch(m[0]):
                    continue
                for at, run in self.pieces(m[0]):
                    if self.allow and self.allow.fullmatch(run):
                        continue
                    for a, z in high_windows(run, c.window, c.bits, c.digits):
                        part = run[a:z]
                        if c.kind == "entropy_base64" and not (re.search("[a-z]", part) and re.search("[A-Z]", part) and re.search("[0-9]", part)):
                            continue
                        a, z = m.start() + at + a, m.start() + at + z
                        if not held(a, z):
                            added.append((a, z, c.kind))
            found += added
        added = found
        inside = within(base)
        extra = [x for x in added if not inside(x[0], x[1])]
        order = {k: i for i, k in enumerate(["assign", "access", "hex", *(c.kind for c, _ in self.classes)])}
        return base, sorted(base + extra, key=lambda x: (x[0], order[x[2]], x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(text, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
    """For a text column: struct of `base` and `spans`, each an array of (kind, start, end)."""

    @F.arrow_udf(f"struct<base:{SPANS},spans:{SPANS}>")
    def run(texts: pa.Array) -> pa.Array:
        scanner = Scanner(classes, allow)
        found = [scanner.spans(t.as_py() or "") for t in texts]
        shaped = [pa.array([[{"kind": k, "start": a, "end": z} for a, z, k in f[i]] for f in found], _SPAN) for i in (0, 1)]
        textops.give_back()
        return pa.StructArray.from_arrays(shaped, names=["base", "spans"])

    return run.asNondeterministic()(text)


def redact(text, mark: str = "[SECRET]", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
    """The text with each found span replaced by `mark`; overlapping spans are replaced once; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        scanner = Scanner(classes, allow)
        out = []
        for t in texts:
            s = t.as_py()
            if s:
                parts, at = [], 0
                for a, z, _ in scanner.spans(s)[1]:
                    if a >= at:
                        parts += [s[at:a], mark]
                    at = max(at, z)
                s = "".join(parts) + s[at:] if parts else s
            out.append(s)
        textops.give_back()
        return pa.array(out, pa.string())

    return run.asNondeterministic()(text)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Adds the struct of scan() under the name `into`, or the next free name; one scan, no shuffle."""
    return docs.withColumn(textops.fresh(docs.columns, into), scan(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with secrets replaced in the text, and `length`, if named, set to the new number of characters."""
    name = textops.fresh(docs.columns, "redacted")
    out = docs.withColumn(name, redact(F.col(text)))
    changed = {text: F.col(name)}
    if length:
        changed[length] = F.when(F.col(name).eqNullSafe(F.col(text)), F.col(length)).otherwise(F.length(name)).cast("long")
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", F.col("secrets.base").alias("base"), F.col("secrets.spans").alias("all"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))
