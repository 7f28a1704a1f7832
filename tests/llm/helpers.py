"""Documents for the edge cases, and plain versions of the contracts."""

import re
from collections import Counter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def edge_rows():
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, odd characters."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    return [
        (1, None, "en", "a", 3), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", None, None, 7), (4, base, "en", None, len(base)), (5, base, "fr", "b", len(base)), (5, base, "fr", "b", len(base)),
        (6, long, "en", "a", len(long)), (7, "é́ 中文字 😀   x y <|endoftext|> ẞ İ", "de", "c", None), (None, base + " tomorrow", "en", "b", 1), (None, None, None, None, None), (8, "one", "en", "b", 3), (9, "one", "en", "b", 3),
    ]


def write_sf(spark, path, rows, schema=DOCS):
    """A folder with a documents table, as queries read it."""
    documents(spark, rows, schema).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def shingle_set(text):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows):
    """id -> (set size, component) of (id, text) rows by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(groups[find(i)])) for i in range(len(rows))}


def plain_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    found = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if found[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), n < 10 or 100 * len(marked) > 20 * n


def table(frame):
    return sorted(map(tuple, frame.collect()), key=repr)
