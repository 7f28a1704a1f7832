import random

import pytest

from seriesgrove.llm import quality
from tests.llm.helpers import documents

LABELS = "doc_id bigint, quality int, toxic int"


def test_labelled_bad_documents_set_the_threshold(spark):
    rng = random.Random(6)
    parts = ["the", "cat", "ing", "and", "ouse", "ther", "of"]
    rows, labels = [], []
    for i in range(200):
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(400))
        if i % 8 == 0:
            text = "".join(c if rng.random() > 0.004 else rng.choice("qxzjkv") for c in text)
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, int(i % 8 != 0), 0))
    out = quality.classify(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == 200
    assert all(r.kept == (r.doc_id % 8 != 0) for r in out), sorted((r.perplexity / r.threshold, r.doc_id % 8 != 0) for r in out)


def test_the_factor_makes_the_fewest_errors():
    assert quality.fit_factor([(900, 50, 0), (1020, 3, 0)], 1.15) == 1.15
    assert quality.fit_factor([(900, 50, 1), (1020, 3, 0), (1101, 0, 9)], 1.15) == pytest.approx(1.06)
    assert quality.fit_factor([(900, 50, 0), (950, 0, 60)], 1.15) == pytest.approx(1.0)
