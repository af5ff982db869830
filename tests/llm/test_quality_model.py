"""The n-gram table of the quality rules, against the model fitted in memory."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("basalt.llm")
from basalt.llm import quality_rules  # noqa: E402


def test_perplexity_crosses_words(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "cat", "Sat", "on", "é", "mat"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    salad = "the cat sat on the mat " * 4
    texts += [salad, " ".join(sorted(salad.split())), None, " \n", "the\n\tcat"]
    grams = []
    for t in texts:
        stream = b" ".join((t or "").lower().encode().split()) + b" "
        stream = stream if stream.strip() else b""
        grams.append([int.from_bytes((b"    " + stream)[i : i + 5], "big") for i in range(len(stream))])
    own, count = np.unique(np.array([g for x in grams for g in x], np.uint64), return_counts=True)
    model = quality_rules.fit(own, count, 5)
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    got = {r.doc_id: r.log_perplexity for r in quality_rules.judge_quality(df).collect()}
    for i, x in enumerate(grams):
        if x:
            assert got[i] == pytest.approx(-model.log_probs(np.array(x, np.uint64)).mean(), abs=1e-5)
        else:
            assert got[i] is None or math.isnan(got[i])
    assert abs(got[60] - got[61]) > 1e-3  # the same words in another order; no difference where n-grams end with words
