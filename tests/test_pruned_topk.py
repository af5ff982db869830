"""The pruned inverted index gives what all pairs give, from a small part of the postings."""

import numpy as np
import pytest
from basalt.operators import recommend
from pyspark.sql import functions as F


def weights(spark, docs):
    rows = []
    for i, words in docs.items():
        norm = sum(w * w for w in words.values()) ** 0.5 or 1.0
        rows += [(i, t, w / norm) for t, w in words.items()]
    return spark.createDataFrame(rows, "id long, token string, weight double")


def brute(queries, corpus, k):
    unit = lambda d: {t: w / sum(x * x for x in d.values()) ** 0.5 for t, w in d.items()}
    out = set()
    docs = {i: unit(d) for i, d in corpus.items()}
    for q, words in queries.items():
        own = unit(words)
        sims = sorted(((-round(sum(w * d[t] for t, w in own.items() if t in d), 9), i) for i, d in docs.items() if own.keys() & d.keys()))
        out |= {(q, i, -s, place) for place, (s, i) in enumerate(sims[:k], 1)}
    return out


def corpus_of(n, rng):
    """Each text has every one of ten common words with a small weight, and a few of many rare ones."""
    return {i: {f"the{j}": float(rng.uniform(0.05, 0.2)) for j in range(10)} | {f"rare{r}": float(rng.uniform(1, 3)) for r in rng.integers(0, n // 8, 4)} for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_topk_equals_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    corpus = corpus_of(600, rng)
    queries = {1000 + i: dict(corpus[i]) for i in range(0, 600, 40)}
    queries |= {2000: {"the0": 1.0, "the3": 0.5}, 2001: {"unknown": 1.0}, 2002: {"rare1": 1.0}, 2003: {"the1": 0.2, "rare2": 1.0, "rare3": 1.0}}
    corpus |= {5000 + i: {"same": 1.0, "the0": 1.0} for i in range(9)}  # ties by id
    queries[2004] = {"same": 1.0}
    for k in (1, 5):
        got = recommend.cosine_topk(weights(spark, queries), weights(spark, corpus).repartition(5), k)
        assert {(r.query, r.id, r.sim, r.place) for r in got.collect()} == brute(queries, corpus, k)


def test_common_words_bring_few_postings(spark):
    rng = np.random.default_rng(3)
    corpus = corpus_of(4000, rng)
    queries = {10_000 + i: dict(corpus[i]) for i in range(0, 4000, 200)}
    asked, _ = recommend.pruned_postings(weights(spark, queries), weights(spark, corpus))
    every, essential = asked.agg(F.sum("df"), F.sum(F.when(F.col("is_essential"), F.col("df")))).first()
    assert every > 20 * 10 * 4000 and essential < every / 10


def test_empty_sides(spark):
    some, none = weights(spark, {1: {"a": 1.0}}), weights(spark, {1: {"a": 1.0}}).limit(0)
    assert recommend.cosine_topk(some, none).count() == recommend.cosine_topk(none, some).count() == 0
