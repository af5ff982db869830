"""Neighbours by tokens: what reaches the driver doesn't follow the corpus' vocabulary."""

import duckdb
import pytest
from basalt import plans
from basalt.operators import recommend
from pyspark.sql import functions as F

#: Tokens of one document each; more than may be broadcast.
OWN = 60
LONG = "x" * 200


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """2,500 documents with a few common words and 60 tokens of their own, and 12 items made of both."""
    d = tmp_path_factory.mktemp("tables")
    own = f"array_join(transform(sequence(1, {OWN}), j -> 'own' || id || '-' || j), ' ')"
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.expr(f"concat_ws(' ', 'The', 'w' || id % 7, 'w' || id % 31, repeat('r' || id % 97 || ' ', 1 + id % 3), {own}, if(id % 5 = 0, '{LONG}', null))").alias("text"), F.expr("'src' || id % 5").alias("source"))
    docs.write.parquet(f"{d}/documents.parquet")
    items = spark.range(12).select(F.col("id").alias("item_id"), F.expr(f"concat_ws(' ', 'the w' || id % 7, 'r' || id, 'r' || 3 * id, 'own' || 20 * id || '-1', if(id = 3, '{LONG}', 'unknown'))").alias("text"))
    items.write.parquet(f"{d}/benchmark.parquet")
    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["cosine_topk", "weighted_vote"])
def test_the_driver_holds_few_tokens_and_short_plans(spark, tables, name, monkeypatch):
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.append(df.count()), broadcast(df))[1])
    got = plans.queries()[name](spark, tables)
    vocabulary = duckdb.sql("select count(distinct token) from (select unnest(regexp_extract_all(lower(text), '[\\w-]+')) as token from documents)").fetchall()[0][0]
    assert vocabulary > 2500 * OWN and sent and max(sent) < 1000
    assert len(got._jdf.queryExecution().toString()) < 200_000
    want = duckdb.sql(plans.oracle_sql()[name])
    columns, want = want.columns, sorted(want.fetchall())
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert len(rows) == len(want) > 12
    for a, b in zip(rows, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6)


@pytest.mark.parametrize("most", [0, 9, 100_000])
def test_weights_of_some_tokens_are_those_of_all(spark, most):
    docs = spark.range(60).select("id", F.expr(f"concat_ws(' ', 'All', id % 2, 'a-b a-b', 'p' || id % 11, 'own' || id, if(id % 4 < 2, '{LONG}', null))").alias("text"))
    counts = recommend.token_counts(docs, "id", "text")
    weights = recommend.idf(counts, docs.agg(F.count("*").alias("docs")))
    every = {(r.id, r.token): r.weight for r in recommend.tfidf(counts, weights, most).collect()}
    wanted = {"all", "1", "own7", LONG}
    some = {(r.id, r.token): r.weight for r in recommend.tfidf(counts, weights, most, spark.createDataFrame([(t,) for t in [*wanted, "1", "unknown"]], "token string")).collect()}
    assert sum(t == LONG for _, t in every) == 30 and len(every) == 60 * 5 + 30
    assert some.keys() == {k for k in every if k[1] in wanted} and all(abs(some[k] - every[k]) < 1e-12 for k in some)


def test_long_tokens_are_not_broadcast(spark, monkeypatch):
    counts = spark.createDataFrame([(1, "a", 1), (1, LONG, 2), (2, LONG, 1)], "id long, token string, tf long")
    weights = spark.createDataFrame([("a", 2.0), (LONG, 1.0)], "token string, idf double")
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.append({r.token for r in df.collect()}), broadcast(df))[1])
    got = {(r.id, r.token): r.weight for r in recommend.tfidf(counts, weights).collect()}
    assert sent and set().union(*sent) == {"a"}
    assert got == pytest.approx({(1, "a"): 0.5**0.5, (1, LONG): 0.5**0.5, (2, LONG): 1.0})
