"""Exact samples, database sources on the bundled database, relation discovery and nearest-neighbour mutual information."""

import hashlib
import math

import numpy as np
import pytest
from basalt import sources
from basalt.operators import mart, synth
from pyspark.sql import functions as F

# -- samples ----------------------------------------------------------------------------


def test_exact_sample_is_exact_and_stable(spark):
    rows = [(i, f"v{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v string")
    told = {i for i in sorted(range(3000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:777]}
    for parts, few in ((1, 100_000), (7, 100_000), (3, 1)):  # with one row as few the last bin is counted digit by digit
        assert {r.id for r in sources.exact_sample(df.repartition(parts), "id", 777, few).collect()} == told
    assert sources.exact_sample(df, "id", 0).count() == 0 and sources.exact_sample(df, "id", 3000).count() == sources.exact_sample(df, "id", 9999).count() == 3000
    assert sources.exact_sample(df.limit(0), "id", 5).count() == 0
    assert sources.adaptive_sample(df, "id", 500).count() == 500 and sources.adaptive_sample(df, "id", 0).count() == sources.adaptive_sample(df, "id", 3000).count() == 3000


def test_exact_sample_of_a_hot_key(spark):
    rows = [(1 if i % 3 == 0 else i, i if i % 2 else 0) for i in range(2000)] + [(None, None)] * 5
    for n in (1, 400, 900, 1500):
        for few in (1, 50, 100_000):
            assert sources.exact_sample(spark.createDataFrame(rows, "id long, v long"), "id", n, few).count() == n


def test_sampling_queries_of_databases():
    assert sources.sampling_query("postgresql", "t", 1_000_000) == "select * from t tablesample bernoulli (5.0000)"
    assert sources.sampling_query("oracle", "t", 200_000) == "select * from t sample (25.0000)"
    assert sources.sampling_query("sqlserver", "t", 10**12).endswith("(0.1000 percent)")
    assert sources.sampling_query("sqlite", "t", 10**6, 10).endswith("random() limit 10")
    assert sources.sampling_query("mysql", "t", 10**6, 10) == "select * from t limit 10"
    assert sources.sampling_query("postgresql", "t", 10, 10) == "select * from t"


# -- databases --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def database(spark):
    """An in-memory database of the kind that comes with Spark: customers, and orders with a foreign key."""
    url = "jdbc:derby:memory:shop;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = connection.createStatement()
    run.execute("create table customers (id bigint primary key, name varchar(20))")
    run.execute("create table orders (order_id bigint primary key, customer_id bigint references customers(id), amount double)")
    for i in range(40):
        run.execute(f"insert into customers values ({1000 + i}, 'name {i}')")
    for i in range(200):
        run.execute(f"insert into orders values ({i}, {'null' if i % 50 == 0 else 1000 + i % 37}, {i / 4})")
    connection.close()
    return url


def test_database_scan_and_query(spark, database):
    whole = sources.read_source(spark, database, table="orders")
    assert whole.count() == 200 and sources.query_rows(spark, database, "select * from orders where amount > 10") == 159
    for column, parts in (("ORDER_ID", 5), ("CUSTOMER_ID", 4)):
        split = sources.read_jdbc(spark, database, "orders", partition=(column, parts))
        assert split.rdd.getNumPartitions() == parts
        assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    sizes = sources.read_jdbc(spark, database, query="select order_id, amount from orders where order_id < 100", partition=("ORDER_ID", 4)).groupBy(F.spark_partition_id()).count()
    assert sorted(r["count"] for r in sizes.collect()) == [25, 25, 25, 25] or sizes.count() == 4
    assert sources.read_jdbc(spark, database, query="select * from orders where order_id < 0", partition=("ORDER_ID", 4)).count() == 0
    pushed = whole.where("AMOUNT > 40")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in pushed and "AMOUNT" in pushed.split("PushedFilters")[1]


def test_database_refuses_changes(spark, database):
    for statement in ("insert into orders values (999, null, 1)", "delete from orders", "select 1 from orders; drop table orders"):
        with pytest.raises(PermissionError):
            sources.read_jdbc(spark, database, query=statement)
        with pytest.raises(PermissionError):
            sources.query_rows(spark, database, statement)
    assert sources.read_jdbc(spark, database, "orders").count() == 200
    assert sources.check_read_only("select 'insert' as word -- drop\nfrom t") and sources.READ_ONLY["postgresql"].endswith("READ ONLY")


def test_database_listing_and_foreign_keys(spark, database):
    assert [r.table_name for r in sources.list_tables(spark, database).collect()] == ["CUSTOMERS", "ORDERS"]
    assert sources.foreign_keys(spark, database) == [("ORDERS", "CUSTOMER_ID", "CUSTOMERS", "ID")]
    tables = {t: sources.read_jdbc(spark, database, t) for _, t in sources.database_tables(spark, database)}
    declared = mart.discover_relations(tables, sources.foreign_keys(spark, database)).collect()
    assert [tuple(r)[:7] for r in declared] == [("ORDERS", "CUSTOMER_ID", "CUSTOMERS", "ID", "declared", 37, 0)]
    found = mart.discover_relations(tables).collect()
    assert [tuple(r)[:5] for r in found] == [("ORDERS", "CUSTOMER_ID", "CUSTOMERS", "ID", "name")]


# -- relations --------------------------------------------------------------------------


def test_relations_between_all_tables(spark):
    d = "/root/testdata/sf0.001"
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    found = mart.discover_relations({t: spark.read.parquet(f"{d}/{t}.parquet") for t in names}).collect()
    assert {tuple(r)[:4] for r in found} == {
        ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
    }


def test_relations_by_values_and_near_misses(spark):
    code = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    tables = {
        "devices": spark.createDataFrame([(code(i), i) for i in range(400)], "serial string, seq long"),
        "readings": spark.createDataFrame([(code(i % 390), i % 300) for i in range(4000)] + [(None, None)], "device string, small long"),  # the other name is no hint
        "strangers": spark.createDataFrame([(code(i % 430), i) for i in range(4000)], "device string, n long"),  # one value in eleven has no device
        "twice": spark.createDataFrame([(code(i % 200),) for i in range(400)], "serial string"),  # not unique
        "empty": spark.createDataFrame([], "serial string, id long"),
    }
    found = {tuple(r)[:5] for r in mart.discover_relations(tables).collect()}
    assert ("readings", "device", "devices", "serial", "values") in found and ("twice", "serial", "devices", "serial", "values") in found
    assert not any("small" in r or r[0] == "strangers" and r[2] == "devices" or r[2] in ("twice", "empty") for r in found)
    assert mart.discover_relation(tables["readings"].withColumnRenamed("device", "device_id"), tables["strangers"].withColumnRenamed("device", "device_id")) == ("device_id", "device_id")
    assert mart.discover_relation(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1,)], "order_id long"), "orders") == ("id", "order_id")
    assert mart.discover_relation(spark.createDataFrame([(1,)], "a long"), spark.createDataFrame([(1,)], "b long")) is None


def test_mart_view(spark):
    name = mart.mart_view(spark.range(3), "three")
    assert name == "mart_three" and spark.sql(f"select count(*) as n from {name}").first().n == 3
    spark.catalog.dropTempView(name)


# -- mutual information -----------------------------------------------------------------


def digamma(x):
    h = 1e-5 * x
    return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)


def plain_mi(x, y, k=3):
    """The estimate over whole-number places by looking at all pairs of a class."""
    x, y = np.asarray(x, np.int64), np.asarray(y)
    keep = np.isin(y, [c for c in np.unique(y) if (y == c).sum() > 1])
    x, y = x[keep], y[keep]
    total, everything = 0.0, np.sort(x)
    for c in np.unique(y):
        own = x[y == c]
        reach = min(k, len(own) - 1)
        d = np.sort(np.abs(own[:, None] - own[None]), axis=1)[:, reach]  # the first is the row itself
        half = np.maximum(d - 1, 0)
        m = np.searchsorted(everything, own + half, "right") - np.searchsorted(everything, own - half, "left")
        total += sum(digamma(reach) - digamma(len(own)) - digamma(v) for v in m)
    return max(digamma(len(x)) + total / len(x), 0)


def place(values, names, column):
    low, high = min(values), max(values)
    noise = [int(hashlib.md5(f"{n},{column}".encode()).hexdigest()[:8], 16) % (1 << 26) for n in names]
    return [(math.floor((v - low) / (high - low) * ((1 << 36) - 1)) << 26) + n for v, n in zip(values, noise, strict=True)]


def test_nearest_mutual_information_equals_plain_numpy(spark):
    rng = np.random.default_rng(9)
    n = 5000
    y = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]).tolist()
    near = {"a": 0.0, "b": 1.0, "c": 5.0}
    data = {"apart": [near[c] + float(e) for c, e in zip(y, rng.normal(0, 0.3, n), strict=True)], "none": rng.normal(size=n).tolist(), "steps": [float(near[c] > 0.5) + float(e) for c, e in zip(y, rng.integers(0, 4, n), strict=True)]}
    y[17] = "alone"
    rows = [(i, y[i], *(data[c][i] for c in data), 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y string, apart double, none double, steps double, flat double")
    told = {c: plain_mi(place(v, range(n), c), y) for c, v in data.items()}
    for parts, block in ((1, 100_000), (11, 60)):
        got = {r.column_name: r.mi for r in synth.mi_nearest(df.repartition(parts), [*data, "flat"], "y", ["id"], block=block).collect()}
        assert got == {**{c: pytest.approx(v, abs=2e-4) for c, v in told.items()}, "flat": 0.0}
    # Well apart classes give nearly the classes' own entropy, unrelated values nearly nothing.
    entropy = -sum(p * math.log(p) for p in (0.6, 0.3, 0.1))
    assert told["apart"] > 0.85 * entropy and told["none"] < 0.02


def test_nearest_mutual_information_of_odd_rows(spark):
    rows = [(1, "a", 1.0), (2, "a", 1.0), (3, "b", 2.0), (4, "b", None), (5, None, 3.0), (6, "b", float("nan")), (7, "b", 2.5), (7, "b", 2.5)]
    df = spark.createDataFrame(rows, "id long, y string, x double")
    assert synth.mi_nearest(df, ["x"], "y", ["id"]).first().mi > 0
    assert synth.mi_nearest(df.limit(0), ["x"], "y", ["id"]).collect()[0].mi == 0.0
