"""Feature marts: one-to-many joins that aggregate children before they meet the parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import numeric_columns


def discover_relation(parent: DataFrame, child: DataFrame, parent_name: str = "") -> tuple[str, str] | None:
    """(parent key, child key) by name: a shared ``*_id``/``*key`` column, else ``{parent}_id``."""
    shared = [c for c in parent.columns if c in child.columns and c.lower().endswith(("id", "key"))]
    if shared:
        return shared[0], shared[0]
    single = parent_name.rstrip("s")
    own = next((c for c in parent.columns if c.lower() in ("id", f"{single}_id")), None)
    other = next((c for c in child.columns if c.lower() == f"{single}_id"), None)
    if own and other:
        return own, other
    bare = lambda c: c.split("_", 1)[-1].lower()
    return next(((p, c) for p in parent.columns for c in child.columns if bare(p) == bare(c) and bare(p).endswith("key")), None)


def key_containment(parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Whether the parent's key is unique, and how many child rows have no parent."""
    unique = parent.agg(F.count("*").alias("parent_rows"), F.countDistinct(key).alias("parent_keys"))
    lost = child.select(F.col(child_key).alias("c")).join(parent.select(F.col(key).alias("k")).distinct(), F.col("c") == F.col("k"), "left_anti").agg(F.count("*").alias("orphan_rows"))
    return unique.join(lost, how="cross").withColumn("is_relation", (F.col("parent_rows") == F.col("parent_keys")) & (F.col("orphan_rows") == 0))


#: Values that a column's theta sketch keeps, as a power of two: a containment is off by a hundredth or two.
SKETCH_BITS = 12


def column_sketches(name: str, df: DataFrame) -> DataFrame:
    """(table, column, bare, kind, n_rows, n_valid, n_distinct, low, high, sketch): a row for each whole-number and text column, from one pass over the table.

    ``bare`` is the column's name without a prefix that all columns of the table share.
    The sketch keeps the smallest hashes of the distinct values, so sketches of two
    columns tell how many values they have in common.
    """
    kinds = {f.name: "number" if isinstance(f.dataType, T.IntegralType) else "text" for f in df.schema if isinstance(f.dataType, T.IntegralType | T.StringType)}
    head = {c.split("_", 1)[0] for c in df.columns}
    prefix = f"{head.pop()}_" if len(head) == 1 and all("_" in c for c in df.columns) else ""
    aggs = []
    for c, kind in kinds.items():
        v = F.col(f"`{c}`").cast("long" if kind == "number" else "string")
        ends = [f(v).cast("double") if kind == "number" else F.lit(None).cast("double") for f in (F.min, F.max)]
        aggs.append(F.struct(F.lit(c).alias("column"), F.lit(c.removeprefix(prefix).lower()).alias("bare"), F.lit(kind).alias("kind"), F.count("*").alias("n_rows"), F.count(v).alias("n_valid"), ends[0].alias("low"), ends[1].alias("high"), F.theta_sketch_agg(v, SKETCH_BITS).alias("sketch")))
    if not aggs:
        return df.sparkSession.createDataFrame([], "table string, column string, bare string, kind string, n_rows long, n_valid long, low double, high double, sketch binary, n_distinct long")
    one = df.agg(F.array(*aggs).alias("columns")).select(F.lit(name).alias("table"), F.explode("columns").alias("x")).select("table", "x.*")
    return one.withColumn("n_distinct", F.theta_sketch_estimate("sketch"))


def relation_candidates(sketches: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs of columns, of different tables and the same kind, that may be child and parent key by their sketches.

    The parent's values are nearly all distinct and hold nearly all of the child's.
    Whole numbers in one dense range are contained in each other by chance, so they also
    need a name in common: equal bare names that end like a key, or the parent's name
    with ``_id``.  (Pairs of sketches: a row for each column of every table.)
    """
    side = lambda s: sketches.select(*[F.col(c).alias(f"{s}_{c}") for c in sketches.columns])
    p, c = F.col("parent_n_distinct"), F.col("child_n_distinct")
    pairs = side("child").join(side("parent"), (F.col("child_kind") == F.col("parent_kind")) & (F.col("child_table") != F.col("parent_table")) & (p >= 0.9 * F.col("parent_n_rows")) & (F.col("child_n_valid") > 0) & (c <= 1.1 * p))
    shared = F.theta_sketch_estimate(F.theta_intersection("child_sketch", "parent_sketch"))
    pairs = pairs.withColumn("containment", F.least(shared / F.greatest(c, F.lit(1)), F.lit(1.0))).where(F.col("containment") >= least)
    single = F.regexp_replace(F.lower("parent_table"), "s$", "")
    key_like = F.col("child_bare").rlike("(id|key|code|no)$")
    of_parent = F.col("parent_bare").isin("id", "key") & F.regexp_extract("child_bare", "^(.+?)_?(id|key)$", 1).eqNullSafe(single)
    named = ((F.col("child_bare") == F.col("parent_bare")) & key_like) | of_parent
    sparse = (F.col("child_kind") == "text") | (F.col("child_high") - F.col("child_low") > 64 * c)
    return pairs.where(named | (sparse & (c >= 20))).select("child_table", "child_column", "parent_table", "parent_column", named.alias("by_name"), F.round("containment", 2).alias("estimate"))


def discover_relations(tables: dict[str, DataFrame], foreign_keys: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, source, child_keys, orphan_keys, parent_rows): relations between tables.

    Declared foreign keys (child table, child column, parent table, parent column)
    come first.  The others are found on the data: one pass over each table makes a
    sketch of every column, all pairs of sketches are compared, and only pairs that
    survive are checked exactly: unique parent keys that hold every child value.
    """
    spark = next(iter(tables.values())).sparkSession
    sketches = None
    for name, df in tables.items():
        one = column_sketches(name, df)
        sketches = one if sketches is None else sketches.unionByName(one)
    told = {tuple(k) for k in foreign_keys}
    wanted = [(*k, "declared") for k in sorted(told)] + [(*tuple(r)[:4], "name" if r.by_name else "values") for r in relation_candidates(sketches).collect() if tuple(r)[:4] not in told]  # a row for each pair of columns at most
    out = spark.createDataFrame([], "child_table string, child_column string, parent_table string, parent_column string, source string, child_keys long, orphan_keys long, parent_rows long")
    for child, column, parent, key, source in sorted(wanted):
        keys = tables[parent].groupBy(F.col(f"`{key}`").alias("k")).agg(F.count("*").alias("n"))
        ours = tables[child].where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("c")).distinct()
        met = ours.join(keys, F.col("c") == F.col("k"), "left").agg(F.count("*").alias("child_keys"), F.count_if(F.col("n").isNull()).alias("orphan_keys"))
        unique = keys.agg(F.sum("n").alias("parent_rows"), F.count("k").alias("parent_keys"))
        checked = met.join(unique, how="cross").where(F.lit(source == "declared") | (F.col("orphan_keys") == 0) & (F.col("parent_rows") == F.col("parent_keys")))
        names = [F.lit(v).alias(n) for v, n in zip((child, column, parent, key, source), out.columns, strict=False)]
        out = out.unionByName(checked.select(*names, "child_keys", "orphan_keys", "parent_rows"))
    return out


def child_agg(child: DataFrame, key: str, prefix: str, numeric: list[str] | None = None, categorical: list[str] | None = None) -> DataFrame:
    numeric = [c for c in numeric_columns(child) if c != key] if numeric is None else numeric
    categorical = [c for c, k in child.dtypes if k == "string" and c != key] if categorical is None else categorical
    aggs = [F.count("*").alias(f"{prefix}_count")]
    for c in numeric:
        aggs += [F.sum(c).alias(f"{prefix}_{c}_sum"), F.avg(c).alias(f"{prefix}_{c}_mean"), F.max(c).alias(f"{prefix}_{c}_max")]
    aggs += [F.countDistinct(c).alias(f"{prefix}_{c}_nunique") for c in categorical]
    return child.groupBy(F.col(key).alias("__key")).agg(*aggs)


def feature_mart(parent: DataFrame, key: str, children: list[tuple[DataFrame, str, str, list[str], list[str]]]) -> DataFrame:
    """``parent`` with the aggregates of every child (frame, key, prefix, numeric, categorical), 0 where it has none.

    Children are aggregated first, so no join fans out.
    """
    out = parent
    for child, child_key, prefix, numeric, categorical in children:
        made = child_agg(child, child_key, prefix, numeric, categorical)
        new = [c for c in made.columns if c != "__key"]
        out = out.join(made, F.col(key) == F.col("__key"), "left").drop("__key").fillna(0, new)
    return out


def mart_view(mart: DataFrame, name: str) -> str:
    mart.createOrReplaceTempView(f"mart_{name}")
    return f"mart_{name}"
