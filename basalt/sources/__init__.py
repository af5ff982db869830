"""Readers, samplers, digests and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import bucket

#: Spark formats by file ending; JDBC kinds by url scheme.
FORMATS = {"parquet": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "orc": "orc"}
MUTATIONS = "insert update delete drop alter create truncate replace merge grant revoke".split()


def detect_kind(url: str) -> str:
    """The source kind of a path or url: a Spark format, ``jdbc``, or ``table``."""
    if url.startswith("jdbc:"):
        return "jdbc"
    ending = url.rstrip("/").rsplit(".", 1)[-1].lower()
    return FORMATS.get(ending, "table")


def check_read_only(sql: str) -> str:
    """The statement itself, or PermissionError if it would change data.

    Comments and string literals are removed before the words are looked at.
    """
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if found := [w for w in re.findall(r"[a-z_]+", bare.lower()) if w in MUTATIONS]:
        raise PermissionError(f"not a read-only statement: {found[0]}")
    return sql


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "x-windows-949", "EUC-KR", "ISO-8859-1"), **options) -> DataFrame:
    """A CSV file in the first encoding that leaves no replacement character."""
    if spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for encoding in encodings:
        df = spark.read.options(header=True, inferSchema=True, encoding=encoding, **options).csv(path)
        if not df.where(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns]).contains("�")).head(1) and not any("�" in c for c in df.columns):
            return df
    return df


def read_source(spark: SparkSession, url: str, **options) -> DataFrame:
    """Any supported source as a DataFrame; a table name is read from the catalog."""
    kind = detect_kind(url)
    if kind == "csv":
        return read_csv(spark, url, **({"sep": "\t"} if url.endswith(".tsv") else {}), **options)
    if kind == "json":
        return spark.read.options(multiLine=not url.endswith(".jsonl"), **options).json(url)
    if kind == "jdbc":
        return read_jdbc(spark, url, **options)
    return spark.table(url) if kind == "table" else spark.read.format(kind).options(**options).load(url)


#: What makes a database session read-only, by the scheme of its url.
READ_ONLY = {"postgresql": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY", "mysql": "SET SESSION TRANSACTION READ ONLY", "mariadb": "SET SESSION TRANSACTION READ ONLY", "sqlite": "PRAGMA query_only = ON"}


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition: tuple[str, int] | None = None, **options) -> DataFrame:
    """A database table or read-only query, over a read-only session where the database has one.

    ``partition`` (column, parts) reads in parallel: the column's ends are asked from
    the database, and rows without a value go with the first part.
    """
    source = f"({check_read_only(query)}) t" if query else table
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if statement := READ_ONLY.get(url.split(":")[1] if url.count(":") > 1 else ""):
        reader = reader.option("sessionInitStatement", statement)
    if partition:
        column, parts = partition
        low, high = reader.option("dbtable", f"(select min({column}) as low_end, max({column}) as high_end from {source}) e").load().first()
        if low is not None and low < high:
            # The upper bound itself would be a part of its own.
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.option("dbtable", source).load()


def query_rows(spark: SparkSession, url: str, query: str, **options) -> int:
    """Rows of a read-only database query, counted by the database."""
    return read_jdbc(spark, url, query=f"select count(*) as n from ({check_read_only(query)}) q", **options).first()[0]


@contextmanager
def _metadata(spark: SparkSession, url: str, options: dict):
    """The driver's own description of a database, over a connection that is read-only."""
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, str(value))
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setReadOnly(True)
        yield connection.getMetaData()
    finally:
        connection.close()


def _rows(found, names: tuple[str, ...]) -> list[tuple]:
    out = []
    while found.next():
        out.append(tuple(found.getString(n) for n in names))
    return out


def database_tables(spark: SparkSession, url: str, **options) -> list[tuple[str, str]]:
    """(schema, table) of every user table of a database."""
    with _metadata(spark, url, options) as told:
        return sorted((s or "", t) for s, t, kind in _rows(told.getTables(None, None, "%", None), ("TABLE_SCHEM", "TABLE_NAME", "TABLE_TYPE")) if kind in ("TABLE", "BASE TABLE"))


def foreign_keys(spark: SparkSession, url: str, **options) -> list[tuple[str, str, str, str]]:
    """(child table, child column, parent table, parent column) of every declared foreign key."""
    with _metadata(spark, url, options) as told:
        tables = [t for _, t, kind in _rows(told.getTables(None, None, "%", None), ("TABLE_SCHEM", "TABLE_NAME", "TABLE_TYPE")) if kind in ("TABLE", "BASE TABLE")]
        return [k for t in tables for k in _rows(told.getImportedKeys(None, None, t), ("FKTABLE_NAME", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME"))]


def sampling_query(kind: str, table: str, total: int, n: int = 50_000) -> str:
    """A query for about ``n`` of ``total`` rows of a database table, in the database's own words."""
    if total <= n:
        return f"select * from {table}"
    percent = min(max(100 * n / total, 0.1), 100)
    forms = {"postgresql": f"select * from {table} tablesample bernoulli ({percent:.4f})", "oracle": f"select * from {table} sample ({percent:.4f})", "sqlserver": f"select * from {table} tablesample ({percent:.4f} percent)", "sqlite": f"select * from {table} order by random() limit {n}"}
    return forms.get(kind, f"select * from {table} fetch first {n} rows only" if kind in ("derby", "db2") else f"select * from {table} limit {n}")


def query_over_files(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A read-only query over named DataFrames."""
    check_read_only(sql)
    before = {name: spark.table(name) for name in tables if any(t.isTemporary for t in spark.catalog.listTables() if t.name == name.lower())}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql)  # resolved by now, so the views can go again
    for name in tables:
        spark.catalog.dropTempView(name)
        if name in before:
            before[name].createOrReplaceTempView(name)
    return out


def list_tables(spark: SparkSession, source: str | None = None, **options) -> DataFrame:
    """(table_name) of a database, of a folder of files (their base names), or of the session's catalog."""
    if source is None:
        return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "table_name string")
    if detect_kind(source) == "jdbc":
        return spark.createDataFrame([(t,) for _, t in database_tables(spark, source, **options)], "table_name string")
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.createDataFrame([(n.rsplit(".", 1)[0],) for n in names if n.rsplit(".", 1)[-1].lower() in FORMATS], "table_name string")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def hash_sample(df: DataFrame, key: str, per_mille: int, seed: str = "42") -> DataFrame:
    """The rows whose key falls into the first ``per_mille`` of 1000 buckets."""
    return df.where(bucket(key, 1000, seed) < per_mille)


#: Rows in the last bin of an exact sample that are few enough to be sorted.
FEW = 100_000


def exact_sample(df: DataFrame, key: str | list[str], n: int, few: int = FEW) -> DataFrame:
    """Exactly n rows (or all), those with the smallest hash of their key; equal keys by a hash of the row.

    Rows are counted by the first digits of their hash.  Bins below the cut are taken
    whole; the bin in which it falls is counted by further digits until few rows are
    left, and only these are sorted.  The result is the same for any partitioning.
    """
    keys = [key] if isinstance(key, str) else list(key)
    row = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in df.columns])
    marked = df.withColumn("__hash", F.concat(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), F.md5(row)))
    inside, left, taken = "", n, F.lit(False)
    rest = marked
    for digits in range(4, 65, 4):
        bins = sorted(map(tuple, rest.groupBy(F.substring("__hash", 1, digits).alias("bin")).agg(F.count("*")).collect()))  # 65,536 at most
        size = 0
        for prefix, size in bins:
            if size > left:
                inside = prefix
                break
            left -= size
        else:
            return df  # all rows
        taken = F.substring("__hash", 1, digits) < inside
        rest = marked.where(F.substring("__hash", 1, digits) == inside)
        if size <= few or not left:
            break
    below = marked.where(taken)
    if left:
        below = below.unionByName(rest.orderBy("__hash").limit(left) if size <= few else rest.limit(left))  # beyond all digits rows are equal
    return below.drop("__hash")


def adaptive_sample(df: DataFrame, key: str | list[str], threshold: int = 50_000) -> DataFrame:
    """A uniform sample of exactly ``threshold`` rows if there are more (0: never)."""
    return exact_sample(df, key, threshold) if threshold and df.count() > threshold else df


def truncate_text(df: DataFrame, size: int = 200) -> DataFrame:
    return df.select(*[F.substring(c, 1, size).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes])


def row_digest(df: DataFrame):
    """A 60-bit integer for each row, from the md5 of its columns as text, each after its length (null: no length)."""
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (F.col(f"`{c}`").cast("string") for c in df.columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def content_digest(df: DataFrame) -> DataFrame:
    """Row count and order-insensitive digest (xor and sum of row digests)."""
    return df.select(row_digest(df).alias("d")).agg(F.count("*").alias("n_rows"), F.bit_xor("d").alias("xor_digest"), F.sum(F.pmod("d", F.lit(1_000_000_007))).alias("sum_digest"))


def fingerprint(df: DataFrame) -> DataFrame:
    """A 16-digit fingerprint of schema and content."""
    schema = ",".join(f"{c}:{k}" for c, k in df.dtypes)
    return content_digest(df).select(F.substring(F.md5(F.concat_ws("|", F.lit(schema), "n_rows", "xor_digest", "sum_digest")), 1, 16).alias("fingerprint"), "n_rows")


def freeze(splits: dict[str, DataFrame], folder: str, fmt: str = "parquet", seed: int | None = None, features: list[str] | None = None) -> DataFrame:
    """Write each split and return the manifest: rows, share of all rows, a SHA-256 over the files' digests, seed and features."""
    spark = next(iter(splits.values())).sparkSession
    rows = []
    for name, df in splits.items():
        path = f"{folder}/{name}"
        df.write.mode("errorifexists").option("header", True).format(fmt).save(path)
        back = spark.read.option("header", True).format(fmt).load(path)
        rows.append((name, path, back.count(), file_digest(spark, path)))
    total = sum(r[2] for r in rows) or 1
    rows = [(*r, round(r[2] / total, 4), seed, features or sorted(set().union(*(df.columns for df in splits.values())))) for r in rows]
    manifest = spark.createDataFrame(rows, "split string, path string, n_rows long, sha256 string, ratio double, seed long, features array<string>")
    manifest.write.json(f"{folder}/manifest")
    return manifest


def file_digest(spark: SparkSession, path: str) -> str:
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"))
    return files.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256)).first()[0]


def verify_frozen(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with a flag for each split whose files are as they were written."""
    rows = [(r.split, r.sha256 == file_digest(spark, r.path)) for r in spark.read.json(f"{folder}/manifest").collect()]
    return spark.createDataFrame(rows, "split string, intact boolean")


def read_stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    if own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own).isDirectory():
        return spark.readStream.schema(schema).options(**options).parquet(path)
    return spark.readStream.schema(schema).options(pathGlobFilter=own.getName(), **options).parquet(str(own.getParent().toString()))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the whole cluster shares: in ``spark.checkpoint.dir``, or of this machine where that is unset and all runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", master := spark.sparkContext.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-work-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


class FeatureStore:
    """Feature tables kept as Parquet under the fingerprint of their input."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def get(self, task: str, df: DataFrame, make) -> tuple[DataFrame, bool]:
        """The features of ``df`` for a task and whether they were there already."""
        path = f"{self.folder}/{task}_{fingerprint(df).first()[0]}"
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        hit = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath)
        if not hit:
            make(df).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), hit

    def clear(self, older_than: float = 0.0) -> list[str]:
        """Delete the tables that were written more than so many seconds ago; returns their names."""
        import time

        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s for s in (fs.listStatus(top) if fs.exists(top) else []) if time.time() - s.getModificationTime() / 1000 >= older_than]
        for s in old:
            fs.delete(s.getPath(), True)
        return [s.getPath().getName() for s in old]

    def warm(self, df: DataFrame, tasks: dict) -> DataFrame:
        return self.spark.createDataFrame([(t, self.get(t, df, make)[1]) for t, make in tasks.items()], "task string, hit boolean")

    def stats(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.folder)
        return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_run(results: dict[str, DataFrame], folder: str, run_id: str | None = None) -> str:
    """Every result table of a run as JSON under one run id."""
    run_id = run_id or uuid.uuid4().hex
    for name, df in results.items():
        df.write.mode("overwrite").json(f"{folder}/{run_id}/{name}")
    return run_id


def append_run(runs: DataFrame, folder: str) -> None:
    """Add rows to the table of run histories."""
    runs.write.mode("append").parquet(folder)


def score_csv(spark: SparkSession, source: str, target: str, transform) -> None:
    """Score a CSV source into a CSV sink, partition by partition."""
    transform(read_csv(spark, source)).write.mode("errorifexists").option("header", True).csv(target)
