"""What the training-data operators share: shared-folder tables, Arrow text
blocks, vectorised word hashing and connected components.

Text is handled in *blocks*: the UTF-8 bytes of consecutive whole documents in
one numpy array.  A block holds about ``BLOCK_BYTES`` bytes (or one longer
document), so a task's memory does not depend on how many documents it reads.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18
M64 = (1 << 64) - 1
GAMMA = 0x9E3779B97F4A7C15
#: ASCII lower-casing as a byte table.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- tables in the folder that the whole cluster shares ---------------------------------


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset and all runs on one machine."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if not re.match(r"local(\[|$)", master := spark.sparkContext.master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _OWN_DIR[0]


#: Lets Spark delete an execution's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Executions in this block leave no shuffle files behind: what they made is written by then."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scratch:
    """Intermediate tables of one operator, written to the shared folder and read back.

    Writing cuts the lineage, so that an executor lost later costs only the
    step it was working on; ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread a table."""
        path = self.paths[name] = f"{self.base}/{name}"
        with shuffles_deleted(self.spark):
            df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever the case of its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, i = f"__{stem}", 0
        while name in taken:
            name, i = f"__{stem}_{i}", i + 1
        taken.add(name)
        out.append(name)
    return out


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` that results of these names don't replace; Spark compares names without case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def kind_of(df: DataFrame, name: str) -> str:
    """The type of a key column, as ``arrow_schema`` names it."""
    return {"bigint": "long"}.get(kind := df.schema[name].dataType.simpleString(), kind)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Texts are long: batches of Spark's usual 10,000 rows would fill a Python worker's memory.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


# -- code on the executors --------------------------------------------------------------


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that tasks
    can import it wherever they run."""
    for name, value in ARROW_LIMITS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    sc = spark.sparkContext
    if getattr(sc, "_basalt_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(target := Path(tempfile.mkdtemp(prefix="basalt-")) / "basalt_package.zip", "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._basalt_shipped = True


def trimmed(run: Callable) -> Callable:
    """``run``, after which the worker's free memory goes back to the system.

    Python workers stay for the next task; what numpy and Arrow have freed would
    otherwise stay with them, also while they are idle beside other workers.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(trimmed(run), schema)


# -- text blocks ------------------------------------------------------------------------


class Block:
    """Bytes of whole documents; ``offs[i]:offs[i+1]`` is document ``i`` of ``rows``."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first, self.n = data, offs, first, len(offs) - 1

    @property
    def rows(self) -> range:
        return range(self.first, self.first + self.n)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of an Arrow string column, in row order; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
        end = min(end, n)
        yield Block(data[offs[start] : offs[end]], offs[start : end + 1] - offs[start], start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers (the finaliser of the splitmix generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Keeps the first n bytes of a little-endian 64-bit integer.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer spans are hashed one by one.
LONG_SPAN = 256


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: its eight-byte pieces go through a mixing function one after another."""
    size = ends - starts
    h = mix64(size.astype(np.uint64) * np.uint64(GAMMA))
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    short = size <= LONG_SPAN
    live = None if short.all() else np.flatnonzero(short)
    at, left = (starts, size) if live is None else (starts[live], size[live])
    while len(at):
        piece = mix64((h if live is None else h[live]) * np.uint64(GAMMA) + (eight[at] & _FIRST[np.minimum(left, 8)]))
        if live is None:
            h = piece
        else:
            h[live] = piece
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(~short):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def set_digests(members: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each set (runs of distinct hashes): two sums over its members, mixed apart, and its size."""
    size = np.diff(bounds).astype(np.uint64)
    return tuple(mix64(run_sums(mix64(members ^ np.uint64(salt)), bounds) + size * np.uint64(GAMMA)) for salt in (0xA5A3564D1F2C8B77, 0x3C79AC492BA7B653))


def run_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run, modulo 2^64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return data + (data - np.uint8(65) < 26) * np.uint8(32)


def words(block: Block, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words ``[^\\x20\\x09-\\x0D]+`` of a block."""
    data = block.data if data is None else data
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = (data == 32) | (data - np.uint8(9) < 5)
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = block.offs[(block.offs > 0) & (block.offs < len(data))]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.repeat(np.arange(block.n), np.diff(np.searchsorted(starts, block.offs)))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of one document; of the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, width if n < k else k, np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(GAMMA) + hashes[i : n - width + 1 + i])
    return out


def by_doc(docs: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each document's run in an array sorted by document number."""
    return np.searchsorted(docs, np.arange(n + 1))


def map_blocks(df: DataFrame, text: str, make: Callable[[], Callable[[Block, pa.Table], list]], schema: str) -> DataFrame:
    """``mapInArrow`` block by block.  ``make()`` runs once in a task and returns
    the function that turns a block and its rows into output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, target = None, None
        for batch in batches:
            work = work or make()
            rows = pa.table(batch)
            for block in blocks(rows.column(text)):
                out = work(block, rows.slice(block.first, block.n))
                target = target or arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array | pa.ChunkedArray) else whole(c).cast(t) for c, t in zip(out, target.types, strict=True)], schema=target)

    return map_arrow(df, run, schema)


def whole(c: pa.Array | pa.ChunkedArray) -> pa.Array:
    if not isinstance(c, pa.ChunkedArray):
        return c
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow types of a flat ``name type, ...`` schema with optional ``array<type>`` columns."""
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(pa.field(name, pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]))
    return pa.schema(fields)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


# -- filters of a fixed size ------------------------------------------------------------

FILTER_BITS = 24


def _slots(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit for each value of a column of longs, by the low bits of a hash: of a fixed size, with false hits but no misses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy())
            word, where = np.unique(slot >> 5, return_inverse=True)
            bits = np.zeros(len(word), np.int64)
            np.bitwise_or.at(bits, where, np.int64(1) << (slot & 31))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], names=["word", "bits"])

    with shuffles_deleted(keys.sparkSession):
        got = map_arrow(keys, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = _slots(keys)
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


# -- ranks ------------------------------------------------------------------------------


def ranked(df: DataFrame, scratch: Scratch, order: list, name: str) -> DataFrame:
    """``df`` with ``rank`` from 0 on in the given order, which must tell all rows apart.

    A range sort: rows are numbered inside their partition, and only the partitions'
    sizes come to the driver.  The sorted table stays in ``scratch`` as ``name``.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = scratch.save(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), name)
    part = F.shiftright("rank", 33)
    sizes = sorted(map(tuple, held.groupBy(part.alias("part")).agg(F.count("*")).collect()))
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(c for _, c in sizes)]).tolist(), strict=False))
    if not before:
        return held
    base = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)) if len(before) <= 1000 else None
    if base is not None:
        return held.withColumn("rank", F.element_at(base, part) + F.col("rank").bitwiseAND(F.lit((1 << 33) - 1)))
    starts = df.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")
    return held.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("rank", F.col("__before") + F.col("rank").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, "rank")


# -- connected components ---------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (columns a, b); component = smallest id.

    Alternates large-star and small-star steps (Kiveris et al., "Connected
    components in MapReduce and beyond") until the edge set stays the same.
    Every step is a partial aggregation and an equi-join, and every round is
    written to the shared folder, so lineage stays short and no vertex list
    comes to the driver.
    """
    run = uuid.uuid4().hex[:8]
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"edges0-{run}")
    seen = None
    for i in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        done = scratch.save(small, f"edges{i}-{run}")
        state = tuple(done.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        scratch.drop(f"edges{i - 1}-{run}")
        now = done
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def text_udf(make: Callable[..., Callable[..., list]], ddl: str):
    """An Arrow UDF from a text column, and others, to a struct with the fields of ``ddl``.

    ``make()`` runs once in a task and returns the function from a block (and
    the Arrow slices of its rows, the texts first) to the fields' columns.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work, target = make(), arrow_schema(ddl)
        for columns in batches:
            column, *more = map(whole, columns if isinstance(columns, tuple) else (columns,))
            out = [pa.array([], pa.struct(target))]
            for block in blocks(column):
                made = work(block, *(c.slice(block.first, block.n) for c in (column, *more)))
                out.append(pa.StructArray.from_arrays([whole(c).cast(t) if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, t) for c, t in zip(made, target.types, strict=True)], fields=list(target)))
            yield pa.concat_arrays(out)

    ship(SparkSession.active())
    return F.arrow_udf(trimmed(run), ddl, F.ArrowUDFType.SCALAR_ITER)


def with_fields(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """``df`` with the struct's fields as columns; columns of these names, in whatever case, are replaced."""
    kept, (made,) = others(df, *names), fresh(df, "made")
    out = df.select(*map(quoted, kept), struct.alias(made))
    return out.select(*map(quoted, kept), *[F.col(made)[n].alias(n) for n in names])
