"""Vector code compression: exact k-means over parts on anchors-hierarchy metric trees.

Vectors become integers ``floor(scale * x)`` and are cut into equal parts, each
of which gets a codebook of its own by a fixed number of Lloyd rounds.  The
result is that of plain Lloyd rounds to the last digit; the trees only save
distances:

* Each block of vectors has one metric tree for each part, built middle-out
  (Moore, "The anchors hierarchy"): about sqrt(n) anchors, each the point
  farthest from its owner, take over points that the triangle inequality does
  not rule out; anchors are merged upwards by the smallest enclosing ball and
  split downwards in the same way.  A ball caches its points' sum and count.
* A round walks each tree from its root with a list of candidate entries.  A ball
  inherits its parent's list and strikes out the entries that are farther than
  the best one from every place of the ball.  When one entry is left, the ball is
  wholly owned and its cached sum and count are added; in a leaf the points meet
  the entries that are left.

The blocks with their trees are written once; a round broadcasts the codebooks,
whose size is fixed, and brings back one sum for each entry.

Defined results: a vector that is null or has null or non-finite components is
dropped.  Codebooks start from the smallest keys in ascending order (equal keys
by their components); rows with a null key are coded but start no entry.  Repeated
rows count as often as they come.  Entries that no part is nearest to stay as they
are; of equally near entries the first wins.  Vectors of different lengths, of a
length that the parts don't divide, or with components too large for exact 64-bit
distances stop the job with a message.  An empty table gives no rows and empty
codebooks.  Only the key, the vector and the columns of ``keep`` are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_arrow, quoted, whole

#: Components in a block of vectors, and points under which a ball is not split.
BLOCK_VALUES, LEAF = 1 << 19, 128


# -- trees ------------------------------------------------------------------------------


class Tree(NamedTuple):
    """Balls in depth-first order; ball ``i`` holds the points ``order[first[i]:last[i]]``."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray  # -1 in a leaf
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    def pack(self) -> bytes:
        arrays = [self.order, self.first, self.last, self.left, self.right, self.radius, self.centre, self.total]
        kinds = ["<i4"] * 5 + ["<f8", "<i8", "<i8"]
        return struct.pack("<3q", len(self.order), len(self.first), self.centre.shape[1]) + b"".join(a.astype(k).tobytes() for a, k in zip(arrays, kinds, strict=True))

    @staticmethod
    def unpack(data: bytes) -> Tree:
        n, balls, width = struct.unpack_from("<3q", data)
        at, out = 24, []
        for kind, size in [("<i4", n)] + [("<i4", balls)] * 4 + [("<f8", balls)] + [("<i8", balls * width)] * 2:
            out.append(np.frombuffer(data, kind, size, at))
            at += out[-1].nbytes
        *plain, radius, centre, total = out
        return Tree(*plain, centre.reshape(balls, width), radius, total.reshape(balls, width))


def anchors(points: np.ndarray, k: int) -> np.ndarray:
    """The owner of each point among at most ``k`` anchors; each new anchor is the point farthest from its owner."""
    places, owner = [0], np.zeros(len(points), np.int64)
    far = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(places) < k:
        new = int(far.argmax())
        if far[new] == 0:
            break
        apart = np.sqrt(((points[places] - points[new]) ** 2).sum(1))
        # A point nearer to its anchor than half the way between the anchors can't be nearer to the new one.
        maybe = np.flatnonzero(far > apart[owner] / 2)
        d = np.sqrt(((points[maybe] - points[new]) ** 2).sum(1))
        taken = d < far[maybe]
        owner[maybe[taken]], far[maybe[taken]] = len(places), d[taken]
        places.append(new)
    return owner


def merged(centres: np.ndarray, radii: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to merge, smallest enclosing ball first; merge ``i`` makes ball ``len(radii) + i``."""
    n = len(radii)
    centre, radius, weight = np.zeros((2 * n - 1, centres.shape[1])), np.zeros(2 * n - 1), np.zeros(2 * n - 1)
    centre[:n], radius[:n], weight[:n] = centres, radii, counts
    cost = np.full((2 * n - 1, 2 * n - 1), np.inf)
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 0))
    cost[:n, :n] = np.maximum(np.maximum(radii[:, None], radii), (apart + radii[:, None] + radii) / 2)
    cost[np.arange(n), np.arange(n)] = np.inf
    out, live = [], np.zeros(2 * n - 1, bool)
    live[:n] = True
    for new in range(n, 2 * n - 1):
        a, b = divmod(int(cost[:new, :new].argmin()), new)
        out.append((a, b))
        weight[new] = weight[a] + weight[b]
        centre[new] = (weight[a] * centre[a] + weight[b] * centre[b]) / weight[new]
        radius[new] = cost[a, b]
        live[[a, b]], live[new] = False, True
        cost[[a, b]] = np.inf
        cost[:, [a, b]] = np.inf
        rest = np.flatnonzero(live[:new])
        d = np.sqrt(((centre[rest] - centre[new]) ** 2).sum(1))
        cost[new, rest] = cost[rest, new] = np.maximum(np.maximum(radius[rest], radius[new]), (d + radius[rest] + radius[new]) / 2)
    return out


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The metric tree of some integer points (one row each), middle-out."""
    order: list[np.ndarray] = []
    rows: list[list] = []  # first, last, left, right, centre, radius, total
    real, size = points.astype(np.float64), 0

    def lay(own: np.ndarray, shape) -> int:
        """Write down a ball and those below it; ``shape`` is None or the two halves, each with its points."""
        nonlocal size
        mine, at, total = points[own], len(rows), points[own].sum(0)
        centre = total // len(own)
        # Ever so little more than the exact radius, so that rounding never makes it too small.
        row = [size, 0, -1, -1, centre, np.sqrt(float(((mine - centre) ** 2).sum(1).max())) * (1 + 1e-12), total]
        rows.append(row)
        if shape is None and len(own) > leaf and row[5] > 0:
            shape = halves(own)
        if shape is None:
            order.append(own)
            size += len(own)
        else:
            row[2], row[3] = (lay(*half) for half in shape)
        row[1] = size
        return at

    def halves(own: np.ndarray):
        owner = anchors(real[own], isqrt(len(own)) + 1)
        by = np.argsort(owner, kind="stable")
        groups = np.split(own[by], np.flatnonzero(np.diff(owner[by])) + 1)
        if len(groups) < 2:
            return None
        centres = np.array([real[g].mean(0) for g in groups])
        radii = np.array([np.sqrt(((real[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centres, strict=True)])
        balls = [(g, None) for g in groups]
        for a, b in merged(centres, radii, np.array([len(g) for g in groups])):
            balls.append((np.concatenate([balls[a][0], balls[b][0]]), (balls[a], balls[b])))
        return balls[-1][1]

    lay(np.arange(len(points)), None)
    first, last, left, right, centre, radius, total = zip(*rows, strict=True)
    return Tree(np.concatenate(order), *(np.array(x) for x in (first, last, left, right, centre, radius, total)))


def walk(tree: Tree, points: np.ndarray, entries: np.ndarray, cached: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each point (-1 in a ball that an entry wholly owns, if ``cached``), and the owned balls' counts and sums by entry."""
    code = np.full(len(points), -1, np.int64)
    n, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    real, norm = entries.astype(np.float64), (entries**2).sum(1)
    # Products of doubles are exact up to 2^53.
    small = 4 * max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0))) ** 2 * entries.shape[1] < 1 << 53
    # Of equal entries only the first can win.
    todo = [(0, np.sort(np.unique(entries, axis=0, return_index=True)[1]))]
    while todo:
        ball, left = todo.pop()
        if len(left) > 1:
            d = ((entries[left] - tree.centre[ball]) ** 2).sum(1)
            best = int(d.argmin())
            apart = np.sqrt(((real[left] - real[left[best]]) ** 2).sum(1))
            # |x-c|^2 - |x-best|^2 is linear in x and at least d - d[best] - 2 * radius * apart in the ball.
            left = left[d - d[best] <= 2 * tree.radius[ball] * apart * (1 + 1e-9)]
        if len(left) == 1:
            if cached:
                n[left[0]] += tree.last[ball] - tree.first[ball]
                sums[left[0]] += tree.total[ball]
            else:
                code[tree.order[tree.first[ball] : tree.last[ball]]] = left[0]
        elif tree.left[ball] >= 0:
            todo += [(tree.left[ball], left), (tree.right[ball], left)]
        else:
            own = tree.order[tree.first[ball] : tree.last[ball]]
            if small:
                d = norm[left] - 2 * (points[own].astype(np.float64) @ real[left].T)
            else:
                d = ((points[own][:, None] - entries[left][None]) ** 2).sum(2)
            code[own] = left[d.argmin(1)]
    return code, n, sums


# -- Spark ------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has only finite components."""
    # In a shell of coalesce, so that null vectors and components count as not usable.
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))), F.lit(False))


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    if (column.value_lengths().to_numpy() != width).any():
        raise ValueError(f"vectors have different lengths, {width} among them")
    with np.errstate(over="ignore"):
        out = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(out) and not np.abs(out).max() <= 1 << 40:
        raise ValueError("components are too large for exact 64-bit distances")
    return out.astype(np.int64).reshape(len(column), width)


class Codebooks(NamedTuple):
    """``entries[p]`` are the integer entries of part ``p``."""

    entries: list[np.ndarray]
    scale: int

    def text(self) -> str:
        """All components by part, entry and position, comma-joined."""
        return ",".join(str(x) for e in self.entries for x in e.ravel().tolist())


def blocks_with_trees(vectors: DataFrame, vector: str, keep: list[str], width: int, parts: int, scale: int) -> DataFrame:
    """One row for each block of vectors: its kept columns, its integers and a tree for each part."""
    each, most = width // parts, max(BLOCK_VALUES // max(width, 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(table: pa.Table) -> pa.RecordBatch:
            points = _integers(whole(table.column(table.num_columns - 1)), width, scale)
            if len(points) and 4 * each * int(np.abs(points).max()) ** 2 >= 1 << 62:
                raise ValueError("components are too large for exact 64-bit distances")
            ends = pa.array([0, len(points)], pa.int32())
            held = [pa.ListArray.from_arrays(ends, whole(table.column(i))) for i in range(len(keep))]
            trees = [build(points[:, p * each : (p + 1) * each]).pack() for p in range(parts)]
            return pa.RecordBatch.from_arrays([*held, pa.array([points.astype("<i8").tobytes()]), pa.array([trees], pa.list_(pa.binary()))], names=[*(f"k{i}" for i in range(len(keep))), "points", "trees"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= most:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, most))
                held, n = table.slice(most).to_batches(), n - most
        if n:
            yield block(pa.Table.from_batches(held))

    schema = T.StructType([*(T.StructField(f"k{i}", T.ArrayType(vectors.schema[c].dataType)) for i, c in enumerate(keep)), T.StructField("points", T.BinaryType()), T.StructField("trees", T.ArrayType(T.BinaryType()))])
    return map_arrow(vectors.select(*map(quoted, keep), quoted(vector)), run, schema)


def _parts(batches: Iterator[pa.RecordBatch], width: int, parts: int):
    """(row's batch, its place, points of all parts, trees) of one block after another."""
    for batch in batches:
        for i in range(batch.num_rows):
            points = np.frombuffer(batch.column("points")[i].as_buffer(), "<i8").reshape(-1, width)
            yield batch, i, points.reshape(len(points), parts, width // parts), [Tree.unpack(t.as_buffer()) for t in batch.column("trees")[i].values]


def round_sums(trees: DataFrame, shared, width: int, parts: int) -> DataFrame:
    """(part, entry, n, sums): what each task's parts add to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        n = [np.zeros(len(e), np.int64) for e in books]
        sums = [np.zeros(e.shape, np.int64) for e in books]
        for _, _, points, own in _parts(batches, width, parts):
            for p, entries in enumerate(books):
                code, more, total = walk(own[p], points[:, p], entries)
                alone = np.flatnonzero(code >= 0)
                n[p] += more + np.bincount(code[alone], minlength=len(entries))
                sums[p] += total
                np.add.at(sums[p], code[alone], points[alone, p])
        rows = [(p, int(i)) for p in range(parts) for i in np.flatnonzero(n[p])]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([i for _, i in rows], pa.int32()), pa.array([int(n[p][i]) for p, i in rows], pa.int64()), pa.array([sums[p][i].tolist() for p, i in rows], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return map_arrow(trees.select("points", "trees"), run, "part int, entry int, n long, sums array<long>")


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", keep: tuple[str, ...] = (), parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """Key, the columns of ``keep``, ``code`` (the nearest entry of each part) and ``error`` (squared distance over all parts) of each usable vector, and the codebooks."""
    spark, keep = vectors.sparkSession, [key, *keep]
    scratch = Scratch(spark, "vector-codes")
    kept = vectors.where(usable(quoted(vector)))
    first = kept.where(quoted(key).isNotNull()).select(quoted(key).alias("key"), quoted(vector).alias("v")).orderBy("key", "v").limit(entries).toArrow()
    some = first if first.num_rows else kept.select(F.lit(0).alias("key"), quoted(vector).alias("v")).limit(1).toArrow()
    width = len(some.column("v")[0]) if some.num_rows else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    each = width // parts
    start = _integers(whole(first.column("v")), width, scale)
    books = [start[:, p * each : (p + 1) * each].copy() for p in range(parts)]
    out_schema = T.StructType([*(vectors.schema[c] for c in keep), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not len(start):
        if some.num_rows:
            raise ValueError("no vector has a key, so there is nothing to start codebooks from")
        return spark.createDataFrame([], out_schema), Codebooks(books, scale)
    trees = scratch.save(blocks_with_trees(kept, vector, keep, width, parts, scale), "trees")

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(each)]
        new = [b.copy() for b in books]
        for row in round_sums(trees, shared, width, parts).groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
            new[row.part][row.entry] = [int(row[f"s{i}"]) // row.n for i in range(each)]
        books = new
        shared.unpersist()

    shared = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch, i, points, own in _parts(batches, width, parts):
            codes = np.stack([walk(own[p], points[:, p], e, cached=False)[0] for p, e in enumerate(books)], 1)
            error = sum(((points[:, p] - e[codes[:, p]]) ** 2).sum(1) for p, e in enumerate(books))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * parts, pa.int32()), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{k}")[i].values for k in range(len(keep))), flat, pa.array(error)], names=out_schema.names)

    return map_arrow(trees, code, out_schema), Codebooks(books, scale)


#: Groups that are sent to every task; more are joined by a shuffle, whose hot keys Spark splits.
MOST_BROADCAST = 100_000


def with_group_sum(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of equal ``group`` (nulls are equal)."""
    scratch = Scratch(rows.sparkSession, "group-sums")
    held = scratch.save(rows, "rows")
    sums = scratch.save(held.groupBy(quoted(group).alias("__group")).agg(F.sum(quoted(value)).alias(name)), "sums")
    small = sums.count() <= MOST_BROADCAST
    joined = held.join(F.broadcast(sums) if small else sums, quoted(group).eqNullSafe(F.col("__group")), "left")
    return joined.drop("__group")
