"""Rows kept as numpy blocks, for fits that pass over them many times.

A step of such a fit is one short job on blocks that are ready: the plan is made
and the vectors are taken apart once, not for every step.  The fits of several
folds take their steps together, in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most.
ROWS = 4096
#: From so many tasks on, sums of tasks meet in a few tasks before they meet on the driver.
MANY = 64


@contextmanager
def packed(rows: DataFrame) -> Iterator[Callable[[int | None], RDD]]:
    """Gives, for the number of a mini-batch (None: all), an RDD of blocks (fold, x by row, y, w) of ``rows`` (columns x, y, w, fold and the mini-batch's number b)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, w, b, fold = (batch.column(c).to_numpy() for c in ("y", "w", "b", "fold"))
            keys, of = np.unique(np.stack([b, fold], 1), axis=0, return_inverse=True)
            for i, key in enumerate(keys):
                own = np.flatnonzero(of.ravel() == i)
                for part in np.array_split(own, -(-len(own) // ROWS)):
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (*key, len(part))), *(pa.array([np.ascontiguousarray(v[part], np.float64).tobytes()]) for v in (x, y, w))], names=["b", "fold", "n", "x", "y", "w"])

    def unpack(r) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return r.fold, np.frombuffer(r.x).reshape(r.n, -1), np.frombuffer(r.y), np.frombuffer(r.w)

    made = rows.select("x", "y", "w", F.col("b").cast("int").alias("b"), F.col("fold").cast("int").alias("fold")).mapInArrow(pack, "b int, fold int, n int, x binary, y binary, w binary").persist()
    ready: dict[int | None, RDD] = {}

    def of(number: int | None = None) -> RDD:
        if number not in ready:
            ready[number] = (made if number is None else made.where(F.col("b") == number)).rdd.map(unpack)
        return ready[number]

    try:
        yield of
    finally:
        made.unpersist()


def summed(blocks: RDD, run: Callable[[list], object], add: Callable[[object, object], object]):
    """What ``run`` makes of each task's blocks, added up in the order of the tasks."""
    parts = blocks.mapPartitions(lambda own: [run(list(own))])
    if parts.getNumPartitions() > MANY:
        return parts.treeReduce(add)
    first, *rest = parts.collect()  # one for each task
    for r in rest:
        first = add(first, r)
    return first


#: A fit asks for (number of a mini-batch or None, what to make of a task's blocks (x, y, w), how two such are added), gets the sum, and returns its model.
Fit = Generator[tuple, object, object]


def together(blocks: Callable[[int | None], RDD], fits: dict[int | None, Fit]) -> dict:
    """What the fits return; the fit of a fold gets the blocks of all other folds, that of None all blocks.  Fits that ask for the same mini-batch share a job."""
    told, done = dict.fromkeys(fits), {}
    while told:
        asked: dict[int | None, dict] = {}
        for fold, answer in told.items():
            try:
                number, run, add = fits[fold].send(answer)
                asked.setdefault(number, {})[fold] = run, add
            except StopIteration as end:
                done[fold] = end.value
        told = {}
        for number, jobs in asked.items():
            runs, adds = {f: r for f, (r, _) in jobs.items()}, {f: a for f, (_, a) in jobs.items()}
            own = lambda held, runs=runs: {f: run([b[1:] for b in held if f is None or b[0] != f]) for f, run in runs.items()}
            both = lambda a, b, adds=adds: {f: add(a[f], b[f]) for f, add in adds.items()}
            told |= summed(blocks(number), own, both)
    return done
