"""Target-distribution importance resampling by bit-sliced aggregation.

Features are the runs of one to ``WORDS`` consecutive words, hashed into buckets
by CRC-32.  A bucket's gain is the scaled logarithm of how much more often the
target has it than the corpus, each with one added to every bucket; a document's
weight is the sum of the gains of its features.  Gumbel noise from the document's
key turns the weights into scores, of which the highest are drawn (a sample
without replacement by the weights' exponentials).

A document's bucket counts are sliced into bit planes, each with one bit for each
bucket, and so are the gains in two's complement, once for all.  A document's
weight is then the sum, over pairs of planes, of a power of two times the number
of bits that both planes have: AND and popcount, 64 buckets at a time, exact in
64-bit integers.

CRC-32 is linear, so the CRC of a run comes from those of its words: a word's
state is moved on by the next word's length (four table lookups) and the next
word's is added to it.

Defined results: null and empty texts have no features and weight 0; texts of any
length are read whole; repeated rows are documents of their own and count as often
as they come; equal scores go by the smaller key, null keys first (their noise is
that of an empty key); an empty corpus gives no rows; with an empty target all
gains come from the corpus alone; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, Scratch, blocks, kind_of, lower, map_arrow, map_blocks, quoted, ranked

BUCKETS, WORDS = 10000, 3
#: Words up to this length move a CRC on by table; longer ones go through zlib.
LONG_WORD = 64
#: Documents whose counts are sliced together.
AT_ONCE = 64

# -- CRC-32 of runs of words ------------------------------------------------------------


def _crc_table() -> np.ndarray:
    """What a byte does to the CRC register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def _moves() -> np.ndarray:
    """``[n, k, b]``: the register after ``n`` zero bytes, if byte ``k`` of it was ``b`` and the others 0."""
    out = np.zeros((LONG_WORD + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> 8) ^ CRC[out[n - 1] & 255]
    return out.reshape(len(out), -1)


MOVES = _moves()


def moved(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC registers after ``n`` zero bytes each; ``n`` up to LONG_WORD."""
    out = np.zeros_like(state)
    flat, base = MOVES.ravel(), n * 1024
    for k in range(4):
        out ^= flat[base + 256 * k + ((state >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def moved_far(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = state
    while (n > 0).any():
        out = moved(out, np.minimum(n, LONG_WORD))
        n = n - np.minimum(n, LONG_WORD)
    return out


#: The register that starts from all ones, after so many zero bytes.
ONES = moved_far(np.full(4 * LONG_WORD, 0xFFFFFFFF, np.uint32), np.arange(4 * LONG_WORD))


def crc_of(run: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of runs whose registers started from 0."""
    ones = ONES[np.minimum(length, len(ONES) - 1)]
    far = np.flatnonzero(length >= len(ONES))
    ones[far] = moved_far(np.full(len(far), 0xFFFFFFFF, np.uint32), length[far])
    return run ^ ones ^ np.uint32(0xFFFFFFFF)


def word_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The register after each word, from 0 on."""
    size = ends - starts
    state = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    at, of = starts[order], np.minimum(size[order], LONG_WORD + 1)
    many = np.searchsorted(-of, -np.arange(1, LONG_WORD + 1), "right")  # words with at least so many bytes
    long = int(np.searchsorted(-of, -LONG_WORD, "left"))
    done = np.zeros(len(starts), np.uint32)
    for i, n in enumerate(many.tolist()):
        if not n:
            break
        done[:n] = (done[:n] >> np.uint32(8)) ^ CRC[(done[:n] ^ data[at[:n] + i]) & np.uint32(255)]
    state[order] = done
    for i in order[:long].tolist():
        # zlib's register starts from all ones and is inverted at the end.
        ones = moved_far(np.array([0xFFFFFFFF], np.uint32), np.array([size[i]]))[0]
        state[i] = np.uint32(zlib.crc32(data[starts[i] : ends[i]].tobytes()) ^ 0xFFFFFFFF) ^ ones
    return state


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every feature of a block, and each document's number of words."""
    low = lower(block.data)
    # Fixed classes of the contract: digits, a-z and all bytes beyond ASCII make words.
    in_word = (low - np.uint8(48) < 10) | (low - np.uint8(97) < 26) | (low > 127)
    if not in_word.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(block.n, np.int64)
    edge = np.zeros(len(low) + 1, bool)  # where documents start, and the end
    edge[block.offs] = True
    first, last = in_word.copy(), in_word.copy()
    first[1:] &= ~in_word[:-1] | edge[1:-1]
    last[:-1] &= ~in_word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    many = np.diff(np.searchsorted(starts, block.offs))
    doc = np.repeat(np.arange(block.n), many)
    size, state = ends - starts, word_states(low, starts, ends)
    move = moved if (size <= LONG_WORD).all() else moved_far
    crcs, docs = [], []
    # The register of a run of words, and the length of the run, for runs that start at each word.
    run, length = state, size
    for k in range(WORDS):
        if k:
            ok = np.flatnonzero(doc[k:] == doc[:-k]) if k < len(doc) else np.zeros(0, np.int64)
            keep = ok if k == 1 else np.searchsorted(held, ok)
            run, length = run[keep], length[keep]
            space = (run >> np.uint32(8)) ^ CRC[(run ^ np.uint32(32)) & np.uint32(255)]
            run = move(space, size[ok + k]) ^ state[ok + k]
            length = length + 1 + size[ok + k]
            held = ok
        else:
            ok = held = np.arange(len(doc))
        crcs.append(crc_of(run, length))
        docs.append(doc[ok])
    return (np.concatenate(crcs) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate(docs), many


# -- bit planes -------------------------------------------------------------------------


def planes(numbers: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` low bit planes of each row of numbers, as 64-bit words: (rows, n, words)."""
    bits = (numbers[:, None, :] >> np.arange(n, dtype=numbers.dtype)[None, :, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=2)
    return np.pad(packed, ((0, 0), (0, 0), (0, -packed.shape[2] % 8))).view(np.uint64)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two's complement planes of the gains and what a bit of each counts; the last is the sign's."""
    n = max(int(np.abs(gains).max(initial=0)), 1).bit_length() + 1
    worth = 2 ** np.arange(n, dtype=np.int64)
    worth[-1] *= -1
    return planes(gains[None, :].astype(np.int64), n)[0], worth


def weights(bucket: np.ndarray, doc: np.ndarray, n: int, gain: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The weight of each of ``n`` documents from the buckets of their features."""
    out = np.zeros(n, np.int64)
    order = np.argsort(doc, kind="stable")
    bucket, doc = bucket[order], doc[order]
    for low in range(0, n, AT_ONCE):
        a, b = np.searchsorted(doc, [low, min(low + AT_ONCE, n)])
        if a == b:
            continue
        counts = np.bincount((doc[a:b] - low) * BUCKETS + bucket[a:b], minlength=min(AT_ONCE, n - low) * BUCKETS).reshape(-1, BUCKETS)
        deep = int(counts.max()).bit_length()
        sliced = planes(counts.astype(np.uint8 if deep <= 8 else np.int64), deep)
        for k in range(deep):
            rows = np.flatnonzero(sliced[:, k].any(1))
            hits = np.bitwise_count(sliced[rows, k][:, None, :] & gain[None]).sum(2, dtype=np.int64)
            out[low + rows] += (hits @ worth) << k
    return out


# -- Spark ------------------------------------------------------------------------------


def bucket_counts(texts: DataFrame, text: str) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                total += np.bincount(features(block)[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in map_arrow(texts.select(quoted(text)), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[row.bucket] = row.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of each bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def gumbel(key: Column, seed: int) -> Column:
    """Scaled Gumbel noise of a key: the same for the same key and seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", seed: int = 42) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every document."""
    spark = docs.sparkSession
    made = gain_planes(gains_of(bucket_counts(docs, text), bucket_counts(target, target_text)))
    shared = spark.sparkContext.broadcast(made)

    def make():
        gain, worth = shared.value

        def work(block: Block, table: pa.Table) -> list:
            bucket, doc, n_words = features(block)
            n = np.bincount(doc, minlength=block.n)
            return [table.column("id"), n_words, n, weights(bucket, doc, block.n, gain, worth)]

        return work

    weighed = map_blocks(docs.select(quoted(key).alias("id"), quoted(text).alias("text")), "text", make, f"id {kind_of(docs, key)}, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumnRenamed("id", key)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``weigh`` with ``rank``: 1, 2, 3... for the ``percent`` of the documents of at least ``least_words`` words with the highest scores, else null."""
    scratch = Scratch(docs.sparkSession, "importance")
    scored = scratch.save(weigh(docs, target, text, key, target_text, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    wanted = fit.count() * percent // 100
    # A score that more than the wanted documents reach for certain leaves little to sort.
    low = fit.select(F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.01), 1000)).first()[0] if wanted else None
    if low is not None and fit.where(F.col("score") >= low).count() < wanted:
        low = None
    top = (F.col("n_words") >= least_words) & (F.lit(True) if low is None else F.col("score") >= low)
    drawn = ranked(scored.where(top), scratch, [F.col("score").desc(), F.col(key).asc(), F.col("row").asc()], "ordered")
    rank = F.when(F.col("rank") < wanted, F.col("rank") + 1)
    rest = scored.where(~top).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", rank).unionByName(rest).drop("row")
