"""Near-duplicate documents by circulant MinHash.

Signatures: the shingle hashes are put through one permutation, and every
coordinate of the signature is the minimum of a second permutation that is
circularly shifted by the coordinate's number (Li and Li, "C-MinHash").  Bands
of coordinates propose pairs, and every link is confirmed by the exact Jaccard
similarity of the full shingle sets.  With 48 bands of 6 a pair at the threshold
of 0.8 shares no band with a probability of 5e-7.

Large groups never become all pairs.  Documents with equal sets are one class.
Within a bucket, classes are first compared with the bucket's smallest class;
what that links needs no further comparison, so only classes of a bucket that
are still apart are compared with each other, which makes the links' components
complete.  Those comparisons pass an exact bound first: a parity sketch of each
set (512 bits, each the parity of the shingles that hash to it) differs in no
more bits than the sets differ in shingles.

Defined results: null or word-less texts have an empty set, link with nothing
and are kept; rows with a null id are in no group and are kept (component null);
an id that comes with several texts is one document, linked if any of them is;
very long texts are compared whole; an empty table gives no rows; only the id
and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAMMA, Block, Scratch, by_doc, components, fresh, in_filter, key_filter, lists, lower, map_blocks, mix64, quoted, set_digests, shingles, signed, spans_hash, words

SKETCH = 8  # longs of the parity sketch
SIGNED = "id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"


def shingle_sets(block: Block, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; A-Z lower-cased."""
    low = lower(block.data)
    starts, ends, doc = words(block, low)
    hashes, bounds = spans_hash(low, starts, ends), by_doc(doc, block.n)
    return [np.unique(shingles(hashes[bounds[i] : bounds[i + 1]], k)) for i in range(block.n)]


def permute(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 32-bit integers (the finaliser of MurmurHash3), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


#: Shifts of the second permutation: multiples of an odd constant, a circular walk through all 2^32 places.
_STEP = np.uint32(0x9E3779B9)


def signature(shingle_set: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates from two permutations: the first scatters, the second is shifted."""
    first = (mix64(shingle_set) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32) * _STEP
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 256):
        np.minimum(out, permute(first[at : at + 256, None] + shifts).min(0), out=out)
    return out


def parity(shingle_set: np.ndarray) -> np.ndarray:
    """Bit b: whether an odd number of shingles hash to it."""
    slot = (mix64(shingle_set ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(55)).astype(np.int64)
    odd = (np.bincount(slot, minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def sign(docs: DataFrame, text: str, key: str, k: int, bands: int, rows: int) -> DataFrame:
    """Set size, 128-bit set digest and band hashes of every document (no bands for empty sets)."""

    def make():
        number = np.arange(bands, dtype=np.uint64) * np.uint64(GAMMA)

        def work(block: Block, table: pa.Table) -> list:
            sets = shingle_sets(block, k)
            d1, d2 = set_digests(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
            hashes, bounds = [], [0]
            for s in sets:
                if len(s):
                    h = number.copy()
                    for column in signature(s, bands * rows).reshape(bands, rows).T:
                        h = mix64(h * np.uint64(GAMMA) + column)
                    hashes.append(signed(h))
                bounds.append(bounds[-1] + (bands if len(s) else 0))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            sketch = signed(np.concatenate([parity(s) for s in sets]))
            return [table.column("id"), np.array([len(s) for s in sets], np.int64), signed(d1), signed(d2), lists(flat, np.array(bounds), pa.int64()), lists(sketch, SKETCH * np.arange(block.n + 1), pa.int64())]

        return work

    return map_blocks(docs.select(quoted(key).cast("long").alias("id"), quoted(text).alias("text")), "text", make, SIGNED)


def sets_of(docs: DataFrame, text: str, key: str, k: int, wanted) -> DataFrame:
    """(d1, d2, s): the shingle sets of the documents whose id may be in the filter ``wanted``."""

    def make():
        bits = wanted.value

        def work(block: Block, table: pa.Table) -> list:
            ids = table.column("id")
            some = np.flatnonzero(in_filter(bits, ids.fill_null(0).to_numpy()))
            if not len(some):
                return [np.zeros(0, np.int64), np.zeros(0, np.int64), lists(np.zeros(0, np.int64), np.zeros(1, np.int64), pa.int64())]
            sets = [shingle_sets(Block(block.data[block.offs[i] : block.offs[i + 1]], block.offs[i : i + 2] - block.offs[i], 0), k)[0] for i in some]
            flat, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            d1, d2 = set_digests(flat, bounds)
            return [signed(d1), signed(d2), lists(signed(flat), bounds, pa.int64())]

        return work

    return map_blocks(docs.select(quoted(key).cast("long").alias("id"), quoted(text).alias("text")), "text", make, "d1 long, d2 long, s array<long>")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id and kept.

    Two documents are linked if ``100 * |intersection| >= percent * |union|``;
    a component is named after its smallest id, which alone is kept.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near-dup")
    signed_docs = scratch.save(sign(docs, text, key, k, bands, rows), "signed")
    shown = signed_docs.where("id is not null and n_shingles > 0")
    # A class: all documents of one set, by the set's 128-bit digest; its number is unique, whatever the ids.
    classes = shown.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = scratch.save(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("number", "n", F.explode("bands").alias("bucket"))

    # Buckets of several classes, and in each the one of the smallest number.
    hubs = buckets.groupBy("bucket").agg(F.min("number").alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = scratch.save(buckets.join(hubs.select("bucket", "hub"), "bucket"), "members")
    pairs = members.where("number <> hub").groupBy("number").agg(F.min("hub").alias("b")).select(F.col("number").alias("a"), "b")
    wanted = scratch.save(members.select("number").distinct().join(classes.select("number", "rep", "d1", "d2"), "number"), "wanted")
    bits = spark.sparkContext.broadcast(key_filter(wanted.select("rep")))
    sets = sets_of(docs, text, key, k, bits).join(wanted.select("number", "d1", "d2"), ["d1", "d2"]).groupBy("number").agg(F.first("s").alias("s"))
    sets = scratch.save(sets, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("number").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("number").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

    # An id with several sets is one document: its classes are linked.
    several = shown.groupBy("id").agg(*(f(c).alias(f"{n}{c}") for c in ("d1", "d2") for n, f in (("low_", F.min), ("high_", F.max)))).where("low_d1 <> high_d1 or low_d2 <> high_d2")
    of_id = shown.join(several.select("id"), "id", "left_semi").select("id", "d1", "d2").join(classes.select("number", "d1", "d2"), ["d1", "d2"]).select("id", "number")
    one_document = of_id.join(of_id.groupBy("id").agg(F.min("number").alias("b")), "id").where("number <> b").select(F.col("number").alias("a"), "b")

    links = scratch.save(confirmed(pairs).unionByName(one_document), "links1")
    near = components(links, scratch)

    # Classes of one bucket that are still apart: each bucket's components first
    # meet by one member each, then, where that did not link them, by all.
    def apart(near: DataFrame) -> DataFrame:
        placed = members.select("bucket", "number", "n").join(near.select(F.col("id").alias("number"), "component"), "number", "left").withColumn("component", F.coalesce("component", "number"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        return placed.join(mixed.select("bucket", "low"), "bucket")

    rest = scratch.save(apart(near), "apart1")
    heads = rest.groupBy("bucket", "component").agg(F.min("number").alias("b"), F.first("low").alias("low"))
    firsts = heads.where("component = low").select("bucket", F.col("b").alias("a"))
    tried = heads.where("component <> low").join(firsts, "bucket").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links2 = scratch.save(confirmed(tried).unionByName(links), "links2")
    near = components(links2, scratch)
    rest = scratch.save(apart(near), "apart2")
    # Sets of matching sizes are in one size range or in neighbouring ones, which splits a bucket of many classes.
    sketched = rest.join(classes.select("number", *[F.col("sketch")[i].alias(f"k{i}") for i in range(SKETCH)]), "number")
    sketched = scratch.save(sketched.withColumn("range", F.floor(F.log("n") / np.log(101 / percent)).cast("int")), "sketched")
    side = lambda x, y, near_by: sketched.select("bucket", near_by.alias("range"), F.col("number").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), *[F.col(f"k{i}").alias(f"{y}{i}") for i in range(SKETCH)])
    left, right = side("a", "p", F.col("range")), side("b", "q", F.explode(F.array(*(F.col("range") + i for i in (-1, 0, 1)))))
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(SKETCH)), F.lit(0))
    most = F.expr(f"na + nb - 2 * (({percent}L * (na + nb) + {99 + percent}L) div {100 + percent}L)")
    close = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("ca") < F.col("cb")) & (differ <= most)
    last = left.join(right, ["bucket", "range"]).where(close).select("a", "b").distinct()
    links3 = scratch.save(confirmed(last).unionByName(links2), "links3")
    near = scratch.save(components(links3, scratch), "near")

    numbered = classes.select("d1", "d2", "rep", "number").join(near.select(F.col("id").alias("number"), "component"), "number", "left").withColumn("component", F.coalesce("component", "number"))
    named = numbered.join(numbered.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
    named = scratch.save(named.select("d1", "d2", "component_id"), "named")
    scratch.drop("members", "wanted", "sets", "links1", "links2", "links3", "apart1", "apart2", "sketched", "near", "classes")
    out = signed_docs.select("id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose document is not kept."""
    (gone,) = fresh(docs, "gone")
    ids = near_duplicates(docs, text, key, **options).where("not kept").select(F.col("id").alias(gone)).distinct()
    return docs.join(ids, quoted(key).cast("long") == F.col(gone), "left_anti")
