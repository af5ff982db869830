"""Benchmark decontamination with DataFrame functions only.

Texts become lower-cased runs of letters and digits.  Every window of a document
with as many words as a benchmark item is compared by its weighted 5-word
shingles: windows get a 64-bit SimHash, a multi-index of ``radius + 1`` bit
blocks finds all items of that size within ``radius`` bits (two fingerprints
that differ in no more bits agree in a block), and the exact weighted Jaccard
similarity of the shingle multisets decides.

Windows are taken where they can match at all: a window of which a smaller share
than ``similarity`` of its places holds a shingle of some item of its size is
below that similarity whatever the weights, because shingles of no item weigh
most.  Such places come from a join of the documents' shingles with the
benchmark's.  Weights are whole numbers from 1 to ``TOP_WEIGHT``: shingles that
fewer items share weigh more; a fingerprint counts their square roots, so that
its distance follows the weighted similarity.

An item of fewer than five words is one shingle, its whole sequence of words: it
is found where a document has just these words.

The benchmark's shingles are broadcast if there are at most ``MOST_BROADCAST``
of them; a larger benchmark is joined by shuffles.

At the threshold of 0.8 the expected distance of two fingerprints is 9.7 bits
with a deviation of 2.9 if all shingles weigh the same, so the default radius of
24 misses about one pair in a million there, and fewer above.  Where a few heavy
shingles of an item outweigh many light ones the deviation is larger.  So wide a
radius makes blocks of two or three bits: the index is a guarantee, and it is
the windows' bound that keeps the comparisons few.

Defined results: null texts and texts of fewer words than any item's shortest
shingle match nothing and are kept; an item without a word is not searched;
items and documents are compared whole, however long; a document shorter than an
item is compared as one window; documents are judged one by one, so repeated
rows, ties and null ids need no care; an empty benchmark keeps everything; an
empty document table gives no rows; other columns pass through and columns named
like a result, in whatever case, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, others, quoted

SHINGLE, TOP_WEIGHT, MOST_BROADCAST = 5, 8, 2_000_000
#: What a fingerprint counts for the weights 1 to 8: five times their square roots.
COUNTED = [round(5 * w**0.5) for w in range(1, TOP_WEIGHT + 1)]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_shingles(df: DataFrame, words: str, k: int = SHINGLE) -> DataFrame:
    """``df`` with sh: a hash for each window of ``k`` words, in order."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.col(words)[i + j] for j in range(k))))
    return df.withColumn("sh", F.when(F.size(words) >= k, hashes).otherwise(F.array().cast("array<bigint>")))


class Benchmark:
    """Items, their shingle counts and weights, and the multi-index over their fingerprints."""

    def __init__(self, items: DataFrame, scratch: Scratch, key: str, text: str, radius: int):
        words = items.select(quoted(key).cast("long").alias("item_id"), tokens(quoted(text)).alias("w")).where(F.size("w") > 0)
        whole = words.select(F.xxhash64("item_id", F.concat_ws(" ", "w")).alias("unit"), "item_id", "w", F.size("w").alias("words")).distinct()
        whole = scratch.save(whole, "whole")
        self.short = whole.where(F.col("words") < SHINGLE).select("item_id", "words", F.concat_ws(" ", "w").alias("phrase"))
        self.short_sizes = sorted(r.words for r in self.short.select("words").distinct().collect())  # 1 to 4
        self.units = scratch.save(with_shingles(whole.where(F.col("words") >= SHINGLE), "w").drop("w"), "units")
        counted = self.units.select("unit", "item_id", "words", F.explode("sh").alias("sh")).groupBy("unit", "item_id", "words", "sh").agg(F.count("*").alias("c"))
        spread = counted.groupBy("sh").agg(F.countDistinct("item_id").alias("df"))
        spread = spread.select("sh", F.greatest(F.lit(1), F.lit(TOP_WEIGHT) - F.floor(F.log2("df"))).cast("int").alias("weight"))
        self.shingles = scratch.save(counted.join(spread, "sh"), "shingles")
        small = self.shingles.count() <= MOST_BROADCAST
        self.hint = F.broadcast if small else (lambda df: df)
        self.weights = self.hint(self.shingles.groupBy("sh").agg(F.first("weight").alias("weight")))
        self.lengths = self.hint(self.shingles.groupBy("sh").agg(F.collect_set("words").alias("sizes")))
        longest = self.units.agg(F.max("words")).first()[0] or 0
        self.width = 16 if longest * COUNTED[-1] < 1 << 16 else 32
        prints = fingerprints(self.units.select("unit", "sh"), "unit", self.weights, self.width)
        self.index = scratch.save(self.units.select("unit", "item_id", "words").join(prints, "unit"), "items")
        self.blocks = bit_blocks(radius + 1)


def bit_blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of n blocks that together are the 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bit(h: str, i: int) -> str:
    return f"(shiftrightunsigned({h}, {i}) & 1L)"


def fingerprints(windows: DataFrame, key: str | list[str], weights: DataFrame, width: int = 16) -> DataFrame:
    """SimHash of the weighted shingles in ``sh`` for each key: (key..., fp, weight of all).

    Bit b of the fingerprint is set if the shingles whose hash has it set count
    more than half.  Counters of ``width`` bits share a long: four of 16 bits, or
    two of 32 where an item is so long that 16 could overflow.  All rows of a key
    come from one input row, so the sums are complete before the shuffle.
    """
    keys = [key] if isinstance(key, str) else key
    each = 64 // width
    rows = windows.select(*keys, F.explode("sh").alias("sh")).join(weights, "sh", "left").withColumn("weight", F.coalesce("weight", F.lit(TOP_WEIGHT)).cast("long"))
    rows = rows.withColumn("counted", F.element_at(F.array(*map(F.lit, COUNTED)), F.col("weight").cast("int")).cast("long"))
    lanes = [F.sum(F.expr("(" + " | ".join(f"shiftleft({_bit('sh', each * j + k)}, {width * k})" for k in range(each)) + ") * counted")).alias(f"s{j}") for j in range(width)]
    summed = rows.groupBy(*keys).agg(F.sum("weight").alias("total"), F.sum("counted").alias("counted"), *lanes)
    ones = [f"if(2 * (shiftrightunsigned(s{j}, {width * k}) & {(1 << width) - 1}L) > counted, {_long(1 << (each * j + k))}, 0L)" for j in range(width) for k in range(each)]
    for i in range(0, 64, 16):
        summed = summed.withColumn(f"f{i}", F.expr(" | ".join(ones[i : i + 16])))
    return summed.select(*keys, F.expr("f0 | f16 | f32 | f48").alias("fp"), "total")


def _long(x: int) -> str:
    x -= (1 << 64) * (x >> 63)
    return f"({x}L)" if x > -(1 << 63) else "shiftleft(1L, 63)"


def _mask(first: int, width: int) -> str:
    return _long(((1 << width) - 1) << first)


def window_starts(need: Column, length: Column, last: Column) -> Column:
    """Starts of the windows of ``length`` places that hold at least ``need`` of the sorted places ``at``."""
    ends = F.sequence(F.lit(0), F.size("at") - need)
    spans = F.transform(ends, lambda i: F.struct(F.greatest(F.col("at")[i + need - 1] - length + 1, F.lit(0)).alias("a"), F.least(F.col("at")[i], last).alias("b")))
    starts = F.transform(F.filter(spans, lambda s: s["a"] <= s["b"]), lambda s: F.sequence(s["a"], s["b"]))
    return F.when(F.size("at") >= need, F.array_distinct(F.flatten(starts))).otherwise(F.array().cast("array<int>"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "item_id", item_text: str = "text", similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """(row, item_id, similarity, start) of all matches; ``row`` is ``row_key`` of the document's text."""
    scratch = Scratch(docs.sparkSession, "leaks")
    bench = Benchmark(benchmark, scratch, key, item_text, radius)
    rows = docs.where(quoted(text).isNotNull()).select(row_key(quoted(text)).alias("row"), quoted(text).alias("t"))

    # Anchors: places whose shingle is in the benchmark, and the item sizes it occurs in.
    # (The outer form of posexplode keeps Catalyst from pushing a filter on the computed
    # array below its computation, which would repeat it.)
    made = with_shingles(rows.select("row", tokens(F.col("t")).alias("w")), "w").select("row", F.posexplode_outer("sh").alias("at", "h"))
    hits = made.join(bench.lengths.withColumnRenamed("sh", "h"), "h").select("row", "at", F.explode("sizes").alias("words"))
    hits = scratch.save(hits.groupBy("row", "words").agg(F.sort_array(F.collect_set("at")).alias("at")), "hits")
    texts = rows.join(hits.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.first("t").alias("t"))
    anchors = with_shingles(texts.select("row", tokens(F.col("t")).alias("w")), "w").select("row", "sh").join(hits, "row")

    # Windows of an item's size of which enough places are anchors.
    length = F.least(F.col("words") - SHINGLE + 1, F.size("sh"))
    need = F.ceil(F.lit(similarity) * length - 1e-9).cast("int")
    anchors = scratch.save(anchors.withColumn("start", window_starts(need, length, F.size("sh") - length)).where(F.size("start") > 0).drop("at"), "anchors")
    windows = anchors.select("row", "words", "sh", F.explode("start").alias("start"))
    windows = windows.select("row", "words", "start", F.slice("sh", F.col("start") + 1, F.col("words") - SHINGLE + 1).alias("sh"))
    prints = fingerprints(windows, ["row", "words", "start"], bench.weights, bench.width)

    # Multi-index: equal block, then the distance; a pair counts at its first equal block.
    values = F.array(*(F.struct(F.lit(i).alias("block"), F.expr(f"fp & {_mask(*b)}").alias("value")) for i, b in enumerate(bench.blocks)))
    items = bench.index.select("unit", "item_id", "words", F.col("fp").alias("item_fp"), F.col("total").alias("item_total"), F.explode(values).alias("v")).select("*", "v.block", "v.value").drop("v")
    probes = prints.select("*", F.explode(values).alias("v")).select("row", "words", "start", "fp", "total", "v.block", "v.value")
    differ = "(fp ^ item_fp)"
    first = "case " + " ".join(f"when {differ} & {_mask(*b)} = 0 then {i}" for i, b in enumerate(bench.blocks)) + " end"
    near = probes.join(bench.hint(items), ["words", "block", "value"]).where(f"bit_count({differ}) <= {radius}").where(f"{first} = block")
    near = scratch.save(near.select("row", "words", "start", "total", "unit", "item_id", "item_total"), "near")

    # Exact weighted Jaccard similarity of the multisets.
    source = anchors.select("row", "words", "sh")
    checked = near.join(source, ["row", "words"]).withColumn("h", F.explode(F.slice("sh", F.col("start") + 1, F.col("words") - SHINGLE + 1)))
    own = ["row", "item_id", "unit", "start", "total", "item_total"]
    checked = checked.join(bench.hint(bench.shingles.select("unit", F.col("sh").alias("h"), "c", "weight")), ["unit", "h"]).groupBy(*own, "h").agg(F.first("weight").alias("weight"), F.least(F.count("*"), F.first("c")).alias("both"))
    checked = checked.groupBy(*own).agg(F.sum(F.col("weight") * F.col("both")).alias("shared"))
    score = F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared"))
    found = checked.select("row", "item_id", score.alias("similarity"), "start").where(F.col("similarity") >= similarity)
    for k in bench.short_sizes:
        phrases = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i, k=k: F.concat_ws(" ", F.slice("w", i + 1, k)))
        spoken = rows.select("row", tokens(F.col("t")).alias("w")).where(F.size("w") >= k).select("row", F.posexplode_outer(phrases).alias("start", "phrase"))
        short = bench.hint(bench.short.where(F.col("words") == k).select("item_id", "phrase"))
        found = found.unionByName(spoken.join(short, "phrase").select("row", "item_id", F.lit(1.0).alias("similarity"), "start"))
    found = scratch.save(found.groupBy("row", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by("start", F.struct(-F.col("similarity"), "start")).alias("start")), "found")
    scratch.drop("hits", "anchors", "near", "whole", "units", "shingles", "items")
    return found


def row_key(text: Column) -> Column:
    """128 bits of the text, the one thing that a document's verdict depends on; null for null."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")))


def flag_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without its text, with n_items, item_ids (sorted), similarity (highest) and kept."""
    new = ["n_items", "item_ids", "similarity", "kept"]
    row, ids, best = fresh(docs, "row", "ids", "best")
    leaks = find_leaks(docs, benchmark, text, **options).groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list("item_id")).alias(ids), F.max("similarity").alias(best))
    joined = docs.select(*map(quoted, others(docs, text, *new)), row_key(quoted(text)).alias(row)).join(leaks, row, "left")
    items = F.coalesce(ids, F.array().cast("array<bigint>"))
    return joined.select(*map(quoted, others(docs, text, *new)), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.coalesce(best, F.lit(0.0)).alias("similarity"), F.col(ids).isNull().alias("kept"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    (row,) = fresh(docs, "row")
    leaks = find_leaks(docs, benchmark, text, **options).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_key(quoted(text))).join(leaks, row, "left_anti").select(*map(quoted, docs.columns))
