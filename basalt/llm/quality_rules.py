"""Quality rules: counting rules and n-gram perplexity bands.

The language model is a modified Kneser-Ney model of one fixed order over the
bytes of the lower-cased words of a document, joined by single spaces, so that
n-grams cross the edges of words.  Keys pack an n-gram's bytes, so two n-grams
never share a key.  Documents are dealt into buckets of about ``BUCKET_BYTES``;
each bucket's distinct n-grams, in ``PARTS`` parts with sorted arrays, are
counted, given their probabilities in the model's table, and joined back to the
bucket, so nothing that grows with the corpus is broadcast or sent to the driver.

A document is rejected if its log perplexity per byte lies outside its
language's band, which reaches ``width`` interquartile ranges to either side of
the median of that language's documents.  A mean over fewer words varies more,
so the band of a document with fewer words than the median is wider by the
square root of the ratio.

Defined results: null text counts as empty and has no words; a null lang is a
language of its own; documents are judged one by one against statistics of the
whole table, so repeated rows count as often as they occur; very long texts are
read whole, in the bucket that they fill; an empty table gives no rows; a
document without words has no perplexity and fails the base rules; other columns
pass through and columns named like a result, in whatever case, are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import Block, Scratch, blocks, by_doc, fresh, lists, lower, others, quoted, shingles, ship, signed, spans_hash, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes of text in a bucket of documents, and parts of the model (n-gram keys modulo a prime).
BUCKET_BYTES = 32 << 20
PARTS = 251
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


# -- counting rules ---------------------------------------------------------------------


def rule_counts(block: Block) -> list[np.ndarray]:
    """The five counts of every document of a block."""
    data, n = block.data, block.n
    starts, ends, doc = words(block)
    per_doc = lambda at, k=None: np.bincount(np.searchsorted(block.offs, at, "right") - 1, k, minlength=n)[:n].astype(np.int64)
    n_words = np.bincount(doc, minlength=n)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.bincount(doc, chars[ends] - chars[starts], minlength=n).astype(np.int64)
    n_symbols = per_doc(np.flatnonzero(_SYMBOL[data]))

    hashes, bounds = spans_hash(data, starts, ends), by_doc(doc, n)
    repeat = np.zeros(n, np.int64)
    for i in range(n):
        own = hashes[bounds[i] : bounds[i + 1]]
        if len(own) < 6:
            continue
        windows = shingles(own, 5)
        _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        if again.any():
            cover = np.zeros(len(own) + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeat[i] = int((np.cumsum(cover) > 0).sum())

    # Lines end at a line feed or with the document; those with a word are compared.
    breaks = np.flatnonzero(data == 10)
    line_from = np.sort(np.concatenate([block.offs[:-1], breaks + 1]), kind="stable")
    line_to = np.sort(np.concatenate([breaks, block.offs[1:]]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(block.offs, breaks, "right") - 1]), kind="stable")
    has = np.searchsorted(starts, line_to, "left") > np.searchsorted(starts, line_from, "left")
    line_from, line_to, line_doc = line_from[has], line_to[has], line_doc[has]
    key = spans_hash(data, line_from, line_to)
    order = np.lexsort((key, line_doc))
    same = (key[order][1:] == key[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup = np.bincount(line_doc[order][1:][same], minlength=n)[:n]
    return [n_words, word_chars, n_symbols, dup, repeat]


# -- the language model -----------------------------------------------------------------


def text_grams(block: Block, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of each document's words joined by spaces (``order - 1`` spaces before, one after), and each one's document."""
    low = lower(block.data)
    starts, ends, doc = words(block, low)
    size = ends - starts + 1
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + starts[word]
    own = doc[word]
    stream = np.where(at < ends[word], low[np.minimum(at, max(len(low) - 1, 0))], 32).astype(np.uint64)
    before = np.arange(len(word)) - np.searchsorted(own, own)
    keys = np.zeros(len(word), np.uint64)
    for back in range(order - 1, -1, -1):
        byte = np.full(len(word), 32, np.uint64)
        byte[back:] = np.where(before[back:] >= back, stream[: len(word) - back], np.uint64(32))
        keys = (keys << np.uint64(8)) | byte
    return keys, own


def counted_grams(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of some texts and their counts."""
    found = []
    for chunk in texts.chunks:
        for block in blocks(chunk):
            found.append(np.unique(text_grams(block, order)[0], return_counts=True))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)


def bucket_grams(dealt: DataFrame, text: str, bucket: str, order: int) -> DataFrame:
    """(bucket, part, grams, counts): the distinct n-grams of each bucket of documents, in parts."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = counted_grams(table.column("text"), order)
        part = (keys % np.uint64(PARTS)).astype(np.int64)
        at = np.argsort(part, kind="stable")
        used, size = np.unique(part, return_counts=True)
        bounds = np.concatenate([[0], np.cumsum(size)])
        bucket = pa.array(np.full(len(used), table.column("bucket")[0].as_py(), np.int64))
        return pa.Table.from_arrays([bucket, pa.array(used), lists(signed(keys[at]), bounds, pa.int64()), lists(counts[at], bounds, pa.int64())], names=["bucket", "part", "grams", "counts"])

    ship(dealt.sparkSession)
    return dealt.select(quoted(bucket).alias("bucket"), quoted(text).alias("text")).groupBy("bucket").applyInArrow(run, "bucket long, part long, grams array<long>, counts array<long>")


def count_grams(grams: DataFrame) -> DataFrame:
    """(gram, n) over all buckets."""

    def run(table: pa.Table) -> pa.Table:
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        keys, inverse = np.unique(flat("grams"), return_inverse=True)
        return pa.Table.from_arrays([pa.array(keys), pa.array(np.bincount(inverse, flat("counts"), minlength=len(keys)).astype(np.int64))], names=["gram", "n"])

    return grams.groupBy("part").applyInArrow(run, "gram long, n long")


def probabilities(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(gram, p): what ``fit`` gives the n-grams of the highest order, as a table."""
    levels = [counts.select("gram", "n")]
    for n in range(order - 1, 0, -1):
        levels.insert(0, scratch.save(levels[0].groupBy(F.col("gram").bitwiseAND((1 << 8 * n) - 1).alias("gram")).agg(F.count("*").alias("n")), f"level{n}"))
    below = None
    for k, level in enumerate(levels, 1):
        seen = dict(level.where("n <= 4").groupBy("n").count().collect())
        d = discounts(*(float(seen.get(i, 0)) for i in (1, 2, 3, 4)))
        step = F.array(*(F.lit(float(x)) for x in d))[F.least(F.col("n"), F.lit(3)).cast("int")]
        own = level.select("gram", "n", step.alias("d"), F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("end"))
        context = own.groupBy("context").agg(F.sum("n").alias("total"), *(F.count_if(F.least("n", F.lit(3)) == i).alias(f"n{i}") for i in (1, 2, 3)))
        context = context.select("context", "total", sum(float(d[i]) * F.col(f"n{i}") for i in (1, 2, 3)).alias("held"))
        joined = own.join(context, "context")
        joined = joined.withColumn("lower", F.lit(1 / 256)) if below is None else joined.join(below.select(F.col("gram").alias("end"), F.col("p").alias("lower")), "end")
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("held") / F.col("total") * F.col("lower")
        below = scratch.save(joined.select("gram", p.alias("p")), f"probs{k}")
    return below


def priced_grams(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(bucket, grams, costs): the buckets' n-grams with their negative log probabilities."""

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        keys, p = table.column("gram").to_numpy(), table.column("p").to_numpy()
        at = np.argsort(keys)
        wanted = asked.column("grams").combine_chunks()
        cost = -np.log(p[at][np.searchsorted(keys, wanted.flatten().to_numpy(), sorter=at)])
        bounds = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy())])
        return pa.Table.from_arrays([asked.column("bucket"), asked.column("grams"), lists(cost.astype(np.float32), bounds, pa.float32())], names=["bucket", "grams", "costs"])

    parted = model.select((F.col("gram") % PARTS).alias("part"), "gram", "p")
    return grams.select("part", "bucket", "grams").groupBy("part").cogroup(parted.groupBy("part")).applyInArrow(run, "bucket long, grams array<long>, costs array<float>")


@dataclass
class KneserNey:
    """For each order, sorted n-gram keys with probabilities and sorted contexts with back-off weights."""

    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]

    @property
    def order(self) -> int:
        return len(self.grams)

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / 256)
        for n in range(1, self.order + 1):
            own = keys & np.uint64((1 << 8 * n) - 1)
            at = _find(self.grams[n - 1], own)
            context = _find(self.contexts[n - 1], own >> np.uint64(8))
            back = np.where(context >= 0, self.backoff[n - 1][context], 1.0) if len(self.backoff[n - 1]) else 1.0
            p = np.where(at >= 0, self.probs[n - 1][at], back * p) if len(self.grams[n - 1]) else p
        return np.log(p)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in a sorted array, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts of the counts 0, 1, 2 and 3 or more, from how many n-grams occur 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    return np.array([0.0] + [min(max(k - (k + 1) * y * b / a, 0.0), k) if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])


def fit(keys: np.ndarray, counts: np.ndarray, order: int) -> KneserNey:
    """Modified Kneser-Ney (Chen and Goodman) from the counts of the highest order.

    Lower orders count the distinct bytes that come before an n-gram.
    """
    at = np.argsort(keys)
    levels = [(keys[at].astype(np.uint64), counts[at].astype(np.float64))]
    for n in range(order - 1, 0, -1):
        own, c = np.unique(levels[0][0] & np.uint64((1 << 8 * n) - 1), return_counts=True)
        levels.insert(0, (own, c.astype(np.float64)))
    model, below = KneserNey([], [], [], []), None
    for n, (own, c) in enumerate(levels, 1):
        d = discounts(*(float((c == k).sum()) for k in (1, 2, 3, 4)))
        step = np.minimum(c, 3).astype(int)
        contexts, inverse = np.unique(own >> np.uint64(8), return_inverse=True)
        total = np.bincount(inverse, c)
        weight = np.bincount(inverse, d[step]) / total
        lower = np.full(len(own), 1 / 256) if below is None else below[1][_find(below[0], own & np.uint64((1 << 8 * (n - 1)) - 1))]
        p = np.maximum(c - d[step], 0) / total[inverse] + weight[inverse] * lower
        model.grams.append(own)
        model.probs.append(p.astype(np.float32))
        model.contexts.append(contexts)
        model.backoff.append(weight.astype(np.float32))
        below = (own, p)
    return model


def perplexity(grams: np.ndarray, costs: np.ndarray, block: Block, order: int) -> np.ndarray:
    """Mean negative log probability of a byte in each document; NaN without words."""
    keys, doc = text_grams(block, order)
    own, at = np.unique(keys.astype(np.int64), return_inverse=True)
    cost = costs[np.searchsorted(grams, own)][at] if len(own) else np.zeros(0)
    with np.errstate(invalid="ignore"):
        return np.bincount(doc, cost, minlength=block.n) / np.bincount(doc, minlength=block.n)


def score(dealt: DataFrame, priced: DataFrame, text: str, bucket: str, order: int) -> DataFrame:
    """``dealt`` documents without the text and bucket, with the counts and log_perplexity."""
    names = [*COUNTS, "log_perplexity"]
    kept = others(dealt, text, bucket, *names)

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        grams, costs = flat("grams"), flat("costs")
        at = np.argsort(grams)
        grams, costs = grams[at], costs[at]
        values = [np.zeros(len(docs), np.int64) for _ in COUNTS] + [np.full(len(docs), np.nan)]
        first = 0
        for chunk in docs.column(text).chunks:
            for block in blocks(chunk):
                rows = slice(first + block.first, first + block.first + block.n)
                for value, found in zip(values, [*rule_counts(block), perplexity(grams, costs, block, order)], strict=True):
                    value[rows] = found
            first += len(chunk)
        arrays = [docs.column(c) for c in kept] + [pa.array(v) for v in values]
        return pa.Table.from_arrays(arrays, names=[*kept, *names])

    fields = [dealt.schema[c] for c in kept] + [StructField(c, LongType()) for c in COUNTS] + [StructField("log_perplexity", DoubleType())]
    return dealt.groupBy(quoted(bucket)).cogroup(priced.withColumnRenamed("bucket", bucket).groupBy(quoted(bucket))).applyInArrow(run, StructType(fields))


# -- the operator -----------------------------------------------------------------------


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = 5, width: float = 2.5, least_words: int = 10) -> DataFrame:
    """``docs`` without the text, with the counts, base_failed, log_perplexity and kept."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    bucket, of_lang, mid, reach, typical = fresh(docs, "bucket", "lang", "mid", "reach", "words")
    docs = docs.drop(*(c for c in docs.columns if c not in others(docs, *COUNTS, "base_failed", "log_perplexity", "kept")))
    size = docs.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    plain = [quoted(c) for c, kind in docs.dtypes if "<" not in kind and kind != "variant"]
    dealt = docs.withColumn(bucket, F.pmod(F.xxhash64(*plain), F.lit(size // BUCKET_BYTES + 1)))
    grams = scratch.save(bucket_grams(dealt, text, bucket, order), "grams")
    model = probabilities(scratch.save(count_grams(grams), "counts"), order, scratch)
    priced = scratch.save(priced_grams(grams, model), "priced")
    scratch.drop(*(name for name in list(scratch.paths) if name != "priced"))
    scored = score(dealt, priced, text, bucket, order)
    scored = scored.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    scored = scratch.save(scored, "scored")
    scratch.drop("priced")
    fine = scored.where("not base_failed").groupBy(quoted(lang).alias(of_lang))
    spread = fine.agg(F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000).alias("q"), F.percentile_approx("n_words", 0.5).alias(typical))
    spread = spread.select(of_lang, typical, F.col("q")[1].alias(mid), (width * (F.col("q")[2] - F.col("q")[0])).alias(reach))
    judged = scored.join(spread, quoted(lang).eqNullSafe(F.col(of_lang)), "left")
    wide = F.col(reach) * F.sqrt(F.greatest(F.lit(1.0), F.col(typical) / F.col("n_words")))
    inside = F.abs(F.col("log_perplexity") - F.col(mid)) <= wide
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(of_lang, typical, mid, reach)
