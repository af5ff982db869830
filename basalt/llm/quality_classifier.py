"""Quality classifier: similarity-weighted votes of the nearest labelled documents.

Labelled documents are turned into latent-semantic vectors (a truncated
singular value decomposition of hashed byte-trigram tf-idf).  At most
``max_labelled`` labelled rows are fitted (a documented bound; half for each
label, chosen by a hash of their text), so vectors and projection have a fixed size and are broadcast.
Every document's exact cosines with all labelled vectors are computed in blocks;
its ``k`` nearest vote with their similarity as weight.

Labelled documents of the same text are none of a document's neighbours, so a
label is no input of its own document's score.  Ids only tie labels to texts:
documents with other ids get the same scores.

Defined results: null counts as an empty text; a text without trigrams, or whose
neighbours all have a similarity of zero, gets the mean label as its score;
documents are scored one by one and whole, however long, so ties, repeated rows,
null ids and empty tables need no care; without any labelled row every score is
0.5.  Of labels that repeat an id the smallest counts, of texts that do the one
that sorts first; null labels and ids are left out.  Other columns pass through
and columns named like a result, in whatever case, are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, lists, map_blocks, quoted, text_udf, with_fields

DIM = 4096


def trigram_counts(block: Block) -> np.ndarray:
    """Counts of each document's byte trigrams, hashed to ``DIM`` features."""
    low = block.data.astype(np.uint32)
    if len(low) < 3:
        return np.zeros((block.n, DIM), np.float32)
    gram = ((low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]) * np.uint32(0x9E3779B1)
    at = np.arange(len(gram))
    doc = np.searchsorted(block.offs, at, "right") - 1
    inside = at + 3 <= block.offs[doc + 1]
    feature = (gram >> np.uint32(20)).astype(np.int64)
    return np.bincount((doc * DIM + feature)[inside], minlength=block.n * DIM).reshape(block.n, DIM).astype(np.float32)


@dataclass
class Neighbours:
    idf: np.ndarray  # DIM
    basis: np.ndarray  # DIM x rank
    vectors: np.ndarray  # labelled x rank, of length 1
    labels: np.ndarray
    k: int
    texts: np.ndarray | None = None  # hashes of the labelled texts, sorted

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(np.log1p(counts) * self.idf) @ self.basis)

    def score(self, counts: np.ndarray, texts: np.ndarray | None = None) -> np.ndarray:
        """Weighted share of label 1 among each row's nearest labelled vectors; those of its own text (by its hash in ``texts``) are left out."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.embed(counts) @ self.vectors.T
        if texts is not None and self.texts is not None:
            low, high = (np.searchsorted(self.texts, texts, side) for side in ("left", "right"))
            row = np.repeat(np.arange(len(texts)), high - low)
            cosine[row, np.arange(len(row)) - np.repeat(np.cumsum(high - low) - high, high - low)] = -np.inf
        k = min(self.k, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0)
        total = weight.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = (weight * self.labels[near]).sum(1) / total
        return np.clip(np.where(total > 1e-6, score, self.labels.mean()), 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(counts: np.ndarray, labels: np.ndarray, k: int = 15, rank: int = 48, seed: int = 7) -> Neighbours:
    """Randomised truncated SVD (Halko et al.) of the labelled tf-idf rows."""
    n = len(labels)
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = unit(np.log1p(counts) * idf)
    rank = max(1, min(rank, n, DIM))
    y = x @ np.random.default_rng(seed).standard_normal((DIM, min(rank + 16, DIM))).astype(np.float32)
    for _ in range(2):
        y, _ = np.linalg.qr(x @ (x.T @ y))
    basis = np.linalg.svd(y.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32) if n else np.zeros((DIM, rank), np.float32)
    return Neighbours(idf, basis, unit(x @ basis).astype(np.float32), labels.astype(np.float32), k)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_labelled: int = 2000, **options) -> Neighbours:
    """Fit on ``labels`` (key, label); rows that must not be learnt from are left out by the caller."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(label).cast("double").alias("__label"))
    own = F.coalesce(quoted(text), F.lit(""))
    of_key = docs.select(quoted(key).alias("__key"), F.struct(own.alias("t"), F.xxhash64(own).alias("h")).alias("__text"))
    known = of_key.select("__key", F.col("__text.h").alias("__h")).join(chosen, "__key")
    drawn = [known.where(of).orderBy("__h", "__key").limit(max_labelled // 2) for of in ("__label < 0.5", "__label >= 0.5")]
    rows = of_key.join(F.broadcast(drawn[0].unionByName(drawn[1]).select("__key", "__label").distinct()), "__key")
    rows = rows.groupBy("__key", "__label").agg(F.min("__text").alias("__own")).select("__label", "__own.*")  # at most max_labelled rows, however often ids repeat

    def make():
        def work(block: Block, table: pa.Table) -> list:
            counts = np.concatenate([trigram_counts(b) for b in _few(block)])
            row, feature = np.nonzero(counts)
            bounds = np.searchsorted(row, np.arange(block.n + 1))
            return [table.column("h"), table.column("__label"), lists(feature, bounds, pa.int32()), lists(counts[row, feature].astype(np.int32), bounds, pa.int32())]

        return work

    got = map_blocks(rows, "t", make, "h long, label double, feature array<int>, n array<int>").toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    counts = np.zeros((got.num_rows, DIM), np.float32)
    for i, (f, n) in enumerate(zip(got.column("feature"), got.column("n"), strict=True)):
        counts[i, np.asarray(f.values)] = np.asarray(n.values)
    model = fit(counts, got.column("label").to_numpy(), **options)
    model.texts = got.column("h").to_numpy()
    return model


def _few(block: Block, most: int = 256):
    """Smaller blocks of at most so many documents, for dense matrices."""
    for i in range(0, block.n, most):
        offs = block.offs[i : i + most + 1]
        yield Block(block.data[offs[0] : offs[-1]], offs - offs[0], block.first + i)


def score_quality(docs: DataFrame, model: Neighbours, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(block: Block, _, texts: pa.Array) -> list:
            texts = texts.to_numpy()
            score = np.concatenate([model.score(trigram_counts(b), texts[b.first - block.first :][: b.n]) for b in _few(block)]).astype(np.float64)
            return [score, (score >= threshold).astype(np.int32)]

        return work

    return with_fields(docs, text_udf(make, "score double, predicted int")(quoted(text), F.xxhash64(F.coalesce(quoted(text), F.lit("")))), ["score", "predicted"])
