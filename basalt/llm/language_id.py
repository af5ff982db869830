"""Language identification by a byte convolutional network.

Texts are cut into windows of ``WINDOW`` bytes (the last one padded); the whole
text is covered.  Filters of several widths over byte embeddings, rectified and
max-pooled over a window, feed a softmax layer.  Training is plain numpy on the
windows of about ``per_lang`` labelled documents of each language, drawn by a hash
of their id (a documented bound: ``max_rows`` documents and ``max_windows`` windows in
all; of a document with more than its part, windows evenly spread over its whole
length).  They are cut on the executors.  A text's prediction is the mean of
its windows' probabilities, weighted by their bytes.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
documents are judged one by one and whole, however long, so ties, repeated rows,
null ids and empty tables need no care; without any labelled row everything is
``und``.  Other columns pass through and columns named like a result, in whatever
case, are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, map_blocks, quoted, text_udf, with_fields

WINDOW, WIDTHS, EMBED, FILTERS = 64, (2, 3, 4), 8, 16
#: A softmax over more languages than this is refused.
MOST_LANGS = 10_000


@dataclass
class ByteConv:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # for each width: width*EMBED x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # features x languages
    out_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Filters as look-up tables: for each width the response to byte pairs, and to what follows."""
        made = []
        for width, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            single = [self.embed @ f[j * EMBED : (j + 1) * EMBED] for j in range(width)]
            pair = (single[0][:, None, :] + single[1][None, :, :] + b).reshape(65536, -1).astype(np.float32)
            rest = None if width == 2 else single[2].astype(np.float32) if width == 3 else (single[2][:, None, :] + single[3][None, :, :]).reshape(65536, -1).astype(np.float32)
            made.append((pair, rest))
        return made

    def features(self, windows: np.ndarray, tables: list) -> np.ndarray:
        pairs = (windows[:, :-1].astype(np.uint16) << 8) | windows[:, 1:]
        pooled = []
        for width, (pair, rest) in zip(WIDTHS, tables, strict=True):
            n = WINDOW - width + 1
            r = pair[pairs[:, :n]]
            if rest is not None:
                r += rest[windows[:, 2 : 2 + n] if width == 3 else pairs[:, 2 : 2 + n]]
            pooled.append(r.max(1))
        return np.maximum(np.concatenate(pooled, 1), 0)

    def probs(self, windows: np.ndarray, tables: list) -> np.ndarray:
        z = self.features(windows, tables) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def cut(raw: np.ndarray) -> np.ndarray:
    """All windows of a document's bytes; the last one is padded with spaces."""
    n = -(-len(raw) // WINDOW)
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WINDOW)


def spread_windows(raw: np.ndarray, most: int) -> np.ndarray:
    """All windows of a document, or ``most`` of them, evenly spread over its whole length."""
    windows = cut(raw)
    return windows if len(windows) <= most else windows[np.arange(most) * len(windows) // most]


def fit(texts: list[str | bytes], langs: list[str], epochs: int = 3, seed: int = 5) -> ByteConv:
    """Adam on softmax cross-entropy, over all windows of every labelled text; each language weighs the same."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    number = {n: i for i, n in enumerate(names)}
    x, y = [], []
    for text, lang in zip(texts, langs, strict=True):
        windows = cut(np.frombuffer(text if isinstance(text, bytes) else text.encode(), np.uint8))
        x.append(windows)
        y += [number[lang]] * len(windows)
    model = ByteConv(names, rng.normal(0, 0.3, (256, EMBED)), [rng.normal(0, (k * EMBED) ** -0.5, (k * EMBED, FILTERS)) for k in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], np.zeros((FILTERS * len(WIDTHS), len(names))), np.zeros(len(names)))
    if not names or not y:
        return model
    x, y = np.concatenate(x), np.array(y)
    w = len(y) / len(names) / np.bincount(y, minlength=len(names)).clip(1)[y]
    params = [model.embed, *model.filters, *model.bias, model.out, model.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            step += 1
            for p, g, a, b in zip(params, _gradients(model, x[own], y[own], w[own]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


def _gradients(model: ByteConv, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    n, e = len(x), model.embed[x]  # n x WINDOW x EMBED
    columns, hits, pooled = [], [], []
    for k, f, b in zip(WIDTHS, model.filters, model.bias, strict=True):
        c = np.concatenate([e[:, j : WINDOW - k + 1 + j] for j in range(k)], 2)
        r = c @ f + b
        hit = r.argmax(1)
        columns.append(c)
        hits.append(hit)
        pooled.append(np.take_along_axis(r, hit[:, None], 1)[:, 0])
    raw = np.concatenate(pooled, 1)
    act = np.maximum(raw, 0)
    z = act @ model.out + model.out_bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(n), y] -= 1
    p *= w[:, None] / n
    back = (p @ model.out.T) * (raw > 0)
    embed, filters, bias = np.zeros_like(model.embed), [], []
    for i, k in enumerate(WIDTHS):
        g, hit = back[:, i * FILTERS : (i + 1) * FILTERS], hits[i]
        own = np.take_along_axis(columns[i], hit[:, :, None], 1)  # n x FILTERS x k*EMBED
        filters.append(np.einsum("nfd,nf->df", own, g))
        bias.append(g.sum(0))
        into = g[:, :, None] * model.filters[i].T[None]
        for j in range(k):
            np.add.at(embed, np.take_along_axis(x, hit + j, 1), into[:, :, j * EMBED : (j + 1) * EMBED])
    return [embed, *filters, *bias, act.T @ p, p.sum(0)]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 100, max_rows: int = 20_000, max_windows: int = 1 << 19, **options) -> ByteConv:
    """Fit on about ``per_lang`` rows of each language and at most ``max_rows`` in all, drawn by a hash of their id, with at most about ``max_windows`` windows."""
    rows = docs.select(quoted(lang).alias("lang"), quoted(text).alias("text"), F.pmod(F.xxhash64(quoted(key), F.lit(11)), F.lit(1 << 30)).alias("draw"))
    rows = rows.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    shares = docs.sparkSession.createDataFrame([(r[0], int(per_lang / r[1] * (1 << 30))) for r in sizes], "lang string, most long")
    most = max(1, max_windows // max(1, min(max_rows, sum(min(per_lang, r[1]) for r in sizes))))

    def make():
        def work(block: Block, table: pa.Table) -> list:
            windows = [spread_windows(block.data[block.offs[i] : block.offs[i + 1]], most).tobytes() for i in range(block.n)]
            return [table.column("draw"), table.column("lang"), windows]

        return work

    drawn = rows.join(F.broadcast(shares), "lang").where("draw < most").select("draw", "lang", "text")
    got = map_blocks(drawn, "text", make, "draw long, lang string, windows binary").orderBy("draw", "lang", "windows").limit(max_rows).toArrow()
    return fit(got.column("windows").to_pylist(), got.column("lang").to_pylist(), **options)


def identify(docs: DataFrame, model: ByteConv, text: str = "text", at_once: int = 2048) -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        tables = model.tables()

        def work(block: Block, texts: pa.Array) -> list:
            lang, score = ["und"] * block.n, np.zeros(block.n)
            letters = [i for i, t in enumerate(texts) if model.langs and (s := t.as_py()) and any(map(str.isalpha, s))]
            if not letters:
                return [lang, score]
            cuts = [cut(block.data[block.offs[i] : block.offs[i + 1]]) for i in letters]
            windows, owner = np.concatenate(cuts), np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            used = np.full(len(windows), float(WINDOW))
            used[np.cumsum([len(c) for c in cuts]) - 1] = [(block.offs[i + 1] - block.offs[i] - 1) % WINDOW + 1 for i in letters]
            probs = np.concatenate([model.probs(windows[i : i + at_once], tables) for i in range(0, len(windows), at_once)])
            bounds = np.searchsorted(owner, np.arange(len(cuts)))
            mean = np.add.reduceat(probs * used[:, None], bounds, 0) / np.add.reduceat(used, bounds)[:, None]
            for i, p in zip(letters, mean, strict=True):
                lang[i], score[i] = model.langs[int(p.argmax())], min(float(p.max()), 1.0)
            return [lang, score]

        return work

    return with_fields(docs, text_udf(make, "lang_pred string, score double")(text), ["lang_pred", "score"])
