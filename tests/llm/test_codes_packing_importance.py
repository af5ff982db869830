"""Vector codes, best-fit packing and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("basalt.llm")
from basalt.llm import importance, packing, vector_codes  # noqa: E402
from basalt.llm.common import blocks  # noqa: E402
from basalt.llm.queries import CHAT_TOKENIZER, queries  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

CLASHES = ", length int, RANK int, `Error` int, code int, row int, id int, `__group` int"


# -- vector codes -----------------------------------------------------------------------


def lloyd(vectors, parts=4, entries=256, rounds=4):
    """Plain rounds over all points and entries."""
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64).reshape(len(vectors), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    near = lambda: np.stack([((x[:, p][:, None] - b[None]) ** 2).sum(2).argmin(1) for p, b in enumerate(books)], 1)
    for _ in range(rounds):
        code = near()
        for p, b in enumerate(books):
            for e in range(len(b)):
                own = x[code[:, p] == e, p]
                if len(own):
                    b[e] = own.sum(0) // len(own)
    code = near()
    return code, sum(((x[:, p] - b[code[:, p]]) ** 2).sum(1) for p, b in enumerate(books)), books


def clustered(n, seed=0, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return np.round(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * rng.choice([0.01, 0.3], (n, 1)), 3)


def test_trees_hold_all_points_inside_their_balls():
    for points in (clustered(1500), np.zeros((300, 4)), np.arange(700.0).repeat(2).reshape(-1, 2)):
        points = np.floor(1024 * points).astype(np.int64)
        tree = vector_codes.Tree.unpack(vector_codes.build(points, leaf=20).pack())
        assert sorted(tree.order) == list(range(len(points)))
        for i in range(len(tree.first)):
            own = points[tree.order[tree.first[i] : tree.last[i]]]
            assert (tree.total[i] == own.sum(0)).all()
            assert np.sqrt(((own - tree.centre[i]) ** 2).sum(1)).max() <= tree.radius[i]
            if tree.left[i] >= 0:
                left, right = tree.left[i], tree.right[i]
                assert (tree.first[left], tree.last[left], tree.last[right]) == (tree.first[i], tree.first[right], tree.last[i])


def test_balls_are_owned_and_sums_are_exact():
    points = np.floor(1024 * clustered(3000)).astype(np.int64)
    entries = points[[*range(60), 3, 3, 7]]  # equal entries among them
    code, n, sums = vector_codes.walk(vector_codes.build(points, leaf=16), points, entries)
    plain = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    alone = code >= 0
    assert (code[alone] == plain[alone]).all() and alone.mean() < 0.9
    assert (n + np.bincount(code[alone], minlength=63) == np.bincount(plain, minlength=63)).all()
    np.add.at(sums, code[alone], points[alone])
    whole = np.zeros_like(sums)
    np.add.at(whole, plain, points)
    assert (sums == whole).all()
    assert (vector_codes.walk(vector_codes.build(points), points, entries, cached=False)[0] == plain).all()


@pytest.mark.parametrize("parts", [1, 7])
def test_codes_equal_plain_lloyd_rounds(spark, parts, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_VALUES", 2000)
    x = clustered(900, 1)
    x[200:500] = x[0]  # a third of all rows are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts), entries=32)
    code, error, plain = lloyd(x, entries=32)
    got = {r.vec_id: r for r in coded.collect()}
    assert all((a == b).all() for a, b in zip(books.entries, plain, strict=True))
    assert all(got[i].code == code[i].tolist() and got[i].error == error[i] for i in range(len(x)))


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (5, [1.0, 2.0, 3.0, 4.0], 1), (1, [0.0, -0.0005, 9.0, 9.0], None), (None, [1.0, 2.0, 3.0, 5.0], None), (7, None, 1), (8, [1.0, None, 1.0, 1.0], 1), (9, [nan, 1.0, 1.0, 1.0], 2), (3, [1.0, inf, 1.0, 1.0], 2)]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int" + CLASHES)
    coded, books = vector_codes.compress(df, keep=("label",))
    assert coded.columns == ["vec_id", "label", "code", "error"]
    got = sorted(((r.vec_id or 0, r.code, r.error) for r in coded.collect()), key=str)
    # The row without a key is coded and starts no entry; floors go down.
    code, error, plain = lloyd([rows[2][1], rows[0][1], rows[1][1], rows[3][1]], entries=3)
    assert all((a == b).all() for a, b in zip(books.entries, plain, strict=True)) and books.entries[1][0, 0] == -1
    assert got == sorted(((k, c.tolist(), e) for k, c, e in zip((1, 5, 5, 0), code, error, strict=True)), key=str)
    summed = vector_codes.with_group_sum(coded, "label", "error", "label_error").collect()
    for label in (1, None):
        assert {r.label_error for r in summed if r.label == label} == {sum(r.error for r in summed if r.label == label)}
    none, empty = vector_codes.compress(df.where("vec_id = 7"), keep=("label",))
    assert none.count() == 0 and none.columns == coded.columns and empty.text() == ""
    with pytest.raises(Exception, match="different lengths|equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 4), (2, [1.0] * 8)], "vec_id long, embedding array<double>"))[0].collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 6)], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"))[0].collect()


# -- packing ----------------------------------------------------------------------------

LETTERS = ["a", "b", " ", "  ", "\n", " \n", " ", "　", "é", "’", "'s", "1", "<|endoftext|>", "\t", "\x1c", " ", "x", "...", "日本", "\x85", "😀", "word"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(CHAT_TOKENIZER)


@pytest.mark.parametrize("limit", [40, 1 << 18])
def test_ids_equal_the_tokenizers(tokenizer, limit):
    rng = np.random.default_rng(3)
    texts = [None, *("".join(rng.choice(LETTERS, rng.integers(0, 30))) for _ in range(4000))]
    with open(CHAT_TOKENIZER, "rb") as f:
        encoder = packing.Encoder(f.read(), 2)
    for block in blocks(pa.array(texts), limit):
        ids, bounds = encoder.encode(block)
        told = tokenizer.encode_batch([t or "" for t in texts[block.first : block.first + block.n]], add_special_tokens=False)
        for i, t in enumerate(told):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*t.ids, 2], texts[block.first + i]


def one_by_one(lengths, capacity, rule, weights):
    """Number of sequences and their contents when pieces are placed one after another."""
    scale = np.array(weights) / np.square(np.array(capacity, float))
    bins, rest = [], np.zeros((0, 3), np.int64)
    for n in sorted(lengths, reverse=True):
        item = packing.demand(n)
        fit = np.flatnonzero((rest >= item).all(1))
        if len(fit):
            cost = np.square(rest[fit] - item) @ scale if rule == "norm" else (rest[fit] * item) @ scale
            j = fit[cost.argmin()]
        else:
            bins.append([])
            rest, j = np.vstack([rest, np.array(capacity)]), len(bins) - 1
        bins[j].append(n)
        rest[j] -= item
    return sorted(map(tuple, bins))


@pytest.mark.parametrize(("rule", "weights"), [("norm", (1, 0, 0)), ("norm", (1, 0.3, 0.5)), ("dot", (1, 0.2, 0.4))])
@pytest.mark.parametrize("capacity", [(100, 100, 10_000), (100, 4, 10_000), (100, 9, 4_900)])
def test_best_fit_by_classes_equals_one_by_one(rule, weights, capacity):
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(1, 71, 400), np.full(200, 7), np.full(150, 33), np.full(90, 50)]).tolist()
    counts = Counter(lengths)
    placed = packing.best_fit(counts, capacity, rule, weights)
    order = np.array(sorted(lengths, reverse=True))
    sequence, offset = placed(np.arange(len(order)))
    bins = [order[sequence == s] for s in range(placed.n_sequences)]
    for s, own in enumerate(bins):
        assert len(own) and own.sum() <= capacity[0] and len(own) <= capacity[1] and (own**2).sum() <= capacity[2]
        assert sorted(offset[sequence == s]) == np.concatenate([[0], np.cumsum(own[np.argsort(offset[sequence == s])])[:-1]]).tolist()
    plain = one_by_one(lengths, capacity, rule, weights)
    if weights == (1, 0, 0) and capacity == (100, 100, 10_000):  # tokens alone decide
        assert sorted(b.sum() for b in bins) == sorted(map(sum, plain))
    # Else ties between unlike sequences of equal cost may go another way, with hardly another number of them.
    assert abs(len(bins) - len(plain)) <= 1
    with pytest.raises(ValueError, match="no sequence"):
        packing.best_fit({90: 1}, (100, 5, 8_000))


@pytest.mark.parametrize("parts", [1, 5])
def test_packed_sequences_read_back(spark, tokenizer, parts):
    rng = np.random.default_rng(7)
    texts = {i: " ".join(rng.choice(["alpha", "Beta", "ß", "gamma\n", "1"], rng.integers(0, 200))) for i in range(150)}
    texts |= {200: None, 201: "", 202: "long " * 5000}
    rows = [*texts.items(), (None, "no key"), (3, texts[3])]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0, 0) for r in rows], "doc_id long, text string" + CLASHES).repartition(parts)
    out = packing.pack(df, CHAT_TOKENIZER, tokens=128, with_ids=True)
    pieces = out.collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    assert Counter(p.doc_id for p in pieces) == Counter(i for i, t in rows for _ in range(-(-len(ids[i]) // 128)))
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids == own and len(own) == p.length and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        assert (p.length == 128 or p.piece == 0) and p.start == (0 if not p.piece else (len(ids[p.doc_id]) - 1) % 128 + 1 + (p.piece - 1) * 128)
    whole = packing.sequences(out).collect()
    assert sum(len(s.ids) for s in whole) == sum(p.length for p in pieces)
    lower = -(-sum(p.length for p in pieces) // 128)
    assert lower <= len(whole) <= lower * 1.02 + 1
    for s in whole:
        at = 0
        for d in s.documents:
            assert d.offset == at and s.ids[at : at + d.length] == next(p.ids for p in pieces if (p.doc_id, p.piece) == (d.key, d.piece))
            at += d.length
        assert at == len(s.ids) <= 128
    assert packing.pack(df.limit(0), CHAT_TOKENIZER).count() == 0
    few = packing.pack(df, CHAT_TOKENIZER, tokens=128, documents=2, rule="dot").groupBy("sequence_id").count()
    assert few.where("count > 2").count() == 0


# -- importance -------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        f, n = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("limit", [30, 1 << 18])
def test_features_and_weights(limit):
    rng = np.random.default_rng(11)
    texts = [None, "", "...", *("".join(rng.choice(["a", "B", " ", "-", "é", "1", "xyz", "ÄÖ", "y" * 70, "z" * 63, "日本", "\n", "w" * 300], rng.integers(0, 25))) for _ in range(1500)), "very often " * 3000]
    gain = rng.integers(-30000, 30000, importance.BUCKETS)
    sliced = importance.gain_planes(gain)
    for block in blocks(pa.array(texts), limit):
        bucket, doc, many = importance.features(block)
        weight = importance.weights(bucket, doc, block.n, *sliced)
        for i in range(block.n):
            f, n = features(texts[block.first + i])
            assert sorted(f) == sorted(bucket[doc == i].tolist()) and n == many[i] and weight[i] == sum(gain[f])


@pytest.mark.parametrize("parts", [1, 6])
def test_resampling_equals_brute_force(spark, parts):
    rng = np.random.default_rng(13)
    some = ["alpha", "beta", "GAMMA", "delta", "9", "straße"]
    docs = [(i, " ".join(rng.choice(some, rng.integers(0, 60)))) for i in range(400)]
    docs += [(1000 + i, "one text that a third of all documents share " * 4) for i in range(200)] + [(5, docs[5][1]), (None, "no key " * 20), (2000, None), (2001, ""), (2002, "alpha beta " * 20000)]
    target = ["alpha beta gamma " * 5, None, "straße 9"]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0, 0) for r in docs], "doc_id long, text string" + CLASHES).repartition(parts)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    told = brute(docs, target)
    fit = sorted((r for r in told if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = fit[: 30 * len(fit) // 100]
    rows = got.collect()
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, told))
    assert [tuple(r)[:5] for r in sorted((r for r in rows if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, len(drawn) + 1))
    assert importance.resample(df.limit(0), df.limit(0)).count() == 0


def test_queries_over_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    packed = queries()["op12_best_fit_packing"](spark, d)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.select("doc_id").distinct().count() == n
    drawn = queries()["op13_importance_resampling"](spark, d).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    told = brute(docs, [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()])
    assert sorted(tuple(r)[:4] for r in drawn) == sorted((i, f, w, s) for i, _, f, w, s in told)
    coded = queries()["op11_vector_codes"](spark, d).collect()
    vectors = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect())
    code, error, books = lloyd([v for _, v in vectors])
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    assert {(r.vec_id, r.code, r.error, r.codebooks_sha256) for r in coded} == {(vectors[i][0], bytes(code[i].tolist()).hex(), int(error[i]), digest) for i in range(len(vectors))}
