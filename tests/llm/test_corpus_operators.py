"""Operators that compare documents, against brute force."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("basalt.llm")
from basalt.llm import decontaminate, line_dedup, near_dup  # noqa: E402
from basalt.llm.common import Scratch, components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, kept string, id long"


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "nu", "re"]) for _ in range(rng.randint(1, 4)))
    line = lambda k: " ".join(word() for _ in range(k))
    rows = []
    for _ in range(n):
        base = "\n".join(line(rng.randint(1, 25)) for _ in range(rng.randint(1, 8)))
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 6])):
            words = re.split(r"(\s)", base)
            for _ in range(rng.randint(0, 4)):
                words[2 * rng.randrange((len(words) + 1) // 2)] = word()
            rows.append("".join(words))
    rows += [rows[0]] * 30 + [None, "", "  ", "one", "ONE", "a b c", "A B C"]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", -i) for i, t in enumerate(rows)], SCHEMA)


def groups(n, linked):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = corpus()
    sets = []
    for t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = groups(len(rows), linked)
    got = {r.id: r for r in near_dup.near_duplicates(frame(spark, rows), k=k).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(rows))}
    kept = {r.doc_id for r in near_dup.drop_near_duplicates(frame(spark, rows), k=k).collect()}
    assert kept == {i for i in range(len(rows)) if want[i] == i}


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "", 1), (None, "a b c d e f", "", 1), (5, "a b c d e f", "", 1), (5, "a b c d e f", "", 1), (9, "a b c d e f", "", 1)], SCHEMA)
    rows = near_dup.near_duplicates(df).collect()
    assert sorted((r.id is None, r.component_id, r.kept) for r in rows if r.id) == [(False, 5, False), (False, 5, True), (False, 5, True)]
    assert [r.kept for r in rows if r.id is None] == [True, True]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_ids_of_several_texts_are_one_document(spark):
    a, b = "a b c d e f g h i j k l m n", "o p q r s t u v w x y z aa bb"
    rows = [(5, a), (5, b), (9, a + " more"), (10, b + " more"), (11, "z " + a), (12, None)]
    got = {(r.id, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5, True), (9, 5, False), (10, 5, False), (11, 5, False), (12, 12, True)}


def test_no_shared_shingle_no_link(spark):
    """Texts that a polynomial hash modulo 2^64 can't tell apart."""
    swap = "ab"
    while len(swap) < 1024:
        swap += swap.translate(str.maketrans("ab", "ba"))
    rows = [(1, swap), (2, swap.translate(str.maketrans("ab", "ba"))), (3, "x " * 3000), (4, "y " * 3000)]
    assert {r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2, 3, 4}


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f\nmenu", 1, 2, 3, 4), (2, "a b c d e f\nmenu", 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone int, ID int, __lines int, N_REMOVED int")
    assert [r["__gone"] for r in near_dup.drop_near_duplicates(df).collect()] == [1]
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [(r.text, r.n_removed, r.ID) for r in got] == [("a b c d e f\nmenu", 0, 2), ("", 2, 6)] and "N_REMOVED" not in got[0].asDict()


def test_components_of_chains(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300)] + [(1000, 1001 + i) for i in range(50)]
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100, **{1000 + i: 1000 for i in range(51)}}


def test_line_dedup(spark):
    rows = corpus(2)
    seen, want = [], []
    for t in rows:
        keep = []
        for x in (t or "").split("\n"):
            s = set(WORD.findall(x.translate(LOW)))
            if s:
                gone = any(100 * len(s & o) >= 80 * len(s | o) for o in seen)
                seen.append(s)
                if gone:
                    continue
            keep.append(x)
        want.append("\n".join(keep) if t is not None else None)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [got[i].text for i in range(len(rows))] == want
    assert sum(r.n_removed for r in got.values()) > 100
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_odd_rows(spark):
    line = "these five words are here"
    rows = [(None, line, "", 1), (7, line, "", 1), (7, line, "", 1), (8, f"{line}\n{line}", "", 1)]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, line), (7, ""), (7, ""), (8, "")]


def brute_leaks(docs, items):
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    has = lambda w, own: any(w[i : i + len(own)] == own for i in range(len(w) - len(own) + 1))
    spread = Counter(g for i in items for g in grams(tokens(i)))
    weight = lambda g: 8 if not spread[g] else max(1, 8 - (spread[g].bit_length() - 1))
    out = {}
    for d, text in enumerate(docs):
        w = tokens(text)
        for i, item in enumerate(items):
            want, size, best = grams(tokens(item)), len(tokens(item)), 0
            if 0 < size < 5 and has(w, tokens(item)):
                best = 1
            for s in range(max(1, len(w) - size + 1)) if want else ():
                own = grams(w[s : s + size])
                low = sum(weight(g) * min(own[g], want[g]) for g in own)
                best = max(best, low / (sum(weight(g) * c for g, c in own.items()) + sum(weight(g) * c for g, c in want.items()) - low))
            if best >= 0.8:
                out[d, i] = round(best, 6)
    return out


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    items = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(12)] + ["too short", None, ""]
    items.append(items[0] + " and more")
    docs = []
    for i in range(60):
        passage = rng.choice(items[:12]).split()
        for _ in range(i % 4):
            at = rng.randrange(len(passage))
            passage[at : at + 1] = rng.choice([[], [word()], [passage[at], word()]])
        docs.append(" ".join(word() for _ in range(rng.randint(0, 30))) + " " + ", ".join(passage).title() + ".\n" + " ".join(word() for _ in range(rng.randint(0, 30))))
    docs += [None, "", items[3], items[3], " ".join(word() for _ in range(50)), "this is Too  short.", "too long, short"]
    want = brute_leaks(docs, items)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = frame(spark, docs)
    rows = {r.doc_id: r for r in decontaminate.flag_leaks(df, bench).collect()}
    assert {d: r.item_ids for d, r in rows.items() if r.n_items} == {d: [i for e, i in sorted(want) if e == d] for d, _ in want}
    for d, r in rows.items():
        assert r.kept == (not r.n_items)
        assert round(r.similarity, 6) == max((s for (e, _), s in want.items() if e == d), default=0)
    kept = {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in want}
    assert decontaminate.flag_leaks(df, bench.limit(0)).where("not kept").count() == 0


def test_items_are_compared_whole(spark):
    """An item of thousands of words, of which documents have nine tenths or seven tenths, and passages near the threshold."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    long = [word() for _ in range(4700)]
    items = [" ".join(long)] + [" ".join(word() for _ in range(60)) for _ in range(6)]
    docs = [" ".join(long[:4300]), " ".join(long[:3300])]
    for i in range(40):  # three changed words take up to 15 of 56 shingles: from 0.6 to 0.9
        passage = items[1 + i % 6].split()
        for at in rng.sample(range(60), 1 + i % 3):
            passage[at] = word()
        docs.append(" ".join([word(), *passage, word()]))
    df, bench = frame(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: (r.n_items, round(r.similarity, 6)) for r in decontaminate.flag_leaks(df, bench).collect()}
    want = brute_leaks(docs[2:], items[1:])
    assert got[0][0] == 1 and 0.9 < got[0][1] < 0.93 and got[1] == (0, 0.0)
    assert {d: g for d, g in got.items() if d > 1 and g[0]} == {d + 2: (1, s) for (d, _), s in want.items()}
    assert 5 < len(want) < 40


def test_packed_fingerprints(spark):
    """The packed counters give the fingerprint that counting bit by bit gives."""
    from pyspark.sql import functions as F

    hashes = [[rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 30))] for rng in map(random.Random, range(20))]
    df = spark.createDataFrame(list(enumerate(hashes)), "k long, sh array<long>")
    weights = spark.createDataFrame([(hashes[0][0], 3)], "sh long, weight int")
    got = {r.k: r.fp for r in decontaminate.fingerprints(df, "k", F.broadcast(weights)).collect()}
    assert got == {r.k: r.fp for r in decontaminate.fingerprints(df, "k", F.broadcast(weights), 32).collect()}
    for k, own in enumerate(hashes):
        w = [decontaminate.COUNTED[2 if h == hashes[0][0] else 7] for h in own]
        bits = sum(1 << b for b in range(64) if 2 * sum(x for h, x in zip(own, w, strict=True) if (h >> b) & 1) > sum(w))
        assert got[k] % (1 << 64) == bits


def test_pipeline(spark):
    cp = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    rows = cp.run(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert 0 < len(rows) < len(docs) and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert r.round_trip and r.n_ids == len(r.ids) and r.n_chars == len(r.text)
        left = docs[r.doc_id].text.split("\n")
        for line in r.text.split("\n"):  # what stays are lines of the document, in their order
            left = left[left.index(line) + 1 :]
