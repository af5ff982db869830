"""Classes and links of the line dedup, against brute force."""

import pytest

pytest.importorskip("basalt.llm")
from basalt.llm import line_dedup  # noqa: E402
from basalt.llm.queries import queries  # noqa: E402

from test_corpus_operators import LOW, WORD, corpus, frame  # noqa: E402


def near_copies(n=40):
    """One large group of lines that differ in one word, all linked with each other."""
    return [f"these ten words are in every line of this w{i}" for i in range(n)] + ["x y"] * 3


def brute(rows, least_words):
    """(id, line) to (token set, copies, linked classes, linked lines, gone)."""
    places = [(i, j, frozenset(WORD.findall(x.translate(LOW)))) for i, t in enumerate(rows) for j, x in enumerate((t or "").split("\n"))]
    places = [p for p in places if len(p[2]) >= max(least_words, 1)]
    copies, out, before = {}, {}, []
    for _, _, s in places:
        copies[s] = copies.get(s, 0) + 1
    near = {s: [o for o in copies if o != s and 100 * len(s & o) >= 80 * len(s | o)] for s in copies}
    for i, j, s in places:
        gone = any(o == s or o in near[s] for o in before)
        before.append(s)
        out[i, j] = (s, copies[s], len(near[s]), sum(copies[o] for o in near[s]), gone)
    return out


def listed(want):
    """Lines with a copy or a link."""
    return {k: w[1:] for k, w in want.items() if w[1] > 1 or w[2]}


def check_links(spark, rows, least_words, **options):
    want = brute(rows, least_words)
    got = {(r.id, r.line): r for r in line_dedup.line_classes(frame(spark, rows), least_words=least_words, **options).collect()}
    assert {k: (r.copies, r.linked_classes, r.linked_lines, r.gone) for k, r in got.items()} == listed(want)
    ids = {(want[k][0], r.class_id) for k, r in got.items()}
    assert len(ids) == len({s for s, _ in ids}) == len({c for _, c in ids})
    return want


def test_no_link_is_lost(spark):
    rows = corpus(2) + near_copies()
    want = check_links(spark, rows, 5)
    assert sum(w[2] == 39 for w in want.values()) == 40
    cleaned = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows), least_words=5).collect()}
    assert {(i, x.line): x.linked_lines for i, r in cleaned.items() for x in r.line_classes} == {k: w[2] for k, w in listed(want).items()}


def test_short_lines_are_compared(spark, tmp_path):
    """Lines of one to four words: equal sets match, and four words match five that hold them."""
    rows = corpus(3, 40) + near_copies(6) + ["a b c d", "a b c d e", "D c b a", "menu", "Menu", "by me\nby  me"]
    want = check_links(spark, rows, 1)
    assert want[len(rows) - 6, 0][1:] == (2, 1, 1, False) and want[len(rows) - 5, 0][4]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries()["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {i: sum(w[4] for (d, _), w in want.items() if d == i) for i in got}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(w[3] for (d, _), w in want.items() if d == i) for i in got}


def test_split_posting_lists(spark):
    """Lists of more than a few entries are split into fragments; no link is lost or counted twice."""
    check_links(spark, corpus(5, 30) + near_copies(60), 1, most_postings=7)


def test_long_lines_and_hash_swaps(spark):
    """A line of thousands of words is compared whole; Thue-Morse words, equal under a polynomial hash modulo 2^64, are not."""
    long = [f"w{i}" for i in range(3000)]
    swap = "ab"
    while len(swap) < 1024:
        swap += swap.translate(str.maketrans("ab", "ba"))
    rows = [" ".join(long), " ".join(long[:2400]), " ".join(long[:2399]), swap, swap.translate(str.maketrans("ab", "ba"))]
    want = check_links(spark, rows, 1)
    assert [want[i, 0][4] for i in range(5)] == [False, True, True, False, False] and want[2, 0][2] == 1
