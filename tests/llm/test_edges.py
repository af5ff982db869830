"""Odd rows under every operator, and brute-force versions of verdicts that other tests don't cover."""

import math

import numpy as np
import pytest

pytest.importorskip("basalt.llm")
from basalt.llm import chat, decontaminate, language_id, line_dedup, near_dup, quality_classifier, quality_rules, secrets, sentencepiece_viterbi, url_filter  # noqa: E402
from basalt.llm.common import spans_hash  # noqa: E402
from basalt.llm.queries import CHAT_TOKENIZER, PIECE_MODEL, URL_RULES, queries  # noqa: E402

from test_corpus_operators import LOW, WORD, brute_leaks, groups  # noqa: E402

LONG = " ".join(f"word{i % 5000}" for i in range(60_000)) + "\nan end"
ITEM = "seven words that stand in a benchmark item"
ROWS = [(1, None), (2, ""), (3, LONG), (4, "the same text twice over here\nmenu"), (4, "the same text twice over here\nmenu"), (None, "no id password=abcdef123"), (5, f"before {ITEM} after"), (6, "▁½ ²"), (7, " \n\t\n ")]
#: Names of results and of helpers, in other cases too.
CLASHES = ["KEPT", "Score", "PREDICTED", "kinds", "Starts", "N_words", "base_Failed", "log_perplexity", "n_items", "ITEM_IDS", "Similarity", "lang_pred", "N_lines", "n_removed", "Line_Classes", "IDS", "Host", "path", "RULE", "verdict", "__made", "__gone", "__row", "__lines", "__id", "__h", "__bucket", "__lang", "id", "h", "n", "row"]


def frame(spark, rows=ROWS):
    data = [(i, t, "xy" if i != 5 else None, *range(len(CLASHES))) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in CLASHES))


def neighbours(df):
    labels = df.sparkSession.createDataFrame([(4, 1), (5, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    return quality_classifier.train(df, labels)


OPERATORS = {
    "secrets": (lambda df: secrets.scan_secrets(df), ["kinds", "starts", "ends"]),
    "quality_rules": (lambda df: quality_rules.judge_quality(df), [*quality_rules.COUNTS, "base_failed", "log_perplexity", "kept", "text"]),
    "classifier": (lambda df: quality_classifier.score_quality(df, neighbours(df)), ["score", "predicted"]),
    "decontaminate": (lambda df: decontaminate.flag_leaks(df, df.sparkSession.createDataFrame([(9, ITEM)], "item_id long, text string")), ["n_items", "item_ids", "similarity", "kept", "text"]),
    "language": (lambda df: language_id.identify(df, language_id.train(df)), ["lang_pred", "score"]),
    "line_dedup": (lambda df: line_dedup.dedup_lines(df), ["n_lines", "n_removed", "line_classes"]),
    "sentencepiece": (lambda df: sentencepiece_viterbi.encode(df, PIECE_MODEL), ["ids"]),
    "urls": (lambda df: url_filter.filter_urls(df, URL_RULES, "text"), ["host", "path", "rule", "verdict"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    run, made = OPERATORS[name]
    df = frame(spark)
    out = run(df)
    gone = {c.lower() for c in made}
    assert [c.lower() for c in out.columns].count("kept") == 1 and len({c.lower() for c in out.columns}) == len(out.columns)
    kept = [c for c in df.columns if c.lower() not in gone]
    assert [c for c in out.columns if c in kept] == kept  # other columns pass through
    rows = out.collect()
    assert sorted((r.doc_id or 0, r["__made"]) for r in rows) == sorted((i or 0, CLASHES.index("__made")) for i, _ in ROWS)
    by_id = {r.doc_id: r for r in rows}
    expected = {
        "secrets": lambda: by_id[None].kinds == ["assign"] and by_id[1].kinds == by_id[3].kinds == [],
        "quality_rules": lambda: by_id[1].base_failed and by_id[3].n_words == 60_002 and by_id[3].n_repeat_words == 60_000,
        "classifier": lambda: all(0 <= r.score <= 1 for r in rows),
        "decontaminate": lambda: [r.doc_id for r in rows if not r.kept] == [5],
        "language": lambda: by_id[1].lang_pred == by_id[6].lang_pred == by_id[7].lang_pred == "und" and by_id[4].lang_pred == "xy",
        "line_dedup": lambda: sorted((r.doc_id or 0, r.n_removed) for r in rows if r.n_removed) == [] and by_id[1].text is None,
        "sentencepiece": lambda: by_id[1].ids == [] and len(by_id[3].ids) > 60_000,
        "urls": lambda: by_id[1].host == "" and by_id[1].verdict == "allow",
    }[name]
    assert expected()
    assert run(df.limit(0)).count() == 0


def test_odd_rows_of_filters(spark):
    df = frame(spark)
    ids = lambda out: sorted(r.doc_id or 0 for r in out.collect())
    assert ids(near_dup.drop_near_duplicates(df)) == [0, 1, 2, 3, 4, 4, 5, 6, 7]
    bench = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    assert ids(decontaminate.drop_leaks(df, bench)) == [0, 1, 2, 3, 4, 4, 6, 7]
    assert near_dup.drop_near_duplicates(df.limit(0)).count() == decontaminate.drop_leaks(df.limit(0), bench).count() == 0
    assert ids(decontaminate.drop_leaks(df, bench.limit(0))) == ids(df)


def test_round_trip_of_marks(spark):
    texts = ["a▁b", "▁", "▁▁ x ▁", " ▁a", "é▁\n▁", LONG[:5000] + "▁"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(df, PIECE_MODEL), PIECE_MODEL).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == texts
    both = sentencepiece_viterbi.encode_decode(df, PIECE_MODEL).orderBy("doc_id").collect()
    assert [(r.ids, r.decoded) for r in both] == [(r.ids, r.decoded) for r in got]


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", LONG), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, "a", "b"), (None, 0, "a", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = chat.digest(chat.format_chats(df, CHAT_TOKENIZER)).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in got) == [(0, 1), (0, 1), (1, 2), (2, 2)]
    assert chat.format_chats(df.limit(0), CHAT_TOKENIZER).count() == 0


def test_span_hash_of_long_words():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    starts, ends = np.array([0, 0, 5, 1000, 1000, 2990]), np.array([3, 8, 14, 1257, 1256, 2999])
    whole = spans_hash(data, starts, ends)
    assert len(set(whole.tolist())) == 6
    for s, e, h in zip(starts, ends, whole, strict=True):  # where a span stands doesn't matter
        assert spans_hash(np.concatenate([data[:7], data[s:e]]), np.array([7]), np.array([7 + e - s]))[0] == h


def test_perplexity_verdict(spark):
    """Bands by language from the perplexities that the operator gives, which another test checks."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcde"), rng.integers(2, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(5, 60))) for _ in range(150)]
    texts += [" ".join("".join(rng.choice(list("fghijklmnopqrstuvwxyz0123456789"), 7)) for _ in range(40)) for _ in range(3)]
    langs = ["p", "q", None]
    df = spark.createDataFrame([(i, t, langs[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = quality_rules.judge_quality(df).collect()
    at = lambda values, p: sorted(values)[max(math.ceil(p * len(values)) - 1, 0)]
    bands = {}
    for lang in langs:
        fine = [r for r in rows if r.lang == lang and not r.base_failed]
        q = [at([r.log_perplexity for r in fine], p) for p in (0.25, 0.5, 0.75)]
        bands[lang] = (q[1], 2.5 * (q[2] - q[0]), at([r.n_words for r in fine], 0.5))
    for r in rows:
        mid, reach, size = bands[r.lang]
        inside = r.n_words and abs(r.log_perplexity - mid) <= reach * max(1, size / r.n_words) ** 0.5
        assert r.kept == (not r.base_failed and bool(inside))
    assert any(not r.kept and not r.base_failed for r in rows)


def test_language_of_windows(spark):
    """The mean of the windows' probabilities, weighted by their bytes."""
    df = spark.createDataFrame([(i, w * (i % 9 + 1), w[:2]) for i, w in enumerate(["aa bab ab aba ", "xyz zyx yz "] * 20)], "doc_id long, text string, lang string")
    model = language_id.train(df, per_lang=10)
    tables = model.tables()
    for r in language_id.identify(df, model).collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        windows = [raw[i : i + language_id.WINDOW] for i in range(0, len(raw), language_id.WINDOW)]
        p = sum(len(w) * model.probs(np.pad(w, (0, language_id.WINDOW - len(w)), constant_values=32)[None], tables)[0] for w in windows) / len(raw)
        assert r.lang_pred == model.langs[int(p.argmax())] == r.lang and r.score == pytest.approx(p.max(), abs=1e-5)


def test_own_label_is_no_input(spark):
    """Turning one document's label round doesn't change its own score."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"], 12)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = []
    for own in (0, 1):
        labels = spark.createDataFrame([(i, own if i == 7 else i % 2) for i in range(40)], "doc_id long, quality int")
        model = quality_classifier.train(df, labels, k=5)
        score.append(quality_classifier.score_quality(df, model).where("doc_id = 7").first().score)
    assert score[0] == pytest.approx(score[1])


def test_pipeline_stages(spark, tmp_path):
    """Every stage of the pipeline against a brute-force version on what the stage before kept."""
    cp = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(cp.COLUMNS)
    extra = [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, docs.first().text, "en", "s", 1), (-3, docs.first().text, "en", "s", 1)]
    now = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for step, (name, stage) in enumerate(cp.STAGES):
        before = {(r.doc_id, r.text): r for r in now.collect()}
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{step}")
        now = spark.read.parquet(f"{tmp_path}/{step}")
        after = now.collect()
        assert step == 4 or now.columns == cp.COLUMNS
        texts = {r.doc_id: r.text for r in after}
        if name == "quality_classifier":
            model = cp.quality_model(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), sf)
            kept = {r.doc_id for r in quality_classifier.score_quality(spark.createDataFrame(list(before.values()), docs.schema), model).where("score >= 0.3").collect()}
            assert set(texts) == kept
        if name == "line_dedup":
            seen, want = [], {}
            for doc, text in sorted(before, key=lambda k: k[0]):
                rest = []
                for line in (text or "").split("\n"):
                    own = set(WORD.findall(line.translate(LOW)))
                    if own:
                        gone = any(100 * len(own & o) >= 80 * len(own | o) for o in seen)
                        seen.append(own)
                        if gone:
                            continue
                    rest.append(line)
                cut = "\n".join(rest)
                if WORD.search(cut) or cut == (text or ""):
                    want[doc] = None if text is None else cut
            assert texts == want
        if name == "minhash_near_dedup":
            keys = sorted(texts_before := {d: t for d, t in before}, key=int)
            sets = []
            for d in keys:
                w = WORD.findall((texts_before[d] or "").translate(LOW))
                sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
            linked = [(i, j) for i in range(len(keys)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            top = groups(len(keys), linked)
            assert set(texts) == {keys[i] for i in range(len(keys)) if top[i] == i}
        if name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            low = lambda t: " ".join(w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
            starts = {" ".join(w[i : i + 5]) for t in items for w in [low(t).split()] for i in range(len(w) - 4)}
            near = [d for d, t in before if any(" ".join(w[i : i + 5]) in starts for w in [low(t).split()] for i in range(len(w) - 4))]
            leaks = {near[d] for d, _ in brute_leaks([next(t for k, t in before if k == d) for d in near], items)}
            assert set(texts) == {d for d, _ in before} - leaks
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in after)


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries()) == list(range(1, 14))


def test_scores_do_not_depend_on_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    scores = []
    for number in ("doc_id", "cast(1000003 * doc_id % 7919 - 3000 as long)"):
        own = docs.selectExpr(f"{number} as doc_id", "text", "doc_id as was")
        model = quality_classifier.train(own, labels.selectExpr(f"{number} as doc_id", "quality"), max_labelled=40)
        scores.append({r.was: r.score for r in quality_classifier.score_quality(own, model).collect()})
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 50


def test_many_removed_lines_of_one_document(spark):
    lines = [f"line number{i} of the long text" for i in range(20_000)]
    own = [f"only{i} in document number{i} two{i}" for i in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*lines[::2], *own, "", "a line that stays"]))], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).select("doc_id", "text", "n_lines", "n_removed").collect()}
    assert out[2].text == "\n".join([*own, "", "a line that stays"]) and (out[2].n_removed, out[2].n_lines, out[1].n_lines) == (10_000, 30_002, 20_000)
