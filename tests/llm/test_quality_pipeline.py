import numpy as np
import pytest

import corpus_pipeline
from logloom.llm import quality
from logloom.llm.queries import op6_quality, tokenizer_path

from . import brute

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op6_quality(spark, SF).collect()]
    assert all(r.held_out == (brute.fold(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in own])
    assert auc(np.array([r.score for r in own]), y) > 0.95
    assert np.mean([r.predicted == labels[r.doc_id] for r in own]) > 0.95


def test_compiled_rules_equal_the_model(spark):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([None, "", " ", "a b a b", "X!! " * 50, "é" * 300, "one. two.\none. two."])], "doc_id long, text string, score double")
    x = np.array([quality.statistics(np.frombuffer((r.text or "").encode(), np.uint8)) for r in df.collect()])
    model = quality.RuleModel(0.2, [([(0, True, 2.0), (10, False, 0.5)], 1.5), ([(12, False, 0.9)], -0.75), ([(7, False, 0.1)], 2.0)])
    got = [r.score for r in quality.score_quality(df, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(model.predict(x).tolist())


def test_degenerate_labels(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1), (2, 1), (None, 0), (2, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert 0.5 <= quality.score_quality(df, quality.fit(df, labels)).first().score <= 1


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (None, None), (3, ""), (4, "x" * 3_000_000), (5, "word " * 300_000)]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (4, 0), (9, 1)], "doc_id long, quality int")
    got = quality.score_quality(df, quality.fit(df, labels)).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.text == "a b"}) == 1 and all(0 <= r.score <= 1 for r in got)
    none = df.limit(0)
    assert quality.score_quality(none, quality.fit(none, labels)).count() == 0
    assert quality.score_quality(df, quality.fit(df, labels.limit(0))).count() == len(rows)


def test_statistics_against_brute_force():
    for text in ["one two\ttwo. THREE?\none two", "é" * 9 + " a!", "   ", "x", "a b c a b c a b c\nline\nline"]:
        raw = text.encode()
        words = brute.words(text)
        got = dict(zip(quality.STATISTICS, quality.statistics(np.frombuffer(raw, np.uint8)), strict=True))
        assert got["log_bytes"] == pytest.approx(np.log1p(len(raw))) and got["log_words"] == pytest.approx(np.log1p(len(words)))
        for name, own in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "beyond_ascii": range(128, 256)}.items():
            assert got[name] == pytest.approx(sum(b in own for b in raw) / len(raw))
        if words:
            triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
            assert got["word_bytes"] == pytest.approx(np.mean([len(w.encode()) for w in words]))
            assert got["distinct_words"] == pytest.approx(len(set(words)) / len(words))
            assert got["distinct_triples"] == pytest.approx(len(set(triples)) / len(triples) if triples else 1)
            assert got["top_word"] == pytest.approx(max(words.count(w) for w in words) / len(words))
            lines = [x for x in text.split("\n") if x]
            assert got["repeated_lines"] == pytest.approx(1 - len(set(lines)) / len(lines))


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id: r.text for r in corpus_pipeline.filter_quality(spark, docs, sf).collect()}
    groups = brute.jaccard(good, 5, 80)
    left = {d: t for d, t in good.items() if groups[d][1] == d}
    kept = docs.where(docs.doc_id.isin(list(good)))
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, kept, sf).collect()} == set(left)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.contamination(left, items)
    clean = {d for d in left if not hits[d][4]}
    assert len(clean) < len(left) < len(good) < docs.count()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == clean
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    spans = brute.discovered({d: left[d] for d in clean if not hits[d][1]})
    for r in rows:
        text, at, out = left[r.doc_id], 0, []
        if hits[r.doc_id][1]:
            continue
        for a, _, b, k in spans[r.doc_id]:
            if a >= at:
                out.append(text[at:a] + f"<{k.upper()}>")
            at = max(at, b)
        assert r.ids == library.encode("".join(out) + text[at:], add_special_tokens=False).ids


def test_stages_survive_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f g", None, "s", 1), (2, "a b c d e f g", None, "s", 1), (None, "a b c d e f g", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and (out.count() > 0 or name == "quality")  # which may reject them all
    assert corpus_pipeline.drop_near_copies(spark, docs, sf).count() == 3
    assert corpus_pipeline.encode(spark, docs, sf).count() == 6


def test_fit_keeps_the_best_penalty_of_its_full_settings(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.STATISTICS)))
    y = (x[:, 0] > 0.5).astype(float)
    used = []

    def lasso(z, y, penalty, rounds=300):
        used.append(penalty)
        return np.zeros(z.shape[1]), {0.001: 0.0}.get(penalty, 0.2)  # 0.001 is best by less than 5 %

    monkeypatch.setattr(quality, "_lasso", lasso)
    y[::5] = np.arange(len(y[::5])) % 2
    quality.fit_rules(x, y)
    assert used == [0.01, 0.003, 0.001, 0.0003, 0.001]
    assert quality.MAX_ROWS == 16384 and quality.fit_rules.__defaults__[0] == 40
