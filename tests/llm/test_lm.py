import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import lm
from logloom.llm.common import cut
from logloom.llm.packed import HASHED, Pairs, distinct, doubled, doubles, fixed, numbers, planes, unfixed
from logloom.llm.queries import op9_language_model

from . import brute


def tokens(text):
    return [*brute.words(brute.lower(text or "")), None]


def base(docs, train):
    c = Counter(t for d in train for t in tokens(docs[d]))
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in docs.items():
        own = tokens(t)
        out[d] = (len(own), sum(c[x] > 0 for x in own), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own))
    return out


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = base(docs, [d for d in docs if brute.fold(d) != 1])
    got = op9_language_model(spark, "/root/testdata/sf0.01").collect()
    ours = theirs = n = 0
    for r in got:
        assert r.held_out == (brute.fold(r.doc_id) == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.score < 0
        if r.held_out:
            ours, theirs, n = ours + r.score, theirs + r.base_score, n + r.n_tokens
    assert ours > theirs + 0.1 * n  # a fifth less perplexity at least, on texts never seen


def test_join_and_broadcast_agree_and_probabilities_sum_to_one(spark):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "été.", "Über!"]
    texts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 80))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.fit(df.select("text"))
    other = lm.fit(df.select("text"), frequent=5, buckets=7)
    a = {r.doc_id: r for r in lm.score_texts(df, model).collect()}
    b = {r.doc_id: r for r in lm.score_texts(df, other).collect()}
    for d in a:
        assert a[d].n_known == b[d].n_known == a[d].n_tokens
        assert a[d].score == pytest.approx(b[d].score, rel=1e-9) and a[d].base_score == pytest.approx(b[d].base_score, rel=1e-9)
    one, two = model.fallback()
    unseen = model.restaurants.unseen() * np.repeat(one, 2) * two / model.sums
    assert np.allclose(model.upper.p.sum(0) + unseen, 1, atol=1e-9)
    assert np.allclose(model.sums[model.restaurants.c2 > 0], 1, atol=0.15)


def test_seating_follows_its_distribution():
    d, weight, c = 0.6, 2.0, 9
    s = lm.log_stirling(d)
    p = np.exp(s[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(weight))
    p /= p.sum()
    u = lm.uniform(np.arange(40000, dtype=np.uint64), 3)
    t = lm.draw_tables(np.full(40000, c), np.full(40000, weight), d, s, u)
    assert np.allclose(np.bincount(t, minlength=c + 1)[1:] / 40000, p, atol=0.01)


def exact_row(c, d):
    """log S(c, t) for all t, by the recursion."""
    row, t = np.full(c + 2, -np.inf), np.arange(c + 2)
    row[1] = 0
    for n in range(1, c):
        with np.errstate(divide="ignore"):
            row = np.logaddexp(row + np.log(np.maximum(n - d * t, 1e-300)), np.concatenate(([-np.inf], row[:-1])))
    return row


@pytest.mark.parametrize("d", [0.05, 0.3, 0.5, 0.77, 0.95])
def test_large_counts_follow_the_same_distribution(d):
    for c in (65, 130, 700):
        row = exact_row(c, d)
        t = np.arange(1, c + 1)
        assert np.abs(lm.log_stirling_of(np.float64(c), t, d) - row[1 : c + 1]).max() < 0.03
        for weight in (0.01, 0.7, 5.0, 60.0):
            p = np.exp(row[1 : c + 1] + t * np.log(weight) - (row[1 : c + 1] + t * np.log(weight)).max())
            p /= p.sum()
            n = 4000
            got = lm.draw_tables(np.full(n, c), np.full(n, weight), d, lm.log_stirling(d), lm.uniform(np.arange(n, dtype=np.uint64), c))
            mean, sd = (p * t).sum(), math.sqrt(max(0.0, (p * t * t).sum() - (p * t).sum() ** 2))
            assert abs(got.mean() - mean) < 0.02 * mean + 5 * sd / math.sqrt(n) + 1e-9
            assert abs(got.std() - sd) < 0.1 * sd + 0.05
    huge = lm.draw_tables(np.array([10**9] * 300), np.full(300, 2.0), 0.5, lm.log_stirling(0.5), lm.uniform(np.arange(300, dtype=np.uint64), 4))
    assert abs(huge.mean() - 5) < 0.7  # one large table, and as many others as a Poisson variable of mean 4


def test_empty_corpus_and_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm.fit(none.select("text"))
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, math.isfinite(r.score)) for r in lm.score_texts(df, model).collect())
    assert got == [(1, 0, 0, True), (3, 0, 0, True)]
    assert lm.score_texts(none, model).count() == 0


def test_word_order_counts_and_pairs_sum_to_one(spark):
    random.seed(9)
    after = {f"w{i}": [f"w{random.randrange(40)}" for _ in range(3)] for i in range(40)}

    def fluent():
        out = ["w0"]
        while len(out) < 60:
            out.append(random.choice(after[out[-1]]))
        return out

    train = [(i, " ".join(fluent())) for i in range(200)]
    fresh = [fluent() for _ in range(20)]
    shuffled = [random.sample(x, len(x)) for x in fresh]
    model = lm.fit(spark.createDataFrame(train, "doc_id long, text string").select("text"))
    held = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(fresh + shuffled)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm.score_texts(held, model).collect()}
    assert all(score[i] > score[i + 20] + 0.3 * 60 for i in range(20))
    # what pairs keep and what is passed on is a whole, in each restaurant of a bucket
    upper = model.upper
    for row in model.pairs.collect():
        p, c, t = Pairs.unpack(row.a, row.b, row.c), numbers(row.n), numbers(row.t)
        assert (t >= 1).all() and (t <= c).all()
        cu, tu = upper.totals(upper.restaurants(p, c, t), p.x)
        x, at = np.unique(p.x[upper.codes.heads(p.x) < 0], return_inverse=True)
        alone = upper.codes.heads(p.x) < 0
        keeps = np.bincount(at, (c - upper.discount * t)[alone]) / (1 + np.array([cu[p.x == v][0] for v in x]))
        passes = (1 + upper.discount * np.array([tu[p.x == v][0] for v in x])) / (1 + np.array([cu[p.x == v][0] for v in x]))
        assert np.allclose(keeps + passes, 1)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 999}" for i in range(lm.BLOCK // 4))
    rows = [(5, None, 1.0), (None, "5", 1.0), (1, "a b a", 1.0), (1, "a b a", 1.0), (2, "a b a", 1.0), (3, "", None), (4, long, 1.0), (6, "x" * 3_000_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score double")
    got = lm.score_texts(df, lm.fit(df.select("text"), buckets=3)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 4, 4, 4, lm.BLOCK // 4 + 1]
    assert len({r.score for r in got if r.n_tokens == 4}) == 1 and got[0].asDict().keys() == {"doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"}


def test_packed_pairs():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.integers(0, 1 << 22, 500), rng.integers(0, 9, 500))).astype(np.uint64)
    y = np.concatenate((rng.integers(0, 1 << 16, 500), rng.integers(0, 5, 500))).astype(np.uint64)
    x[::3] |= HASHED
    y[::7] |= HASHED
    pairs, order, at = distinct(x, y)
    want = Counter(zip(x.tolist(), y.tolist(), strict=True))
    assert dict(zip(zip(pairs.x.tolist(), pairs.y.tolist(), strict=True), np.diff(np.append(at, len(x))).tolist(), strict=True)) == want
    back = Pairs.unpack(*pairs.pack())
    assert (back.x == pairs.x).all() and (back.y == pairs.y).all() and back.small == pairs.small
    half = distinct(x[::2], y[::2])[0]
    place, hit = half.find(pairs)
    known = set(zip(half.x.tolist(), half.y.tolist(), strict=True))
    for i, p in enumerate(zip(pairs.x.tolist(), pairs.y.tolist(), strict=True)):
        assert hit[i] == (p in known) and (not hit[i] or (half.x[place[i]], half.y[place[i]]) == p)
    for values in ([], [0], [5, 5, 1 << 63]):
        a = np.array(values, np.uint64)
        assert (numbers(planes(a)) == a).all() and (numbers(planes(a, True), True) == a).all()


def test_what_a_block_asks_does_not_go_through_all_pairs_of_a_bucket():
    rng = np.random.default_rng(4)
    x = np.sort(rng.integers(0, 200_000, 1_000_000).astype(np.uint64)) | HASHED
    own = distinct(x, rng.integers(0, 1 << 62, len(x)).astype(np.uint64) | HASHED)[0]
    began = time.process_time()
    for i in range(100):
        on = rng.integers(0, len(own.x), 50)
        y = own.y[on] + (np.arange(50) % 2 * i).astype(np.uint64)  # half of them are not there but for the first time
        place, hit = own.find(Pairs(own.x[on], y, 0))
        wanted = (np.arange(50) % 2 == 0) | (i == 0)
        assert (hit == wanted).all() and (place[hit] == on[hit]).all()
    assert time.process_time() - began < 5


def test_many_blocks_of_documents(spark, monkeypatch):
    random.seed(10)
    texts = [" ".join(f"w{int(random.paretovariate(0.8))}" for _ in range(random.randint(0, 90))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = lm.fit(df.select("text"), frequent=9, buckets=5)
    want = {r.doc_id: r for r in lm.score_texts(df, model).collect()}
    monkeypatch.setattr(lm, "BLOCK", 40)  # nearly every document is a block
    for r in lm.score_texts(df, model).collect():
        assert (r.n_tokens, r.n_known) == (want[r.doc_id].n_tokens, want[r.doc_id].n_known)
        assert r.score == pytest.approx(want[r.doc_id].score, rel=1e-9) and r.base_score == pytest.approx(want[r.doc_id].base_score, rel=1e-9)


def test_texts_in_runs_have_the_tokens_of_each_text():
    random.seed(12)
    parts = ["a", "B", "é", ".", "!", " ", " ", "\n", "\t", "日", "x y"]
    texts = [random.choice([None, "", "".join(random.choices(parts, k=random.randint(1, 25)))]) for _ in range(400)]
    texts += ["z é! " * 40_000, "x", "q w" * 60_000, " "]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()).slice(3), pa.array([], pa.string())):
        want = [lm.tokens(np.frombuffer((t or "").encode(), np.uint8)) for t in column.to_pylist()]
        got = list(lm.token_runs(column))
        assert [n for r in got for n in r[2]] == [len(h) for h, _ in want]
        for i in (0, 1):
            assert [x for r in got for x in r[i].tolist()] == [x for w in want for x in w[i].tolist()]


def test_stirling_numbers_at_large_discounts():
    # was off by 0.015 before
    t = np.arange(1, 701)
    assert np.abs(lm.log_stirling_of(np.float64(700), t, 0.95) - exact_row(700, 0.95)[1:701]).max() < 0.013


def test_rounds_leave_no_document_out_and_none_twice(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a b{i % 7} c") for i in range(60)] + [(None, None), (3, "a b3 c")], "doc_id long, text string").coalesce(1)
    model = lm.fit(df.select("text"), buckets=3)
    want = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in lm.score_texts(df, model).collect())
    monkeypatch.setattr(lm, "BLOCK", 40)
    written = []

    def counting(frame, tag, instead=None):
        out = cut(frame, tag, instead)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(lm, "cut", counting)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in lm.score_texts(df, model).collect())
    assert got == want and len(got) == 62
    # what a round sends lies on disk until it is written, so no round may have all documents
    assert [tag for tag, _ in written] == ["lm-sums"] * lm.ROUNDS
    assert sum(n for _, n in written) == 62 and max(n for _, n in written) < 50


def test_messages_keep_their_numbers():
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(0, 50, 999), [0.0, -1e6, 1e6]))
    assert np.abs(unfixed(fixed(x)) - x).max() <= 2.0**-33
    assert (doubled(doubles(x), len(x)) == x).all()
    assert len(unfixed(fixed(x[:0]))) == len(doubled(doubles(x[:0]), 0)) == 0
    assert len(fixed(x[:999])) < 6 * 999
