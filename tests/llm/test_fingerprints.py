import random

import numpy as np

from logloom.llm import fingerprints as fp
from logloom.llm.queries import op3_fingerprints

from . import brute


def test_peeling_recovers_differences():
    random.seed(6)
    for size in (0, 1, 5, 40, 700):
        lines = ["".join(random.choice("abc def") for _ in range(30)) for _ in range(size)]
        other = lines[: size // 2] + [f"new {i}" for i in range(size // 3)] + lines[:1] * 3
        a, b = fp.Document("\n".join(lines)), fp.Document("\n".join(other))
        ours, theirs = fp.difference(a, b)
        assert set(ours.tolist()) == set(a.keys.tolist()) - set(b.keys.tolist())
        assert set(theirs.tolist()) == set(b.keys.tolist()) - set(a.keys.tolist())
        assert fp.likeness(a, fp.Document("\n".join(lines))) == 1.0
        tight = fp.Document("\n".join(other))
        assert a.sketch(3).peel(tight.sketch(3)) is None or size < 5


def test_repeated_units_are_counted():
    a, b = fp.Document("x y\nx y\nx y"), fp.Document("x y")
    assert len(a.keys) == 3 and len(b.keys) == 1 and fp.likeness(a, b) == 1 / 3


def expected(docs):
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        out.append((d, len(t), brute.sha(fp.edited(t, n)), t, n))
    return out


def check(spark, rows, got):
    want = expected(rows)
    assert sorted(map(repr, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(repr, (w[:3] for w in want)))
    by = {r.doc_id: r for r in got}
    for d, _, _, t, n in want:
        if d is not None and sum(r[0] == d for r in rows) == 1:
            r = by[d]
            a, b, e = fp.Document(t), fp.Document(n), fp.Document(fp.edited(t, n))
            for near, o in ((r.near_next, b), (r.near_edited, e)):
                both = len(np.intersect1d(a.keys, o.keys))
                union = len(a.keys) + len(o.keys) - both
                assert near == (both / union if union else 1.0)
            assert r.fingerprint == a.sketch().text() and r.edited_fingerprint == e.sketch().text()


def test_small_and_odd_tables(spark, monkeypatch):
    schema = "doc_id long, text string, n_chars int"
    for rows in ([], [(1, "one two")], [(2, None), (1, "")], [(5, "a b"), (5, "c"), (None, "z"), (None, None), (-3, "é😂" * 99), (7, "x" * 5000)]):
        df = spark.createDataFrame([(d, t, 0) for d, t in rows], schema)
        got = fp.fingerprint_versions(df).collect()
        if rows:
            check(spark, rows, got)
        else:
            assert got == []
    rows = [(i * 7 % 501, f"text {i} " * (i % 9)) for i in range(501)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], schema)
    source = fp.neighbours
    monkeypatch.setattr(fp, "neighbours", lambda d, k, t: source(d, k, t, 20))
    check(spark, rows, fp.fingerprint_versions(df).collect())


def test_keys_that_are_no_numbers(spark, monkeypatch):
    rows = [(f"k{i * 7 % 90}x", f"text {i} " * (i % 5)) for i in range(90)] + [(None, "last"), ("", "before last")]
    df = spark.createDataFrame([(d, t, "f", 1.5) for d, t in rows], "id string, text string, Fingerprint string, near_next double")
    source = fp.neighbours
    monkeypatch.setattr(fp, "neighbours", lambda d, k, t: source(d, k, t, 8))
    got = fp.fingerprint_versions(df, "id").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""), reverse=True)
    want = {d: brute.sha(fp.edited(t, order[(i + 1) % len(order)][1])) for i, (d, t) in enumerate(order)}
    assert {r.id: r.edited_sha256 for r in got} == want and len(got) == len(rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = op3_fingerprints(spark, "/root/testdata/sf0.01").collect()
    check(spark, rows, got)
    assert sum(r.near_edited for r in got) > 10 * sum(r.near_next for r in got)
