import random

import numpy as np

from logloom.llm import jaccard
from logloom.llm.queries import op1_jaccard

from . import brute


def check(spark, texts, size=4, percent=85):
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, i) for i, t in docs.items()], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.link_documents(df, size=size, percent=percent).collect()}
    assert got == brute.jaccard(docs, size, percent)


def test_families_of_near_copies(spark):
    random.seed(1)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(40)]
    texts = [None, "", " ", "a", "A", "a b", "a b c d", "A  B\tc d", "b " * 30]
    for _ in range(25):
        base = [word() for _ in range(random.randint(4, 90))] + (common if random.random() < 0.5 else [])
        for _ in range(random.randint(1, 9)):
            own = list(base)
            for _ in range(random.randint(0, 3)):
                own[random.randrange(len(own))] = word()
            if random.random() < 0.3:
                own = own[: random.randint(1, len(own))]
            texts.append(" ".join(own))
    check(spark, texts)


def test_chains_merge_across_pivots(spark):
    words = [str(i) for i in range(400)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 200, 3)] + [" ".join(words[i : i + 60]) for i in range(0, 120, 4)]
    check(spark, texts)
    check(spark, ["a b c d e f g h i j k l m n o p q r s t u v w x y z"[: 2 * n] for n in range(1, 27)], 1, 60)


def test_large_component_in_blocks(spark):
    random.seed(7)
    base = [str(i) for i in range(120)]
    texts = []
    for _ in range(700):
        own = list(base)
        own[random.randrange(120)] = f"x{random.randrange(300)}"
        own[random.randrange(120)] = f"y{random.randrange(300)}"
        texts.append(" ".join(own))
    check(spark, texts)


def test_links_among():
    random.seed(3)
    sets = [np.unique(np.array([random.randrange(30) for _ in range(random.randint(1, 40))], np.uint64)) for _ in range(50)]
    got = jaccard.links_among(sets, 60)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            n = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 100 * n >= 60 * (len(a) + len(b) - n))


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = brute.jaccard(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in op1_jaccard(spark, "/root/testdata/sf0.01").collect()} == want


def test_empty_table_and_null_keys(spark):
    assert jaccard.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (None, "x")], "doc_id long, text string")
    assert sorted((r.component_id or 0, r.n_links) for r in jaccard.link_documents(df).collect()) == [(0, 0), (4, 2), (4, 2), (4, 2)]


def test_links_within_families_of_empty_parts(spark):
    random.seed(5)
    members, sets = [], {}
    for family in range(0, 200, 5):
        base = [random.getrandbits(62) for _ in range(100)]
        for c in range(family, family + random.randint(2, 5)):
            sets[c] = sorted({*base[random.randint(0, 8) :], *(random.getrandbits(62) for _ in range(random.randint(0, 6)))})
            members.append((c, len(sets[c]), random.randint(1, 3), family))
    want = dict.fromkeys(sets, 0)
    for a, _, _, f in members:
        for b, _, m, g in members:
            n = len({*sets[a]} & {*sets[b]})
            if a != b and f == g and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                want[a] += m
    left = spark.createDataFrame(members, "c long, n long, m long, family long")
    right = spark.createDataFrame(list(sets.items()), "c long, own array<long>")
    for part in (1, 2, 512):
        rows = jaccard._within(left, right, 85, part=part).groupBy("c").sum("k").collect()
        assert {c: n for c, n in want.items() if n} == {r[0]: r[1] for r in rows if r[1]}
