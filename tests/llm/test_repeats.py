import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logloom.llm import common, filters, repeats
from logloom.llm.queries import op2_substrings
from logloom.llm.tokens import mix

from . import brute


def check(spark, texts, size, anchor):
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    want = brute.repeats(dict(enumerate(texts)), size)
    got = repeats.find_repeats(df, size=size, anchor=anchor).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_small_windows_and_ties(spark):
    random.seed(2)
    texts = [None, "", " ", "a", "a a a a a a a a a", "b\tb\nb b", "x " * 500]
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(0, 40))) for _ in range(60)]
    texts += texts[-3:]
    check(spark, texts, 7, 3)
    check(spark, texts[:20], 3, 3)


def test_shared_passages(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(random.randint(30, 120))] for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(random.randint(1, 4)):
            p = random.choice(passages)
            a = random.randint(0, len(p) - 1)
            parts += p[a : random.randint(a, len(p))] if random.random() < 0.7 else [word() for _ in range(random.randint(1, 60))]
        texts.append(" ".join(parts))
    check(spark, texts, 35, 10)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = brute.repeats(docs)
    for r in op2_substrings(spark, "/root/testdata/sf0.01").collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.find_repeats(df).count() == 0
    row = (None, " ".join(map(str, range(50))))
    twice = spark.createDataFrame([row, row], "doc_id long, text string")
    assert [r.n_removed for r in repeats.find_repeats(twice).collect()] == [50, 50]


def test_chains_of_a_graph(spark):
    # 1-2-3-4 in a row, 5 and 6 both into node 50, 7 into itself, 8 and 9 in a ring, 10 alone
    rows = [(1, 3, 10, 11), (2, 4, 11, 12), (3, 5, 12, 13), (4, 6, 13, 14), (5, 1, 40, 50), (6, 1, 41, 50), (11, 1, 50, 51), (7, 2, 60, 60), (8, 1, 70, 71), (9, 1, 71, 70), (10, 9, 80, 81)]
    got = {r.p: (r.head, r.offset) for r in repeats._chains(spark.createDataFrame(rows, "p long, n int, start long, end long")).collect()}
    assert got == {2: (1, 3), 3: (1, 7), 4: (1, 12)}


def test_equal_hashes_of_different_words_start_the_search_anew(spark, monkeypatch):
    words = lambda a: [f"{a}{i}" for i in range(40)]
    texts = [" ".join(words(a)) for a in ("x", "y")] + ["p " + " ".join(words("z")), "q " + " ".join(words("z"))]

    def blind(text, salt):  # sees no difference between x and y at first
        return repeats_hashes(np.frombuffer(text.tobytes().replace(b"y", b"x"), np.uint8) if not salt else text, salt)

    repeats_hashes = repeats._hashes
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(repeats, "_hashes", blind)
    again, search = [], repeats.find_repeats
    monkeypatch.setattr(repeats, "find_repeats", lambda *a, **k: again.append(a) or search(*a, **k))
    assert {r.doc_id: r.n_removed for r in repeats.find_repeats(df).collect()} == {0: 0, 1: 0, 2: 40, 3: 40}
    assert len(again) == 2


def test_whole_chains_are_read_as_one(spark, monkeypatch):
    random.seed(8)
    base = " ".join(str(random.randint(0, 9999)) for _ in range(2000))
    texts = [base, base, base + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read = []
    plain = repeats._read
    monkeypatch.setattr(repeats, "_read", lambda met, size, salt: read.append(met) or plain(met, size, salt))
    assert [r.n_removed for r in repeats.find_repeats(df).collect()] == [2000, 2000, 2000]
    assert read[0].select(F.size("_hits")).groupBy().max().first()[0] < 12  # not some 150 pieces


def test_long_document_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 64)
    random.seed(5)
    base = [str(random.randint(0, 999)) for _ in range(400)]
    from logloom.llm.tokens import PLAIN

    h = PLAIN.hashes(np.frombuffer(" ".join(base).encode(), np.uint8))
    pieces = list(repeats.path_pieces(h, 35, 10))
    assert len(pieces) == 6 and sum(int(p[3].sum()) for p in pieces) == 366


def test_windows_far_longer_than_the_anchor(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(random.randint(150, 400))] for _ in range(4)]
    texts = []
    for _ in range(40):
        p = random.choice(passages)
        a = random.randint(0, 60)
        texts.append(" ".join([word() for _ in range(20)] + p[a : a + random.randint(70, 300)] + [word() for _ in range(20)]))
    for size in (73, 90, 140):
        check(spark, texts, size, 10)


def test_texts_stay_out_of_python_where_rows_are_told_apart_by_hashes(spark):
    rows = [(i, mix(np.array([i], np.uint64)).view(np.int64).item(), None if i % 7 == 0 else f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, h long, text string")
    bits = filters.hash_bits(df.where("id % 3 = 0"))
    out, may = filters.parted(df, "h", bits)
    for part in (out, may):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    out, may = sorted(map(tuple, out.collect())), sorted(map(tuple, may.collect()))
    assert sorted(out + may) == rows and {r[0] for r in rows if r[0] % 3 == 0} <= {r[0] for r in may} and len(out) > 300


def test_slices_cover_all_rows():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["x"]) for n in (0, 1, common.SLICE, 2 * common.SLICE + 5)]
    got = list(common.sliced(iter(batches)))
    assert max(b.num_rows for b in got) == common.SLICE
    assert [x for b in got for x in b.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
