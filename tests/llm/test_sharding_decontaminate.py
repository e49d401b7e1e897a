import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from logloom.llm import common, decontaminate, sharding
from logloom.llm.queries import op8_sharding, op10_decontamination

from . import brute


def test_shards(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op8_sharding(spark, "/root/testdata/sf0.01").collect()
    slots = {}
    for r in rows:
        body = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    moved = sum(r.grown_shard == 24 for r in rows)
    assert 0 < moved < 3 * len(rows) / 25


def test_weights_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x", "s") for i in range(4000)] + [(None, "é", "s")] * 3, "doc_id long, text string, shard string")
    rows = sharding.assign_shards(df, "doc_id", "text", [1.0, 3.0, 0.0]).collect()
    n = Counter(r.shard for r in rows)
    assert set(n) == {0, 1} and 2.5 < n[1] / n[0] < 3.6
    assert all(r.size == 8 + len((r.text or "").encode()) for r in rows)
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sharding.assign_shards(df.where(F.lit(False)), "doc_id", "text", [1.0]).count() == 0


def test_contamination_against_brute_force(spark):
    random.seed(9)
    word = lambda: random.choice(["ab", "AB", "é", "É", "x1", "z", "q"])
    items = [(i, " ".join(word() for _ in range(random.choice([0, 1, 2, 3, 5, 8])))) for i in range(12)] + [(50, None), (51, "ab é")]
    texts = [None, "", "...", "ab-é", *("_".join(word() for _ in range(random.randint(0, 60))) for _ in range(80))]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(dict(enumerate(texts)), items, 4)
    for block in (1 << 20, 40):
        found = decontaminate.find_contamination(df, bench, size=4, block_bytes=block)
        got = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), decontaminate.contaminated().alias("c"))
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(found).collect()}
    for i, t in enumerate(texts):
        if want[i][1] == 0:
            assert cut[i] == t
        else:
            assert brute.contamination({0: cut[i]}, [])[0][0] >= want[i][0] - want[i][1] - 1


def test_long_items_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    random.seed(3)
    items = [(i, " ".join(random.choice("abcd") for _ in range(n))) for i, n in enumerate((1, 3, 4, 5, 9, 10, 11, 12, 40, 200))]
    texts = [" ".join(random.choice("abcd") for _ in range(60)) for _ in range(20)] + ["w" * 3_000_000 + " " + items[8][1]]
    df = spark.createDataFrame([(i % 21, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(dict(enumerate(texts)), items, 4)
    for block in (1 << 20, 60):
        found = decontaminate.find_contamination(df, bench, size=4, block_bytes=block)
        got = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), decontaminate.contaminated().alias("c")).collect()
        assert len(got) == 42 and all(tuple(r[1:]) == want[r.doc_id] for r in got)


def test_table_of_a_large_benchmark_is_small():
    random.seed(5)
    words = [f"w{i}" for i in range(5000)]
    text = " ".join(random.choice(words) for _ in range(400_000))
    scanner = decontaminate.Scanner([("a", text)], 13)
    held = sum(x.nbytes for t in scanner.tables.values() for x in t[:4]) + scanner.start.nbytes + scanner.end.nbytes + scanner.low.nbytes
    assert held < 36 * 400_000 + len(text) + (1 << 24)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contamination(docs, items)
    assert sum(w[4] for w in want.values()) > 0
    for r in op10_decontamination(spark, "/root/testdata/sf0.01").collect():
        assert tuple(r[1:]) == want[r.doc_id]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(df, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.find_contamination(one, bench).first().n_hit == 0


def test_cuts_are_removed(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    first = common.cut(spark.range(5), "a")
    second = common.cut(first.selectExpr("id + 1 AS id"), "b", first)
    left = os.listdir(tmp_path / "cuts" / spark.sparkContext.applicationId)
    assert len(left) == 1 and left[0].startswith("b-") and second.count() == 5
    common.clear_cuts(spark)
    assert os.listdir(tmp_path / "cuts") == []
