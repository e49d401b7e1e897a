import random

from pyspark.sql import functions as F

from logloom.llm import pii

from . import brute

HARD = [
    None,
    "",
    "a@b.c+d@e.f a@@b.c x@y @x.y a.b@c-.d.e...",
    "999.1.1.1.2.3.4 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3 256.1.1.1 0000.1.1.255",
    "4111 1111 1111 1111 4111-1111-1111-1111-4111 1  4111111111111111 5 4111111111111111x41111111111111110",
    "+1 (758) 555-3655 +49 30 1234567 +1.2 +12345678901234567 ++1 555 555 5555- +1 555 555 555 .",
    "é😂 mail x@y.zz é +1 222 333 4444é 10.0.0.1😂",
    "0" * 3000 + " " + "1 " * 3000 + "a" * 20000 + "@b.c" + ".d" * 5000,
    "a" * 30000,
    " ".join(f"u{i}@x.org 10.0.{i % 256}.7" for i in range(700)),
]


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    out = pii.find_pii(df, **more)
    return {r.doc_id: r for r in out.select("doc_id", *(f"n_{k}" for k in pii.KINDS), pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s"), pii.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("red")).collect()}


def test_base_spans_against_brute_force(spark):
    random.seed(4)
    parts = ["a@b.co", "1.2.3.4", "4111111111111111", "+1 (212) 555-1234", " ", " ", "-", ".", "x", "7", "٣", "é", "@", "+", "\n", "4242 4242 4242 4242"]
    texts = HARD + ["".join(random.choice(parts) for _ in range(random.randint(1, 60))) for _ in range(400)]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        want = brute.pii(t)
        assert got[i].b == brute.spans(want), t[:80]
        for k in pii.KINDS:
            assert got[i][f"n_{k}"] == sum(x[3] == k for x in want)


def test_whole_table(spark):
    from logloom.llm.queries import op5_pii

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    want = brute.discovered(docs)
    for r in op5_pii(spark, "/root/testdata/sf0.01").collect():
        assert r.base_sha256 == brute.sha(brute.spans(brute.pii(docs[r.doc_id])))
        assert r.spans == brute.spans(want[r.doc_id])


def planted(n=400, seed=2):
    """Texts with seeds in a few contexts, the same contexts around identifiers that no base pattern takes, and prose."""
    random.seed(seed)
    prose = lambda k: " ".join(random.choice("the of and river walked slowly under bright old stones while rain fell on quiet fields".split()) for _ in range(k))
    number = lambda k: "".join(random.choice("0123456789") for _ in range(k))
    seen = {
        "email": lambda: f"{random.choice(['ann', 'bo', 'cy'])}{number(3)}@site{number(2)}.org",
        "ip": lambda: ".".join(str(random.randint(0, 255)) for _ in range(4)),
        "phone": lambda: f"+1 ({number(3)}) 555-{number(4)}",
    }
    unseen = {"email": lambda: f"{random.choice(['ann', 'bo'])}.at.{random.choice(['mill', 'quay', 'lock'])}{random.choice('abcdefgh')}.dot.org", "ip": lambda: f"host-{random.choice('abcdefgh')}{random.choice('qrstuvwx')}", "phone": lambda: f"0049-{number(3)}-{number(4)}"}
    contexts = {"email": ("please write to", "soon"), "ip": ("logged in from", "at night"), "phone": ("call me at", "after noon")}
    texts, want = [], []
    for i in range(n):
        kind = random.choice(list(contexts))
        new = i % 10 == 3
        own = (unseen if new else seen)[kind]()
        before, after = contexts[kind]
        texts.append(f"{prose(8)} {before} {own} {after} {prose(8)}")
        want.append((kind, own) if new else None)
    return texts + [prose(40) for _ in range(n)], want + [None] * n


def test_contexts_discover_unseen_identifiers(spark):
    texts, want = planted()
    got = run(spark, texts)
    hit = miss = wrong = 0
    for i, (t, w) in enumerate(zip(texts, want, strict=True)):
        extra = set(got[i].s.split(",")) - set(brute.spans(brute.seeds(t)).split(","))
        if w is None:
            wrong += bool(extra)
        else:
            at = t.index(w[1])
            own = f"{w[0]}:{at}:{at + len(w[1])}"
            hit += own in extra
            miss += own not in extra
            wrong += bool(extra - {own})
    assert hit / (hit + miss) >= 0.9 and wrong == 0
    docs = dict(enumerate(texts))
    assert {i: got[i].s for i in docs} == {i: brute.spans(v) for i, v in brute.discovered(docs).items()}


def test_discovery_by_shuffled_patterns_and_redaction(spark, monkeypatch):
    texts, want = planted(300, 3)
    plain = run(spark, texts)
    monkeypatch.setattr(pii, "BROADCAST", 0)
    assert {i: r.s for i, r in run(spark, texts).items()} == {i: r.s for i, r in plain.items()}
    i = next(i for i, w in enumerate(want) if w and w[0] == "ip")
    assert f"logged in from <IP> at night" in plain[i].red


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(df).count() == 0
