import random
import re

import numpy as np

from logloom.llm import licenses
from logloom.llm.queries import op4_licenses

APACHE, GPL = licenses.TEMPLATES["apache-2.0"], licenses.TEMPLATES["gpl-3.0"]


def test_patience_matches_rise_and_agree():
    random.seed(2)
    for _ in range(300):
        a, b = ([random.randint(0, 12) for _ in range(random.randint(0, 25))] for _ in "ab")
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    words = list(range(30))
    assert licenses.patience(words, words) == [(i, i) for i in words]
    assert licenses.patience([9, 9, *words[:20], 7, 7, *words[20:]], words)[:1] == [(2, 0)]


def test_hits_edits_repeats_and_clean_texts(spark):
    noise = " ".join(f"word{i}" for i in range(300))
    long = licenses.TEMPLATES["mit"]
    edited = long.replace("hereby ", "")
    texts = [None, "", noise, f"{noise} {APACHE}. {noise}", f"{APACHE}\n{APACHE}", GPL.upper(), f"{noise} {edited} {noise}", "licensed under the version 2 0 apache", f"x {GPL} y {APACHE}", noise * 50 + " " + GPL]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hits int")
    got = {r.doc_id: [(h.license, h.start, h.end, round(h.coverage, 3)) for h in r.hits] for r in licenses.scan_licenses(df).collect()}
    assert got[0] == got[1] == got[2] == got[7] == []
    assert got[3] == [("apache-2.0", 300, 308, 1.0)]
    assert got[4] == [("apache-2.0", 0, 8, 1.0), ("apache-2.0", 8, 16, 1.0)]
    assert [x[0] for x in got[5]] == ["gpl-3.0", "lgpl-3.0"][: len(got[5])] and got[5][0][3] == 1.0
    assert [x[:3] for x in got[6]] == [("mit", 300, 300 + len(edited.split()))] and 0.9 <= got[6][0][3] < 1
    assert {x[0] for x in got[8]} >= {"gpl-3.0", "apache-2.0"} and got[9][0][0] == "gpl-3.0"
    assert licenses.scan_licenses(df.where("false")).count() == 0
    assert licenses.scan_licenses(df, templates={"none": "..."}).where("size(hits) > 0").count() == 0


def test_whole_table_against_exact_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    tidy = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) + " "
    want = {k: {d for d, t in docs.items() if tidy(licenses.TEMPLATES[k]) in tidy(t)} for k in ("apache-2.0", "gpl-3.0")}
    rows = op4_licenses(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and want["apache-2.0"] and want["gpl-3.0"]
    for k, ids in want.items():
        found = {r.doc_id for r in rows if k in r.licenses.split(",")}
        assert ids <= found and len(found - ids) <= max(2, len(ids) // 10)


def test_empty_scanner():
    assert licenses.Scanner({}, 0.9).scan(np.frombuffer(b"a b", np.uint8)) == (2, [])


def scan(text):
    return licenses.Scanner(licenses.known(), 0.9).scan(np.frombuffer(text.encode(), np.uint8))[1]


def test_every_license_line_of_the_table(spark):
    lines = {"mit": "Released under the MIT License", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0", "apache-2.0": APACHE, "gpl-3.0": GPL}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op4_licenses(spark, "/root/testdata/sf0.1").collect()}
    for name, line in lines.items():
        want = {d for d, t in docs.items() if line in t}
        assert len(want) > 50 and want == {d for d, r in rows.items() if name in r.licenses.split(",")}
    assert all(r.n_hits == sum(docs[d].count(x) for x in lines.values()) for d, r in rows.items())


def test_whole_texts_notices_and_references():
    noise = " ".join(f"word{i}" for i in range(40))
    for path in sorted(licenses.TEXTS.glob("*.txt")):
        name = path.name.removesuffix(".txt").removesuffix(".notice")
        text = path.read_text()
        got = scan(f"{noise}\n{text}\n{noise}")
        n = len(re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text))
        assert [(x[0], x[1]) for x in got] == [(name, 1.0)] and got[0][2:] == (40, 40 + n), path.name
    one = {"lgpl-3.0": "GNU Lesser General Public License, version 3", "cc-by-nc-sa-4.0": "licensed under CC BY-NC-SA 4.0", "gpl-2.0": "under GPLv2.", "agpl-3.0": "the GNU Affero General Public License v3"}
    assert {k: [x[0] for x in scan(f"{noise} {t} {noise}")] for k, t in one.items()} == {k: [k] for k in one}
    assert [x[0] for x in scan("Licensed under the Apache License, Version 2.0 or the MIT License")] == ["apache-2.0", "mit"]
    assert scan("MIT grants no such license, and CC is by no means 4 or 0") == []


def test_equal_notices_side_by_side():
    noise = " ".join(f"word{i}" for i in range(200))
    cc = licenses.TEMPLATES["cc-by-4.0"]
    got = scan(f"{cc} {noise} {GPL} {GPL}")
    at = len(re.findall(r"\w+", cc)) + 200
    assert [x[0] for x in got] == ["cc-by-4.0", "gpl-3.0", "gpl-3.0"] and [x[2:] for x in got[1:]] == [(at, at + 12), (at + 12, at + 24)]
    plain = licenses.Scanner(licenses.TEMPLATES, 0.9).scan(np.frombuffer(f"{cc} {noise} {GPL} {GPL}".encode(), np.uint8))[1]
    assert [x[0] for x in plain] == ["cc-by-4.0", "gpl-3.0", "gpl-3.0"]
