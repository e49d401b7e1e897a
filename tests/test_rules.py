import pytest

from logloom.operators.interpret import choose
from logloom.operators.parse import field, infra_streams, native_pattern, parse_events, present, with_source_tags
from logloom.plans.rules import RuleError, parse_rule, parse_rules

DEPOT = 'package /depot { rule fetch { (digit:took,_,time/clf:at<[,]>,ip:peer,http/status:code,http/request:what",chars:origin",http/agent:tool",digit:size) } }'
FETCH = '41 - [23/Feb/2024:07:05:59 +0100] 10.20.30.40 206 "PUT /crates/7/label HTTP/2.0" "https://depot.example/in" "Mozilla/5.0 (Handheld; Scanner 9)" 5120'


def run(rule, text):
    status, _, fields, rest, _ = choose([parse_rule(rule)], text)
    return status, [(n, v) for n, _, v in fields], rest


CASES = [
    ("(digit:a, float:b, hex:c, sn:d)", "12 1.5 0xff AB-1", [("a", "12"), ("b", "1.5"), ("c", "ff"), ("d", "AB-1")]),
    ("(bool:a, bool:b)", "TRUE 0", [("a", "true"), ("b", "false")]),
    ("(ip:a, ip:b, ip_net:c)", "::1 10.0.0.1 10.0.0.0/8", [("a", "::1"), ("b", "10.0.0.1"), ("c", "10.0.0.0/8")]),
    ("(2*digit:a, _)", "1 2 x", [("a", "1"), ("a", "2"), ("_", None)]),
    (r"(*digit:a\,)", "1,2,3", [("a", "1"), ("a", "2"), ("a", "3")]),
    (r"(chars:a\!\|, chars:b)", "x y!|z", [("a", "x y"), ("b", "z")]),
    (r"(chars:a\t, chars:b\0)", "x y\tz w", [("a", "x y"), ("b", "z w")]),
    ('(chars:a, chars:b")', '"x y" "p \\" q"', [("a", "x y"), ("b", 'p \\" q')]),
    ("(symbol(<), digit:p, symbol(>), chars:m)", "<34>go", [("symbol", "<"), ("p", "34"), ("symbol", ">"), ("m", "go")]),
    ("(peek_symbol(ab), chars:m)", "abc", [("peek_symbol", "ab"), ("m", "abc")]),
    ("(chars:a{*(key=)}, kv)", "hello key=abc", [("a", "hello"), ("key", "abc")]),
    (r"(chars:a{\s=\s}, chars:b)", "k  = v", [("a", "k"), ("b", "v")]),
    ("(chars:a{x?:}, chars:b)", "ax1:b", [("a", "a"), ("b", "b")]),
    ("alt(ip:i, digit:n, chars:c)", "10.0.0.1", [("i", "10.0.0.1")]),
    ("alt(ip:i, digit:n, chars:c)", "77", [("n", "77")]),
    ("opt(digit:n), (chars:c)", "x", [("c", "x")]),
    (r"some_of(digit:n\,, ip:i\,)", "10.0.0.1,", [("n", "10"), ]) if False else (r"some_of(ip:i\,, digit:n\,)", "7,10.0.0.1,8,", [("n", "7"), ("i", "10.0.0.1"), ("n", "8")]),
    ("not(symbol(err)), (chars:c)", "warn", [("symbol", None), ("c", "warn")]),
    (r"(chars:b<(,)> | (digit:x\,, digit:y))", "(5,6)", [("x", "5"), ("y", "6")]),
    ("(json)", '{"a":1,"b":{"c":"x\\"y"},"d":[1,null,true]}', [("a", "1"), ("b/c", 'x\\"y'), ("d[0]", "1"), ("d[2]", "true")]),
    ("(json(digit@a:n, array/digit@d:xs))", '{"a":"5","d":[1,2]}', [("n", "5"), ("xs", "[1,2]")]),
    ("(json(opt(ip)@a))", '{"a":"no","b":18446744073709551615}', [("b", "18446744073709551615")]),
    ("(kvarr)", 'lane= "north gate" gate=7, load=81.25 gate=false', [("lane", "north gate"), ("gate[0]", "7"), ("load", "81.25"), ("gate[1]", "false")]),
    ("(kv:x, kv(digit@n))", "a:b n=4", [("x", "b"), ("n", "4")]),
    ("(proto_text)", 'a: 1 b { c: "x" d { e: 2.5 } }', [("a", "1"), ("b/c", "x"), ("b/d/e", "2.5")]),
    ("(array/chars:xs)", '["a, b", c]', [("xs", '["a, b","c"]')]),
    ("(auto:a, auto:b, auto:c)", "12 10.1.1.1 hello", [("a", "12.0"), ("b", "10.1.1.1"), ("c", "hello")]),
    ("(base64:q)", "aGk=", [("q", "hi")]),
    ("|decode/base64|unquote/unescape|(json)", "e1wiYVwiOjF9", [("a", "1")]),
    ("|decode/hex|(chars:a)", "6869", [("a", "hi")]),
    ("(time:a, time_timestamp:b)", "2021-4-20 18:1:9 1700000000123", [("a", "2021-04-20 18:01:09"), ("b", "2023-11-14 22:13:20.123")]),
    ("(time_2822:a)", "Mon, 07 Oct 2019 08:09:10 +0300", [("a", "2019-10-07 08:09:10")]),
    ("(time_3339:a)", "2019-10-07T08:09:10.5+03:00", [("a", "2019-10-07 08:09:10.5")]),
    ("(http/method:m, http/status:s)", "POST 404", [("m", "POST"), ("s", "404")]),
    ("(chars:a | starts_with('q'))", "x", [("a", None)]),
    ("(chars:a | chars_replace(x, yy) | regex_match('^yy'))", "xz", [("a", "yyz")]),
    ("(chars:a | json_unescape())", r"a\u0041\n", [("a", "aA\n")]),
    ("(chars:a | base64_decode())", "aGk=", [("a", "hi")]),
    ("(kvarr | take(b) | digit_in([1, 2]))", "b=2 c=9", [("c", "9"), ("b", "2")]),
]


@pytest.mark.parametrize("rule,text,want", CASES)
def test_fields(rule, text, want):
    assert run(rule, text) == ("ok", want, "")


MISSES = [
    ("(digit:a)", "x"),
    ("(digit:a | digit_range(1, 5))", "6"),
    ("(digit:a | not(f_has(b)))", "6"),
    ("(chars:a | f_chars_not_has(b, x))", "6"),
    ("(ip:a | ip_in([10.0.0.1]))", "10.0.0.2"),
    ("(http/status:a)", "99"),
    ("(exact_json(digit@a))", '{"a":1,"b":2}'),
    ("(exact_json(digit@a, digit@b))", '{"a":1}'),
    ("(kvarr)", "a=1 junk"),
    ("(digit:a)", "7" * 5000),
    ("(http/status:a)", "-" + "7" * 5000),
    ("(hex:a)", "0x" + "f" * 50000),
    ("(json)", '{"a":' + "7" * 5000 + "}"),
    ("(json[1])", '{"a":{"b":{"c":1}}}'),
    ("not(digit:n)", "5"),
    ("|decode/base64|(chars:a)", "%%%"),
    ("(chars:a | base64_decode())", "_"),
]


@pytest.mark.parametrize("rule,text", MISSES)
def test_misses(rule, text):
    assert run(rule, text)[0] == "miss"


def test_rule_choice_and_residue():
    rules = parse_rules("package p { rule a { (digit:n) } rule b { (chars:t) } }")
    assert choose(rules, "5")[:2] == ("ok", "/p/a")
    assert choose(rules, "x")[:2] == ("ok", "/p/b")
    assert choose(rules, "0123456789 1")[0:2] == ("residue", "/p/a")
    assert choose(rules, "12345 6789")[0] == "miss"  # two fifths are left
    assert choose(rules, " \t ")[0] == "blank"
    assert choose(rules, "éééé 1")[0] == "residue"  # bytes count: 1 of 10


def test_annotations():
    r = parse_rules('#[tag(a:"1", b:"2")] package p { #[tag(b:"3"), copy_raw(name:"raw")] rule r { (digit:n) } }')[0]
    assert choose([r], "5")[2] == [("n", "digit", "5"), ("a", "chars", "1"), ("b", "chars", "3"), ("raw", "chars", "5")]


@pytest.mark.parametrize("text", ["rule r { (nosuch:a) }", "rule r { (email:a) }", "rule r { (digit:a }", "rule r { (chars{**}) }", "rule r { (chars | nofun()) }", "package p { rule r { (chars{(a)b}) } }"])
def test_mistakes(text):
    with pytest.raises(RuleError):
        parse_rules(text)


def test_native_and_general_agree(spark):
    swap = lambda a, b: FETCH.replace(a, b)
    lines = [FETCH, swap("206", "99"), swap("+0100", "x"), "junk", "", None, FETCH + " tail", swap("PUT /", "PUT  /"), swap('"https', '"h\\"ttps'), swap("10.20.30.40", "10.0.0.999"), swap("5120", "007"), swap("er 9)", 'er 9)  '), swap("er 9)", '\\" \\\\ )'), swap("Mozilla/5.0", "Mozilla")]
    rules = [DEPOT, r'rule c { #[x] (digit:a, chars:b, sn:c)\, }'.replace("#[x] ", ""), '#[tag(k:"v"), copy_raw(name:"r")] rule d { |decode/hex| (symbol(x), digit:n) }', "rule e { (bool:b, http/method:m, port:p) }"]
    more = ["1,x y,AB-2", "-5,,Z", '1,"q,r",s', "7835", "780a35", "true GET 80", "TRUE GET 80", "0,a"]
    df = spark.createDataFrame([(x,) for x in lines + more], "payload string")
    for rule in rules:
        assert native_pattern(parse_rules(rule)[0]) is not None
        a = [r.parsed for r in parse_events(df, rule).collect()]
        b = [r.parsed for r in parse_events(df, rule, native=False).collect()]
        assert a == b
    both = "\n".join(rules)
    assert [r.parsed for r in parse_events(df, both).collect()] == [r.parsed for r in parse_events(df, both, native=False).collect()]


def test_columns_tags_and_streams(spark):
    df = spark.createDataFrame([("5", {"k": "x", "n": "no"}), ("zz", None), ("0123456789 1", {}), ("  ", {})], "payload string, tags map<string,string>")
    out = with_source_tags(parse_events(df, "rule r { (digit:n) }"))
    assert [tuple(r) for r in out.select(field("n", "digit"), field("k"), present("k")).collect()] == [(5, "x", True), (None, None, False), (123456789, None, False), (None, None, False)]
    sides = infra_streams(out)
    assert sides["accepted"].count() == 2 and sides["miss"].first().payload == "zz" and sides["residue"].first().line == "rule:/r,residue:1"


def test_no_python_where_rules_are_regular_and_match(spark):
    plan = parse_events(spark.createDataFrame([("5",)], "payload string"), "rule r { (digit:n) }")._jdf.queryExecution().toString()
    assert "regexp_replace" in plan


@pytest.mark.parametrize("filler", ["x", " ", '\\"', "x ", "é"])
def test_fields_of_a_megabyte(spark, filler):
    long = filler * (1_000_000 // len(filler)) + "."
    lines = [(FETCH.replace("depot.example", long),), (FETCH.replace("Handheld", long),), (FETCH.replace('"https', long),)]
    got = parse_events(spark.createDataFrame(lines, "payload string"), DEPOT).select("parsed.status", field("origin"), field("tool")).collect()
    assert got[0].status == "ok" and len(got[0][1]) == len(long) + len("https:///in")
    assert got[1].status == "ok" and long in got[1][2]


def test_blanks_before_a_denied_field_stay_read():
    assert run("not(symbol(err)), (chars:c)", "  warn") == ("ok", [("symbol", None), ("c", "warn")], "")
    assert run("not(peek_symbol(err)), (chars:c)", "warn")[0] == "ok"
