"""Registered queries of the log engine, each over whole tables, with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import net
from .functions.compare import filter_expression, record
from .functions.payload import step
from .operators import stats
from .operators.lookup import Knowledge
from .operators.parse import field, infra_streams, parse_events, present, with_source_tags
from .operators.project import apply_model, field_columns
from .operators.route import Routes, Sink, SinkGroup, empty_results, fan_out, for_sink, model_of_rule
from .plans.models import parse_model
from .plans.rules import parse_rules
from .sinks.formats import line
from .sources.readers import decoded
from .sources.syslog import header, normalise
from .streaming.engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(df: DataFrame, expression: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.expr(expression).alias("payload"))


def _parsed(df: DataFrame, rule: str, fields: dict[str, str], *keys: str, native: bool = True) -> DataFrame:
    out = parse_events(df, rule, native=native)
    return out.select(*keys, F.col("parsed.status").alias("status"), *[field(n, k).alias(a) for a, (n, k) in {x: (y if isinstance(y, tuple) else (x, y)) for x, y in fields.items()}.items()])


# -- parsing

ACCESS = r"""concat('10.', cast(pmod(user_id, 250) as string), '.', cast(pmod(event_id, 250) as string), '.7 - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "GET /', event_type, '?id=', cast(event_id as string), ' HTTP/1.1" ', cast(200 + pmod(event_id, 4) * 100 as string), ' ', cast(user_id as string), ' "http://h', cast(pmod(user_id, 9) as string), '.example/" "Mozilla/5.0 (X11)" "-"')"""
NGINX = 'package /web { rule access { (ip:src,2*_,time/clf:at<[,]>,http/request:req",http/status:code,digit:size,chars:ref",http/agent:agent",_") } }'
_ACCESS_SQL = """
SELECT event_id, 'ok' AS status, '10.' || (user_id % 250) || '.' || (event_id % 250) || '.7' AS src, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at,
  'GET /' || event_type || '?id=' || event_id || ' HTTP/1.1' AS req, 200 + (event_id % 4) * 100 AS code, user_id AS size,
  'http://h' || (user_id % 9) || '.example/' AS ref, 'Mozilla/5.0 (X11) ' AS agent
FROM events"""
_ACCESS_FIELDS = {"src": "ip", "at": "chars", "req": "chars", "code": "digit", "size": "digit", "ref": "chars", "agent": "chars"}


@query(_ACCESS_SQL)
def parse_access(spark, sf):
    return _parsed(_lines(table(spark, sf, "events"), ACCESS, "event_id"), NGINX, _ACCESS_FIELDS, "event_id")


@query(_ACCESS_SQL)
def parse_access_general(spark, sf):
    return _parsed(_lines(table(spark, sf, "events"), ACCESS, "event_id"), NGINX, _ACCESS_FIELDS, "event_id", native=False)


@query("SELECT event_id, 'ok' AS status, json_extract(props, '$.k')::BIGINT AS k FROM events")
def parse_json(spark, sf):
    return _parsed(_lines(table(spark, sf, "events"), "props", "event_id"), "rule j { (json(digit@k)) }", {"k": "digit"}, "event_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'miss' ELSE 'ok' END AS status, CASE WHEN event_id % 3 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events")
def parse_exact_json(spark, sf):
    lines = _lines(table(spark, sf, "events"), "if(event_id % 3 = 0, replace(props, '}', ', \"z\": 1}'), props)", "event_id")
    return _parsed(lines, "rule j { (exact_json(digit@k)) }", {"k": "digit"}, "event_id")


@query("SELECT event_id, 'ok' AS status, event_type AS a_b, user_id AS n0, (user_id + 1) AS n1 FROM events")
def parse_json_nested(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('{\"a\":{\"b\":\"', event_type, '\",\"x\":null},\"n\":[', user_id, ',', user_id + 1, ']}')", "event_id")
    return _parsed(lines, "rule j { (json) }", {"a_b": ("a/b", "chars"), "n0": ("n[0]", "digit"), "n1": ("n[1]", "digit")}, "event_id")


@query("SELECT event_id, 'ok' AS status, user_id AS uid, event_type AS kind FROM events")
def parse_kv(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('user=', user_id, ' type:', event_type)", "event_id")
    return _parsed(lines, "rule k { (kv(digit@user:uid), kv(chars@type:kind)) }", {"uid": "digit", "kind": "chars"}, "event_id")


@query("SELECT event_id, 'ok' AS status, user_id AS u, event_type AS t, user_id AS d0, event_id AS d1, true AS b FROM events")
def parse_kvarr(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('u=', user_id, ' t=\"', event_type, '\" d=', user_id, ', d=', event_id, ' b=true')", "event_id")
    return _parsed(lines, "rule k { (kvarr) }", {"u": "digit", "t": "chars", "d0": ("d[0]", "digit"), "d1": ("d[1]", "digit"), "b": "bool"}, "event_id")


@query("SELECT o_orderkey, 'ok' AS status, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr FROM orders")
def parse_separator(spark, sf):
    lines = _lines(table(spark, sf, "orders"), "concat(o_orderkey, ',', o_orderstatus, ',', o_orderpriority)", "o_orderkey")
    return _parsed(lines, r"rule s { (digit:k, chars:st, chars:pr)\, }", {"k": "digit", "st": "chars", "pr": "chars"}, "o_orderkey")


@query("SELECT event_id, 'ok' AS status, event_type AS a, user_id AS b FROM events")
def parse_separator_pattern(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat(event_type, '   ==> id=', user_id)", "event_id")
    return _parsed(lines, r"rule s { (chars:a{\s==>\s}, kv(digit@id:b)) }", {"a": "chars", "b": "digit"}, "event_id")


@query("SELECT event_id, 'ok' AS status, event_type AS a, user_id AS b FROM events")
def parse_separator_preserve(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat(event_type, ' key=', user_id)", "event_id")
    return _parsed(lines, r"rule s { (chars:a{*(key=)}, kv(digit@key:b)) }", {"a": "chars", "b": "digit"}, "event_id")


@query("SELECT event_id, 'ok' AS status, user_id AS a, event_type || ' x' AS b FROM events")
def parse_scope(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('[', user_id, '] \"', event_type, ' x\"')", "event_id")
    return _parsed(lines, 'rule s { (digit:a<[,]>, chars:b") }', {"a": "digit", "b": "chars"}, "event_id")


@query("SELECT event_id, 'ok' AS status, CASE WHEN event_id % 2 = 0 THEN user_id END AS n, CASE WHEN event_id % 2 <> 0 THEN event_type END AS c FROM events")
def parse_alt(spark, sf):
    lines = _lines(table(spark, sf, "events"), "if(event_id % 2 = 0, cast(user_id as string), event_type)", "event_id")
    return _parsed(lines, "rule g { alt(digit:n, chars:c) }", {"n": "digit", "c": "chars"}, "event_id")


@query("SELECT event_id, 'ok' AS status, CASE WHEN event_id % 2 = 0 THEN user_id END AS n, event_type AS c FROM events")
def parse_opt(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat(if(event_id % 2 = 0, concat(user_id, ' '), ''), event_type)", "event_id")
    return _parsed(lines, "rule g { opt(digit:n), (chars:c) }", {"n": "digit", "c": "chars"}, "event_id")


@query("SELECT event_id, 'ok' AS status, user_id AS n, '10.0.0.' || (event_id % 200) AS i FROM events")
def parse_some_of(spark, sf):
    lines = _lines(table(spark, sf, "events"), "if(event_id % 2 = 0, concat('10.0.0.', event_id % 200, ' n=', user_id), concat('n=', user_id, ' 10.0.0.', event_id % 200))", "event_id")
    return _parsed(lines, "rule g { some_of(ip:i, kv(digit@n:n)) }", {"n": "digit", "i": "ip"}, "event_id")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'miss' ELSE 'ok' END AS status, CASE WHEN event_type <> 'click' THEN event_type END AS c FROM events")
def parse_not(spark, sf):
    return _parsed(_lines(table(spark, sf, "events"), "event_type", "event_id"), r"rule g { not(symbol(click)), (chars:c\0) }", {"c": "chars"}, "event_id")


@query("SELECT event_id, 'ok' AS status, user_id AS a, event_id AS b FROM events")
def parse_nested_group(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('<', user_id, '|', event_id, '>')", "event_id")
    return _parsed(lines, r"rule g { (chars:body<<,>> | (digit:a\|, digit:b)) }", {"a": "digit", "b": "digit"}, "event_id")


@query("SELECT event_id, 'ok' AS status, '[' || user_id || ',' || event_id || ']' AS xs FROM events")
def parse_array(spark, sf):
    return _parsed(_lines(table(spark, sf, "events"), "concat('[', user_id, ', ', event_id, ']')", "event_id"), "rule a { (array/digit:xs) }", {"xs": "chars"}, "event_id")


@query("SELECT event_id, 'ok' AS status, user_id AS u, event_type AS t FROM events")
def parse_proto_text(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('user { id: ', user_id, ' kind { name: \"', event_type, '\" } }')", "event_id")
    return _parsed(lines, "rule p { (proto_text) }", {"u": ("user/id", "digit"), "t": ("user/kind/name", "chars")}, "event_id")


@query("SELECT event_id, 'ok' AS status, date_trunc('second', ts) AS a, date_trunc('second', ts) AS b, date_trunc('second', ts) AS c, date_trunc('second', ts) AS d FROM events")
def parse_times(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00,', date_format(ts, 'd MMM yyyy HH:mm:ss'), ' +0000,', date_format(ts, 'yyyy/M/d H:m:s'), ',', unix_timestamp(ts))", "event_id")
    return _parsed(lines, r"rule t { (time_iso:a, time_2822:b, time:c, time_timestamp:d)\, }", {"a": "time", "b": "time", "c": "time", "d": "time"}, "event_id")


@query("SELECT event_id, 'ok' AS status, lower(hex(event_id)) AS h, 'SN-' || event_id AS s, event_id % 2 = 0 AS b, event_id / 4.0::DOUBLE AS f, '10.0.0.0/' || (8 + event_id % 20) AS n, event_type AS q FROM events")
def parse_scalars(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('0x', hex(event_id), ' SN-', event_id, if(event_id % 2 = 0, ' True ', ' 0 '), event_id div 4, '.', lpad(cast((event_id % 4) * 25 as string), 2, '0'), ' 10.0.0.0/', 8 + event_id % 20, ' ', base64(encode(event_type, 'UTF-8')))", "event_id")
    return _parsed(lines, "rule x { (hex:h, sn:s, bool:b, float:f, ip_net:n, base64:q) }", {"h": "chars", "s": "chars", "b": "bool", "f": "float", "n": "chars", "q": "chars"}, "event_id")


@query("SELECT event_id, 'ok' AS status, CASE WHEN event_id % 3 = 0 THEN user_id::DOUBLE END AS f, CASE event_id % 3 WHEN 0 THEN 'float' WHEN 1 THEN 'ip' ELSE 'chars' END AS kind FROM events")
def parse_auto(spark, sf):
    lines = _lines(table(spark, sf, "events"), "case event_id % 3 when 0 then cast(user_id as string) when 1 then '10.1.1.1' else event_type end", "event_id")
    out = parse_events(lines, "rule a { (auto:v) }")
    kind = F.get(F.col("parsed.fields"), F.lit(0))["type"]
    return out.select("event_id", F.col("parsed.status").alias("status"), F.when(kind == "float", field("v", "float")).alias("f"), kind.alias("kind"))


@query("SELECT event_id, 'ok' AS status, user_id AS u, event_type AS t FROM events")
def payload_base64(spark, sf):
    lines = _lines(table(spark, sf, "events"), "base64(encode(concat(user_id, ' ', event_type), 'UTF-8'))", "event_id")
    return _parsed(lines, "rule b { |decode/base64| (digit:u, chars:t) }", {"u": "digit", "t": "chars"}, "event_id")


@query("SELECT event_id, 'ok' AS status, user_id AS u, event_type AS t FROM events")
def payload_hex(spark, sf):
    lines = _lines(table(spark, sf, "events"), "hex(encode(concat(user_id, ' ', event_type), 'UTF-8'))", "event_id")
    return _parsed(lines, "rule b { |decode/hex| (digit:u, chars:t) }", {"u": "digit", "t": "chars"}, "event_id")


@query("SELECT event_id, 'ok' AS status, user_id AS u, event_type AS t FROM events")
def payload_unescape(spark, sf):
    lines = _lines(table(spark, sf, "events"), r"""concat('﻿{\\"u\\":', user_id, ',\\"t\\":\\"', event_type, '\\"}')""", "event_id")
    return _parsed(lines, "rule b { |strip/bom|unquote/unescape| (json(digit@u, chars@t)) }", {"u": "digit", "t": "chars"}, "event_id")


@query("SELECT doc_id, replace(replace(text, '\"', ''), chr(92), '') AS plain, text AS coded FROM documents")
def payload_steps(spark, sf):
    docs = table(spark, sf, "documents")
    coded = step("decode/base64").column(F.base64(F.encode("text", "UTF-8")))
    return docs.select("doc_id", step("unquote/unescape").column(F.col("text")).alias("plain"), step("strip/bom").column(coded).alias("coded"))


_FIELD_RULES = {
    "chars_has(click)": "event_type = 'click'",
    "chars_not_has(click)": "event_type <> 'click'",
    "chars_in([click, view])": "event_type IN ('click', 'view')",
    'regex_match("^[cv]")': "event_type SIMILAR TO '[cv].*'",
    "f_chars_has(t, click)": "event_type = 'click'",
    "not(chars_has(click))": "event_type <> 'click'",
    "has()": "true",
    "not(f_has(zz))": "false",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {v}) AS n FROM events" for k, v in _FIELD_RULES.items()))
def field_predicates_chars(spark, sf):
    events = _lines(table(spark, sf, "events"), "event_type", "event_id")
    out = None
    for k in _FIELD_RULES:
        one = parse_events(events, f"rule f {{ (chars:t\\0 | {k}) }}").select(F.lit(k).alias("rule"), (F.col("parsed.status") == "ok").cast("long").alias("n")).groupBy("rule").agg(F.sum("n").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_DIGIT_RULES = {
    "digit_has(7)": "user_id = 7",
    "digit_in([1, 2, 3])": "user_id IN (1, 2, 3)",
    "digit_range(5, 50)": "user_id BETWEEN 5 AND 50",
    "f_digit_has(u, 7)": "user_id = 7",
    "f_digit_in(u, [1, 2])": "user_id IN (1, 2)",
    "not(digit_has(7))": "user_id <> 7",
    "take(u) | digit_range(5, 50)": "user_id BETWEEN 5 AND 50",
    "last() | chars_has(x)": "false",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {v}) AS n FROM events" for k, v in _DIGIT_RULES.items()))
def field_predicates_digit(spark, sf):
    events = _lines(table(spark, sf, "events"), "cast(user_id as string)", "event_id")
    out = None
    for k in _DIGIT_RULES:
        one = parse_events(events, f"rule f {{ (digit:u | {k}) }}").select(F.lit(k).alias("rule"), (F.col("parsed.status") == "ok").cast("long").alias("n")).groupBy("rule").agg(F.sum("n").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN 'ok' ELSE 'miss' END AS status FROM events")
def field_predicates_ip(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('10.0.0.', event_id % 4)", "event_id")
    return _parsed(lines, "rule f { (ip:i | ip_in([10.0.0.1, 10.0.0.2])) }", {}, "event_id")


@query("SELECT event_id, 'ok' AS status, CASE WHEN starts_with(event_type, 'c') THEN event_type END AS t, true AS there FROM events")
def field_starts_with(spark, sf):
    out = parse_events(_lines(table(spark, sf, "events"), "event_type", "event_id"), "rule f { (chars:t\\0 | starts_with('c') | has()) }")
    return out.select("event_id", F.col("parsed.status").alias("status"), field("t").alias("t"), present("t").alias("there"))


@query("SELECT event_id, 'ok' AS status, 'a\"' || event_type AS j, event_type AS b, replace(event_type, 'c', 'K') AS r FROM events")
def field_transforms(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('a\\\\\"', event_type, ',', base64(encode(event_type, 'UTF-8')), ',', event_type)", "event_id")
    return _parsed(lines, r"rule f { (chars:j | json_unescape(), chars:b | base64_decode(), chars:r | chars_replace(c, K))\, }", {"j": "chars", "b": "chars", "r": "chars"}, "event_id")


_MIXED = "case event_id % 4 when 0 then concat('A ', user_id) when 1 then concat('B ', event_type, ' 12345678901234567890 x') when 2 then '   ' else concat('B ', event_type) end"
_MIXED_RULES = r"package /m { rule a { (symbol(A), digit:n) } rule b { (symbol(B), chars:t) } }"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'miss' WHEN 2 THEN 'blank' ELSE 'ok' END AS status, CASE event_id % 4 WHEN 0 THEN '/m/a' WHEN 2 THEN NULL ELSE '/m/b' END AS rule FROM events")
def rule_select(spark, sf):
    out = parse_events(_lines(table(spark, sf, "events"), _MIXED, "event_id"), _MIXED_RULES)
    return out.select("event_id", F.col("parsed.status").alias("status"), F.col("parsed.rule").alias("rule"))


@query("SELECT '/m/b' AS rule, count(*) AS n FROM events WHERE event_id % 4 = 1")
def rule_miss(spark, sf):
    out = parse_events(_lines(table(spark, sf, "events"), _MIXED, "event_id"), _MIXED_RULES)
    return infra_streams(out)["miss"].groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'rule:/r,residue:' || (event_id % 10) AS line FROM events")
def rule_residue(spark, sf):
    out = parse_events(_lines(table(spark, sf, "events"), "concat('0123456789012345 ', event_id % 10)", "event_id"), "rule r { (chars:t) }")
    return infra_streams(out)["residue"]


@query("SELECT event_id, user_id::VARCHAR AS raw, 'v' AS k, 'src1' AS from_source, 'v' AS tagged FROM events")
def rule_annotations(spark, sf):
    lines = _lines(table(spark, sf, "events"), "cast(user_id as string)", "event_id").withColumn("tags", F.expr("map('k', 'ignored', 'host', 'src1')"))
    out = with_source_tags(parse_events(lines, '#[tag(k:"v"), copy_raw(name:"raw")] rule r { (digit:n) }'))
    return out.select("event_id", field("raw").alias("raw"), field("k").alias("k"), field("host").alias("from_source"), field("k").alias("tagged"))


# -- object models


def _model(spark, sf, name, keys, body, knowledge=None, view=None, now=None):
    df = table(spark, sf, name)
    if view:
        df = df.selectExpr(*view)
    return apply_model(df, f"name : q\n---\n{body}", knowledge, now, keep=keys)


@query("SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 1 AND 50 THEN 'low' WHEN o_custkey BETWEEN 51 AND 100 THEN 'mid' ELSE 'high' END AS band FROM orders")
def model_match_range(spark, sf):
    return _model(spark, sf, "orders", ("o_orderkey",), "band = match read(o_custkey) { in (digit(1), digit(50)) => chars(low) ; in (digit(51), digit(100)) => chars(mid) ; _ => chars(high) ; } ;")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 WHEN c_mktsegment <> 'AUTOMOBILE' THEN 2 ELSE 3 END AS tier FROM customer")
def model_match_or(spark, sf):
    return _model(spark, sf, "customer", ("c_custkey",), "tier = match read(c_mktsegment) { chars(BUILDING) | chars(MACHINERY) => digit(1) ; !chars(AUTOMOBILE) => digit(2) ; _ => digit(3) ; } ;")


@query("SELECT event_id, CASE WHEN event_type = 'click' AND user_id BETWEEN 1 AND 100 THEN 'a' WHEN event_type IN ('view', 'click') AND user_id = 200 THEN 'b' ELSE 'c' END AS z FROM events")
def model_match_multi(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "z = match (read(event_type), read(user_id)) { (chars(click), in (digit(1), digit(100))) => chars(a) ; (chars(view) | chars(click), digit(200)) => chars(b) ; _ => chars(c) ; } ;")


@query("""SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'sw' WHEN ends_with(p_type, 'STEEL') THEN 'ew' WHEN contains(p_type, 'BRASS') THEN 'co' WHEN regexp_matches(p_type, 'P[A-Z]+D') THEN 're' WHEN lower(p_brand) = 'brand#11' THEN 'ie' WHEN p_type = '' THEN 'em' ELSE 'no' END AS f,
  CASE WHEN p_size > 40 THEN 'gt' WHEN p_size < 5 THEN 'lt' WHEN p_size = 20 THEN 'eq' WHEN p_size BETWEEN 10 AND 15 THEN 'ir' ELSE 'no' END AS n FROM part""")
def model_match_functions(spark, sf):
    return _model(spark, sf, "part", ("p_partkey",), """__g = match read(p_brand) { iequals(BRAND#11) => chars(ie) ; _ => chars(no) ; } ;
__h = match read(p_type) { is_empty() => chars(em) ; _ => chars(no) ; } ;
f = match (read(p_type), read(__g), read(__h)) { (starts_with(STANDARD), chars(ie) | chars(no), chars(no)) => chars(sw) ; (ends_with(STEEL), chars(ie) | chars(no), chars(no)) => chars(ew) ; (contains(BRASS), chars(ie) | chars(no), chars(no)) => chars(co) ; (regex_match('P[A-Z]+D'), chars(ie) | chars(no), chars(no)) => chars(re) ; (regex_match('.*'), chars(ie), chars(no)) => chars(ie) ; (is_empty(), chars(ie) | chars(no), chars(em)) => chars(em) ; _ => chars(no) ; } ;
n = match read(p_size) { gt(40) => chars(gt) ; lt(5) => chars(lt) ; eq(20) => chars(eq) ; in_range(10, 15) => chars(ir) ; _ => chars(no) ; } ;""")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS who, 'none' AS lost, c_custkey AS n FROM customer")
def model_option_default(spark, sf):
    return _model(spark, sf, "customer", ("c_custkey",), "who = take(option:[a, b]) ; lost : chars = read(nowhere) { _ : chars(none) } ; n : digit = read(c) { _ : digit(0) } ;", view=["c_custkey", "if(c_custkey % 2 = 0, c_name, '') AS a", "c_mktsegment AS b", "cast(c_custkey as string) AS c"])


@query("SELECT p_partkey, '{\"name\":\"' || p_name || '\",\"size\":' || p_size || '}' AS o, p_brand || ',' || p_type AS xs, p_size::BIGINT AS size FROM part")
def model_object_collect(spark, sf):
    out = _model(spark, sf, "part", ("p_partkey",), "__o : obj = object { name : chars = read(p_name) ; size : digit = read(p_size) ; } ; o = read(__o) | to_json ; xs = collect read(keys:[p_b*, p_t*]) ; size = read(__o) | get(size) ;")
    return out.select("p_partkey", "o", F.array_join("xs", ",").alias("xs"), F.col("size").cast("long").alias("size"))


@query("SELECT n_nationkey, n_name || '-' || n_regionkey AS a, '' AS b FROM nation")
def model_fmt(spark, sf):
    return _model(spark, sf, "nation", ("n_nationkey",), 'a = fmt("{n_name}-{n_regionkey}", @n_name, read(n_regionkey)) ; b = fmt("{x}", read(x)) ;')


@query("SELECT doc_id, base64(encode(text)) AS e, text AS d FROM documents")
def model_base64(spark, sf):
    return _model(spark, sf, "documents", ("doc_id",), "e = read(text) | base64_encode ; d = read(text) | base64_encode | base64_decode(Utf8) ;").withColumn("e", F.regexp_replace("e", "\r\n", ""))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;') AS e, text AS d FROM documents")
def model_html(spark, sf):
    return _model(spark, sf, "documents", ("doc_id",), "e = read(text) | html_escape ; d = read(text) | html_escape | html_unescape ;")


@query("SELECT conv_id, turn, to_json(text)::VARCHAR AS j, text AS d FROM conversations")
def model_json_text(spark, sf):
    return _model(spark, sf, "conversations", ("conv_id", "turn"), "j = read(text) | to_json ; d = read(text) | json_escape | json_unescape ;")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '\\?([^#]*)', 1) AS params FROM pages""")
def model_url(spark, sf):
    return _model(spark, sf, "pages", ("page_id",), "domain = read(url) | url(domain) ; host = read(url) | url(host) ; path = read(url) | url(path) ; params = read(url) | url(params) ;")


@query("SELECT event_id, event_type || '.log' AS name, '/var/' || user_id AS parent FROM events")
def model_path(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "name = read(p) | path(name) ; parent = read(p) | path(path) ;", view=["event_id", "concat('/var/', user_id, '\\\\', event_type, '.log') AS p"])


@query("SELECT event_id, epoch(ts)::BIGINT - 28800 AS a, epoch_ms(ts) - 28800000 AS b, epoch_us(ts) - 28800000000 AS c, epoch_ms(ts) + 10800000 AS d FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def model_time(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "a = read(ts) | Time::to_ts ; b = read(ts) | Time::to_ts_ms ; c = read(ts) | Time::to_ts_us ; d = read(ts) | Time::to_ts_zone(-3, ms) ;", view=["event_id", "date_trunc('second', ts)::timestamp_ntz AS ts"])


@query("SELECT event_id, event_type AS first, CASE WHEN user_id % 2 = 1 THEN 1 END AS odd, CASE WHEN starts_with(event_type, 'c') THEN 'C' END AS c, CASE WHEN user_id NOT IN (0, 7) THEN user_id END AS some, user_id::VARCHAR AS s, 167772160 + user_id % 256 AS ip FROM events")
def model_values(spark, sf):
    return _model(spark, sf, "events", ("event_id",), """__xs = collect read(keys:[event_type, s]) ; first = read(__xs) | nth(0) ; odd = read(odd) | map_to(1) ;
c = read(event_type) | starts_with('c') | map_to('C') ; some = read(some) | skip_empty ; s = read(user_id) | to_str ; __ip : ip = read(ip) ; ip = read(__ip) | ip4_to_int ;""", view=["event_id", "event_type", "user_id", "cast(user_id as string) AS s", "if(user_id % 2 = 1, user_id, null) AS odd", "if(user_id = 7, 0, user_id) AS some", "concat('10.0.0.', user_id % 256) AS ip"])


@query("SELECT s_suppkey AS k, s_name AS title, 'k1' AS fixed, s_nationkey, s_acctbal FROM supplier")
def model_static_temp_wildcard(spark, sf):
    return _model(spark, sf, "supplier", (), "static { K : chars = chars(k1) ; } __n = take(s_name) ; k = take(s_suppkey) ; title = read(__n) ; fixed = K ; * = take() ;")


@query("SELECT n_nationkey, 20240102 AS d, 2024010203 AS h, TIMESTAMP '2024-01-02 03:04:05' AS t FROM nation")
def model_now(spark, sf):
    return _model(spark, sf, "nation", ("n_nationkey",), "d = Now::date() ; h = Now::hour() ; t = Now::time() ;", now=F.expr("timestamp_ntz'2024-01-02 03:04:05'"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS d, user_id / 2.0::DOUBLE AS f, CASE event_id % 2 WHEN 0 THEN true END AS b, '1.2.3.' || (event_id % 300) AS text, CASE WHEN event_id % 300 < 256 THEN '1.2.3.' || (event_id % 300) END AS ip FROM events")
def model_convert(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "d : digit = read() ; f : float = read() ; b : bool = read() ; text : chars = read(ip) ; ip : ip = read() ;", view=["event_id", "if(event_id % 2 = 0, cast(user_id as string), 'x') AS d", "cast(user_id / 2.0D as string) AS f", "if(event_id % 2 = 0, 'TRUE', 'maybe') AS b", "concat('1.2.3.', event_id % 300) AS ip"])


# -- lookups


def _knowledge(spark, sf):
    bands = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) * 40 AS low", "cast(n_nationkey as bigint) * 40 + 39 AS high", "n_name AS band")
    zones = table(spark, sf, "nation").selectExpr("167772160 + cast(n_nationkey as bigint) * 10 AS start_ip", "167772160 + cast(n_nationkey as bigint) * 10 + 14 AS end_ip", "n_name AS zone")
    return Knowledge(spark).add("nation", table(spark, sf, "nation"), ["n_nationkey"]).add("customer", table(spark, sf, "customer"), ["c_custkey"]).add("bands", bands, ["low"]).add("zones", zones, ["start_ip"])


@query("SELECT o_orderkey, c_name AS who, c_mktsegment AS seg FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def lookup_equal(spark, sf):
    return _model(spark, sf, "orders", ("o_orderkey",), "who, seg = select c_name, c_mktsegment from customer where c_custkey = read(o_custkey) ;", _knowledge(spark, sf))


@query("SELECT o_orderkey, (SELECT arg_min(c_name, c_custkey) FROM customer WHERE c_nationkey = o_custkey % 30) AS who FROM orders")
def lookup_first_row(spark, sf):
    return _model(spark, sf, "orders", ("o_orderkey",), "who = select c_name from customer where c_nationkey = read(k) ;", _knowledge(spark, sf), view=["o_orderkey", "o_custkey % 30 AS k"])


@query("SELECT event_id, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE n_nationkey * 40 <= user_id AND n_nationkey * 40 + 39 >= user_id) AS band FROM events")
def lookup_range(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "band = select band from bands where low <= read(user_id) and high >= read(user_id) ;", _knowledge(spark, sf))


@query("SELECT event_id, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE 167772160 + n_nationkey * 10 <= 167772160 + event_id % 256 AND 167772160 + n_nationkey * 10 + 14 >= 167772160 + event_id % 256) AS zone FROM events")
def lookup_ip_zone(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "zone = select zone from zones where start_ip <= ip4_int(read(ip)) and end_ip >= ip4_int(read(ip)) ;", _knowledge(spark, sf), view=["event_id", "concat('10.0.0.', event_id % 256) AS ip"])


@query("SELECT o_orderkey, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE (n_regionkey = o_custkey % 7 OR n_nationkey = o_custkey % 40) AND NOT n_name = 'NATION_1') AS n FROM orders")
def lookup_condition(spark, sf):
    return _model(spark, sf, "orders", ("o_orderkey",), "n = select n_name from nation where (n_regionkey = read(a) or n_nationkey = read(b)) and not n_name = 'NATION_1' ;", _knowledge(spark, sf), view=["o_orderkey", "o_custkey % 7 AS a", "o_custkey % 40 AS b"])


@query("SELECT event_id, 167772160 + event_id % 256 AS n, '10.0.0.' || (event_id % 256) AS t, CASE WHEN event_id % 256 BETWEEN 3 AND 9 THEN 1 ELSE 0 END AS b, 0 AS bad, 'x' AS q FROM events")
def sql_ip4(spark, sf):
    ip = F.expr("concat('10.0.0.', event_id % 256)")
    return table(spark, sf, "events").select("event_id", net.ip4_int(ip).alias("n"), net.ip4_text(net.ip4_int(ip)).alias("t"), net.ip4_between(ip, F.lit("10.0.0.3"), F.lit(167772169)).alias("b"), net.ip4_int(F.lit("10.0.0.999")).cast("int").alias("bad"), net.trim_quotes(F.lit("\"x\"")).alias("q"))


@query("SELECT event_id, 167772160 + (event_id % 200) * 256 AS low, 167772160 + (event_id % 200) * 256 + 255 AS high, CASE WHEN event_id % 200 = 7 THEN 1 ELSE 0 END AS inside FROM events")
def sql_cidr(spark, sf):
    block = F.expr("concat('10.0.', event_id % 200, '.9/24')")
    return table(spark, sf, "events").select("event_id", net.cidr4_min(block).alias("low"), net.cidr4_max(block).alias("high"), net.cidr4_contains(F.lit("10.0.7.77"), block).alias("inside"))


# -- filters, routing, counters

_FILTER = "($event_type == chars(click) || $event_type =* chars(v*)) && !($user_id > digit(500)) && isset($ts)"


@query("SELECT event_id FROM events WHERE (event_type = 'click' OR event_type LIKE 'v%') AND NOT user_id > 500")
def filter_rows(spark, sf):
    df = table(spark, sf, "events")
    return df.where(filter_expression(_FILTER, record(df))).select("event_id")


@query("SELECT count(*) FILTER (WHERE false) AS a, count(*) AS b, count(*) FILTER (WHERE value >= 10.5) AS c, 0 AS d FROM events")
def filter_type_rules(spark, sf):
    df = table(spark, sf, "events")
    r = record(df)
    n = lambda t: F.sum(filter_expression(t, r).cast("long"))
    return df.agg(n("$user_id == float(1.0)").alias("a"), n("!($nowhere != digit(1))").alias("b"), n("$value >= float(10.5)").alias("c"), n("$nowhere != digit(1)").cast("int").alias("d"))


_GROUP = SinkGroup("g", ("/web/*",), (), (Sink("clicks", "$event_type == chars(click)", True, (("k", "v"),)), Sink("others", "$event_type == chars(click)", False), Sink("all"), Sink("two", None, True, (), 2)))


@query("SELECT sink, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'clicks' ELSE 'others' END AS sink FROM events UNION ALL SELECT 'all' FROM events UNION ALL SELECT 'two#' || (event_id % 2) FROM events) GROUP BY sink")
def route_fan_out(spark, sf):
    return fan_out(table(spark, sf, "events"), _GROUP, "event_id").groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 'v' AS k FROM events WHERE event_type = 'click'")
def route_filter_tags(spark, sf):
    return for_sink(table(spark, sf, "events"), _GROUP.sinks[0]).select("event_id", "k")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'narrow' WHEN o_orderkey % 3 = 1 THEN 'wide' ELSE 'default' END AS grp FROM orders")
def route_rules(spark, sf):
    routes = Routes([SinkGroup("wide", ("/web/*",)), SinkGroup("narrow", ("/web/access*",))])
    rule = F.expr("case o_orderkey % 3 when 0 then '/web/access' when 1 then '/web/error' else '/sys/x' end")
    return table(spark, sf, "orders").select("o_orderkey", routes.column(rule, ["/web/access", "/web/error", "/sys/x"]).alias("grp"))


@query("SELECT 'pick' AS stage, 'c' AS name, 'all' AS target, event_type, '*' AS lost, count(*) AS total, count(*) FILTER (WHERE user_id < 300) AS success, count(*) FILTER (WHERE user_id < 300) * 100.0 / count(*) AS suc_rate FROM events GROUP BY event_type")
def stat_counters(spark, sf):
    return stats.counters(table(spark, sf, "events"), stats.Request("c", "pick", ("event_type", "lost")), F.col("user_id") < 300)


@query("SELECT 'parse' AS stage, 't' AS name, 'all' AS target, l_suppkey::VARCHAR AS l_suppkey, count(*) AS total, count(*) AS success, 100.0::DOUBLE AS suc_rate FROM lineitem GROUP BY l_suppkey ORDER BY total DESC, l_suppkey LIMIT 20")
def stat_top(spark, sf):
    return stats.counters(table(spark, sf, "lineitem"), stats.Request("t", "parse", ("l_suppkey",), top=10))


@query("SELECT 's' AS name, date_trunc('hour', ts) AS beg, count(*) AS total, min(ts) AS beg_time, max(ts) AS end_time FROM events GROUP BY date_trunc('hour', ts)")
def stat_window(spark, sf):
    out = stats.counters(table(spark, sf, "events"), stats.Request("s"), at="ts", window="1 hour")
    return out.select("name", F.col("slice.start").cast("timestamp_ntz").alias("beg"), "total", "beg_time", "end_time")


@query("SELECT 'pick' AS stage, 'm' AS name, 'all' AS target, event_type, count(*) AS total, count(*) FILTER (WHERE user_id < 300) AS success, count(*) FILTER (WHERE user_id < 300) * 100.0 / count(*) AS suc_rate FROM events GROUP BY event_type")
def stat_merge(spark, sf):
    events = table(spark, sf, "events")
    r = stats.Request("m", "pick", ("event_type",))
    return stats.merge([stats.counters(events.where(F.col("event_id") % 2 == k), r, F.col("user_id") < 300) for k in (0, 1)], ["event_type"])


@query("SELECT event_type AS name, 'high' AS severity FROM events GROUP BY event_type HAVING count(*) > 10")
def stat_alert(spark, sf):
    c = stats.counters(table(spark, sf, "events"), stats.Request("a", "pick", ("event_type",)))
    return stats.alert(c, "$total > digit(10)", "high", "many").select(F.col("event_type").alias("name"), "severity")


@query("SELECT event_type AS sink, count(*) AS \"rows\", count(*) * 1.0::DOUBLE / (SELECT count(*) FROM events) AS ratio, event_type <> 'click' AS ok, CASE WHEN event_type = 'click' THEN 'ratio' END AS reason FROM events GROUP BY event_type")
def expect_ratio(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("sink")).agg(F.count(F.lit(1)).alias("rows"))
    return stats.check_ratios(counts, {"click": stats.Expect(0.99, 0.001), "view": stats.Expect(least=0.0, most=1.0)})


# -- sources and sinks


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '5424' WHEN 1 THEN '3164' ELSE 'raw' END AS form, CASE WHEN event_id % 3 < 2 THEN 165 END AS pri, CASE WHEN event_id % 3 < 2 THEN 20 END AS facility, CASE WHEN event_id % 3 < 2 THEN 5 END AS severity, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'su: ' || event_type ELSE event_type END AS message FROM events")
def source_syslog(spark, sf):
    line = F.expr("case event_id % 3 when 0 then concat('<165>1 2003-10-11T22:14:15.003Z h app - ID47 [x a=\"1\"] ', event_type) when 1 then concat('<165>Oct 11 22:14:15 h su: ', event_type) else event_type end")
    return table(spark, sf, "events").select("event_id", normalise(line).alias("s")).select("event_id", "s.form", "s.pri", "s.facility", "s.severity", "s.message")


@query("SELECT doc_id, text AS b, text AS h, text AS t FROM documents")
def source_encodings(spark, sf):
    raw = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").select("doc_id", decoded(F.base64(raw), "base64").alias("b"), decoded(F.hex(raw), "hex").alias("h"), decoded(F.col("text"), "text").alias("t"))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS j, n_nationkey || ',' || n_name AS c, 'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name AS k, 'n_nationkey: ' || n_nationkey || ' n_name: \"' || n_name || '\"' AS p FROM nation")
def sink_formats(spark, sf):
    df = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return df.select(*[line(df.schema, f).alias(a) for a, f in {"j": "json", "c": "csv", "k": "kv", "p": "proto-text"}.items()])


@query()
def generate_round_trip(spark, sf):
    """Rows drawn from a rule parse again by it (random values: no SQL)."""
    from .operators.generate import from_rule

    rule = parse_rules(NGINX)[0]
    out = parse_events(from_rule(spark, rule, 5000, seed=3), [rule])
    return out.groupBy(F.col("parsed.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


# -- operators one by one, with odd, long and missing input


_ODD = """case event_id % 8 when 0 then null when 1 then '' when 2 then concat(user_id, ' "', repeat('x', 3000), '" end') when 3 then concat(repeat('7', 5000), ' "a" b') when 4 then concat(user_id, ' "open b')
when 5 then concat(user_id, ' "', repeat('q\\\\"', 900), '" end') when 6 then 'no number here' else concat(user_id, ' "', event_type, '" end') end"""


@query("SELECT event_id, CASE WHEN event_id % 8 < 2 THEN 'blank' WHEN event_id % 8 IN (2, 5, 7) THEN 'ok' ELSE 'miss' END AS status, CASE WHEN event_id % 8 IN (2, 5, 7) THEN user_id END AS n, CASE event_id % 8 WHEN 2 THEN 3000 WHEN 5 THEN 2700 WHEN 7 THEN length(event_type) END AS size FROM events")
def parse_odd_lines(spark, sf):
    """Null, empty, very long, unclosed and unfit lines through a regular rule."""
    out = parse_events(_lines(table(spark, sf, "events"), _ODD, "event_id"), 'rule odd { (digit:n, chars:t", chars:e) }')
    return out.select("event_id", F.col("parsed.status").alias("status"), field("n", "digit").alias("n"), F.char_length(field("t")).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 8 < 2 THEN 'blank' WHEN event_id % 8 IN (2, 5, 7) THEN 'ok' ELSE 'miss' END AS status, CASE WHEN event_id % 8 IN (2, 5, 7) THEN user_id END AS n, CASE event_id % 8 WHEN 2 THEN 3000 WHEN 5 THEN 2700 WHEN 7 THEN length(event_type) END AS size FROM events")
def parse_odd_lines_general(spark, sf):
    """The same lines through the general evaluator."""
    out = parse_events(_lines(table(spark, sf, "events"), _ODD, "event_id"), 'rule odd { (digit:n, chars:t", chars:e) }', native=False)
    return out.select("event_id", F.col("parsed.status").alias("status"), field("n", "digit").alias("n"), F.char_length(field("t")).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'miss' ELSE 'ok' END AS status, CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'PATCH' END AS m FROM events")
def parse_http_method(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat(case event_id % 3 when 0 then 'GET' when 1 then 'PATCH' else 'FETCH' end, ' ', user_id)", "event_id")
    return _parsed(lines, "rule m { (http/method:m, digit:n) }", {"m": "chars"}, "event_id")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'ok' ELSE 'miss' END AS status, CASE WHEN event_type = 'click' THEN 'click' || user_id END AS t FROM events")
def parse_peek_symbol(spark, sf):
    return _parsed(_lines(table(spark, sf, "events"), "concat(event_type, user_id)", "event_id"), "rule p { (peek_symbol(click), chars:t) }", {"t": "chars"}, "event_id")


@query("SELECT event_id, 1 + event_id % 5 AS fields, user_id AS first FROM events")
def parse_repeated_field(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat_ws(',', array_repeat(cast(user_id as string), cast(1 + event_id % 5 as int)))", "event_id")
    out = parse_events(lines, r"rule r { (*digit:n\,) }")
    return out.select("event_id", F.size("parsed.fields").cast("long").alias("fields"), field("n", "digit").alias("first"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'miss' END AS status FROM events")
def parse_json_depth(spark, sf):
    lines = _lines(table(spark, sf, "events"), "if(event_id % 2 = 0, concat('{\"a\":', user_id, '}'), concat('{\"a\":{\"b\":{\"c\":', user_id, '}}}'))", "event_id")
    return _parsed(lines, "rule d { (json[1]) }", {}, "event_id")


@query("SELECT event_id, 'ok' AS status, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (event_id % 256) END AS a, user_id AS b FROM events")
def parse_optional_member(spark, sf):
    lines = _lines(table(spark, sf, "events"), "concat('{\"a\":\"', if(event_id % 2 = 0, concat('10.0.0.', event_id % 256), 'none'), '\",\"b\":', user_id, '}')", "event_id")
    return _parsed(lines, "rule o { (json(opt(ip)@a, digit@b)) }", {"a": "chars", "b": "digit"}, "event_id")


@query("SELECT event_id, 'ok' AS status, event_type || ' ' || user_id AS a, 'p \\\" q' AS b FROM events")
def parse_quotes(spark, sf):
    lines = _lines(table(spark, sf, "events"), """concat('"', event_type, ' ', user_id, '" "p \\\\\\\\" q"')""".replace("\\\\\\\\", "\\\\"), "event_id")
    return _parsed(lines, 'rule q { (chars:a, chars:b") }', {"a": "chars", "b": "chars"}, "event_id")


_NAMED_RULES = {"f_chars_not_has(t, click)": "event_type <> 'click'", "f_chars_in(t, [click, view])": "event_type IN ('click', 'view')", "f_chars_not_has(zz, click)": "false"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {v}) AS n FROM events" for k, v in _NAMED_RULES.items()) + " UNION ALL SELECT 'f_ip_in' AS rule, count(*) FILTER (WHERE user_id % 4 IN (1, 2)) AS n FROM events")
def field_predicates_named(spark, sf):
    events = table(spark, sf, "events")
    out = parse_events(_lines(events, "concat('10.0.0.', user_id % 4)"), "rule f { (ip:i | f_ip_in(i, [10.0.0.1, 10.0.0.2])) }").select(F.lit("f_ip_in").alias("rule"), (F.col("parsed.status") == "ok").cast("long").alias("n"))
    for k in _NAMED_RULES:
        out = out.unionByName(parse_events(_lines(events, "event_type"), f"rule f {{ (chars:t\\0 | {k}) }}").select(F.lit(k).alias("rule"), (F.col("parsed.status") == "ok").cast("long").alias("n")))
    return out.groupBy("rule").agg(F.sum("n").alias("n"))


@query("SELECT event_id, user_id AS n, 'p' AS a, 'r' AS b, user_id::VARCHAR AS raw FROM events")
def rule_package_annotations(spark, sf):
    out = parse_events(_lines(table(spark, sf, "events"), "cast(user_id as string)", "event_id"), '#[tag(a:"p", b:"p")] package x { #[tag(b:"r"), copy_raw(name:"raw")] rule r { (digit:n) } }')
    return out.select("event_id", field("n", "digit").alias("n"), *[field(x).alias(x) for x in ("a", "b", "raw")])


@query("SELECT event_id, 'file' AS src_key, '10.0.0.' || (event_id % 9) AS src_ip, 'eu' AS zone FROM events")
def source_provenance(spark, sf):
    lines = _lines(table(spark, sf, "events"), "cast(user_id as string)", "event_id").selectExpr("*", "map('zone', 'eu') AS tags", "'file' AS key", "concat('10.0.0.', event_id % 9) AS peer")
    out = with_source_tags(parse_events(lines, "rule r { (digit:n) }"), source="key", ip="peer")
    return out.select("event_id", *[field(x).alias(x) for x in ("src_key", "src_ip", "zone")])


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'plain' END AS payload, CASE WHEN event_id % 2 = 0 THEN '165' END AS pri, CASE WHEN event_id % 2 = 0 THEN '20' END AS facility FROM events")
def source_syslog_tags(spark, sf):
    lines = _lines(table(spark, sf, "events"), "if(event_id % 2 = 0, concat('<165>1 2003-10-11T22:14:15.003Z h app - ID47 - ', event_type), 'plain')", "event_id")
    return header(lines, "tag").select("event_id", "payload", F.col("tags")["syslog.pri"].alias("pri"), F.col("tags")["syslog.facility"].alias("facility"))


@query("SELECT event_id, event_type AS first, NULL::VARCHAR AS none FROM events")
def value_nth(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "__xs = collect read(keys:[event_type, s]) ; first = read(__xs) | nth(0) ; none = read(__xs) | nth(7) ;", view=["event_id", "event_type", "cast(user_id as string) AS s"])


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS t, CASE WHEN user_id % 2 > 0 THEN user_id % 2 END AS n FROM events")
def value_skip_empty(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "t = read(t) | skip_empty ; n = read(n) | skip_empty ;", view=["event_id", "if(event_id % 3 > 0, event_type, '') AS t", "user_id % 2 AS n"])


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'even' END AS a, CASE WHEN event_id % 2 = 0 THEN 7 END AS b, CASE WHEN event_id % 2 = 0 THEN true END AS c FROM events")
def value_map_to(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "a = read(x) | map_to('even') ; b = read(x) | map_to(7) ; c = read(x) | map_to(true) ;", view=["event_id", "if(event_id % 2 = 0, event_type, null) AS x"])


@query("SELECT event_id, event_type || chr(92) || 't' || chr(92) || '\"' || chr(92) || chr(92) || chr(92) || 'n' || chr(92) || 'u{e9}' AS t FROM events")
def value_str_escape(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.concat("event_type", F.lit('\t"\\\né')).alias("x"))
    return apply_model(df, "name : q\n---\nt = read(x) | str_escape ;", keep=("event_id",))


@query("SELECT event_id, CASE WHEN starts_with(event_type, 'c') THEN event_type END AS t FROM events")
def value_starts_with(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "t = read(event_type) | starts_with('c') ;")


@query("SELECT event_id, user_id::VARCHAR AS s, CASE WHEN event_id % 300 < 256 THEN 167772160 + event_id % 300 END AS n FROM events")
def value_to_str_and_ip4(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "s = read(user_id) | to_str ; __i : ip = read(ip) ; n = read(__i) | ip4_to_int ;", view=["event_id", "user_id", "concat('10.0.', if(event_id % 300 < 256, '0', '999'), '.', event_id % 300) AS ip"])


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'hit' ELSE 'other' END AS z FROM events")
def model_match_static(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "static { K : chars = chars(click) ; } z = match read(event_type) { K => chars(hit) ; _ => chars(other) ; } ;")


@query("SELECT event_id, event_type AS t FROM events")
def model_privacy_section(spark, sf):
    return _model(spark, sf, "events", ("event_id",), "t = read(event_type) ;\n---\nt : privacy_ip\n")


@query("SELECT n_name AS name, n_regionkey * 2 AS twice, 167772160 + n_nationkey AS ip FROM nation WHERE n_regionkey > 1")
def knowledge_query(spark, sf):
    return _knowledge(spark, sf).query("SELECT n_name AS name, n_regionkey * 2 AS twice, ip4_int(concat('10.0.0.', n_nationkey)) AS ip FROM nation WHERE n_regionkey > 1")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS at, n_name AS value FROM nation")
def knowledge_values(spark, sf):
    return spark.createDataFrame(list(enumerate(_knowledge(spark, sf).values("nation", "n_name"))), "at int, value string")


@query("SELECT o_orderkey, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE n_nationkey * 1000 <= o_custkey AND n_nationkey * 1000 + power(10, n_nationkey % 7) >= o_custkey) AS n FROM orders")
def lookup_wide_ranges(spark, sf):
    """Ranges of widths from 1 to a million, which overlap."""
    bands = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) * 1000 AS low", "cast(n_nationkey as bigint) * 1000 + cast(power(10, n_nationkey % 7) as bigint) AS high", "n_name AS name", "n_nationkey AS k")
    knowledge = Knowledge(spark).add("wide", bands, ["k"])
    return _model(spark, sf, "orders", ("o_orderkey",), "n = select name from wide where low <= read(o_custkey) and high >= read(o_custkey) ;", knowledge)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'm1' WHEN o_orderkey % 3 = 1 THEN 'm2' END AS model, CASE WHEN o_orderkey % 3 = 0 THEN 'narrow' WHEN o_orderkey % 3 = 1 THEN 'wide' ELSE 'default' END AS grp FROM orders")
def route_models(spark, sf):
    """Rule to model, and model to sink group."""
    models = [parse_model(f"name : {n}\nrule : {r}\n---\na = read() ;") for n, r in (("m1", "/web/access*"), ("m2", "/web/*"))]
    routes = Routes([SinkGroup("wide", models=("m*",)), SinkGroup("narrow", models=("m1",))])
    out, group = F.lit(None).cast("string"), F.lit(routes.default)
    rule = F.expr("case o_orderkey % 3 when 0 then '/web/access' when 1 then '/web/error' else '/sys/x' end")
    for r in ("/web/access", "/web/error", "/sys/x"):
        m = model_of_rule(r, models)
        if m is not None:
            out, group = F.when(rule == r, F.lit(m.name)).otherwise(out), F.when(rule == r, F.lit(routes.group_of_model(m.name))).otherwise(group)
    return table(spark, sf, "orders").select("o_orderkey", out.alias("model"), group.alias("grp"))


@query("SELECT event_id, event_id % 2 = 0 AS filled, CASE WHEN event_id % 2 = 1 THEN 'empty' END AS kind FROM events")
def route_empty_results(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "if(event_id % 2 = 0, event_type, null) AS a", "cast(null as string) AS b")
    good, bad = empty_results(df, ["a", "b"])
    return good.selectExpr("event_id", "true AS filled", "cast(null as string) AS kind").unionByName(bad.selectExpr("event_id", "false AS filled", "__err_kind AS kind"))


@query("SELECT 'pick' AS stage, 'c' AS name, 'click' AS target, count(*) AS total, count(*) AS success, 100.0::DOUBLE AS suc_rate FROM events WHERE event_type = 'click'")
def stat_target(spark, sf):
    return stats.counters(table(spark, sf, "events"), stats.Request("c", "pick", target="click"), rule="event_type")


@query("SELECT 'parse' AS stage, 'r' AS name, 'all' AS target, event_type AS t, count(*) AS total, count(*) AS success, 100.0::DOUBLE AS suc_rate FROM events GROUP BY event_type")
def stat_records(spark, sf):
    """Counters of parsed fields as records, as the monitor output gets them."""
    engine = Engine.of("rule r { (digit:n, chars:t) }")
    parsed = engine.parse(_lines(table(spark, sf, "events"), "concat(user_id, ' ', event_type)"))
    return engine.monitor(parsed, stats.Request("r", "parse", ("t",)))


@query("SELECT 'show' AS form, n_nationkey, n_name FROM nation UNION ALL SELECT 'raw', n_nationkey, n_name FROM nation")
def sink_plain_formats(spark, sf):
    """Forms without a fixed layout hold every value."""
    df = table(spark, sf, "nation").select("n_nationkey", "n_name")
    out = None
    for form in ("show", "raw"):
        one = df.select(F.lit(form).alias("form"), "n_nationkey", F.when(F.contains(line(df.schema, form), F.col("n_name")), F.col("n_name")).alias("n_name"))
        out = one if out is None else out.unionByName(one)
    return out


# -- the flagship: lines -> fields -> model with lookup -> sinks


@query("""
SELECT sink, level, band, count(*) AS n, sum(size)::BIGINT AS bytes FROM (
  SELECT CASE WHEN event_id % 4 >= 2 THEN 'errors' ELSE 'good' END AS sink, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'moved' ELSE 'error' END AS level, coalesce((SELECT n_name FROM nation WHERE n_nationkey = user_id // 40), 'far') AS band, user_id AS size FROM events
) GROUP BY ALL""")
def access_pipeline(spark, sf):
    lines = _lines(table(spark, sf, "events"), ACCESS, "event_id")
    parsed = infra_streams(parse_events(lines, NGINX))["accepted"]
    fields = field_columns(parsed.drop("payload", "event_id"), {"src": "ip", "code": "http/status", "size": "digit", "req": "chars"})
    model = """name : access
rule : /web/*
---
level = match read(code) { in (digit(200), digit(299)) => chars(ok) ; in (digit(300), digit(399)) => chars(moved) ; _ => chars(error) ; } ;
__band = select band from bands where low <= read(size) and high >= read(size) ;
band = read(__band) { _ : chars(far) } ;
size = take() ;
"""
    records = apply_model(fields, model, _knowledge(spark, sf))
    group = SinkGroup("web", ("/web/*",), (), (Sink("errors", "$level == chars(error)"), Sink("good", "$level == chars(error)", False)))
    return fan_out(records, group).groupBy("sink", "level", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
