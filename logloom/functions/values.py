"""Value functions of object models: each takes a typed value and gives one. A wrong input type passes through."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .net import IPV4, ip4_int


@dataclass(frozen=True)
class Value:
    """A Spark expression with its model type: chars, digit, float, bool, ip, time, obj, array or auto."""

    column: Column
    kind: str = "auto"
    members: tuple[tuple[str, Value], ...] = ()


def kind_of(data: T.DataType) -> str:
    if isinstance(data, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "digit"
    if isinstance(data, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    return {T.BooleanType: "bool", T.TimestampNTZType: "time", T.TimestampType: "time", T.DateType: "time", T.ArrayType: "array", T.StructType: "obj", T.MapType: "obj"}.get(type(data), "chars")


_SPARK = {"digit": "bigint", "float": "double", "bool": "boolean", "chars": "string", "time": "timestamp_ntz"}


def convert(v: Value, kind: str | None) -> Value:
    """To a declared type: text is parsed, anything becomes text, other pairs stay as they are.

    Text that does not parse becomes null, since a column has one type.
    """
    if kind in (None, "auto", v.kind):
        return v
    if kind == "chars":
        return Value(F.to_json(v.column) if v.kind in ("obj", "array") else v.column.cast("string"), "chars")
    if v.kind in ("chars", "auto"):
        if kind == "ip":
            return Value(F.when(v.column.rlike(IPV4), v.column), "ip")
        if kind in _SPARK:
            text = F.trim(v.column)
            if kind == "bool":
                return Value(F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False), "bool")
            shape = {"digit": r"^[+-]?[0-9]+$", "float": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"}.get(kind)
            return Value(F.when(text.rlike(shape), text.try_cast(_SPARK[kind])) if shape else text.try_cast(_SPARK[kind]), kind)
    return v


def constant(kind: str, text: str) -> Value:
    text = text.strip()
    if kind == "digit":
        return Value(F.lit(int(text)).cast("bigint"), "digit")
    if kind == "float":
        return Value(F.lit(float(text)), "float")
    if kind == "bool":
        return Value(F.lit(text.lower() == "true"), "bool")
    if kind == "time":
        return Value(F.lit(text).cast("timestamp_ntz"), "time")
    return Value(F.lit(text), kind)


def _text(f: Callable[..., Column]) -> Callable[..., Value]:
    def apply(v: Value, *args) -> Value:
        return Value(f(v.column, *args), "chars") if v.kind in ("chars", "auto") else v

    return apply


#: Charsets that Spark decodes itself; the others go through Python's codecs.
JVM_CHARSETS = {"utf8": "UTF-8", "ascii": "US-ASCII", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE", "latin1": "ISO-8859-1", "iso88591": "ISO-8859-1"}
#: Charset names and Python's names for them; `imap` is modified UTF-7.
CODECS = {
    "gbk": "gbk", "gb18030": "gb18030", "gb2312": "gb2312", "hz": "hz", "big5": "big5", "big52003": "big5hkscs", "eucjp": "euc_jp", "iso2022jp": "iso2022_jp", "shiftjis": "shift_jis",
    "windows31j": "cp932", "euckr": "euc_kr", "windows949": "cp949", "mac": "mac_roman", "macroman": "mac_roman", "maccyrillic": "mac_cyrillic", "koi8r": "koi8_r", "koi8u": "koi8_u", "ibm866": "cp866",
    "windows874": "cp874", "windows1250": "cp1250", "windows1251": "cp1251", "windows1252": "cp1252", "windows1253": "cp1253", "windows1254": "cp1254", "windows1255": "cp1255", "windows1256": "cp1256",
    "windows1257": "cp1257", "windows1258": "cp1258", "iso88592": "iso8859_2", "iso88593": "iso8859_3", "iso88594": "iso8859_4", "iso88595": "iso8859_5", "iso88596": "iso8859_6", "iso88597": "iso8859_7",
    "iso88598": "iso8859_8", "iso885910": "iso8859_10", "iso885913": "iso8859_13", "iso885914": "iso8859_14", "iso885915": "iso8859_15", "iso885916": "iso8859_16", "imap": "imap",
}


def _imap(raw: bytes) -> str:
    return re.sub(r"&([^-]*)-", lambda m: "&" if not m[1] else ("+" + m[1].replace(",", "/") + "-").encode().decode("utf-7", "replace"), raw.decode("ascii", "replace"))


def base64_decode(c: Column, charset: str = "utf8") -> Column:
    """Text of base64 data; what is no base64 gives the empty string."""
    key = re.sub(r"[^a-z0-9]", "", charset.lower())
    raw = F.try_to_binary(c, F.lit("base64"))
    if key in JVM_CHARSETS:
        text = F.make_valid_utf8(raw.cast("string")) if key == "utf8" else F.decode(raw, JVM_CHARSETS[key])
        return F.when(c.isNotNull(), F.coalesce(text, F.lit("")))
    if key not in CODECS:
        raise ValueError(f"unknown charset {charset}")
    codec = CODECS[key]

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else _imap(bytes(b)) if codec == "imap" else bytes(b).decode(codec, "replace"))

    return F.when(c.isNotNull(), F.coalesce(decode(raw), F.lit("")))


import pandas as pd  # noqa: E402


def _map(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else f(s))

    return run


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def str_escape(c: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ("'", "\\'"), ('"', '\\"')):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    pieces = F.regexp_extract_all(c, F.lit(r"[\x20-\x7e]+|[^\x20-\x7e]"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^[\x20-\x7e]"), p).otherwise(F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(p))), F.lit("}")))), "")


def html_escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


#: Buckets of the table of HTML's named references, and the common ones that need no look at it.
_BUCKETS = 64
_COMMON = (("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("amp;", "&"), ("#x27;", "'"), ("#x2F;", "/"))


def _references() -> Column:
    """HTML's names and what they stand for, in buckets by the names' CRC."""
    buckets: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for name, text in html5.items():
        buckets[zlib.crc32(name.encode()) % _BUCKETS].append(f"{name}\x02{text}")
    return F.array(*[F.str_to_map(F.lit("\x01".join(b)), F.lit("\x01"), F.lit("\x02")) for b in buckets])


def html_unescape(c: Column) -> Column:
    """References of HTML 5 resolved as `html.unescape` of Python resolves them, in the JVM row by row: text that passes through
    Python's workers is held there by the batch."""
    table = _references()
    legacy = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    low = F.split(F.lit("\ue000".join(html.unescape(f"&#{n};") for n in range(160))), "\ue000")
    after = lambda p, n: F.substring(p, n + F.lit(1), F.length(p))

    def character(n: Column) -> Column:
        nothing = n.between(0xFDD0, 0xFDEF) | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
        one = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
        return F.when(n < 160, F.get(low, n.cast("int"))).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).when(nothing, F.lit("")).otherwise(one)

    def number(base: int) -> Callable[[Column], Column]:
        return lambda digits: F.when(F.length(digits) > 8, F.lit(0x110000).cast("bigint")).otherwise(F.conv(F.concat(F.lit("0"), digits), base, 10).cast("bigint"))

    def numeric(p: Column) -> Column:
        n = F.when(p.rlike("^#[xX]"), _let(F.regexp_extract(p, "^#[xX]0*([0-9a-fA-F]*)", 1), number(16))).otherwise(_let(F.regexp_extract(p, "^#0*([0-9]*)", 1), number(10)))
        return F.concat(_let(n, character), F.regexp_replace(p, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""))

    def named(p: Column) -> Column:
        head = F.substring(p, F.lit(1), F.lit(33))
        names = F.array(F.regexp_extract(head, r"^[^\t\n\f <&#;]{1,32};", 0), F.regexp_extract(head, f"^(?:{legacy})", 0))
        bucket = lambda name: F.get(table, F.pmod(F.crc32(name.cast("binary")), F.lit(_BUCKETS)).cast("int"))
        made = F.transform(names, lambda name: F.concat(F.try_element_at(bucket(name), name), after(p, F.length(name))))
        return _let(made, lambda m: F.coalesce(F.get(m, F.lit(0)), F.get(m, F.lit(1)), F.concat(F.lit("&"), p)))

    def resolved(p: Column) -> Column:
        out = F.when(F.lit(False), p)
        for name, text in _COMMON:
            out = out.when(p.startswith(name), F.concat(F.lit(text), after(p, F.lit(len(name)))))
        return out.when(p.rlike("^#(?:[0-9]|[xX][0-9a-fA-F])"), numeric(p)).otherwise(named(p))

    return F.array_join(F.transform(F.split(c, "&"), lambda p, i: F.when(i == 0, p).otherwise(resolved(p))), "")


def json_escape(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":"(.*)"\}$', "$1")


def json_unescape(c: Column) -> Column:
    """JSON escapes resolved; text that is no JSON string body passes through."""
    good = c.rlike(r'(?s)^(?:[^"\\]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+$')
    return F.when(good, F.coalesce(F.from_json(F.concat(F.lit('{"x":"'), F.regexp_replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), "\t", "\\\\t"), F.lit('"}')), "x string")["x"], c)).otherwise(c)


def path(c: Column, part: str) -> Column:
    """File name or parent of a path; backslashes count as slashes."""
    tidy = F.replace(c, F.lit("\\"), F.lit("/"))
    if part == "name":
        return F.regexp_extract(tidy, r"([^/]*)/*$", 1)
    parent = F.regexp_replace(tidy, r"/*[^/]*/*$", "")
    return F.when((parent == "") & tidy.startswith("/"), F.lit("/")).otherwise(parent)


def url(c: Column, part: str) -> Column:
    """domain, host (with a port that is not the default), uri, path or params of a URL; other text passes through."""
    get = lambda p: F.try_parse_url(c, F.lit(p))
    host = get("HOST")
    authority = F.regexp_replace(get("AUTHORITY"), r"^[^@]*@", "")
    scheme = F.lower(get("PROTOCOL"))
    plain = F.when((scheme == "http") & authority.endswith(":80"), host).when((scheme == "https") & authority.endswith(":443"), host).otherwise(authority)
    body = F.coalesce(F.nullif(get("PATH"), F.lit("")), F.lit("/"))
    query = get("QUERY")
    fragment = get("REF")
    uri = F.concat(body, F.coalesce(F.concat(F.lit("?"), query), F.lit("")), F.coalesce(F.concat(F.lit("#"), fragment), F.lit("")))
    found = {"domain": host, "host": plain, "uri": uri, "path": body, "params": F.coalesce(query, F.lit(""))}[part]
    return F.when(host.isNotNull(), found).otherwise(c)


def _to_ts(v: Value, hours: int = 8, unit: str = "s") -> Value:
    """Epoch of a naive time read at an hour offset (UTC+8 unless said otherwise)."""
    if v.kind != "time":
        return v
    utc = (v.column.cast("timestamp_ntz") - F.expr(f"INTERVAL '{hours}' HOUR")).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc)
    per = {"s": 1000000, "ss": 1000000, "ms": 1000, "us": 1}[unit]
    return Value(F.floor(micros / F.lit(per)).cast("bigint") if per > 1 else micros, "digit")


def _nth(v: Value, i: str) -> Value:
    return Value(F.get(v.column, F.lit(int(i))), "auto") if v.kind == "array" else v


def _get(v: Value, where: str) -> Value:
    for name in where.strip("/").split("/"):
        if v.kind != "obj":
            return v
        own = dict(v.members)
        v = Value(v.column.getField(name), own[name].kind if name in own else "auto", own[name].members if name in own else ())
    return v


def _skip_empty(v: Value) -> Value:
    if v.kind in ("chars", "auto"):
        return Value(F.nullif(v.column, F.lit("")), v.kind)
    if v.kind in ("digit", "float"):
        return Value(F.when(v.column != 0, v.column), v.kind)
    return Value(F.when(F.size(v.column) > 0, v.column), v.kind) if v.kind == "array" else v


def _starts_with(v: Value, prefix: str) -> Value:
    return Value(F.when(v.column.startswith(prefix), v.column), v.kind) if v.kind in ("chars", "auto") else v


def _map_to(v: Value, to: str, quoted: bool = False) -> Value:
    if quoted:
        made = Value(F.lit(to), "chars")
    elif to in ("true", "false"):
        made = constant("bool", to)
    elif re.fullmatch(r"[+-]?\d+", to):
        made = constant("digit", to)
    else:
        made = constant("float", to) if re.fullmatch(r"[+-]?\d*\.\d+", to) else Value(F.lit(to), "chars")
    return Value(F.when(v.column.isNotNull(), made.column), made.kind)


def _to_str(v: Value) -> Value:
    return convert(v, "chars")


def _to_json(v: Value) -> Value:
    if v.kind in ("obj", "array"):
        return Value(F.to_json(v.column), "chars")
    if v.kind in ("chars", "auto", "ip", "time"):
        return Value(F.concat(F.lit('"'), json_escape(v.column.cast("string")), F.lit('"')), "chars")
    return Value(v.column.cast("string"), "chars")


def _ip4_to_int(v: Value) -> Value:
    return Value(ip4_int(v.column), "digit") if v.kind in ("ip",) else v


#: A word splitter of one's own, used by the two semantic functions: text -> {subject, action, object, status, main}.
SEMANTICS: dict[str, Callable[[str], dict] | None] = {"splitter": None}


def register_semantics(splitter: Callable[[str], dict] | None) -> None:
    """Turns the semantic functions on. Without a splitter they give an empty word and an empty object."""
    SEMANTICS["splitter"] = splitter


def _main_word(c: Column) -> Column:
    f = SEMANTICS["splitter"]
    return F.when(c.isNotNull(), F.lit("")) if f is None else _map(lambda s: f(s).get("main", ""))(c)


def _subject_object(v: Value) -> Value:
    names = ("subject", "action", "object", "status")
    members = tuple((n, Value(F.lit(""), "chars")) for n in names)
    f = SEMANTICS["splitter"]
    if v.kind not in ("chars", "auto"):
        return v
    if f is None:
        return Value(F.struct(*[F.lit("").alias(n) for n in names]), "obj", members)

    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{n: f(s or "").get(n, "") for n in names} for s in values], columns=list(names))

    return Value(run(v.column), "obj", members)


FUNCTIONS: dict[str, Callable[..., Value]] = {
    "base64_encode": _text(lambda c: F.base64(F.encode(c, "UTF-8"))),
    "base64_decode": _text(base64_decode),
    "html_escape": _text(html_escape),
    "html_unescape": _text(html_unescape),
    "str_escape": _text(str_escape),
    "json_escape": _text(json_escape),
    "json_unescape": _text(json_unescape),
    "Time::to_ts": lambda v: _to_ts(v),
    "Time::to_ts_ms": lambda v: _to_ts(v, 8, "ms"),
    "Time::to_ts_us": lambda v: _to_ts(v, 8, "us"),
    "Time::to_ts_zone": lambda v, zone, unit: _to_ts(v, int(zone), unit),
    "nth": _nth,
    "get": _get,
    "skip_empty": _skip_empty,
    "path": _text(path),
    "url": _text(url),
    "ip4_to_int": _ip4_to_int,
    "to_str": _to_str,
    "to_json": _to_json,
    "starts_with": _starts_with,
    "map_to": _map_to,
    "extract_main_word": _text(_main_word),
    "extract_subject_object": _subject_object,
}


def register_function(name: str, function: Callable[..., Value]) -> None:
    """A value function of one's own."""
    FUNCTIONS[name] = function
