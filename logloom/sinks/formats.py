"""Text forms of records: json, kv, show, csv, raw and proto-text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")


def _quoted(f: T.StructField) -> Column:
    text = _text(f)
    if isinstance(f.dataType, T.StringType):
        return F.when(text.rlike(r'[\s",=]') | (text == ""), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)
    return text


def line(schema: T.StructType, form: str, raw: str = "payload") -> Column:
    """A record as text. Absent (null) fields are left out, but in csv, where their place stays empty."""
    fields = schema.fields
    if form == "json":
        made = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in fields]))
    elif form == "csv":
        cell = lambda f: F.when(_text(f).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(_text(f), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(_text(f))
        made = F.concat_ws(",", *[F.coalesce(cell(f), F.lit("")) for f in fields])
    elif form == "kv":
        made = F.concat_ws(", ", *[F.concat(F.lit(f"{f.name}: "), _quoted(f)) for f in fields])
    elif form == "show":
        made = F.concat_ws("\n", *[F.concat(F.lit(f"{f.name} = "), _text(f)) for f in fields])
    elif form == "raw":
        made = F.col(raw) if raw in schema.fieldNames() else F.concat_ws(" ", *[_text(f) for f in fields])
    elif form in ("proto-text", "proto_text"):
        value = lambda f: F.concat(F.lit('"'), F.replace(F.replace(_text(f), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) if isinstance(f.dataType, T.StringType) else _text(f)
        made = F.concat_ws(" ", *[F.concat(F.lit(f"{f.name}: "), value(f)) for f in fields])
    else:
        raise ValueError(f"unknown format {form}")
    return made


def encode(df: DataFrame, form: str, into: str = "line", raw: str = "payload") -> DataFrame:
    """One text column instead of the record."""
    return df.select(line(df.schema, form, raw).alias(into))
