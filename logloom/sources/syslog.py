"""Syslog headers: RFC 5424, then RFC 3164, then the line as it is; and what a source does with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: <pri>version time host app proc msgid [data] message
RFC5424 = r"(?s)^<([0-9]{1,3})>([1-9][0-9]?) (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|(?:\[(?:\\.|\"(?:[^\"\\]++|\\.)*+\"|[^\]\\\"]++)*+\])++)(?: (.*))?$"
#: <pri>Mon dd HH:MM:SS host tag: message
RFC3164 = r"(?s)^<([0-9]{1,3})>((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2}) (\S+) (.*)$"


def normalise(c: Column) -> Column:
    """A struct: form (5424, 3164 or raw), pri, facility, severity, and the message without its head."""
    new, old = c.rlike(RFC5424), c.rlike(RFC3164)
    pri = F.when(new, F.regexp_extract(c, RFC5424, 1)).when(old, F.regexp_extract(c, RFC3164, 1)).cast("int")
    pri = F.when(pri <= 191, pri)
    message = F.when(new & pri.isNotNull(), F.ltrim(F.regexp_replace(F.regexp_extract(c, RFC5424, 8), "^\ufeff", ""))).when(old & pri.isNotNull(), F.regexp_extract(c, RFC3164, 4)).otherwise(c)
    form = F.when(pri.isNull(), "raw").when(new, "5424").otherwise("3164")
    return F.struct(form.alias("form"), pri.alias("pri"), F.floor(pri / 8).cast("int").alias("facility"), (pri % 8).alias("severity"), message.alias("message"))


def header(df: DataFrame, mode: str, payload: str = "payload", tags: str = "tags") -> DataFrame:
    """``raw`` leaves lines alone; ``skip`` strips heads; ``tag`` strips them and adds syslog.pri, .facility, .severity."""
    if mode == "raw":
        return df
    if mode not in ("skip", "tag"):
        raise ValueError(f"unknown header mode {mode}")
    out = df.withColumn("_s", normalise(F.col(payload))).withColumn(payload, F.col("_s.message"))
    if mode == "tag":
        own = F.create_map(*[x for k in ("pri", "facility", "severity") for x in (F.lit(f"syslog.{k}"), F.col(f"_s.{k}").cast("string"))])
        old = F.coalesce(F.col(tags), F.create_map().cast("map<string,string>")) if tags in df.columns else F.create_map().cast("map<string,string>")
        out = out.withColumn(tags, F.when(F.col("_s.pri").isNull(), old).otherwise(F.map_concat(F.map_filter(old, lambda k, v: ~k.startswith("syslog.")), own)))
    return out.drop("_s")
