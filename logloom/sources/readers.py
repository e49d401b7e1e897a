"""Sources as DataFrames of events: event_id, src_key, payload, tags, ups_ip."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .network import register_network_sources
from .syslog import header

COLUMNS = ["event_id", "src_key", "payload", "tags", "ups_ip"]


def decoded(c: Column, encode: str) -> Column:
    """Payload text of a line in text, base64 or hex form; null where it does not decode."""
    if encode == "text":
        return c
    if encode not in ("base64", "hex"):
        raise ValueError(f"unknown encoding {encode}")
    return F.make_valid_utf8(F.try_to_binary(F.trim(c), F.lit(encode)).cast("string"))


def _events(lines: DataFrame, key: str, tags: Mapping[str, str], encode: str = "text", ip: Column | None = None, origin: Column | None = None) -> DataFrame:
    text = F.regexp_replace(F.col("value"), r"[\r\n]+$", "")
    pairs = [x for k, v in tags.items() for x in (F.lit(k), F.lit(v))]
    if origin is not None:
        pairs += [F.lit("access_source"), origin]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    where = origin if origin is not None else F.lit(key)
    return lines.select(F.xxhash64(F.lit(key), where, text).alias("event_id"), F.lit(key).alias("src_key"), decoded(text, encode).alias("payload"), made.alias("tags"), (ip if ip is not None else F.lit(None).cast("string")).alias("ups_ip"))


def file_source(spark: SparkSession, key: str, options: Mapping[str, str], streaming: bool = False) -> DataFrame:
    """Lines of text files. ``encode``: text, base64 or hex. Byte ranges are split by the scan itself.

    The event id is a hash of source, file and line, so a file that is read again gives the same ids.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and "batch_files" in options:
        reader = reader.option("maxFilesPerTrigger", options["batch_files"])
    lines = reader.option("lineSep", options["separator"]).text(options["path"]) if "separator" in options else reader.text(options["path"])
    return _events(lines, key, _tags(options), options.get("encode", "text"), origin=F.col("_metadata.file_path"))


def kafka_source(spark: SparkSession, key: str, options: Mapping[str, str], streaming: bool = True) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", options["brokers"]).option("subscribe", options["topic"])
    for name in ("startingOffsets", "maxOffsetsPerTrigger"):
        if name in options:
            reader = reader.option(name, options[name])
    return _events(reader.load().select(F.col("value").cast("string")), key, _tags(options))


def network_source(protocol: str) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, key: str, options: Mapping[str, str], streaming: bool = True) -> DataFrame:
        if not streaming:
            raise ValueError("a network source is a stream")
        register_network_sources(spark)
        reader = spark.readStream.format("logloom_net").option("protocol", "udp" if protocol == "syslog_udp" else "tcp")
        for name in ("addr", "port", "framing"):
            if name in options:
                reader = reader.option(name, options[name])
        lines = reader.load()
        events = _events(lines, key, _tags(options), ip=F.col("peer"))
        return header(events, options.get("header", "skip" if protocol.startswith("syslog") else "raw"))

    return read


def _tags(options: Mapping[str, str]) -> dict[str, str]:
    return {k.removeprefix("tag."): v for k, v in options.items() if k.startswith("tag.")}


READERS: dict[str, Callable[..., DataFrame]] = {
    "file": file_source,
    "kafka": kafka_source,
    "tcp": network_source("tcp"),
    "syslog_tcp": network_source("syslog_tcp"),
    "syslog_udp": network_source("syslog_udp"),
}


def register_source(kind: str, reader: Callable[..., DataFrame]) -> None:
    READERS[kind] = reader


class Connector:
    """A kind with default options, of which only the named ones may be replaced by a source of its own."""

    def __init__(self, kind: str, options: Mapping[str, str], allow_override: tuple[str, ...] = ()):
        self.kind, self.options, self.allow = kind, dict(options), set(allow_override)

    @classmethod
    def from_toml(cls, text: str) -> dict[str, Connector]:
        """Connectors of a TOML text, by id."""
        import tomllib

        found = tomllib.loads(text)
        return {c["id"]: cls(c["type"], {k: str(v) for k, v in c.get("params", {}).items()}, tuple(c.get("allow_override", ()))) for c in found.get("connectors", [])}

    def with_options(self, own: Mapping[str, str]) -> dict[str, str]:
        refused = set(own) - self.allow - {k for k in own if k.startswith("tag.")}
        if refused:
            raise ValueError(f"these options may not be replaced: {sorted(refused)}")
        return {**self.options, **own}

    def read(self, spark: SparkSession, key: str, own: Mapping[str, str] | None = None, streaming: bool = False) -> DataFrame:
        if self.kind not in READERS:
            raise ValueError(f"unknown source kind {self.kind}")
        return READERS[self.kind](spark, key, self.with_options(own or {}), streaming)


def union(sources: list[DataFrame]) -> DataFrame:
    """All sources of a run as one frame."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out
