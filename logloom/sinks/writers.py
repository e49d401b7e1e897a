"""Sinks: files, TCP, syslog, Kafka, JDBC, discard, and a dead-letter table for what a sink could not take."""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formats import encode


@dataclass(frozen=True)
class Policy:
    """What happens when a sink fails: try again, put the rows aside, ignore, or stop."""

    retries: int = 2
    then: str = "rescue"  # rescue, ignore, throw
    wait_s: float = 0.2


#: Named error strategies.
POLICIES = {"normal": Policy(), "debug": Policy(0, "throw"), "stoic": Policy(5, "ignore", 0.5)}


def write_file(df: DataFrame, options: Mapping[str, str]) -> None:
    form = options.get("fmt", "json")
    if form in ("json", "csv", "kv", "show", "raw", "proto-text"):
        encode(df, form).write.mode(options.get("mode", "append")).text(options["path"])
    else:
        df.write.mode(options.get("mode", "append")).format(form).save(options["path"])


class _Sender:
    """Sends lines over one connection for each partition, waiting longer after each failure to connect."""

    def __init__(self, host: str, port: int, protocol: str, framing: str, header: str | None = None):
        self.host, self.port, self.protocol, self.framing, self.header = host, port, protocol, framing, header

    def frame(self, line: str) -> bytes:
        body = ((self.header or "") + line).encode()
        if self.protocol == "udp":
            return body
        return f"{len(body)} ".encode() + body if self.framing == "len" else body + b"\n"

    def __call__(self, rows) -> None:
        peer, wait = None, 0.05
        try:
            for row in rows:
                while peer is None:
                    try:
                        if self.protocol == "udp":
                            peer = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
                            peer.connect((self.host, self.port))
                        else:
                            peer = socket.create_connection((self.host, self.port), 10)
                    except OSError:
                        if wait > 2:
                            raise
                        time.sleep(wait)
                        wait *= 2
                peer.sendall(self.frame(row[0]))
        finally:
            if peer is not None:
                peer.close()


def write_tcp(df: DataFrame, options: Mapping[str, str]) -> None:
    sender = _Sender(options["addr"], int(options["port"]), "tcp", options.get("framing", "line"))
    encode(df, options.get("fmt", "json")).foreachPartition(sender)


def write_syslog(df: DataFrame, options: Mapping[str, str]) -> None:
    """Lines with an RFC 3164 or RFC 5424 head, over UDP or TCP."""
    pri = int(options.get("facility", 16)) * 8 + int(options.get("severity", 6))
    host, app = options.get("hostname", "localhost"), options.get("app", "logloom")
    now = F.current_timestamp()
    if options.get("rfc", "3164") == "5424":
        head = F.concat(F.lit(f"<{pri}>1 "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f" {host} {app} - - - "))
    else:
        head = F.concat(F.lit(f"<{pri}>"), F.date_format(now, "MMM dd HH:mm:ss"), F.lit(f" {host} {app}: "))
    lines = encode(df, options.get("fmt", "json")).select(F.concat(head, F.col("line")).alias("line"))
    lines.foreachPartition(_Sender(options["addr"], int(options["port"]), options.get("protocol", "udp"), options.get("framing", "line")))


def write_kafka(df: DataFrame, options: Mapping[str, str]) -> None:
    encode(df, options.get("fmt", "json"), "value").write.format("kafka").option("kafka.bootstrap.servers", options["brokers"]).option("topic", options["topic"]).save()


def write_jdbc(df: DataFrame, options: Mapping[str, str]) -> None:
    df.write.mode("append").format("jdbc").options(**options).save()


def write_blackhole(df: DataFrame, options: Mapping[str, str]) -> None:
    df.write.mode("append").format("noop").save()


def write_failing(df: DataFrame, options: Mapping[str, str]) -> None:
    """A test double that fails a set number of times, then discards."""
    left = int(options.get("fail", 1))
    if left > 0:
        options["fail"] = str(left - 1)  # type: ignore[index]
        raise OSError("this sink fails on purpose")
    write_blackhole(df, options)


WRITERS: dict[str, Callable[[DataFrame, Mapping[str, str]], None]] = {
    "file": write_file,
    "tcp": write_tcp,
    "syslog": write_syslog,
    "kafka": write_kafka,
    "mysql": write_jdbc,
    "doris": write_jdbc,
    "jdbc": write_jdbc,
    "blackhole": write_blackhole,
    "test_rescue": write_failing,
}


def register_sink(kind: str, writer: Callable[[DataFrame, Mapping[str, str]], None]) -> None:
    WRITERS[kind] = writer


def write(df: DataFrame, kind: str, options: Mapping[str, str], policy: Policy | str = "normal", rescue: str | None = None, name: str = "sink") -> bool:
    """Writes a frame to a sink under an error policy; True if it arrived.

    With ``rescue`` the rows of a failed write go to that folder as JSON lines, with the sink's name, to be replayed.
    """
    p = POLICIES[policy] if isinstance(policy, str) else policy
    for attempt in range(p.retries + 1):
        try:
            WRITERS[kind](df, options)
            return True
        except Exception:
            if attempt < p.retries:
                time.sleep(p.wait_s * 2**attempt)
                continue
            if p.then == "throw" or (p.then == "rescue" and rescue is None):
                raise
            if p.then == "rescue":
                encode(df, "json").select(F.lit(name).alias("sink"), F.lit(json.dumps(dict(options))).alias("options"), "line").write.mode("append").json(rescue)
    return False


def replay(spark, rescue: str, schema: str, send: Callable[[DataFrame, str], bool], done: str) -> int:
    """Sends rescued rows again, sink by sink; files that were sent are noted in ``done`` and not read twice."""
    files = spark.read.schema("sink string, options string, line string").json(rescue).withColumn("file", F.input_file_name())
    try:
        sent = spark.read.schema("file string").json(done)
        files = files.join(sent, "file", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = 0
    for r in files.groupBy("sink").count().collect():
        own = files.where(F.col("sink") == r.sink)
        if send(own.select(F.from_json("line", schema).alias("r")).select("r.*"), r.sink):
            n += r["count"]
            own.select("file").distinct().write.mode("append").json(done)
    return n
