"""TCP and UDP listeners as a streaming data source.

One reader listens, in the driver; each micro-batch takes what has come in since the last one. A message is numbered when
it arrives and kept as a line of a spool file, from which a batch can be read again, by another process too. The option
``spool`` names its folder, a shared one on a cluster. This is meant for tests and small feeds: for volume, let a
collector write to Kafka.
"""

from __future__ import annotations

import json
import os
import socket
import tempfile
import threading
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .framing import Framer, FramingError


class _Listener:
    def __init__(self, protocol: str, addr: str, port: int, framing: str, spool: str):
        self.next, self.lock = 0, threading.Lock()
        kind = socket.SOCK_DGRAM if protocol == "udp" else socket.SOCK_STREAM
        self.sock = socket.socket(socket.AF_INET, kind)
        self.sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.sock.bind((addr, port))
        self.framing = framing
        os.makedirs(os.path.dirname(spool), exist_ok=True)
        if os.path.exists(spool):
            with open(spool, encoding="utf-8") as f:
                self.next = sum(1 for _ in f)
        self.file = open(spool, "a", encoding="utf-8")  # noqa: SIM115
        if protocol != "udp":
            self.sock.listen(64)
        threading.Thread(target=self._datagrams if protocol == "udp" else self._accept, daemon=True).start()

    def put(self, body: bytes, peer: str) -> None:
        with self.lock:
            self.file.write(json.dumps([body.decode("utf-8", "replace"), peer]) + "\n")
            self.file.flush()
            self.next += 1

    def _datagrams(self) -> None:
        while True:
            body, peer = self.sock.recvfrom(65535)
            self.put(body.rstrip(b"\r\n"), peer[0])

    def _accept(self) -> None:
        while True:
            peer, address = self.sock.accept()
            threading.Thread(target=self._stream, args=(peer, address[0]), daemon=True).start()

    def _stream(self, peer: socket.socket, ip: str) -> None:
        framer = Framer(self.framing)
        with peer:
            try:
                while data := peer.recv(1 << 16):
                    for m in framer.feed(data):
                        self.put(m, ip)
                for m in framer.close():
                    self.put(m, ip)
            except (OSError, FramingError):
                return  # the connection is dropped


_listeners: dict[tuple, _Listener] = {}


class NetworkReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        protocol, port = options.get("protocol", "tcp"), int(options.get("port", "0"))
        folder = options.get("spool") or os.path.join(tempfile.gettempdir(), "logloom-net")
        self.spool = os.path.join(folder, f"{protocol}-{port}.jsonl")
        self.key = (protocol, options.get("addr", "127.0.0.1"), port, options.get("framing", "auto"), self.spool)

    def _listener(self) -> _Listener:
        if self.key not in _listeners:
            _listeners[self.key] = _Listener(*self.key)
        return _listeners[self.key]

    def initialOffset(self) -> dict:
        return {"n": self._listener().next}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"n": self._listener().next}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with open(self.spool, encoding="utf-8") as f:
            return iter([tuple(json.loads(x)) for x in islice(f, start["n"], end["n"])])

    def commit(self, end: dict) -> None:
        pass


class NetworkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logloom_net"

    def schema(self) -> str:
        return "value string, peer string"

    def simpleStreamReader(self, schema) -> NetworkReader:
        return NetworkReader(self.options)


def register_network_sources(spark: SparkSession) -> None:
    spark.dataSource.register(NetworkSource)
