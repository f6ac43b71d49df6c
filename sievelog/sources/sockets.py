"""TCP and UDP listeners, as a server that hands on batches of lines and as a streaming source over it.

Spark's own socket source is a client for tests. These listen. Lines wait in the memory of one process, so those not
yet written are lost if it ends: as with any receiver without a log of its own.
"""

from __future__ import annotations

import socket
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..config import DATAGRAM_BYTES, TCP_BATCH_LINES, TCP_FLUSH_MS


class LineBuffer:
    """Bytes of one connection to lines. A line cut short by a pause is finished when the rest comes."""

    def __init__(self):
        self.rest = b""

    def feed(self, data: bytes) -> list[str]:
        *whole, self.rest = (self.rest + data).split(b"\n")
        return self._clean(whole)

    def end(self) -> list[str]:
        last, self.rest = self.rest, b""
        return self._clean([last])

    @staticmethod
    def _clean(parts: list[bytes]) -> list[str]:
        texts = (p.decode("utf-8", "replace").rstrip("\r\n") for p in parts)
        return [t for t in texts if t]


def datagram_lines(data: bytes) -> list[str]:
    return LineBuffer._clean(data.split(b"\n"))


class LineServer:
    """Listens on TCP or UDP and calls `take` with batches of lines, one call at a time.

    A connection's lines are handed on when `batch` have come, when none came for `flush_ms`, and when it ends.
    """

    def __init__(self, take: Callable[[list[str]], None], kind: str = "tcp", host: str = "127.0.0.1", port: int = 0, batch: int = TCP_BATCH_LINES, flush_ms: int = TCP_FLUSH_MS):
        self.take, self.batch, self.flush = take, batch, flush_ms / 1000
        self.lock, self.stopped = threading.Lock(), threading.Event()
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_STREAM if kind == "tcp" else socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((host, port))
        self.socket.settimeout(0.2)
        if kind == "tcp":
            self.socket.listen()
        self.port = self.socket.getsockname()[1]
        self.threads: list[threading.Thread] = []
        self._start(self._accept if kind == "tcp" else self._receive)

    def _start(self, work: Callable, *args) -> None:
        self.threads = [t for t in self.threads if t.is_alive()]
        self.threads.append(threading.Thread(target=work, args=args, daemon=True))
        self.threads[-1].start()

    def _give(self, lines: list[str]) -> None:
        if lines:
            with self.lock:
                self.take(lines)

    def _accept(self) -> None:
        while not self.stopped.is_set():
            try:
                connection, _ = self.socket.accept()
            except TimeoutError:
                continue
            except OSError:
                return
            self._start(self._serve, connection)

    def _serve(self, connection: socket.socket) -> None:
        buffer, waiting, since = LineBuffer(), [], time.monotonic()
        with connection:
            connection.settimeout(min(self.flush, 0.2))
            while not self.stopped.is_set():
                try:
                    data = connection.recv(1 << 16)
                except TimeoutError:
                    if waiting and time.monotonic() - since >= self.flush:
                        self._give(waiting)
                        waiting = []
                    continue
                except OSError:
                    break
                if not data:
                    break
                found = buffer.feed(data)
                if found:
                    since = time.monotonic()
                    waiting += found
                while len(waiting) >= self.batch:
                    self._give(waiting[: self.batch])
                    waiting = waiting[self.batch :]
        self._give(waiting + buffer.end())

    def _receive(self) -> None:
        while not self.stopped.is_set():
            try:
                data = self.socket.recv(DATAGRAM_BYTES)
            except TimeoutError:
                continue
            except OSError:
                return
            self._give(datagram_lines(data))

    def stop(self) -> None:
        """Stop listening and hand on what has come."""
        self.stopped.set()
        for thread in self.threads:
            thread.join(5)
        self.socket.close()


class LineSource(DataSource):
    """`spark.readStream.format("sievelog_lines").option("kind", "tcp").option("port", 8081).load()`."""

    @classmethod
    def name(cls) -> str:
        return "sievelog_lines"

    def schema(self) -> str:
        return "line string"

    def simpleStreamReader(self, schema) -> "LineReader":
        return LineReader(self.options)


class LineReader(SimpleDataSourceStreamReader):
    """Offsets count lines since the start. Lines are held until their batch is committed, so a batch can be read again."""

    def __init__(self, options):
        self.options, self.server = options, None
        self.held: list[str] = []
        self.base = 0

    def _listen(self) -> None:
        if self.server is None:
            o = self.options
            self.server = LineServer(self.held.extend, o.get("kind", "tcp"), o.get("host", "127.0.0.1"), int(o.get("port", 0)), flush_ms=int(o.get("flushMs", TCP_FLUSH_MS)))

    def initialOffset(self) -> dict:
        self._listen()
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._listen()
        with self.server.lock:
            end = self.base + len(self.held)
            rows = self.held[start["line"] - self.base :]
        return iter([(r,) for r in rows]), {"line": max(end, start["line"])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(r,) for r in self.held[max(start["line"] - self.base, 0) : max(end["line"] - self.base, 0)]])

    def commit(self, end: dict) -> None:
        if self.server is not None:
            with self.server.lock:
                del self.held[: max(end["line"] - self.base, 0)]
                self.base = max(self.base, end["line"])
