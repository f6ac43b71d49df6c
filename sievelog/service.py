"""The store as functions of requests, and a small HTTP server over them.

    GET  /                        a search page
    POST /ingest                  ["line", ..]                        -> {"ingested": n}
    GET  /search?query=..&limit=n                                     -> {"query", "count", "total", "results"}
    POST /search                  {"query": tree, "limit": n}         -> the same; query as infix text
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .config import BODY_BYTES
from .operators.store import Store
from .plans.query import QueryError, display, from_json, parse_query, spark_chars

PAGE = b"""<!doctype html><meta charset=utf-8><title>Log search</title>
<form id=i><textarea name=lines rows=4 cols=60 placeholder='one line each'></textarea><button>Add</button><span id=a></span></form>
<form id=f><input name=query size=60 placeholder='error AND NOT timeout'><input name=limit type=number value=100 min=0><button>Search</button></form>
<p id=n></p><pre id=r></pre>
<script>i.onsubmit=async e=>{e.preventDefault();const b=await fetch('/ingest',{method:'POST',body:JSON.stringify(i.elements.lines.value.split('\\n').filter(x=>x))});
a.textContent=b.ok?(await b.json()).ingested+' added':'Not added';if(b.ok)i.reset()}
f.onsubmit=async e=>{e.preventDefault();const a=await fetch('/search?'+new URLSearchParams(new FormData(f)));
if(!a.ok){n.textContent='Not a query';r.textContent='';return}
const j=await a.json();n.textContent=j.count+' of '+j.total;r.textContent=j.results.join('\\n')}</script>"""


class BadRequest(ValueError):
    """The request is not of the right form."""


class TooLarge(ValueError):
    """The body is larger than the service takes."""


class Service:
    """Requests over a store. Full blocks are sealed by a thread of its own, so that no ingest waits for it."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store, self.lock, self.full = spark, store, threading.Lock(), threading.Event()
        self.failed: Exception | None = None
        threading.Thread(target=self._seal, daemon=True).start()

    def _seal(self) -> None:
        while True:
            self.full.wait()
            self.full.clear()
            try:
                self.store.seal()
            except Exception as e:  # noqa: BLE001  the blocks stay unsealed, searchable, and are tried again with the next
                self.failed = e

    def ingest(self, lines: list[str]) -> dict:
        if not isinstance(lines, list) or not all(isinstance(x, str) for x in lines):
            raise BadRequest("an array of strings is wanted")
        if not lines:
            return {"ingested": 0}
        rows = self.spark.createDataFrame(list(enumerate(lines)), "n long, line string")
        with self.lock:
            stored = self.store.append(rows, order=["n"])
        if self.store.manifest.sealed_before < self.store.manifest.active_block:
            self.full.set()
        return {"ingested": int(stored)}

    def search(self, query: str, limit: int | None = None) -> dict:
        """Echoes the text as given."""
        return self._whole(self.asked(query, limit))

    def search_tree(self, tree: dict, limit: int | None = None) -> dict:
        """Echoes the tree as infix text."""
        return self._whole(self.asked_tree(tree, limit))

    def asked(self, query: str, limit: int | None = None) -> tuple:
        return self._found(parse_query(query, spark_chars(self.spark, query)), query, limit)

    def asked_tree(self, tree: dict, limit: int | None = None) -> tuple:
        query = from_json(tree, spark_chars(self.spark, json.dumps(tree, ensure_ascii=False)))
        return self._found(query, display(query), limit)

    def _found(self, query, text: str, limit: int | None) -> tuple:
        """The echoed text, the total, and the lines one after the other: without a limit they never are in memory at once."""
        result = self.store.search(query, self.store.settings.resolve_limit(limit))
        total = result.total
        if result.limit == 0:
            lines = iter(())
        elif result.limit is None:
            lines = (r[0] for r in result.rows.select(result.line).toLocalIterator())
        else:
            lines = iter(result.lines())
        return text, total, total if result.limit is None else min(total, result.limit), lines

    @staticmethod
    def _whole(found: tuple) -> dict:
        text, total, count, lines = found
        return {"query": text, "count": count, "total": total, "results": list(lines)}


def answer_parts(found: tuple):
    """The answer's JSON, piece by piece."""
    text, total, count, lines = found
    yield json.dumps({"query": text, "count": count, "total": total})[:-1] + ', "results": ['
    for i, line in enumerate(lines):
        yield (", " if i else "") + json.dumps(line)
    yield "]}"


def _limit(value) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool) or not str(value).isdecimal():
        raise BadRequest("limit is a number from 0")
    return int(value)


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080, most: int = BODY_BYTES) -> ThreadingHTTPServer:
    """A server that is ready to `serve_forever()`; `most`: bytes of a request's body."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _send(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            if status >= 400:
                self.send_header("Connection", "close")
                self.close_connection = True
            self.end_headers()
            self.wfile.write(body)

        def _stream(self, parts) -> None:
            """In chunks, as they come; what HTTP/1.0 asks for ends with the connection."""
            chunked = self.request_version != "HTTP/1.0"
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header(*(("Transfer-Encoding", "chunked") if chunked else ("Connection", "close")))
            self.end_headers()
            held = b""
            try:
                for part in parts:
                    held += part.encode()
                    if len(held) >= 1 << 16:
                        self.wfile.write(b"%x\r\n%s\r\n" % (len(held), held) if chunked else held)
                        held = b""
                self.wfile.write(b"%x\r\n%s\r\n0\r\n\r\n" % (len(held), held) if chunked else held)
            except Exception:  # noqa: BLE001  too late for a status: the answer breaks off, which the client sees
                self.close_connection = True

        def _answer(self, work) -> None:
            try:
                found = work()
            except (BadRequest, QueryError, json.JSONDecodeError, UnicodeDecodeError, RecursionError) as e:
                self._send(400, json.dumps({"error": str(e)}).encode())
            except TooLarge as e:
                self._send(413, json.dumps({"error": str(e)}).encode())
            except Exception as e:  # noqa: BLE001
                self._send(500, json.dumps({"error": str(e)[:200]}).encode())
            else:
                if isinstance(found, tuple):
                    self._stream(answer_parts(found))
                else:
                    self._send(200, json.dumps(found).encode())

        def _body(self):
            size = self.headers.get("Content-Length", "0")
            if not size.isdecimal():
                raise BadRequest("Content-Length is a number")
            if int(size) > most:
                raise TooLarge(f"a body has at most {most} bytes")
            return json.loads(self.rfile.read(int(size)))

        def do_GET(self):
            url = urlsplit(self.path)
            if url.path == "/":
                self._send(200, PAGE, "text/html; charset=utf-8")
            elif url.path == "/search":
                given = parse_qs(url.query, keep_blank_values=True)

                def work():
                    if "query" not in given:
                        raise BadRequest("query is missing")
                    return service.asked(given["query"][0], _limit(given.get("limit", [None])[0]))

                self._answer(work)
            else:
                self._send(404, b"{}")

        def do_POST(self):
            if self.path == "/ingest":
                self._answer(lambda: service.ingest(self._body()))
            elif self.path == "/search":

                def work():
                    body = self._body()
                    if not isinstance(body, dict) or "query" not in body:
                        raise BadRequest("query is missing")
                    return service.asked_tree(body["query"], _limit(body.get("limit")))

                self._answer(work)
            else:
                self._send(404, b"{}")

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
