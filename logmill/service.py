"""The HTTP surface over a store: health, ingest, binary ingest, query, stats and a WebSocket tail.

Requests are handled by Service.handle, which knows nothing of sockets; serve() puts it behind the standard library's
server. Ingest appends to the store, so one commit is one request.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import queue
import struct
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from logmill.plans.query import run
from logmill.plans.request import QUERY_BODY_BYTES, from_http
from logmill.schema import ENTRY
from logmill.sources.frames import BATCH_BODY_BYTES, DecodeError, decode_batch
from logmill.sources.lines import BODY_BYTES, decode_body
from logmill.stats import RunningStats
from logmill.store import Ids, LogStore
from logmill.streaming.tail import Hub, as_json

_LIMITS = {"/api/v1/ingest": BODY_BYTES, "/api/v1/ingest/binary": BATCH_BODY_BYTES, "/api/v1/query": QUERY_BODY_BYTES}
_CORS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type, Authorization"}
PING_S = 25
ICON = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 8 8"><path d="M1 1h6v1H1zM1 3.5h4v1H1zM1 6h5v1H1z"/></svg>'
#: Fixed value of the WebSocket protocol, RFC 6455.
_WS_KEY = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


class Service:
    def __init__(self, store: LogStore, hub: Hub | None = None, compat: str = "strict", now_ns=time.time_ns):
        self.store, self.hub, self.compat, self.now_ns = store, hub or Hub(compat), compat, now_ns
        self.ids, self._stats = Ids(now_ns), RunningStats(store)

    def handle(self, method: str, target: str, body: bytes = b"") -> tuple[int, str]:
        """Status and body of a request."""
        url = urlsplit(target)
        path, params = url.path.rstrip("/") or "/", parse_qs(url.query, keep_blank_values=True)
        if method == "OPTIONS":
            return 204, ""
        if path == "/":
            return 200, "The log store's API is at /api/v1; there is no page here."
        if path == "/favicon.ico":
            return 200, ICON
        if path == "/health":
            return 200, json.dumps({"status": "ok"})
        if path == "/api/v1/query":
            return self._query(body if method == "POST" else b"", params)
        if path == "/api/v1/stats":
            return 200, json.dumps(self.stats())
        if path in ("/api/v1/ingest", "/api/v1/ingest/binary"):
            if method != "POST":
                return 405, "Method not allowed"
            try:
                return self._ingest(body[: _LIMITS[path]], path.endswith("binary"))
            except ValueError as e:
                return 400, str(e)
        return 404, "not found"

    def _ingest(self, body: bytes, binary: bool) -> tuple[int, str]:
        if binary:
            rows = [{"ts_ns": t, "level": v, "service": s, "message": m, "labels": None, "data": None} for t, v, s, m in decode_batch(body, self.now_ns())]
        else:
            rows = decode_body(body, self.now_ns())
        self.add(rows)
        return 200, json.dumps({"status": "ok", "ingested": len(rows)})

    def add(self, rows: list[dict]) -> None:
        for i, r in enumerate(rows, self.ids.take(len(rows))):
            r["id"] = i
        if rows:
            spark = self.store.spark
            narrow = lambda v: v - 256 if v > 127 else v
            self.store.append(spark.createDataFrame([(r["id"], r["ts_ns"], narrow(r["level"]), r["service"], r["message"], r["labels"], r["data"]) for r in rows], ENTRY))
        from logmill.functions.levels import NAMES

        for r in rows:
            self.hub.publish(r | {"level_name": NAMES[r["level"]] if r["level"] in range(6) else NAMES[0]})

    def _logs(self):
        from logmill.schema import canonical

        return self.store.read() if self.store.files() else canonical(self.store.spark.createDataFrame([], ENTRY))

    def _query(self, body: bytes, params: dict) -> tuple[int, str]:
        from dataclasses import replace

        q = replace(from_http(body, params), compat=self.compat)
        return 200, run(self._logs(), q, self.now_ns()).to_json()

    def stats(self) -> dict:
        return self._stats.summary(len(self.hub))


def ws_frame(text: str, opcode: int = 1) -> bytes:
    """An unmasked WebSocket frame."""
    raw = text.encode()
    n = len(raw)
    head = bytes([0x80 | opcode]) + (bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n) if n < 1 << 16 else b"\x7f" + struct.pack(">Q", n))
    return head + raw


def serve(service: Service, host: str = "127.0.0.1", port: int = 9428) -> ThreadingHTTPServer:
    """A server that is ready to serve_forever()."""
    names = itertools.count(1)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def _answer(self) -> None:
            if urlsplit(self.path).path == "/api/v1/tail" and self.headers.get("Upgrade", "").lower() == "websocket":
                return self._tail()
            most = _LIMITS.get(urlsplit(self.path).path.rstrip("/"), QUERY_BODY_BYTES)
            size = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(min(size, most))
            if size > most:
                self.close_connection = True  # the rest stays unread
            status, text = service.handle(self.command, self.path, body)
            raw = text.encode()
            self.send_response(status)
            for k, v in _CORS.items():
                self.send_header(k, v)
            kind = "image/svg+xml" if text == ICON else "application/json" if text[:1] in ("{", "[") else "text/plain; charset=utf-8"
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_OPTIONS = do_PUT = do_DELETE = _answer

        def _tail(self) -> None:
            accept = base64.b64encode(hashlib.sha1((self.headers.get("Sec-WebSocket-Key", "") + _WS_KEY).encode()).digest()).decode()
            self.send_response(101)
            for k, v in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", accept)):
                self.send_header(k, v)
            self.end_headers()
            self.close_connection = True
            self.connection.settimeout(5)
            name = f"ws-{next(names)}"
            text = parse_qs(urlsplit(self.path).query).get("filter", [""])[0]
            inbox = service.hub.subscribe(name, text)
            try:
                while True:
                    try:
                        self.wfile.write(ws_frame(as_json(inbox.get(timeout=PING_S))))
                    except queue.Empty:
                        self.wfile.write(ws_frame("", 9))
            except OSError:
                pass
            finally:
                service.hub.unsubscribe(name)

    return ThreadingHTTPServer((host, port), Handler)
