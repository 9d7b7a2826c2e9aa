"""The server command: the HTTP surface and the syslog listener over one store.

    logmill serve -http :9428 -syslog :9429 -data DIR      (python -m logmill.cli serve ...)

Syslog frames are spooled to files below the data folder and streamed into the store from there. stop() takes nothing
more in, stores what has arrived, and then ends.
"""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from logmill.functions.syslog import parse_syslog
from logmill.service import Service, serve
from logmill.store import LogStore
from logmill.streaming.ingest import drain, ingest
from logmill.streaming.syslog_server import SyslogListener, spooled
from logmill.streaming.tail import Hub

HTTP, SYSLOG, DATA = ":9428", ":9429", "./data"


def address(text: str) -> tuple[str, int]:
    """Host and port of an address such as :9428 (any host) or 127.0.0.1:0 (any port)."""
    host, _, port = text.rpartition(":")
    return host or "0.0.0.0", int(port)


class Server:
    """data must be a folder that all executors share, and that this process can write."""

    def __init__(self, spark: SparkSession, data: str = DATA, http: str = HTTP, syslog: str = SYSLOG, compat: str = "strict", now_ns: Callable[[], int] = time.time_ns, seconds: float = 1.0):
        data = data.rstrip("/")
        self.store = LogStore(spark, f"{data}/store")
        self.hub = Hub(compat)
        self.service = Service(self.store, self.hub, compat, now_ns)
        self.http = serve(self.service, *address(http))
        self.listener = SyslogListener(f"{data}/spool", *address(syslog), seconds=seconds)
        frames = spooled(spark, f"{data}/spool")
        self.stream = ingest(
            parse_syslog(frames, None, compat), self.store, f"{data}/syslog_checkpoint", now_ns, {"processingTime": f"{seconds} seconds"}, self.hub.on_batch, self.service.ids
        )
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    @property
    def addresses(self) -> tuple[tuple[str, int], tuple[str, int]]:
        return self.http.server_address[:2], (self.listener.host, self.listener.port)

    def stop(self) -> None:
        """In this order: no more frames, the spooled ones stored, no more requests."""
        self.listener.stop()
        drain(self.stream)
        self.stream.stop()
        self.http.shutdown()
        self.http.server_close()


def main(spark: SparkSession, args, out) -> int:
    server = Server(spark, args.data, args.http, args.syslog, args.compat)
    done = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: done.set())
    (host, port), (_, syslog_port) = server.addresses
    print(f"serving http://{host}:{port}, syslog on port {syslog_port}, data in {args.data}", file=out, flush=True)
    done.wait()
    server.stop()
    print("all stored", file=out, flush=True)
    return 0
