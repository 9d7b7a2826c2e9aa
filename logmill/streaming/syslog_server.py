"""Syslog over UDP and TCP as a streaming source: a datagram, or a line of a connection, is a frame.

The listener spools frames to files in a folder that the cluster shares, each file complete when it appears. The stream
reads these files, so a frame can be read again after a failure; only what hasn't been spooled yet is lost with the
listener.
"""

from __future__ import annotations

import json
import os
import socketserver
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

DATAGRAM_BYTES = 65_535


class Spool:
    """Writes frames to files, a file when enough frames or time have gathered."""

    def __init__(self, folder: str, frames: int = 10_000, seconds: float = 1.0):
        self.folder, self.frames, self.seconds = folder, frames, seconds
        os.makedirs(folder, exist_ok=True)
        self._lock, self._rows, self._done = threading.Lock(), [], threading.Event()
        threading.Thread(target=self._tick, daemon=True).start()

    def add(self, raw: str, sender: str) -> None:
        with self._lock:
            self._rows.append(json.dumps({"raw": raw, "sender": sender}))
            full = len(self._rows) >= self.frames
        if full:
            self.flush()

    def flush(self) -> None:
        """Write what has gathered. A name with a leading dot is no input until it is renamed."""
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            name = f"{uuid.uuid4().hex}.json"
            with open(os.path.join(self.folder, "." + name), "w", encoding="utf-8") as f:
                f.write("\n".join(rows) + "\n")
                f.flush()
                os.fsync(f.fileno())
            os.rename(os.path.join(self.folder, "." + name), os.path.join(self.folder, name))

    def _tick(self) -> None:
        while not self._done.wait(self.seconds):
            self.flush()

    def close(self) -> None:
        self._done.set()
        self.flush()


class SyslogListener:
    """UDP and TCP sockets that fill a spool. Port 0 takes any free port."""

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 5514, frames: int = 10_000, seconds: float = 1.0):
        self.host, self.spool = host, (spool := Spool(folder, frames, seconds))

        class Udp(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                data = self.request[0][:DATAGRAM_BYTES]
                if data:
                    spool.add(data.decode("utf-8", "replace"), self.client_address[0])

        class Tcp(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                for line in self.rfile:
                    text = line.decode("utf-8", "replace").rstrip("\r\n")
                    if text:
                        spool.add(text, self.client_address[0])

        self.udp = socketserver.ThreadingUDPServer((host, port), Udp)
        self.udp.max_packet_size = DATAGRAM_BYTES
        self.port = self.udp.server_address[1]
        self.tcp = socketserver.ThreadingTCPServer((host, self.port), Tcp)
        self.udp.daemon_threads = self.tcp.daemon_threads = True
        for server in (self.udp, self.tcp):
            threading.Thread(target=server.serve_forever, daemon=True).start()

    def stop(self) -> None:
        for server in (self.udp, self.tcp):
            server.shutdown()
            server.server_close()
        self.spool.close()


def spooled(spark: SparkSession, folder: str, most_files: int | None = None) -> DataFrame:
    """The frames of a spool as a stream: raw, sender. most_files bounds what a trigger takes."""
    reader = spark.readStream.schema("raw string, sender string")
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).json(folder)
