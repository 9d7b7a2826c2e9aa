"""Live tail: stored entries fanned out to subscribers with bounded, lossy queues."""

from __future__ import annotations

import json
import queue
import threading
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from logmill.functions.levels import NAMES
from logmill.store import LogStore

QUEUE_ROWS = 1024


class Hub:
    """Subscribers by name. An entry that finds a full queue is dropped for that subscriber, and counted.

    strict passes everything to everyone; corrected applies a subscriber's filter, a text the message must contain in any case.
    """

    def __init__(self, compat: str = "strict"):
        self.compat = compat
        self._lock = threading.Lock()
        self._inboxes: dict[str, tuple[queue.Queue, str]] = {}
        self.dropped: dict[str, int] = {}

    def subscribe(self, name: str, text: str = "") -> queue.Queue:
        """A queue of entries; a second subscription by the same name takes the first one's place."""
        inbox: queue.Queue = queue.Queue(QUEUE_ROWS)
        with self._lock:
            self._inboxes[name] = (inbox, text.lower())
            self.dropped.setdefault(name, 0)
        return inbox

    def unsubscribe(self, name: str) -> None:
        with self._lock:
            self._inboxes.pop(name, None)

    def __len__(self) -> int:
        return len(self._inboxes)

    def publish(self, entry: dict[str, Any]) -> None:
        with self._lock:
            inboxes = list(self._inboxes.items())
        for name, (inbox, text) in inboxes:
            if self.compat == "corrected" and text and text not in (entry.get("message") or "").lower():
                continue
            try:
                inbox.put_nowait(entry)
            except queue.Full:
                self.dropped[name] += 1

    def on_batch(self, batch: DataFrame, number: int) -> None:
        """For ingest(also=...): passes a batch's entries on, in order of id, a partition of them in the driver at a time."""
        if not len(self):
            return
        rows = batch.orderBy("id")
        for r in rows.toLocalIterator():
            d = r.asDict(recursive=True)
            self.publish(d | {"level_name": NAMES[d["level"]] if d.get("level") in range(6) else NAMES[0]})


def follow(store: LogStore, hub: Hub, checkpoint: str | None = None) -> StreamingQuery:
    """Publish what is added to a store from now on."""
    spark = store.spark
    stream = spark.readStream.schema(store.read().schema).option("recursiveFileLookup", "false").parquet(store.path)
    writer = stream.writeStream.foreachBatch(hub.on_batch)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def as_json(entry: dict[str, Any]) -> str:
    """The message of one entry on the wire."""
    out = {"id": entry.get("id") or 0, "timestamp": entry["ts_ns"], "level": entry["level_name"], "service": entry.get("service") or "", "message": entry.get("message") or ""}
    if entry.get("labels"):
        out["labels"] = dict(entry["labels"])
    if entry.get("data"):
        try:
            out["data"] = json.loads(entry["data"])
        except ValueError:
            out["data"] = entry["data"]
    return json.dumps(out, ensure_ascii=False)


def tail_frame(entries: DataFrame) -> DataFrame:
    """The same messages as a column, for a stream that goes elsewhere."""
    return entries.select(F.to_json(F.struct("id", F.col("ts_ns").alias("timestamp"), F.col("level_name").alias("level"), "service", "message", "labels", "data")).alias("value"))
