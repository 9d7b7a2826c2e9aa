"""Binary formats: batches of frames, and the write-ahead log with its entries. All numbers are little-endian.

Files are read as binaryFile rows and decoded by Arrow batches of files. Both decoders keep the valid prefix of a file
and stop at the first piece that doesn't decode; neither changes its input.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FRAMES = 500_000
MOST_RECORD_BYTES = 16 << 20
LEAST_ENTRY_BYTES = 27
BATCH_BODY_BYTES = 64 << 20
#: Records of a log whose checksums are computed together.
_RECORDS = 4096
#: Castagnoli's polynomial, reflected.
_POLYNOMIAL = 0x82F63B78

Entry = tuple[int, int, int, str, str, dict[str, str], str | None]


class DecodeError(ValueError):
    """Bytes that are no valid entry."""


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLYNOMIAL if n & 1 else 0)
        table.append(n)
    return table


_TABLE = np.array(_crc_table(), np.uint32)
#: Bytes from which a checksum is folded by halves instead of going byte by byte.
_FOLD_BYTES = 4096


@lru_cache(64)
def _shift(log2: int) -> np.ndarray:
    """Tables, one for each byte of a checksum, of what it becomes after 2 ** log2 bytes of zero."""
    if log2 == 0:
        one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        return _TABLE[one & 0xFF] ^ one >> 8
    half = _shift(log2 - 1)
    return _moved(half, half)


def _moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


def _folded(data: np.ndarray) -> int:
    """The checksum of one long text: neighbouring pieces are joined, twice as long each time. It is linear, so zeros in front change nothing."""
    n, log2 = len(data), (len(data) - 1).bit_length()
    crc = np.zeros(1 << log2, np.uint32)
    crc[len(crc) - n :] = _TABLE[data]
    for level in range(log2):
        crc = _moved(_shift(level), crc[::2]) ^ crc[1::2]
    start = np.array([0xFFFFFFFF], np.uint32)
    for level in range(n.bit_length()):
        if n >> level & 1:
            start = _moved(_shift(level), start)
    return int(crc[0] ^ start[0]) ^ 0xFFFFFFFF


def crc32c_many(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of pieces of data. Short pieces go byte by byte, all of them at a time; long ones are folded."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(sizes > _FOLD_BYTES):
        out[i] = _folded(raw[starts[i] : starts[i] + sizes[i]])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] <= _FOLD_BYTES]
    crc, at, left = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order], sizes[order]
    longer = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")  # how many pieces go on at each byte
    for k, n in enumerate(longer.tolist()):
        c = crc[:n]
        crc[:n] = _TABLE[(c ^ raw[at[:n] + k]) & 0xFF] ^ c >> 8
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(data: bytes) -> int:
    return _folded(np.frombuffer(data, np.uint8)) if data else 0


class _Reader:
    """Takes numbers and length-prefixed texts off a buffer; running past its end is an error."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def number(self, kind: str) -> int:
        size = struct.calcsize("<" + kind)
        if self.at + size > len(self.data):
            raise DecodeError("cut off")
        (n,) = struct.unpack_from("<" + kind, self.data, self.at)
        self.at += size
        return n

    def text(self, kind: str) -> str:
        n = self.number(kind)
        if self.at + n > len(self.data):
            raise DecodeError("cut off")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")


def encode_entry(entry: Entry) -> bytes:
    """id, ts, level, service, message, labels and data. A service, key or value beyond 65,535 bytes is an error."""
    ident, ts, level, service, message, labels, data = entry

    def sized(text: str | None, kind: str) -> bytes:
        raw = (text or "").encode()
        if kind == "H" and len(raw) > 0xFFFF:
            raise ValueError("longer than its length field can tell")
        return struct.pack("<" + kind, len(raw)) + raw

    pairs = b"".join(sized(k, "H") + sized(v, "H") for k, v in (labels or {}).items())
    return struct.pack("<QqB", ident, ts, level) + sized(service, "H") + sized(message, "I") + struct.pack("<H", len(labels or {})) + pairs + sized(data, "I")


def decode_entry(data: bytes) -> Entry:
    """The entry that encode_entry wrote; DecodeError if it is short or a length runs past the end."""
    if len(data) < LEAST_ENTRY_BYTES:
        raise DecodeError("too short for an entry")
    r = _Reader(data)
    ident, ts, level = r.number("Q"), r.number("q"), r.number("B")
    service, message = r.text("H"), r.text("I")
    labels = {}
    for _ in range(r.number("H")):
        key = r.text("H")
        labels[key] = r.text("H")
    return ident, ts, level, service, message, labels, r.text("I") or None


def encode_log(entries: Iterable[Entry]) -> bytes:
    """A write-ahead log file of entries."""
    out = []
    payloads = map(encode_entry, entries)
    while some := list(itertools.islice(payloads, _RECORDS)):
        sizes = np.array([len(p) for p in some])
        if sizes.max() > MOST_RECORD_BYTES:
            raise ValueError("record beyond 16 MiB")
        crcs = crc32c_many(b"".join(some), np.cumsum(sizes) - sizes, sizes).tolist()
        out += [struct.pack("<II", c, len(p)) + p for c, p in zip(crcs, some)]
    return b"".join(out)


def decode_log(data: bytes) -> Iterator[Entry]:
    """Entries of a log file up to the first record that is short, oversized, of a wrong checksum or undecodable."""
    at = 0
    while True:
        want, starts, sizes = [], [], []
        while len(starts) < _RECORDS and at + 8 <= len(data):
            crc, size = struct.unpack_from("<II", data, at)
            if size > MOST_RECORD_BYTES or at + 8 + size > len(data):
                break
            want.append(crc)
            starts.append(at + 8)
            sizes.append(size)
            at += 8 + size
        whole = len(starts) == _RECORDS
        # A record behind a bad one may be made of anything; none is given out.
        sound = crc32c_many(data, np.array(starts, np.int64), np.array(sizes, np.int64)) == np.array(want, np.uint32)
        for start, size, ok in zip(starts, sizes, sound.tolist()):
            try:
                if not ok:
                    return
                yield decode_entry(data[start : start + size])
            except DecodeError:
                return
        if not whole:
            return


def encode_batch(frames: Iterable[tuple[int, int, str, str]]) -> bytes:
    """A batch of (ts, level, service, message)."""
    rows = []
    for ts, level, service, message in frames:
        s, m = service.encode(), message.encode()
        rows.append(struct.pack("<qBH", ts, level, len(s)) + s + struct.pack("<I", len(m)) + m)
    return struct.pack("<I", len(rows)) + b"".join(rows)


def decode_batch(data: bytes, now_ns: int) -> Iterator[tuple[int, int, str, str]]:
    """Frames of a batch; a time of 0 is now_ns. Bytes beyond 64 MiB aren't read; a frame cut off ends the batch.

    A count of 0 or above 500,000, or a body too short for it, is an error.
    """
    r = _Reader(data[:BATCH_BODY_BYTES])
    n = r.number("I")
    if not 0 < n <= MOST_FRAMES:
        raise DecodeError("count out of range")
    for _ in range(n):
        try:
            ts, level = r.number("q"), r.number("B")
            service = r.text("H")
            message = r.text("I")
        except DecodeError:
            return
        yield ts or now_ns, level, service, message


_ROWS = "path string, seq bigint, id bigint, ts_ns bigint, level tinyint, service string, message string, labels map<string,string>, data string"
_ARROW = pa.schema([
    ("path", pa.string()), ("seq", pa.int64()), ("id", pa.int64()), ("ts_ns", pa.int64()), ("level", pa.int8()), ("service", pa.string()),
    ("message", pa.string()), ("labels", pa.map_(pa.string(), pa.string())), ("data", pa.string()),
])
_SLICE = 10_000


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size, so that a large file isn't held decoded."""
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == _SLICE:
            yield _batch(some)
            some = []
    if some:
        yield _batch(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    cols[7] = tuple(list(x.items()) if x is not None else None for x in cols[7])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _signed(n: int, bits: int) -> int:
    return n - (1 << bits) if n >> (bits - 1) else n


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of write-ahead log files: path, seq (place in the file) and the fields of an entry."""

    def decode(batches):
        def rows():
            for b in batches:
                for p, raw in zip(b.column("path").to_pylist(), b.column("content")):
                    for k, (i, ts, level, service, message, labels, data) in enumerate(decode_log(raw.as_py())):
                        yield p, k, _signed(i, 64), ts, _signed(level, 8), service, message, labels, data

        return _batches(rows())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, _ROWS)


def read_batches(spark: SparkSession, path: str, now_ns: int) -> DataFrame:
    """Entries of binary batch files; a file whose count is out of range gives none."""

    def decode(batches):
        def rows():
            for b in batches:
                for p, raw in zip(b.column("path").to_pylist(), b.column("content")):
                    try:
                        for k, (ts, level, service, message) in enumerate(decode_batch(raw.as_py(), now_ns)):
                            yield p, k, None, ts, _signed(level, 8), service, message, None, None
                    except DecodeError:
                        continue

        return _batches(rows())

    return spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, BATCH_BODY_BYTES).alias("content")).mapInArrow(decode, _ROWS)
