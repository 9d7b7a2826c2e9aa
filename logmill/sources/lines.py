"""JSON, NDJSON and plain-text sources.

Two JSON decoders: `strict` keeps the rules of the store this one is compatible with; `fast` is from_json alone, which is more
lenient (it turns non-string label values into text). For the common kind of line both give the same, and so strict, too,
leaves these to from_json and the JVM; only lines that a pattern can't vouch for go to Python, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.levels import INFO, UNKNOWN, level_from_json, parse_level, parse_level_name

BODY_BYTES = 32 << 20
LINE_BYTES = 64 << 10
_NAMES = {"id", "timestamp", "level", "service", "message", "labels", "data"}
_FIELDS = "struct<ok:boolean,ts_ns:bigint,level:smallint,service:string,message:string,labels:map<string,string>,data:string>"
_FIELDS_ARROW = pa.struct([
    ("ok", pa.bool_()), ("ts_ns", pa.int64()), ("level", pa.int16()), ("service", pa.string()), ("message", pa.string()),
    ("labels", pa.map_(pa.string(), pa.string())), ("data", pa.string()),
])


class _Raw(str):
    """A number as it is written."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=_Raw, parse_float=_Raw, parse_constant=_no_constant)
#: Halves of a character beyond the basic plane that come alone.
_LONE = re.compile("[\ud800-\udfff]")


def _level(v: Any) -> int:
    if isinstance(v, _Raw):
        return int(v) if v.isdigit() and int(v) <= 255 else INFO
    return parse_level_name(v) if isinstance(v, str) else INFO


def _whole(v: Any, low: int, high: int) -> int:
    if not isinstance(v, _Raw):
        raise ValueError("no number")
    n = int(v)  # fails on fractions and exponents
    if not low <= n <= high:
        raise ValueError("out of range")
    return n


def _text(v: Any) -> str:
    if v is None:
        return ""
    if not isinstance(v, str) or isinstance(v, _Raw):
        raise ValueError("no string")
    return v if v.isascii() else _LONE.sub("\ufffd", v)


def _find(source: str, name: str) -> str | None:
    """The value of a top-level key as it is written, without the blanks around it."""
    decode, at, found = json.JSONDecoder(strict=False), 1, None
    while True:
        while source[at] in " \t\r\n,":
            at += 1
        if source[at] == "}":
            return found
        key, at = decode.raw_decode(source, at)
        while source[at] in " \t\r\n:":
            at += 1
        _, end = decode.raw_decode(source, at)
        if key.lower() == name:
            found = source[at:end]
        at = end


def decode_entry(source: str) -> dict[str, Any]:
    """One JSON object as an entry; ValueError if it is none.

    Keys match in any case and unknown ones are dropped. A missing level is UNKNOWN, null or an unknown kind INFO. Fractional
    times, label values that aren't strings and texts that are none are errors. data is kept as it is written.
    """
    source = source.strip(" \t\r\n")
    got = _DECODER.decode(source)
    if not isinstance(got, dict):
        raise ValueError("no object")
    out: dict[str, Any] = {"ts_ns": 0, "level": UNKNOWN, "service": "", "message": "", "labels": None, "data": None}
    for k, v in got.items():
        name = k.lower()
        if name not in _NAMES:
            continue
        if name == "level":
            out["level"] = _level(v)
        elif name == "data":
            out["data"] = _find(source, "data")
        elif v is None:
            continue
        elif name == "id":
            _whole(v, 0, 2**64 - 1)
        elif name == "timestamp":
            out["ts_ns"] = _whole(v, -(2**63), 2**63 - 1)
        elif name == "labels":
            if not isinstance(v, dict):
                raise ValueError("labels are no object")
            out["labels"] = {_text(a): _text(b) for a, b in v.items()}
        else:
            out[name] = _text(v)
    return out


def _split_array(source: str) -> list[str]:
    """The elements of a JSON array as they are written."""
    decode, at, out = json.JSONDecoder(strict=True), 1, []
    source = source.strip(" \t\r\n")
    json.loads(source)  # the whole must be valid
    while True:
        while source[at] in " \t\r\n,":
            at += 1
        if source[at] == "]":
            return out
        _, end = decode.raw_decode(source, at)
        out.append(source[at:end])
        at = end


def decode_body(body: bytes | str, now_ns: int) -> list[dict[str, Any]]:
    """Entries of an ingest body, ValueError if it is rejected.

    An array counts as a whole or not at all. An object of one line is one entry; one that has line ends is taken for
    lines, of which bad ones are passed over, and a line beyond 64 KiB ends the reading. Anything else is one text entry.
    Empty bodies are an error. Bytes beyond 32 MiB aren't read. Times of 0 are now_ns.
    """
    raw = (body.encode() if isinstance(body, str) else body)[:BODY_BYTES]
    text = raw.decode("utf-8", "replace").strip()
    if not text:
        raise ValueError("empty")
    if text.startswith("["):
        out = [decode_entry(x) for x in _split_array(text)]
    elif text.startswith("{") and "\n" in text:
        out = []
        for line in text.split("\n"):
            if len(line.encode()) >= LINE_BYTES:
                break
            try:
                out += [decode_entry(line)] if line.strip() else []
            except ValueError:
                continue
    elif text.startswith("{"):
        out = [decode_entry(text)]
    else:
        out = [{"ts_ns": now_ns, "level": INFO, "service": "default", "message": text, "labels": None, "data": None}]
    return [e | {"ts_ns": e["ts_ns"] or now_ns} for e in out]


def _decode_array(lines: pa.Array) -> pa.Array:
    rows, places = [], []
    for i, line in enumerate(lines.drop_null().to_pylist()):
        try:
            e = decode_entry(line)
        except (ValueError, RecursionError):
            continue
        rows.append({"ok": True, **e, "labels": list(e["labels"].items()) if e["labels"] is not None else None})
        places.append(i)
    at = np.full(len(lines), -1)
    at[np.flatnonzero(lines.is_valid().to_numpy(zero_copy_only=False))[places]] = np.arange(len(rows))
    return pa.array(rows, _FIELDS_ARROW).take(pa.array(at, mask=at < 0))


_STR = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4})*+"'
_INT = r"-?(?:0|[1-9][0-9]{0,17})"
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_MEMBER = (
    rf'"(?:timestamp"\s*:\s*{_INT}|(?:service|message)"\s*:\s*{_STR}|level"\s*:\s*(?:{_STR}|0|[1-9][0-9]{{0,2}})|id"\s*:\s*(?:0|[1-9][0-9]{{0,17}})'
    rf'|labels"\s*:\s*\{{\s*(?:{_STR}\s*:\s*{_STR}(?:\s*,\s*{_STR}\s*:\s*{_STR})*+\s*)?\}}'
    rf'|(?!(?i:id|timestamp|level|service|message|labels|data)")[^"\\\x00-\x1f]*+"\s*:\s*(?:{_STR}|{_NUMBER}|true|false|null))'
)
#: Lines that every JSON decoder reads alike: known fields of their own kinds, in lower case, and others that are no objects.
_PLAIN = rf"^\s*+\{{\s*(?:{_MEMBER}(?:\s*,\s*{_MEMBER})*+\s*)?\}}\s*+$".replace(r"\s", r"[ \t\r\n]")
_FROM_JSON = "timestamp bigint, level string, service string, message string, labels map<string,string>"


def _decode_strict(lines: DataFrame, column: str) -> DataFrame:
    """Lines with one more column e, what the strict decoder gives, null for lines that don't decode. Each step is computed once."""
    line = F.col(column)
    df = lines.withColumn("_fits", F.coalesce(line.rlike(_PLAIN) & (F.regexp_count(line, F.lit('"level"[ \\t\\r\\n]*:')) <= 1), F.lit(False)))
    df = df.withColumn("_got", F.when(F.col("_fits"), F.from_json(line, _FROM_JSON, {"mode": "PERMISSIVE"})))
    got, names = F.col("_got"), F.map_keys("_got.labels")
    df = df.withColumn("_plain", got.isNotNull() & F.coalesce(F.size(F.array_distinct(names)) == F.size(names), F.lit(True)))
    df = df.withColumn("_number", F.when(F.col("_plain"), F.regexp_extract(line, r'"level"[ \t\r\n]*:[ \t\r\n]*([0-9]+)', 1).try_cast("int")))
    number = F.col("_number")
    level = F.when(number.isNotNull(), F.when(number <= 255, number).otherwise(INFO)).when(got["level"].isNull(), UNKNOWN).otherwise(parse_level(got["level"]).cast("int"))
    jvm = F.struct(
        F.lit(True).alias("ok"), F.coalesce(got["timestamp"], F.lit(0).cast("bigint")).alias("ts_ns"), level.cast("smallint").alias("level"), F.coalesce(got["service"], F.lit("")).alias("service"),
        F.coalesce(got["message"], F.lit("")).alias("message"), got["labels"].alias("labels"), F.lit(None).cast("string").alias("data"),
    )
    # Called so only to keep filters on the result above it: pushed down, they would compute every step again.
    python = F.arrow_udf(_decode_array, _FIELDS).asNondeterministic()
    df = df.withColumn("_other", python(F.when(~F.col("_plain") & F.coalesce(F.trim(line) != "", F.lit(False)), line)))
    return df.withColumn("e", F.when(F.col("_plain"), jvm).otherwise(F.col("_other")))


def decode_lines(lines: DataFrame, column: str = "value", decoder: str = "strict", now_ns: int = 0) -> DataFrame:
    """Entries of NDJSON lines; lines that don't decode, and blank ones, are passed over. Other columns stay in front.

    Lines of any length are decoded: the 64 KiB after which decode_body stops bound what a request may bring, not a record of
    a file.
    """
    keep = [c for c in lines.columns if c != column]
    if decoder == "strict":
        got = _decode_strict(lines.select(*keep, column), column).filter("e.ok")
        e = F.col("e")
        cols = [e["ts_ns"], e["level"], e["service"], e["message"], e["labels"], e["data"]]
    elif decoder == "fast":
        schema = "timestamp bigint, level string, service string, message string, labels map<string,string>, data string, _bad string"
        parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        got = lines.select(*keep, F.col(column).alias("_l"), parsed.alias("e")).filter("trim(_l) <> '' and e._bad is null")
        e = F.col("e")
        quoted = F.get_json_object(F.col("_l"), "$.level")
        number = F.regexp_extract(F.col("_l"), r'"level"\s*:\s*(\d+|null)', 1)
        level = F.when(number != "", level_from_json(number)).otherwise(level_from_json(F.concat(F.lit('"'), quoted, F.lit('"'))))
        cols = [e["timestamp"], level, F.coalesce(e["service"], F.lit("")), F.coalesce(e["message"], F.lit("")), e["labels"], e["data"]]
    else:
        raise ValueError(decoder)
    names = ["ts_ns", "level", "service", "message", "labels", "data"]
    out = got.select(*keep, *[c.alias(n) for c, n in zip(cols, names)])
    return out.withColumn("ts_ns", default_ts(F.col("ts_ns"), now_ns)).withColumn("level", F.col("level").cast("tinyint"))


def default_ts(ts: Column, now_ns: int) -> Column:
    """A time of 0, or none, is now."""
    return F.when(F.coalesce(ts, F.lit(0)) == 0, F.lit(now_ns).cast("bigint")).otherwise(ts)


def text_entries(lines: DataFrame, now_ns: int, service: str = "default", column: str = "value") -> DataFrame:
    """Each text as one INFO entry at now_ns. Other columns stay in front."""
    keep = [c for c in lines.columns if c != column]
    return lines.select(
        *keep, F.lit(now_ns).cast("bigint").alias("ts_ns"), F.lit(INFO).cast("tinyint").alias("level"), F.lit(service).alias("service"), F.col(column).alias("message"),
        F.lit(None).cast("map<string,string>").alias("labels"), F.lit(None).cast("string").alias("data"),
    )


def read_ndjson(spark: SparkSession, path: str, now_ns: int, decoder: str = "strict") -> DataFrame:
    return decode_lines(spark.read.text(path), "value", decoder, now_ns)


def read_text(spark: SparkSession, path: str, now_ns: int, whole: bool = False, service: str = "default") -> DataFrame:
    """Text files as entries, one a line or (whole) one a file."""
    return text_entries(spark.read.text(path, wholetext=whole), now_ns, service)
