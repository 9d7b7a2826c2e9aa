"""Syslog frames into entries, as column expressions alone; batch and stream use the same plan.

Strict mode follows the store this one is compatible with: a frame of RFC 5424 isn't recognised, as its version is taken
for the first word. Corrected mode reads such frames.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import date, datetime, timezone
from time import time_ns

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions.levels import DEBUG, ERROR, INFO, SPACES, WARN, trim_space

_RFC3339 = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})$"
_CLOCK = r"^(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?$"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_RFC5424 = r"^\d{1,2}\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(-|(?:\[(?:[^\]\\\"]|\\.|\"(?:[^\"\\]|\\.)*\")*\])+)(?:\s(.*))?$"


def _part(text: Column, regex: str, n: int) -> Column:
    return F.regexp_extract(text, regex, n)


def priority(text: Column) -> tuple[Column, Column, Column]:
    """(rest, PRI or null, has prefix) of a trimmed frame.

    A prefix is '<', one to four characters, '>'; it is stripped even if these aren't a number, which gives no PRI.
    """
    at = F.locate(">", text)
    has = text.startswith("<") & at.between(3, 6)
    inner = F.substring(text, F.lit(2), at - 2)
    number = F.when(has & inner.rlike(r"^[+-]?\d+$"), inner.try_cast("bigint"))
    rest = F.when(has, trim_space(F.substring(text, at + 1, F.length(text)))).otherwise(text)
    return rest, number, has


def severity_level(pri: Column) -> Column:
    """Level of a PRI by its severity: 0 to 3 ERROR, 4 WARN, 5 and 6 INFO, 7 DEBUG; null gives INFO."""
    s = pri.bitwiseAND(F.lit(7).cast("bigint"))
    return F.when(s <= 3, ERROR).when(s == 4, WARN).when(s == 7, DEBUG).otherwise(INFO).cast("tinyint")


def tokens(text: Column) -> Column:
    """Words of a frame, parted by any white space; no empty ones."""
    # A pattern of one plain character is the only one that split doesn't compile for every row.
    plain = F.when(text.rlike(r"[\t-\r\x{85}\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"), F.translate(text, SPACES, " " * len(SPACES))).otherwise(text)
    # The lambda also ends the code-generated stage: as one, its method would be too long for the JVM to compile.
    return F.filter(F.split(plain, " "), lambda t: t != "")


def _nanos(fraction: Column) -> Column:
    return F.rpad(F.substring(fraction, 1, 9), 9, "0").try_cast("bigint")  # of no digits, 0


def is_rfc3339(text: Column) -> Column:
    return text.rlike(_RFC3339)


def rfc3339_ns(text: Column) -> Column:
    """ns since the epoch of a text that is_rfc3339, null if there is no such day; nine digits of the fraction count.

    What precedes the fraction has a fixed width, and so has a zone that isn't Z.
    """
    seconds = F.unix_seconds(F.concat(F.substring(text, 1, 19), F.lit("Z")).try_cast("timestamp"))
    utc = text.endswith("Z")
    zone = F.substring(text, -6, 6)
    ahead = F.substring(zone, 2, 2).try_cast("bigint") * 3600 + F.substring(zone, 5, 2).try_cast("bigint") * 60
    offset = F.when(utc, F.lit(0)).when(zone.startswith("-"), -ahead).otherwise(ahead)
    fraction = F.substring(text, F.lit(21), F.length(text) - F.when(utc, F.lit(21)).otherwise(F.lit(26)))
    return (seconds - offset) * F.lit(1_000_000_000) + _nanos(fraction)


def month_number(word: Column) -> Column:
    """1 to 12 for the English short name of a month in any case, 0 or null for anything else."""
    return F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(word)).cast("int")


def clock_seconds(word: Column) -> Column:
    """Seconds since midnight of a clock time, null if it is none."""
    at = F.locate(":", word)
    part = lambda start, n: F.substring(word, start, n).cast("bigint")
    h, m, s = part(F.lit(1), at - 1), part(at + 1, F.lit(2)), part(at + 4, F.lit(2))
    return F.when(word.rlike(_CLOCK) & (h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def clock_nanos(word: Column) -> Column:
    """The fraction of a clock time in ns, null if it has none."""
    return F.when(F.locate(":", word) > 0, _nanos(F.substring(word, F.locate(":", word) + 7, F.lit(9))))


def month_start(month: Column, day: Column, year: int) -> Column:
    """Days since the epoch of the day before a month's first in a given year, null if the month has no such day.

    29 February of a year without one is 1 March.
    """
    first = [date(year, m, 1).toordinal() - 719_164 for m in range(1, 13)]
    last = [29 if m == 2 else monthrange(year, m)[1] for m in range(1, 13)]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), month)
    return F.when((month > 0) & (day >= 1) & (day <= of(last)), of(first).cast("bigint"))


def parse_syslog(frames: DataFrame, now_ns: int | None, compat: str = "strict") -> DataFrame:
    """Entries of frames (raw, sender): ts_ns, level, service, message, labels, data. Other columns of frames stay in front.

    An empty or null frame gives no entry; one of white space gives an entry with an empty message. Times missing or
    unreadable are now_ns; a time without a year is in now_ns' year. Labels: source, sender, and facility and host where
    known. Of a stream that runs for long now_ns is None: missing times are null then, which prepare() makes the time of storing,
    and the year is that of the plan's start.
    """
    year = datetime.fromtimestamp((time_ns() if now_ns is None else now_ns) // 1_000_000_000, timezone.utc).year
    keep = [c for c in frames.columns if c not in ("raw", "sender")]
    df = frames.filter("raw is not null and raw <> ''").withColumn("_t", trim_space(F.col("raw")))
    rest, pri, _ = priority(F.col("_t"))
    df = df.withColumn("_r", rest).withColumn("_p", pri).withColumn("_w", tokens(F.col("_r"))).withColumn("_n", F.size("_w"))
    word = lambda i: F.try_element_at("_w", F.lit(i + 1))
    long = F.col("_n") >= 4
    # One column a step: each is computed once, and the generated methods stay small enough to be compiled.
    df = df.withColumn("_mon", F.when(long, month_number(word(0))))
    df = df.withColumn("_day", F.when((F.col("_mon") > 0) & word(1).rlike(r"^\d{1,2}$"), word(1).try_cast("int")))
    df = df.withColumn("_first", F.when(F.col("_day").isNotNull(), month_start(F.col("_mon"), F.col("_day"), year)))
    df = df.withColumn("_clock", F.when(F.col("_first").isNotNull(), clock_seconds(word(2))))
    since = ((F.col("_first") + F.col("_day")) * 86_400 + F.col("_clock")) * F.lit(1_000_000_000) + F.coalesce(clock_nanos(word(2)), F.lit(0).cast("bigint"))
    df = df.withColumn("_b", F.when(F.col("_clock").isNotNull(), since))
    df = df.withColumn("_iso", F.when(F.col("_b").isNull() & is_rfc3339(word(0)), word(0)))
    df = df.withColumn("_i", F.when(F.col("_iso").isNotNull(), rfc3339_ns(F.col("_iso"))))
    bsd, iso = F.col("_b").isNotNull(), long & F.col("_i").isNotNull()
    short = (F.col("_n") < 4) & F.col("_i").isNotNull()
    df = df.withColumn("_s", F.when(bsd, 4).when(iso, 3).when(short & (F.col("_n") > 1), 1))  # words before the message
    df = df.withColumn("_a", F.when(F.col("_s").isNotNull(), F.array_join(F.slice("_w", F.col("_s") + 1, F.greatest(F.col("_n") - F.col("_s"), F.lit(0))), " ")))
    df = df.withColumn("_c", F.when(bsd, F.locate(":", F.col("_a"))))
    after, colon = F.col("_a"), F.col("_c")
    service = (
        F.when(bsd & (colon > 0), trim_space(F.substring(after, F.lit(1), colon - 1)))
        .when(bsd, F.lit("system")).when(iso, word(2)).otherwise(F.lit("system"))
    )
    message = (
        F.when(bsd & (colon > 0), trim_space(F.substring(after, colon + 1, F.length(after))))
        .when(F.col("_s").isNotNull(), after)
        .when(short, F.col("_t"))
        .otherwise(F.col("_r"))
    )
    host = F.when(bsd, word(3)).when(iso, word(1))
    ts = F.coalesce("_b", "_i", F.lit(now_ns).cast("bigint"))
    if compat == "corrected":
        v = F.col("_r").rlike(_RFC5424) & F.col("_p").isNotNull()
        g = lambda n: _part(F.col("_r"), _RFC5424, n)
        known = lambda c: F.when(c != "-", c)
        service = F.when(v, F.coalesce(known(g(3)), F.lit("system"))).otherwise(service)
        message = F.when(v, g(7)).otherwise(message)
        host = F.when(v, known(g(2))).otherwise(host)
        ts = F.when(v, F.coalesce(rfc3339_ns(g(1)), F.lit(now_ns).cast("bigint"))).otherwise(ts)
        extra = [(k, F.when(v, known(g(n)))) for k, n in (("procid", 4), ("msgid", 5), ("sd", 6))]
    else:
        extra = []
    facility = F.shiftright("_p", 3).cast("string")
    pairs = [("source", F.lit("syslog")), ("sender", F.col("sender")), ("facility", facility), ("host", host), *extra]
    labels = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))
    return df.select(*keep, ts.alias("ts_ns"), severity_level(F.col("_p")).alias("level"), service.alias("service"), message.alias("message"), labels.alias("labels"), F.lit(None).cast("string").alias("data"))
