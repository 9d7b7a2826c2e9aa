"""Severity levels as column expressions.

Codes: 0 UNKNOWN, 1 DEBUG, 2 INFO, 3 WARN, 4 ERROR, 5 FATAL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, DEBUG, INFO, WARN, ERROR, FATAL = range(6)
NAMES = ("UNKNOWN", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
#: The words that stand for a level; any other word stands for INFO.
WORDS = {
    DEBUG: ("DEBUG", "DBG", "TRACE"),
    INFO: ("INFO", "INF", "NOTICE"),
    WARN: ("WARN", "WARNING"),
    ERROR: ("ERROR", "ERR"),
    FATAL: ("FATAL", "CRITICAL", "EMERGENCY", "PANIC"),
}
#: The characters that are white space, the blank first.
SPACES = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(text: Column) -> Column:
    """Without white space at the ends, of any kind (trim alone knows blanks)."""
    return F.btrim(text, F.lit(SPACES))


def parse_level_name(word: str | None) -> int:
    """The level code of a word, for requests and decoders outside of Spark."""
    w = (word or "").strip().upper()
    return next((code for code, words in WORDS.items() if w in words), INFO)


def parse_level(word: Column) -> Column:
    """Level code of a word, whatever its case and surrounding space; unknown words, empty ones and null give INFO."""
    codes = F.create_map(*[F.lit(x) for code, words in WORDS.items() for w in words for x in (w, code)])
    return F.coalesce(F.try_element_at(codes, F.upper(trim_space(word))), F.lit(INFO)).cast("tinyint")


def level_name(level: Column, missing: str | None = NAMES[UNKNOWN]) -> Column:
    """Upper-case name of a level code; anything outside 1..5 is UNKNOWN, and null is `missing`."""
    out = F.when(level.isNull(), F.lit(missing).cast("string"))
    for code in range(1, 6):
        out = out.when(level == code, F.lit(NAMES[code]))
    return out.otherwise(F.lit(NAMES[UNKNOWN]))


def level_from_json(text: Column) -> Column:
    """Level code of a JSON value given as its text, null where the key is missing.

    A missing key gives UNKNOWN, a string its word's code, a whole number from 0 to 255 itself, anything else INFO.
    The text of a string keeps its quotes, so 3 and "3" differ.
    """
    t = trim_space(text)
    number = F.when(t.rlike(r"^\d{1,3}$"), t.cast("int"))
    quoted = F.regexp_extract(t, r'^"(.*)"$', 1)
    return (
        F.when(t.isNull(), F.lit(UNKNOWN))
        .when(number.between(0, 255), number)
        .when(t.startswith('"'), parse_level(quoted).cast("int"))
        .otherwise(F.lit(INFO))
        .cast("smallint")
    )
