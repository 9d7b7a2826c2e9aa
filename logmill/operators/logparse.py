"""Raw log lines of many layouts into entries with timestamp, level, component and message.

A weighted grammar describes headers, their fields and continuations over lexical classes; operators.earley finds the
best parse. A line whose best parse is a header starts an entry, every other line continues its sender's last one.
Lines are parsed where they are read; then each sender's lines are put together in blocks of their ids, so that no task
holds a whole sender.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions.entries import int_div
from logmill.operators.earley import Grammar, Parser

BLOCK = 1 << 16

# Level aliases of the data model, and the severities of a syslog priority.
ALIASES = {
    "DEBUG": "DEBUG", "DBG": "DEBUG", "TRACE": "DEBUG", "INFO": "INFO", "INF": "INFO", "NOTICE": "INFO", "WARN": "WARN", "WARNING": "WARN",
    "ERROR": "ERROR", "ERR": "ERROR", "FATAL": "FATAL", "CRITICAL": "FATAL", "EMERGENCY": "FATAL", "PANIC": "FATAL",
}
LETTERS = {"T": "TRACE", "D": "DEBUG", "I": "INFO", "N": "NOTICE", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "CRITICAL", "P": "PANIC"}
SEVERITIES = {0: "ERROR", 1: "ERROR", 2: "ERROR", 3: "ERROR", 4: "WARN", 5: "INFO", 6: "INFO", 7: "DEBUG"}
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
#: Names that a field goes by in structured lines, lower case.
FIELD_NAMES = {
    "ts": {"ts", "time", "timestamp", "@timestamp", "datetime", "asctime"},
    "lvl": {"level", "lvl", "severity", "levelname", "loglevel"},
    "comp": {"component", "logger", "svc", "service", "unit", "program", "module", "source"},
    "msg": {"msg", "message", "text"},
}
FIELD_OF = {name: kind for kind, names in FIELD_NAMES.items() for name in names}

GRAMMAR = Grammar(
    """
# A line is a header with its message, or else a continuation; headers differ in how much they claim.
Line 0   = REST
Line 12  = '<' Pri '>' d1 sp TsIso sp Host sp Comp sp Id sp Id sp Sd sp REST
Line 11  = '<' Pri '>' d1 sp TsIso sp Host sp Comp sp Id sp Id sp Sd END
Line 10  = '<' Pri '>' TsBsd sp Host sp Comp Pid? ':' Gap REST
Line 9   = '<' Pri '>' TsBsd sp Host sp Comp Pid? ':' END
Line 9   = TsBsd sp Host sp Comp Pid? ':' Gap REST
Line 9   = '<' Pri '>' TsIso sp Host sp Comp Pid? ':' Gap REST
Line 10  = Letter TsGlog Gap Num sp Comp ':' Num ']' sp REST
Line 9   = Letter TsGlog Gap Num sp Comp ':' Num ']' END
Line 10  = '[' TsClf ']' sp '[' Comp ']' sp '[' Level ']' sp REST
Line 9   = '[' TsClf ']' sp '[' Comp ']' sp '[' Level ']' END
Line 10  = ansi TsIso ansi sp ansi Gap? Level Gap? ansi sp Comp ':' sp REST
Line 9   = ansi TsIso ansi sp ansi Gap? Level Gap? ansi sp Comp ':' END
Line 8   = TsIso Gap Known Gap Comp ':' sp REST
Line 8   = TsIso Gap '[' Known ']' Gap Comp ':' sp REST
Line 8   = '[' TsIso ']' Gap '['? Known ']'? Gap Comp ':' sp REST
Line 9   = TsIso Gap '[' Thread ']' Gap Known Gap Comp sp '-' sp REST
Line 9   = TsIso Gap Known Gap Num sp '-' '-' '-' sp '[' Gap? Thread ']' sp Comp Gap? ':' sp REST
Line 10  = TsDash sp Zone sp '[' Num ']' sp Comp sp Level ':' Gap REST
Line 9   = TsDash sp Zone sp '[' Num ']' sp Comp sp Level ':' END
Line 10  = TsDash sp '-' sp Comp sp '-' sp Level sp '-' sp REST
Line 9   = TsDash sp '-' sp Comp sp '-' sp Level sp '-' END
Line 10  = TsDash sp Level Gap '[' Thread ']' sp Comp sp '-' sp REST
Line 9   = TsDash sp Level Gap '[' Thread ']' sp Comp sp '-' END
Line 4   = TsIso Gap '['? Known ']'? Gap REST
Line 3   = '[' TsIso ']' Gap '['? Known ']'? Gap REST
Line 2   = TsIso Gap Junk Gap Loud ':'? Gap REST
Line 2   = '[' TsIso ']' Gap Junk Gap Loud ':'? Gap REST
Line 10  = Pairs END
Line 10  = '{' Members '}' END

# Headers made of key=value pairs in any order, of which one is the time.
Pairs = TsPair | Timeless sp TsPair | Pairs sp Pair | Pairs sp TsPair
Timeless = Pair | Timeless sp Pair
TsPair 1 = w_ts '=' TsValue
Pair 1 = w_lvl '=' LvlValue | w_comp '=' CompValue | w_msg '=' MsgValue
Pair = Key '=' | Key '=' Extra
Key = KeyTok | Key KeyTok
KeyTok = Word | Digits | '.' | '_' | '-' | '/' | '@' | ':' | '$' | '#'
TsValue = Bare | qs
LvlValue = Bare | qs
CompValue = Bare | qs
MsgValue = Bare | qs
Extra = Bare | qs
Bare = BareTok | Bare BareTok
BareTok = Word | Digits | '-' | '.' | ':' | '/' | '_' | '+' | '@' | ',' | '[' | ']' | '(' | ')' | '<' | '>' | '$' | '#' | '%' | '&' | '*' | ';' | '!' | '?' | '~' | '{' | '}' | '|' | oth

# JSON objects; the lexer drops blanks there and takes a number as one token.
Members = TsMember | Others ',' TsMember | Members ',' Member | Members ',' TsMember
Others = Member | Others ',' Member
TsMember 1 = j_ts ':' JTs
Member 1 = j_lvl ':' JLvl | j_comp ':' JComp | j_msg ':' JMsg
Member = Str ':' Value
JTs = Str | num
JLvl = Str | num
JComp = Str
JMsg = Str
Str = j | j_ts | j_lvl | j_comp | j_msg
Value = Str | num | jw | Object | Array
Object = '{' '}' | '{' Inner '}'
Inner = Str ':' Value | Inner ',' Str ':' Value
Array = '[' ']' | '[' Values ']'
Values = Value | Values ',' Value

TsIso 2 = d4 '-' d2 '-' d2 T Clock Frac? Offset?
TsIso 2 = d4 '-' d2 '-' d2 sp Clock Frac? Offset?
TsDash 2 = d4 '-' d2 '-' d2 sp Clock Frac?
TsClf 2 = d2 '/' mon '/' d4 ':' Clock sp Offset
TsBsd 2 = mon Gap DayNo sp Clock
TsGlog 2 = d4 sp Clock Frac
Clock = d2 ':' d2 ':' d2
Frac = '.' Digits | ',' Digits
Offset = Z | '+' d2 ':' d2 | '-' d2 ':' d2 | '+' d4 | '-' d4
DayNo = d1 | d2
Zone = Word
Digits = d1 | d2 | d4 | dn
Num = d1 | d2 | d4 | dn
Pri = d1 | d2 | dn
Pid = '[' Num ']'
Gap = sp | sps
Letter = I | W | E | F | D | T | C | N | P
Level 1 = LVL | lvl
Level = Letter
Level -1 = Word
Known 1 = LVL | lvl
Known = Letter
Loud 1 = LVL
Loud = '[' Known ']'
Word = w | LVL | lvl | mon | T | Z | I | W | E | F | D | C | N | P | w_ts | w_lvl | w_comp | w_msg
Comp = CompTok | Comp CompTok
CompTok = Word | Digits | '.' | '/' | '_' | '-' | '$' | '@' | '#'
Host = Dense
Id = Dense
Dense = DenseTok | Dense DenseTok
DenseTok = Word | Digits | '-' | '.' | ':' | '/' | '_' | '@' | '[' | ']' | '#' | '+'
Sd = '-' | Elems
Elems = Elem | Elem Elems
Elem = '[' Dense ']' | '[' Dense Params ']'
Params = Param | Param Params
Param = sp Dense '=' qs
Thread = ThreadTok | Thread ThreadTok
ThreadTok = Word | Digits | sp | '-' | '.' | ':' | '/' | '_' | '#' | '$' | '@'
# Words before a level that must then be upper case or in brackets, as words of a message are level names too.
Junk -1 = JunkWord
Junk = Junk Gap JunkWord
JunkWord = JunkTok | JunkWord JunkTok
JunkTok = BareTok | '=' | qs
"""
)
CAPTURES = frozenset("Pri TsIso TsBsd TsGlog TsClf TsDash Letter Level Known Loud Comp TsValue LvlValue CompValue MsgValue JTs JLvl JComp JMsg Junk".split())

_LEXER = re.compile(
    r"""(?P<ansi>\x1b\[[0-9;]*[A-Za-z])|(?P<qs>"(?:[^"\\]|\\.)*")|(?P<dig>[0-9]+)|(?P<word>[^\W\d_]+|[^\W0-9_]+)|(?P<sp>[ \t ]+)|(?P<punct>.)""", re.S
)
_JSON_LEXER = re.compile(r"""\s*(?:(?P<qs>"(?:[^"\\]|\\.)*")|(?P<num>-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(?P<word>true|false|null)|(?P<punct>[^\s]))""", re.S)
_PUNCT = frozenset("<>[]{}()-:./_+@,=$#%&*;!?~|")
_DIGITS = {1: "d1", 2: "d2", 4: "d4"}


@lru_cache(50_000)
def _word_class(w: str) -> str:
    if w in LETTERS or w in ("T", "Z"):
        return w
    if w.upper() in ALIASES:
        return "LVL" if w in ALIASES else "lvl"
    if w in MONTHS:
        return "mon"
    return "w_" + FIELD_OF[w.lower()] if w.lower() in FIELD_OF else "w"


@lru_cache(50_000)
def _string_class(s: str) -> str:
    name = FIELD_OF.get(s[1:-1].lower())
    return "j_" + name if name else "j"


def _tokens(line: str, spans: list[tuple[int, int]]) -> Iterator[str]:
    """Token classes of a line, one at a time; where each lies is added to spans."""
    if line.startswith("{"):
        at, match, tail = 0, _JSON_LEXER.match, len(line.rstrip())
        while at < tail:
            m = match(line, at)
            at = m.end()
            kind, text = m.lastgroup, m[m.lastgroup]
            spans.append((at - len(text), at))
            yield _string_class(text) if kind == "qs" and len(text) < 24 else "j" if kind == "qs" else "num" if kind == "num" else "jw" if kind == "word" else text
        return
    at, match, end = 0, _LEXER.match, len(line)
    while at < end:
        m = match(line, at)
        spans.append((at, at := m.end()))
        kind = m.lastgroup
        if kind == "dig":
            yield _DIGITS.get(at - spans[-1][0], "dn")
        elif kind == "word":
            yield _word_class(m[0]) if at - spans[-1][0] < 24 else "w"
        elif kind == "sp":
            yield "sp" if m[0] == " " else "sps"
        elif kind == "punct":
            yield m[0] if m[0] in _PUNCT else "oth"
        else:
            yield kind


#: Characters from which key=value lines and JSON objects, which no other rule can fit, are read without charts, for speed only.
LONG = 1024
_PAIR = re.compile(r"[^\s=]+=")
_WORDS = frozenset({"w", "LVL", "lvl", "mon", "T", "Z", *LETTERS, *("w_" + k for k in FIELD_NAMES)})
_DIGIT_RUNS = frozenset({"d1", "d2", "d4", "dn"})
_KEYS = _WORDS | _DIGIT_RUNS | frozenset("._-/@:$#")
_BARE = _WORDS | _DIGIT_RUNS | (_PUNCT - {"="}) | {"oth"}
_STRINGS = frozenset({"j", *("j_" + k for k in FIELD_NAMES)})
_ATOMS = _STRINGS | {"num", "jw"}
#: Names of the grammar for the values of known fields, and which values these may have in JSON objects.
_PAIR_VALUES = {"w_ts": "TsValue", "w_lvl": "LvlValue", "w_comp": "CompValue", "w_msg": "MsgValue"}
_MEMBER_VALUES = {"j_ts": ("JTs", _STRINGS | {"num"}), "j_lvl": ("JLvl", _STRINGS | {"num"}), "j_comp": ("JComp", _STRINGS), "j_msg": ("JMsg", _STRINGS)}


def _long_pairs(kinds: list[str]) -> list[tuple[str, int, int]] | None:
    """What the grammar's ``Pairs END`` captures of a line, in linear time; None if the line is no such one."""
    found, at, end = [], 0, len(kinds)
    while True:
        key = at
        while at < end and kinds[at] in _KEYS:
            at += 1
        if at == key or at == end or kinds[at] != "=":
            return None
        at += 1
        till = at
        if till < end and kinds[till] == "qs":
            till += 1
        else:
            while till < end and kinds[till] in _BARE:
                till += 1
        if at == key + 2 and kinds[key] in _PAIR_VALUES and till > at:
            found.append((_PAIR_VALUES[kinds[key]], at, till))
        if till == end:
            return found if any(f[0] == "TsValue" for f in found) else None
        if kinds[till] != "sp":
            return None
        at = till + 1


def _long_value(kinds: list[str], at: int) -> int:
    """The end of the JSON value that begins at a token, -1 if none does. kinds ends with an empty string."""
    inside: list[str] = []
    while True:
        k = kinds[at]
        at += 1
        if k in ("{", "["):
            if kinds[at] == ("}" if k == "{" else "]"):
                at += 1
            else:
                inside.append(k)
                if k == "{":
                    if kinds[at] not in _STRINGS or kinds[at + 1] != ":":
                        return -1
                    at += 2
                continue
        elif k not in _ATOMS:
            return -1
        while inside and kinds[at] == ("}" if inside[-1] == "{" else "]"):
            inside.pop()
            at += 1
        if not inside:
            return at
        if kinds[at] != ",":
            return -1
        at += 1
        if inside[-1] == "{":
            if kinds[at] not in _STRINGS or kinds[at + 1] != ":":
                return -1
            at += 2


def _long_members(kinds: list[str]) -> list[tuple[str, int, int]] | None:
    """The same for ``'{' Members '}' END``."""
    found, at, end = [], 1, len(kinds)
    kinds = [*kinds, "", ""]
    while at + 3 < end and kinds[at] in _STRINGS and kinds[at + 1] == ":":
        name, values = _MEMBER_VALUES.get(kinds[at], ("", ()))
        if kinds[at + 2] in values:
            found.append((name, at + 2, at + 3))
        at = _long_value(kinds, at + 2)
        if at < 0:
            return None
        if kinds[at] == "}":
            return found if at + 1 == end and any(f[0] == "JTs" for f in found) else None
        if kinds[at] != ",":
            return None
        at += 1
    return None


@lru_cache(20_000)
def _day_us(y: int, m: int, d: int) -> int | None:
    try:
        return (date(y, m, d).toordinal() - 719_163) * 86_400_000_000
    except ValueError:
        return None


def _frac_us(f: str) -> int:
    return int((f + "000000")[:6]) if f else 0


_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?\s*(?:([Zz])|([+-])(\d\d):?(\d\d))?$")
_BSD = re.compile(r"(\w{3})\s+(\d+) (\d\d):(\d\d):(\d\d)$")
_GLOG = re.compile(r"(\d\d)(\d\d) (\d\d):(\d\d):(\d\d)\.(\d+)$")
_CLF = re.compile(r"(\d\d)/(\w{3})/(\d{4}):(\d\d):(\d\d):(\d\d) ([+-])(\d\d):?(\d\d)$")
_EPOCH = re.compile(r"(\d+)(?:\.(\d+))?$")


def _us(day: int | None, h: str, m: str, s: str, frac: str = "", sign: str | None = None, oh: str = "0", om: str = "0") -> int | None:
    if day is None or int(h) > 24 or int(m) > 59 or int(s) > 60:
        return None
    off = (int(oh) * 60 + int(om)) * 60_000_000 * (-1 if sign == "-" else 1) if sign else 0
    return day + (int(h) * 3600 + int(m) * 60 + int(s)) * 1_000_000 + _frac_us(frac) - off


@lru_cache(4096)
def _year_of(ts_ns_day: int) -> int:
    return date.fromordinal(719_163 + ts_ns_day).year


def _year(ts_ns: int | None) -> int | None:
    if ts_ns is None or not 0 <= ts_ns // 86_400_000_000_000 < 2_000_000:
        return None
    return _year_of(ts_ns // 86_400_000_000_000)


def parse_time(text: str, arrival_ns: int | None) -> int | None:
    """µs since the epoch of a header's time, None if it is no time; a missing zone is UTC, a missing year that of arrival."""
    if m := _ISO.match(text):
        y, mo, d, h, mi, s, f, _, sign, oh, om = m.groups()
        return _us(_day_us(int(y), int(mo), int(d)), h, mi, s, f or "", sign, oh or "0", om or "0")
    if m := _GLOG.match(text):
        mo, d, h, mi, s, f = m.groups()
        y = _year(arrival_ns)
        return None if y is None else _us(_day_us(y, int(mo), int(d)), h, mi, s, f)
    if m := _BSD.match(text):
        y = _year(arrival_ns)
        return None if y is None or m[1] not in MONTHS else _us(_day_us(y, MONTHS[m[1]], int(m[2])), m[3], m[4], m[5])
    if m := _CLF.match(text):
        return None if m[2] not in MONTHS else _us(_day_us(int(m[3]), MONTHS[m[2]], int(m[1])), m[4], m[5], m[6], "", m[7], m[8], m[9])
    if m := _EPOCH.match(text):
        whole, f = m.groups()
        n = len(whole)
        if n <= 11:
            return int(whole) * 1_000_000 + _frac_us(f or "")
        return int(whole) * 1000 + _frac_us((f or ""))//1000 if n <= 14 else int(whole) if n <= 17 else int(whole) // 1000
    return None


def _plain(text: str) -> str:
    """The text of a JSON or key=value string without its quotes and escapes; anything else stays."""
    if len(text) >= 2 and text[0] == text[-1] == '"':
        if "\\" not in text:
            return text[1:-1]
        try:
            return json.loads(text, strict=False)
        except ValueError:
            return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text


def level_of(word: str) -> str:
    """Level name of a word: by the aliases, a single letter for its word, anything else INFO."""
    w = word.strip().upper()
    return ALIASES.get(LETTERS.get(w, w), "INFO")


class LineParser:
    """Parses single lines; keeps its charts between them."""

    def __init__(self) -> None:
        self.parser = Parser(GRAMMAR, CAPTURES)

    def __call__(self, line: str | None, arrival_ns: int | None) -> tuple | None:
        """(ts_us, level, component, message, unparsed spans) of a header line, None for any other line."""
        if not line:
            return None
        line = line.rstrip("\r\n")
        spans: list[tuple[int, int]] = []
        if len(line) > LONG and (line[0] == "{" or _PAIR.match(line)):
            # No other rule begins so, and these two need no charts.
            kinds = list(_tokens(line, spans))
            whole = _long_members(kinds) if line[0] == "{" else _long_pairs(kinds)
            best = whole and (1.0, whole, len(kinds))
        else:
            best = self.parser.parse(_tokens(line, spans))
        if best is None or best[0] <= 0:
            return None
        _, found, n = best
        ts = level = pri = comp = msg = None
        lost: list[str] = []
        for name, a, b in found:
            text = line[spans[a][0] : spans[b - 1][1]]
            if name[:2] == "Ts" or name == "JTs":
                ts = text if ts is None else ts
            elif name == "Pri":
                pri = int(text)
            elif name in ("Level", "Known", "Loud", "Letter", "LvlValue", "JLvl"):
                level = _plain(text).strip("[]") if level is None else level
            elif name in ("Comp", "CompValue", "JComp"):
                comp = _plain(text) if comp is None else comp
            elif name in ("MsgValue", "JMsg"):
                msg = _plain(text) if msg is None else msg
            elif name == "Junk":
                lost.append(f"{spans[a][0]}-{spans[b - 1][1]}")
        us = parse_time(_plain(ts), arrival_ns)
        if us is None and not re.match(r"\w{3} |\d{4} ", ts):
            return None  # shaped like a time, but none
        if msg is None and line[:1] != "{" and not any(x[0] == "TsValue" for x in found):
            msg = line[spans[n - 1][1] :] if n else line
        name = SEVERITIES[pri & 7] if pri is not None else level_of(level) if level is not None else "UNKNOWN"
        return us, name, comp, (msg or "").rstrip("\r\n"), lost


PARSED = pa.schema([("id", pa.int64()), ("sender", pa.string()), ("head", pa.bool_()), ("ts_us", pa.int64()), ("level", pa.string()), ("component", pa.string()), ("message", pa.string()), ("unparsed", pa.string())])
PARSED_DDL = "id bigint, sender string, head boolean, ts_us bigint, level string, component string, message string, unparsed string"


@lru_cache(1)
def _parser() -> LineParser:
    """One for each Python worker, which serves many tasks: they share its charts."""
    return LineParser()


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parse = _parser()
    for batch in batches:
        out: list[tuple] = []
        lines = batch.column("message").to_pylist()
        for line, ns in zip(lines, batch.column("ts_ns").to_pylist()):
            got = parse(line, ns)
            if got is None:
                out.append((False, None, None, None, None, f"0-{len(line)}" if line else None))
            else:
                out.append((True, *got[:4], ",".join(got[4]) or None))
        cols = list(zip(*out)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sender"), *(pa.array(c, type=PARSED.field(i + 2).type) for i, c in enumerate(cols))], schema=PARSED)


def parse_lines(raw: DataFrame) -> DataFrame:
    """Each line parsed alone: id, sender, head and, if it is a header, its fields; unparsed has the spans no rule names."""
    return raw.select("id", "ts_ns", F.element_at("labels", "sender").alias("sender"), "message").mapInArrow(_parse_batches, PARSED_DDL)


def _group():
    return Window.partitionBy("sender", "open", "k")


def _fold(pieces: DataFrame) -> DataFrame:
    """Join the open pieces of each sender and block k, in order of id, to entries and what is left open at the block's ends.

    A piece has the n lines from its id on. One without head joins the piece before it. Left open are the last head, and the
    lines before the first. Pieces that aren't open stay as they are, in groups of their own.
    """
    whole, w = _group(), _group().orderBy("id")
    seen = pieces.withColumns({
        "before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(whole), "first": F.row_number().over(w) == 1,
    }).filter("head or first")
    ends = seen.withColumns({"till": F.coalesce(F.lead("before").over(w), F.col("all")), "last": F.lead("before").over(w).isNull()})
    joined = ends.withColumn("n", F.when(F.col("open"), F.col("till") - F.col("before")).otherwise(F.col("n")))
    return joined.withColumn("open", F.col("open") & (F.col("last") | ~F.col("head"))).drop("before", "all", "first", "till", "last")


def assemble(parsed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Entries of parsed lines: first_id, sender, n_lines and the fields of the first line.

    Lines are joined within (sender, block of ids); what stays open at the ends of blocks, two rows of each at most, within
    blocks of blocks; and what stays open of these in one step for each sender.
    """
    at = lambda width: int_div(F.col("id"), width)
    wider = lambda df, k: df.withColumn("k", F.when(F.col("open"), k).otherwise(at(block)))
    pieces = parsed.withColumns({"n": F.lit(1).cast("bigint"), "open": F.lit(True), "k": at(block)})
    once = pieces.withColumn("_p", F.lag("id").over(_group().orderBy("id"))).filter("_p is null or _p <> id").drop("_p")
    second = _fold(wider(_fold(once), at(block * block)))
    third = _fold(wider(second, F.lit(0).cast("bigint")))
    return third.filter("head").select(F.col("id").alias("first_id"), "sender", F.col("n").alias("n_lines"), "ts_us", "level", "component", "message", "unparsed")


def entries_of_lines(raw: DataFrame) -> DataFrame:
    """One row per logged entry of raw lines: first_id, n_lines, ts_us, level, component, message.

    Lines before a sender's first header belong to no entry. Lines with a null sender form one stream. Null or empty
    messages are continuations. Lines with a null id come first in their stream. Replayed rows count once. ts_us is null
    where the header lacks the year and the line its arrival. Lines and headers of any length are parsed as a whole. Lines
    with equal ids are one line. An empty table gives no rows; further columns are not read.
    """
    return assemble(parse_lines(raw)).select("first_id", "n_lines", "ts_us", "level", "component", "message")
