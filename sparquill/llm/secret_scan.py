"""Secret scans by assignment-aware lexing.

Source and configuration text is read as name-literal pairs (``name = "x"``, ``name: x``, ``"name": "x"``,
``NAME := x``, ``name => x``, ``m["name"] = x``, ``name: type = x``); the value may stand in parentheses, and a string on the next line.
A name that stands on the right of a later pair, or in a concatenation, is replaced
by the constant it was bound to, so a secret is found where its literal stands even if the telling name is
elsewhere.  Literals are scored by the names they flow into and by how random they look, each alone and all literals of a
concatenation as the value that they make.
The fixed patterns (assign, access, hex) are always reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import query, table

# The patterns that are always reported, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more; shorter runs would be dropped anyway
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "literal")

# Parts of names and how surely they name a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "secret": 1.0, "private_key": 1.0, "privatekey": 1.0,
    "token": 0.9, "api_key": 0.9, "apikey": 0.9, "access_key": 0.9, "accesskey": 0.9, "credential": 0.9, "pwd": 0.8, "auth": 0.6,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "dummy", "<", "${", "{{")
ACCEPT = 0.5
_EDGE = max(map(len, PLACEHOLDERS)) - 1  # of a value: what a placeholder can reach over a join

_NAME = r"[A-Za-z_][\w.\-]*"
_STRING = r'"(?:[^"\\\n]|\\.)*"' + r"|'(?:[^'\\\n]|\\.)*'"
# str, string | null, Optional[str], &'static str, Map<String, List<String>>, std::string: arguments nest once
_INNER = r"[^<>\[\]\n=\"]*+"
_TYPE = (
    r"(?:&[ \t]*+(?:'[a-z_]\w*+[ \t]++)?)?(?:mut[ \t]++)?[A-Za-z_][\w.]*+(?:::[\w.]++)*+"
    rf"(?:<{_INNER}(?:<{_INNER}>{_INNER})*+>|\[{_INNER}(?:\[{_INNER}\]{_INNER})*+\]|\?)?"
)
_BLANKS = r"[ \t\r\n]*+"
_PAIR = re.compile(
    rf"""(?<![\w.\-])({_NAME})["']?[ \t]*+(?:\][ \t]*+|\[\w*\][ \t]*+)?[?!]?"""
    rf"""(?::[ \t]*+{_TYPE}(?:[ \t]*+\|[ \t]*+{_TYPE})*[ \t]*+=(?![=>])|:=|=>|=(?![=>])|:(?!:))[ \t]*+"""
    rf"""(?=(?P<open>\({_BLANKS}(?:\({_BLANKS})*+)?(?:{_STRING}|[A-Za-z_0-9])|(?P<below>\\?\r?\n{_BLANKS}\(?{_BLANKS})(?:{_STRING})(?![ \t]*[:=]))"""
)
_OPERAND = re.compile(rf"({_STRING})|([\w.+/=\-]+)")
_JOIN = re.compile(rf"{_BLANKS}\+{_BLANKS}")
_ADJACENT = re.compile(rf"{_BLANKS}(?=[\"'])")  # between strings in parentheses


def _sensitivity(name: str) -> float:
    low = name.lower().replace("-", "_")
    return max((w for part, w in SENSITIVE.items() if part in low), default=0.0)


class Value:
    """What scoring needs to know of a value, so that joining two costs the same however long they are."""

    __slots__ = ("length", "counts", "unfit", "cased", "digit", "head", "tail", "parts", "span", "literal", "weight", "whole")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None):
        low = text.lower()
        self.length, self.counts = len(text), Counter(text)
        self.unfit = any(p in low for p in PLACEHOLDERS) or any(c.isspace() for c in text)
        self.cased = text != low, text != text.upper()
        self.digit = any(c.isdigit() for c in text)
        self.head, self.tail = low[:_EDGE], low[-_EDGE:]
        self.parts, self.span = [], span  # the values it was joined from, or the place of a literal
        self.literal = True  # not so a bare word in a concatenation, which is a name
        self.weight, self.whole = 0.0, False  # the surest name it flows into; whether it is in a value that was found

    def add(self, other: Value) -> None:
        seam = self.tail + other.head
        self.unfit = self.unfit or other.unfit or any(p in seam for p in PLACEHOLDERS)
        self.length += other.length
        self.counts.update(other.counts)
        self.cased = self.cased[0] or other.cased[0], self.cased[1] or other.cased[1]
        self.digit = self.digit or other.digit
        self.head = (self.head + other.head)[:_EDGE] if len(self.head) < _EDGE else self.head
        self.tail = (self.tail + other.tail)[-_EDGE:]

    def randomness(self) -> float:
        """0 to 1: entropy of the characters, against 4 bits each; nothing for short texts and placeholders."""
        if self.length < 8 or self.unfit:
            return 0.0
        shares = (c / self.length for c in self.counts.values())
        entropy = -sum(p * math.log2(p) for p in shares if p)
        mixed = self.digit or all(self.cased)
        return min(1.0, entropy / 4) * (1.0 if mixed else 0.6)


def _values(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of every assignment, in order.  A value refers to the constants in it and does not repeat them."""
    constants: dict[str, Value] = {}
    for match in _PAIR.finditer(text):
        at = match.end() + len(match["open"] or match["below"] or "")
        inside = "(" in (match["open"] or match["below"] or "")
        operands: list[tuple[Value, bool]] = []  # and whether it is a literal or a constant
        while operand := _OPERAND.match(text, at):
            at = operand.end()
            if operand[1] is not None:
                span = operand.start() + 1, at - 1
                operands.append((Value(text[slice(*span)], span), True))
            elif operand[2] in constants:
                operands.append((constants[operand[2]], True))
            else:
                operands.append((Value(operand[2], operand.span()), False))
            join = _JOIN.match(text, at) or (_ADJACENT.match(text, at) if inside and operand[1] is not None else None)
            if not join:
                break
            at = join.end()
        if len(operands) == 1:
            value = operands[0][0]
        else:
            value = Value()
            for part, known in operands:
                value.parts.append(part)
                part.literal = known
                if known:
                    value.add(part)
        constants[match[1]] = value
        yield match[1], value


def literals(text: str) -> set[tuple[int, int]]:
    """The spans of the literals that are secrets alone or in the value they are joined to.

    Names and findings go from the values down to their parts, each value once: later ones first, as they refer to earlier ones only.
    """
    order: dict[int, Value] = {}
    for name, value in _values(text):
        value.weight = max(value.weight, _sensitivity(name))
        for part in value.parts:
            order.setdefault(id(part), part)
        order.setdefault(id(value), value)
    found = set()
    for value in reversed(order.values()):
        value.whole = value.whole or (value.weight > 0 and value.weight * value.randomness() >= ACCEPT)
        if value.span and value.whole:
            found.add(value.span)
        for part in value.parts:
            part.weight, part.whole = max(part.weight, value.weight), part.whole or (value.whole and part.literal)
    return found


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans, as (start, place in KINDS, end), sorted."""
    low = text.lower()
    base = []
    if any(word in low for word in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found = set()
    if any(part in low or part.replace("_", "-") in low for part in SENSITIVE):
        found = {(start, 3, end) for start, end in literals(text)}
    base.sort()
    return base, sorted([*base, *found])


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, texts = [], [], []
        for text in batch.column(1):
            base, spans = scan(text.as_py() or "")
            kinds = Counter(kind for _, kind, _ in base)
            counts.append((kinds[0], kinds[1], kinds[2]))
            digests.append(hashlib.sha256(_text_of(base).encode()).hexdigest())
            texts.append(_text_of(spans))
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind: whole matches of the fixed patterns,
    and ``literal`` for literals (without quotes) that the lexer traces to a sensitive name.  The digest covers the fixed patterns only.
    Null texts count as empty.  Ids may be null or repeat.  Other columns are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan_batches, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
