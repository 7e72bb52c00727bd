"""Secrets in source and configuration text, by assignment-aware lexing.

Three base kinds are fixed patterns. Beside them a small lexer reads name-literal pairs around every assignment sign
(= := => :), in the syntaxes that source and configuration files share: quoted or bare names and keys, string literals
joined by + or standing side by side (over several lines within brackets), bare values. A bare value that names an
earlier constant takes that constant's literal (constants propagate through chains of names), as a summary that joins
in constant time. A pair counts as a secret by a score of the name's sensitive words and the literal's length,
character classes and entropy, less what marks placeholders.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gablework.llm.common import column_of, small_batches, text_batches, texts_of

#: Fixed: the base kinds in their order, then the lexer's.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
#: Runs are maximal, so asking for the least length finds what filtering all runs by length would.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_LEAST = 12


@dataclass(frozen=True)
class Scoring:
    """threshold: least score of a secret. least: least characters of a literal. words: sensitive words of a name and their worth."""

    threshold: float = 3.0
    least: int = 8
    words: tuple[tuple[str, float], ...] = (
        ("password", 2.0), ("passwd", 2.0), ("pwd", 2.0), ("passphrase", 2.0), ("secret", 2.0), ("token", 1.6), ("apikey", 2.0),
        ("credential", 1.6), ("credentials", 1.6), ("bearer", 1.6), ("private", 1.0), ("auth", 1.0), ("key", 1.0), ("access", 0.6),
        ("api", 0.6), ("signing", 0.6), ("encryption", 0.6), ("client", 0.2),
    )


@dataclass(frozen=True)
class Span:
    """kind, start and end (code points, end exclusive); value_start and value_end: the literal itself."""

    kind: str
    start: int
    end: int
    value_start: int
    value_end: int


_SIGN = re.compile(r":=|=>|[=:]")
#: A name and what may close it, read backwards from a sign.
_NAME_BACK = re.compile(r"[\x20\t]*[\"'\])]{0,2}([A-Za-z0-9_.\-]*[A-Za-z_])")
_OPEN = re.compile(r"[\x20\t]*(?:([(\[])[\x20\t]*)?(?:\\?\r?\n[\x20\t]*)?(?=[\"'`])")
_TERM = re.compile(r"[\x20\t]*(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([A-Za-z0-9_+/.=\-$@!%^&*~]+))")
_JOIN = re.compile(r"[\x20\t]*(?:\+[\x20\t]*)?(?=[\"'`])|[\x20\t]*\+[\x20\t]*")
#: The same within brackets, where lines may end between the parts.
_JOIN_LINES = re.compile(r"[\x20\t\r\n]*(?:\+[\x20\t\r\n]*)?(?=[\"'`])|[\x20\t]*\+[\x20\t]*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"example|changeme|placeholder|your|dummy|sample|test|xxx|\*\*\*|\.\.\.|%s|localhost", re.IGNORECASE)
#: One character less than the longest placeholder: what a join has to look at on either side.
_REACH = 10
_CLASSES = [re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
#: Length beyond which a literal's numbers are scaled down; only their proportions count there.
_LONG = 1e200


@dataclass(frozen=True)
class Summary:
    """What the score asks of a literal. Two summaries join in the same time however long their literals are, so constants that double line by line cost no more than their text.

    counts: of characters, by code point modulo 256. head, tail: the first and last characters. classes: which kinds of characters there are.
    """

    length: float
    counts: dict[int, float]
    classes: frozenset[int]
    head: str
    tail: str
    spaced: bool
    placeholder: bool

    @staticmethod
    def of(text: str) -> Summary:
        counts: dict[int, float] = {}
        for c, n in Counter(text).items():
            counts[ord(c) % 256] = counts.get(ord(c) % 256, 0.0) + n
        classes = frozenset(i for i, c in enumerate(_CLASSES) if c.search(text))
        return Summary(float(len(text)), counts, classes, text[:_REACH], text[-_REACH:], any(map(str.isspace, text)), bool(_PLACEHOLDER.search(text)))

    def joined(self, other: Summary) -> Summary:
        counts = dict(self.counts)
        for k, n in other.counts.items():
            counts[k] = counts.get(k, 0.0) + n
        length, tail = self.length + other.length, (self.tail + other.tail)[-_REACH:]
        if length > _LONG:
            length, counts = length / 1e100, {k: n / 1e100 for k, n in counts.items()}
        held = self.placeholder or other.placeholder or bool(_PLACEHOLDER.search(self.tail + other.head))
        return Summary(length, counts, self.classes | other.classes, (self.head + other.head)[:_REACH], tail, self.spaced or other.spaced, held)


class Literal:
    """A literal and where it stands; its summary is made when it is asked for."""

    __slots__ = ("start", "end", "length", "_text", "_summary")

    def __init__(self, start: int, end: int, text: str | None = None, summary: Summary | None = None):
        self.start, self.end, self._text, self._summary = start, end, text, summary
        self.length = len(text) if summary is None else summary.length

    @property
    def summary(self) -> Summary:
        if self._summary is None:
            self._summary, self._text = Summary.of(self._text), None
        return self._summary


def _whole(parts: list[Literal]) -> Literal:
    """The parts as one literal; of parts written far apart, the longest says where it stands."""
    if len(parts) == 1:
        return parts[0]
    summary = parts[0].summary
    for p in parts[1:]:
        summary = summary.joined(p.summary)
    start, end = min(p.start for p in parts), max(p.end for p in parts)
    if end - start > 4 * summary.length + 16:
        longest = max(parts, key=lambda p: p.length)
        start, end = longest.start, longest.end
    return Literal(start, end, summary=summary)


def pairs(text: str) -> Iterator[tuple[str, Literal]]:
    """The name-literal pairs of a text in order, constants propagated. A literal of joined parts may stand on several lines if brackets hold it; a propagated one stands where it was written."""
    constants: dict[str, Literal] = {}
    at = before = read = 0
    while sign := _SIGN.search(text, at):
        at = sign.end()
        named = _NAME_BACK.match(text[before : sign.start()][::-1])
        before = at
        if not named:
            continue
        name, parts, end = named[1][::-1], [], at
        opened = _OPEN.match(text, end)
        if opened:
            end = opened.end()
        join = _JOIN_LINES if opened and opened[1] else _JOIN
        inside = sign.start() < read  # within a literal that was read: its own pairs are read too, but not chained, so the time stays linear
        while term := _TERM.match(text, end):
            group = term.lastindex
            known = constants.get(term[4]) if group == 4 else None
            parts.append(known or Literal(term.start(group), term.end(group), term[group]))
            end = term.end()
            joined = None if inside else join.match(text, end)
            if not joined or (group == 4 and "+" not in joined[0]):
                break
            end = joined.end()
        if not parts:
            continue
        if group == 4:
            at = max(at, end)  # signs within a bare value are its own, so each character is read once
        read = max(read, end)
        constants[name] = whole = _whole(parts)
        yield name, whole


def literal_score(name: str, literal: Literal, scoring: Scoring = Scoring()) -> float:
    """How likely the pair is a secret: at the threshold and above it counts as one."""
    if literal.length < scoring.least:
        return 0.0
    worth = dict(scoring.words)
    named = min(2.5, sum(worth.get(p.lower(), 0.0) for p in _PART.findall(name)))
    if not named:
        return 0.0
    s = literal.summary
    if s.spaced or s.placeholder or s.head.startswith("$"):
        return 0.0
    entropy = -sum(n / s.length * math.log2(n / s.length) for n in s.counts.values() if n)
    return named + min(1.0, s.length / 24) + 0.35 * (len(s.classes) - 1) + 0.25 * max(0.0, entropy - 2.5)


def spans_of(text: str, scoring: Scoring = Scoring()) -> list[Span]:
    """All spans by start, then kind."""
    found = []
    signed = ":" in text or "=" in text
    if signed:
        found += [Span("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [Span("hex", m.start(), m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    if signed:
        known = [(s.start, s.end) for s in found]
        fresh = {(v.start, v.end) for name, v in pairs(text) if literal_score(name, v, scoring) >= scoring.threshold}
        found += [Span("literal", a, b, a, b) for a, b in fresh if not any(s <= a and b <= e for s, e in known)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each literal replaced; literals that overlap are replaced once."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted((s.value_start, s.value_end) for s in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scanned(docs: DataFrame, scoring: Scoring = Scoring(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one for each row of docs.

    A null text counts as empty: no spans, and the SHA-256 of nothing. Null and repeated ids come out as they came in;
    an empty table gives no rows; other columns aren't read. Texts of any length are taken whole.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            found = [spans_of(t, scoring) for t in texts_of(batch)]
            base = [[s for s in spans if s.kind != "literal"] for spans in found]
            counts = [[sum(s.kind == kind for s in spans) for spans in base] for kind in KINDS[:3]]
            columns = [column_of(batch, "doc_id"), *(pa.array(c, type=pa.int64()) for c in counts)]
            columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(s) for s in found], type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted_documents(docs: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """docs with the secrets of text replaced by a mark; n_chars, if there is one, follows.

    All rows and columns stay as they are, null and repeated ids too; null texts stay null, empty ones empty, and an
    empty table gives no rows.
    """
    schema, n_chars = StructType.fromJson(docs.schema.jsonValue()), "n_chars" in docs.columns
    schema["text"].nullable = True

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            texts = column_of(batch, "text").to_pylist()
            found = [spans_of(t or "", scoring) for t in texts]
            if any(found):
                clean = [redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(clean, type=batch.schema.field(at).type))
                if n_chars:
                    at = batch.schema.get_field_index("n_chars")
                    old = batch.column(at).to_pylist()
                    batch = batch.set_column(at, batch.schema.field(at), pa.array([len(t) if s else n for t, s, n in zip(clean, found, old, strict=True)], type=batch.schema.field(at).type))
            yield batch

    return small_batches(docs).mapInArrow(run, schema)
