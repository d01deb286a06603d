"""Secret scans: three fixed patterns, and an assignment-aware lexer that adds what they miss.

The lexer reads lines of source code and configuration (`name = "literal"`, `name: literal`, `"name": "literal"`,
`name => literal`, sums of literals and names), propagates constants through assignments within a document, and scores a
literal by how sensitive the name is that it reaches and by how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Parts of names that hold credentials, and how much each tells.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "pass": 2.5, "secret": 3.0, "credential": 3.0,
    "credentials": 3.0, "apikey": 3.0, "privatekey": 3.0, "token": 2.5, "auth": 2.0, "bearer": 2.0, "signature": 1.5,
    "private": 1.5, "access": 1.0, "client": 0.5, "api": 1.0, "key": 1.5, "salt": 1.5, "cookie": 1.0, "session": 1.0,
}
#: Literals that stand for a value to be filled in.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|change_me|example.*|placeholder|todo|none|null|true|false|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")
THRESHOLD = 6.0

_LINE = re.compile(r"[^\n]+")
_TERM = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z0-9_./+@$%!#^&*~-]+)"""
_PAIR = re.compile(rf"""(?<![\w.-])["']?([A-Za-z_][\w.-]*+)["']?[\x20\t]*+(?:=>|:=|=(?![=~])|:(?![:/]))[\x20\t]*({_TERM}(?:[\x20\t]+\+[\x20\t]+{_TERM})*)""")
_ONE = re.compile(_TERM)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NAME = re.compile(r"[A-Za-z_][\w.-]*\Z")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of the three kinds, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def name_score(name: str) -> float:
    """Sum over the parts of an identifier, in camel or snake case."""
    parts = {p.lower() for p in _PART.findall(name)} | {re.sub(r"[\W_]", "", name).lower()}
    return sum(SENSITIVE.get(p, 0.0) for p in parts)


class Value:
    """What is known of a literal, or of several joined: the one literal there is (None of several), its number of
    characters, and how often it has each. Counts of joined values are sums, so a value costs the same however many
    literals go into it; they are floats, scaled down where they would overflow."""

    __slots__ = ("only", "counts", "size")

    def __init__(self, text: str = "") -> None:
        self.only: str | None = text
        self.counts: dict[str, float] = Counter(text)
        self.size = float(len(text))

    def joined(self, other: Value) -> Value:
        if not self.size:
            return other
        out = Value()
        out.only, out.size = None, self.size + other.size
        scale = 1.0 if out.size < 1e100 else 1e-80
        out.size *= scale
        out.counts = {c: (self.counts.get(c, 0.0) + other.counts.get(c, 0.0)) * scale for c in self.counts | other.counts}
        return out


def literal_score(value: Value) -> float:
    """Bits a character, with a bonus for mixed classes; 0 for short values and placeholders."""
    if value.size < 8 or " " in value.counts or value.only is not None and PLACEHOLDER.match(value.only):
        return 0.0
    bits = -sum(p * math.log2(p) for c in value.counts.values() if (p := c / value.size) > 0)
    chars = "".join(value.counts)
    classes = sum(bool(re.search(p, chars)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return bits * (0.6 + 0.2 * classes) if classes > 1 else bits * 0.5


def lexed_pairs(text: str) -> list[tuple[str, list[tuple[str, int, int, bool]]]]:
    """(name, terms) of every assignment; a term is (value, start, end, quoted) with the quotes left out."""
    pairs = []
    for line in _LINE.finditer(text):
        if "=" not in line.group() and ":" not in line.group():
            continue
        for m in _PAIR.finditer(text, line.start(), line.end()):
            terms = []
            for t in _ONE.finditer(text, m.start(2), m.end(2)):
                raw, quoted = t.group(), t.group()[0] in "\"'" and len(t.group()) > 1
                if raw != "+":
                    terms.append((raw[1:-1], t.start() + 1, t.end() - 1, True) if quoted else (raw.rstrip(".,;"), t.start(), t.start() + len(raw.rstrip(".,;")), False))
            if terms:
                pairs.append((m.group(1), terms))
    return pairs


def _references(pairs: list) -> list[list[int | None]]:
    """For every term of every pair, the pair whose value it stands for, or None for a literal: a name's latest assignment
    before the term, or its first one after it."""
    by_name: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(pairs):
        by_name.setdefault(name, []).append(k)
    out = []
    for k, (_, terms) in enumerate(pairs):
        own: list[int | None] = []
        for value, _, _, quoted in terms:
            places = by_name.get(value) if not quoted and _NAME.match(value) else None
            at = bisect_left(places, k) if places else 0
            own.append(None if not places or places == [k] else places[at - 1] if at else next(p for p in places if p > k))
        out.append(own)
    return out


def _values(pairs: list, refers: list[list[int | None]]) -> list[Value]:
    """The value of every pair, each worked out once; a reference back to a value under way adds nothing."""
    done: list[Value | None] = [None] * len(pairs)
    under_way: set[int] = set()
    for first in range(len(pairs)):
        stack = [first]
        while stack:
            k = stack[-1]
            if done[k] is not None:
                stack.pop()
                continue
            waits = [] if k in under_way else [r for r in refers[k] if r is not None and done[r] is None and r not in under_way]
            under_way.add(k)
            if waits:
                stack += waits
                continue
            value = Value()
            for (text, _, _, _), r in zip(pairs[k][1], refers[k]):
                part = Value(text) if r is None else done[r]
                if part is not None:
                    value = value.joined(part)
            done[k] = value
            under_way.discard(k)
            stack.pop()
    return done


def named_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, directly or through constants of the same text, however many steps away."""
    if "=" not in text and ":" not in text:
        return []
    pairs = lexed_pairs(text)
    weights = [name_score(name) for name, _ in pairs]
    if not any(weights):
        return []
    refers = _references(pairs)
    values = _values(pairs, refers)
    reached = [k for k, w in enumerate(weights) if w > 0 and w * literal_score(values[k]) >= threshold]
    seen, found = set(reached), set()
    while reached:
        k = reached.pop()
        for (_, start, end, _), r in zip(pairs[k][1], refers[k]):
            if r is None:
                if end > start:
                    found.add((start, end))
            elif r not in seen:
                seen.add(r)
                reached.append(r)
    return sorted(found)


def scan_text(text: str | None) -> tuple[list, list]:
    """Base spans, and all spans by start and then kind; an added span is never wholly inside a base one."""
    text = text or ""
    base = base_spans(text)
    added = [("named", s, e) for s, e in named_spans(text) if not any(b <= s and e <= t for _, b, t in base)]
    return base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))


def _shown(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs (doc_id, text).

    Null and empty texts have no spans; a null id stays null; equal rows give equal rows; an empty table gives no rows;
    other columns are ignored. Offsets are code points, end exclusive.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, spans = scan_text(text.as_py())
                kinds = Counter(k for k, _, _ in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(spans)))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by [KIND] (spans that overlap, by the kind of the first) and n_chars, where there is such a column, brought up to date."""
    names = docs.columns

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                if text:
                    at, out = 0, []
                    for kind, s, e in scan_text(text)[1]:
                        if s >= at:
                            out += [text[at:s], f"[{kind.upper()}]"]
                        elif e <= at:
                            continue
                        at = e
                    text = "".join([*out, text[at:]])
                texts.append(text)
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in names:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(redact, docs.schema)
