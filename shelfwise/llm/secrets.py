"""Secret scan by assignment-aware lexing.

Source and configuration syntax is read into (name, literal) pairs; a name that is assigned another name takes
over its literal; literals are scored by how sensitive the names are that they end up in, and by how random
they look. Three plain patterns are always reported besides, and spans may overlap.

Literals are words, strings in any quotes, blocks of indented lines, text of elements and arguments of calls that set
something. Names, blanks and literals may have any length. A constant that is used again is referred to, not copied, so
work and memory stay in proportion to the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "named")
REPORT = "doc_id long, n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of hex digits is maximal, so shorter ones can be passed over

_MARK = re.compile(r":=|=>|[:=](?![:=])")
_BLANKS = re.compile(r"[ \t]*")
_STRING = re.compile(
    r"""[rbfuRBFU]{0,2}(?:\"{3}((?:[^"\\]|\\[\s\S]|"(?!""))*+)\"{3}|'{3}((?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`]*+)`)"""
)
#: The head of a block of indented lines, and text inside an element.
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*\n")
_ELEMENT = re.compile(r"""<([A-Za-z_][\w.:-]*)([^<>]*)>([^<>]+)</\1\s*>""")
_ATTRIBUTE = re.compile(r"""\b(?:name|key|id)\s*=\s*["']([^"'<>]+)["']""")
#: A call that sets something to the literal that follows: its name says what, or a name before the literal does.
_SETTER = re.compile(r"""\b((?:set|with|put|add|use|assign|update)(?=[_A-Z])[\w$]*)\(\s*(?=[rbfuRBFU]{0,2}["'`])""")
_PUT = re.compile(r"""\(\s*(["'])([A-Za-z_][\w.-]*)\1\s*,\s*(?=[rbfuRBFU]{0,2}["'`])""")
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>|&+]+""")
#: A type between a declared name and its value.
_TYPE = re.compile(r"""[ \t]*[&*]*[A-Za-z_][\w.]*(?:\[[^\[\]\n:=]*\]|<[^<>\n:=]*>)?[?!]?[ \t]*(?==(?![=>]))""")
_TYPE_WORDS = {"string", "str", "String", "text", "varchar", "char", "bytes", "byte", "any", "auto"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[\w$]+)*")
#: How much a word inside a name says that the value is to be kept secret. Fixed values.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "private": 0.5, "key": 0.6, "access": 0.4, "api": 0.4,
    "signature": 0.5, "salt": 0.5, "session": 0.4, "cookie": 0.4, "client": 0.2,
}
_PLACEHOLDER = re.compile(r"(?i)(?:(?:change_?me|none|null|true|false|todo|test)$|example|your[_-]|\$\{|\{\{|<)")
THRESHOLD = 1.0
MIN_LENGTH = 8
#: Characters of a value that are looked at for a placeholder.
HEAD = 256
#: Characters of a word between those whose sums up to the word's end are kept.
STEP = 1024


def name_weight(name: str) -> float:
    """How much a name asks for secrecy."""
    words = [w.lower() for w in _WORD.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:], strict=False)]
    return min(1.5, sum(SENSITIVE.get(w, 0.0) for w in {*words, *pairs}))


_common_name_weight = lru_cache(maxsize=1 << 14)(name_weight)


def weight_of(name: str) -> float:
    return _common_name_weight(name) if len(name) <= 100 else name_weight(name)


class Value:
    """What a score needs of a literal, however long: its first characters, its length, how often each character is in it
    (beyond ASCII in 128 kinds), and its blanks inside. Values are added without looking at their characters again."""

    __slots__ = ("head", "size", "counts", "blanks")

    def __init__(self, text: str = ""):
        self.head, self.size, self.blanks = text[:HEAD], len(text), text.strip().count(" ")
        self.counts: Counter[int] = Counter()
        for c, k in Counter(text).items():
            self.counts[ord(c) if c < "\x80" else 128 + ord(c) % 128] += k

    def add(self, other: Value) -> None:
        self.head = (self.head + other.head)[:HEAD]
        self.size += other.size
        self.blanks += other.blanks
        self.counts.update(other.counts)

    def entropy(self) -> float:
        """Bits a character."""
        n = self.size
        return -sum(k / n * math.log2(k / n) for k in self.counts.values()) if n else 0.0

    def weight(self) -> float:
        """How random it looks, 0 to 1."""
        few = set(self.counts) <= {ord(c) for c in "xX"} or len(self.counts) == 1 and next(iter(self.counts)) in (ord("*"), ord("."))
        if self.size < MIN_LENGTH or few or _PLACEHOLDER.match(self.head):
            return 0.0
        if self.blanks:
            return 0.2
        classes = sum(any(a <= k <= b for k in self.counts) for a, b in ((97, 122), (65, 90), (48, 57)))
        return min(1.0, self.entropy() / 4.5) * (0.5 + classes / 6)


class Word:
    """A word with other names inside, all of whose values end with it. Values are added up from its end in steps, so that
    each one is of all its characters, in time for at most a step of them."""

    __slots__ = ("text", "end", "sums")

    def __init__(self, text: str, end: int):
        self.text, self.end = text, end
        self.sums = [Value()]  # of the last 0, STEP, 2 * STEP, ... characters

    def value(self, start: int) -> Value:
        k = (self.end - start) // STEP
        while len(self.sums) <= k:
            at = self.end - len(self.sums) * STEP
            longer = Value(self.text[at : at + STEP])
            longer.add(self.sums[-1])
            self.sums.append(longer)
        out = Value(self.text[start : self.end - k * STEP])
        out.add(self.sums[k])
        return out


class Assignment:
    """A name and what it is assigned: spans of literals, assignments that it refers to, and names defined further on."""

    __slots__ = ("name", "parts", "value")

    def __init__(self, name: str, *parts: tuple[int, int] | tuple[int, int, Word] | Assignment | Later):
        self.name, self.parts = name, list(parts)
        self.value: Value | None = None


class Later:
    """A word that is a constant if it is defined further on, else a literal (or, inside a sum, nothing)."""

    __slots__ = ("name", "span")

    def __init__(self, name: str, span: tuple[int, int] | None):
        self.name, self.span = name, span


def _name_before(text: str, end: int) -> tuple[str, int]:
    """The dotted name that ends before ``end``, closing quotes, brackets and blanks passed over, and its start."""
    while end and text[end - 1] in " \t":
        end -= 1
    while end and text[end - 1] in "\"']":
        end -= 1
    start = end
    while start and ((c := text[start - 1]).isalnum() or c in "_$.-"):
        start -= 1
    name = text[start:end]
    if name[-1:] in (".", "-"):
        return "", start
    name = re.split(r"[.-]{2,}", name)[-1].lstrip("0123456789.-")
    return (name if name[:1].isalpha() or name[:1] in ("_", "$") else ""), start


def _string_at(text: str, at: int) -> tuple[tuple[int, int], int] | None:
    """The span of the literal whose quotes open at ``at``, and where it ends with them."""
    m = _STRING.match(text, at)
    return (m.span(m.lastindex), m.end()) if m else None


def _block_at(text: str, start: int, at: int) -> list[tuple[int, int]] | None:
    """The lines, blanks around them left out, of a block that opens at ``at`` and belongs to the name at ``start``."""
    m = _BLOCK.match(text, at)
    if m is None:
        return None
    line = text.rfind("\n", 0, start) + 1
    outer = _BLANKS.match(text, line).end() - line
    found, at = [], m.end()
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        first = _BLANKS.match(text, at, end).end()
        if first < end and first - at <= outer:
            break
        if first < end:
            found.append((first, first + len(text[first:end].rstrip())))
        at = end + 1
    return found


def assignments(text: str) -> list[Assignment]:
    """All assignments: those with a mark in order, then calls that set something and elements; constants are referred to,
    wherever they are defined."""
    known: dict[str, Assignment] = {}
    earliest: dict[str, Assignment] = {}
    declared: dict[int, str] = {}  # where the value of a declared name begins
    out: list[Assignment] = []
    bare_end, word_of = -1, Word(text, 0)
    for mark in _MARK.finditer(text):
        name, start = _name_before(text, mark.start())
        if name in _TYPE_WORDS and start and text[start - 1] in " \t*":  # name, type, value
            name = _name_before(text, start - 1)[0] or name
        typed = declared.pop(mark.start(), "")
        if typed and weight_of(typed) >= weight_of(name):
            name = typed
        if not name:
            continue
        if mark[0] == ":" and (kind := _TYPE.match(text, mark.end())):
            declared[kind.end()] = name
            continue
        found, at = Assignment(name), mark.end()
        block = _block_at(text, start, _BLANKS.match(text, at).end()) if mark[0] == ":" else None
        if block is not None:
            found.parts += block
        while block is None:
            at = _BLANKS.match(text, at).end()
            if quoted := _string_at(text, at):
                span, at = quoted
                found.parts.append(span)
            else:
                nested = at < bare_end
                if nested:
                    end = bare_end
                elif m := _BARE.match(text, at):
                    end = bare_end = m.end()
                    word_of = Word(text, end)
                else:
                    break
                word = _IDENTIFIER.match(text, at)
                whole = word is not None and word.end() == end
                if whole and word[0] in known:
                    found.parts.append(known[word[0]])
                elif whole:
                    found.parts.append(Later(word[0], None if found.parts else (at, end)))
                else:
                    found.parts.append((at, end, word_of) if nested else (at, end))
                at = end
            plus = _BLANKS.match(text, at).end()
            if text[plus : plus + 1] != "+":
                break
            at = plus + 1
        if found.parts:
            for key in (name, name.rpartition(".")[2]):
                known[key] = found
                earliest.setdefault(key, found)
            out.append(found)
    for pattern, group in ((_SETTER, 1), (_PUT, 2)):
        for m in pattern.finditer(text):
            if quoted := _string_at(text, m.end()):
                out.append(Assignment(m[group], quoted[0]))
    for m in _ELEMENT.finditer(text):
        inside = m[3].strip()
        if inside:
            start = m.start(3) + m[3].index(inside)
            out.append(Assignment(" ".join([m[1], *_ATTRIBUTE.findall(m[2])]), (start, start + len(inside))))
    for found in out:
        found.parts = [x for part in found.parts for x in _resolved(part, earliest)]
    return [x for x in out if x.parts]


def _resolved(part: tuple[int, int] | Assignment | Later, earliest: dict[str, Assignment]) -> list[tuple[int, int] | Assignment]:
    if not isinstance(part, Later):
        return [part]
    found = earliest.get(part.name)
    return [found] if found is not None else [part.span] if part.span else []


def _value_at(text: str, a: int, b: int, word: Word | None = None) -> Value:
    """The value of a span, by the word that it ends with if other names' values end there too."""
    return word.value(a) if word else Value(text[a:b])


def valued(text: str, found: Assignment) -> Value:
    """The value of an assignment, those that it refers to worked out first; one that refers to itself adds nothing there."""
    todo, inside = [found], set()
    while todo:
        x = todo[-1]
        if x.value is not None:
            todo.pop()
        elif id(x) not in inside:
            inside.add(id(x))
            todo += [p for p in x.parts if isinstance(p, Assignment) and p.value is None and id(p) not in inside]
        else:
            todo.pop()
            total = Value()
            for p in x.parts:
                if isinstance(p, tuple):
                    total.add(_value_at(text, *p))
                elif p.value is not None:
                    total.add(p.value)
            x.value = total
    return found.value or Value()


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]], str]]:
    """(name, spans of the literals, first characters of the value) of each assignment, constants propagated."""
    return [(x.name, sorted(_literals([x], set())), valued(text, x).head) for x in assignments(text)]


def _literals(todo: list[Assignment], seen: set[int]) -> Iterator[tuple[int, int]]:
    """Spans of the literals of assignments and of all that they refer to; each assignment is visited once."""
    while todo:
        x = todo.pop()
        if id(x) in seen:
            continue
        seen.add(id(x))
        for part in x.parts:
            if isinstance(part, Assignment):
                todo.append(part)
            elif part[1] > part[0]:
                yield part[:2]


def named_spans(text: str) -> set[tuple[int, int]]:
    """Spans of the literals that end up in names that ask for secrecy."""
    spans: set[tuple[int, int]] = set()
    seen: set[int] = set()
    every = assignments(text)  # held, so that ids stay those of one assignment each
    for found in every:
        weight = weight_of(found.name)
        if weight <= 0 or not 0 < (value := valued(text, found).weight()) or weight + value < THRESHOLD:
            continue
        spans.update(_literals([found], seen))
    return spans


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all findings, by start, then kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text or "(" in text or "</" in text:
        found += [(a, 3, b) for a, b in named_spans(text)]
    return sorted(found)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_secrets(docs: DataFrame) -> DataFrame:
    """All findings of every document: counts a kind, a digest of the plain patterns' spans, and all spans.

    Spans are code points, end exclusive. Null and empty texts have no findings, each row gives one row,
    repeated rows repeat, other columns are ignored. Texts are read whole, one at a time; no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = spans_of(text.as_py() or "")
                base = [x for x in found if x[1] < 3]
                counts = Counter(k for _, k, _ in found)
                rows.append((counts[0], counts[1], counts[2], counts[3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            names = ("n_assign", "n_access", "n_hex", "n_named", "base_sha256", "spans")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {n: pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i, n in enumerate(names)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, REPORT)


def redact_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask``; all columns stay."""

    def cut(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, _, b in spans_of(text):
            if b > at:
                out += [text[at : max(a, at)], mask if a >= at else ""]
                at = b
        return "".join([*out, text[at:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([cut(x.as_py()) for x in batch.column("text")], batch.schema.field(at).type))

    return docs.mapInArrow(scan, docs.schema)
