"""Secret scans with assignment-aware lexing.

A text is lexed as source or configuration into pairs of a name and a value: `name = "literal"`,
`name: literal`, `"name": 'literal'`, `name := literal`, `name => literal`. A value is a string with escapes,
a string in triple quotes, strings joined by `+`, `.` or by standing side by side (also over lines in
brackets), a bare word, an indented block behind `name: |` or a PEM block. A value that is a name, or a
string that holds `${name}`, `{{name}}` or `%(name)s`, takes over constants: it stands for the last value the
name was given before, in the same function or class or outside of any, or else for the next one after.
Literals are scored by the most sensitive name they reach that way; those of at least LEAST_LITERAL
characters with a digit or of mixed case are reported as kind `literal`. Pairs in comments count: a secret
that is commented out is still one. Spans of fixed formats (kinds assign, access, hex) are always reported;
a literal inside one of them isn't repeated.

Spans are (kind, start, end) in code points, end exclusive; that of a joined value reaches from its first to
its last character. Null texts are empty. Repeated rows each get a row. Whole texts are scanned, in time
proportional to their length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import lean

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is one match, as with `+` and a later check
#: How sensitive a word of a name is; a name's score is its best word's.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "bearer": 0.8, "signing": 0.7, "salt": 0.5, "private": 0.7, "access": 0.4, "key": 0.5, "api": 0.4, "session": 0.4, "cookie": 0.4,
}
THRESHOLD, LEAST_LITERAL = 0.8, 8
NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: A name and its sign; possessive repeats keep the search linear.
TARGET = re.compile(rf"""(?<![A-Za-z0-9_.\-])["']?({NAME})["']?[ \t]*+(?::=|=>|=(?![=>])|:(?![:/=]))[ \t]*+""")
STRING = re.compile(r'''[rbfuRBFU]{0,2}(?:"""((?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'((?:[^'\\]|\\.|'(?!''))*+)\'\'\'|"(?!"")((?:[^"\\\n]|\\.)*+)"|'(?!'')((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)''', re.S)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]]++""")
JOINT = re.compile(r"[ \t]*+(?:\+|\.\.?|&)?[ \t]*+(?:\\?\n[ \t]*+)?(?:\+[ \t]*+)?")
OPENING = re.compile(r"[(\[][ \t]*+\n?[ \t]*+(?=[rbfuRBFU]{0,2}[\"'])")
BLOCK = re.compile(r"[|>][+-]?[ \t]*+\n")
PEM = "-----BEGIN "
SCOPE = re.compile(r"^([ \t]*)(?:(?:public|private|protected|static|async|export|default)[ \t]+)*(?:def|class|function|func|fn)\b", re.M)
REFERENCES = re.compile(rf"\$\{{({NAME})\}}|\$({NAME})|\{{\{{[ \t]*({NAME})[ \t]*\}}\}}|%\(({NAME})\)s")
_SIGN = re.compile(r"[=:]")
_WORD = re.compile(r"[a-z0-9]+")
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_NAME = re.compile(NAME + r"\Z")


class Pair(NamedTuple):
    """A name, its value, the value's span, whether it was quoted, and the indentation of its line."""

    name: str
    value: str
    start: int
    end: int
    quoted: bool
    at: int


def name_score(name: str) -> float:
    """How sensitive a name is: the best of its words and of its neighbouring words together, 0 to 1; two weaker ones add up."""
    words = [w.lower() for w in _PARTS.findall(name)] or _WORD.findall(name.lower())
    found = [SENSITIVE.get(w, 0.0) for w in words]
    joined = [SENSITIVE.get(a + b, 0.0) for a, b in zip(words, words[1:])]
    return min(1.0, max([0.0, *found, *joined, *(a + b for a, b in zip(found, found[1:]))]))


def _indented(text: str, name_at: int, body_at: int) -> int:
    """Where the block of lines ends that are indented deeper than the line of the name."""
    line = text.rfind("\n", 0, name_at) + 1
    depth = len(text[line:name_at]) - len(text[line:name_at].lstrip(" \t-"))
    at = end = body_at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        row = text[at:stop]
        if row.strip():
            if len(row) - len(row.lstrip(" \t")) <= depth:
                break
            end = stop
        at = stop + 1
    return end


def pairs(text: str) -> list[Pair]:
    """The pairs of names and values, in order."""
    out: list[Pair] = []
    at, last_pem = 0, text.rfind("-----END ")
    while (m := TARGET.search(text, at)) is not None:
        at = m.end()
        if (b := BLOCK.match(text, at)) is not None:
            end = _indented(text, m.start(1), b.end())
            if end > b.end():
                start = b.end() + len(text[b.end() : end]) - len(text[b.end() : end].lstrip())
                out.append(Pair(m[1], text[start:end], start, end, True, m.start(1)))
                at = end
                continue
        if text.startswith(PEM, at) and last_pem > at:
            end = text.find("-----END ", at)
            close = text.find("-----", end + 9)
            end = close + 5 if 0 <= close < end + 80 else end
            out.append(Pair(m[1], text[at:end], at, end, True, m.start(1)))
            at = end
            continue
        first = OPENING.match(text, at)
        x = first.end() if first else at
        parts = []
        while (s := STRING.match(text, x)) is not None:
            k = s.lastindex
            parts.append((s[k], s.start(k), s.end(k)))
            at = s.end()
            joint = JOINT.match(text, at)
            x = joint.end()
            if "\n" in joint[0] and not (first or "\\" in joint[0] or "+" in joint[0] or "." in joint[0]):
                break
        if parts:
            out.append(Pair(m[1], "".join(p for p, _, _ in parts), parts[0][1], parts[-1][2], True, m.start(1)))
        elif (bare := BARE.match(text, at)) is not None:
            out.append(Pair(m[1], bare[0], at, bare.end(), False, m.start(1)))
            at = bare.end()
    return out


def _scopes(text: str, found: list[Pair]) -> list[int]:
    """For each pair where the function or class begins that it stands in, -1 outside of any."""
    heads = [(m.start(), len(m[1])) for m in SCOPE.finditer(text)]
    if not heads:
        return [-1] * len(found)
    out, stack, k = [], [], 0
    for p in found:
        while k < len(heads) and heads[k][0] < p.at:
            while stack and stack[-1][1] >= heads[k][1]:
                stack.pop()
            stack.append(heads[k])
            k += 1
        line = text.rfind("\n", 0, p.at) + 1
        depth = len(text[line : p.at]) - len(text[line : p.at].lstrip(" \t"))
        while stack and stack[-1][1] >= depth and text.find("\n", stack[-1][0], p.at) >= 0:
            stack.pop()
        out.append(stack[-1][0] if stack else -1)
    return out


def _literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name."""
    found = pairs(text)
    if not found:
        return []
    places: dict[str, list[int]] = {}
    for i, p in enumerate(found):
        places.setdefault(p.name, []).append(i)
    uses: list[tuple[int, str]] = []
    for i, p in enumerate(found):
        if not p.quoted and p.value in places:
            uses.append((i, p.value))
        elif any(c in p.value for c in "$%{"):
            uses += [(i, n) for m in REFERENCES.finditer(p.value) for n in m.groups() if n in places]
    score = [name_score(p.name) for p in found]
    if uses:
        scope = _scopes(text, found)
        by_scope: dict[tuple[str, int], list[int]] = {}
        for i, p in enumerate(found):
            by_scope.setdefault((p.name, scope[i]), []).append(i)
        takes: dict[int, list[int]] = {}
        for i, name in uses:
            best = None
            for s in dict.fromkeys((scope[i], -1)):
                own = by_scope.get((name, s), [])
                k = bisect.bisect_left(own, i)
                before, after = own[k - 1] if k else None, next((j for j in own[k : k + 2] if j != i), None)
                best = before if before is not None else best if best is not None else after
                if before is not None:
                    break
            if best is not None:
                takes.setdefault(i, []).append(best)
        todo = sorted(takes, key=lambda i: score[i])
        while todo:  # the value's sensitivity reaches back to where it was given
            i = todo.pop()
            for j in takes.get(i, ()):
                if score[i] > score[j]:
                    score[j] = score[i]
                    todo.append(j)
    return [
        (p.start, p.end)
        for p, s in zip(found, score, strict=True)
        if s >= THRESHOLD and p.end - p.start >= LEAST_LITERAL and (p.quoted or p.value not in places) and (any(map(str.isdigit, p.value)) or p.value.lower() != p.value) and not REFERENCES.fullmatch(p.value)
    ]


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by start, then kind in the order of KINDS."""
    text = text or ""
    out: list[tuple[int, int, int]] = []
    signs = _SIGN.search(text) is not None
    if signs:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if signs:
        base = sorted((s, e) for s, _, e in out)
        starts, ends = [s for s, _ in base], [*accumulate((e for _, e in base), max)]
        for a, z in dict.fromkeys(_literals(text)):
            k = bisect.bisect_right(starts, a)
            if not k or ends[k - 1] < z:
                out.append((a, 3, z))
    return [(KINDS[k], a, z) for a, k, z in sorted(out)]


def redact(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with every run of overlapping spans replaced."""
    if text is None:
        return None
    out, at = [], 0
    for _, a, z in spans(text):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, z)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: its id, n_assign, n_access, n_hex, base_sha256, spans, n_literal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for x in b.column(1):
                found = spans(x.as_py())
                said = [f"{k}:{a}:{z}" for k, a, z in found]
                n = [sum(k == kind for k, _, _ in found) for kind in KINDS]
                base = ",".join(s for s, (k, _, _) in zip(said, found, strict=True) if k != "literal")
                for c, v in zip(cols, (*n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), n[3]), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with their texts redacted; every row and column stays."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(redact)

    return docs.withColumn(text_col, clean(F.col(text_col)))
