"""Secret scans by assignment-aware lexing.

Source and configuration syntax (``name = "x"``, ``"name": "x"``, ``NAME=x``, ``name := x``, ``a = b + "x"``) is read into
pairs of a name and the literals assigned to it. Constants are propagated: a name that is assigned another name gets
that one's literals. A literal is scored by the most sensitive name that it reaches and by its own looks. Three plain
patterns are reported beside that, whatever the syntax around them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in order of report.
KINDS = ("assign", "access", "hex", "literal")
#: Fixed patterns and least lengths of the three plain kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the whole run of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words of which one must occur, in any case, where ASSIGN can match.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

#: How far a name says that its value is a secret.
NAMES = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "private_key": 1.0, "token": 0.9, "api_key": 0.9, "apikey": 0.9,
         "access_key": 0.9, "accesskey": 0.9, "credential": 0.8, "auth": 0.6, "signature": 0.5}
#: Values that stand for a secret without being one.
STAND_INS = re.compile(r"(?i)^(?:x+|\*+|\.+|change_?me|example.*|your[_-].*|none|null|true|false|test|dummy|placeholder)$|\$\{|\{\{|^<.*>$|%\(")
LEAST_SCORE = 0.5

OPERATOR = re.compile(r":=|=>|[:=]")
STRING = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'')
REFERENCE = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.]*)\}?(?=[\t ]*(?:[+,;)\n]|$))")
BARE = re.compile(r"""[^\s,;"'(){}\[\]<>&|=:]+={0,2}""")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("stop", T.LongType()), T.StructField("score", T.DoubleType())]))


def sensitivity(name: str) -> float:
    low = name.lower().replace("-", "_")
    return max((w for word, w in NAMES.items() if word in low), default=0.0)


def looks(value: str) -> float:
    """0 to 1: how much a literal looks like a key or a password rather than a word, a number or a stand-in."""
    n = len(value)
    if n < 6 or STAND_INS.search(value) or " " in value.strip():
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + (not value.isalnum())
    return min(1.0, entropy / 3.0) * (0.5 if classes < 2 else 1.0) * min(1.0, n / 8)


def _name_before(text: str, at: int) -> str:
    """The identifier that ends before an operator, past blanks and a closing quote or bracket."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    while i and text[i - 1] in "\"'])":
        i -= 1
    j = i
    while j and text[j - 1] in NAME_CHARS:
        j -= 1
    return text[j:i].strip(".-")


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, spans of its literals, names it refers to) for every assignment, in order of the text."""
    end = 0
    for op in OPERATOR.finditer(text):
        if op.start() < end or text[op.start() - 1:op.start()] in ("=", "!", "<", ">", ":") or text[op.end():op.end() + 1] in ("=", ":") or text.startswith("//", op.end()):
            continue
        name = _name_before(text, op.start())
        if not name or name[0].isdigit():
            continue
        at, literals, refers = op.end(), [], []
        while True:
            while text[at:at + 1] in (" ", "\t"):
                at += 1
            if m := STRING.match(text, at):
                literals.append(m.span(1) if m[1] is not None else m.span(2))
            elif m := REFERENCE.match(text, at):
                refers.append(m[1])
                literals.append(m.span(1))  # a bare word is a literal where no constant has this name
            elif m := BARE.match(text, at):
                literals.append(m.span())
            else:
                break
            at = end = m.end()
            while text[at:at + 1] in (" ", "\t"):
                at += 1
            if text[at:at + 1] != "+":
                break
            at += 1
        if literals:
            yield name, literals, refers


def literal_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, stop, score) of literals that reach a sensitive name directly or through other names."""
    if ":" not in text and "=" not in text:
        return []
    # an assignment keeps its own literals and points to those it refers to; weights then run back once, from the last
    latest: dict[str, int] = {}
    made: list[tuple[list[tuple[int, int]], list[int]]] = []
    weights: list[float] = []
    for name, literals, refers in assignments(text):
        own = [s for s in literals if not (text[s[0]:s[1]] in refers and text[s[0]:s[1]] in latest)]
        made.append((own, [latest[r] for r in dict.fromkeys(refers) if r in latest]))
        weights.append(sensitivity(name))
        latest[name] = len(made) - 1
    reach: dict[tuple[int, int], float] = {}
    for i in range(len(made) - 1, -1, -1):
        if weights[i]:
            own, sources = made[i]
            for j in sources:
                weights[j] = max(weights[j], weights[i])
            for s in own:
                reach[s] = max(reach.get(s, 0.0), weights[i])
    out = []
    for (a, b), weight in sorted(reach.items()):
        score = weight * looks(text[a:b])
        if score >= LEAST_SCORE:
            out.append((a, b, round(score, 6)))
    return out


def scan_text(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, stop, score) by start, then kind; code points, stop exclusive; null is empty."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    found += [("literal", a, b, s) for a, b, s in literal_spans(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact_text(text: str, spans: list[tuple[str, int, int, float]], mask: str = "[SECRET]") -> str:
    """The text with every span replaced by the mask; spans that overlap or touch become one. Of an assignment only the
    value goes."""
    out, done, open_to = [], 0, -1
    values = ((ASSIGN.match(text, a).start(2) if kind == "assign" else a, b) for kind, a, b, _ in spans)
    for a, b in sorted(values):
        if a > open_to:
            if open_to >= 0:
                out.append(mask)
            out.append(text[done if open_to < 0 else open_to:a])
        open_to = max(open_to, b)
        done = open_to
    if open_to >= 0:
        out.append(mask)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., spans): a row per document. Null and empty texts have no spans; other columns are not read."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("text_"))
    schema = rows.select(*keep).schema.add("spans", SPANS)

    def job(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            found = [[dict(zip(("kind", "start", "stop", "score"), s)) for s in scan_text(t)] for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(found, kind)], names=[*keep, "spans"])

    return rows.mapInArrow(job, schema)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets masked and the length counted anew; a text without secrets, and null, stays as it is."""
    at = docs.columns.index(text)
    size = docs.columns.index(n_chars) if n_chars in docs.columns else None
    schema = docs.schema

    def job(batches):
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            texts, hit = [], []
            for t in cols[at].to_pylist():
                spans = scan_text(t)
                hit.append(bool(spans))
                texts.append(redact_text(t, spans) if spans else t)
            if size is not None:
                old = cols[size].to_pylist()
                cols[size] = pa.array([len(t) if h else n for t, h, n in zip(texts, hit, old)], cols[size].type)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(job, schema)
