"""Personal data in texts, also in disguise, with spans of the source text.

A batch of texts is one tape of symbols; each symbol knows the code points of the source that it stands for.
Transducers rewrite the tape one after the other: look-alike and full-width characters become plain ones and
invisible ones vanish, ``[dot]`` and `` dot `` become a dot, ``(at)`` and `` at `` become ``@``, spelled digits
become digits, letters among digits become the digits they look like. Identifiers are searched on the tape as
it is (the base) and on the rewritten one; a span found there goes back through the source positions of its
first and last symbol, so it covers exactly the characters of the disguise.

Identifiers (base, on the raw text, leftmost, not overlapping per kind, failing matches dropped without retry):
``email``, ``ip`` (parts up to 255), ``card`` (16 to 19 digits, Luhn), ``phone`` (8 to 15 digits after a plus).
Searches follow runs of digits and separators instead of backtracking, so any text takes linear time.

Rewriting is cautious, so that prose stays clean: a bare `` at `` counts only before a name with a usual
top label that has a disguised dot or follows letters with digits or marks, spelled digits only in chains of three or more, ``plus`` only before such a chain
or an area code in brackets. A span of the rewritten tape is added unless a base span of its kind covers it;
base spans always stay, and the counts by kind are those of the base.

Defined results: null is empty and has no spans; rows are judged one by one, also with equal or null ids; an
empty table gives an empty table; other columns may have any name. A text is never cut: a batch takes about
50 bytes of memory a code point, so a task of 1 GB takes texts of about 20 million characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from daypanel.llm import arrays as A

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like Latin ones, and the word forms of digits, dots and at signs.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "･": ".", "∙": ".",
}
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe00\ufe0e\ufe0f\ufeff"
SPELLED = (
    ("zero", "oh", "null", "z\x80ro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "f\x80nf", "fuenf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
DOTS = ("dot", "punkt", "point", "punto", "ponto")
ATS = ("at", "arroba")
#: Last labels that make a bare " at " count; any label of two letters does too.
TOP_LABELS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "dev", "app", "cloud", "online", "site", "example", "test")

#: Symbols of the tape beside ASCII: a disguised dot, any other letter or digit, any other character.
_DOT, _WORD, _OTHER = 1, 0x80, 0x1F
#: Blocks whose characters may fold to ASCII; elsewhere only the table above applies.
_FOLDING = ((0xA0, 0x3100), (0xFB00, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F200))
_TOP = 0x1F200


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Tape symbol of each code point after folding; 0 for an invisible one. Letters in lower case."""
    table = np.full(_TOP + 1, _WORD, dtype=np.uint8)
    for low, high in _FOLDING:
        for c in range(low, high):
            ch = chr(c)
            plain = unicodedata.normalize("NFKC", ch) if c > 0xFF or c == 0xA0 else ch
            digit = unicodedata.decimal(ch, None)
            if digit is not None:
                table[c] = 48 + digit
            elif len(plain) == 1 and plain.isascii():
                table[c] = ord(plain.lower())
            elif unicodedata.category(ch) == "Zs":
                table[c] = 32
            elif not ch.isalnum():
                table[c] = _OTHER
    table[:0x80] = np.frombuffer(bytes(range(0x80)).lower(), dtype=np.uint8)
    table[0x80:0xA0] = _OTHER
    table[[0, _DOT, 2]] = _OTHER
    for ch, plain in LOOK_ALIKES.items():
        table[ord(ch)] = ord(plain.lower())
    table[[ord(ch) for ch in INVISIBLE]] = 0
    return table


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_LOWER = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_LABEL = _flags(_LOWER + _LOWER.upper() + _DIGITS + "-")
_LOCAL = _LABEL | _flags("._%+")
_DOMAIN = _LABEL | _flags(".")
_DIGIT = _flags(_DIGITS)
_PHONE = _DIGIT | _flags(" ().-")


@dataclass
class Tape:
    """Symbols, and the source code points ``low`` to ``high`` (exclusive) that each stands for."""

    sym: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def rewrite(self, edits: Sequence[tuple[int, int, int]]) -> Tape:
        """Replace stretches of symbols, given as (start, end, symbol) in order, by one symbol each; symbol 0 deletes."""
        if not edits:
            return self
        start, end, new = (np.array(x, dtype=np.int64) for x in zip(*edits))
        sym, high = self.sym.copy(), self.high.copy()
        sym[start], high[start] = new, self.high[end - 1]
        depth = np.zeros(len(sym) + 1, dtype=np.int8)
        np.add.at(depth, np.minimum(start + 1, end), 1)
        np.add.at(depth, end, -1)
        keep = np.cumsum(depth[:-1]) == 0
        keep[start[new == 0]] = False
        return Tape(sym[keep], self.low[keep], high[keep])


def _any(words: Sequence[str]) -> bytes:
    return b"|".join(w.encode("latin-1") for w in words)


_END = rb"(?![a-z0-9\x80])"
_DOT_FORMS = re.compile(
    rb"(?<=[a-z0-9-])(?: {0,2}[\[({<] {0,2}(?:" + _any(DOTS) + rb"|\.) {0,2}[\])}>] {0,2}| {1,2}(?:" + _any(DOTS)
    + rb") {1,2}|[_-]dot[_-]|&#46;|&period;)(?=[a-z0-9-])"
)
_NAME = rb"[a-z0-9-]{1,63}"
#: A name with a disguised dot that ends in a top label; "look at the dot product" has none.
_HIDDEN_NAME = (
    rb"(?=(?:" + _NAME + rb"\.){0,4}" + _NAME + rb"\x01(?:" + _NAME + rb"[.\x01]){0,4}(?:[a-z]{2}|" + _any(TOP_LABELS) + rb")(?![a-z0-9\x80-]))"
)
_ANY_NAME = rb"(?=" + _NAME + rb"[.\x01][a-z0-9-])"
_AT_FORMS = re.compile(
    rb"(?<=[a-z0-9._%+-])(?: {0,2}[\[({<] {0,2}(?:" + _any(ATS) + rb"|@) {0,2}[\])}>] {0,2}" + _ANY_NAME
    + rb"| {1,2}(?:" + _any(ATS) + rb") {1,2}" + _HIDDEN_NAME + rb"|[_-]at[_-]" + _HIDDEN_NAME + rb"|&#64;|&commat;"
    + rb"| {1,2}@ {0,2}" + _ANY_NAME + rb"|@ {1,2}" + _ANY_NAME + rb")"
)
#: A bare " at " before a plain name counts if what stands before it is no word of prose: letters with digits or marks.
_AT_NAME = re.compile(
    rb"(?<=[a-z0-9._%+-]) {1,2}(?:" + _any(ATS) + rb") {1,2}(?=(?:" + _NAME + rb"\.){1,4}(?:[a-z]{2}|" + _any(TOP_LABELS) + rb")(?![a-z0-9\x80-]))"
)
_ACCOUNT_TAIL = re.compile(rb"[a-z0-9._%+-]+\Z")
_ACCOUNT = re.compile(rb"(?=[^a-z]*[a-z])(?=[a-z]*[0-9._%+-]+[a-z0-9])[a-z0-9._%+-]+\Z")
_VALUE = {w.encode("latin-1"): 48 + d for d, forms in enumerate(SPELLED) for w in forms}
_SPELLED = re.compile(rb"(?<![a-z0-9\x80])(?:" + b"|".join(sorted(_VALUE, key=len, reverse=True)) + rb")" + _END)
#: What may stand between two spelled digits of one chain.
_LINK = re.compile(rb"[ ().\x010-9-]{1,8}")
_PLUS = re.compile(rb"(?<![a-z0-9\x80])plus {0,2}(?=\x02|[0-9]{1,3} {0,1}\([0-9])")
_AS_DIGIT = re.compile(rb"(?:(?<=[0-9])|(?<=[0-9][ .-]))[oil|]{1,3}(?=[ .)-]?[0-9])")


def _spelled(tape: Tape) -> tuple[Tape, np.ndarray]:
    """Digits in words to digits, chain by chain; also where the chains begin on the new tape."""
    text = tape.sym.tobytes()
    found = [(m.start(), m.end(), _VALUE[m.group()]) for m in _SPELLED.finditer(text)]
    chains: list[list[tuple[int, int, int]]] = []
    for one in found:
        if chains and _LINK.fullmatch(text, chains[-1][-1][1], one[0]):
            chains[-1].append(one)
        else:
            chains.append([one])
    edits, heads = [], []
    for chain in chains:
        if len(chain) < 3:
            continue
        heads.append(chain[0][0])
        for i, (s, e, value) in enumerate(chain):
            # The single space between two digits goes with the first, so that they read as one number.
            joined = i + 1 < len(chain) and chain[i + 1][0] == e + 1 and text[e : e + 1] == b" "
            edits.append((s, e, value))
            if joined:
                edits.append((e, e + 1, 0))
    if not edits:
        return tape, np.zeros(0, np.int64)
    gone = np.cumsum([e - s - (1 if v else 0) for s, e, v in edits])
    before = np.concatenate([[0], gone])
    at = np.searchsorted([s for s, _, _ in edits], heads)
    return tape.rewrite(edits), np.array(heads) - before[at]


def normalise(tape: Tape) -> Tape:
    """The transducers after folding: dots, at signs, spelled digits, plus, letters among digits."""
    tape = tape.rewrite([(m.start(), m.end(), _DOT) for m in _DOT_FORMS.finditer(tape.sym.tobytes())])
    text = tape.sym.tobytes()
    signs = {m.start(): m.end() for m in _AT_FORMS.finditer(text)}
    for m in _AT_NAME.finditer(text):
        if _ACCOUNT.match(_ACCOUNT_TAIL.search(text, max(0, m.start() - 64), m.start()).group()):
            signs.setdefault(m.start(), m.end())
    tape = tape.rewrite([(s, e, 64) for s, e in sorted(signs.items())])
    tape, heads = _spelled(tape)
    marked = tape.sym.copy()
    marked[heads] = 2
    tape = tape.rewrite([(m.start(), m.end(), 43) for m in _PLUS.finditer(marked.tobytes())])
    edits = [(i, i + 1, 48 if tape.sym[i] == 111 else 49) for m in _AS_DIGIT.finditer(tape.sym.tobytes()) for i in range(*m.span())]
    tape = tape.rewrite(edits)
    sym = tape.sym.copy()
    sym[sym == _DOT] = 46
    return Tape(sym, tape.low, tape.high)


def _chains(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First digit run of each chain (one entry more), and the chain of each run, for runs one linking symbol apart."""
    tied = np.zeros(len(starts), dtype=bool)
    tied[1:] = (starts[1:] == ends[:-1] + 1) & link[b[ends[:-1]]]
    heads = np.flatnonzero(~tied)
    return np.append(heads, len(starts)), np.cumsum(~tied) - 1


def _luhn(digits: np.ndarray) -> bool:
    own = digits[::-1].astype(np.int64) - 48
    twice = own[1::2] * 2
    return (own[::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0


def _emails(b: np.ndarray) -> list[tuple[int, int]]:
    signs = np.flatnonzero(b == 64)
    if not len(signs):
        return []
    walls = np.flatnonzero(~_LOCAL[b])
    stops = np.append(np.flatnonzero(~_DOMAIN[b]), len(b))
    before = np.searchsorted(walls, signs) - 1
    first = np.where(before >= 0, walls[np.maximum(before, 0)] + 1, 0)
    last = stops[np.searchsorted(stops, signs + 1)]
    out, done = [], 0
    for p, s, e in zip(signs.tolist(), first.tolist(), last.tolist()):
        s = max(s, done)
        if s >= p:
            continue
        labels = b[p + 1 : e].tobytes().split(b".")
        whole = labels.index(b"") if b"" in labels else len(labels)
        if whole >= 2:
            done = p + 1 + sum(map(len, labels[:whole])) + whole - 1
            out.append((s, done))
    return out


def _ips(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    heads, chain = _chains(b, starts, ends, _flags("."))
    place = np.arange(len(starts)) - heads[chain]
    quads = np.flatnonzero((place % 4 == 0) & (np.arange(len(starts)) + 3 < heads[chain + 1]))
    out = []
    for i in quads.tolist():
        parts = [b[starts[j] : ends[j]].tobytes().lstrip(b"0") for j in range(i, i + 4)]
        if all(len(x) <= 3 and int(x or b"0") <= 255 for x in parts):
            out.append((int(starts[i]), int(ends[i + 3])))
    return out


def _cards(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    heads, _ = _chains(b, starts, ends, _flags(" -"))
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    digits = size[heads[1:]] - size[heads[:-1]]
    out = []
    for i in np.flatnonzero((digits >= 16) & (digits <= 19)).tolist():
        s, e = int(starts[heads[i]]), int(ends[heads[i + 1] - 1])
        own = b[s:e]
        if _luhn(own[_DIGIT[own]]):
            out.append((s, e))
    return out


def _phones(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    signs = np.flatnonzero(b[:-1] == 43)
    signs = signs[_DIGIT[b[signs + 1]]]
    if not len(signs):
        return []
    stops = np.append(np.flatnonzero(~_PHONE[b]), len(b))
    stop = stops[np.searchsorted(stops, signs + 1)]
    run = np.searchsorted(starts, stop) - 1
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    n = size[run + 1] - size[np.searchsorted(starts, signs + 1)]
    good = (ends[run] - 1 >= signs + 3) & (n >= 8) & (n <= 15)
    return list(zip(signs[good].tolist(), ends[run[good]].tolist()))


def identifiers(sym: np.ndarray) -> dict[str, list[tuple[int, int]]]:
    """Starts and ends of each kind on a tape whose texts are parted by newlines."""
    step = np.diff(np.concatenate([[0], _DIGIT[sym].view(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return {"email": _emails(sym), "ip": [], "card": [], "phone": []}
    return {"email": _emails(sym), "ip": _ips(sym, starts, ends), "card": _cards(sym, starts, ends), "phone": _phones(sym, starts, ends)}


@dataclass
class Found:
    """Spans of a batch by text, kind and start: text, kind, start, end (code points), base or not, normal form."""

    owner: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    base: np.ndarray
    normal: list[str]


def _covered(spans: list[tuple[int, int]], by: list[tuple[int, int]]) -> list[bool]:
    if not by:
        return [False] * len(spans)
    starts = np.array([s for s, _ in by])
    at = np.searchsorted(starts, [s for s, _ in spans], side="right") - 1
    return [i >= 0 and by[i][1] >= e for i, (_, e) in zip(at.tolist(), spans)]


def find(column: pa.Array) -> Found:
    """All spans of the texts of a column."""
    texts = [t or "" for t in column.to_pylist()]
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.where(points < 0x80, points, _WORD).astype(np.uint8)
    base = identifiers(raw)

    folded = _symbols()[np.minimum(points, _TOP)]
    low = np.flatnonzero(folded)
    tape = normalise(Tape(folded[low], low, low + 1))
    rewritten = len(tape.sym) < len(raw) or bool(((points >= 0x80) & (folded < 0x80) & (folded != _OTHER)).any())
    rows = [(k, s, e, True, raw[s:e].tobytes().decode("latin-1")) for k, kind in enumerate(KINDS) for s, e in base[kind]]
    if rewritten or not np.array_equal(tape.sym, _symbols()[np.minimum(raw, 0x80)]):
        for k, (kind, spans) in enumerate(identifiers(tape.sym).items()):
            source = [(int(tape.low[s]), int(tape.high[e - 1])) for s, e in spans]
            hidden = _covered(source, base[kind])
            rows += [
                (k, s, e, False, tape.sym[i:j].tobytes().decode("latin-1"))
                for (i, j), (s, e), known in zip(spans, source, hidden) if not known
            ]
    kind, start, end, own = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
    owner = np.searchsorted(begins, start, side="right") - 1
    order = np.lexsort((end, start, kind, owner))
    local = start - begins[owner], end - begins[owner]
    return Found(owner[order], kind[order], local[0][order], local[1][order], own[order] > 0, [rows[i][4] for i in order.tolist()])


def _listed(found: Found, at: slice, base_only: bool) -> str:
    return ",".join(
        f"{KINDS[k]}:{s}:{e}"
        for k, s, e, own in zip(found.kind[at].tolist(), found.start[at].tolist(), found.end[at].tolist(), found.base[at].tolist())
        if own or not base_only
    )


_COUNTS = tuple(f"n_{kind}" for kind in KINDS)
_OUT = StructType(
    [StructField(c, LongType(), False) for c in (*_COUNTS, "n_disguised")]
    + [StructField("base_sha256", StringType(), False), StructField("spans", StringType(), False)]
)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _plain(docs: DataFrame, text: str, keep: Sequence[str]) -> tuple[DataFrame, list[StructField]]:
    """The kept columns under positional names, then the text, so that no name can clash."""
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    return docs.select(*cols, F.col(f"`{text}`").alias("t")), [StructField(f"c{i}", docs.schema[c].dataType, True) for i, c in enumerate(keep)]


def detect(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row the columns of ``keep``, base counts by kind, the number of added spans, a digest of the base spans, all spans."""
    rows, fields = _plain(docs, text, keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, n = find(batch.column(batch.num_columns - 1)), batch.num_rows
        counts = [np.bincount(found.owner[found.base & (found.kind == k)], minlength=n) for k in range(len(KINDS))]
        counts.append(np.bincount(found.owner[~found.base], minlength=n))
        digest, spans = [_EMPTY] * n, [""] * n
        first = np.searchsorted(found.owner, np.arange(n + 1))
        for i in np.unique(found.owner).tolist():
            at = slice(first[i], first[i + 1])
            digest[i] = hashlib.sha256(_listed(found, at, True).encode()).hexdigest()
            spans[i] = _listed(found, at, False)
        made = [pa.array(c.astype(np.int64)) for c in counts] + [pa.array(digest), pa.array(spans)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[f.name for f in fields] + _OUT.names)

    return A.map_texts(rows, "t", run, StructType(fields + _OUT.fields)).toDF(*keep, *_OUT.names)


_SPAN = StructType([
    StructField("kind", StringType(), False), StructField("start", LongType(), False), StructField("end", LongType(), False),
    StructField("disguised", BooleanType(), False), StructField("source", StringType(), False), StructField("normal", StringType(), False),
])


def spans(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per span: the columns of ``keep``, kind, place, the source characters and their normal form."""
    rows, fields = _plain(docs, text, keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.num_columns - 1)
        found, texts = find(column), column.to_pylist()
        at = pa.array(found.owner)
        cut = [texts[o][s:e] for o, s, e in zip(found.owner.tolist(), found.start.tolist(), found.end.tolist())]
        made = [pa.array([KINDS[k] for k in found.kind.tolist()], pa.string()), pa.array(found.start), pa.array(found.end),
                pa.array(~found.base), pa.array(cut, pa.string()), pa.array(found.normal, pa.string())]
        return pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns[:-1]] + made, names=[f.name for f in fields] + _SPAN.names)

    return A.map_texts(rows, "t", run, StructType(fields + _SPAN.fields)).toDF(*keep, *_SPAN.names)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    names = docs.columns
    at = names.index(text)
    numbered = docs.toDF(*[f"d{i}" for i in range(len(names))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        found, texts = find(column), column.to_pylist()
        first = np.searchsorted(found.owner, np.arange(len(texts) + 1))
        for i in np.unique(found.owner).tolist():
            own = sorted(zip(*(x[first[i] : first[i + 1]].tolist() for x in (found.start, found.end, found.kind))))
            parts, done = [], 0
            for s, e, k in own:
                if s >= done:
                    parts += [texts[i][done:s], f"<{KINDS[k]}>"]
                done = max(done, e)
            texts[i] = "".join([*parts, texts[i][done:]])
        columns = list(batch.columns)
        columns[at] = pa.array(texts, column.type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    fields = [StructField(f"d{i}", f.dataType, True) for i, f in enumerate(docs.schema)]
    return A.map_texts(numbered, f"d{at}", run, StructType(fields)).toDF(*names)
