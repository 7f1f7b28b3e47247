"""Quality rules as a short-circuit cascade, ordered by rejections per unit of cost.

Base figures are counted for every document. The rules of the cascade are then applied one after the
other, each only to the documents that are still in. Their cost and selectivity are measured on a sample,
and the rules run in descending order of rejections per second. The order changes the work, never the
verdict: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words and fails the base; repeated rows and repeated ids are
judged row by row; other columns are neither read nor needed; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from daypanel.llm import arrays as A

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_WINDOW = 5

MIN_WORDS = 10
MAX_REPEATED_SHARE = 20
#: Rows looked at for cost and selectivity, on average.
SAMPLE_ROWS = 400

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Texts:
    """The texts of a batch with figures that are computed when a rule first asks for them."""

    def __init__(self, column: pa.Array):
        self.buf, self.offs = A.utf8(column)

    @cached_property
    def _words(self):
        return A.words(self.buf, self.offs)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self._words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return A.per_text(~A.SPACE[self.buf] & ((self.buf & 0xC0) != 0x80), self.offs)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return A.per_text(_SYMBOL[self.buf], self.offs)

    @cached_property
    def _hashes(self) -> np.ndarray:
        return A.span_hash(self.buf, *self._words[:2])

    @cached_property
    def stuttered_words(self) -> np.ndarray:
        """Words equal to the word before them in the same text."""
        same = np.zeros(len(self._hashes), dtype=bool)
        same[1:] = self._hashes[1:] == self._hashes[:-1]
        first = self._words[2]
        same[first[:-1][first[:-1] < len(same)]] = False
        return A.per_text(same, first)

    @cached_property
    def _lines(self):
        """Starts and ends of lines with a word, and the text of each."""
        starts, ends, first = A.lines(self.buf, self.offs)
        solid = np.concatenate([[0], np.cumsum(~A.SPACE[self.buf])])
        full = solid[ends] > solid[starts]
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return starts[full], ends[full], owner[full]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[2], minlength=len(self.offs) - 1)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        starts, ends, owner = self._lines
        value = A.span_hash(self.buf, starts, ends)
        offs = np.concatenate([[0], np.cumsum(self.n_lines)])
        return self.n_lines - A.per_text(A.firsts(value, offs), offs)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in a five-word window that occurs at least twice in its text."""
        starts, ends, first = self._words
        value = A.window_hash(self._hashes, _WINDOW)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.flatnonzero(owner[: len(value)] == owner[_WINDOW - 1 :]) if len(value) else np.zeros(0, int)
        twice = inside[A.repeated(A.mix(value[inside] + A.mix(owner[inside].astype(np.uint64))))]
        cover = np.zeros(len(starts) + 1, dtype=np.int64)
        cover[twice] += 1
        cover[twice + _WINDOW] -= 1
        return A.per_text(np.cumsum(cover)[:-1] > 0, first)

    @cached_property
    def upper_share(self) -> np.ndarray:
        return A.per_text(_UPPER[self.buf], self.offs) / np.maximum(1, A.per_text(_LETTER[self.buf], self.offs))

    @cached_property
    def shouted_words(self) -> np.ndarray:
        """Words that end in two exclamation marks."""
        starts, ends, first = self._words
        loud = (ends - starts >= 2) & (self.buf[ends - 1] == 33) & (self.buf[np.maximum(ends - 2, 0)] == 33)
        return A.per_text(loud, first)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives one flag per text."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The cascade in no special order.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("shouting", lambda t: 10 * t.shouted_words > t.n_words),
    Rule("capitals", lambda t: t.upper_share > 0.5),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("stutter", lambda t: 10 * t.stuttered_words > 3 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 40 * t.n_words),
    Rule("short_words", lambda t: 2 * t.word_chars < 3 * t.n_words),
)


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < MIN_WORDS) | (100 * t.n_repeat_words > MAX_REPEATED_SHARE * t.n_words)


def cascade(column: pa.Array, alive: np.ndarray, rules: Sequence[Rule]) -> np.ndarray:
    """Texts that no rule rejects; a rule sees only the texts that the rules before it left."""
    alive = np.flatnonzero(alive)
    texts = Texts(column.take(pa.array(alive)))
    for rule in rules:
        bad = rule.rejects(texts)
        if bad.any():
            alive = alive[~bad]
            texts = Texts(column.take(pa.array(alive)))
    return alive


_PROFILE = "rule string, rows long, rejected long, seconds double"


def profile(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> list[dict]:
    """Rows, rejections and seconds of each rule on a sample of about ``SAMPLE_ROWS`` rows.

    Every row is drawn by itself with the same chance, so no task gathers the sample, however many there are.
    """
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = docs.select(F.col(f"`{text}`").alias("text")).sample(share, 11)

    def measure(batches):
        for batch in batches:
            for piece in A.pieces(batch, "text"):
                rows = []
                for rule in rules:
                    began = time.perf_counter()
                    rejected = int(rule.rejects(Texts(piece.column(0))).sum())
                    rows.append((rule.name, piece.num_rows, rejected, time.perf_counter() - began))
                yield pa.RecordBatch.from_pylist([dict(zip(("rule", "rows", "rejected", "seconds"), r)) for r in rows])

    sums = sample.mapInArrow(measure, _PROFILE).groupBy("rule").agg(
        F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")
    )
    return [r.asDict() for r in sums.collect()]


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> list[Rule]:
    """The rules by rejections per second on the sample, highest first; unmeasured rules keep their place at the end."""
    seen = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in profile(docs, rules, text)}
    return sorted(rules, key=lambda r: -seen.get(r.name, 0.0))


_OUT = StructType(
    [StructField(c, LongType(), False) for c in BASE]
    + [StructField("base_failed", BooleanType(), False), StructField("kept", BooleanType(), False)]
)


def judge(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] | None = None) -> DataFrame:
    """The columns of ``keep``, the base figures, ``base_failed`` and ``kept``, one row per row of ``docs``."""
    order = ordered(docs, RULES if rules is None else rules, text)
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*cols, F.col(f"`{text}`").alias("t"))
    kept_fields = [StructField(f"c{i}", docs.schema[c].dataType, True) for i, c in enumerate(keep)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.num_columns - 1)
        t = Texts(column)
        failed = base_failed(t)
        kept = np.zeros(batch.num_rows, dtype=bool)
        kept[cascade(column, ~failed, order)] = True
        found = [pa.array(getattr(t, c).astype(np.int64)) for c in BASE] + [pa.array(failed), pa.array(kept)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[f.name for f in kept_fields] + _OUT.names)

    out = A.map_texts(rows, "t", run, StructType(kept_fields + _OUT.fields))
    return out.toDF(*keep, *_OUT.names)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base and the cascade keep, with their columns unchanged."""
    names = docs.columns
    judged = judge(docs.toDF(*[f"d{i}" for i in range(len(names))]), f"d{names.index(text)}", [f"d{i}" for i in range(len(names))])
    return judged.where("kept").select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])
