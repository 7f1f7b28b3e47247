"""Texts of an Arrow batch as flat numpy arrays: bytes, words, lines, hashes of spans.

A batch is one byte buffer and the offsets of its texts. Every function works on all texts of the batch
at once; none loops over words. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Space and U+0009 to U+000D, the separators of words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(9, 14)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)

#: Batches whose texts are longer than this many bytes are cut into several, at row borders.
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one entry more than texts). Null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of a value per byte (or per word, line) over each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _edges(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the borders of texts."""
    n = len(solid)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    start = solid & (first[:-1] | np.concatenate([[True], ~solid[:-1]]))
    stop = solid & (first[1:] | np.concatenate([~solid[1:], [True]]))
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def runs(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the borders of texts, and the first run of each text (one entry more)."""
    starts, ends = _edges(solid, offs)
    return starts, ends, np.searchsorted(starts, offs)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each text (one entry more)."""
    starts, ends = _edges(~SPACE[buf], offs)
    return starts, ends, np.searchsorted(starts, offs)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines that hold a byte, split at newlines, and the first line of each text."""
    starts, ends = _edges(buf != 10, offs)
    return starts, ends, np.searchsorted(starts, offs)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _sized(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums of a polynomial in a fixed odd base."""
    up, down = _sized(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes that start at each byte."""
    n = max(0, len(buf) - k + 1)
    up, down = _sized(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n]) if n else np.zeros(0, np.uint64)


_STEP = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes, at every start (also across texts)."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out += hashes[i : i + n] * _STEP[i]
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and the first shingle of each text (one entry more).

    A text of fewer than ``width`` words, but at least one, has a single shingle: all its words.
    """
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offs = np.concatenate([[0], np.cumsum(n)])
    full = window_hash(hashes, width)
    owner = np.repeat(np.arange(len(counts)), n)
    at = first[owner] + np.arange(offs[-1]) - offs[owner]
    short = counts[owner] < width
    out = np.zeros(len(at), dtype=np.uint64)
    out[~short] = full[at[~short]]
    for i in np.flatnonzero(short):
        own = hashes[at[i] : at[i] + counts[owner[i]]]
        out[i] = mix(np.sum(own * _STEP[: len(own)] + np.uint64(len(own)), dtype=np.uint64)[None])[0]
    return out, offs


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once. One sort of the bare keys, then a lookup of few."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(keys), dtype=bool)
    if len(twice):
        bits = np.uint64(22)
        marked = np.zeros(1 << int(bits), dtype=bool)
        marked[twice >> (np.uint64(64) - bits)] = True
        maybe = np.flatnonzero(marked[keys >> (np.uint64(64) - bits)])
        at = np.minimum(np.searchsorted(twice, keys[maybe]), len(twice) - 1)
        out[maybe[twice[at] == keys[maybe]]] = True
    return out


def firsts(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each value is the first equal one of its text."""
    owner = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(offs))
    keys = mix(values + mix(owner))
    out = np.ones(len(values), dtype=bool)
    again = np.flatnonzero(repeated(keys))
    out[again] = False
    out[again[np.unique(keys[again], return_index=True)[1]]] = True
    return out


def distinct_per_text(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text in the order they first occur, and the first of each text (one entry more)."""
    new = firsts(values, offs)
    return values[new], np.concatenate([[0], np.cumsum(per_text(new, offs))])


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch cut at row borders so that the texts of a piece hold about ``most`` bytes at most.

    A single longer text is a piece of its own; no text is cut.
    """
    if batch.num_rows == 0:
        return
    _, offs = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def map_texts(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType) -> DataFrame:
    """Apply ``fn`` to pieces of the frame whose texts fit in memory."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column):
                yield fn(piece)

    return df.mapInArrow(run, schema)


def text_key(column: str = "text"):
    """SHA-256 of a text, null as empty: equal keys mean equal texts."""
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def ragged(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Values of each text as raw bytes, one binary per text."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )
