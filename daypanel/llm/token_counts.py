"""Token counts of whole texts by rank-synchronous merging over ragged arrays.

The vocabulary is a byte-fallback BPE model. No piece of it holds a word mark after another character
(checked when it is loaded), so no merge crosses the border before a space that follows a non-space: texts
fall into pre-tokens that merge on their own. The distinct pre-tokens of a batch are held as one ragged
array of symbols. In each round every sequence applies its lowest-rank pair, all sequences at once;
sequences with no pair left drop out. What survives is counted, then summed over the texts.

Of a pair that occurs several times in its sequence, the leftmost occurrences are merged in the same round
up to the first whose merge makes a pair of no higher rank, since the sequential order would take that first. In
some long sequences, such as runs of spaces, that leaves few merges a round: a sequence of more than ``LONG`` symbols
of which a round would merge less than one in ``SLOW`` is merged in sequential order instead, with a queue.
So the work is linear in the text, but for a logarithm, whatever it holds.

Defined results: a null or empty text has no bytes and no tokens; special strings in a text are ordinary
text; a character that the vocabulary lacks counts one token per byte; repeated rows and null ids are rows
like any other; columns other than id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from daypanel.llm import arrays as A

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
LONG, SLOW = 512, 256
_MARK = "▁"
_NONE = np.int64(1) << np.int64(62)
_HALF = np.uint64(32)


class Vocabulary:
    """Symbols, and for every pair of symbols that merges: its rank and the symbol it makes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        plain = not spec.precompiled_charsmap and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if not (plain and model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback):
            raise ValueError("the model must be a byte-fallback BPE without text normalisation")
        self.prefix = spec.add_dummy_prefix
        normal = [p for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]
        if len(normal) + 259 < len(model.pieces) or any(_MARK in p.piece.lstrip(_MARK) for p in normal):
            raise ValueError("the model has user-defined pieces, or pieces that cross word borders")
        score = {p.piece: p.score for p in normal}
        self.pieces = set(score)
        symbols = list(score) + sorted({c for p in score for c in p} - set(score))
        ids = {s: i for i, s in enumerate(symbols)}
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, ranks, made = [], [], []
        for piece, s in score.items():
            for i in range(1, len(piece)):
                left, right = ids.get(piece[:i]), ids.get(piece[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank_of[s])
                    made.append(ids[piece])
        order = np.argsort(np.array(keys, dtype=np.uint64))
        self.keys = np.array(keys, dtype=np.uint64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        # Characters: their symbol (or none), and their tokens if they survive alone.
        chars = [(ord(s), i) for s, i in ids.items() if len(s) == 1]
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        self.symbol[[c for c, _ in chars]] = [i for _, i in chars]
        self.single = np.zeros(0x110000, dtype=bool)
        self.single[[ord(s) for s in score if len(s) == 1]] = True
        self.whole = np.array([s in score for s in symbols], dtype=bool)

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and result by pair, for merging one at a time."""
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; a pair that does not merge has a rank above all."""
        key = left.astype(np.uint64) << _HALF | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(fits, self.ranks[at], _NONE), np.where(fits, self.made[at], -1)


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


def count_symbols(codes: np.ndarray, offs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Tokens of each sequence of code points ``codes[offs[i]:offs[i+1]]``."""
    n = len(offs) - 1
    out = np.zeros(n, dtype=np.int64)
    symbol = vocab.symbol[codes].astype(np.int64)
    # Tokens of a symbol if it survives: one for a piece, else its bytes.
    wide = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    cost = np.where(vocab.single[codes], 1, wide)
    seq = np.repeat(np.arange(n), np.diff(offs))
    while len(symbol):
        last = np.append(seq[1:] != seq[:-1], True)
        rank = np.full(len(symbol), _NONE)
        made = np.full(len(symbol), -1, dtype=np.int64)
        inner = np.flatnonzero(~last)
        rank[inner], made[inner] = vocab.merge(symbol[inner], symbol[inner + 1])
        # The rank each sequence applies; sequences without any are counted and leave.
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(seq)))
        done = np.repeat(low == _NONE, size)
        if done.any():
            out += np.bincount(seq[done], weights=cost[done], minlength=n).astype(np.int64)
            keep = ~done
            symbol, cost, seq, rank, made = symbol[keep], cost[keep], seq[keep], rank[keep], made[keep]
            if not len(symbol):
                break
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            size, low = np.diff(np.append(first, len(seq))), low[low != _NONE]
        at = _leftmost(np.flatnonzero(rank == np.repeat(low, size)))
        at = at[_before_lower(at, symbol, seq, made, rank, vocab)]
        merges = np.bincount(np.repeat(np.arange(len(size)), size)[at], minlength=len(size))
        slow = (size > LONG) & (merges * SLOW < size)
        if slow.any():
            for s, e in zip(first[slow].tolist(), (first + size)[slow].tolist()):
                out[seq[s]] += _in_order(symbol[s:e], cost[s:e], vocab)
            keep = np.repeat(~slow, size)
            symbol, cost, seq = symbol[keep], cost[keep], seq[keep]
            continue
        symbol[at], cost[at] = made[at], 1
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        symbol, cost, seq = symbol[keep], cost[keep], seq[keep]
    return out


def _in_order(symbol: np.ndarray, cost: np.ndarray, vocab: Vocabulary) -> int:
    """Tokens of one sequence, its pairs merged one by one: lowest rank first, leftmost of equal ones.

    The pairs at the start wait in a sorted list, those that merges make in a queue, which stays short.
    """
    n, pairs = len(symbol), vocab.pairs
    rank, _ = vocab.merge(symbol[:-1], symbol[1:])
    at = np.flatnonzero(rank < _NONE)
    waiting = np.sort(rank[at] << 32 | at).tolist()[::-1]
    queue: list[int] = []
    sym, cost = symbol.tolist(), cost.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while waiting or queue:
        entry = heappop(queue) if queue and (not waiting or queue[0] < waiting[-1]) else waiting.pop()
        here = entry & 0xFFFFFFFF
        there = after[here]
        # Symbols that are gone or unknown are negative. An entry counts if its place still has a pair of its rank.
        if there >= n or sym[here] < 0 or sym[there] < 0:
            continue
        found = pairs.get(sym[here] << 32 | sym[there])
        if found is None or found[0] != entry >> 32:
            continue
        sym[here], sym[there], cost[here], cost[there] = found[1], -2, 1, 0
        far = after[here] = after[there]
        if far < n:
            before[far] = here
            if sym[far] >= 0:
                new = pairs.get(found[1] << 32 | sym[far])
                if new:
                    heappush(queue, new[0] << 32 | here)
        near = before[here]
        if near >= 0 and sym[near] >= 0:
            new = pairs.get(sym[near] << 32 | found[1])
            if new:
                heappush(queue, new[0] << 32 | near)
    return sum(cost)


def _leftmost(at: np.ndarray) -> np.ndarray:
    """The occurrences that are merged when they are taken from the left: no two of them overlap."""
    run = np.append(True, at[1:] != at[:-1] + 1)
    start = np.flatnonzero(run)
    return at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]


def _before_lower(at, symbol, seq, made, rank, vocab) -> np.ndarray:
    """Which occurrences come no later than the first of their sequence that makes a pair of no higher rank."""
    x = made[at]
    bad = np.zeros(len(at), dtype=bool)
    # The neighbour before, as it is or already merged this round; the one after.
    has = np.flatnonzero((at > 0) & (seq[np.maximum(at - 1, 0)] == seq[at]))
    bad[has] |= vocab.merge(symbol[at[has] - 1], x[has])[0] <= rank[at[has]]
    joined = has[(has > 0) & (at[has] - 2 == at[np.maximum(has - 1, 0)])]
    bad[joined] |= vocab.merge(x[joined - 1], x[joined])[0] <= rank[at[joined]]
    after = np.minimum(at + 2, len(seq) - 1)
    has = np.flatnonzero((at + 2 < len(seq)) & (seq[after] == seq[at]))
    bad[has] |= vocab.merge(x[has], symbol[after[has]])[0] <= rank[at[has]]
    owner = seq[at]
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    before = np.cumsum(bad) - bad
    return before == np.repeat(before[start], np.diff(np.append(start, len(at))))


def _pretokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens (spaces, then what is no space) and the first of each text."""
    space = buf == 32
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    start = edge[:-1].copy()
    start[1:] |= space[1:] & ~space[:-1]
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, offs)


def _marked(text: pa.Array) -> pa.Array:
    """Spaces for word marks, which the model does not tell apart, and the mark it puts before a text."""
    import pyarrow.compute as pc

    return pc.replace_substring(text, _MARK, " ")


def count_tokens(column: pa.Array, vocab: Vocabulary) -> np.ndarray:
    """Tokens of each text of a batch."""
    if column.null_count:
        column = column.fill_null("")
    column = _marked(column)
    if vocab.prefix:
        raw, offs = A.utf8(column)
        full = np.diff(offs) > 0
        buf = np.full(len(raw) + int(full.sum()), 32, dtype=np.uint8)
        shift = np.cumsum(full)
        buf[np.arange(len(raw)) + np.repeat(shift, np.diff(offs))] = raw
        offs = offs + np.concatenate([[0], shift])
    else:
        buf, offs = A.utf8(column)
    if not len(buf):
        return np.zeros(len(column), dtype=np.int64)
    starts, ends, first = _pretokens(buf, offs)
    key, pick, back = np.unique(A.span_hash(buf, starts, ends), return_index=True, return_inverse=True)
    size = ends[pick] - starts[pick]
    at = np.concatenate([[0], np.cumsum(size)])
    flat = buf[np.arange(at[-1]) + np.repeat(starts[pick] - at[:-1], size)]
    codes = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    codes[codes == 32] = ord(_MARK)
    counts = count_symbols(codes, lead[at], vocab)
    return A.per_text(counts[back], first)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``."""
    schema = StructType(
        [StructField("doc_id", docs.schema[doc_id].dataType), StructField("n_bytes", LongType()),
         StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    )

    def run(batch):
        n = count_tokens(batch.column(1), vocabulary(model))
        size = np.diff(A.utf8(batch.column(1))[1])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=schema.names)

    return A.map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", run, schema)
