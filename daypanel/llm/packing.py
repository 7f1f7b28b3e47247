"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Documents are tokenised and cut in tasks; only lengths matter from there on. Pieces of equal length are
interchangeable, so best-fit decreasing needs no more than the number of pieces of each length, at most
``capacity`` numbers however many documents there are. It runs over that histogram: a segment tree over the
remaining capacities finds the tightest open bin in logarithmic time, for a whole run of equal pieces at
once, and the plan it writes says which ranks of a length go to which bins. The tasks then number the
pieces of each length (a prefix sum over tasks) and read their place off the plan. The packing is that of
the sequential method, with no group or bin in one place.

Defined results: a null or empty text is a document of the end id alone; repeated rows and ids are packed
row by row; columns other than id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from daypanel.llm import arrays as A
from daypanel.llm.staging import staged

CAPACITY = 2048
END = 0
TOKENIZER = "byte_bpe_50k"


@lru_cache(maxsize=2)
def _coder(name: str):
    """(encoder, special tokens): the ids of ``<name>.json``, coded by its ranks in ``<name>.tiktoken``.

    The two files hold one vocabulary; the second library codes it several times faster. The special
    strings are those of the first and count as special wherever they stand, as is its default.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    with open(public_tokenizers.path(f"{name}.json")) as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _exact_coder(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_ids(text: str, name: str = TOKENIZER) -> np.ndarray:
    """Token ids of a whole text, without added special tokens."""
    try:
        return _coder(name).encode_to_numpy(text, allowed_special="all").astype("<u4")
    except BaseException as error:  # the fast coder's regex gives up on some very long runs; its panic is no Exception
        if isinstance(error, (KeyboardInterrupt, SystemExit)):
            raise
        return np.array(_exact_coder(name).encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: the first takes what is left over by full ones."""
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(s, (head if head and s == 0 else capacity)) for s in starts]


class Capacities:
    """Segment tree over remaining capacities: how many open bins have each, and the lowest that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += bins
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The lowest capacity of at least ``need`` that an open bin has."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The packing of ``counts[length]`` pieces of each length, as runs of equal pieces.

    Rows are (length, first rank, pieces per bin, first bin, offset in the bin), in order of length and
    rank: piece ``r`` of a length lies in bin ``first bin + (r - first rank) // per bin``. A piece that finds
    no open bin opens one; the next of its length fits there too, which is why bins fill one after the other.
    """
    tree = Capacities(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    bins, plan = 0, []

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            open_bins.setdefault(room, []).append((first, many))
            tree.add(room, many)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, many = bins, -(-left // (capacity // length))
                bins += many
            else:
                first, many = open_bins[room].pop()
                tree.add(room, -many)
            per = room // length
            full, rest = min(many, left // per), 0
            if full < many:
                rest = min(left - full * per, per - 1)
            plan.append((length, rank, per, first, capacity - room))
            put(room - per * length, first, full)
            if full < many:
                put(room - rest * length, first + full, 1 if rest else 0)
                put(room, first + full + bool(rest), many - full - bool(rest))
            rank += full * per + rest
            left -= full * per + rest
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def _pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, name: str) -> DataFrame:
    """One row per piece, with the task that made it and its number among the task's pieces of that length."""
    schema = StructType(
        [StructField("doc_id", docs.schema[doc_id].dataType), StructField("piece", IntegerType())]
        + [StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "task", "nth")]
    )

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for part in A.pieces(batch, "text"):
                rows = []
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids = np.append(token_ids(t or "", name), np.uint32(END)).astype("<u4")
                    for j, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((i, j, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length]))
                        seen[length] += 1
                at, *cols = zip(*rows)
                cols = [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array([task] * len(at), pa.int64()), pa.array(cols[4], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *cols], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    pieces = staged(_pieces(docs, doc_id, text, capacity, tokenizer), "pieces")
    counts = staged(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_decreasing(totals, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    schema = StructType(ranked.schema.fields[:5] + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    key = plan[:, 0] << np.int64(48) | plan[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = plan[np.searchsorted(key, length << np.int64(48) | rank, side="right") - 1]
            nth = rank - row[:, 1]
            found = [row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, found)], names=schema.names)

    return ranked.mapInArrow(place, schema)
