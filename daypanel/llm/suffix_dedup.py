"""Removal of repeated byte strings across and within texts, by suffix arrays.

1. Anchors. In each text, every window of ``length`` bytes picks the lowest hash among its 32-byte strings.
   Equal windows pick the same string at the same place, so a repeated window has a repeated anchor. Only
   anchor hashes are shuffled and counted, about one per 35 bytes.
2. A repeated anchor stands for the stretch of bytes that its windows cover. Equal stretches of one anchor
   (by a hash of all their bytes) are folded to the first; every later one repeats it whole and is removed whole.
3. The different stretches of one anchor share a window only in part. They are cut into parts of ``PART``
   neighbouring windows, which all hold one core of bytes; equal parts are folded, and a core that only one
   part has is done. Of the rest, the core is written as one symbol, and the suffix array of the parts that
   share it is built by the linear grouping construction (``lyndon_suffixes``), very many at a time.
   Neighbours with a window in common (checked byte by byte) form the classes of equal windows, and all
   but the first of a class are removed.
4. An anchor with more than ``MOST`` different stretches (a hot passage among near copies) is cut by window
   instead: equal windows are folded in the same way by a distributed group, exactly.

The order of windows is (doc_id, start) on the input. Defined results: a null id sorts first; rows with equal
ids, also null ones, and different texts are different documents in the order of a hash of id and text, by which all
rows are joined, so no id is a hot key; rows equal in id and text are one document seen several times; a null or empty
text, or one shorter than ``length``, loses nothing; an empty table gives an empty table; other columns are
passed through or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from daypanel.llm import arrays as A
from daypanel.llm.lyndon_suffixes import suffix_arrays
from daypanel.llm.staging import staged

LENGTH = 100
ANCHOR = 32
#: Different stretches of one anchor that are compared in one suffix array; more are compared by window.
MOST = 8192
#: Neighbouring windows of a part.
PART = 9
#: Bytes of stretches that are solved at a time, and symbols whose suffix arrays are built in step.
BATCH = 2 << 20
_KEEP = ["h", "stretch", "id", "k", "at", "fold", "lead"]
_NO_ID = -(1 << 63)
_U32 = np.uint64(32)


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(owner, place, hash, first, last): each anchor and the first and last start of its windows."""
    n = len(buf) - length + 1
    empty = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return empty, empty, np.zeros(0, np.uint64), empty, empty
    k = min(ANCHOR, max(1, length // 2))
    value = A.rolling_hash(buf, k)
    low = (value >> _U32 << _U32) | np.arange(len(value), dtype=np.uint64)
    width, reach = length - k + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    room = np.maximum(0, np.diff(offs) - length + 1)
    owner = np.repeat(np.arange(len(room)), room)
    start = np.arange(len(owner)) + np.repeat(offs[:-1] - (np.cumsum(room) - room), room)
    if not len(start):
        return empty, empty, np.zeros(0, np.uint64), empty, empty
    pick = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])))
    last = np.append(new[1:], len(start)) - 1
    return owner[new], pick[new], value[pick[new]], start[new], start[last]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(k, h, n): the distinct anchor hashes of each text and how often each is picked."""

    def run(batch):
        buf, offs = A.utf8(batch.column(1))
        owner, _, value, _, _ = anchors(buf, offs, length)
        at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        new = A.firsts(value, at)
        many = np.ones(len(value), dtype=np.int32)
        if not new.all():
            many[:] = np.where(A.repeated(A.mix(value + A.mix(owner.astype(np.uint64)))), 2, 1)
        keys = batch.column(0).take(pa.array(owner[new]))
        return pa.RecordBatch.from_arrays([keys, pa.array(value[new].view(np.int64)), pa.array(many[new])], names=["k", "h", "n"])

    return A.map_texts(docs, "text", run, "k long, h long, n int")


def _mine(column: pa.Array, value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which anchors are in the list (of repeated hashes) of their text."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(lists.flatten()).view(np.uint64) if len(lists) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
    listed = np.sort(A.mix(flat + A.mix(row.astype(np.uint64))))
    own = A.mix(value + A.mix(owner.astype(np.uint64)))
    if not len(listed):
        return np.zeros(len(own), dtype=bool)
    return listed[np.minimum(np.searchsorted(listed, own), len(listed) - 1)] == own


def _find(row, at, fold, own_row, own_at, own_fold) -> tuple[np.ndarray, np.ndarray]:
    """Which listed (row, at, fold) equal an own one: (index in the list, index among the own), own ascending."""
    key = lambda r, a, f: A.mix(f ^ A.mix(r.astype(np.uint64) << np.uint64(40) ^ a.astype(np.uint64)))
    listed, own = key(row, at, fold), key(own_row, own_at, own_fold)
    if not len(listed):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(listed)
    found = order[np.minimum(np.searchsorted(listed[order], own), len(listed) - 1)]
    hit = np.flatnonzero(listed[found] == own)
    return found[hit], hit


def _folds(rows: DataFrame, length: int) -> DataFrame:
    """(h, fold, id, k, at) of the repeated anchors: hashes of the anchor and of its stretch, and its place.

    Of equal stretches in a batch only the first by (id, k, at) is emitted.
    """

    def run(batch):
        buf, offs = A.utf8(batch.column(2))
        owner, place, value, first, last = anchors(buf, offs, length)
        own = np.flatnonzero(_mine(batch.column(3), value, owner))
        ids, k = (batch.column(c).to_numpy(zero_copy_only=False)[owner[own]] for c in (0, 1))
        at = place[own] - offs[owner[own]]
        fold = A.span_hash(buf, first[own], last[own] + length)
        key = A.mix(value[own] ^ A.mix(fold))
        keep = np.ones(len(own), dtype=bool)
        again = np.flatnonzero(A.repeated(key))
        again = again[np.lexsort((at[again], k[again], ids[again], key[again]))]
        keep[again[np.append(False, key[again][1:] == key[again][:-1])[: len(again)]]] = False
        cols = [value[own][keep].view(np.int64), fold[keep].view(np.int64), ids[keep], k[keep], at[keep]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "fold", "id", "k", "at"])

    return A.map_texts(rows, "text", run, "h long, fold long, id long, k long, at long")


def _stretches(rows: DataFrame, length: int) -> DataFrame:
    """(h, stretch, id, k, at, fold, n, lead) of the anchors listed in ``want`` (at, fold, n) of each text."""

    def run(batch):
        buf, offs = A.utf8(batch.column(2))
        owner, place, value, first, last = anchors(buf, offs, length)
        fold = A.span_hash(buf, first, last + length)
        lists = batch.column(3)
        at, listed, many = lists.flatten().flatten()
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        found, own = _find(row, np.asarray(at), np.asarray(listed).view(np.uint64), owner, place - offs[owner], fold)
        size = last[own] - first[own] + length
        ends = np.concatenate([[0], np.cumsum(size)])
        span = np.arange(ends[-1]) + np.repeat(first[own] - ends[:-1], size)
        return pa.RecordBatch.from_arrays(
            [pa.array(value[own].view(np.int64)), A.ragged(buf[span], ends), *[batch.column(c).take(pa.array(owner[own])) for c in (0, 1)],
             pa.array((place - offs[owner])[own]), pa.array(fold[own].view(np.int64)), many.take(pa.array(found)), pa.array((place - first)[own])],
            names=["h", "stretch", "id", "k", "at", "fold", "n", "lead"],
        )

    return A.map_texts(rows, "text", run, "h long, stretch binary, id long, k long, at long, fold long, n long, lead long")


_FIRST = "min(struct(id, k, at)) AS p"


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges ``start .. start + size - 1``, range after range."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _classes(table: pa.Table, length: int) -> np.ndarray:
    """Windows, as places in the joined stretches of ``table``, that an earlier stretch of their anchor holds.

    Rows are the different stretches of several anchors; ``lead`` is the place of the anchor in its stretch.
    """
    h, lead = table["h"].to_numpy().view(np.uint64), table["lead"].to_numpy()
    buf, offs = A.utf8(table["stretch"].combine_chunks())
    many = np.diff(offs) - length + 1
    # Order by (id, k, place of the anchor); ties are equal places of rows that are equal.
    by = [table[c].to_numpy() for c in ("at", "k", "id")]
    sort = np.lexsort(by)
    rank = np.empty(len(sort), dtype=np.int64)
    rank[sort] = np.cumsum(np.append(True, np.any([x[sort][1:] != x[sort][:-1] for x in by], axis=0)))
    # Parts: windows whose start lies PART * p .. PART * p + PART - 1 bytes before the anchor.
    low = (lead - many + 1) // PART
    count = lead // PART - low + 1
    row = np.repeat(np.arange(len(h)), count)
    part = _ranges(low, count)
    first = np.maximum(0, lead[row] - (PART * part + PART - 1))
    last = np.minimum(many[row] - 1, lead[row] - PART * part)
    core = offs[row] + lead[row] - PART * part
    core_end = core + length - PART + 1
    start, end = offs[row] + first, offs[row] + last + length
    key = A.mix(h[row] ^ A.mix(A.span_hash(buf, core, core_end) + part.astype(np.uint64)))
    same = A.span_hash(buf, start, end) ^ A.mix((core - start).astype(np.uint64))
    order = np.lexsort((rank[row], same, key))
    k, f, r = key[order], same[order], rank[row][order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, f[1:] != f[:-1])
    heads = np.flatnonzero(new)
    later = order[r > np.repeat(r[heads], np.diff(np.append(heads, len(order))))]
    gone = [_ranges(start[later], (last - first + 1)[later])]
    # Cores that several different parts have.
    group = np.cumsum(new_key)[heads]
    shared = np.bincount(group, minlength=1)[group] > 1
    pick, group = order[heads[shared]], group[shared]
    if len(pick):
        width = np.bincount(group, weights=(end - start)[pick] - (core_end - core)[pick] + 2, minlength=1)
        bundle = (np.cumsum(width) - width)[group] // BATCH
        for at in np.split(np.arange(len(pick)), np.flatnonzero(np.diff(bundle)) + 1):
            i = pick[at]
            gone.append(_windows(buf, start[i], end[i], core[i], core_end[i], group[at], rank[row[i]], length))
    return np.concatenate(gone)


def _windows(buf, start, end, core, core_end, group, rank, length: int) -> np.ndarray:
    """Starts of the windows of parts that an earlier part of their group holds; parts of a group lie together."""
    left, right = core - start, end - core_end
    size = left + 1 + right
    # Per part: the bytes before the core, the core as one symbol, the bytes after it, a separator below all.
    at = np.cumsum(size + 1) - (size + 1)
    symbols = np.zeros(int((size + 1).sum()), dtype=np.int64)
    symbols[_ranges(at, left)] = buf[_ranges(start, left)].astype(np.int64) + 1
    symbols[at + left] = 257
    symbols[_ranges(at + left + 1, right)] = buf[_ranges(core_end, right)].astype(np.int64) + 1
    bounds = np.append(at[np.flatnonzero(np.append(True, group[1:] != group[:-1]))], len(symbols))
    order = suffix_arrays(symbols, bounds)
    part = np.repeat(np.arange(len(start)), size + 1)
    inside = np.arange(len(symbols)) - at[part] <= end[part] - start[part] - length
    order = order[inside[order]]
    flat = start[part[order]] + order - at[part[order]]
    # Neighbours with a window in common: equal hashes, then equal bytes.
    value = A.span_hash(buf, flat, flat + length)
    same = np.append(False, (value[1:] == value[:-1]) & (group[part[order[1:]]] == group[part[order[:-1]]]))
    pairs = np.flatnonzero(same)
    for low in range(0, len(pairs), 4096):
        i = pairs[low : low + 4096]
        span = np.arange(length)
        same[i] = (buf[flat[i][:, None] + span] == buf[flat[i - 1][:, None] + span]).all(axis=1)
    kind = np.cumsum(~same)
    mine = rank[part[order]]
    best = np.full(int(kind[-1]) + 1 if len(kind) else 1, np.iinfo(np.int64).max)
    np.minimum.at(best, kind, mine)
    return flat[mine > best[kind]]


def _partly(rows: DataFrame, length: int) -> DataFrame:
    """(k, at, fold, gone): of the first occurrence of each stretch, the windows held by an earlier stretch.

    ``gone`` are starts of windows, counted from the stretch. Rows of an anchor lie together.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        _, offs = A.utf8(table["stretch"].combine_chunks())
        gone = np.sort(_classes(table, length))
        cut = np.searchsorted(gone, offs)
        local = (gone - np.repeat(offs[:-1], np.diff(cut))).astype(np.int32)
        cols = [table[c].combine_chunks() for c in ("k", "at", "fold")]
        return pa.RecordBatch.from_arrays([*cols, A.ragged(local, cut)], names=["k", "at", "fold", "gone"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        bytes_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            bytes_held += batch.column(1).nbytes
            if bytes_held >= BATCH:
                table = pa.Table.from_batches(held).combine_chunks()
                h = table["h"].to_numpy()
                cut = int(np.flatnonzero(np.append(True, h[1:] != h[:-1]))[-1])  # the last anchor may go on
                at = 0
                for stop in _portions(table, h, cut):
                    yield solve(table.slice(at, stop - at))
                    at = stop
                held = table.slice(cut).to_batches()
                bytes_held = sum(b.column(1).nbytes for b in held)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            at = 0
            for stop in _portions(table, table["h"].to_numpy(), table.num_rows):
                yield solve(table.slice(at, stop - at))
                at = stop

    return rows.mapInArrow(run, "k long, at long, fold long, gone binary")


def _portions(table: pa.Table, h: np.ndarray, rows: int) -> list[int]:
    """Ends of portions of about ``BATCH`` bytes that keep the rows of an anchor together."""
    if not rows:
        return []
    ends = np.append(np.flatnonzero(h[1:rows] != h[: rows - 1]) + 1, rows)
    _, offs = A.utf8(table["stretch"].combine_chunks())
    part = offs[ends - 1] // BATCH
    return [int(e) for e in ends[np.append(part[1:] != part[:-1], True)]]


def _by_window(rows: DataFrame, length: int) -> DataFrame:
    """The same as ``_partly`` for hot anchors: one row per window, folded by a group of equal windows (128-bit hash)."""

    def cut(batch):
        buf, offs = A.utf8(batch.column(1))
        many = np.maximum(0, np.diff(offs) - length + 1)
        row = np.repeat(np.arange(len(many)), many)
        i = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        at = offs[row] + i
        w = np.stack([A.span_hash(x, at, at + length) for x in (buf, buf ^ np.uint8(0xA5))], axis=1)
        own = [batch.column(c).take(pa.array(row)) for c in (2, 3, 4, 5)]
        return pa.RecordBatch.from_arrays(
            [A.ragged(w.reshape(-1).view(np.uint8), np.arange(len(row) + 1) * 16), *own, pa.array(i.astype(np.int32))],
            names=["w", "id", "k", "at", "fold", "i"],
        )

    windows = A.map_texts(rows, "stretch", cut, "w binary, id long, k long, at long, fold long, i int")
    best = windows.groupBy("w").agg(F.expr(_FIRST)).select("w", "p.k", "p.at")
    held = windows.join(staged(best, "first-windows"), ["w", "k", "at"]).groupBy("k", "at", "fold").agg(F.collect_set("i").alias("held"))

    def pack(batch):
        out = []
        for size, held in zip(np.diff(A.utf8(batch.column(0))[1]), batch.column(4).to_pylist()):
            gone = np.ones(max(0, size - length + 1), dtype=bool)
            gone[held or []] = False
            out.append(np.flatnonzero(gone).astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([*batch.columns[1:4], pa.array(out, pa.binary())], names=["k", "at", "fold", "gone"])

    packed = rows.join(held, ["k", "at", "fold"], "left").select("stretch", "k", "at", "fold", "held")
    return A.map_texts(packed, "stretch", pack, "k long, at long, fold long, gone binary")


def _spans(buf, offs, lists: pa.Array, firsts: pa.Array, length: int) -> list[np.ndarray]:
    """Removed (start, end) runs of each text, from its repeated anchors and the stretches it is first to hold."""
    owner, place, value, first, last = anchors(buf, offs, length)
    own = _mine(lists, value, owner)
    owner, place, first, last = owner[own], place[own], first[own], last[own]
    fold = A.span_hash(buf, first, last + length)
    cover = np.zeros(len(buf) + 1, dtype=np.int64)
    at, listed, gone = firsts.flatten().flatten()
    row = np.repeat(np.arange(len(firsts)), np.asarray(firsts.value_lengths().fill_null(0)))
    found, hit = _find(row, np.asarray(at), np.asarray(listed).view(np.uint64), owner, place - offs[owner], fold)
    whole = np.ones(len(owner), dtype=bool)
    whole[hit] = False
    if len(hit):
        raw, ends = A.utf8(gone.take(pa.array(found)))
        starts = np.frombuffer(raw.tobytes(), np.int32) + np.repeat(first[hit], np.diff(ends) // 4)
        cover += np.bincount(starts, minlength=len(cover)) - np.bincount(starts + length, minlength=len(cover))
    cover += np.bincount(first[whole], minlength=len(cover)) - np.bincount(last[whole] + length, minlength=len(cover))
    covered = np.cumsum(cover[:-1]) > 0
    starts, ends = A._edges(covered, offs)
    at = np.searchsorted(starts, offs)
    return [np.stack([starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]], axis=1) - offs[i] for i in range(len(offs) - 1)]


def _prepared(docs: DataFrame, doc_id: str, text: str, length: int, hollow: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with the repeated anchors of each text, stretches that each row is first to hold).

    Rows have the columns of ``docs`` as ``d0 ..``, then ``id``, ``k`` (a hash of id and text, by which rows are joined), ``hs``. With ``hollow`` the text of rows
    without a repeated anchor is replaced by its length and digest, which is all that their result needs.
    """
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    t = f"d{names.index(text)}"
    own_id = f"d{names.index(doc_id)}"
    plain = plain.withColumns({"id": F.coalesce(own_id, F.lit(_NO_ID)), "k": F.xxhash64(own_id, t)})
    rows = staged(_anchor_rows(plain.select("k", F.col(t).alias("text")), length), "anchors")
    again = staged(rows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "repeated")
    lists = rows.select("k", "h").join(again, "h").groupBy("k").agg(F.collect_set("h").alias("hs"))
    joined = plain.join(lists, "k", "left")
    if hollow:
        bytes_ = F.coalesce(F.col(t), F.lit(""))
        joined = joined.withColumns(
            {
                "n_bytes": F.octet_length(bytes_).cast("long"),
                "digest": F.when(F.col("hs").isNull(), F.sha2(bytes_, 256)),
                t: F.when(F.col("hs").isNotNull(), F.col(t)),
            }
        )
    joined = staged(joined, "candidates")
    some = joined.where("hs IS NOT NULL").select("id", "k", F.col(t).alias("text"), "hs")
    folds = _folds(some, length).groupBy("h", "fold").agg(F.expr(_FIRST)).select("h", "fold", "p.k", "p.at")
    folds = staged(folds, "folds")
    sizes = folds.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    folds = folds.join(staged(sizes.where("n > 1"), "sizes"), "h", "left")
    single = folds.where("n IS NULL").select("k", "at", "fold", F.unhex(F.lit("")).alias("gone"))
    want = F.collect_list(F.struct("at", "fold", "n")).alias("want")
    wanted = folds.where("n IS NOT NULL").groupBy("k").agg(want)
    # Rows that are equal are one document: one of them speaks for all.
    speakers = some.join(wanted, "k").select("id", "k", "text", "want").dropDuplicates(["k"])
    several = staged(_stretches(speakers, length), "stretches")
    # Groups of like size lie together: the suffix arrays of a batch advance in step.
    cool = several.where(F.col("n") <= MOST).repartition("h").sortWithinPartitions("n", "h")
    hot = several.where(F.col("n") > MOST)
    firsts = single.unionByName(_partly(cool.select(*_KEEP), length)).unionByName(_by_window(hot.select(*_KEEP[:-1]), length))
    firsts = firsts.groupBy("k").agg(F.collect_list(F.struct("at", "fold", "gone")).alias("held"))
    return joined, firsts


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``."""
    joined, firsts = _prepared(docs.select(doc_id, text), doc_id, text, length, hollow=True)
    schema = StructType(
        [StructField("doc_id", docs.schema[doc_id].dataType)]
        + [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [StructField("kept_sha256", docs.schema[text].dataType)]
    )
    some = joined.where("hs IS NOT NULL").join(firsts, "k", "left").select("d0", "d1", "hs", "held")

    def run(batch):
        buf, offs = A.utf8(batch.column(1))
        digests, counts, gone = [], [], []
        for i, spans in enumerate(_spans(buf, offs, batch.column(2), batch.column(3), length)):
            keep = np.ones(offs[i + 1] - offs[i], dtype=bool)
            for a, b in spans:
                keep[a:b] = False
            digests.append(hashlib.sha256(buf[offs[i] : offs[i + 1]][keep].tobytes()).hexdigest())
            counts.append(len(spans))
            gone.append(int((~keep).sum()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offs)), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
            names=schema.names,
        )

    zero = F.lit(0).cast("long")
    rest = joined.where("hs IS NULL").select(
        F.col("d0").alias("doc_id"), "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("digest").alias("kept_sha256")
    )
    return A.map_texts(some, "d1", run, schema).unionByName(rest)


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with their repeated strings cut out of the text, other columns unchanged.

    A character that a cut splits goes whole. Rows whose words are all gone through the cut are dropped.
    """
    names = docs.columns
    t = names.index(text)
    joined, firsts = _prepared(docs, doc_id, text, length, hollow=False)
    own = [f"d{i}" for i in range(len(names))]
    some = joined.where("hs IS NOT NULL").join(firsts, "k", "left").select(*own, "hs", "held")
    schema = StructType([StructField(f"d{i}", docs.schema[c].dataType) for i, c in enumerate(names)])

    def run(batch):
        buf, offs = A.utf8(batch.column(t))
        texts = []
        for i, spans in enumerate(_spans(buf, offs, batch.column(len(own)), batch.column(len(own) + 1), length)):
            raw, at, parts = buf[offs[i] : offs[i + 1]].tobytes(), 0, []
            for a, b in spans.tolist():
                parts.append(raw[at:a])
                at = b
            texts.append("".join(x.decode("utf-8", "ignore") for x in [*parts, raw[at:]]))
        good = pa.array([i for i, x in enumerate(texts) if x.strip(" \t\n\v\f\r")], pa.int64())
        cols = list(batch.columns[: len(own)])
        cols[t] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(cols, names=own).take(good)

    done = A.map_texts(some, f"d{t}", run, schema).unionByName(joined.where("hs IS NULL").select(*own))
    return done.toDF(*names)
