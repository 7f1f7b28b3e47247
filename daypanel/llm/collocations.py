"""Phrase collocations by set-oriented mining: occurrences are relations, joined, counted and filtered length by length.

A text is cut into pieces, a piece into words. The occurrence relation of length k has a row for each frequent
phrase of k words at its position; pieces follow each other with a gap, so two occurrences are adjacent in one
piece if their positions differ by one. The relation of length k + 1 is the merge join of the relation with
itself, position p with p + 1: both are sorted, and the phrase is named by its first and its last k words. Groups are counted, and a semi-join
with the frequent ones gives the relation from which the next length starts.

The relation is persisted sorted, in chunks of whole texts (about ``CHUNK`` bytes, one row each), so the merge join moves
no data: it compares neighbours of sorted arrays. What moves are the groups. Each chunk counts its own first and
sends every group once, with its count, to the bucket of the group; there counts are summed, frequent groups get
a number, and the chunks that hold them are told. A group of most of all rows is one entry a chunk. Buckets grow in number
with the entries, empty ones send nothing, so what moves is at most the occurrences. Names are exact: words are compared as
bytes, longer phrases by the numbers of their parts. The driver sees no phrase.

For a phrase the counts of all its beginnings and endings come from its two parts, which are frequent as well: two joins a length.

Defined results: null texts are empty; a null language counts as ``und``; repeated rows count as often as they stand, ids are not read;
phrases never cross pieces or texts; an empty table gives an empty table; other columns may have any name. A text is never cut: a
chunk takes about 40 bytes of memory a byte of text, so a task of 1 GB takes texts of 25 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from daypanel.llm import arrays as A
from daypanel.llm.staging import dropped, staged

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000

CHUNK = 8 << 20
#: Entries of a bucket, and buckets at least.
BUCKET = 500_000
LEAST = 64
#: Chunks that a Python task takes at once.
_BATCH = 4
#: Parts that the first phrases of a language are picked in, before they meet.
_PICKERS = 64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_BREAK
_SOLID[[0x20, 0x09]] = False
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
#: Bytes below which compression does not pay.
_FEW = 64
#: Between pieces in the first relation.
_GAP = 0


def pack(values: np.ndarray) -> bytes:
    """Numbers from zero up: width and length, then their lowest bytes, their next bytes and so on, compressed. Few numbers go as they are."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    if len(planes) < _FEW:
        return bytes([width | 0x80]) + planes
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    if data[0] & 0x80:
        width = data[0] & 0x7F
        raw, n = data[1:], (len(data) - 1) // width
    else:
        width, n = data[0], int.from_bytes(data[1:9], "little")
        raw = pa.decompress(data[9:], width * n, "zstd")
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def pack_rising(values: np.ndarray) -> bytes:
    """Numbers that never fall, by their steps."""
    return pack(np.diff(values, prepend=0))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts, lower-cased; whether a word opens a piece; words of each text."""
    buf, offs = A.utf8(column)
    buf = _LOWER[buf]
    solid = _SOLID[buf]
    starts, ends, first = A.runs(solid, offs)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[buf], dtype=np.int64)])
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(buf[solid])])
    return words, opens, np.diff(first)


def _dense(keys: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, the place of each key among them, and their counts."""
    if space > 4 * len(keys) + 1024:
        found, place, n = np.unique(keys, return_inverse=True, return_counts=True)
        return found, place, n
    n = np.bincount(keys, minlength=space)
    found = np.flatnonzero(n)
    place = np.zeros(space, dtype=np.int64)
    place[found] = np.arange(len(found))
    return found, place[keys], n[found]


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = A.utf8(words)
    return buf, offs


_WORDS = "chunk long, seq binary, lang array<string>, code binary, words binary, sizes binary, n binary, total map<string, long>"


def occurrences(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The relation of single words: per chunk its word numbers in order (0 between pieces, words from 1), and its words with language and count."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("t"))
    schema = pa.schema([
        ("chunk", pa.int64()), ("seq", pa.binary()), ("lang", pa.list_(pa.string())), ("code", pa.binary()), ("words", pa.binary()),
        ("sizes", pa.binary()), ("n", pa.binary()), ("total", pa.map_(pa.string(), pa.int64())),
    ])

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in A.pieces(batch, "t", CHUNK):
                words, opens, per_text = _words(piece.column(1))
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                langs = piece.column(0).dictionary_encode()
                names = langs.dictionary.to_pylist()
                own = np.repeat(langs.indices.to_numpy(), per_text)
                found, place, n = _dense(coded.indices.to_numpy().astype(np.int64) * len(names) + own, len(coded.dictionary) * len(names))
                seq = np.full(len(place) + int(opens.sum()), _GAP, dtype=np.int64)
                seq[np.arange(len(place)) + np.cumsum(opens)] = place + 1
                buf, offs = _flat(coded.dictionary.take(pa.array(found // len(names))))
                code = found % len(names)
                total = np.bincount(code, weights=n, minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_pylist(
                    [{"chunk": chunk, "seq": pack(seq), "lang": names, "code": pack(code), "words": buf.tobytes(), "sizes": pack(np.diff(offs)),
                      "n": pack(n), "total": list(zip(names, total.tolist()))}],
                    schema,
                )
                chunk += 1

    return staged(rows.mapInArrow(run, _WORDS), "phrases-1")


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with its entries, in ascending order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for at, own in zip(cuts.tolist(), np.split(order, cuts[1:])):
        if len(own):
            yield int(bucket[order[at]]), own


#: What buckets answer: to a chunk its frequent entries and their numbers; for the whole corpus the frequent groups.
_ANSWER = "chunk long, idx binary, ids binary, id long, lang string, word binary, a long, b long, f long"
_ARROW_ANSWER = pa.schema([
    ("chunk", pa.int64()), ("idx", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.binary()),
    ("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64()),
])


def _answers(chunks: list[int], sizes: list[int], idx: list[np.ndarray], group: np.ndarray, ids: np.ndarray, listed: dict[str, list]) -> pa.Table:
    """The frequent groups, listed, and for each chunk its entries in them. ``ids`` has the number of each group, or -1."""
    own = ids[group]
    out, at = [], 0
    for chunk, size, place in zip(chunks, sizes, idx):
        part = own[at : at + size]
        hit = part >= 0
        if hit.any():
            out.append({"chunk": chunk, "idx": pack_rising(place[hit]), "ids": pack(part[hit])})
        at += size
    rows = len(listed["f"])
    named = pa.table([pa.array(listed[f.name], f.type) if f.name in listed else pa.nulls(rows, f.type) for f in _ARROW_ANSWER], schema=_ARROW_ANSWER)
    return pa.concat_tables([pa.Table.from_pylist(out, _ARROW_ANSWER), named])


def _numbered(f: np.ndarray, least: int, bucket: int, buckets: int) -> np.ndarray:
    """A number for each frequent group, unique over all buckets; -1 for the others."""
    hit = f >= least
    return np.where(hit, (np.cumsum(hit) - 1) * buckets + bucket, -1)


def _buckets(entries: int) -> int:
    return max(LEAST, -(-entries // BUCKET))


def _count_words(table: DataFrame, least: int) -> DataFrame:
    """Answers for single words."""
    entries = table.select(F.sum(F.octet_length("words"))).first()[0] or 0
    buckets = _buckets(entries // 6)

    def send(batches):
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("lang", pa.string()), ("idx", pa.binary()), ("words", pa.binary()), ("sizes", pa.binary()), ("n", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                code, n, sizes = unpack(row["code"]), unpack(row["n"]), unpack(row["sizes"])
                offs = np.concatenate([[0], np.cumsum(sizes)])
                buf = np.frombuffer(row["words"], dtype=np.uint8)
                seeds = np.array([crc32(x.encode()) for x in row["lang"]], dtype=np.uint64)
                bucket = (A.mix(A.span_hash(buf, offs[:-1], offs[1:]) + seeds[code]) % np.uint64(buckets)).astype(np.int64)
                words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(buf)])
                out = []
                for key, own in _split(bucket * len(seeds) + code):
                    taken = words.take(pa.array(own))
                    data, at = _flat(taken)
                    out.append({"bucket": key // len(seeds), "chunk": row["chunk"], "lang": row["lang"][key % len(seeds)], "idx": pack_rising(own),
                                "words": data.tobytes(), "sizes": pack(np.diff(at)), "n": pack(n[own])})
                yield pa.RecordBatch.from_pylist(out, schema)

    def count(key, rows):
        sizes = [unpack(x) for x in rows["sizes"].to_pylist()]
        offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        data = b"".join(rows["words"].to_pylist())
        coded = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(data)]).dictionary_encode()
        langs = rows["lang"].combine_chunks().dictionary_encode()
        names = langs.dictionary.to_pylist()
        own = np.repeat(langs.indices.to_numpy(), [len(x) for x in sizes])
        found, group, _ = _dense(coded.indices.to_numpy().astype(np.int64) * len(names) + own, len(coded.dictionary) * len(names))
        f = np.zeros(len(found), dtype=np.int64)
        np.add.at(f, group, np.concatenate([unpack(x) for x in rows["n"].to_pylist()]))
        ids = _numbered(f, least, key[0].as_py(), buckets)
        hit = np.flatnonzero(ids >= 0)
        listed = {"id": ids[hit], "lang": [names[i] for i in found[hit] % len(names)],
                  "word": coded.dictionary.take(pa.array(found[hit] // len(names))).to_pylist(), "f": f[hit]}
        return _answers(rows["chunk"].to_pylist(), [len(x) for x in sizes], [unpack_rising(x) for x in rows["idx"].to_pylist()], group, ids, listed)

    sent = table.select("chunk", "lang", "code", "words", "sizes", "n").mapInArrow(
        send, "bucket int, chunk long, lang string, idx binary, words binary, sizes binary, n binary"
    )
    return staged(sent.groupBy("bucket").applyInArrow(count, _ANSWER), "phrases-frequent-1", _BATCH)


def _count_pairs(table: DataFrame, least: int, length: int) -> DataFrame:
    """Answers for phrases of two or more words, named by the numbers of their parts."""
    buckets = _buckets(table.select(F.sum("size")).first()[0] or 0)

    def send(batches):
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("idx", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                a, b, n = unpack_rising(row["a"]), unpack(row["b"]), unpack(row["n"])
                bucket = (A.mix(A.mix(a.astype(np.uint64)) + b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield pa.RecordBatch.from_pylist(
                    [{"bucket": k, "chunk": row["chunk"], "idx": pack_rising(own), "a": pack_rising(a[own]), "b": pack(b[own]), "n": pack(n[own])} for k, own in _split(bucket)],
                    schema,
                )

    def count(key, rows):
        a = np.concatenate([unpack_rising(x) for x in rows["a"].to_pylist()])
        b, n = (np.concatenate([unpack(x) for x in rows[c].to_pylist()]) for c in ("b", "n"))
        idx = [unpack_rising(x) for x in rows["idx"].to_pylist()]
        order = np.lexsort((b, a))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        f = np.add.reduceat(n[order], first)
        ids = _numbered(f, least, key[0].as_py(), buckets)
        hit = np.flatnonzero(ids >= 0)
        at = order[first[hit]]
        listed = {"id": ids[hit], "a": a[at], "b": b[at], "f": f[hit]}
        return _answers(rows["chunk"].to_pylist(), [len(x) for x in idx], idx, group, ids, listed)

    sent = table.select("chunk", "a", "b", "n").mapInArrow(send, "bucket int, chunk long, idx binary, a binary, b binary, n binary")
    return staged(sent.groupBy("bucket").applyInArrow(count, _ANSWER), f"phrases-frequent-{length}", _BATCH)


_PAIRS = "chunk long, at binary, seq binary, a binary, b binary, n binary, size long"


def _longer(table: DataFrame, answers: DataFrame, length: int) -> DataFrame:
    """The relation of the next length: occurrences of frequent phrases, joined with those one position on."""
    told = answers.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("idx", "ids")).alias("told"))
    has_places = "at" in table.columns
    rows = table.select("chunk", "seq", *(["at"] if has_places else [])).join(told, "chunk")
    schema = pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in ("at", "seq", "a", "b", "n")], ("size", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                idx = np.concatenate([unpack_rising(x["idx"]) for x in row["told"]])
                ids = np.concatenate([unpack(x["ids"]) for x in row["told"]])
                seq = unpack(row["seq"])
                # In the first relation 0 is the gap between pieces, and positions are places.
                shift = 0 if has_places else 1
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                place = np.full(max(int(seq.max(initial=0)), int(idx.max())) + 2, -1, dtype=np.int64)
                place[idx[order] + shift] = np.arange(len(ids))
                known = place[seq]
                keep = np.flatnonzero(known >= 0)
                known = known[keep]
                at = unpack_rising(row["at"])[keep] if has_places else keep
                joined = np.flatnonzero(at[1:] == at[:-1] + 1)
                if not len(joined):
                    continue
                pair, where, n = np.unique(known[joined] * len(ids) + known[joined + 1], return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_pylist(
                    [{"chunk": row["chunk"], "at": pack_rising(at[joined]), "seq": pack(where),
                      "a": pack_rising(ids[pair // len(ids)]), "b": pack(ids[pair % len(ids)]), "n": pack(n), "size": len(pair)}],
                    schema,
                )

    return staged(rows.mapInArrow(run, _PAIRS), f"phrases-{length}", _BATCH)


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, longest: int = MAX_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length, and words by language (lang, n).

    Each frame has lang, phrase, f, the counts of its beginnings of 1, 2, ... words (lefts) and of the rest after them (rights),
    and the numbers by which the next length names it.
    """
    table = occurrences(docs, text, lang)
    totals = staged(table.select(F.explode("total").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n")), "phrases-total")
    answers = _count_words(table, least)
    none = F.array().cast("array<bigint>")
    word = F.col("word").cast("string")
    found = [staged(answers.where("chunk is null").select("id", "lang", word.alias("phrase"), word.alias("last"), "f", none.alias("lefts"), none.alias("rights")), "phrases")]
    for length in range(2, longest + 1):
        longer = _longer(table, answers, length)
        dropped(table)
        dropped(answers)
        table = longer
        answers = _count_pairs(table, least, length)
        head = found[-1].select(F.col("id").alias("a"), "lang", "phrase", "lefts", F.col("f").alias("fa"))
        tail = found[-1].select(F.col("id").alias("b"), "last", "rights", F.col("f").alias("fb"))
        joined = answers.where("chunk is null").select("id", "a", "b", "f").join(head, "a").join(tail, "b")
        found.append(staged(joined.select(
            "id", "a", "b", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
            F.concat("lefts", F.array("fa")).alias("lefts"), F.concat(F.array("fb"), "rights").alias("rights"),
        ), "phrases"))
    dropped(table)
    dropped(answers)
    return found, totals


def _score(f: str, n: str, left: str, right: str) -> str:
    """floor(1000 f n / (l r)) without rounding: 38 digits hold all products."""
    wide = "CAST({} AS DECIMAL(17, 0))".format
    return f"(CAST(1000 AS DECIMAL(4, 0)) * {wide(f)} * {wide(n)}) DIV ({wide(left)} * {wide(right)})"


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, longest: int = MAX_WORDS, top: int | None = TOP
) -> DataFrame:
    """The phrases of two words and more by language: lang, rank, phrase, a, l, r, n, score; the first ``top`` of each, or all.

    A phrase counts with its lowest-scoring cut. It goes if a longer frequent phrase that holds it is as frequent: since counts
    only fall as phrases grow, looking at phrases of one word more is enough.
    """
    found, totals = frequent(docs, text, lang, least, longest)
    kept = []
    for i, phrases in enumerate(found[1:], start=1):
        rows = phrases.select("id", "lang", "phrase", "f", "lefts", "rights")
        if i + 1 < len(found):
            within = found[i + 1].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("longer"))
            within = within.groupBy("id").agg(F.max("longer").alias("longer"))
            rows = rows.join(within, "id", "left").where("longer IS NULL OR longer < f").drop("longer")
        kept.append(rows.drop("id"))
    whole = kept[0]
    for rows in kept[1:]:
        whole = whole.unionByName(rows)
    cut = F.expr(
        "array_min(transform(sequence(1, size(lefts)), k -> named_struct('score', "
        + _score("f", "n", "lefts[k - 1]", "rights[k - 1]") + ", 'k', k, 'l', lefts[k - 1], 'r', rights[k - 1])))"
    )
    scored = whole.join(totals, "lang").withColumn("cut", cut)
    scored = scored.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # The first of each part of a language, then of these: no task sorts all phrases of one.
        part = F.pmod(F.xxhash64("phrase"), F.lit(_PICKERS))
        scored = scored.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("at") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
