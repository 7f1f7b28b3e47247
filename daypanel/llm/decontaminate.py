"""Benchmark decontamination: SimHash of item-sized windows, exact weighted-shingle check.

1. Candidates of documents. Shingles are weighted by their rarity in the whole benchmark. A window that reaches the threshold
   shares at least that part of an item's weight, so it holds one of the item's rarest shingles, those without which the
   rest weighs less. These are the item's postings. One scan of the documents keeps those with a shingle
   that a bitmap of fixed size says may be posted; their shingles are joined with the postings by a shuffle, which gives
   exactly the (document, item) pairs with a posting in common. The benchmark stays a table, whatever its size.
2. Windows. A document is read in windows of as many words as an item has. A window's fingerprint is the
   SimHash of its weighted shingles, found from prefix sums, one subtraction per window and bit. The document's items
   stand in a multi-index: the 64 bits are cut into blocks, and the pigeonhole bound says that a pair within ``RADIUS``
   differs in at most ``RADIUS // BLOCKS`` bits of some block, so looking up every block with that many flips misses none.
3. Pairs within the radius are verified by the weighted Jaccard similarity of their shingle sets.

A window shares with an item no more weight than its shingles known to the benchmark have, so a window
whose known weight is below the threshold times the lightest item of its size is not fingerprinted. That
bound is exact; it keeps the work at the text's size plus its suspicious stretches.

The items of a document are verified in blocks of about ``PART_WORDS`` words, so a document with very many of them
is work for many tasks; every block gets the weights of all shingles involved, so blocks change no similarity.

Defined results: null, empty and blank texts and items match nothing; an item of fewer than five words is
one shingle of all its words and is found where those words stand in a row; repeated rows are judged row by
row; of repeated items each is reported; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from daypanel.llm import arrays as A
from daypanel.llm.staging import staged

SHINGLE = 5
THRESHOLD = 0.8
BITS = 64
#: Bits in which a window and an item may differ, and blocks of the index. A pair at the threshold differs
#: in 10 to 14 bits on average (more for short items), with a deviation of 3 to 4, 21 at most in 1,500; unrelated pairs
#: in 32. The index lets 71 % of unrelated pairs through, the radius 1.6 %.
RADIUS = 23
BLOCKS = 8
#: Words of the items that are verified against a document at a time.
PART_WORDS = 200_000
#: Leading bits of a shingle that the bitmaps tell apart; they take two megabytes each, whatever the benchmark.
_BITMAP = 24
#: Documents that a Python task verifies at once.
_BATCH = 256
#: Windows whose fingerprints are held at a time.
_SLICE = 20_000


@dataclass
class Rarity:
    """Number of items of the whole benchmark, and the sorted shingles that several of them share, with their weights."""

    items: int
    shingles: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, items: int, shingles: np.ndarray, count: np.ndarray) -> Rarity:
        """From sorted shingles and the number of items that hold each."""
        shared = count > 1
        return cls(items, shingles[shared], np.log(1 + items / count[shared]))


class Items:
    """Shingles, weights, fingerprints and the block index of a part of the benchmark."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str], rarity: Rarity | None = None):
        buf, offs = A.utf8(pa.array(texts, pa.string()))
        starts, ends, first = A.words(buf, offs)
        self.ids = np.asarray(ids, dtype=np.int64)
        self.words = np.diff(first)
        self.widths, self.lists = _shingles(A.span_hash(buf, starts, ends), first)
        flat = np.concatenate([np.unique(x) for x in self.lists]) if self.lists else np.zeros(0, np.uint64)
        self.known, count = np.unique(flat, return_counts=True)
        self.rarity = Rarity.of(len(texts), self.known, count) if rarity is None else rarity
        self.unknown = float(np.log(1 + self.rarity.items))
        self.weight = self.weights_of(self.known)
        self.prints = np.array([self.fingerprint(x) for x in self.lists], dtype=np.uint64)
        holder = np.repeat(np.arange(len(self.lists)), [len(np.unique(x)) for x in self.lists])
        order = np.argsort(flat, kind="stable")
        self.holders, self.holders_at = holder[order], np.concatenate([[0], np.cumsum(count)])
        self.mass = np.array([self.weights_of(np.unique(x)).sum() for x in self.lists])
        self.sizes = [_Size(self, w, n) for w, n in sorted(set(zip(self.widths.tolist(), self.words.tolist()))) if n]

    def weights_of(self, shingles: np.ndarray) -> np.ndarray:
        """Rarity in the benchmark; a shingle that it lacks weighs as one that it has once."""
        shared = self.rarity.shingles
        if not len(shared):
            return np.full(len(shingles), self.unknown)
        at = np.minimum(np.searchsorted(shared, shingles), len(shared) - 1)
        return np.where(shared[at] == shingles, self.rarity.weights[at], self.unknown)

    def fingerprint(self, shingles: np.ndarray) -> np.uint64:
        return _pack((_signs(shingles) * self.weights_of(shingles)[:, None]).sum(axis=0)[None])[0]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of two shingle sets."""
        a, b = np.unique(window), np.unique(self.lists[item])
        both, either = np.intersect1d(a, b), np.union1d(a, b)
        return float(self.weights_of(both).sum() / self.weights_of(either).sum()) if len(either) else 0.0


class _Size:
    """The items of one size: their fingerprints, and for each block and value the items near it."""

    def __init__(self, items: Items, width: int, words: int):
        self.width, self.shingles = width, words - width + 1
        self.items = np.flatnonzero((items.widths == width) & (items.words == words))
        self.prints = items.prints[self.items]
        self.lightest = float(items.mass[self.items].min())
        values = np.arange(1 << (BITS // BLOCKS), dtype=np.uint64)
        self.near = []
        for b in range(BLOCKS):
            value, item = np.nonzero(np.bitwise_count(values[:, None] ^ _block(self.prints, b)[None, :]) <= RADIUS // BLOCKS)
            self.near.append((np.searchsorted(value, np.arange(len(values) + 1)), item))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs within the radius, by the multi-index."""
        pairs = []
        for b, (at, item) in enumerate(self.near):
            value = _block(prints, b).astype(np.int64)
            many = at[value + 1] - at[value]
            row = np.repeat(np.arange(len(prints)), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + at[value][row]
            pairs.append(row * len(self.prints) + item[place])
        found = np.unique(np.concatenate(pairs))
        row, item = found // len(self.prints), found % len(self.prints)
        good = np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS
        return row[good], self.items[item[good]]


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words (none for an empty text)."""
    return A.window_hash(hashes, int(width)) + np.uint64(width) if width else np.zeros(0, np.uint64)


def _shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shingle width and shingles of each item; one of fewer words than a shingle is a shingle of its own length."""
    widths = np.minimum(np.diff(first), SHINGLE)
    return widths, [_runs(hashes[a:b], w) for a, b, w in zip(first[:-1], first[1:], widths)]


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle hash."""
    spread = A.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return ((spread[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    width = BITS // BLOCKS
    return (prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)


def matches(items: Items, hashes: np.ndarray, threshold: float) -> dict[int, tuple[float, int]]:
    """Items found in a text, given its word hashes: the best similarity and where its window starts."""
    best: dict[int, tuple[float, int]] = {}
    for width in sorted({s.width for s in items.sizes}):
        runs = _runs(hashes, width)
        known = _member(runs, items.known)
        if not known.any():
            continue
        held = np.concatenate([[0.0], np.cumsum(np.where(known, items.weights_of(runs), 0.0))])
        picked = []
        for size in items.sizes:
            if size.width == width:
                # A text shorter than the item is one window.
                starts = np.arange(max(1, len(runs) - size.shingles + 1))
                ends = np.minimum(starts + size.shingles, len(runs))
                heavy = held[ends] - held[starts] >= threshold * size.lightest - 1e-6
                if heavy.any():
                    picked.append((size, starts[heavy], ends[heavy]))
        if not picked:
            continue
        used = np.zeros(len(runs) + 1, dtype=np.int64)
        for _, starts, ends in picked:
            np.add.at(used, starts, 1)
            np.add.at(used, ends, -1)
        place = np.flatnonzero(np.cumsum(used[:-1]) > 0)
        prints = _Prints(items, runs, place)
        shared = _Shared(items, runs, np.flatnonzero(known))
        for size, starts, ends in picked:
            for low in range(0, len(starts), _SLICE):
                a, b = starts[low : low + _SLICE], ends[low : low + _SLICE]
                row, item = size.candidates(prints(a, b))
                good = shared(item, a[row], b[row]) >= threshold * items.mass[item] - 1e-6
                for i, item in zip(row[good], item[good]):
                    score = items.similarity(runs[a[i] : b[i]], int(item))
                    if score >= threshold - 1e-9 and score > best.get(int(item), (0.0, 0))[0]:
                        best[int(item)] = (score, int(a[i]))
    return best


class _Prints:
    """Fingerprints of windows over the runs at ``place``, from prefix sums of their signed weights."""

    def __init__(self, items: Items, runs: np.ndarray, place: np.ndarray):
        self.place = place
        value = _signs(runs[place]) * items.weights_of(runs[place])[:, None]
        self.sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(value, axis=0)])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.place, starts), np.searchsorted(self.place, ends)
        # Rounding keeps equal windows at equal prints wherever they stand.
        return _pack(np.round(self.sums[b] - self.sums[a], 6))


class _Shared:
    """Upper bound of the weight that a window shares with an item: its runs that the item has, repeats included."""

    def __init__(self, items: Items, runs: np.ndarray, at: np.ndarray):
        k = np.searchsorted(items.known, runs[at])
        many = items.holders_at[k + 1] - items.holders_at[k]
        row = np.repeat(np.arange(len(at)), many)
        item = items.holders[items.holders_at[k][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
        self.length = len(runs) + 1
        key = item * self.length + at[row]
        order = np.argsort(key)
        self.key = key[order]
        self.sums = np.concatenate([[0.0], np.cumsum(items.weight[k][row][order])])

    def __call__(self, item: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = (np.searchsorted(self.key, item * self.length + x) for x in (starts, ends))
        return self.sums[b] - self.sums[a]


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted known ones; a bitmap spares most of the searches."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    shift = np.uint64(64 - 20)
    marked = np.zeros(1 << 20, dtype=bool)
    marked[known >> shift] = True
    out = np.zeros(len(values), dtype=bool)
    maybe = np.flatnonzero(marked[values >> shift])
    at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
    out[maybe[known[at] == values[maybe]]] = True
    return out


@dataclass
class Benchmark:
    """The benchmark as tables: items (item, item_id, text, words, shared), postings (shingle, item), shared shingles (shingle, n)."""

    items: DataFrame
    postings: DataFrame
    shared: DataFrame
    size: int
    widths: list[int]

    @classmethod
    def of(cls, benchmark: DataFrame, item_id: str, text: str, threshold: float) -> Benchmark:
        rows = benchmark.select(F.coalesce(F.col(item_id).cast("long"), F.lit(-1).cast("long")).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        # The number of an item is written with it, so that it stays the same wherever it is read.
        rows = staged(rows.withColumn("item", F.monotonically_increasing_id()), "benchmark")
        size = rows.count()
        found = staged(A.map_texts(rows.select("item", "text"), "text", _item_shingles, "item long, width int, words int, shingle long"), "item-shingles")
        counts = staged(found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle-counts")
        weight = F.log(1 + F.lit(float(size)) / F.col("n"))
        weighed = found.join(counts, "shingle").withColumn("w", weight)
        by_item = Window.partitionBy("item")
        before = F.coalesce(F.sum("w").over(by_item.orderBy(F.desc("w"), "shingle").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        mass = F.sum("w").over(by_item)
        # Without the shingles up to this one, the item could still reach the threshold.
        needed = weighed.withColumns({"before": before, "mass": mass}).where(F.col("mass") - F.col("before") >= threshold * F.col("mass") - 1e-6)
        own = weighed.groupBy("item").agg(F.first("words").alias("words"), F.collect_list(F.when(F.col("n") > 1, F.struct("shingle", "n"))).alias("shared"))
        return cls(
            staged(rows.join(own, "item"), "items"), staged(needed.select("shingle", "item"), "postings"), counts.where("n > 1"), size,
            sorted(r.width for r in found.select("width").distinct().collect()),
        )


def _item_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The different shingles of each item."""
    buf, offs = A.utf8(batch.column(1))
    starts, ends, first = A.words(buf, offs)
    widths, lists = _shingles(A.span_hash(buf, starts, ends), first)
    lists = [np.unique(x) for x in lists]
    row = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
    flat = np.concatenate([np.zeros(0, np.uint64), *lists])
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row)), pa.array(widths[row].astype(np.int32)), pa.array(np.diff(first)[row].astype(np.int32)), pa.array(flat.view(np.int64))],
        names=["item", "width", "words", "shingle"],
    )


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """Which leading bits occur, of a size that does not depend on the benchmark."""
    lead = F.shiftrightunsigned("shingle", 64 - _BITMAP)
    words = shingles.groupBy(F.shiftright(lead, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), lead.bitwiseAND(63).cast("int"))).alias("bits"))
    out = np.zeros(1 << (_BITMAP - 6), dtype=np.uint64)
    found = words.toArrow()
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _marked(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    lead = values >> np.uint64(64 - _BITMAP)
    return (bitmap[lead >> np.uint64(6)] >> (lead & np.uint64(63)) & np.uint64(1)).astype(bool)


def _suspects(rows: DataFrame, bench: Benchmark) -> DataFrame:
    """(row, doc_id, text, hits, maybe) from (doc_id, text): rows that may hold a posting, and which; shingles that several items may share."""
    context = rows.sparkSession.sparkContext
    posted, shared = context.broadcast(_bitmap(bench.postings)), context.broadcast(_bitmap(bench.shared))
    widths = bench.widths

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = A.utf8(batch.column(1))
        starts, ends, first = A.words(buf, offs)
        hashes = A.span_hash(buf, starts, ends)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
        lists: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for width in widths:
            runs = _runs(hashes, width)
            inside = owner[: len(runs)] == owner[width - 1 :]
            for found, bitmap in zip(lists, (posted.value, shared.value)):
                at = np.flatnonzero(_marked(runs, bitmap) & inside)
                found.append((owner[at], runs[at]))
        columns, keep = [], None
        for found in lists:
            at = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in found]])
            values = np.concatenate([np.zeros(0, np.uint64), *[x for _, x in found]])
            order = np.lexsort((values, at))
            at, values = at[order], values[order]
            new = np.append(True, (at[1:] != at[:-1]) | (values[1:] != values[:-1]))[: len(at)]
            at, values = at[new], values[new]
            ends_at = np.searchsorted(at, np.arange(batch.num_rows + 1))
            columns.append(pa.ListArray.from_arrays(pa.array(ends_at.astype(np.int32)), pa.array(values.view(np.int64))))
            keep = np.flatnonzero(np.diff(ends_at)) if keep is None else keep
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["doc_id", "text", "hits", "maybe"]).take(pa.array(keep))

    schema = StructType([*rows.schema.fields, StructField("hits", ArrayType(LongType())), StructField("maybe", ArrayType(LongType()))])
    return staged(A.map_texts(rows, "text", run, schema).withColumn("row", F.monotonically_increasing_id()), "suspects")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, similarity, word): each item found in a row of ``docs``, and the word where its best window starts.

    Rows without a match do not appear. Items with a null id are reported with id -1.
    """
    names = ["doc_id", "item_id", "similarity", "word"]
    schema = StructType(
        [StructField("doc_id", docs.schema[doc_id].dataType), StructField("item_id", LongType()),
         StructField("similarity", DoubleType()), StructField("word", LongType())]
    )
    bench = Benchmark.of(benchmark, item_id, item_text, threshold)
    suspects = _suspects(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), bench)
    pairs = suspects.select("row", F.explode("hits").alias("shingle")).join(bench.postings, "shingle").select("row", "item").distinct()
    pairs = staged(pairs.join(bench.items.select("item", "words"), "item"), "pairs")
    parts = pairs.groupBy("row").agg(F.ceil(F.sum("words") / PART_WORDS).cast("int").alias("parts"))
    blocks = pairs.drop("words").join(parts, "row").withColumn("part", F.pmod(F.xxhash64("item"), "parts")).join(bench.items, "item")
    blocks = blocks.groupBy("row", "part").agg(F.collect_list(F.struct("item_id", "text", "shared")).alias("items"))
    # Weights of the shingles that several items share, as far as the document has them; the items bring those of their own.
    maybe = suspects.join(parts, "row", "left_semi").select("row", F.explode("maybe").alias("shingle"))
    known = maybe.join(bench.shared, "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "n")).alias("known"))
    work = suspects.select("row", "doc_id", "text").join(blocks, "row").join(known, "row", "left").select("doc_id", "text", "items", "known")
    size = bench.size

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.select(["text", "items", "known"]).to_pylist():
                counts = {x["shingle"]: x["n"] for one in [row["known"] or [], *[i["shared"] or [] for i in row["items"]]] for x in one}
                shingles = np.array(sorted(counts, key=lambda x: x % (1 << 64)), dtype=np.int64)
                rarity = Rarity.of(size, shingles.view(np.uint64), np.array([counts[x] for x in shingles.tolist()], dtype=np.int64))
                items = Items([i["item_id"] for i in row["items"]], [i["text"] for i in row["items"]], rarity)
                buf, offs = A.utf8(pa.array([row["text"]], pa.string()))
                starts, ends, _ = A.words(buf, offs)
                out.append([(int(items.ids[i]), s, at) for i, (s, at) in sorted(matches(items, A.span_hash(buf, starts, ends), threshold).items())])
            row_of = np.repeat(np.arange(len(out)), [len(x) for x in out])
            flat = [x for one in out for x in one]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row_of)), *[pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))]], names=names
            )

    return staged(work.mapInArrow(run, schema), "contaminated", _BATCH)


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, their columns unchanged. Null ids are rows like any other.

    Whether a row goes depends on its text alone, so rows go by the digests of the texts in which items were found.
    """
    names = docs.columns
    own = [f"d{i}" for i in range(len(names))]
    plain = docs.toDF(*own)
    digest = F.unhex(F.sha2(F.coalesce(F.col(own[names.index(text)]), F.lit("")), 256))
    keyed = plain.select(digest.alias("key"), F.col(own[names.index(text)]).alias("body"))
    bad = contaminated(keyed, benchmark, "key", "body").select(F.col("doc_id").alias("key")).distinct()
    return plain.withColumn("key", digest).join(staged(bad, "contaminated-texts"), "key", "left_anti").select(*own).toDF(*names)
