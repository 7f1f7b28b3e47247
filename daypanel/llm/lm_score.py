"""Language-model scoring by cross-entropy difference.

Two bigram models are matched: one vocabulary, one smoothing, one order. The target model counts the
documents whose label marks them as good; the background model counts all documents. A document's score is
the mean over its tokens of background loss less target loss, in nats: high where the target model predicts
the text better than the background does.

The vocabulary is every word of the corpus, each for itself, and no table of the models is gathered whole:

1. The texts are cut into chunks, one row each: word numbers in order, and the words by hash. A chunk counts
   its words, how often each is followed by another, and its pairs, in good texts and in all.
2. Each chunk sends every count once, with its key, to the bucket of the key. There counts are summed, and
   the sums go back to the chunks in the order in which they were sent. A word that makes up most of the corpus is one entry a
   chunk. Buckets grow in number with the tokens, empty ones send nothing: what moves is at most the tokens.
3. Each chunk scores its texts with the sums of its own keys.

With ``leave_out`` each text is also scored by models that have not seen it: its own counts are taken off first. Such a
good text does not score high for being among the good ones, and a text that occurs twice is told from one that occurs once.

With ``classes`` the vocabulary is folded to ``2 * classes`` symbols first: the most frequent words each for itself,
every other word in one of ``classes`` classes by hash.

Smoothing is interpolation with the word's own frequency, which is interpolated with the uniform
distribution. The background counts are scaled to the size of the target's, so the smoothing weighs the same in both.

Defined results: a null, empty or blank text has no tokens, zero losses and score zero; repeated rows are
scored row by row, and counted as often as they stand; documents with a null id are never targets; without
a target document both models are the background, and all scores are zero; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from daypanel.llm import arrays as A
from daypanel.llm.collocations import pack, unpack
from daypanel.llm.staging import dropped, staged

#: Bytes of a chunk of texts; no text is cut.
CHUNK = 8 << 20
#: Tokens for each bucket of counts, and buckets at least.
BUCKET = 500_000
LEAST = 64
#: Chunks that a Python task takes at once.
_BATCH = 4
#: Weight of the pair estimate grows with the count of the first word: c / (c + PRIOR).
PRIOR = 20.0
UNIFORM = 0.01


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = A.utf8(column)
    starts, ends, first = A.words(buf, offs)
    return A.span_hash(buf, starts, ends), first


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word, by its hash, occurs; every task sums its own words first."""

    def run(batch):
        words, n = np.unique(_tokens(batch.column(0))[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    made = A.map_texts(docs.select(F.col(text).alias("text")), "text", run, "word long, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> np.ndarray:
    """Hashes of the most frequent words of (word, n), sorted; ties go to the lower hash."""
    top = counts.orderBy(F.desc("n"), "word").limit(most)
    return np.sort(np.array([r.word for r in top.collect()], dtype=np.int64).view(np.uint64))


def _places(words: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted list, counted from 1; 0 for a word that it lacks."""
    if not len(listed):
        return np.zeros(len(words), dtype=np.int64)
    at = np.minimum(np.searchsorted(listed, words), len(listed) - 1)
    return np.where(listed[at] == words, at + 1, 0)


def folded(words: np.ndarray, frequent: np.ndarray, classes: int) -> np.ndarray:
    """Each word as the hash of its symbol: 1 .. classes for frequent ones, the classes after that by hash."""
    place = _places(words, frequent)
    rare = classes + 1 + (A.mix(words) % np.uint64(classes)).astype(np.int64)
    return A.mix(np.where(place > 0, place, rare).astype(np.uint64))


def _own(share: np.ndarray, size: int) -> np.ndarray:
    """Probability of a word by itself, from its share of the tokens."""
    return (1 - UNIFORM) * share + UNIFORM / size


def log_probabilities(counts: np.ndarray, total: float) -> np.ndarray:
    """Smoothed log-probabilities from a square table of all pair counts, scaled to ``total`` tokens: the definition of a model."""
    size = len(counts)
    have = counts.sum()
    scaled = counts * (total / have) if have else counts
    # Symbols are 1 .. size - 1; nothing predicts the start.
    one = _own(scaled.sum(axis=0) / total if have else np.append(0, np.full(size - 1, 1 / (size - 1))), size - 1)
    after = scaled.sum(axis=1)
    return np.log((scaled + PRIOR * one[None, :]) / (after + PRIOR)[:, None]).astype(np.float32)


@dataclass
class Corpus:
    """Numbers of the whole corpus: tokens and texts with a token, in good texts and in all, and different words."""

    tokens: tuple[int, int]
    texts: tuple[int, int]
    words: int


def chunks(rows: DataFrame, frequent: np.ndarray | None = None, classes: int | None = None) -> DataFrame:
    """One row per chunk of the rows (doc_id, text, good): ids, tokens and goodness of its texts, word numbers in order, word hashes."""
    kind = rows.schema["doc_id"].dataType
    schema = StructType(
        [StructField("chunk", LongType()), StructField("ids", ArrayType(kind))]
        + [StructField(c, BinaryType()) for c in ("n", "good", "seq", "words")]
        + [StructField(c, LongType()) for c in ("good_tokens", "tokens", "good_texts", "texts")]
    )

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in A.pieces(batch, "text", CHUNK):
                words, first = _tokens(piece.column(1))
                if classes is not None:
                    words = folded(words, frequent, classes)
                found, seq = np.unique(words, return_inverse=True)
                n, good = np.diff(first), piece.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = piece.column(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     *[pa.array([x], pa.binary()) for x in (pack(n), pack(good), pack(seq), found.tobytes())],
                     *[pa.array([int(x)]) for x in ((n * good).sum(), n.sum(), ((n > 0) * good).sum(), (n > 0).sum())]],
                    names=schema.names,
                )
                chunk += 1

    return staged(rows.select("doc_id", "text", "good").mapInArrow(run, schema), "lm-chunks")


#: Kinds of keys, in their last two bits.
_WORD, _FOLLOWED, _PAIR = 1, 2, 3
_MARKS = np.random.default_rng(9).integers(0, 1 << 63, 4, dtype=np.uint64)


@dataclass
class Chunk:
    """The tokens of a chunk and the keys of its counts: word and followed word of each word, then the pairs."""

    n: np.ndarray
    good: np.ndarray
    seq: np.ndarray
    #: Pair of each token, and its first word (the number after the last word at the start of a text).
    pair: np.ndarray
    before: np.ndarray
    followed: np.ndarray
    n_words: int
    keys: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        n, good, seq = unpack(row["n"]), unpack(row["good"]) > 0, unpack(row["seq"])
        words = np.frombuffer(row["words"], dtype=np.uint64)
        first = np.concatenate([[0], np.cumsum(n)])
        opens = first[:-1][n > 0]
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[opens] = len(words)
        followed = np.ones(len(seq), dtype=bool)
        followed[first[1:][n > 0] - 1] = False
        codes, pair = np.unique(before * len(words) + seq, return_inverse=True) if len(seq) else (seq, seq)
        left = np.append(words, _MARKS[0])[codes // max(1, len(words))]
        right = words[codes % max(1, len(words))]
        kinds = ((_WORD, words), (_FOLLOWED, words), (_PAIR, A.mix(left ^ _MARKS[_PAIR]) + right))
        keys = np.concatenate([A.mix(x ^ _MARKS[k]) & ~np.uint64(3) | np.uint64(k) for k, x in kinds])
        return cls(n, good, seq, pair, before, followed, len(words), keys, np.argsort(keys, kind="stable"))

    def counts(self, weight: np.ndarray | None) -> np.ndarray:
        """Counts by key, over all tokens or weighted."""
        on = self.followed if weight is None else self.followed * weight
        return np.concatenate([
            np.bincount(self.seq, weights=weight, minlength=self.n_words), np.bincount(self.seq, weights=on, minlength=self.n_words),
            np.bincount(self.pair, weights=weight, minlength=len(self.keys) - 2 * self.n_words),
        ]).astype(np.int64)


def _slices(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Each bucket with its keys; keys ascend, so those of a bucket lie together."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_ENTRIES = "bucket int, chunk long, keys binary, good binary, every binary"
_SUMS = "chunk long, bucket int, good binary, every binary, words long"


def entries(table: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, keys, good, every): each key of a chunk once, with its counts, packed by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("good", pa.binary()), ("every", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk.of(row)
                keys = c.keys[c.order]
                good, every = c.counts(np.repeat(c.good, c.n).astype(np.float64))[c.order], c.counts(None)[c.order]
                yield pa.RecordBatch.from_pylist(
                    [{"bucket": b, "chunk": row["chunk"], "keys": pack(np.diff(keys[at], prepend=np.uint64(0))), "good": pack(good[at]), "every": pack(every[at])}
                     for b, at in _slices(keys, buckets)],
                    schema,
                )

    return table.select("chunk", "n", "good", "seq", "words").mapInArrow(run, _ENTRIES)


def _sum(rows: pa.Table) -> pa.Table:
    """Sums of a bucket, for each chunk in the order in which it sent its keys; in a row of their own, the different words."""
    keys = [np.cumsum(unpack(x).view(np.uint64), dtype=np.uint64) for x in rows["keys"].to_pylist()]
    sizes = [len(k) for k in keys]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = {"chunk": rows["chunk"].to_pylist() + [None], "bucket": rows["bucket"].to_pylist() + [None],
           "words": [None] * len(sizes) + [int((found & np.uint64(3) == _WORD).sum())]}
    for name in ("good", "every"):
        sums = np.zeros(len(found), dtype=np.int64)
        np.add.at(sums, at, np.concatenate([unpack(x) for x in rows[name].to_pylist()]))
        out[name] = [pack(x) for x in np.split(sums[at], np.cumsum(sizes)[:-1])] + [None]
    return pa.table([pa.array(out["chunk"], pa.int64()), pa.array(out["bucket"], pa.int32()), pa.array(out["good"], pa.binary()),
                     pa.array(out["every"], pa.binary()), pa.array(out["words"], pa.int64())], names=["chunk", "bucket", "good", "every", "words"])


def _losses(c: Chunk, sums: tuple[np.ndarray, np.ndarray], corpus: Corpus, leave_out: bool) -> Iterator[np.ndarray]:
    """Losses of each text under the target and the background model."""
    text = np.repeat(np.arange(len(c.n)), c.n)
    first = np.concatenate([[0], np.cumsum(c.n)])
    w, starts = c.n_words, c.before == c.n_words
    own = [np.zeros(len(text), dtype=np.int64)] * 3
    if leave_out and len(text):
        # What each text itself adds to the counts of its tokens.
        _, at, many = np.unique(text * w + c.seq, return_inverse=True, return_counts=True)
        _, pair, pairs = np.unique(text * (len(c.keys) - 2 * w + 1) + c.pair, return_inverse=True, return_counts=True)
        on = np.bincount(at, weights=c.followed, minlength=len(many)).astype(np.int64)
        after = np.ones(len(text), dtype=np.int64)
        after[~starts] = on[at[np.flatnonzero(~starts) - 1]]
        own = [many[at], after, pairs[pair]]
    alike = not corpus.tokens[0]
    seen = np.where(c.good, c.n, 0) if leave_out and not alike else np.where(alike & leave_out, c.n, 0)
    target = np.maximum(1, corpus.tokens[int(alike)] - seen).astype(np.float64)
    for i in (0, 1):
        model = 1 if alike else i
        off = c.good if model == 0 else np.ones(len(c.n), dtype=bool)
        have = np.maximum(1, corpus.tokens[model] - np.where(off & leave_out, c.n, 0))
        scale = (target / have)[text]
        less = off[text]
        count = [sums[model][:w][c.seq], np.where(starts, corpus.texts[model], sums[model][w : 2 * w][np.minimum(c.before, max(0, w - 1))]), sums[model][2 * w :][c.pair]]
        word, after, pair = (x - less * y for x, y in zip(count, own))
        loss = np.log(after * scale + PRIOR) - np.log(pair * scale + PRIOR * _own(word * scale / target[text], max(1, corpus.words)))
        total = np.concatenate([[0.0], np.cumsum(loss)])
        yield total[first[1:]] - total[first[:-1]]


def scores(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", classes: int | None = None, leave_out: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score): mean losses a token and their difference.

    With ``leave_out`` also left_out_target_loss, left_out_background_loss and left_out_score, by the counts of all other rows.
    """
    good = labels.where(F.col(label) == 1).select(F.col(doc_id).alias("id")).where("id IS NOT NULL").distinct().withColumn("good", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Labels may be as many as documents: they are merged by a shuffle at every size, never broadcast.
    rows = rows.join(good.hint("merge"), F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    frequent = None if classes is None else frequent_words(word_counts(docs.select(F.col(text).alias("text"))), classes)
    table = chunks(rows, frequent, classes)
    totals = table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("good_tokens", "tokens", "good_texts", "texts")]).first()
    buckets = max(LEAST, math.ceil(totals[1] / BUCKET))
    sums = staged(entries(table, buckets).groupBy("bucket").applyInArrow(_sum, _SUMS), "lm-sums", _BATCH)
    words = sums.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] if classes is None else 2 * classes
    corpus = Corpus((totals[0], totals[1]), (totals[2], totals[3]), words)
    told = sums.where("chunk IS NOT NULL").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "good", "every"))).alias("told"))
    # A chunk without a token has sent nothing.
    both = table.select("chunk", "ids", "n", "good", "seq", "words").join(told, "chunk", "left")
    kinds = ["", "left_out_"] if leave_out else [""]
    schema = StructType(
        [StructField("doc_id", docs.schema[doc_id].dataType), StructField("n_tokens", LongType())]
        + [StructField(f"{kind}{c}", DoubleType()) for kind in kinds for c in ("target", "background")]
    )

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            for i, row in enumerate(batch.select([c for c in batch.schema.names if c != "ids"]).to_pylist()):
                c = Chunk.of(row)
                found = []
                for name in ("good", "every"):
                    sums = np.zeros(len(c.keys), dtype=np.int64)
                    if row["told"]:
                        sums[c.order] = np.concatenate([unpack(x[name]) for x in row["told"]])
                    found.append(sums)
                made = [x for kind in kinds for x in _losses(c, tuple(found), corpus, kind != "")]
                yield pa.RecordBatch.from_arrays([ids[i].values, pa.array(c.n), *[pa.array(x) for x in made]], names=schema.names)

    out = staged(both.mapInArrow(run, schema), "lm-scores", _BATCH)
    for used in (table, sums):
        dropped(used)
    mean = lambda x: F.round(x / F.greatest("n_tokens", F.lit(1)), 9)
    losses = [
        mean(x).alias(f"{kind}{name}") for kind in kinds for t, b in [(F.col(f"{kind}target"), F.col(f"{kind}background"))]
        for x, name in ((t, "target_loss"), (b, "background_loss"), (b - t, "score"))
    ]
    return out.select("doc_id", "n_tokens", *losses)
