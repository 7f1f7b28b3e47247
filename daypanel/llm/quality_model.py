"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: hashed words with their share of the document, and a few dense statistics
of its structure and size. Labels, language, source and id are never inputs. The score is

    sigmoid(w0 + w.x + 1/2 * sum_f [(V_f.x)^2 - (V_f^2).(x^2)]),

all pairwise interactions of rank ``FACTORS``, in time linear in the features by the sum-of-squares
identity. The model is fitted on a sample of labelled rows of at most ``TRAIN_ROWS`` (by hash of the id, so
the sample is the same on every run), by mini-batch gradient steps with per-weight step sizes. The features
of the sample are made in tasks; the driver sees only them. Scoring is a map over all rows.

Held-out rows are those whose crc32 of the id, as text, is a multiple of ``FOLDS``; they are never learnt
from.

Defined results: a null or empty text has no words and is scored from its statistics; a null id is held
out; repeated rows get equal scores; several labels of one id are several examples, a null label none;
without examples of both labels every score is the share of label 1 (or 0.5); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from daypanel.llm import arrays as A
from daypanel.llm.quality_rules import Texts

BUCKETS = 1 << 14
FACTORS = 6
#: Bound of the labelled rows that are fitted on.
TRAIN_ROWS = 8_000
FOLDS = 5
THRESHOLD = 0.3
#: Passes over the sample, more if they would be fewer gradient steps than ``MIN_STEPS``.
EPOCHS = 8
MIN_STEPS = 1500
BATCH = 64
STEP = 0.08
DECAY = 1e-5

STATISTICS = (
    "log_words", "log_chars", "word_length", "symbols", "bars", "capitals", "shouting", "digits", "line_length",
    "repeated_lines", "repeated_words", "stutter", "sentence_ends", "distinct_words",
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, buckets, values, first): dense rows, and the sparse words of each text.

    A word's value is its count over the root of the sum of squared counts, so a text's words have length one.
    """
    t = Texts(column)
    n = len(t.offs) - 1
    words = np.maximum(1, t.n_words)
    chars = np.maximum(1, t.word_chars)
    count = lambda chars: A.per_text(np.isin(t.buf, np.frombuffer(chars, np.uint8)), t.offs)
    hashes, first = t._hashes, t._words[2]
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    key, many = np.unique((hashes % np.uint64(BUCKETS)) | owner << np.uint64(32), return_counts=True)
    bucket, row = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(row, np.arange(n + 1))
    root = np.sqrt(np.maximum(1e-9, np.bincount(row, weights=many.astype(float) ** 2, minlength=n)))
    dense = np.stack(
        [
            np.log1p(t.n_words) / 8,
            np.log1p(t.word_chars) / 10,
            chars / words / 20,
            np.minimum(3, t.n_symbols / words),
            np.minimum(2, count(b"|") / words),
            t.upper_share,
            t.shouted_words / words,
            count(b"0123456789") / chars,
            np.log1p(words / np.maximum(1, t.n_lines)) / 8,
            t.n_dup_lines / np.maximum(1, t.n_lines),
            t.n_repeat_words / words,
            t.stuttered_words / words,
            count(b".!?") / words,
            np.diff(at) / words,
        ],
        axis=1,
    )
    return dense, bucket, many / root[row], at


@dataclass
class Machine:
    """Bias, weights and factors; the first features are the statistics, then the buckets."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def parts(self, dense, bucket, value, at):
        """Score before the sigmoid, and the factor sums that its gradient needs."""
        d = dense.shape[1]
        row = np.repeat(np.arange(len(dense)), np.diff(at))
        v = self.factors[d + bucket]
        linear = self.bias + dense @ self.weights[:d] + _sum(self.weights[d + bucket] * value, row, len(dense))
        sums = dense @ self.factors[:d] + _sum(v * value[:, None], row, len(dense))
        squares = dense**2 @ self.factors[:d] ** 2 + _sum((v * value[:, None]) ** 2, row, len(dense))
        return linear + 0.5 * (sums**2 - squares).sum(axis=1), sums, row

    def score(self, dense, bucket, value, at) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(dense, bucket, value, at)[0], -30, 30)))


def _sum(x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of consecutive rows of ``x`` by ``row``."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    at = np.searchsorted(row, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def fit(dense, bucket, value, at, label, seed: int = 3) -> Machine:
    """Logistic loss by mini-batches with adaptive steps."""
    rng = np.random.default_rng(seed)
    n, d = dense.shape
    share = float(label.mean()) if n else 0.5
    size = d + BUCKETS
    if n == 0 or share in (0.0, 1.0):
        return Machine(float(np.log((share + 1e-3) / (1 - share + 1e-3))) if n else 0.0, np.zeros(size), np.zeros((size, FACTORS)))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // n))):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            pick = order[low : low + BATCH]
            many = at[pick + 1] - at[pick]
            cut = np.concatenate([[0], np.cumsum(many)])
            place = np.arange(cut[-1]) + np.repeat(at[pick] - cut[:-1], many)
            x, b, v = dense[pick], bucket[place], value[place]
            z, sums, row = m.parts(x, b, v, cut)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) / len(pick)
            seen_b += g.sum() ** 2
            m.bias -= STEP * g.sum() / np.sqrt(seen_b)
            used, back = np.unique(b, return_inverse=True)
            gv = g[row] * v
            grad_w = np.concatenate([x.T @ g, np.bincount(back, weights=gv, minlength=len(used))])
            grad_v = np.zeros((len(grad_w), FACTORS))
            ids = np.concatenate([np.arange(d), d + used])
            grad_v[:d] = x.T @ (g[:, None] * sums) - (x**2).T @ g[:, None] * m.factors[:d]
            for f in range(FACTORS):
                grad_v[d:, f] = np.bincount(back, weights=gv * sums[row, f], minlength=len(used))
            grad_v[d:] -= np.bincount(back, weights=gv * v, minlength=len(used))[:, None] * m.factors[d + used]
            grad_w += DECAY * m.weights[ids]
            grad_v += DECAY * m.factors[ids]
            seen_w[ids] += grad_w**2
            seen_v[ids] += grad_v**2
            m.weights[ids] -= STEP * grad_w / np.sqrt(seen_w[ids])
            m.factors[ids] -= STEP * grad_v / np.sqrt(seen_v[ids])
    return m


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Machine:
    """Fit on at most ``TRAIN_ROWS`` labelled rows outside the held-out fold, chosen by hash of the id."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    known = known.orderBy(F.xxhash64("id", F.lit(17)), "id", "y").limit(TRAIN_ROWS)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")

    def run(batch):
        dense, bucket, value, at = features(batch.column(1))
        dense = dense.astype("<f8")
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([x.tobytes() for x in dense], pa.binary()),
             A.ragged(bucket.astype("<i4"), at), A.ragged(value.astype("<f4"), at)],
            names=["id", "y", "dense", "bucket", "value"],
        )

    made = A.map_texts(rows.select("id", "text", "y"), "text", run, "id long, y int, dense binary, bucket binary, value binary")
    got = sorted(made.collect(), key=lambda r: (r.id, r.y, bytes(r.dense), bytes(r.bucket)))
    counts = [len(r.bucket) // 4 for r in got]
    join = lambda field, kind: np.frombuffer(b"".join(bytes(r[field]) for r in got), kind)
    return fit(
        join("dense", "<f8").reshape(len(got), len(STATISTICS)),
        join("bucket", "<i4").astype(np.int64), join("value", "<f4").astype(float),
        np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.array([r.y for r in got], dtype=float),
    )


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    machine = train(docs, labels, doc_id, text)
    schema = StructType(
        [StructField("doc_id", docs.schema[doc_id].dataType), StructField("held_out", BooleanType()),
         StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    )

    def run(batch):
        s = machine.score(*features(batch.column(2)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names
        )

    own = F.col(f"`{doc_id}`")
    return A.map_texts(docs.select(own.alias("doc_id"), held_out(own).alias("held_out"), F.col(text).alias("text")), "text", run, schema)
