"""Near-duplicate join: MinHash bands find partners, full n-gram sets verify them.

1. Every text gives its set of word n-grams (hashes of five words), the MinHash of each band, and a
   128-bit key of the set. Texts with equal sets are folded: only the sets travel on.
2. The bands are shuffled. The lowest set of a band bucket is the bucket's leader, so a pair of sets that
   share a bucket share a leader, and a bucket of any size costs one row per member.
3. Each member is compared with its leader once: what it lacks and what it has more. These differences are
   short for near copies, and the n-gram sets of two members of one leader follow from them exactly.
4. The members of a leader are compared in blocks of bounded size; a hot group is spread over many tasks.
   A block emits per set the number of linked rows and one link that keeps it connected, never all pairs.
   A pair with several common leaders is counted at the lowest.
5. Classes are the connected components of those links.

Bands and rows per band follow from the target recall at the threshold (``choose_bands``).

Defined results: a null, empty or blank text has no n-grams, forms a class of its own and has no links; a
text of one to four words is one n-gram; repeated rows, repeated ids and null ids are rows like any other
(two rows with equal sets are linked); ``class_id`` is the lowest id of the class, null if all are null;
columns other than id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from daypanel.llm import arrays as A
from daypanel.llm.components import components
from daypanel.llm.staging import staged

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Sets of one leader that are compared with each other in one task, and columns of a product at a time.
BLOCK = 768
_COLUMNS = 2048

_SEEDS = np.random.default_rng(61).integers(0, 1 << 63, (2, 512), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NO_ID = -(1 << 63)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 512) -> tuple[int, int]:
    """(bands, rows): the most selective split whose recall at the threshold reaches the target with at most 16 bands.

    Bands are what is shuffled, so their number is bounded first; more rows per band mean fewer false partners.
    """
    best = None
    for rows in range(1, 17):
        p = threshold**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        if bands * rows <= most and (best is None or bands <= 16):
            best = (bands, rows)
    return best


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text and the first of each text."""
    buf, offs = A.utf8(column)
    starts, ends, first = A.words(buf, offs)
    grams, at = A.shingles(A.span_hash(buf, starts, ends), first, n)
    return A.distinct_per_text(grams, at)


def _keys(grams: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128-bit key of each set, None for an empty one."""
    ends = at[1:]
    out = np.zeros((len(ends), 2), dtype=np.uint64)
    for i in range(2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(A.mix(grams ^ _SEEDS[i, 0]), dtype=np.uint64)])
        out[:, i] = sums[ends] - sums[at[:-1]]
    raw = out.byteswap().tobytes()
    return [raw[16 * i : 16 * i + 16] if ends[i] > at[i] else None for i in range(len(ends))]


def _bands(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each non-empty set, in the order of the texts."""
    full = np.flatnonzero(at[1:] > at[:-1])
    out = np.zeros((len(full), bands), dtype=np.uint64)
    if len(full):
        for i in range(bands * rows):
            low = np.minimum.reduceat((grams * _SEEDS[0, i % 512]) ^ _SEEDS[1, i % 512], at[full])
            low = A.mix(low + np.uint64(i))
            out[:, i // rows] = A.mix(out[:, i // rows] ^ low)
    return out


def _text_key(text: str) -> Column:
    """128-bit digest of a text: with the id it names a row, whatever ids repeat or lack."""
    return F.unhex(F.md5(F.col(text)))


def signatures(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tk, node, bands): a digest of each text, the key of its n-gram set and its band hashes."""
    schema = StructType(
        [StructField("doc_id", docs.schema[doc_id].dataType), StructField("tk", BinaryType()), StructField("node", BinaryType()),
         StructField("bands", ArrayType(LongType()))]
    )

    def run(batch):
        grams, at = _sets(batch.column(2), n)
        keys = _keys(grams, at)
        found = _bands(grams, at, bands, rows)
        empty = np.array([k is None for k in keys], dtype=bool)
        ends = np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.binary()), lists], names=schema.names)

    return A.map_texts(docs.select(F.col(doc_id).alias("doc_id"), _text_key(text).alias("tk"), F.col(text).alias("text")), "text", run, schema)


def _grams_of(rows: DataFrame, n: int) -> DataFrame:
    """(node, grams) from (node, text), for the rows whose text gives the key they are asked for."""

    def run(batch):
        grams, at = _sets(batch.column(1), n)
        keys = _keys(grams, at)
        good = [i for i, (k, want) in enumerate(zip(keys, batch.column(0).to_pylist())) if k == want]
        raw = [np.sort(grams[at[i] : at[i + 1]]).tobytes() for i in good]
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in good], pa.binary()), pa.array(raw, pa.binary())], names=["node", "grams"])

    return A.map_texts(rows, "text", run, "node binary, grams binary").dropDuplicates(["node"])


def _difference(own: bytes, leader: bytes) -> tuple[bytes, bytes]:
    """Positions in the leader's set that are missing, and n-grams that the leader lacks."""
    a, b = np.frombuffer(own, np.uint64), np.frombuffer(leader, np.uint64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = b[at] == a
    missing = np.ones(len(b), dtype=bool)
    missing[at[shared]] = False
    return np.flatnonzero(missing).astype(np.int32).tobytes(), a[~shared].tobytes()


def _differences(rows: DataFrame) -> DataFrame:
    """(leader, node, n_leader, missing, extra) from (leader, node, own, theirs)."""

    def run(batches):
        for batch in batches:
            leader, node, own, theirs = (c.to_pylist() for c in batch.columns)
            found = [_difference(a, b) for a, b in zip(own, theirs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(b) // 8 for b in theirs], pa.int64()),
                 pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())],
                names=["leader", "node", "n_leader", "missing", "extra"],
            )

    return rows.mapInArrow(run, "leader binary, node binary, n_leader long, missing binary, extra binary")


def _product(features: list[np.ndarray], n: int) -> np.ndarray:
    """Number of shared features of each two of ``n`` lists; a feature of one list only costs nothing."""
    owner = np.repeat(np.arange(n), [len(f) for f in features])
    ids, at, count = np.unique(np.concatenate(features), return_inverse=True, return_counts=True) if len(owner) else (owner, owner, owner)
    out = np.zeros((n, n), dtype=np.float32)
    out[np.arange(n), np.arange(n)] = [len(f) for f in features]
    if len(ids):
        shared = count > 1
        column = np.cumsum(shared) - 1
        use = shared[at]
        owner, at = owner[use], column[at[use]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        total = np.zeros((n, n), dtype=np.float32)
        for low in range(0, int(shared.sum()), _COLUMNS):
            part = slice(np.searchsorted(at, low), np.searchsorted(at, low + _COLUMNS))
            m = np.zeros((n, min(_COLUMNS, int(shared.sum()) - low)), dtype=np.float32)
            m[owner[part], at[part] - low] = 1
            total += m @ m.T
        np.fill_diagonal(total, out.diagonal())
        out = total
    return out


def linked(n_leader: int, missing: list[np.ndarray], extra: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two of the members of a leader are similar, from their differences to the leader."""
    n = len(missing)
    lack, more = np.array([len(m) for m in missing]), np.array([len(e) for e in extra])
    both = n_leader - lack[:, None] - lack[None, :] + _product(missing, n).astype(np.int64) + _product(extra, n).astype(np.int64)
    size = n_leader - lack + more
    with np.errstate(invalid="ignore", divide="ignore"):
        out = both / (size[:, None] + size[None, :] - both) >= threshold
    np.fill_diagonal(out, False)
    return out


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        leader = rows["leader"][0].as_py()
        node, lists = rows["node"].to_pylist(), rows["leaders"].to_pylist()
        weight, block = np.array(rows["size"].to_pylist(), dtype=np.int64), np.array(rows["block"].to_pylist())
        pairs = linked(
            rows["n_leader"][0].as_py(),
            [np.frombuffer(b, np.int32) for b in rows["missing"].to_pylist()],
            [np.frombuffer(b, np.uint64) for b in rows["extra"].to_pylist()],
            threshold,
        )
        if rows["lo"][0].as_py() != rows["hi"][0].as_py():
            pairs &= block[:, None] != block[None, :]
        lower = sorted({x for one in lists for x in one if x < leader})
        if lower:
            at = {x: i for i, x in enumerate(lower)}
            c = np.zeros((len(node), len(lower)), dtype=np.float32)
            for i, one in enumerate(lists):
                c[i, [at[x] for x in one if x < leader]] = 1
            pairs &= (c @ c.T) == 0
        root = np.arange(len(node))
        while True:
            low = np.minimum(root, np.where(pairs, root[None, :], len(node)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        has = np.flatnonzero(pairs.any(axis=1))
        return pa.table(
            {
                "node": pa.array([node[i] for i in has], pa.binary()),
                "links": pa.array((pairs @ weight)[has], pa.int64()),
                "to": pa.array([node[root[i]] for i in has], pa.binary()),
            }
        )

    return run


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """(doc_id, class_id, n_links), one row per row of ``docs``.

    ``n_links`` counts the other rows whose n-gram Jaccard similarity is at least ``threshold``; ``class_id``
    is the lowest id among the rows connected by such links.
    """
    sig, answer = _classes(docs, doc_id, text, n, threshold, recall)
    known = sig.where("node IS NOT NULL").select("doc_id", "node")
    blank = sig.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.join(answer.drop("root"), "node").select("doc_id", "class_id", "n_links").unionByName(blank)


def _classes(docs: DataFrame, doc_id: str, text: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tk, node, bands) of every row, and (node, root, class_id, n_links) of every set of n-grams."""
    bands, rows = choose_bands(threshold, recall)
    sig = staged(signatures(docs, doc_id, text, n, bands, rows), "signatures")
    known = sig.where("node IS NOT NULL")
    sets = staged(
        known.groupBy("node").agg(
            F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"),
            F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "tk")).alias("row"),
        ),
        "sets",
    )

    bucket = sets.select("node", F.posexplode("bands").alias("band", "h"))
    leads = bucket.groupBy("band", "h").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
    leads = staged(leads.where("n > 1").drop("n"), "leaders")
    members = staged(bucket.join(leads, ["band", "h"]).select("leader", "node").distinct(), "members")

    # One row of each set gives its n-grams again; rows of no or one id are told apart by their texts.
    wanted = members.select("node").distinct().join(sets.select("node", "row.id", "row.tk"), "node")
    texts = docs.select(F.coalesce(F.col(doc_id), F.lit(_NO_ID)).alias("id"), _text_key(text).alias("tk"), F.col(text).alias("text"))
    grams = staged(_grams_of(wanted.join(texts, ["id", "tk"]).select("node", "text"), n), "grams")
    own = members.join(grams.withColumnRenamed("grams", "own"), "node")
    theirs = grams.select(F.col("node").alias("leader"), F.col("grams").alias("theirs"))
    delta = staged(_differences(own.join(theirs, "leader").select("leader", "node", "own", "theirs")), "differences")

    lists = members.groupBy("node").agg(F.collect_set("leader").alias("leaders")).join(sets.select("node", "size"), "node")
    blocks = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    spread = delta.join(lists, "node").join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    cols = ["leader", "node", "n_leader", "missing", "extra", "leaders", "size", "block", "lo", "hi"]
    found = spread.select(*cols).groupBy("leader", "lo", "hi").applyInArrow(
        _compare(threshold), "node binary, links long, to binary"
    )
    found = staged(found, "links")

    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_set = sets.select("node", "size", "first_id").join(roots, "node", "left").join(links, "node", "left")
    per_set = per_set.select("node", "size", "first_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    per_set = staged(per_set, "sets")
    classes = per_set.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return sig, per_set.join(classes, "root").select("node", "root", "class_id", (F.col("size") - 1 + F.col("links")).alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the near-duplicates: of each class the row with the lowest id stays, with its columns unchanged.

    Rows are judged one by one, also those of one id: a text that is like no other stays. A null id comes after
    all others, equal ids are told apart by a digest of the text, and of fully equal rows one stays. A blank text is a
    class of its own and stays. Other columns may have any name.
    """
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    own, body = f"d{names.index(doc_id)}", f"d{names.index(text)}"
    sig, answer = _classes(plain, own, body, NGRAM, THRESHOLD, RECALL)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "tk")
    known = sig.where("node IS NOT NULL").select("node", row.alias("row"))
    first = known.join(answer.select("node", "root"), "node").groupBy("root").agg(F.min("row").alias("row")).select("row.id", "row.tk")
    solid = F.coalesce(F.col(body).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = plain.where(solid).withColumns({"id": F.coalesce(own, F.lit(_NO_ID)), "tk": _text_key(body)})
    again = F.row_number().over(Window.partitionBy("id", "tk").orderBy("id"))
    rows = keyed.join(first, ["id", "tk"]).withColumn("again", again).where("again = 1").drop("id", "tk", "again")
    return rows.unionByName(plain.where(~solid)).toDF(*names)
