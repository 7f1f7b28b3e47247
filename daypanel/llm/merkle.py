"""Merkle manifest of a dataset: one hash tree per group, one over the groups, a proof for every row.

A leaf is the hash of a row's fields. Per group the leaves ascend by the order column; every two consecutive
nodes become their parent, a lone last one its own, until one remains: the subroot. The subroots, in byte
order of their groups (null first), are the leaves of the tree that ends in the root. A proof lists the
siblings of a row's nodes from the leaf to the root.

Time-forward processing: nodes are labelled level by level, so children have smaller labels than parents. A
queue ordered by label delivers the digests of the children to their parent, which is hashed when its label is
due. The reversed sweep takes the labels from the top: a node that has its proof suffix sends each child the
sibling's digest followed by that suffix, and what arrives at a leaf is its proof.

The queue is external. Positions are cut into slabs of 1,024 leaves (``limit`` levels), which are complete subtrees; inside a slab
the queue is a heap of a task, and what leaves a slab goes by way of tables sorted by label: slab tops are the
leaves of the next round, and proof suffixes go back slab by slab. So no task holds more than a slab and a proof,
the rounds grow with the logarithm of the rows, and every round is written to the shared folder.

Positions come from a range partitioning by (group, order, leaf): a group with most of the rows spreads over all
partitions. Counts per partition and group give the shift; the driver sees two numbers and the root.

Defined results: a null field is hashed as ``-``; rows with equal group and order ascend by leaf, fully equal rows are
interchangeable; null order values come first and are never altered; an empty table gives an empty table; other columns
may have any name. A lone row is its subroot, a lone group its root; an empty proof is hashed as the empty string.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from daypanel.llm.staging import staged

#: Levels of a slab, which has two to this power leaves.
LEVELS = 10
#: Slabs that a Python task takes at once.
_BATCH = 16

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """SHA-256 of the concatenated parts, as lower-case hex text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of fields, each as its length in UTF-8 bytes, a colon and the value, or as a dash if null."""
    text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def at_level(n: int, level: int) -> int:
    """Nodes of a level above ``n`` leaves."""
    return -(-n >> level) if level else n


def rise(digests: Sequence[bytes], first: int, n: int, limit: int = LEVELS) -> list[dict[int, bytes]]:
    """Forward sweep over a slab: digests by level and index. ``first`` is the index of its first leaf of ``n`` in the group.

    Messages are (level, index of the receiver, place among its children, digest); the receiver is hashed
    when all messages with its label have been taken from the queue.
    """
    top = min(limit, height(n))
    levels: list[dict[int, bytes]] = [{} for _ in range(top + 1)]
    levels[0] = {first + i: d for i, d in enumerate(digests)}
    if top == 0:
        return levels
    queue = [(1, i >> 1, i & 1, d) for i, d in levels[0].items()]
    heapq.heapify(queue)
    while queue:
        level, index, _, own = heapq.heappop(queue)
        inputs = [own]
        while queue and queue[0][:2] == (level, index):
            inputs.append(heapq.heappop(queue)[3])
        made = levels[level][index] = digest(*inputs)
        if level < top:
            heapq.heappush(queue, (level + 1, index >> 1, index & 1, made))
    return levels


def fall(levels: Sequence[Mapping[int, bytes]], suffix: bytes) -> Iterator[tuple[int, bytes]]:
    """Reversed sweep over a slab: the proof of each leaf, from the proof suffix of the slab's top."""
    top = len(levels) - 1
    queue = [(-top, -index, suffix) for index in levels[top]]
    while queue:
        level, index, own = heapq.heappop(queue)
        level, index = -level, -index
        if level == 0:
            yield index, own
            continue
        below = levels[level - 1]
        for child in (2 * index, 2 * index + 1):
            if child in below:
                heapq.heappush(queue, (1 - level, -child, below.get(child ^ 1, b"") + own))


def fold(own: bytes, proof: bytes, path: Sequence[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings give; ``path`` has index and number of leaves of each tree on the way."""
    at = 0
    for index, n in path:
        while n > 1:
            if index ^ 1 < n:
                sibling = proof[at : at + 64]
                at += 64
                own = digest(sibling, own) if index & 1 else digest(own, sibling)
            else:
                own = digest(own)
            index, n = index >> 1, (n + 1) >> 1
    return own


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their ``pos`` in the group ``g``, from 0, and the size ``n`` of the group. ``rows`` is a staged table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    by = ["g", *order, "tie"]
    # The number holds the partition above bit 33 and the place of the row below.
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie")
    ordered = staged(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition and group in it.
    sizes = ordered.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("least"))
    shift = sizes.select(
        "g", "part", F.sum("rows").over(group).alias("n"), (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("least")).alias("shift")
    )
    return ordered.join(shift, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _slabs(rows: DataFrame, limit: int, extra: Sequence[str] = ()) -> DataFrame:
    """One row per slab: (g, n, slab, items by position). ``rows`` has g, n, pos, own and the extra columns."""
    item = F.struct("pos", "own", *extra)
    grouped = rows.groupBy("g", "n", F.shiftright("pos", limit).alias("slab")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return staged(grouped, "merkle-slabs")


_TOP = "g string, n bigint, pos bigint, own binary"


def _tops(slabs: DataFrame, limit: int) -> DataFrame:
    """The top node of each slab, as a leaf of the next round."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.select(["g", "n", "slab", "items"]).to_pylist():
                levels = rise([i["own"] for i in row["items"]], row["items"][0]["pos"], row["n"], limit)
                (index, own), = levels[-1].items()
                out.append({"g": row["g"], "n": at_level(row["n"], len(levels) - 1), "pos": index, "own": own})
            yield pa.RecordBatch.from_pylist(out, _ARROW_TOP)

    return staged(slabs.mapInArrow(run, _TOP), "merkle-tops", _BATCH)


_ARROW_TOP = pa.schema([("g", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("own", pa.binary())])


def _rounds(rows: DataFrame, extra: Sequence[str], most: int, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """Slabs of every round, lowest first, and the top (g, own) of every group. ``most`` is the size of the largest group."""
    rounds = [_slabs(rows, limit, extra)]
    tops = _tops(rounds[0], limit)
    while (most := at_level(most, limit)) > 1:
        rounds.append(_slabs(tops, limit))
        tops = _tops(rounds[-1], limit)
    return rounds, tops.select("g", "own")


#: What goes down with a proof suffix: the subroot, and index and number of the groups.
_DOWN = "g string, slab bigint, suffix binary, subroot binary, gi bigint"
_ARROW_DOWN = pa.schema([("g", pa.string()), ("slab", pa.int64()), ("suffix", pa.binary()), ("subroot", pa.binary()), ("gi", pa.int64())])


def _suffixes(slabs: DataFrame, down: DataFrame, limit: int) -> DataFrame:
    """Proof suffixes of the slabs below, from those of these slabs."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels = rise([i["own"] for i in row["items"]], row["items"][0]["pos"], row["n"], limit)
                yield pa.RecordBatch.from_pylist(
                    [{"g": row["g"], "slab": i, "suffix": p, "subroot": row["subroot"], "gi": row["gi"]} for i, p in fall(levels, row["suffix"])],
                    _ARROW_DOWN,
                )

    return staged(slabs.join(down, ["g", "slab"]).mapInArrow(run, _DOWN), "merkle-down", _BATCH)


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    keep: Sequence[str] = ("doc_id",),
    altered: tuple[Column, Mapping[str, Column]] | None = None,
    with_proof: bool = False,
    limit: int = LEVELS,
) -> DataFrame:
    """Per row: the columns of ``keep``, leaf, subroot, root, proof digest, the root folded from leaf and proof, and whether it equals the root.

    ``altered`` gives the rows, by a condition, whose copy to verify differs, and the fields of that copy; proofs are those of
    the original. ``with_proof`` adds ``proof``: the siblings as an array of digests, leaf to root. ``limit`` is the levels of a slab.
    """
    named = {c: F.col(f"`{c}`") for c in fields}
    claim = F.lit(None).cast("string")
    if altered is not None:
        claim = F.when(altered[0], leaf([altered[1].get(c, named[c]) for c in fields]))
    g = F.col(f"`{group}`").cast("string")
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    types = [docs.schema[c].dataType for c in keep]
    extra = ["claim", *[f"c{i}" for i in range(len(keep))]]
    # The empty key is the null group, so that it comes first and equals itself in joins.
    leaves = docs.select(
        F.when(g.isNull(), "").otherwise(F.concat(F.lit("="), g)).alias("g"), F.col(f"`{order}`").alias("o"),
        F.encode(leaf(list(named.values())), "utf-8").alias("own"), F.encode(claim, "utf-8").alias("claim"), *kept,
    )
    placed = staged(_placed(staged(leaves, "merkle-leaves"), ["o", "own"]).drop("o"), "merkle-placed")
    most = placed.agg(F.max("n")).first()[0] or 0
    rounds, subroots = _rounds(placed, extra, most, limit)

    # The tree over the groups is one more forest, of a single group.
    own_group = _placed(staged(subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), "own"), "merkle-subroots"), ["o"])
    own_group = staged(own_group, "merkle-groups")
    n_groups = own_group.count()
    upper, tops = _rounds(own_group, ["o"], n_groups, limit)
    root = (tops.first() or {"own": b""})["own"]
    down = tops.select("g", F.lit(0).cast("bigint").alias("slab"), F.encode(F.lit(""), "utf-8").alias("suffix"),
                       F.col("own").alias("subroot"), F.lit(0).cast("bigint").alias("gi"))
    for slabs in reversed(upper):
        down = _suffixes(slabs, down, limit)
    # Position in the upper tree back to the group: its only slab of the last round gets the group's suffix.
    below = own_group.select(F.col("o"), F.col("pos").alias("at"), F.col("own").alias("top"))
    down = down.join(below, F.col("slab") == F.col("at")).select(
        F.col("o").alias("g"), F.lit(0).cast("bigint").alias("slab"), "suffix", F.col("top").alias("subroot"), F.col("at").alias("gi")
    )
    for slabs in reversed(rounds[1:]):
        down = _suffixes(slabs, down, limit)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                items = {i["pos"]: i for i in row["items"]}
                levels = rise([i["own"] for i in items.values()], row["items"][0]["pos"], row["n"], limit)
                out = []
                for pos, proof in fall(levels, row["suffix"]):
                    item = items[pos]
                    folded = fold(item["claim"] or item["own"], proof, ((pos, row["n"]), (row["gi"], n_groups)))
                    made = {"leaf": item["own"], "subroot": row["subroot"], "root": root, "proof_sha256": digest(proof),
                            "folded_root": folded, "verified": folded == root}
                    if with_proof:
                        made["proof"] = [proof[i : i + 64].decode() for i in range(0, len(proof), 64)]
                    out.append({k: v.decode() if isinstance(v, bytes) else v for k, v in made.items()} | {"c": {c: item[c] for c in extra[1:]}})
                struct = pa.struct([pa.field(f.name, f.type) for f in batch.schema.field("items").type.value_type if f.name in extra[1:]])
                yield pa.RecordBatch.from_pylist(out, pa.schema([*_ARROW_OUT, *([pa.field("proof", pa.list_(pa.string()))] if with_proof else []), pa.field("c", struct)]))

    inner = ", ".join(f"c{i}: {t.simpleString()}" for i, t in enumerate(types))
    schema = ", ".join(f"{f.name} {'boolean' if f.name == 'verified' else 'string'}" for f in _ARROW_OUT)
    schema += (", proof array<string>" if with_proof else "") + f", c struct<{inner}>"
    found = staged(rounds[0].join(down, ["g", "slab"]).mapInArrow(run, schema), "merkle-manifest", _BATCH)
    names = [f.name for f in _ARROW_OUT] + (["proof"] if with_proof else [])
    return found.select(*[F.col(f"c.c{i}").alias(c) for i, c in enumerate(keep)], *names)


_ARROW_OUT = [
    pa.field("leaf", pa.string()), pa.field("subroot", pa.string()), pa.field("root", pa.string()), pa.field("proof_sha256", pa.string()),
    pa.field("folded_root", pa.string()), pa.field("verified", pa.bool_()),
]
