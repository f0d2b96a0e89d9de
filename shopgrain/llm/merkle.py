"""A Merkle manifest of a table, as a tree of hash states.

Leaves of a branch (here: a language) are ordered; every ``arity`` consecutive nodes have a parent, which hashes their
digests as hexadecimal text, and the branches' roots are the leaves of one more tree in the order of the branches. A
parent keeps a copy of its hash state before each child slot. A leaf's path holds, per level, the state before its slot
and its siblings; replacing a leaf resumes each state with the new digest and the siblings to the right alone, so
siblings to the left are never hashed again.

Rows are numbered by a range sort and one count per branch and partition, and hashed in blocks of at most ``span`` nodes;
the blocks' roots are the next tier. So no branch, however large, is held by one task, and a tier is smaller than the
one below by a factor of ``span``.

Null branches come first; a branch of one leaf has that leaf as root. Null fields are ``-``. Rows with equal keys are
ordered by their digests, and equal rows each have a leaf. Texts are hashed whole. An empty table has no rows and no
root. Other columns may have any names: only those named by the caller are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgrain.llm import sha_states as sha
from shopgrain.session import materialize

STEP = "struct<state: binary, left: binary, right: binary>"
BLOCK = "branch string, block long, blocks long, n long, height int, digests binary, states binary, root binary"
BLOCK_NODES = 4096


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """The digest of one row."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in columns]), 256))


def branch_key(column: Column) -> Column:
    """Never null, in the order of the column with null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each row's ``place`` within its ``branch`` by ``order``, and the branch's ``total``.

    Equal rows keep the order of the scan, so that many of them are still spread over partitions.
    """
    keys = ["branch", *order, "scanned"]
    placed = materialize(
        rows.withColumn("scanned", F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("scanned")
        .withColumn("at", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftright("at", 33).alias("part")
    by_branch = Window.partitionBy("branch")
    earlier = by_branch.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy("branch", part).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")).select(
        "branch", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start")).alias("shift"),
        F.sum("n").over(by_branch).alias("total"),
    )
    return (
        placed.withColumn("part", part).join(spans, ["branch", "part"])
        .withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    )


def height_of(total: int, arity: int, depth: int) -> int:
    """Levels above the nodes of a block: all of them in a large branch, else as many as lead to one node."""
    height = 0
    while height < depth and arity ** height < total:
        height += 1
    return height


def hash_block(arity: int, depth: int, group: pa.Table) -> pa.Table:
    """The tree over one block: digests of all levels, a state for each child slot of each parent, and how many blocks its
    branch has."""
    group = group.sort_by("place")
    level = sha.from_bytes(b"".join(group["digest"].to_pylist()))
    total = group["total"][0].as_py()
    height = height_of(total, arity, depth)
    digests, kept = [level], []
    for _ in range(height):
        parents = -(-len(level) // arity)
        states = np.empty((parents, arity, 8), np.uint32)
        state, children = sha.fresh(parents), np.zeros(parents, np.int64)
        for slot in range(arity):
            states[:, slot] = state
            child = level[slot::arity]
            if len(child):
                state[:len(child)] = sha.add_child(state[:len(child)], child)
                children[:len(child)] += 1
        level = sha.finish(state, children)
        digests.append(level)
        kept.append(states.reshape(-1, 8))
    everything = sha.to_bytes(np.concatenate(digests)).tobytes()
    return pa.table({
        "branch": group["branch"][:1], "block": group["block"][:1], "blocks": pa.array([-(-total // arity ** depth)], pa.int64()),
        "n": pa.array([group.num_rows], pa.int64()),
        "height": pa.array([height], pa.int32()), "digests": pa.array([everything], pa.binary()),
        "states": pa.array([sha.to_bytes(np.concatenate(kept)).tobytes() if kept else b""], pa.binary()),
        "root": pa.array([everything[-32:]], pa.binary()),
    })


@dataclass
class Tree:
    """Tiers of hashed blocks; the last has one block per branch."""

    tiers: list[DataFrame]
    arity: int
    depth: int

    @property
    def roots(self) -> DataFrame:
        return self.tiers[-1].select("branch", F.col("root").alias("digest"))


@dataclass
class Manifest:
    """Numbered leaves, the trees of the branches, and the tree over their roots."""

    leaves: DataFrame
    branches: Tree
    top: Tree
    branch_places: DataFrame


def grow(nodes: DataFrame, arity: int, depth: int) -> Tree:
    """Hash numbered nodes (branch, place, total, digest) block by block until each branch has one."""
    span = arity ** depth
    largest = nodes.agg(F.max("total")).first()[0] or 0
    tiers: list[DataFrame] = []

    def hashed(group: pa.Table) -> pa.Table:
        return hash_block(arity, depth, group)

    while True:
        blocks = nodes.select("branch", F.floor(F.col("place") / span).alias("block"), "place", "total", "digest")
        tier = materialize(blocks.groupBy("branch", "block").applyInArrow(hashed, BLOCK), "blocks")
        tiers.append(tier)
        largest = -(-largest // span)
        if largest <= 1:
            return Tree(tiers, arity, depth)
        nodes = tier.select("branch", F.col("block").alias("place"), F.col("blocks").alias("total"), F.col("root").alias("digest"))


def build(leaves: DataFrame, order: Sequence[str], arity: int = 2, block_nodes: int = BLOCK_NODES) -> Manifest:
    """The manifest of leaves with columns ``branch`` (see ``branch_key``), ``digest`` (32 bytes) and any others."""
    depth = max(1, int(np.log(block_nodes) / np.log(arity) + 1e-9))
    rows = numbered(leaves, [*order, "digest"])
    branches = grow(rows.select("branch", "place", "total", "digest"), arity, depth)
    places = numbered(branches.roots.select(F.lit("").alias("branch"), F.col("branch").alias("name"), "digest"), ["name"])
    places = materialize(places, "branches")
    return Manifest(rows, branches, grow(places.select("branch", "place", "total", "digest"), arity, depth), places)


def _ragged(pool: np.ndarray, index: np.ndarray) -> pa.Array:
    """One binary value per row of ``index``: the digests that it names, -1 naming none."""
    named = index >= 0
    offsets = np.concatenate([[0], np.cumsum(named.sum(axis=1) * 32)]).astype(np.int32)
    data = pool[index[named]].tobytes()
    return pa.Array.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def paths_in(block: dict, arity: int) -> pa.Array:
    """For each node of a block, its steps up to the block's root and then on along the block's own path."""
    n, height, above = block["n"], block["height"], block["path"] or []
    pool = [np.frombuffer(block["digests"], np.uint8).reshape(-1, 32)]
    states = np.frombuffer(block["states"], np.uint8).reshape(-1, 32)
    steps = height + len(above)
    state = np.empty((n, steps, 32), np.uint8)
    left = np.full((n, steps, arity - 1), -1, np.int64)
    right = left.copy()
    node, count, first, first_state = np.arange(n), n, 0, 0
    for k in range(height):
        parent, slot = node // arity, node % arity
        state[:, k] = states[first_state + node]
        for s in range(arity - 1):
            before = s < slot
            left[before, k, s] = first + (parent * arity + s)[before]
            other = parent * arity + s + 1
            after = (s >= slot) & (other < count)
            right[after, k, s] = first + other[after]
        first, count = first + count, -(-count // arity)
        first_state += count * arity
        node = parent
    at = len(pool[0])
    for k, step in enumerate(above, start=height):
        state[:, k] = np.frombuffer(step["state"], np.uint8)
        for side, index in (("left", left), ("right", right)):
            siblings = np.frombuffer(step[side], np.uint8).reshape(-1, 32)
            index[:, k, :len(siblings)] = at + np.arange(len(siblings))
            pool.append(siblings)
            at += len(siblings)
    digests = np.concatenate(pool)
    size = n * steps
    values = pa.StructArray.from_arrays([
        pa.Array.from_buffers(
            pa.binary(), size, [None, pa.py_buffer(np.arange(0, 32 * size + 1, 32, dtype=np.int32)), pa.py_buffer(state.tobytes())]
        ),
        _ragged(digests, left.reshape(size, arity - 1)), _ragged(digests, right.reshape(size, arity - 1)),
    ], ["state", "left", "right"])
    return pa.ListArray.from_arrays(np.arange(0, size + 1, max(steps, 1), dtype=np.int32)[:n + 1] if steps else np.zeros(n + 1, np.int32), values)


def _descend(arity: int, span: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            n = block["n"]
            yield pa.record_batch({
                "branch": pa.array([block["branch"]] * n, pa.string()),
                "place": pa.array(block["block"] * span + np.arange(n), pa.int64()),
                "path": paths_in(block, arity), "root": pa.array([block["root_of_all"]] * n, pa.binary()),
            })


def down(tree: Tree, tier: int, above: DataFrame) -> DataFrame:
    """The paths of a tier's nodes, from those of its blocks (branch, place, path, root)."""
    blocks = tree.tiers[tier].drop("root").join(
        above.select("branch", F.col("place").alias("block"), "path", F.col("root").alias("root_of_all")), ["branch", "block"]
    )
    return blocks.mapInArrow(
        partial(_descend, tree.arity, tree.arity ** tree.depth), f"branch string, place long, path array<{STEP}>, root binary"
    )


def paths(manifest: Manifest) -> DataFrame:
    """The leaves' columns with ``subroot``, ``root`` and ``path``: for each level from the leaf up to the root, the hash
    state before the slot, and the siblings' digests to the left and to the right, joined."""
    top, tree = manifest.top, manifest.branches
    above = top.tiers[-1].select("branch", F.lit(0).cast("long").alias("place"), F.array().cast(f"array<{STEP}>").alias("path"), "root")
    for tier in reversed(range(len(top.tiers))):
        above = down(top, tier, above)
    names = manifest.branch_places.select("place", F.col("name").alias("branch"), F.col("digest").alias("subroot"))
    above = materialize(above.drop("branch").join(names, "place").withColumn("place", F.lit(0).cast("long")), "paths")
    subroots = above.select("branch", "subroot")
    for tier in reversed(range(1, len(tree.tiers))):
        above = down(tree, tier, above.drop("subroot"))
    blocks = tree.tiers[0].drop("root").join(
        above.select("branch", F.col("place").alias("block"), "path", F.col("root").alias("root_of_all")), ["branch", "block"]
    ).join(subroots, "branch")
    leaves = manifest.leaves.drop("total").withColumn("block", F.floor(F.col("place") / tree.arity ** tree.depth))
    columns = [field for field in leaves.schema.fields if field.name != "block"]
    schema = T.StructType([*columns, *T.StructType.fromDDL(f"subroot binary, root binary, path array<{STEP}>").fields])
    names_out, arity = [field.name for field in columns], tree.arity

    def walk(rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        (found,) = block.to_pylist()
        n = rows.num_rows
        return pa.table([
            *[rows[name] for name in names_out], pa.array([found["subroot"]] * n, pa.binary()),
            pa.array([found["root_of_all"]] * n, pa.binary()), paths_in(found, arity),
        ], names=[*names_out, "subroot", "root", "path"])

    return leaves.groupBy("branch", "block").cogroup(blocks.groupBy("branch", "block")).applyInArrow(walk, schema)


def fold_batch(digests: np.ndarray, path: pa.ListArray) -> np.ndarray:
    """The roots that follow when the given digests stand at the start of the given paths."""
    starts = path.offsets.to_numpy()
    steps = path.values
    state = np.frombuffer(b"".join(steps.field("state").to_pylist()), np.uint8).reshape(-1, 32)
    right = steps.field("right")
    ends = np.frombuffer(right.buffers()[1], np.int32)[right.offset:right.offset + len(right) + 1].astype(np.int64)
    data = np.frombuffer(right.buffers()[2] or b"", np.uint8)
    n_left = np.diff(np.frombuffer(steps.field("left").buffers()[1], np.int32)[steps.field("left").offset:][:len(steps) + 1]) // 32
    n_right = np.diff(ends) // 32
    current = digests.copy()
    n_steps = np.diff(starts)
    for k in range(n_steps.max(initial=0)):
        rows = np.flatnonzero(n_steps > k)
        at = starts[rows] + k
        resumed = sha.add_child(sha.from_bytes(state[at]), current[rows])
        for s in range(n_right[at].max(initial=0)):
            more = np.flatnonzero(n_right[at] > s)
            sibling = data[(ends[at[more]] + 32 * s)[:, None] + np.arange(32)]
            resumed[more] = sha.add_child(resumed[more], sha.from_bytes(sibling))
        current[rows] = sha.finish(resumed, n_left[at] + 1 + n_right[at])
    return current


def fold(rows: DataFrame, leaf: str, path: str = "path", into: str = "folded") -> DataFrame:
    """Add the root that results from the digest in ``leaf`` along each row's path; a null digest gives null."""
    out = T.StructType([*[f for f in rows.schema.fields if f.name != path], T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            given = table[leaf].to_pylist()
            whole = pa.concat_arrays(table[path].chunks) if batch.num_rows else pa.array([], table.schema.field(path).type)
            found = sha.to_bytes(fold_batch(sha.from_bytes(b"".join(d or bytes(32) for d in given)), whole))
            folded = [None if d is None else f.tobytes() for d, f in zip(given, found)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in out.fields[:-1]], pa.array(folded, pa.binary())], names=out.names
            )

    return rows.mapInArrow(run, out)


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings on a path as hexadecimal text, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), ""), 256)


def check_rows(docs: DataFrame) -> DataFrame:
    """Leaves of documents by language, and for rows whose id has a checksum divisible by 7 the leaf of a tampered copy."""
    def digest(n_chars: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(
        branch_key(F.col("lang")).alias("branch"), F.col("doc_id").cast("long").alias("doc_id"),
        digest(F.col("n_chars")).alias("digest"),
        F.when(tampered, digest(F.col("n_chars").cast("long") + 1)).alias("replacement"),
    )


def verify(docs: DataFrame, arity: int = 2, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """A manifest of the documents, each row's proof, and the root that its possibly tampered copy folds to."""
    manifest = build(materialize(check_rows(docs), "leaves"), ["doc_id"], arity, block_nodes)
    proofs = paths(manifest).withColumn("given", F.coalesce("replacement", "digest")).withColumn(
        "proof_sha256", siblings_digest(F.col("path"))
    )
    return fold(proofs, "given").select(
        "doc_id", *[F.lower(F.hex(c)).alias(name) for c, name in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))],
        "proof_sha256", F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
