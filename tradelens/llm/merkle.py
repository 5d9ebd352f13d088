"""Merkle manifest of a dataset (operator 11).

Every row is a leaf: SHA-256 of its fields, each ``-`` if null, else its
length in UTF-8 bytes, ``:`` and the value.  The leaves of a tree (one per
value of ``tree_col``) stand in order of ``id_col``; every 8 consecutive
nodes become the hash of their hex digests until one, the subroot, is left.
The subroots, in order of the tree value (null first, bytewise), are the
leaves of one more such tree, whose last node is the root.

Trees are stored as aligned subtrees (blocks) of ``BLOCK_LEAVES`` leaves, one
row each, whose nodes lie in van Emde Boas order: a subtree is split at half
its height into a top subtree and the subtrees below it, each stored
contiguously and split again.  ``address`` computes a node's place from its
level and index; building a block and reading siblings both go through it,
and need no knowledge of page or cache sizes.  The roots of the blocks are
the leaves of the next row of blocks, and so on up.

On Spark: the digests (not the texts) are ranked by a range partition, so a
tree with a third of all rows is spread; a task holds one block at a time.
Proofs go down the same blocks: each block joins the path of its own root
and hands its leaves theirs.  A path has a few hundred bytes a level.

Defined results: a null field is ``-``; an empty text is ``0:``; a null
``tree_col`` is a tree of its own; null ids come first and equal ids are
ordered by digest, so the root does not depend on the order of rows; repeated
rows are leaves of their own with equal digests; an empty table has no
blocks, no root and no proofs; very long texts are hashed whole; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut, named, ranked

ARITY = 8
BLOCK_HEIGHT = 3
BLOCK_LEAVES = ARITY**BLOCK_HEIGHT
DIGEST = 32
HEX = 2 * DIGEST


def subtree_nodes(levels: int) -> int:
    """Nodes of a complete subtree with that many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places, in van Emde Boas order, of nodes ``index`` of a level (0: the
    root) of a subtree with ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if level < top:
        return address(top, level, index)
    below = ARITY ** (level - top)
    return subtree_nodes(top) + index // below * subtree_nodes(levels - top) + address(levels - top, level - top, index % below)


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    height = 0
    while ARITY**height < leaves:
        height += 1
    return height


def _hash(hex_digests: bytes) -> bytes:
    return hashlib.sha256(hex_digests).digest()


def build_block(leaves: np.ndarray, height: int) -> np.ndarray:
    """Nodes of a block in van Emde Boas order; places without a node are zero."""
    nodes = np.zeros((subtree_nodes(height + 1), DIGEST), dtype=np.uint8)
    level, row = height, leaves
    while True:
        nodes[address(height + 1, level, np.arange(len(row)))] = row
        if level == 0:
            return nodes
        text = row.tobytes().hex().encode()
        parents = b"".join(_hash(text[i : i + ARITY * HEX]) for i in range(0, len(text), ARITY * HEX))
        level, row = level - 1, np.frombuffer(parents, dtype=np.uint8).reshape(-1, DIGEST)


def block_paths(nodes: np.ndarray, height: int, count: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """For each leaf of a block, from its own level up: the hex digests of its
    siblings to the left and to the right, a pair per level."""
    rows = []
    for level in range(height, 0, -1):
        rows.append(nodes[address(height + 1, level, np.arange(count))].tobytes().hex().encode())
        count = -(-count // ARITY)
    for leaf in range(len(rows[0]) // HEX if rows else 1):
        left, right, at = [], [], leaf
        for text in rows:
            run = at // ARITY
            left.append(text[run * ARITY * HEX : at * HEX])
            right.append(text[(at + 1) * HEX : (run + 1) * ARITY * HEX])
            at = run
        yield left, right


def fold(leaf_hex: bytes, left: Sequence[bytes], right: Sequence[bytes]) -> bytes:
    """The root that a leaf and its siblings give."""
    for a, b in zip(left, right):
        leaf_hex = hashlib.sha256(a + leaf_hex + b).hexdigest().encode()
    return leaf_hex


def digest(fields: Sequence[Column]) -> Column:
    """Leaf digest (32 bytes) of a row's fields."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*map(part, fields)), 256))


@dataclass
class Manifest:
    """``levels[k]``: the blocks of row ``k`` of the trees (0: over the rows
    themselves); ``top``: the blocks over the subroots, likewise.  A block:
    ``tree, block, n`` (nodes of its row in the whole tree), ``height``,
    ``digest`` (of its root), ``nodes`` (van Emde Boas order) and, in row 0,
    its rows' ``ids`` and ``claims``."""

    levels: list[DataFrame]
    subroots: DataFrame  # tree, digest, rank (its place among the subroots)
    top: list[DataFrame]
    root: bytes | None


def _blocks(leaves: DataFrame, tag: str) -> DataFrame:
    """One row per block from ``tree, rank, n, digest`` (and ``id, claim``)."""
    kept = [c for c in ("id", "claim") if c in leaves.columns]
    types = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    extra = "".join(f", {c}s array<{types[c]}>" for c in kept)
    schema = f"tree {types['tree']}, block long, n long, height int, digest binary, nodes binary{extra}"

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        n = rows.column("n")[0].as_py()
        height = min(height_of(n), BLOCK_HEIGHT)
        leaf = np.frombuffer(b"".join(rows.column("digest").to_pylist()), dtype=np.uint8).reshape(-1, DIGEST)
        nodes = build_block(leaf, height)
        lists = [pa.array([rows.column(c).to_pylist()], type=pa.list_(rows.schema.field(c).type)) for c in kept]
        first = [rows.column(c).slice(0, 1).combine_chunks() for c in ("tree", "block", "n")]
        made = [pa.array([height], pa.int32()), pa.array([nodes[0].tobytes()], pa.binary()), pa.array([nodes.tobytes()], pa.binary())]
        return pa.Table.from_arrays([*first, *made, *lists], ["tree", "block", "n", "height", "digest", "nodes", *[f"{c}s" for c in kept]])

    grouped = leaves.withColumn("block", F.expr(f"rank div {BLOCK_LEAVES}")).groupBy("tree", "block")
    return cut(grouped.applyInArrow(build, schema), tag)


def _rows_of_blocks(leaves: DataFrame, tag: str) -> list[DataFrame]:
    """Blocks of every row up: the roots of the blocks are the next leaves."""
    levels = [_blocks(leaves, tag)]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > BLOCK_LEAVES:
        most = -(-most // BLOCK_LEAVES)
        inner = levels[-1].filter(F.col("n") > BLOCK_LEAVES)
        roots = inner.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK_LEAVES).alias("n"), "digest")
        levels.append(_blocks(roots, tag))
    return levels


def _tree_roots(levels: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of every tree, from the row where it is one block."""
    found = [b.filter(F.col("n") <= BLOCK_LEAVES).select("tree", "digest") for b in levels]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def build_manifest(docs: DataFrame, fields: Sequence[str], id_col: str, tree_col: str, claim: Column | None = None) -> Manifest:
    """Hash and store the trees of ``docs``.  ``claim``, if given, is another
    digest of each row (of a copy to be checked); it is kept beside the leaf
    and null where the copy is not checked."""
    claim = F.lit(None).cast("binary") if claim is None else claim
    leaves = docs.select(
        named(tree_col).alias("tree"), named(id_col).alias("id"), digest([named(c) for c in fields]).alias("digest"), claim.alias("claim"), F.monotonically_increasing_id().alias("row")
    )
    placed = ranked(cut(leaves, "merkle-leaves"), ["tree"], ["id", "digest", "row"], "merkle-order").withColumnRenamed("group_rows", "n")
    levels = _rows_of_blocks(placed.drop("row"), "merkle-blocks")
    subroots = ranked(cut(_tree_roots(levels), "merkle-subroots"), [], ["tree"], "merkle-subroot-order")
    top = _rows_of_blocks(subroots.select(F.lit("").alias("tree"), "rank", F.col("group_rows").alias("n"), "digest"), "merkle-top")
    last = _tree_roots(top).first()
    return Manifest(levels, subroots.drop("group_rows"), top, None if last is None else bytes(last["digest"]))


PATH = "left array<string>, right array<string>, subroot string"


def _handed_down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``tree, rank, left, right, subroot`` of every leaf of the blocks, from
    the paths of the blocks' own roots (``tree, block, left, right, subroot``)."""
    tree = blocks.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                nodes = np.frombuffer(r["nodes"], dtype=np.uint8).reshape(-1, DIGEST)
                count = min(r["n"] - r["block"] * BLOCK_LEAVES, BLOCK_LEAVES)
                paths = [([*map(bytes.decode, a), *r["left"]], [*map(bytes.decode, z), *r["right"]]) for a, z in block_paths(nodes, r["height"], count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["tree"]] * count, type=b.schema.field("tree").type),
                        pa.array(range(r["block"] * BLOCK_LEAVES, r["block"] * BLOCK_LEAVES + count), type=pa.int64()),
                        pa.array([p[0] for p in paths], type=pa.list_(pa.string())),
                        pa.array([p[1] for p in paths], type=pa.list_(pa.string())),
                        pa.array([r["subroot"]] * count, type=pa.string()),
                    ],
                    ["tree", "rank", "left", "right", "subroot"],
                )

    return _with_path(blocks, above).mapInArrow(run, f"tree {tree}, rank long, {PATH}")


def _with_path(blocks: DataFrame, above: DataFrame) -> DataFrame:
    up = above.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "left", "right", "subroot")
    return blocks.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block")


def _descend(levels: list[DataFrame], of_tree: DataFrame) -> DataFrame:
    """Paths of the roots of the blocks of row 0, from those of the trees' roots."""
    roots = of_tree.withColumn("block", F.lit(0).cast("long"))
    above = None
    for k in range(len(levels) - 1, -1, -1):
        whole = levels[k].filter(F.col("n") <= BLOCK_LEAVES).select("tree")
        ends = roots.join(whole.select(F.col("tree").alias("_t")), F.col("tree").eqNullSafe(F.col("_t")), "left_semi")
        ends = ends.select("tree", "block", "left", "right", "subroot")
        above = ends if above is None else above.unionByName(ends)
        if k:
            above = cut(_handed_down(levels[k], above), "merkle-paths").withColumnRenamed("rank", "block")
    return above


def prove(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``id, tree, leaf, subroot, root, proof_sha256`` (hash
    of all siblings, from the leaf's level up to the root's, left to right),
    ``folded_root`` (recomputed from the claim where there is one, else from
    the leaf, with the stored siblings) and ``verified``."""
    blocks = manifest.levels[0]
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    id_type = types["ids"][len("array<") : -1]
    schema = f"id {id_type}, tree {types['tree']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if manifest.root is None:
        return blocks.sparkSession.createDataFrame([], schema)
    empty = F.array().cast("array<string>")
    root_path = _tree_roots(manifest.top).select("tree", empty.alias("left"), empty.alias("right"), F.lit("").alias("subroot"))
    top = _descend(manifest.top, root_path)
    of_subroot = cut(_handed_down(manifest.top[0], top), "merkle-paths").drop("tree", "subroot")
    subroots = manifest.subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"), F.col("rank").alias("_rank"))
    above = _descend(manifest.levels, cut(subroots.join(of_subroot, F.col("rank") == F.col("_rank")).select("tree", "left", "right", "subroot"), "merkle-paths"))
    root = manifest.root.hex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, r in enumerate(b.to_pylist()):
                nodes = np.frombuffer(r["nodes"], dtype=np.uint8).reshape(-1, DIGEST)
                count = len(r["ids"])
                leaves = [x.hex() for x in map(bytes, nodes[address(r["height"] + 1, r["height"], np.arange(count))])]
                up_left, up_right = [x.encode() for x in r["left"]], [x.encode() for x in r["right"]]
                above_block = b"".join(a + z for a, z in zip(up_left, up_right))
                proof, folded = [], []
                for leaf, claim, (left, right) in zip(leaves, r["claims"], block_paths(nodes, r["height"], count)):
                    proof.append(hashlib.sha256(b"".join(a + z for a, z in zip(left, right)) + above_block).hexdigest())
                    start = leaf if claim is None else claim.hex()
                    folded.append(fold(start.encode(), left + up_left, right + up_right).decode())
                text = lambda values: pa.array(values, type=pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("ids").slice(i, 1).flatten(),
                        pa.array([r["tree"]] * count, type=b.schema.field("tree").type),
                        text(leaves),
                        text([r["subroot"]] * count),
                        text([root] * count),
                        text(proof),
                        text(folded),
                        pa.array([f == root for f in folded]),
                    ],
                    ["id", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return _with_path(blocks, above).mapInArrow(run, schema)
