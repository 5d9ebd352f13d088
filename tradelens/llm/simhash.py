"""SimHash near-duplicate groups (operator 2).

1. Fingerprint: every word shingle's XXH64; a fingerprint bit is 1 when it is
   set in over half of the shingle hashes (Charikar; one Arrow batch at a
   time, numpy bit counts, long texts in chunks).
2. Equal fingerprints collapse to one row before anything is joined.
3. Pigeonhole blocks: for distance d the 64 bits are split into 2*d blocks;
   two fingerprints within d bits agree on at least d whole blocks, so they
   share one of the C(2d, d) block selections (Manku et al., WWW 2007).
   Fingerprints meet on the selected bits and are verified by Hamming
   distance.
4. Inside a meeting group only a spanning forest of the links is emitted,
   never all pairs.  A group beyond ``TILE`` members is cut into tiles and
   every pair of tiles is one bounded task group, so a hot block is spread
   over tasks and no group has to fit a task.
5. Links become classes by distributed connected components.

Defined results: null and empty texts (and texts of white space) have
fingerprint zero, linked like any other; fewer words than the shingle length
give one shingle, the whole sequence; repeated rows get equal classes, of
which exactly one row is kept; a null id never names a class unless the class
has no other id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import broadcast_if_small, cut, named
from tradelens.llm.graph import components

TILE = 4096
SEED = 42
CHUNK = 1 << 16


def text_fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of one text (0 for a text without words)."""
    from xxhash import xxh64_intdigest

    # bytes.lower() changes A-Z only and bytes.split() splits at \x20, \x09-\x0D
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        parts = zip(*(words[lo + j : hi + j] for j in range(shingle)), strict=False) if len(words) >= shingle else [words]
        h = np.fromiter((xxh64_intdigest(b" ".join(p), SEED) for p in parts), dtype=np.uint64, count=hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: bool = False) -> DataFrame:
    """``(doc_id, fp)`` per row; ``fp`` is the 64-bit fingerprint as a signed
    long.  With ``carry`` also the whole input row as struct ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((text_fingerprint(t.as_py(), shingle) for t in b.column("text")), dtype=np.uint64, count=len(b))
            names = ["doc_id", "fp", *(["row"] if carry else [])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), *([b.column("row")] if carry else [])], names)

    extra = [F.struct(*[named(c) for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"), *extra)
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("fp"), *(["row"] if carry else [])).schema
    return rows.mapInArrow(run, schema)


def block_masks(distance: int) -> list[int]:
    """Masks of the block selections: within ``distance`` bits, two 64-bit
    values are equal under at least one of them."""
    blocks = 2 * max(1, distance)
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    keep = blocks - distance
    return [sum(c) for c in combinations(block, keep)]


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the "within ``distance`` bits" graph over distinct
    values: breadth first, each popped value claims all unclaimed neighbours."""
    links: list[tuple[int, int]] = []
    rest = values
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                links.extend((int(x), int(y)) for y in found.view(np.int64))
                frontier.extend(found)
                rest = rest[~near]
    return [(int(np.uint64(a).view(np.int64)), b) for a, b in links]


def _link_groups(distance: int):
    cols = ["k", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None

        def links(b: pd.DataFrame) -> pd.DataFrame:
            fp = b["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            key = b[cols].to_numpy(dtype=np.int64)
            new = np.ones(len(b), dtype=bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(b)))
            two = start[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            u, v = [fp[two].view(np.int64)], [fp[two + 1].view(np.int64)]
            for s, n in zip(start[size > 2], size[size > 2], strict=True):
                found = spanning_links(fp[s : s + n], distance)
                if found:
                    a = np.array(found, dtype=np.int64)
                    u.append(a[:, 0])
                    v.append(a[:, 1])
            return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)}).drop_duplicates()

        for b in batches:
            b = b if left is None else pd.concat([left, b], ignore_index=True)
            last = b[cols].iloc[-1]
            open_ = (b[cols] == last).all(axis=1).to_numpy()
            cutoff = len(b) - int(open_[::-1].argmin() if not open_.all() else len(b))
            done, left = b.iloc[:cutoff], b.iloc[cutoff:]
            if len(done):
                yield links(done)
        if left is not None and len(left):
            yield links(left)

    return run


def near_links(distinct_fps: DataFrame, distance: int) -> DataFrame:
    """``(fp)`` distinct -> ``(u, v)`` links that connect exactly the values
    reachable over steps of at most ``distance`` differing bits."""
    masks = block_masks(distance)

    def signed(m: int) -> int:
        return m - (1 << 64) if m >= 1 << 63 else m

    keyed = distinct_fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])).alias("k"))
    # partial counts: a key met once needs no partner search, a hot key says how many tiles it needs
    met = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    members = keyed.join(met, "k").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # one tile: group (0, 0).  More: the member joins each group {t, other}; two tiles of a group hold about 2 * TILE rows.
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != F.col("t")))
    grouped = members.select("k", "fp", "t", F.explode(others).alias("o")).select("k", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "fp")
    dealt = grouped.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return dealt.mapInPandas(_link_groups(distance), "u long, v long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, carry: bool = False) -> DataFrame:
    """Near-duplicate classes: one row per input row with ``doc_id``,
    ``fingerprint`` (16 lower-case hex digits), ``component_id`` (smallest id
    of the class reachable over links of at most ``distance`` bits), ``kept``
    (one row of each class) and, with ``carry``, the input row as struct ``row``."""
    made = fingerprints(docs, id_col, text_col, shingle, carry).withColumn("row_id", F.monotonically_increasing_id())
    rows = cut(made, "simhash-fp")  # fixes row_id
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    distinct = cut(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp"), distance)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    labelled = distinct.join(roots, "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    classes = labelled.groupBy("root").agg(F.sum("n").alias("rows"), F.min("first").alias("keep")).filter(F.col("rows") > 1)
    # only classes of several rows take part in the join back; any other row is its own class
    shared = cut(labelled.join(classes, "root").select(F.col("fp").alias("class_fp"), "keep"), "simhash-classes")
    shared = broadcast_if_small(shared, shared.count())
    alone = F.col("keep").isNull()
    return rows.join(shared, F.col("fp") == F.col("class_fp"), "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("component_id"),
        (alone | (F.col("keep.row_id") == F.col("row_id"))).alias("kept"),
        *(["row"] if carry else []),
    )
