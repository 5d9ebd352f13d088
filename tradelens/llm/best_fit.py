"""Best-fit packing of documents into as few sequences as it finds (operator 12).

Best-fit decreasing over all documents at once: longest first, each into the
open sequence with the least room that still holds it.  A segment tree over
remaining capacities finds that sequence in logarithmic time.  Only documents
longer than a sequence are cut, into full pieces and a last shorter one.

Best-fit decreasing looks at nothing but lengths, and pieces of equal length
are interchangeable.  So the decision is made on the counts per length (at
most ``size`` numbers, whatever the corpus): open sequences with one history
are a cohort, and a run of equal pieces goes into a cohort in one step, with
the very result of placing them one by one.  The plan says which ranks of a
length go where; it has at most a few cohorts per length (each step at least
halves a cohort's room, or ends a length), so it is small at every size and
is sent to the tasks.  Spark does the rest: tokenise, count by length, rank
the pieces of each length (range partition, so a length with a third of all
pieces is spread), and look each piece up in the plan.

Defined results: a null or empty text is one piece holding only the end id;
repeated rows are packed each on its own; an empty table gives an empty
result; pieces of equal length are placed in (doc_id, piece) order; a very
long text is cut into full pieces, each a sequence of its own, and the rest;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut, named, ranked
from tradelens.llm.word_tokenizer import word_bpe


class Capacities:
    """Segment tree that says which remaining capacities have open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()  # capacities 0 .. size
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        node = self.leaves + capacity
        self.any[node] = value
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest capacity >= length that has open sequences."""
        node = self.leaves + length
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):  # climb until something lies to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


@dataclass
class Plan:
    """Step ``i``: the pieces of length ``length[i]`` with ranks from
    ``rank[i]`` on go ``each[i]`` to a sequence, into consecutive sequences
    from ``sequence[i]``, at ``offset[i]``."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank."""
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for n in np.unique(length):
            lo, hi = np.searchsorted(self.length, [n, n + 1])
            mine = np.nonzero(length == n)[0]
            step = lo + np.searchsorted(self.rank[lo:hi], rank[mine], side="right") - 1
            more, slot = np.divmod(rank[mine] - self.rank[step], self.each[step])
            sequence[mine] = self.sequence[step] + more
            offset[mine] = self.offset[step] + slot * n
        return sequence, offset


def best_fit_plan(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing of ``counts`` (pieces per length, 1 .. size)."""
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # (first sequence, how many) by room
    room, steps, sequences = Capacities(size), [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_at[capacity].append((first, n))
            room.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = room.tightest(length)
            if capacity is None:  # nothing fits: open what the rest of this length needs
                n = -(-left // (size // length))
                put(size, sequences, n)
                sequences += n
                continue
            first, n = open_at[capacity].pop()
            room.set(capacity, bool(open_at[capacity]))
            each = capacity // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, each, first, size - capacity))
                rank, left = rank + full * each, left - full * each
                put(capacity - each * length, first, full)
            first, n = first + full, n - full
            if n and left:  # fewer than a sequence takes
                steps.append((length, rank, each, first, size - capacity))
                put(capacity - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(capacity, first, n)
    columns = np.array(sorted(steps), dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def _tokenise(encoder: Callable[[], Callable[[str], np.ndarray]], end_id: int, size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            row, piece, length, crc, ids = [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                doc = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k in range(-(-len(doc) // size)):
                    part = doc[k * size : (k + 1) * size]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        ids.append(part.astype(np.int64))
            numbers = [pa.array(piece, pa.int32()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            more = [pa.array(ids, type=pa.list_(pa.int64()))] if keep_ids else []
            names = ["doc_id", "piece", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, type=pa.int64())), *numbers, *more], names)

    return run


def best_fit_pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, with ``keep_ids``, the piece's ``ids``."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    pieces = rows.mapInArrow(_tokenise(lambda: word_bpe(tokenizer_path).encode, end_id, size, keep_ids), schema)
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()), "best-fit-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    plan = docs.sparkSession.sparkContext.broadcast(best_fit_plan(counts, size))
    placed = ranked(pieces, ["length"], ["doc_id", "piece", "row"], "best-fit-order").drop("row", "group_rows")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            kept = b.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    found = placed.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")
    start = (F.col("piece").cast("long") * size).alias("start")
    return found.select("doc_id", "piece", start, "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
