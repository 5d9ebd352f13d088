"""Packing documents into fixed training windows (operator 3).

Best-fit decreasing over token counts: every document is tokenised once,
overlong documents are first cut into full windows (each a sequence of its
own), and the remaining pieces are placed, longest first, into the open
window with the least room that still fits; a segment tree over remaining
capacity finds it.

Only piece numbers (and, on request, ids) are shuffled: pieces are dealt by
hash into groups of about ``DOCS_PER_GROUP`` documents and each group is
packed by one task, streaming in chunks of at most ``CHUNK`` pieces, so no
task holds an unbounded group even if all rows are alike.  A group of that
size already packs with a padding well below one percent.

Defined results: a null or empty text is one piece holding only the end id;
repeated rows are packed each on its own; an empty table gives an empty
result; ties in length are placed in (doc_id, start) order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import named

DOCS_PER_GROUP = 8192
CHUNK = 1 << 16
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that says
    which capacities have any."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()  # capacities 0 .. size
        self.tree = [0] * (2 * self.leaves)  # number of windows below each node
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += n
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.at[capacity].append(window)
        self._add(capacity, 1)

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """A window with the smallest remaining capacity >= length."""
        node = self.leaves + length
        while not self.tree[node]:
            while node & 1:  # a right child: nothing to its right below this parent
                node >>= 1
            if not node:
                return None
            node += 1  # right sibling
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece (1 <= length <= size); number of windows."""
    window = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    room, n = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = room.take_tightest(length)
        if found is None:
            found, n = (n, size), n + 1
        window[i], offset[i] = found[0], size - found[1]
        if found[1] > length:
            room.put(found[0], found[1] - length)
    return window, offset, n


def _tokenise(path: str, end_id: int, size: int, keep_ids: bool):
    from tradelens.llm.tokenizer import byte_bpe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path, special=True).encode
        for b in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                doc = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for lo in range(0, len(doc), size):
                    piece = doc[lo : lo + size]
                    row.append(i)
                    start.append(lo)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(doc))
                    if keep_ids:
                        ids.append(piece.astype(np.int64))
            numbers = [pa.array(x, type=pa.int64()) for x in (start, length, crc, total)]
            more = [pa.array(ids, type=pa.list_(pa.int64()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, type=pa.int64())), *numbers, *more], [*PIECE, *(["ids"] if keep_ids else [])])

    return run


def _pack(size: int):
    def place(batches: list[pa.RecordBatch], base: int, first: int) -> tuple[list[pa.RecordBatch], int]:
        t = pa.Table.from_batches(batches)
        length = t.column("length").to_numpy()
        full = length == size
        seq, off = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
        seq[full] = np.arange(full.sum())
        w, o, n = best_fit_decreasing(length[~full], size)
        seq[~full], off[~full] = w + full.sum(), o
        t = t.append_column("sequence_id", pa.array(base + first + seq)).append_column("offset", pa.array(off))
        return t.to_batches(), first + int(full.sum()) + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, first = TaskContext.get().partitionId() << 40, 0
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= CHUNK:
                out, first = place(held, base, first)
                held = []
                yield from out
        if held:
            yield from place(held, base, first)[0]

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, with ``keep_ids``, the piece's ``ids``."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    groups = max(1, -(-rows.count() // DOCS_PER_GROUP))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    piece = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep_ids else "")
    pieces = rows.mapInArrow(_tokenise(tokenizer_path, end_id, size, keep_ids), piece)
    dealt = pieces.repartition(groups, F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(_pack(size), f"{piece}, sequence_id long, offset long")
