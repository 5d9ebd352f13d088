"""Token counts of documents in flat token files (operator 5).

A flat file holds little-endian token ids and nothing else; a document ends
at an end-of-document id and there is no index.

1. Scan: files are cut into blocks of ``BLOCK_TOKENS``; each block is read by
   offset and its separators are found with one vectorised comparison.
2. Stitch: a prefix scan over block summaries gives each block the number of
   separators before it (sum) and where its first document began (maximum of
   the last separators).  The scan has two levels - runs of ``RUN`` blocks,
   then blocks within a run - so even one huge file is scanned by many tasks.
3. Documents: every separator ends one document; lengths are differences of
   neighbouring separators, the first one against the stitched start.

Defined results: an empty file has no documents; two neighbouring separators
enclose a document of zero tokens; tokens after the last separator are a
document marked ``terminated = false``; an empty file list gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradelens.llm import files
from tradelens.llm.common import cut, named, scratch_dir

BLOCK_TOKENS = 1 << 20
RUN = 1024


def _scan(end_id: int, width: int):
    dtype = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_py() for c in ("file", "block", "first", "tokens")}
                ids = np.frombuffer(files.read_range(row["file"], row["first"] * width, row["tokens"] * width), dtype=dtype)
                ends = row["first"] + np.flatnonzero(ids == end_id).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (row["file"], row["block"], row["first"], row["tokens"])] + [pa.array([ends], type=pa.list_(pa.int64()))],
                    ["file", "block", "first", "tokens", "ends"],
                )

    return run


def count_tokens(token_files: DataFrame, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``token_files(file, bytes)`` -> one row per document: ``file, ordinal,
    start, n_tokens`` (without the separator), ``terminated``."""
    blocks = (
        token_files.select("file", F.floor(F.col("bytes") / width).cast("long").alias("total"))
        .filter("total > 0")
        .select("file", "total", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(block_tokens).cast("long"))).alias("block", "first"))
        .select("file", F.col("block").cast("long").alias("block"), "first", F.least(F.lit(block_tokens).cast("long"), F.col("total") - F.col("first")).alias("tokens"))
    )
    scanned = cut(blocks.repartition("file", "block").mapInArrow(_scan(end_id, width), "file string, block long, first long, tokens long, ends array<long>"), "token-blocks")

    # prefix scan, level 1: runs of blocks; level 2: blocks within a run
    summary = scanned.select("file", "block", F.floor(F.col("block") / RUN).alias("run"), F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"), (F.col("first") + F.col("tokens")).alias("stop"))
    before = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = summary.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select(
        "file", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_n"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("run_last")
    )
    within = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = summary.select("file", "run", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("n_before"), F.max("last").over(within).alias("last_before"))
    carry = stitched.join(runs, ["file", "run"]).select(
        "file", "block", (F.col("run_n") + F.col("n_before")).alias("ordinal"), (F.coalesce("last_before", "run_last") + 1).alias("begin")
    )

    # documents ended by a separator, block by block
    ended = scanned.filter(F.size("ends") > 0).select("file", "block", "ends").join(carry, ["file", "block"])
    starts = F.concat(F.array("begin"), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1))
    ended = ended.select("file", "ordinal", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("p", "d")).select(
        "file", (F.col("ordinal") + F.col("p")).alias("ordinal"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("n_tokens"), F.lit(True).alias("terminated")
    )
    # tokens after the last separator of a file
    tail = (
        summary.groupBy("file")
        .agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop"))
        .filter("start < stop")
        .select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    )
    return ended.unionByName(tail)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tokenise documents into flat 16-bit token files, one per task, in the
    shared folder.  Returns ``(file, bytes)`` and ``(file, ordinal, doc_id)``."""
    from tradelens.llm.tokenizer import byte_bpe

    folder = scratch_dir(docs.sparkSession, "token-files")
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n, size = byte_bpe(tokenizer_path).encode, 0, 0
        uri = files.attempt_name(folder, f"tokens-{TaskContext.get().partitionId():06d}")
        with files.open_output(uri) as f:
            for b in batches:
                for text in b.column("text"):
                    ids = np.append(encode(text.as_py() or ""), end_id)
                    if ids.max() > 0xFFFF:
                        raise ValueError("token id beyond 16 bits")
                    data = ids.astype("<u2").tobytes()
                    f.write(data)
                    size += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(b), type=pa.string()), pa.array(np.arange(n, n + len(b))), b.column("doc_id"), pa.array(np.full(len(b), size))],
                    ["file", "ordinal", "doc_id", "bytes"],
                )
                n += len(b)

    manifest = cut(rows.mapInArrow(run, f"file string, ordinal long, doc_id {id_type}, bytes long"), "token-manifest")
    return manifest.groupBy("file").agg(F.max("bytes").alias("bytes")), manifest.select("file", "ordinal", "doc_id")
