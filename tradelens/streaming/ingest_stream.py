"""Incremental import of customs CSV files as a Structured Stream.

New files dropped in ``source_dir`` form micro-batches (``maxFilesPerTrigger``
bounds them); ``foreachBatch`` reads the batch's files like a batch import -
columns bound by each file's own header - and imports them: validate ->
in-batch de-duplication -> anti-join against the stored lines -> commit.
De-duplication against what is already stored makes a replayed batch (after a
failure) a no-op, and its dimensions and rejected lines are completed.
Rejected lines, and all lines of a refused batch, are written to
``{store_root}/rejected`` under the batch's id.

The caller may pass ``on_chunk``: it gets a :class:`Chunk` after each
micro-batch, with the batch's lines, its import counts (observed on the
writes) and the share of the source's bytes read so far.  An exception it
raises, or more than ``max_errors`` lines with issues in a batch with
``abort_on_error``, stops the stream; what was committed stays, and the
stream goes on from there when it is started again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tradelens.operators import ingest as I
from tradelens.sources.commits import children, hadoop_path
from tradelens.sources.customs_csv import batch_files, stream_files


class ImportAborted(RuntimeError):
    """A batch was refused and the caller asked to stop then."""


@dataclass(frozen=True)
class Chunk:
    """What ``on_chunk`` gets.  ``progress`` is in percent of the bytes that
    lay in the source when the stream was started, at most 99 until the last
    of them is imported; files that came later are not part of it."""

    batch_id: int
    files: tuple[str, ...]
    result: I.ImportResult
    progress: float

    @property
    def counts(self) -> dict[str, int]:
        return self.result.counts

    @property
    def lines(self) -> DataFrame:
        """The new lines of the chunk, as stored."""
        return self.result.new_facts


class _Progress:
    """Bytes of the source's files, and how many are done."""

    def __init__(self, spark: SparkSession, source_dir: str):
        self.size = {}
        for name in children(spark, source_dir):
            path, fs = hadoop_path(spark, f"{source_dir.rstrip('/')}/{name}")
            status = fs.getFileStatus(path)
            if not status.isDirectory() and not name.startswith("_"):
                self.size[status.getPath().getName()] = status.getLen()
        self.left = set(self.size)

    def after(self, files: list[str]) -> float:
        self.left -= {f.rpartition("/")[2] for f in files}
        total = sum(self.size.values())
        done = total - sum(self.size[n] for n in self.left)
        return 100.0 if not self.left else min(99.0, 100.0 * done / total if total else 99.0)


def import_batch(
    batch: DataFrame, batch_id: int, store_root: str, mode: str = "quarantine", max_errors: int | None = None, abort_on_error: bool = False
) -> tuple[list[str], I.ImportResult] | None:
    """One micro-batch of the stream import (called by ``foreachBatch``): its
    files and their import."""
    files = batch_files(batch)
    if not files:
        return None
    result = I.run_import(batch.sparkSession, files, store_root, mode, import_id=f"batch-{batch_id}", max_errors=max_errors)
    if abort_on_error and not result.accepted:
        raise ImportAborted(f"batch {batch_id}: {result.counts['invalid_rows']} lines rejected")
    return files, result


def start_stream_import(
    spark: SparkSession,
    source_dir: str,
    store_root: str,
    checkpoint_location: str,
    max_files_per_trigger: int = 1,
    available_now: bool = True,
    mode: str = "quarantine",
    on_chunk: Callable[[Chunk], None] | None = None,
    max_errors: int | None = None,
    abort_on_error: bool = False,
) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    progress = _Progress(spark, source_dir) if on_chunk else None

    def run(batch: DataFrame, batch_id: int) -> None:
        done = import_batch(batch, batch_id, store_root, mode, max_errors, abort_on_error)
        if done is not None and on_chunk is not None:
            on_chunk(Chunk(batch_id, tuple(done[0]), done[1], progress.after(done[0])))

    writer = stream_files(spark, source_dir, max_files_per_trigger).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
