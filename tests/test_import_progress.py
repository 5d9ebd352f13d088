"""The caller's chunk callback, progress and abort of a stream import."""

import os

import pytest
from pyspark.errors import StreamingQueryException

from tests.test_ingest import write_csv
from tradelens.sources.commits import CommitLog
from tradelens.sources.store import ParquetStore
from tradelens.streaming.ingest_stream import start_stream_import


def files(tmp_dir, n, faulty=()):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for i in range(n):
        rows = [{"Số tờ khai": f"{i}{k}"} for k in range(5)]
        if i in faulty:
            rows += [{"Tháng": "13"}] * 3
        write_csv(os.path.join(src, f"{i}.csv"), rows)
        os.utime(os.path.join(src, f"{i}.csv"), (1_700_000_000 + i, 1_700_000_000 + i))
    return src


def test_chunks_and_progress(spark, tmp_dir):
    src, seen = files(tmp_dir, 3, faulty=[1]), []
    start_stream_import(
        spark, src, f"{tmp_dir}/store", f"{tmp_dir}/ckpt", on_chunk=lambda c: seen.append((c.batch_id, len(c.files), c.progress, c.counts["imported_rows"], c.counts["invalid_rows"], c.lines.count()))
    ).awaitTermination(180)
    assert [s[:2] + s[3:] for s in seen] == [(0, 1, 5, 0, 5), (1, 1, 5, 3, 5), (2, 1, 5, 0, 5)]
    progress = [s[2] for s in seen]
    assert 0 < progress[0] < progress[1] <= 99 and progress[2] == 100


def test_callback_error_stops_and_the_stream_goes_on_from_there(spark, tmp_dir):
    src, seen = files(tmp_dir, 3), []

    def stop(chunk):
        seen.append(chunk.batch_id)
        if len(seen) == 2:
            raise ValueError("enough")

    with pytest.raises(StreamingQueryException):
        start_stream_import(spark, src, f"{tmp_dir}/store", f"{tmp_dir}/ckpt", on_chunk=stop).awaitTermination(180)
    assert seen == [0, 1] and ParquetStore(spark, f"{tmp_dir}/store").facts().count() == 10
    again = []
    start_stream_import(spark, src, f"{tmp_dir}/store", f"{tmp_dir}/ckpt", on_chunk=lambda c: again.append((c.batch_id, c.counts["imported_rows"]))).awaitTermination(180)
    # the batch whose callback failed is replayed and adds nothing
    assert again == [(1, 0), (2, 5)]
    assert ParquetStore(spark, f"{tmp_dir}/store").facts().count() == 15


def test_too_many_errors_abort(spark, tmp_dir):
    src = files(tmp_dir, 3, faulty=[1])
    with pytest.raises(StreamingQueryException, match="lines rejected"):
        start_stream_import(spark, src, f"{tmp_dir}/store", f"{tmp_dir}/ckpt", max_errors=2, abort_on_error=True).awaitTermination(180)
    assert ParquetStore(spark, f"{tmp_dir}/store").facts().count() == 5
    assert len(CommitLog(spark, f"{tmp_dir}/store").entries()) == 1
