"""Streamed sessions equal the batch ones whatever the order of events."""

import datetime as dt
import os
import random

import pytest

from tradelens.streaming.sessions import compact_fragments, merge_sessions, read_sessions, sessionize, start_session_stream

T0 = dt.datetime(2024, 1, 1)
EVENT = "user_id long, ts timestamp, value double"
FRAGMENT = "user_id long, session_start timestamp, session_end timestamp, events long, total_value double"


def brute(events, gap=30):
    out, last = [], {}
    for u, t, v in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[1])):
        if u not in last or t - last[u] > dt.timedelta(minutes=gap):
            out.append([u, t, t, 0, 0.0])
        out[-1][2:] = [t, out[-1][3] + 1, out[-1][4] + v]
        last[u] = t
    return sorted(map(tuple, out), key=repr)


def rows(df):
    return sorted(((r.user_id, r.session_start, r.session_end, r.events, r.total_value) for r in df.collect()), key=repr)


def some_events(rng, n, users):
    return [(rng.choice(users), T0 + dt.timedelta(minutes=rng.randint(0, 40 * n // len(users))), float(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_merged_fragments_equal_the_whole(spark, slices):
    """A hot user, a null user, fragments that overlap, touch and lie inside one another."""
    rng = random.Random(slices)
    events = some_events(rng, 900, [1] * 8 + [2, 3, None])
    parts = [[e for e in events if hash((e[1], i)) % 3 == 0 or i == 3] for i in range(4)]
    seen, dealt = set(), []
    for p in parts:
        dealt.append([e for k, e in enumerate(events) if e in p and k not in seen])
        seen |= {k for k, e in enumerate(events) if e in p}
    assert sum(map(len, dealt)) == len(events)
    fragments = [f for p in dealt for f in brute(p)]
    got = merge_sessions(spark.createDataFrame(fragments, FRAGMENT).repartition(4), slices=slices)
    assert rows(got) == brute(events)


def test_a_fragment_over_many_slices(spark):
    """One fragment that covers the user's whole day takes in all that lie inside it."""
    inside = [(1, T0 + dt.timedelta(minutes=60 * i), T0 + dt.timedelta(minutes=60 * i + 1), 2, 1.0) for i in range(1, 200)]
    whole = (1, T0, T0 + dt.timedelta(minutes=60 * 150), 5, 2.0)
    out = rows(merge_sessions(spark.createDataFrame([*inside, whole], FRAGMENT), slices=16))
    assert out[0] == (1, T0, inside[149][2], 5 + 2 * 150, 2.0 + 150.0) and len(out) == 1 + 49


def write(spark, src, i, events):
    path = os.path.join(src, f"{i:02d}.json")
    with open(path, "w") as f:
        for u, t, v in events:
            f.write(f'{{"user_id": {"null" if u is None else u}, "ts": "{t.isoformat()}", "value": {v}}}\n')
    os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def stream(spark, src, tmp_dir, n=1):
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", n).json(src)
    start_session_stream(events, f"{tmp_dir}/sessions", f"{tmp_dir}/ckpt").awaitTermination(180)


def test_streamed_sessions_equal_the_batch(spark, tmp_dir):
    rng = random.Random(9)
    events = some_events(rng, 400, [1, 1, 1, 2, 3])
    rng.shuffle(events)  # days out of order: far beyond any watermark
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for i in range(4):
        write(spark, src, i, events[i::5])
    stream(spark, src, tmp_dir)
    root = f"{tmp_dir}/sessions"
    assert rows(read_sessions(spark, root)) == brute([e for i in range(4) for e in events[i::5]])
    assert compact_fragments(spark, root) == 3
    write(spark, src, 4, events[4::5])
    stream(spark, src, tmp_dir)
    want = brute(events)
    assert rows(read_sessions(spark, root)) == want
    assert rows(sessionize(spark.read.schema(EVENT).json(src))) == want
    assert compact_fragments(spark, root) == 4 and rows(read_sessions(spark, root)) == want


def test_a_late_event_bridges_two_sessions(spark, tmp_dir):
    src, root = os.path.join(tmp_dir, "in"), f"{tmp_dir}/sessions"
    os.makedirs(src)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    assert read_sessions(spark, root) is None and compact_fragments(spark, root) == -1
    write(spark, src, 0, [(1, at(0), 1.0), (1, at(50), 1.0), (2, at(5000), 1.0)])
    stream(spark, src, tmp_dir)
    assert len(rows(read_sessions(spark, root))) == 3
    write(spark, src, 1, [(1, at(25), 1.0)])
    stream(spark, src, tmp_dir)
    found = {(r.user_id, r.events, r.open) for r in read_sessions(spark, root).collect()}
    assert found == {(1, 3, False), (2, 1, True)}


def test_a_replayed_batch_counts_once(spark, tmp_dir):
    events = [(1, T0, 1.0), (1, T0 + dt.timedelta(minutes=5), 1.0)]
    df = spark.createDataFrame(events, EVENT)
    for _ in range(2):  # what foreachBatch does again after a failure
        sessionize(df).write.mode("overwrite").parquet(f"{tmp_dir}/sessions/fragments/batch=0")
    os.makedirs(f"{tmp_dir}/sessions/fragments/batch=1")  # a batch that was stopped
    assert rows(read_sessions(spark, f"{tmp_dir}/sessions")) == brute(events)
