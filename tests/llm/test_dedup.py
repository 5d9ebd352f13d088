"""Exact, SimHash and line de-duplication against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tests.llm.helpers import by_id, clashing, docs
from tradelens.llm.exact_dedup import exact_dedup
from tradelens.llm.graph import components
from tradelens.llm.line_dedup import PerfectHash, Shard, line_dedup
from tradelens.llm.queries import QUERIES, table
from tradelens.llm.simhash import block_masks, near_links, simhash_dedup, spanning_links, text_fingerprint

LONG = "word " * 60_000


def test_exact_dedup_cases(spark):
    same = "x" * 80
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (7, same + "1"), (8, same + "2"), (6, same + "1"), (None, "a b"), (4, LONG), (10, LONG), (11, "a b")]
    got = by_id(exact_dedup(docs(spark, rows), digest_all=True))
    assert (got[5].keep_id, got[3].keep_id, got[None].keep_id, got[3].group_size) == (3, 3, 3, 3)
    assert got[3].kept and not got[5].kept and not got[None].kept
    assert got[9].keep_id == 9  # a trailing run becomes one space, it is not trimmed
    assert (got[2].keep_id, got[1].keep_id, got[1].group_size) == (1, 1, 2)
    assert (got[7].keep_id, got[8].keep_id, got[6].keep_id) == (6, 8, 6)
    assert (got[10].keep_id, got[11].keep_id) == (4, 11)
    assert got[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    # texts the first levels prove unique are not hashed unless asked for
    assert by_id(exact_dedup(docs(spark, rows)))[11].text_sha256 is None


def test_exact_dedup_repeated_rows_and_clashing_columns(spark):
    df = clashing(docs(spark, [(1, "a"), (1, "a"), (1, "b"), (2, "a")]))
    out = exact_dedup(df, carry=True).collect()
    assert sorted((r.doc_id, r.kept, r.group_size) for r in out) == [(1, False, 3), (1, True, 1), (1, True, 3), (2, False, 3)]
    kept = exact_dedup(df, carry=True).filter("kept").select("row.*")
    assert kept.columns == df.columns and kept.count() == 2


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_simhash_dedup", "op4_line_dedup"])
def test_empty_table(spark, tmp_dir, name):
    docs(spark, []).write.parquet(f"{tmp_dir}/documents.parquet")
    assert QUERIES[name](spark, tmp_dir).collect() == []


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    import xxhash

    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_classes(values, distance):
    """id -> smallest id reachable over links of at most ``distance`` bits."""
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        if (values[a] ^ values[b]).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C", "É é A", "a\x0bb\x0cc d", "x y z " * 50, "a b c d"])
def test_fingerprint_matches_brute_force(text):
    assert text_fingerprint(text, 3) == brute_fingerprint(text)


def test_simhash_query_matches_brute_force(spark):
    rows = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    want = brute_classes(fps, 3)
    got = by_id(QUERIES["op2_simhash_dedup"](spark, SF_SMALL))
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_cases(spark):
    df = clashing(docs(spark, [(4, None), (3, ""), (None, " "), (5, "one two three four"), (5, "one two three four"), (6, "One Two three four"), (7, LONG)]))
    got = simhash_dedup(df, carry=True).collect()
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    assert sorted(r.kept for r in got if r.component_id == 5) == [False, False, True]
    assert simhash_dedup(df, carry=True).filter("kept").select("row.*").columns == df.columns


def test_blocks_cover_every_close_pair():
    rng, masks = random.Random(1), block_masks(3)
    assert len(masks) == 20
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_links_connect_chains_and_hot_groups(spark, monkeypatch):
    # chains of three-bit steps, a ball of near values around one centre, and noise; tiles of 16 force the split
    monkeypatch.setattr("tradelens.llm.simhash.TILE", 16)
    rng = random.Random(7)
    values = {0, (1 << 64) - 1}
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(6):
            values.add(x)
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a, b in combinations(range(20), 2)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.u: r.v for r in components(near_links(df, 3)).collect()}
    want = brute_classes({s[0]: int(np.int64(s[0]).view(np.uint64)) for s in signed}, 3)
    assert {s[0]: roots.get(s[0], s[0]) for s in signed} == want


def test_spanning_links_are_few():
    ball = np.array([(1 << a) ^ (1 << b) for a, b in combinations(range(30), 2)], dtype=np.uint64)
    links = spanning_links(ball, 3)
    assert len(links) == len(ball) - 1


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**64, (20_000, 2), dtype=np.uint64)
    known, other = h[:10_000], h[10_000:]
    known[1, 0] = known[0, 0]  # halves may repeat, pairs may not
    ph = PerfectHash.build(known[:, 0], known[:, 1])
    assert sorted(ph.slots(known[:, 0], known[:, 1])) == list(range(len(known)))
    shard = Shard.load(Shard.build(known[:, 0], known[:, 1], np.arange(len(known)) + 2).dump())
    assert (shard.counts(known[:, 0], known[:, 1]) == np.arange(len(known)) + 2).all()
    assert not shard.counts(other[:, 0], other[:, 1]).any()


def test_line_dedup_cases(spark):
    rows = [(i, f"own {i}\n  Shared LINE\t\nÉ x\n\n\ntail\r") for i in range(10)]
    rows += [(20, None), (21, ""), (22, "shared line"), (23, "é x\nown 3"), (24, "\n".join(["shared line"] * 5)), (None, "a\nshared line\nb"), (25, LONG)]
    got = by_id(line_dedup(clashing(docs(spark, rows)), min_docs=10))
    assert (got[0].n_lines, got[0].n_dropped, got[0].kept_text) == (6, 3, "own 0\n\n")
    assert (got[20].n_lines, got[20].n_dropped, got[20].kept_text) == (1, 0, "")
    assert (got[21].n_lines, got[22].n_dropped, got[22].kept_text) == (1, 1, "")
    assert (got[23].n_dropped, got[24].n_dropped, got[24].kept_text) == (0, 5, "")  # only A-Z are folded
    assert got[None].kept_text == "a\nb"
    assert got[25].kept_text == LONG
    # a line met twice in one document counts once
    assert by_id(line_dedup(docs(spark, [(1, "a\na"), (2, "a")]), min_docs=3))[1].n_dropped == 0
    with pytest.raises(ValueError):
        line_dedup(docs(spark, rows), min_docs=1)


def test_line_index_is_read_once_a_block(spark, monkeypatch):
    """With room for one shard only, a block loads every shard once, whatever its number of batches."""
    import pyarrow as pa

    from tradelens.llm import line_dedup as LD

    monkeypatch.setattr(LD, "KEYS_PER_SHARD", 16)
    texts = ["\n".join(f"line {(i * 7 + k) % 300}" for k in range(20)) for i in range(120)]
    df = docs(spark, list(enumerate(texts)))
    uris = LD.build_line_index(df, min_chars=1, index_from=3)
    assert len(uris) > 10
    loads = []
    monkeypatch.setattr(LD, "CACHE_BYTES", 1)
    monkeypatch.setattr(LD.files, "read_all", lambda uri, plain=LD.files.read_all: loads.append(uri) or plain(uri))
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in enumerate(texts)]

    def run():
        LD._CACHE.clear()
        loads.clear()
        shared = type("shared", (), {"value": uris})
        return [r for b in LD._probe(shared, 3, 1)(iter(batches)) for r in b.to_pylist()]

    whole = run()
    assert len(loads) == len(set(loads)) <= len(uris)
    monkeypatch.setattr(LD, "BLOCK_BYTES", 1)  # a block per batch
    assert run() == whole and len(loads) > 5 * len(uris)
    counts = Counter(x for t in texts for x in set(t.split("\n")))
    assert {r["doc_id"]: r["kept_text"] for r in whole} == {i: "\n".join(x for x in t.split("\n") if counts[x] < 3) for i, t in enumerate(texts)}
