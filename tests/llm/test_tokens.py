"""Packing and token counts against ``tokenizers`` and brute force."""

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, docs
from tradelens.llm import files
from tradelens.llm.packing import OpenWindows, best_fit_decreasing, pack
from tradelens.llm.queries import QUERIES, table, vocabulary
from tradelens.llm.token_counts import count_tokens, write_token_files
from tradelens.llm.tokenizer import byte_bpe

TEXTS = ["", "plain text", "  lead\n\nÉé 日本語   x", "<|endoftext|> is text here", "it's we'll 123,456 %%%***", "a" * 3000, "​\U0001f600 ퟿"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(spark, reference):
    texts = TEXTS + [r.text for r in table(spark, SF_SMALL, "documents").select("text").collect()]
    encode = byte_bpe(vocabulary()).encode
    for t in texts:
        assert encode(t).tolist() == reference(t)


def brute_best_fit(lengths, size):
    room, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w in range(len(room)) if room[w] >= lengths[i]]
        w = min(fits, key=lambda w: room[w]) if fits else len(room)
        if not fits:
            room.append(size)
        room[w] -= lengths[i]
        where[i] = w
    return sorted(room)


def test_best_fit_decreasing_matches_a_linear_search():
    rng = random.Random(5)
    for size in (1, 7, 64, 2048):
        for _ in range(20):
            lengths = np.array([rng.randint(1, size) for _ in range(rng.randint(0, 120))], dtype=np.int64)
            window, offset, n = best_fit_decreasing(lengths, size)
            used = np.bincount(window, weights=lengths, minlength=n) if len(lengths) else np.zeros(0)
            assert sorted(size - used) == brute_best_fit(lengths.tolist(), size)
            for w in range(n):  # gapless
                at = np.argsort(offset[window == w])
                assert (np.concatenate([[0], np.cumsum(lengths[window == w][at])[:-1]]) == offset[window == w][at]).all()


def test_tightest_window_is_found():
    room = OpenWindows(10)
    for w, c in ((1, 9), (2, 4), (3, 6)):
        room.put(w, c)
    assert room.take_tightest(5) == (3, 6)
    assert room.take_tightest(5) == (1, 9)
    assert room.take_tightest(5) is None
    assert room.take_tightest(1) == (2, 4)


def check_pieces(pieces, texts, reference, size):
    """Every id in exactly one piece; sequences gapless within ``size``."""
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        ids = np.array(reference(texts[i]) + [1], dtype="<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return sum(r.length for r in pieces) / (size * len(by_seq))


def test_packing_query(spark, reference):
    texts = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    assert check_pieces(QUERIES["op3_packing"](spark, SF_SMALL).collect(), texts, reference, 2048) > 0.95


def test_packing_cases(spark, reference):
    texts = {1: None, 2: "", 3: "word " * 5000, None: "no id", 5: "a b c", 6: "a b c"}
    df = clashing(docs(spark, list(texts.items())))
    rows = pack(df, vocabulary(), size=64, keep_ids=True).collect()
    check_pieces(rows, texts, reference, 64)
    assert [r.ids for r in rows if r.doc_id == 1] == [[1]]
    again = pack(docs(spark, [(1, "x"), (1, "x")]), vocabulary(), size=8).collect()
    assert len(again) == 2 and len({(r.sequence_id, r.offset) for r in again}) == 2
    assert pack(docs(spark, []), vocabulary()).collect() == []


def test_packing_gives_special_tokens_as_the_library_does(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    texts = {i: t for i, t in enumerate([*TEXTS, "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|", "a" * 3000 + "<|endoftext|>"])}
    library = lambda x: plain.encode(x, add_special_tokens=False).ids
    assert library("a<|endoftext|>b") == [64, 50256, 65]
    rows = pack(docs(spark, list(texts.items())), vocabulary(), size=64).collect()
    check_pieces(rows, texts, library, 64)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("width", [2, 4])
def test_separator_scan_matches_splitting(spark, tmp_dir, monkeypatch, block, width):
    monkeypatch.setattr("tradelens.llm.token_counts.RUN", 3)
    streams = [[], [9], [9, 9], [1, 2, 9, 3], [4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 9, 9, 1, 9, 2, 2], [1, 2, 3]]
    rows, want = [], set()
    for n, ids in enumerate(streams):
        uri = f"{tmp_dir}/f{n}.bin"
        with files.open_output(uri) as f:
            f.write(np.array(ids, dtype=f"<u{width}").tobytes())
        rows.append((uri, len(ids) * width))
        start = 0
        ends = [i for i, x in enumerate(ids) if x == 9]
        for k, e in enumerate(ends):
            want.add((uri, k, start, e - start, True))
            start = e + 1
        if start < len(ids):
            want.add((uri, len(ends), start, len(ids) - start, False))
    got = count_tokens(spark.createDataFrame(rows, "file string, bytes long"), end_id=9, width=width, block_tokens=block)
    assert {tuple(r) for r in got.select("file", "ordinal", "start", "n_tokens", "terminated").collect()} == want


def test_token_counts_of_documents(spark, reference):
    texts = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, SF_SMALL).collect()}
    assert got == {i: len(reference(t)) for i, t in texts.items()}


def test_token_files_cases(spark):
    df = clashing(docs(spark, [(1, None), (2, ""), (None, "<|endoftext|> a"), (2, "b")]))
    token_files, places = write_token_files(df, vocabulary(), end_id=50256)
    out = count_tokens(token_files, 50256).join(places, ["file", "ordinal"]).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in out) == [(0, True), (1, False), (2, False), (2, True)]
    token_files, places = write_token_files(docs(spark, []), vocabulary(), end_id=50256)
    assert count_tokens(token_files, 50256).collect() == []


def test_object_store_schemes(monkeypatch):
    asked = []
    known = SimpleNamespace(from_uri=lambda uri: asked.append(uri) or (None, uri))
    monkeypatch.setattr(files, "fs", SimpleNamespace(LocalFileSystem=files.fs.LocalFileSystem, FileSystem=known))
    for uri in ("s3a://bucket/a/b", "s3n://bucket/a", "hdfs://host:1/a", "gs://bucket/a"):
        files.filesystem(uri)
    assert asked == ["s3://bucket/a/b", "s3://bucket/a", "hdfs://host:1/a", "gs://bucket/a"]
    assert files.filesystem("file:/tmp/x")[1] == files.filesystem("/tmp/x")[1] == "/tmp/x"
