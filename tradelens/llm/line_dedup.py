"""Line de-duplication over a sharded minimal perfect hash (operator 4).

1. Count: every line's 128-bit key hash, once per document, summed with
   map-side partials (a task sends one row per distinct line it met).
2. Index: distinct hashes of lines found in at least ``min_docs`` documents
   are dealt into shards of about ``KEYS_PER_SHARD``; one task per shard
   builds a minimal perfect hash (levels of bit arrays with rank counts, as
   BBHash) that numbers the shard's hashes without gaps, and two compact
   arrays indexed by that number: the 64-bit fingerprint and the document
   count.  Shards are files in the shared folder.
3. Probe: documents are read again in blocks of ``BLOCK_BYTES`` of text; the
   lines of a block look up fingerprint and count shard by shard, so however
   large the index is, a shard is loaded at most once a block.  Loaded shards
   are held within ``CACHE_BYTES`` per worker.  Lines are never joined or
   shuffled with their documents.

A line in fewer documents stays wherever it is, so it is not indexed; probing
it ends at no slot or at a slot whose fingerprint differs (hash halves
together: 128 bits), and it counts as none.

Defined results: a null or empty text is one empty line; a key below
``min_chars`` code points is never dropped; repeated rows are documents of
their own; if all lines go the kept text is empty; a very long text is one block; a
line at the threshold in exactly ``min_docs`` documents goes; extra columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm import files
from tradelens.llm.common import cut, named, scratch_dir

INDEX_FROM = 2
KEYS_PER_SHARD = 1 << 17
CACHE_BYTES = 256 << 20
BLOCK_BYTES = 96 << 20
GAMMA = 2.0
ASCII_BLANKS = " \t\n\x0b\f\r"


# ------------------------------------------------------------ minimal perfect hash


def _mix(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """64-bit finaliser over both hash halves and the level."""
    with np.errstate(over="ignore"):
        x = hi ^ (lo * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD1B54A32D192ED03) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers a fixed set of 128-bit hashes 0 .. n-1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.rank = (np.cumsum(counts) - counts).astype(np.uint32)

    @staticmethod
    def build(hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """Distinct (hi, lo) only.  A level keeps the hashes that land alone;
        the others go on to the next level."""
        sizes, words, level = [], [], 0
        while len(hi):
            m = 64 * max(1, int(np.ceil(GAMMA * len(hi) / 64)))
            pos = (_mix(hi, lo, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(pos, minlength=m) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(m)
            rest = ~alone[pos]
            hi, lo, level = hi[rest], lo[rest], level + 1
        return PerfectHash(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, dtype="<u8"))

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each hash of the set; -1 or any slot for others."""
        out = np.full(len(hi), -1, dtype=np.int64)
        open_ = np.arange(len(hi))
        for level, m in enumerate(self.sizes):
            if not len(open_):
                break
            pos = self.starts[level] + (_mix(hi[open_], lo[open_], level) % np.uint64(m)).astype(np.int64)
            word, bit = pos >> 6, (pos & 63).astype(np.uint64)
            w = self.words[word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.rank[word[hit]].astype(np.int64) + below
            open_ = open_[~hit]
        return out


class Shard:
    """A perfect hash with its fingerprint and count arrays."""

    def __init__(self, ph: PerfectHash, fingerprint: np.ndarray, count: np.ndarray):
        self.ph, self.fingerprint, self.count = ph, fingerprint, count
        self.nbytes = ph.words.nbytes + ph.rank.nbytes + fingerprint.nbytes + count.nbytes

    @staticmethod
    def build(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Shard:
        ph = PerfectHash.build(hi, lo)
        slot = ph.slots(hi, lo)
        fingerprint, count = np.zeros(len(hi), dtype=np.uint64), np.zeros(len(hi), dtype=np.uint32)
        fingerprint[slot], count[slot] = lo, np.minimum(n, 2**32 - 1)
        return Shard(ph, fingerprint, count)

    def counts(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slot = self.ph.slots(hi, lo)
        known = slot >= 0
        known[known] = self.fingerprint[slot[known]] == lo[known]
        out = np.zeros(len(hi), dtype=np.uint32)
        out[known] = self.count[slot[known]]
        return out

    def dump(self) -> bytes:
        buf = io.BytesIO()
        np.savez(buf, sizes=self.ph.sizes, words=self.ph.words, fingerprint=self.fingerprint, count=self.count)
        return buf.getvalue()

    @staticmethod
    def load(data: bytes) -> Shard:
        z = np.load(io.BytesIO(data))
        return Shard(PerfectHash(z["sizes"], z["words"]), z["fingerprint"], z["count"])


_CACHE: OrderedDict[str, Shard] = OrderedDict()  # per Python worker


def _shard(uri: str) -> Shard:
    if uri in _CACHE:
        _CACHE.move_to_end(uri)
    else:
        _CACHE[uri] = Shard.load(files.read_all(uri))
        while len(_CACHE) > 1 and sum(s.nbytes for s in _CACHE.values()) > CACHE_BYTES:
            _CACHE.popitem(last=False)
    return _CACHE[uri]


# ------------------------------------------------------------ lines


def line_key(line: str) -> str:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(ASCII_BLANKS).encode("utf-8").lower().decode("utf-8")


def _hashed(texts: pa.Array, min_chars: int) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; for all lines in order their document's number,
    (hi, lo) hash, and whether the key is long enough to count."""
    from xxhash import xxh3_128_digest

    lines = [(t.as_py() or "").split("\n") for t in texts]
    keys = [line_key(x) for doc in lines for x in doc]
    h = np.frombuffer(b"".join(xxh3_128_digest(k.encode("utf-8")) for k in keys), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    doc = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    counts = np.fromiter((len(k) >= min_chars for k in keys), dtype=bool, count=len(keys))
    return lines, doc, h, counts


def _count_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            _, doc, h, ok = _hashed(b.column("text"), min_chars)
            once = np.unique(np.column_stack([doc[ok].astype(np.uint64), h[ok]]), axis=0)
            keys, n = np.unique(once[:, 1:], axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(n.astype(np.int64))], ["hi", "lo", "n"])

    return run


def _build_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got)
        number = t.column("shard").to_numpy()
        hi, lo, n = (t.column(c).to_numpy() for c in ("hi", "lo", "n"))
        out = []
        for s in np.unique(number):
            own = number == s
            data = Shard.build(hi[own].view(np.uint64), lo[own].view(np.uint64), n[own]).dump()
            uri = files.attempt_name(folder, f"shard-{s:06d}")
            with files.open_output(uri) as f:
                f.write(data)
            out.append((int(s), uri, int(own.sum()), len(data)))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["shard", "uri", "keys", "bytes"])

    return run


def build_line_index(docs: DataFrame, text_col: str = "text", min_chars: int = 1, index_from: int = INDEX_FROM) -> list[str]:
    """Count lines over all documents and build the shards; their file URIs, by shard number."""
    spark = docs.sparkSession
    texts = docs.select(named(text_col).cast("string").alias("text"))
    met = texts.mapInArrow(_count_lines(min_chars), "hi long, lo long, n long")
    counts = cut(met.groupBy("hi", "lo").agg(F.sum("n").alias("n")).filter(F.col("n") >= index_from), "line-counts")
    shards = max(1, -(-counts.count() // KEYS_PER_SHARD))
    folder = scratch_dir(spark, "line-index")
    # hi is a uniform hash: its low bits deal equal shards
    dealt = counts.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("long")).repartition(shards, "shard")
    made = cut(dealt.mapInArrow(_build_shards(folder), "shard long, uri string, keys long, bytes long"), "line-shards")
    uris = {r["shard"]: r["uri"] for r in made.select("shard", "uri").collect()}  # one short row per shard
    return [uris.get(s, "") for s in range(shards)]


def _counts_of(shard_uris: list[str], h: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Documents of each line hash, shard by shard."""
    found = np.zeros(len(h), dtype=np.uint32)
    number = np.where(ok, h[:, 0].view(np.int64) % len(shard_uris), -1)
    order = np.argsort(number, kind="stable")
    at = np.searchsorted(number[order], np.arange(len(shard_uris) + 1))
    for s in np.unique(number[ok]):
        own = order[at[s] : at[s + 1]]
        if shard_uris[s]:
            found[own] = _shard(shard_uris[s]).counts(h[own, 0], h[own, 1])
    return found


def _probe(shard_uris, min_docs: int, min_chars: int):
    """``shard_uris`` is a broadcast list."""

    def kept(b: pa.RecordBatch, doc: np.ndarray, drop: np.ndarray) -> pa.RecordBatch:
        n_lines = np.bincount(doc, minlength=len(b)).astype(np.int64)
        n_dropped = np.bincount(doc[drop], minlength=len(b)).astype(np.int64)
        texts, at = [], 0
        for t, n, gone in zip(b.column("text"), n_lines, n_dropped, strict=True):
            text = t.as_py() or ""
            texts.append("\n".join(y for y, d in zip(text.split("\n"), drop[at : at + n], strict=True) if not d) if gone else text)
            at += n
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_lines), pa.array(n_dropped), pa.array(texts, type=pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    def probed(block: list) -> Iterator[pa.RecordBatch]:
        found = _counts_of(shard_uris.value, np.concatenate([h for _, _, h, _ in block]), np.concatenate([ok for *_, ok in block]))
        at = 0
        for b, doc, h, _ in block:
            yield kept(b, doc, found[at : at + len(h)] >= min_docs)
            at += len(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for b in batches:
            if not len(b):
                continue
            _, doc, h, ok = _hashed(b.column("text"), min_chars)
            block.append((b, doc, h, ok))  # texts stay in Arrow, lines are split again when they are kept
            size += b.nbytes
            if size >= BLOCK_BYTES:
                yield from probed(block)
                block, size = [], 0
        if block:
            yield from probed(block)

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop every line whose key occurs in at least ``min_docs`` documents:
    ``doc_id, n_lines, n_dropped, kept_text`` per row."""
    if min_docs < INDEX_FROM:
        raise ValueError(f"min_docs below {INDEX_FROM} would drop every line")
    uris = docs.sparkSession.sparkContext.broadcast(build_line_index(docs, text_col, min_chars, min_docs))
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_probe(uris, min_docs, min_chars), f"doc_id {id_type}, n_lines long, n_dropped long, kept_text string")
