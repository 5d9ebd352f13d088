"""Language identification by prediction by partial matching (operator 9).

Per language a variable-order byte context tree holds how often each byte
followed each context of up to ``ORDER`` bytes.  A byte's code length is that
of PPM with escape method C and full exclusion under frozen counts: in the
longest context known to the language, a byte seen there costs
log2((total + distinct) / count); an unseen byte costs the escape
log2((total + distinct) / distinct) and is coded in the next shorter context,
whose counts leave out the bytes already excluded; below order 0 all
remaining byte values are equally likely.  A text belongs to the language
that codes it in the fewest bits.

Training counts n-grams of a bounded sample of labelled documents
(``TRAIN_DOCS`` per language, drawn by hash at a rate found from the label
counts); the counts of that sample are the only thing that reaches the
driver.  Scoring walks the union of the trees as an automaton with numpy
look-ups, one step per byte for all languages at once; n-grams no tree knows
are coded exactly by the rule above.

Defined results: ``und`` with score 0 for a null text, a text without any
letter, and if nothing could be learned; ties go to the first language in
alphabetical order; repeated rows get equal results; a null id is learned
from and scored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.llm.common import named

ORDER = 3
TRAIN_DOCS = 3000
CHUNK = 1 << 18  # bytes scored at once
SLICE = 512  # texts scored at once
PAD = b"\n" * ORDER  # context before the first byte
UNDETERMINED = "und"


def _gram_keys(docs: list[bytes]) -> np.ndarray:
    """Every byte with its context, as one integer of ORDER + 1 bytes."""
    a = np.frombuffer(b"".join(PAD + d for d in docs), dtype=np.uint8).astype(np.uint32)
    key = np.zeros(len(a) - ORDER, dtype=np.uint32)
    for j in range(ORDER + 1):
        key = (key << np.uint32(8)) | a[j : len(a) - ORDER + j]
    real = np.ones(len(a), dtype=bool)
    at = 0
    for d in docs:
        real[at : at + ORDER] = False
        at += ORDER + len(d)
    return key[real[ORDER:]]


def _rows_of(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Row of each key in a sorted table, -1 if absent."""
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, i, -1)


class PpmModel:
    """Frozen context trees of all languages."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        width = len(langs)
        grams, row = np.unique(gram.astype(np.uint32), return_inverse=True)
        full = np.zeros((len(grams), width))
        np.add.at(full, (row, lang), n)
        # per order k: n-grams of k + 1 bytes, their contexts, totals and distinct followers
        self.grams, self.counts, self.ctxs, self.total, self.distinct, self.after_escape = [], [], [], [], [], []
        for k in range(ORDER + 1):
            keys, r = np.unique(grams & np.uint32(2 ** (8 * (k + 1)) - 1), return_inverse=True)
            c = np.zeros((len(keys), width))
            np.add.at(c, r, full)
            ctx, cr = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, distinct = np.zeros((len(ctx), width)), np.zeros((len(ctx), width))
            np.add.at(total, cr, c)
            np.add.at(distinct, cr, c > 0)
            self.grams.append(keys)
            self.counts.append(c)
            self.ctxs.append(ctx)
            self.total.append(total)
            self.distinct.append(distinct)
            if k:  # weight left in the next shorter context once this context's bytes are excluded
                shorter = _rows_of(self.grams[k - 1], keys & np.uint32(2 ** (8 * k) - 1))
                excluded = np.zeros((len(ctx), width))
                np.add.at(excluded, cr, np.where(c > 0, self.counts[k - 1][shorter], 0))
                up = _rows_of(self.ctxs[k - 1], ctx & np.uint32(2 ** (8 * (k - 1)) - 1))
                self.after_escape.append(self.total[k - 1][up] - excluded + self.distinct[k - 1][up] - distinct)
            else:
                self.after_escape.append(np.zeros((len(ctx), width)))
        self._automaton()

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each key's last byte after its context, per language."""
        shape = (len(keys), len(self.langs))
        bits, done, escaped = np.zeros(shape), np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        left, known = np.zeros(shape), np.zeros(shape)  # weight after the last escape, bytes excluded by it

        def at(table: np.ndarray, row: np.ndarray) -> np.ndarray:
            return np.where((row >= 0)[:, None], table[row], 0)

        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(ORDER, -1, -1):
                gram = keys & np.uint32(2 ** (8 * (k + 1)) - 1)
                g, c = _rows_of(self.grams[k], gram), _rows_of(self.ctxs[k], gram >> np.uint32(8))
                n, total, distinct = at(self.counts[k], g), at(self.total[k], c), at(self.distinct[k], c)
                weight = np.where(escaped, left, total + distinct)
                active = ~done & (total > 0)
                seen = active & (n > 0)
                bits += np.where(seen, np.log2(weight) - np.log2(n), 0)
                done |= seen
                leave = active & ~seen
                bits += np.where(leave & (weight > 0), np.log2(weight) - np.log2(distinct - np.where(escaped, known, 0)), 0)
                left, known = np.where(leave, at(self.after_escape[k], c), left), np.where(leave, distinct, known)
                escaped |= leave
        return bits + np.where(done, 0, np.log2(np.maximum(256 - known, 1)))

    def _automaton(self) -> None:
        """Step tables: byte class, then n-gram number from the preceding one and a byte."""
        self.byte = np.zeros(256, dtype=np.int64)
        used = np.unique(self.grams[ORDER].view(np.uint8))
        self.byte[used] = np.arange(1, len(used) + 1)
        size = len(used) + 1
        self.size = size
        self.steps = []
        for k in range(1, ORDER + 1):
            last, head = self.byte[self.grams[k] & np.uint32(255)], self.grams[k] >> np.uint32(8)
            before = self.byte[head] if k == 1 else _rows_of(self.grams[k - 1], head) + 1
            ok = before > 0
            step = np.zeros((size if k == 1 else len(self.grams[k - 1]) + 1) * size, dtype=np.int32)
            step[before[ok] * size + last[ok]] = np.flatnonzero(ok) + 1
            self.steps.append(step)
        self.known_bits = np.vstack([np.zeros((1, len(self.langs))), self.code_lengths(self.grams[ORDER])])

    def text_bits(self, docs: list[bytes]) -> np.ndarray:
        """Code length of each text per language, texts of any length in chunks."""
        out = np.zeros((len(docs), len(self.langs)))
        chunk = max(1 << 14, CHUNK * 4 // max(4, len(self.langs)))
        owner: list[int] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> None:
            raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
            a = self.byte[raw]
            state = a
            for step in self.steps:  # state[i]: number of the n-gram that ends at i
                nxt = np.zeros(len(a), dtype=np.int64)
                nxt[1:] = step[state[:-1] * self.size + a[1:]]
                state = nxt
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) - ORDER for p in parts]
            bits = np.zeros((len(a) + 1, len(self.langs)))
            np.take(self.known_bits, state, axis=0, out=bits[:-1])
            scored = np.zeros(len(a) + 1, dtype=np.int32)
            np.add.at(scored, starts, 1)
            np.add.at(scored, ends, -1)
            odd = np.flatnonzero((state == 0) & (np.cumsum(scored)[:-1] > 0))
            if len(odd):
                key = np.zeros(len(odd), dtype=np.uint32)
                for j in range(ORDER, -1, -1):
                    key = (key << np.uint32(8)) | raw[odd - j].astype(np.uint32)
                fresh, back = np.unique(key, return_inverse=True)
                bits[odd] = self.code_lengths(fresh)[back]
            np.add.at(out, owner, np.add.reduceat(bits, np.column_stack([starts, ends]).ravel(), axis=0)[::2])

        for i, d in enumerate(docs):
            for lo in range(0, len(d), chunk):
                parts.append((PAD if lo == 0 else d[lo - ORDER : lo]) + d[lo : lo + chunk])
                owner.append(i)
                held += len(parts[-1])
                if held >= chunk:
                    flush()
                    owner, parts, held = [], [], 0
        if parts:
            flush()
        return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text.encode("utf-8"))
        for lang, docs in by_lang.items():
            gram, n = np.unique(_gram_keys(docs), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), type=pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> PpmModel | None:
    """Learn from rows where ``learn`` holds, text and label are given: at
    most about ``train_docs`` documents a language.  None without any."""
    rows = docs.filter(F.coalesce(learn, F.lit(False)) & named(text_col).isNotNull() & named(lang_col).isNotNull())
    rows = rows.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"), named(lang_col).cast("string").alias("lang"))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not have:
        return None
    langs = sorted(have)
    rate = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, train_docs / have[lang])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.filter(draw < rate[F.col("lang")]).select("lang", "text")
    grams = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if grams.empty:
        return None
    number = grams["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy()
    return PpmModel(langs, number, grams["gram"].to_numpy(), grams["n"].to_numpy())


def predict(docs: DataFrame, model: PpmModel | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` (share of the best language in
    2 ** -bits), ``bits_per_byte`` of the best language, and with ``carry`` the
    input row as struct ``row``."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"), *([F.struct(*[named(c) for c in docs.columns]).alias("row")] if carry else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, len(whole), SLICE)):
            texts = b.column("text").to_pylist()
            lang, score, per_byte = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            todo = [i for i, t in enumerate(texts) if m is not None and t is not None and any(c.isalpha() for c in t)]
            raw = [texts[i].encode("utf-8") for i in todo]
            if todo:
                bits = m.text_bits(raw)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                for j, i in enumerate(todo):
                    lang[i], score[i], per_byte[i] = m.langs[best[j]], float(share[j]), float(bits[j, best[j]] / len(raw[j]))
            cols = [b.column("doc_id"), pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(per_byte, type=pa.float64())]
            names = ["doc_id", "lang_pred", "score", "bits_per_byte"]
            if carry:
                cols, names = [*cols, b.column("row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    if carry:
        schema.add(rows.schema["row"])
    return rows.mapInArrow(run, schema)
