"""Toxicity by maximum-scoring segments of token log-odds (operator 10).

1. Log-odds: over a bounded sample of labelled documents, how often each
   feature (a word, or the first ``STEM`` letters of a longer word) occurs in
   toxic and in other documents; the log-odds ratio under a symmetric
   Dirichlet prior and its z-score.  Features with a z-score of ``MIN_Z`` and
   a ratio of ``MIN_RATIO`` or more carry their ratio;
   a word takes its own ratio, else its stem's.  Every token pays ``DRIFT``,
   so text without such features scores below zero.
2. Passages: one linear scan (Ruzzo and Tompa, 1999) finds all maximal
   scoring segments of the token scores.
3. Extreme-value calibration (Karlin and Altschul): lambda solves
   sum p * exp(lambda * s) = 1 under the clean sample's score distribution, K
   is the rate at which clean sample text gives segments.  A segment of
   score S in a text of m tokens has E = K * m * exp(-lambda * S) and is a
   significant toxic passage below ``MAX_E``.
4. The document's normalised passage scores, -ln E summed and maximum, and
   the number and density of passages give its score by a logistic model
   fitted on the same sample.

Only features, segment scores and labels of the bounded sample reach the
driver.  Every text is scored whole.

Defined results: a null or empty text has no passage and gets the score of
one; without any usable label every score is 0; a document with several label
rows counts as toxic if one says so; repeated rows get equal results; a null
id is scored but has no label; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut, named

TRAIN_DOCS = 10_000  # of each class
STEM = 4
PRIOR = 0.5
MIN_Z = 3.0
MIN_RATIO = 3.0
DRIFT = 0.25
MAX_E = 0.05

_WORD = re.compile(r"\w+")


def features_of(words: list[str]) -> list[str]:
    """Words, and stems of longer words marked by a trailing star."""
    return words + [w[:STEM] + "*" for w in words if len(w) > STEM]


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that is ``scores`` at
    ``places`` and ``-drift`` elsewhere: (first place, last place, score).

    Ruzzo and Tompa's list of candidates with the cumulative scores left and
    right of each; a candidate also knows the nearest earlier one whose left
    sum is smaller, so the search back skips those in between."""
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest smaller
    total, last = 0.0, -1
    for at, s in zip(places, scores, strict=True):
        total -= drift * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        first, before = at, total
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
        found.append((first, at, before, total, j))
    return [(c[0], c[1], c[3] - c[2]) for c in found]


@dataclass
class ToxicModel:
    ratio: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    weights: np.ndarray | None = None
    base: float = 0.0

    def tokens(self, text: str) -> tuple[int, list[int], list[float]]:
        """Number of tokens, places and scores of those with log-odds."""
        words = _WORD.findall(text.lower())
        get, places, scores = self.ratio.get, [], []
        for i, w in enumerate(words):
            r = get(w)
            if r is None and len(w) > STEM:
                r = get(w[:STEM] + "*")
            if r is not None:
                places.append(i)
                scores.append(r - DRIFT)
        return len(words), places, scores

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        n, places, scores = self.tokens(text)
        return n, maximal_segments(places, scores, DRIFT) if places else []

    def e_value(self, n_tokens: int, score: float) -> float:
        return self.k * max(1, n_tokens) * float(np.exp(-self.lam * score))

    def evidence(self, n_tokens: int, scores: list[float]) -> list[float]:
        """Inputs of the logistic model."""
        norm = [-np.log(max(e, 1e-300)) for e in (self.e_value(n_tokens, s) for s in scores) if e < MAX_E]
        return [1.0, np.log1p(sum(norm)), np.log1p(max(norm, default=0.0)), np.log1p(len(norm)), np.log1p(100 * len(norm) / max(1, n_tokens))]

    def score(self, n_tokens: int, scores: list[float]) -> float:
        if self.weights is None:
            return self.base
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.evidence(n_tokens, scores)), -30, 30))))


def _fit_lambda(values: np.ndarray, share: np.ndarray) -> float:
    """Positive root of sum share * exp(lambda * value) = 1 (mean below zero)."""
    lo, hi = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps of the ridge-penalised logistic likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts[toxic].update(features_of(_WORD.findall((text or "").lower())))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), *(pa.array([counts[c][f] for f in names], type=pa.int64()) for c in (1, 0))], ["feature", "n1", "n0"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> ToxicModel:
    """Fit on at most about ``train_docs`` labelled documents of each class.
    ``learn`` is a condition over the label table (which documents may be learned from)."""
    own = labels.filter(F.coalesce(learn, F.lit(False)) & named(label_col).isNotNull() & named(label_id_col).isNotNull())
    own = own.groupBy(named(label_id_col).alias("label_id")).agg(F.max(F.when(named(label_col) > 0, 1).otherwise(0)).alias("toxic"))
    have = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = ToxicModel()
    if not have:
        return model
    model.base = have.get(1, 0) / sum(have.values())
    if len(have) < 2:
        return model
    rate = F.when(F.col("toxic") == 1, min(1.0, train_docs / have[1])).otherwise(min(1.0, train_docs / have[0]))
    own = own.filter(F.pmod(F.xxhash64("label_id", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(1 << 30) < rate)
    # about 2 * train_docs rows of an id and a flag, whatever the input's size
    sample = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("label_id")).select("toxic", "text")

    counts = sample.mapInArrow(_count_features, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = cut(counts.withColumn("stem", F.col("feature").endswith("*")), "toxic-features")
    total = {r["stem"]: r for r in counts.groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count(F.lit(1)).alias("v")).collect()}
    word = total.get(False)
    if word is None or not word["n1"] or not word["n0"]:
        return model
    n0 = float(word["n0"])
    mass = {c: F.when(F.col("stem"), float(total[True][c] if True in total else 0) + PRIOR * (total[True]["v"] if True in total else 0)).otherwise(float(word[c]) + PRIOR * word["v"]) for c in ("n1", "n0")}
    a1, a0 = F.col("n1") + PRIOR, F.col("n0") + PRIOR
    delta = F.log(a1 / (mass["n1"] + PRIOR - a1)) - F.log(a0 / (mass["n0"] + PRIOR - a0))
    kept = counts.filter("n1 > 0").select("feature", "stem", "n0", delta.alias("delta"), (delta / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
    kept = kept.filter((F.col("z") >= MIN_Z) & (F.col("delta") >= MIN_RATIO))
    kept = kept.toPandas()
    model.ratio = dict(zip(kept["feature"], kept["delta"], strict=True))

    # score distribution of clean text: words that carry a ratio, the rest pays the drift
    words = kept[~kept["stem"]]
    share = (words["n0"].to_numpy() + 0.5) / (n0 + 0.5 * len(words) + 1)
    values = np.append(words["delta"].to_numpy() - DRIFT, -DRIFT)
    model.lam = _fit_lambda(values, np.append(share, max(1e-9, 1 - share.sum())))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.segments(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array([n for n, _ in got], type=pa.int64()), pa.array([[s for _, _, s in seg] for _, seg in got], type=pa.list_(pa.float64()))], ["toxic", "n", "scores"]
            )

    seen = sample.mapInArrow(measure, "toxic int, n long, scores array<double>").toPandas()
    clean = seen[seen["toxic"] == 0]
    found = np.concatenate([np.zeros(0), *clean["scores"]])
    low = found.min() if len(found) else 0.0
    model.k = (len(found) + 0.5) / (clean["n"].sum() + 1) * float(np.exp(model.lam * low))
    x = np.array([model.evidence(n, list(s)) for n, s in zip(seen["n"], seen["scores"], strict=True)])
    y = seen["toxic"].to_numpy(dtype=float)
    if len(np.unique(y)) == 2:
        model.weights = _fit_logistic(x, y)
        # the sample keeps each class at its own rate: shift back to the labels' odds
        model.weights[0] += np.log(have[1] / have[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_tokens`` and ``passages``: significant toxic passages
    as (first_token, last_token, score, e_value)."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    passage = pa.struct([("first_token", pa.int64()), ("last_token", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores, tokens, passages = [], [], []
            for text in b.column("text").to_pylist():
                n, seg = m.segments(text or "")
                scores.append(m.score(n, [s for _, _, s in seg]))
                tokens.append(n)
                e = [(a, z, s, m.e_value(n, s)) for a, z, s in seg]
                passages.append([{"first_token": a, "last_token": z, "score": s, "e_value": v} for a, z, s, v in e if v < MAX_E])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, type=pa.float64()), pa.array(tokens, type=pa.int64()), pa.array(passages, type=pa.list_(passage))], ["doc_id", "score", "n_tokens", "passages"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, score double, n_tokens long, passages array<struct<first_token:long,last_token:long,score:double,e_value:double>>")
