"""Merkle manifest, best-fit packing and whitening against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, docs
from tradelens.llm import best_fit, merkle, whitening
from tradelens.llm.common import ranked
from tradelens.llm.queries import MERKLE_FIELDS, QUERIES, table, word_vocabulary
from tradelens.llm.word_tokenizer import word_bpe

# ---------------------------------------------------------------- ranks


def test_ranks_of_hot_groups(spark):
    rows = [(None if i % 3 else "b", 7 if i % 2 else i, i) for i in range(500)]
    out = ranked(spark.createDataFrame(rows, "g string, o long, row long").repartition(5), ["g"], ["o", "row"], "t").collect()
    want = {}
    for g in (None, "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        want.update({r: (i, len(mine)) for i, r in enumerate(mine)})
    assert {(r.g, r.o, r.row): (r["rank"], r.group_rows) for r in out} == want


# ---------------------------------------------------------------- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in MERKLE_FIELDS))


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        at //= 8
    return out


def brute_manifest(rows, altered=lambda r: None):
    """(doc_id, leaf, subroot, root, proof, folded) of every row."""
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for k in order:
        trees[k].sort(key=lambda x: x[:3])
        built[k] = brute_levels([x[2] for x in trees[k]])
    top = brute_levels([built[k][-1][0] for k in order])
    out = []
    for place, k in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(trees[k]):
            path = siblings(built[k], at) + siblings(top, place)
            h = altered(r) or leaf
            for a, b in path:
                h = sha(a + h + b)
            out.append((r["doc_id"], leaf, built[k][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h))
    return sorted(out, key=repr)


def manifest_rows(df, claim=None):
    made = merkle.build_manifest(df, MERKLE_FIELDS, "doc_id", "lang", claim)
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in merkle.prove(made).collect()), key=repr)


@pytest.mark.parametrize("levels", range(1, 7))
def test_addresses_fill_the_layout_and_keep_subtrees_together(levels):
    seen = np.concatenate([merkle.address(levels, k, np.arange(8**k)) for k in range(levels)])
    assert sorted(seen.tolist()) == list(range(merkle.subtree_nodes(levels)))
    if levels > 1:  # every subtree below the split at half height is contiguous
        top = levels // 2
        for i in range(min(8**top, 20)):
            mine = np.concatenate([merkle.address(levels, k, np.arange(i * 8 ** (k - top), (i + 1) * 8 ** (k - top))) for k in range(top, levels)])
            assert np.ptp(mine) == len(mine) - 1


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512])
def test_blocks_equal_plain_trees(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    height = merkle.height_of(n)
    nodes = merkle.build_block(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32), height)
    levels = brute_levels([d.hex() for d in digests])
    assert nodes[0].tobytes().hex() == levels[-1][0]
    for at, (left, right) in enumerate(merkle.block_paths(nodes, height, n)):
        assert [(a.decode(), b.decode()) for a, b in zip(left, right)] == siblings(levels, at)
        assert merkle.fold(digests[at].hex().encode(), left, right).decode() == levels[-1][0]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_rows_of_blocks_equal_plain_trees(spark, monkeypatch, height):
    """Small blocks, so that trees of one to four rows of blocks are met."""
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 8**height)
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "e": 65, None: 150, "é": 70, "Z": 2, **{f"x{i}": 1 for i in range(9)}}
    rows, n = [], 0
    for k, size in sizes.items():
        for _ in range(size):
            rows.append({"doc_id": n * 7 % 1009, "text": f"Text {n}", "lang": k, "source": None if n % 5 == 0 else "s", "n_chars": n})
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert manifest_rows(df) == brute_manifest(rows)


def test_manifest_query(spark):
    rows = [r.asDict() for r in table(spark, SF_SMALL, "documents").collect()]

    def altered(r):
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 or r["text"] is None:
            return None
        return leaf_of({**r, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])})

    out = QUERIES["op11_merkle_manifest"](spark, SF_SMALL).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in out), key=repr) == brute_manifest(rows, altered)
    assert all(r.verified == (r.folded_root == r.root) for r in out)
    assert 0 < sum(not r.verified for r in out) < len(out)


def test_manifest_cases(spark):
    rows = [(1, None, None), (2, "", "en"), (None, "No id", "en"), (3, "Same", "de"), (3, "Same", "de"), (3, "Other", "de"), (4, "ÄÖ Lang " * 200_000, "de"), (5, "a", "")]
    df = docs(spark, rows)
    plain = [r.asDict() for r in df.collect()]
    assert manifest_rows(df) == brute_manifest(plain)
    # neither the order of rows, nor other columns, change a result
    assert manifest_rows(clashing(df).withColumns({c: F.lit("x") for c in ("tree", "rank", "place", "part", "before", "group_rows", "block", "digest", "claim")}).repartition(7)) == brute_manifest(plain)
    # a claim that equals the leaf verifies, another does not
    claim = F.when(F.col("doc_id") == 2, F.unhex(F.sha2(F.lit("?"), 256))).when(F.col("doc_id") == 5, merkle.digest([F.col(c) for c in MERKLE_FIELDS]))
    found = {(r.id, r.leaf): r.verified for r in merkle.prove(merkle.build_manifest(df, MERKLE_FIELDS, "doc_id", "lang", claim)).collect()}
    assert [k[0] for k, v in found.items() if not v] == [2]
    one = docs(spark, [(9, "x", "fr")])
    assert [(r[1], r[2], r[3]) for r in manifest_rows(one)] == [(leaf_of(one.first().asDict()),) * 3]
    assert manifest_rows(docs(spark, [])) == []
    assert merkle.build_manifest(docs(spark, []), MERKLE_FIELDS, "doc_id", "lang").root is None


# ---------------------------------------------------------------- best-fit packing


def brute_best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [w for w in range(len(room)) if room[w] >= n]
        if fits:
            room[min(fits, key=lambda w: room[w])] -= n
        else:
            room.append(size - n)
    return sorted(room)


def place_all(lengths, size):
    plan = best_fit.best_fit_plan(Counter(lengths), size)
    seen, rank = Counter(), []
    for n in lengths:
        rank.append(seen[n])
        seen[n] += 1
    return (*plan.place(np.array(lengths, dtype=np.int64), np.array(rank, dtype=np.int64)), plan.sequences)


def test_plan_equals_placing_one_by_one():
    rng = random.Random(3)
    for size in (1, 5, 16, 64, 100, 257):
        for _ in range(60):
            lengths = [rng.randint(1, size if rng.random() < 0.5 else max(1, size // 4)) for _ in range(rng.randint(0, 150))]
            sequence, offset, n = place_all(lengths, size)
            used = np.bincount(sequence, weights=lengths, minlength=n) if lengths else np.zeros(0)
            assert sorted((size - used).tolist()) == brute_best_fit(lengths, size)
            taken = [(s, k) for s, o, n in zip(sequence, offset, lengths) for k in range(o, o + n)]
            assert len(taken) == len(set(taken)) == sum(lengths)
            assert all(o + n <= used[s] for s, o, n in zip(sequence, offset, lengths))  # gapless


def test_plan_stays_small_at_any_count():
    rng = random.Random(4)
    plan = best_fit.best_fit_plan({n: rng.randint(1, 10**9) for n in range(1, 4097)}, 4096)
    assert len(plan.length) < 20_000


def test_tightest_capacity():
    rng = random.Random(5)
    room, held = best_fit.Capacities(20), set()
    for _ in range(500):
        c = rng.randint(1, 20)
        held ^= {c}
        room.set(c, c in held)
        want = rng.randint(1, 20)
        assert room.tightest(want) == min((h for h in held if h >= want), default=None)


def check_packed(rows, texts, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_vocabulary())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    lengths = []
    for i, mine in by_doc.items():
        ids = np.array(t.encode(texts[i] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        mine.sort(key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // size)))
        for r in mine:
            assert r.start == r.piece * size and r.length == min(size, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            lengths.append(r.length)
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert len(by_seq) == len(brute_best_fit(lengths, size))
    return lengths


def test_best_fit_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    rows = QUERIES["op12_best_fit_packing"](spark, SF_SMALL).collect()
    lengths = check_packed(rows, texts, 4096)
    assert len({r.sequence_id for r in rows}) <= math.ceil(sum(lengths) / 4096) * 1.01 + 1


def test_best_fit_cases(spark):
    texts = {1: None, 2: "", 3: "Word " * 5000, None: "no id", 5: "a b c", 6: "a b c", 7: "<|endoftext|>É日本", 8: " \t\n "}
    df = clashing(docs(spark, list(texts.items()))).withColumns({c: F.lit(0) for c in ("piece", "rank", "sequence_id", "offset")})
    rows = best_fit.best_fit_pack(df, word_vocabulary(), size=64, keep_ids=True).collect()
    check_packed(rows, texts, 64)
    assert [r.ids for r in rows if r.doc_id in (1, 8)] == [[1], [1]]
    again = best_fit.best_fit_pack(docs(spark, [(1, "x")] * 40), word_vocabulary(), size=8).collect()
    assert len({(r.sequence_id, r.offset) for r in again}) == 40 and len({r.sequence_id for r in again}) == 10
    assert best_fit.best_fit_pack(docs(spark, []), word_vocabulary()).collect() == []


def test_word_ids_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(word_vocabulary()), word_bpe(word_vocabulary())
    rng = random.Random(6)
    odd = "'sStTRE  \t\n\x85\xa0\xadİıſßÉéŁ²½ÀÅ–—…“”€™<|endoftext|>Σςσ日本éÅẞ​0123_&%"
    texts = ["", " ", "I'LL 'S don't", "ΑΣ ΑΣΑ", "a\x1cb", "<|startoftext|> x", "x" * 5000]
    texts += ["".join(rng.choice(odd if rng.random() < 0.4 else "abcdefghij ") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += [r.text or "" for r in table(spark, SF_SMALL, "documents").select("text").collect()]
    for t in texts:
        assert fast.encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids, t
    assert fast._fast is not None


# ---------------------------------------------------------------- whitening


def vectors(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts) if rows else spark.createDataFrame([], "vec_id long, embedding array<float>")


def run_whitening(df, k=4):
    return whitening.whiten(df, whitening.fit_whitening(df, "embedding", k), "vec_id", "embedding").collect()


def check_whitened(rows, source, k=4):
    """Against an eigendecomposition of the covariance in plain numpy."""
    usable = [(i, v) for i, v in source if v and all(c is not None and math.isfinite(c) for c in v)]
    grids = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in usable]
    fit = sorted({x for _, x in grids})
    n, a = len(fit), np.array(fit, dtype=float)
    sums = [sum(col) for col in zip(*fit)]
    centred = a - a.mean(axis=0)
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    keep = min(k, int((values > 1e-9 * values[0]).sum()))
    assert Counter((r.id, r.component) for r in rows) == Counter((i, c + 1) for i, _ in grids for c in range(keep))
    got = defaultdict(list)
    for r in rows:
        got[(r.id, r.component)].append(r)
    for c in range(keep):
        want = {i: (np.array(x) - a.mean(axis=0)) @ basis[:, c] / math.sqrt(values[c]) for i, x in grids}
        mine = {i: got[(i, c + 1)][0].whitened for i, _ in grids}
        first = max(want, key=lambda i: abs(want[i]))
        sign = 1 if want[first] * mine[first] > 0 else -1
        assert max(abs(want[i] - sign * mine[i]) for i in want) < 1e-6
    for i, x in grids:
        r = got[(i, 1)][0]
        assert (r.n, int(r.deviation)) == (n, sum((n * v - s) ** 2 for v, s in zip(x, sums)))
        assert r.identity_error < 1e-9
        for c in range(keep):
            assert abs(got[(i, c + 1)][0].explained / (values[c] / np.trace(cov)) - 1) < 1e-9
    return keep


def test_whitening_query(spark):
    source = [(r.vec_id, r.embedding) for r in table(spark, SF_SMALL, "embeddings").select("vec_id", "embedding").collect()]
    rows = [r for r in QUERIES["op13_embedding_whitening"](spark, SF_SMALL).withColumnRenamed("vec_id", "id").collect()]
    assert check_whitened(rows, source) == 4


def test_whitening_cases(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=5) * [3, 2, 1, 0.5, 0.1]).tolist()) for i in range(60)]
    rows += [(60, rows[0][1]), (60, rows[0][1]), (None, rows[1][1]), (61, None), (62, []), (63, [1.0, None, 0.0, 0.0, 0.0]), (64, [float("nan")] * 5), (65, [float("inf")] * 5), (66, [-0.0] * 5)]
    assert check_whitened(run_whitening(vectors(spark, rows)), rows) == 4
    renamed = vectors(spark, rows).withColumns({c: F.lit("x") for c in ("id", "v", "x", "n", "dim", "component", "i", "a.b`c")})
    assert check_whitened(run_whitening(renamed), rows) == 4
    # vectors of another length are dropped
    assert check_whitened(run_whitening(vectors(spark, [*rows, (70, [1.0, 2.0])])), rows) == 4
    assert run_whitening(vectors(spark, [])) == []
    assert run_whitening(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == []


def test_whitening_without_full_rank(spark):
    rng = np.random.default_rng(8)
    low = rng.integers(-40, 40, size=(50, 2)) / 4.0
    rows = [(i, [v[0], v[1], v[0] + v[1], 7.0, v[0] - 2 * v[1]]) for i, v in enumerate(low.tolist())]
    assert check_whitened(run_whitening(vectors(spark, rows)), rows) == 2
    two = [(1, [1.0, 2.0, 3.0]), (2, [0.0, 2.0, 5.0])]
    assert check_whitened(run_whitening(vectors(spark, two)), two) == 1


def test_whitening_is_exact_far_from_the_origin(spark):
    """Large means and overflowing squares: centring on the whole part, sums beyond a long."""
    rng = np.random.default_rng(9)
    rows = [(i, [2.0**22 + float(a), -(2.0**21) + float(b)]) for i, (a, b) in enumerate(rng.integers(0, 9, size=(30, 2)).tolist())]
    out = run_whitening(vectors(spark, rows))
    assert check_whitened(out, rows) == 2
    huge = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 1.0])]
    assert len(run_whitening(vectors(spark, huge))) in (3, 6)


def test_factor_is_that_of_the_rows(spark):
    df = table(spark, SF_SMALL, "embeddings")
    model = whitening.fit_whitening(df, "embedding")
    x = np.array(sorted({tuple(math.floor(256 * float(c)) for c in r.embedding) for r in df.collect()}), dtype=float)
    a = x - x.mean(axis=0)
    assert np.allclose(model.factor.T @ model.factor, a.T @ a, rtol=1e-10, atol=1e-6)
    assert np.allclose(np.tril(model.factor, -1), 0) and model.passes == 3 and len(model.eigenvalues) == model.dim
    assert np.allclose(model.eigenvalues.sum(), model.trace)
