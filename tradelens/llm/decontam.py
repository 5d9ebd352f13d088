"""Benchmark decontamination (operator 6, native).

Finds, in every document, windows of the size of a benchmark item that match
the item at a weighted-shingle similarity of at least ``SIMILARITY``.

1. Words: lower case, parted by anything but letters, digits and marks;
   shingles of five words, hashed
   (an item of fewer words is one shingle, the whole sequence, and is looked
   for with shingles of its own length).
2. Item-sized windows: similarity above zero needs a common shingle, so
   windows are laid, for each item size, at every start that covers a
   position whose shingle some item of that size has.  All other windows
   share nothing with any item.
3. Each window gets a 64-bit SimHash, shingles weighted by how often they
   occur.  Bits are counted for all 64 places at once in bit-sliced
   counters (plain longs), one pass over the window.
4. Multi-index Hamming blocks: the 64 bits are cut into ``BLOCKS`` blocks; two
   fingerprints within ``RADIUS`` agree on some block within RADIUS // BLOCKS
   bits.  Items are indexed under all such neighbours of their blocks, so
   the equi-join on (item size, block, value) finds every pair within the
   radius; the full distance is then checked.  At similarity 0.8 the expected
   distance is 9.7 bits with a deviation of 2.9, so the radius of 19 lies
   three deviations above it.
5. Verification: weighted Jaccard similarity of the two shingle multisets,
   exact.

Everything is DataFrame expressions.  Documents are scanned twice (hits, then
windows of documents with hits); texts are never shuffled unless the hit
table outgrows the broadcast bound, and then only shingle hashes move.

Defined results: null and empty texts match nothing and an item without
words is ignored; a document shorter than the item is one window; repeated
rows of a document give the same match once; a null id is a value like any
other; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import broadcast_if_small, cut, named

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 8
BLOCK_BITS = 64 // BLOCKS


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and marks; whatever lies
    between (blanks of any kind, dashes, slashes, punctuation) parts them."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", " ")
    return F.array_remove(F.split(bare, " "), "")


def _with_shingles(df: DataFrame, words: str, k: int) -> DataFrame:
    """Adds ``sh``: hashes of the k-word shingles in order (empty below k words).

    The word hashes are bound by an outer lambda: a plain column would be
    inlined into the inner lambda by predicate push-down and be computed
    again for every shingle.
    """

    def shingled(w: Column) -> Column:
        count = F.greatest(F.size(w) - (k - 1), F.lit(0))
        return F.transform(F.slice(w, 1, count), lambda x, i: F.xxhash64(x, *[w[i + j] for j in range(1, k)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return df.withColumn("sh", F.transform(F.array(hashed), shingled)[0])


def _simhash(sh: Column, planes: int) -> Column:
    """64-bit SimHash of an array of hashes; plane b holds bit b of the 64 counters."""

    def add(acc: Column, h: Column) -> Column:
        out, carry = [], h
        for b in range(planes):
            p = acc[f"p{b}"]
            out.append(p.bitwiseXOR(carry).alias(f"p{b}"))
            carry = carry.bitwiseAND(p)
        return F.struct(*out)

    def majority(acc: Column) -> Column:
        half = F.floor(F.size(sh) / 2).cast("long")
        above, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for b in reversed(range(planes)):
            p, t = acc[f"p{b}"], -F.shiftright(half, b).bitwiseAND(F.lit(1).cast("long"))
            above = above.bitwiseOR(equal.bitwiseAND(p).bitwiseAND(F.bitwise_not(t)))
            equal = equal.bitwiseAND(F.bitwise_not(p.bitwiseXOR(t)))
        return above

    zero = F.struct(*[F.lit(0).cast("long").alias(f"p{b}") for b in range(planes)])
    return F.aggregate(sh, zero, add, majority)


def _occurrences(sh: Column) -> Column:
    """The multiset as a set: from the second time on, a repeat is hashed with its occurrence number."""

    def tagged(h: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(sh, 1, i + 1), lambda x: x == h))
        return F.when(F.array_position(sh, h) == i + 1, h).otherwise(F.xxhash64(h, seen))

    return F.when(F.size(F.array_distinct(sh)) == F.size(sh), sh).otherwise(F.transform(sh, tagged))


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))


def _near_masks(radius: int) -> list[int]:
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= radius]


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per (document, item) that match: ``doc_id, text_key`` (XXH64 of
    the text as Spark computes it), ``item_id, similarity, word_start,
    n_words`` of the best window and ``n_windows`` that match."""
    rows = docs.select(named(id_col).alias("doc_id"), F.xxhash64(named(text_col)).alias("text_key"), words_of(named(text_col)).alias("words"))
    bench = cut(
        items.select(named(item_id_col).alias("item_id"), words_of(named(item_text_col)).alias("words"))
        .withColumn("n", F.size("words"))
        .filter("n > 0"),
        "benchmark-items",
    )
    lengths = sorted(r[0] for r in bench.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most five values
    found = [_find(rows, bench.filter(F.least("n", F.lit(SHINGLE)) == k), k, similarity, radius) for k in lengths]
    if not found:
        found = [_find(rows, bench, SHINGLE, similarity, radius)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _find(rows: DataFrame, bench: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    bench = _with_shingles(bench, "words", k).select("item_id", "n", "sh")
    size = bench.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.max("n"), F.lit(k)).alias("n"), F.coalesce(F.sum(F.size("sh")), F.lit(0)).alias("shingles")).first()
    planes = max(1, int(size["n"] - k + 1).bit_length())

    # items: fingerprint, multiset, and the multi-index of block neighbours
    bench = cut(bench.select("item_id", "n", "sh", _simhash(F.col("sh"), planes).alias("item_fp")).withColumn("item_set", _occurrences(F.col("sh"))), "benchmark-index")
    shingles = broadcast_if_small(bench.select("n", F.explode("sh").alias("h")).groupBy("h").agg(F.collect_set("n").alias("sizes")), size["shingles"])
    masks = _near_masks(radius // BLOCKS)
    index = bench.select("item_id", "n", "item_fp", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("item_fp"), b).alias("own")) for b in range(BLOCKS)])).alias("x"))
    index = index.select("item_id", "n", "item_fp", "x.block", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col("x.own")))).alias("value"))
    index = broadcast_if_small(index, size["items"] * BLOCKS * len(masks))

    # scan 1: positions whose shingle some item has, by item size
    rows = _with_shingles(rows, "words", k).select("doc_id", "text_key", "sh")
    hits = rows.select("doc_id", "text_key", F.posexplode_outer("sh").alias("pos", "h")).join(shingles, "h")
    covered = cut(hits.select("doc_id", "text_key", F.explode("sizes").alias("n"), "pos").groupBy("doc_id", "text_key", "n").agg(F.collect_set("pos").alias("at")), "benchmark-hits")
    covered = broadcast_if_small(covered.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "n", "at"), covered.agg(F.coalesce(F.sum(F.size("at") + 2), F.lit(0))).first()[0])

    # scan 2: item-sized windows over those positions
    laid = rows.join(covered, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")))
    m = F.col("n") - (k - 1)
    last = F.greatest(F.size("sh") - m, F.lit(0))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(F.least(p - m + 1, last), F.lit(0)), F.least(p, last)))))
    # cut inside the array: a row holds one window, not the document
    cut_out = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("sh", s + 1, m).alias("win")))
    windows = laid.select("doc_id", "text_key", "n", F.explode(cut_out).alias("w")).select("doc_id", "text_key", "n", "w.s", "w.win")
    windows = windows.withColumn("fp", _simhash(F.col("win"), planes))

    # multi-index join, full distance, each pair once (at its first near block)
    probes = windows.select("doc_id", "text_key", "n", "s", "win", "fp", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)])).alias("x"))
    pairs = probes.select("doc_id", "text_key", "n", "s", "win", "fp", "x.block", "x.value").join(index, ["n", "block", "value"]).withColumn("diff", F.col("fp").bitwiseXOR(F.col("item_fp")))
    first_block = F.coalesce(*[F.when(F.bit_count(_block(F.col("diff"), b)) <= radius // BLOCKS, F.lit(b)) for b in range(BLOCKS)])
    pairs = pairs.filter((F.bit_count("diff") <= radius) & (F.col("block") == first_block)).select("doc_id", "text_key", "item_id", "n", "s", "win")

    # exact weighted Jaccard
    sets = broadcast_if_small(bench.select(F.col("item_id").alias("set_id"), F.col("n").alias("set_n"), "item_set"), size["shingles"])
    checked = pairs.withColumn("win_set", _occurrences(F.col("win"))).join(sets, F.col("item_id").eqNullSafe(F.col("set_id")) & (F.col("n") == F.col("set_n")))
    both = F.size(F.array_intersect("win_set", "item_set"))
    checked = checked.withColumn("similarity", both / (F.size("win_set") + F.size("item_set") - both)).filter(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("s")).alias("s"), "n")).alias("best")
    return checked.groupBy("doc_id", "text_key", "item_id").agg(best, F.size(F.collect_set("s")).cast("long").alias("n_windows")).select(
        "doc_id", "text_key", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).cast("long").alias("word_start"), F.col("best.n").cast("long").alias("n_words"), "n_windows"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without a match, all columns as they are."""
    hit = find_matches(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key")).distinct()
    hit = cut(hit, "contaminated")
    hit = broadcast_if_small(hit, hit.count())
    return docs.join(hit, named(id_col).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(named(text_col)) == F.col("_hit_key")), "left_anti")
