"""Exact de-duplication by progressive refinement (operator 1, native).

Rows are refined level by level so that full content is only hashed where a
duplicate is still possible:

1. group by the length of the normalised text,
2. inside lengths that occur twice: group by a hash of the text's first
   ``PREFIX_CHARS`` characters,
3. inside (length, prefix hash) pairs that occur twice: SHA-256 of the whole
   normalised text; equal digests are equal texts.

Only narrow keys are shuffled, never texts, and every grouping is an
aggregation with map-side partials, so a group holding a third of all rows
costs one partial row per task.  Everything is DataFrame expressions.

Defined results: a null text counts as empty; empty texts form one group; a
null id is larger than any id, so a row with an id stays before one without;
repeated rows (same id and text) are separate rows of the same group and
exactly one of them is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import broadcast_if_small, cut, named

PREFIX_CHARS = 64


def normalise_space(text: Column) -> Column:
    """Null as empty; every run of ASCII white space becomes one space.

    The pattern skips runs that already are one space (same result, far
    fewer replacements).
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, carry: bool = False) -> DataFrame:
    """Mark exact copies (after white-space normalisation).

    Returns one row per input row: ``doc_id``, ``keep_id`` (smallest id of the
    equal texts), ``group_size``, ``kept``, ``text_sha256`` (null for texts
    the first two levels already proved unique, unless ``digest_all``), and
    with ``carry`` the whole input row as struct ``row``.
    """
    base = docs.select(
        named(id_col).alias("id"),
        normalise_space(named(text_col)).alias("norm"),
        *([F.struct(*[named(c) for c in docs.columns]).alias("row")] if carry else []),
    )
    keyed = base.withColumns({"len": F.char_length("norm"), "prefix": F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))})

    # levels 1 and 2 on a narrow table of (length, prefix hash)
    pairs = cut(keyed.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")), "exact-dedup-keys")
    lengths = pairs.groupBy("len").agg(F.sum("n").alias("n")).filter("n > 1").select("len")
    open_pairs = pairs.filter("n > 1").join(lengths, "len", "left_semi").select("len", "prefix", F.lit(True).alias("open"))
    open_pairs = broadcast_if_small(open_pairs, open_pairs.count())

    # level 3: full content is hashed for the surviving pairs only
    digest = F.sha2(F.col("norm"), 256)
    rows = keyed.join(open_pairs, ["len", "prefix"], "left").select(
        "id",
        F.monotonically_increasing_id().alias("row_id"),
        (digest if digest_all else F.when(F.col("open"), digest)).alias("sha"),
        F.coalesce("open", F.lit(False)).alias("open"),
        *(["row"] if carry else []),
    )
    rows = cut(rows, "exact-dedup-rows")  # fixes row_id
    groups = (
        rows.filter("open")
        .groupBy("sha")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_id")).alias("first"))
        .filter("n > 1")
        .select(F.col("sha").alias("group_sha"), "n", "first")
    )
    # a table of its own: members of a hot group then meet it by broadcast or by a join Spark can split
    groups = cut(groups, "exact-dedup-groups")
    groups = broadcast_if_small(groups, groups.count())
    in_group = F.col("n").isNotNull()
    return rows.join(groups, F.when(F.col("open"), F.col("sha")) == F.col("group_sha"), "left").select(
        F.col("id").alias("doc_id"),
        F.when(in_group, F.col("first.id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (~in_group | (F.col("first.row_id") == F.col("row_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )
