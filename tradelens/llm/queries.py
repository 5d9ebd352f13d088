"""Registered queries of the operators: name -> callable(spark, sf_dir).

Each reads its whole table, applies its operator with production parameters
and derives the contract's columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm import langid, merkle, toxicity
from tradelens.llm.best_fit import best_fit_pack
from tradelens.llm.common import held_out_fold
from tradelens.llm.decontam import find_matches
from tradelens.llm.exact_dedup import exact_dedup
from tradelens.llm.html_extract import extract_text
from tradelens.llm.line_dedup import line_dedup
from tradelens.llm.packing import pack
from tradelens.llm.pii import pseudonymise
from tradelens.llm.simhash import simhash_dedup
from tradelens.llm.token_counts import count_tokens, write_token_files
from tradelens.llm.whitening import fit_whitening, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


def vocabulary() -> str:
    """Place of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""


@register("op1_exact_dedup", OP1_SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of whole ``documents`` texts (progressive refinement)."""
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


@register("op2_simhash_dedup")
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of ``documents``: 3-word shingles, at most 3 differing bits."""
    return simhash_dedup(table(spark, sf_dir, "documents"), shingle=3, distance=3)


@register("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into windows of 2048 tokens, best fit decreasing."""
    return pack(table(spark, sf_dir, "documents"), vocabulary(), size=2048, end_id=1)


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@register("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 ``documents`` dropped everywhere."""
    kept = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of flat token files.  The files (the job's input) are
    ``documents`` tokenised and written with id 50256 after each document;
    the manifest only names the document at each place of a file."""
    token_files, places = write_token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=50256)
    counts = count_tokens(token_files, end_id=50256, width=2)
    return counts.join(places, ["file", "ordinal"]).select(
        "doc_id", F.regexp_extract("file", r"tokens-(\d+)-", 1).cast("long").alias("file_no"), "ordinal", "start", "n_tokens", "terminated"
    )


@register("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, benchmark item) pairs where a window of the document matches
    the item: five-word shingles, weighted similarity of 0.8 or more."""
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@register("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract_text(table(spark, sf_dir, "pages"))


# Key of the registered query only; callers bring their own secret.
DEMO_KEY = "registered-query"


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format-preserving pseudonyms in whole ``documents`` texts."""
    return pseudonymise(table(spark, sf_dir, "documents"), key=DEMO_KEY)


def language_model(spark: SparkSession, sf_dir: str) -> langid.PpmModel | None:
    """Learned from the documents outside the held-out fold."""
    return langid.train(table(spark, sf_dir, "documents"), ~F.coalesce(held_out_fold(F.col("doc_id")), F.lit(False)))


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by code length."""
    found = langid.predict(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fold are not read."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out_fold(F.col("doc_id")))
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(held_out_fold(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


MERKLE_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t
), enc AS (
  SELECT doc_id, lang, text,
         coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
           || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
         xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) AS crc
  FROM documents, crc_table
), leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text)::VARCHAR || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS claim
  FROM enc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), tree AS (
  SELECT lang, 0 AS lvl, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // 8, n
), sub AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS lvl, idx, n, subroot AS digest FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 8, n
), tree_runs AS (
  SELECT lang, lvl, idx, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY lang, lvl, idx // 8 ORDER BY idx)
), top_runs AS (
  SELECT lvl, idx, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY lvl, idx // 8 ORDER BY idx)
), walk AS (
  SELECT doc_id, lang, idx AS place, leaf, 0 AS lvl, idx, n, '' AS proof, coalesce(claim, leaf) AS h FROM placed
  UNION ALL
  SELECT w.doc_id, w.lang, place, leaf, w.lvl + 1, w.idx // 8, (w.n + 7) // 8, proof || l || r, sha256(l || h || r)
  FROM walk w JOIN tree_runs t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = w.lvl AND t.idx = w.idx WHERE w.n > 1
), up AS (
  SELECT doc_id, w.lang, place, leaf, subroot, 0 AS lvl, s.idx, s.n, proof, h FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT doc_id, lang, place, leaf, subroot, u.lvl + 1, u.idx // 8, (u.n + 7) // 8, proof || l || r, sha256(l || h || r)
  FROM up u JOIN top_runs t ON t.lvl = u.lvl AND t.idx = u.idx WHERE u.n > 1
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root,
       h = (SELECT digest FROM top WHERE n = 1) AS verified
FROM up WHERE n = 1
"""


@register("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of ``documents``, a tree per language, and the check of
    a copy in which the texts of a third of the ids are lower-cased."""
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = {"text": F.translate("text", upper, upper.lower())}
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claim = F.when(altered, merkle.digest([lowered.get(c, F.col(c)) for c in MERKLE_FIELDS]))
    found = merkle.prove(merkle.build_manifest(docs, MERKLE_FIELDS, "doc_id", "lang", claim))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def word_vocabulary() -> str:
    """Place of the public BPE vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed whole into sequences of at most 4096 tokens, best fit decreasing."""
    return best_fit_pack(table(spark, sf_dir, "documents"), word_vocabulary(), size=4096, end_id=1)


@register("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every row of ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings")
    found = whiten(vectors, fit_whitening(vectors, "embedding", components=4), "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
