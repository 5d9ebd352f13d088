"""The pipeline against a brute-force version of its stages, and its edge cases."""

import re

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, docs
from tests.llm.test_dedup import brute_classes, brute_fingerprint
from tests.llm.test_text import brute_matches
from tradelens.llm.queries import table


def brute_keep(rows, items):
    """Ids that reach packing."""
    rows = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    classes = brute_classes({i: brute_fingerprint(t) for i, t in rows.items()}, 3)
    rows = {i: t for i, t in rows.items() if classes[i] == i}
    return set(rows) - {d for d, _ in brute_matches(rows, items)}


def test_pipeline_keeps_what_brute_force_keeps(spark):
    rows = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    items = {r.item_id: r.text for r in table(spark, SF_SMALL, "benchmark").collect()}
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id for r in got} == brute_keep(rows, items)
    assert all(0 < r.length <= 2048 and r.offset + r.length <= 2048 for r in got)


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_dir):
    item = "one benchmark passage with clearly more than five words in it to be found again"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    clean = [(10 + i, f"clean document number {i} about topic {i * 7} and {i * 13} with words {i} of its own") for i in range(6)]
    odd = [(1, None), (2, ""), (3, "123 456"), (4, "same text of some length here"), (5, "same  text of some length here"), (4, "same text of some length here"), (None, "a text without id that is clean"), (7, f"so {item} so"), (8, "long text " * 20_000)]
    d = clashing(docs(spark, clean + odd))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d.columns
        d = stage(spark, d, tmp_dir)
        assert d.columns == before, name
        path = f"{tmp_dir}/{name}"
        d.write.parquet(path)
        d = spark.read.parquet(path)
    kept = [r.doc_id for r in d.select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == [4, 8, 10, 11, 12, 13, 14, 15] and kept.count(None) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, d, tmp_dir).collect()
    assert {r.doc_id for r in last} == set(kept)


def test_stages_on_an_empty_table(spark, tmp_dir):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), tmp_dir).collect() == []
