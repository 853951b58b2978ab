"""The pipeline's stages on a small table with planted cases, against brute force."""

import collections

import corpus_pipeline
from llm_tables import DOCS, prose
from test_corpus_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [(50_000 + i, prose(i, 150), "en", f"s{i % 4}", 0) for i in range(60)]
    copies = [(60_000 + i, clean[i][1] + " extra", "en", "s1", 0) for i in range(10)]
    short = [(70_000 + i, prose(i, 20), "en", "s2", 0) for i in range(5)]
    repeats = [(80_000, "one two three " * 40, "en", "s2", 0), (80_001, None, None, None, None), (80_002, "", "en", None, 0)]
    docs = spark.createDataFrame([tuple(r) for r in docs.collect()] + clean + copies + short + repeats, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "ngram_jaccard_join", "mixing", "packing"]
    good = stages["quality_rules"](spark, docs, SF)
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and {c[0] for c in clean + copies} <= ids
    assert not ids & {r[0] for r in short + repeats}
    want = {k for k, (_, c) in brute_components([(r.doc_id, r.text) for r in good.collect()]).items() if k == c}
    unique = stages["ngram_jaccard_join"](spark, good, SF)
    kept = {r.doc_id for r in unique.collect()}
    assert kept == want and not kept & {c[0] for c in copies} and {c[0] for c in clean} <= kept
    mixed = stages["mixing"](spark, unique, SF)
    n = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(n.values()) == 2
    packed = stages["packing"](spark, mixed, SF).collect()
    lengths = collections.Counter()
    for p in packed:
        lengths[p.sequence_id] += p.length
    assert all(v == 2048 or v & (v - 1) == 0 for v in lengths.values())


def test_repeated_and_null_ids(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= 2 * docs.count()
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    same = [r for r in unique if r.text and r.text == docs.where("doc_id = 1").first().text]
    assert len(same) == 1 and any(r.doc_id is None for r in unique)


def test_empty_table(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
