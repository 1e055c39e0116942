"""The registered queries: rows for every document, the oracles that SQL can state, and the pipeline's stages."""

import pytest

pytest.importorskip("stratalens.llm")
import duckdb  # noqa: E402

from stratalens.llm import registry  # noqa: E402

COLUMNS = {
    "op1_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op2_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_sentencepiece_codec": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op6_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op7_licenses": {"doc_id", "license"}, "op8_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op9_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op10_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op12_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op13_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_every_document_has_its_row(spark, sf, name):
    out = registry.QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(out.columns)
    ids = sorted(r.doc_id for r in out.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", registry.ORACLES)
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    result = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(repr, result.fetchall()))
    got = registry.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = [(f.name, f.dataType) for f in docs.schema]
    kept = {r.doc_id: r.text for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert [(f.name, f.dataType) for f in out.schema] == columns
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert set(ids) <= set(kept)
        if i < 3:
            assert len(ids) == len(set(ids))
        if i == 2:
            assert len(ids) == docs.count() and not any("token = \"" in r.text and len(r.text) < 200 for r in rows)
        if i == 3:
            assert max(ids.count(d) for d in set(ids)) <= 2
        docs = spark.createDataFrame(rows, out.schema)
    assert len(rows) == len(ids) and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
