"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, collocations, jaccard, licenses, media, mixing, quality, secrets, sentencepiece_codec, sharding, token_counts, token_files, toxicity



def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_mixing": mixing.query,
    "op3_sentencepiece_codec": sentencepiece_codec.query,
    "op4_toxicity": toxicity.query,
    "op5_token_files": token_files.query,
    "op6_media": media.query,
    "op7_licenses": licenses.query,
    "op8_secrets": secrets.query,
    "op9_quality": quality.query,
    "op10_jaccard_join": jaccard.query,
    "op11_collocations": collocations.query,
    "op12_sharding": sharding.query,
    "op13_alignment": alignment.query,
    "pipeline": _pipeline,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op7_licenses": licenses.ORACLE,
    "op8_secrets": secrets.ORACLE,
    "op11_collocations": collocations.ORACLE,
}
