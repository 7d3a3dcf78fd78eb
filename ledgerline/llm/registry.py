"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from ledgerline.llm import importance, langid, merkle, mixing, near_dup, neighbours, piece_codec, repeats, secrets, token_counts, toxicity, vectors, warc
from ledgerline.llm.common import table

QUERIES = {
    "op1_toxicity": lambda spark, d: toxicity.op1_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_secrets": lambda spark, d: secrets.op2_secrets(table(spark, d, "documents")),
    "op3_language": lambda spark, d: langid.op3_language(table(spark, d, "documents")),
    "op4_near_duplicates": lambda spark, d: near_dup.near_duplicates(table(spark, d, "documents")),
    "op5_embedding_dups": lambda spark, d: vectors.op5_embedding_dups(table(spark, d, "embeddings")),
    "op6_mix": lambda spark, d: mixing.op6_mix(table(spark, d, "documents")),
    "op7_repeats": lambda spark, d: repeats.op7_repeats(table(spark, d, "documents"), lines=True),
    "op8_neighbours": lambda spark, d: neighbours.op8_neighbours(table(spark, d, "embeddings")),
    "op9_token_counts": lambda spark, d: token_counts.op9_token_counts(table(spark, d, "documents")),
    "op10_pieces": lambda spark, d: piece_codec.op10_pieces(table(spark, d, "documents")),
    "op11_merkle": lambda spark, d: merkle.op11_merkle(table(spark, d, "documents")),
    "op12_importance": lambda spark, d: importance.op12_importance(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_warc": lambda spark, d: warc.op13_warc(table(spark, d, "pages")),
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_secrets": secrets.oracle(),
    "op6_mix": mixing.oracle(),
    "op11_merkle": merkle.oracle(),
    "op12_importance": importance.oracle(),
    "op13_warc": warc.oracle(),
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
