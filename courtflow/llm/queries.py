"""The registered queries of this subpackage, one for each operator, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from courtflow.llm import bpe, embeddings, langid, lengths, linededup, mixing, quality, simhash, spelling, tokenfiles, toxicity, urlrules, whitening
from courtflow.llm.shared import read

BYTE_BPE, BYTE_BPE_END = public_tokenizers.path("byte_bpe_50k.json"), 2
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

QUERIES = {
    "op1_simhash_near_dedup": lambda spark, d: simhash.near_duplicates(read(spark, d, "documents")),
    "op2_language_id": lambda spark, d: langid.identified(read(spark, d, "documents")),
    "op3_url_filters": lambda spark, d: urlrules.judged(read(spark, d, "pages"), urlrules.page_labels(read(spark, d, "labels"))),
    "op4_quality_rules": lambda spark, d: quality.quality(read(spark, d, "documents")),
    "op5_embedding_near_dedup": lambda spark, d: embeddings.near_duplicates(read(spark, d, "embeddings")),
    "op6_bpe": lambda spark, d: bpe.encode_and_decode(read(spark, d, "documents"), WORD_BPE),
    "op7_toxicity": lambda spark, d: toxicity.toxicity(read(spark, d, "documents"), read(spark, d, "labels")),
    "op8_token_counts": lambda spark, d: lengths.length_histogram(lengths.encoded_lengths(read(spark, d, "documents"), BYTE_BPE)),
    "op9_token_files": lambda spark, d: tokenfiles.token_digest(read(spark, d, "documents"), BYTE_BPE, BYTE_BPE_END),
    "op10_mixing": lambda spark, d: mixing.mix_plan(read(spark, d, "documents")),
    "op11_line_dedup": lambda spark, d: linededup.line_digest(read(spark, d, "documents")),
    "op12_spelling_variants": lambda spark, d: spelling.spelling_groups(read(spark, d, "documents")),
    "op13_embedding_whitening": lambda spark, d: whitening.whitened(read(spark, d, "embeddings")),
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality.oracle(),
    "op10_mixing": mixing.ORACLE,
    "op11_line_dedup": linededup.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
}
