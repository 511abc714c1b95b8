"""The queries of this subpackage and their DuckDB SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from . import decontaminate, jaccard_join, line_dedup, merkle, minhash, rules, warc
from .bpe import op7_bpe_codec
from .cross_tokens import op13_cross_tokenizer_alignment
from .quality import op1_quality_classifier
from .secrets import op4_secret_scan
from .token_binary import op9_token_binary
from .token_counts import op5_token_counts

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_warc": warc.op8_warc,
    "op9_token_binary": op9_token_binary,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_minhash_dedup": minhash.op12_minhash_dedup,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.SQL,
    "op3_quality_rules": rules.SQL,
    "op6_ngram_jaccard_join": jaccard_join.SQL,
    "op8_warc": warc.SQL,
    "op10_decontamination": decontaminate.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_minhash_dedup": minhash.SQL,
}
