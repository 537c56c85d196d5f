"""Registered queries of the training-data operators and their SQL."""

from codecensus.llm.bpe_codec import op9_bpe_codec
from codecensus.llm.chat_format import op7_chat_format
from codecensus.llm.decontamination import op2_decontamination
from codecensus.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from codecensus.llm.importance_resampling import OP12_SQL, op12_importance_resampling
from codecensus.llm.license_scan import op13_license_scan
from codecensus.llm.near_dedup import op10_near_dedup
from codecensus.llm.quality import op6_quality
from codecensus.llm.sharding import op8_sharding
from codecensus.llm.source_divergence import OP11_SQL, op11_source_divergence
from codecensus.llm.suffix_dedup import op1_suffix_dedup
from codecensus.llm.token_counts import op4_token_counts
from codecensus.llm.toxicity import op3_toxicity

REGISTRY = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_chat_format": op7_chat_format,
    "op8_sharding": op8_sharding,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_near_dedup": op10_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_license_scan": op13_license_scan,
}

SQL = {
    "op5_exact_dedup": OP5_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
