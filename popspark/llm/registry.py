"""The queries of this subpackage and the SQL that gives their rows, where SQL can."""

from __future__ import annotations

import corpus_pipeline
from popspark.llm import alignment, ann, binary_output, chat, embedding_dedup, exact_topk, line_dedup, mixing, near_dedup, packing, quality, resampling, substring_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_exact_topk": exact_topk.op2_exact_topk,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_packing": packing.op5_packing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_chat": chat.op7_chat,
    "op8_ann": ann.op8_ann,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "pipeline": corpus_pipeline.run,
    "op10_binary_output": binary_output.op10_binary_output,
    "op11_alignment": alignment.op11_alignment,
    "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
    "op13_resampling": resampling.op13_resampling,
}
SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_exact_topk": exact_topk.SQL,
    "op3_mixing": mixing.SQL,
    "op7_chat": chat.SQL,
    "op12_embedding_dedup": embedding_dedup.SQL,
    "op13_resampling": resampling.SQL,
}
