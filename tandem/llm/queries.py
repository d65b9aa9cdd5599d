"""The queries of this subpackage and the SQL that must agree with them, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tandem.llm import bitplanes, chat, decontaminate, html_text, licenses, passages, pii, quality, sentencepiece_topk, simhash, token_alignment, topk_search, turn_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bitplanes": bitplanes.op1_bitplanes,
    "op2_chat_tree": chat.op2_chat_tree,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_passages": passages.op4_passages,
    "op5_pii": pii.op5_pii,
    "op6_html_text": html_text.op6_html_text,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_simhash": simhash.op8_simhash,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_sentencepiece": sentencepiece_topk.op10_sentencepiece,
    "op11_topk": topk_search.op11_topk,
    "op12_turn_trie": turn_trie.op12_turn_trie,
    "op13_token_alignment": token_alignment.op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op7_quality_rules": quality.ORACLE, "op11_topk": topk_search.ORACLE, "op12_turn_trie": turn_trie.ORACLE}
