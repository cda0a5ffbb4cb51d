"""The operators' registered queries and, where SQL can state them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from saldo.llm import chat_examples, chunk_dedup, collocations, html_text, neighbours, pieces, quality_rules, simhash, source_mix, spelling_variants, toxicity, url_filters, warc_store

LLM_QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_warc": warc_store.op5_warc,
    "op6_pieces": pieces.op6_pieces,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_chunk_dedup": chunk_dedup.op8_chunk_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_source_mix": source_mix.op10_source_mix,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_chat_examples": chat_examples.op12_chat_examples,
    "op13_collocations": collocations.op13_collocations,
    "pipeline": corpus_pipeline.run,
}

LLM_SQL = {
    "op2_url_filters": url_filters.SQL,
    "op5_warc": warc_store.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op10_source_mix": source_mix.SQL,
    "op12_chat_examples": chat_examples.SQL,
    "op13_collocations": collocations.SQL,
}
