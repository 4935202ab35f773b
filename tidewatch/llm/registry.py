"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from tidewatch.llm.byte_bpe import op7_byte_bpe
from tidewatch.llm.decontaminate import OP3_SQL, op3_decontamination
from tidewatch.llm.html_text import op5_html_text
from tidewatch.llm.jaccard import OP10_SQL, op10_jaccard_join
from tidewatch.llm.metric_search import OP9_SQL, op9_metric_search
from tidewatch.llm.pii import op2_pii
from tidewatch.llm.quality import op8_quality
from tidewatch.llm.token_counts import op1_token_counts
from tidewatch.llm.token_files import op4_token_files
from tidewatch.llm.toxicity import op6_toxicity


def queries() -> dict:
    found = [op1_token_counts, op2_pii, op3_decontamination, op4_token_files, op5_html_text, op6_toxicity, op7_byte_bpe, op8_quality, op9_metric_search, op10_jaccard_join]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op3_decontamination": OP3_SQL, "op9_metric_search": OP9_SQL, "op10_jaccard_join": OP10_SQL}
