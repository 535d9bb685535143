"""The queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .hnsw import op1_ann_hnsw
from .langid import op8_language_id
from .mixing import op3_source_mix
from .packing import op7_lexical_packing
from .pii import op9_pii
from .quality import op5_quality_mil
from .repeats import op4_suffix_dedup
from .simhash import op2_simhash_neardup
from .toolcalls import OP10_SQL, op10_chat_tool_calls
from .vectors import OP6_SQL, op6_exact_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ann_hnsw,
        op2_simhash_neardup,
        op3_source_mix,
        op4_suffix_dedup,
        op5_quality_mil,
        op6_exact_topk,
        op7_lexical_packing,
        op8_language_id,
        op9_pii,
        op10_chat_tool_calls,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the result; the others are held against brute force in the tests."""
    return {"op6_exact_topk": OP6_SQL, "op10_chat_tool_calls": OP10_SQL}
