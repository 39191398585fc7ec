"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP5_SQL, op5_chat
from .classifier import op4_quality
from .decontamination import op8_decontamination
from .line_dedup import op3_line_dedup
from .lm import op7_lm_scoring
from .mixing import OP6_SQL, op6_mixing
from .pii import op1_pii
from .quality_rules import OP10_SQL, op10_quality_rules
from .simhash import op2_simhash
from .token_counts import op9_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_mixing": op6_mixing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {"op5_chat": OP5_SQL, "op6_mixing": OP6_SQL, "op10_quality_rules": OP10_SQL}
