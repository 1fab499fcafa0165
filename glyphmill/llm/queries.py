"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .brown import op7_brown_lm
from .collocations import OP13_SQL, op13_collocations
from .decontaminate import op1_decontaminate
from .chat import OP3_SQL, op3_chat_format
from .idfiles import op10_ids
from .licences import op6_licences
from .lines import OP12_SQL, op12_lines
from .neardup import OP4_SQL, op4_neardup
from .pieces import op8_sentencepiece
from .privacy import op5_pii
from .rules import op9_quality
from .spelling import OP11_SQL, op11_spelling
from .substrings import OP2_SQL, op2_substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_decontaminate": op1_decontaminate,
    "op2_substrings": op2_substrings,
    "op3_chat_format": op3_chat_format,
    "op4_neardup": op4_neardup,
    "op5_pii": op5_pii,
    "op6_licences": op6_licences,
    "op7_brown_lm": op7_brown_lm,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_ids": op10_ids,
    "op11_spelling": op11_spelling,
    "op12_lines": op12_lines,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op2_substrings": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op4_neardup": OP4_SQL,
    "op11_spelling": OP11_SQL,
    "op12_lines": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
