"""Queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import divergence, knn, lines, spelling
from vigil.llm.decontaminate import op6_decontaminate
from vigil.llm.divergence import op12_divergence
from vigil.llm.knn import op4_knn
from vigil.llm.langid import op2_langid
from vigil.llm.lines import op10_lines
from vigil.llm.neardup import op9_neardup
from vigil.llm.packing import op3_packing
from vigil.llm.pii import op8_pii
from vigil.llm.quality import op5_quality
from vigil.llm.spelling import op13_spelling
from vigil.llm.substrings import op7_substrings
from vigil.llm.suffixes import op11_suffixes
from vigil.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_langid, op3_packing, op4_knn, op5_quality, op6_decontaminate, op7_substrings, op8_pii, op9_neardup, op10_lines, op11_suffixes, op12_divergence, op13_spelling)}
ORACLE: dict[str, str] = {"op4_knn": knn.ORACLE, "op10_lines": lines.ORACLE, "op12_divergence": divergence.ORACLE, "op13_spelling": spelling.ORACLE}
