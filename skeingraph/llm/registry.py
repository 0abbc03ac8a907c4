"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op8_chat
from .clustering import op13_clusters
from .decontaminate import op10_decontaminate
from .language import op4_language
from .neighbours import op9_neighbours
from .notices import op11_licenses
from .oracles import ORACLES
from .packing import op3_packing
from .quality import op1_quality
from .resampling import op12_resampling
from .simhash import op2_simhash
from .substring import op6_substring
from .suffixes import op7_suffixes
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_substring": op6_substring,
    "op7_suffixes": op7_suffixes,
    "op8_chat": op8_chat,
    "op9_neighbours": op9_neighbours,
    "op10_decontaminate": op10_decontaminate,
    "op11_licenses": op11_licenses,
    "op12_resampling": op12_resampling,
    "op13_clusters": op13_clusters,
}
__all__ = ["ORACLES", "QUERIES"]
