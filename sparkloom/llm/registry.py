"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .op1_warc import op1_warc
from .op10_viterbi import op10_viterbi
from .op2_jaccard import op2_jaccard
from .op3_pii import op3_pii
from .op4_difference_cover import op4_difference_cover
from .op5_quality import op5_quality
from .op6_lattice import op6_lattice
from .op7_forest import op7_forest
from .op8_packing import op8_packing
from .op9_sparse_suffix import op9_sparse_suffix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc, op2_jaccard, op3_pii, op4_difference_cover, op5_quality, op6_lattice, op7_forest, op8_packing, op9_sparse_suffix, op10_viterbi]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
