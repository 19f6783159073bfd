"""Queries and SQL of this subpackage, for the entry module of the repository."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import storage
from .decontaminate import OP5_SQL, op5_decontamination
from .language import op4_language_id
from .license import op7_license
from .minhash import op1_minhash
from .packing import op3_packing
from .quality import OP9_SQL, op9_quality_rules
from .repeats import op6_suffix_dedup
from .token_binary import op8_token_binary
from .url_filter import op10_url_filter
from .warc import op2_warc

_QUERIES = [op1_minhash, op2_warc, op3_packing, op4_language_id, op5_decontamination, op6_suffix_dedup, op7_license, op8_token_binary, op9_quality_rules, op10_url_filter]


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        storage.ship_package(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipped(q) for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op9_quality_rules": OP9_SQL}
