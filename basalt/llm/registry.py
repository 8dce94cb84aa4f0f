"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .bpe import op9_bpe
from .fingerprint import op7_fingerprint
from .licenses import op4_license_scan
from .media import op2_media
from .near_duplicates import op3_near_duplicates
from .packing import op6_packing
from .quality import op8_quality
from .substring_dedup import op10_substring_dedup
from .suffix_dedup import op1_suffix_dedup
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_media": op2_media,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_license_scan": op4_license_scan,
        "op5_warc": op5_warc,
        "op6_packing": op6_packing,
        "op7_fingerprint": op7_fingerprint,
        "op8_quality": op8_quality,
        "op9_bpe": op9_bpe,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op3_near_duplicates": oracles.NEAR_DUPLICATES,
        "op5_warc": WARC_SQL,
        "op10_substring_dedup": oracles.SUBSTRING_DEDUP,
    }
