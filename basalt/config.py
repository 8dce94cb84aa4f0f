"""Result-neutral settings by name, applied as Spark configuration.

``k=v;k=v`` strings are accepted, and :func:`with_config` restores what was set
before. Keys that steer mechanisms Spark owns are accepted and do nothing; those
in ``OWN`` are read by this engine, from the session, under ``basalt.<name>``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Setting names and their defaults.
DEFAULTS: dict[str, str] = {
    "parallelism": "", "vector_size": "1024", "morsel_size": "16384",
    "enable_optimizations": "true", "enable_reoptimize": "true", "runtime_feedback": "true",
    "enable_output": "true", "enable_profiling": "true",
    "compilation_strategy": "none", "max_tuples": str(2**40),
    "dynamic_minmax": "true",
}
#: Settings of this engine: the row bound of sums, and what ``result.run`` does.
OWN = {"max_tuples", "enable_output", "enable_profiling"}
#: Names accepted without effect here.
NEUTRAL = {
    "table_load_factor", "inline_operators", "default_flavor", "compilation_flavor", "max_risk_budget",
    "max_execute_progress", "enable_cache", "enable_learning", "has_full_evaluation",
    "full_evaluation_bit_score_divisor", "table_cardinality_multiplier", "enable_trace_profiling", "verify_code_fragments", "paranoid_mode", "asynchronous_compilation",
}


def parse(text: str) -> dict[str, str]:
    out = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        key, sep, value = part.partition("=")
        if not sep:
            raise ValueError(f"no '=' in {part!r}")
        out[key.strip()] = value.strip()
    return out


def _known(key: str) -> bool:
    return key in DEFAULTS or key in NEUTRAL or key.endswith("_seed") or key.startswith("adaptive_")


def spark_settings(config: dict[str, str]) -> dict[str, str]:
    """The Spark settings that these stand for."""
    if unknown := [k for k in config if not _known(k)]:
        raise KeyError(f"unknown setting {unknown}")
    out: dict[str, str] = {}
    truth = lambda v: str(v.lower() in ("1", "true", "yes", "on")).lower()
    for k, v in config.items():
        if k == "parallelism" and v:
            out["spark.sql.shuffle.partitions"] = str(int(v))
        elif k == "vector_size":
            out["spark.sql.parquet.columnarReaderBatchSize"] = str(int(v))
        elif k == "morsel_size":
            out["spark.sql.files.maxPartitionBytes"] = str(max(1 << 20, int(v) * 64))
        elif k == "enable_optimizations":
            out["spark.sql.codegen.wholeStage"] = truth(v)
        elif k in ("enable_reoptimize", "runtime_feedback"):
            out["spark.sql.adaptive.enabled"] = truth(v)
        elif k == "dynamic_minmax":
            out["spark.sql.parquet.filterPushdown"] = truth(v)
        elif k in OWN:
            out[f"basalt.{k}"] = str(int(float(v))) if k == "max_tuples" else truth(v)
        elif k == "compilation_strategy":
            out["spark.sql.codegen.wholeStage"] = str(v != "none").lower()
    return out


def setting(spark: SparkSession, key: str) -> str:
    """What one of this engine's settings is in this session."""
    return spark.conf.get(f"basalt.{key}", DEFAULTS[key])


@contextmanager
def with_config(spark: SparkSession, config: dict[str, str] | str) -> Iterator[None]:
    settings = spark_settings(parse(config) if isinstance(config, str) else config)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
