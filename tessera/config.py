"""Process-wide settings, and the Spark session that suits them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tessera.errors import FailedPrecondition


@dataclass(frozen=True)
class Settings:
    """brute_force_ratio: an index of cells isn't probed if a filter leaves fewer rows than this share, but read whole.

    optimize_threads, fts_brute_force_ratio and invert_to_forward_scan_ratio are taken for callers that set them and change nothing:
    how many tasks run, and whether a filter is met by statistics or by a scan, is for Spark's scheduler and optimizer to choose.
    """

    query_threads: int = 0
    optimize_threads: int = 0
    memory_limit_mb: int = 0
    log_level: str = "WARN"
    shuffle_partitions: int = 0
    brute_force_ratio: float = 0.1
    fts_brute_force_ratio: float = 0.05
    invert_to_forward_scan_ratio: float = 0.9


_now: Settings | None = None


def init(**values) -> Settings:
    """Set once for the process."""
    global _now
    if _now is not None:
        raise FailedPrecondition("already initialised")
    _now = Settings(**values)
    return _now


def settings() -> Settings:
    return _now or Settings()


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow."""
    s = settings()
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if s.query_threads:
        b = b.config("spark.master", f"local[{s.query_threads}]")
    if s.memory_limit_mb:
        b = b.config("spark.driver.memory", f"{s.memory_limit_mb}m")
    if s.shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(s.shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel(s.log_level)
    return spark
