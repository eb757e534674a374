"""Session factory: UTC, adaptive execution, ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "quernstone", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return a session with the settings every operator assumes.

    Timestamps are UTC; adaptive execution coalesces and splits shuffle
    partitions, so ``shuffle_partitions`` is an upper bound, not a fixed layout.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
