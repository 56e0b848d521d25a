"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """UTC times, adaptive execution with skew handling; results need only the first.

    Shuffle files of a query go when it ends: plans here are cut by written tables, so nobody reads them again, and
    disk holds those tables and the shuffles of one query at a time.

    The wide projections of normalising and labelling exceed what the JVM is willing to
    compile as one method, so beyond that size each operator gets its own, split code.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark
