"""Writing an intermediate result once, where every executor can read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; if it names none, one below the warehouse.

    A warehouse on a machine's own disk will do for a local master only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        own = warehouse.startswith("file:") or "://" not in warehouse
        if own and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"{warehouse}/_stages")
        current = spark.sparkContext.getCheckpointDir()
    return current


def materialize(df: DataFrame, name: str = "stage", by: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Cut the lineage: the result is read from a columnar table, not recomputed.

    With ``by``, rows of equal keys are kept in one of ``tasks`` buckets, so what groups them by these columns reads them
    without a shuffle. The rows should come dealt by the same columns and number. Ids are digests, which only an
    entropy coder makes smaller.
    """
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    path = f"{scratch_dir(spark)}/{name}-{unique}"
    writer = df.write.option("compression", "zstd")
    if by is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"taskloom_{name}_{unique}"
    writer.format("parquet").option("path", path).bucketBy(tasks or partitions(spark), *by).saveAsTable(table)
    return spark.table(table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
