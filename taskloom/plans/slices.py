"""Time slices: the unit by which one stream is spread over many tasks.

A stream may hold a large share of all rows, so nothing here groups by stream alone.
Work that needs the row before is done inside a (stream, slice) group; what a slice
needs to know about earlier slices travels in a table with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

NO_TIME = 2**62


def home_slice(slice_ms: int) -> Column:
    """Slice of a row. Rows without a readable time come after all others."""
    return F.coalesce(
        F.floor(F.unix_millis("ts") / F.lit(slice_ms)), F.lit(NO_TIME // slice_ms)
    ).cast("long")


ORDER = ["ms", "tie", "seq"]


def with_order(events):
    """Position in the stream: instant, the text of unreadable times, input order."""
    return events.withColumns(
        {
            "ms": F.coalesce(F.unix_millis("ts"), F.lit(NO_TIME)),
            "tie": F.when(F.col("ts").isNull(), F.col("ts_text")),
        }
    )


def order_key() -> Column:
    return F.struct(*ORDER)


def in_slices(df, slice_ms: int):
    return with_order(df if "slice" in df.columns else df.withColumn("slice", home_slice(slice_ms)))


def _before(keys):
    return Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)


def with_previous_row(df, keys: list[str], name: str, fields: list[str], slice_ms: int):
    """Add ``name``: a struct of the previous row of the same keys, over slice edges."""
    rows = in_slices(df, slice_ms)
    here = F.struct(*fields)
    w = Window.partitionBy(*keys, "slice").orderBy(*ORDER)
    far = (
        rows.groupBy(*keys, "slice")
        .agg(F.max_by(here, order_key()).alias("_tail"))
        .select(*keys, "slice", F.last("_tail").over(_before(keys)).alias("_far"))
    )
    return (
        rows.withColumns({"_near": F.lag(here).over(w), "_n": F.row_number().over(w)})
        .join(far, [*keys, "slice"], "left")
        .withColumn(name, F.when(F.col("_n") > 1, F.col("_near")).otherwise(F.col("_far")))
        .drop("_near", "_far", "_n")
    )


def with_next_row(df, keys: list[str], name: str, fields: list[str], slice_ms: int):
    """Add ``name``: a struct of the next row of the same keys, over slice edges."""
    rows = in_slices(df, slice_ms)
    here = F.struct(*fields)
    w = Window.partitionBy(*keys, "slice").orderBy(*ORDER)
    far = (
        rows.groupBy(*keys, "slice")
        .agg(F.min_by(here, order_key()).alias("_head"))
        .select(
            *keys,
            "slice",
            F.lead("_head").over(Window.partitionBy(*keys).orderBy("slice")).alias("_far"),
        )
    )
    return (
        rows.withColumn("_near", F.lead(here).over(w))
        .join(far, [*keys, "slice"], "left")
        .withColumn(name, F.coalesce("_near", "_far"))
        .drop("_near", "_far")
    )


def with_running_number(df, keys: list[str], name: str, slice_ms: int):
    """Add ``name``: 1, 2, 3, ... along the keys' rows, over slice edges."""
    rows = in_slices(df, slice_ms)
    w = Window.partitionBy(*keys, "slice").orderBy(*ORDER)
    offset = (
        rows.groupBy(*keys, "slice")
        .agg(F.count("*").alias("_size"))
        .select(*keys, "slice", F.coalesce(F.sum("_size").over(_before(keys)), F.lit(0)).alias("_offset"))
    )
    return (
        rows.withColumn("_n", F.row_number().over(w))
        .join(offset, [*keys, "slice"])
        .withColumn(name, F.col("_n") + F.col("_offset"))
        .drop("_n", "_offset")
    )


def with_running_max(df, keys: list[str], values: dict[str, Column], slice_ms: int):
    """Add the running maximum of each value along the keys' rows, over slice edges."""
    rows = in_slices(df, slice_ms).withColumns({f"_v_{n}": c for n, c in values.items()})
    w = Window.partitionBy(*keys, "slice").orderBy(*ORDER)
    far = (
        rows.groupBy(*keys, "slice")
        .agg(*[F.max(f"_v_{n}").alias(f"_m_{n}") for n in values])
        .select(*keys, "slice", *[F.max(f"_m_{n}").over(_before(keys)).alias(f"_f_{n}") for n in values])
    )
    near = rows.withColumns({f"_w_{n}": F.max(f"_v_{n}").over(w) for n in values})
    joined = near.join(far, [*keys, "slice"], "left")
    return joined.withColumns(
        {n: F.coalesce(F.col(f"_w_{n}"), F.col(f"_f_{n}")) for n in values}
    ).drop(*[f"_{p}_{n}" for n in values for p in "vwmf"])


def in_stream_order(df, keys: list[str], order: list[str]):
    """Whole keys per task, rows sorted, for a walk in Python.

    The number of tasks is stated, because row sizes say little about the work per row.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)
