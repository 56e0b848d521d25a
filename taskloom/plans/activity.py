"""Events in the raw-event shape, derived from the supplied event and page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_utc, stable_id

ACTIVITY_SQL = """
SELECT CAST(e.user_id AS STRING) AS stream_id, e.event_id AS seq, e.ts AS event_ts,
  e.event_type, e.k,
  CASE e.event_type WHEN 'click' THEN 'browser.click' WHEN 'view' THEN 'chrome.navigation'
       WHEN 'purchase' THEN 'form.submit' WHEN 'signup' THEN 'app.switch'
       ELSE 'file.download' END AS source_event_type,
  CASE WHEN e.event_type IN ('click','view','purchase') THEN 'chrome_extension'
       ELSE 'desktop' END AS source,
  CASE WHEN e.event_type IN ('click','view','purchase') THEN 'Google Chrome'
       WHEN e.k % 3 = 0 THEN 'Slack' WHEN e.k % 3 = 1 THEN 'Microsoft Excel'
       ELSE 'Outlook' END AS application,
  CASE WHEN e.k % 2 = 0 THEN CONCAT('Order #', CAST(1000 + e.k AS STRING), ' - Admin')
       END AS window_title,
  CASE WHEN e.event_type NOT IN ('click','view','purchase') THEN NULL
       WHEN e.k % 4 = 0 THEN CONCAT('https://admin.example.com/orders/', CAST(1000 + e.k AS STRING))
       WHEN e.k % 4 = 1 THEN CONCAT('https://docs.google.com/spreadsheets/d/', CAST(1000 + e.k AS STRING), '/edit')
       WHEN e.k % 4 = 2 THEN CONCAT('https://www.notion.so/', CAST(1000 + e.k AS STRING), '?view=list&token=x')
       ELSE p.url END AS url,
  CASE e.k % 5 WHEN 0 THEN 'search_order' WHEN 1 THEN 'status_dropdown'
               WHEN 3 THEN 'toolbar_button' WHEN 4 THEN 'export_orders_csv' END AS target
FROM (SELECT *, k % page_count AS page_no
      FROM (SELECT event_id, user_id, ts, event_type,
                   CAST(get_json_object(props, '$.k') AS INT) AS k,
                   CAST({page_count} AS BIGINT) AS page_count FROM {events})) e
JOIN {pages} p ON p.page_id = e.page_no
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` may be the events table as a stream; pages are always read as they are."""
    pages = table(spark, sf_dir, "pages")
    return spark.sql(
        ACTIVITY_SQL,
        events=table(spark, sf_dir, "events") if events is None else events,
        pages=pages.select("page_id", "url"),
        page_count=pages.count(),
    )


def raw_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Unsanitised raw events with millisecond times, as a collector would send them."""
    text = iso_utc(F.col("event_ts"))
    none = F.lit(None).cast("string")
    return activity(spark, sf_dir, events).select(
        stable_id("raw_event", F.col("stream_id"), F.col("seq").cast("string")).alias("id"),
        "stream_id",
        "seq",
        F.date_trunc("millisecond", "event_ts").alias("ts"),
        text.alias("ts_text"),
        "source",
        "source_event_type",
        "application",
        "window_title",
        none.alias("domain"),
        "url",
        none.cast("int").alias("browser_schema_version"),
        none.alias("canonical_url"),
        none.alias("route_template"),
        none.alias("route_key"),
        none.alias("resource_hash"),
        F.element_at(F.split("source_event_type", r"\."), -1).alias("action"),
        "target",
        F.lit("{}").alias("metadata"),
    )
