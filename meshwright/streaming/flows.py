"""Flows assembled from a stream of spans: complete when quiet, by event time and watermark.

A flow ends when no span of it began for ``quiet``; session windows close it once the watermark
has passed, so late spans within the watermark still join. State is one small aggregate a flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(spans: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """spans plus at (from start_ns, to the microsecond) and a watermark on it."""
    return spans.withColumn("at", F.timestamp_micros((F.col("start_ns") / 1000).cast("long"))).withWatermark("at", delay)


def complete_flows(spans: DataFrame, quiet: str = "10 seconds", delay: str = "30 seconds") -> DataFrame:
    """flow, service, began, ended, n_spans, n_heads, n_errors, synthesized of flows that fell quiet."""
    out = with_event_time(spans, delay).groupBy("flow", "service", F.session_window("at", quiet).alias("w")).agg(
        F.count("*").alias("n_spans"), F.count_if(F.col("parent").isNull()).alias("n_heads"), F.count_if(F.col("status") == "error").alias("n_errors"))
    return out.select("flow", "service", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n_spans", "n_heads", "n_errors", (F.col("n_heads") != 1).alias("synthesized"))


def whole_flows(spans: DataFrame, quiet: str = "10 seconds", delay: str = "30 seconds") -> DataFrame:
    """flow, n_spans, services: the same across services."""
    out = with_event_time(spans, delay).groupBy("flow", F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("n_spans"), F.array_sort(F.collect_set("service")).alias("services"))
    return out.drop("w")


def marker_coverage(spans: DataFrame, marker: str, window: str = "1 minute", delay: str = "30 seconds") -> DataFrame:
    """began, n_spans, n_marked: how many spans of a window carry an attribute."""
    marked = F.try_element_at("attrs", F.lit(marker)).isNotNull()
    out = with_event_time(spans, delay).groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("n_spans"), F.count_if(marked).alias("n_marked"))
    return out.select(F.col("w.start").alias("began"), "n_spans", "n_marked")


def stale(flows: DataFrame, limit: str = "1 hour") -> DataFrame:
    """Flows plus stale: they ended longer ago than the limit, seen from the newest."""
    newest = flows.agg(F.max("ended").alias("newest"))
    return flows.join(F.broadcast(newest)).withColumn("stale", F.col("ended") < F.col("newest") - F.expr(f"INTERVAL {limit}")).drop("newest")  # one row
