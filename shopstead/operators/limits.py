"""Fixed-window rate limits, duplicate suppression, and the activity feed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Requests allowed and window length in seconds, by action.
RATE_LIMITS = {"login": (10, 900), "register": (5, 3600), "scan": (10, 3600), "marketing": (60, 3600), "api": (300, 60)}


def window_start(ts: Column, seconds: int | Column) -> Column:
    """Epoch-aligned start of the window that holds a time, in seconds."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("long") * seconds


def verdicts(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Each request (id, key, ts) with its count so far in its key's window, and whether it passes."""
    start = window_start(F.col("ts"), seconds)
    order = Window.partitionBy("key", "window_start").orderBy("ts", "id")
    counted = events.withColumn("window_start", start).withColumn("n", F.row_number().over(order))
    left_ms = (F.col("window_start") + seconds) * 1000 - F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return counted.withColumns({"allowed": F.col("n") <= limit, "remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("n")), "retry_after_s": F.greatest(F.lit(1), F.ceil(left_ms / 1000)).cast("long")})


def live_windows(events: DataFrame, seconds: int, now: Column) -> DataFrame:
    """Counters that a purge at now leaves: windows whose end lies after it."""
    counts = events.withColumn("window_start", window_start(F.col("ts"), seconds)).groupBy("key", "window_start").agg(F.count("*").alias("n"))
    return counts.where((F.col("window_start") + seconds) > F.unix_seconds(now.cast("timestamp")))


def suppress_duplicates(events: DataFrame, keys: list[str], seconds: int = 60) -> DataFrame:
    """Drops events of a key within `seconds` (inclusive) of the last one kept. A dropped event does not extend the
    window, so this is a fold in time order; each task streams its sorted keys with one timestamp of state."""

    def run(batches):
        now, kept = None, None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            ts = batch.column(batch.schema.get_field_index("ts")).cast(pa.int64()).to_pylist()
            keep = []
            for i, key in enumerate(zip(*cols)):
                if key != now:
                    now, kept = key, None
                if kept is None or ts[i] - kept > seconds * 1_000_000:
                    kept = ts[i]
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return events.repartition(*keys).sortWithinPartitions(*keys, "ts", "id").mapInArrow(run, events.schema)


#: Kinds that ask for a decision, kinds worth a notice; others are routine.
ATTENTION = ("creativeNeedsReview", "offerProposed", "productUnavailable", "everythingPaused", "needsYourInput")
NOTICE = ("websiteChanged", "campaignLaunched", "campaignPaused", "priceChanged", "budgetReached", "everythingResumed", "providerFellBack")


def severity(kind: Column) -> Column:
    return F.when(kind.isin(*ATTENTION), "ATTENTION").when(kind.isin(*NOTICE), "NOTICE").otherwise("INFO")


def with_defaults(events: DataFrame) -> DataFrame:
    """severity and needs_attention filled in by kind where an event does not state them."""
    given = F.col("severity") if "severity" in events.columns else F.lit(None)
    level = F.coalesce(given, severity(F.col("kind")))
    asked = F.col("needs_attention") if "needs_attention" in events.columns else F.lit(None)
    return events.withColumns({"severity": level, "needs_attention": F.coalesce(asked, level == "ATTENTION")})


def pending_attention(events: DataFrame) -> DataFrame:
    """Open decisions of each business."""
    return with_defaults(events).where(F.col("needs_attention") & F.col("resolved_at").isNull()).groupBy("business_id").agg(F.count("*").alias("pending"))


def resolve(events: DataFrame, kinds: list[str], at: Column) -> DataFrame:
    """Open decisions of the given kinds marked resolved."""
    hit = F.col("kind").isin(*kinds) & F.col("needs_attention") & F.col("resolved_at").isNull()
    return events.withColumn("resolved_at", F.when(hit, at).otherwise(F.col("resolved_at")))


def recent(events: DataFrame, asked: int, most: int = 100) -> DataFrame:
    """The feed, newest first; the caller's limit is clamped."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(min(asked, most))
