"""Cost ledger: spend windows, groups, ceilings and the decision whether a call may be made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAID, FREE = "EXTERNAL_PAID", "LOCAL_FREE"
#: A row's cost: what was charged where it is known, else the estimate.
BILLED = "coalesce(actual_cents, estimated_cents)"


def spend_to_date(costs: DataFrame, now: Column) -> DataFrame:
    """(workspace_id, day_cents, month_cents): successful paid cost since the UTC day and month of now began, one scan."""
    paid = costs.where((F.col("tier") == PAID) & F.col("succeeded"))
    since = lambda unit: F.coalesce(F.sum(F.when(F.col("created_at") >= F.date_trunc(unit, now).cast("timestamp_ntz"), F.expr(BILLED))), F.lit(0)).cast("long")
    return paid.groupBy("workspace_id").agg(since("day").alias("day_cents"), since("month").alias("month_cents"))


def by_provider(costs: DataFrame) -> DataFrame:
    """Per provider and tier: calls, units, sums, and the cost shown, which falls back for the group as a whole."""
    return costs.groupBy("provider_key", "tier").agg(
        F.count("*").alias("calls"), F.sum("units").cast("long").alias("units"), F.sum("estimated_cents").alias("estimated_cents"),
        F.sum("actual_cents").alias("actual_cents"), F.coalesce(F.sum("actual_cents"), F.sum("estimated_cents"), F.lit(0)).alias("shown_cents"),
    )


def summary(costs: DataFrame, now: Column) -> DataFrame:
    """Per workspace: spend windows, all-time paid spend, calls by tier (failed ones count), and whether all was free."""
    totals = costs.groupBy("workspace_id").agg(
        F.coalesce(F.sum(F.when((F.col("tier") == PAID) & F.col("succeeded"), F.expr(BILLED))), F.lit(0)).alias("all_cents"),
        F.count_if(F.col("tier") == FREE).alias("free_calls"), F.count_if(F.col("tier") == PAID).alias("paid_calls"),
    )
    joined = totals.join(spend_to_date(costs, now), "workspace_id", "left")
    return joined.withColumns({"day_cents": F.coalesce("day_cents", F.lit(0)), "month_cents": F.coalesce("month_cents", F.lit(0)), "is_free": F.col("all_cents") == 0})


def lower_of(platform: Column, provider: Column) -> Column:
    return F.when(provider.isNull(), platform).otherwise(F.least(platform, provider))


def decide(calls: DataFrame, spend: DataFrame, single: int, daily: int, monthly: int) -> DataFrame:
    """Each call (workspace_id, tier, estimated_cents, optional provider ceilings) with allowed, reason, ceiling_cents.

    Guards in order: free, zero-cost mode, single call, day, month. Free calls never look at spend.
    """
    c, cost = F.col, F.col("estimated_cents")
    calls = calls.join(spend, "workspace_id", "left").withColumns({"day_cents": F.coalesce("day_cents", F.lit(0)), "month_cents": F.coalesce("month_cents", F.lit(0))})
    own = lambda name: c(name) if name in calls.columns else F.lit(None).cast("long")
    day, month = lower_of(F.lit(daily), own("provider_daily_cents")), lower_of(F.lit(monthly), own("provider_monthly_cents"))
    steps = [
        ((c("tier") == FREE) | (cost == 0), "free", F.lit(None)), (F.lit(daily == 0 and monthly == 0), "zero-cost-mode", F.lit(0)), (cost > single, "single-call-ceiling", F.lit(single)),
        (c("day_cents") + cost > day, "daily-ceiling", day), (c("month_cents") + cost > month, "monthly-ceiling", month),
    ]
    reason = ceiling = None
    for test, name, limit in steps:
        reason = F.when(test, name) if reason is None else reason.when(test, name)
        ceiling = F.when(test, limit.cast("long")) if ceiling is None else ceiling.when(test, limit.cast("long"))
    reason = reason.otherwise("within-ceilings")
    return calls.withColumns({"reason": reason, "ceiling_cents": ceiling, "allowed": reason.isin("free", "within-ceilings")})


def outcome_row(tier: Column, estimated: Column, reported: Column, succeeded: Column) -> Column:
    """What the ledger stores as actual cost: reported on success; NULL for failed paid calls, 0 for failed free ones."""
    return F.when(succeeded, reported).when(tier == PAID, F.lit(None)).otherwise(F.lit(0)).cast("long")
