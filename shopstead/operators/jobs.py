"""The job queue as a table: claim order, transitions, leases, idempotent enqueue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Backoff base and cap in milliseconds, lease in seconds.
BASE_MS, MOST_MS, LEASE_S = 2000, 60_000, 300


def runnable(jobs: DataFrame, now: Column, types: list[str] | None = None) -> DataFrame:
    due = jobs.where((F.col("status") == "PENDING") & (F.col("run_at") <= now))
    return due.where(F.col("type").isin(*types)) if types else due


def claim(jobs: DataFrame, now: Column, workers: int, types: list[str] | None = None) -> DataFrame:
    """The next `workers` jobs: highest priority, then longest due, then least id; a top-k, not a sort of the queue."""
    head = runnable(jobs, now, types).orderBy(F.desc("priority"), "run_at", "id").limit(workers)
    return head.withColumns({"status": F.lit("RUNNING"), "started_at": now, "attempts": F.col("attempts") + 1})


def drain(jobs: DataFrame, now: Column, most: int = 100, budget_ms: int | None = None, types: list[str] | None = None) -> DataFrame:
    """The jobs that one drain of the queue runs, in order (n): at most `most`, and none once the jobs before it have taken
    budget_ms (took_ms says how long each takes). The budget is looked at between jobs, so the last may pass it. Only the
    first `most` rows are ever put in order."""
    head = claim(jobs, now, most, types)
    order = Window.orderBy(F.desc("priority"), "run_at", "id")
    spent = F.coalesce(F.sum("took_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = head.withColumns({"n": F.row_number().over(order), "spent_ms": spent})
    return rows if budget_ms is None else rows.where(F.col("spent_ms") < budget_ms)


def backoff_ms(attempt: Column, draw: Column) -> Column:
    """Exponential with full jitter; draw in [0, 1) is an input, so results repeat."""
    return F.floor(draw * F.least(F.lit(float(BASE_MS)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(MOST_MS))) + 0.5).cast("long")


def fail(jobs: DataFrame, now: Column, retryable: Column, draw: Column) -> DataFrame:
    """Running jobs after a failure: pending again while attempts remain; FAILED if not retryable, DEAD if exhausted."""
    left = F.col("attempts") < F.col("max_attempts")
    again = retryable & left
    delay = backoff_ms(F.greatest(F.col("attempts"), F.lit(1)), draw)
    run_at = F.when(again, F.timestamp_millis(F.unix_millis(now.cast("timestamp")) + delay).cast("timestamp_ntz")).otherwise(F.col("run_at"))
    return jobs.withColumns({"status": F.when(again, "PENDING").when(left, "FAILED").otherwise("DEAD"), "run_at": run_at, "will_retry": again})


def reclaim(jobs: DataFrame, now: Column, lease_s: int = LEASE_S) -> DataFrame:
    """Running jobs past their lease go back to pending."""
    stale = (F.col("status") == "RUNNING") & (F.col("started_at") < now - F.expr(f"INTERVAL {lease_s} SECOND"))
    return jobs.withColumns({"status": F.when(stale, "PENDING").otherwise(F.col("status")), "run_at": F.when(stale, now).otherwise(F.col("run_at")), "reclaimed": F.coalesce(stale, F.lit(False))})


def depth(jobs: DataFrame) -> DataFrame:
    """Pending and running jobs of each workspace."""
    return jobs.groupBy("workspace_id").agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "RUNNING").alias("running"))


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New jobs whose idempotency key is neither taken nor claimed by an earlier new one (least id); keyless ones all."""
    keyed = new.where("idempotency_key is not null").join(jobs.select("idempotency_key").where("idempotency_key is not null").distinct(), "idempotency_key", "left_anti")
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("idempotency_key").orderBy("id"))).where("_n = 1").drop("_n")
    return first.select(*new.columns).unionByName(new.where("idempotency_key is null"))


def paused_since(paused_at: Column, started_at: Column) -> Column:
    """Whether the business was paused strictly after the work began."""
    return F.coalesce(paused_at > started_at, F.lit(False))


def single_flight(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Scan requests of businesses that have no scan queued or running."""
    return requests.join(runs.where(F.col("status").isin("QUEUED", "RUNNING")).select("business_id").distinct(), "business_id", "left_anti")
