"""Registered queries over offers, costs, limits, feeds and jobs, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import jobs as queue
from ..operators import ledger, limits, offers
from ..sources.projections import as_sql, project

NOW, ORDERS_NOW = "2024-01-20 12:00:00", "1999-06-15 00:00:00"
_now = lambda t: F.lit(t).cast("timestamp_ntz")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _offer_sql(where: str, columns: str, low: str = "NULL::INT") -> str:
    return f"""
WITH b AS (SELECT *, price_cents * 5 // 100 AS discount, price_cents - price_cents * 5 // 100 AS result, {low} AS low FROM {as_sql("products")}),
m AS (SELECT *, coalesce(cost_cents > 0, false) AS known, CASE WHEN cost_cents > 0 THEN result - cost_cents END AS margin FROM b),
r AS (SELECT *, CASE WHEN availability = 'OUT_OF_STOCK' THEN 'it is out of stock'
  WHEN price_cents IS NULL OR price_cents <= 0 THEN NULL
  WHEN compare_price_cents > price_cents THEN 'it is already on sale'
  WHEN result <= 0 THEN 'the discount would take the price to zero'
  WHEN known AND margin <= 0 THEN 'the discount would sell it at a loss'
  WHEN known AND low IS NOT NULL AND margin::DOUBLE / result * 100 < low THEN 'it would leave less than your ' || low || '% minimum margin' END AS reason FROM m)
SELECT {columns} FROM r WHERE {where}"""


_PRICED = "price_cents IS NOT NULL AND price_cents > 0"


@query(_offer_sql("reason IS NULL", f"""id, CASE WHEN {_PRICED} THEN 'PERCENT_OFF' ELSE 'FREE_SHIPPING' END AS type,
  CASE WHEN {_PRICED} THEN 5::BIGINT END AS value, CASE WHEN {_PRICED} THEN price_cents END AS current_price_cents,
  CASE WHEN {_PRICED} THEN result END AS resulting_price_cents, {_PRICED} AND known AS margin_known, CASE WHEN {_PRICED} THEN margin END AS estimated_margin_cents"""))  # fmt: skip
def offer_proposals(spark, sf_dir):
    found = offers.propose(project(spark, sf_dir, "products")).where("reason is null")
    return found.select("id", "type", "value", "current_price_cents", "resulting_price_cents", "margin_known", "estimated_margin_cents")


@query("SELECT business_id, reason, count(*) AS n FROM (" + _offer_sql("reason IS NOT NULL", "business_id, reason", "15") + ") GROUP BY ALL")
def offer_skips_by_reason(spark, sf_dir):
    rules = spark.range(1, 60).select(F.col("id").cast("int").alias("business_id"), F.lit(15).alias("min_margin_percent"))
    found = offers.propose(project(spark, sf_dir, "products"), rules).where("reason is not null")
    return found.groupBy("business_id", "reason").agg(F.count("*").alias("n"))


@query(f"""SELECT id, business_id, created_at FROM {as_sql("offers")} WHERE status = 'ACTIVE' AND (ends_at IS NULL OR ends_at > TIMESTAMP '{ORDERS_NOW}')
  AND (starts_at IS NULL OR starts_at <= TIMESTAMP '{ORDERS_NOW}')""")
def active_offers_at(spark, sf_dir):
    return offers.active_at(project(spark, sf_dir, "offers"), _now(ORDERS_NOW)).select("id", "business_id", "created_at")


_SPEND = f"""SELECT workspace_id,
  CAST(coalesce(sum(coalesce(actual_cents, estimated_cents)) FILTER (WHERE created_at >= TIMESTAMP '2024-01-20'), 0) AS BIGINT) AS day_cents,
  CAST(coalesce(sum(coalesce(actual_cents, estimated_cents)) FILTER (WHERE created_at >= TIMESTAMP '2024-01-01'), 0) AS BIGINT) AS month_cents
  FROM {as_sql("cost_records")} WHERE tier = 'EXTERNAL_PAID' AND succeeded GROUP BY workspace_id"""


@query(_SPEND)
def spend_windows(spark, sf_dir):
    return ledger.spend_to_date(project(spark, sf_dir, "cost_records"), _now(NOW))


@query(f"""SELECT provider_key, tier, count(*) AS calls, CAST(sum(units) AS BIGINT) AS units, CAST(sum(estimated_cents) AS BIGINT) AS estimated_cents,
  CAST(sum(actual_cents) AS BIGINT) AS actual_cents, CAST(coalesce(sum(actual_cents), sum(estimated_cents), 0) AS BIGINT) AS shown_cents
  FROM {as_sql("cost_records")} GROUP BY provider_key, tier""")
def cost_by_provider(spark, sf_dir):
    return ledger.by_provider(project(spark, sf_dir, "cost_records"))


@query(f"""WITH t AS (SELECT workspace_id, CAST(coalesce(sum(coalesce(actual_cents, estimated_cents)) FILTER (WHERE tier = 'EXTERNAL_PAID' AND succeeded), 0) AS BIGINT) AS all_cents,
  count(*) FILTER (WHERE tier = 'LOCAL_FREE') AS free_calls, count(*) FILTER (WHERE tier = 'EXTERNAL_PAID') AS paid_calls FROM {as_sql("cost_records")} GROUP BY 1)
  SELECT workspace_id, all_cents, free_calls, paid_calls, coalesce(day_cents, 0) AS day_cents, coalesce(month_cents, 0) AS month_cents, all_cents = 0 AS is_free
  FROM t LEFT JOIN ({_SPEND}) s USING (workspace_id)""")
def cost_summary(spark, sf_dir):
    return ledger.summary(project(spark, sf_dir, "cost_records"), _now(NOW))


@query(f"""WITH s AS ({_SPEND}), c AS (SELECT id, workspace_id, tier, estimated_cents AS cost FROM {as_sql("cost_records")}),
  r AS (SELECT id, CASE WHEN tier = 'LOCAL_FREE' OR cost = 0 THEN 'free' WHEN cost > 20000 THEN 'single-call-ceiling'
    WHEN coalesce(day_cents, 0) + cost > 30000 THEN 'daily-ceiling' WHEN coalesce(month_cents, 0) + cost > 100000 THEN 'monthly-ceiling' ELSE 'within-ceilings' END AS reason
    FROM c LEFT JOIN s USING (workspace_id))
  SELECT id, reason, reason IN ('free', 'within-ceilings') AS allowed, CASE reason WHEN 'single-call-ceiling' THEN 20000::BIGINT WHEN 'daily-ceiling' THEN 30000 WHEN 'monthly-ceiling' THEN 100000 END AS ceiling_cents FROM r""")
def budget_decisions(spark, sf_dir):
    costs = project(spark, sf_dir, "cost_records")
    spend = ledger.spend_to_date(costs, _now(NOW))
    return ledger.decide(costs.select("id", "workspace_id", "tier", "estimated_cents"), spend, 20_000, 30_000, 100_000).select("id", "reason", "allowed", "ceiling_cents")


@query("""WITH b AS (SELECT c_custkey AS id, CAST(round(c_acctbal * 10) AS BIGINT) AS amount, CASE WHEN c_custkey % 2 = 0 THEN 'DAILY' ELSE 'MONTHLY' END AS period FROM customer),
  d AS (SELECT *, CASE WHEN period = 'DAILY' THEN amount ELSE CAST(floor(amount / 31) AS BIGINT) END AS day FROM b),
  e AS (SELECT *, CASE WHEN amount <= 0 THEN 'invalid' WHEN day < 1 THEN 'too-small' WHEN day > 60000 THEN 'over-ceiling' END AS error FROM d)
  SELECT id, error, CASE WHEN error IS NULL THEN day END AS daily, CASE WHEN error IS NULL THEN least(day * 31, 500000) END AS max_campaign,
  CASE WHEN error IS NULL THEN least(greatest(day // 2, 1), 5000) END AS approval_threshold,
  least(day, 60000) AS cap FROM e""")
def budget_resolution(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "CAST(round(c_acctbal * 10) AS BIGINT) AS amount", "CASE WHEN c_custkey % 2 = 0 THEN 'DAILY' ELSE 'MONTHLY' END AS period")
    limits_ = money.resolve_budget(F.col("amount"), F.col("period"), 60_000, 500_000, 5_000)
    return given.withColumn("b", limits_).select("id", "b.*", money.effective_daily_cap(F.col("amount"), F.col("period"), 60_000).alias("cap"))


_WINDOW = "CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600"


@query(f"""WITH w AS (SELECT id, key, ts, {_WINDOW} AS window_start FROM {as_sql("rate_events")}),
  n AS (SELECT *, row_number() OVER (PARTITION BY key, window_start ORDER BY ts, id) AS n FROM w)
  SELECT id, key, window_start, n, n <= 1 AS allowed, greatest(0, 1 - n) AS remaining,
  CAST(greatest(1, ceil(((window_start + 3600) * 1000 - floor(epoch_us(ts) / 1000)) / 1000)) AS BIGINT) AS retry_after_s FROM n""")
def rate_limit_verdicts(spark, sf_dir):
    found = limits.verdicts(project(spark, sf_dir, "rate_events"), 1, 3600)
    return found.select("id", "key", "window_start", F.col("n").cast("long").alias("n"), "allowed", F.col("remaining").cast("long").alias("remaining"), "retry_after_s")


@query(f"""SELECT key, window_start, count(*) AS n FROM (SELECT key, {_WINDOW} AS window_start FROM {as_sql("rate_events")})
  WHERE window_start + 3600 > epoch(TIMESTAMP '{NOW}') GROUP BY key, window_start""")
def rate_limit_purge(spark, sf_dir):
    return limits.live_windows(project(spark, sf_dir, "rate_events"), 3600, _now(NOW))


@query(f"""WITH RECURSIVE a AS (SELECT business_id, kind, message, created_at AS ts, id FROM {as_sql("activity")}),
  k AS (SELECT business_id, kind, message, min(ts) AS ts FROM a GROUP BY ALL
    UNION ALL SELECT a.business_id, a.kind, a.message, min(a.ts) FROM k JOIN a ON a.business_id = k.business_id AND a.kind = k.kind AND a.message = k.message AND a.ts > k.ts + INTERVAL 6 HOUR GROUP BY a.business_id, a.kind, a.message, k.ts)
  SELECT min(a.id) AS id, a.business_id, a.kind, a.message, a.ts FROM k JOIN a USING (business_id, kind, message, ts) GROUP BY ALL""")
def activity_dedup(spark, sf_dir):
    events = project(spark, sf_dir, "activity").select("id", "business_id", "kind", "message", F.col("created_at").alias("ts"))
    return limits.suppress_duplicates(events, ["business_id", "kind", "message"], 6 * 3600)


@query(f"""SELECT business_id, count(*) AS pending FROM {as_sql("activity")} WHERE kind IN ('needsYourInput', 'productUnavailable') AND resolved_at IS NULL GROUP BY 1""")
def attention_pending(spark, sf_dir):
    return limits.pending_attention(project(spark, sf_dir, "activity"))


@query(f"""SELECT id, kind, CASE WHEN kind = 'needsYourInput' AND resolved_at IS NULL THEN TIMESTAMP '{NOW}' ELSE resolved_at END AS resolved_at,
  CASE WHEN kind IN ('needsYourInput', 'productUnavailable') THEN 'ATTENTION' WHEN kind = 'priceChanged' THEN 'NOTICE' ELSE 'INFO' END AS severity FROM {as_sql("activity")}""")
def attention_resolution(spark, sf_dir):
    events = limits.with_defaults(project(spark, sf_dir, "activity"))
    return limits.resolve(events, ["needsYourInput"], _now(NOW)).select("id", "kind", "resolved_at", "severity")


@query(f"SELECT id, business_id, kind, created_at FROM {as_sql('activity')} ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_activity(spark, sf_dir):
    return limits.recent(project(spark, sf_dir, "activity"), 500).select("id", "business_id", "kind", "created_at")


@query(f"""SELECT id, priority, run_at, attempts + 1 AS attempts FROM {as_sql("jobs")} WHERE status = 'PENDING' AND run_at <= TIMESTAMP '{ORDERS_NOW}' AND type = 'website.scan'
  ORDER BY priority DESC, run_at, id LIMIT 50""")
def queue_claim_order(spark, sf_dir):
    return queue.claim(project(spark, sf_dir, "jobs"), _now(ORDERS_NOW), 50, ["website.scan"]).select("id", "priority", "run_at", "attempts")


@query(f"""WITH j AS (SELECT *, attempts < max_attempts AS left_, id % 7 <> 0 AS retryable, (id % 10) / 10.0::DOUBLE AS draw FROM {as_sql("jobs")} WHERE status = 'RUNNING')
  SELECT id, CASE WHEN retryable AND left_ THEN 'PENDING' WHEN left_ THEN 'FAILED' ELSE 'DEAD' END AS status, retryable AND left_ AS will_retry,
  CASE WHEN retryable AND left_ THEN TIMESTAMP '{ORDERS_NOW}' + to_milliseconds(CAST(floor(draw * least(2000.0::DOUBLE * pow(2, greatest(attempts, 1) - 1), 60000) + 0.5) AS BIGINT)) ELSE run_at END AS run_at FROM j""")
def queue_transitions(spark, sf_dir):
    running = project(spark, sf_dir, "jobs").where("status = 'RUNNING'")
    return queue.fail(running, _now(ORDERS_NOW), F.col("id") % 7 != 0, (F.col("id") % 10) / 10).select("id", "status", "will_retry", "run_at")


@query(f"""SELECT id, CASE WHEN stale THEN 'PENDING' ELSE status END AS status, CASE WHEN stale THEN TIMESTAMP '{ORDERS_NOW}' ELSE run_at END AS run_at
  FROM (SELECT *, coalesce(status = 'RUNNING' AND started_at < TIMESTAMP '{ORDERS_NOW}' - INTERVAL 300 SECOND, false) AS stale FROM {as_sql("jobs")})""")
def queue_reclaim(spark, sf_dir):
    return queue.reclaim(project(spark, sf_dir, "jobs"), _now(ORDERS_NOW)).select("id", "status", "run_at")


@query(f"SELECT workspace_id, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RUNNING') AS running FROM {as_sql('jobs')} GROUP BY 1")
def queue_depth(spark, sf_dir):
    return queue.depth(project(spark, sf_dir, "jobs"))


@query(f"""WITH j AS (SELECT id, idempotency_key AS k FROM {as_sql("jobs")}), old AS (SELECT * FROM j WHERE id % 10 < 3), new AS (SELECT * FROM j WHERE id % 10 >= 3)
  SELECT min(id) AS id, k AS idempotency_key FROM new WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM old WHERE k IS NOT NULL) GROUP BY k UNION ALL SELECT id, k FROM new WHERE k IS NULL""")
def enqueue_idempotent(spark, sf_dir):
    rows = project(spark, sf_dir, "jobs").select("id", "idempotency_key")
    return queue.enqueue(rows.where("id % 10 < 3"), rows.where("id % 10 >= 3"))
