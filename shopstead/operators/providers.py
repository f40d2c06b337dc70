"""Providers of a capability: listing, the choice between free and paid, guarded calls, model prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ledger


def listing(providers: DataFrame) -> DataFrame:
    """rank of each provider in its capability: highest priority first, then by key."""
    order = Window.partitionBy("capability").orderBy(F.desc("priority"), "key")
    return providers.withColumn("rank", F.row_number().over(order))


def offered(providers: DataFrame) -> DataFrame:
    """(capability, free, paid): the free provider that would serve, and all paid ones in listing order."""
    row = F.struct((-F.col("priority")).alias("order"), "key", "label", "priority", "configured", (F.col("implemented") & F.col("configured")).alias("usable"))
    rows = providers.withColumn("row", row)
    free = F.min(F.when((F.col("tier") == ledger.FREE) & F.col("row.usable"), F.col("row")))
    paid = F.array_sort(F.collect_list(F.when(F.col("tier") == ledger.PAID, F.col("row"))))
    return rows.groupBy("capability").agg(free.alias("free"), paid.alias("paid"))


def _with_offers(requests: DataFrame, providers: DataFrame, settings: DataFrame) -> DataFrame:
    on = settings.where("enabled").groupBy("workspace_id").agg(F.collect_set("key").alias("on"))
    return requests.join(offered(providers), "capability", "left").join(on, "workspace_id", "left")


def choose(requests: DataFrame, providers: DataFrame, settings: DataFrame) -> DataFrame:
    """requests (workspace_id, capability, zero_cost) with provider_key, tier and reason.

    A paid provider serves only if it is implemented, configured, switched on by the workspace and of no lower priority
    than the free one. Without a free provider there is no choice at all. Each capability is a row, however many ask.
    """
    c = F.col
    usable = F.filter("paid", lambda x: x["usable"])
    best = F.get(F.filter("paid", lambda x: x["usable"] & F.array_contains("on", x["key"])), F.lit(0))
    rows = _with_offers(requests, providers, settings).withColumns({"best": best, "any_paid": F.size(usable) > 0})
    paid = ~c("zero_cost") & F.coalesce(c("best.priority") >= c("free.priority"), F.lit(False))
    reason = F.when(c("free").isNull(), "no-free-provider").when(c("zero_cost"), "zero-cost-mode").when(paid, "paid-enabled")
    reason = reason.when(c("any_paid"), "paid-not-enabled").otherwise("only-free-available")
    key = F.when(c("free").isNotNull(), F.when(paid, c("best.key")).otherwise(c("free.key")))
    tier = F.when(c("free").isNotNull(), F.when(paid, ledger.PAID).otherwise(ledger.FREE))
    return rows.select(*requests.columns, key.alias("provider_key"), tier.alias("tier"), reason.alias("reason"), c("free.key").alias("free_key"))


def summarise(requests: DataFrame, providers: DataFrame, settings: DataFrame) -> DataFrame:
    """choose() with `alternatives`: every paid provider of the capability, and whether it is configured and switched on."""
    both = _with_offers(requests, providers, settings)
    is_on = lambda key: F.coalesce(F.array_contains("on", key), F.lit(False))
    rows = F.transform("paid", lambda x: F.struct(x["key"].alias("key"), x["label"].alias("label"), x["configured"].alias("configured"), is_on(x["key"]).alias("enabled")))
    found = both.select("workspace_id", "capability", rows.alias("alternatives"))
    return choose(requests, providers, settings).join(found, ["workspace_id", "capability"])


def why_blocked(tier: Column, implemented: Column, configured: Column, zero_cost: bool, daily: int, monthly: int) -> Column:
    """Why a paid provider cannot be switched on; NULL if it can. A NULL tier is a provider that nobody knows."""
    found = F.when(tier.isNull(), "unknown-provider").when(tier != ledger.PAID, "not-paid").when(~implemented, "not-implemented")
    return found.when(F.lit(zero_cost), "zero-cost-mode").when(~configured, "no-credentials").when(F.lit(daily == 0 and monthly == 0), "no-allowance")


def guarded(requests: DataFrame, providers: DataFrame, settings: DataFrame, spend: DataFrame, single: int, daily: int, monthly: int) -> DataFrame:
    """Calls (id, workspace_id, capability, zero_cost, estimated_cents, succeeded) as the ledger records them.

    The choice, then the budget check against what the workspace has spent and its own ceilings; a paid call that is
    refused falls back to the free provider. Calls that no provider serves are left out.
    """
    own = settings.groupBy(F.col("workspace_id"), F.col("key").alias("provider_key")).agg(F.min("daily_cents").alias("provider_daily_cents"), F.min("monthly_cents").alias("provider_monthly_cents"))
    chosen = choose(requests, providers, settings).where("provider_key is not null").withColumnRenamed("reason", "choice")
    checked = ledger.decide(chosen.join(own, ["workspace_id", "provider_key"], "left"), spend, single, daily, monthly)
    back = ~F.col("allowed")
    key, tier = F.when(back, F.col("free_key")).otherwise(F.col("provider_key")), F.when(back, ledger.FREE).otherwise(F.col("tier"))
    asked = F.when(tier == ledger.PAID, F.col("estimated_cents")).otherwise(0)
    recorded = {"fell_back_because": F.when(back, F.col("reason")), "provider_key": key, "tier": tier, "estimated_cents": asked}
    rows = checked.withColumns(recorded)
    return rows.withColumn("actual_cents", ledger.outcome_row(F.col("tier"), F.col("estimated_cents"), F.col("estimated_cents"), F.col("succeeded")))


def priced(models: DataFrame, prices: DataFrame, fallback: bool = False) -> DataFrame:
    """models (model) with input_cents and output_cents per million tokens: of the model itself, else of the first family
    (prices by seq) whose name and a dash it starts with, else NULL or, with fallback, the dearest of each.

    A model joins on each of its prefixes that end before a dash, so no pair of tables is compared row by row.
    """
    parts = F.split("model", "-")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    asked = models.select("model").distinct().withColumn("family", F.explode(names))
    best = F.min_by(F.struct("input_cents", "output_cents"), F.struct(F.col("family") != F.col("model"), "seq"))
    found = asked.join(prices, "family").groupBy("model").agg(best.alias("price")).select("model", "price.*")
    out = models.join(found, "model", "left")
    if fallback:
        most = prices.agg(F.max("input_cents").alias("i"), F.max("output_cents").alias("o")).first()
        out = out.withColumns({"input_cents": F.coalesce("input_cents", F.lit(most["i"])), "output_cents": F.coalesce("output_cents", F.lit(most["o"]))})
    return out


def prompt_length(instruction: Column, data: Column) -> Column:
    """Characters of a prompt with its labelled data (map<string, string>), and a fifth for what is put around them."""
    sizes = F.aggregate(F.map_entries(F.coalesce(data, F.create_map().cast("map<string,string>"))), F.lit(0), lambda n, e: n + F.length(e["key"]) + F.length(e["value"]))
    return F.ceil((F.length(instruction) + sizes) * 1.2).cast("long")
