"""Offer proposals: ordered guards, integer discounts, margins only where a cost is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rules of a business that never set any.
DEFAULT_RULES = {"max_discount_percent": 20, "min_discount_percent": 5, "min_margin_percent": None, "allow_percentage": True, "allow_fixed": True, "allow_free_shipping": True}


def with_rules(products: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """products beside their business's rules; defaults where a business has none."""
    if rules is not None:
        products = products.join(rules, "business_id", "left")
    own = set() if rules is None else set(rules.columns)
    kinds = {bool: "boolean", int: "int", type(None): "int"}
    new = {}
    for name, value in DEFAULT_RULES.items():
        default = F.lit(value).cast(kinds[type(value)])
        new[name] = F.coalesce(F.col(name), default) if name in own else default
    return products.withColumns(new)


def propose(products: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Each product with either an offer (type, value, prices, margin) or the reason why not."""
    c = F.col
    base = with_rules(products, rules)
    no_price = c("price_cents").isNull() | (c("price_cents") <= 0)
    discount = F.expr("price_cents * min_discount_percent div 100")
    result = c("price_cents") - discount
    known = c("cost_cents").isNotNull() & (c("cost_cents") > 0)
    margin = F.when(known, result - c("cost_cents"))
    low = c("min_margin_percent").isNotNull() & (margin / result * 100 < c("min_margin_percent"))
    reason = (
        F.when(c("availability") == "OUT_OF_STOCK", "it is out of stock")
        .when(no_price, F.when(~c("allow_free_shipping"), "its page states no price"))
        .when(~c("allow_percentage") & ~c("allow_fixed"), "your settings do not allow discounts")
        .when(c("compare_price_cents") > c("price_cents"), "it is already on sale")
        .when((c("min_discount_percent") <= 0) | (c("min_discount_percent") > c("max_discount_percent")), "your discount settings leave no room")
        .when(result <= 0, "the discount would take the price to zero")
        .when(known & (margin <= 0), "the discount would sell it at a loss")
        .when(known & low, F.concat(F.lit("it would leave less than your "), c("min_margin_percent").cast("string"), F.lit("% minimum margin")))
    )
    kind = F.when(no_price, "FREE_SHIPPING").when(c("allow_percentage"), "PERCENT_OFF").otherwise("FIXED_OFF")
    base = base.withColumn("reason", reason)
    offer = lambda x: F.when(c("reason").isNull(), x)
    priced = lambda x: offer(F.when(~no_price, x))
    value = F.when(c("allow_percentage"), c("min_discount_percent").cast("long")).otherwise(discount)
    return base.withColumns({
        "type": offer(kind), "value": priced(value), "current_price_cents": priced(c("price_cents")), "resulting_price_cents": priced(result),
        "margin_known": offer(F.when(no_price, F.lit(False)).otherwise(known)), "estimated_margin_cents": priced(margin),
    })


def newest(products: DataFrame, n: int = 20, seen: str = "last_seen_at") -> DataFrame:
    """The n products of each business seen last, those considered for offers."""
    order = Window.partitionBy("business_id").orderBy(F.desc(seen), "id")
    return products.withColumn("_n", F.row_number().over(order)).where(f"_n <= {n}").drop("_n")


def active_at(offers: DataFrame, now: Column) -> DataFrame:
    """Offers in force: active, started (or no start), not ended (or no end)."""
    return offers.where((F.col("status") == "ACTIVE") & (F.col("ends_at").isNull() | (F.col("ends_at") > now)) & (F.col("starts_at").isNull() | (F.col("starts_at") <= now)))


def first_offer(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Each product with its newest offer, if any (ties: least id)."""
    order = Window.partitionBy("product_id").orderBy(F.desc("created_at"), "id")
    top = offers.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return products.join(top.withColumnRenamed("id", "offer_id"), products["id"] == top["product_id"], "left")


def still_valid(proposals: DataFrame, products: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Proposals that may be approved: still proposed, and proposed anew at the same resulting price."""
    again = propose(products, rules).where("reason is null").select(F.col("id").alias("product_id"), F.col("resulting_price_cents").alias("again_cents"))
    joined = proposals.join(again, "product_id", "left")
    return joined.withColumn("approvable", F.coalesce((F.col("status") == "PROPOSED") & F.col("again_cents").eqNullSafe(F.col("resulting_price_cents")), F.lit(False))).drop("again_cents")
