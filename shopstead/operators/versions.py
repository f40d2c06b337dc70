"""Snapshots compared and versioned: keys, content hashes, full outer diff, change summary, upserts as pure functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash

KEY = ["website_id", "product_url"]
#: Fields that make a new version; the hash has the currency as well, which the list of changed fields leaves out.
DIFFED = ["name", "description", "price_cents", "compare_price_cents", "availability", "sku"]


def product_key(final_url: Column, anchor: Column) -> Column:
    return F.when(anchor.isNotNull(), F.concat(final_url, F.lit("#"), anchor)).otherwise(final_url)


def hashed(snapshot: DataFrame) -> DataFrame:
    c = F.col
    return snapshot.withColumn("content_hash", content_hash(c("name"), c("description"), c("price_cents"), c("compare_price_cents"), c("currency"), c("availability"), c("sku")))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def compare(before: DataFrame, after: DataFrame, completed: Column | bool = True) -> DataFrame:
    """One row a product of either snapshot: status new, removed, changed or same, and the fields that changed.

    One full outer join on (website_id, product_url). Products missing from the new snapshot count as removed only when
    the crawl completed, else as same.
    """
    old, new = hashed(before).alias("o"), hashed(after).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY]
    both = old.join(new, on[0] & on[1], "full_outer")
    is_new, gone = F.col("o.product_url").isNull(), F.col("n.product_url").isNull()
    done = F.lit(completed) if isinstance(completed, bool) else completed
    changed = F.col("o.content_hash") != F.col("n.content_hash")
    status = F.when(is_new, "new").when(gone & done, "removed").when(gone, "same").when(changed, "changed").otherwise("same")
    fields = F.filter(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in DIFFED]), lambda x: x.isNotNull())
    pairs = [x for f in ("name", "price_cents", "availability") for x in (F.col(f"o.{f}").alias(f"from_{f}"), F.col(f"n.{f}").alias(f"to_{f}"))]
    keys = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in KEY]
    return both.select(*keys, status.alias("status"), F.when(status == "changed", fields).otherwise(F.array().cast("array<string>")).alias("changed_fields"), *pairs)


def change_summary(diff: DataFrame) -> DataFrame:
    """Per website: products new and removed, price and availability changes."""
    c = F.col
    return diff.groupBy("website_id").agg(
        F.count_if(c("status") == "new").alias("new_products"), F.count_if(c("status") == "removed").alias("removed_products"),
        F.count_if((c("status") == "changed") & F.array_contains("changed_fields", "price_cents")).alias("price_changes"),
        F.count_if((c("status") == "changed") & F.array_contains("changed_fields", "availability")).alias("availability_changes"),
    )


def numbered(history: DataFrame, at: str = "scan_no") -> DataFrame:
    """Versions from 1 for each product: a scan starts one when its hash differs from the scan before."""
    w = Window.partitionBy(*KEY).orderBy(at)
    rows = hashed(history).withColumn("_before", F.lag("content_hash").over(w))
    rows = rows.withColumn("_new", F.col("_before").isNull() | (F.col("_before") != F.col("content_hash")))
    rows = rows.withColumn("version_number", F.sum(F.col("_new").cast("long")).over(w)).withColumn("from_price_cents", F.lag("price_cents").over(w))
    return rows.where("_new").drop("_before", "_new")


def seen_span(history: DataFrame, at: str = "scan_no") -> DataFrame:
    return history.groupBy(*KEY).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_known: tuple[str, ...] = (), keep_old: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows put in: new values win, columns in keep_known only where not NULL, columns in keep_old never."""
    o, n = old.alias("o"), new.alias("n")
    cond = None
    for k in keys:
        c = F.col(f"o.{k}") == F.col(f"n.{k}")
        cond = c if cond is None else cond & c
    hit = F.col(f"n.{keys[0]}").isNotNull()

    def pick(c):
        if c in keys or c in keep_known:
            return F.coalesce(f"n.{c}", f"o.{c}")
        both = F.col(f"o.{keys[0]}").isNotNull() & hit
        return F.when(both, F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")) if c in keep_old else F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return o.join(n, cond, "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def replace_drafts(old: DataFrame, new: DataFrame, owner: str, drafts: tuple[str, ...]) -> DataFrame:
    """Rows in a draft status of owners that have new rows give way to those; others stay."""
    owners = new.select(owner).distinct()
    kept = old.where(~F.col("status").isin(*drafts)).unionByName(old.where(F.col("status").isin(*drafts)).join(owners, owner, "left_anti"))
    return kept.unionByName(new)


def discard(tables: dict[str, DataFrame], gone: DataFrame, key: str = "website_id") -> dict[str, DataFrame]:
    """Every table without the rows of discarded keys."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def diff_fields(previous: str, following: str, allowed: list[str]) -> Column:
    """Of two struct columns, the allowed fields that differ, as array<struct<field, before, after>>."""
    one = lambda f: F.when(~F.col(f"{previous}.{f}").eqNullSafe(F.col(f"{following}.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"{previous}.{f}").cast("string").alias("before"), F.col(f"{following}.{f}").cast("string").alias("after")))
    return F.filter(F.array(*map(one, allowed)), lambda x: x.isNotNull())
