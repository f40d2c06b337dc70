"""Products of websites kept from scan to scan: removed, seen again, versioned. A scan rewrites the partitions it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import DIFFED, KEY, first_seen, hashed

FIELDS = ["name", "description", "price_cents", "compare_price_cents", "currency", "availability", "sku"]
STATE = ["content_hash", "first_seen_at", "last_seen_at", "removed_at", "last_version"]
#: Rows of a store: the catalogue's fields, and what is known of a product over time.
PRODUCTS = "website_id long, product_url string, name string, description string, price_cents long, compare_price_cents long, currency string, availability string, sku string, content_hash string, first_seen_at long, last_seen_at long, removed_at long, last_version long"


def persisted(old: DataFrame, scan: DataFrame, scans: DataFrame) -> DataFrame:
    """old (PRODUCTS) after a scan (KEY, FIELDS and seq), with status, changed_fields and from_price_cents of each row.

    scans has (website_id, completed, at) of the websites scanned; other rows of old pass through, their status NULL. Of
    rows of one product_url the first in sequence counts. A product that is not known, or was removed, is new; it is
    changed where the hash of its fields differs, and removed where a completed scan does not have it. Seen again, it
    is no longer removed, but keeps its number of versions: only changes of a known product make another.
    """
    new = hashed(first_seen(scan.join(scans.select("website_id"), "website_id", "left_semi"), KEY, ["seq"])).select(*KEY, *FIELDS, "content_hash")
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.website_id") == F.col("n.website_id")) & (F.col("o.product_url") == F.col("n.product_url")), "full_outer")
    seen, known = F.col("n.product_url").isNotNull(), F.col("o.product_url").isNotNull() & F.col("o.removed_at").isNull()
    rows = both.select(
        *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in KEY], *[F.when(seen, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in [*FIELDS, "content_hash"]],
        *[F.col(f"o.{f}").alias(f) for f in STATE if f != "content_hash"], seen.alias("seen"), known.alias("known"), (F.col("o.content_hash") != F.col("n.content_hash")).alias("differs"),
        F.filter(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in DIFFED]), lambda x: x.isNotNull()).alias("fields"), F.col("o.price_cents").alias("from_price_cents"),
    )
    rows = rows.join(scans.select("website_id", "completed", "at"), "website_id", "left")
    status = F.when(F.col("at").isNull(), None).when(F.col("seen") & ~F.col("known"), "new").when(F.col("seen") & F.col("differs"), "changed").when(F.col("seen"), "same")
    status = status.when(F.col("known") & F.col("completed"), "removed")
    rows = rows.withColumn("status", status)
    here = F.col("seen") & F.col("at").isNotNull()
    changed = F.col("status") == "changed"
    return rows.select(
        *KEY, *FIELDS, "content_hash", F.coalesce("first_seen_at", "at").alias("first_seen_at"), F.when(here, F.col("at")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(F.col("status") == "removed", F.col("at")).when(~here, F.col("removed_at")).alias("removed_at"), (F.coalesce("last_version", F.lit(1)) + F.when(F.coalesce(changed, F.lit(False)), 1).otherwise(0)).cast("long").alias("last_version"),
        "status", F.when(changed, F.col("fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"), "from_price_cents", F.col("last_version").isNull().alias("first"),
    )


class ProductStore:
    """Product tables under one path: `products` in parts by website, `versions` and `changes` by scan.

    A scan reads and rewrites the parts that its websites fall into and no other; parts are swapped by dynamic partition
    overwrite once all of them are written. The outcome of a scan is first written to `changes`: a run that breaks off
    afterwards is taken up from there, so persisting a scan again changes nothing. One writer a store is assumed.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _exists(self, place: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def products(self) -> DataFrame:
        return self._read("products", f"{PRODUCTS}, part int")

    def versions(self) -> DataFrame:
        return self._read("versions", f"{PRODUCTS}, status string, changed_fields array<string>, from_price_cents long, scan_id string")

    def _read(self, name: str, schema: str) -> DataFrame:
        place = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(place) if self._exists(place) else self.spark.createDataFrame([], schema)

    def _part(self):
        return F.pmod(F.xxhash64("website_id"), F.lit(self.parts)).cast("int")

    def persist(self, scan: DataFrame, scans: DataFrame, scan_id: str) -> DataFrame:
        """Takes a scan in (see persisted) and gives its rows with their status."""
        staged = f"{self.path}/changes/scan_id={scan_id}"
        if not self._exists(f"{staged}/_SUCCESS"):
            touched = scans.select(self._part().alias("part")).distinct()  # `parts` numbers at most
            old = self.products().join(F.broadcast(touched), "part", "left_semi").drop("part")
            persisted(old, scan, scans).write.mode("overwrite").parquet(staged)
        after = self.spark.read.parquet(staged)
        swap = lambda df, name, by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")
        made = after.where("status = 'changed' or status = 'new' and first").drop("first").withColumn("scan_id", F.lit(scan_id))
        swap(made, "versions", "scan_id")
        swap(after.drop("status", "changed_fields", "from_price_cents", "first").withColumn("part", self._part()).repartition("part"), "products", "part")
        return after.where("status is not null").drop("first")
