"""Facts with provenance: arbitration by confidence, upserts, counts, product images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confidence of each extraction method.
CONFIDENCE = {"MERCHANT_PROVIDED": 1.0, "JSON_LD": 0.95, "MICRODATA": 0.9, "OPENGRAPH": 0.8, "HTML": 0.7, "TEXT_PATTERN": 0.5}
MOST_CHARS, MOST_SOCIALS = 2000, 10


def confidence(method: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[method]


def arbitrate(candidates: DataFrame, keys: list[str], columns: list[str], seq: str = "seq") -> DataFrame:
    """For each key the columns of the most confident candidate; the first in sequence wins ties."""
    best = F.max_by(F.struct(*columns), F.struct("confidence", -F.col(seq)))
    return candidates.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def tidy(candidates: DataFrame) -> DataFrame:
    """Facts fit to store: trimmed, not empty, at most 2000 characters, with a source."""
    text = F.substring(F.trim("value"), 1, MOST_CHARS)
    return candidates.withColumn("value", text).where((F.col("value") != "") & F.col("source_url").isNotNull() & F.col("method").isNotNull())


def unpivot(rows: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """(ids, key, value): one candidate a field that is not NULL."""
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields]), lambda x: x["value"].isNotNull())
    return rows.select(*ids, F.explode(pairs).alias("_f")).select(*ids, "_f.*")


def latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts of owners after new ones came in by (owner, key, value): source, method and confidence are refreshed, the
    excerpt stays as it was first seen."""
    from .versions import upsert

    return upsert(old, new, ["owner_id", "key", "value"], keep_old=("source_excerpt",))


def socials(candidates: DataFrame, most: int = MOST_SOCIALS) -> DataFrame:
    """Distinct profiles of each owner in order of first sight."""
    first = candidates.groupBy("owner_id", "value").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("owner_id").orderBy("seq", "value")
    return first.withColumn("n", F.row_number().over(order)).where(f"n <= {most}")


def top_facts(facts: DataFrame, most: int) -> DataFrame:
    """The most confident facts of each owner, by key within equal confidence."""
    order = Window.partitionBy("owner_id").orderBy(F.desc("confidence"), "key", "value", "seq")
    return facts.withColumn("n", F.row_number().over(order)).where(f"n <= {most}")


def first_images(images: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("product_id").orderBy("position", "source_url")
    return images.withColumn("n", F.row_number().over(order)).where(f"n <= {most}")


def worth_showing(images: DataFrame, most: int = 3, small: int = 200) -> DataFrame:
    """The largest declared images of each product; those of unknown size come last, small ones not at all."""
    area = F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))
    short = F.least("width", "height")
    fit = images.where(F.col("source_url").rlike("^https?://") & (short.isNull() | (short >= small)))
    order = Window.partitionBy("product_id").orderBy(F.desc("area"), "position", "source_url")
    return fit.withColumn("area", area).withColumn("n", F.row_number().over(order)).where(f"n <= {most}")


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with the number of their children, 0 where there are none."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


#: Facts of a product that are its fields; key of the page address of each page type; confidences.
PRODUCT_FIELDS = ("name", "description", "sku", "brand", "category", "availability")
PAGE_KEYS = {"SHIPPING": "policy.shipping_url", "RETURNS": "policy.returns_url", "FAQ": "policy.faq_url", "CONTACT": "page.contact_url", "ABOUT": "page.about_url"}
OFFER, CALL, PAGE, SOCIAL = 0.6, 0.7, 0.75, 0.8


def product_facts(products: DataFrame) -> DataFrame:
    """(product_id, key, value, method, confidence) of products (id, fields, price_cents, currency, method, confidence,
    stated_offers array<struct<kind, source_text>>, calls array<string>): one row a field, offer and call to action."""
    c = F.col
    fact = lambda key, value, method, sure: F.struct(key.alias("key"), value.alias("value"), method.alias("method"), sure.cast("double").alias("confidence"))
    price = F.when(c("price_cents").isNotNull(), F.concat(F.format_string("%.2f", c("price_cents") / 100), F.lit(" "), c("currency")))
    fields = [fact(F.lit(f"product.{f}"), c(f).cast("string"), c("method"), c("confidence")) for f in PRODUCT_FIELDS]
    fields.append(fact(F.lit("product.price"), price, c("method"), c("confidence")))
    offers = F.transform(F.coalesce("stated_offers", F.array().cast("array<struct<kind:string,source_text:string>>")), lambda o: fact(F.concat(F.lit("offer."), o["kind"]), o["source_text"], F.lit("TEXT_PATTERN"), F.lit(OFFER)))
    calls = F.transform(F.coalesce("calls", F.array().cast("array<string>")), lambda x: fact(F.lit("cta"), x, F.lit("HTML"), F.lit(CALL)))
    every = F.filter(F.concat(F.array(*fields), offers, calls), lambda f: F.trim(f["value"]) != "")
    return products.select(c("id").alias("product_id"), F.explode(every).alias("f")).select("product_id", "f.*")


def business_facts(candidates: DataFrame, pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """(owner_id, key, value, source_url, method, confidence): for each key the most confident candidate of what pages
    say (owner_id, seq, key, value, source_url, method, confidence) and of where pages of a type are (owner_id, seq, url,
    page_type), and beside them an owner's social profiles (owner_id, seq, value, source_url)."""
    c = F.col
    names = F.create_map(*[F.lit(x) for kv in PAGE_KEYS.items() for x in kv])
    columns = ["value", "source_url", "method", "confidence"]
    places = pages.select("owner_id", "seq", names[c("page_type")].alias("key"), c("url").alias("value"), c("url").alias("source_url"), F.lit("HTML").alias("method"), F.lit(PAGE).alias("confidence")).where("key is not null")
    best = arbitrate(candidates.select("owner_id", "seq", "key", *columns).unionByName(places), ["owner_id", "key"], columns)
    seen = socials(profiles).join(profiles.groupBy("owner_id").agg(F.min("source_url").alias("source_url")), "owner_id")
    return best.unionByName(seen.select("owner_id", F.lit("social.profile").alias("key"), "value", "source_url", F.lit("HTML").alias("method"), F.lit(SOCIAL).alias("confidence")))


def positioned(products: DataFrame, most: int = 12) -> DataFrame:
    """(product_id, position, url, is_primary) of products (id, images array<string>): the first is the primary one."""
    rows = products.select(F.col("id").alias("product_id"), F.posexplode(F.slice("images", 1, most)).alias("position", "url"))
    return rows.withColumn("is_primary", F.col("position") == 0)


def ordered_union(rows: DataFrame, by: str, arrays: str) -> DataFrame:
    """(by, values): the distinct elements of all arrays of an owner's rows (seq, arrays), in order of first sight."""
    seen = rows.select(by, "seq", F.posexplode(arrays).alias("i", "value")).groupBy(by, "value").agg(F.min(F.struct("seq", "i")).alias("first"))
    return seen.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias("values"))


def known_sizes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Images (product_id, source_url, alt_text, position, width, height) after a scan: an unknown size never erases a
    known one; images that the scan did not see stay as they were."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in ("product_id", "source_url")], "full_outer")
    seen = F.col("n.product_id").isNotNull()
    either = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in ("product_id", "source_url", "width", "height")]
    return both.select(*either, *[F.when(seen, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in ("alt_text", "position")])
