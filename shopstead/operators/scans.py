"""What follows a scan: its phase, warnings, feed rows, what a new address discards, and what is known of a website."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PAGE_TYPES

#: Uncertainties in the order of their enum, statuses that mean a firewall refused us, rows of a class that a
#: scan tells the feed, rows that a knowledge bundle lists.
UNCERTAINTIES = ("LOW", "MEDIUM", "HIGH")
BLOCKED = (401, 403, 429)
TOLD, PAGES, PRODUCTS, FACTS, INFERENCES = 5, 200, 100, 100, 20


def phase(status: Column) -> Column:
    found = F.when(status == "QUEUED", "queued").when(status == "RUNNING", "crawling")
    return found.when(status.isin("FAILED", "CANCELLED"), "failed").otherwise("done")


def outcome(stop_reason: Column) -> Column:
    """Status of a finished scan, from why its crawl stopped."""
    return F.when(stop_reason == "completed", "COMPLETED").when(stop_reason == "cancelled", "CANCELLED").otherwise("PARTIAL")


def http_class(code: Column) -> Column:
    """What an owner is told about a status: refused by a firewall, not there, slowed down, broken, or anything else."""
    found = F.when(code.isin(401, 403), "refused").when(code == 404, "missing").when(code == 429, "slow-down")
    return found.when(code.isin(500, 502, 503, 504), "site-error").otherwise("other-error")


#: What an owner is told about a status and about a reason; {code} and {agent} stand for those.
STATUS_MESSAGES = {
    "refused": "The website refused us ({code}). This is almost always a firewall or bot protection in front of the site rather than a problem with the site itself — Cloudflare’s bot protection does it by default. Allow the visitor named “{agent}” in that service’s settings, then read the site again.",
    "missing": "That page was not found on the website (404). Check the address.",
    "slow-down": "The website asked us to slow down (429). We already wait between pages, so this usually means rate limiting in front of the site. Allowing “{agent}” there, or trying again later, should fix it.",
    "site-error": "The website itself returned an error ({code}). That is a problem at the site's end, not ours — try again once it is back.",
    "other-error": "The website answered with an error ({code}), so there was nothing to read.",
}
REASON_MESSAGES = {
    "unsafe-url": "That address is not one we can scan. It must be a public http:// or https:// website.",
    "robots-disallowed": "The website’s robots.txt asks crawlers not to read it, so we stopped.",
    "not-html": "That address is not a web page, so there was nothing to read.",
    "PROVIDER_TIMEOUT": "The website took too long to respond. It may be slow or temporarily down.",
}
NOTHING_READ, NOT_READ = "Nothing could be read from that address. Check that the website is online.", "The website could not be read."


def status_message(code: Column, agent: str) -> Column:
    """What an owner can do about an HTTP status (as text), with the visitor's name that they would have to allow."""
    kind = http_class(code.try_cast("int"))
    told = F.lit(None).cast("string")
    for name, message in STATUS_MESSAGES.items():
        told = F.when(kind == name, message.replace("{agent}", agent)).otherwise(told)
    return F.replace(told, F.lit("{code}"), code)


def unreachable(scans: DataFrame, warnings: DataFrame, agent: str) -> DataFrame:
    """scans (scan_id, root_url) with `message`: why nothing could be read, from the first of their warnings (scan_id, n, url,
    reason, detail) about the root address, else from their first that is not only about robots.txt."""
    about = (F.col("url") == F.col("root_url")) | (F.col("url") == F.concat("root_url", F.lit("/")))
    own = warnings.join(scans.select("scan_id", "root_url"), "scan_id").withColumn("about", about).where(F.col("about") | (F.col("reason") != "robots-not-plain-text"))
    first = own.groupBy("scan_id").agg(F.min_by(F.struct("reason", "detail"), F.struct((~F.col("about")).alias("other"), "n")).alias("w"))
    reason = F.col("w.reason")
    told = F.when(F.col("w").isNull(), NOTHING_READ)
    for name, message in REASON_MESSAGES.items():
        told = told.when(reason == name, message)
    told = told.when(reason.startswith("http-"), status_message(F.substring(reason, 6, 10), agent)).otherwise(F.coalesce("w.detail", F.lit(NOT_READ)))
    return scans.join(first, "scan_id", "left").withColumn("message", told).drop("w")


def first_blocked(warnings: DataFrame) -> DataFrame:
    """(scan_id, status): the first status of each scan's warnings (scan_id, n, reason) that means we were refused."""
    code = F.regexp_extract("reason", "^http-([0-9]+)$", 1).try_cast("int")
    return warnings.withColumn("code", code).where(F.col("code").isin(*BLOCKED)).groupBy("scan_id").agg(F.min_by("code", "n").alias("status"))


def feed_rows(scans: DataFrame, diff: DataFrame) -> DataFrame:
    """(website_id, kind, seq, message, needs_attention): what each scan (website_id, host, is_first, pages, products)
    tells the feed about diff (website_id, product_url, status, changed_fields, from_name, to_name, to_availability).

    A first scan tells what it read. A later one tells new products in one row, and of price changes, availability
    changes and removals the first TOLD each by product_url; of those availability changes only the ones that went out
    of stock. Where nothing changed, that.
    """
    c = F.col
    changed = c("status") == "changed"
    name = F.coalesce("to_name", "from_name")
    kinds = {
        "price": changed & F.array_contains("changed_fields", "price_cents"), "availability": changed & F.array_contains("changed_fields", "availability"),
        "removed": c("status") == "removed", "new": c("status") == "new",
    }
    classes = F.filter(F.array(*[F.when(test, F.lit(k)) for k, test in kinds.items()]), lambda x: x.isNotNull())
    later = scans.where("not is_first").select("website_id", "host", c("pages").alias("n_pages"))
    changes = diff.select("website_id", "product_url", name.alias("name"), "to_availability", F.explode(classes).alias("class")).join(later, "website_id")
    order = Window.partitionBy("website_id", "class").orderBy("product_url")
    some = changes.where("class != 'new'").withColumn("seq", F.row_number().over(order)).where(c("seq") <= TOLD)
    some = some.where("class != 'availability' or to_availability = 'OUT_OF_STOCK'")
    message = F.when(c("class") == "price", F.concat(F.lit("Price changed for "), c("name"), F.lit(". Advertising materials will be updated.")))
    message = message.when(c("class") == "availability", F.concat("name", F.lit(" is out of stock. It will not be advertised until it is back.")))
    message = message.otherwise(F.concat("name", F.lit(" is no longer on the website.")))
    each = some.select("website_id", F.when(c("class") == "price", "priceChanged").otherwise("productUnavailable").alias("kind"), "class", "seq", message.alias("message"), (c("class") != "price").alias("needs_attention"))
    counts = changes.groupBy("website_id").agg(F.count_if(c("class") == "new").alias("n_new"))
    sums = later.join(counts, "website_id", "left")
    plural = lambda n, one, many: F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))
    row = lambda kind, text, asks: [F.lit(kind).alias("kind"), F.lit(kind).alias("class"), F.lit(1).alias("seq"), text.alias("message"), asks.alias("needs_attention")]
    new = sums.where("n_new > 0").select("website_id", *row("productsFound", F.concat(plural(c("n_new"), "new product", "new products"), F.lit(" appeared on "), "host", F.lit(".")), F.lit(False)))
    still = sums.where("n_new is null").select("website_id", *row("websiteScanned", F.concat(F.lit("Checked "), "host", F.lit(". Nothing has changed.")), F.lit(False)))
    n = c("products")
    found = F.when(n == 0, "No products were found on it.").otherwise(F.concat(F.lit("Found "), plural(n, "product", "products"), F.lit(".")))
    read = F.concat(F.lit("Read "), plural(c("pages"), "page", "pages"), F.lit(" of "), "host", F.lit(". "), found)
    first = scans.where("is_first").select("website_id", *row("productsFound", read, n == 0))
    return each.unionByName(new).unionByName(still).unionByName(first)


def discarded(businesses: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """businesses (business_id) with the number of rows that each table (business_id) loses when the address changes: one
    pass over the union of all tables."""
    rows = None
    for name, table in tables.items():
        part = table.select("business_id", F.lit(name).alias("_of"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("business_id").agg(*[F.count_if(F.col("_of") == n).alias(n) for n in tables])
    return businesses.join(counts, "business_id", "left").fillna(0, list(tables))


def enum_rank(value: Column, names: tuple[str, ...]) -> Column:
    """Place of a value in its enum; unknown values come last."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in zip(names, range(len(names))) for x in pair])[value], F.lit(len(names)))


def _first(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= most)


def known_pages(pages: DataFrame, most: int = PAGES) -> DataFrame:
    """Pages of each website by page type, the newest first within one."""
    return _first(pages, "website_id", [enum_rank(F.col("page_type"), PAGE_TYPES), F.desc("fetched_at"), "id"], most)


def latest_website(websites: DataFrame) -> DataFrame:
    return _first(websites, "business_id", [F.desc("created_at"), "id"], 1).drop("n")


def fact_totals(business_facts: DataFrame, product_facts: DataFrame, products: DataFrame) -> DataFrame:
    """(business_id, facts): facts of each business and of its products; products count by semi-join, never twice."""
    of_products = product_facts.join(products.select(F.col("id").alias("product_id"), "business_id"), "product_id").select("business_id")
    return business_facts.select("business_id").unionByName(of_products).groupBy("business_id").agg(F.count("*").alias("facts"))


def facts_of_businesses(product_facts: DataFrame, products: DataFrame, businesses: DataFrame) -> DataFrame:
    """Product facts whose product belongs to one of the businesses: a filter along the relation."""
    own = products.join(businesses.select("business_id"), "business_id", "left_semi").select(F.col("id").alias("product_id"))
    return product_facts.join(own, "product_id", "left_semi")


def knowledge(websites: DataFrame, pages: DataFrame, products: DataFrame, facts: DataFrame, images: DataFrame, versions: DataFrame, totals: DataFrame) -> DataFrame:
    """One row a business: its latest website; the pages, products still sold (each with its first image and the number of its
    versions) and facts that a screen lists, as arrays in order and bounded; the number of pages by type, and of all facts.

    images (product_id, source_url, position) and versions (product_id) are met by the listed products only; totals are
    fact_totals(), since the list of facts stops at its limit.
    """
    c = F.col
    site = latest_website(websites).select("business_id", c("id").alias("website_id"))
    gather = lambda *cols: F.transform(F.array_sort(F.collect_list(F.struct("n", *cols))), lambda x: F.struct(*[x[k].alias(k) for k in cols]))
    own = pages.join(site, "website_id")
    types = own.groupBy("website_id", "page_type").agg(F.count("*").alias("k")).groupBy("website_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_type", "k")))).alias("page_types"))
    listed = known_pages(own).groupBy("website_id").agg(gather("url", "page_type").alias("pages"))
    sold = _first(products.where("removed_at is null").join(site, "business_id"), "website_id", [F.desc("last_seen_at"), "id"], PRODUCTS).select("website_id", "n", "name", c("id").alias("product_id"))
    main = images.groupBy("product_id").agg(F.min_by("source_url", F.struct("position", "source_url")).alias("image"))
    counts = versions.groupBy("product_id").agg(F.count("*").alias("n_versions"))
    seen = sold.join(main, "product_id", "left").join(counts, "product_id", "left").fillna(0, ["n_versions"])
    shown = seen.groupBy("website_id").agg(gather("name", "image", "n_versions").alias("products"))
    top = _first(facts, "business_id", [F.desc("confidence"), "key", "seq"], FACTS).groupBy("business_id").agg(gather("key", "value").alias("facts"))
    joined = site.join(listed, "website_id", "left").join(types, "website_id", "left").join(shown, "website_id", "left").join(top, "business_id", "left")
    return joined.join(totals.withColumnRenamed("facts", "n_facts"), "business_id", "left").fillna(0, ["n_facts"])


def current_analysis(profiles: DataFrame, inferences: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row a profile (business_id): its inferences, the surest first and the newest first within that, at most
    INFERENCES, and its latest decision of kind business.analyse."""
    order = [enum_rank(F.col("uncertainty"), UNCERTAINTIES), F.desc("created_at"), "id"]
    said = _first(inferences, "business_id", order, INFERENCES).groupBy("business_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "statement"))), lambda x: x["statement"]).alias("statements"))
    last = decisions.where("kind = 'business.analyse'").groupBy("business_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("decision_id"))
    return profiles.join(said, "business_id", "left").join(last, "business_id", "left")


def uncertainty(word: Column) -> Column:
    """An answer's word as the enum has it; whatever else was said counts as HIGH."""
    return F.when(word.isin("low", "medium", "high"), F.upper(word)).otherwise("HIGH")
