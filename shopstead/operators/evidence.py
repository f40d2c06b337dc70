"""Evidence dossiers: rows turned into labelled text under character budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as words
from . import facts as fact_rules

#: Facts, products, pages, image lines and images of a product in a dossier; characters a page and in all; facts
#: that an analysis takes; page types whose words describe what is sold; what the list of pictures and the owner's words
#: are headed by.
FACTS, PRODUCTS, PAGES, IMAGES, PER_PRODUCT, PAGE_CHARS, ALL_CHARS, LEAST_FACTS = 120, 40, 8, 40, 6, 12_000, 30_000, 3
INFORMATIVE = ("HOME", "ABOUT", "PRODUCT", "COLLECTION", "FAQ", "OTHER")
PICTURES = """How the merchant describes the pictures on their own site.
These describe images, not guarantees — use them for what the thing looks
like and what it is called, not for claims about how it performs.

"""
NOTES = "The owner says, in their own words:\n"


def budgeted_pages(pages: DataFrame, owner: str, order: str, page_chars: int = PAGE_CHARS, all_chars: int = ALL_CHARS) -> DataFrame:
    """Pages (owner, order, page_type, title, url, text) cut to the budget: each may use what those before it left."""
    text = pages.withColumn("text", F.trim("text")).where("text != ''")
    # a page takes min(its length, page_chars, what is left), so what is left is all_chars less a capped running sum
    wants = F.least(F.length("text"), F.lit(page_chars))
    before = F.coalesce(F.sum(wants).over(Window.partitionBy(owner).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = text.withColumn("take", F.least(wants, F.lit(all_chars) - before)).where("take > 0")
    return kept.withColumn("slice", F.substring("text", F.lit(1), F.col("take").cast("int")))


def page_block(page_type: Column, title: Column, url: Column, text: Column) -> Column:
    return F.concat(F.lit("--- "), page_type, F.lit(" page: "), F.coalesce(title, url), F.lit("\n("), url, F.lit(")\n"), text)


def description(owner_says: Column, page_says: Column) -> Column:
    """struct<text, source>: the owner's words before the page's."""
    own, page = F.nullif(F.trim(owner_says), F.lit("")), F.nullif(F.trim(page_says), F.lit(""))
    return F.struct(F.coalesce(own, page).alias("text"), F.when(own.isNotNull(), "owner").when(page.isNotNull(), "page").alias("source"))


def facts_text(facts: DataFrame, owner: str, most: int = FACTS, least: int = LEAST_FACTS) -> DataFrame:
    """`key: value` lines of each owner's most confident facts, where there are enough to go by."""
    order = Window.partitionBy(owner).orderBy(F.desc("confidence"), "key", "value", "seq")
    top = facts.withColumn("n", F.row_number().over(order)).where(f"n <= {most}")
    lines = F.array_sort(F.collect_list(F.struct("n", F.concat("key", F.lit(": "), "value").alias("line"))))
    return top.groupBy(owner).agg(F.count("*").alias("n_facts"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("facts_text")).where(f"n_facts >= {least}")


def product_block(p: DataFrame) -> Column:
    """A product in lines: name, description and whose words it is, price, brand, category, reference, availability. A
    description and a price that are not known are said to be so; other lines that nothing is known for are left out.
    Columns that p lacks count as not known."""
    c = lambda name: F.col(name) if name in p.columns else F.lit(None).cast("string")
    says = description(c("owner_description"), c("description"))
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"{label}: "), value))
    told = F.when(says["source"] == "owner", F.concat(F.lit("Description (from the owner): "), says["text"]))
    told = told.when(says["source"] == "page", F.concat(F.lit("Description (from the product page): "), says["text"])).otherwise("Description: none given — do not invent one.")
    price = F.when(c("price_cents").isNull(), "Price: not stated").otherwise(F.rtrim(F.concat(F.lit("Price: "), F.format_string("%.2f", F.coalesce(c("price_cents").cast("long"), F.lit(0)) / 100), F.lit(" "), F.coalesce(c("currency"), F.lit("")))))
    return F.concat_ws("\n", line("Product", c("name")), told, price, line("Brand", c("brand")), line("Category", c("category")), line("Reference", c("sku")), line("Availability", c("availability")))


def _joined(n: str, column: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, column))), lambda x: x[column]), between)


def newest_pages(pages: DataFrame, owner: str, most: int = PAGES) -> DataFrame:
    """Each owner's newest pages of the informative types, numbered by `_n`."""
    order = Window.partitionBy(owner).orderBy(F.desc("fetched_at"), "id")
    return pages.where(F.col("page_type").isin(*INFORMATIVE)).withColumn("_n", F.row_number().over(order)).where(f"_n <= {most}")


def seen_products(products: DataFrame, owner: str, most: int = PRODUCTS) -> DataFrame:
    """Each owner's products that are not removed, those seen last first, numbered by `_n`."""
    order = Window.partitionBy(owner).orderBy(F.desc("last_seen_at"), "id")
    return products.where("removed_at is null").withColumn("_n", F.row_number().over(order)).where(f"_n <= {most}")


def image_text(products: DataFrame, images: DataFrame, pages: DataFrame, owner: str, most: int = IMAGES) -> DataFrame:
    """(owner, image_text): what pictures show, in the merchant's words. First the pictures of products, each with the
    product's name and declared shape, then those of pages (image_alts); each line once whatever its case.

    products and pages are numbered by `_n`, as seen_products() and newest_pages() give them.
    """
    gallery = images.withColumn("k", F.row_number().over(Window.partitionBy("product_id").orderBy("position", "source_url"))).where(f"k <= {PER_PRODUCT}")
    shown = products.select(owner, "_n", "name", F.col("id").alias("product_id")).join(gallery, "product_id")
    alt, shape = F.nullif(F.trim("alt_text"), F.lit("")), words.shape(F.col("width"), F.col("height"))
    line = F.when(alt.isNotNull() | shape.isNotNull(), F.concat_ws(" ", F.concat("name", F.lit(":")), alt, F.concat(F.lit("("), shape, F.lit(")"))))
    of_products = shown.select(owner, F.lit(0).alias("kind"), F.col("_n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), line.alias("line"))
    of_pages = pages.select(owner, F.lit(1).alias("kind"), F.col("_n").cast("long").alias("n"), F.posexplode("image_alts").alias("k", "line")).withColumn("k", F.col("k").cast("long"))
    both = of_products.unionByName(of_pages).where("line is not null").withColumn("place", F.struct("kind", "n", "k"))
    once = both.groupBy(owner, F.lower("line").alias("same")).agg(F.min(F.struct("place", "line")).alias("first"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy(owner).orderBy("first.place"))).where(f"n <= {most}").withColumn("line", F.concat(F.lit("- "), "first.line"))
    return first.groupBy(owner).agg(F.concat(F.lit(PICTURES), _joined("n", "line", "\n")).alias("image_text"))


def pages_text(pages: DataFrame, owner: str) -> DataFrame:
    """Pages numbered by `_n` (page_type, title, url, text) under the budget, as blocks in order."""
    blocks = budgeted_pages(pages, owner, "_n").withColumn("block", page_block(F.col("page_type"), F.col("title"), F.col("url"), F.col("slice")))
    return blocks.groupBy(owner).agg(F.count("*").alias("n_pages"), _joined("_n", "block", "\n\n").alias("pages_text"))


def dossier(businesses: DataFrame, facts: DataFrame, products: DataFrame, pages: DataFrame, images: DataFrame, owner: str = "business_id", product_id=None) -> DataFrame:
    """One row a business with what a writer is given of it: facts, products, pages and pictures as text, the owner's own
    words, and whether there are facts enough to analyse it.

    businesses (owner, description) and products (removed_at, last_seen_at, owner_description where there is one) are as
    stored; pages have fetched_at and image_alts, images their products' ids. With a product_id the products are that one
    and image_urls has its pictures worth looking at; without, it is empty.
    """
    if product_id is not None:
        products = products.where(F.col("id") == product_id)
    listed, newest = seen_products(products, owner, PRODUCTS if product_id is None else 1), newest_pages(pages, owner)
    blocks = listed.withColumn("block", product_block(listed)).groupBy(owner).agg(F.count("*").alias("n_products"), _joined("_n", "block", "\n\n").alias("products_text"))
    parts = [facts_text(facts, owner, least=0), blocks, pages_text(newest, owner), image_text(listed, images, newest, owner)]
    if product_id is not None:
        own = fact_rules.worth_showing(images.join(listed.select(owner, F.col("id").alias("product_id")), "product_id"))
        parts.append(own.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "source_url"))), lambda x: x["source_url"]).alias("image_urls")))
    notes = F.when(F.col("description") != "", F.concat(F.lit(NOTES), "description")).otherwise("")
    rows = businesses.select(owner, notes.alias("owner_notes_text"))
    for part in parts:
        rows = rows.join(part, owner, "left")
    texts = ["facts_text", "products_text", "pages_text", "image_text"]
    urls = F.coalesce("image_urls", F.array().cast("array<string>")) if product_id is not None else F.array().cast("array<string>")
    return rows.fillna("", texts).fillna(0, ["n_facts", "n_products", "n_pages"]).withColumns({"image_urls": urls, "enough": F.col("n_facts") >= LEAST_FACTS})
