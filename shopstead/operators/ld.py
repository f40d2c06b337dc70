"""JSON-LD of pages as variants in the JVM: blocks, records of a type wherever they nest, and their values as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import let

#: Blocks of a page, levels that are looked at below a block (0 is the block itself).
MOST_BLOCKS, MOST_DEPTH = 50, 6
#: Levels of arrays and records inside a value that text() looks through.
TEXT_LEVELS = 3
_SCRIPT = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?[^\"'>]*ld\+json[^>]*>(.*?)</script>"


def items(v: Column) -> Column:
    """The elements of a variant that is an array, else NULL."""
    return F.try_variant_get(v, "$", "array<variant>")


def fields(v: Column) -> Column:
    """The fields of a variant that is a record, as a map, else NULL."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, v) of pages (page_id, html): every JSON-LD script that parses, its @graph or array taken apart; the
    first MOST_BLOCKS of a page, numbered from 0. Scripts that do not parse are left out."""
    scripts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_SCRIPT), F.lit(1))).alias("script", "raw"))
    parsed = scripts.select("page_id", "script", F.try_parse_json("raw").alias("v")).where("v is not null")
    parts = F.coalesce(items(F.try_variant_get("v", "$['@graph']", "variant")), items(F.col("v")), F.array("v"))
    rows = parsed.select("page_id", "script", F.posexplode(parts).alias("i", "v"))
    order = Window.partitionBy("page_id").orderBy("script", "i")
    return rows.withColumn("block", F.row_number().over(order) - 1).where(F.col("block") < MOST_BLOCKS).select("page_id", "block", "v")


def records(found: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(page_id, block, path, v): the records of one of the types (lower case) in blocks, however deep they nest, down to
    MOST_DEPTH levels. path numbers the steps from the block; the fields of a record come in the order of their names.

    The nodes of each level are an array of a block's row, made from the level above, so all levels are one pass over the
    blocks, and nothing is shuffled.
    """
    node = "array<struct<path:array<int>,v:variant>>"

    def inner(x):
        below = F.coalesce(F.map_values(fields(x["v"])), items(x["v"]), F.array().cast("array<variant>"))
        return F.transform(below, lambda y, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), y.alias("v")))

    def typed(x):
        kinds = let(F.try_variant_get(x["v"], "$['@type']", "variant"), lambda k: F.coalesce(items(k), F.array(k)))
        return F.exists(kinds, lambda t: F.coalesce(F.lower(F.try_variant_get(t, "$", "string")).isin(*types), F.lit(False)))

    rows = found.withColumn("level0", F.array(F.struct(F.array().cast("array<int>").alias("path"), "v")).cast(node))
    for depth in range(MOST_DEPTH):
        below = F.flatten(F.transform(f"level{depth}", inner))
        rows = rows.withColumn(f"level{depth + 1}", F.filter(below, lambda x: x["v"].isNotNull() & ~F.is_variant_null(x["v"])))
    every = F.concat(*[F.filter(f"level{d}", typed) for d in range(MOST_DEPTH + 1)])
    return rows.select("page_id", "block", F.explode(every).alias("r")).select("page_id", "block", "r.path", "r.v")


def text(v: Column) -> Column:
    """text_of() down to TEXT_LEVELS."""
    return text_of(v, TEXT_LEVELS)


def text_of(v: Column, levels: int) -> Column:
    """A variant as text: a string that is not blank, trimmed; a number; the first text of an array; a record's @value, name or
    url. Truth values have none."""

    def of(x):
        plain = let(F.trim(F.try_variant_get(x, "$", "string")), lambda t: F.when(t != "", t))
        scalar = F.when(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|BOOLEAN)"), plain)
        if not levels:
            return scalar
        first = F.get(F.filter(F.transform(items(x), lambda y: text_of(y, levels - 1)), lambda y: y.isNotNull()), F.lit(0))
        return F.coalesce(scalar, first, text_of(either(fields(x), "@value", "name", "url"), levels - 1))

    return let(v, of)


def either(record: Column, *names: str) -> Column:
    """The first of the named fields that a record has and that is not null."""
    return let(record, lambda r: F.coalesce(*[let(r[n], lambda x: F.when(~F.is_variant_null(x), x)) for n in names]))


def products(pages: DataFrame) -> DataFrame:
    """Products that pages declare in JSON-LD: page_id, block, path, name, description, sku, brand, category, price,
    currency and availability (of the first offer), as stated. No Python takes part."""
    rows = records(blocks(pages), ("product", "productgroup")).withColumn("m", fields(F.col("v")))
    offers = either(F.col("m"), "offers")
    rows = rows.withColumn("offer", F.try_element_at(F.filter(F.transform(F.coalesce(items(offers), F.array(offers)), fields), lambda x: x.isNotNull()), F.lit(1)))
    m, o = F.col("m"), F.col("offer")
    stated = {
        "name": m["name"], "description": m["description"], "sku": either(m, "sku", "mpn", "productID", "gtin13"), "brand": m["brand"], "category": m["category"],
        "price": either(o, "price", "lowPrice"), "currency": o["priceCurrency"], "availability": o["availability"],
    }
    rows = rows.withColumn("said", F.transform(F.array(*stated.values()), text))  # one expression for all fields
    return rows.select("page_id", "block", "path", *[F.get("said", F.lit(i)).alias(name) for i, name in enumerate(stated)])
