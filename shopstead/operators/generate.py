"""The deterministic writer: seeded choices, copy variants, strategies, simulated campaign figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_number(seed: Column) -> Column:
    """The first 32 bits of the seed's sha256, as a number."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long")


def pick(seed: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (seed_number(seed) % len(options) + 1).cast("int"))


def unit(seed: Column, label: str) -> Column:
    """A repeatable number in [0, 1)."""
    return seed_number(F.concat(seed, F.lit(f":{label}"))) / 4294967296.0


def short(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


#: Tones, angles and calls of the writer.
VOICES = ["Warm and direct", "Plain and practical", "Confident and calm"]
ANGLES, CTAS = ["PROBLEM_SOLUTION", "BENEFIT", "DEMONSTRATION"], ["Shop now", "Learn more", "See details"]


def analysis(businesses: DataFrame) -> DataFrame:
    return businesses.withColumns({"value_proposition": F.concat("name", F.lit(" sells products described on its own website.")), "brand_voice": pick(F.col("name"), VOICES)})


def strategies(products: DataFrame) -> DataFrame:
    """Three angles a product; only the first underscore of an angle becomes a slash."""
    rows = products.withColumn("angle", F.explode(F.array(*map(F.lit, ANGLES))))
    word = F.regexp_replace(F.lower("angle"), "^([^_]*)_", "$1/")
    return rows.withColumns({"hypothesis": F.concat(F.lit("A "), word, F.lit(" angle may suit "), "name", F.lit(".")), "hook": F.concat("name", F.lit(", shown plainly.")), "cta": pick(F.concat("name", "angle"), CTAS)})


def copy_variants(products: DataFrame) -> DataFrame:
    """Two variants a product (name, and detail: a sentence of the merchant's own, or NULL)."""
    name = short(F.col("name"), 48)
    detail = F.col("detail")
    one = F.struct(F.lit(1).alias("n"), short(F.when(detail.isNotNull(), F.concat("name", F.lit(". "), detail)).otherwise(F.concat("name", F.lit(". See the details and decide for yourself."))), 500).alias("primary_text"), name.alias("headline"), F.lit("Available now.").alias("description"), F.lit("Shop now").alias("cta"))
    two = F.struct(F.lit(2).alias("n"), short(F.when(detail.isNotNull(), F.concat(detail, F.lit(" Read more about "), "name", F.lit("."))).otherwise(F.concat(F.lit("Looking at "), "name", F.lit("? Here is what it is."))), 500).alias("primary_text"), short(F.concat(F.lit("About "), name), 60).alias("headline"), F.lit("Full details on the product page.").alias("description"), F.lit("Learn more").alias("cta"))
    return products.withColumn("_v", F.explode(F.array(one, two))).select(*products.columns, "_v.*")


def insights(campaigns: DataFrame) -> DataFrame:
    """Simulated results of (campaign_id, daily_budget_cents, days); spend never passes budget times days."""
    r = lambda c: F.floor(c + 0.5).cast("long")
    seed = F.col("campaign_id")
    spend = r(F.col("daily_budget_cents") * F.col("days") * (F.lit(0.75) + unit(seed, "utilisation") * 0.24))
    rows = campaigns.withColumns({"spend_cents": spend, "cpm_cents": F.lit(400) + r(unit(seed, "cpm") * 900)})
    rows = rows.withColumn("impressions", F.greatest(F.lit(1), r(F.col("spend_cents") / F.col("cpm_cents") * 1000)))
    rows = rows.withColumn("clicks", r(F.col("impressions") * (F.lit(0.008) + unit(seed, "ctr") * 0.022)))
    rows = rows.withColumn("purchases", r(F.col("clicks") * (F.lit(0.01) + unit(seed, "cvr") * 0.04)))
    return rows.withColumn("purchase_value_cents", F.col("purchases") * (F.lit(2000) + r(unit(seed, "aov") * 6000))).drop("cpm_cents")


#: Bounds of generated copy, in characters.
BOUNDS = {"primary_text": 500, "headline": 60, "description": 120, "cta": 40}


def copy_errors(copy: DataFrame) -> Column:
    """Names of the fields that are empty or too long."""
    bad = [F.when(F.coalesce(F.trim(F.col(f)) == "", F.lit(True)) | (F.length(f) > n), F.lit(f)) for f, n in BOUNDS.items()]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


#: Sizes of the drawn card.
_SVG = '<svg xmlns="http://www.w3.org/2000/svg" width="1080" height="1080"><rect width="100%" height="100%" fill="#{c}"/><text x="540" y="500" text-anchor="middle" font-size="64">{h}</text><text x="540" y="620" text-anchor="middle" font-size="40">{t}</text></svg>'


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def card_svg(headline: Column, text: Column) -> Column:
    """A plain card as SVG; its colour follows the headline."""
    svg = F.lit(_SVG)
    colour = F.substring(F.sha2(headline, 256), 1, 6)
    for mark, value in (("{c}", colour), ("{h}", escape_xml(headline)), ("{t}", escape_xml(text))):
        svg = F.replace(svg, F.lit(mark), value)
    return svg
