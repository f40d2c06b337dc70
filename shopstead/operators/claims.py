"""Claim checks of ad copy against what a merchant's site states. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import format_cents
from ..functions.text import ascii_edges, holds_any

#: What counts as an amount, a discount, and a claim of each kind.
MONEY = r"[$£€¥]\s?\d(?:[\d.,]*\d)?"
PERCENT_OFF = r"(?i)(\d{1,3})\s*%\s*(?:off|discount)"
CLAIMS = {
    "unsubstantiated-superlative": r"(?i)\b(?:best|greatest|finest|#\s?1|number one|world'?s leading|unbeatable|guaranteed|perfect|miracle|revolutionary)\b",
    "unverifiable-statistic": r"(?i)\b\d[\d,.]*\s*(?:%|customers|reviews|sold|users|stars|out of \d)",
    "manufactured-urgency": r"(?i)\b(?:only\s+\d+\s+left|last chance|ends (?:today|tonight|soon)|hurry|while stocks last|limited time)\b",
    "regulated-promise": r"(?i)\b(?:cures?|heals?|treats?|clinically proven|doctor recommended|lose \d+|earn \$?\d+|risk[- ]free|money[- ]back)\b",
}
#: Lower-case strings of which every match holds one: texts without skip the pattern.
HINTS = {
    "unsubstantiated-superlative": ("best", "greatest", "finest", "#", "number one", "leading", "unbeatable", "guaranteed", "perfect", "miracle", "revolutionary"),
    "unverifiable-statistic": ("%", "customers", "reviews", "sold", "users", "stars", "out of "),
    "manufactured-urgency": ("left", "last", "ends ", "hurry", "limited time"),
    "regulated-promise": ("cure", "heal", "treat", "proven", "recommended", "lose ", "earn ", "risk", "money"),
}


def _violations(rule: str, excerpts: Column) -> Column:
    return F.transform(excerpts, lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("excerpt")))


def _whole(text: Column) -> Column:
    """A number rounded half up to units, as text."""
    return F.floor(text.try_cast("double") + 0.5).cast("long").cast("string")


def check(copy: DataFrame) -> DataFrame:
    """copy with `violations`, an array of (rule, excerpt), and `ok`.

    Needs headline, primary_text, description, cta; stated_price_cents array<long>, allowed_percents array<int>,
    verified_text, restrictions array<string>. A price passes if stated, also as a number or rounded to units; a phrase
    the site itself uses passes; restrictions always bite.
    """
    c = F.col
    text = F.concat_ws("\n", *[F.coalesce(c(x), F.lit("")) for x in ("headline", "primary_text", "description", "cta")])
    columns, every, low = copy.columns, c("_text"), c("_low")
    copy = copy.withColumn("_text", text).withColumn("_low", F.lower("_text"))  # columns, so that each is worked out once
    matches = lambda hints, pattern, group: F.when(holds_any(low, hints), F.regexp_extract_all(every, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
    prices = F.coalesce("stated_price_cents", F.array().cast("array<long>"))
    allowed = F.flatten(F.transform(prices, lambda p: F.array(format_cents(p), F.format_string("%.2f", p / 100), F.floor(p / 100 + 0.5).cast("long").cast("string"))))
    two = lambda n: F.format_string("%.2f", n.try_cast("double"))

    def unsupported(m):
        tight = F.regexp_replace(m, r"\s", "")
        number = F.regexp_replace(F.regexp_replace(tight, r"[^\d.,]", ""), ",", "")
        has = lambda x: F.coalesce(F.array_contains(allowed, x), F.lit(False))
        return ~(has(tight) | has(number) | has(two(number)) | has(_whole(number)))

    money_ = F.filter(matches(("$", "£", "€", "¥"), MONEY, 0), unsupported)
    percents = F.coalesce("allowed_percents", F.array().cast("array<int>"))
    number = lambda m: F.regexp_extract(m, r"^\d+", 0).cast("int")
    percent = F.filter(matches(("%",), PERCENT_OFF, 0), lambda m: ~F.array_contains(percents, number(m)))
    verified = F.lower(F.coalesce("verified_text", F.lit("")))
    rules = [_violations("unstated-price", money_), _violations("unsupported-discount", percent)]
    for rule, pattern in CLAIMS.items():
        rules.append(_violations(rule, F.filter(matches(HINTS[rule], ascii_edges(pattern), 0), lambda m: ~F.contains(verified, F.lower(m)))))
    banned = F.filter(F.coalesce("restrictions", F.array().cast("array<string>")), lambda r: (F.trim(r) != "") & F.contains(low, F.lower(F.trim(r))))
    rules.append(_violations("merchant-restriction", banned))
    checked = copy.withColumn("violations", F.concat(*rules))
    return checked.select(*columns, "violations", (F.size("violations") == 0).alias("ok"))


def labelled(checked: DataFrame, group: list[str], order: str) -> DataFrame:
    """Accepted variants of each group with n, their number in it, and label: A, B, C... in order, past Z what follows in
    UTF-16, which starts anew after 65,536; half a pair, which is no character, gives U+FFFD."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    unit = (F.col("n") + 64) % 65536
    whole = F.when(unit.between(0xD800, 0xDFFF), 0xFFFD).otherwise(unit)
    label = F.decode(F.unhex(F.lpad(F.hex(whole), 4, "0")), "UTF-16BE")
    return checked.where("ok").withColumn("n", n).withColumn("label", label)


def evidence(products: DataFrame, facts: DataFrame, offers: DataFrame, page_text: DataFrame) -> DataFrame:
    """Per product what copy may claim: prices stated, discounts offered or advertised, and the site's own words."""
    words = facts.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("facts"))
    offer = offers.select("product_id", F.when(F.col("type") == "PERCENT_OFF", F.col("value").cast("int")).alias("offer_percent"), F.lit(True).alias("has_active_offer"))
    joined = products.join(words, products["id"] == words["product_id"], "left").drop("product_id").join(offer, F.col("id") == offer["product_id"], "left").drop("product_id").join(page_text, "product_url", "left")
    prices = F.filter(F.array("price_cents", "compare_price_cents"), lambda x: x.isNotNull())
    text = F.concat_ws("\n", "name", F.coalesce("description", F.lit("")), F.array_join(F.transform(F.coalesce("facts", F.array().cast("array<struct<key:string,value:string>>")), lambda x: x["value"]), "\n"), F.coalesce("page_text", F.lit("")))
    percents = F.filter(F.array("offer_percent"), lambda x: x.isNotNull())
    if "stated_offers" in products.columns:  # any value a page states, amounts in cents included
        percents = F.concat(percents, F.transform(F.filter("stated_offers", lambda x: x["value"].isNotNull()), lambda x: x["value"].cast("int")))
    return joined.select("id", prices.alias("stated_price_cents"), percents.alias("allowed_percents"), text.alias("verified_text"), F.coalesce("has_active_offer", F.lit(False)).alias("has_active_offer"))
