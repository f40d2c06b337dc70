"""Products that a page repeats without declaring them: cards among sibling elements, found on the table of its nodes.

A subtree is the interval (node, last] of the numbers of its elements, so "the first price inside a card" is the next
price after the card's start, if it comes before its end: one window over a page answers it for all cards at once, in
time linear in the page, however deep elements nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text

#: An amount, what a card's price is not, labels that name nothing, words of buttons that sell, attributes
#: that identify an item, in order; cards and images of a page at most; levels up to which a cart counts.
PRICE = r"[$£€¥]\s?\d[\d.,]*|\d[\d.,]*\s?(?:USD|EUR|GBP|AUD|CAD)"
NOT_PRICE = r"(?i)ship|deliver|postage|tax|vat|was|rrp|instead|save|compare|from\b"
BADGE = r"(?i)^(?:most popular|best value|new|sale|sold out|free)\z"
ADD_TO_CART = r"(?i)add to (?:cart|bag|basket)\b"
ORDERS = r"(?i)\bbuy now\b|\bcheckout\b|\border now\b"
CHOOSES = r"(?i)\bbuy\b|\bchoose\b|\bselect\b|\border\b"
SKUS = ("data-sku", "data-add", "data-product-id", "data-variant-id")
MOST_CARDS, MOST_IMAGES, CART_LEVELS, MOST_PIXELS = 24, 6, 12, 20_000
PAGE, IMAGES = ["page_id", "url"], "array<struct<url:string,alt:string,width:int,height:int>>"


def purchase_intent(visible: Column) -> Column:
    """Whether a page sells anything: without a word of it, repeated prices are a table in an article."""
    return visible.rlike(text.ascii_edges(ADD_TO_CART)) | visible.rlike(text.ascii_edges(ORDERS))


def pixels(raw: Column) -> Column:
    """A declared side of an image, NULL where it is not a number of pixels from 1 to 20000."""
    n = F.regexp_extract(raw, r"^\s*\+?(\d+)", 1).try_cast("int")
    return F.when(n.between(1, MOST_PIXELS), n)


def plausible_name(own: Column) -> Column:
    """A name, not a sentence, a price or a label like "Most popular"."""
    wrong = own.rlike(PRICE) | own.rlike(text.ascii_edges(NOT_PRICE)) | own.rlike(BADGE) | own.rlike(r"[.!?]\s")
    return F.length(own).between(2, 80) & ~wrong & (F.size(F.split(own, r"\s+")) <= 8)


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _marks(nodes: DataFrame) -> DataFrame:
    """What each element is by itself: its shape among siblings, and whether it has a price, a name, an identifier, sells, or
    leads elsewhere."""
    css = F.trim(F.coalesce(_attr("class"), F.lit("")))
    first_word = F.regexp_extract(css, r"^\S+", 0)
    no_price = F.concat(F.coalesce(_attr("class"), F.lit("")), F.lit(" "), "own").rlike(text.ascii_edges(NOT_PRICE))
    amount = F.when(F.col("own").rlike(PRICE) & ~no_price, money.parse_price(F.col("own"), F.lit(None).cast("string")))
    sku = F.coalesce(*[F.when(F.trim(_attr(k)) != "", F.substring(F.trim(_attr(k)), 1, 100)) for k in SKUS])
    says = F.col("label").rlike(text.ascii_edges(ADD_TO_CART)) | F.col("label").rlike(text.ascii_edges(CHOOSES))
    href = F.trim(_attr("href"))
    tagged = lambda a, b: F.coalesce(F.coalesce(_attr(a), _attr(b)) != "", F.lit(False))
    alt = F.trim(F.regexp_replace(_attr("alt"), r"\s+", " "))
    image = F.struct(F.col("image").alias("url"), F.when(alt != "", F.substring(alt, 1, 300)).alias("alt"), pixels(_attr("width")).alias("width"), pixels(_attr("height")).alias("height"))
    return nodes.select(
        *PAGE, "node", "last", "parent", F.when(first_word != "", F.concat(F.lit("."), first_word)).otherwise(F.col("tag")).alias("shape"),
        F.coalesce(F.col("depth") - F.col("cart") < CART_LEVELS, F.lit(False)).alias("in_cart"), _attr("id").alias("id"), F.when(F.col("image").isNotNull(), image).alias("image"),
        amount.alias("amount"), F.when(plausible_name(F.col("own")), F.col("own")).alias("name"), sku.alias("sku"), tagged("data-sku", "data-add").alias("sells"),
        (F.col("control") & (F.coalesce(says, F.lit(False)) | tagged("data-add", "data-sku"))).alias("sold_by"), F.coalesce((F.col("tag") == "a") & (href != "") & ~href.startswith("#"), F.lit(False)).alias("leads"),
    )


def cards(nodes: DataFrame) -> DataFrame:
    """All elements, and of each whether it is a card (`good`): it names one thing with one price and sells it in place.

    `like` are the siblings of an element that have the same first word of their class, or the same tag where they have
    none: how many they are, the first of them, and how many are cards.
    """
    inside = Window.partitionBy(*PAGE).orderBy("node").rowsBetween(1, Window.unboundedFollowing)
    nth = lambda condition, *values: F.min(F.when(condition, F.struct("node", *values))).over(inside)
    marks = _marks(nodes).withColumns({
        "price": nth(F.col("amount.cents") > 0, "amount"), "named": nth(F.col("name").isNotNull(), "name"), "tagged": nth(F.col("sku").isNotNull(), "sku"),
        "sale": nth(F.col("sold_by")), "link": nth(F.col("leads")),
    })
    within = lambda c: F.coalesce(F.col(f"{c}.node") <= F.col("last"), F.lit(False))
    good = within("price") & within("named") & ~within("link") & (F.col("sells") | within("sale")) & (F.col("parent") >= 0)
    like = Window.partitionBy(*PAGE, "parent", "shape")
    rows = marks.select(
        *PAGE, "node", "last", "parent", "image", "in_cart", "shape", good.alias("good"), "id", F.col("named.name").alias("name"), F.col("price.amount.cents").alias("price_cents"),
        F.col("price.amount.currency").alias("currency"), F.coalesce("sku", F.when(within("tagged"), F.col("tagged.sku"))).alias("sku"),
    )
    counts = F.struct(F.count("*").over(like).alias("n"), F.min(F.struct("node", "in_cart")).over(like).alias("first"), F.count(F.when(F.col("good"), 1)).over(like).alias("cards"))
    return rows.withColumn("like", counts)


def products(nodes: DataFrame) -> DataFrame:
    """page_id, url, owner (0, 1, ...), name, price_cents, price_method, currency, sku, anchor and images of the cards of each
    page's largest group of siblings all of which, or all but one, are cards; of equal groups the first counts.

    Nothing inside a cart counts; of cards with one name the first stays; a page gives 24 at most. An image, with its
    alternative text and declared size, belongs to the last card that starts before it, if that ends after it: cards of
    one group do not overlap; a card has its first six. nodes are those of `extract.node_rows`, of pages with
    purchase_intent(). Every window is over one page, so all of it is one shuffle.
    """
    page, n = Window.partitionBy(*PAGE), F.col("like.cards")
    fits = F.col("good") & (n >= 2) & (n >= F.col("like.n") - 1) & ~F.col("like.first.in_cart")
    place = F.when(fits, F.struct(n.alias("n"), (-F.col("parent")).alias("p"), (-F.col("like.first.node")).alias("f")))
    best = cards(nodes).withColumn("place", place).withColumn("chosen", F.coalesce(F.col("place") == F.max("place").over(page), F.lit(False)))
    first = F.row_number().over(Window.partitionBy(*PAGE, "chosen", F.lower("name")).orderBy("node")) == 1
    once = best.withColumn("chosen", F.col("chosen") & first)
    owner = F.when(F.col("chosen"), F.count(F.when(F.col("chosen"), 1)).over(page.orderBy("node").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    before = F.max(F.when(F.col("owner") < MOST_CARDS, F.struct("node", "last", "owner"))).over(page.orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    rows = once.withColumn("owner", owner).withColumn("card", before)
    of_card = F.when(F.col("owner").isNotNull(), F.col("owner")).when(F.col("image").isNotNull() & (F.col("node") <= F.col("card.last")), F.col("card.owner"))
    kept = rows.withColumn("of", of_card).where((F.col("of") < MOST_CARDS))
    value = lambda c: F.max(F.when(F.col("owner").isNotNull(), c))
    anchor = F.coalesce("id", text.slug_id(F.coalesce("sku", "name")))
    shown = F.array_sort(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("node", "image"))))
    each_once = F.aggregate(shown, F.array().cast(IMAGES), lambda have, x: F.when((F.size(have) >= MOST_IMAGES) | F.exists(have, lambda h: h["url"] == x["image"]["url"]), have).otherwise(F.array_append(have, x["image"])))
    return kept.groupBy(*PAGE, F.col("of").cast("int").alias("owner")).agg(
        value(F.col("name")).alias("name"), value(F.col("price_cents")).alias("price_cents"), F.lit("HTML").alias("price_method"), value(F.col("currency")).alias("currency"),
        value(F.col("sku")).alias("sku"), value(anchor).alias("anchor"), each_once.alias("images"),
    )
