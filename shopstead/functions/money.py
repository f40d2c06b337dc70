"""Money as integer minor units: parsing, formatting, budgets, token prices. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols, longest first where one holds another, and currencies without minor units.
SYMBOLS = {"NZ$": "NZD", "CHF": "CHF", "R$": "BRL", "C$": "CAD", "A$": "AUD", "kr": "SEK", "zł": "PLN", "$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₹": "INR", "₽": "RUB", "₩": "KRW", "₪": "ILS", "₺": "TRY"}
ZERO_DECIMAL = ("JPY", "KRW", "VND", "CLP", "ISK", "XAF", "XOF")
#: No page states a price above this many minor units; days that a monthly budget must last.
MOST_CENTS, MONTH_DAYS = 1_000_000_000, 31


def let(value: Column, then) -> Column:
    """then(value), with value worked out once: a name for it inside one expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def detect_currency(raw: Column) -> Column:
    """The first stand-alone three-letter word of the text in upper case; without one (or with THE, AND, FOR), the
    longest symbol that occurs."""
    word = F.regexp_extract(F.upper(raw), r"\b([A-Z]{3})\b", 1)
    found = F.when((word != "") & ~word.isin("THE", "AND", "FOR"), word)
    for symbol, code in SYMBOLS.items():
        found = found.when(F.contains(raw, F.lit(symbol)), code)
    return found


def parse_price_number(raw: Column, currency: Column) -> Column:
    """Minor units of a written number, NULL where its separators leave doubt.

    The last separator is a decimal mark before one or two digits; three digits after it mean grouping, unless the
    other separator came earlier. Currencies without minor units take whole numbers only.
    """
    return let(F.regexp_replace(raw, r"[^0-9.,]", ""), lambda text: _parse_clean(text, currency))


def _parse_clean(text: Column, currency: Column) -> Column:
    tail = F.regexp_extract(text, r"[.,]([0-9]*)$", 1)
    split = text.rlike(r"[.,]")
    after = F.length(tail)
    mark = F.regexp_extract(text, r"([.,])[0-9]*$", 1)
    before = F.substring(text, F.lit(1), F.length(text) - after - 1)
    other = F.when(mark == ",", F.lit(".")).otherwise(F.lit(","))
    grouped = (after == 3) & (F.contains(before, mark) | ~F.contains(before, other))
    digits = lambda c: F.regexp_replace(c, "[.,]", "")
    whole = F.when(~split, text).when(grouped, digits(text)).when(after.isin(1, 2), digits(before))
    part = F.when(split & ~grouped & after.isin(1, 2), tail).otherwise(F.lit(""))
    # 12 digits are far beyond the limit below and still fit a long
    units = F.when(F.length(F.regexp_replace(whole, "^0+", "")) <= 12, F.when(whole == "", F.lit(0)).otherwise(whole.try_cast("long")))
    cents = units * 100 + F.rpad(part, 2, "0").try_cast("long")
    no_minor = F.coalesce(currency.isin(*ZERO_DECIMAL), F.lit(False))
    fits = F.when(cents <= MOST_CENTS, cents)
    return F.when(text.rlike("[0-9]"), F.when(no_minor, F.when(part == "", units)).otherwise(fits))


def parse_price(raw: Column, hint: Column) -> Column:
    """struct<cents, currency>, NULL where no amount can be told."""
    both = let(F.coalesce(detect_currency(raw), hint), lambda c: F.struct(F.when(F.trim(raw) != "", parse_price_number(raw, c)).alias("cents"), c.alias("currency")))
    return let(both, lambda p: F.when(p["cents"].isNotNull(), p))


def format_cents(cents: Column, symbol: str = "$") -> Column:
    """1050 -> $10.50, 100000 -> $1,000."""
    units = F.format_number((F.abs(cents) / 100).cast("decimal(20,2)"), 2)
    return F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), F.lit(symbol), F.regexp_replace(units, r"\.00$", ""))


def format_budget(cents: Column, period: Column) -> Column:
    return F.concat(format_cents(cents), F.lit("/"), F.when(period == "DAILY", "day").otherwise("month"))


def daily_budget(amount: Column, period: Column) -> Column:
    """Rounded down, so that the stated amount is never passed."""
    return F.when(period == "DAILY", amount).otherwise(F.floor(amount / MONTH_DAYS)).cast("long")


def monthly_budget(amount: Column, period: Column) -> Column:
    return F.when(period == "MONTHLY", amount).otherwise(amount * MONTH_DAYS).cast("long")


def resolve_budget(amount: Column, period: Column, platform_daily: int, platform_campaign: int, platform_approval: int) -> Column:
    """struct<daily, max_campaign, approval_threshold, error>: the limits that follow from one stated budget, or why not."""
    daily = daily_budget(amount, period)
    error = F.when(amount.isNull() | (amount <= 0), "invalid").when(daily < 1, "too-small").when(daily > platform_daily, "over-ceiling")
    ok = lambda c: F.when(error.isNull(), c)
    threshold = F.least(F.greatest(F.floor(daily / 2), F.lit(1)), F.lit(platform_approval)).cast("long")
    return F.struct(ok(daily).alias("daily"), ok(F.least(daily * MONTH_DAYS, F.lit(platform_campaign))).alias("max_campaign"), ok(threshold).alias("approval_threshold"), error.alias("error"))


def effective_daily_cap(amount: Column, period: Column, platform_daily: int) -> Column:
    return F.when(amount.isNull() | period.isNull(), F.lit(0)).otherwise(F.least(daily_budget(amount, period), F.lit(platform_daily)))


def parse_budget(text: Column) -> Column:
    """Typed budget -> minor units; commas group thousands only, anything ambiguous is NULL."""
    clean = F.regexp_replace(F.trim(text), r"[$\s]", "")
    ok = clean.rlike(r"^([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]{1,2})?$")
    return F.when(ok, F.round(F.regexp_replace(clean, ",", "").try_cast("decimal(18,2)") * 100).cast("long"))


#: Characters a token, tokens an image, price factors of cache reads and writes.
CHARS_PER_TOKEN, TOKENS_PER_IMAGE, CACHE_READ, CACHE_WRITE = 3.5, 1600, 0.1, 1.25


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN).cast("long")


def token_cost(in_rate: Column, out_rate: Column, tokens_in: Column, tokens_out: Column, cache_read=None, cache_write=None) -> Column:
    """Exact cents, from cents per million tokens."""
    none = F.lit(0)
    per_in, per_out = in_rate / 1_000_000, out_rate / 1_000_000
    return tokens_in * per_in + tokens_out * per_out + F.coalesce(cache_read or none, none) * per_in * CACHE_READ + F.coalesce(cache_write or none, none) * per_in * CACHE_WRITE


def whole_cents(cents: Column) -> Column:
    """Nearest cent, but never 0 for what cost something."""
    return F.when(cents <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(cents + 0.5))).cast("long")


def estimate_call(in_rate: Column, out_rate: Column, chars: Column, most_out: Column, images: Column) -> Column:
    """What a call costs at worst, rounded up."""
    cents = token_cost(in_rate, out_rate, token_estimate(chars) + F.coalesce(images, F.lit(0)) * TOKENS_PER_IMAGE, most_out)
    return F.greatest(F.lit(1), F.ceil(cents)).cast("long")
