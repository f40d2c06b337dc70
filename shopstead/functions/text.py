"""Text rules: sanitising, slugs, page types, offers stated on a page, injection signals. Column expressions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import let, parse_price


#: A word boundary by ASCII letters, digits and underscore, whatever the engine's own \\b takes for letters.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_edges(pattern: str) -> str:
    """pattern with ASCII word boundaries; where a word must follow, a look behind is enough, and much cheaper."""
    out, rest = "", pattern
    while r"\b" in rest:
        head, rest = rest.split(r"\b", 1)
        out += head + (r"(?<!\w)" if _starts_word(rest) else _EDGE)
    return out + rest


def _starts_word(pattern: str) -> bool:
    """Whether all that a pattern matches starts with an ASCII letter or digit."""
    if not pattern.startswith("(?:"):
        return pattern[:2] == r"\d" or pattern[:1].isascii() and pattern[:1].isalnum()
    depth, heads, at = 0, [3], 0
    for at, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if depth == 0:
            break
        if depth == 1 and c == "|":
            heads.append(at + 1)
    return pattern[at + 1 : at + 2] not in ("?", "*") and all(_starts_word(pattern[h:]) for h in heads)


def sanitise(text: Column) -> Column:
    """Control characters to spaces, zero-width and bidirectional marks out, blanks and empty lines squeezed."""
    text = F.regexp_replace(text, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f]", " ")
    text = F.regexp_replace(text, "[​-‏﻿‪-‮⁦-⁩]", "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def truncate(text: Column, most: int, mark: str = "\n[content truncated]") -> Column:
    """Cut at `most` characters, at a space if one lies in the last fifth, with a mark."""
    cut = F.substring(text, 1, most)
    space = F.lit(most) - F.locate(" ", F.reverse(cut))
    body = F.when((F.locate(" ", cut) > 0) & (space > most * 0.8), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(body, F.lit(mark)))


def slug_id(text: Column) -> Column:
    """Lower case, runs of other characters to '-', 60 characters at most, 'item' for nothing."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.substring(dashed, 1, 60), "-+$", "")
    return F.when(short == "", F.lit("item")).otherwise(short)


#: Page types by path, first match wins; then by words in the heading.
PATH_TYPES = [
    ("PRODUCT", r"(?i)/(?:products?|item|p)/[^/]+"), ("COLLECTION", r"(?i)/(?:collections?|categor(?:y|ies)|shop|store|catalog(?:ue)?)(?:/|$)"),
    ("ABOUT", r"(?i)/(?:about|our-story|who-we-are|team)"), ("FAQ", r"(?i)/(?:faqs?|help|support|questions)"), ("SHIPPING", r"(?i)/(?:shipping|delivery|postage)"),
    ("RETURNS", r"(?i)/(?:returns?|refunds?|exchanges?)"), ("CONTACT", r"(?i)/(?:contact|get-in-touch|reach-us)"),
    ("POLICY", r"(?i)/(?:policies|policy|privacy|terms|legal|cookies?)"), ("BLOG", r"(?i)/(?:blogs?|news|articles?|posts?|journal)(?:/|$)"),
]
HEADING_TYPES = [("FAQ", "frequently asked|faq"), ("SHIPPING", "shipping|delivery"), ("RETURNS", "returns?|refunds?"), ("CONTACT", "contact"), ("ABOUT", "about us|our story")]
#: Declared order of page types, which sorts use.
PAGE_TYPES = ("HOME", "PRODUCT", "COLLECTION", "ABOUT", "FAQ", "SHIPPING", "RETURNS", "CONTACT", "POLICY", "BLOG", "OTHER")


def page_type(path: Column, title: Column, text: Column, declared_product: Column, priced_product: Column) -> Column:
    found = F.when(declared_product | priced_product, "PRODUCT")
    for name, pattern in PATH_TYPES:
        found = found.when(path.rlike(pattern), name)
    found = found.when(F.coalesce(path, F.lit("/")).isin("/", ""), "HOME")
    heading = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 400)))
    for name, pattern in HEADING_TYPES:
        found = found.when(heading.rlike(pattern), name)
    return found.otherwise("OTHER")


def ordinal(value: Column, order: tuple[str, ...]) -> Column:
    """Position in a declared order, which is how enumerations sort."""
    return F.array_position(F.array(*map(F.lit, order)), value)


def listing(text: Column) -> Column:
    """Whether a page lists several items: more than three distinct prices, or more than two cart phrases."""
    prices = F.regexp_extract_all(text, F.lit(r"(?:[$£€¥]\s?\d[\d.,]*|\d[\d.,]*\s?(?:USD|EUR|GBP|AUD|CAD))"), F.lit(0))
    distinct = F.array_distinct(F.transform(prices, lambda p: F.regexp_replace(p, r"\s+", "")))
    return (F.size(distinct) > 3) | (F.regexp_count(text, F.lit(ascii_edges(r"(?i)add to (?:cart|bag|basket)\b"))) > 2)


def availability(raw: Column) -> Column:
    """In stock is looked for first, so 'unavailable' counts as available, as the catalogue's contract has it."""
    low = F.lower(raw)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words])
    return F.when(has("instock", "in stock", "available"), "IN_STOCK").when(has("outofstock", "out of stock", "sold out"), "OUT_OF_STOCK").when(has("preorder", "pre-order", "backorder"), "PREORDER")


#: Patterns of offers that a page states, in order.
OFFER_PATTERNS = [
    ("percent-off", r"(?i)(\d{1,2})\s*%\s*(?:off|discount|reduction)", "percent"), ("percent-off", r"(?i)(?:save|get)\s*(\d{1,2})\s*%", "percent"),
    ("amount-off", r"(?i)save\s*([$£€]\s?\d[\d.,]*)", "amount"), ("bxgy", r"(?i)buy\s*(?:one|two|\d)\s*,?\s*get\s*(?:one|two|\d)\s*(?:free|half)", None),
    ("bxgy", r"(?i)\b(?:bogo|2\s*for\s*1|3\s*for\s*2)\b", None), ("free-shipping", r"(?i)free\s*(?:standard\s*)?(?:shipping|delivery|postage)", None),
]


#: Lower-case strings of which a match of the pattern at that place holds one: texts without skip the pattern.
OFFER_HINTS = (("%",), ("%",), ("save",), ("buy",), ("bogo", "for"), ("free",))


def holds_any(lowered: Column, hints: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(lowered, F.lit(h)) for h in hints])


def stated_offers(text: Column) -> Column:
    """array<struct<kind, value, source_text>>: the first match of each pattern, each (kind, value) once."""
    return let(F.struct(text.alias("text"), F.lower(text).alias("lowered")), lambda t: let(_offers(t["text"], t["lowered"]), _each_once))


def _each_once(every: Column) -> Column:
    return F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: (y["kind"] == x["kind"]) & y["value"].eqNullSafe(x["value"])))


def _offers(text: Column, lowered: Column) -> Column:
    found = []
    for (kind, pattern, what), hints in zip(OFFER_PATTERNS, OFFER_HINTS):
        pattern = ascii_edges(pattern)
        whole = F.when(holds_any(lowered, hints), F.regexp_extract(text, pattern, 0)).otherwise("")
        value = F.lit(None).cast("long")
        ok = whole != ""
        if what == "percent":
            value = F.regexp_extract(text, pattern, 1).try_cast("long")
            ok = ok & value.between(1, 95)
        if what == "amount":
            value = parse_price(F.regexp_extract(text, pattern, 1), F.lit(None).cast("string"))["cents"]
            ok = ok & value.isNotNull()
        found.append(F.when(ok, F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.substring(F.trim(whole), 1, 120).alias("source_text"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


#: Wording that looks like an instruction to a model. A signal, never a filter.
INJECTION = {
    "ignore-instructions": r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    "disregard-instructions": r"(?i)disregard\s+(?:all\s+)?(?:previous|prior|the\s+above)",
    "system-prompt": r"(?i)system\s+prompt|<\|?im_start\|?>|\[\[system\]\]",
    "role-switch": r"(?i)you\s+are\s+now\s+(?:a|an|the)\b|act\s+as\s+(?:if|a|an)\b",
    "reveal-secrets": r"(?i)\b(?:reveal|print|output|show)\b.{0,30}\b(?:api\s*key|secret|token|password|credentials?)\b",
    "assistant-turn": r"(?im)^\s*(?:assistant|ai)\s*:",
    "tool-invocation": r"(?i)</?(?:function_calls|invoke|tool_use)\b",
}


def injection_signals(text: Column) -> Column:
    """Names of the patterns that the first 50 000 characters match."""
    sample = F.substring(text, 1, 50_000)
    return F.filter(F.array(*[F.when(sample.rlike(ascii_edges(p)), F.lit(n)) for n, p in INJECTION.items()]), lambda x: x.isNotNull())


#: Labels that count as calls to action.
CALLS = [r"\badd to (?:cart|bag|basket)\b", r"\bbuy (?:now|it now)\b", r"\bshop now\b", r"\border now\b", r"\bpre-?order\b", r"\bsubscribe\b", r"\bbook (?:now|a call)\b", r"\bget (?:started|a quote|yours)\b", r"\blearn more\b", r"\bsign up\b", r"\bcontact us\b"]


def calls_to_action(labels: Column) -> Column:
    """Distinct labels of up to 40 characters that call to action, the first 12."""
    tidy = F.transform(labels, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(tidy, lambda x: (x != "") & (F.length(x) <= 40) & x.rlike(ascii_edges("(?i)" + "|".join(CALLS))))), 1, 12)


def first_sentence(text: Column, most: int = 180) -> Column:
    """The first sentence, cut at `most` characters, always with closing punctuation; NULL under 12 characters."""
    body = F.trim(text)
    sentence = F.trim(F.regexp_extract(body, r"(?s)^(.*?[.!?])(?=\s|$)", 1))
    sentence = F.when(sentence == "", body).otherwise(sentence)
    cut = F.when(F.length(sentence) > most, F.concat(F.rtrim(F.substring(sentence, 1, most - 1)), F.lit("…"))).otherwise(sentence)
    return F.when(F.length(body) >= 12, F.when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit("."))))


def shape(width: Column, height: Column) -> Column:
    """Declared image size in words, NULL where a side is not declared."""
    ratio, short = width / height, F.least(width, height)
    form = F.when(ratio > 1.15, "landscape").when(ratio < 0.87, "portrait").otherwise("square")
    note = F.when(short >= 1080, "").when(short >= 500, ", small for an ad").otherwise(", far too small for an ad")
    return F.when(width.isNotNull() & height.isNotNull(), F.concat(width.cast("string"), F.lit("×"), height.cast("string"), F.lit(", "), form, note))


def content_hash(*parts: Column) -> Column:
    """sha256 over the parts joined by U+0000; NULL counts as empty."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def wrapped(text: Column, most_chars: int, most_lines: int) -> Column:
    """array<string>: the words of a text in lines of up to most_chars (a longer word has a line of its own), at most
    most_lines of them; where words are left over, the last line is cut and ends in an ellipsis."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))

    def add(have, word):
        longer = F.when(have["now"] == "", word).otherwise(F.concat(have["now"], F.lit(" "), word))
        full = F.when(have["now"] == "", have["lines"]).otherwise(F.array_append(have["lines"], have["now"]))
        fits = F.struct(have["lines"].alias("lines"), longer.alias("now"))
        breaks = F.struct(full.alias("lines"), word.alias("now"))
        return F.when(F.size(have["lines"]) >= most_lines, have).when(F.length(longer) <= most_chars, fits).otherwise(breaks)

    def finish(have):
        return F.when((have["now"] != "") & (F.size(have["lines"]) < most_lines), F.array_append(have["lines"], have["now"])).otherwise(have["lines"])

    def cut(lines):
        short = F.length(F.array_join(words, " ")) > F.length(F.array_join(lines, " "))
        last = F.concat(F.substring(F.element_at(lines, -1), 1, most_chars - 1), F.lit("…"))
        return F.when((F.size(lines) == most_lines) & short, F.array_append(F.slice(lines, 1, most_lines - 1), last)).otherwise(lines)

    return let(F.aggregate(words, start, add, finish), cut)


def contained(label: Column, content: Column, token: Column | None = None) -> Column:
    """Untrusted text between marks that nobody can guess, for a prompt: a random token a row unless one is given; should
    the content hold it, it is taken out. Not deterministic, so the result must not be a key."""
    token = F.concat(F.lit("UNTRUSTED_"), F.substring(F.expr("replace(uuid(), '-', '')"), 1, 12)) if token is None else token
    name = F.substring(F.regexp_replace(label, "[^a-zA-Z0-9_.-]", "_"), 1, 64)
    body = sanitise(content)
    return let(token, lambda t: F.concat(F.lit("<<<"), t, F.lit(' label="'), name, F.lit('">>>\n'), F.replace(body, t, F.lit("[removed]")), F.lit("\n<<<END_"), t, F.lit(">>>")))
