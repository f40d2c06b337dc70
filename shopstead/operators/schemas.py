"""Bounds of generated answers and job payloads as data: violations as a column, and the same as JSON Schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field is Text(most characters), Texts(most items, characters each) or one of a tuple of values.
Text, Texts = "text", "texts"

#: The bounds of each answer. Field -> (kind, ...); a name that ends in "?" may be missing.
ANSWERS = {
    "copy": {"primary_text": (Text, 500), "headline": (Text, 60), "description": (Text, 120), "cta": (Text, 40)},
    "strategy": {
        "angle": ("PROBLEM_SOLUTION", "BENEFIT", "DEMONSTRATION", "LIFESTYLE", "SEASONAL", "GIFT", "VALUE", "SOCIAL_PROOF", "URGENCY", "EDUCATIONAL", "COMPARISON"),
        "hypothesis": (Text, 1000), "hook": (Text, 300), "suggested_cta": (Text, 40), "assumptions?": (Texts, 10, 300), "testing_variables?": (Texts, 10, 300),
    },
    "hypothesis": {
        "statement": (Text, 300), "reasoning": (Text, 1000), "uncertainty?": ("low", "medium", "high"),
        "kind?": ("AUDIENCE_HYPOTHESIS", "MOTIVATION", "OBJECTION", "USE_CASE", "SEASONAL_OPPORTUNITY"),
    },
    "brief": {
        "looks_like": (Text, 1000), "colours?": (Texts, 10, 300), "form": (Text, 300), "packaging?": (Text, 300), "printed_text?": (Texts, 10, 300), "scale?": (Text, 300),
        "do_not_show?": (Texts, 10, 300), "image_prompt": (Text, 1200),
    },
}
#: How many rows of each kind an answer has.
ROWS = {"copy": (1, 5), "strategy": (1, 6), "hypothesis": (1, 8), "brief": (1, 1)}
_UUID = r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _wrong(value: Column, rule: tuple, optional: bool) -> Column:
    if rule[0] == Text:
        size = F.length(F.trim(value))
        bad = (size < 1) | (size > rule[1])
    elif rule[0] == Texts:
        bad = (F.size(value) > rule[1]) | F.exists(value, lambda x: x.isNull() | ~F.length(F.trim(x)).between(1, rule[2]))
    else:
        bad = ~value.isin(*rule)
    return F.coalesce(bad, F.lit(not optional))


def violations(kind: str) -> Column:
    """Names of the fields of an answer's row that are missing, blank, too long, too many or not of the enum."""
    found = []
    for name, rule in ANSWERS[kind].items():
        field = name.rstrip("?")
        found.append(F.when(_wrong(F.col(field), rule, name.endswith("?")), F.lit(field)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def accepted(answers: DataFrame, kind: str, by: str) -> DataFrame:
    """(by, n, ok): whether an answer's rows are of an allowed number and none of them has violations."""
    least, most = ROWS[kind]
    rows = answers.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.size(violations(kind)) > 0).alias("bad"))
    return rows.select(by, "n", (F.col("n").between(least, most) & (F.col("bad") == 0)).alias("ok"))


def json_schema(kind: str) -> dict:
    """The same bounds for a provider that takes a JSON Schema."""

    def of(rule):
        if rule[0] == Text:
            return {"type": "string", "minLength": 1, "maxLength": rule[1]}
        if rule[0] == Texts:
            return {"type": "array", "maxItems": rule[1], "items": {"type": "string", "minLength": 1, "maxLength": rule[2]}}
        return {"type": "string", "enum": list(rule)}

    fields = ANSWERS[kind]
    return {"type": "object", "additionalProperties": False, "properties": {n.rstrip("?"): of(r) for n, r in fields.items()}, "required": [n for n in fields if not n.endswith("?")]}


#: Whole answers as providers give them. Flag is a truth value that is false where it is missing; Rows(least,
#: most, fields) are records. A field that may be missing has a default only where DEFAULTS names one; lists are empty.
Flag, Rows = "flag", "rows"
_HYPOTHESIS = {"statement": (Text, 300), "reasoning": (Text, 1000), "uncertainty?": ("low", "medium", "high"), "kind?": ("AUDIENCE_HYPOTHESIS", "MOTIVATION", "OBJECTION", "USE_CASE", "SEASONAL_OPPORTUNITY")}
DEFAULTS = {"uncertainty": "high", "kind": "AUDIENCE_HYPOTHESIS"}
WHOLE = {
    "business.analyse": {"simulated?": (Flag,), "valueProposition": (Text, 1000), "brandVoice": (Text, 300), "restrictions?": (Texts, 10, 300), "audienceHypotheses": (Rows, 1, 8, _HYPOTHESIS)},
    "strategy.generate": {
        "simulated?": (Flag,),
        "strategies": (Rows, 1, 6, {"angle": ANSWERS["strategy"]["angle"], "hypothesis": (Text, 1000), "hook": (Text, 300), "suggestedCta": (Text, 40), "assumptions?": (Texts, 10, 300), "testingVariables?": (Texts, 10, 300)}),
    },
    "copy.generate": {"simulated?": (Flag,), "variants": (Rows, 1, 5, {"primaryText": (Text, 500), "headline": (Text, 60), "description": (Text, 120), "cta": (Text, 40)})},
    "product.describe": {
        "simulated?": (Flag,), "seen?": (Flag,), "looksLike": (Text, 1000), "colours?": (Texts, 10, 300), "form": (Text, 300), "packaging?": (Text, 300), "printedText?": (Texts, 10, 300), "scale?": (Text, 300),
        "doNotShow?": (Texts, 10, 300), "imagePrompt": (Text, 1200),
    },
}


def answer_ddl(task: str) -> str:
    """The type of a task's answer."""

    def of(fields):
        kinds = {Text: "string", Texts: "array<string>", Flag: "boolean"}
        return ",".join(f"{n.rstrip('?')}:{f'array<struct<{of(r[3])}>>' if r[0] == Rows else kinds.get(r[0], 'string')}" for n, r in fields.items())

    return f"struct<{of(WHOLE[task])}>"


def answer_issues(value: Column, task: str) -> Column:
    """Paths of what is wrong with a parsed answer, in the order of its fields: the field, or rows.field of any row."""

    def wrong_in(name, rule):
        return lambda row: _wrong(row[name.rstrip("?")], rule, name.endswith("?"))

    def of(v, fields, before):
        found = []
        for name, rule in fields.items():
            field, optional = name.rstrip("?"), name.endswith("?")
            path = F.lit(f"{before}{field}")
            if rule[0] == Rows:
                rows = v[field]
                found.append(F.when(F.coalesce(~F.size(rows).between(rule[1], rule[2]), F.lit(True)), path))
                found += [F.when(F.exists(rows, wrong_in(n, r)), F.lit(f"{field}.{n.rstrip('?')}")) for n, r in rule[3].items()]
            elif rule[0] != Flag:
                found.append(F.when(_wrong(v[field], rule, optional), path))
        return found

    listed = F.filter(F.array(*of(value, WHOLE[task], "")), lambda x: x.isNotNull())
    return F.when(value.isNull(), F.array(F.lit("root"))).otherwise(listed)


def answer_value(value: Column, task: str) -> Column:
    """A parsed answer with texts trimmed and defaults put in."""

    def one(v, name, rule):
        field = name.rstrip("?")
        if rule[0] == Flag:
            out = F.coalesce(v[field], F.lit(False))
        elif rule[0] == Text:
            out = F.trim(v[field])
        elif rule[0] == Texts:
            out = F.coalesce(F.transform(v[field], F.trim), F.array().cast("array<string>"))
        elif rule[0] == Rows:
            out = F.transform(v[field], lambda x: F.struct(*[one(x, n, r) for n, r in rule[3].items()]))
        else:
            out = F.coalesce(v[field], F.lit(DEFAULTS[field])) if name.endswith("?") else v[field]
        return out.alias(field)

    return F.struct(*[one(value, n, r) for n, r in WHOLE[task].items()])


PAYLOAD = "scanRunId string, businessId string, requestedUrl string, isRescan boolean, ownerRequested boolean"


def scan_payload(payload: Column) -> Column:
    """struct of a scan job's payload (JSON) with flags filled in; NULL where ids are no UUIDs or the address no URL."""
    p = F.from_json(payload, PAYLOAD)
    fine = p["scanRunId"].rlike(_UUID) & p["businessId"].rlike(_UUID) & p["requestedUrl"].rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^\s/?#]+")
    flag = lambda name: F.coalesce(p[name], F.lit(False)).alias(name)
    return F.when(fine, F.struct(*[p[n].alias(n) for n in ("scanRunId", "businessId", "requestedUrl")], flag("isRescan"), flag("ownerRequested")))


def config_errors(pairs: list[tuple[object, object]], daily: int, campaign: int, provider_daily: int, provider_monthly: int) -> list[str]:
    """What a deployment's settings contradict each other in, checked on the driver before any job starts: credentials
    that go together (both or neither of a pair), and ceilings of a shorter time above those of a longer one. 0 means
    nothing may be spent, not that anything may."""
    found = [f"pair {k} is set in part" for k, (x, y) in enumerate(pairs) if bool(x) != bool(y)]
    if daily > campaign:
        found.append("the daily ceiling is above the campaign's")
    if provider_daily > provider_monthly:
        found.append("the daily provider ceiling is above the monthly one")
    return found
