"""Guarded generation: providers by capability, answers validated, one repair, a decision row for each request."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import injection_signals
from .crawl import folder
from .generate import ANGLES, CTAS, VOICES, pick, short
from .schemas import WHOLE, answer_ddl, answer_issues, answer_value

#: Characters of a field of untrusted data, of a summary; complaints that a repair names; what a decision's
#: reasoning says; what a repair asks.
MOST_FIELD, MOST_SUMMARY, MOST_ISSUES = 20_000, 2000, 4
BUILT_IN = "Generated by the built-in provider without a language model. Treat as a starting point rather than a recommendation."
FROM_FACTS = "Generated from the verified facts read from this business’s own website."
REPAIR = "\n\nThe previous response could not be used. Return only valid output matching\nthe required shape. The problem was: "


@dataclass(frozen=True)
class Provider:
    """Something that does a job. run is given Columns (for AI: task name, instruction, data map) and gives a Column: an
    expression, or a pandas UDF over them. Providers are tried by priority; those that are not free need to be enabled."""

    key: str
    capability: str
    run: Callable[..., Column]
    tier: str = "LOCAL_FREE"
    priority: int = 100
    cents: int = 0


@dataclass
class Registry:
    """Providers by capability; a later one of the same key takes the place of an earlier one."""

    providers: dict[tuple[str, str], Provider] = field(default_factory=dict)

    def register(self, provider: Provider) -> Provider:
        self.providers[provider.capability, provider.key] = provider
        return provider

    def choose(self, capability: str, enabled: tuple[str, ...] = ()) -> Provider:
        """The enabled provider of least priority, a paid one before a free one; free ones are always enabled."""
        found = [p for p in self.providers.values() if p.capability == capability and (p.tier == "LOCAL_FREE" or p.key in enabled)]
        if not found:
            raise LookupError(f"no provider for {capability}")
        return min(found, key=lambda p: (p.tier == "LOCAL_FREE", p.priority, p.key))


def prepared(data: Column) -> Column:
    """Untrusted data as a writer is given it: sanitised, and cut where a field is too long."""
    return F.transform_values(data, lambda k, v: text.truncate(text.sanitise(v), MOST_FIELD))


def generate(requests: DataFrame, provider: Provider, task: str) -> DataFrame:
    """A decision row for each request (id, instruction, data map<string, string>, input_summary, fact_ids).

    A provider's answer is JSON, parsed and held against the task's bounds. One that does not fit is asked for once
    more, with what was wrong; one that does not fit then is refused: output is NULL and error says so. Columns: id,
    kind, input_summary, signals (wording of the data that looks like an instruction: told, never acted on), output,
    reasoning_summary, uncertainty, fact_ids, provider_key, simulated, estimated_cost_cents, attempts, error. Answers
    are written by checkpoint() before they are looked at, so no plan asks a provider twice for one attempt.
    """
    folder(requests.sparkSession)
    signals = F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values("data"), injection_signals))))
    asked = requests.select("id", "instruction", prepared(F.col("data")).alias("data"), F.substring("input_summary", 1, MOST_SUMMARY).alias("input_summary"), "fact_ids", signals.alias("signals"))

    def attempt(rows: DataFrame, n: int) -> DataFrame:
        answered = rows.withColumn("answer", provider.run(F.lit(task), F.col("instruction"), F.col("data"))).checkpoint()
        parsed = answered.withColumn("value", F.from_json("answer", answer_ddl(task)))
        return parsed.withColumns({"issues": answer_issues(F.col("value"), task), "value": answer_value(F.col("value"), task), "attempts": F.lit(n)})

    first = attempt(asked, 1)
    bad = first.where(F.size("issues") > 0)
    complaint = F.concat("instruction", F.lit(REPAIR), F.array_join(F.slice("issues", 1, MOST_ISSUES), "; "))
    second = attempt(bad.withColumn("instruction", complaint).select(*asked.columns), 2)
    done = first.where(F.size("issues") == 0).unionByName(second)
    ok = F.size("issues") == 0
    simulated = F.col("value.simulated") | F.lit(provider.tier == "LOCAL_FREE")
    reasoning = F.col("value.reasoning") if "reasoning" in WHOLE[task] else F.lit(None).cast("string")
    summary = F.when(simulated, BUILT_IN).when(F.trim(reasoning) != "", F.substring(reasoning, 1, MOST_SUMMARY)).otherwise(FROM_FACTS)
    return done.select(
        "id", F.lit(task).alias("kind"), "input_summary", "signals", F.when(ok, F.to_json("value")).alias("output"), F.when(ok, summary).alias("reasoning_summary"), F.when(ok, F.when(simulated, "high").otherwise("medium")).alias("uncertainty"),
        "fact_ids", F.lit(provider.key).alias("provider_key"), F.when(ok, simulated).alias("simulated"), (F.lit(provider.cents) * F.col("attempts")).alias("estimated_cost_cents"), "attempts",
        F.when(~ok, F.concat(F.lit("AI_OUTPUT_INVALID: "), F.array_join(F.slice("issues", 1, MOST_ISSUES), "; "))).alias("error"),
    )


def hypotheses(decisions: DataFrame) -> DataFrame:
    """(id, n, statement, reasoning, uncertainty, kind): what a business analysis supposes, a row each; an inference, no fact."""
    value = F.from_json("output", answer_ddl("business.analyse"))
    rows = decisions.where("kind = 'business.analyse' and output is not null").select("id", F.posexplode(value["audienceHypotheses"]).alias("n", "h"))
    return rows.select("id", "n", "h.statement", "h.reasoning", F.upper("h.uncertainty").alias("uncertainty"), "h.kind")


#: What the free writer supposes of every audience, and says of pictures that nobody has looked at.
_AUDIENCES = (
    ("People who already searched for this kind of product", "Intent-led audiences are the usual starting point for a new account.", "high"),
    ("Existing visitors who did not buy", "Retargeting needs no new audience research to be worth testing.", "medium"),
)
_NO_FORM = "Not established — nothing here has looked at the pictures."
_NOT_NAMED = "Anything not named above. Nothing here comes from looking at the product."
_ASSUMED, _VARIED = "Generated locally without market data. Treat as a starting point.", ("creative concept", "headline")
MOST_ALTS = 8


def _analysis(data: Column) -> Column:
    name = F.coalesce(data["businessName"], F.lit("This business"))
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("statement", "reasoning", "uncertainty"), a)]) for a in _AUDIENCES])
    return F.struct(F.lit(True).alias("simulated"), F.concat(name, F.lit(" sells products described on its own website.")).alias("valueProposition"), pick(name, VOICES).alias("brandVoice"), rows.alias("audienceHypotheses"))


def _strategies(data: Column) -> Column:
    name = F.coalesce(data["productName"], F.lit("the product"))
    one = lambda a: F.struct(
        F.lit(a).alias("angle"), F.concat(F.lit(f"A {a.lower().replace('_', '/', 1)} angle may suit "), name, F.lit(".")).alias("hypothesis"), F.concat(name, F.lit(", shown plainly.")).alias("hook"),
        pick(F.concat(name, F.lit(a)), CTAS).alias("suggestedCta"), F.array(F.lit(_ASSUMED)).alias("assumptions"), F.array(*map(F.lit, _VARIED)).alias("testingVariables"),
    )
    return F.struct(F.lit(True).alias("simulated"), F.array(*map(one, ANGLES)).alias("strategies"))


def _brief(data: Column) -> Column:
    """What the pictures show, in the merchant's words: the free writer cannot look."""
    name = F.coalesce(data["productName"], F.lit("this product"))
    lines = F.filter(F.split(F.coalesce(data["imageDescriptions"], F.lit("")), "\n"), lambda x: x.startswith("- "))
    alts = F.slice(F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, 3, 1 << 20))), lambda x: x != ""), 1, MOST_ALTS)
    said, some = F.array_join(alts, "; "), F.size(alts) > 0
    looks = F.when(some, F.concat(F.lit("The site's own words about its pictures: "), said, F.lit("."))).otherwise(F.concat(F.lit("No description of "), name, F.lit("'s appearance was found on the site, and the free version cannot look at photographs.")))
    told = F.concat(F.lit("A product photograph of "), name, F.lit(". Everything known about its appearance: "), said, F.lit(". Do not add designs, characters or colours beyond these — they would be invented."))
    plain = F.concat(F.lit("A plain product photograph of "), name, F.lit(" on a neutral background. Nothing is known about its appearance, so invent nothing: no characters, no seasonal decoration, no packaging detail."))
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(True).alias("simulated"), F.lit(False).alias("seen"), looks.alias("looksLike"), none.alias("colours"), F.lit(_NO_FORM).alias("form"), none.alias("printedText"), F.array(F.lit(_NOT_NAMED)).alias("doNotShow"),
        F.when(some, told).otherwise(plain).alias("imagePrompt"),
    )


def _copy(data: Column) -> Column:
    name, detail = F.coalesce(data["productName"], F.lit("this product")), text.first_sentence(data["productDetails"])
    head = short(name, 48)
    plain = F.concat(name, F.lit(". See the details and decide for yourself."))
    one = F.struct(short(F.when(detail.isNotNull(), F.concat(name, F.lit(". "), detail)).otherwise(plain), 500).alias("primaryText"), head.alias("headline"), F.lit("Available now.").alias("description"), F.lit("Shop now").alias("cta"))
    looking = F.concat(F.lit("Looking at "), name, F.lit("? Here is what it is."))
    two = F.struct(short(F.when(detail.isNotNull(), F.concat(detail, F.lit(" Read more about "), name, F.lit("."))).otherwise(looking), 500).alias("primaryText"), short(F.concat(F.lit("About "), head), 60).alias("headline"), F.lit("Full details on the product page.").alias("description"), F.lit("Learn more").alias("cta"))
    return F.struct(F.lit(True).alias("simulated"), F.array(one, two).alias("variants"))


def free_writer(task: Column, instruction: Column, data: Column) -> Column:
    """The built-in provider: an answer to each task, composed of what it is given and nothing else; NULL for other tasks."""
    answer = None
    for name, make in (("business.analyse", _analysis), ("strategy.generate", _strategies), ("product.describe", _brief), ("copy.generate", _copy)):
        answer = (F.when if answer is None else answer.when)(task == name, F.to_json(make(data)))
    return answer


REGISTRY = Registry()
REGISTRY.register(Provider("local-writer", "AI", free_writer))
