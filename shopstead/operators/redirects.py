"""Redirect chains over stored responses, every hop gated anew, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import tables
from .crawl import folder

#: Redirects that are followed at most (fixed by the contract).
MOST_HOPS = 5
#: Rows of a task that parses, resolves and gates addresses, some 0.1 ms each.
SPREAD = 10_000
CHAIN = ["url", "end", "hops", "chain", "outcome"]


def steps(responses: DataFrame) -> DataFrame:
    """Where each stored response (url, status, location) leads: `end` after `hops` (0 or 1) with the chain of addresses, and
    the outcome: http-<status>, no-location, invalid-location or unsafe-url; NULL where the next address is to be
    looked up. Addresses are normalised; of responses that share one, the one with the least status counts."""
    raw = urls.resolve(F.col("location"), F.col("url"))
    rows = tables.spread(responses.where(urls.absolute(F.col("url"))), SPREAD).withColumns({"raw": raw, "url": urls.normalise(F.col("url"))})
    rows = rows.withColumns({"next": urls.normalise(F.col("raw")), "unsafe": F.when(F.col("raw").isNotNull(), urls.unsafe_url("raw"))})
    moved = F.col("status").between(300, 399)
    outcome = F.when(~F.coalesce(moved, F.lit(False)), F.concat(F.lit("http-"), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
    outcome = outcome.when(F.coalesce(F.trim("location"), F.lit("")) == "", "no-location").when(F.col("raw").isNull(), "invalid-location").when(F.col("unsafe").isNotNull(), "unsafe-url").when(F.col("next").isNull(), "invalid-location")
    once = rows.withColumn("outcome", outcome).groupBy("url").agg(F.min(F.struct(F.coalesce("status", F.lit(0)).alias("s"), "outcome", "next")).alias("r"))
    goes = F.col("r.outcome").isNull()
    end = F.when(goes, F.col("r.next")).otherwise(F.col("url"))
    return once.select("url", end.alias("end"), goes.cast("int").alias("hops"), F.when(goes, F.array("r.next")).otherwise(F.array().cast("array<string>")).alias("chain"), F.col("r.outcome").alias("outcome"))


def further(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chains a, those still open carried on by the chains b of the addresses where they stand."""
    on = b.select(F.col("url").alias("end"), F.col("end").alias("b_end"), F.col("hops").alias("b_hops"), F.col("chain").alias("b_chain"), F.col("outcome").alias("b_outcome"), F.lit(True).alias("met"))
    moved = a.where("outcome is null").join(on, "end", "left")
    lost = F.when(F.col("met").isNull(), "not-stored").otherwise(F.col("b_outcome"))
    carried = moved.select("url", F.coalesce("b_end", "end").alias("end"), (F.col("hops") + F.coalesce("b_hops", F.lit(0))).alias("hops"), F.concat("chain", F.coalesce("b_chain", F.array().cast("array<string>"))).alias("chain"), lost.alias("outcome"))
    return a.where("outcome is not null").select(*CHAIN).unionByName(carried)


def follow(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every row of requests (url) with final_url, hops, chain (addresses led to, in order) and outcome.

    A chain ends at the first response that is no redirect (http-<status>), has no location, leads to an address that is
    none or must not be fetched (the gate is asked at every hop) or is not stored; more than five redirects, cycles
    included, are too-many-redirects. An unsafe request is not looked up. Chains of one, two and four hops are composed
    with each other in place of five look-ups one after another; chains that have ended take no part. Nulls are unsafe.
    """
    folder(requests.sparkSession)
    one = steps(responses).checkpoint()
    two = further(one, one).checkpoint()
    six = further(further(two, two), two)
    many = F.col("outcome").isNull() | (F.col("hops") > MOST_HOPS)
    ended = six.select(
        F.col("url").alias("_key"), F.when(many, F.element_at("chain", MOST_HOPS)).otherwise(F.col("end")).alias("final_url"), F.least("hops", F.lit(MOST_HOPS)).alias("hops"),
        F.slice("chain", 1, MOST_HOPS).alias("chain"), F.when(many, "too-many-redirects").otherwise(F.col("outcome")).alias("outcome"),
    )
    asked = tables.spread(requests, SPREAD).withColumns({"_unsafe": urls.unsafe_url("url"), "_key": urls.normalise(F.col("url"))})
    found = asked.join(ended, "_key", "left")
    none = F.array().cast("array<string>")
    safe = F.col("_unsafe").isNull()
    return found.withColumns({
        "final_url": F.when(safe, F.coalesce("final_url", "_key")), "hops": F.when(safe, F.coalesce("hops", F.lit(0))).otherwise(0), "chain": F.when(safe, F.coalesce("chain", none)).otherwise(none),
        "outcome": F.when(~safe, "unsafe-url").otherwise(F.coalesce("outcome", F.lit("not-stored"))),
    }).drop("_unsafe", "_key")
