"""Workspaces: roles, sessions, ownership, slugs, onboarding, what owners may edit."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Roles from the least, campaign objectives of goals, bounds of owner edits, tries for a slug.
ROLES = ("VIEWER", "MEMBER", "ADMIN", "OWNER")
OBJECTIVES = {"SALES": "OUTCOME_SALES", "LEADS": "OUTCOME_LEADS", "CUSTOMERS": "OUTCOME_TRAFFIC", "AWARENESS": "OUTCOME_AWARENESS"}
MOST_DESCRIPTION, MOST_COST, TRIES, SLUG = 2000, 100_000_000, 25, 60


def has_role(actual: Column, required: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for pair in zip(ROLES, range(len(ROLES))) for x in pair])
    return rank[actual] >= rank[required]


def live_sessions(sessions: DataFrame, users: DataFrame, memberships: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not expired, with their user and the workspaces the user is in, a row each."""
    live = sessions.where(F.col("expires_at") > now)
    return live.join(users, "user_id").join(memberships, "user_id")


def expired(sessions: DataFrame, now: Column) -> DataFrame:
    """The sessions that a purge deletes."""
    return sessions.where(F.col("expires_at") <= now)


def allowed(requests: DataFrame, memberships: DataFrame, required: str = "VIEWER") -> DataFrame:
    """requests (user_id, workspace_id) of members whose role suffices."""
    return requests.join(memberships.where(has_role(F.col("role"), F.lit(required))).select("user_id", "workspace_id").distinct(), ["user_id", "workspace_id"], "left_semi")


def not_found(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """requests to workspaces that the user is no member of; they see no difference to ones that are not there."""
    return requests.join(memberships.select("user_id", "workspace_id").distinct(), ["user_id", "workspace_id"], "left_anti")


def foreign(rows: DataFrame, businesses: DataFrame) -> DataFrame:
    """Rows whose business is not one of their workspace's: what an ownership assertion fails on."""
    return rows.join(businesses.select(F.col("id").alias("business_id"), "workspace_id").distinct(), ["business_id", "workspace_id"], "left_anti")


def listed(businesses: DataFrame, archived: bool = False) -> DataFrame:
    """rank of each business in its workspace, newest first; archived ones only on request."""
    rows = businesses if archived else businesses.where("archived_at is null")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc("created_at"), "id")))


def active(requests: DataFrame, businesses: DataFrame) -> DataFrame:
    """requests (workspace_id, requested) with business_id: the requested one if the workspace lists it, else its first."""
    rows = listed(businesses)
    own = rows.select("workspace_id", F.col("id").alias("requested"), F.col("id").alias("hit"))
    first = rows.where("rank = 1").select("workspace_id", F.col("id").alias("first"))
    found = requests.join(own, ["workspace_id", "requested"], "left").join(first, "workspace_id", "left")
    return found.withColumn("business_id", F.coalesce("hit", "first")).drop("hit", "first")


def onboarding_step(goal: Column, amount: Column, period: Column) -> Column:
    return F.when(goal.isNull(), "goal").when(amount.isNull() | period.isNull(), "budget").otherwise("done")


def objective(goal: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in OBJECTIVES.items() for x in pair])[goal]


def may_scan(paused_at: Column, by_owner: Column) -> Column:
    """A paused business is scanned only when its owner asks."""
    return paused_at.isNull() | by_owner


@F.pandas_udf(StringType())
def _plain(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks, which no built-in function does."""
    marks = re.compile("[̀-ͯ]")
    for part in names:
        yield part.map(lambda x: None if x is None else marks.sub("", unicodedata.normalize("NFKD", x)))


def slugify(name: Column, most: int = SLUG) -> Column:
    """Lower-case letters and digits with dashes between them, at most `most` characters, no dash at either end."""
    bare = F.regexp_replace(F.lower(_plain(name)), "['’ʼ`]", "")
    dashed = F.trim(F.regexp_replace(bare, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(dashed, 1, most), F.lit("-"))


def unique_slugs(new: DataFrame, taken: DataFrame) -> DataFrame:
    """new (seq, name) with slug: its base, or the base with the next free number from 2 on; NULL after TRIES numbers.

    Rows of one base take free numbers in the order of seq; numbers are free if no taken slug has them. New slugs of
    other bases are not looked at.
    """
    rows = new.withColumn("base", F.coalesce(F.nullif(slugify(F.col("name")), F.lit("")), F.lit("workspace")))
    numbers = rows.select("base").distinct().withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(TRIES))))
    numbers = numbers.withColumn("slug", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("number").cast("string"))))
    free = numbers.join(taken.select("slug"), "slug", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("number")))
    asked = rows.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("seq")))
    return asked.join(free.select("base", "k", "slug"), ["base", "k"], "left").drop("base", "k")


def owner_edits(products: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """products (id, owner_description, owner_described_at, cost_cents) after edits (id, description, cost_cents,
    has_description, has_cost), with `error` where an edit is refused; a refused edit changes nothing.

    A blank description clears what was there. Edits of products that are not there do nothing.
    """
    e = edits.select("id", F.trim("description").alias("text"), F.col("cost_cents").alias("new_cost"), "has_description", "has_cost")
    long, bad = F.length("text") > MOST_DESCRIPTION, ~F.col("new_cost").between(0, MOST_COST)
    error = F.when(F.col("has_description") & long, "description-too-long").when(F.col("has_cost") & bad, "unusable-cost")
    # texts grow with the edits, whatever the size of the files they come from; those that are refused stay behind
    e = e.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull() & F.col("has_description"), F.col("text")))
    rows = products.join(e.hint("merge"), "id", "left")
    fine = F.col("error").isNull()
    text, told = F.nullif(F.col("text"), F.lit("")), fine & F.coalesce("has_description", F.lit(False))
    changed = {
        "owner_description": F.when(told, text).otherwise(F.col("owner_description")),
        "owner_described_at": F.when(told, F.when(text.isNotNull(), now)).otherwise(F.col("owner_described_at")),
        "cost_cents": F.when(fine & F.coalesce("has_cost", F.lit(False)), F.col("new_cost")).otherwise(F.col("cost_cents")),
    }
    return rows.withColumns(changed).drop("text", "new_cost", "has_description", "has_cost")
