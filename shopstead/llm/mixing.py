"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: A source's keys are cut into COARSE ranges of FINE ranges each, so that no window sees a whole source.
COARSE, FINE = 256, 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.5 to 1 by the share of letters in the text: a document with more prose in it comes earlier in an epoch."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce(F.lit(0.5) + F.lit(0.5) * letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.5))


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target: weighted shares of `share` times all words, none above `cap` times its
    source's size. Raising a common level until the budget is spent is the fixed point of resharing every excess by
    weight. Sources weigh `weights` in turn by code point, null last. One row a source comes in, so one window will do.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") - 1) % len(weights) + 1)
    ranked = sources.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", cycle.cast("double"))
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("full_at", "pos")
    spent = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    levels = ranked.withColumn("budget", share * F.sum("source_size").over(every)).withColumn("level", (F.col("budget") - spent) / left)
    fits = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    return levels.withColumn("level", F.min(F.struct(fits.isNull().alias("no"), F.col("full_at").alias("at"), "pos", fits.alias("level"))).over(every)["level"]).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target")
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1", weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Each document draws the key -ln(u)/w, u from a digest of its doc_id and the seed, w its quality weight; ascending
    keys are the Efraimidis-Spirakis order. A source first takes as many complete epochs as its target (rounded to
    words) holds, then documents in key order until the rest is spent; the document at the border gives only the words
    still missing, so every source meets its target to the word. Prefix sums are two-level: sums by key range, then
    within a range, so a source that holds most rows is spread over its ranges.

    Null text counts 0 words and takes 0; a null source is a source of its own, after all others; documents without
    doc_id share one draw. Repeated rows are mixed as rows of their own; ties go by doc_id, then size. Empty tables
    give empty results; extra columns are left behind.
    """
    text = F.col("text")
    w = quality_weight(text) if weight is None else weight
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = docs.select("doc_id", "source", word_count(text).alias("size"), (-F.log(draw) / w).alias("key"))
    place = F.lit(1.0) - F.exp(-F.col("key"))
    keyed = keyed.withColumns({"coarse": F.floor(place * COARSE).cast("int"), "fine": F.floor(place * (COARSE * FINE)).cast("int"), "name": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()})
    keyed = stored(keyed, "mix")
    key = ["name", "unnamed"]
    fine = keyed.groupBy(*key, "coarse", "fine").agg(F.sum("size").alias("words"))
    coarse = fine.groupBy(*key, "coarse").agg(F.sum("words").alias("words"))
    before = lambda part, order: F.coalesce(F.sum("words").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select(*key, "coarse", before(key, "coarse").alias("start_coarse"))
    fine = fine.withColumn("start_fine", before([*key, "coarse"], "fine"))
    by_source = keyed.groupBy(*key, "source").agg(F.sum("size").alias("source_size"))
    aims = targets(by_source.select("source", "source_size"), weights, share, cap)
    aims = aims.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source_size", "target")
    ranges = fine.join(coarse, [*key, "coarse"]).join(aims, key).select(*key, "fine", "source_size", "target", (F.col("start_coarse") + F.col("start_fine")).alias("start"))
    within = Window.partitionBy(*key, "fine").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(ranges, [*key, "fine"]).withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal = F.round("target").cast("long")
    epochs = F.coalesce(F.floor(goal / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), goal - epochs * F.col("source_size") - F.col("start")))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


#: DuckDB SQL for mix(documents) with its defaults; {docs} is the table.
MIX_SQL = r"""
WITH keyed AS (
  SELECT doc_id, source,
    CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / coalesce(0.5::DOUBLE + 0.5::DOUBLE * CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS DOUBLE) / CAST(nullif(length(text), 0) AS DOUBLE), 0.5::DOUBLE) AS key
  FROM {docs}),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(pos - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos FROM src)),
level AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
  FROM ranked),
aim AS (
  SELECT source, source_size, least(most, coalesce(weight * (
    SELECT lam FROM level WHERE lam <= most / weight ORDER BY most / weight, pos LIMIT 1), most)) AS target
  FROM level),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS goal,
    CAST(coalesce(sum(size) OVER (PARTITION BY keyed.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM keyed JOIN aim ON keyed.source IS NOT DISTINCT FROM aim.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size
    + greatest(0, least(size, goal % source_size - start)) END AS taken
FROM placed
"""
