"""The prefix trie of conversations by smallest-member ownership: each conversation owns the end of its path."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, mapped, stored
from .mixing import word_count

#: Values of turn, depth or conv_id (a power of two: so many bits) that one range of a two-level sum or list covers.
BITS = 12
#: Keys that meet a SHARE-th of all rows or more are joined by broadcast: there are SHARE of them at most.
SHARE = 1000
_FIRST = -(1 << 63)


def _before(how, values, key, order):
    """An aggregate over the rows before this one."""
    return how(values).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def split_join(rows: DataFrame, side: DataFrame, key: str, weight: str) -> DataFrame:
    """The inner join of rows with side, which has one row a key; its column `weight` is how many rows meet that key.

    Keys that meet a thousandth of all rows or more, a thousand keys at most, are broadcast, the others shuffled: no key
    of a shuffle holds more than a thousandth of the rows.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * SHARE >= total
    few = side.where(hot)
    rare = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(side.where(~hot), key)
    return rows.join(F.broadcast(few), key).unionByName(rare)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, tokens): the turns of each conversation in order from 1, a digest of role and text for each
    and the words of its text. Texts go no further than this scan.

    Turns go by turn, null first, ties by the digest; null role and text are empty. Rows without conv_id are left out.
    Ranges of 4096 turn numbers are ordered each for itself, so a long conversation is no task of its own.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select("conv_id", F.coalesce(F.shiftright("turn", BITS), F.lit(_FIRST)).alias("range"), "turn", digest.alias("digest"), word_count(text).alias("tokens"))
    turns = stored(turns, "turns")
    ranges = turns.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    starts = ranges.select("conv_id", "range", F.coalesce(_before(F.sum, "n", ["conv_id"], "range"), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    placed = turns.withColumn("place", place).join(starts, ["conv_id", "range"])
    result = stored(placed.select("conv_id", (F.col("start") + F.col("place")).alias("depth"), "digest", "tokens"), "turns")
    dropped(turns)
    return result


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, n) of numbered turns."""
    return turns.groupBy("conv_id").agg(F.max("depth").alias("n"))


def spliced(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and (conv_id, n) of all of them, turnless ones too.

    Conversation c starts with the first h turns of c - c % family (none if it is absent; % keeps the sign) and goes on
    with its own after its first h; h is the CRC-32 of its decimal id modulo `heads`. A conversation lends its first
    turns to family - 1 others at most.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = lengths(turns).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("lent"))
    lead = F.least("h", F.coalesce("lent", F.lit(0)))
    convs = stored(own.join(bases, "base", "left").select("conv_id", "base", "n", "h", lead.alias("lead")), "convs")
    kept = split_join(turns, convs, "conv_id", "n").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("lead")).alias("depth"), "digest", "tokens")
    lent = turns.where((F.col("depth") < heads) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.join(lent, "base").where("depth <= lead").select("conv_id", "depth", "digest", "tokens")
    return kept.unionByName(lent), convs.select("conv_id", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and node on its path, the root (depth 0) included.

    k1 and k2 name the node: 128 bits, each the XOR of a hash of depth and digest over all turns up to here, so that the
    name of the node above is this one without the own turn (t1, t2). `before` counts the tokens of the turns above.
    """
    hashes = {"t1": F.xxhash64("depth", "digest"), "t2": F.xxhash64("digest", "depth", F.lit("trie"))}
    rows = turns.withColumns({**hashes, "range": F.shiftright("depth", BITS)})
    rows = stored(rows.drop("digest"), "rows")
    ranges = rows.groupBy("conv_id", "range").agg(F.bit_xor("t1").alias("r1"), F.bit_xor("t2").alias("r2"), F.sum("tokens").alias("words"))
    none = F.lit(0).cast("long")
    start = lambda how, c: F.coalesce(_before(how, c, ["conv_id"], "range"), none).alias(c)
    ranges = ranges.select("conv_id", "range", start(F.bit_xor, "r1"), start(F.bit_xor, "r2"), start(F.sum, "words"))
    here = Window.partitionBy("conv_id", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"x1": F.bit_xor("t1").over(here), "x2": F.bit_xor("t2").over(here), "w": F.sum("tokens").over(here)}).join(ranges, ["conv_id", "range"])
    rows = rows.select("conv_id", "depth", F.expr("x1 ^ r1").alias("k1"), F.expr("x2 ^ r2").alias("k2"), "t1", "t2", "tokens", (F.col("words") + F.col("w") - F.col("tokens")).alias("before"))
    roots = convs.select("conv_id", none.alias("depth"), *[none.alias(c) for c in ("k1", "k2", "t1", "t2", "tokens", "before")])
    return rows.unionByName(roots)


NODE = ["depth", "k1", "k2"]


def _ends(rows: DataFrame) -> DataFrame:
    """The digest of the decimal conv_ids that end at a node, ascending: lists of a range of ids are joined in the JVM, and
    a node's lists pass one task as a stream, as SHA-256 reads its input in order; none is held whole."""
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    lists = rows.groupBy(*NODE, F.shiftright("conv_id", BITS).alias("part")).agg(ids.alias("ids"))

    def run(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*[k for k, _ in done])] + [pa.array([d for _, d in done])], names=[*NODE, "ends_sha256"])

        now, sha, done = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if key == now:
                    sha.update(b",")
                else:
                    if now:
                        done.append((now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            if len(done) > 1000:
                yield out()
                done = []
        if now:
            done.append((now, sha.hexdigest()))
            yield out()

    dealt = lists.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids")
    return mapped(dealt, run, "depth long, k1 long, k2 long, ends_sha256 string")


def _flag(condition: Column) -> Column:
    return condition.cast("long")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns, from the root: conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    turns are numbered(); convs has (conv_id, n) of every conversation. The smallest member of a node is that of all
    nodes below on its path, so a conversation owns the nodes of its path from a depth `cut` on, and every node has one
    owner. Sums over a subtree are then sums over the conversations that pass its top: the words of the path below it,
    once for each conversation, less those of the nodes that it owns; and one leaf where it owns a leaf. A node's owner,
    its sums and its children come from two groupings by node, combined before they are dealt, so that a node that
    all conversations share is a row a task. No row of an empty table: there is no root without a member.
    """
    rows = split_join(paths(turns, convs), convs.withColumn("met", F.col("n") + 1), "conv_id", "met").drop("met")
    rows = stored(rows.withColumn("more", F.col("depth") < F.col("n")), "paths")
    owners = rows.groupBy(*NODE).agg(F.min(F.struct("conv_id", "before")).alias("own"), F.max("more").alias("inner"))
    owned = owners.groupBy("own.conv_id").agg(F.min(F.struct("depth", F.col("own.before").alias("before"))).alias("cut"), F.max(_flag(~F.col("inner"))).alias("leaf"))
    totals = rows.groupBy("conv_id").agg(F.count("*").alias("met"), F.sum("tokens").alias("total"))
    facts = totals.join(owned, "conv_id", "left").select(
        "conv_id", "met", F.coalesce("cut.depth", "met").alias("cut"), F.coalesce("cut.before", "total").alias("spent"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")
    )
    facts = stored(facts, "facts")
    marked = split_join(rows, facts, "conv_id", "met")
    shared = F.when(F.col("depth") < F.col("cut"), F.col("spent") - F.col("before")).otherwise(0)
    nodes = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(shared).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"),
        F.sum(_flag(F.col("more") & (F.col("depth") + 1 >= F.col("cut")))).alias("n_children"), F.min("t1").alias("t1"), F.min("t2").alias("t2"),
    )
    nodes = stored(nodes, "nodes")
    name = lambda depth, k1, k2: F.struct(depth.alias("depth"), k1.alias("k1"), k2.alias("k2")).alias("above")
    children = nodes.where("depth > 0").withColumn("above", name(F.col("depth") - 1, F.expr("k1 ^ t1"), F.expr("k2 ^ t2")))
    parents = nodes.where("n_children > 0").select(name(*map(F.col, NODE)), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("children"))
    placed = split_join(children, parents, "above", "children").drop("above", "children")
    placed = placed.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = _ends(rows.where(~F.col("more")))
    result = placed.join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return result.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """trie() of the conversations as spliced() rebuilds them.

    Null turns come first, null roles and texts are empty, rows without conv_id are left out. Turns that tie go by a
    digest of role and text; repeated rows are turns of their own. A long text is read once, where it is scanned. An
    empty table gives an empty result; extra columns are left behind.
    """
    turns = numbered(conversations)
    return trie(*spliced(turns))


#: DuckDB SQL; {crc} is the table of CRC-32, {h} the digest of a conv_id.
TRIE_SQL = r"""
WITH RECURSIVE {crc},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {h} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
spliced AS (
  SELECT ids.conv_id, 0 AS part, pos, role, body FROM ids JOIN turns ON turns.conv_id = ids.conv_id - ids.conv_id % 20 WHERE pos <= h
  UNION ALL SELECT conv_id, 1, pos, role, body FROM ids JOIN turns USING (conv_id) WHERE pos > h),
path AS (
  SELECT conv_id, row_number() OVER w AS depth, list([role, body]) OVER w AS seq,
    len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words
  FROM spliced WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, [], 0 FROM ids),
node AS (SELECT seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM path GROUP BY seq, depth),
kids AS (SELECT seq[:depth - 1] AS seq, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT n.seq[:k] AS seq, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM node n LEFT JOIN kids ON kids.seq = n.seq, unnest(range(0, n.depth + 1)) t(k) GROUP BY ALL),
ends AS (
  SELECT seq, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(seq, depth) AS seq FROM path GROUP BY conv_id) GROUP BY seq)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, below.leaves AS n_leaves,
  below.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM node n JOIN below USING (seq) LEFT JOIN kids USING (seq) LEFT JOIN ends USING (seq)
  LEFT JOIN node up ON n.depth > 0 AND up.seq = n.seq[:n.depth - 1]
"""
