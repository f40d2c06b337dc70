"""Spelling variants: words one edit apart by an even-partition pigeonhole join, each led to its commoner form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, dropped, mapped, rows_of, stored

#: Runs of letters in Latin-1 bytes, one a code point (fixed by the contract: A-Z, a-z, U+00C0 to U+00FF), LEAST or longer.
LEAST = 5
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST)
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: A hash bucket of more postings than FULL is split by the next segments; BUCKETS bounds the list of full ones.
FULL, BUCKETS = 100, 1 << 20


def _slipped(name: bytes, counts: Counter, every: int):
    """(word, n) of one document: a word whose digest `every` divides lacks one letter throughout the document."""
    start = zlib.crc32(name + b":")
    for word, n in counts.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def word_counts(docs: DataFrame, every: int = 97, least: int = 3) -> DataFrame:
    """(word, n): the words of 5 letters or more that occur `least` times or more in all documents together.

    Only A-Z are lower-cased. Null texts have no words; a null doc_id is the empty string in a word's digest. Repeated
    rows count each. Tasks count what they see before words are dealt by key, so a frequent word costs a row a task.
    """

    def run(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held = Counter()
        for ids, texts in rows_of(batches, ("doc_id", "text")):
            for i, text in zip(ids, texts):
                # other code points become question marks, which are no letters
                counts = Counter(_RUN.findall(text.encode("latin-1", "replace").lower()))
                for word, n in _slipped(b"" if i is None else str(i).encode(), counts, every):
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    counts = mapped(documents(docs), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) & (F.length("word") >= LEAST))


def _split(postings: DataFrame) -> DataFrame:
    """The two postings of each posting's open part by even partition.

    A posting says: outside `size` letters from `lo` on, the word is what `key` stands for. `longer` is 0 where the word
    is indexed and 1 where it probes for words one letter shorter. If two open parts are one edit apart, either the
    first halves agree (the edit is in the second) or the second halves do, shifted by the difference of lengths.
    """
    short = F.col("size") - F.col("longer")
    half = F.floor(short / 2).cast("int")
    first = F.struct(F.lit(0).alias("side"), F.expr("substring(word, lo, half)").alias("part"), (F.col("lo") + F.col("half")).alias("lo"), (F.col("size") - F.col("half")).alias("size"))
    second = F.struct(F.lit(1).alias("side"), F.expr("substring(word, lo + half + longer, size - longer - half)").alias("part"), F.col("lo"), (F.col("half") + F.col("longer")).alias("size"))
    both = postings.withColumn("half", half).withColumn("s", F.explode(F.array(first, second)))
    key = F.xxhash64("key", F.col("size") - F.col("longer"), "s.side", "s.part")
    return both.select("word", "n", "longer", key.alias("key"), F.col("s.lo").alias("lo"), F.col("s.size").alias("size"))


def links(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), once for each two of the distinct words that differ by one inserted, deleted or replaced letter.

    Every word is indexed by its two halves and probes with its own halves for words of equal length and with those of
    its even partition less one letter for shorter ones. Halves that many words share are split again by the halves of
    what is left open, until no bucket is full or one letter is open: words that agree in all but one place are links
    themselves, as many as the alphabet has letters at most. So no bucket compares all its pairs, and none is skipped.
    """
    spread = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    todo = words.select("word", "n", spread, F.lit(0).cast("long").alias("key"), F.lit(1).alias("lo"), F.length("word").alias("size"))
    tables, ready = [], []
    while True:
        postings = stored(_split(todo), "postings").withColumn("bucket", F.pmod("key", F.lit(BUCKETS)))
        tables.append(postings)
        full = stored(postings.where("size - longer > 1").groupBy("bucket").count().where(F.col("count") > FULL).select("bucket"), "full")
        tables.append(full)
        small = F.broadcast(full)  # BUCKETS numbers at most
        ready += [postings.where("size - longer <= 1"), postings.where("size - longer > 1").join(small, "bucket", "left_anti")]
        if full.isEmpty():
            break
        todo = postings.where("size - longer > 1").join(small, "bucket", "left_semi")
    every = reduce(DataFrame.union, [r.select("key", "word", "n", "longer") for r in ready])
    a = every.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = every.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    pairs = a.join(b, "key").where((F.col("longer") == 1) | (F.col("a") < F.col("b")))
    found = stored(pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").dropDuplicates(["a", "b"]), "links")
    dropped(*tables)
    return found


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of distinct words with their counts: the form is the near word of largest count
    (ties: the first in code-point order) if it has twice the word's count or more."""
    near = links(words)
    ends = F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"{y}_n").alias("m")) for x, y in ("ab", "ba")])
    best = near.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    far = -F.col("best.less") >= 2 * F.col("n")
    joined = words.join(best, "word", "left")
    result = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"))
    result = stored(result, "forms")
    dropped(near)
    return result


def with_roots(found: DataFrame) -> DataFrame:
    """Adds root, the last form that a word leads to, from the roots downwards.

    A round names the words whose form was named in the round before. Counts double along a chain at least, so the
    rounds are at most the binary logarithm of the largest count, and a form has no more followers than near words.
    """
    led = found.where("form is not null").select("word", "form")
    front = found.where("form is null").select("word", F.col("word").alias("root"))
    named = [front]
    while True:
        front = stored(led.join(front.withColumnRenamed("word", "form"), "form").select("word", "root"), "roots")
        named.append(front)
        if front.isEmpty():
            break
    return found.join(reduce(DataFrame.union, named), "word")


def variants(docs: DataFrame, every: int = 97, least: int = 3) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of word_counts(docs).

    Null and empty texts have no words; a very long run of letters is a word like others. Ties of count go by code
    point. Repeated rows count each. An empty table gives an empty result; extra columns are left behind.
    """
    words = stored(word_counts(docs, every, least), "words")
    found = with_roots(forms(words))
    dropped(words)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


#: DuckDB: the table of CRC-32 (its fixed polynomial), and the digest of a list of bytes by it.
CRC_SQL = """
crc_step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_step WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text of code points below 256, in a query that has `tab` in scope."""
    each = "CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [194 + (ord(x)::BIGINT - 128) // 64, 128 + ord(x)::BIGINT % 64] END"
    octets = f"flatten(list_transform(string_split({text}, ''), lambda x: {each}))"
    return f"xor(list_reduce([4294967295] || {octets}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


VARIANTS_SQL = f"""
WITH RECURSIVE {CRC_SQL},
run AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM {{docs}})
  WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (SELECT w, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM run, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shape AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM words, unnest(range(1, length(word) + 1)) t(i)),
pair AS (
  SELECT a.word, b.word AS other, b.n AS m FROM shape a JOIN shape b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shape a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM shape a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM pair GROUP BY word),
found AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
led(word, root) AS (
  SELECT word, word FROM found WHERE form IS NULL
  UNION ALL SELECT found.word, led.root FROM found JOIN led ON found.form = led.word)
SELECT word, form, root, n, n_near, form_n FROM found JOIN led USING (word)
"""
