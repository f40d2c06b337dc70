"""Crawl policy over stored pages: robots rules, sitemaps, bounded breadth-first crawl, fetch verdicts."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import tables


def folder(spark: SparkSession) -> None:
    """Lets checkpoint() write to the folder that the driver and all executors share; to one of our own only where the session
    names none and the master is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        spark.sparkContext.setCheckpointDir(place)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tables.scratch(spark, "checkpoints"))


def parse_robots(files: DataFrame) -> DataFrame:
    """(site, body) -> (site, line, group, field, value): directives with the group they belong to.

    User-agent lines open a group unless they follow one another; directives before any belong to none.
    """
    lines = files.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("line", "raw"))
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    fields = lines.withColumn("text", text).where(F.contains("text", F.lit(":"))).select("site", "line", F.lower(F.trim(F.regexp_extract("text", "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("text", "^[^:]*:(.*)$", 1)).alias("value"))
    known = fields.where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay", "sitemap"))
    in_group = known.where("field != 'sitemap'")
    order = Window.partitionBy("site").orderBy("line")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = in_group.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order)).drop("opens")
    return grouped.unionByName(known.where("field = 'sitemap'").withColumn("group", F.lit(None).cast("long")))


def group_for(directives: DataFrame, agent: str) -> DataFrame:
    """(site, group): the group with the longest agent token inside our agent string; * is the weakest, first wins."""
    agents = directives.where("field = 'user-agent' and group > 0").withColumn("value", F.lower("value"))
    score = F.when(F.col("value") == "*", 0).when(F.contains(F.lit(agent.lower()), F.col("value")), F.length("value"))
    return agents.withColumn("score", score).where("score is not null").groupBy("site").agg(F.max_by("group", F.struct("score", -F.col("line"))).alias("group"))


def rules_for(directives: DataFrame, agent: str) -> DataFrame:
    """(site, allow, pattern, length, regex) of the group that applies. `$` anywhere is the end of the path."""
    rules = directives.where("field in ('allow', 'disallow') and value != ''").join(group_for(directives, agent), ["site", "group"])
    literal = F.regexp_replace("value", r"([.+?^{}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("$"), F.lit(r"\z")))
    return rules.select("site", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), F.length(F.regexp_replace("value", r"\$$", "")).alias("length"), regex.alias("regex"))


def robots_verdicts(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, path) with allowed: the longest matching pattern decides, Allow on ties; no match allows."""
    best = rules.join(paths.select("site", "path").distinct(), "site").where(F.regexp_like("path", F.col("regex"))).groupBy("site", "path").agg(F.max_by("allow", F.struct("length", "allow")).alias("verdict"))
    return paths.join(best, ["site", "path"], "left").withColumn("allowed", F.coalesce("verdict", F.lit(True))).drop("verdict")


def crawl_delay_ms(directives: DataFrame, agent: str, own_ms: int, most_ms: int = 10_000) -> DataFrame:
    """Per site the pause between fetches: the declared delay within bounds, never below our own."""
    declared = directives.where("field = 'crawl-delay'").join(group_for(directives, agent), ["site", "group"]).withColumn("s", F.col("value").try_cast("double")).where("s >= 0")
    last = declared.groupBy("site").agg(F.max_by("s", "line").alias("s"))
    return last.select("site", F.greatest(F.lit(own_ms), F.least(F.round(F.col("s") * 1000).cast("long"), F.lit(most_ms))).alias("delay_ms"))


def is_robots(body: Column, content_type: Column) -> Column:
    head = F.lower(F.substring(body, 1, 500))
    return ~(F.coalesce(content_type.rlike("(?i)html"), F.lit(False)) | F.contains(head, F.lit("<!doctype html")) | F.contains(head, F.lit("<html")))


#: Where sitemaps live when robots.txt names none.
WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.xml?page=1", "/wp-sitemap.xml")


def well_known_sitemaps(sites: DataFrame) -> DataFrame:
    return sites.withColumn("sitemap", F.explode(F.array(*[F.concat("origin", F.lit(p)) for p in WELL_KNOWN])))


#: Entries of one sitemap, sitemaps a site starts from, goes on to from an index, and visits; entries for a page
#: that is to be read, after which no further sitemap is opened.
MOST_ENTRIES, FIRST_SITEMAPS, NESTED, VISITED, PER_PAGE = 5000, 5, 10, 10, 3


def parse_sitemap(files: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """(site, base, xml, and the file's url where there is one) -> (site, sitemap, n, url, lastmod, priority, is_index): the
    first entries of each file that lie on the same site, normalised, in order; tolerant of broken XML. A file with both
    kinds of entries is no index."""
    return _own(_entries(files, most))


def _own(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("url").isNotNull() & urls.same_site(F.col("url"), F.col("base"))).drop("base")


def _entries(files: DataFrame, most: int | None) -> DataFrame:
    """What parse_sitemap finds before foreign addresses are left out, with the file's base."""
    index = F.col("xml").rlike(r"(?i)<sitemap\b") & ~F.col("xml").rlike(r"(?i)<url\b")
    blocks = F.when(index, F.regexp_extract_all("xml", F.lit(r"(?is)<sitemap\b[^>]*>(.*?)</sitemap>"), F.lit(1))).otherwise(F.regexp_extract_all("xml", F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1)))
    name = F.col("url") if "url" in files.columns else F.lit(None).cast("string")
    # blocks are a column before they are exploded: an entry does not carry its file along
    cut = files.select("site", "base", name.alias("sitemap"), index.alias("is_index"), (blocks if most is None else F.slice(blocks, 1, most)).alias("blocks"))
    rows = cut.select("site", "base", "sitemap", "is_index", F.posexplode("blocks").alias("n", "block")).repartition("site", "sitemap", "n")
    tag = lambda t: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("block", rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), r"(?s)<!\[CDATA\[|\]\]>", "")), F.lit(""))
    loc = F.replace(tag("loc"), F.lit("&amp;"), F.lit("&"))
    # each a column of its own, since the next one reads it many times
    rows = rows.withColumns({"loc": loc, "priority": tag("priority").try_cast("double")})
    rows = rows.withColumn("near", F.when(F.col("loc").rlike("(?i)^https?://"), F.col("loc")).otherwise(urls.resolve(F.col("loc"), F.col("base"))))
    return rows.select("site", "base", "sitemap", "n", "is_index", urls.normalise(F.col("near")).alias("url"), tag("lastmod").try_cast("timestamp").alias("lastmod"), F.when(F.col("priority").between(0, 1), F.col("priority")).alias("priority"))


def nested_sitemaps(starts: DataFrame, files: DataFrame, most_pages: int = 200, most_entries: int | None = MOST_ENTRIES) -> DataFrame:
    """(site, url, sitemap, place, rank, lastmod, priority): the addresses that a site's sitemaps list, each where it is
    listed first; place is the number of its sitemap in the order of visits, rank its place within it by prioritise().

    starts (site, origin, seq, url) name the first sitemaps of a site, of which five count; files (site, base, url, xml) are
    what is stored. Indexes queue their first ten sitemaps behind those that wait. A site visits ten different
    sitemaps, unsafe, foreign and missing ones included, so cycles end, and opens none once it has three times
    most_pages addresses. Of a file most_entries count, all where it is None. A round visits all sitemaps of one depth; ten rounds are the most there can be. Between rounds
    there are ten rows a site at most, written by checkpoint(), as are the entries of all files, which every round reads.
    """
    folder(files.sparkSession)
    entries = _own(_entries(files, most_entries).checkpoint())
    sizes = entries.groupBy("site", F.col("sitemap").alias("url")).agg(F.count("*").alias("n"), F.max("is_index").alias("is_index"))
    nested = entries.where("is_index").withColumn("k", F.row_number().over(Window.partitionBy("site", "sitemap").orderBy("n"))).where(F.col("k") <= NESTED).select("site", "sitemap", F.col("url").alias("child"), "k")
    queue = starts.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("seq"))).where(F.col("k") <= FIRST_SITEMAPS).select("site", "origin", "url", F.lit(0).alias("parent"), "k")
    rounds: list[DataFrame] = []
    while True:
        once = queue.groupBy("site", "origin", "url").agg(F.min(F.struct("parent", "k")).alias("at"))
        held = F.lit(0)
        if rounds:
            seen = reduce(DataFrame.unionByName, rounds)
            counts = seen.groupBy("site").agg(F.count("*").alias("held"))
            once, held = once.join(seen.select("site", "url"), ["site", "url"], "left_anti").join(counts, "site"), F.col("held")
        place = held + F.row_number().over(Window.partitionBy("site").orderBy("at"))
        now = once.withColumn("place", place).where(F.col("place") <= VISITED).join(sizes, ["site", "url"], "left")
        good = urls.unsafe_url("url").isNull() & urls.same_site(F.col("url"), F.col("origin"))
        now = now.withColumn("good", good).select("site", "origin", "url", "place", F.when(F.col("good") & ~F.col("is_index"), F.col("n")).otherwise(0).alias("n"), (F.col("good") & F.coalesce("is_index", F.lit(False))).alias("opens")).checkpoint()
        if now.isEmpty():
            break
        rounds.append(now)
        queue = now.where("opens").select("site", "origin", F.col("url").alias("sitemap"), F.col("place").alias("parent")).join(nested, ["site", "sitemap"]).select("site", "origin", F.col("child").alias("url"), "parent", "k")
    if not rounds:
        return entries.limit(0).select("site", "url", "sitemap", F.lit(0).alias("place"), F.lit(0).alias("rank"), "lastmod", "priority")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("site").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = reduce(DataFrame.unionByName, rounds).withColumn("before", before).where((F.col("before") < PER_PAGE * most_pages) & (F.col("n") > 0)).select("site", F.col("url").alias("sitemap"), "place")
    listed = prioritise(entries.where("not is_index").join(opened, ["site", "sitemap"]), ["site", "sitemap"])
    return listed.groupBy("site", "url").agg(F.min(F.struct("place", "rank", "sitemap", "lastmod", "priority")).alias("first")).select("site", "url", "first.*")


def prioritise(entries: DataFrame, by=("site",)) -> DataFrame:
    """rank of each entry on its site: path class, newest first, priority, then order of appearance."""
    order = Window.partitionBy(*by).orderBy(urls.sitemap_class(F.col("url")), F.coalesce(F.unix_seconds("lastmod"), F.lit(0)).desc(), F.coalesce("priority", F.lit(0.0)).desc(), "n")
    return entries.withColumn("rank", F.row_number().over(order))


def frontier(links: DataFrame) -> DataFrame:
    """rank of each (site, seq, url) in its site's frontier: path class, then order found."""
    order = Window.partitionBy("site").orderBy(urls.frontier_class(F.col("url")), "seq")
    return links.withColumn("rank", F.row_number().over(order))


def crawl(pages: DataFrame, starts: DataFrame, most_pages: int, most_bytes: int | None = None) -> DataFrame:
    """Breadth-first crawl of stored pages (url, links, status) from starts (site, url), `most_pages` a site.

    Pages may also have final_url (where a redirect led), canonical and bytes. A page that was led to, or declares itself
    a view of, an address its site has seen is a duplicate: it is read but not taken. What was seen and taken is kept a
    table a round, each written once, so a round writes its own addresses only. A site stops after most_pages pages
    or once most_bytes are read, and gets to see six times most_pages addresses at most. Each round joins the frontier to
    the pages and leaves out what was seen; rounds run until no site has anything new to read. Within a round pages are
    taken in frontier order. Returns (site, url, round, n). Rounds are cut by checkpoint(), so the session needs a
    checkpoint folder, which the driver and all executors share.
    """
    folder(pages.sparkSession)
    given = lambda c, other: F.coalesce(c, other) if c in pages.columns else other
    stored = pages.where("status = 200").select("url", "links", given("final_url", F.col("url")).alias("final_url"), given("canonical", F.lit(None).cast("string")).alias("canonical"), given("bytes", F.lit(0)).cast("long").alias("bytes"))
    own = F.when(urls.same_site(F.col("canonical"), F.col("final_url")), urls.normalise(F.col("canonical")))
    stored = stored.withColumn("same", F.coalesce(own, "final_url")).drop("canonical")
    todo = starts.select("site", "url").distinct().withColumn("seq", F.lit(0).cast("long")).checkpoint()
    met, taken, spent = [todo.select("site", "url")], [], None
    for step in itertools.count():
        hits, seen = todo.join(stored, "url"), reduce(DataFrame.unionByName, met)
        for name in ("final_url", "same"):
            known = hits.select("site", name).distinct().join(seen.withColumnRenamed("url", name), ["site", name], "left_semi").withColumn(f"{name}_seen", F.lit(True))
            hits = hits.join(known, ["site", name], "left")
        if spent is not None:
            hits = hits.join(spent, "site", "left")
        else:
            hits = hits.withColumns({"have": F.lit(0).cast("long"), "used": F.lit(0).cast("long")})
        order = Window.partitionBy("site").orderBy(urls.frontier_class(F.col("url")), "seq", "url")
        again = F.row_number().over(Window.partitionBy("site", "same").orderBy(urls.frontier_class(F.col("url")), "seq", "url")) > 1
        elsewhere = lambda c, own: (F.col(c) != own) & F.col(f"{c}_seen").isNotNull()
        twin = (elsewhere("final_url", F.col("url")) & F.lit(step > 0)) | elsewhere("same", F.col("final_url")) | again
        ranked = hits.withColumn("twin", twin).withColumns({
            "n": F.coalesce("have", F.lit(0)) + F.sum((~F.col("twin")).cast("long")).over(order),
            "read": F.coalesce("used", F.lit(0)) + F.sum("bytes").over(order),
        })
        before = F.col("n") - (~F.col("twin")).cast("long")
        room = before < most_pages if most_bytes is None else (before < most_pages) & (F.col("read") - F.col("bytes") < most_bytes)
        read = ranked.where(room).select("site", "url", F.lit(step).alias("round"), "n", "links", "final_url", "same", "bytes", "twin").checkpoint()
        got = read.where("not twin")
        taken.append(got.select("site", "url", "round", "n"))
        now = read.groupBy("site").agg(F.count_if(~F.col("twin")).alias("have"), F.sum("bytes").alias("used"))
        spent = (now if spent is None else spent.unionByName(now)).groupBy("site").agg(F.sum("have").alias("have"), F.sum("used").alias("used")).checkpoint()
        arrived = got.select("site", F.explode(F.array("final_url", "same")).alias("url")).distinct().join(seen, ["site", "url"], "left_anti").checkpoint()
        met.append(arrived)
        seen = seen.unionByName(arrived)
        nxt = got.select("site", "n", F.posexplode("links").alias("i", "url")).groupBy("site", "url").agg(F.min(F.struct("n", "i")).alias("at"))
        new = nxt.join(seen, ["site", "url"], "left_anti").withColumn("seq", F.row_number().over(Window.partitionBy("site").orderBy("at")).cast("long"))
        new = new.join(seen.groupBy("site").agg(F.count("*").alias("held")), "site", "left").where(F.col("seq") + F.col("held") <= 6 * most_pages)
        todo = new.select("site", "url", (F.lit(step + 1).cast("long") * (6 * most_pages + 1) + F.col("seq")).alias("seq")).checkpoint()
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        met.append(todo.select("site", "url"))


def fetch_warning(status: Column, content_type: Column, robots_ok: Column, unsafe: Column) -> Column:
    """Why a page was not read, NULL if it was."""
    return F.when(~robots_ok, "robots-disallowed").when(unsafe.isNotNull(), "unsafe-url").when(status != 200, F.concat(F.lit("http-"), status.cast("string"))).when(~content_type.rlike("(?i)html"), "not-html")
