"""Registered queries over stored sites (products of pages, crawls, redirects, sitemaps), each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, extract, ld, redirects
from ..sources.projections import _split, as_sql, project

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Markup of one of the six parts of a shop page, in expressions that Spark and DuckDB read alike. Kinds of pages: 0 cards
#: that sell, 1 cards that lead elsewhere, 2 cards where nothing is sold, 3 cards in a cart, 4 several declared products,
#: 5 one declared product, 6 microdata scopes, 7 a labelled price.
_CARD = """CASE WHEN kind <= 3 THEN concat('<li class="tile n', nth, '"', CASE WHEN id % 4 = 0 THEN concat(' id="t', id, '"') ELSE '' END, '><em>New</em><h3>', name, '</h3><i>+ $4.99 shipping</i>',
    CASE WHEN price = '' THEN '' ELSE concat('<b>$', price, '</b>') END, CASE WHEN id % 3 = 0 THEN concat('<img src="data:x" data-src="/img/', id, '.jpg" alt="a ', type, ' thing" width="', id % 900, '" height="auto"><img src="/img/', id, '.jpg">') ELSE '' END,
    CASE WHEN kind = 1 THEN concat('<a href="/p/', id, '">see</a>') ELSE '' END, CASE WHEN id % 7 = 0 THEN concat('<u data-sku=" K-', id, ' "></u>') ELSE '' END,
    CASE WHEN kind = 2 THEN '<button>Read more</button>' WHEN id % 5 = 0 THEN '<input type="submit" value="Choose">' WHEN id % 11 = 0 THEN '' ELSE '<button>Add to basket</button>' END, ' </li>')
  WHEN kind = 4 OR kind = 5 AND nth = 0 THEN concat('<script type="application/ld+json">{"@type":"Product","name":"', name, '","brand":{"name":"', brand, '"}', CASE WHEN id % 2 = 0 THEN concat(',"sku":"S ', id, '"') ELSE '' END,
    ',"offers":{"price":"', price, '","priceCurrency":"eur","availability":"https://schema.org/', CASE WHEN id % 3 = 0 THEN 'OutOfStock' ELSE 'InStock' END, '"}}</script>')
  WHEN kind = 6 THEN concat('<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">', name, '</b><meta itemprop="price" content="', price, '"><p itemprop="description">', type, ' goods</p></div>')
  WHEN kind = 7 AND nth = 0 THEN concat('<h1>', name, '</h1><p class="price">', CASE WHEN price = '' THEN 'ask us' ELSE concat('£', price) END, '</p><s>£999.00</s>') ELSE '' END"""
_HEAD = """CASE kind WHEN 3 THEN '<main id="minicart"><ul>' WHEN 5 THEN '<meta property="og:description" content="One of many"><img src="/logo.png" width="32" height="0"><main><ul>' ELSE '<main><ul>' END"""


def shop_pages(spark, sf_dir):
    """(page_id, url, html) made from parts, six a page."""
    cards = project(spark, sf_dir, "shop_parts").selectExpr("page_id", "kind", "nth", f"{_CARD} AS card")
    html = F.concat(F.expr(_HEAD), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "card"))), lambda x: x["card"]), ""), F.lit("</ul></main>"))
    return cards.groupBy("page_id", "kind").agg(html.alias("html")).selectExpr("page_id", "concat('https://shop.example/w/', page_id) AS url", "html")


def _cents(text: str) -> str:
    return f"CAST(round(TRY_CAST({text} AS DOUBLE) * 100) AS BIGINT)"


def _slug(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', '-', 'g'), '-')"


#: The pages taken apart by their tags alone (a closing tag ends the element that is open at its depth), cards as intervals
#: of tags, the largest group of like siblings; declared products by their JSON or tags.
_PRODUCTS = rf"""WITH pages_ AS (SELECT page_id, kind, {_HEAD} || string_agg({_CARD}, '' ORDER BY nth) || '</ul></main>' AS html FROM {as_sql("shop_parts")} GROUP BY page_id, kind),
  tok AS (SELECT page_id, i, l[i] AS x, CASE WHEN l[i] LIKE '</%' THEN -1 WHEN l[i] LIKE '<%' AND NOT regexp_matches(l[i], '^<(img|input|meta)\b') THEN 1 ELSE 0 END AS step
    FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^<]+') AS l FROM pages_), unnest(range(1, len(l) + 1)) t(i)),
  place AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) - greatest(step, 0) AS depth FROM tok),
  el AS (SELECT page_id, i, depth, step, x, regexp_extract(x, '^<(\w+)', 1) AS tag, regexp_extract(x, ' class="([^"]*)"', 1) AS css FROM place WHERE x LIKE '<%' AND step >= 0),
  ends AS (SELECT e.page_id, e.i, CASE WHEN e.step = 0 THEN e.i ELSE min(c.i) END AS e FROM el e LEFT JOIN place c ON c.page_id = e.page_id AND c.step = -1 AND c.depth = e.depth AND c.i > e.i GROUP BY e.page_id, e.i, e.step),
  node AS (SELECT el.*, ends.e, p.i AS parent, CASE WHEN css = '' THEN tag ELSE '.' || string_split(css, ' ')[1] END AS shape FROM el JOIN ends USING (page_id, i)
    ASOF LEFT JOIN (SELECT page_id, depth + 1 AS depth, i FROM el WHERE step = 1) p ON p.page_id = el.page_id AND p.depth = el.depth AND el.i > p.i),
  own AS (SELECT n.page_id, n.i, trim(string_agg(t.x, ' ' ORDER BY t.i)) AS own FROM node n JOIN place t ON t.page_id = n.page_id AND t.step = 0 AND t.x NOT LIKE '<%' AND t.depth = n.depth + 1 AND t.i > n.i AND t.i < n.e GROUP BY ALL),
  part_of AS (SELECT c.page_id, c.i AS card, n.i, n.x, n.tag, o.own FROM node c JOIN node n ON n.page_id = c.page_id AND n.i > c.i AND n.i < c.e LEFT JOIN own o ON o.page_id = n.page_id AND o.i = n.i),
  card AS (SELECT page_id, card, min_by(own, i) FILTER (WHERE regexp_matches(own, '^\$[1-9]')) AS amount, min_by(own, i) FILTER (WHERE regexp_matches(own, '^[A-Z][a-z]+ [a-z]+$') AND tag NOT IN ('button', 'a')) AS name,
      bool_or(tag = 'a') AS leads, bool_or(coalesce(own, '') LIKE 'Add to %' OR x LIKE '%"Choose"%') AS sells, min_by(trim(regexp_extract(x, 'data-sku="([^"]*)"', 1)), i) FILTER (WHERE x LIKE '%data-sku%') AS sku,
      any_value('https://shop.example' || regexp_extract(x, 'src="(/[^"]*)"', 1) || '|' || regexp_extract(x, 'alt="([^"]*)"', 1) || '|' || regexp_replace(regexp_extract(x, 'width="([^"]*)"', 1), '^0$', '') || '|') FILTER (WHERE x LIKE '<img%alt=%') AS images
    FROM part_of GROUP BY ALL),
  good AS (SELECT *, amount IS NOT NULL AND name IS NOT NULL AND NOT leads AND sells AS ok FROM card),
  grouped AS (SELECT n.page_id, n.i, n.parent, n.shape, n.x, c.* EXCLUDE (page_id, card), count(*) OVER g AS like_n, count(*) FILTER (WHERE ok) OVER g AS good_n
    FROM node n JOIN good c ON c.page_id = n.page_id AND c.card = n.i WHERE n.parent IS NOT NULL WINDOW g AS (PARTITION BY n.page_id, n.parent, n.shape)),
  best AS (SELECT g.* FROM grouped g JOIN pages_ p USING (page_id) WHERE good_n >= 2 AND good_n >= like_n - 1 AND ok AND p.html LIKE '%Add to basket%' AND p.html NOT LIKE '%minicart%'
    QUALIFY good_n = max(good_n) OVER (PARTITION BY g.page_id)),
  sold AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY i) = 1),
  ld AS (SELECT page_id, kind, n, x->>'$.name' AS name, x->>'$.sku' AS sku, x->>'$.brand.name' AS brand, x->>'$.offers.price' AS price, x->>'$.offers.priceCurrency' AS currency, CASE WHEN x->>'$.offers.availability' LIKE '%/In%' THEN 'IN_STOCK' ELSE 'OUT_OF_STOCK' END AS availability
    FROM (SELECT page_id, kind, n, l[n + 1]::JSON AS x FROM (SELECT page_id, kind, regexp_extract_all(html, '<script[^>]*>([^<]*)<', 1) AS l FROM pages_ WHERE kind IN (4, 5)), unnest(range(0, len(l))) t(n))),
  micro AS (SELECT page_id, n, regexp_extract(l[n + 1], '"name">([^<]*)<', 1) AS name, regexp_extract(l[n + 1], 'content="([^"]*)"', 1) AS price, regexp_extract(l[n + 1], '"description">([^<]*)<', 1) AS description
    FROM (SELECT page_id, regexp_extract_all(html, '<div itemscope.*?</div>') AS l FROM pages_ WHERE kind = 6), unnest(range(0, len(l))) t(n)),
  lone AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)<', 1) AS name, regexp_extract(html, 'price">£([^<]*)<', 1) AS price FROM pages_ WHERE kind = 7),
  every AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS owner, name, NULL AS description, sku, NULL AS brand, {_cents("amount[2:]")} AS price_cents, 'HTML' AS price_method, NULL AS compare_price_cents, 'USD' AS currency, NULL AS availability,
      coalesce(nullif(regexp_extract(x, ' id="([^"]*)"', 1), ''), {_slug("coalesce(sku, name)")}) AS anchor, coalesce(images, '') AS images FROM sold
    UNION ALL SELECT page_id, n, name, NULL, sku, brand, {_cents("price")}, CASE WHEN price <> '' THEN 'JSON_LD' END, NULL, upper(currency), availability, {_slug("coalesce(sku, name)")}, '' FROM ld WHERE kind = 4
    UNION ALL SELECT page_id, n, name, 'One of many', sku, brand, {_cents("price")}, CASE WHEN price <> '' THEN 'JSON_LD' END, NULL, currency, availability, NULL, 'https://shop.example/logo.png||32|' FROM ld WHERE kind = 5
    UNION ALL SELECT page_id, n, name, description, NULL, NULL, {_cents("price")}, CASE WHEN price <> '' THEN 'MICRODATA' END, NULL, NULL, NULL, {_slug("name")}, '' FROM micro
    UNION ALL SELECT page_id, 0, name, NULL, NULL, NULL, {_cents("CASE WHEN price = '' THEN '999.00' ELSE price END")}, CASE WHEN price = '' THEN 'TEXT_PATTERN' ELSE 'HTML' END, CASE WHEN TRY_CAST(price AS DOUBLE) < 999 THEN 99900 END, 'GBP', NULL, NULL, '' FROM lone)
  SELECT page_id, CAST(owner AS INT) AS owner, name, description, sku, brand, price_cents, price_method, CAST(compare_price_cents AS BIGINT) AS compare_price_cents, currency, availability, anchor, images FROM every"""


@query(_PRODUCTS)
def page_products(spark, sf_dir):
    none = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    shown = F.array_join(F.transform("images", lambda i: F.concat_ws("|", i["url"], none(i["alt"]), none(i["width"]), none(i["height"]))), ",")
    got = extract.products(extract.extract(shop_pages(spark, sf_dir)))
    return got.select("page_id", F.col("owner").cast("int").alias("owner"), "name", "description", "sku", "brand", "price_cents", "price_method", "compare_price_cents", "currency", "availability", "anchor", shown.alias("images"))


#: Stored responses made from events, most of them redirects: chains, cycles, an address that many lead to, addresses that
#: must not be fetched, and some that are not stored.
_RESPONSES = """SELECT id, concat('https://r', id % 5, '.example/', id) AS url, CASE WHEN id % 4 = 0 THEN 200 WHEN id % 29 = 1 THEN 404 WHEN id % 2 = 0 THEN 301 ELSE 302 END AS status,
  CASE WHEN id % 37 = 9 THEN NULL WHEN id % 41 = 10 THEN 'http://10.0.0.1/x' WHEN id % 43 = 11 THEN 'ftp://r0.example/1' WHEN id % 47 = 12 THEN '/nowhere' WHEN t % 5 = id % 5 THEN concat('/', t) ELSE concat('https://r', t % 5, '.example/', t, '#top') END AS location
  FROM (SELECT event_id AS id, CASE WHEN event_id % 7 = 3 THEN event_id + 1 WHEN event_id % 11 = 6 THEN event_id - 1 WHEN event_id % 5 = 1 THEN 2 ELSE CAST(floor(event_id / 3) AS BIGINT) END AS t FROM events)"""


@query(f"""WITH RECURSIVE r AS ({_RESPONSES}),
  n AS (SELECT id, url, status, location, CASE WHEN location LIKE '/%' THEN regexp_extract(url, '^(https://[^/]*)', 1) || location ELSE regexp_replace(location, '#.*', '') END AS target FROM r),
  s AS (SELECT url, target, CASE WHEN status < 300 OR status > 399 THEN 'http-' || status WHEN location IS NULL THEN 'no-location' WHEN NOT regexp_matches(target, '^https?://') OR regexp_matches(target, '^http://10\\.') THEN 'unsafe-url' END AS outcome FROM n),
  walk AS (SELECT id, url AS now, 0 AS hops, []::VARCHAR[] AS chain, NULL::VARCHAR AS outcome FROM r
    UNION ALL SELECT w.id, CASE WHEN s.url IS NULL OR s.outcome IS NOT NULL OR hops = 5 THEN w.now ELSE s.target END, CASE WHEN s.url IS NULL OR s.outcome IS NOT NULL OR hops = 5 THEN hops ELSE hops + 1 END,
      CASE WHEN s.url IS NULL OR s.outcome IS NOT NULL OR hops = 5 THEN chain ELSE list_append(chain, s.target) END, CASE WHEN s.url IS NULL THEN 'not-stored' WHEN s.outcome IS NOT NULL THEN s.outcome WHEN hops = 5 THEN 'too-many-redirects' END
    FROM walk w LEFT JOIN s ON s.url = w.now WHERE w.outcome IS NULL)
  SELECT id, now AS final_url, hops, array_to_string(chain, ' ') AS chain, outcome FROM walk WHERE outcome IS NOT NULL""")
def redirect_chains(spark, sf_dir):
    t = F.expr("CASE WHEN event_id % 7 = 3 THEN event_id + 1 WHEN event_id % 11 = 6 THEN event_id - 1 WHEN event_id % 5 = 1 THEN 2 ELSE CAST(floor(event_id / 3) AS BIGINT) END")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), t.alias("t"))
    url, status, location = (x.rpartition(" AS ")[0] for x in _split(_RESPONSES[len("SELECT id, ") : _RESPONSES.index("\n  FROM")]))
    stored = rows.selectExpr("id", f"{url} AS url", f"{status} AS status", f"{location} AS location")
    got = redirects.follow(stored.select("id", "url"), stored.drop("id"))
    return got.select("id", "final_url", "hops", F.array_join("chain", " ").alias("chain"), "outcome")


#: Sitemaps of fifty sites made from parts: an index with a foreign file, a repeated one, a relative one, a cycle, an index
#: of twelve, a broken file, and one that lists what another lists already.
_SITE = "concat('https://m', p_size, '.example')"
_SITE_FILES = f"""SELECT p_size AS site, kind, {_SITE} AS base, p_partkey AS id,
  concat('<url><loc> ', {_SITE}, CASE p_partkey % 4 WHEN 0 THEN '/products/' WHEN 1 THEN '/blog/' WHEN 2 THEN '/shop/' ELSE '/x/' END, p_partkey % 60, '</loc>', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('<lastmod>2024-01-', 10 + p_partkey % 19, '</lastmod>') END, '<priority>', CASE p_partkey % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '7' ELSE '0.25' END, '</priority></url>') AS entry
  FROM part, (SELECT unnest([0, 1, 4, 5]) AS kind)"""


def _index(*names: str) -> str:
    """A sitemap index of the named files of a site, as an expression."""
    return "concat('<sitemapindex>', " + ", ".join(f"concat('<sitemap><loc>', {n}, '</loc></sitemap>')" for n in names) + ", '</sitemapindex>')"


_OWN = [f"concat(base, '/s{k}.xml')" for k in range(7)]
_INDEXES = {
    "concat(base, '/sitemap.xml')": _index(_OWN[0], _OWN[1], "'https://other.example/x.xml'", _OWN[2], _OWN[0], _OWN[3], "'/s4.xml'", "'http://127.0.0.1/s.xml'"),
    _OWN[2]: _index("concat(base, '/sitemap.xml')", _OWN[5], _OWN[6]), _OWN[3]: "'<urlset><url><loc>'",
    _OWN[4]: f"CASE WHEN site % 2 = 1 THEN {_index(*[f'''concat(base, '/c{k}.xml')''' for k in range(12)], _OWN[5])} END",
}
_LISTS = "CASE kind WHEN 0 THEN id % 3 = 0 WHEN 1 THEN id % 3 = 1 WHEN 4 THEN site % 2 = 0 AND id % 3 = 2 ELSE id % 2 = 0 END"


@query(f"""WITH RECURSIVE e AS ({_SITE_FILES}), f AS (SELECT site, base || '/s' || kind || '.xml' AS url, '<urlset>' || string_agg(entry, '' ORDER BY id) || '</urlset>' AS xml FROM e WHERE {_LISTS} GROUP BY ALL
    UNION ALL SELECT site, u, x FROM (SELECT DISTINCT site, base FROM e), LATERAL (VALUES {", ".join(f"({u}, {x})" for u, x in _INDEXES.items())}) t(u, x) WHERE x IS NOT NULL),
  nest AS (SELECT site, url, i, l[i] AS child FROM (SELECT site, url, regexp_extract_all(xml, '<loc>([^<]+)</loc></sitemap>', 1) AS l FROM f), unnest(range(1, len(l) + 1)) t(i)),
  abs AS (SELECT site, url, CASE WHEN child LIKE '/%' THEN 'https://m' || site || '.example' || child ELSE child END AS child, i FROM nest),
  kept AS (SELECT site, url, child, row_number() OVER (PARTITION BY site, url ORDER BY i) AS i FROM abs WHERE child LIKE 'https://m' || site || '.example/%'),
  walk AS (SELECT DISTINCT site, 'https://m' || site || '.example/sitemap.xml' AS url, [0] AS path FROM f
    UNION ALL SELECT w.site, k.child, list_append(w.path, k.i) FROM walk w JOIN kept k ON k.site = w.site AND k.url = w.url WHERE k.i <= 10 AND len(w.path) < 6),
  visit AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY len(path), path) AS place FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY len(path), path) = 1)),
  item AS (SELECT site, url AS sitemap, i, regexp_extract(l[i], '<loc>\\s*([^<]*)</loc>', 1) AS url, TRY_CAST(regexp_extract(l[i], '<lastmod>([^<]*)<', 1) AS TIMESTAMP) AS lastmod, TRY_CAST(regexp_extract(l[i], '<priority>([^<]*)<', 1) AS DOUBLE) AS p
    FROM (SELECT site, url, regexp_extract_all(xml, '<url>.*?</url>') AS l FROM f), unnest(range(1, len(l) + 1)) t(i)),
  size AS (SELECT v.*, coalesce(n, 0) AS n FROM visit v LEFT JOIN (SELECT site, sitemap AS url, count(*) AS n FROM item GROUP BY ALL) USING (site, url) WHERE place <= 10),
  open AS (SELECT site, url AS sitemap, place FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY site ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM size) WHERE b < 45),
  ranked AS (SELECT item.*, place, row_number() OVER (PARTITION BY item.site, item.sitemap ORDER BY CASE WHEN item.url LIKE '%/products/%' THEN 0 WHEN item.url LIKE '%/shop/%' THEN 1 WHEN item.url LIKE '%/blog/%' THEN 4 ELSE 3 END,
      coalesce(epoch(lastmod), 0) DESC, CASE WHEN p <= 1 THEN p ELSE 0 END DESC, i) AS rank FROM item JOIN open USING (site, sitemap))
  SELECT site, url, sitemap, place, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY place, rank) = 1""")
def sitemap_walk(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    columns = [c.replace("site_files", "") for c in _split(_SITE_FILES[len("SELECT ") : _SITE_FILES.index("\n  FROM")])]
    entries = part.withColumn("kind", F.explode(F.array(*map(F.lit, (0, 1, 4, 5))))).selectExpr(*columns).where(_LISTS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "entry"))), lambda x: x["entry"]), "")
    sets = entries.groupBy("site", "base", "kind").agg(text.alias("xml")).selectExpr("site", "base", "concat(base, '/s', kind, '.xml') AS url", "concat('<urlset>', xml, '</urlset>') AS xml")
    sites = part.selectExpr("p_size AS site", f"{_SITE} AS base").distinct()
    others = sites.select("site", "base", F.explode(F.array(*[F.struct(F.expr(u).alias("url"), F.expr(x).alias("xml")) for u, x in _INDEXES.items()])).alias("f")).select("site", "base", "f.*").where("xml is not null")
    starts = sites.selectExpr("site", "base AS origin", "0 AS seq", "concat(base, '/sitemap.xml') AS url")
    got = crawl.nested_sitemaps(starts, sets.unionByName(others), most_pages=15, most_entries=None)
    return got.select("site", "url", "sitemap", F.col("place").cast("long").alias("place"), F.col("rank").cast("long").alias("rank"))


#: Stored pages of twenty sites made from customers: trees with links back and across, missing pages, views of other pages.
_PATH = "CASE WHEN {k} = 0 THEN '/' WHEN {k} % 5 = 0 THEN concat('/products/', {k}) WHEN {k} % 5 = 1 THEN concat('/blog/', {k}) WHEN {k} % 5 = 2 THEN concat('/about/', {k}) WHEN {k} % 5 = 3 THEN concat('/x/', {k}) ELSE concat('/shop/', {k}) END"
_WEB = "concat('https://w', c_custkey % 20, '.example', {path})"
_K = "CAST(floor(c_custkey / 20) AS INT)"
_LINKED = [f"({_K} * 2 + 1)", f"({_K} * 2 + 2)", f"CAST(floor({_K} / 2) AS INT)", f"({_K} * 7 % 30)", f"({_K} * 5 % 40)"]
_SITE_PAGES = {
    "site": "c_custkey % 20", "url": _WEB.format(path=_PATH.format(k=_K)), "status": f"CASE WHEN {_K} % 13 = 6 THEN 404 ELSE 200 END", "bytes": f"CAST(100 + {_K} AS BIGINT)",
    "canonical": f"CASE WHEN {_K} % 11 = 5 THEN {_WEB.format(path=_PATH.format(k=f'({_K} - 1)'))} WHEN {_K} % 11 = 7 THEN 'https://else.example/' END",
}
_MOST, _BYTES, _ROUNDS = 12, 1400, 9


def _round_sql(k: int) -> str:
    """The tables of one round of the crawl: what is read, what has been seen by then, and what comes next."""
    rank = "CASE WHEN regexp_matches(url, 'example/$') THEN 0 WHEN url LIKE '%/products/%' THEN 1 WHEN url LIKE '%/shop/%' THEN 2 WHEN url LIKE '%/about/%' THEN 3 WHEN url LIKE '%/blog/%' THEN 6 ELSE 4 END, seq, url"
    have = "0" if k == 0 else "coalesce(have, 0)"
    spent = "" if k == 0 else f" LEFT JOIN (SELECT site, count(*) FILTER (WHERE NOT twin) AS have, sum(bytes) AS used FROM ({' UNION ALL '.join(f'SELECT site, twin, bytes FROM read{j}' for j in range(k))}) GROUP BY site) USING (site)"
    return f"""h{k} AS (SELECT p.*, seq, (p.same <> p.url AND EXISTS (SELECT 1 FROM seen{k} s WHERE s.site = p.site AND s.url = p.same)) OR row_number() OVER (PARTITION BY p.site, p.same ORDER BY {rank.replace("url", "p.url")}) > 1 AS twin FROM todo{k} t JOIN p ON p.site = t.site AND p.url = t.url),
  n{k} AS (SELECT h{k}.*, {have} + count(*) FILTER (WHERE NOT twin) OVER w AS n, {"0" if k == 0 else "coalesce(used, 0)"} + sum(bytes) OVER w AS total FROM h{k}{spent} WINDOW w AS (PARTITION BY site ORDER BY {rank} ROWS UNBOUNDED PRECEDING)),
  read{k} AS (SELECT * FROM n{k} WHERE n - CASE WHEN twin THEN 0 ELSE 1 END < {_MOST} AND total - bytes < {_BYTES}),
  after{k} AS (SELECT * FROM seen{k} UNION SELECT site, same FROM read{k} WHERE NOT twin),
  next{k} AS (SELECT site, url, min(row(n, i)) AS met FROM (SELECT site, n, unnest(links) AS url, generate_subscripts(links, 1) AS i FROM read{k} WHERE NOT twin) GROUP BY ALL),
  todo{k + 1} AS (SELECT site, url, q AS seq FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY met) AS q FROM next{k} x WHERE NOT EXISTS (SELECT 1 FROM after{k} s WHERE s.site = x.site AND s.url = x.url)) JOIN (SELECT site, count(*) AS held FROM after{k} GROUP BY site) USING (site) WHERE q + held <= {6 * _MOST}),
  seen{k + 1} AS (SELECT * FROM after{k} UNION SELECT site, url FROM todo{k + 1})"""


_LINKS = ", ".join(_WEB.format(path=_PATH.format(k=x)) for x in _LINKED)


@query(f"""WITH p AS (SELECT *, CASE WHEN canonical LIKE '%else%' THEN url ELSE coalesce(canonical, url) END AS same FROM (SELECT {", ".join(f"{e} AS {n}" for n, e in _SITE_PAGES.items())}, [{_LINKS}] AS links FROM customer) WHERE status = 200),
  todo0 AS (SELECT DISTINCT c_custkey % 20 AS site, 'https://w' || c_custkey % 20 || '.example/' AS url, 0 AS seq FROM customer), seen0 AS (SELECT site, url FROM todo0),
  {", ".join(map(_round_sql, range(_ROUNDS)))}
  {" UNION ALL ".join(f"SELECT site, url, {k} AS round, n::BIGINT AS n FROM read{k} WHERE NOT twin" for k in range(_ROUNDS))}""")
def crawl_order(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    pages = rows.selectExpr(*[f"{e} AS {n}" for n, e in _SITE_PAGES.items() if n != "site"], f"array({_LINKS}) AS links")
    starts = rows.selectExpr("c_custkey % 20 AS site", "concat('https://w', c_custkey % 20, '.example/') AS url").distinct()
    return crawl.crawl(pages, starts, _MOST, _BYTES)


#: JSON-LD made from parts: graphs, arrays, records at several depths, one that is too deep, and scripts that do not parse.
_LD = """concat('{"@type":', CASE WHEN p_partkey % 3 = 0 THEN '["Thing","PRODUCT"]' ELSE '"ProductGroup"' END, ',"name":', CASE WHEN p_partkey % 2 = 0 THEN concat('{"@value":" ', p_name, ' "}') ELSE concat('"', p_name, '"') END, CASE p_partkey % 4 WHEN 0 THEN concat(',"brand":["",{"name":"', p_brand, '"}]') WHEN 1 THEN concat(',"brand":{"name":"', p_brand, '"}') WHEN 2 THEN ',"brand":true' ELSE '' END,
  ',"sku":null,"mpn":', p_size, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',"offers":[1,{"lowPrice":12.5,"priceCurrency":"USD"},{"price":1}]' END, '}')"""
_LD_HTML = "CASE CAST(floor(p_partkey / 3) AS INT) % 8 WHEN 0 THEN concat('{\"@context\":\"x\",\"@graph\":[', r, ',{\"@type\":\"Thing\",\"isRelatedTo\":[', r, ']}]}') WHEN 1 THEN concat('[', r, ',', r, ',7]') WHEN 2 THEN concat('{\"@type\":\"WebPage\",\"about\":null,\"mainEntity\":', r, '}') WHEN 3 THEN '{\"@type\":\"Product\",' WHEN 4 THEN concat('{\"a\":{\"b\":{\"c\":{\"d\":{\"e\":', r, '}}}}}') WHEN 5 THEN concat('{\"z\":1,\"a\":[{\"b\":[{\"c\":[', r, ']}]}]}') WHEN 6 THEN concat('{\"a\":[{\"b\":[{\"c\":[{\"d\":', r, '}]}]}]}') ELSE r END"


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS page_id, {_LD_HTML} AS doc FROM (SELECT *, {_LD} AS r FROM part)),
  top AS (SELECT page_id, CASE WHEN json_valid(doc) THEN doc::JSON END AS j FROM p), list_ AS (SELECT page_id, CASE WHEN json_type(j, '$."@graph"') = 'ARRAY' THEN j->'$."@graph"' WHEN json_type(j) = 'ARRAY' THEN j ELSE json_array(j) END AS l FROM top WHERE j IS NOT NULL),
  walk AS (SELECT page_id, i - 1 AS block, []::BIGINT[] AS path, json_extract(l, '$[' || (i - 1) || ']') AS j FROM list_, unnest(range(1, json_array_length(l)::BIGINT + 1)) t(i)
    UNION ALL SELECT page_id, block, list_append(path, k - 1), CASE WHEN json_type(j) = 'OBJECT' THEN json_extract(j, '$."' || list_sort(json_keys(j))[k] || '"') ELSE json_extract(j, '$[' || (k - 1) || ']') END
      FROM walk, unnest(range(1, CASE json_type(j) WHEN 'OBJECT' THEN len(json_keys(j)) WHEN 'ARRAY' THEN json_array_length(j)::BIGINT ELSE 0 END + 1)) t(k) WHERE len(path) < 6)
  SELECT page_id, block, array_to_string(path, '.') AS path, trim(coalesce(j->>'$.name."@value"', j->>'$.name')) AS name, coalesce(j->>'$.brand.name', j->>'$.brand[1].name') AS brand, j->>'$.mpn' AS sku, j->>'$.offers[1].lowPrice' AS price, j->>'$.offers[1].priceCurrency' AS currency
  FROM walk WHERE json_type(j) = 'OBJECT' AND (lower(j->>'$."@type"') = 'productgroup' OR lower(j->>'$."@type"[1]') = 'product')""")
def ld_products(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("r", F.expr(_LD)).selectExpr("p_partkey AS page_id", f"concat('<p></p><script  type=application/LD+json>', {_LD_HTML}, '</script>') AS html")
    got = ld.products(docs)
    return got.select("page_id", F.col("block").cast("long").alias("block"), F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "name", "brand", "sku", "price", "currency")
