"""Operators on small tables, and pages of the usual shapes."""

import datetime as dt
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from shopstead import streaming
from shopstead.operators import claims, crawl, evidence, extract, facts, generate, jobs, ledger, limits, offers, versions
from shopstead.sources import tables

P = "id long, business_id int, name string, price_cents long, cost_cents long, compare_price_cents long, availability string"


def test_offer_guards(spark):
    rows = [(1, 1, "a", 1999, None, None, "IN_STOCK"), (2, 1, "b", 1999, None, None, "OUT_OF_STOCK"), (3, 1, "c", None, None, None, "IN_STOCK"), (4, 1, "d", 1000, 980, None, "IN_STOCK"), (5, 1, "e", 1000, None, 1200, "IN_STOCK"), (6, 2, "f", 1000, 900, None, "IN_STOCK"), (7, 2, "g", 0, None, None, "IN_STOCK")]
    rules = spark.createDataFrame([(2, 10, False)], "business_id int, min_margin_percent int, allow_free_shipping boolean")
    got = {r.id: r for r in offers.propose(spark.createDataFrame(rows, P), rules).collect()}
    assert (got[1].type, got[1].value, got[1].resulting_price_cents, got[1].margin_known) == ("PERCENT_OFF", 5, 1900, False)
    assert got[2].reason == "it is out of stock" and got[3].type == "FREE_SHIPPING" and got[3].resulting_price_cents is None
    assert got[4].reason == "the discount would sell it at a loss" and got[5].reason == "it is already on sale"
    assert got[6].reason == "it would leave less than your 10% minimum margin" and got[7].reason == "its page states no price"


def test_claims(spark):
    df = spark.createDataFrame([("h", "Now $19.60, only $21! 20% off, 30% off", "the best, rated 4.8 stars", "hurry", [2000], [20], "THE BEST", ["Rated "])], "headline string, primary_text string, description string, cta string, stated_price_cents array<long>, allowed_percents array<int>, verified_text string, restrictions array<string>")
    got = [(v.rule, v.excerpt) for v in claims.check(df).first().violations]
    assert ("unstated-price", "$21") in got and ("unstated-price", "$19.60") not in got and ("unsupported-discount", "30% off") in got
    assert ("unsubstantiated-superlative", "best") not in got and ("manufactured-urgency", "hurry") in got and ("merchant-restriction", "Rated ") in got
    assert [r for r, _ in got].count("unverifiable-statistic") == 3


def test_ledger_and_jobs(spark):
    t = dt.datetime(2024, 1, 20, 12)
    costs = spark.createDataFrame([(1, "EXTERNAL_PAID", 100, 40, True, t), (1, "EXTERNAL_PAID", 100, None, True, t.replace(day=3)), (1, "EXTERNAL_PAID", 500, None, False, t), (1, "LOCAL_FREE", 9, 9, True, t)], "workspace_id long, tier string, estimated_cents long, actual_cents long, succeeded boolean, created_at timestamp_ntz")
    now = F.lit("2024-01-20 23:00:00").cast("timestamp_ntz")
    assert tuple(ledger.spend_to_date(costs, now).first()) == (1, 40, 140)
    calls = spark.createDataFrame([(1, "EXTERNAL_PAID", 50), (1, "LOCAL_FREE", 50), (2, "EXTERNAL_PAID", 50), (2, "EXTERNAL_PAID", 80)], "workspace_id long, tier string, estimated_cents long")
    got = sorted((r.workspace_id, r.tier, r.estimated_cents, r.reason) for r in ledger.decide(calls, ledger.spend_to_date(costs, now), 70, 80, 1000).collect())
    assert [g[3] for g in got] == ["daily-ceiling", "free", "within-ceilings", "single-call-ceiling"]
    assert {r.reason for r in ledger.decide(calls, ledger.spend_to_date(costs, now), 0, 0, 0).collect()} == {"free", "zero-cost-mode"}
    q = spark.createDataFrame([(1, "PENDING", 0, t), (2, "PENDING", 5, t), (3, "RUNNING", 9, t), (4, "PENDING", 5, t.replace(day=1)), (5, "PENDING", 9, t.replace(month=5))], "id long, status string, priority int, run_at timestamp_ntz").withColumns({"attempts": F.lit(0), "type": F.lit("x"), "started_at": F.lit(None).cast("timestamp_ntz")})
    assert [r.id for r in jobs.claim(q, now, 2).collect()] == [4, 2]


def test_duplicate_chain_batch_and_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "k" if i % 3 else "m", base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 59, 60, 61, 100, 122, 122, 500, 183])]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    want, last = [], {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() > 60:
            last[k] = t
            want.append(i)
    assert sorted(r.id for r in limits.suppress_duplicates(df, ["key"], 60).collect()) == sorted(want)
    df.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = streaming.drain(streaming.suppress_duplicates(live, "key", 60), "live_dedup", str(tmp_path / "cp"))
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_stream_windows_equal_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, f"k{i % 2}", base + dt.timedelta(minutes=i)) for i in range(300)], "id long, key string, ts timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in streaming.drain(streaming.rate_windows(live, 3600, "0 seconds"), "live_windows", str(tmp_path / "cp")).collect()}
    batch = {(r.key, r.window_start, r.n) for r in df.withColumn("window_start", limits.window_start(F.col("ts"), 3600)).groupBy("key", "window_start").agg(F.count("*").alias("n")).collect()}
    last = max(w for _, w, _ in batch)
    assert {g for g in batch if g[1] < last - 3600} <= got <= batch


def test_open_windows_are_counted(spark, sf):
    from shopstead.plans import catalogue

    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("concat(event_type, ':', user_id) AS key", "ts")
    batch = events.withColumn("window_start", limits.window_start(F.col("ts"), 3600)).groupBy("key", "window_start").agg(F.count("*").alias("n"))
    got = catalogue.stream_rate_windows(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.inputFiles()  # a table in files, not one in the driver's memory


def test_suppression_takes_keys_in_pieces(monkeypatch):
    monkeypatch.setattr(streaming, "RUN", 40)
    monkeypatch.setattr(streaming, "PART", 7)
    rng = random.Random(4)
    every = pd.DataFrame({"id": range(300), "key": "k", "ts": [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(5000)) for _ in range(300)]})
    sizes = []
    for part in streaming._in_time_order(every[i : i + 11] for i in range(0, 300, 11)):
        sizes.append(len(part))
    assert sum(sizes) == 300 and max(sizes) < 150
    got = pd.concat(streaming._in_time_order(every[i : i + 11] for i in range(0, 300, 11)))
    assert got["id"].tolist() == every.sort_values(["ts", "id"])["id"].tolist()


def in_batches(spark, folder, rows, schema, size):
    """A stream of rows, `size` a batch, in the order given."""
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(live, folder):
    """The rows of a drained stream, and the rows of its state after the last batch."""
    live.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = live.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return live.sparkSession.read.schema(live.schema).parquet(f"{folder}/out").collect(), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_suppression_state_is_by_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "BUCKETS", 3)
    rng, base = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([None, *(f"k{j}" for j in range(30))]), base + dt.timedelta(seconds=20 * i + rng.randrange(20))) for i in range(240)]
    want, last = [], {}
    for i, k, t in rows:
        if k not in last or (t - last[k]).total_seconds() > 900:
            last[k] = t
            want.append(i)
    live = in_batches(spark, str(tmp_path / "in"), rows, "id long, key string, ts timestamp_ntz", 80)
    got, state = drained(streaming.suppress_duplicates(live, "key", 900), tmp_path)
    assert sorted(map(tuple, got)) == [rows[i] for i in want] and len(want) < 200
    assert state <= 3


def test_flights_are_kept_by_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "BUCKETS", 3)
    rng, base = random.Random(12), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, rng.choice([None, *(f"k{j}" for j in range(30))]), base + dt.timedelta(seconds=60 * i + rng.randrange(60)), rng.random() < 0.2) for i in range(240)]
    want, flights, lease = [], {}, dt.timedelta(seconds=3000)
    for i, k, t, finished in rows:
        if k in flights and t >= flights[k][1] + lease:
            want.append((flights[k][0], k, flights[k][1] + lease, "lapsed"))
            del flights[k]
        if finished:
            flights.pop(k, None)
        elif k not in flights:
            flights[k] = (i, t)
            want.append((i, k, t, "accepted"))
    mark = rows[-1][2] - dt.timedelta(seconds=600)
    want += [(i, k, t + lease, "lapsed") for k, (i, t) in flights.items() if t + lease < mark]
    live = in_batches(spark, str(tmp_path / "in"), rows, "id long, key string, ts timestamp, finished boolean", 80)
    got, state = drained(streaming.single_flight(live, 3000, "10 minutes").selectExpr("id", "key", "unix_micros(at) AS at", "verdict"), tmp_path)
    assert sorted((x.id, x.key or "", x.at, x.verdict) for x in got) == sorted((i, k or "", (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1), v) for i, k, t, v in want)
    assert {x[3] for x in want} == {"accepted", "lapsed"} and any(t + lease >= mark for _, t in flights.values()) and state <= 9  # flights and timers by key, by time


def test_versions(spark):
    s = "website_id int, product_url string, name string, description string, price_cents long, compare_price_cents long, currency string, availability string, sku string"
    old = spark.createDataFrame([(1, "/a", "A", None, 100, None, "USD", "IN_STOCK", None), (1, "/b", "B", None, 100, None, "USD", "IN_STOCK", None), (1, "/c", "C", None, 1, None, "USD", "IN_STOCK", None)], s)
    new = spark.createDataFrame([(1, "/a", "A", None, 120, None, "USD", "OUT_OF_STOCK", None), (1, "/b", "B", None, 100, None, "EUR", "IN_STOCK", None), (1, "/d", "D", None, 1, None, "USD", "IN_STOCK", None)], s)
    got = {r.product_url: (r.status, r.changed_fields) for r in versions.compare(old, new).collect()}
    assert got == {"/a": ("changed", ["price_cents", "availability"]), "/b": ("changed", []), "/c": ("removed", []), "/d": ("new", [])}
    assert {r.status for r in versions.compare(old, new, completed=False).where("product_url = '/c'").collect()} == {"same"}
    up = versions.upsert(old.select("product_url", "name", "price_cents", "sku"), spark.createDataFrame([("/a", None, None, "s"), ("/z", "Z", 5, None)], "product_url string, name string, price_cents long, sku string"), ["product_url"], keep_known=("price_cents",), keep_old=("name",))
    assert {(r.product_url, r.name, r.price_cents, r.sku) for r in up.collect()} == {("/a", "A", 100, "s"), ("/b", "B", 100, None), ("/c", "C", 1, None), ("/z", "Z", 5, None)}


def test_facts(spark):
    rows = spark.createDataFrame([(2, "o", "k", "late", 0.9), (1, "o", "k", "first", 0.9), (0, "o", "k", "weak", 0.5)], "seq int, owner_id string, key string, value string, confidence double")
    assert facts.arbitrate(rows, ["owner_id", "key"], ["value"]).first().value == "first"
    images = spark.createDataFrame([("p", "https://a", None, None, 1), ("p", "https://b", 900, 900, 2), ("p", "https://c", 100, 900, 3), ("p", "data:x", 900, 900, 4)], "product_id string, source_url string, width int, height int, position int")
    assert [r.source_url for r in facts.worth_showing(images).orderBy("n").collect()] == ["https://b", "https://a"]


def test_robots_sitemap_and_crawl(spark):
    body = "User-agent: shopbot\nUser-agent: other\nDisallow: /admin\nAllow: /admin/public\nDisallow: /*.pdf$\nCrawl-delay: 3\n# c\nUser-agent: *\nDisallow: /\nSitemap: https://a.example/s.xml"
    directives = crawl.parse_robots(spark.createDataFrame([("a", body)], "site string, body string"))
    paths = spark.createDataFrame([("a", p) for p in ("/admin", "/admin/public/x", "/x.pdf", "/x.pdf2", "/")] + [("b", "/")], "site string, path string")
    got = {(r.site, r.path): r.allowed for r in crawl.robots_verdicts(paths, crawl.rules_for(directives, "ShopBot/1.0")).collect()}
    assert got == {("a", "/admin"): False, ("a", "/admin/public/x"): True, ("a", "/x.pdf"): False, ("a", "/x.pdf2"): True, ("a", "/"): True, ("b", "/"): True}
    assert crawl.crawl_delay_ms(directives, "shopbot", 1000).first().delay_ms == 3000
    xml = "<urlset><url><loc>https://a.example/blog/x/</loc></url><url><loc> https://www.a.example/products/y </loc><priority>0.4</priority></url><url><loc>https://else.example/</loc></url>"
    entries = crawl.parse_sitemap(spark.createDataFrame([("a", "https://a.example/", xml)], "site string, base string, xml string"))
    assert [r.url for r in crawl.prioritise(entries).orderBy("rank").collect()] == ["https://www.a.example/products/y", "https://a.example/blog/x"]
    web = {"https://s.example/": ["/p/1", "/blog/a/", "/products/x"], "/products/x": ["/"], "/p/1": ["/deep"], "/deep": [], "/blog/a/": []}
    full = lambda u: u if u.startswith("http") else f"https://s.example{u}"
    pages = spark.createDataFrame([(full(u), [full(x) for x in links], 200) for u, links in web.items()], "url string, links array<string>, status int")
    got = crawl.crawl(pages, spark.createDataFrame([("s", "https://s.example/")], "site string, url string"), 4).orderBy("n").collect()
    assert [(r.url.removeprefix("https://s.example"), r.round) for r in got] == [("/", 0), ("/products/x", 1), ("/p/1", 1), ("/blog/a/", 1)]


def test_crawl_skips_duplicates_and_stops(spark):
    full = lambda u: u and f"https://s.example{u}"
    web = [("/", ["/a", "/b", "/old", "/view", "/twin1", "/twin2", "/gone"], None, None), ("/a", ["/c"], None, None), ("/b", [], None, "/b"), ("/old", ["/lost"], "/a", None), ("/view", ["/lost"], None, "/b"),
           ("/twin1", [], None, "/twin"), ("/twin2", ["/lost"], None, "/twin"), ("/c", ["/twin"], None, "https://else.example/"), ("/twin", [], None, None), ("/lost", [], None, None)]
    rows = [(full(u), [full(x) for x in links], 200, full(final), canon if canon and canon.startswith("http") else full(canon), 100) for u, links, final, canon in web]
    pages = spark.createDataFrame(rows, "url string, links array<string>, status int, final_url string, canonical string, bytes long")
    starts = spark.createDataFrame([("s", full("/"))], "site string, url string")
    taken = lambda *limits: [r.url.removeprefix("https://s.example") for r in crawl.crawl(pages, starts, *limits).orderBy("n").collect()]
    assert taken(50) == ["/", "/a", "/b", "/twin1", "/c"]
    assert taken(3) == ["/", "/a", "/b"]
    assert taken(50, 250) == ["/", "/a", "/b"] and taken(50, 450) == ["/", "/a", "/b"] and taken(50, 501) == ["/", "/a", "/b", "/twin1"]
    assert taken(1) == ["/"] and crawl.crawl(pages, starts.limit(0), 5).count() == 0


def test_crawl_sees_six_addresses_a_page(spark):
    links = [f"https://s.example/{n}" for n in range(20)]
    pages = spark.createDataFrame([("https://s.example/", links, 200), (links[10], [], 200), (links[11], [], 200)], "url string, links array<string>, status int")
    got = crawl.crawl(pages, spark.createDataFrame([("s", "https://s.example/")], "site string, url string"), 2)
    assert [r.url for r in got.orderBy("n").collect()] == ["https://s.example/", links[10]]
    got = crawl.crawl(pages.where(f"url <> '{links[10]}'"), spark.createDataFrame([("s", "https://s.example/")], "site string, url string"), 2)
    assert [r.url for r in got.collect()] == ["https://s.example/"]  # the twelfth link is the thirteenth address


LD = json.dumps({"@graph": [{"@type": "Organization", "name": "Bakehouse", "email": "mailto:hi@b.example", "sameAs": ["https://instagram.com/b"]}, {"@type": "Product", "name": "Starter", "sku": "S1", "offers": {"price": "19.99", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}}]})
SHOP = {
    "https://b.example/products/starter": f'<title>Starter</title><link rel=canonical href="/products/starter"><script type="application/ld+json">{LD}</script><h1>Our starter</h1><s>$24.00</s><img src=/a.jpg alt="a jar of starter"><a href="/about?utm_source=x">Shop now</a><nav>menu</nav>',
    "https://b.example/products/rye": '<meta property="og:type" content="product"><meta property="og:title" content="Rye"><meta property="product:price:amount" content="8,50"><meta property="product:price:currency" content="EUR">Save 20%',
    "https://b.example/products/basket": '<div itemscope itemtype="https://schema.org/Product"><a itemprop="name" href="/x">Basket</a><meta itemprop="price" content="32.00"><meta itemprop="priceCurrency" content="USD"><link itemprop="availability" href="https://schema.org/OutOfStock"></div>',
    "https://b.example/collections/all": "<h1>All</h1>" + "".join(f"<p class=price>${n}.00</p>" for n in range(5, 10)),
    "https://b.example/packs": '<div class=grid>' + "".join(f"<div class=pack><h3>Pack {n}</h3><span>${n}0.00</span><button>Add to bag</button></div>" for n in (1, 2, 3)) + "</div>",
    "https://b.example/posts/prices": '<div class=grid>' + "".join(f"<div class=pack><h3>Pack {n}</h3><span>${n}0.00</span><button>Choose</button></div>" for n in (1, 2, 3)) + "</div>",
    "https://b.example/shop/couche": "<h1>Couche</h1><p class=price_color>£18.50</p>",
    "https://b.example/": "<h1>Home</h1><p class=price>$9.00</p>",
}


def test_extraction(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SHOP.items())] + [(90, "https://b.example/null", None)], "page_id long, url string, html string")
    got = extract.extract(pages)
    rows = {r.url.removeprefix("https://b.example"): r for r in got.collect()}
    first = rows["/products/starter"]
    assert first.page_type == "PRODUCT" and first.links == ["https://b.example/about"] and first.page.canonical == "https://b.example/products/starter" and first.calls_to_action == ["Shop now"] and "menu" not in first.text
    assert rows["/collections/all"].page_type == "COLLECTION" and rows["/collections/all"].is_listing and [o.value for o in rows["/products/rye"].stated_offers] == [20]
    found = sorted((r.url.removeprefix("https://b.example"), r.name, r.price_cents, r.currency, r.availability, r.compare_price_cents) for r in extract.products(got).collect())
    assert found == [
        ("/packs", "Pack 1", 1000, "USD", None, None), ("/packs", "Pack 2", 2000, "USD", None, None), ("/packs", "Pack 3", 3000, "USD", None, None), ("/products/basket", "Basket", 3200, "USD", "OUT_OF_STOCK", None),
        ("/products/rye", "Rye", 850, "EUR", None, None), ("/products/starter", "Starter", 1999, "USD", "IN_STOCK", 2400), ("/shop/couche", "Couche", 1850, "GBP", None, None),
    ]
    said = {r.field: (r.value, r.method) for r in extract.business_facts(got).collect()}
    assert said["name"] == ("Bakehouse", "JSON_LD") and said["email"] == ("hi@b.example", "JSON_LD")


def test_repeated_cards(spark):
    """Cards of one shape, all but one with a name, a price and a control; links elsewhere, carts, other amounts and pages
    that sell nothing are no products."""
    buy = "<button>Add to cart</button>\n"
    card = lambda n, css="", more=buy: f'<li class="tile {css}"><h3>Mug {n}</h3><em>$1{n}.00</em><small class=note>+ $4.99 shipping</small>{more}</li>'
    lazy = '<img src="data:image/gif;base64,x" data-src="/m.jpg" alt="a  mug" width=40 height="auto"><img src=/m.jpg><img src="mailto:x"><button data-sku="M-3">Go</button>'
    pages = {
        "/grid": f"<ul>{card(1)}{card(2, 'wide', '<b id=x></b><input type=submit value=Choose>')}{card(3, '', lazy)}{card(1)}<li class=tile>More soon</li></ul><p>Call us: (02) 5550 1234</p>",
        "/list": f"<ul>{card(1, '', buy + '<a href=/p/1>see</a>')}{card(2, '', buy + '<a href=/p/2>see</a>')}</ul>", "/cart": f"<div id=basket><ul>{card(1)}{card(2)}</ul></div>",
        "/deep": f"<div id=basket>{'<div>' * 12}<ul>{card(1)}{card(2)}</ul></div>", "/silent": f"<ul>{card(1, '', '<button>More</button>')}{card(2, '', '')}</ul>{buy}",
        "/ids": "".join(f'<div class=t id=pot-{n} data-add=p><b>Pot {n}</b><i>$0.00</i><i>${n}.50</i></div>' for n in (1, 2)).join(["<main>", " checkout</main>"]),
        "/two": f"<dl><dt>Jug</dt><dt>$1.00{buy}</dt></dl><ul>{card(4)}{card(5)}</ul><ol>{card(6)}{card(7)}</ol>", "/partly": f"<ul>{card(1)}{card(2)}{card(3, '', '')}{card(4, '', '')}</ul>",
        "/nest": "<p>" * 3000 + f"<ul>{card(8)}{card(9)}</ul>", "/table": f"<ul>{card(1, '', '<button>Choose</button>')}{card(2, '', '<button>Choose</button>')}</ul>",
    }
    got = extract.extract(spark.createDataFrame([(i, f"https://c.example{u}", h) for i, (u, h) in enumerate(pages.items())], "page_id long, url string, html string"))
    rows = extract.products(got).collect()
    found = sorted((r.url.removeprefix("https://c.example"), r.owner, r.name, r.price_cents, r.sku, r.anchor) for r in rows)
    assert found == [
        ("/deep", 0, "Mug 1", 1100, None, "mug-1"), ("/deep", 1, "Mug 2", 1200, None, "mug-2"), ("/grid", 0, "Mug 1", 1100, None, "mug-1"), ("/grid", 1, "Mug 2", 1200, None, "mug-2"), ("/grid", 2, "Mug 3", 1300, "M-3", "m-3"),
        ("/ids", 0, "Pot 1", 150, "p", "pot-1"), ("/ids", 1, "Pot 2", 250, "p", "pot-2"), ("/nest", 0, "Mug 8", 1800, None, "mug-8"), ("/nest", 1, "Mug 9", 1900, None, "mug-9"), ("/two", 0, "Mug 4", 1400, None, "mug-4"), ("/two", 1, "Mug 5", 1500, None, "mug-5"),
    ]
    assert [tuple(i) for r in rows if r.name == "Mug 3" for i in r.images] == [("https://c.example/m.jpg", "a mug", 40, None)]
    assert {(r.value, r.method) for r in extract.business_facts(got).where("field = 'phone'").collect()} == {("(02) 5550 1234", "TEXT_PATTERN")}


def test_declared_products(spark):
    """Several declared products, each for itself; one merges all sources; images of all kinds once each."""
    ld = lambda *nodes: f'<script type="application/ld+json">{json.dumps(list(nodes))}</script>'
    offer = lambda p, **k: {"price": p, "priceCurrency": "eur", **k}
    scope = lambda n, more="": f'<div itemscope itemtype="https://schema.org/Product" {more}><b itemprop=name>{n}</b><i itemprop=price>{n[-1]}.50</i><meta itemprop=priceCurrency content=GBP></div>'
    pages = {
        "/several": ld({"@type": "Product", "name": "A", "sku": "S 1", "offers": [offer("1"), offer("2.50", availability="OutOfStock")]}, {"@type": ["x", "PRODUCT"], "name": "A"}, {"@type": "Product"}),
        "/scopes": scope("Cup 1", 'id="one"') + scope("Cup 2"),
        "/one": ld({"@type": "Product", "name": "B", "image": ["/b1.jpg", {"url": "b2.jpg"}, "ftp://x/y"]}) + '<meta property="og:image" content="/b1.jpg"><meta property="og:price:amount" content="3"><img src="/c.jpg" width="640" height=99999 alt=" "><img data-src="/d.jpg" width="1e3">',
        "/label": "<h1>Tin</h1><p class=price>call</p><b>£7.00</b>", "/id": "<h1>Tin</h1><p id=price>£7.00</p>",
    }
    got = extract.products(extract.extract(spark.createDataFrame([(i, f"https://d.example{u}", h) for i, (u, h) in enumerate(pages.items())], "page_id long, url string, html string")))
    rows = {(r.url.removeprefix("https://d.example"), r.owner): r for r in got.collect()}
    assert {k: (r.name, r.price_cents, r.currency, r.availability, r.anchor) for k, r in rows.items()} == {
        ("/several", 0): ("A", 250, "EUR", "OUT_OF_STOCK", "s-1"), ("/several", 1): ("A", None, None, None, "a"), ("/scopes", 0): ("Cup 1", 150, None, None, "one"), ("/scopes", 1): ("Cup 2", 250, None, None, "cup-2"),
        ("/one", 0): ("B", 300, None, None, None), ("/label", 0): ("Tin", 700, "GBP", None, None),
    }
    assert [tuple(i) for i in rows["/one", 0].images] == [("https://d.example/b1.jpg", None, None, None), ("https://d.example/b2.jpg", None, None, None), ("https://d.example/c.jpg", None, 640, None), ("https://d.example/d.jpg", None, 1, None)]


def test_evidence_and_writer(spark):
    pages = spark.createDataFrame([("o", 1, "x" * 50), ("o", 2, " "), ("o", 3, "y" * 50), ("o", 4, "z" * 50)], "owner string, n int, text string")
    assert [(r.n, len(r.slice)) for r in evidence.budgeted_pages(pages, "owner", "n", 40, 70).orderBy("n").collect()] == [(1, 40), (3, 30)]
    copy = generate.copy_variants(spark.createDataFrame([("Blue Lamp", None), ("Jar", "Made by hand.")], "name string, detail string")).orderBy("name", "n").collect()
    assert [r.primary_text for r in copy] == ["Blue Lamp. See the details and decide for yourself.", "Looking at Blue Lamp? Here is what it is.", "Jar. Made by hand.", "Made by hand. Read more about Jar."]
    long = spark.createDataFrame([("x" * 501, "h", "d", " ")], "primary_text string, headline string, description string, cta string")
    assert long.select(generate.copy_errors(long)).first()[0] == ["primary_text", "cta"]
    sim = generate.insights(spark.createDataFrame([(f"c{i}", 1000, 7) for i in range(50)], "campaign_id string, daily_budget_cents long, days int")).collect()
    assert all(5250 <= r.spend_cents <= 7000 and r.clicks <= r.impressions for r in sim)


def test_tenants_keys_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "business_id int, v string")
    tables.append_table(df, str(tmp_path), "t")
    tables.append_table(df, str(tmp_path), "t")
    back = tables.read_table(spark, str(tmp_path), "t")
    assert [r.v for r in tables.for_tenant(back, 1).collect()] == ["a", "a"] and tables.find_by_key(back, v="b").count() == 1
    log = spark.createDataFrame([({"apiKey": "x", "note": "n" * 2005},)], "m map<string,string>").select(tables.redact(F.col("m")).alias("m")).first().m
    assert log["apiKey"] == "[REDACTED]" and log["note"].endswith("…[truncated 5 chars]")


def wrap(words, chars, lines):
    """The same by a loop."""
    words, out, now = words.split(), [], ""
    for w in words:
        if len((now + " " + w).strip()) <= chars:
            now = (now + " " + w).strip()
            continue
        out += [now] if now else []
        now = w
        if len(out) == lines:
            break
    if now and len(out) < lines:
        out.append(now)
    if len(out) == lines and len(" ".join(words)) > len(" ".join(out)):
        out[-1] = out[-1][: chars - 1] + "…"
    return out


def test_wrapped_and_contained(spark):
    from pyspark.sql import functions as F

    from shopstead.functions import text

    rows = ["", "one", "a b c d e f g", "verylongwordindeed and more words here", " spaced   out  text ", "x " * 40]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(text.wrapped(F.col("t"), 10, 2)).collect()] == [wrap(r, 10, 2) for r in rows]
    block = spark.createDataFrame([("a b", "says T1 loudly")], "l string, t string").select(text.contained(F.col("l"), F.col("t"), F.lit("T1"))).first()[0]
    assert block == '<<<T1 label="a_b">>>\nsays [removed] loudly\n<<<END_T1>>>'
    two = df.select(text.contained(F.lit("x"), F.col("t"))).collect()
    assert len({r[0] for r in two}) == len(rows)


def test_objects(spark, tmp_path):
    from pyspark.sql import functions as F

    from shopstead.sources import tables

    rows = spark.createDataFrame([("a/b.png", b"1", 1), ("c.txt", b"2", 1)], "key string, content binary, at int")
    tables.put_objects(rows, str(tmp_path))
    tables.put_objects(spark.createDataFrame([("c.txt", b"3", 2)], rows.schema), str(tmp_path))
    tables.delete_objects(spark.createDataFrame([("a/b.png", 3), ("none", 3)], "key string, at int"), str(tmp_path))
    assert [(r.key, bytes(r.content)) for r in tables.get_objects(spark, str(tmp_path)).collect()] == [("c.txt", b"3")]
    keys = ["a/b", "/a", "a//b", "../a", "a/../b", "a/.", "a\\b", "a..b/c", "", None]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(tables.safe_key(F.col("k"))).collect()
    assert [bool(r[0]) for r in got] == [True] + [False] * 6 + [True, False, False]


def test_schemas():
    from shopstead.operators import schemas

    shape = schemas.json_schema("strategy")
    assert shape["required"] == ["angle", "hypothesis", "hook", "suggested_cta"] and shape["properties"]["hook"]["maxLength"] == 300
    assert schemas.config_errors([("a", None), (None, None)], 5, 4, 1, 1) == ["pair 0 is set in part", "the daily ceiling is above the campaign's"]


def test_model_price_fallback(spark):
    from shopstead.operators import providers

    prices = spark.createDataFrame([("m", 1, 5, 1), ("m-large", 3, 4, 2)], "family string, input_cents int, output_cents int, seq int")
    models = spark.createDataFrame([("m",), ("m-large",), ("m-large-1",), ("other",), ("mx",)], "model string")
    got = {r.model: (r.input_cents, r.output_cents) for r in providers.priced(models, prices, fallback=True).collect()}
    assert got == {"m": (1, 5), "m-large": (3, 4), "m-large-1": (1, 5), "other": (3, 5), "mx": (3, 5)}
