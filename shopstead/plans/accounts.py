"""Registered queries over providers, accounts, scans and facts, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import accounts, facts, ledger, providers, scans, schemas, versions
from ..sources.projections import as_sql, project

NOW = "2024-01-20 12:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_LISTED = f"(SELECT *, row_number() OVER (PARTITION BY capability ORDER BY priority DESC, key) AS rank FROM {as_sql('providers')})"


@query(f"SELECT capability, key, CAST(rank AS INT) AS rank FROM {_LISTED}")
def provider_listing(spark, sf_dir):
    return providers.listing(project(spark, sf_dir, "providers")).select("capability", "key", "rank")


def _choice_sql(calls: str) -> str:
    return f"""
  (WITH u AS (SELECT * FROM {_LISTED} WHERE implemented AND configured),
  f AS (SELECT * FROM u WHERE tier = 'LOCAL_FREE' QUALIFY row_number() OVER (PARTITION BY capability ORDER BY rank) = 1),
  np AS (SELECT capability, count(*) AS n FROM u WHERE tier = 'EXTERNAL_PAID' GROUP BY 1),
  s AS (SELECT DISTINCT workspace_id, key FROM {as_sql("provider_settings")} WHERE enabled),
  p AS (SELECT s.workspace_id, u.* FROM u JOIN s USING (key) WHERE tier = 'EXTERNAL_PAID' QUALIFY row_number() OVER (PARTITION BY s.workspace_id, capability ORDER BY rank) = 1),
  c AS (SELECT r.*, f.key AS free_key, p.key AS paid_key, coalesce(np.n, 0) AS n, NOT zero_cost AND coalesce(p.priority >= f.priority, false) AS take
    FROM {calls} r LEFT JOIN f USING (capability) LEFT JOIN np USING (capability) LEFT JOIN p ON p.workspace_id = r.workspace_id AND p.capability = r.capability)
  SELECT *, CASE WHEN free_key IS NULL THEN NULL WHEN take THEN paid_key ELSE free_key END AS provider_key,
    CASE WHEN free_key IS NULL THEN NULL WHEN take THEN 'EXTERNAL_PAID' ELSE 'LOCAL_FREE' END AS tier,
    CASE WHEN free_key IS NULL THEN 'no-free-provider' WHEN zero_cost THEN 'zero-cost-mode' WHEN take THEN 'paid-enabled' WHEN n > 0 THEN 'paid-not-enabled' ELSE 'only-free-available' END AS reason FROM c)"""


def _provider_tables(spark, sf_dir):
    return [project(spark, sf_dir, n) for n in ("provider_calls", "providers", "provider_settings")]


@query(f"SELECT id, provider_key, tier, reason FROM {_choice_sql(as_sql('provider_calls'))}")
def provider_choice(spark, sf_dir):
    return providers.choose(*_provider_tables(spark, sf_dir)).select("id", "provider_key", "tier", "reason")


_ASKED = f"(SELECT DISTINCT workspace_id, capability, false AS zero_cost FROM {as_sql('provider_calls')})"


@query(f"""WITH c AS {_choice_sql(_ASKED)}, s AS (SELECT DISTINCT workspace_id, key FROM {as_sql("provider_settings")} WHERE enabled),
  a AS (SELECT c.workspace_id, c.capability, string_agg(l.key || ':' || l.label || ':' || l.configured || ':' || (s.key IS NOT NULL), ',' ORDER BY l.rank) AS alternatives
    FROM c JOIN {_LISTED} l ON l.capability = c.capability AND l.tier = 'EXTERNAL_PAID' LEFT JOIN s ON s.workspace_id = c.workspace_id AND s.key = l.key GROUP BY ALL)
  SELECT workspace_id, capability, provider_key, reason, alternatives FROM c JOIN a USING (workspace_id, capability)""")
def capability_summary(spark, sf_dir):
    calls, known, settings = _provider_tables(spark, sf_dir)
    asked = calls.select("workspace_id", "capability", F.lit(False).alias("zero_cost")).distinct()
    words = F.transform("alternatives", lambda x: F.concat_ws(":", x["key"], x["label"], x["configured"].cast("string"), x["enabled"].cast("string")))
    return providers.summarise(asked, known, settings).select("workspace_id", "capability", "provider_key", "reason", F.array_join(words, ",").alias("alternatives"))


@query(f"""SELECT key, CASE WHEN tier <> 'EXTERNAL_PAID' THEN 'not-paid' WHEN NOT implemented THEN 'not-implemented' WHEN NOT configured THEN 'no-credentials' END AS reason,
  CASE WHEN tier <> 'EXTERNAL_PAID' THEN 'not-paid' WHEN NOT implemented THEN 'not-implemented' WHEN NOT configured THEN 'no-credentials' ELSE 'no-allowance' END AS reason_without_allowance FROM {as_sql("providers")}""")
def provider_blocks(spark, sf_dir):
    why = lambda daily: providers.why_blocked(F.col("tier"), F.col("implemented"), F.col("configured"), False, daily, daily)
    return project(spark, sf_dir, "providers").select("key", why(500).alias("reason"), why(0).alias("reason_without_allowance"))


@query(f"""WITH c AS (SELECT * FROM {_choice_sql(as_sql("provider_calls"))} WHERE provider_key IS NOT NULL),
  s AS (SELECT workspace_id, coalesce(sum(coalesce(actual_cents, estimated_cents)) FILTER (WHERE created_at >= TIMESTAMP '2024-01-20'), 0) AS d,
    coalesce(sum(coalesce(actual_cents, estimated_cents)) FILTER (WHERE created_at >= TIMESTAMP '2024-01-01'), 0) AS m FROM {as_sql("cost_records")} WHERE tier = 'EXTERNAL_PAID' AND succeeded GROUP BY 1),
  o AS (SELECT workspace_id, key AS provider_key, min(daily_cents) AS pd, min(monthly_cents) AS pm FROM {as_sql("provider_settings")} GROUP BY ALL),
  g AS (SELECT c.*, CASE WHEN tier = 'LOCAL_FREE' OR estimated_cents = 0 THEN NULL WHEN estimated_cents > 9000 THEN 'single-call-ceiling'
    WHEN coalesce(d, 0) + estimated_cents > least(30000, coalesce(pd, 30000)) THEN 'daily-ceiling' WHEN coalesce(m, 0) + estimated_cents > least(400000, coalesce(pm, 400000)) THEN 'monthly-ceiling' END AS no
    FROM c LEFT JOIN s USING (workspace_id) LEFT JOIN o USING (workspace_id, provider_key)),
  t AS (SELECT *, CASE WHEN no IS NULL THEN provider_key ELSE free_key END AS used, CASE WHEN no IS NULL THEN tier ELSE 'LOCAL_FREE' END AS used_tier FROM g)
  SELECT id, used AS provider_key, used_tier AS tier, no AS fell_back_because, CASE WHEN used_tier = 'EXTERNAL_PAID' THEN estimated_cents ELSE 0 END AS estimated_cents,
    CASE WHEN used_tier = 'LOCAL_FREE' THEN 0 WHEN succeeded THEN estimated_cents END AS actual_cents FROM t""")
def guarded_calls(spark, sf_dir):
    spend = ledger.spend_to_date(project(spark, sf_dir, "cost_records"), F.lit(NOW).cast("timestamp_ntz"))
    done = providers.guarded(*_provider_tables(spark, sf_dir), spend, 9_000, 30_000, 400_000)
    return done.select("id", "provider_key", "tier", "fell_back_because", "estimated_cents", "actual_cents")


_PRICES = [("small", 100, 500, 1), ("small-ring", 200, 1000, 2), ("large-pipe-economy", 900, 4500, 3), ("large", 300, 1500, 4)]
_VALUES = ", ".join(map(str, _PRICES))


@query(f"""WITH m AS (SELECT p_partkey AS id, replace(lower(p_name || ' ' || p_type), ' ', '-') AS model FROM part), f(family, i, o, seq) AS (VALUES {_VALUES}),
  j AS (SELECT id, i, o, row_number() OVER (PARTITION BY id ORDER BY family <> model, seq) AS k FROM m JOIN f ON model = family OR starts_with(model, family || '-'))
  SELECT m.id, model, i AS input_cents, o AS output_cents FROM m LEFT JOIN j ON j.id = m.id AND k = 1""")
def model_prices(spark, sf_dir):
    models = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "replace(lower(concat_ws(' ', p_name, p_type)), ' ', '-') AS model")
    prices = spark.createDataFrame(_PRICES, "family string, input_cents int, output_cents int, seq int")
    return providers.priced(models, prices).select("id", "model", "input_cents", "output_cents")


@query("SELECT p_partkey AS id, CAST(ceil((length(p_name) + 5 + length(p_type) + 5 + length(p_brand)) * 1.2::DOUBLE) AS BIGINT) AS chars FROM part")
def prompt_lengths(spark, sf_dir):
    data = F.create_map(F.lit("about"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), providers.prompt_length(F.col("p_name"), data).alias("chars"))


@query(f"SELECT id FROM {as_sql('access_requests')} r WHERE EXISTS (SELECT 1 FROM {as_sql('memberships')} m WHERE m.user_id = r.user_id AND m.workspace_id = r.workspace_id AND role IN ('ADMIN', 'OWNER'))")
def admin_requests(spark, sf_dir):
    return accounts.allowed(project(spark, sf_dir, "access_requests"), project(spark, sf_dir, "memberships"), "ADMIN").select("id")


@query(f"SELECT id, user_id, workspace_id FROM {as_sql('access_requests')} r WHERE NOT EXISTS (SELECT 1 FROM {as_sql('memberships')} m WHERE m.user_id = r.user_id AND m.workspace_id = r.workspace_id)")
def requests_not_found(spark, sf_dir):
    return accounts.not_found(project(spark, sf_dir, "access_requests"), project(spark, sf_dir, "memberships")).select("id", "user_id", "workspace_id")


_LIVE = f"TIMESTAMP '{NOW}'"


@query(f"SELECT s.id, u.c_name AS name, m.workspace_id, m.role FROM {as_sql('sessions')} s JOIN customer u ON u.c_custkey = s.user_id JOIN {as_sql('memberships')} m ON m.user_id = s.user_id WHERE s.expires_at > {_LIVE}")
def live_sessions(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS user_id", "c_name AS name")
    found = accounts.live_sessions(project(spark, sf_dir, "sessions"), users, project(spark, sf_dir, "memberships"), F.lit(NOW).cast("timestamp_ntz"))
    return found.select("id", "name", "workspace_id", "role")


@query(f"SELECT id, expires_at FROM {as_sql('sessions')} WHERE expires_at <= {_LIVE}")
def sessions_to_purge(spark, sf_dir):
    return accounts.expired(project(spark, sf_dir, "sessions"), F.lit(NOW).cast("timestamp_ntz")).select("id", "expires_at")


@query(f"SELECT o.id, o.business_id FROM {as_sql('offers')} o WHERE NOT EXISTS (SELECT 1 FROM {as_sql('businesses')} b WHERE b.id = o.business_id AND b.workspace_id = o.id % 40)")
def foreign_offers(spark, sf_dir):
    rows = project(spark, sf_dir, "offers").select("id", "business_id", (F.col("id") % 40).alias("workspace_id"))
    return accounts.foreign(rows, project(spark, sf_dir, "businesses")).select("id", "business_id")


_BUSINESSES = f"(SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id) AS rank FROM {as_sql('businesses')} WHERE archived_at IS NULL)"


@query(f"SELECT workspace_id, id, CAST(rank AS INT) AS rank FROM {_BUSINESSES}")
def business_listing(spark, sf_dir):
    return accounts.listed(project(spark, sf_dir, "businesses")).select("workspace_id", "id", "rank")


@query(f"""WITH r AS (SELECT id, workspace_id, user_id AS requested FROM {as_sql("access_requests")}), b AS {_BUSINESSES}
  SELECT r.id, coalesce(h.id, f.id) AS business_id FROM r LEFT JOIN b h ON h.workspace_id = r.workspace_id AND h.id = r.requested LEFT JOIN b f ON f.workspace_id = r.workspace_id AND f.rank = 1""")
def active_businesses(spark, sf_dir):
    asked = project(spark, sf_dir, "access_requests").select("id", "workspace_id", F.col("user_id").alias("requested"))
    return accounts.active(asked, project(spark, sf_dir, "businesses")).select("id", "business_id")


@query(f"""SELECT id, CASE WHEN goal IS NULL THEN 'goal' WHEN budget_amount_cents IS NULL OR budget_period IS NULL THEN 'budget' ELSE 'done' END AS step,
  CASE goal WHEN 'SALES' THEN 'OUTCOME_SALES' WHEN 'LEADS' THEN 'OUTCOME_LEADS' WHEN 'CUSTOMERS' THEN 'OUTCOME_TRAFFIC' WHEN 'AWARENESS' THEN 'OUTCOME_AWARENESS' END AS objective,
  archived_at IS NULL OR id % 2 = 0 AS may_scan FROM {as_sql("businesses")}""")
def onboarding_steps(spark, sf_dir):
    c = F.col
    step = accounts.onboarding_step(c("goal"), c("budget_amount_cents"), c("budget_period"))
    return project(spark, sf_dir, "businesses").select("id", step.alias("step"), accounts.objective(c("goal")).alias("objective"), accounts.may_scan(c("archived_at"), c("id") % 2 == 0).alias("may_scan"))


_PLAIN = r"regexp_replace(regexp_replace(strip_accents({x}).lower(), '[''’ʼ`]', '', 'g'), '[^a-z0-9]+', '-', 'g').trim('-')"


@query(rf"SELECT id, rtrim({_PLAIN.format(x='name')}[1:60], '-') AS slug FROM (SELECT p_partkey AS id, ' Café ' || p_name || '’s — ' || p_type || repeat(' Über', CAST(p_size % 14 AS INT)) AS name FROM part)")
def slugs(spark, sf_dir):
    name = F.expr("concat(' Café ', p_name, '’s — ', p_type, repeat(' Über', CAST(p_size % 14 AS INT)))")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), accounts.slugify(name).alias("slug"))


@query(r"""WITH n AS (SELECT p_partkey AS seq, replace(lower(p_brand), '#', '-') || '-' || p_size AS base FROM part),
  k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS k FROM n), b AS (SELECT DISTINCT base FROM n),
  c AS (SELECT base, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS slug, i FROM b, range(1, 26) r(i)),
  f AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM c WHERE slug NOT IN (SELECT replace(lower(p_brand), '#', '-') || '-7' FROM part))
  SELECT seq, slug FROM k LEFT JOIN f USING (base, k)""")
def unique_slugs(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    new = part.selectExpr("p_partkey AS seq", "concat(p_brand, ' ', p_size) AS name")
    taken = part.selectExpr("concat(replace(lower(p_brand), '#', '-'), '-7') AS slug").distinct()
    return accounts.unique_slugs(new, taken).select("seq", "slug")


@query(f"""WITH p AS (SELECT id, cost_cents FROM {as_sql("products")}), e AS (SELECT id, CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN repeat('x', 2001) ELSE ' new words ' END AS d, CASE WHEN id % 5 = 0 THEN -1 ELSE id END AS c, id % 3 = 0 AS hd, id % 2 = 0 AS hc FROM p WHERE id % 7 <> 0),
  j AS (SELECT p.id, 'old' AS old, p.cost_cents, trim(d) AS d, c, hd, hc, CASE WHEN hd AND length(trim(d)) > 2000 THEN 'description-too-long' WHEN hc AND c < 0 THEN 'unusable-cost' END AS error FROM p LEFT JOIN e USING (id))
  SELECT id, CASE WHEN error IS NULL AND hd THEN nullif(d, '') ELSE old END AS owner_description, CASE WHEN error IS NULL AND hc THEN c ELSE cost_cents END AS cost_cents, error FROM j""")
def owner_edits(spark, sf_dir):
    rows = project(spark, sf_dir, "products").select("id", "cost_cents", F.lit("old").alias("owner_description"), F.lit(None).cast("timestamp_ntz").alias("owner_described_at"))
    edits = rows.where("id % 7 <> 0").selectExpr("id", "CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN repeat('x', 2001) ELSE ' new words ' END AS description", "CASE WHEN id % 5 = 0 THEN -1 ELSE id END AS cost_cents", "id % 3 = 0 AS has_description", "id % 2 = 0 AS has_cost")
    return accounts.owner_edits(rows, edits, F.lit(NOW).cast("timestamp_ntz")).select("id", "owner_description", "cost_cents", "error")


_SCANS = f"(SELECT DISTINCT * FROM {as_sql('scans')})"
_BEFORE, _AFTER = (f"(SELECT * FROM {as_sql(n)} WHERE absent = 0)" for n in ("scan_before", "scan_after"))
_HASH = "concat_ws(chr(0), coalesce({t}.name, ''), coalesce({t}.description, ''), coalesce(CAST({t}.price_cents AS VARCHAR), ''), coalesce(CAST({t}.compare_price_cents AS VARCHAR), ''), coalesce({t}.currency, ''), coalesce({t}.availability, ''), coalesce({t}.sku, ''))"


@query(f"""WITH d AS (SELECT coalesce(n.website_id, o.website_id) AS website_id, coalesce(n.product_url, o.product_url) AS u, coalesce(n.name, o.name) AS name, n.availability AS a,
    o.product_url IS NULL AS fresh, n.product_url IS NULL AS gone, {_HASH.format(t="o")} <> {_HASH.format(t="n")} AS differs, o.price_cents IS DISTINCT FROM n.price_cents AS price, o.availability IS DISTINCT FROM n.availability AS avail
    FROM {_BEFORE} o FULL JOIN {_AFTER} n ON o.website_id = n.website_id AND o.product_url = n.product_url),
  c AS (SELECT website_id, u, name, a, 'price' AS class FROM d WHERE NOT fresh AND NOT gone AND differs AND price UNION ALL SELECT website_id, u, name, a, 'availability' FROM d WHERE NOT fresh AND NOT gone AND differs AND avail
    UNION ALL SELECT website_id, u, name, a, 'removed' FROM d WHERE gone UNION ALL SELECT website_id, u, name, a, 'new' FROM d WHERE fresh),
  s AS {_SCANS}, l AS (SELECT c.*, host, row_number() OVER (PARTITION BY website_id, class ORDER BY u) AS seq FROM c JOIN s USING (website_id) WHERE NOT is_first),
  k AS (SELECT website_id, host, count(*) AS n, count(*) FILTER (WHERE class = 'new') AS fresh FROM l GROUP BY ALL)
  SELECT website_id, CASE class WHEN 'price' THEN 'priceChanged' ELSE 'productUnavailable' END AS kind, CAST(seq AS INT) AS seq,
    CASE class WHEN 'price' THEN 'Price changed for ' || name || '. Advertising materials will be updated.' WHEN 'availability' THEN name || ' is out of stock. It will not be advertised until it is back.' ELSE name || ' is no longer on the website.' END AS message,
    class <> 'price' AS needs_attention FROM l WHERE class <> 'new' AND seq <= 5 AND (class <> 'availability' OR a = 'OUT_OF_STOCK')
  UNION ALL SELECT website_id, 'productsFound', 1, fresh || CASE WHEN fresh = 1 THEN ' new product' ELSE ' new products' END || ' appeared on ' || host || '.', false FROM k WHERE fresh > 0
  UNION ALL SELECT website_id, 'websiteScanned', 1, 'Checked ' || host || '. Nothing has changed.', false FROM s WHERE NOT is_first AND website_id NOT IN (SELECT website_id FROM k)
  UNION ALL SELECT website_id, 'productsFound', 1, 'Read ' || pages || CASE WHEN pages = 1 THEN ' page of ' ELSE ' pages of ' END || host || '. ' || CASE products WHEN 0 THEN 'No products were found on it.' WHEN 1 THEN 'Found 1 product.' ELSE 'Found ' || products || ' products.' END, products = 0 FROM s WHERE is_first""")
def scan_feed(spark, sf_dir):
    before, after = (project(spark, sf_dir, n).where("absent = 0").drop("absent") for n in ("scan_before", "scan_after"))
    done = project(spark, sf_dir, "scans").distinct()
    return scans.feed_rows(done, versions.compare(before, after)).drop("class")


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'crawling' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' ELSE 'done' END AS phase,
  CASE event_id % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'CANCELLED' ELSE 'PARTIAL' END AS outcome FROM events""")
def scan_phases(spark, sf_dir):
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("QUEUED", "RUNNING", "FAILED", "CANCELLED", "COMPLETED", "PARTIAL"))), (k % 6 + 1).cast("int"))
    stop = F.element_at(F.array(*map(F.lit, ("completed", "cancelled", "page-limit", "time-limit"))), (k % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(k.alias("id"), scans.phase(status).alias("phase"), scans.outcome(stop).alias("outcome"))


_CODES = (401, 403, 404, 429, 500, 502, 503, 504, 418, 301)


@query("""WITH w AS (SELECT user_id AS scan_id, event_id AS n, [401, 403, 404, 429, 500, 502, 503, 504, 418, 301][event_id % 10 + 1] AS code, event_id % 3 = 0 AS plain FROM events)
  SELECT scan_id, min_by(code, n) AS status, CASE min_by(code, n) WHEN 429 THEN 'slow-down' ELSE 'refused' END AS class FROM w WHERE NOT plain AND code IN (401, 403, 429) GROUP BY 1""")
def blocked_scans(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 10 + 1).cast("int"))
    reason = F.when(F.col("event_id") % 3 == 0, "not-html").otherwise(F.concat(F.lit("http-"), code.cast("string")))
    warnings = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("n"), reason.alias("reason"))
    return scans.first_blocked(warnings).withColumn("class", scans.http_class(F.col("status")))


@query(f"""SELECT b.id AS business_id, (SELECT count(*) FROM {as_sql("products")} t WHERE t.business_id = b.id) AS products, (SELECT count(*) FROM {as_sql("websites")} t WHERE t.business_id = b.id) AS websites,
  (SELECT count(*) FROM {as_sql("offers")} t WHERE t.business_id = b.id) AS offers, (SELECT count(*) FROM {as_sql("inferences")} t WHERE t.business_id = b.id) AS inferences FROM {as_sql("businesses")} b""")
def discarded_knowledge(spark, sf_dir):
    owners = project(spark, sf_dir, "businesses").select(F.col("id").alias("business_id"))
    return scans.discarded(owners, {n: project(spark, sf_dir, n) for n in ("products", "websites", "offers", "inferences")})


_PRODUCT_FACTS = f"(SELECT seq, owner_id * 13 AS product_id, key, value FROM {as_sql('facts')})"


def _product_facts(spark, sf_dir):
    return project(spark, sf_dir, "facts").select("seq", (F.col("owner_id") * 13).alias("product_id"), "key", "value")


@query(f"""SELECT business_id, count(*) AS facts FROM (SELECT owner_id AS business_id FROM {as_sql("facts")} UNION ALL SELECT business_id FROM {_PRODUCT_FACTS} f JOIN {as_sql("products")} p ON p.id = f.product_id) GROUP BY 1""")
def fact_totals(spark, sf_dir):
    return scans.fact_totals(project(spark, sf_dir, "facts").select(F.col("owner_id").alias("business_id")), _product_facts(spark, sf_dir), project(spark, sf_dir, "products"))


@query(f"SELECT seq, product_id, key, value FROM {_PRODUCT_FACTS} WHERE product_id IN (SELECT id FROM {as_sql('products')} WHERE business_id IN (SELECT id FROM {_BUSINESSES}))")
def facts_of_businesses(spark, sf_dir):
    own = accounts.listed(project(spark, sf_dir, "businesses")).select(F.col("id").alias("business_id"))
    return scans.facts_of_businesses(_product_facts(spark, sf_dir), project(spark, sf_dir, "products"), own)


_TYPE = "list_position(['HOME', 'PRODUCT', 'COLLECTION', 'ABOUT', 'FAQ', 'SHIPPING', 'RETURNS', 'CONTACT', 'POLICY', 'BLOG', 'OTHER'], page_type)"


@query(f"""WITH w AS (SELECT business_id, id AS website_id FROM {as_sql("websites")} QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY created_at DESC, id) = 1),
  p AS (SELECT website_id, url, row_number() OVER (PARTITION BY website_id ORDER BY {_TYPE}, fetched_at DESC, id) AS n FROM {as_sql("site_pages")}),
  g AS (SELECT website_id, page_type, count(*) AS k FROM {as_sql("site_pages")} GROUP BY ALL), t AS (SELECT website_id, string_agg(page_type || '=' || k, ',' ORDER BY page_type) AS types FROM g GROUP BY 1),
  l AS (SELECT website_id, md5(string_agg(url, ' ' ORDER BY n)) AS pages_md5 FROM p WHERE n <= 200 GROUP BY 1),
  s AS (SELECT id, business_id, name, row_number() OVER (PARTITION BY business_id ORDER BY id * 37 % 1013 DESC, id) AS n FROM {as_sql("products")} WHERE availability <> 'OUT_OF_STOCK'),
  i AS (SELECT product_id, source_url FROM {as_sql("product_images")} QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY position, source_url) = 1),
  v AS (SELECT l_partkey AS id, count(*) AS k FROM lineitem WHERE l_linenumber < 3 GROUP BY 1),
  r AS (SELECT business_id, md5(string_agg(name || '|' || coalesce(source_url, '') || '|' || coalesce(k, 0), ' ' ORDER BY n)) AS products_md5 FROM s LEFT JOIN i ON i.product_id = s.id LEFT JOIN v USING (id) WHERE n <= 100 GROUP BY 1),
  f AS (SELECT owner_id AS business_id, key || '=' || value AS v, row_number() OVER (PARTITION BY owner_id ORDER BY confidence DESC, key, seq) AS n FROM {as_sql("facts")}), h AS (SELECT business_id, md5(string_agg(v, ' ' ORDER BY n)) AS facts_md5 FROM f WHERE n <= 100 GROUP BY 1),
  a AS (SELECT business_id, count(*) AS n_facts FROM (SELECT owner_id AS business_id FROM {as_sql("facts")} UNION ALL SELECT q.business_id FROM {_PRODUCT_FACTS} x JOIN {as_sql("products")} q ON q.id = x.product_id) GROUP BY 1)
  SELECT business_id, website_id, types, pages_md5, products_md5, facts_md5, coalesce(n_facts, 0) AS n_facts FROM w LEFT JOIN a USING (business_id) LEFT JOIN l USING (website_id) LEFT JOIN t USING (website_id) LEFT JOIN r USING (business_id) LEFT JOIN h USING (business_id)""")
def website_knowledge(spark, sf_dir):
    products = project(spark, sf_dir, "products")
    sold = products.select("id", "name", "business_id", F.expr("id * 37 % 1013").alias("last_seen_at"), F.when(F.col("availability") == "OUT_OF_STOCK", 1).alias("removed_at"))
    said = project(spark, sf_dir, "facts").withColumnRenamed("owner_id", "business_id")
    versions = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber < 3").select(F.col("l_partkey").alias("product_id"))
    totals = scans.fact_totals(said, _product_facts(spark, sf_dir), products)
    known = scans.knowledge(project(spark, sf_dir, "websites"), project(spark, sf_dir, "site_pages"), sold, said, project(spark, sf_dir, "product_images"), versions, totals)
    words = lambda rows, f: F.md5(F.array_join(F.transform(rows, f), " "))
    types = F.array_join(F.transform(F.map_entries("page_types"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return known.select("business_id", "website_id", types.alias("types"), words("pages", lambda x: x["url"]).alias("pages_md5"), words("products", lambda x: F.concat_ws("|", x["name"], F.coalesce(x["image"], F.lit("")), x["n_versions"].cast("string"))).alias("products_md5"), words("facts", lambda x: F.concat_ws("=", x["key"], x["value"])).alias("facts_md5"), "n_facts")


@query(f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY list_position(['LOW', 'MEDIUM', 'HIGH'], uncertainty), created_at DESC, id) AS n FROM {as_sql("inferences")}),
  s AS (SELECT business_id, string_agg(statement, ';' ORDER BY n) AS statements FROM i WHERE n <= 20 GROUP BY 1),
  d AS (SELECT business_id, arg_max(id, (created_at, id)) AS decision_id FROM {as_sql("inferences")} WHERE id % 5 = 0 GROUP BY 1)
  SELECT b.id AS business_id, statements, decision_id FROM {as_sql("businesses")} b LEFT JOIN s ON s.business_id = b.id LEFT JOIN d ON d.business_id = b.id""")
def current_analysis(spark, sf_dir):
    said = project(spark, sf_dir, "inferences")
    made = said.withColumn("kind", F.when(F.col("id") % 5 == 0, "business.analyse").otherwise("copy.generate"))
    owners = project(spark, sf_dir, "businesses").select(F.col("id").alias("business_id"))
    return scans.current_analysis(owners, said, made).select("business_id", F.array_join("statements", ";").alias("statements"), "decision_id")


@query(f"""WITH p AS (SELECT *, format('{{:.2f}}', price_cents / 100.0::DOUBLE) || ' USD' AS price FROM {as_sql("products")})
  SELECT id AS product_id, 'product.name' AS key, name AS value, 'JSON_LD' AS method, 0.95::DOUBLE AS confidence FROM p UNION ALL SELECT id, 'product.brand', brand, 'JSON_LD', 0.95 FROM p UNION ALL SELECT id, 'product.availability', availability, 'JSON_LD', 0.95 FROM p
  UNION ALL SELECT id, 'product.price', price, 'JSON_LD', 0.95 FROM p WHERE price IS NOT NULL UNION ALL SELECT id, 'offer.percent-off', 'save ' || id % 50 || '%', 'TEXT_PATTERN', 0.6 FROM p WHERE id % 4 = 0 UNION ALL SELECT id, 'cta', 'Buy now', 'HTML', 0.7 FROM p WHERE id % 3 = 0""")
def product_fact_rows(spark, sf_dir):
    none = F.lit(None).cast("string")
    stated = F.when(F.col("id") % 4 == 0, F.array(F.struct(F.lit("percent-off").alias("kind"), F.concat(F.lit("save "), (F.col("id") % 50).cast("string"), F.lit("%")).alias("source_text"))))
    rows = project(spark, sf_dir, "products").withColumns({"description": F.lit(" "), "sku": none, "category": none, "method": F.lit("JSON_LD"), "confidence": F.lit(0.95), "stated_offers": stated, "calls": F.when(F.col("id") % 3 == 0, F.array(F.lit("Buy now")))})
    return facts.product_facts(rows)


@query(f"""WITH g AS (SELECT website_id AS owner_id, id AS seq, CASE page_type WHEN 'SHIPPING' THEN 'policy.shipping_url' WHEN 'RETURNS' THEN 'policy.returns_url' WHEN 'FAQ' THEN 'policy.faq_url' WHEN 'CONTACT' THEN 'page.contact_url' WHEN 'ABOUT' THEN 'page.about_url' END AS key,
    url AS value, url AS source_url, 'HTML' AS method, 0.75::DOUBLE AS confidence FROM {as_sql("site_pages")}),
  c AS (SELECT owner_id, seq, key, value, source_url, method, confidence FROM {as_sql("facts")} UNION ALL SELECT * FROM g WHERE key IS NOT NULL),
  b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY owner_id, key ORDER BY confidence DESC, seq) = 1),
  v AS (SELECT owner_id, 'https://social.example/' || value AS value, min(seq) AS seq FROM {as_sql("facts")} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY seq, value) AS n FROM v)
  SELECT owner_id, key, value, source_url, method, confidence FROM b UNION ALL SELECT owner_id, 'social.profile', value, '/', 'HTML', 0.8 FROM r WHERE n <= 10""")
def business_fact_rows(spark, sf_dir):
    said = project(spark, sf_dir, "facts")
    places = project(spark, sf_dir, "site_pages").select(F.col("website_id").alias("owner_id"), F.col("id").alias("seq"), "url", "page_type")
    profiles = said.select("owner_id", "seq", F.concat(F.lit("https://social.example/"), "value").alias("value"), F.lit("/").alias("source_url"))
    return facts.business_facts(said, places, profiles)


@query("""WITH i AS (SELECT l_orderkey AS product_id, l_linenumber AS n, 'https://img.example/' || l_partkey AS url FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n, url) - 1 AS k FROM i)
  SELECT product_id, CAST(k AS INT) AS position, url, k = 0 AS is_primary FROM r WHERE k < 3""")
def image_positions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", F.concat(F.lit("https://img.example/"), "l_partkey").alias("url")).alias("image"))
    return facts.positioned(rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("image")), lambda x: x["url"]).alias("images")), 3)


@query("""WITH l AS (SELECT user_id AS owner_id, event_id AS seq, unnest(['a' || event_id % 17, 'b' || event_id % 5]) AS value, unnest([0, 1]) AS i FROM events), f AS (SELECT owner_id, value, min((seq, i)) AS place FROM l GROUP BY ALL)
  SELECT owner_id, string_agg(value, ',' ORDER BY place) AS links FROM f GROUP BY 1""")
def site_links(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS owner_id", "event_id AS seq", "array(concat('a', event_id % 17), concat('b', event_id % 5)) AS links")
    return facts.ordered_union(rows, "owner_id", "links").select("owner_id", F.array_join("values", ",").alias("links"))


_IMAGES = as_sql("product_images")


@query(f"""WITH o AS (SELECT * FROM {_IMAGES} WHERE position % 5 <> 0), n AS (SELECT product_id, source_url, 'seen again' AS alt_text, position + 1 AS position, CASE WHEN position % 2 = 0 THEN width END AS width, CASE WHEN position % 3 = 0 THEN height + 1 END AS height FROM {_IMAGES} WHERE position % 7 <> 0)
  SELECT coalesce(n.product_id, o.product_id) AS product_id, coalesce(n.source_url, o.source_url) AS source_url, coalesce(n.width, o.width) AS width, coalesce(n.height, o.height) AS height,
    CASE WHEN n.product_id IS NOT NULL THEN n.alt_text ELSE o.alt_text END AS alt_text, CASE WHEN n.product_id IS NOT NULL THEN n.position ELSE o.position END AS position FROM o FULL JOIN n ON o.product_id = n.product_id AND o.source_url = n.source_url""")
def image_sizes(spark, sf_dir):
    images = project(spark, sf_dir, "product_images")
    new = images.where("position % 7 <> 0").selectExpr("product_id", "source_url", "'seen again' AS alt_text", "position + 1 AS position", "CASE WHEN position % 2 = 0 THEN width END AS width", "CASE WHEN position % 3 = 0 THEN height + 1 END AS height")
    return facts.known_sizes(images.where("position % 5 <> 0"), new)


@query(f"""SELECT o.id, p.name AS product_name FROM (SELECT id, CASE WHEN id % 9 <> 0 THEN id % 2500 END AS product_id FROM {as_sql("offers")}) o LEFT JOIN {as_sql("products")} p ON p.id = o.product_id""")
def offer_product_names(spark, sf_dir):
    rows = project(spark, sf_dir, "offers").selectExpr("id", "CASE WHEN id % 9 <> 0 THEN id % 2500 END AS product_id")
    names = project(spark, sf_dir, "products").select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return rows.join(names, "product_id", "left").select("id", "product_name")


@query("""WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'BENEFIT' WHEN 1 THEN 'benefit' WHEN 2 THEN 'GIFT' END AS angle, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS hypothesis, repeat('h', CAST(p_partkey % 7 * 51 AS INT)) AS hook, repeat('c', CAST(p_partkey % 9 * 6 AS INT)) AS cta FROM part)
  SELECT id, concat_ws(',', CASE WHEN coalesce(angle NOT IN ('BENEFIT', 'GIFT'), true) THEN 'angle' END, CASE WHEN trim(hypothesis) = '' THEN 'hypothesis' END, CASE WHEN length(hook) NOT BETWEEN 1 AND 300 THEN 'hook' END,
    CASE WHEN length(cta) NOT BETWEEN 1 AND 40 THEN 'suggested_cta' END, CASE WHEN id % 6 = 0 OR id % 11 > 9 THEN 'assumptions' END) AS wrong FROM p""")
def strategy_violations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN 'BENEFIT' WHEN 1 THEN 'benefit' WHEN 2 THEN 'GIFT' END AS angle", "CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS hypothesis",
        "repeat('h', CAST(p_partkey % 7 * 51 AS INT)) AS hook", "repeat('c', CAST(p_partkey % 9 * 6 AS INT)) AS suggested_cta",
        "CASE WHEN p_partkey % 6 = 0 THEN array('fine', ' ') ELSE array_repeat('said', CAST(p_partkey % 11 + 1 AS INT)) END AS assumptions", "CAST(NULL AS ARRAY<STRING>) AS testing_variables",
    )
    return rows.select("id", F.array_join(schemas.violations("strategy"), ",").alias("wrong"))


@query("""WITH e AS (SELECT event_id AS id, md5('' || event_id) AS h FROM events), u AS (SELECT id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS u FROM e)
  SELECT id, CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN u END AS scan_id, CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN id % 5 = 0 END AS is_rescan FROM u""")
def scan_payloads(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", "md5(CAST(event_id AS STRING)) AS h")
    uuid = F.concat_ws("-", *[F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    scan = F.when(F.col("id") % 3 == 0, "no uuid").otherwise(uuid).alias("scanRunId")
    url = F.when(F.col("id") % 4 == 0, "/no/url").otherwise("https://shop.example/").alias("requestedUrl")
    payload = F.to_json(F.struct(scan, uuid.alias("businessId"), url, F.when(F.col("id") % 5 == 0, True).alias("isRescan")))
    return rows.select("id", schemas.scan_payload(payload).alias("p")).select("id", F.col("p.scanRunId").alias("scan_id"), F.col("p.isRescan").alias("is_rescan"))


@query(r"""WITH RECURSIVE w AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(concat_ws(' ', p_name, p_type, p_brand, p_name), '\s+'), lambda x: x <> '') AS words FROM part),
  r AS (SELECT id, words, 0 AS i, []::VARCHAR[] AS lines, '' AS now FROM w
    UNION ALL SELECT id, words, i + 1, CASE WHEN len(lines) < 3 AND now <> '' AND length(now || ' ' || words[i + 1]) > 14 THEN list_append(lines, now) ELSE lines END,
      CASE WHEN len(lines) >= 3 THEN now WHEN now <> '' AND length(now || ' ' || words[i + 1]) <= 14 THEN now || ' ' || words[i + 1] ELSE words[i + 1] END FROM r WHERE i < len(words)),
  f AS (SELECT id, words, CASE WHEN now <> '' AND len(lines) < 3 THEN list_append(lines, now) ELSE lines END AS lines FROM r WHERE i = len(words))
  SELECT id, CASE WHEN len(lines) = 3 AND length(array_to_string(words, ' ')) > length(array_to_string(lines, ' ')) THEN lines[1] || '|' || lines[2] || '|' || lines[3][1:13] || '…' ELSE array_to_string(lines, '|') END AS lines FROM f""")
def card_lines(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "concat_ws(' ', p_name, p_type, p_brand, p_name) AS name")
    return rows.select("id", F.array_join(text.wrapped(F.col("name"), 14, 3), "|").alias("lines"))
