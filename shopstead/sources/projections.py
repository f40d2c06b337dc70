"""Domain tables projected from the star-schema tables, in expressions that Spark and DuckDB read alike.

The catalogue tables (products, cost records, jobs, ...) are what the operators work on; deployments read them with
`tables.read_table`. These projections derive them deterministically from part, orders, events, lineitem and documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PRICE = "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(round(p_retailprice * 100) AS BIGINT) END"

#: domain table -> (source table, select list)
PROJECTIONS: dict[str, tuple[str, str]] = {
    "products": (
        "part",
        f"""p_partkey AS id, p_name AS name, p_brand AS brand, 'USD' AS currency, {_PRICE} AS price_cents,
        CASE WHEN p_partkey % 3 = 0 THEN CAST(round(p_retailprice * (60 + p_partkey % 45)) AS BIGINT) END AS cost_cents,
        CASE WHEN p_partkey % 7 = 0 THEN {_PRICE} + 500 END AS compare_price_cents,
        CASE WHEN p_partkey % 5 = 0 THEN 'OUT_OF_STOCK' WHEN p_partkey % 5 = 1 THEN 'UNKNOWN' ELSE 'IN_STOCK' END AS availability,
        p_size AS business_id""",
    ),
    "shop_parts": (
        "part",
        """CAST(floor(p_partkey / 6) AS BIGINT) AS page_id, p_partkey AS id, p_partkey % 6 AS nth, CAST(floor(p_partkey / 6) AS BIGINT) % 8 AS kind,
        concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) AS name, p_brand AS brand, p_type AS type,
        CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat(CAST(floor(p_retailprice) AS BIGINT), '.', lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS STRING), 2, '0')) END AS price""",
    ),
    "scan_before": (
        "part",
        f"""p_size AS website_id, concat('/p/', p_partkey) AS product_url, p_name AS name, p_type AS description, {_PRICE} AS price_cents,
        CASE WHEN p_partkey % 7 = 0 THEN {_PRICE} + 500 END AS compare_price_cents, 'USD' AS currency,
        CASE WHEN p_partkey % 5 = 0 THEN 'OUT_OF_STOCK' ELSE 'IN_STOCK' END AS availability, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS sku,
        CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS absent""",
    ),
    "scan_after": (
        "part",
        f"""p_size AS website_id, concat('/p/', p_partkey) AS product_url, CASE WHEN p_partkey % 23 = 0 THEN concat(p_name, ' II') ELSE p_name END AS name,
        p_type AS description, CASE WHEN p_partkey % 6 = 0 THEN {_PRICE} + 100 ELSE {_PRICE} END AS price_cents,
        CASE WHEN p_partkey % 7 = 0 THEN {_PRICE} + 500 END AS compare_price_cents, CASE WHEN p_partkey % 29 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
        CASE WHEN p_partkey % 9 = 0 THEN 'OUT_OF_STOCK' WHEN p_partkey % 5 = 0 THEN 'OUT_OF_STOCK' ELSE 'IN_STOCK' END AS availability,
        CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS sku, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS absent""",
    ),
    "cost_records": (
        "events",
        """event_id AS id, user_id AS workspace_id, event_type AS provider_key,
        CASE WHEN event_id % 3 = 0 THEN 'LOCAL_FREE' ELSE 'EXTERNAL_PAID' END AS tier, CAST(event_id % 7 AS INT) AS units,
        CAST(round(value * 100) AS BIGINT) AS estimated_cents,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) - event_id % 3 END AS actual_cents,
        event_id % 5 <> 0 AS succeeded, ts AS created_at""",
    ),
    "offers": (
        "orders",
        """o_orderkey AS id, o_custkey AS business_id, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'PROPOSED' ELSE 'EXPIRED' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS starts_at,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 365 DAY END AS ends_at""",
    ),
    "jobs": (
        "orders",
        """o_orderkey AS id, o_custkey AS workspace_id, CASE WHEN o_orderkey % 5 = 4 THEN 'ads.sync' ELSE 'website.scan' END AS type,
        CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status,
        5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_orderkey % 4 AS INT) AS attempts, 3 AS max_attempts,
        o_orderdate AS run_at, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS started_at,
        CASE WHEN o_orderkey % 3 = 0 THEN concat('k', o_orderkey % 400) END AS idempotency_key""",
    ),
    "activity": (
        "events",
        """event_id AS id, user_id AS business_id, CASE event_type WHEN 'error' THEN 'needsYourInput' WHEN 'purchase' THEN 'priceChanged'
        WHEN 'signup' THEN 'onboardingCompleted' WHEN 'click' THEN 'productUnavailable' ELSE 'websiteScanned' END AS kind,
        event_type AS message, CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL 1 DAY END AS resolved_at, ts AS created_at""",
    ),
    "rate_events": ("events", "event_id AS id, concat(event_type, ':', user_id) AS key, event_type AS action, ts"),
    "facts": (
        "events",
        """event_id AS seq, user_id AS owner_id, event_type AS key, CAST(event_id % 37 AS STRING) AS value,
        CASE event_id % 5 WHEN 0 THEN 'JSON_LD' WHEN 1 THEN 'MICRODATA' WHEN 2 THEN 'OPENGRAPH' WHEN 3 THEN 'HTML' ELSE 'TEXT_PATTERN' END AS method,
        CASE event_id % 5 WHEN 0 THEN 0.95e0 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.8e0 WHEN 3 THEN 0.7e0 ELSE 0.5e0 END AS confidence,
        concat('/page/', event_id % 11) AS source_url, CASE WHEN event_id % 2 = 0 THEN concat('seen in ', event_id) END AS source_excerpt""",
    ),
    "product_images": (
        "lineitem",
        """l_partkey AS product_id, concat('https://img.example/', l_orderkey, '/', l_linenumber, '.jpg') AS source_url,
        CASE WHEN l_linenumber % 2 = 0 THEN concat('view of ', l_partkey) END AS alt_text,
        CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS INT) * 30 END AS width,
        CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_quantity AS INT) * 24 END AS height, l_orderkey * 8 + l_linenumber AS position""",
    ),
    "providers": (
        "nation",
        """concat('p', n_nationkey) AS key, CAST(n_nationkey % 5 AS INT) AS capability, n_name AS label, CASE WHEN n_nationkey % 3 = 0 THEN 'LOCAL_FREE' ELSE 'EXTERNAL_PAID' END AS tier,
        CAST(n_nationkey * 7 % 10 AS INT) AS priority, n_nationkey % 8 <> 5 AS implemented, n_nationkey % 4 <> 2 AS configured""",
    ),
    "provider_settings": (
        "customer",
        """c_custkey % 150 AS workspace_id, concat('p', CAST(floor(c_custkey / 150) AS INT)) AS key, c_custkey % 3 <> 0 AS enabled,
        CAST(c_custkey % 7 * 5000 AS BIGINT) AS daily_cents, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 11 * 20000 AS BIGINT) END AS monthly_cents""",
    ),
    "provider_calls": (
        "events",
        """event_id AS id, user_id AS workspace_id, CAST(event_id % 5 AS INT) AS capability, event_id % 10 = 0 AS zero_cost,
        CAST(round(value * 100) AS BIGINT) AS estimated_cents, event_id % 7 <> 0 AS succeeded""",
    ),
    "memberships": (
        "customer",
        """c_custkey % 150 AS user_id, c_custkey % 40 AS workspace_id, CASE c_custkey % 4 WHEN 0 THEN 'VIEWER' WHEN 1 THEN 'MEMBER' WHEN 2 THEN 'ADMIN' ELSE 'OWNER' END AS role""",
    ),
    "sessions": ("events", "event_id AS id, user_id, ts + INTERVAL 3 DAY AS expires_at"),
    "access_requests": ("events", "event_id AS id, user_id, event_id % 40 AS workspace_id"),
    "businesses": (
        "supplier",
        """s_suppkey AS id, s_suppkey % 40 AS workspace_id, s_name AS name, CAST(s_suppkey * 37 % 101 AS INT) AS created_at, CASE WHEN s_suppkey % 9 = 0 THEN 1 END AS archived_at,
        CASE s_suppkey % 5 WHEN 0 THEN 'SALES' WHEN 1 THEN 'LEADS' WHEN 2 THEN 'CUSTOMERS' WHEN 3 THEN 'AWARENESS' END AS goal,
        CASE WHEN s_suppkey % 3 <> 0 THEN 1000 END AS budget_amount_cents, CASE WHEN s_suppkey % 7 <> 0 THEN 'DAILY' END AS budget_period""",
    ),
    "scans": (
        "part",
        """p_size AS website_id, concat('shop', p_size, '.example') AS host, p_size % 6 = 0 AS is_first, CAST(p_size % 4 AS INT) AS pages, CAST(p_size % 12 AS INT) AS products""",
    ),
    "websites": ("customer", "c_custkey AS id, c_custkey % 60 AS business_id, CAST(c_custkey * 53 % 997 AS INT) AS created_at"),
    "site_pages": (
        "events",
        """event_id AS id, user_id AS website_id, concat('/page/', event_id) AS url, CAST(event_id * 31 % 1009 AS INT) AS fetched_at,
        CASE event_id % 12 WHEN 0 THEN 'HOME' WHEN 1 THEN 'PRODUCT' WHEN 2 THEN 'FAQ' WHEN 3 THEN 'SHIPPING' WHEN 4 THEN 'ABOUT' WHEN 5 THEN 'CONTACT' WHEN 6 THEN 'RETURNS' WHEN 7 THEN 'COLLECTION' WHEN 8 THEN 'POLICY' WHEN 9 THEN 'BLOG' ELSE 'OTHER' END AS page_type""",
    ),
    "shop_texts": (
        "documents",
        """doc_id % 50 + 1 AS business_id, doc_id AS id, lang AS title, concat('/p/', doc_id) AS url, text, CAST(doc_id * 31 % 1009 AS INT) AS fetched_at, concat('a view of ', doc_id % 9) AS alt,
        CASE doc_id % 12 WHEN 0 THEN 'HOME' WHEN 1 THEN 'PRODUCT' WHEN 2 THEN 'FAQ' WHEN 3 THEN 'SHIPPING' WHEN 4 THEN 'ABOUT' WHEN 5 THEN 'CONTACT' WHEN 6 THEN 'RETURNS' WHEN 7 THEN 'COLLECTION' WHEN 8 THEN 'POLICY' WHEN 9 THEN 'BLOG' ELSE 'OTHER' END AS page_type""",
    ),
    "inferences": (
        "events",
        """event_id AS id, user_id AS business_id, concat('said ', event_id) AS statement, CAST(event_id % 13 AS INT) AS created_at,
        CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS uncertainty""",
    ),
}


def project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the Parquet tables in sf_dir; columns that it does not use are never read."""
    source, columns = PROJECTIONS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*_split(columns))


def as_sql(name: str) -> str:
    """The same projection as a DuckDB subquery."""
    source, columns = PROJECTIONS[name]
    return f"(SELECT {columns.replace('AS STRING', 'AS VARCHAR')} FROM {source})"


def _split(columns: str) -> list[str]:
    """The select list at its outer commas."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(columns):
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]
