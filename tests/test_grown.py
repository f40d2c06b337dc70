"""Registered queries on tables grown by repeating them with shifted keys: the keys and groups of larger inputs."""

import hashlib
import os

import duckdb
from test_queries import QUERIES, SQL, rows

from shopstead.operators import crawl, extract, redirects
from shopstead.sources import tables


def grown(sf, folder, times, **keys):
    """Copies of the tables in sf: those named by keys (table = (column, shift)) `times` over with shifted keys."""
    for f in os.listdir(sf):
        name = f.removesuffix(".parquet")
        if name in keys:
            column, shift = keys[name]
            duckdb.sql(f"COPY (SELECT t.* REPLACE ({column} + k * {shift} AS {column}) FROM '{sf}/{f}' t, (SELECT unnest(range({times}))::BIGINT AS k)) TO '{folder}/{f}' (FORMAT parquet)")
        else:
            os.symlink(f"{sf}/{f}", f"{folder}/{f}")
    return str(folder)


def same(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    got, want = QUERIES[name](spark, folder), con.sql(SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_labels_do_not_come_round(spark, sf, tmp_path):
    same(spark, grown(sf, tmp_path, 100, part=("p_partkey", 200)), "labelled_copy")


def test_labels_of_all_variants(spark, tmp_path):
    """An ad's accepted variants are all labelled: past Z, past the halves of pairs, past 65,536."""
    duckdb.sql(f"COPY (SELECT k * 40 + 1 AS p_partkey, 'plain' AS p_name FROM range(122500) t(k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    ids = [i for i in range(1, 122500 * 40, 40) if i % 3 and i % 7]
    unit = lambda n: (65 + n) % 65536
    want = [(i, 1, "\ufffd" if 0xD800 <= unit(n) <= 0xDFFF else chr(unit(n))) for n, i in enumerate(ids)]
    assert len(want) == 70000 and sorted(tuple(r) for r in QUERIES["labelled_copy"](spark, str(tmp_path)).select("id", "ad", "label").collect()) == want
    same(spark, str(tmp_path), "labelled_copy")


def test_copy_evidence_of_large_ids(spark, sf, tmp_path):
    same(spark, grown(sf, tmp_path, 3, part=("p_partkey", 500_000)), "copy_evidence")


def test_copy_evidence_of_all_products_and_events(spark, sf, tmp_path):
    """Beside its SQL: every product has a row, whatever its id, with the facts of every event."""
    folder = grown(sf, tmp_path, 3, part=("p_partkey", 500_000))
    facts = {}
    for event, user, kind in duckdb.sql(f"SELECT event_id, user_id, event_type FROM '{folder}/events.parquet'").fetchall():
        facts.setdefault(user % 200, []).append((kind, f"v{event % 37}"))
    said = lambda i: "\n".join(v for _, v in sorted(facts.get(i, [])))
    want = [(i, hashlib.md5(f"{name}\n\n{said(i)}\n{'' if i % 5 else 'As seen'}".encode()).hexdigest()) for i, name in duckdb.sql(f"SELECT p_partkey, p_name FROM '{folder}/part.parquet'").fetchall()]
    assert len(want) == 600 and sorted(tuple(r) for r in QUERIES["copy_evidence"](spark, folder).select("id", "words_md5").collect()) == sorted(want)


def test_copy_evidence_of_missing_ids(spark, sf, tmp_path):
    for f in os.listdir(sf):
        missing = {"part": "p_partkey", "events": "event_id"}.get(f.removesuffix(".parquet"))
        if missing:
            duckdb.sql(f"COPY (SELECT * REPLACE (nullif({missing}, 7) AS {missing}) FROM '{sf}/{f}') TO '{tmp_path}/{f}' (FORMAT parquet)")
        else:
            os.symlink(f"{sf}/{f}", f"{tmp_path}/{f}")
    same(spark, str(tmp_path), "copy_evidence")


def test_owner_texts_are_not_broadcast(spark, sf):
    """Edits read from a small file grow to 2,000 characters each; refused texts do not reach the join."""
    plan = QUERIES["owner_edits"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sitemap_entries_leave_their_file(spark):
    files = spark.createDataFrame([(1, "https://a.example", "https://a.example/s.xml", "<urlset><url><loc>/p</loc></url></urlset>")], "site int, base string, url string, xml string")
    plan = crawl.parse_sitemap(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "xml#" not in plan[: plan.index("Generate")]


def test_small_rows_are_spread(spark, sf, monkeypatch):
    """A pass with much work a row has a task for each SPREAD rows, not for each split of the file."""
    monkeypatch.setattr(tables, "SPREAD", 20)
    assert QUERIES["page_markup"](spark, sf).rdd.getNumPartitions() == 10


def test_redirects_are_spread(spark, monkeypatch):
    """Addresses are parsed and gated in a task for each SPREAD rows, after they are dealt out."""
    monkeypatch.setattr(redirects, "SPREAD", 20, raising=False)
    stored = spark.range(200).coalesce(1).selectExpr("concat('https://a.example/', id) AS url", "301 AS status", "concat('/', id + 1) AS location")
    plan = redirects.steps(stored)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.rindex("ArrowEvalPython") < plan.find("RoundRobinPartitioning(10)")
    assert "regexp_extract" not in plan[plan.index("RoundRobinPartitioning(10)") :]


def test_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(extract, "PAGES", 3)
    pages = spark.range(10).selectExpr("id AS page_id", "'https://a.example/' AS url", "concat('<title>t', id, '</title>') AS html").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    got = extract.extract(pages).select("page_id", "page.title").collect()
    assert sorted((r.page_id, r.title) for r in got) == [(i, f"t{i}") for i in range(10)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
