"""Sinks as queries: what is stored after each kind of write."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.plans.catalog import query
from ledgerlark.sources import sinks

c = F.col
NOW = "DATE '2001-08-01'"


def now():
    return F.lit("2001-08-01").cast("date")


@query("SK1_SK2_upserts", "stored", "incoming", sql=f"""
SELECT key, i.name, i.v, i.status, coalesce(s.created_at, i.created_at, {NOW}) AS created_at, i.grp, {NOW} AS updated_at FROM incoming i LEFT JOIN stored s USING (key) UNION ALL SELECT key, name, v, status, created_at, grp, NULL FROM stored WHERE key NOT IN (SELECT key FROM incoming)""")
def upserted(stored, incoming):
    return sinks.upsert_stamped(stored, incoming, ["key"], now())


@query("SK3_replace_by_keys", "stored", "incoming", sql="""
WITH i AS (SELECT * FROM incoming WHERE v > 40) SELECT * FROM i UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.grp = s.grp AND i.v = s.v) AND NOT EXISTS (SELECT 1 FROM i WHERE i.grp = s.grp AND i.name = s.name)""")
def replaced(stored, incoming):
    return sinks.replace_matching(stored, incoming.where("v > 40"), ["grp", "v"], ["grp", "name"])


@query("SK4_SK5_replace_by_filing", "trades", sql="""
WITH n AS (SELECT doc_id, ticker, amount + 1 AS amount FROM trades WHERE chamber = 'House' AND amount_floor >= 50001), d AS (SELECT DISTINCT regexp_replace(doc_id, '-[0-9]+$', '') k FROM n)
SELECT * FROM n UNION ALL SELECT doc_id, ticker, amount FROM trades WHERE regexp_replace(doc_id, '-[0-9]+$', '') NOT IN (SELECT k FROM d)""")
def filings(trades):
    rows = trades.select("doc_id", "ticker", c("amount").cast("decimal(19,2)").alias("amount"))
    new = trades.where("chamber = 'House' and amount_floor >= 50001").select("doc_id", "ticker", (c("amount") + 1).cast("decimal(19,2)").alias("amount"))
    return sinks.replace_derived(rows, new, S.filing_key, "doc_id")


@query("SK6_J14_insert_absent", "stored", "incoming", sql="SELECT * FROM stored UNION ALL SELECT * FROM incoming WHERE key NOT IN (SELECT key FROM stored)")
def absent(stored, incoming):
    return stored.unionByName(incoming.join(stored.select("key"), "key", "left_anti"))


@query("SK7_register_missing", "companies", "trades", sql="""
SELECT ticker, name, sector FROM companies WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT ticker, 'unknown', NULL FROM trades WHERE ticker IS NOT NULL AND ticker NOT IN (SELECT ticker FROM companies WHERE p_partkey % 2 = 0)""")
def registered(companies, trades):
    return sinks.register_missing(companies.where("p_partkey % 2 = 0").select("ticker", "name", "sector"), trades, "ticker", name=F.lit("unknown"))


@query("SK8_SK9_keep_clean_names", "stored", "incoming", sql="""
SELECT key, CASE WHEN s.name LIKE '%ring%' THEN s.name ELSE i.name END AS name, i.v FROM incoming i LEFT JOIN stored s USING (key) UNION ALL SELECT key, name, v FROM stored WHERE key NOT IN (SELECT key FROM incoming)""")
def clean(stored, incoming):
    cols = ["key", "name", "v"]
    return sinks.upsert_keeping(stored.select(*cols), incoming.select(*cols), "key", "name", lambda n: n.contains("ring"))


@query("SK10_changes_by_hash", "stored", "incoming", sql="SELECT i.key, CASE WHEN s.key IS NULL THEN 'insert' WHEN s.name = i.name AND s.v = i.v THEN 'skip' ELSE 'update' END AS action FROM incoming i LEFT JOIN stored s USING (key)")
def hashed(stored, incoming):
    return sinks.changes(stored, incoming, "key", ["name", "v"])


@query("SK11_keep_reviewed", "stored", "incoming", sql="""
SELECT i.key, coalesce(s.name, i.name) AS name, i.v, coalesce(s.status, i.status) AS status FROM incoming i LEFT JOIN (SELECT * FROM stored WHERE status <> 'pending_review') s USING (key)""")
def reviewed(stored, incoming):
    return sinks.keep_reviewed(incoming.select("key", "name", "v", "status"), stored, "key", ["name"])


@query("SK12_prune", "stored", "incoming", sql="SELECT * FROM stored WHERE key IN (SELECT key FROM incoming) OR NOT (status = 'pending_review' AND created_at >= DATE '2001-01-20')")
def pruned(stored, incoming):
    return sinks.prune(stored, incoming, "key", (c("status") == "pending_review") & (c("created_at") >= "2001-01-20"))


@query("SK13_deduplicated", "trades", sql="SELECT doc_id, ticker, amount, member_id FROM trades QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ticker NULLS LAST, amount, member_id) = 1")
def deduplicated(trades):
    from ledgerlark.operators.relations import first_per
    return first_per(trades, ["doc_id"], [F.asc_nulls_last("ticker"), F.asc("amount"), F.asc("member_id")]).select("doc_id", "ticker", "amount", "member_id")


@query("SK15_J10_backfill", "trades", "companies", sql="""
WITH t AS (SELECT doc_id, ticker, amount, CASE WHEN amount_floor = 1001 THEN '' ELSE asset_name END AS name FROM trades), d AS (SELECT doc_id, min(name) AS name FROM t WHERE name <> '' GROUP BY 1)
SELECT t.doc_id, t.ticker, t.amount, coalesce(nullif(trim(t.name), ''), d.name, c.name) AS name FROM t LEFT JOIN d ON t.doc_id = d.doc_id LEFT JOIN companies c ON t.ticker = c.ticker""")
def filled(trades, companies):
    t = trades.select("doc_id", "ticker", "amount", F.when(c("amount_floor") == 1001, "").otherwise(c("asset_name")).alias("name"))
    by_doc = t.where("name <> ''").groupBy("doc_id").agg(F.min("name").alias("name"))
    return sinks.backfill(t, (by_doc, ["doc_id"]), (companies.select("ticker", "name"), ["ticker"]), column="name")


@query("SK16_guarded_correction", "holdings", sql="SELECT fund_name, ticker, report_period, value_held * 1000 AS value_held FROM holdings")
def guarded(holdings):
    rows = holdings.select("fund_name", "ticker", "report_period", "value_held")
    return sinks.corrected_once(rows, c("value_held") < 10**9, "value_held", 1000).withColumn("value_held", c("value_held").cast("decimal(38,2)"))


@query("SK17_deliveries", "stored", "incoming", sql="""
SELECT s.key, s.v % 4 + CASE WHEN i.key IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN i.key IS NULL THEN 'pending' WHEN i.v % 2 = 0 THEN 'sent' WHEN s.v % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN i.v % 2 = 0 THEN DATE '2001-08-01' END AS sent_at FROM stored s LEFT JOIN incoming i USING (key)""")
def deliveries(stored, incoming):
    queue = stored.select("key", (c("v") % 4).alias("attempts"), F.lit("pending").alias("status"))
    return sinks.delivered(queue, incoming.select("key", (c("v") % 2 == 0).alias("ok")), "key", now())
