"""Rows that are filled in later: raw filings of disclosures, option details, unknown members, watchlists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import options as O
from ledgerlark.functions.resolution import FIRST_NAMES
from ledgerlark.operators import members as M
from ledgerlark.operators import relations as R
from ledgerlark.plans import scalar_queries  # noqa: F401  its oracle is part of one below
from ledgerlark.plans.catalog import SQL, query
from ledgerlark.sources import sinks

c = F.col


@query("X29_raw_filings", "disclosed", sql="""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY member_id, filed ORDER BY ticker NULLS FIRST, value_range) - 1 AS i FROM disclosed), p AS (SELECT *, json_object('filed', CAST(filed AS VARCHAR), 'politician_name', member_id, 'ticker', ticker, 'value_range', value_range) AS payload FROM n)
SELECT 'house_disclosures' AS source, 'disclosure_holding' AS filing_type, 'house-disclosure-' || year(filed) || '-' || member_id || '-' || strftime(filed, '%m%d') || '-' || i AS source_document_id, ticker, filed AS filed_at, sha256(CAST(payload AS VARCHAR)) AS content_hash, CAST(payload AS VARCHAR) AS payload FROM p""")
def raw_filings(disclosed):
    """Each row of a disclosure as a raw filing: its number in the filing, its payload with sorted names, and the payload's hash."""
    i = F.row_number().over(Window.partitionBy("member_id", "filed").orderBy(F.asc_nulls_first("ticker"), "value_range")) - 1
    payload = F.to_json(F.struct(c("filed").cast("string").alias("filed"), c("member_id").alias("politician_name"), "ticker", "value_range"), {"ignoreNullFields": "false"})
    rows = disclosed.withColumn("i", i).withColumn("payload", payload)
    name = F.concat_ws("-", F.lit("house-disclosure"), F.year("filed").cast("string"), "member_id", F.date_format("filed", "MMdd"), c("i").cast("string"))
    return rows.select(F.lit("house_disclosures").alias("source"), F.lit("disclosure_holding").alias("filing_type"), name.alias("source_document_id"), "ticker", c("filed").alias("filed_at"), F.sha2("payload", 256).alias("content_hash"), "payload")


@query("X31_option_backfill", "options", sql=f"""
WITH s AS (SELECT p_partkey, side, strike, expiry FROM ({SQL['S19_options']}) AS x), o AS (SELECT options.p_partkey, text, asset_type, side, strike, expiry FROM options JOIN s USING (p_partkey)),
t AS (SELECT p_partkey, p_partkey % 70 AS url, text FROM o WHERE upper(asset_type) = 'OP' AND side IS NULL AND strike IS NULL AND expiry IS NULL), r AS (SELECT p_partkey % 70 AS url, side, strike, expiry FROM o WHERE side IS NOT NULL OR strike IS NOT NULL OR expiry IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY p_partkey) = 1)
SELECT t.p_partkey, t.text, r.side, r.strike, r.expiry FROM t LEFT JOIN r USING (url)""")
def option_backfill(options):
    """Option rows that tell no detail get those of the first raw row of their address; one raw row an address is kept before the join."""
    o = options.withColumn("o", O.details(c("text"), c("asset_type"))).withColumn("url", c("p_partkey") % 70)
    known = c("o.side").isNotNull() | c("o.strike").isNotNull() | c("o.expiry").isNotNull()
    raw = R.first_per(o.where(F.coalesce(known, F.lit(False))), ["url"], [F.asc("p_partkey")]).select("url", "o.side", "o.strike", "o.expiry")
    targets = o.where((F.upper("asset_type") == "OP") & ~F.coalesce(known, F.lit(False))).select("p_partkey", "url", "text")
    return targets.join(raw, "url", "left").drop("url")


SAME = " ".join(f"WHEN x = '{n}' THEN '{g[0]}'" for g in FIRST_NAMES for n in g)
TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z]+'), lambda t: t NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v'))"


@query("X32_J17_unknown_members", "unknown_filers", "registered", sql=f"""
WITH f AS (SELECT c_custkey, member_id, district, {TOKENS.format('first_name')} AS a, array_to_string({TOKENS.format('last_name')}, ' ') AS last FROM unknown_filers), m AS (SELECT member_id AS id, district, {TOKENS.format('first_name')} AS b, array_to_string({TOKENS.format('last_name')}, ' ') AS last FROM registered),
x AS (SELECT c_custkey, id, unnest(a) AS x, b FROM f JOIN m USING (district, last)), y AS (SELECT c_custkey, id, x, unnest(b) AS y FROM x), z AS (SELECT *, CASE {SAME} ELSE x END AS sx, CASE {SAME.replace('x = ', 'y = ')} ELSE y END AS sy FROM y),
h AS (SELECT c_custkey, count(DISTINCT id) AS n, min(id) AS id FROM z WHERE sx = sy OR (starts_with(x, y) OR starts_with(y, x)) AND (least(length(x), length(y)) = 1 OR least(length(x), length(y)) >= 3) GROUP BY 1)
SELECT f.c_custkey, f.member_id, CASE WHEN n = 1 THEN id END AS resolved_id FROM f LEFT JOIN h USING (c_custkey)""")
def unknown_members(unknown_filers, registered):
    """Rows stored under an unknown member, resolved by last name and district, then first names, nicknames and initials."""
    return M.resolved(unknown_filers.where("member_id like 'unknown-%'"), registered, "c_custkey", ["district"]).select("c_custkey", "member_id", "resolved_id")


@query("X49_watchlist_setup", "follows", "trades", sql="""
WITH s AS (SELECT watchlist_id, target, min(alert_mode) AS alert_mode FROM follows WHERE match_type = 'ticker' AND target IS NOT NULL GROUP BY 1, 2), i AS (SELECT DISTINCT 'U' || (CAST(substr(member_id, 2) AS BIGINT) % 40) AS watchlist_id, ticker AS target, 'both' AS alert_mode FROM trades WHERE ticker IS NOT NULL AND amount_floor >= 50001)
SELECT watchlist_id, target, coalesce(i.alert_mode, s.alert_mode) AS alert_mode, s.target IS NULL AS fresh FROM s FULL JOIN i USING (watchlist_id, target)""")
def watchlists(follows, trades):
    """Wanted tickers are written over what a watchlist follows, by list and ticker; `fresh` marks lines that were not there."""
    stored = follows.where("match_type = 'ticker' and target is not null").groupBy("watchlist_id", "target").agg(F.min("alert_mode").alias("alert_mode"))
    wanted = trades.where("ticker is not null and amount_floor >= 50001").select(F.concat(F.lit("U"), (F.substring("member_id", 2, 20).cast("bigint") % 40).cast("string")).alias("watchlist_id"), c("ticker").alias("target"), F.lit("both").alias("alert_mode")).distinct()
    both = sinks.upsert(stored, wanted, ["watchlist_id", "target"])
    return both.join(stored.select("watchlist_id", "target", F.lit(False).alias("old")), ["watchlist_id", "target"], "left").select("watchlist_id", "target", "alert_mode", c("old").isNull().alias("fresh"))
