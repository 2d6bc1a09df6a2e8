"""Domain views over the TPC-H-like driver tables, as one SQL text that Spark and the oracle both read.

Dates of the driver tables carry no zone; all views use DATE. `(l_orderkey, l_linenumber)` is not unique, so trades have no
natural key and operators bring their own total orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01"

_TICKER = ("CASE l_partkey % 200 WHEN 7 THEN 'US-TREAS' WHEN 8 THEN 'N/A' WHEN 9 THEN NULL "
           "ELSE translate(lpad(CAST(l_partkey % 200 AS VARCHAR(10)), 3, '0'), '0123456789', 'ABCDEFGHIJ') END")
_AMOUNT = "CAST(l_extendedprice AS DECIMAL(18,2))"
_RANGE = f"""CASE WHEN {_AMOUNT} < 1001 THEN '$1 - $1,000' WHEN {_AMOUNT} <= 15000 THEN '$1,001 - $15,000'
 WHEN {_AMOUNT} <= 50000 THEN '$15,001 - $50,000' WHEN {_AMOUNT} <= 100000 THEN '$50,001 - $100,000' ELSE '$100,001 - $250,000' END"""
_QUARTER = "last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL '2' MONTH)"

VIEWS = {
    "trades": f"""SELECT 'M' || o_custkey AS member_id, c_name AS politician_name, {_TICKER} AS ticker, p_name AS asset_name,
 CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS direction, CAST(o_orderdate AS DATE) AS published_date,
 CAST(l_shipdate AS DATE) AS transaction_date, {_RANGE} AS amount_range, {_AMOUNT} AS amount,
 CASE WHEN {_AMOUNT} < 1001 THEN 1 WHEN {_AMOUNT} <= 15000 THEN 1001 WHEN {_AMOUNT} <= 50000 THEN 15001 WHEN {_AMOUNT} <= 100000 THEN 50001 ELSE 100001 END AS amount_floor,
 'house-' || year(o_orderdate) || '-' || o_orderkey || '-' || l_linenumber AS doc_id, c_mktsegment AS party,
 CASE WHEN o_custkey % 2 = 0 THEN 'House' ELSE 'Senate' END AS chamber,
 CASE p_size % 5 WHEN 1 THEN 'Stock' WHEN 2 THEN 'ST' WHEN 3 THEN 'ETF' WHEN 4 THEN 'Municipal Security' END AS asset_type
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "insiders": f"""SELECT s_name AS filer_name, {_TICKER} AS ticker,
 CASE s_nationkey % 4 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'Director' WHEN 2 THEN '10% Owner' ELSE 'Other' END AS relation,
 CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'P' END AS transaction_code, CAST(l_shipdate AS DATE) AS transaction_date,
 CAST(l_shipdate AS DATE) + 2 AS published_date, CAST(l_quantity AS DECIMAL(18,2)) AS shares, {_AMOUNT} AS amount,
 'https://x.example/' || lpad(CAST(l_orderkey AS VARCHAR(12)), 10, '0') || '-' || lpad(CAST(year(l_shipdate) % 100 AS VARCHAR(4)), 2, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR(6)), 6, '0') || '.txt#' || l_linenumber AS source_url
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "holdings": f"""SELECT s_name AS fund_name, {_TICKER} AS ticker, {_QUARTER} AS report_period, {_QUARTER} + 45 AS published_date,
 CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS BIGINT) AS shares_held, sum({_AMOUNT}) AS value_held
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 200 NOT IN (7, 8, 9) GROUP BY 1, 2, 3, 4""",
    "prices": f"SELECT {_TICKER} AS ticker, CAST(l_shipdate AS DATE) AS price_date, max({_AMOUNT}) AS price FROM lineitem WHERE l_partkey % 200 NOT IN (7, 8, 9) GROUP BY 1, 2",
    "members": """SELECT 'M' || c_custkey AS member_id, c_name AS full_name, n_name AS state, c_mktsegment AS party, c_acctbal >= 0 AS active
 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "signals": """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS day, 'U' || user_id AS user_id, event_type AS signal_type,
 CAST(value AS DECIMAL(18,4)) AS amount FROM events""",
}
_PART = _TICKER.replace("l_partkey", "p_partkey")
VIEWS |= {
    "companies": f"""SELECT ticker, p_name AS name, p_brand AS sector, p_type AS industry, p_partkey FROM
 (SELECT *, {_PART} AS ticker, row_number() OVER (PARTITION BY p_partkey % 200 ORDER BY p_partkey) AS nth FROM part) AS numbered WHERE nth = 1 AND ticker IS NOT NULL""",
    "issuers": """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN upper(p_name) || ' HLDGS INC' WHEN 1 THEN p_name || ' Finl & Svcs/CA' WHEN 2 THEN p_name || ' Incorporated New'
 WHEN 3 THEN 'The ' || p_name || ' Intl Group /DE/' ELSE p_name || ' A B Z Corp' END AS issuer,
 CASE p_size % 6 WHEN 0 THEN 'CL A' WHEN 1 THEN 'COM SER C' WHEN 2 THEN 'SPON ADR NEW' WHEN 3 THEN 'Class B' WHEN 4 THEN 'PFD' ELSE 'COM' END AS title,
 CASE WHEN p_size % 9 = 0 THEN 'Put' END AS put_call, CASE p_size % 4 WHEN 0 THEN 'PRN' WHEN 1 THEN NULL ELSE ' sh' END AS share_type,
 CASE p_size % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'Nasdaq' ELSE 'OTC' END AS exchange FROM part""",
    "options": """SELECT p_partkey, p_name || CASE p_size % 6 WHEN 0 THEN ' Call options; Strike price $' || (p_size * 500) || '; Expires 06/18/2026' WHEN 1 THEN ' put option  exp 1/5/27'
 WHEN 2 THEN ' [OP]' WHEN 3 THEN CASE p_partkey % 3 WHEN 0 THEN ' strike:$150; expires:06/19/2026' WHEN 1 THEN ',1/2/2024' ELSE ' (STRIKE of 1,250.50) 2024-01-05' END WHEN 4 THEN ' call option expiration date: 2027-02-30' ELSE '' END AS text,
 CASE p_size % 4 WHEN 0 THEN 'op' WHEN 1 THEN 'ST' WHEN 2 THEN '' END AS asset_type FROM part""",
    "people": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'José ' || c_name || ' Jr.' WHEN 1 THEN 'Zoë O''Neil ' || c_name WHEN 2 THEN c_name || ' Capital Partners, L.P.' ELSE c_name || ', III' END AS name,
 CASE WHEN c_custkey % 3 > 0 THEN ' M' || c_custkey || ' ' END AS member_id FROM customer""",
    "codes": """SELECT DISTINCT l_returnflag AS flag, CASE l_linenumber % 9 WHEN 0 THEN 'Purchase' WHEN 1 THEN ' SALE (Full)' WHEN 2 THEN 'p' WHEN 3 THEN 'S' WHEN 4 THEN 'Increased' WHEN 5 THEN 'reduce'
 WHEN 6 THEN 'Held' WHEN 7 THEN '' ELSE 'Exchange' END AS raw, CASE l_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'P' WHEN 3 THEN 's' ELSE 'X' END AS code FROM lineitem""",
    "stored": """SELECT p_partkey AS key, p_name AS name, p_size AS v, CASE p_size % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending_review' END AS status,
 DATE '2001-01-01' + p_size AS created_at, p_brand AS grp FROM part WHERE p_partkey % 3 <> 0""",
    "incoming": """SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN p_name ELSE upper(p_name) END AS name, CAST(p_size + p_partkey % 4 AS INT) AS v, 'pending_review' AS status,
 CASE WHEN p_partkey % 8 = 0 THEN DATE '2001-06-01' END AS created_at, p_brand AS grp FROM part WHERE p_partkey % 2 = 0""",
    "follows": f"""SELECT DISTINCT 'U' || user_id AS watchlist_id, CASE event_id % 2 WHEN 0 THEN 'ticker' ELSE 'actor' END AS match_type,
 CASE event_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'activity' ELSE 'unusual' END AS alert_mode,
 CASE WHEN event_id % 2 = 0 THEN {_TICKER.replace("l_partkey", "event_id")} ELSE 'politician:m' || (event_id % 1500) END AS target FROM events WHERE event_type = 'signup'""",
    "subscriptions": """SELECT DISTINCT 'U' || user_id AS watchlist_id, 'S' || user_id || event_type AS subscription_id, CASE event_type WHEN 'view' THEN 'email' ELSE 'sms' END AS channel,
 CAST(CASE event_type WHEN 'view' THEN 0.70 ELSE 0.75 END AS DECIMAL(5,2)) AS minimum_importance FROM events WHERE event_type IN ('view', 'error') AND user_id % 3 > 0""",
}
VIEWS["feed_events"] = f"""SELECT 'E' || l_orderkey || '-' || l_linenumber AS event_id, CASE l_orderkey % 12 WHEN 0 THEN 'politician_cluster' WHEN 1 THEN 'cross_source_accumulation'
 WHEN 2 THEN 'politician_gain_milestone' WHEN 3 THEN 'cluster_gain_milestone' WHEN 4 THEN 'politician_filing_summary' WHEN 5 THEN 'fund_filing_received' WHEN 6 THEN 'fund_position_change'
 WHEN 7 THEN 'insider_trade' WHEN 8 THEN 'insider_cluster' WHEN 9 THEN 'politician_trade_grouped' WHEN 10 THEN 'insider_trade_grouped' ELSE 'politician_trade' END AS signal_type,
 CASE l_orderkey % 12 WHEN 7 THEN 'insider_trade' WHEN 8 THEN 'insider_trade' WHEN 10 THEN 'insider_trade' WHEN 9 THEN 'politician_trade' WHEN 11 THEN 'politician_trade' END AS base_type,
 CASE WHEN l_orderkey % 12 IN (5, 6) THEN 'fund' WHEN l_orderkey % 12 IN (7, 8, 10) THEN 'insider' ELSE 'congress' END AS source,
 CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS direction, {_TICKER} AS ticker,
 CASE l_suppkey % 9 WHEN 0 THEN 'Ann Notable' WHEN 1 THEN 'North Capital Group' WHEN 2 THEN NULL ELSE 'Person ' || l_suppkey END AS actor_name,
 CASE WHEN l_suppkey % 4 > 0 THEN 'M' || l_suppkey END AS member_id, {_RANGE} AS amount_range, CAST(floor({_AMOUNT}) AS BIGINT) * 10 AS value,
 CASE l_partkey % 7 WHEN 1 THEN 'Stock' WHEN 2 THEN 'ETF fund' WHEN 3 THEN 'Municipal Security' WHEN 4 THEN '' END AS asset_type,
 CASE l_partkey % 11 WHEN 3 THEN 'County bond' ELSE 'Common shares' END AS asset_name,
 CASE l_partkey % 5 WHEN 0 THEN 'quantum' WHEN 1 THEN 'crypto' WHEN 2 THEN 'defense' END AS theme, CASE l_suppkey % 3 WHEN 0 THEN 'defense' WHEN 1 THEN 'quantum' END AS member_theme,
 l_partkey % 13 = 0 AS first_ticker_buy, l_suppkey % 3 = 0 AS first_actor_buy, (l_orderkey * 7 + l_linenumber * 3) % 130 AS change_pct, l_partkey % 17 = 0 AS new_position,
 (l_orderkey + l_linenumber) % 240 AS gain_pct, CASE WHEN (l_orderkey + l_linenumber) % 240 >= 100 THEN 100 ELSE 50 END AS milestone_pct,
 CASE l_partkey % 3 WHEN 0 THEN 'cross_source_accumulation' ELSE 'politician_cluster' END AS cluster_type, l_linenumber % 2 = 0 AS includes_fund,
 l_linenumber % 3 > 0 AS summary_activity, l_linenumber % 5 = 0 AS summary_unusual, CASE l_suppkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'exit' WHEN 2 THEN 'increase' END AS change_type,
 l_linenumber % 4 AS group_rows, CAST(0.60 + (l_partkey % 40) / 100.0 AS DECIMAL(5,2)) AS importance, CAST(l_shipdate AS DATE) AS published_date, l_suppkey % 7 AS actors FROM lineitem"""
VIEWS |= {  # a graph of unequal depth with shared children, cycles of two, and children that have no row
    "graph_nodes": f"""SELECT 'n' || p_partkey AS id, p_partkey, {_PART} AS ticker, CASE p_size % 2 WHEN 0 THEN 'buy' ELSE 'sell' END AS direction, CASE p_partkey % 4 WHEN 0 THEN 'insider' ELSE 'congress' END AS source,
 DATE '2001-01-01' + p_size % 3 AS transaction_date, CAST(p_size % 4 AS DECIMAL(18,2)) AS amount, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1001 WHEN 2 THEN 15001 WHEN 3 THEN 50001 ELSE 100001 END AS amount_floor FROM part""",
    "graph_edges": """SELECT 'n' || p_partkey AS parent, 'n' || CAST(floor(p_partkey / 2) AS BIGINT) AS child FROM part WHERE p_partkey % 3 <> 0 AND p_partkey > 1
 UNION SELECT 'n' || p_partkey, 'n' || CAST(floor(p_partkey / 3) AS BIGINT) FROM part WHERE p_partkey % 5 IN (1, 2) AND p_partkey % 3 <> 0 AND p_partkey > 3
 UNION SELECT 'n' || p_partkey, 'n' || (p_partkey + CASE p_partkey % 50 WHEN 1 THEN 1 ELSE -1 END) FROM part WHERE p_partkey % 50 IN (1, 2)
 UNION SELECT 'n' || p_partkey, 'missing' || p_partkey FROM part WHERE p_partkey % 11 = 0""",
    "graph_stories": "SELECT p_brand || '/' || p_size AS story, 'n' || p_partkey AS event, p_size * 100 AS own_floor FROM part WHERE p_partkey % 4 = 1",
}
VIEWS["disclosed"] = f"""SELECT DISTINCT 'M' || o_custkey AS member_id, {_TICKER} AS ticker, {_RANGE} AS value_range, CASE o_custkey % 3 WHEN 0 THEN DATE '2002-01-01' ELSE DATE '1998-01-01' END + CAST(l_linenumber % 2 AS INT) * 30 AS filed
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 3 < 2 AND l_suppkey % 3 = 0"""
VIEWS["scan_tokens"] = "SELECT l_orderkey AS doc, l_linenumber % 2 AS page, l_partkey % 150 AS top, l_suppkey % 1000 AS edge, l_returnflag || l_partkey AS text FROM lineitem"
VIEWS["gap_reports"] = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{"house":{"missing_or_partial_filings":[{"doc":"a' || o_orderkey || '"},{"doc":"b"},5]},"ok":true}'
 WHEN 1 THEN '{"missing_or_partial_filings":[{"doc":"c","deep":{"missing_or_partial_filings":[{"doc":"not"}]}}]}'
 WHEN 2 THEN '[{"a":[{"b":{"missing_or_partial_filings":[{"doc":"d"},"s",null,{"doc":"e' || o_custkey || '"}]}}]},{"missing_or_partial_filings":"text"}]'
 ELSE '{"missing_or_partial_filings":{"x":{"missing_or_partial_filings":[]},"y":[[{"missing_or_partial_filings":[{"doc":"f"}]}]]},"n":1}' END AS doc FROM orders"""
_LASTS = ("CASE {} % 12 WHEN 0 THEN 'Abbott' WHEN 1 THEN 'Brown' WHEN 2 THEN 'Castro' WHEN 3 THEN 'Diaz' WHEN 4 THEN 'Evans' WHEN 5 THEN 'Foster' WHEN 6 THEN 'Green' WHEN 7 THEN 'Hill' WHEN 8 THEN 'Ibarra' WHEN 9 THEN 'Jones' WHEN 10 THEN 'Kim' ELSE 'Lopez' END")
_FIRSTS = ("CASE {} % 9 WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' WHEN 3 THEN '{}' WHEN 4 THEN '{}' WHEN 5 THEN '{}' WHEN 6 THEN '{}' WHEN 7 THEN '{}' ELSE '{}' END")
VIEWS |= {  # registered members, and names on filings that come near theirs
    "registered": f"""SELECT 'M' || c_custkey AS member_id, {_FIRSTS.format("c_custkey", "William", "Daniel", "David", "James", "Richard", "Thomas", "Mary Ann", "Roberta", "Rafael")} AS first_name,
 {_LASTS.format("CAST(floor(c_custkey / 9) AS BIGINT)")} AS last_name, 'D' || CAST(floor(c_custkey / 60) AS BIGINT) AS district FROM customer WHERE c_custkey % 4 > 0""",
    "unknown_filers": f"""SELECT c_custkey, 'unknown-' || c_custkey AS member_id, {_FIRSTS.format("c_custkey", "Bill", "Danny J.", "D", "Jimmy", "Rick", "Thom", "Ann", "Bob", "Ted")} AS first_name,
 {_LASTS.format("CAST(floor(c_custkey / 9) AS BIGINT)")} || CASE WHEN c_custkey % 5 = 0 THEN ', Jr.' ELSE '' END AS last_name, 'D' || CAST(floor(c_custkey / 60) AS BIGINT) AS district FROM customer""",
}
_THIRD = ("CASE p_partkey % 8 WHEN 0 THEN 'industries' WHEN 1 THEN 'logistics' WHEN 2 THEN 'materials' WHEN 3 THEN 'energy' WHEN 4 THEN 'bancorp' WHEN 5 THEN 'robotics' WHEN 6 THEN 'foods' ELSE 'airlines' END")
_SYMBOL = "'T' || translate(CAST(p_partkey AS VARCHAR(12)), '0123456789', 'ABCDEFGHIJ')"
VIEWS |= {  # lists of companies with clean and unclean names, and asset texts that name them well, nearly or not at all
    "listed_reference": f"""SELECT {_SYMBOL} AS ticker, p_name || ' ' || {_THIRD} || CASE p_size % 4 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Corp' WHEN 2 THEN ', Inc.' ELSE '' END || CASE WHEN p_partkey % 51 = 0 THEN ' Trust' ELSE '' END AS name,
 CASE p_size % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'Nasdaq' ELSE 'OTC' END AS exchange FROM part WHERE p_partkey % 3 = 0""",
    "listed_rows": f"""SELECT {_SYMBOL} AS ticker, CASE WHEN p_partkey % 17 = 0 THEN lower({_SYMBOL}) || ' placeholder' WHEN p_partkey % 60 = 1 THEN p_name WHEN p_partkey % 19 = 0 THEN p_name || ' 1/2/2024 sale'
 ELSE p_name || ' ' || {_THIRD} || ' group' END AS name FROM part WHERE p_partkey % 3 = 1 OR p_partkey % 6 = 0""",
    "asset_texts": f"""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN p_name || ' ' || {_THIRD} || ' Inc' WHEN 1 THEN p_name || ' ' || {_THIRD} || ' Common Stock (ZQX)' WHEN 2 THEN 'United States Treasury Bill 4.5%'
 WHEN 3 THEN p_name || ' ' || {_THIRD} || 's Corp' WHEN 4 THEN 'Intel Corporation - Common' WHEN 5 THEN p_name || ' municipal bond' WHEN 6 THEN p_name WHEN 7 THEN p_name || ' unheard of ' || {_SYMBOL}
 WHEN 8 THEN p_name || ' ' || {_THIRD} || ' [ST] 5/1/2024 $1,000 class A' ELSE 'Fund 7 ' || p_name || CASE p_partkey % 4 WHEN 1 THEN ' LLC' WHEN 3 THEN ' (held) Partners stock' ELSE '' END END AS asset,
 CASE WHEN p_partkey % 13 = 0 THEN 'Starbucks Coffee' WHEN p_partkey % 14 = 0 THEN p_name || ' ' || {_THIRD} END AS other FROM part""",
}
VIEWS |= {  # companies and other names that they go by, for suggestions
    "directory": f"""SELECT {_SYMBOL} AS ticker, p_name || CASE p_partkey % 7 WHEN 0 THEN ' - Class A Common Stock' WHEN 1 THEN ' Common Stock [ST]' WHEN 2 THEN ' Ordinary Shares each' WHEN 3 THEN ' trust account' WHEN 4 THEN ' works' ELSE '' END AS name
 FROM part WHERE p_partkey % 4 > 0""",
    "nicknames": f"SELECT {_SYMBOL} AS ticker, p_name AS company, p_brand AS other FROM part WHERE p_partkey % 40 IN (0, 1)",
}
#: Joins that Spark makes by hashing the dealt smaller side: lineitem is not sorted again for each of them. The oracle's SQL has no hints.
HINTS = {"trades": "SHUFFLE_HASH(placed, part)"}
#: Orders meet their customers before lines meet their orders: lines are dealt once less. The oracle's SQL has the joins in their plain order.
PLACED = ("lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
          "lineitem JOIN (SELECT /*+ SHUFFLE_HASH(customer) */ * FROM orders JOIN customer ON o_custkey = c_custkey) AS placed ON l_orderkey = o_orderkey")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view, or a driver table of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}").replace(*PLACED)  # braces of texts are no places for tables
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", sql)
    if name in HINTS:
        sql = sql.replace("SELECT", f"SELECT /*+ {HINTS[name]} */", 1)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(sql: str) -> str:
    """sql with the views it names as common table expressions."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if not head:
        return body
    return f"WITH RECURSIVE {head}, {body[15:].strip()}" if body.upper().startswith("WITH RECURSIVE") else f"WITH {head}, {body[5:].strip()}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
