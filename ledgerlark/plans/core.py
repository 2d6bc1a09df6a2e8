"""Windows, joins, aggregates and composites over trades, insiders, holdings, prices and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.operators import clusters as C
from ledgerlark.operators import graph as G
from ledgerlark.operators import relations as R
from ledgerlark.operators import windows as W
from ledgerlark.plans.catalog import query
from ledgerlark.sources.adapters import AS_OF

OK = "ticker NOT IN ('', 'N/A', 'NA', 'UNKNOWN', 'MULTI', 'US-TREAS')"
AT = f"DATE '{AS_OF}'"

# --- windows ---


@query("W1_trailing_actor_clusters", "trades", sql=f"""
WITH e AS (SELECT DISTINCT ticker, direction, published_date d, member_id FROM trades WHERE {OK}),
a AS (SELECT DISTINCT ticker, direction, d FROM e)
SELECT a.ticker, a.direction, a.d AS anchor, count(DISTINCT e.member_id) AS actors FROM a JOIN e ON e.ticker = a.ticker AND e.direction = a.direction AND e.d BETWEEN a.d - 9 AND a.d
GROUP BY 1, 2, 3 HAVING count(DISTINCT e.member_id) >= 2""")
def w1(trades):
    return W.trailing_actors(C.congress_events(trades), ["ticker", "direction"], "member_id", "published_date", 10, 2)


@query("W4_strongest_windows", "trades", sql=f"""
WITH e AS (SELECT ticker, direction, published_date d, member_id, amount_floor f FROM trades WHERE {OK}), a AS (SELECT DISTINCT ticker, direction, d FROM e),
w AS (SELECT a.ticker, a.direction, a.d AS anchor, count(DISTINCT e.member_id) AS actors, CAST(sum(e.f) AS BIGINT) AS floor_sum FROM a JOIN e ON e.ticker = a.ticker AND e.direction = a.direction AND e.d BETWEEN a.d - 44 AND a.d GROUP BY 1, 2, 3)
SELECT * FROM w WHERE actors >= 4 QUALIFY row_number() OVER (PARTITION BY ticker, direction ORDER BY actors DESC, floor_sum DESC, anchor DESC) = 1""")
def w4(trades):
    return W.strongest_window(C.congress_events(trades), ["ticker", "direction"], "member_id", "published_date", "amount_floor", 45, 4)


GREEDY = f"""d AS (SELECT DISTINCT ticker, transaction_code c, published_date d FROM insiders WHERE {OK}),
s AS (SELECT ticker, c, min(d) AS ws FROM d GROUP BY 1, 2 UNION ALL SELECT s.ticker, s.c, (SELECT min(d.d) FROM d WHERE d.ticker = s.ticker AND d.c = s.c AND d.d >= s.ws + 10) FROM s WHERE s.ws IS NOT NULL)"""


@query("W2_greedy_windows", "insiders", sql=f"""
WITH RECURSIVE {GREEDY} SELECT s.ticker, s.c AS transaction_code, s.ws AS window_start, count(*) AS n FROM s JOIN insiders i ON i.ticker = s.ticker AND i.transaction_code = s.c AND i.published_date BETWEEN s.ws AND s.ws + 9
WHERE s.ws IS NOT NULL GROUP BY 1, 2, 3""")
def w2(insiders):
    rows = insiders.withColumn("ticker", S.publishable_ticker(F.col("ticker"))).where("ticker is not null")
    return W.greedy_windows(rows, ["ticker", "transaction_code"], "published_date", 10).groupBy("ticker", "transaction_code", "window_start").agg(F.count(F.lit(1)).alias("n"))


ECON = f"""econ AS (SELECT * FROM insiders WHERE {OK} QUALIFY row_number() OVER (PARTITION BY ticker, transaction_code, transaction_date, shares, amount ORDER BY filer_name, source_url) = 1)"""


@query("W3_insider_clusters", "insiders", sql=f"""
WITH RECURSIVE {ECON}, d AS (SELECT DISTINCT ticker, transaction_code c, published_date d FROM econ),
s AS (SELECT ticker, c, min(d) AS ws FROM d GROUP BY 1, 2 UNION ALL SELECT s.ticker, s.c, (SELECT min(d.d) FROM d WHERE d.ticker = s.ticker AND d.c = s.c AND d.d >= s.ws + 10) FROM s WHERE s.ws IS NOT NULL)
SELECT s.ticker, s.c AS transaction_code, s.ws AS window_start, count(DISTINCT filer_name) AS actors, count(*) AS trades, sum(amount) AS total_value, max(published_date) AS clocked_at
FROM s JOIN econ i ON i.ticker = s.ticker AND i.transaction_code = s.c AND i.published_date BETWEEN s.ws AND s.ws + 9 WHERE s.ws IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT filer_name) >= 5""")
def w3(insiders):
    return C.insider_clusters(insiders, 10, 2)


@query("W6_latest_insider_rows", "insiders", sql="""
SELECT filer_name, ticker, transaction_code, transaction_date, shares, amount FROM insiders WHERE ticker IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY filer_name, ticker ORDER BY transaction_date DESC, amount DESC, shares DESC, transaction_code) = 1""")
def w6(insiders):
    return W.latest_per(insiders.where("ticker is not null"), ["filer_name", "ticker"], [F.desc("transaction_date"), F.desc("amount"), F.desc("shares"), F.asc("transaction_code")]).select(
        "filer_name", "ticker", "transaction_code", "transaction_date", "shares", "amount")


@query("W8_first_actor_events", "trades", sql=f"""
SELECT ticker, member_id, published_date, doc_id FROM trades WHERE {OK} QUALIFY row_number() OVER (PARTITION BY ticker, member_id ORDER BY published_date, doc_id, amount) = 1""")
def w8(trades):
    return R.first_per(C.congress_events(trades), ["ticker", "member_id"], [F.asc("published_date"), F.asc("doc_id"), F.asc("amount")]).select("ticker", "member_id", "published_date", "doc_id")


@query("W9_holder_estimates", "trades", sql=f"""
WITH t AS (SELECT member_id, ticker, transaction_date d, CAST(sum(CASE WHEN direction = 'buy' THEN amount_floor ELSE -amount_floor END) AS BIGINT) x FROM trades WHERE {OK} GROUP BY 1, 2, 3),
s AS (SELECT *, CAST(sum(x) OVER w AS BIGINT) s FROM t WINDOW w AS (PARTITION BY member_id, ticker ORDER BY d)),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY member_id, ticker ORDER BY d)) AS balance FROM s)
SELECT member_id, ticker, d AS transaction_date, balance FROM m QUALIFY row_number() OVER (PARTITION BY member_id, ticker ORDER BY d DESC) = 1""")
def w9(trades):
    daily = C.congress_events(trades).groupBy("member_id", "ticker", "transaction_date").agg(F.sum(F.when(F.col("direction") == "buy", F.col("amount_floor")).otherwise(-F.col("amount_floor"))).alias("x"))
    return W.latest_per(W.clamped_balance(daily, ["member_id", "ticker"], ["transaction_date"], "x", "balance"), ["member_id", "ticker"], [F.desc("transaction_date")]).drop("x")


@query("W10_fifo_lots", "insiders", sql=f"""
WITH t AS (SELECT filer_name, ticker, transaction_date d, transaction_code c, CAST(sum(shares) AS BIGINT) q FROM insiders WHERE {OK} GROUP BY 1, 2, 3, 4),
s AS (SELECT *, sum(CASE WHEN c = 'P' THEN q ELSE -q END) OVER (PARTITION BY filer_name, ticker ORDER BY d, c) s, sum(CASE WHEN c = 'P' THEN q ELSE 0 END) OVER (PARTITION BY filer_name, ticker ORDER BY d, c) cum,
 sum(CASE WHEN c = 'P' THEN q ELSE 0 END) OVER (PARTITION BY filer_name, ticker) total FROM t),
h AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY filer_name, ticker ORDER BY d, c)) held FROM s),
l AS (SELECT *, last_value(held) OVER (PARTITION BY filer_name, ticker ORDER BY d, c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) now FROM h)
SELECT filer_name, ticker, d AS transaction_date, CAST(least(q, greatest(0, cum - (total - now))) AS BIGINT) AS shares_left FROM l WHERE c = 'P' AND least(q, greatest(0, cum - (total - now))) > 0""")
def w10(insiders):
    rows = (insiders.withColumn("ticker", S.publishable_ticker(F.col("ticker"))).where("ticker is not null").groupBy("filer_name", "ticker", "transaction_date", "transaction_code")
            .agg(F.sum("shares").cast("long").alias("q")).withColumn("side", F.when(F.col("transaction_code") == "P", "buy").otherwise("sell")))
    return W.surviving_lots(rows, ["filer_name", "ticker"], ["transaction_date", "transaction_code"], "side", "q").select("filer_name", "ticker", "transaction_date", F.col("shares_left").cast("long").alias("shares_left"))


@query("W11_first_buy_flags", "trades", sql=f"""
WITH b AS (SELECT ticker, member_id, transaction_date d, doc_id, amount FROM trades WHERE {OK} AND direction = 'buy'), dd AS (SELECT ticker, d, count(*) n FROM b GROUP BY 1, 2),
p AS (SELECT ticker, d, coalesce(sum(n) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) prior FROM dd)
SELECT b.ticker, b.member_id, b.d AS transaction_date, b.doc_id, b.amount, CAST(p.prior AS BIGINT) AS prior_buys, p.prior = 0 AS is_first FROM b JOIN p ON b.ticker = p.ticker AND b.d = p.d""")
def w11(trades):
    buys = C.congress_events(trades).where("direction = 'buy'").select("ticker", "member_id", "transaction_date", "doc_id", "amount")
    return W.prior_counts(buys, ["ticker"], "transaction_date", "prior_buys").withColumn("is_first", F.col("prior_buys") == 0)


@query("W14_quota_selection", "trades", sql=f"""
WITH t AS (SELECT chamber || ':' || direction AS rule, ticker, member_id, doc_id, amount, row_number() OVER (PARTITION BY chamber || ':' || direction ORDER BY amount DESC, doc_id, ticker, member_id) g FROM trades WHERE {OK})
SELECT rule, ticker, member_id, doc_id, amount, g <= 8 AS reserved FROM t ORDER BY g <= 8 DESC, amount DESC, doc_id, ticker, member_id LIMIT 60""")
def w14(trades):
    rows = C.congress_events(trades).select(F.concat_ws(":", "chamber", "direction").alias("rule"), "ticker", "member_id", "doc_id", "amount")
    return W.quota_top(rows, "rule", [F.desc("amount"), F.asc("doc_id"), F.asc("ticker"), F.asc("member_id")], 8, 60)


@query("W_rank_functions", "trades", sql=f"""
WITH t AS (SELECT ticker, CAST(sum(amount) AS DECIMAL(20,2)) total, chamber FROM trades WHERE {OK} GROUP BY ticker, chamber)
SELECT ticker, chamber, total, CAST(rank() OVER w AS BIGINT) rnk, CAST(dense_rank() OVER w AS BIGINT) drnk, CAST(ntile(4) OVER w AS BIGINT) quart, lag(total) OVER w AS before, lead(total) OVER w AS after FROM t WINDOW w AS (PARTITION BY chamber ORDER BY total DESC, ticker)""")
def ranks(trades):
    w = Window.partitionBy("chamber").orderBy(F.desc("total"), "ticker")
    t = C.congress_events(trades).groupBy("ticker", "chamber").agg(F.sum("amount").cast("decimal(20,2)").alias("total"))
    return t.select("ticker", "chamber", "total", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("drnk"), F.ntile(4).over(w).cast("long").alias("quart"), F.lag("total").over(w).alias("before"), F.lead("total").over(w).alias("after"))


# --- joins ---

CHANGES = """k AS (SELECT fund_name, report_period, row_number() OVER (PARTITION BY fund_name ORDER BY report_period) k FROM (SELECT DISTINCT fund_name, report_period FROM holdings)),
n AS (SELECT h.fund_name, h.ticker, k.k, h.shares_held s FROM holdings h JOIN k ON h.fund_name = k.fund_name AND h.report_period = k.report_period),
q AS (SELECT coalesce(a.fund_name, b.fund_name) fund_name, coalesce(a.ticker, b.ticker) ticker, coalesce(a.k, b.k + 1) k, coalesce(a.s, 0) s, coalesce(b.s, 0) b FROM n a FULL JOIN n b ON a.fund_name = b.fund_name AND a.ticker = b.ticker AND a.k = b.k + 1),
changes AS (SELECT q.fund_name, q.ticker, k.report_period, q.s AS shares_held, q.s - q.b AS change_shares, CASE WHEN q.b > 0 THEN CAST(round(CAST((q.s - q.b) * 100 AS DECIMAL(30,10)) / q.b, 4) AS DECIMAL(18,4)) END AS change_percent FROM q JOIN k ON q.fund_name = k.fund_name AND q.k = k.k WHERE q.k > 1)"""
KIND = """CASE WHEN shares_held <= 0 AND change_shares < 0 THEN 'exit' WHEN shares_held > 0 AND change_shares > 0 AND (shares_held - change_shares <= 0 OR (shares_held - change_shares <= 100 AND (shares_held - change_shares) * 1000 <= shares_held)) THEN 'new'
 WHEN change_shares > 0 THEN 'increase' WHEN change_shares < 0 THEN 'decrease' ELSE 'hold' END"""


def _changes(holdings):
    c = R.period_changes(holdings, "fund_name", "ticker", "report_period", "shares_held")
    return c.withColumn("change_type", S.fund_change_type(F.col("shares_held"), F.col("change_shares"), F.col("change_percent")))


@query("J2_qoq_changes", "holdings", sql=f"WITH {CHANGES} SELECT fund_name, ticker, report_period, shares_held, change_shares, {KIND} AS change_type FROM changes")
def j2(holdings):
    return _changes(holdings).drop("change_percent")


@query("A17_change_kind_counts", "holdings", sql=f"WITH {CHANGES}, c AS (SELECT *, {KIND} AS t FROM changes) SELECT report_period, count(*) FILTER (WHERE t IN ('new', 'increase')) AS increased, count(*) FILTER (WHERE t IN ('exit', 'decrease')) AS decreased, count(*) FILTER (WHERE t = 'hold') AS neutral FROM c GROUP BY 1")
def a17(holdings):
    return _changes(holdings).groupBy("report_period").agg(F.count_if(F.col("change_type").isin("new", "increase")).alias("increased"), F.count_if(F.col("change_type").isin("exit", "decrease")).alias("decreased"), F.count_if(F.col("change_type") == "hold").alias("neutral"))


@query("J3_member_roles", "trades", "members", sql="SELECT t.chamber, m.state, m.party, count(*) AS n, count(DISTINCT t.member_id) AS members FROM trades t LEFT JOIN members m ON t.member_id = m.member_id AND m.active GROUP BY 1, 2, 3")
def j3(trades, members):
    active = members.where("active").select("member_id", "state", F.col("party").alias("m_party"))
    return trades.join(active, "member_id", "left").groupBy("chamber", "state", "m_party").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("member_id").alias("members")).withColumnRenamed("m_party", "party")


@query("J4_as_of_prices", "trades", "prices", sql=f"""
WITH e AS (SELECT DISTINCT member_id, ticker, published_date FROM trades WHERE {OK})
SELECT e.member_id, e.ticker, e.published_date, p.price_date, p.price FROM e ASOF LEFT JOIN prices p ON e.ticker = p.ticker AND e.published_date >= p.price_date""")
def j4(trades, prices):
    return R.as_of_prices(C.congress_events(trades).select("member_id", "ticker", "published_date").distinct(), prices, ["ticker"], "published_date", "price_date", "price")


@query("J5_prior_buy_history", "trades", sql=f"""
WITH b AS (SELECT ticker, member_id, transaction_date d, count(*) n FROM trades WHERE {OK} AND direction = 'buy' GROUP BY 1, 2, 3)
SELECT ticker, member_id, d AS transaction_date, CAST(coalesce((SELECT sum(x.n) FROM b x WHERE x.ticker = b.ticker AND x.member_id = b.member_id AND x.d < b.d), 0) AS BIGINT) AS prior_own FROM b""")
def j5(trades):
    buys = C.congress_events(trades).where("direction = 'buy'").select("ticker", "member_id", "transaction_date")
    return W.prior_counts(buys, ["ticker", "member_id"], "transaction_date", "prior_own").distinct()


@query("J7_cross_source_buys", "trades", "insiders", "holdings", sql=f"""
WITH RECURSIVE {CHANGES}, f AS (SELECT c.ticker, c.fund_name, c.report_period + 45 AS fd FROM changes c WHERE {KIND} IN ('new', 'increase')),
e AS (SELECT ticker, published_date d, 'congress' fam, member_id actor FROM trades WHERE {OK} AND direction = 'buy' UNION ALL SELECT ticker, published_date, 'insider', filer_name FROM insiders WHERE {OK} AND transaction_code = 'P'),
dd AS (SELECT DISTINCT ticker, d FROM e),
s AS (SELECT ticker, min(d) AS ws FROM dd GROUP BY 1 UNION ALL SELECT s.ticker, (SELECT min(dd.d) FROM dd WHERE dd.ticker = s.ticker AND dd.d >= s.ws + 30) FROM s WHERE s.ws IS NOT NULL),
w AS (SELECT s.ticker, s.ws, count(DISTINCT CASE WHEN fam = 'congress' THEN actor END) congress, count(DISTINCT CASE WHEN fam = 'insider' THEN actor END) insider, max(d) AS window_end FROM s JOIN e ON e.ticker = s.ticker AND e.d BETWEEN s.ws AND s.ws + 29 WHERE s.ws IS NOT NULL GROUP BY 1, 2),
x AS (SELECT w.*, (SELECT count(DISTINCT f.fund_name) FROM f WHERE f.ticker = w.ticker AND f.fd <= w.ws + 29 AND f.fd > w.ws + 29 - 120) funds FROM w)
SELECT ticker, ws AS window_start, congress, insider, window_end, funds, 'cross-source::' || ticker || '::buy::30d::120fd::' || ws AS event_id FROM x
WHERE (congress > 0)::INT + (insider > 0)::INT + (funds > 0)::INT >= 2 AND ((congress > 0 AND insider > 0) OR funds >= 2)""")
def j7(trades, insiders, holdings):
    funds = _changes(holdings).withColumn("published_date", F.date_add("report_period", 45))
    return C.cross_source(trades, insiders, funds, "buy")


@query("J8_two_key_fallback", "insiders", sql="""
WITH a AS (SELECT source_url, max(relation) r FROM insiders WHERE transaction_code = 'P' GROUP BY 1), b AS (SELECT filer_name, ticker, max(relation) r FROM insiders WHERE ticker IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(a.r, b.r, 'none') AS role, CASE WHEN a.r IS NOT NULL THEN 'url' WHEN b.r IS NOT NULL THEN 'identity' ELSE 'none' END AS matched_by, count(*) AS n FROM insiders i LEFT JOIN a ON i.source_url = a.source_url LEFT JOIN b ON i.filer_name = b.filer_name AND i.ticker = b.ticker GROUP BY 1, 2""")
def j8(insiders):
    a = insiders.where("transaction_code = 'P'").groupBy("source_url").agg(F.max("relation").alias("ra"))
    b = insiders.where("ticker is not null").groupBy("filer_name", "ticker").agg(F.max("relation").alias("rb"))
    rows = insiders.join(a, "source_url", "left").join(b, ["filer_name", "ticker"], "left")
    return rows.groupBy(F.coalesce("ra", "rb", F.lit("none")).alias("role"), F.when(F.col("ra").isNotNull(), "url").when(F.col("rb").isNotNull(), "identity").otherwise("none").alias("matched_by")).agg(F.count(F.lit(1)).alias("n"))


@query("J12_event_graph_leaves", "conversations", sql="""
WITH RECURSIVE e AS (SELECT 'c' || conv_id AS parent, 'g' || conv_id || '-' || role AS child FROM conversations UNION SELECT 'g' || conv_id || '-' || role, 't' || conv_id || '-' || turn FROM conversations),
r AS (SELECT DISTINCT parent AS root, parent AS node FROM e WHERE parent LIKE 'c%' UNION SELECT r.root, e.child FROM r JOIN e ON r.node = e.parent)
SELECT root, node AS leaf FROM r WHERE node NOT IN (SELECT parent FROM e)""")
def j12(conversations):
    edges = (conversations.select(F.concat(F.lit("c"), "conv_id").alias("parent"), F.concat(F.lit("g"), "conv_id", F.lit("-"), "role").alias("child"))
             .union(conversations.select(F.concat(F.lit("g"), "conv_id", F.lit("-"), "role"), F.concat(F.lit("t"), "conv_id", F.lit("-"), "turn"))).distinct())
    return G.leaves(edges, conversations.select(F.concat(F.lit("c"), "conv_id").alias("root"), F.concat(F.lit("c"), "conv_id").alias("node")))


@query("J13_unfiled_periods", "holdings", sql="""
WITH p AS (SELECT DISTINCT report_period FROM holdings), f AS (SELECT DISTINCT fund_name FROM holdings)
SELECT fund_name, report_period FROM f CROSS JOIN p WHERE NOT EXISTS (SELECT 1 FROM holdings h WHERE h.fund_name = f.fund_name AND h.report_period = p.report_period)""")
def j13(holdings):
    periods = holdings.select("report_period").distinct()
    span = holdings.select("fund_name").distinct().join(periods.agg(F.collect_set("report_period").alias("ps")), how="cross").select("fund_name", F.explode("ps").alias("report_period"))
    return span.join(holdings.select("fund_name", "report_period"), ["fund_name", "report_period"], "left_anti")


@query("J15_members_with_purchases", "members", "trades", sql="SELECT member_id, state, party FROM members WHERE member_id IN (SELECT member_id FROM trades WHERE direction = 'buy' AND amount_floor >= 100001)")
def j15(members, trades):
    return members.join(trades.where("direction = 'buy' and amount_floor >= 100001").select("member_id"), "member_id", "left_semi").select("member_id", "state", "party")


@query("J16_tiered_reconciliation", "trades", "insiders", sql=f"""
WITH s AS (SELECT ticker, transaction_date d, amount FROM insiders WHERE ticker IS NOT NULL),
t AS (SELECT *, EXISTS (SELECT 1 FROM s WHERE s.ticker = t.ticker AND s.d = t.transaction_date AND s.amount = t.amount) k1, EXISTS (SELECT 1 FROM s WHERE s.ticker = t.ticker AND s.d = t.published_date) k2, EXISTS (SELECT 1 FROM s WHERE s.ticker = t.ticker) k3 FROM trades t)
SELECT CASE WHEN k1 THEN 'exact' WHEN k2 THEN 'date' WHEN k3 THEN 'loose' WHEN published_date >= {AT} - 365 THEN 'recent_gap' ELSE 'old_gap' END AS status, count(*) AS n FROM t GROUP BY 1""")
def j16(trades, insiders):
    s = insiders.where("ticker is not null")
    keys = [s.select("ticker", F.col("transaction_date"), "amount").distinct().withColumn("k1", F.lit(True)), s.select("ticker", F.col("transaction_date").alias("published_date")).distinct().withColumn("k2", F.lit(True)), s.select("ticker").distinct().withColumn("k3", F.lit(True))]
    t = trades.join(keys[0], ["ticker", "transaction_date", "amount"], "left").join(keys[1], ["ticker", "published_date"], "left").join(keys[2], "ticker", "left")
    status = F.when(F.col("k1"), "exact").when(F.col("k2"), "date").when(F.col("k3"), "loose").when(F.col("published_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 365), "recent_gap").otherwise("old_gap")
    return t.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("J21_multiset_diff", "trades", "insiders", sql="""
WITH l AS (SELECT ticker, transaction_date d, count(*) n FROM trades WHERE direction = 'sell' GROUP BY 1, 2), r AS (SELECT ticker, transaction_date d, count(*) n FROM insiders WHERE amount > 20000 GROUP BY 1, 2)
SELECT coalesce(l.ticker, r.ticker) AS ticker, coalesce(l.d, r.d) AS transaction_date, greatest(coalesce(l.n, 0) - coalesce(r.n, 0), 0) AS missing, greatest(coalesce(r.n, 0) - coalesce(l.n, 0), 0) AS extra
FROM l FULL JOIN r ON l.ticker IS NOT DISTINCT FROM r.ticker AND l.d IS NOT DISTINCT FROM r.d WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""")
def j21(trades, insiders):
    return R.multiset_diff(trades.where("direction = 'sell'"), insiders.where("amount > 20000"), ["ticker", "transaction_date"])
