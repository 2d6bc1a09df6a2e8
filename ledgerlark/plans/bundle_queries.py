"""What pages put together: the overview of every ticker, the feed of clusters, and flags that two readers set differently."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.operators import clusters as C
from ledgerlark.operators import windows as W
from ledgerlark.plans.catalog import query
from ledgerlark.plans.core import OK
from ledgerlark.plans.signal_queries import STORY_RULES

c = F.col
DAYS = "CASE actors % 3 WHEN 0 THEN 7 WHEN 1 THEN 10 ELSE 30 END"


@query("C14_ticker_overview", "companies", "trades", "insiders", "holdings", "prices", sql=f"""
WITH t AS (SELECT * FROM trades WHERE {OK}), n AS (SELECT * FROM insiders WHERE {OK}), pt AS (SELECT ticker, count(*) AS n, max(greatest(transaction_date, published_date)) AS d FROM t GROUP BY 1), it AS (SELECT ticker, count(*) AS n, max(greatest(transaction_date, published_date)) AS d FROM n GROUP BY 1),
b AS (SELECT member_id, ticker, transaction_date d, CAST(sum(CASE WHEN direction = 'buy' THEN amount_floor ELSE -amount_floor END) AS BIGINT) x FROM t GROUP BY 1, 2, 3), s AS (SELECT *, sum(x) OVER (PARTITION BY member_id, ticker ORDER BY d) s FROM b),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY member_id, ticker ORDER BY d)) AS balance FROM s), h AS (SELECT member_id, ticker, balance FROM m QUALIFY row_number() OVER (PARTITION BY member_id, ticker ORDER BY d DESC) = 1), ph AS (SELECT ticker, count(*) AS n FROM h WHERE balance > 0 GROUP BY 1),
fl AS (SELECT fund_name, max(report_period) AS p FROM holdings GROUP BY 1), fh AS (SELECT ticker, count(DISTINCT fund_name) AS n FROM holdings JOIN fl USING (fund_name) WHERE report_period = p AND shares_held > 0 GROUP BY 1), ft AS (SELECT ticker, max(greatest(report_period, published_date)) AS d FROM holdings GROUP BY 1),
pr AS (SELECT ticker, max_by(price, price_date) AS price, max(price_date) AS price_date FROM prices GROUP BY 1), k AS (SELECT ticker FROM companies UNION SELECT ticker FROM pt UNION SELECT ticker FROM it UNION SELECT ticker FROM ft)
SELECT k.ticker, coalesce(co.name, k.ticker) AS company_name, co.sector, pr.price AS current_price, pr.price_date AS price_as_of, greatest(pt.d, it.d, ft.d) AS latest_activity, (pt.n IS NOT NULL)::INT + (it.n IS NOT NULL)::INT + (ft.d IS NOT NULL)::INT AS source_count,
 coalesce(ph.n, 0) AS politician_holders, coalesce(pt.n, 0) AS politician_transactions, coalesce(it.n, 0) AS insider_transactions, coalesce(fh.n, 0) AS fund_holders
FROM k LEFT JOIN companies co USING (ticker) LEFT JOIN pt USING (ticker) LEFT JOIN it USING (ticker) LEFT JOIN ft USING (ticker) LEFT JOIN ph USING (ticker) LEFT JOIN fh USING (ticker) LEFT JOIN pr USING (ticker) WHERE k.ticker NOT IN ('US-TREAS', 'N/A')""")
def overview(companies, trades, insiders, holdings, prices):
    """One row a ticker: what each source knows of it. Every source is reduced to a row a ticker before anything is joined."""
    newest = lambda *dates: F.max(F.greatest(*dates)).alias("d")
    t = C.congress_events(trades)
    i = insiders.withColumn("ticker", S.publishable_ticker(c("ticker"))).where("ticker is not null")
    daily = t.groupBy("member_id", "ticker", "transaction_date").agg(F.sum(F.when(c("direction") == "buy", c("amount_floor")).otherwise(-c("amount_floor"))).alias("x"))
    held = W.latest_per(W.clamped_balance(daily, ["member_id", "ticker"], ["transaction_date"], "x", "balance"), ["member_id", "ticker"], [F.desc("transaction_date")]).where("balance > 0")
    reports = holdings.groupBy("fund_name").agg(F.max("report_period").alias("report_period"))
    active = holdings.where("shares_held > 0").join(reports, ["fund_name", "report_period"], "left_semi")
    parts = {
        "p": t.groupBy("ticker").agg(F.count("*").alias("politician_transactions"), newest("transaction_date", "published_date")),
        "i": i.groupBy("ticker").agg(F.count("*").alias("insider_transactions"), newest("transaction_date", "published_date")),
        "f": holdings.groupBy("ticker").agg(newest("report_period", "published_date")),
        "h": held.groupBy("ticker").agg(F.count("*").alias("politician_holders")),
        "a": active.groupBy("ticker").agg(F.count_distinct("fund_name").alias("fund_holders")),
        "r": prices.groupBy("ticker").agg(F.max_by("price", "price_date").alias("current_price"), F.max("price_date").alias("price_as_of")),
    }
    out = companies.select("ticker", "name", "sector")
    for name in ("p", "i", "f"):
        out = out.join(parts[name].withColumnRenamed("d", f"d_{name}"), "ticker", "full")
    for name in ("h", "a", "r"):
        out = out.join(parts[name], "ticker", "left")
    none = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    sources = sum(c(f"d_{n}").isNotNull().cast("int") for n in ("p", "i", "f"))
    return out.where(~c("ticker").isin("US-TREAS", "N/A")).select(
        "ticker", F.coalesce("name", "ticker").alias("company_name"), "sector", "current_price", "price_as_of", F.greatest("d_p", "d_i", "d_f").alias("latest_activity"), sources.alias("source_count"),
        *map(none, ("politician_holders", "politician_transactions", "insider_transactions", "fund_holders")))


@query("C17_cluster_feed", "feed_events", sql=f"""
WITH RECURSIVE st AS (SELECT *, {DAYS} AS days, row_number() OVER (PARTITION BY signal_type, ticker, direction ORDER BY published_date, event_id) i FROM feed_events WHERE signal_type IN {STORY_RULES} AND {OK} AND actors >= 3 AND importance >= 0.7 AND value >= 50001),
r AS (SELECT signal_type, ticker, direction, i, published_date AS ws, days AS n FROM st WHERE i = 1 UNION ALL
 SELECT st.signal_type, st.ticker, st.direction, st.i, CASE WHEN st.published_date - r.ws >= r.n THEN st.published_date ELSE r.ws END, CASE WHEN st.published_date - r.ws >= r.n THEN st.days ELSE r.n END FROM r JOIN st ON st.signal_type = r.signal_type AND st.ticker = r.ticker AND st.direction = r.direction AND st.i = r.i + 1),
b AS (SELECT st.* FROM r JOIN st USING (signal_type, ticker, direction, i) QUALIFY row_number() OVER (PARTITION BY r.signal_type, r.ticker, r.direction, r.ws ORDER BY CASE WHEN r.signal_type = 'cross_source_accumulation' THEN st.group_rows END DESC, st.actors DESC, st.importance DESC, st.value DESC, st.published_date DESC, st.event_id) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY signal_type ORDER BY importance DESC, actors DESC, published_date DESC, event_id) <= 8 AS reserved FROM b)
SELECT event_id, signal_type, ticker, direction, published_date, reserved, actors || CASE signal_type WHEN 'insider_cluster' THEN ' insiders ' WHEN 'politician_cluster' THEN ' members ' ELSE ' actors ' END || CASE direction WHEN 'buy' THEN 'bought ' ELSE 'sold ' END || ticker AS label
FROM q ORDER BY reserved DESC, importance DESC, actors DESC, published_date DESC, event_id LIMIT 60""")
def cluster_feed(feed_events):
    """Stored cluster stories that pass the gate, the strongest of each window, up to eight of each rule first, the rest by rank, with their labels."""
    keys = ["signal_type", "ticker", "direction"]
    gated = feed_events.withColumn("ticker", S.publishable_ticker(c("ticker"))).where(f"signal_type in {STORY_RULES} and ticker is not null and actors >= 3 and importance >= 0.7 and value >= 50001").withColumn("days", F.expr(DAYS))
    rows = W.story_windows(gated, keys, "published_date", "days", "event_id")
    mixed = F.when(c("signal_type") == "cross_source_accumulation", c("group_rows"))
    best = W.latest_per(rows, [*keys, "window_start"], [F.desc(mixed), F.desc("actors"), F.desc("importance"), F.desc("value"), F.desc("published_date"), F.asc("event_id")])
    shown = W.quota_top(best, "signal_type", [F.desc("importance"), F.desc("actors"), F.desc("published_date"), F.asc("event_id")], 8, 60)
    who = F.when(c("signal_type") == "insider_cluster", " insiders ").when(c("signal_type") == "politician_cluster", " members ").otherwise(" actors ")
    label = F.concat(c("actors").cast("string"), who, F.when(c("direction") == "buy", "bought ").otherwise("sold "), "ticker")
    return shown.select("event_id", *keys, "published_date", "reserved", label.alias("label"))


@query("Q2_calendar_legacy_flag", "trades", sql=f"""
SELECT published_date AS day, count(*) AS clusters_calendar, count(*) FILTER (WHERE NOT (chamber = 'House' AND published_date < DATE '1999-01-01')) AS buying_calendar FROM trades WHERE {OK} AND direction = 'buy' GROUP BY 1""")
def legacy(trades):
    """The calendar of clusters counts legacy rows of the House, that of purchases leaves them out: one plan, a flag for each reader."""
    old = (c("chamber") == "House") & (c("published_date") < "1999-01-01")
    return C.congress_events(trades).where("direction = 'buy'").groupBy(c("published_date").alias("day")).agg(F.count("*").alias("clusters_calendar"), F.count_if(~old).alias("buying_calendar"))


@query("Q9_sides_with_lower_bound", "feed_events", sql="""
SELECT direction, count(*) AS n, count(*) FILTER (WHERE direction = 'buy' AND value > 0) AS with_bound, count(*) FILTER (WHERE direction = 'buy' AND value > 0 AND gain_pct >= 50) AS milestones FROM feed_events WHERE signal_type = 'cross_source_accumulation' GROUP BY 1""")
def bounds(feed_events):
    """Only accumulations carry a combined lower bound, so clusters of sales never reach a milestone of gains."""
    bound = F.when(c("direction") == "buy", c("value"))
    rows = feed_events.where("signal_type = 'cross_source_accumulation'").withColumn("bound", bound)
    return rows.groupBy("direction").agg(F.count("*").alias("n"), F.count_if(c("bound") > 0).alias("with_bound"), F.count_if((c("bound") > 0) & (c("gain_pct") >= 50)).alias("milestones"))


@query("Q16_follow_keys_of_mixed_clusters", "feed_events", sql="""
SELECT event_id, array_to_string(list_sort(list_filter(['politician:' || lower(member_id), 'insider:' || regexp_replace(lower(actor_name), '[^a-z0-9]', '', 'g'), CASE WHEN includes_fund THEN 'fund:' || regexp_replace(lower(actor_name), '[^a-z0-9]', '', 'g') END], lambda x: x IS NOT NULL)), ',') AS delivery,
 array_to_string(list_sort(list_filter(['politician:' || lower(member_id), 'insider:' || regexp_replace(lower(actor_name), '[^a-z0-9]', '', 'g')], lambda x: x IS NOT NULL)), ',') AS preview FROM feed_events WHERE signal_type = 'cross_source_accumulation'""")
def follow_keys(feed_events):
    """Deliveries match a mixed cluster by its funds too, the account's preview does not."""
    name = S.actor_key(c("actor_name"))
    keys = [F.concat(F.lit("politician:"), F.lower("member_id")), F.when(c("actor_name").isNotNull(), F.concat(F.lit("insider:"), name))]
    fund = F.when(c("includes_fund") & c("actor_name").isNotNull(), F.concat(F.lit("fund:"), name))
    listed = lambda k: F.array_join(F.array_sort(F.filter(F.array(*k), lambda x: x.isNotNull())), ",")
    return feed_events.where("signal_type = 'cross_source_accumulation'").select("event_id", listed([*keys, fund]).alias("delivery"), listed(keys).alias("preview"))


@query("U5_counters", "stored", "incoming", sql="""
WITH i AS (SELECT grp, count(*) AS n FROM incoming GROUP BY 1), s AS (SELECT grp, CAST(sum(v) AS BIGINT) AS n FROM stored GROUP BY 1) SELECT coalesce(s.grp, i.grp) AS grp, coalesce(s.n, 0) + coalesce(i.n, 0) AS n FROM s FULL JOIN i ON s.grp = i.grp""")
def counters(stored, incoming):
    """Counters after a batch of increments: increments are summed by counter before they meet what is stored, and a new counter starts at zero."""
    held = stored.groupBy("grp").agg(F.sum("v").cast("long").alias("n"))
    return held.unionByName(incoming.groupBy("grp").agg(F.count("*").alias("n"))).groupBy("grp").agg(F.sum("n").alias("n"))


@query("X7_reference_dates", "feed_events", sql="""
SELECT event_id, coalesce(CASE WHEN change_pct % 5 = 0 THEN published_date - 5 END, CASE WHEN change_pct % 5 = 1 THEN published_date - 4 END, CASE WHEN change_pct % 5 = 2 THEN published_date - 3 END, CASE WHEN change_pct % 5 = 3 THEN published_date - 2 END, published_date) AS reference_date,
 row_number() OVER (PARTITION BY ticker, actor_name ORDER BY coalesce(CASE WHEN change_pct % 5 = 0 THEN published_date - 5 END, CASE WHEN change_pct % 5 = 1 THEN published_date - 4 END, CASE WHEN change_pct % 5 = 2 THEN published_date - 3 END, CASE WHEN change_pct % 5 = 3 THEN published_date - 2 END, published_date), event_id) AS nth FROM feed_events""")
def reference_dates(feed_events):
    """The first of five date fields of an event that is filled (as texts in its payload), and its place in its actor's history."""
    fields = [F.when(c("change_pct") % 5 == k, F.date_sub("published_date", 5 - k).cast("string")).otherwise("  " if k % 2 else None) for k in range(4)]
    date = F.coalesce(*(F.try_to_date(S.blank_to_null(f)) for f in fields), "published_date")
    nth = F.row_number().over(Window.partitionBy("ticker", "actor_name").orderBy("reference_date", "event_id"))
    return feed_events.withColumn("reference_date", date).select("event_id", "reference_date", nth.cast("long").alias("nth"))
