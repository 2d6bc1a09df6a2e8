"""Aggregations, calendars, fund and profile summaries, deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import calendar as K
from ledgerlark.functions import scalars as S
from ledgerlark.operators import clusters as C
from ledgerlark.operators import relations as R
from ledgerlark.plans.catalog import query
from ledgerlark.plans.core import AT, CHANGES, KIND, OK, _changes
from ledgerlark.plans.filters import equity_purchase
from ledgerlark.sources.adapters import AS_OF
from ledgerlark.sources.workspace import staged

c = F.col


@query("A1_fund_period_summary", "holdings", sql="SELECT fund_name, report_period, max(published_date) AS last_filed, sum(value_held) AS total_value, count(*) AS holding_count FROM holdings WHERE shares_held > 0 GROUP BY 1, 2")
def a1(holdings):
    return holdings.where("shares_held > 0").groupBy("fund_name", "report_period").agg(F.max("published_date").alias("last_filed"), F.sum("value_held").alias("total_value"), F.count("*").alias("holding_count"))


@query("A2_A3_guards", "trades", sql="""
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE direction = 'sell') AS sells, count(*) FILTER (WHERE amount_floor >= 50001) AS large FROM trades GROUP BY 1 HAVING count(*) > 1""")
def a2(trades):
    return trades.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(c("direction") == "sell").alias("sells"), F.count_if(c("amount_floor") >= 50001).alias("large")).where("n > 1")


@query("A4_A5_filing_rollup", "holdings", sql="""
SELECT fund_name, report_period, published_date, count(*) AS holding_count, sum(value_held) AS total_value, array_to_string(list_sort(list(DISTINCT ticker))[1:20], ',') AS tickers FROM holdings GROUP BY 1, 2, 3""")
def a4(holdings):
    return holdings.groupBy("fund_name", "report_period", "published_date").agg(F.count("*").alias("holding_count"), F.sum("value_held").alias("total_value"), F.array_join(F.slice(F.array_sort(F.collect_set("ticker")), 1, 20), ",").alias("tickers"))


GROUPS = """g AS (SELECT regexp_replace(doc_id, '-[0-9]+$', '') AS filing, ticker, member_id, direction, count(*) AS row_count, CAST(sum(amount_floor) AS BIGINT) AS combined_floor, min(transaction_date) AS first_trade, max(transaction_date) AS last_trade,
 max(published_date) AS published_date, array_to_string(list_sort(list(DISTINCT amount_range)), '; ') AS ranges FROM trades WHERE ticker IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query("A6_filing_groups", "trades", sql=f"WITH {GROUPS} SELECT * FROM g")
def a6(trades):
    return C.filing_groups(trades)


@query("A7_filing_summaries", "trades", sql=f"""
WITH {GROUPS} SELECT filing, member_id, CAST(sum(row_count) AS BIGINT) AS trade_count, count(DISTINCT ticker) AS ticker_count, array_to_string(list_sort(list(DISTINCT ticker))[1:10], ',') AS tickers, max(published_date) AS published_date FROM g GROUP BY 1, 2 HAVING sum(row_count) > 1""")
def a7(trades):
    return C.filing_summaries(C.filing_groups(trades))


WINDOWS = "(VALUES ('7d', 7), ('30d', 30), ('90d', 90), ('1y', 365), ('all', 100000)) w(key, days)"


@query("A8_insider_windows", "insiders", sql=f"""
WITH s AS (SELECT ticker, key, count(*) AS n, sum(CASE transaction_code WHEN 'P' THEN amount ELSE 0 END) AS buy_value, sum(CASE transaction_code WHEN 'S' THEN amount ELSE 0 END) AS sell_value, count(*) FILTER (WHERE transaction_code = 'P') AS buys FROM insiders, {WINDOWS}
 WHERE ticker IS NOT NULL AND transaction_date >= {AT} - days GROUP BY 1, 2)
SELECT ticker, key, n, buy_value, sell_value, buys, CASE WHEN (buy_value * 2 - (buy_value + sell_value)) * 100 > (buy_value + sell_value) * 15 THEN 'bullish' WHEN (buy_value * 2 - (buy_value + sell_value)) * 100 < (buy_value + sell_value) * -15 THEN 'bearish' ELSE 'neutral' END AS tone FROM s""")
def a8(insiders):
    spans = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(d).alias("days")) for k, d in (("7d", 7), ("30d", 30), ("90d", 90), ("1y", 365), ("all", 100_000)))),
                     lambda w: F.datediff(F.lit(AS_OF).cast("date"), c("transaction_date")) <= w["days"])
    rows = insiders.where("ticker is not null").withColumn("w", F.explode(spans))
    value = lambda code: F.sum(F.when(c("transaction_code") == code, c("amount")).otherwise(0))
    s = rows.groupBy("ticker", c("w.key").alias("key")).agg(F.count("*").alias("n"), value("P").cast("decimal(38,2)").alias("buy_value"), value("S").cast("decimal(38,2)").alias("sell_value"), F.count_if(c("transaction_code") == "P").alias("buys"))
    total, lean = c("buy_value") + c("sell_value"), c("buy_value") - c("sell_value")
    return s.withColumn("tone", F.when(lean * 100 > total * 15, "bullish").when(lean * 100 < total * -15, "bearish").otherwise("neutral"))


PURCHASES = f"""u AS (SELECT ticker, member_id, transaction_date, published_date, amount_floor, amount_range, asset_name FROM trades WHERE {OK} AND direction = 'buy' AND coalesce(asset_type, '') <> 'Municipal Security'
 QUALIFY row_number() OVER (PARTITION BY ticker, member_id, transaction_date, amount_range ORDER BY published_date, asset_name, amount_floor) = 1)"""


def _purchases(trades):
    """Equity purchases, one row an economic trade."""
    rows = C.congress_events(trades).where((c("direction") == "buy") & equity_purchase(c("asset_type"), c("asset_name")))
    return R.first_per(rows, ["ticker", "member_id", "transaction_date", "amount_range"], [F.asc("published_date"), F.asc("asset_name"), F.asc("amount_floor")])


@query("A9_accumulation_ranking", "trades", sql=f"""
WITH {PURCHASES}, n AS (SELECT ticker, asset_name, row_number() OVER (PARTITION BY ticker ORDER BY count(*) DESC, asset_name) r FROM u GROUP BY 1, 2),
g AS (SELECT ticker, count(DISTINCT member_id) AS actors, count(*) AS trades_n, CAST(sum(amount_floor) AS BIGINT) AS amount_floor, max(CASE WHEN transaction_date <= published_date THEN transaction_date END) AS latest_trade, max(published_date) AS latest_disclosure FROM u GROUP BY 1)
SELECT g.*, n.asset_name AS company, row_number() OVER (ORDER BY amount_floor DESC, actors DESC, trades_n DESC, latest_disclosure DESC, g.ticker) AS place FROM g JOIN n ON g.ticker = n.ticker AND r = 1""")
def a9(trades):
    u = _purchases(trades)
    names = R.first_per(u.groupBy("ticker", "asset_name").agg(F.count("*").alias("k")), ["ticker"], [F.desc("k"), F.asc("asset_name")]).select("ticker", c("asset_name").alias("company"))
    g = u.groupBy("ticker").agg(F.count_distinct("member_id").alias("actors"), F.count("*").alias("trades_n"), F.sum("amount_floor").alias("amount_floor"),
                                F.max(S.calendar_transaction_date(c("transaction_date"), c("published_date"))).alias("latest_trade"), F.max("published_date").alias("latest_disclosure"))
    place = F.row_number().over(Window.orderBy(F.desc("amount_floor"), F.desc("actors"), F.desc("trades_n"), F.desc("latest_disclosure"), "ticker"))  # one row a ticker
    return g.join(names, "ticker").withColumn("place", place.cast("long"))


@query("A10_calendar_rollup", "trades", sql=f"""
WITH {PURCHASES}, t AS (SELECT ticker, member_id, amount_floor, transaction_date AS day, CAST(date_trunc('week', transaction_date) AS DATE) AS week, CAST(date_trunc('month', transaction_date) AS DATE) AS month FROM u WHERE transaction_date <= published_date)
SELECT day, week, month, ticker, count(DISTINCT member_id) AS actors, count(DISTINCT ticker) AS companies, count(*) AS n, CAST(sum(amount_floor) AS BIGINT) AS amount_floor FROM t GROUP BY GROUPING SETS ((day), (day, ticker), (week), (month))""")
def a10(trades):
    t = _purchases(trades).where("transaction_date <= published_date").select("ticker", "member_id", "amount_floor", c("transaction_date").alias("day"), S.week_start(c("transaction_date")).alias("week"), F.trunc("transaction_date", "month").alias("month"), c("ticker").alias("company"))
    rows = staged(t)  # trades are joined once, and each level moves only what it counts
    n, floor = F.count("*").alias("n"), F.sum("amount_floor").alias("amount_floor")

    def level(*kept):
        """Members are counted where they are dealt to, so that a level leaves one row a key and partition to add up."""
        each = R.dealt(rows.select(*kept, "member_id", "amount_floor"), "member_id").groupBy(*kept, "member_id").agg(n, floor)
        people = each.groupBy(*kept).agg(F.count("member_id").alias("actors"), F.sum("n").alias("n"), F.sum("amount_floor").alias("amount_floor"))
        companies = rows.groupBy(*kept).agg(F.count_distinct("company").alias("companies"))
        return people.join(companies, list(kept)).select(*((c(k) if k in kept else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in ("day", "week", "month", "ticker")), "actors", "companies", "n", "amount_floor")

    return level("day").unionByName(level("day", "ticker")).unionByName(level("week")).unionByName(level("month"))


@query("A11_profile_summary", "trades", sql="""
SELECT member_id, CAST(year(transaction_date) AS INT) AS year, count(*) AS n, count(*) FILTER (WHERE direction = 'buy') AS buys, CAST(sum(CASE direction WHEN 'buy' THEN amount_floor ELSE 0 END) AS BIGINT) AS bought, CAST(sum(CASE direction WHEN 'sell' THEN amount_floor ELSE 0 END) AS BIGINT) AS sold,
 min(transaction_date) AS first, max(transaction_date) AS last FROM trades GROUP BY GROUPING SETS ((member_id), (member_id, year(transaction_date)))""")
def a11(trades):
    t = trades.withColumn("year", F.year("transaction_date"))
    flow = lambda d: F.sum(F.when(c("direction") == d, c("amount_floor")).otherwise(0)).cast("long")
    return t.groupingSets([[c("member_id")], [c("member_id"), c("year")]], "member_id", "year").agg(F.count("*").alias("n"), F.count_if(c("direction") == "buy").alias("buys"), flow("buy").alias("bought"), flow("sell").alias("sold"),
                                                                                               F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last"))


@query("A11_net_holdings", "trades", sql="""
SELECT member_id, CASE WHEN ticker IS NOT NULL THEN 'ticker:' || lower(ticker) ELSE 'asset:' || asset_name END AS holding, CAST(sum(CASE direction WHEN 'buy' THEN amount_floor ELSE -amount_floor END) AS BIGINT) AS net, count(*) AS n FROM trades GROUP BY 1, 2 HAVING sum(CASE direction WHEN 'buy' THEN amount_floor ELSE -amount_floor END) > 0""")
def a11b(trades):
    key = F.coalesce(F.concat(F.lit("ticker:"), F.lower(S.blank_to_null(c("ticker")))), F.concat(F.lit("asset:"), F.lower(S.blank_to_null(c("asset_name")))))
    return trades.groupBy("member_id", key.alias("holding")).agg(F.sum(F.when(c("direction") == "buy", c("amount_floor")).otherwise(-c("amount_floor"))).alias("net"), F.count("*").alias("n")).where("net > 0")


@query("A12_month_timeline", "trades", sql=f"""
WITH m AS (SELECT CAST(date_trunc('month', {AT}) - to_months(CAST(k AS INT)) AS DATE) AS month FROM range(0, 12) r(k)), p AS (SELECT DISTINCT chamber FROM trades)
SELECT p.chamber, m.month, count(t.member_id) AS n, CAST(coalesce(sum(t.amount_floor), 0) AS BIGINT) AS amount_floor FROM m CROSS JOIN p LEFT JOIN trades t ON t.chamber = p.chamber AND t.transaction_date <= {AT} AND CAST(date_trunc('month', t.transaction_date) AS DATE) = m.month GROUP BY 1, 2""")
def a12(trades):
    first = F.trunc(F.lit(AS_OF).cast("date"), "month")
    grid = trades.select("chamber").distinct().withColumn("month", F.explode(F.sequence(F.add_months(first, -11), first, F.expr("interval 1 month"))))
    seen = trades.where(c("transaction_date") <= AS_OF).groupBy("chamber", F.trunc("transaction_date", "month").alias("month")).agg(F.count("*").alias("n"), F.sum("amount_floor").alias("amount_floor"))
    return grid.join(seen, ["chamber", "month"], "left").select("chamber", "month", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount_floor", F.lit(0)).cast("long").alias("amount_floor"))


@query("A13_weighted_returns", "trades", "prices", sql=f"""
WITH b AS (SELECT member_id, ticker, transaction_date, amount_floor FROM trades WHERE {OK} AND direction = 'buy' AND transaction_date BETWEEN {AT} - 365 AND {AT}), e AS (SELECT b.*, p.price FROM b ASOF JOIN prices p ON b.ticker = p.ticker AND b.transaction_date >= p.price_date),
l AS (SELECT ticker, max_by(price, price_date) AS now FROM prices WHERE price_date <= {AT} GROUP BY 1), r AS (SELECT member_id, amount_floor, CAST(floor((now - price) * 10000 / price) AS BIGINT) AS bp FROM e JOIN l USING (ticker) WHERE price > 0)
SELECT member_id, CAST(sum(amount_floor) AS BIGINT) AS weight, CAST(sum(amount_floor * bp) AS BIGINT) AS weighted, CAST(floor(CAST(sum(amount_floor * bp) AS DOUBLE) / sum(amount_floor)) AS BIGINT) AS mean_bp FROM r GROUP BY 1""")
def a13(trades, prices):
    buys = C.congress_events(trades).where((c("direction") == "buy") & c("transaction_date").between(F.date_sub(F.lit(AS_OF).cast("date"), 365), F.lit(AS_OF).cast("date"))).select("member_id", "ticker", "transaction_date", "amount_floor")
    e = R.as_of_prices(buys, prices, ["ticker"], "transaction_date", "price_date", "price").where("price > 0")
    last = prices.where(c("price_date") <= AS_OF).groupBy("ticker").agg(F.max_by("price", "price_date").alias("now"))
    r = e.join(last, "ticker").withColumn("bp", F.floor((c("now") - c("price")) * 10000 / c("price")).cast("long"))
    out = r.groupBy("member_id").agg(F.sum("amount_floor").alias("weight"), F.sum(c("amount_floor") * c("bp")).alias("weighted"))
    return out.withColumn("mean_bp", F.floor(c("weighted").cast("double") / c("weight")).cast("long"))


PERIODS = """k AS (SELECT fund_name, report_period, row_number() OVER (PARTITION BY fund_name ORDER BY report_period DESC) k FROM (SELECT DISTINCT fund_name, report_period FROM holdings WHERE shares_held > 0)),
h AS (SELECT fund_name, ticker, k, shares_held s, value_held v FROM holdings JOIN k USING (fund_name, report_period) WHERE shares_held > 0)"""


@query("A14_period_returns", "holdings", sql=f"""
WITH {PERIODS}, m AS (SELECT a.fund_name, b.v AS v, a.v * b.s AS up, b.v * a.s AS down FROM h a JOIN h b ON a.fund_name = b.fund_name AND a.ticker = b.ticker AND a.k = 1 AND b.k = 2 WHERE a.v > 0 AND b.v > 0),
f AS (SELECT fund_name, v, CAST(floor((up - down) * CAST(10000 AS DECIMAL(6,0)) / down) AS BIGINT) AS bp FROM m WHERE up * 20 >= down * 1 AND up <= down * 6), t AS (SELECT fund_name, sum(v) AS total FROM h WHERE k = 2 GROUP BY 1)
SELECT fund_name, sum(v) AS comparable, t.total, sum(v * bp) AS weighted FROM f JOIN t USING (fund_name) GROUP BY 1, 3""")
def a14(holdings):
    """Value-weighted return between a fund's last two periods over tickers of both; outliers outside -95 % and +500 % drop."""
    return period_returns(holdings)


def period_returns(holdings):
    h = holdings.where("shares_held > 0")
    k = h.select("fund_name", "report_period").distinct().withColumn("k", F.row_number().over(Window.partitionBy("fund_name").orderBy(F.desc("report_period")))).where("k <= 2")
    both = h.join(k, ["fund_name", "report_period"]).groupBy("fund_name", "ticker").agg(*(F.max(F.when(c("k") == n, c(x))).alias(f"{x[0]}{n}") for n in (1, 2) for x in ("shares_held", "value_held")))
    up, down = c("v1") * c("s2"), c("v2") * c("s1")
    fit = both.where("v1 > 0 and v2 > 0").where((up * 20 >= down) & (up <= down * 6)).withColumn("bp", F.floor((up - down) * 10000 / down).cast("long"))
    total = both.groupBy("fund_name").agg(F.sum("v2").alias("total"))
    return fit.groupBy("fund_name").agg(F.sum("v2").alias("comparable"), F.sum(c("v2") * c("bp")).cast("decimal(38,2)").alias("weighted")).join(total, "fund_name").select("fund_name", "comparable", "total", "weighted")


@query("A15_fund_directory", "holdings", sql="""
WITH p AS (SELECT fund_name, report_period, max(published_date) AS last_filed, sum(value_held) AS value, count(*) AS n FROM holdings WHERE shares_held > 0 GROUP BY 1, 2), r AS (SELECT *, lag(report_period) OVER w AS previous, lag(value) OVER w AS previous_value, row_number() OVER (PARTITION BY fund_name ORDER BY report_period DESC) AS k FROM p WINDOW w AS (PARTITION BY fund_name ORDER BY report_period))
SELECT fund_name, report_period, last_filed, last_day(report_period + INTERVAL 3 MONTH) + 45 AS next_expected, value, n, previous, previous_value, row_number() OVER (ORDER BY value DESC, fund_name) AS place FROM r WHERE k = 1""")
def a15(holdings):
    p = a1(holdings).select("fund_name", "report_period", "last_filed", c("total_value").alias("value"), c("holding_count").alias("n"))
    w = Window.partitionBy("fund_name").orderBy("report_period")
    r = p.select("*", F.lag("report_period").over(w).alias("previous"), F.lag("value").over(w).alias("previous_value"), F.row_number().over(Window.partitionBy("fund_name").orderBy(F.desc("report_period"))).alias("k")).where("k = 1")
    return r.select("fund_name", "report_period", "last_filed", K.next_filing(c("report_period")).alias("next_expected"), "value", "n", "previous", "previous_value", F.row_number().over(Window.orderBy(F.desc("value"), "fund_name")).cast("long").alias("place"))


@query("A16_quarter_snapshots", "holdings", sql=f"""
WITH {CHANGES}, x AS (SELECT *, {KIND} AS t FROM changes) SELECT fund_name, report_period, count(*) FILTER (WHERE shares_held > 0) AS held, count(*) FILTER (WHERE t <> 'hold') AS changed, count(*) FILTER (WHERE t = 'new') AS opened, count(*) FILTER (WHERE t = 'exit') AS closed, CAST(sum(abs(change_shares)) AS BIGINT) AS turnover FROM x GROUP BY 1, 2""")
def a16(holdings):
    t = c("change_type")
    return _changes(holdings).groupBy("fund_name", "report_period").agg(F.count_if(c("shares_held") > 0).alias("held"), F.count_if(t != "hold").alias("changed"), F.count_if(t == "new").alias("opened"), F.count_if(t == "exit").alias("closed"),
                                                                     F.sum(F.abs("change_shares")).alias("turnover"))


@query("A18_sale_and_buy_summaries", "insiders", sql="""
WITH t AS (SELECT source_url, filer_name, transaction_code, shares, amount, sum(CASE transaction_code WHEN 'P' THEN shares ELSE -shares END) OVER (PARTITION BY filer_name, ticker ORDER BY transaction_date, source_url, amount, shares, transaction_code ROWS UNBOUNDED PRECEDING) + 1000 AS following, ticker, transaction_date FROM insiders WHERE ticker IS NOT NULL),
g AS (SELECT filer_name, ticker, transaction_date, transaction_code, sum(shares) AS shares, sum(amount) AS value, CASE transaction_code WHEN 'S' THEN min(following) ELSE max(following) END AS after, count(*) AS n FROM t GROUP BY 1, 2, 3, 4)
SELECT *, CASE transaction_code WHEN 'S' THEN after + shares ELSE greatest(after - shares, 0) END AS before, transaction_code = 'P' AND after - shares <= 0 AND after > 0 AS new_position FROM g""")
def a18(insiders):
    return position_changes(insiders)


def position_changes(insiders, opening=1000):
    """Sales and buys of one filer, ticker and day: shares, value, shares held before and after, from `opening` shares on (A18, C12)."""
    w = Window.partitionBy("filer_name", "ticker").orderBy("transaction_date", "source_url", "amount", "shares", "transaction_code").rowsBetween(Window.unboundedPreceding, 0)
    rows = R.dealt(insiders.where("ticker is not null").select("filer_name", "ticker", "transaction_date", "source_url", "amount", "shares", "transaction_code"), "filer_name", "ticker")
    t = rows.withColumn("following", F.sum(F.when(c("transaction_code") == "P", c("shares")).otherwise(-c("shares"))).over(w) + opening)
    sale = c("transaction_code") == "S"
    g = t.groupBy("filer_name", "ticker", "transaction_date", "transaction_code").agg(F.sum("shares").alias("shares"), F.sum("amount").alias("value"), F.min("following").alias("lo"), F.max("following").alias("hi"), F.count("*").alias("n"))
    g = g.withColumn("after", F.when(sale, c("lo")).otherwise(c("hi"))).drop("lo", "hi")
    before = F.when(sale, c("after") + c("shares")).otherwise(F.greatest(c("after") - c("shares"), F.lit(0)))
    return g.withColumn("before", before).withColumn("new_position", ~sale & (c("before") <= 0) & (c("after") > 0))


@query("A19_economic_actors", "insiders", sql=f"SELECT ticker, count(DISTINCT filer_name) AS reporting, count(DISTINCT (transaction_code, transaction_date, shares, amount)) AS economic FROM insiders WHERE {OK} GROUP BY 1")
def a19(insiders):
    rows = insiders.withColumn("ticker", S.publishable_ticker(c("ticker"))).where("ticker is not null")
    return rows.groupBy("ticker").agg(F.count_distinct("filer_name").alias("reporting"), F.count_distinct(F.struct("transaction_code", "transaction_date", "shares", "amount")).alias("economic"))


@query("A20_merged_stories", "trades", sql=f"""
SELECT ticker, direction, max(amount_floor) AS best, min(published_date) AS first, max(published_date) AS last, array_to_string(list_sort(list(DISTINCT chamber)), ',') AS chambers, count(DISTINCT member_id) AS members, CAST(count(*) FILTER (WHERE chamber = 'House') AS BIGINT) AS house, count(*) FILTER (WHERE chamber = 'Senate') AS senate FROM trades WHERE {OK} GROUP BY 1, 2""")
def a20(trades):
    by = lambda x: F.count_if(c("chamber") == x)
    return C.congress_events(trades).groupBy("ticker", "direction").agg(F.max("amount_floor").alias("best"), F.min("published_date").alias("first"), F.max("published_date").alias("last"), F.array_join(F.array_sort(F.collect_set("chamber")), ",").alias("chambers"),
                                                                        F.count_distinct("member_id").alias("members"), by("House").alias("house"), by("Senate").alias("senate"))


@query("A21_rule_metrics", "signals", sql="SELECT signal_type, count(*) AS total, count(*) FILTER (WHERE amount < 5) AS pending, count(*) FILTER (WHERE amount >= 5) AS published, count(*) FILTER (WHERE day > DATE '2024-01-20') AS recent FROM signals GROUP BY 1")
def a21(signals):
    return signals.groupBy("signal_type").agg(F.count("*").alias("total"), F.count_if(c("amount") < 5).alias("pending"), F.count_if(c("amount") >= 5).alias("published"), F.count_if(c("day") > "2024-01-20").alias("recent"))


@query("A22_congress_overview", "trades", sql=f"""
SELECT ticker, count(DISTINCT member_id) AS lawmakers, count(*) FILTER (WHERE direction = 'buy') AS buys, count(*) FILTER (WHERE direction = 'sell') AS sells, CAST(sum(CASE direction WHEN 'buy' THEN amount_floor ELSE 0 END) AS BIGINT) AS bought, CAST(sum(CASE direction WHEN 'sell' THEN amount_floor ELSE 0 END) AS BIGINT) AS sold
 FROM trades WHERE ticker IS NOT NULL AND published_date BETWEEN date_trunc('year', {AT}) AND {AT} GROUP BY 1""")
def a22(trades):
    t = trades.where(c("ticker").isNotNull() & c("published_date").between(F.trunc(F.lit(AS_OF).cast("date"), "year"), F.lit(AS_OF).cast("date")))
    buy, sell = c("direction") == "buy", c("direction") == "sell"
    flow = lambda f: F.sum(F.when(f, c("amount_floor")).otherwise(0)).cast("long")
    return t.groupBy("ticker").agg(F.count_distinct("member_id").alias("lawmakers"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), flow(buy).alias("bought"), flow(sell).alias("sold"))


@query("A23_weekly_counters", "trades", "insiders", sql=f"""
SELECT (SELECT count(*) FROM (SELECT 1 FROM trades WHERE published_date > {AT} - 7 LIMIT 1000)) AS trades_n, (SELECT count(*) FROM (SELECT 1 FROM insiders WHERE published_date > {AT} - 7 LIMIT 1000)) AS insiders_n, (SELECT max(published_date) FROM trades) AS latest""")
def a23(trades, insiders):
    week = F.date_sub(F.lit(AS_OF).cast("date"), 7)
    capped = lambda d, n: d.where(c("published_date") > week).limit(1000).agg(F.count("*").alias(n))
    return capped(trades, "trades_n").crossJoin(capped(insiders, "insiders_n")).crossJoin(trades.agg(F.max("published_date").alias("latest")))  # three single rows


@query("A24_A25_first_and_latest", "trades", sql=f"SELECT ticker, min(transaction_date) AS earliest, max(greatest(published_date, transaction_date)) AS latest, max(coalesce(CASE WHEN transaction_date <= {AT} THEN transaction_date END, published_date)) AS bounded FROM trades GROUP BY 1")
def a24(trades):
    bounded = F.coalesce(F.when(c("transaction_date") <= AS_OF, c("transaction_date")), c("published_date"))
    return trades.groupBy("ticker").agg(F.min("transaction_date").alias("earliest"), F.max(F.greatest("published_date", "transaction_date")).alias("latest"), F.max(bounded).alias("bounded"))


@query("A26_ST8_lag", "trades", "insiders", sql=f"""
SELECT 'trades' AS name, max(published_date) AS latest, count(*) AS n, datediff('day', max(published_date), {AT}) AS lag_days, datediff('day', max(published_date), {AT}) <= 5 AS fresh FROM trades
UNION ALL SELECT 'insiders', max(published_date), count(*), datediff('day', max(published_date), {AT}), datediff('day', max(published_date), {AT}) <= 5 FROM insiders""")
def a26(trades, insiders):
    return lag_of(trades, "trades", 5).unionAll(lag_of(insiders, "insiders", 5))


def lag_of(rows, name, grace):
    lag = F.datediff(F.lit(AS_OF).cast("date"), "latest").cast("long")
    return rows.agg(F.max("published_date").alias("latest"), F.count("*").alias("n")).select(F.lit(name).alias("name"), "latest", "n", lag.alias("lag_days"), (lag <= grace).alias("fresh"))


@query("A27_duplicate_prefixes", "trades", sql="WITH d AS (SELECT doc_id, count(*) AS n FROM trades GROUP BY 1 HAVING count(*) > 1) SELECT regexp_replace(doc_id, '-[0-9]+$', '') AS prefix, CAST(sum(n - 1) AS BIGINT) AS extra, count(*) AS docs FROM d GROUP BY 1")
def a27(trades):
    d = trades.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return d.groupBy(S.filing_key(c("doc_id")).alias("prefix")).agg(F.sum(c("n") - 1).alias("extra"), F.count("*").alias("docs"))


@query("A28_X27_top_mismatches", "trades", sql="""
WITH p AS (SELECT regexp_replace(doc_id, '-[0-9]+$', '') AS prefix, CAST(year(max(published_date)) AS INT) AS year, count(*) AS n, count(*) FILTER (WHERE ticker IS NULL) AS unknown, count(*) FILTER (WHERE transaction_date > published_date) AS late FROM trades GROUP BY 1)
SELECT *, unknown * 100 + late * 10 + n AS score FROM p ORDER BY score DESC, n DESC, prefix LIMIT 50""")
def a28(trades):
    p = trades.groupBy(S.filing_key(c("doc_id")).alias("prefix")).agg(F.year(F.max("published_date")).alias("year"), F.count("*").alias("n"), F.count_if(c("ticker").isNull()).alias("unknown"), F.count_if(c("transaction_date") > c("published_date")).alias("late"))
    return p.withColumn("score", c("unknown") * 100 + c("late") * 10 + c("n")).orderBy(F.desc("score"), F.desc("n"), "prefix").limit(50)


@query("A29_top_tickers", "trades", sql=f"SELECT ticker, sum(amount) AS total FROM trades WHERE {OK} AND published_date >= {AT} - 365 GROUP BY 1 ORDER BY total DESC, ticker LIMIT 20")
def a29(trades):
    return C.congress_events(trades).where(c("published_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 365)).groupBy("ticker").agg(F.sum("amount").alias("total")).orderBy(F.desc("total"), "ticker").limit(20)


# --- deduplication and set operations ---

@query("D1_last_batch_wins", "trades", sql="""
WITH b AS (SELECT 0 AS batch, doc_id, ticker, amount, published_date FROM trades WHERE chamber = 'House' UNION ALL SELECT 1, doc_id, upper(ticker), amount + 1, published_date FROM trades WHERE amount_floor >= 50001)
SELECT doc_id, ticker, amount, published_date FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC, published_date DESC, amount DESC, ticker DESC NULLS LAST) = 1""")
def d1(trades):
    cols = ["doc_id", "ticker", "amount", "published_date"]
    a = trades.where("chamber = 'House'").select(*cols).withColumn("batch", F.lit(0))
    b = trades.where("amount_floor >= 50001").select(*cols).withColumn("amount", c("amount") + 1).withColumn("batch", F.lit(1))
    return R.first_per(a.unionByName(b), ["doc_id"], [F.desc("batch"), F.desc("published_date"), F.desc("amount"), F.desc_nulls_last("ticker")]).select("doc_id", "ticker", c("amount").cast("decimal(19,2)").alias("amount"), "published_date")


@query("D3_D5_insider_signatures", "insiders", sql=f"""
SELECT ticker, transaction_code, transaction_date, shares, amount, filer_name, source_url FROM insiders WHERE {OK} QUALIFY row_number() OVER (PARTITION BY ticker, transaction_code, transaction_date, shares, amount ORDER BY filer_name, source_url) = 1""")
def d5(insiders):
    return C.insider_economic_rows(insiders).select("ticker", "transaction_code", "transaction_date", "shares", "amount", "filer_name", "source_url")


@query("D4_congress_economic_trades", "trades", sql=f"WITH {PURCHASES} SELECT ticker, member_id, transaction_date, amount_range, published_date FROM u")
def d4(trades):
    return _purchases(trades).select("ticker", "member_id", "transaction_date", "amount_range", "published_date")


@query("D6_key_or_id", "insiders", sql="""
SELECT coalesce(ticker || ':' || transaction_code || ':' || transaction_date || ':' || amount, source_url) AS key, count(*) AS n FROM insiders GROUP BY 1""")
def d6(insiders):
    key = F.concat("ticker", F.lit(":"), "transaction_code", F.lit(":"), c("transaction_date").cast("string"), F.lit(":"), c("amount").cast("string"))
    return insiders.groupBy(F.coalesce(key, "source_url").alias("key")).agg(F.count("*").alias("n"))


@query("D8_D9_set_differences", "trades", "insiders", sql="""
WITH a AS (SELECT ticker, transaction_date FROM trades WHERE direction = 'sell'), b AS (SELECT ticker, transaction_date FROM insiders WHERE transaction_code = 'S')
SELECT 'except_all' AS kind, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def d8(trades, insiders):
    a, b = trades.where("direction = 'sell'").select("ticker", "transaction_date"), insiders.where("transaction_code = 'S'").select("ticker", "transaction_date")
    parts = {"except_all": a.exceptAll(b), "intersect_all": a.intersectAll(b), "except": a.subtract(b), "intersect": a.intersect(b), "union": a.union(b).distinct()}
    out = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in parts.items()]
    for o in out[1:]:
        out[0] = out[0].unionAll(o)
    return out[0]


@query("D10_latest_snapshot", "trades", sql="""
WITH m AS (SELECT member_id, max(published_date) AS d FROM trades WHERE ticker IS NOT NULL GROUP BY 1) SELECT t.member_id, t.ticker, t.published_date, t.amount_floor, t.amount FROM trades t JOIN m ON t.member_id = m.member_id AND t.published_date = m.d WHERE ticker IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY t.member_id, t.ticker ORDER BY amount_floor DESC, amount DESC) = 1""")
def d10(trades):
    t = trades.where("ticker is not null")
    last = t.groupBy("member_id").agg(F.max("published_date").alias("published_date"))
    return R.first_per(t.join(last, ["member_id", "published_date"]), ["member_id", "ticker"], [F.desc("amount_floor"), F.desc("amount")]).select("member_id", "ticker", "published_date", "amount_floor", "amount")


@query("D11_filing_inputs", "insiders", sql="""
WITH f AS (SELECT DISTINCT regexp_extract(source_url, '([0-9]{10}-[0-9]{2}-[0-9]{6})', 1) a FROM insiders WHERE transaction_code = 'P'), s AS (SELECT DISTINCT regexp_extract(source_url, '([0-9]{10}-[0-9]{2}-[0-9]{6})', 1) a FROM insiders WHERE transaction_code = 'S')
SELECT a AS accession, 'feed' AS origin FROM f UNION ALL SELECT * FROM (SELECT a, 'stored' FROM s WHERE a NOT IN (SELECT a FROM f) ORDER BY a DESC LIMIT 200)""")
def d11(insiders):
    a = insiders.where(c("transaction_code").isin("P", "S")).select(S.accession(c("source_url")).alias("accession"), (c("transaction_code") == "P").alias("bought"))
    kinds = R.dealt(a, "accession").groupBy("accession").agg(F.bool_or("bought").alias("fed"))
    feed, stored = (kinds.where(c("fed") == x).select("accession", F.lit(o).alias("origin")) for x, o in ((True, "feed"), (False, "stored")))
    return feed.unionByName(stored.orderBy(F.desc("accession")).limit(200))


@query("D12_D7_first_of_sorted", "signals", sql="SELECT user_id, signal_type, event_id, amount FROM signals QUALIFY row_number() OVER (PARTITION BY user_id, signal_type ORDER BY amount DESC, ts DESC, event_id) = 1")
def d12(signals):
    return R.first_per(signals, ["user_id", "signal_type"], [F.desc("amount"), F.desc("ts"), F.asc("event_id")]).select("user_id", "signal_type", "event_id", "amount")
