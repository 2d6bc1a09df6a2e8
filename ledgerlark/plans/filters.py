"""Scans, filters, sorts and limits over the domain views."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import options as O
from ledgerlark.functions import scalars as S
from ledgerlark.plans.catalog import query
from ledgerlark.sources.adapters import AS_OF

c = F.col
AT = f"DATE '{AS_OF}'"


# --- scans ---

@query("SC1_recent_rows", "trades", sql=f"""
SELECT member_id, ticker, published_date, doc_id, amount FROM trades WHERE published_date >= {AT} - 30 ORDER BY published_date DESC, doc_id, amount, ticker LIMIT 500""")
def recent_rows(trades):
    return (trades.where(c("published_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 30)).orderBy(F.desc("published_date"), "doc_id", "amount", F.asc_nulls_last("ticker")).limit(500)
            .select("member_id", "ticker", "published_date", "doc_id", "amount"))


@query("SC2_typed_rows_since", "signals", sql="SELECT event_id, signal_type, day, amount FROM signals WHERE signal_type IN ('purchase', 'signup') AND day >= DATE '2024-01-10'")
def typed_rows(signals):
    return signals.where(c("signal_type").isin("purchase", "signup") & (c("day") >= "2024-01-10")).select("event_id", "signal_type", "day", "amount")


@query("SC4_rows_of_a_ticker", "insiders", sql="SELECT filer_name, transaction_date, shares, amount, source_url FROM insiders WHERE ticker = 'ABC' ORDER BY transaction_date DESC, amount DESC, source_url LIMIT 2000")
def ticker_rows(insiders):
    return insiders.where("ticker = 'ABC'").orderBy(F.desc("transaction_date"), F.desc("amount"), "source_url").limit(2000).select("filer_name", "transaction_date", "shares", "amount", "source_url")


@query("SC6_calendar_rows", "trades", sql="SELECT member_id, ticker, transaction_date, published_date, amount_range FROM trades WHERE transaction_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' AND published_date <= DATE '1998-04-30' AND direction LIKE 'buy%'")
def calendar_rows(trades):
    return trades.where(c("transaction_date").between("1998-03-01", "1998-03-31") & (c("published_date") <= "1998-04-30") & c("direction").startswith("buy")).select("member_id", "ticker", "transaction_date", "published_date", "amount_range")


@query("SC7_embedded_to_one", "trades", "members", sql="""
SELECT t.doc_id, t.ticker, t.amount, m.full_name || ' (' || m.state || ')' AS member FROM trades t LEFT JOIN members m USING (member_id) WHERE t.published_date >= DATE '2001-06-01'""")
def embedded(trades, members):
    m = members.select("member_id", F.struct("full_name", "state").alias("m"))
    return trades.where("published_date >= date '2001-06-01'").join(m, "member_id", "left").select("doc_id", "ticker", "amount", F.concat("m.full_name", F.lit(" ("), "m.state", F.lit(")")).alias("member"))


@query("SC8_embedded_inner", "trades", "members", sql="SELECT t.doc_id, m.state FROM trades t JOIN members m ON t.member_id = m.member_id AND m.active AND m.party = 'BUILDING' WHERE t.amount_floor >= 100001")
def embedded_inner(trades, members):
    return trades.where("amount_floor >= 100001").join(members.where("active and party = 'BUILDING'").select("member_id", "state"), "member_id").select("doc_id", "state")


@query("SC9_json_path_scan", "events", sql="SELECT event_id, user_id, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 42")
def json_scan(events):
    return events.where(F.get_json_object("props", "$.k").cast("long") == 42).select("event_id", "user_id", "event_type")


@query("SC10_counts", "trades", "insiders", "holdings", sql="SELECT 'trades' AS t, count(*) AS n FROM trades UNION ALL SELECT 'insiders', count(*) FROM insiders UNION ALL SELECT 'holdings', count(*) FROM holdings")
def counts(trades, insiders, holdings):
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t, d in (("trades", trades), ("insiders", insiders), ("holdings", holdings))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SC11_existence", "holdings", sql="SELECT fund_name, p AS report_period, EXISTS (SELECT 1 FROM holdings h WHERE h.fund_name = f.fund_name AND h.report_period = p AND ticker = 'ABC') AS present FROM (SELECT DISTINCT fund_name FROM holdings) f, (VALUES (DATE '1998-03-31'), (DATE '2031-03-31')) v(p)")
def existence(holdings):
    wanted = holdings.select("fund_name").distinct().withColumn("report_period", F.explode(F.array(F.lit("1998-03-31").cast("date"), F.lit("2031-03-31").cast("date"))))
    there = holdings.where("ticker = 'ABC'").select("fund_name", "report_period", F.lit(True).alias("present")).distinct()
    return wanted.join(there, ["fund_name", "report_period"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


@query("SC28_distinct_series", "trades", "prices", sql="SELECT p.ticker, count(*) AS points, min(p.price_date) AS first, max(p.price_date) AS last FROM prices p WHERE p.ticker IN (SELECT ticker FROM trades WHERE direction = 'buy' AND amount_floor >= 50001) GROUP BY 1")
def series(trades, prices):
    need = trades.where("direction = 'buy' and amount_floor >= 50001 and ticker is not null").select("ticker").distinct()
    return prices.join(need, "ticker", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("points"), F.min("price_date").alias("first"), F.max("price_date").alias("last"))


# --- filters ---

@query("F1_F5_predicates", "trades", "insiders", sql="""
SELECT 'trade' AS kind, chamber AS grp, count(*) AS n FROM trades WHERE chamber = 'House' AND direction IN ('buy') AND amount >= 1000 AND amount <= 60000 AND ticker IS NOT NULL AND ticker <> '' AND ticker NOT IN ('N/A', 'NA', 'UNKNOWN', 'MULTI') GROUP BY 2
UNION ALL SELECT 'name', chamber, count(*) FROM trades WHERE politician_name ILIKE '%#00000001%' OR asset_name ILIKE 'RED%' GROUP BY 2
UNION ALL SELECT 'insider', transaction_code, count(*) FROM insiders WHERE upper(transaction_code) IN ('P', 'A', 'BUY', 'PURCHASE') GROUP BY 2""")
def predicates(trades, insiders):
    one = trades.where((c("chamber") == "House") & c("direction").isin("buy") & c("amount").between(1000, 60000) & c("ticker").isNotNull() & (c("ticker") != "") & ~c("ticker").isin("N/A", "NA", "UNKNOWN", "MULTI"))
    two = trades.where(reduce(or_, (c(k).ilike(p) for k, p in (("politician_name", "%#00000001%"), ("asset_name", "RED%")))))
    three = insiders.where(F.upper("transaction_code").isin("P", "A", "BUY", "PURCHASE"))
    parts = [d.groupBy(c(g).alias("grp")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "grp", "n") for k, d, g in (("trade", one, "chamber"), ("name", two, "chamber"), ("insider", three, "transaction_code"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("F6_F8_ticker_rules", "trades", sql="""
WITH t AS (SELECT DISTINCT ticker FROM trades UNION SELECT x FROM (VALUES ('BRK.B'), ('bf-b'), ('A1'), ('TOOLONG'), ('1AB'), (''), (' msft '), ('US-TREAS')) v(x)), u AS (SELECT ticker, upper(trim(ticker)) u FROM t)
SELECT ticker, CASE WHEN u NOT IN ('', 'N/A', 'NA', 'UNKNOWN', 'MULTI', 'US-TREAS') AND regexp_matches(u, '^[A-Z][A-Z0-9]{0,4}([.-][A-Z])?$') THEN u END AS publishable, CASE WHEN regexp_matches(u, '^[A-Z][A-Z0-9.-]{0,9}$') THEN u END AS calendar, CASE WHEN regexp_matches(u, '^[A-Z]{1,5}(\\.[A-Z])?$') THEN u END AS market FROM u""")
def ticker_rules(trades):
    more = trades.sparkSession.createDataFrame([(x,) for x in ("BRK.B", "bf-b", "A1", "TOOLONG", "1AB", "", " msft ", "US-TREAS")], "ticker string")
    t = trades.select("ticker").union(more).distinct()
    return t.select("ticker", S.publishable_ticker(c("ticker")).alias("publishable"), S.calendar_ticker(c("ticker")).alias("calendar"), S.market_ticker(c("ticker")).alias("market"))


#: The words of a text, as the oracle says it.
O_WORDS = "list_filter(list_transform(string_split_regex(lower(text), '[\\s:;$]+'), lambda x: regexp_replace(x, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda x: x <> '')"

#: Asset types that count as equity, and words of asset names that do not (fixed values).
EQUITY_TYPES = ("st", "stock", "stocks", "stock/etf", "etf", "cs", "common stock", "common stocks")
NOT_EQUITY_WORDS = ("annuity", "annuities", "bond", "municipal", "treasury", "treasuries")


def clean_asset(ticker, asset_type, asset_name):
    """No treasuries, municipal paper or bonds, and only equity types where a type is given."""
    t, kind, name = F.upper(F.trim(F.coalesce(ticker, F.lit("")))), F.lower(F.trim(F.coalesce(asset_type, F.lit("")))), F.lower(F.coalesce(asset_name, F.lit("")))
    listed = (kind == "") | kind.isin(*EQUITY_TYPES) | kind.contains("stock") | kind.contains("etf")
    return ~t.isin("", "N/A", "NA", "UNKNOWN") & ~t.rlike("^US-?TREAS") & listed & ~name.rlike("treasury|municipal|bond")


def equity_purchase(asset_type, asset_name):
    kind, name = F.lower(F.trim(F.coalesce(asset_type, F.lit("")))), F.lower(F.coalesce(asset_name, F.lit("")))
    return ~F.arrays_overlap(F.split(name, "[^a-z0-9]+"), F.array(*map(F.lit, NOT_EQUITY_WORDS))) & ((kind == "") | kind.isin(*EQUITY_TYPES) | kind.contains("stock") | kind.contains("etf"))


@query("F9_F13_asset_rules", "trades", sql="""
SELECT asset_type, ticker, count(*) AS n, count(*) FILTER (WHERE ticker IS NOT NULL AND ticker NOT IN ('N/A', 'US-TREAS') AND coalesce(asset_type, '') <> 'Municipal Security') AS clean, count(*) FILTER (WHERE coalesce(asset_type, '') <> 'Municipal Security') AS equity,
 count(*) FILTER (WHERE NOT (chamber = 'House' AND published_date < DATE '1998-01-01') AND ticker IS NOT NULL AND ticker <> 'N/A') AS displayable, count(*) FILTER (WHERE contains(' ' || asset_name || ' ', ' gear ') OR contains(' ' || asset_name || ' ', ' bolt ')) AS derived FROM trades GROUP BY 1, 2""")
def asset_rules(trades):
    shown = ~((c("chamber") == "House") & (c("published_date") < "1998-01-01")) & (S.blank_to_null(c("ticker")).isNotNull()) & ~F.upper("ticker").isin("N/A", "NA", "UNKNOWN", "MULTI")
    padded = F.concat(F.lit(" "), F.lower(F.trim("asset_name")), F.lit(" "))
    return trades.groupBy("asset_type", "ticker").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(clean_asset(c("ticker"), c("asset_type"), c("asset_name"))).alias("clean"), F.count_if(equity_purchase(c("asset_type"), c("asset_name"))).alias("equity"),
        F.count_if(shown).alias("displayable"), F.count_if(padded.contains(" gear ") | padded.contains(" bolt ")).alias("derived"))


@query("F19_resolution_gate", "holdings", "issuers", sql="""
WITH r AS (SELECT h.fund_name, h.report_period, count(*) FILTER (WHERE NOT (ascii(h.ticker[3]) % 3 = 0 AND length(h.fund_name) > 0)) AS resolved, count(*) AS supported FROM holdings h GROUP BY 1, 2)
SELECT fund_name, report_period, resolved, supported FROM r WHERE resolved * 100 >= supported * 55""")
def gate(holdings, issuers):
    known = F.ascii(F.substring("ticker", 3, 1)) % 3 != 0
    return holdings.groupBy("fund_name", "report_period").agg(F.count_if(known).alias("resolved"), F.count(F.lit(1)).alias("supported")).where("resolved * 100 >= supported * 55")


@query("F20_trivial_rows", "insiders", sql="SELECT transaction_code, count(*) AS n, sum(amount) AS total FROM insiders WHERE amount >= 1000 AND shares > 1 AND coalesce(trim(ticker), '') <> '' GROUP BY 1")
def trivial(insiders):
    return insiders.where((c("amount") >= 1000) & (c("shares") > 1) & S.blank_to_null(c("ticker")).isNotNull()).groupBy("transaction_code").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


#: Parts of company names that are no names, and words of trades (fixed values).
DIRTY_PARTS = ("f s:", "s o:", "subholding of", "filing status", " fields law firm ", " ira fbo ", " morgan stanley ", "etrade", "e*trade", "trust ")
TRADE_WORDS = ("purchase", "sale", "bought", "sold")


def dirty_name(name):
    """A text that holds one of the parts, a date, a sum of money, a span of two large sums, or words of a trade or an option."""
    tidy, words = S.search_text(name), O.words(name)
    # one or two digits, one or two, two to four, between strokes or dashes
    parts = F.transform(F.split(F.lower(name), "[^a-z0-9/-]+"), lambda w: F.split(w, "[/-]"))
    long = lambda p, i, least, most: F.get(p, F.lit(i)).rlike(f"^[0-9]{{{least},{most}}}$")
    dated = F.exists(parts, lambda p: (F.size(p) == 3) & long(p, 0, 1, 2) & long(p, 1, 1, 2) & long(p, 2, 2, 4))
    money = F.size(F.filter(F.split(name, r"\$"), lambda part: F.substring(part, 1, 1).between("0", "9"))) > F.when(F.substring(name, 1, 1).between("0", "9"), 1).otherwise(0)
    large = F.filter(words, lambda w: w.contains(",") & (F.length(F.translate(w, "0123456789,", "")) == 0))
    return (tidy != "") & (reduce(or_, [tidy.contains(x) for x in DIRTY_PARTS]) | dated | money | (name.contains("-") & (F.size(large) >= 2))
                           | F.arrays_overlap(words, F.array(*map(F.lit, TRADE_WORDS))) | O.side_of(name).isNotNull())


@query("F22_dirty_names", "options", sql=f"""
WITH t AS (SELECT *, {O_WORDS} w FROM options)
SELECT p_partkey, text FROM t WHERE len(list_filter(string_split(text, '$')[2:], lambda x: x[1] BETWEEN '0' AND '9')) > 0 OR regexp_matches(text, '\\b[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}\\b')
 OR list_has_any(w, ['purchase', 'sale', 'bought', 'sold']) OR list_has_any(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), ['call option', 'call options', 'put option', 'put options'])""")
def dirty(options):
    return options.where(dirty_name(c("text"))).select("p_partkey", "text")


@query("F23_rows_of_an_owner", "signals", sql="SELECT event_id, signal_type FROM signals WHERE user_id = 'U7'")
def owner_rows(signals):
    return signals.where("user_id = 'U7'").select("event_id", "signal_type")


# --- sorts and limits ---

@query("O1_O2_sorted_page", "trades", sql="SELECT doc_id, ticker, member_id, amount, row_number() OVER (ORDER BY published_date DESC, amount DESC, doc_id, ticker NULLS LAST, member_id) AS place FROM trades QUALIFY place BETWEEN 101 AND 151")
def page(trades):
    order = [F.desc("published_date"), F.desc("amount"), "doc_id", F.asc_nulls_last("ticker"), "member_id"]
    rows = trades.orderBy(*order).offset(100).limit(51)
    return rows.withColumn("place", (F.row_number().over(Window.orderBy(*order)) + 100).cast("long")).select("doc_id", "ticker", "member_id", "amount", "place")


@query("O4_weight_order", "holdings", sql="SELECT fund_name, ticker, report_period, greatest(abs(value_held), abs(shares_held)) AS weight FROM holdings ORDER BY weight DESC, ticker, fund_name, report_period LIMIT 100")
def weights(holdings):
    return holdings.select("fund_name", "ticker", "report_period", F.greatest(F.abs("value_held"), F.abs("shares_held")).alias("weight")).orderBy(F.desc("weight"), "ticker", "fund_name", "report_period").limit(100)


@query("O5_merged_pages", "trades", "insiders", "holdings", sql="""
WITH a AS (SELECT 'congress' AS source, ticker, published_date, CAST(amount AS DECIMAL(38,2)) AS amount FROM trades WHERE ticker = 'ABC' ORDER BY 3 DESC, 4 DESC LIMIT 25), b AS (SELECT 'insider', ticker, published_date, CAST(amount AS DECIMAL(38,2)) FROM insiders WHERE ticker = 'ABC' ORDER BY 3 DESC, 4 DESC LIMIT 25),
f AS (SELECT 'fund', ticker, published_date, CAST(value_held AS DECIMAL(38,2)) FROM holdings WHERE ticker = 'ABC' ORDER BY 3 DESC, 4 DESC LIMIT 25)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM f) ORDER BY published_date DESC, amount DESC, source LIMIT 25""")
def merged(trades, insiders, holdings):
    parts = [d.where("ticker = 'ABC'").select(F.lit(s).alias("source"), "ticker", "published_date", c(a).cast("decimal(38,2)").alias("amount")).orderBy(F.desc("published_date"), F.desc("amount")).limit(25)
             for s, d, a in (("congress", trades, "amount"), ("insider", insiders, "amount"), ("fund", holdings, "value_held"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).orderBy(F.desc("published_date"), F.desc("amount"), "source").limit(25)


@query("O8_recent_then_backlog", "trades", sql=f"""
WITH r AS (SELECT doc_id, ticker, member_id, amount, published_date FROM trades WHERE published_date >= {AT} - 7 ORDER BY amount DESC, doc_id, member_id, ticker LIMIT 20), b AS (SELECT doc_id, ticker, member_id, amount, published_date FROM trades t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id) ORDER BY amount DESC, doc_id, member_id, ticker LIMIT 30)
SELECT *, TRUE AS recent FROM r UNION ALL SELECT *, FALSE FROM b""")
def backlog(trades):
    cols, order = ["doc_id", "ticker", "member_id", "amount", "published_date"], [F.desc("amount"), "doc_id", "member_id", F.asc_nulls_last("ticker")]
    recent = trades.where(c("published_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 7)).orderBy(*order).limit(20).select(*cols)
    rest = trades.join(recent.select("doc_id"), "doc_id", "left_anti").orderBy(*order).limit(30).select(*cols)
    return recent.withColumn("recent", F.lit(True)).unionByName(rest.withColumn("recent", F.lit(False)))


@query("O3_fund_activity_order", "holdings", sql="""
SELECT fund_name, ticker, report_period, shares_held, value_held FROM holdings WHERE fund_name = 'Supplier#000000001'
ORDER BY published_date DESC, CASE WHEN shares_held >= 80 THEN 0 WHEN shares_held >= 40 THEN 1 ELSE 2 END, value_held DESC, shares_held DESC, ticker LIMIT 40""")
def activity(holdings):
    kind = F.when(c("shares_held") >= 80, 0).when(c("shares_held") >= 40, 1).otherwise(2)
    return holdings.where("fund_name = 'Supplier#000000001'").orderBy(F.desc("published_date"), kind, F.desc("value_held"), F.desc("shares_held"), "ticker").limit(40).select("fund_name", "ticker", "report_period", "shares_held", "value_held")
