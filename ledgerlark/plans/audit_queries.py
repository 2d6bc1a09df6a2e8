"""Name and date resolution, audit keys, run state, search results and account tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import resolution as N
from ledgerlark.functions import scalars as S
from ledgerlark.plans.catalog import query

c = F.col


@query("S3_prefix_direction", "codes", sql="""
SELECT raw, CASE WHEN lower(trim(raw)) LIKE 'purchase%' OR lower(trim(raw)) LIKE 'buy%' THEN 'buy' WHEN lower(trim(raw)) LIKE 'sale%' OR lower(trim(raw)) LIKE 'sell%' THEN 'sell' END AS direction, count(*) AS n FROM codes GROUP BY 1, 2""")
def s3(codes):
    return codes.groupBy("raw", N.cluster_direction(c("raw")).alias("direction")).agg(F.count("*").alias("n"))


_NAMES = """CASE p_partkey % 7 WHEN 0 THEN 'Bill J' WHEN 1 THEN 'Jim' WHEN 2 THEN 'J' WHEN 3 THEN 'Tho' WHEN 4 THEN 'Rafael' WHEN 5 THEN 'Dan Q' ELSE '' END AS filed,
 CASE p_size % 6 WHEN 0 THEN 'William' WHEN 1 THEN 'James' WHEN 2 THEN 'Thomas' WHEN 3 THEN 'Ted' WHEN 4 THEN 'Daniel K' ELSE 'Jane' END AS registered"""
_GROUP = " ".join(f"WHEN %s IN {g} THEN '{g[0]}'" for g in N.FIRST_NAMES)


def _fits(least: int) -> str:
    same = f"CASE {_GROUP.replace('%s', 'f')} ELSE f END = CASE {_GROUP.replace('%s', 'r')} ELSE r END"
    return f"coalesce(bool_or(f <> '' AND ({same} OR (starts_with(f, r) OR starts_with(r, f)) AND (least(length(f), length(r)) = 1 OR least(length(f), length(r)) >= {least}))), false)"


@query("S7_Q8_first_names", "part", sql=f"""
WITH p AS (SELECT p_partkey, {_NAMES} FROM part), a AS (SELECT p_partkey, unnest(string_split(lower(filed), ' ')) AS f, lower(registered) AS reg FROM p), b AS (SELECT p_partkey, f, unnest(string_split(reg, ' ')) AS r FROM a)
SELECT p_partkey, {_fits(3)} AS by_three, {_fits(4)} AS by_four FROM b GROUP BY 1""")
def s7(part):
    """First names match from three letters on in one reader and from four on in the other."""
    p = part.selectExpr("p_partkey", *(x.strip() for x in _NAMES.split(",\n")))
    return p.select("p_partkey", N.first_names_match(c("filed"), c("registered")).alias("by_three"), N.first_names_match(c("filed"), c("registered"), prefix=4).alias("by_four"))


@query("S22_Q3_dollar_floors", "options", sql=r"""
WITH t AS (SELECT p_partkey, regexp_extract(replace(text, ',', ''), '\$([0-9]+(\.[0-9]+)?)', 1) AS d FROM options) SELECT p_partkey, greatest(coalesce(CAST(nullif(d, '') AS DECIMAL(18,2)), 0), CAST(p_partkey % 2000 AS DECIMAL(18,2))) AS floor FROM t""")
def s22(options):
    """Only numbers after a dollar sign count; an event's floor is the largest of its fields."""
    return options.select("p_partkey", F.greatest(N.dollar_floor(c("text")), (c("p_partkey") % 2000).cast("decimal(18,2)")).alias("floor"))


_SCAN = """CASE o_orderkey % 7 WHEN 0 THEN '0l/1O/2024' WHEN 1 THEN '1/5/24' WHEN 2 THEN '13/02/2024' WHEN 3 THEN '3-7-4' WHEN 4 THEN 'l2.3I.202' WHEN 5 THEN '12.30.202' ELSE 'n/a' END AS scan"""


@query("S27_scanned_dates", "orders", sql=f"""
WITH o AS (SELECT o_orderkey, {_SCAN} FROM orders), r AS (SELECT o_orderkey, CASE scan WHEN '0l/1O/2024' THEN DATE '2024-01-10' WHEN '1/5/24' THEN DATE '2024-01-05' END AS read, scan FROM o)
SELECT o_orderkey, read, CASE scan WHEN '3-7-4' THEN DATE '2024-03-07' WHEN '12.30.202' THEN DATE '2024-12-30' WHEN 'l2.3I.202' THEN DATE '2024-02-03' ELSE read END AS scanned FROM r""")
def s27(orders):
    """Letters read as digits, and years of one or three digits filled up near the filing's year (there digits alone count)."""
    o = orders.selectExpr("o_orderkey", _SCAN)
    return o.select("o_orderkey", N.read_date(c("scan")).alias("read"), N.scanned_date(c("scan"), F.lit(2024)).alias("scanned"))


@query("X8_X9_baseline_backfill", "feed_events", "prices", sql="""
WITH e AS (SELECT event_id, ticker, published_date, importance, CASE WHEN change_pct % 4 = 0 THEN gain_pct END AS stored FROM feed_events) SELECT event_id, e.ticker, published_date, importance, price FROM e JOIN prices p ON p.ticker = e.ticker AND price_date = published_date WHERE coalesce(stored, 0) <= 0 AND price > 0""")
def x9(feed_events, prices):
    """Events without a stored positive baseline get the day's price; those without a price are left out."""
    stored = F.when(c("change_pct") % 4 == 0, c("gain_pct"))
    missing = feed_events.where(F.coalesce(stored, F.lit(0)) <= 0).select("event_id", "ticker", "published_date", "importance")
    return missing.join(prices.select("ticker", c("price_date").alias("published_date"), "price"), ["ticker", "published_date"]).where("price > 0")


@query("X12_X45_trade_keys", "insiders", sql="""
SELECT regexp_extract(source_url, '([0-9]{10}-[0-9]{2}-[0-9]{6})', 1) || '|' || upper(filer_name) || '|' || coalesce(ticker, '') || '|' || transaction_date || '|' || lower(transaction_code) AS key, count(*) AS n, sum(CASE WHEN shares > 40 THEN amount ELSE shares * 10 END) AS value FROM insiders GROUP BY 1""")
def x12(insiders):
    """Audit key of a trade, and its value: as stored, else shares times price (ten here)."""
    key = F.concat_ws("|", F.coalesce(S.accession(c("source_url")), "source_url"), F.upper(F.trim("filer_name")), F.upper(F.trim(F.coalesce("ticker", F.lit("")))), c("transaction_date").cast("string"), F.lower("transaction_code"))
    value = F.coalesce(F.when(c("shares") > 40, c("amount")), c("shares") * 10)
    return insiders.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("value"))


@query("X15_recent_filings", "orders", sql="""
WITH f AS (SELECT year(o_orderdate) AS y, o_custkey % 700 AS doc, CAST(max(o_orderdate) AS DATE) AS filed FROM orders WHERE o_orderdate >= DATE '2000-01-01' GROUP BY 1, 2) SELECT * FROM f ORDER BY filed DESC, doc DESC, y DESC LIMIT 50""")
def x15(orders):
    """The newest fifty filings of all years after a cutoff; of a document met twice the last stands."""
    f = orders.where("o_orderdate >= date '2000-01-01'").groupBy(F.year("o_orderdate").cast("long").alias("y"), (c("o_custkey") % 700).alias("doc")).agg(F.max("o_orderdate").cast("date").alias("filed"))
    return f.orderBy(F.desc("filed"), F.desc("doc"), F.desc("y")).limit(50)


@query("X16_parse_status", "orders", sql="""
SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'trades' WHEN o_orderkey % 5 = 0 THEN 'no_trade' WHEN o_orderkey % 7 = 0 THEN 'attachment_unparsed' WHEN o_orderkey % 3 = 0 THEN 'trades' WHEN o_orderkey % 11 = 0 THEN 'no_trade' ELSE 'unparsed' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def x16(orders):
    k = lambda m: (c("o_orderkey") % m == 0)
    status = N.parse_status(k(4).cast("int"), k(5), k(7), k(3).cast("int"), k(11))
    return orders.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("X18_paper_forms", "part", sql=f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN 1400 + p_partkey % 300 END AS l, CASE WHEN p_partkey % 8 > 0 THEN 1950 + p_partkey * 7 % 1000 END AS a FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'sell' WHEN l < 1475 THEN 'buy' WHEN l < 1600 THEN 'sell' ELSE 'exchange' END AS kind, CASE WHEN a IS NULL THEN 'Unknown' {" ".join(f"WHEN a < {e} THEN '{t}'" for e, t in N.FORM_AMOUNTS)} ELSE 'Over $5,000,000' END AS amount FROM p""")
def x18(part):
    left, amount = F.when(c("p_partkey") % 9 > 0, 1400 + c("p_partkey") % 300), F.when(c("p_partkey") % 8 > 0, 1950 + c("p_partkey") * 7 % 1000)
    line = F.when(c("p_partkey") % 6 == 0, "Partial SALE").otherwise("")
    return part.select("p_partkey", N.form_kind(left, line).alias("kind"), N.form_amount(amount).alias("amount"))


@query("X23_row_signatures", "trades", sql="""
SELECT upper(coalesce(ticker, '')) || '|' || lower(asset_name) || '|' || direction || '|' || transaction_date || '|' || published_date || '|' || amount_range AS signature, count(*) AS n FROM trades GROUP BY 1""")
def x23(trades):
    """How often rows say the same in six normalised fields."""
    parts = [F.upper(F.trim("ticker")), F.lower(F.trim("asset_name")), S.event_direction(c("direction")), c("transaction_date").cast("string"), c("published_date").cast("string"), F.trim("amount_range")]
    key = F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))
    return trades.groupBy(key.alias("signature")).agg(F.count("*").alias("n"))


@query("X33_alias_scores", "companies", sql="""
WITH s AS (SELECT ticker, lower(name) AS v FROM companies) SELECT ticker, CASE WHEN v = 'blue bolt' THEN 260 WHEN starts_with(v, 'blue bolt') THEN 125 WHEN (starts_with(v, 'blue') OR contains(v, ' blue')) AND (starts_with(v, 'bolt') OR contains(v, ' bolt')) THEN 55 WHEN contains(v, 'blue bolt') THEN 40 ELSE 0 END AS score FROM s""")
def x33(companies):
    return companies.select("ticker", N.alias_score(F.array("name"), "blue bolt").alias("score"))


@query("X36_alert_history", "stored", sql="""
SELECT key, grp, status, created_at FROM stored QUALIFY row_number() OVER (PARTITION BY grp, status = 'approved' ORDER BY created_at DESC, key) <= 3""")
def x36(stored):
    """The newest three sent and the newest three other alerts of each account."""
    w = Window.partitionBy("grp", c("status") == "approved").orderBy(F.desc("created_at"), "key")
    return stored.withColumn("n", F.row_number().over(w)).where("n <= 3").select("key", "grp", "status", "created_at")


@query("X38_follow_limits", "follows", sql="""
SELECT watchlist_id, count(DISTINCT match_type || ':' || target) AS follows, count(DISTINCT match_type || ':' || target) < 25 AS may_add FROM follows WHERE target IS NOT NULL GROUP BY 1""")
def x38(follows):
    n = follows.where("target is not null").groupBy("watchlist_id").agg(F.count_distinct("match_type", "target").alias("follows"))
    return n.withColumn("may_add", c("follows") < 25)


@query("X3_cluster_watchlists", "members", "follows", sql="""
WITH p AS (SELECT 'U' || substr(member_id, 2) AS watchlist_id, CASE party WHEN 'BUILDING' THEN ['email', 'fax'] WHEN 'MACHINERY' THEN ['sms', 'email'] ELSE ['fax'] END AS ch FROM members WHERE active) SELECT watchlist_id, array_to_string(list_filter(ch, lambda q: q IN ('email', 'sms')), ',') AS channels FROM (SELECT DISTINCT watchlist_id FROM follows) JOIN p USING (watchlist_id)""")
def x3(members, follows):
    """Watchlists whose owner wants cluster alerts, and the allowed channels among the owner's."""
    asked = F.when(c("party") == "BUILDING", F.array(F.lit("email"), F.lit("fax"))).when(c("party") == "MACHINERY", F.array(F.lit("sms"), F.lit("email"))).otherwise(F.array(F.lit("fax")))
    owners = members.where("active").select(F.concat(F.lit("U"), F.substr("member_id", F.lit(2))).alias("watchlist_id"), F.array_join(F.array_intersect(asked, F.array(F.lit("email"), F.lit("sms"))), ",").alias("channels"))
    return follows.select("watchlist_id").distinct().join(owners, "watchlist_id")


@query("X44_leaf_labels", "feed_events", sql="""
SELECT event_id, CASE WHEN source <> 'fund' THEN CASE direction WHEN 'buy' THEN 'Buy' ELSE 'Sell' END WHEN change_type = 'new' THEN 'New Position' WHEN change_type = 'exit' THEN 'Exit' WHEN change_type = 'increase' THEN 'Increase' WHEN signal_type = 'fund_position_change' THEN 'Fund Position Change' ELSE 'Fund Filing Received' END AS action,
 CASE source WHEN 'congress' THEN amount_range ELSE CAST(value AS VARCHAR) END AS amount FROM feed_events""")
def x44(feed_events):
    kind = F.when(c("source") == "fund", F.coalesce("change_type", "signal_type")).otherwise(c("direction"))
    words = {"buy": "Buy", "sell": "Sell", "new": "New Position", "exit": "Exit", "increase": "Increase", "decrease": "Decrease", "hold": "Hold"}
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    action = F.coalesce(F.try_element_at(table, kind), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))
    return feed_events.select("event_id", action.alias("action"), F.when(c("source") == "congress", c("amount_range")).otherwise(c("value").cast("string")).alias("amount"))


@query("ST7_staleness", "trades", "insiders", "feed_events", sql="""
WITH u AS (SELECT 'congress' AS source, max(published_date) AS latest FROM trades UNION ALL SELECT 'insider', max(published_date) FROM insiders), e AS (SELECT source, count(*) AS n FROM feed_events WHERE signal_type = 'politician_trade' GROUP BY 1) SELECT u.source, latest, coalesce(n, 0) AS events, n IS NULL AND latest IS NOT NULL AS stale FROM u LEFT JOIN e USING (source)""")
def st7(trades, insiders, feed_events):
    """A source with fresh rows and no events of the watched type is stale."""
    latest = lambda rows, name: rows.agg(F.max("published_date").alias("latest")).select(F.lit(name).alias("source"), "latest")
    e = feed_events.where("signal_type = 'politician_trade'").groupBy("source").agg(F.count("*").alias("n"))
    u = latest(trades, "congress").unionByName(latest(insiders, "insider")).join(e, "source", "left")
    return u.select("source", "latest", F.coalesce("n", F.lit(0)).alias("events"), (c("n").isNull() & c("latest").isNotNull()).alias("stale"))


_FAILED = "CASE WHEN o_orderkey % 3 = 0 THEN '2024-D' || (o_custkey % 90) || ',bad' WHEN o_orderkey % 3 = 1 THEN '2023-E' || (o_custkey % 50) || ',2024-' ELSE '' END AS failed"


@query("ST10_failed_documents", "orders", sql=f"""
WITH r AS (SELECT o_orderkey AS run, {_FAILED} FROM orders), d AS (SELECT run, unnest(string_split(failed, ',')) AS doc FROM r), p AS (SELECT CAST(regexp_extract(doc, '^([0-9]+)-(.+)$', 1) AS INT) AS y, regexp_extract(doc, '^([0-9]+)-(.+)$', 2) AS doc, max(run) AS run FROM d WHERE regexp_matches(doc, '^[0-9]+-.+$') GROUP BY 1, 2)
SELECT y, doc, run FROM p ORDER BY run DESC, y, doc LIMIT 100""")
def st10(orders):
    """Documents that failed, newest run first, each once, at most a hundred to be tried again."""
    d = orders.selectExpr("o_orderkey as run", _FAILED).select("run", F.explode(F.split("failed", ",")).alias("id")).where(c("id").rlike("^[0-9]+-.+$"))
    part = lambda i: F.regexp_extract("id", "^([0-9]+)-(.+)$", i)
    return d.groupBy(part(1).cast("int").alias("y"), part(2).alias("doc")).agg(F.max("run").alias("run")).orderBy(F.desc("run"), "y", "doc").limit(100)


@query("SK14_run_metrics", "signals", sql="""
SELECT user_id AS run, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms, count(*) AS rows_seen, count(*) FILTER (WHERE signal_type = 'error') AS errors, '{"views":' || count(*) FILTER (WHERE signal_type = 'view') || '}' AS run_metadata FROM signals GROUP BY 1""")
def sk14(signals):
    """One row a run: start to finish in milliseconds, known counts as columns, all others as JSON."""
    span = F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000)
    return signals.groupBy(c("user_id").alias("run")).agg(span.alias("duration_ms"), F.count("*").alias("rows_seen"), F.count_if(c("signal_type") == "error").alias("errors"),
                                                          F.to_json(F.struct(F.count_if(c("signal_type") == "view").alias("views"))).alias("run_metadata"))


@query("O6_interleaved_search", "companies", "members", sql="""
WITH k AS (SELECT 'company' AS kind, ticker AS id, lower(name) AS v, 6 AS most FROM companies UNION ALL SELECT 'politician', member_id, lower(party || ' ' || state), 4 FROM members), s AS (SELECT *, CASE WHEN starts_with(v, 'b') THEN 850 WHEN contains(v, ' b') THEN 760 ELSE 0 END AS score FROM k),
t AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) <= most) SELECT kind, id, score FROM t ORDER BY score < 850, kind, score DESC, id LIMIT 8""")
def o6(companies, members):
    """Strong companies, strong politicians, then the weak ones, eight in all, from six and four candidates."""
    def best(rows, kind, key, text, most):
        s = rows.select(F.lit(kind).alias("kind"), c(key).alias("id"), S.search_score(text, "b").alias("score")).where("score >= 760")
        return s.orderBy(F.desc("score"), "id").limit(most)
    both = best(companies, "company", "ticker", c("name"), 6).unionByName(best(members, "politician", "member_id", F.concat_ws(" ", "party", "state"), 4))
    return both.orderBy(c("score") < 850, "kind", F.desc("score"), "id").limit(8)


@query("U4_profile_upsert", "stored", "incoming", sql="""
SELECT key, coalesce(i.name, s.name) AS name, coalesce(s.created_at, i.created_at) AS created_at FROM stored s FULL JOIN incoming i USING (key)""")
def u4(stored, incoming):
    """New values win, old creation dates stay."""
    i = incoming.select("key", c("name").alias("n"), c("created_at").alias("d"))
    return stored.join(i, "key", "full").select("key", F.coalesce("n", "name").alias("name"), F.coalesce("created_at", "d").alias("created_at"))


@query("S36_fund_scores", "feed_events", sql="""
SELECT event_id, CAST(least(0.99, CASE WHEN change_type IN ('new', 'increase') THEN 0.58 WHEN change_type = 'exit' THEN 0.46 ELSE 0.40 END + CASE WHEN change_type IN ('new', 'exit') THEN 0.12 ELSE 0 END
 + CASE WHEN value * 200 >= 100000000 THEN 0.12 WHEN value * 200 >= 10000000 THEN 0.08 WHEN value * 200 >= 1000000 THEN 0.04 ELSE 0 END + CASE WHEN change_pct * 10000 >= 1000000 THEN 0.08 WHEN change_pct * 10000 >= 100000 THEN 0.05 ELSE 0 END) AS DECIMAL(5,2)) AS score FROM feed_events WHERE source = 'fund'""")
def s36(feed_events):
    """Scores of fund changes (values and shares scaled up, as the synthetic ones are small)."""
    change = F.coalesce("change_type", F.lit("hold"))
    return feed_events.where("source = 'fund'").select("event_id", S.fund_score(change, c("value") * 200, c("change_pct") * 10_000).alias("score"))


@query("X28_member_filings", "members", "trades", sql="""
SELECT m.member_id, year(t.published_date) AS y, count(DISTINCT regexp_replace(t.doc_id, '-[0-9]+$', '')) AS filings FROM members m JOIN trades t ON regexp_replace(lower(m.full_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(t.politician_name), '[^a-z0-9]', '', 'g') GROUP BY 1, 2""")
def x28(members, trades):
    """Filings of each member by year, joined by the normalised name; filings are reduced to one row each before the join."""
    f = trades.select(S.actor_key(c("politician_name")).alias("k"), F.year("published_date").alias("y"), S.filing_key(c("doc_id")).alias("filing")).distinct()
    f = f.groupBy("k", "y").agg(F.count("*").alias("filings"))
    return members.select("member_id", S.actor_key(c("full_name")).alias("k")).join(f, "k").groupBy("member_id", "y").agg(F.sum("filings").alias("filings"))
