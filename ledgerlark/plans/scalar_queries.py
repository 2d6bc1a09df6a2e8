"""Scalar functions, each over a whole domain view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import calendar as K
from ledgerlark.functions import labels as L
from ledgerlark.functions import options as O
from ledgerlark.functions import scalars as S
from ledgerlark.functions import themes as T
from ledgerlark.operators import relations as R
from ledgerlark.plans.catalog import query
from ledgerlark.plans.filters import O_WORDS
from ledgerlark.sources.adapters import AS_OF

c = F.col


@query("S1_S4_directions", "codes", sql="""
WITH n AS (SELECT *, lower(trim(raw)) r FROM codes), e AS (SELECT *, CASE WHEN r = '' THEN NULL WHEN r IN ('buy', 'purchase', 'p') THEN 'buy' WHEN r IN ('sell', 'sale', 's') THEN 'sell' WHEN r IN ('increase', 'increased') THEN 'increase'
 WHEN r IN ('decrease', 'decreased', 'reduce', 'reduced') THEN 'decrease' WHEN r IN ('hold', 'held') THEN 'hold' ELSE r END AS event FROM n)
SELECT DISTINCT raw, code, event, CASE WHEN r LIKE 'buy%' OR r LIKE 'purchase%' OR r = 'p' THEN 'buy' WHEN r LIKE 'sell%' OR r LIKE 'sale%' OR r = 's' THEN 'sell' ELSE 'other' END AS profile,
 CASE WHEN upper(r) IN ('P', 'BUY', 'PURCHASE') THEN 'buy' WHEN upper(r) IN ('S', 'SELL', 'SALE') THEN 'sell' WHEN upper(code) = 'A' THEN 'buy' WHEN upper(code) = 'D' THEN 'sell' ELSE 'other' END AS insider,
 CASE coalesce(event, 'unknown') WHEN 'buy' THEN 'bought' WHEN 'sell' THEN 'sold' WHEN 'increase' THEN 'increased' WHEN 'decrease' THEN 'decreased' WHEN 'hold' THEN 'held' WHEN 'exchange' THEN 'exchanged' WHEN 'unknown' THEN 'reported' ELSE event END AS past FROM e""")
def directions(codes):
    event = S.event_direction(c("raw"))
    return codes.select("raw", "code", event.alias("event"), S.profile_direction(c("raw")).alias("profile"), S.insider_direction(c("raw"), c("code")).alias("insider"), S.past_tense(event).alias("past")).distinct()


@query("S5_S8_names", "people", sql="""
WITH n AS (SELECT *, lower(strip_accents(name)) p FROM people)
SELECT c_custkey, regexp_replace(p, '[^a-z0-9]', '', 'g') AS actor_key, coalesce(nullif(lower(trim(member_id)), ''), regexp_replace(p, '[^a-z0-9]', '', 'g')) AS match_key,
 array_to_string(list_filter(regexp_extract_all(p, '[a-z]+'), lambda x: x NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v')), ' ') AS tokens FROM n""")
def names(people):
    return people.select("c_custkey", S.actor_key(c("name")).alias("actor_key"), S.actor_match_key(c("member_id"), c("name")).alias("match_key"), F.array_join(S.name_tokens(c("name")), " ").alias("tokens"))


@query("F14_entity_names", "people", sql="""
SELECT c_custkey, len(list_intersect(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), ['inc', 'corp', 'corporation', 'holdings', 'partners', 'trust', 'services', 'management', 'capital', 'group'])) > 0
 OR contains(' ' || regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') || ' ', ' l p ') AS is_entity FROM people""")
def entities(people):
    return people.select("c_custkey", S.is_entity_name(c("name")).alias("is_entity"))


@query("S10_S14_ids", "trades", "insiders", sql="""
SELECT regexp_replace(doc_id, '-[0-9]+$', '') AS filing, sha1(coalesce(doc_id, '') || '|' || coalesce(ticker, '') || '|' || direction) AS stable,
 sha256(doc_id || '|' || amount_range) AS content, count(*) AS n FROM trades GROUP BY ALL
UNION ALL SELECT regexp_extract(source_url, '([0-9]{10}-[0-9]{2}-[0-9]{6})', 1), sha1(source_url), sha256(source_url), count(*) FROM insiders GROUP BY ALL""")
def ids(trades, insiders):
    """Rows are grouped by the texts and hashed after that: texts share beginnings and pack well, hashes do not pack at all.

    Of a document its id, what was traded and the range tell its groups apart: the other texts are made of them. Trades are written once
    with no more than that, so that what their joins shuffled is gone when they are grouped.
    """
    named = R.staged(trades.select("doc_id", S.id_text(c("ticker"), c("direction")).alias("what"), F.when(c("doc_id").isNotNull(), c("amount_range")).alias("amount_range")))
    a = named.groupBy("doc_id", "what", "amount_range").agg(F.count(F.lit(1)).alias("n")).select(
        S.filing_key(c("doc_id")).alias("filing"), S.id_text(c("doc_id"), c("what")).alias("s"), F.concat("doc_id", F.lit("|"), "amount_range").alias("t"), "n")
    b = insiders.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"))
    return a.select("filing", F.sha1("s").alias("stable"), F.sha2("t", 256).alias("content"), "n").unionAll(
        b.select(S.accession(c("source_url")).alias("filing"), S.stable_id(c("source_url")).alias("stable"), F.sha2("source_url", 256).alias("content"), "n"))


_UUID = "sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || encode(c_custkey || '|' || c_name))"


@query("S13_name_uuids", "customer", sql=f"""
WITH h AS (SELECT c_custkey, {_UUID} h FROM customer)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def uuids(customer):
    return customer.select("c_custkey", S.stable_uuid(c("c_custkey"), c("c_name")).alias("uuid"))


_WORDS = "{" + ", ".join(f"'{k}': '{v}'" for k, v in S.ISSUER_WORDS.items()) + "}"
_NOTHING = ", ".join(f"'{w}'" for w in S.ISSUER_NOTHING)


@query("S15_S17_issuers", "issuers", sql=f"""
WITH t AS (SELECT *, replace(replace(regexp_replace(regexp_replace(replace(upper(issuer), '&', ' AND '), '/[A-Z]{{2,4}}/', ' ', 'g'), '/[A-Z]{{2,4}}\\b', ' ', 'g'), 'BANK AMERICA', 'BANK OF AMERICA'), 'INCORPORATED', 'INC') t FROM issuers),
w AS (SELECT *, list_transform(regexp_extract_all(t, '[A-Z0-9]+'), lambda w: coalesce(MAP {_WORDS}[w], w)) w FROM t)
SELECT p_partkey, array_to_string(list_filter(w, lambda x: x NOT IN ({_NOTHING}) AND (length(x) > 1 OR x IN ('A', 'B', 'C'))), ' ') AS name,
 CASE WHEN upper(title) LIKE '%ADR%' THEN 'ADR' ELSE CASE upper(title) WHEN 'CL A' THEN 'A' WHEN 'COM SER C' THEN 'C' WHEN 'CLASS B' THEN 'B' ELSE 'COMMON' END END AS share_class,
 coalesce(trim(put_call), '') = '' AND upper(trim(coalesce(share_type, ''))) IN ('', 'SH') AND title <> 'PFD' AS is_equity,
 CASE exchange WHEN 'Nasdaq' THEN 0 WHEN 'NYSE' THEN 1 ELSE 99 END AS exchange_rank FROM w""")
def issuers(issuers):
    return issuers.select("p_partkey", S.issuer_name(c("issuer")).alias("name"), S.share_class(c("title")).alias("share_class"), S.is_equity_row(c("title"), c("put_call"), c("share_type")).alias("is_equity"), S.exchange_rank(c("exchange")).alias("exchange_rank"))


@query("S19_options", "options", sql=r"""
WITH t AS (SELECT *, upper(coalesce(asset_type, '')) = 'OP' op, trim(regexp_replace(text, '\s+', ' ', 'g')) t, """ + O_WORDS + r""" w FROM options),
f AS (SELECT *, list_transform(list_filter(w, lambda x: x NOT IN ('price', 'of', 'date')), lambda x: CASE WHEN x IN ('expire', 'expires', 'expiration') THEN '#' ELSE x END) f FROM t),
d AS (SELECT *, list_filter(range(1, len(w)), lambda i: w[i] IN ('call', 'put') AND w[i + 1] IN ('option', 'options'))[1] s, replace(f[nullif(list_position(f, 'strike'), 0) + 1], ',', '') a, f[nullif(list_position(f, '#'), 0) + 1] e,
 contains(lower(text), '[op]') OR list_has_any(w, ['option', 'strike', 'expire', 'expiration']) mark FROM f),
x AS (SELECT *, w[s] side, CASE WHEN try_cast(a AS DOUBLE) IS NOT NULL THEN a END strike, coalesce(CASE length(string_split(e, '/')[3]) WHEN 2 THEN try_strptime(e, '%m/%d/%y') ELSE try_strptime(e, '%m/%d/%Y') END, try_strptime(e, '%Y-%m-%d'))::DATE expiry FROM d),
o AS (SELECT *, (op OR mark) AND (op OR side IS NOT NULL OR strike IS NOT NULL OR expiry IS NOT NULL) is_option FROM x),
k AS (SELECT *, CASE WHEN op OR mark OR (is_option AND (side IS NOT NULL OR strike IS NOT NULL OR expiry IS NOT NULL)) THEN 'OP' WHEN coalesce(asset_type, '') = '' THEN 'Stock' ELSE upper(asset_type) END kind FROM o)
SELECT p_partkey, CASE WHEN is_option THEN side END AS side, CASE WHEN is_option THEN strike END AS strike, CASE WHEN is_option THEN expiry END AS expiry, kind,
 concat_ws(' | ', regexp_replace(t, '\s*\[OP\]\s*$', '') || CASE kind WHEN 'OP' THEN ' [OP]' ELSE '' END, CASE WHEN is_option THEN upper(side[1]) || side[2:] || ' option' END, CASE WHEN is_option THEN 'Strike $' || strike END, CASE WHEN is_option THEN 'Expires ' || expiry END) AS label FROM k""")
def options(options):
    o = options.withColumn("o", O.details(c("text"), c("asset_type")))
    return o.select("p_partkey", "o.side", "o.strike", "o.expiry", O.asset_type(c("asset_type"), c("text"), c("o")).alias("kind"), O.label(c("text"), c("asset_type"), c("o")).alias("label"))


@query("S20_S24_amounts", "trades", sql="""
WITH t AS (SELECT amount_range, direction, amount, count(*) n FROM trades GROUP BY ALL), b AS (SELECT *, list_transform(regexp_extract_all(amount_range, '[0-9][0-9,]*'), lambda x: CAST(replace(x, ',', '') AS BIGINT)) v FROM t)
SELECT amount_range, direction, amount, n, v[1] AS floor, least(v[1], v[2]) AS low, greatest(v[1], v[2]) AS high, CAST((v[1] + v[2]) / 2 AS DECIMAL(18,1)) AS mid,
 regexp_replace(regexp_replace(CAST(CAST(amount AS DECIMAL(38,4)) AS VARCHAR), '0+$', ''), '[.]$', '') AS component,
 CAST(CASE direction WHEN 'buy' THEN 0.72 ELSE 0.56 END + CASE v[1] WHEN 50001 THEN 0.05 ELSE 0 END AS DECIMAL(5,2)) AS score FROM b""")
def amounts(trades):
    t = trades.groupBy("amount_range", "direction", "amount").agg(F.count(F.lit(1)).alias("n")).withColumn("r", S.amount_range(c("amount_range")))
    return t.select("amount_range", "direction", "amount", "n", S.amount_lower_bound(c("amount_range")).alias("floor"), c("r.min").alias("low"), c("r.max").alias("high"), c("r.mid").alias("mid"),
                    S.numeric_component(c("amount")).alias("component"), S.politician_score(c("direction"), c("amount_range")).alias("score"))


@query("S26_S33_dates", "trades", sql="""
SELECT published_date, transaction_date, count(*) AS n, CASE WHEN transaction_date <= published_date THEN transaction_date END AS calendar_date, least(transaction_date, published_date) AS feed_date, CAST(date_trunc('week', published_date) AS DATE) AS week_start,
 'Q' || quarter(transaction_date) || ' ' || year(transaction_date) AS quarter, greatest(datediff('day', transaction_date, published_date), 0) AS days,
 CAST(date_trunc('week', date_trunc('month', published_date)) AS DATE) AS grid_start, CAST(date_trunc('week', last_day(published_date)) AS DATE) + 6 AS grid_end FROM trades GROUP BY ALL""")
def dates(trades):
    p, t = c("published_date"), c("transaction_date")
    first, last = K.month_grid(F.trunc(p, "month"))
    return trades.groupBy("published_date", "transaction_date").agg(F.count(F.lit(1)).alias("n")).select(
        "published_date", "transaction_date", "n", S.calendar_transaction_date(t, p).alias("calendar_date"), S.feed_transaction_date(t, p).alias("feed_date"), S.week_start(p).alias("week_start"), S.quarter_label(t).alias("quarter"),
        S.days_between(t, p).alias("days"), first.alias("grid_start"), last.alias("grid_end"))


@query("S26_date_parsing", "orders", sql="""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/') || '0' || (o_orderkey % 10) WHEN 3 THEN '2/30/2024' ELSE 'n/a' END AS raw FROM orders)
SELECT o_orderkey, raw, CAST(coalesce(try_strptime(raw, '%Y-%m-%d'), CASE WHEN regexp_matches(raw, '/[0-9]{4}$') THEN try_strptime(raw, '%m/%d/%Y') ELSE try_strptime(raw, '%m/%d/%y') END) AS DATE) AS parsed FROM r""")
def parsed(orders):
    d = c("o_orderdate")
    raw = F.when(c("o_orderkey") % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(c("o_orderkey") % 5 == 1, F.date_format(d, "M/d/yyyy")).when(c("o_orderkey") % 5 == 2, F.concat(F.date_format(d, "MM/dd/"), F.lit("0"), c("o_orderkey") % 10)).when(c("o_orderkey") % 5 == 3, "2/30/2024").otherwise("n/a")
    return orders.select("o_orderkey", raw.alias("raw")).withColumn("parsed", S.parsed_date(c("raw")))


_HOLIDAYS = """y AS (SELECT range y FROM range(1994, 2004)), fixed AS (SELECT make_date(y, m, d) d FROM y, (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) f(m, d)),
nth AS (SELECT make_date(y, m, 1) + CAST((wd - isodow(make_date(y, m, 1)) + 7) % 7 + (k - 1) * 7 AS INT) d FROM y, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) f(m, wd, k)),
may AS (SELECT make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) - 1) AS INT) d FROM y),
h AS (SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END d, year(d) y FROM fixed UNION SELECT d, year(d) FROM nth UNION SELECT d, year(d) FROM may)"""


@query("S31_S32_filing_deadlines", "holdings", sql=f"""
WITH {_HOLIDAYS}, p AS (SELECT DISTINCT report_period FROM holdings),
s AS (SELECT report_period, CAST(unnest(generate_series(report_period + 45, report_period + 55, INTERVAL 1 DAY)) AS DATE) d FROM p)
SELECT report_period, min(d) AS due, last_day(report_period + INTERVAL 3 MONTH) + 45 AS next_filing FROM s WHERE isodow(d) < 6 AND NOT EXISTS (SELECT 1 FROM h WHERE h.d = s.d AND h.y = year(s.d)) GROUP BY report_period""")
def deadlines(holdings):
    p = c("report_period")
    return holdings.select(p).distinct().select(p, K.filing_due(p).alias("due"), K.next_filing(p).alias("next_filing"))


@query("S34_S40_scores", "insiders", sql="""
WITH t AS (SELECT transaction_code, amount * shares AS value, count(*) n FROM insiders GROUP BY ALL)
SELECT transaction_code, value, n, CAST(least(0.99, CASE transaction_code WHEN 'P' THEN 0.68 ELSE 0.48 END + CASE WHEN value >= 10000000 THEN 0.18 WHEN value >= 1000000 THEN 0.12 WHEN value >= 250000 THEN 0.06 ELSE 0 END) AS DECIMAL(5,2)) AS score FROM t""")
def insider_scores(insiders):
    t = insiders.groupBy("transaction_code", (c("amount") * c("shares")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("transaction_code", c("value").cast("decimal(36,4)").alias("value"), "n", S.insider_score(S.insider_direction(c("transaction_code"), F.lit(None).cast("string")), c("value")).alias("score"))


@query("S38_S41_cluster_scores", "trades", sql="""
WITH g AS (SELECT ticker, direction, count(DISTINCT member_id) actors, max(amount_floor) f, sum(amount) v, count(*) n FROM trades WHERE ticker IS NOT NULL GROUP BY 1, 2)
SELECT ticker, direction, actors, CAST(least(0.99, 0.84 + least(0.04 * greatest(actors - 2, 0), 0.12)) AS DECIMAL(5,2)) AS congress, CAST(least(0.99, 0.90 + least(0.01 * greatest(actors - 2, 0), 0.05)) AS DECIMAL(5,2)) AS crossed,
 CAST(least(0.99, 0.70 + 0.08 + CASE WHEN actors >= 3 THEN least(0.04, 0.02 * (actors - 2)) ELSE 0 END + CASE WHEN v >= 1000000 THEN 0.04 ELSE 0 END + CASE WHEN v >= 5000000 THEN 0.02 ELSE 0 END + CASE WHEN v >= 20000000 THEN 0.02 ELSE 0 END) AS DECIMAL(5,2)) AS broadcast,
 CAST(least(0.99, 0.82 + CASE WHEN n % 250 >= 200 THEN 0.12 WHEN n % 250 >= 100 THEN 0.08 WHEN n % 250 >= 50 THEN 0.05 WHEN n % 250 >= 40 THEN 0.03 ELSE 0 END + CASE WHEN actors <= 90 THEN 0.04 WHEN actors <= 180 THEN 0.03 WHEN actors <= 270 THEN 0.02 WHEN actors <= 365 THEN 0.01 ELSE 0 END
  + CASE WHEN f >= 500000 THEN 0.02 WHEN f >= 250000 THEN 0.01 ELSE 0 END + CASE WHEN actors <= 120 AND n % 250 >= 40 THEN 0.02 ELSE 0 END) AS DECIMAL(5,2)) AS gain FROM g""")
def cluster_scores(trades):
    g = trades.where("ticker is not null").groupBy("ticker", "direction").agg(F.count_distinct("member_id").alias("actors"), F.max("amount_floor").alias("f"), F.sum("amount").alias("v"), F.count(F.lit(1)).alias("n"))
    gain = c("n") % 250
    return g.select("ticker", "direction", "actors", S.cluster_score(c("actors"), "0.84").alias("congress"), S.cluster_score(c("actors"), "0.90", "0.01", "0.05").alias("crossed"),
                    S.broadcast_cluster_score(F.lit("0.70").cast("decimal(5,2)"), c("v"), c("actors")).alias("broadcast"), S.performance_score(gain, gain, c("actors"), c("f")).alias("gain"))


@query("S42_S43_themes", "companies", "nation", sql="""
WITH t AS (SELECT ticker AS key, [x for x in [CASE WHEN contains(name, 'red') OR contains(name, 'blue') THEN 'colours' END, CASE WHEN ticker = 'ABC' OR contains(name, 'bolt') OR contains(name, 'nut') THEN 'fasteners' END,
 CASE WHEN ticker IN ('AAB', 'AAC') OR contains(name, 'ring') THEN 'jewels' END, CASE WHEN contains(name, 'widget') OR contains(name, 'gear') THEN 'parts' END] if x IS NOT NULL] AS l FROM companies
UNION ALL SELECT n_name, [x for x in [CASE WHEN contains(upper(n_name), 'AFRICA') OR contains(upper(n_name), 'ASIA') THEN 'colours' END, CASE WHEN contains(upper(n_name), 'AMERICA') OR contains(upper(n_name), 'ASIA') THEN 'fasteners' END, CASE WHEN contains(upper(n_name), 'EUROPE') THEN 'jewels' END] if x IS NOT NULL] FROM nation)
SELECT key, array_to_string(l, ',') AS themes FROM t""")
def themes(companies, nation):
    a = companies.select(c("ticker").alias("key"), F.array_join(T.infer(c("ticker"), c("name")), ",").alias("themes"))
    return a.unionAll(nation.select("n_name", F.array_join(T.of_committee(c("n_name")), ",")))


@query("S44_labels", "holdings", sql="""
WITH g AS (SELECT fund_name, report_period, CAST(sum(shares_held) AS BIGINT) s, CAST(sum(value_held) AS DECIMAL(20,2)) v, list_sort(list(DISTINCT ticker)) t FROM holdings GROUP BY 1, 2)
SELECT fund_name, report_period, format('${:,}+', CAST(round(v) AS BIGINT)) AS floor_label, CASE WHEN v >= 1000000 THEN '$' || CAST(CAST(round(v / 1000000, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'M' ELSE '$' || format('{:,}', CAST(round(v / 1000) AS BIGINT)) || 'K' END AS compact,
 strftime(report_period, '%b %-d, %Y') AS day, array_to_string(t[1:4], ', ') || CASE WHEN len(t) > 4 THEN ', +' || (len(t) - 4) || ' more' ELSE '' END AS names,
 CASE WHEN s >= 10000 THEN CAST(CAST(round(s / 1000) AS BIGINT) AS VARCHAR) || 'K shares' WHEN s >= 1000 THEN regexp_replace(CAST(CAST(round(CAST(s AS DECIMAL(20,2)) / 1000, 1) AS DECIMAL(20,1)) AS VARCHAR), '\\.0$', '') || 'K shares' WHEN s = 1 THEN '1 share' ELSE s || ' shares' END AS shares,
 CASE WHEN length(array_to_string(t, ', ')) <= 60 THEN array_to_string(t, ', ') ELSE rtrim(substr(array_to_string(t, ', '), 1, 57)) || '...' END AS cut FROM g""")
def label_texts(holdings):
    g = holdings.groupBy("fund_name", "report_period").agg(F.sum("shares_held").alias("s"), F.sum("value_held").cast("decimal(20,2)").alias("v"), F.array_sort(F.collect_set("ticker")).alias("t"))
    return g.select("fund_name", "report_period", L.money_floor(c("v")).alias("floor_label"), L.compact_money(c("v")).alias("compact"), L.short_date(c("report_period")).alias("day"), L.name_list(c("t")).alias("names"),
                    L.compact_shares(c("s")).alias("shares"), L.cut(F.array_join("t", ", "), 60).alias("cut"))


@query("S45_S47_search_scores", "companies", sql="""
WITH v AS (SELECT ticker, name, trim(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) v FROM companies), w AS (SELECT *, string_split(v, ' ') w, replace(v, ' ', '') t FROM v),
s AS (SELECT ticker, name, greatest(CASE WHEN t = 'redrinq' THEN 1000 WHEN starts_with(t, 'redrinq') THEN 850 WHEN contains(t, 'redrinq') THEN 700 ELSE 0 END, CASE WHEN len([x for x in w if starts_with(x, 'red')]) > 0 AND len([x for x in w if starts_with(x, 'rinq')]) > 0 THEN 760 ELSE 0 END,
 CASE WHEN len([x for x in w if starts_with(x, 'red')]) > 0 THEN 720 WHEN len([x for x in w if levenshtein(x, 'red') = 1]) > 0 THEN 640 ELSE 0 END,
 CASE WHEN len([x for x in w if starts_with(x, 'rinq')]) > 0 THEN 720 WHEN len([x for x in w if levenshtein(x, 'rinq') = 1]) > 0 THEN 640 ELSE 0 END) AS score,
 CASE WHEN t = 'smal' THEN 1000 WHEN starts_with(t, 'smal') THEN 850 WHEN len([x for x in w if starts_with(x, 'smal')]) > 0 THEN 760 WHEN contains(t, 'smal') THEN 700 WHEN len([x for x in w if levenshtein(x, 'smal') = 1]) > 0 THEN 640 ELSE 0 END AS short_score FROM w)
SELECT * FROM s WHERE score > 0 OR short_score > 0""")
def search_scores(companies):
    return companies.select("ticker", "name", S.search_score(c("name"), "Red  rinq").alias("score"), S.search_score(c("name"), "smal").alias("short_score")).where("score > 0 or short_score > 0")


@query("S48_S49_keys", "trades", sql="""
SELECT DISTINCT 'congress-window-v1:' || ticker || ':' || direction || ':' || transaction_date || ':' || published_date AS cluster_key, ticker AS part, concat_ws('::', 'broadcast', 'large_politician_buy', regexp_replace(doc_id, '-[0-9]+$', ''), lower(member_id), CAST(published_date AS VARCHAR), lower(ticker)) AS candidate_key FROM trades WHERE ticker IS NOT NULL""")
def keys(trades):
    key = F.concat_ws(":", F.lit("congress-window-v1"), "ticker", "direction", c("transaction_date").cast("string"), c("published_date").cast("string"))
    story = F.concat_ws("::", F.lit("broadcast"), F.lit("large_politician_buy"), S.filing_key(c("doc_id")), S.actor_match_key(c("member_id"), F.lit("")), c("published_date").cast("string"), F.lower("ticker"))
    return trades.where("ticker is not null").select(key.alias("cluster_key"), F.split(key, ":")[1].alias("part"), story.alias("candidate_key")).distinct()


@query("S50_json_fields", "events", sql="""
SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.missing') AS has_missing, count(*) AS n, '{"k":' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1) || '}' AS raised FROM events GROUP BY ALL""")
def json_fields(events):
    p = F.from_json("props", "k long, missing string")
    return events.withColumn("p", p).groupBy("event_type", c("p.k").alias("k"), c("p.missing").isNotNull().alias("has_missing")).agg(F.count(F.lit(1)).alias("n")).withColumn("raised", F.to_json(F.struct((c("k") + 1).alias("k"))))


@query("S52_returns", "prices", sql="""
WITH r AS (SELECT ticker, price_date, price, lag(price) OVER (PARTITION BY ticker ORDER BY price_date) p FROM prices)
SELECT ticker, price_date, price, CAST(round((price - p) * 100 / CAST(p AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS gain_pct FROM r WHERE p > 0""")
def returns(prices):
    from pyspark.sql import Window
    r = prices.withColumn("p", F.lag("price").over(Window.partitionBy("ticker").orderBy("price_date"))).where("p > 0")
    return r.select("ticker", "price_date", "price", F.round((c("price") - c("p")) * 100 / c("p"), 2).cast("decimal(18,2)").alias("gain_pct"))


@query("S53_insider_roles", "insiders", sql="""
WITH f AS (SELECT filer_name, max(CASE relation WHEN 'Chief Executive Officer' THEN relation END) t, bool_or(relation = 'Director') d, bool_or(relation = '10% Owner') o FROM insiders GROUP BY 1)
SELECT filer_name, CASE WHEN t IS NOT NULL THEN t WHEN d THEN 'Director' WHEN o THEN '10% Owner' ELSE 'Other' END AS role FROM f""")
def roles(insiders):
    f = insiders.groupBy("filer_name").agg(F.max(F.when(c("relation") == "Chief Executive Officer", c("relation"))).alias("t"), F.bool_or(c("relation") == "Director").alias("d"), F.bool_or(c("relation") == "10% Owner").alias("o"))
    return f.select("filer_name", S.insider_role(c("t"), c("d"), c("o")).alias("role"))


@query("S55_source_urls", "insiders", sql="""
SELECT DISTINCT source_url, string_split(source_url, '#')[1] AS document, CAST(string_split(source_url, '#')[2] AS INT) AS tx_index, 'archives/' || replace(regexp_extract(source_url, '([0-9]{10}-[0-9]{2}-[0-9]{6})', 1), '-', '') || '/' || regexp_extract(source_url, '([0-9]{10}-[0-9]{2}-[0-9]{6})', 1) || '.txt' AS canonical FROM insiders""")
def urls(insiders):
    a = S.accession(c("source_url"))
    parts = F.split("source_url", "#")
    return insiders.select("source_url", parts[0].alias("document"), parts[1].cast("int").alias("tx_index"), F.concat(F.lit("archives/"), F.replace(a, F.lit("-"), F.lit("")), F.lit("/"), a, F.lit(".txt")).alias("canonical")).distinct()


@query("S25_safe_casts", "pages", sql="""
WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN '1e999' WHEN 2 THEN 'x' || page_id ELSE ' 12.5 ' END AS raw FROM pages)
SELECT page_id, raw, CASE page_id % 4 WHEN 0 THEN CAST(page_id AS DOUBLE) WHEN 3 THEN 12.5 END AS real, CASE page_id % 4 WHEN 0 THEN page_id END AS whole FROM r""")
def casts(pages):
    raw = F.when(c("page_id") % 4 == 0, c("page_id").cast("string")).when(c("page_id") % 4 == 1, "1e999").when(c("page_id") % 4 == 2, F.concat(F.lit("x"), "page_id")).otherwise(" 12.5 ")
    r = pages.select("page_id", raw.alias("raw"))
    real = c("raw").try_cast("double")
    return r.select("page_id", "raw", F.when(~F.isnan(real) & (F.abs(real) < float("inf")), real).alias("real"), F.when(c("raw").rlike(r"^\s*-?\d+\s*$"), F.trim("raw").try_cast("long")).alias("whole"))


@query("S46_edit_distance", "companies", "people", sql="""
WITH a AS (SELECT DISTINCT name FROM companies), b AS (SELECT DISTINCT name FROM companies)
SELECT a.name, b.name AS other, levenshtein(a.name, b.name) AS distance FROM a JOIN b ON substr(a.name, 1, 2) = substr(b.name, 1, 2) AND a.name < b.name WHERE levenshtein(a.name, b.name) <= 6""")
def near_names(companies, people):
    a = companies.select("name", F.substring("name", 1, 2).alias("k")).distinct()
    b = a.withColumnRenamed("name", "other")
    return a.join(b, "k").where("name < other").select("name", "other", F.levenshtein("name", "other", 6).alias("distance")).where("distance >= 0")


@query("S56_S23_bridge_ids", "pages", sql="""
SELECT page_id, CASE WHEN regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) <> '' THEN 'page-' || regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) || '-' || regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) ELSE 'lead-' || page_id END AS doc_id,
 CASE page_id % 4 WHEN 0 THEN '$1,001 - $15,000' WHEN 1 THEN '$15,001 - $50,000' WHEN 2 THEN '$50,001 - $100,000' END AS amount_range FROM pages""")
def bridge_ids(pages):
    kind, number = (F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", k) for k in (1, 2))
    short = F.when(c("page_id") % 4 == 0, "1K–15K").when(c("page_id") % 4 == 1, "15K–50K").when(c("page_id") % 4 == 2, "50K–100K").otherwise("?")
    table = F.create_map(*(F.lit(x) for kv in SHORT_RANGES.items() for x in kv))
    return pages.select("page_id", F.when(number != "", F.concat_ws("-", F.lit("page"), kind, number)).otherwise(F.concat(F.lit("lead-"), "page_id")).alias("doc_id"), F.try_element_at(table, short).alias("amount_range"))


#: Short range labels and the disclosed ranges they stand for (fixed values).
SHORT_RANGES = {"1K–15K": "$1,001 - $15,000", "15K–50K": "$15,001 - $50,000", "50K–100K": "$50,001 - $100,000", "100K–250K": "$100,001 - $250,000", "250K–500K": "$250,001 - $500,000",
                "500K–1M": "$500,001 - $1,000,000", "1M–5M": "$1,000,001 - $5,000,000", "5M–25M": "$5,000,001 - $25,000,000", "25M–50M": "$25,000,001 - $50,000,000"}


@query("X10_range_buckets", "trades", sql=f"""
SELECT CASE WHEN d <= 90 THEN '3mo' WHEN d <= 180 THEN '6mo' WHEN d <= 365 THEN '1y' WHEN d <= 730 THEN '2y' WHEN d <= 1825 THEN '5y' ELSE '10y' END AS bucket, count(*) AS n FROM (SELECT datediff('day', published_date, DATE '{AS_OF}') d FROM trades) GROUP BY 1""")
def buckets(trades):
    d = F.datediff(F.lit(AS_OF).cast("date"), "published_date")
    return trades.groupBy(F.when(d <= 90, "3mo").when(d <= 180, "6mo").when(d <= 365, "1y").when(d <= 730, "2y").when(d <= 1825, "5y").otherwise("10y").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
