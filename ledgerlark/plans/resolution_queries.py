"""Tickers of asset texts, and the list of companies they are looked up in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import assets as A
from ledgerlark.operators import resolve as R
from ledgerlark.plans.catalog import query

c = F.col


def _norm(x: str) -> str:
    """A text without tags, sums, dates and words of share kinds; these tables have no percentage before a word."""
    parts = r"\[[a-z]+\]|\$[0-9,.]+|[0-9]+/[0-9]+/[0-9]+|\bclass [a-z]\b|\bcommon stock\b|\bst\b|\bbill\b"
    return f"trim(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '{parts}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _words(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda x: x <> '' AND x NOT IN {A.STOP_WORDS})"


OTHER = str(list(A.OTHER_WORDS))
RANK = "CASE exchange WHEN 'Nasdaq' THEN 0 WHEN 'NYSE' THEN 1 ELSE 99 END"
COMPANIES = f"""l AS (SELECT ticker, name, exchange, 0 AS src, {_norm('name')} AS n FROM listed_reference UNION ALL
 SELECT ticker, name, '', 1, {_norm('name')} FROM listed_rows WHERE NOT (length(ticker) >= 5 AND starts_with(replace({_norm('name')}, ' ', ''), lower(ticker)))),
lw AS (SELECT *, {_words('n')} AS w FROM l), co AS (SELECT ticker, exchange, n, w FROM lw WHERE len(w) >= 2 AND NOT list_has_any(w, {OTHER}) AND NOT regexp_matches(name, '[0-9]/[0-9]') QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY src, name) = 1)"""


def _known(x: str) -> str:
    return (f"CASE WHEN regexp_extract({x}, '\\(([A-Za-z]{{1,6}})\\)', 1) <> '' THEN upper(regexp_extract({x}, '\\(([A-Za-z]{{1,6}})\\)', 1)) WHEN contains(upper({x}), 'UNITED STATES TREAS') THEN 'US-TREAS' "
            f"WHEN contains({_norm(x)}, 'intel') THEN 'INTC' WHEN contains({_norm(x)}, 'starbucks') THEN 'SBUX' END")


@query("X20_company_list", "listed_reference", "listed_rows", sql=f"WITH {COMPANIES} SELECT ticker, exchange, n AS name, array_to_string(w, ' ') AS words FROM co")
def company_list(listed_reference, listed_rows):
    return R.company_list(listed_reference, listed_rows).withColumn("words", F.array_join("words", " "))


@query("J19_house_tickers", "asset_texts", "listed_reference", "listed_rows", sql=f"""
WITH {COMPANIES}, a AS (SELECT *, coalesce({_known('asset')}, {_known('other')}) AS known, trim({_norm('asset')} || ' ' || coalesce({_norm('other')}, '')) AS blob FROM asset_texts),
t AS (SELECT p_partkey, unnest([0, 1]) AS turn, unnest([{_norm('asset')}, {_norm('other')}]) AS n FROM a WHERE known IS NULL AND NOT list_has_any(string_split(blob, ' '), {OTHER}) AND NOT regexp_matches(blob, '[0-9]') AND len({_words('blob')}) >= 2),
tw AS (SELECT *, {_words('n')} AS w FROM t WHERE n <> ''),
m AS (SELECT p_partkey, turn, co.ticker, co.n AS cn, {RANK} AS rank, CASE WHEN tw.n = co.n THEN 0 WHEN tw.w[1:least(len(tw.w), len(co.w), 3)] = co.w[1:least(len(tw.w), len(co.w), 3)] THEN 1 WHEN levenshtein(tw.n, co.n) = 1 AND abs(length(tw.n) - length(co.n)) = 1 THEN 2 END AS stage
 FROM tw JOIN co ON tw.w[1] = co.w[1] AND tw.w[2] = co.w[2]),
b AS (SELECT p_partkey, ticker FROM m WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY turn, stage, CASE WHEN stage > 0 THEN cn END, rank, CASE WHEN stage = 0 THEN length(ticker) END, ticker) = 1)
SELECT a.p_partkey, asset, coalesce(known, b.ticker, 'N/A') AS ticker FROM a LEFT JOIN b USING (p_partkey)""")
def house(asset_texts, listed_reference, listed_rows):
    rows = asset_texts.select(c("p_partkey").alias("row"), "asset", F.when(c("other").isNotNull(), F.array("other")).alias("others"))
    return R.house_tickers(rows, R.company_list(listed_reference, listed_rows)).select(c("row").alias("p_partkey"), "asset", "ticker")


@query("X17_senate_tickers", "asset_texts", "listed_reference", sql=r"""
WITH a AS (SELECT *, upper(asset) u, regexp_matches(' ' || upper(asset), ' LLC| L\.L\.C| L\.P\.| LP| PARTNERS| FAMILY| TRUST') private, regexp_matches(' ' || upper(asset), ' STOCK| SHARES| COMMON| ETF| ETN| ADR| ADS| INC| CORP| PLC') public FROM asset_texts),
s AS (SELECT list(ticker) AS every FROM listed_reference), f AS (SELECT *, CASE WHEN regexp_extract(asset, '\(([A-Z]{1,6})\)', 1) <> '' THEN regexp_extract(asset, '\(([A-Z]{1,6})\)', 1) WHEN contains(u, 'UNITED STATES TREAS') THEN 'US-TREAS' END AS fixed,
 CASE WHEN NOT private THEN list_filter(regexp_extract_all(u, '\b([A-Z]{1,5})\b', 1), lambda x: list_contains(every, x) AND x NOT IN ('NYSE', 'OTC', 'LLC', 'LP', 'INC', 'CORP', 'LTD'))[1] END AS word FROM a, s),
x AS (SELECT p_partkey, unnest([0, 1]) AS turn, unnest([lower(asset), trim(regexp_replace(regexp_replace(lower(asset), '\([^)]*\)', '', 'g'), '\s+', ' ', 'g'))]) AS begins FROM f WHERE fixed IS NULL AND (NOT private OR public)),
n AS (SELECT p_partkey, ticker FROM x JOIN listed_reference r ON starts_with(lower(r.name), begins) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY turn, ticker) = 1)
SELECT f.p_partkey, f.asset, coalesce(fixed, word, n.ticker) AS ticker FROM f LEFT JOIN n USING (p_partkey)""")
def senate(asset_texts, listed_reference):
    return R.senate_tickers(asset_texts.select(c("p_partkey").alias("row"), "asset"), listed_reference).select(c("row").alias("p_partkey"), "asset", "ticker")
