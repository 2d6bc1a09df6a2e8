"""Suggestions by all tokens with a second source, and by names and aliases with suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import search as Q
from ledgerlark.operators import suggest as G
from ledgerlark.plans.catalog import query

c = F.col
#: Persons that go by other names too.
NICKNAMES = [("Ann Notable", ["the notable", "annie n"])]
PERSONS, TICKERS = ("person 12", "supplier 00000001", "north group", "the notable", "zzz"), ("cold bolt", "blue", "TBC", "brand 12")


def _persons_sql(k: int, text: str) -> str:
    """One query: the newest rows that hold all tokens, the trades too where fewer than five persons are met, and an alias's person."""
    tokens, q = Q.tokens(text), text
    held = lambda name, words: " AND ".join(f"contains(lower({name}), '{t}')" for t in words)
    events = lambda words, n: f"(SELECT actor_name AS name, ticker, published_date AS date, {n} AS source FROM feed_events WHERE source = 'insider' AND {held('actor_name', words)} ORDER BY date DESC, name, ticker NULLS FIRST LIMIT 80)"
    trades = lambda words, n: f"(SELECT filer_name AS name, ticker, transaction_date AS date, {n} AS source FROM insiders WHERE {held('filer_name', words)} ORDER BY date DESC, name, ticker NULLS FIRST LIMIT 80)"
    key = "regexp_replace(lower(name), '[^a-z0-9]', '', 'g')"
    own = "annnotable" if Q.alias_score(NICKNAMES[0][1], text) else "-"
    more = f"UNION ALL SELECT name, ticker, date, source, '{own}' AS key FROM (SELECT * FROM (FROM {events(['ann', 'notable'], 2)} UNION ALL FROM {trades(['ann', 'notable'], 3)}) ORDER BY source, date DESC, name, ticker NULLS FIRST LIMIT 1)" if own != "-" else ""
    words = "string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ')"
    begin = " AND ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) > 0" for t in tokens)
    return f"""a{k} AS (SELECT * FROM {events(tokens, 0)}), b{k} AS (SELECT * FROM a{k} UNION ALL SELECT * FROM {trades(tokens, 1)} WHERE (SELECT count(DISTINCT {key}) FROM a{k}) < 5),
d{k} AS (SELECT *, {key} AS key FROM b{k} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY source, date DESC, name, ticker NULLS FIRST) = 1), e{k} AS (SELECT * FROM (SELECT * FROM d{k} {more}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY source) = 1),
w{k} AS (SELECT *, lower(name) AS v, {words} AS w FROM e{k}), s{k} AS (SELECT '{q}' AS query, name, ticker, date, (CASE WHEN v = '{q}' THEN 120 ELSE 0 END + CASE WHEN starts_with(v, '{q}') THEN 70 ELSE 0 END + CASE WHEN contains(v, '{q}') THEN 25 ELSE 0 END
 + CASE WHEN list_contains(w, '{q}') THEN 60 ELSE 0 END + CASE WHEN len(list_filter(w, lambda x: starts_with(x, '{q}'))) > 0 THEN 40 ELSE 0 END + CASE WHEN {begin} THEN 30 ELSE 0 END + CASE WHEN key = 'annnotable' THEN {348 - 40 if own != '-' else 8} ELSE 0 END)::INT AS score FROM w{k}),
t{k} AS (SELECT * FROM s{k} WHERE score > 0 ORDER BY score DESC, date DESC, name LIMIT 8)"""


@query("X35_insider_suggestions", "feed_events", "insiders", sql=f"WITH {', '.join(_persons_sql(k, q) for k, q in enumerate(PERSONS))} " + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(len(PERSONS))))
def persons(feed_events, insiders):
    events = feed_events.where("source = 'insider'")
    out = [G.insider_suggestions(events, insiders, NICKNAMES, q).select(F.lit(q).alias("query"), "*") for q in PERSONS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


_N = "trim(regexp_replace(replace(lower({}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def _tickers_sql(k: int, text: str) -> str:
    q, tick, parts = Q.normal(text), Q.ticker(text), Q.tokens(text)
    inside = " OR ".join(f"contains(lower(name), '{p}')" for p in {text.lower(), *parts})
    starts = " AND ".join(f"len(list_filter(words, lambda x: starts_with(x, '{p}'))) > 0" for p in parts)
    return f"""n{k} AS (SELECT ticker, company AS known, [{_N.format('other')}, {_N.format("'the ' || company")}] AS others FROM nicknames),
c{k} AS (SELECT d.ticker, coalesce(n.known, CASE WHEN NOT contains(lower(name), 'trust') THEN trim(regexp_replace(name, '( - Class A)? (Common Stock|Ordinary Shares).*$', '')) END, d.ticker) AS company, name AS raw, n.known, n.others FROM directory d LEFT JOIN n{k} n USING (ticker) WHERE starts_with(d.ticker, '{tick}') OR {inside}),
o{k} AS (SELECT ticker, known, known, known, others FROM n{k} WHERE (starts_with(ticker, '{tick}') OR len(list_filter(list_concat(others, [{_N.format('known')}, lower(ticker)]), lambda x: contains(x, '{q}'))) > 0) AND ticker NOT IN (SELECT ticker FROM c{k})),
u{k} AS (SELECT * FROM c{k} UNION ALL SELECT * FROM o{k}), v{k} AS (SELECT *, {_N.format('company')} AS n, list_distinct(list_concat(coalesce(others, []), [lower(ticker), {_N.format('company')}])) AS terms FROM u{k}), x{k} AS (SELECT *, flatten(list_transform(terms, lambda a: string_split(a, ' '))) AS words FROM v{k}),
s{k} AS (SELECT *, (CASE WHEN n = '{q}' THEN 180 ELSE 0 END + CASE WHEN starts_with(n, '{q}') THEN 120 ELSE 0 END + CASE WHEN contains(n, '{q}') THEN 60 ELSE 0 END + CASE WHEN ticker = '{tick}' THEN 260 ELSE 0 END + CASE WHEN starts_with(ticker, '{tick}') THEN 180 ELSE 0 END
 + list_sum(list_transform(terms, lambda a: CASE WHEN a = '{q}' THEN 210 WHEN starts_with(a, '{q}') THEN 130 WHEN contains(a, '{q}') THEN 55 ELSE 0 END)) + CASE WHEN {starts} THEN 55 ELSE 0 END - CASE WHEN contains(lower(raw), 'trust') THEN 20 ELSE 0 END)::INT AS score FROM x{k}),
t{k} AS (SELECT '{text}' AS query, ticker, company, score FROM s{k} s WHERE score > 0 AND NOT (known IS NULL AND length(ticker) > 4 AND EXISTS (SELECT 1 FROM s{k} a WHERE a.known IS NOT NULL AND a.score > 0 AND a.ticker <> s.ticker AND contains(s.n, a.n))) ORDER BY score DESC, ticker LIMIT 8)"""


@query("X34_ticker_suggestions", "directory", "nicknames", sql=f"WITH {', '.join(_tickers_sql(k, q) for k, q in enumerate(TICKERS))} " + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(len(TICKERS))))
def tickers(directory, nicknames):
    aliases = nicknames.select("ticker", "company", F.array("other", F.concat(F.lit("the "), "company")).alias("aliases"))
    out = [G.ticker_suggestions(directory, aliases, q).select(F.lit(q).alias("query"), "*") for q in TICKERS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("X34_suppressed_names", "directory", "nicknames", sql=f"""
SELECT DISTINCT d.ticker FROM directory d JOIN nicknames n ON d.ticker <> n.ticker AND length(d.ticker) > 4 AND contains({_N.format('d.name')}, {_N.format('n.company')}) WHERE d.ticker NOT IN (SELECT ticker FROM nicknames)""")
def suppressed(directory, nicknames):
    """Which names of the whole directory hold the name of a company that has aliases."""
    own = directory.join(nicknames.select("ticker"), "ticker", "left_anti").select("ticker", c("name").alias("company"))
    return G.suppressed(own, nicknames.select("ticker", "company"))


@query("S18_company_names", "directory", sql="""
SELECT ticker, name, CASE WHEN contains(name, 'trust') THEN ticker ELSE trim(regexp_replace(name, '( - Class A)? (Common Stock|Ordinary Shares).*$', '')) END AS shown, trim(regexp_replace(name, '( - Class A)? (Common Stock|Ordinary Shares).*$', '')) AS calendar FROM directory""")
def names(directory):
    return directory.select("ticker", "name", Q.display_name(c("ticker"), c("name"), F.lit(None).cast("string")).alias("shown"), Q.calendar_name(c("ticker"), c("name")).alias("calendar"))
