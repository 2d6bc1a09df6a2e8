"""Suggestions for what a user types: persons by all tokens, companies by names and aliases."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.functions import search as Q
from ledgerlark.operators.relations import first_per

NEWEST, FEWEST, SHOWN = 80, 5, 8


def word_index(rows: DataFrame, name: str) -> DataFrame:
    """word, name: each lower-case word of each distinct name. A token without blanks stands in a name if it stands in one of its words."""
    names = rows.where(F.trim(F.coalesce(name, F.lit(""))) != "").select(F.col(name).alias("name")).distinct()
    return names.select(F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("word"), "name")


def names_with_all(index: DataFrame, tokens: list[str]) -> DataFrame:
    """The names in which every token stands."""
    met = F.filter(F.array(*map(F.lit, sorted(set(tokens)))), lambda t: F.col("word").contains(t))
    hits = index.where(reduce(or_, [F.col("word").contains(t) for t in tokens])).select("name", F.explode(met).alias("token"))
    return hits.groupBy("name").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(set(tokens))).select("name")


def _newest(rows: DataFrame, name: str, date: str, tokens: list[str]) -> DataFrame:
    """name, ticker, date of the newest rows whose name holds all tokens."""
    held = names_with_all(word_index(rows, name), tokens)
    found = rows.select(F.col(name).alias("name"), "ticker", F.col(date).alias("date")).join(held, "name", "left_semi")
    return found.orderBy(F.desc("date"), "name", F.asc_nulls_first("ticker")).limit(NEWEST)


def _persons(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("key", S.actor_key(F.col("name"))).where("key <> ''")
    return first_per(keyed, ["key"], [F.asc("source"), F.desc("date"), F.asc("name"), F.asc_nulls_first("ticker")])


def insider_suggestions(events: DataFrame, trades: DataFrame, aliases: list[tuple[str, list[str]]], query: str) -> DataFrame:
    """name, ticker, date, score of up to `SHOWN` persons: of the events (actor_name, ticker, published_date) whose name holds all tokens of
    the query, of the trades (filer_name, ticker, transaction_date) too where fewer than `FEWEST` persons are met, and those that an alias names.

    The first answer is counted, and the second table is read only if that count asks for it.
    """
    tokens = Q.tokens(query)
    first = _newest(events, "actor_name", "published_date", tokens).withColumn("source", F.lit(0))
    found = _persons(first)
    if found.limit(FEWEST).count() < FEWEST:
        found = _persons(first.unionByName(_newest(trades, "filer_name", "transaction_date", tokens).withColumn("source", F.lit(1))))
    for canonical, names in aliases:
        if Q.alias_score(names, query):
            own = Q.tokens(canonical)
            rows = _newest(events, "actor_name", "published_date", own).withColumn("source", F.lit(2)).unionByName(_newest(trades, "filer_name", "transaction_date", own).withColumn("source", F.lit(3)))
            one = rows.orderBy("source", F.desc("date"), "name", F.asc_nulls_first("ticker")).limit(1).withColumn("key", F.lit(Q.actor_key(canonical)))
            found = found.unionByName(one.join(found.select("key"), "key", "left_anti").select(*found.columns))
    scored = found.withColumn("score", Q.insider_score(F.col("name"), F.col("key"), aliases, query)).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("date"), "name").limit(SHOWN).select("name", "ticker", "date", "score")


def _grams(text: Column, most: int) -> Column:
    """All distinct pieces of up to `most` letters."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, n)))))


def suppressed(candidates: DataFrame, canonical: DataFrame, piece: int = 3) -> DataFrame:
    """Candidates (ticker, company) whose company holds that of a canonical row with another ticker; short tickers are never suppressed.

    "Holds" is made an equality: the beginning of a canonical name, of up to `piece` letters, is one of the pieces of the other name;
    what meets in that is then compared in full. Only distinct names meet: of a name's tickers the first and the last tell whether one
    of them is another one, so that rows of equal names make no pairs.
    """
    long = candidates.where(F.length("ticker") > 4).select("ticker", Q.text("company").alias("own")).where("own <> ''")
    pieces = long.select("own").distinct().withColumn("piece", F.explode(_grams(F.col("own"), piece)))
    names = canonical.select("ticker", Q.text("company").alias("name")).where("name <> ''").groupBy("name").agg(F.min("ticker").alias("first"), F.max("ticker").alias("last"))
    held = pieces.join(names.withColumn("piece", F.substring("name", 1, piece)), "piece").where(F.col("own").contains(F.col("name")))
    other = held.groupBy("own").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return long.join(other, "own").where((F.col("first") != F.col("ticker")) | (F.col("last") != F.col("ticker"))).select("ticker").distinct()


def ticker_suggestions(companies: DataFrame, aliases: DataFrame, query: str, shown: int = SHOWN) -> DataFrame:
    """ticker, company, score of up to `shown` companies (ticker, name) and aliases (ticker, company, aliases) that answer the query.

    A company without an alias of its own, whose name holds the name of an answering company with aliases, is left out.
    """
    q, tick, parts = Q.normal(query), Q.ticker(query), Q.tokens(query)
    known = aliases.select("ticker", F.col("company").alias("known"), F.transform("aliases", Q.text).alias("others"))
    terms = F.concat(F.col("others"), F.array(Q.text("known"), Q.text("ticker")))
    hit = (F.col("ticker").startswith(tick) | F.exists(terms, lambda t: t.contains(q))) if tick else F.exists(terms, lambda t: t.contains(q))
    inside = [F.lower("name").contains(p) for p in sorted({query.strip().lower(), *parts})]
    rows = companies.withColumn("ticker", S.ticker_candidate(F.col("ticker"))).where("ticker <> ''").where(reduce(or_, [F.col("ticker").startswith(tick or query.strip().upper()), *inside]))
    rows = first_per(rows.select("ticker", "name"), ["ticker"], [F.asc_nulls_last("name")]).join(known, "ticker", "left").withColumn("raw", F.col("name"))
    rows = rows.withColumn("company", Q.display_name(F.col("ticker"), F.col("name"), F.col("known")))
    only = known.where(hit).join(rows.select("ticker"), "ticker", "left_anti").select("ticker", F.col("known").alias("company"), F.col("known").alias("raw"), "known", "others")
    every = rows.select("ticker", "company", "raw", "known", "others").unionByName(only)
    scored = every.withColumn("score", Q.ticker_score(F.col("ticker"), F.col("company"), F.col("raw"), F.col("others"), query)).where("score > 0")
    out = suppressed(scored.where("known is null"), scored.where("known is not null"))
    return scored.join(out, "ticker", "left_anti").orderBy(F.desc("score"), "ticker").limit(shown).select("ticker", "company", "score")


