"""Event compilers: filing groups, summaries, clusters of one family and of several, milestones, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.operators.deliveries import FOLLOWS, deliveries
from ledgerlark.operators.relations import as_of_prices, dealt, first_per, lookup
from ledgerlark.operators.windows import trailing_sums, window_days
from ledgerlark.sources.workspace import staged

#: Changes of a fund's position that go with a side.
FUND_CHANGES = {"buy": ("new", "increase"), "sell": ("exit", "decrease")}


def congress_events(trades: DataFrame) -> DataFrame:
    """Canonical events of trades that a cluster may use."""
    return trades.withColumn("ticker", S.publishable_ticker(F.col("ticker"))).where("ticker is not null and direction in ('buy', 'sell') and published_date is not null")


def filing_groups(trades: DataFrame) -> DataFrame:
    """Rows of one filing, ticker, actor and direction as one event; groups of one row pass through with row_count 1."""
    return (trades.where("ticker is not null").withColumn("filing", S.filing_key(F.col("doc_id"))).groupBy("filing", "ticker", "member_id", "direction")
            .agg(F.count(F.lit(1)).alias("row_count"), F.sum("amount_floor").alias("combined_floor"), F.min("transaction_date").alias("first_trade"),
                 F.max("transaction_date").alias("last_trade"), F.max("published_date").alias("published_date"),
                 F.array_join(F.array_sort(F.collect_set("amount_range")), "; ").alias("ranges")))


def filing_summaries(groups: DataFrame) -> DataFrame:
    """Per filing and actor: trades, tickers and the first ten tickers; filings of a single trade give no summary."""
    return (groups.groupBy("filing", "member_id").agg(F.sum("row_count").alias("trade_count"), F.count_distinct("ticker").alias("ticker_count"),
                                                       F.array_join(F.slice(F.array_sort(F.collect_set("ticker")), 1, 10), ",").alias("tickers"), F.max("published_date").alias("published_date"))
            .where("trade_count > 1"))


def filing_counts(filed: DataFrame) -> DataFrame:
    """n and latest published_date of the groups of `filing_groups` and of the `filing_summaries`, by kind: rows are dealt once, by what both have in common.

    filed: filing, member_id, ticker, direction and published_date of trades with a ticker, written, as they are counted first.
    """
    rows = dealt(filed, "filing", "member_id")
    groups = rows.groupBy("filing", "member_id", "ticker", "direction").agg(F.count(F.lit(1)).alias("trades"), F.max("published_date").alias("latest"))
    filings = groups.groupBy("filing", "member_id").agg(F.sum("trades").alias("trades"), F.count(F.lit(1)).alias("groups"), F.max("latest").alias("latest"))
    count = lambda kind, n, latest: F.struct(F.lit(kind).alias("kind"), n.alias("n"), latest.alias("latest"))
    several = F.col("trades") > 1
    both = filings.agg(F.array(count("group", F.coalesce(F.sum("groups"), F.lit(0)), F.max("latest")), count("summary", F.count(F.when(several, 1)), F.max(F.when(several, F.col("latest"))))).alias("kinds"))
    return both.select(F.inline("kinds"))


def congress_clusters(trades: DataFrame, days: int = 10, least: int = 2) -> DataFrame:
    """Trailing clusters with their identity (ticker, direction, anchor, hash of the actors) and score.

    Rows become one list of actors a day first. Days are dealt by stretches of the calendar, each with the days just before it, and a
    frame over the days puts the lists together: no actor is moved once for each anchor that it counts for.
    """
    events = congress_events(trades).select("ticker", "direction", F.col("published_date").alias("d"), "member_id", "amount_floor")
    daily = events.groupBy("ticker", "direction", "d").agg(F.collect_set("member_id").alias("ids"), F.sum("amount_floor").alias("floor"))
    stretch = lambda day: F.floor(F.unix_date(day) / (days * 6))
    own, later = stretch(F.col("d")), stretch(F.date_add("d", days - 1))
    dealt = daily.withColumn("own", own).withColumn("stretch", F.explode(F.array_distinct(F.array(own, later))))
    frame = Window.partitionBy("ticker", "direction", "stretch").orderBy(F.unix_date("d")).rangeBetween(1 - days, 0)
    near = dealt.withColumn("ids", F.array_distinct(F.flatten(F.collect_list("ids").over(frame)))).withColumn("floor_sum", F.sum("floor").over(frame)).where("own = stretch")
    found = near.withColumn("actors", F.size("ids").cast("long")).where(F.col("actors") >= least)
    out = found.select("ticker", "direction", F.col("d").alias("anchor"), "actors", "floor_sum", F.sha1(F.array_join(F.sort_array(F.array_distinct(F.transform("ids", F.lower))), "|")).alias("actor_hash"))
    return out.withColumn("cluster_id", F.concat_ws("::", F.lit("cluster"), "ticker", "direction", F.lit(f"{days}d"), F.col("anchor").cast("string"), F.substring("actor_hash", 1, 12))).withColumn(
        "importance", F.least(F.lit("0.99").cast("decimal(5,2)"), F.lit("0.84").cast("decimal(5,2)") + F.least(F.col("actors") - least, F.lit(5)).cast("decimal(5,2)") * F.lit("0.02").cast("decimal(5,2)")).cast("decimal(5,2)"))


def insider_economic_rows(insiders: DataFrame) -> DataFrame:
    """One row an economic trade: related owners reporting the same trade count once (the first filer by name)."""
    rows = insiders.withColumn("ticker", S.publishable_ticker(F.col("ticker"))).where("ticker is not null")
    keys = ["ticker", "transaction_code", "transaction_date", "shares", "amount"]
    return first_per(dealt(rows, *keys), keys, [F.asc("filer_name"), F.asc("source_url")])


def insider_clusters(insiders: DataFrame, days: int = 10, least: int = 5) -> DataFrame:
    """Greedy windows with at least max(5, least) distinct filers."""
    # economic rows are found once, for the windows' starts and for their members
    economic = staged(insider_economic_rows(insiders).select("ticker", "transaction_code", "published_date", "filer_name", "amount"))
    keys = ["ticker", "transaction_code"]
    rows = economic.join(lookup(window_days(economic.select(*keys, "published_date").distinct(), keys, "published_date", days)), [*keys, "published_date"])
    return (dealt(rows, "ticker", "transaction_code", "window_start", "filer_name", like=economic).groupBy("ticker", "transaction_code", "window_start").agg(F.count_distinct("filer_name").alias("actors"), F.count(F.lit(1)).alias("trades"), F.sum("amount").alias("total_value"), F.max("published_date").alias("clocked_at"))
            .where(F.col("actors") >= max(5, least)))


def source_events(trades: DataFrame, insiders: DataFrame) -> DataFrame:
    """side, ticker, d, family and actor of congress and insider events that a window may hold."""
    c = congress_events(trades).select(F.col("direction").alias("side"), "ticker", F.col("published_date").alias("d"), F.lit("congress").alias("family"), F.col("member_id").alias("actor"))
    code = F.col("transaction_code")
    i = insiders.withColumn("ticker", S.publishable_ticker(F.col("ticker"))).where(code.isin("P", "S") & F.col("ticker").isNotNull())
    return c.unionByName(i.select(F.when(code == "P", "buy").otherwise("sell").alias("side"), "ticker", F.col("published_date").alias("d"), F.lit("insider").alias("family"), F.col("filer_name").alias("actor")))


def cross_source(trades: DataFrame, insiders: DataFrame, funds: DataFrame, side: str, days: int = 30, fund_days: int = 120) -> DataFrame:
    """Greedy windows of congress and insider events with fund changes of the trailing days; two families are needed at least."""
    # events are written once, for the days that open windows and for the members of windows
    return crossed(staged(source_events(trades, insiders).where(F.col("side") == side)), funds, side, days, fund_days)


def crossed(events: DataFrame, funds: DataFrame, side: str, days: int = 30, fund_days: int = 120) -> DataFrame:
    """The windows of `cross_source` over written events of all sides."""
    events = events.where(F.col("side") == side).drop("side")
    opened = staged(window_days(events.select("ticker", "d").distinct(), ["ticker"], "d", days))
    actors = events.join(lookup(opened), ["ticker", "d"]).groupBy("ticker", "window_start", "family", "actor").agg(F.max("d").alias("d"))
    of = lambda family: F.count(F.when(F.col("family") == family, F.col("actor")))
    windows = actors.groupBy("ticker", "window_start").agg(of("congress").alias("congress"), of("insider").alias("insider"), F.max("d").alias("window_end"))
    f = funds.where(F.col("change_type").isin(*FUND_CHANGES[side])).select("ticker", "fund_name", F.col("published_date").alias("fd"))
    # funds are counted at the last day of each window, by a sweep and not by pairs
    ends = opened.select("ticker", F.date_add("window_start", days - 1).alias("anchor"))
    near = trailing_sums(f, ["ticker"], "fd", "fund_name", fund_days, points=ends).select("ticker", F.date_sub("anchor", days - 1).alias("window_start"), F.col("actors").alias("funds"))
    out = windows.join(near, ["ticker", "window_start"], "left").withColumn("funds", F.coalesce("funds", F.lit(0).cast("long")))
    families = sum((F.col(x) > 0).cast("int") for x in ("congress", "insider", "funds"))
    pairing = (F.col("congress") > 0) & (F.col("insider") > 0) | (F.col("funds") >= 2)
    return out.where((families >= 2) & pairing).withColumn("event_id", F.concat_ws("::", F.lit("cross-source"), "ticker", F.lit(side), F.lit(f"{days}d"), F.lit(f"{fund_days}fd"), F.col("window_start").cast("string")))


def gain_milestones(trades: DataFrame, prices: DataFrame, as_of: str, least_floor: int = 50_001, within: int = 365, thresholds: tuple[int, ...] = (40, 50, 100, 200)) -> DataFrame:
    """Buys whose price rose past a threshold between trade and as_of."""
    today = F.lit(as_of).cast("date")
    buys = (trades.withColumn("ticker", S.market_ticker(F.col("ticker"))).where(F.col("ticker").isNotNull() & (F.col("direction") == "buy") & (F.col("amount_floor") >= least_floor))
            .withColumn("ref", F.when(F.col("transaction_date") <= today, F.col("transaction_date")).otherwise(F.col("published_date"))).where(F.datediff(today, "ref").between(0, within))
            .select("member_id", "ticker", "ref", "amount_floor").distinct())
    entry = as_of_prices(buys, prices, ["ticker"], "ref", "price_date", "price").where("price > 0").drop("price_date").withColumnRenamed("price", "entry_price")
    last = prices.where(F.col("price_date") <= today).groupBy("ticker").agg(F.max_by("price", "price_date").alias("current_price"))
    gained = entry.join(last, "ticker").withColumn("gain_pct", F.floor((F.col("current_price") - F.col("entry_price")) * 100 / F.col("entry_price")).cast("long"))
    return gained.withColumn("milestone", S.milestone(F.col("gain_pct"), thresholds)).where("milestone is not null").withColumn("holding_days", F.datediff(today, "ref"))


def daily_quota(events: DataFrame, user: str, day: str, event: str, score: str, limit: int) -> DataFrame:
    """Which events of a user and day are within the quota, best score first; repeats of a taken event (other channels) are free."""
    each = events.groupBy(user, day, event).agg(F.max(score).alias("best"), F.count(F.lit(1)).alias("deliveries"))
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy(user, day).orderBy(F.desc("best"), F.asc(event))))
    return ranked.withColumn("status", F.when(F.col("place") <= limit, "queued").otherwise("suppressed"))


def follow_deliveries(events: DataFrame, follows: DataFrame, subscriptions: DataFrame, most: int = FOLLOWS) -> DataFrame:
    """doc_id, subscription_id, channel and reasons of what followers get. events: doc_id, importance, unusual, match_type, target;
    follows: watchlist_id, match_type, target, alert_mode; subscriptions: watchlist_id, subscription_id, channel, minimum_importance.

    A follow of all activity always delivers; one of unusual events delivers those that are important enough. Documents go past blocks
    of up to `most` follows, and what comes out of that is never moved or kept.
    """
    key = F.concat(F.length("match_type"), F.lit(":"), "match_type", "target").alias("key")
    active = F.coalesce(F.col("alert_mode").isin("both", "activity"), F.lit(False))
    watched = follows.select(key, "watchlist_id", active.alias("activity")).where("key is not null").groupBy("key", "watchlist_id").agg(F.bool_or("activity").alias("activity"))
    fans = watched.join(subscriptions, "watchlist_id").groupBy("key", "subscription_id", "channel").agg(F.min("minimum_importance").cast("double").alias("least"), F.bool_or("activity").alias("activity"))
    held = (events.select("doc_id", key, "unusual", F.when(F.col("unusual"), F.col("importance")).alias("importance")).join(lookup(watched.select("key").distinct()), "key", "left_semi").repartition("doc_id")
            .groupBy("doc_id", "key").agg(F.bool_or("unusual").alias("unusual"), F.max("importance").cast("double").alias("importance")))
    return deliveries(held.groupBy("doc_id").agg(F.collect_list(F.struct("key", "unusual", "importance")).alias("held")), fans, most)
