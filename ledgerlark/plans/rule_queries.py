"""Behaviour rules, broadcast dispatch, feed gates, subscriptions and previews over signal events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.operators import rules as B
from ledgerlark.plans.catalog import query

c = F.col
PRIORITY, ALLOWED, NOTABLE = ("quantum", "defense"), ("quantum", "crypto", "defense"), ("Ann Notable", "M6")

_EVENTS = """b AS (SELECT *, coalesce(base_type, signal_type) AS base, CASE amount_range WHEN '$1 - $1,000' THEN 1 WHEN '$1,001 - $15,000' THEN 1001 WHEN '$15,001 - $50,000' THEN 15001 WHEN '$50,001 - $100,000' THEN 50001 ELSE 100001 END AS floor,
 coalesce(actor_name = 'Ann Notable', false) OR coalesce(member_id = 'M6', false) AS known, coalesce(theme IN ('quantum', 'defense'), false) AS pri, coalesce(theme = member_theme, false) AS comm, coalesce(theme, '') AS th,
 ticker IS NOT NULL AND ticker NOT IN ('N/A', 'US-TREAS') AND NOT ((source = 'congress' OR base_type = 'politician_trade') AND (coalesce(asset_type, '') = 'Municipal Security' OR asset_name = 'County bond')) AS clean FROM feed_events),
k AS (SELECT *, CASE WHEN signal_type IN ('politician_cluster', 'cross_source_accumulation', 'politician_gain_milestone', 'cluster_gain_milestone', 'politician_filing_summary') THEN 'apart' WHEN signal_type = 'fund_filing_received' THEN 'reminder' WHEN NOT clean THEN 'bad'
 WHEN base = 'politician_trade' THEN 'member' WHEN base = 'insider_trade' THEN 'insider' ELSE 'fund' END AS k FROM b),
r AS (SELECT *, CASE k WHEN 'bad' THEN 'non_clean_asset' WHEN 'reminder' THEN signal_type ELSE concat_ws(',', CASE signal_type WHEN 'politician_cluster' THEN 'congress_cluster' WHEN 'cross_source_accumulation' THEN signal_type WHEN 'politician_filing_summary' THEN 'actor_filing_summary' END,
 CASE WHEN signal_type = 'cross_source_accumulation' AND includes_fund THEN 'cross_source_full_stack' END, CASE WHEN signal_type = 'politician_gain_milestone' AND gain_pct >= 40 OR signal_type = 'cluster_gain_milestone' AND gain_pct >= 50 THEN signal_type END,
 CASE WHEN signal_type LIKE '%gain_milestone' AND milestone_pct >= 100 THEN 'triple_digit_gain' END, CASE WHEN signal_type = 'cluster_gain_milestone' THEN CASE cluster_type WHEN 'cross_source_accumulation' THEN cluster_type ELSE 'congress_cluster' END END,
 CASE WHEN signal_type = 'politician_filing_summary' AND comm THEN 'committee_relevance' END,
 CASE WHEN k = 'member' AND floor >= CASE WHEN pri OR known THEN 50000 ELSE 100000 END THEN 'large_politician_trade' END, CASE WHEN k = 'member' AND comm AND floor >= 15001 THEN 'committee_relevance' END,
 CASE WHEN k = 'member' AND direction = 'buy' AND th = 'quantum' THEN CASE WHEN first_ticker_buy THEN 'first_quantum_congress_buy' WHEN first_actor_buy THEN 'new_quantum_position' END END, CASE WHEN k = 'member' AND known THEN 'notable_politician' END,
 CASE WHEN k = 'insider' AND direction = 'buy' AND value >= CASE WHEN pri THEN 100000 ELSE 250000 END THEN 'large_insider_buy' END, CASE WHEN k = 'insider' AND direction = 'buy' AND (change_pct >= 50 OR new_position) THEN 'substantial_insider_position_increase' END,
 CASE WHEN k = 'insider' AND direction = 'sell' AND value >= 1000000 THEN 'large_insider_sell' END, CASE WHEN k = 'insider' AND direction = 'sell' AND change_pct >= 50 THEN 'substantial_insider_position_reduction' END,
 CASE WHEN k = 'fund' THEN CASE WHEN change_type = 'new' THEN 'new_fund_position' WHEN change_type = 'exit' THEN 'fund_position_exit' WHEN change_pct >= 20 THEN 'large_fund_position_change' END END,
 CASE WHEN pri THEN 'priority_theme_ticker' END, 'theme_' || theme) END AS reasons FROM k),
x AS (SELECT *, k = 'bad' AS suppressed, CASE signal_type WHEN 'politician_filing_summary' THEN summary_activity ELSE k <> 'bad' AND signal_type <> 'politician_cluster' END AS activity,
 CASE WHEN signal_type = 'politician_filing_summary' THEN summary_unusual WHEN signal_type IN ('politician_cluster', 'cross_source_accumulation') THEN true WHEN signal_type = 'politician_gain_milestone' THEN gain_pct >= 40 WHEN signal_type = 'cluster_gain_milestone' THEN gain_pct >= 50
 ELSE k IN ('member', 'insider', 'fund') AND len(list_filter(string_split(reasons, ','), lambda q: q <> '' AND q <> 'priority_theme_ticker' AND NOT starts_with(q, 'theme_'))) > 0 END AS unusual FROM r)"""


def classified(feed_events):
    return B.behaviour(feed_events, PRIORITY, NOTABLE)


@query("R1_R4_Q11_event_behaviour", "feed_events", sql=f"WITH {_EVENTS} SELECT event_id, activity, unusual, suppressed, reasons FROM x")
def behaviour(feed_events):
    return classified(feed_events).select("event_id", "activity", "unusual", "suppressed", F.array_join("reasons", ",").alias("reasons"))


@query("R2_Q12_thresholds", "stored", "incoming", sql="""
SELECT i.key, CASE WHEN s.v IS NULL OR s.v % 5 = 0 THEN i.v ELSE s.v % 5 END AS limit_value, coalesce(s.v % 5, i.v) AS strict_value FROM incoming i LEFT JOIN stored s ON s.key = i.key""")
def thresholds(stored, incoming):
    """Limits from a policy table before those of the environment; a policy's zero falls through, or counts in the strict reading."""
    rows = incoming.select("key", c("v").alias("e")).join(stored.select("key", (c("v") % 5).alias("p")), "key", "left")
    return rows.select("key", B.chosen(c("p"), c("e")).alias("limit_value"), B.chosen(c("p"), c("e"), zero_counts=True).alias("strict_value"))


@query("R3_reason_labels", "feed_events", sql=f"""
WITH {_EVENTS}, u AS (SELECT signal_type, unnest(list_distinct(string_split(reasons, ','))) AS q FROM x WHERE reasons <> '')
SELECT CASE q {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.REASON_LABELS.items())} WHEN 'theme_quantum' THEN 'Quantum' WHEN 'theme_crypto' THEN 'Crypto' ELSE 'Defense' END AS label, signal_type, count(*) AS n FROM u GROUP BY 1, 2""")
def labels(feed_events):
    e = classified(feed_events).select("signal_type", F.explode(B.reason_labels(c("reasons"))).alias("label"))
    return e.groupBy("label", "signal_type").agg(F.count("*").alias("n"))


_PUB = "ticker IS NOT NULL AND ticker NOT IN ('N/A', 'US-TREAS')"


@query("R5_R19_broadcast_dispatch", "feed_events", sql=f"""
WITH {_EVENTS}, d AS (SELECT *, {_PUB} AS ok, coalesce(actor_name, '') = 'North Capital Group' AS entity, direction = 'buy' AS buy FROM x),
t AS (SELECT event_id, CASE signal_type WHEN 'politician_cluster' THEN 'congress_cluster' WHEN 'insider_cluster' THEN signal_type WHEN 'cross_source_accumulation' THEN signal_type WHEN 'politician_gain_milestone' THEN signal_type WHEN 'cluster_gain_milestone' THEN signal_type
 ELSE CASE WHEN suppressed THEN NULL WHEN signal_type = 'politician_filing_summary' AND known THEN 'notable_politician_filing' WHEN signal_type = 'politician_trade' AND ok THEN CASE WHEN known THEN 'notable_politician_trade'
 WHEN buy AND th = 'quantum' AND (first_ticker_buy OR first_actor_buy) THEN 'first_quantum_politician_buy' WHEN buy AND comm AND floor >= 15001 THEN 'committee_relevance_buy' WHEN buy AND floor >= 100000 THEN 'large_politician_buy' WHEN NOT buy AND th = 'crypto' THEN 'crypto_politician_sell'
 WHEN buy AND th <> '' AND floor >= 50000 THEN 'theme_politician_buy' END WHEN signal_type = 'insider_trade' AND ok AND NOT entity THEN CASE WHEN buy AND (change_pct >= 50 OR new_position) AND value >= 250000 THEN 'substantial_insider_buy' WHEN NOT buy AND change_pct >= 20 AND value >= 1000000 THEN 'substantial_insider_sell'
 WHEN change_pct >= 25 AND value >= 250000 THEN 'meaningful_insider_change' END WHEN group_rows >= 2 AND buy AND ok AND signal_type = 'politician_trade_grouped' THEN 'grouped_congress_buy' WHEN group_rows >= 2 AND buy AND ok AND signal_type = 'insider_trade_grouped' AND NOT entity AND th <> '' THEN 'grouped_insider_buy' END END AS rule,
 importance FROM d) SELECT event_id, rule, CAST(CASE rule WHEN 'meaningful_insider_change' THEN importance * 0.8 ELSE importance END AS DECIMAL(6,3)) AS score FROM t WHERE rule IS NOT NULL""")
def dispatch(feed_events):
    """The first rule that takes each event; meaningful changes count four fifths of their importance."""
    e = classified(feed_events).withColumn("rule", B.broadcast_rule(ALLOWED, NOTABLE)).where("rule is not null")
    score = F.when(c("rule") == "meaningful_insider_change", c("importance") * F.lit("0.8").cast("decimal(2,1)")).otherwise(c("importance"))
    return e.select("event_id", "rule", score.cast("decimal(6,3)").alias("score"))


@query("R20_cluster_participants", "feed_events", sql=f"""
SELECT event_id, ticker, direction, actor_name FROM feed_events WHERE source = 'insider' AND {_PUB} AND actor_name <> 'North Capital Group' AND (change_pct >= 25 OR direction = 'buy' AND new_position) AND value >= 250000""")
def participants(feed_events):
    return feed_events.where(B.joins_insider_cluster()).select("event_id", "ticker", "direction", "actor_name")


@query("F16_feed_gate", "feed_events", sql="""
SELECT event_id, importance FROM feed_events WHERE importance >= 0.72 OR (signal_type = 'insider_cluster' AND direction = 'sell' AND importance >= 0.68 AND (actors >= 3 OR value >= 1000000))""")
def gate(feed_events):
    return feed_events.where(B.feed_gate(c("importance"), c("signal_type"), c("direction"), c("actors"), c("value"))).select("event_id", "importance")


#: Subscriptions of the example: name, event types (none: all), least importance, whether any activity is enough.
SUBSCRIPTIONS = (("all", (), "0.80", False), ("insiders", ("insider", "politician_trade"), "0.75", False), ("active", ("politician_trade_grouped", "fund"), "0.95", True))


@query("F17_X4_subscription_match", "feed_events", sql=f"""
WITH {_EVENTS}, s AS (SELECT * FROM (VALUES ('all', 'all', 0.80, false), ('insiders', 'insider', 0.75, false), ('insiders', 'politician_trade', 0.75, false), ('active', 'politician_trade_grouped', 0.95, true), ('active', 'fund', 0.95, true)) v(subscription, kind, least, anyway)),
m AS (SELECT s.subscription, x.* FROM x JOIN (SELECT subscription, list(kind) AS kinds, min(least) AS least, bool_or(anyway) AS anyway FROM s GROUP BY 1) s ON (list_contains(kinds, 'all') OR list_contains(kinds, source) OR list_contains(kinds, signal_type) OR list_contains(kinds, base_type)) AND (anyway AND activity OR importance >= least))
SELECT subscription, signal_type, count(*) AS n, min(importance) AS least FROM m GROUP BY 1, 2""")
def subscribed(feed_events):
    kinds = [(n, F.array(*map(F.lit, k)) if k else F.array().cast("array<string>"), F.lit(v).cast("decimal(5,2)"), F.lit(a)) for n, k, v, a in SUBSCRIPTIONS]
    hits = F.array_compact(F.array(*(F.when(B.takes(k, v, a), F.lit(n)) for n, k, v, a in kinds)))
    e = classified(feed_events).select("signal_type", "importance", F.explode(hits).alias("subscription"))
    return e.groupBy("subscription", "signal_type").agg(F.count("*").alias("n"), F.min("importance").alias("least"))


@query("F21_story_filters", "feed_events", sql=f"""
SELECT event_id, signal_type IN ('politician_cluster', 'cross_source_accumulation', 'insider_cluster', 'politician_trade_grouped', 'insider_trade_grouped') AS in_cluster_feed, source IN ('congress', 'insider') AS in_all, coalesce(ticker, 'N/A') <> 'N/A' OR signal_type = 'politician_filing_summary' AS curatable
FROM feed_events WHERE contains(lower(concat_ws(' ', actor_name, ticker, signal_type, direction, theme)), 'notable') OR contains(lower(concat_ws(' ', actor_name, ticker, signal_type, direction, theme)), 'quantum')""")
def stories(feed_events):
    """Category, whether a story may be curated, and a search in all its texts for either of two words."""
    blob = F.lower(F.concat_ws(" ", "actor_name", "ticker", "signal_type", "direction", "theme"))
    t = F.upper(F.trim(F.coalesce("ticker", F.lit(""))))
    return feed_events.where(blob.contains("notable") | blob.contains("quantum")).select(
        "event_id", c("signal_type").isin("politician_cluster", "cross_source_accumulation", "insider_cluster", "politician_trade_grouped", "insider_trade_grouped").alias("in_cluster_feed"),
        c("source").isin("congress", "insider").alias("in_all"), (~t.isin("", "N/A", "MULTI", "UNKNOWN") | (c("signal_type") == "politician_filing_summary")).alias("curatable"))


@query("S54_preview_labels", "feed_events", sql="""
WITH p AS (SELECT *, contains(signal_type, 'cluster') OR signal_type = 'cross_source_accumulation' AS cl FROM feed_events)
SELECT event_id, array_to_string(list_filter([CASE WHEN cl THEN CASE signal_type WHEN 'cross_source_accumulation' THEN 'Cross-source cluster' ELSE 'Cluster' END END, CASE WHEN importance >= 0.9 THEN 'High-confidence signal' WHEN importance >= 0.8 THEN 'Unusual signal' END, CASE WHEN contains(signal_type, 'gain') THEN 'Performance update' END,
 CASE WHEN signal_type = 'politician_filing_summary' OR contains(signal_type, 'grouped') THEN 'Grouped filing' END, CASE WHEN contains(signal_type, 'insider') THEN 'Insider activity' END, CASE WHEN contains(signal_type, 'politician') OR source = 'congress' THEN 'Congress activity' END,
 CASE signal_type WHEN 'fund_filing_received' THEN '13F filing' WHEN 'fund_position_change' THEN 'Fund positioning' END, CASE WHEN summary_unusual THEN 'Unusual filing' END], lambda q: q IS NOT NULL)[1:4], ',') AS labels, cl OR importance >= 0.8 OR summary_unusual OR contains(signal_type, 'gain') AS unusual FROM p""")
def previews(feed_events):
    return feed_events.select("event_id", F.array_join(B.preview_labels(), ",").alias("labels"), B.preview_unusual().alias("unusual"))


@query("X5_X6_global_deliveries", "feed_events", "subscriptions", sql="""
SELECT event_id, 'discord' AS channel, sha1(event_id || '|global_discord|discord') AS delivery_key FROM feed_events WHERE importance >= 0.80 AND NOT EXISTS (SELECT 1 FROM subscriptions WHERE channel = 'discord')
UNION ALL SELECT event_id, 'sms', sha1(event_id || '|global_cluster_sms|sms') FROM feed_events WHERE signal_type IN ('politician_cluster', 'cross_source_accumulation', 'politician_gain_milestone', 'cluster_gain_milestone') AND importance >= 0.84""")
def global_deliveries(feed_events, subscriptions):
    """Important events for everyone, unless a stored subscription does that (one flag), and the owner's four types."""
    stored = subscriptions.agg(F.coalesce(F.bool_or(c("channel") == "discord"), F.lit(False)).alias("stored"))
    def sent(rows, reason, channel):
        return rows.select("event_id", F.lit(channel).alias("channel"), S.stable_id(c("event_id"), F.lit(reason), F.lit(channel)).alias("delivery_key"))
    everyone = feed_events.where("importance >= 0.80").crossJoin(F.broadcast(stored)).where("not stored")  # one row
    owner = feed_events.where((c("importance") >= F.lit("0.84").cast("decimal(5,2)")) & c("signal_type").isin(*(k for k in B.OWN_RULE if k != "insider_cluster")))
    return sent(everyone, "global_discord", "discord").unionByName(sent(owner, "global_cluster_sms", "sms"))


@query("X7_history_keys", "feed_events", sql="""
SELECT event_id, CASE WHEN member_id IS NOT NULL THEN 'id:' || lower(member_id) WHEN actor_name IS NOT NULL THEN 'name:' || lower(actor_name) ELSE '' END AS actor, CASE change_pct % 3 WHEN 0 THEN published_date - 3 ELSE published_date END AS reference_date FROM feed_events""")
def history_keys(feed_events):
    """An actor is its id, else its name; the date is the first of trade, occurrence and publication that is there."""
    some = lambda name: F.nullif(F.lower(F.trim(name)), F.lit(""))
    traded = F.when(c("change_pct") % 3 == 0, F.date_sub("published_date", 3))
    actor = F.coalesce(F.concat(F.lit("id:"), some("member_id")), F.concat(F.lit("name:"), some("actor_name")), F.lit(""))
    return feed_events.select("event_id", actor.alias("actor"), F.coalesce(traded, "published_date").alias("reference_date"))


@query("C25_follow_dry_run", "feed_events", "follows", sql=f"""
WITH {_EVENTS}, fol AS (SELECT DISTINCT watchlist_id, alert_mode, match_type, target FROM follows WHERE target IS NOT NULL), both_keys AS (SELECT 'ticker' AS match_type, ticker AS target, activity, unusual FROM x WHERE NOT suppressed UNION ALL SELECT 'actor', 'politician:' || lower(member_id), activity, unusual FROM x WHERE NOT suppressed),
ev AS (SELECT match_type, target, activity, unusual, count(*) AS n FROM both_keys WHERE target IS NOT NULL GROUP BY ALL)
SELECT watchlist_id, fol.match_type, fol.target, alert_mode, CAST(sum(n) AS BIGINT) AS matches FROM fol JOIN ev USING (match_type, target) WHERE CASE alert_mode WHEN 'both' THEN activity OR unusual WHEN 'activity' THEN activity ELSE unusual END GROUP BY 1, 2, 3, 4""")
def dry_run(feed_events, follows):
    """How many events each follow of a ticker or an actor would get; events are counted by key and behaviour before the join."""
    keys = F.array(F.struct(F.lit("ticker").alias("match_type"), c("ticker").alias("target")), F.struct(F.lit("actor").alias("match_type"), F.concat(F.lit("politician:"), F.lower("member_id")).alias("target")))
    each = classified(feed_events).where("not suppressed").select("activity", "unusual", F.explode(keys).alias("k")).select("activity", "unusual", "k.*").where("target is not null")
    e = each.groupBy("match_type", "target", "activity", "unusual").agg(F.count("*").alias("n"))
    f = follows.where("target is not null").select("watchlist_id", "alert_mode", "match_type", "target").distinct()
    wanted = F.when(c("alert_mode") == "both", c("activity") | c("unusual")).when(c("alert_mode") == "activity", c("activity")).otherwise(c("unusual"))
    return f.join(e, ["match_type", "target"]).where(wanted).groupBy("watchlist_id", "match_type", "target", "alert_mode").agg(F.sum("n").alias("matches"))
