"""Behaviour of signal events and the dispatch of broadcast rules, as tables of conditions over columns.

An event row has signal_type, base_type, source, direction, ticker, actor_name, member_id, amount_range, value, asset_type,
asset_name, theme, member_theme, first_ticker_buy, first_actor_buy, change_pct, new_position, gain_pct, milestone_pct,
cluster_type, includes_fund, summary_activity, summary_unusual, change_type, group_rows and importance. Missing numbers count
as zero, missing flags as false. Everything is one projection: no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S

#: Limits of the rules (fixed values); amounts in dollars, shares in per cent.
LIMITS = {"politician": 100_000, "politician_theme": 50_000, "committee": 15_001, "politician_gain": 40, "cluster_gain": 50, "insider_buy": 250_000, "insider_theme_buy": 100_000,
          "insider_sell": 1_000_000, "position_change": 50, "fund_change": 20, "large_buy": 100_000, "theme_buy": 50_000, "committee_buy": 15_001, "substantial_value": 250_000,
          "substantial_sell": 1_000_000, "substantial_sell_share": 20, "meaningful_share": 25, "meaningful_value": 250_000, "group_rows": 2}
#: Types whose behaviour does not depend on the asset, asset types and words (fixed values).
FUND_FILINGS = ("fund_filing_deadline_reminder", "fund_filing_received")
SUMMARIES = ("politician_filing_summary", "insider_filing_summary")
OWN_RULE = {"politician_cluster": "congress_cluster", "insider_cluster": "insider_cluster", "cross_source_accumulation": "cross_source_accumulation",
            "politician_gain_milestone": "politician_gain_milestone", "cluster_gain_milestone": "cluster_gain_milestone"}
EQUITY_TYPES = ("st", "cs", "stock", "stocks", "stock/etf", "etf", "common stock", "common stocks")
#: What a reader sees for a reason (fixed values); other reasons show as their words in title case.
REASON_LABELS = {
    "large_politician_trade": "Large politician trade", "large_insider_buy": "Large insider buy", "large_insider_sell": "Large insider sell", "notable_politician": "Notable politician",
    "committee_relevance": "Committee relevance", "new_quantum_position": "New quantum position", "first_quantum_congress_buy": "First Congress quantum buy", "congress_cluster": "Congress cluster",
    "cross_source_accumulation": "Cross-source accumulation", "politician_gain_milestone": "Politician gain milestone", "cluster_gain_milestone": "Cluster gain milestone",
    "triple_digit_gain": "Triple-digit gain", "cross_source_full_stack": "Congress + insiders + funds", "actor_filing_summary": "Grouped filing summary",
    "substantial_insider_position_increase": "Insider position increase", "substantial_insider_position_reduction": "Insider position reduction", "priority_theme_ticker": "Priority theme ticker",
    "non_clean_asset": "Non-market asset suppressed", "new_fund_position": "New fund position", "fund_position_exit": "Fund exited position", "large_fund_position_change": "Large fund position change",
    "fund_filing_deadline_reminder": "13F filing reminder", "fund_filing_received": "13F filing received"}


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _lower(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def chosen(policy: Column, environment: Column, zero_counts: bool = False) -> Column:
    """The policy's value, else the environment's. A policy value of zero falls through too, unless `zero_counts`."""
    return F.coalesce(policy if zero_counts else F.nullif(policy, F.lit(0)), environment)


def notable(keys: tuple[str, ...]) -> Column:
    """The member's id or the actor's name is one of `keys`, both as bare letters and digits."""
    wanted = ["".join(ch for ch in k.lower() if ch.isalnum()) for k in keys]
    return S.actor_key(F.col("member_id")).isin(*wanted) | S.actor_key(F.col("actor_name")).isin(*wanted)


def market_asset() -> Column:
    """A ticker of the market and, for congress rows, an equity by its type and name."""
    t = F.upper(F.trim(F.coalesce("ticker", F.lit(""))))
    kind, name = _lower("asset_type"), _lower("asset_name")
    equity = (kind == "") | kind.isin(*EQUITY_TYPES) | kind.contains("stock") | kind.contains("etf")
    odd = name.contains("treasury") | name.contains("municipal") | name.contains("bond")
    congress = (_lower("source") == "congress") | (F.coalesce("base_type", "signal_type") == "politician_trade")
    return ~t.isin("", "N/A", "NA", "UNKNOWN") & ~t.startswith("US-TREAS") & ~t.startswith("USTREAS") & (~congress | (equity & ~odd))


def behaviour(events: DataFrame, priority_themes: tuple[str, ...], notable_keys: tuple[str, ...], limits: dict = LIMITS) -> DataFrame:
    """Adds activity, unusual, suppressed and reasons (array, in the order of the table below).

    A cluster of insiders has no rule of its own here and is judged as its base type, a single insider trade.
    """
    # each step is a projection of its own: what many conditions share is evaluated once a row and not once a condition
    step = {"_kind": F.lower("signal_type"), "_base": F.lower(F.coalesce("base_type", "signal_type")), "_market": market_asset(), "_known": notable(notable_keys), "_floor": S.amount_lower_bound(F.col("amount_range")),
            "_themed": F.coalesce(F.col("theme").isin(*priority_themes), F.lit(False)), "_committee": F.coalesce(F.col("theme") == F.col("member_theme"), F.lit(False)), "_change": F.abs(_number("change_pct")), "_moved": F.coalesce("change_type", F.lit(""))}
    kind, base, known, floor, themed, committee, change, moved = (F.col(f"_{k}") for k in ("kind", "base", "known", "floor", "themed", "committee", "change", "moved"))
    value, buy, sell = _number("value"), F.col("direction") == "buy", F.col("direction") == "sell"
    summary, reminder = kind.isin(*SUMMARIES), kind.isin(*FUND_FILINGS)
    cluster, cross, gain, cluster_gain = (kind == k for k in ("politician_cluster", "cross_source_accumulation", "politician_gain_milestone", "cluster_gain_milestone"))
    aside = summary | reminder | cluster | cross | gain | cluster_gain
    kinds = {"_apart": aside, "_member": ~aside & F.col("_market") & (base == "politician_trade"), "_insider": ~aside & F.col("_market") & (base == "insider_trade"),
             "_fund": ~aside & F.col("_market") & (kind == "fund_position_change"), "_off": ~aside & ~F.col("_market")}
    apart, member, insider, fund, suppressed = (F.col(k) for k in kinds)
    quantum = member & buy & (F.coalesce("theme", F.lit("")) == "quantum") & (floor > 0)
    found = (  # reason, where it holds, whether it makes the event unusual
        ("non_clean_asset", suppressed, False),
        ("congress_cluster", cluster, True),
        ("cross_source_accumulation", cross, True),
        ("cross_source_full_stack", cross & _yes("includes_fund"), False),
        ("politician_gain_milestone", gain & (_number("gain_pct") >= limits["politician_gain"]), True),
        ("cluster_gain_milestone", cluster_gain & (_number("gain_pct") >= limits["cluster_gain"]), True),
        ("triple_digit_gain", (gain | cluster_gain) & (_number("milestone_pct") >= 100), False),
        ("cross_source_accumulation", cluster_gain & (_lower("cluster_type") == "cross_source_accumulation"), False),
        ("congress_cluster", cluster_gain & (_lower("cluster_type") != "cross_source_accumulation"), False),
        ("actor_filing_summary", summary, False),
        ("committee_relevance", summary & committee, False),
        *((k, kind == k, False) for k in FUND_FILINGS),
        ("large_politician_trade", member & (buy | sell) & (floor >= F.when(themed | known, limits["politician_theme"]).otherwise(limits["politician"])), True),
        ("committee_relevance", member & committee & (floor >= limits["committee"]), True),
        ("first_quantum_congress_buy", quantum & _yes("first_ticker_buy"), True),
        ("new_quantum_position", quantum & ~_yes("first_ticker_buy") & _yes("first_actor_buy"), True),
        ("notable_politician", member & known, True),
        ("large_insider_buy", insider & buy & (value >= F.when(themed, limits["insider_theme_buy"]).otherwise(limits["insider_buy"])), True),
        ("substantial_insider_position_increase", insider & buy & ((change >= limits["position_change"]) | _yes("new_position")), True),
        ("large_insider_sell", insider & sell & (value >= limits["insider_sell"]), True),
        ("substantial_insider_position_reduction", insider & sell & (change >= limits["position_change"]), True),
        ("new_fund_position", fund & (moved == "new"), True),
        ("fund_position_exit", fund & (moved == "exit"), True),
        ("large_fund_position_change", fund & ~moved.isin("new", "exit") & (change >= limits["fund_change"]), True),
        ("priority_theme_ticker", themed & ((apart & ~reminder) | member | insider | fund), False),
    )
    has_theme = F.col("theme").isNotNull() & ((apart & ~reminder) | member | insider | fund)
    reasons = F.array_compact(F.array(*(F.when(where, F.lit(reason)) for reason, where, _ in found), F.when(has_theme, F.concat(F.lit("theme_"), "theme"))))
    strong = reduce(or_, (F.coalesce(where, F.lit(False)) for _, where, counts in found if counts))
    out = events.withColumns(step).withColumns(kinds).withColumns({
        "reasons": reasons, "suppressed": suppressed, "activity": F.when(summary, _yes("summary_activity")).otherwise(~suppressed & ~cluster),
        "unusual": F.when(summary, _yes("summary_unusual")).otherwise(strong)})
    return out.drop(*step, *kinds)


def reason_labels(reasons: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in REASON_LABELS.items() for x in kv))
    spelt = lambda r: F.initcap(F.replace(F.regexp_replace(r, "^theme_", ""), F.lit("_"), F.lit(" ")))
    return F.transform(F.array_distinct(reasons), lambda r: F.coalesce(F.try_element_at(table, r), spelt(r)))


def broadcast_rule(allowed_themes: tuple[str, ...], notable_keys: tuple[str, ...], limits: dict = LIMITS) -> Column:
    """Key of the first rule that takes a classified event, else null. Types with a rule of their own come first, then
    suppressed events go, then single trades by priority, then filings of several rows."""
    kind, buy, sell = F.lower("signal_type"), F.col("direction") == "buy", F.col("direction") == "sell"
    ticker, known = S.publishable_ticker(F.col("ticker")).isNotNull(), notable(notable_keys)
    trade = (kind == "politician_trade") & ticker
    insider = (F.lower(F.coalesce("base_type", "signal_type")) == "insider_trade") & (kind == "insider_trade") & ticker & ~S.is_entity_name(F.col("actor_name"))
    floor, value, change = S.amount_lower_bound(F.col("amount_range")), _number("value"), _number("change_pct")
    theme = F.when(F.col("theme").isin(*allowed_themes), F.col("theme"))
    several = (F.coalesce("group_rows", F.lit(0)) >= max(2, limits["group_rows"])) & buy & ticker
    single = (
        ("notable_politician_filing", (kind == "politician_filing_summary") & known),
        ("notable_politician_trade", trade & known & (buy | sell)),
        ("first_quantum_politician_buy", trade & buy & (theme == "quantum") & (_yes("first_ticker_buy") | _yes("first_actor_buy"))),
        ("committee_relevance_buy", trade & buy & F.array_contains("reasons", "committee_relevance") & (floor >= limits["committee_buy"])),
        ("large_politician_buy", trade & buy & (floor >= limits["large_buy"])),
        ("crypto_politician_sell", trade & sell & (theme == "crypto")),
        ("theme_politician_buy", trade & buy & theme.isNotNull() & (floor >= limits["theme_buy"])),
        ("substantial_insider_buy", insider & buy & ((change >= limits["position_change"]) | _yes("new_position")) & (value >= limits["substantial_value"])),
        ("substantial_insider_sell", insider & sell & (change >= limits["substantial_sell_share"]) & (value >= limits["substantial_sell"])),
        ("meaningful_insider_change", insider & (change >= limits["meaningful_share"]) & (value >= limits["meaningful_value"])),
        ("grouped_congress_buy", several & (kind == "politician_trade_grouped")),
        ("grouped_insider_buy", several & (kind == "insider_trade_grouped") & theme.isNotNull() & ~S.is_entity_name(F.col("actor_name"))),
    )
    own = F.try_element_at(F.create_map(*(F.lit(x) for kv in OWN_RULE.items() for x in kv)), kind)
    return F.coalesce(own, *(F.when(~F.col("suppressed") & where, F.lit(rule)) for rule, where in single))


def joins_insider_cluster(limits: dict = LIMITS) -> Column:
    """Persons' purchases and sales that change a position enough; a new position needs the value alone."""
    enough = (_number("change_pct") >= limits["meaningful_share"]) | ((F.col("direction") == "buy") & _yes("new_position"))
    return ((_lower("source") == "insider") & S.publishable_ticker(F.col("ticker")).isNotNull() & F.col("direction").isin("buy", "sell") & (_lower("actor_name") != "")
            & ~S.is_entity_name(F.col("actor_name")) & enough & (_number("value") >= limits["meaningful_value"]))


def feed_gate(score: Column, rule: Column, direction: Column, actors: Column, floor: Column) -> Column:
    """Whether a story is strong enough for the feed: by its score, or as a sale of many insiders or of much money."""
    return (score >= F.lit("0.72").cast("decimal(5,2)")) | ((rule == "insider_cluster") & (direction == "sell") & (score >= F.lit("0.68").cast("decimal(5,2)")) & ((actors >= 3) | (floor >= 1_000_000)))


def takes(event_types: Column, least: Column, activity_is_enough: Column) -> Column:
    """Whether a subscription takes an event: one of its types (none means all) and important enough, or any activity."""
    mine = F.array(F.lower("signal_type"), F.lower("source"), F.lower(F.coalesce("base_type", F.lit(""))))
    typed = (F.size(event_types) == 0) | F.arrays_overlap(event_types, mine)
    return typed & ((activity_is_enough & F.col("activity")) | (_number("importance") >= least))


def preview_labels() -> Column:
    """At most four words for an event in an account's preview."""
    kind, cluster, score = F.lower("signal_type"), is_cluster(), _number("importance")
    pairs = (("Cross-source cluster", cluster & (kind == "cross_source_accumulation")), ("Cluster", cluster & (kind != "cross_source_accumulation")),
             ("High-confidence signal", score >= F.lit("0.90").cast("decimal(5,2)")), ("Unusual signal", (score >= F.lit("0.80").cast("decimal(5,2)")) & (score < F.lit("0.90").cast("decimal(5,2)"))),
             ("Performance update", kind.contains("gain")), ("Grouped filing", kind.contains("filing_summary") | kind.contains("grouped")), ("Insider activity", kind.contains("insider")),
             ("Congress activity", kind.contains("politician") | (_lower("source") == "congress")), ("13F filing", kind.isin(*FUND_FILINGS)),
             ("Fund positioning", kind.contains("fund") & ~kind.isin(*FUND_FILINGS)), ("Unusual filing", _yes("summary_unusual")))
    return F.slice(F.array_compact(F.array(*(F.when(where, F.lit(label)) for label, where in pairs))), 1, 4)


def is_cluster() -> Column:
    kind = F.lower("signal_type")
    return kind.contains("cluster") | (kind == "cross_source_accumulation")


def preview_unusual() -> Column:
    words = ("large", "substantial", "notable", "committee", "first", "theme", "meaningful", "gain")
    named = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("signal_type"), w))
    return is_cluster() | (_number("importance") >= F.lit("0.80").cast("decimal(5,2)")) | _yes("summary_unusual") | named
