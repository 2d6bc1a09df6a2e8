"""A member's live portfolio: what a disclosure of holdings opens with, later trades on top, sold first in, first out, at current prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.operators.relations import as_of_prices, dealt, lookup
from ledgerlark.sources.workspace import staged

#: Shares are counted in millionths and sums in cents, both whole numbers.
PARTS = 1_000_000


def live(trades: DataFrame, disclosures: DataFrame, prices: DataFrame) -> DataFrame:
    """member_id, ticker, min_value, max_value, trade_count, shares_held, cost_basis, current_value.

    trades: member_id, ticker, direction, amount_range, date, row (anything that orders them within a date). disclosures: member_id, ticker,
    value_range, filed. A member's snapshot date is their latest filing; trades up to it are in the snapshot already. A ticker's
    holding of the latest filing opens with the middle of its range at the price of that day; ranges of value add up the other
    ends for sales and never fall below zero. Tickers without a price keep their range and have no shares.

    Trades and disclosures are written once. Their distinct ranges, and days of a ticker, are read and priced once each and looked up;
    rows are then dealt by member and sorted once, and every window below goes through that one order.
    """
    keys, order = ["member_id", "ticker"], ["counted", "date", "high0", "low0", "row"]
    later = trades.where("member_id is not null and direction in ('buy', 'sell') and date is not null").select(
        "member_id", S.market_ticker(F.col("ticker")).alias("ticker"), "date", "row", F.col("direction").alias("side"), F.col("amount_range").alias("range"), F.lit(1).alias("counted")).where("ticker is not null")
    filed = disclosures.where("member_id is not null and ticker is not null and filed is not null").select(
        "member_id", S.market_ticker(F.col("ticker")).alias("ticker"), F.col("filed").alias("date"), F.lit(None).cast(trades.schema["row"].dataType).alias("row"), F.lit("buy").alias("side"), F.col("value_range").alias("range"), F.lit(0).alias("counted"))
    moves, prices = staged(later.unionByName(filed)), staged(prices.select("ticker", "price_date", "price"))
    ranges = moves.select("range").distinct().withColumn("r", S.amount_range(F.col("range"))).select("range", F.col("r.min").alias("low"), F.col("r.max").alias("high"))
    days = as_of_prices(moves.where("ticker is not null").select("ticker", "date").distinct(), prices, ["ticker"], "date", "price_date", "price").where("price > 0")
    rows = moves.join(lookup(days.select("ticker", "date", "price")), ["ticker", "date"], "left").join(lookup(ranges), "range", "left").drop("range")
    # of a ticker's disclosures the latest, then the largest, comes last and just before the trades
    first = lambda n: F.when(F.col("counted") == 0, F.col(n)).alias(f"{n}0")
    rows = dealt(rows.select("*", first("high"), first("low")), "member_id", like=moves).sortWithinPartitions(*keys, *order)
    rows = rows.withColumn("snapshot", F.max(F.when(F.col("counted") == 0, F.col("date"))).over(Window.partitionBy("member_id")))
    rows = rows.where("ticker is not null and low is not null and (counted = 0 or snapshot is null or date > snapshot)")
    inside = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("next", F.lead("counted").over(inside)).where("counted = 1 or next is null or next = 1")
    # balances clamped at zero: the sum less its least running value, where that is negative
    buys = F.col("side") == "buy"
    shares = F.when(F.col("price").isNotNull(), F.floor((F.col("low") + F.col("high")).cast("double") * (PARTS / 2) / F.col("price").cast("double"))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("shares", shares).select(*keys, "side", "price", "counted", *order[1:], "shares", F.when(buys, F.col("low")).otherwise(-F.col("high")).alias("d_low"), F.when(buys, F.col("high")).otherwise(-F.col("low")).alias("d_high"),
                                                    F.when(buys, F.col("shares")).otherwise(-F.col("shares")).alias("d"), F.when(buys, F.col("shares")).otherwise(F.lit(0).cast("long")).alias("buy"))
    past, every = inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    rows = rows.select("*", *(F.sum(n).over(past).alias(f"s_{n}") for n in ("d_low", "d_high", "d", "buy")))
    clamped = lambda total, least: total - F.least(F.lit(0), least)
    rows = rows.withColumn("held", clamped(F.sum("d").over(every), F.min("s_d").over(every))).withColumn("bought", F.sum("buy").over(every))
    left = F.when(buys, F.least(F.col("shares"), F.greatest(F.lit(0).cast("long"), F.col("s_buy") - (F.col("bought") - F.col("held")))))
    cents = lambda n, price: F.floor(F.col(n).cast("double") * F.col(price).cast("double") / (PARTS / 100))
    rows = rows.withColumn("left", left).withColumn("left", F.when(F.col("left") > 0, F.col("left")))
    values = rows.groupBy(*keys).agg(clamped(F.sum("d_low"), F.min("s_d_low")).alias("min_value"), clamped(F.sum("d_high"), F.min("s_d_high")).alias("max_value"), F.sum("counted").alias("trade_count"),
                                     F.sum("left").alias("parts"), F.sum(cents("left", "price")).alias("cost"))
    last = prices.groupBy("ticker").agg(F.max_by("price", "price_date").alias("current_price"))
    worth = cents("parts", "current_price")
    exact = lambda n, over, kind: (n.cast("decimal(30,0)") / over).cast(kind)
    return values.join(lookup(last), "ticker", "left").select(*keys, F.col("min_value").cast("decimal(20,2)").alias("min_value"), F.col("max_value").cast("decimal(20,2)").alias("max_value"), F.col("trade_count").cast("long").alias("trade_count"),
                        exact(F.col("parts"), PARTS, "decimal(26,6)").alias("shares_held"), exact(F.col("cost"), 100, "decimal(26,2)").alias("cost_basis"), exact(worth, 100, "decimal(26,2)").alias("current_value"))
