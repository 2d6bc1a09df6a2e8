"""Joins, deduplication and set operators that the disclosure queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.sources.workspace import staged

#: Rows of a partition of `dealt`: what a task sorts or groups of them takes some hundred MB.
PART_ROWS = 250_000

#: Rows of a table of `lookup` up to which every task holds all of it.
LOOKUP_ROWS = 1_000_000


def dealt(rows: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """rows, dealt by keys over as many partitions as their counted number (that of `like`, where it is the same) asks for: a task's share does not grow with the table."""
    spark = rows.sparkSession
    parts = -(-(rows if like is None else like).count() // PART_ROWS)
    return rows.repartition(parts, *keys) if parts > spark.sparkContext.defaultParallelism else rows.repartition(*keys)


def lookup(table: DataFrame) -> DataFrame:
    """table as the looked-up side of a join, written and counted first: every task holds all of it, or its hashed share where it has more than LOOKUP_ROWS rows."""
    table = staged(table)
    return F.broadcast(table) if table.count() <= LOOKUP_ROWS else table.hint("shuffle_hash")


def first_per(rows: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """One row a key: the first by `order`, which must be total for a stable result."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(batches: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Union of batches by identity; a row of a later batch replaces an earlier one, within a batch the largest `order` wins."""
    tagged = [b.withColumn("_batch", F.lit(k)) for k, b in enumerate(batches)]
    every = tagged[0]
    for b in tagged[1:]:
        every = every.unionByName(b)
    return first_per(every, keys, [F.desc("_batch"), F.desc(order)]).drop("_batch")


def as_of_prices(events: DataFrame, prices: DataFrame, keys: list[str], date: str, price_date: str, price: str) -> DataFrame:
    """Adds the last price on or before each event's date, null where there is none.

    Prices are carried on two levels: inside a key's month, events and prices are united in one window; what a month begins with comes
    from a window over the last prices of the key's months. No window holds all rows of a key, and no rows are paired.
    """
    month = F.trunc("_at", "month").alias("_m")
    e = events.select(*keys, F.col(date).alias("_at"), F.lit(1).alias("_kind"), F.struct(*events.columns).alias("_row"))
    p = prices.where(F.col(price_date).isNotNull()).select(*keys, F.col(price_date).alias("_at"), F.lit(0).alias("_kind"), F.struct(price_date, price).alias("_p"))
    both = e.withColumn("_p", F.lit(None).cast(p.schema["_p"].dataType)).unionByName(p.withColumn("_row", F.lit(None).cast(e.schema["_row"].dataType))).select("*", month)
    inside = Window.partitionBy(*keys, "_m").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_p", F.last("_p", ignorenulls=True).over(inside)).where("_row is not null")
    # a month's last price, of the months that have events or prices
    months = both.groupBy(*keys, "_m").agg(F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_m").alias("_month"), F.last("_last", ignorenulls=True).over(before).alias("_c"))
    same = [filled[k].eqNullSafe(carried[f"_{k}"]) for k in keys]
    out = filled.join(carried, [*same, filled["_m"].eqNullSafe(carried["_month"])], "left").withColumn("_p", F.coalesce("_p", "_c"))
    return out.select("_row.*", F.col(f"_p.{price_date}").alias(price_date), F.col(f"_p.{price}").alias(price))


def nearest(events: DataFrame, points: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds near (value, name): the point of the same keys with the nearest value, of equally near ones the smallest name; null where a key has none.

    Events look down and up in one order of values; equal values of a key are one point before that.
    """
    p = points.groupBy(*keys, F.col(value).alias("_v")).agg(F.min(name).alias("_name"))
    e = events.select(*keys, F.col(value).alias("_v"), F.struct(*events.columns).alias("_row"))
    point = F.when(F.col("_row").isNull(), F.struct(F.col("_v").alias(value), F.col("_name").alias(name)))
    both = e.withColumn("_name", F.lit(None).cast("string")).unionByName(p.withColumn("_row", F.lit(None).cast(e.schema["_row"].dataType))).withColumn("_point", point)
    # up looks back in falling order: a frame that ends at the last row would be gone through again for every row
    back = lambda order: F.last("_point", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    down, up = back(F.asc("_v")), back(F.desc("_v"))
    found = both.withColumn("_down", down).withColumn("_up", up).where("_row is not null")
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.{value}") - F.col("_v")).alias("far"), F.col(f"{side}.{name}").alias("name"), F.col(side).alias("p")))
    return found.withColumn("_best", F.least(far("_down"), far("_up"))).select("_row.*", F.col("_best.p").alias("near"))


def period_changes(holdings: DataFrame, group: str, key: str, period: str, shares: str) -> DataFrame:
    """Each group's holdings against its previous reported period: matched, new and exited keys.

    A group's periods are those it reported, so a skipped quarter compares with the last one there is. Holdings are one row a group, key
    and period and are written once; every row knows its group's period before and after its own, and one order of a key's
    rows tells what it had before and whether it exits after: no holding is joined with another.
    """
    held = staged(holdings.select(group, key, period, shares))
    by_period = Window.partitionBy(group).orderBy(period)
    periods = held.select(group, period).distinct().select(group, period, F.lag(period).over(by_period).alias("_prior"), F.lead(period).over(by_period).alias("_after"))
    mine = Window.partitionBy(group, key).orderBy(period)
    near = lambda at, which: F.col(key).isNotNull() & F.coalesce(at == F.col(which), F.lit(False))
    rows = held.join(lookup(periods), [group, period]).select(
        "*", F.when(near(F.lag(period).over(mine), "_prior"), F.lag(shares).over(mine)).alias("_before"), near(F.lead(period).over(mine), "_after").alias("_stays"))
    none = F.lit(None).cast(held.schema[shares].dataType)
    change = lambda at, now, before: F.struct(at.alias(period), now.alias("_now"), before.alias("_before"))
    own, exit = change(F.col(period), F.col(shares), F.col("_before")), change(F.col("_after"), none, F.col(shares))
    moved = rows.select(group, key, F.inline(F.array(F.when(F.col("_prior").isNotNull(), own), F.when(F.col("_after").isNotNull() & ~F.col("_stays"), exit)))).where(F.col(period).isNotNull())
    now, before = F.coalesce("_now", F.lit(0)), F.coalesce("_before", F.lit(0))
    return moved.select(group, key, period, now.alias("shares_held"), (now - before).alias("change_shares"),
                        F.when(before > 0, F.round((now - before) * 100 / before.cast("decimal(20,4)"), 4).cast("decimal(18,4)")).alias("change_percent"))


def multiset_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows of each signature one side has beyond the other."""
    l, r = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in ((left, "_l"), (right, "_r")))
    on = [l[k].eqNullSafe(r[k]) for k in keys]
    both = l.join(r, on, "full").select(*(F.coalesce(l[k], r[k]).alias(k) for k in keys), F.coalesce("_l", F.lit(0)).alias("_l"), F.coalesce("_r", F.lit(0)).alias("_r"))
    return both.select(*keys, F.greatest(F.col("_l") - F.col("_r"), F.lit(0)).alias("missing"), F.greatest(F.col("_r") - F.col("_l"), F.lit(0)).alias("extra")).where("missing + extra > 0")


def insert_absent(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(rows.join(stored.select(*keys), keys, "left_anti"))
