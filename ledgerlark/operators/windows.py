"""Window operators: trailing clusters, greedy windows, running balances, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_sums(events: DataFrame, keys: list[str], date: str, actor: str, days: int, amount: str | None = None, points: DataFrame | None = None) -> DataFrame:
    """keys, anchor, actors (and amounts): distinct actors, and sums, of the `days` days that end at each anchor.

    Anchors are the events' own dates, or those of `points` (keys, anchor). An actor's day counts from itself on until its days are over
    or the actor's next day takes its place: plus and minus ones, added up by day. Only a key's distinct days meet in one window.
    """
    who = Window.partitionBy(*keys, actor).orderBy("anchor")
    daily = events.select(*keys, F.col(date).alias("anchor"), actor).where("anchor is not null").distinct().withColumn("_next", F.lead("anchor").over(who))
    end = F.date_add("anchor", days)
    zero = F.lit(0).cast("long")
    change = lambda day, n, floor, point: F.struct(day.alias("anchor"), n.cast("long").alias("n"), floor.cast("long").alias("floor"), point.alias("point"))
    own = F.lit(points is None)
    rows = daily.select(*keys, F.explode(F.array(change(F.col("anchor"), F.lit(1), zero, own), change(F.least(end, F.coalesce("_next", end)), F.lit(-1), zero, F.lit(False)))).alias("c")).select(*keys, "c.*")
    if amount:
        sums = events.where(F.col(date).isNotNull()).groupBy(*keys, F.col(date).alias("anchor")).agg(F.sum(amount).alias("_f"))
        rows = rows.unionByName(sums.select(*keys, F.explode(F.array(change(F.col("anchor"), zero, F.col("_f"), own), change(end, zero, -F.col("_f"), F.lit(False)))).alias("c")).select(*keys, "c.*"))
    if points is not None:
        rows = rows.unionByName(points.select(*keys, "anchor").distinct().select(*keys, "anchor", zero.alias("n"), zero.alias("floor"), F.lit(True).alias("point")))
    day = rows.groupBy(*keys, "anchor").agg(F.sum("n").alias("n"), F.sum("floor").alias("floor"), F.bool_or("point").alias("point"))
    past = Window.partitionBy(*keys).orderBy("anchor").rowsBetween(Window.unboundedPreceding, 0)
    out = day.withColumn("actors", F.sum("n").over(past)).withColumn("amounts", F.sum("floor").over(past)).where("point")
    return out.select(*keys, "anchor", "actors", *(["amounts"] if amount else []))


def trailing_actors(events: DataFrame, keys: list[str], actor: str, date: str, days: int, least: int) -> DataFrame:
    """For each key and date, the distinct actors of the `days` days ending there, where there are `least` or more."""
    return trailing_sums(events, keys, date, actor, days).where(F.col("actors") >= least)


def strongest_window(events: DataFrame, keys: list[str], actor: str, date: str, floor: str, days: int, least: int) -> DataFrame:
    """The trailing window of each key with most actors, then largest sum of amount floors, then the latest."""
    rows = trailing_sums(events, keys, date, actor, days, floor).withColumnRenamed("amounts", "floor_sum").where(F.col("actors") >= least)
    best = rows.groupBy(*keys).agg(F.max(F.struct("actors", "floor_sum", "anchor")).alias("b"))
    return best.select(*keys, "b.anchor", "b.actors", "b.floor_sum")


def greedy_windows(events: DataFrame, keys: list[str], date: str, days: int) -> DataFrame:
    """Adds window_start: a window opens at the first date past the last window and spans `days` days.

    The fold runs over a key's distinct dates (at most one a calendar day), not over its rows; rows then join their date's window.
    """
    return events.join(window_days(events, keys, date, days), [*keys, date])


def window_days(events: DataFrame, keys: list[str], date: str, days: int) -> DataFrame:
    """keys, date and window_start: a key's distinct dates, each with the greedy window it lies in."""
    starts = (events.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(date)).alias("dates"))
              .withColumn("starts", F.aggregate("dates", F.expr("cast(array() as array<date>)"), lambda acc, d: F.when(
                  (F.size(acc) == 0) | (F.datediff(d, F.element_at(acc, -1)) >= days), F.concat(acc, F.array(d))).otherwise(acc))))
    of = F.explode(F.transform("dates", lambda d: F.struct(d.alias("d"), F.element_at(F.filter("starts", lambda s: s <= d), -1).alias("s")))).alias("w")
    return starts.select(*keys, of).select(*keys, F.col("w.d").alias(date), F.col("w.s").alias("window_start"))


def story_windows(stories: DataFrame, keys: list[str], day: str, days: str, tie: str) -> DataFrame:
    """Adds window_start: a window opens at the first story past the last window and is as long as the `days` of that story (one at least).

    Of stories of one day the first by `tie` counts. The fold runs over a key's distinct days and carries the end of the open window.
    """
    first = stories.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(F.min_by(F.greatest(F.lit(1), F.coalesce(days, F.lit(10))).cast("int"), tie).alias("n"))
    sorted_days = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col("n").alias("n")))).alias("days"))
    start = "cast(named_struct('open', null, 'end', null, 'out', array()) as struct<open: date, end: date, out: array<struct<d: date, s: date>>>)"

    def step(acc, x):
        opens = acc["end"].isNull() | (x["d"] >= acc["end"])
        held = F.when(opens, x["d"]).otherwise(acc["open"])
        until = F.when(opens, F.date_add(x["d"], x["n"])).otherwise(acc["end"])
        return F.struct(held.alias("open"), until.alias("end"), F.concat(acc["out"], F.array(F.struct(x["d"].alias("d"), held.alias("s")))).alias("out"))

    opened = sorted_days.select(*keys, F.explode(F.aggregate("days", F.expr(start), step)["out"]).alias("w")).select(*keys, F.col("w.d").alias(day), F.col("w.s").alias("window_start"))
    return stories.join(opened, [*keys, day])


def latest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def clamped_balance(rows: DataFrame, keys: list[str], order: list[str], delta: str, out: str) -> DataFrame:
    """Running sum that never falls below zero: S - least(0, running minimum of S)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_s", F.sum(delta).over(w))
    return summed.withColumn(out, F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def prior_counts(events: DataFrame, keys: list[str], date: str, out: str) -> DataFrame:
    """Rows of the same key with an earlier date."""
    day = F.datediff(date, F.lit("1970-01-01").cast("date"))
    return events.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)))


def surviving_lots(rows: DataFrame, keys: list[str], order: list[str], side: str, shares: str) -> DataFrame:
    """Buy lots with the shares left after first-in-first-out selling; sales beyond what is held are ignored."""
    signed = rows.withColumn("_d", F.when(F.col(side) == "buy", F.col(shares)).otherwise(-F.col(shares)))
    balanced = clamped_balance(signed, keys, order, "_d", "_held")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys)
    held = balanced.withColumn("_buy", F.when(F.col(side) == "buy", F.col(shares)).otherwise(F.lit(0)))
    held = held.withColumn("_cum", F.sum("_buy").over(w)).withColumn("_all", F.sum("_buy").over(back))
    held = held.withColumn("_last", F.max_by("_held", F.struct(*order)).over(back))
    left = F.least(F.col(shares), F.greatest(F.lit(0), F.col("_cum") - (F.col("_all") - F.col("_last"))))
    return held.where(F.col(side) == "buy").withColumn("shares_left", left).where("shares_left > 0").drop("_d", "_held", "_buy", "_cum", "_all", "_last")


def quota_top(rows: DataFrame, group: str, order: list[Column], each: int, limit: int) -> DataFrame:
    """Up to `each` rows of every group come first, the rest fill up by the global order.

    No group can bring more than its first `each + limit` rows, so that groups are cut to those before they are moved.
    """
    ranked = rows.withColumn("_g", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_g") <= each + limit)
    return ranked.withColumn("reserved", F.col("_g") <= each).orderBy(F.desc("reserved"), *order).limit(limit).drop("_g")
