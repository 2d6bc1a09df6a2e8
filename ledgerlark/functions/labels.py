"""Texts for readers: money, shares, per cent, dates, name lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_floor(c: Column) -> Column:
    return F.when(c > 0, F.concat(F.lit("$"), F.format_number(F.round(c).cast("long"), 0), F.lit("+")))


def exact_money(c: Column) -> Column:
    return F.when(c > 0, F.concat(F.lit("$"), F.format_number(F.round(c).cast("long"), 0)))


def _tenths(c: Column, unit: int) -> Column:
    return F.round(c.cast("decimal(20,2)") / unit, 1).cast("decimal(20,1)").cast("string")


def compact_money(c: Column) -> Column:
    """$0, thousands without decimals, then millions, billions and trillions with one."""
    scale = F.when(c >= 10**12, F.concat(_tenths(c, 10**12), F.lit("T"))).when(c >= 10**9, F.concat(_tenths(c, 10**9), F.lit("B"))).when(c >= 10**6, F.concat(_tenths(c, 10**6), F.lit("M")))
    thousands = F.concat(F.format_number(F.round(c.cast("decimal(20,2)") / 1000).cast("long"), 0), F.lit("K"))
    return F.concat(F.lit("$"), F.when(F.coalesce(c, F.lit(0)) <= 0, "0").otherwise(F.coalesce(scale, thousands)))


def compact_shares(c: Column) -> Column:
    """Whole units from ten up, one decimal below, closing zero cut."""
    a = F.abs(F.coalesce(c, F.lit(0)))

    def unit(size: int, letter: str) -> Column:
        x = a.cast("decimal(20,2)") / size
        small = F.regexp_replace(F.round(x, 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")
        return F.concat(F.when(x >= 10, F.round(x).cast("long").cast("string")).otherwise(small), F.lit(f"{letter} shares"))

    plain = F.concat(F.format_number(F.round(a).cast("long"), 0), F.when(F.round(a) == 1, " share").otherwise(" shares"))
    return F.when(a >= 10**9, unit(10**9, "B")).when(a >= 10**6, unit(10**6, "M")).when(a >= 1000, unit(1000, "K")).otherwise(plain)


def per_cent(c: Column) -> Column:
    """One decimal, none where it is zero."""
    r = F.round(c, 1).cast("decimal(18,1)")
    return F.concat(F.regexp_replace(r.cast("string"), r"\.0$", ""), F.lit("%"))


def short_date(c: Column) -> Column:
    return F.date_format(c, "MMM d, yyyy")


def name_list(names: Column, most: int = 4) -> Column:
    clean = F.filter(F.transform(names, F.trim), lambda n: n != "")
    rest = F.size(clean) - most
    return F.concat(F.array_join(F.slice(clean, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(", +"), rest.cast("string"), F.lit(" more"))).otherwise(""))


def cut(text: Column, most: int = 280) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def past_days(days: Column) -> Column:
    return F.when(days == 0, "today").when(days == 1, "tomorrow").when(days == 7, "in one week")
