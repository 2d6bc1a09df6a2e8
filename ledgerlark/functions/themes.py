"""Themes of tickers and texts. Tables are parameters; the default holds a few themes over the synthetic part names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: theme -> (tickers, keywords)
DEFAULT = {"fasteners": (("ABC",), ("bolt", "nut")), "colours": ((), ("red", "blue")), "jewels": (("AAB", "AAC"), ("ring",)), "parts": ((), ("widget", "gear"))}
COMMITTEES = {"fasteners": ("AMERICA", "ASIA"), "jewels": ("EUROPE",), "colours": ("AFRICA", "ASIA")}


def infer(ticker: Column, text: Column, table: dict = DEFAULT) -> Column:
    """Sorted themes whose tickers hold the ticker or whose keywords stand in the text."""
    low, t = F.lower(F.coalesce(text, F.lit(""))), F.upper(F.trim(F.coalesce(ticker, F.lit(""))))
    hits = [F.when(t.isin(*tickers) | low.rlike("|".join(words)), F.lit(theme)) for theme, (tickers, words) in sorted(table.items())]
    return F.array_compact(F.array(*hits))


def of_committee(name: Column, table: dict = COMMITTEES) -> Column:
    n = F.upper(F.coalesce(name, F.lit("")))
    return F.array_compact(F.array(*(F.when(n.rlike("|".join(words)), F.lit(theme)) for theme, words in sorted(table.items()))))
