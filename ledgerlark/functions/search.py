"""Scores of suggestions for a typed query, and names as they are shown."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S

#: Tickers that come first, and parts of names that are no names (fixed values).
PRIORITY = ("NVDA", "PLTR", "IONQ", "QBTS", "RGTI", "SKYT", "VLD", "OKLO", "SMR", "NNE")
UNCLEAN = ("f s:", "s o:", "subholding of", "filing status", " fields law firm ", " ira fbo ", " morgan stanley ", "etrade", "e*trade", "trust ")


def normal(text: str) -> str:
    return " ".join(re.sub("[^a-z0-9]+", " ", text.lower().replace("&", " and ")).split())


def tokens(text: str) -> list[str]:
    return normal(text).split()


def ticker(text: str) -> str:
    return re.sub("[^A-Z0-9.-]", "", text.strip().upper())[:15]


def actor_key(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.lower())


def text(c) -> Column:
    return S.search_text(F.col(c) if isinstance(c, str) else c)


def alias_score(aliases: list[str], query: str) -> int:
    """How well the best of a few aliases answers a query: whole, beginning, beginnings of words, inside."""
    q, best = normal(query), 0
    for alias in filter(None, map(normal, aliases)):
        if alias == q:
            best = max(best, 260)
        elif alias.startswith(q):
            best = max(best, 125)
        elif all(any(w.startswith(t) for w in alias.split()) for t in q.split()):
            best = max(best, 55)
        elif len(q) >= 3 and q in alias:
            best = max(best, 40)
    return best


def _words_begin(words: Column, query: str) -> Column:
    return F.forall(F.array(*map(F.lit, tokens(query))), lambda t: F.exists(words, lambda w: w.startswith(t)))


def insider_score(name: Column, key: Column, aliases: list[tuple[str, list[str]]], query: str) -> Column:
    plain, q = F.lower(F.trim(name)), query.strip().lower()
    words = F.split(text(name), " ")
    point = lambda condition, n: F.when(condition, n).otherwise(0)
    score = point(plain == q, 120) + point(plain.startswith(q), 70) + point(plain.contains(q), 25) + point(F.array_contains(words, q), 60)
    score += point(F.exists(words, lambda w: w.startswith(q)), 40) + point(_words_begin(words, query), 30)
    for canonical, names in aliases:
        every = [w for a in names for w in tokens(a)]
        named = all(any(w.startswith(t) for w in every) for t in tokens(query))
        score += point(key == actor_key(canonical), 8 + alias_score(names, query) + (40 if named else 0))
    return score


def is_unclean(name: Column) -> Column:
    n = text(name)
    return (n == "") | (F.length(n) > 120) | F.exists(F.array(*(F.lit(p.strip()) for p in UNCLEAN)), lambda p: n.contains(p))


def without_share_kind(name: Column, class_needs_dash: bool) -> Column:
    """A name up to the words that tell its kind of share, without a tag at its end."""
    kind = r"\s+-(\s+class\s+[a-z])?\s+common\s+stock|\s+common\s+stock" if class_needs_dash else r"(\s+-)?(\s+class\s+[a-z])?\s+common\s+stock|\s+-\s+class\s+[a-z]\s+capital\s+stock"
    shares = r"\s+ordinary\s+shares?" if class_needs_dash else r"(\s+class\s+[a-z])?\s+ordinary\s+shares?"
    cut = F.regexp_replace(F.regexp_replace(name, r"\s+\[[A-Z]+\]\s*$", ""), f"(?i)({kind}|{shares}).*$", "")
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def display_name(ticker: Column, name: Column, known: Column) -> Column:
    """The known name of a ticker, else the clean name, else the ticker."""
    clean = F.regexp_replace(without_share_kind(F.trim(F.coalesce(name, F.lit(""))), True), r"(?i)\s+corporation - common.*$", " Corporation")
    return F.coalesce(known, F.when((clean != "") & ~is_unclean(F.coalesce(name, F.lit(""))) & ~is_unclean(clean), clean), ticker)


def calendar_name(ticker: Column, name: Column) -> Column:
    """The company of an asset text, or null where only its ticker or a kind of share is left."""
    clean = without_share_kind(F.coalesce(name, F.lit("")), False)
    kind = F.lower(clean).isin("common stock", "ordinary share", "ordinary shares", "capital stock", "stock")
    return F.when((clean != "") & (F.upper(clean) != F.upper(F.trim(F.coalesce(ticker, F.lit(""))))) & ~kind, clean)


def ticker_score(ticker_: Column, company: Column, raw: Column, aliases: Column, query: str) -> Column:
    q, tick, name = normal(query), ticker(query), text(company)
    terms = F.filter(F.array_distinct(F.concat(F.coalesce(aliases, F.array().cast("array<string>")), F.array(text(ticker_), name))), lambda a: a != "")
    point = lambda condition, n: F.when(condition, n).otherwise(0)
    score = point(name == q, 180) + point(name.startswith(q), 120) + point(name.contains(q), 60)
    if tick:
        score += point(ticker_ == tick, 260) + point(ticker_.startswith(tick), 180)
    each = F.transform(terms, lambda a: F.when(a == q, 210).when(a.startswith(q), 130).when(a.contains(q) & F.lit(len(q) >= 3), 55).otherwise(0))
    words = F.flatten(F.transform(terms, lambda a: F.split(a, " ")))
    return score + F.aggregate(each, F.lit(0), lambda x, y: x + y) + point(_words_begin(words, query), 55) + point(ticker_.isin(*PRIORITY), 12) - point(is_unclean(F.coalesce(raw, F.lit(""))), 20)
