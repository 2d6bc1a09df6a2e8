"""Asset texts of filings and names of companies: normal forms, tickers written out, well-known names, and what is no equity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Parts of a text that name no company, words that carry nothing, words and tags of other securities, and names with their tickers.
DROPPED = (r"\[[a-z]{1,4}\]", r"\$\s*\d[\d,]*(?:\.\d+)?", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d+(?:\.\d+)?%\b", r"\bclass\s+[a-z]\b", r"\bcommon stock\b", r"\bst\b", r"\bbill\b")
STOP_WORDS = ("and", "class", "cmn", "cmin", "co", "common", "corp", "corporation", "group", "inc", "ltd", "ordinary", "plc", "share", "shares", "stock")
OTHER_WORDS = ("bond", "bonds", "note", "notes", "treasury", "treasuries", "municipal", "muni", "turnpike", "certificate", "trust", "fund", "funds", "series", "option", "options", "futures", "lp", "llc", "l.p", "l.p.")
OTHER_TAGS = ("[gs]", "[ot]", "[ct]", "[hn]")
TREASURY = ("UNITED STATES TREAS", "U.S. TREASURY", "US TREAS", "TREASURY BILL")
PLAIN_ALIASES = (("ALPHABET", "GOOGL"), ("CHUBB", "CB"))
ALIASES = {
    "abbott laboratories": "ABT", "ally financial": "ALLY", "american intl group": "AIG", "american international group": "AIG", "american tower": "AMT", "avnet": "AVT", "arista networks": "ANET",
    "at t": "T", "att": "T", "axalta": "AXTA", "biogen": "BIIB", "bank of america": "BAC", "berkshire hathaway": "BRKB", "block inc": "XYZ", "broadcom": "AVGO", "canadian imperial bank": "CM",
    "capital one financial": "COF", "costco wholesale": "COST", "carrier global": "CARR", "colgate palmolive": "CL", "coca cola europacific partners": "CCEP", "estee laude": "EL", "estee lauder": "EL",
    "eaton": "ETN", "eversource energy": "ES", "extra space storage": "EXR", "first solar": "FSLR", "fortinet": "FTNT", "ge vernova": "GEV", "gilead sciences": "GILD", "hims hers health": "HIMS",
    "hubspot": "HUBS", "imperial bank": "CM", "international business machines": "IBM", "ibm": "IBM", "intel": "INTC", "kimberly clark": "KMB", "lam research": "LRCX", "lam resh": "LRCX",
    "mead johnson": "MJN", "michael kors": "KORS", "martin marietta": "MLM", "metlife": "MET", "micron technology": "MU", "occidental petro": "OXY", "paycom software": "PAYC", "qihu 360": "QIHU",
    "quanta services": "PWR", "rockwell automation": "ROK", "salesforce": "CRM", "servicenow": "NOW", "starbucks": "SBUX", "sysco": "SYY", "texas instruments": "TXN", "thermo fisher": "TMO",
    "trade desk": "TTD", "united rentals": "URI", "waste management": "WM", "western alliance": "WAL", "zoetis": "ZTS",
}
PRIVATE = (" LLC", " L.L.C", " L.P.", " LP", " PARTNERS", " FAMILY", " TRUST")
PUBLIC = (" STOCK", " SHARES", " COMMON", " ETF", " ETN", " ADR", " ADS", " INC", " CORP", " PLC")
NO_SYMBOLS = ("NYSE", "OTC", "LLC", "LP", "INC", "CORP", "LTD")


def _held(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: text.contains(p))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def company_name(c: Column) -> Column:
    """Lower-case words of a name, & as a word, without tags, sums, dates and words of share kinds."""
    text = F.replace(F.lower(_text(c)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "|".join(DROPPED), " "), "[^a-z0-9]+", " "))


def name_words(name: Column) -> Column:
    """The telling words of a normal name."""
    return F.filter(F.split(name, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def known_ticker(c: Column) -> Column:
    """A ticker in brackets, the treasury, or the first well-known name inside the text."""
    upper = F.upper(_text(c))
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(t).alias("t")) for a, t in ALIASES.items()))
    written = F.nullif(F.regexp_extract(_text(c), r"\(([A-Za-z]{1,6})\)", 1), F.lit(""))
    plain = [F.when(upper.contains(a), t) for a, t in PLAIN_ALIASES]
    # an array of one, so that the name is made once and not for each alias
    listed = F.transform(F.array(company_name(c)), lambda name: F.get(F.filter(table, lambda x: name.contains(x["a"])), F.lit(0))["t"])
    return F.coalesce(F.upper(written), F.when(_held(upper, TREASURY), "US-TREAS"), *plain, F.get(listed, F.lit(0)))


def may_be_looked_up(texts: Column) -> Column:
    """Whether texts (an array) together may name a listed company: no tag or word of another security, no digit, two words at least."""
    raw = F.lower(F.array_join(F.transform(texts, _text), " "))
    name = F.array_join(F.filter(F.transform(texts, company_name), lambda n: n != ""), " ")
    other = F.arrays_overlap(F.split(name, " "), F.array(*map(F.lit, OTHER_WORDS)))
    return ~_held(raw, OTHER_TAGS) & ~other & ~name.rlike("[0-9]") & (F.size(name_words(name)) >= 2)


def is_listable(c: Column) -> Column:
    """Whether a name of a list of companies is a clean one of an equity."""
    raw, name = F.trim(_text(c)), company_name(c)
    words = name_words(name)
    dated = raw.rlike(r"\b\d{1,2}/\d{1,2}/\d{2,4}\b")
    return (raw != "") & ~_held(F.lower(raw), OTHER_TAGS) & ~raw.contains("$") & ~dated & (F.size(words) >= 2) & ~F.arrays_overlap(words, F.array(*map(F.lit, OTHER_WORDS))) & ~name.startswith("unknown")


def is_placeholder(ticker: Column, name: Column) -> Column:
    """Whether a row only repeats its ticker as the name, or has none."""
    bare = F.regexp_replace(F.lower(ticker), "[^a-z0-9]", "")
    squeezed = F.replace(company_name(name), F.lit(" "), F.lit(""))
    return (F.replace(ticker, F.lit("-"), F.lit("")) == "") | (ticker == "N/A") | (F.length(bare) >= 5) & squeezed.startswith(bare)


@F.pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks (the longest common block, then to its left and right) over both lengths."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def could_reach(a: Column, b: Column, ratio: float) -> Column:
    """False where lengths alone keep `matching_blocks` below ratio."""
    return 2 * F.least(F.length(a), F.length(b)) >= ratio * (F.length(a) + F.length(b))


def is_private(text: Column) -> Column:
    return _held(F.concat(F.lit(" "), F.upper(_text(text))), PRIVATE)


def is_public(text: Column) -> Column:
    return _held(F.concat(F.lit(" "), F.upper(_text(text))), PUBLIC)
