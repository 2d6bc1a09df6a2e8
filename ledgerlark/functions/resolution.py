"""Names of persons, scanned dates and forms, amounts with a sign, and parse states as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S

#: First names that stand for each other (fixed values).
FIRST_NAMES = (("bill", "billy", "will", "william"), ("dan", "daniel", "danny"), ("dave", "david"), ("jim", "jimmy", "james"), ("rick", "richard"), ("ted", "rafael"), ("tom", "tommy", "thomas"))
#: Left edges of a paper form's columns and what a mark before them means (fixed values).
FORM_KINDS = ((1475, "buy"), (1600, "sell"))
FORM_AMOUNTS = ((2050, "$1,001 - $15,000"), (2200, "$15,001 - $50,000"), (2360, "$50,001 - $100,000"), (2500, "$100,001 - $250,000"), (2620, "$250,001 - $500,000"), (2725, "$500,001 - $1,000,000"), (2835, "$1,000,001 - $5,000,000"))


def first_names_match(filed: Column, registered: Column, prefix: int = 3) -> Column:
    """Any token of one name is the other's, its short form, its initial, or a beginning of `prefix` letters or more."""
    table = F.create_map(*(F.lit(x) for group in FIRST_NAMES for name in group for x in (name, group[0])))
    same = lambda x: F.coalesce(F.try_element_at(table, x), x)

    def fits(a, b):
        begins = a.startswith(b) | b.startswith(a)
        shorter = F.least(F.length(a), F.length(b))
        return (same(a) == same(b)) | (begins & ((shorter == 1) | (shorter >= prefix)))

    return F.exists(S.name_tokens(filed), lambda a: F.exists(S.name_tokens(registered), lambda b: fits(a, b)))


def cluster_direction(c: Column) -> Column:
    n = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(n.startswith("purchase") | n.startswith("buy"), "buy").when(n.startswith("sale") | n.startswith("sell"), "sell")


def dollar_floor(c: Column) -> Column:
    """The first number after a dollar sign, else zero."""
    found = F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit(",")), r"\$([0-9]+(\.[0-9]+)?)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def read_date(c: Column) -> Column:
    """Month, day and year of a scan, letters that look like digits read as digits; null where that is no date."""
    numbers = F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), "oOlI", "0011"), F.lit("([0-9]+)"), 1)

    def read(n):
        month, day, year = (F.get(n, F.lit(i)) for i in range(3))
        whole = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).when(F.length(year) == 4, year)
        return F.when((F.length(month) <= 2) & (F.length(day) <= 2), _date(whole, month, day))

    # the numbers are found once a text, and not for each mention of month, day and year
    return F.get(F.transform(F.array(numbers), lambda n: read(n)), F.lit(0))


def scanned_date(c: Column, filed: Column) -> Column:
    """read_date; a year of one or three digits is filled up to one at most a year from `filed` (a year)."""
    n = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), 1)
    month, day, year = (F.get(n, F.lit(i)) for i in range(3))
    due = F.lpad((filed % 100).cast("string"), 2, "0")
    ends = F.when(F.length(year) == 1, F.array(F.concat(year, F.substring(due, 2, 1)), F.concat(F.substring(due, 1, 1), year))).when(
        F.length(year) == 3, F.array(F.substring(year, 1, 2), F.substring(year, 2, 2), due))
    near = F.filter(F.transform(ends, lambda e: _date(F.concat(F.lit("20"), e), month, day)), lambda d: F.abs(F.year(d) - filed) <= 1)
    return F.coalesce(read_date(c), F.when((F.length(month) <= 2) & (F.length(day) <= 2), F.get(near, F.lit(0))))


def form_kind(left: Column, line: Column) -> Column:
    """What a line of a paper form says in words, else by the place of its mark."""
    text = F.lower(F.coalesce(line, F.lit("")))
    spoken = F.when(text.contains("sale") | text.contains("sold"), "sell").when(text.contains("purchase") | text.contains("buy"), "buy")
    return F.coalesce(spoken, *(F.when(left < edge, F.lit(kind)) for edge, kind in FORM_KINDS), F.lit("exchange"))


def form_amount(left: Column) -> Column:
    return F.coalesce(F.when(left.isNull(), "Unknown"), *(F.when(left < edge, F.lit(text)) for edge, text in FORM_AMOUNTS), F.lit("Over $5,000,000"))


def parse_status(rows: Column, says_none: Column, attached: Column, scanned_rows: Column, scan_says_none: Column) -> Column:
    """trades, no_trade, attachment_unparsed or unparsed; the scan is asked only where the text gave nothing."""
    return (F.when(rows > 0, "trades").when(says_none, "no_trade").when(attached, "attachment_unparsed").when(scanned_rows > 0, "trades").when(scan_says_none, "no_trade").otherwise("unparsed"))


def alias_score(aliases: Column, query: str) -> Column:
    """Best of the aliases: whole, beginning, all words' beginnings, inside."""
    q = query.lower()
    words = lambda a: F.split(a, " ")

    def score(a):
        all_begin = F.forall(F.array(*map(F.lit, q.split())), lambda p: F.exists(words(a), lambda w: w.startswith(p)))
        return F.when(a == q, 260).when(a.startswith(q), 125).when(all_begin, 55).when(a.contains(q) & F.lit(len(q) >= 3), 40).otherwise(0)

    return F.coalesce(F.array_max(F.transform(aliases, lambda a: score(S.search_text(a)))), F.lit(0))
