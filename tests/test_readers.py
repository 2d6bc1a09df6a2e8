"""Readers of lines, nested payloads, tables and archives, mended functions, and portfolios on small inputs."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlark.functions import options as O
from ledgerlark.functions import scalars as S
from ledgerlark.functions import search as Q
from ledgerlark.operators import portfolio as P
from ledgerlark.operators import relations as R
from ledgerlark.operators import windows as W
from ledgerlark.plans.filters import dirty_name
from ledgerlark.sources import readers as D

DAY = datetime.date


def column(spark, function, texts):
    return [r.y for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(function(F.col("x")).alias("y")).collect()]


def test_mended_functions(spark):
    assert column(spark, S.share_class, ["CL A", "CLASS B COM", "CL.A", "CLASS-A", "CLASS\tC", "COM SER D", "S E", "CL AB", "SPON ADR", None, "(CLASS F)"]) == ["A", "B", "COMMON", "COMMON", "C", "D", "E", "COMMON", "ADR", "COMMON", "F"]
    assert column(spark, dirty_name, ["Fund 2024-01-05", "Acme 123-45-6789", "Acme,1/2/2024", "Acme 1-2-24", "Acme 1/2/20245", "Acme $5", "Plain Name", "Acme sold"]) == [False, False, True, True, False, True, False, True]
    assert column(spark, S.is_entity_name, ["A. B. L.L.C.", "Ann L L P", "Lp Smith", "Ann B. Cole", "Helping Hand", "Oak Trust", None, "J P Morgan"]) == [True, True, True, False, False, True, False, False]
    got = [(r.o.strike, r.o.expiry) for r in spark.createDataFrame([("call option strike:$150; expires:06/19/2026",), ("call option exp 1/5/27",), ("STRIKE of 1,250.50 [OP]",)], "x string").select(O.details(F.col("x"), F.lit("OP")).alias("o")).collect()]
    assert got == [("150", DAY(2026, 6, 19)), (None, None), ("1250.50", None)]


def test_token_lines_hang_on_their_first_token(spark):
    tokens = [(1, 10, 5, "b"), (1, 28, 1, "a"), (1, 29, 3, "c"), (1, 46, 2, "d"), (1, 47, 9, "e"), (1, 48, 0, "f"), (2, 48, 0, "g"), (2, None, 0, "h")]
    got = {(r.page, r.text): r.line for r in D.token_lines(spark.createDataFrame(tokens, "page int, top int, edge int, text string"), ["page"], "top", "edge").collect()}
    assert got == {(1, "b"): 10, (1, "a"): 10, (1, "c"): 29, (1, "d"): 29, (1, "e"): 29, (1, "f"): 48, (2, "g"): 48}


def test_nested_items(spark):
    docs = [(1, '{"x":{"y":[[{"gaps":[{"a":1},[{"a":9}],{"gaps":[{"a":8}]},null]}]]},"gaps":[]}'), (2, "[]"), (3, None), (4, '"gaps"'), (5, '{"gaps":{"gaps":[{"b":"{}"}]}}')]
    got = [tuple(r) for r in D.nested_items(spark.createDataFrame(docs, "id int, doc string"), "doc", "gaps", "id").collect()]
    assert sorted(got) == [(1, '{"a":1}'), (1, '{"gaps":[{"a":8}]}'), (5, '{"b":"{}"}')]


def test_trade_table(spark):
    head = "".join(f"<th> {h} </th>" for h in ("#", "Amount", "Ticker", "Asset Name", "Transaction Date", "Type"))
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    body = row("1", "$1 - $2", "<a href='x'>ABC</a>", "A &amp; B\n Co", "O1/l5/2024", "Sale (Partial)") + row("2", "", "--", "", "2/3/2024", "Gift") + row("short") + row("3", "$5", "D", "", "soon", "Purchase") + row("4", "$5", "D", "", "12/31/2023", "Purchase")
    html = [(1, f"<table class='list'><tr><td>x</td></tr></table><table id=t class=\"a table b\"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"), (2, "<p>none</p>"), (3, None)]
    got = [tuple(r) for r in D.trade_table(spark.createDataFrame(html, "id int, html string"), "html", "id").orderBy("id", "place").collect()]
    assert got == [(1, 0, DAY(2024, 1, 15), "ABC", "A & B Co", "sell", "$1 - $2"), (1, 1, DAY(2024, 2, 3), "N/A", "--", "exchange", "Unknown"), (1, 4, DAY(2023, 12, 31), "D", "D", "buy", "$5")]


def test_portfolio(spark):
    rng = lambda n: f"${n:,}"
    trades = [("both", "A", "sell", "$1,000 - $3,000", DAY(2024, 1, 9), 1), ("both", "A", "buy", "$2,000 - $4,000", DAY(2024, 3, 1), 1), ("both", "A", "sell", "$9,000 - $9,500", DAY(2024, 2, 1), 1), ("both", "A", "buy", rng(9000), DAY(2024, 1, 5), 9),
              ("only", "B", "buy", "$1,000 - $2,000", DAY(2024, 2, 1), 1), ("only", "B", "sell", "$400 - $600", DAY(2024, 2, 1), 2), ("only", "NOP", "buy", "$1 - $3", DAY(2024, 2, 1), 1), ("only", "B", "gift", "$1 - $3", DAY(2024, 2, 2), 1), ("only", "US-TREAS", "buy", "$1 - $3", DAY(2024, 2, 2), 1)]
    disclosed = [("both", "A", "$5,000 - $15,000", DAY(2024, 1, 9)), ("both", "A", "$50,000 - $60,000", DAY(2023, 1, 9)), ("snap", "A", "$100 - $300", DAY(2024, 1, 31)), ("snap", "B", None, DAY(2024, 5, 1))]
    prices = [("A", DAY(2024, 1, 1), Decimal(100)), ("A", DAY(2024, 3, 1), Decimal(50)), ("B", DAY(2024, 2, 1), Decimal(10)), ("B", DAY(2024, 2, 2), Decimal(20))]
    got = P.live(spark.createDataFrame(trades, "member_id string, ticker string, direction string, amount_range string, date date, row int"), spark.createDataFrame(disclosed, "member_id string, ticker string, value_range string, filed date"), spark.createDataFrame(prices, "ticker string, price_date date, price decimal(18,2)"))
    rows = {(r.member_id, r.ticker): tuple(None if x is None else float(x) for x in r[2:]) for r in got.collect()}
    # both: opens with 100 shares at 100, sells 92.5 of them, buys 60 at 50; the trades up to the snapshot are in it already
    assert rows[("both", "A")] == (2000, 10_000, 2, 67.5, 7.5 * 100 + 60 * 50, 67.5 * 50)
    assert rows[("only", "B")] == (400, 1600, 2, 100, 1000, 2000) and rows[("only", "NOP")] == (1, 3, 1, None, None, None) and rows[("snap", "A")] == (100, 300, 0, 2, 200, 100) and len(rows) == 4


def test_as_of_prices_across_months(spark):
    prices = [("T", DAY(2024, 1, 31), 1), ("T", DAY(2024, 4, 15), 2), ("U", DAY(2024, 2, 1), 3), (None, DAY(2024, 2, 1), 4)]
    events = [("T", DAY(2024, 1, 30)), ("T", DAY(2024, 1, 31)), ("T", DAY(2024, 3, 5)), ("T", DAY(2024, 4, 14)), ("T", DAY(2024, 4, 15)), ("T", DAY(2025, 1, 1)), ("V", DAY(2024, 2, 2)), (None, DAY(2024, 3, 3)), ("T", None)]
    got = R.as_of_prices(spark.createDataFrame(events, "ticker string, day date"), spark.createDataFrame(prices, "ticker string, price_date date, price int"), ["ticker"], "day", "price_date", "price")
    assert {(r.ticker, r.day): r.price for r in got.collect()} == dict(zip(events, [None, 1, 1, 1, 2, 2, None, 4, None], strict=True))


def test_trailing_sums(spark):
    rows = [("k", DAY(2024, 1, d), a, n) for d, a, n in ((1, "x", 5), (1, "x", 6), (2, "y", 7), (4, "x", 1), (9, "z", 2), (11, "y", 3))]
    events = spark.createDataFrame(rows, "key string, day date, actor string, n int")
    got = {r.anchor.day: (r.actors, r.amounts) for r in W.trailing_sums(events, ["key"], "day", "actor", 3, "n").collect()}
    assert got == {1: (1, 11), 2: (2, 18), 4: (2, 8), 9: (1, 2), 11: (2, 5)}
    points = spark.createDataFrame([("k", DAY(2024, 1, 3)), ("k", DAY(2024, 1, 7)), ("none", DAY(2024, 1, 7))], "key string, anchor date")
    assert {(r.key, r.anchor.day): r.actors for r in W.trailing_sums(events, ["key"], "day", "actor", 3, points=points).collect()} == {("k", 3): 2, ("k", 7): 0, ("none", 7): 0}


def test_story_windows_are_as_long_as_their_first_story(spark):
    rows = [(1, 3, "a"), (1, 30, "b"), (3, 9, "c"), (4, 30, "d"), (20, 1, "e"), (34, 0, "f"), (35, None, "g"), (44, 5, "h"), (45, 5, "i")]
    stories = spark.createDataFrame([("k", DAY(2024, 1, 1) + datetime.timedelta(days=d), n, i) for d, n, i in rows], "key string, day date, days int, id string")
    got = {r.id: (r.window_start - DAY(2024, 1, 1)).days for r in W.story_windows(stories, ["key"], "day", "days", "id").collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 4, "e": 4, "f": 34, "g": 35, "h": 35, "i": 45}


def test_names_as_they_are_shown(spark):
    names = ["Acme Corp - Class A Common Stock", "Acme  Corp Common Stock [ST]", "Acme Ordinary Shares each", "Acme Class B Common Stock", "", "filing status: new", "Acme Corporation - Common Stock"]
    assert column(spark, lambda x: Q.display_name(F.lit("ACM"), x, F.lit(None).cast("string")), names) == ["Acme Corp", "Acme Corp", "Acme", "Acme Class B", "ACM", "ACM", "Acme Corporation"]
    assert column(spark, lambda x: Q.calendar_name(F.lit("acm"), x), [*names, "ACM", "Common stock", "Stock"]) == ["Acme Corp", "Acme Corp", "Acme", "Acme", None, "filing status: new", "Acme Corporation", None, None, None]


def test_nearest(spark):
    points = spark.createDataFrame([("k", 10, "u2"), ("k", 10, "u1"), ("k", 20, "v"), ("j", 5, "w")], "key string, n int, name string")
    got = R.nearest(spark.createDataFrame([("k", 14), ("k", 15), ("k", 16), ("k", 99), ("m", 1), ("k", 10)], "key string, n int"), points, ["key"], "n", "name")
    assert {(r.key, r.n): r.near and r.near.name for r in got.collect()} == {("k", 14): "u1", ("k", 15): "u1", ("k", 16): "v", ("k", 99): "v", ("m", 1): None, ("k", 10): "u1"}
