"""Tickers of asset texts: known names, lists, beginnings, near names, and plans without pairs of everything."""

import difflib

from pyspark.sql import functions as F

from ledgerlark.functions import assets as A
from ledgerlark.operators import resolve as R

REFERENCE = [("MSFT", "Microsoft Corporation", "Nasdaq"), ("AMBA", "Ambarella Semiconductor Devices Inc", "Nasdaq"), ("AMBB", "Ambarella Semiconductor Devices, Inc.", "NYSE"), ("AMB-P", "Ambarella Semiconductor Devices", "Nasdaq"),
             ("RIV", "River Valley Transportation Logistics", "NYSE"), ("RIVX", "River Valley", ""), ("SUN", "Sunny Hill Mines", "OTC"), ("TRS", "Old Oak Trust", "NYSE"), ("DTD", "Dated Name 1/2/2024", ""), ("D$", "Cash $5 Name", "")]
ROWS = [("MSFT", "Other Name Here"), ("QRSTU", "qrstu units"), ("--", "Dash Dash Company"), ("N/A", "No Such Company"), (" NEWCO ", "Newly Listed Works"), (None, "No Ticker Here"), ("UNK", "Unknown Issuer Name"), ("SUNZ", "Sunny Hill Farms"), ("ONE", "Single Inc")]


def companies(spark):
    return R.company_list(spark.createDataFrame(REFERENCE, "ticker string, name string, exchange string"), spark.createDataFrame(ROWS, "ticker string, name string"))


def house(spark, texts):
    rows = [(i, t[0], list(t[1:]) or None) for i, t in enumerate(texts)]
    got = R.house_tickers(spark.createDataFrame(rows, "row int, asset string, others array<string>"), companies(spark))
    assert got.count() == len(rows)
    return [r.ticker for r in got.orderBy("row").collect()]


def test_company_list_fills_gaps_with_clean_names(spark):
    got = {r.ticker: r.name for r in companies(spark).collect()}
    assert set(got) == {"AMBA", "AMBB", "AMB-P", "RIV", "RIVX", "SUN", "NEWCO", "SUNZ", "MSFT"} and got["MSFT"] == "other name here"  # one word of the reference's name tells something


def test_known_names(spark):
    texts = ["Apple Inc (aapl)", "Alphabet Inc. - Class A", "AT&T Inc.", "Chubb Limited", "US Treasury bill 4.2%", "U.S. TREASURY note", "Lam Resh Corp [ST]", None, "  ", "Intel Corp; Chubb", "nothing known"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(A.known_ticker(F.col("x")).alias("t")).collect()]
    assert got == ["AAPL", "GOOGL", None, "CB", "US-TREAS", "US-TREAS", "LRCX", None, None, "CB", None]


def test_house_tickers(spark):
    texts = [("Ambarella Semiconductor Devices",), ("Ambarella Semiconductor Devices Common Stock and more",), ("Ambarella Semiconductor",), ("Ambarella Semiconductor Device",), ("Ambarella Semiconductor Machines",),
             ("River Valley Transportation Logistic",), ("Rover Valley Transportation Logistics",), ("River Valley Bank",), ("River Valley municipal bond",), ("Sunny Hill",), ("Sunny Hill Minez",), ("Sunny Hill 7 Mines",), ("Sunny Hill Mines [ST] 5/1/2024 $1,000",), ("Newly Listed Works class A",),
             ("??", "Starbucks Coffee"), ("Nobody knows this", "Sunny Hill Mines"), ("Ambarella Semiconductor Device", "Sunny Hill Mines"), (None,), ("",), ("single",)]
    assert house(spark, texts) == ["AMB-P", "AMB-P", "AMB-P", "AMB-P", "N/A", "RIVX", "N/A", "RIVX", "N/A", "SUNZ", "N/A", "N/A", "SUN", "NEWCO", "SBUX", "SUN", "AMB-P", "N/A", "N/A", "N/A"]


def test_matching_blocks(spark):
    pairs = [("river valley transport", "river valley transports"), ("abcd", "bcde"), ("", ""), ("aa", "b")]
    got = [r.r for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(A.matching_blocks("a", "b").alias("r")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_no_pairs_without_a_shared_key(spark, capsys):
    rows = spark.createDataFrame([(1, "Ambarella Semiconductor Device", None)], "row int, asset string, others array<string>")
    for found in (R.house_tickers(rows, companies(spark)), R.senate_tickers(rows, companies(spark))):
        found.explain()
        plan = capsys.readouterr().out
        assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_senate_tickers(spark):
    listed = spark.createDataFrame([("ABC", "Abacus (Holdings) Corp"), ("ABD", "Abacus (Holdings) Corp"), ("INC", "Inc Things"), ("ZED", "Zed Works LLC"), ("FAM", "Oak Family Partners Common Units")], "ticker string, name string")
    texts = ["x (TOOLNG) y", "UNITED STATES TREAS bill", "buy some ABD now", "Abacus (holdings)", "abacus (old) ", "Zed Works LLC", "Oak Family Partners Common", "INC and ZED", "ZED Partners", None, "Inc"]
    got = R.senate_tickers(spark.createDataFrame(list(enumerate(texts)), "row int, asset string"), listed).orderBy("row").collect()
    assert [r.ticker for r in got] == ["TOOLNG", "US-TREAS", "ABD", "ABC", "ABC", None, "FAM", "ZED", None, None, "INC"]
