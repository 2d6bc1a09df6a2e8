"""Small inputs with known results, in our own words."""

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlark.functions import calendar as K
from ledgerlark.functions import labels as L
from ledgerlark.functions import options as O
from ledgerlark.functions import scalars as S
from ledgerlark.operators import clusters as C
from ledgerlark.operators import relations as R
from ledgerlark.operators import windows as W
from ledgerlark.sources import sinks

D = datetime.date


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def lit(*values):
    return [F.lit(v) for v in values]


def trades(spark, rows):
    schema = "member_id string, ticker string, direction string, published_date date, transaction_date date, amount_range string, amount_floor int, doc_id string, asset_type string"
    return spark.createDataFrame([(m, t, d, p, x, r, f, doc, "Stock") for m, t, d, p, x, r, f, doc in rows], schema)


def test_amounts(spark):
    got = one(spark, *(S.amount_lower_bound(x) for x in lit("$100,001 - $250,000", "Over $1,000,000", None, "1,001 - 15,000", "over $1 to $2", "Unknown")))
    assert list(got) == [100_001, 1_000_000, 0, 1001, 12, 0]
    got = one(spark, *(S.amount_range(x) for x in lit("$1,001 - $15,000", "$15,001", "Over $50,000,000", "Unknown", "$15,000 - $1,001")))
    assert [(r.min, r.max) for r in got] == [(1001, 15_000), (15_001, 50_000), (50_000_000, 50_000_000), (None, None), (1001, 15_000)]
    assert list(one(spark, *(S.numeric_component(x) for x in lit(0.0, 12.5, 100.0, 0.12345)))) == ["", "12.5", "100", "0.1235"]


def test_accessions_and_issuers(spark):
    assert list(one(spark, *(S.accession(x) for x in lit("a/000110465926032683/x", "b/0001104659-26-032683.txt", "none")))) == ["0001104659-26-032683", "0001104659-26-032683", None]
    assert list(one(spark, *(S.issuer_name(x) for x in lit("ALLY FINL INC", "VERISIGN INC/CA", "Bank America Corp", "The A & B Intl Z")))) == ["ALLY FINANCIAL", "VERISIGN", "BANK OF AMERICA", "THE A AND B INTERNATIONAL"]
    assert list(one(spark, *(S.share_class(x) for x in lit("CAP STK CL A", "COM SER C", "SPON ADR NEW", "COM", None)))) == ["A", "C", "ADR", "COMMON", "COMMON"]


def test_options(spark):
    text = F.lit("Apple Inc. - Common  Stock [OP]")
    o = O.details(F.lit("Apple Call options; Strike price $325; Expires 06/18/2026"), F.lit("OP"))
    got = one(spark, O.label(text, F.lit("OP"), o), O.details(F.lit("plain stock"), F.lit("ST")), O.stripped(O.label(text, F.lit("OP"), o)))
    assert list(got) == ["Apple Inc. - Common Stock [OP] | Call option | Strike $325 | Expires 2026-06-18", None, "Apple Inc. - Common Stock"]


def test_deadlines(spark):
    got = one(spark, *(K.filing_due(F.lit(d)) for d in (D(2024, 3, 31), D(2025, 12, 31), D(2026, 6, 30))), K.next_filing(F.lit(D(2024, 3, 31))))
    assert list(got) == [D(2024, 5, 15), D(2026, 2, 17), D(2026, 8, 14), D(2024, 8, 14)]


def test_labels(spark):
    got = one(spark, L.money_floor(F.lit(115_002)), L.compact_money(F.lit(2_400_000_000)), L.compact_money(F.lit(0)), L.compact_shares(F.lit(1)), L.compact_shares(F.lit(1500)), L.compact_shares(F.lit(25_000_000)), L.per_cent(F.lit(40.0)), L.per_cent(F.lit(12.34)), L.cut(F.lit("a" * 300)))
    assert list(got)[:8] == ["$115,002+", "$2.4B", "$0", "1 share", "1.5K shares", "25M shares", "40%", "12.3%"] and len(got[8]) == 280 and got[8].endswith("...")


def test_search(spark):
    names = ["Nvidia Corp", "nvidia", "Nvidea", "Acme Nvidia", "Unrelated"]
    assert list(one(spark, *(S.search_score(F.lit(n), "NVIDIA") for n in names))) == [850, 1000, 640, 760, 0]


def test_grouping_and_summaries(spark):
    rows = [("K1", "MSFT", "buy", D(2026, 3, 12), D(2026, 3, 1), "$1,001 - $15,000", 1001, f"house-2026-20034179-{k}") for k in (0, 1)]
    groups = C.filing_groups(trades(spark, rows))
    g = groups.first()
    assert groups.count() == 1 and (g.row_count, g.combined_floor, g.ranges, g.published_date) == (2, 2002, "$1,001 - $15,000", D(2026, 3, 12))
    s = C.filing_summaries(groups).first()
    assert (s.trade_count, s.ticker_count, s.tickers) == (2, 1, "MSFT")


def cluster_rows(*days):
    return [(m, "NVDA", "buy", D(2026, 3, d), D(2026, 3, 1), "$15,001 - $50,000", 15_001, f"{m}-{d}") for m, d in days]


def test_congress_clusters(spark):
    pair = C.congress_clusters(trades(spark, cluster_rows(("A", 17), ("B", 18))), 7, 2).collect()
    assert [(r.anchor, r.actors, r.floor_sum) for r in pair] == [(D(2026, 3, 18), 2, 30_002)]
    again = C.congress_clusters(trades(spark, cluster_rows(("A", 17), ("B", 18), ("A", 24), ("B", 24))), 7, 2).collect()
    assert {r.anchor for r in again} == {D(2026, 3, 18), D(2026, 3, 24)} and len({r.cluster_id for r in again}) == 2
    for ticker in ("N/A", "MULTI", "US-TREAS", "", None, "TOOLONG1"):
        assert C.congress_clusters(trades(spark, [(m, ticker, d, p, x, r, f, doc) for m, _, d, p, x, r, f, doc in cluster_rows(("A", 17), ("B", 18))])).count() == 0


def insiders(spark, rows):
    return spark.createDataFrame([(*r, "u") for r in rows], "filer_name string, ticker string, transaction_code string, transaction_date date, published_date date, shares int, amount decimal(18,2), source_url string")


def test_insider_clusters(spark):
    def row(who, day, n=0):
        return (who, "ABC", "P", D(2026, 5, day), D(2026, 5, day), 10 + n, Decimal(100 + n))
    five = [row(f"p{k}", 21 + k, k) for k in range(5)]
    got = C.insider_clusters(insiders(spark, five), 10, 2).collect()
    assert [(r.window_start, r.clocked_at, r.actors) for r in got] == [(D(2026, 5, 21), D(2026, 5, 25), 5)]
    assert C.insider_clusters(insiders(spark, five[:2] + [row("p0", 22, k) for k in range(6)]), 10, 2).count() == 0
    assert C.insider_clusters(insiders(spark, [row(f"owner{k}", 21) for k in range(5)] + [row("other", 22, 9)])).count() == 0


def test_quarter_changes(spark):
    held = [("F", "AAPL", D(2025, 9, 30), 100), ("F", "MSFT", D(2025, 9, 30), 80), ("F", "AAPL", D(2025, 12, 31), 140), ("F", "NVDA", D(2025, 12, 31), 50)]
    df = R.period_changes(spark.createDataFrame(held, "fund string, ticker string, period date, shares long"), "fund", "ticker", "period", "shares")
    assert {(r.ticker, r.shares_held, r.change_shares, r.change_percent) for r in df.collect()} == {("AAPL", 140, 40, Decimal("40.0000")), ("NVDA", 50, 50, None), ("MSFT", 0, -80, Decimal("-100.0000"))}
    assert one(spark, S.fund_change_type(F.lit(202_344), F.lit(202_343), F.lit(20_234_300.0)))[0] == "new"


def test_as_of_and_milestones(spark):
    prices = spark.createDataFrame([("X", D(2026, 1, 8), 80.0), ("X", D(2026, 1, 10), 82.5), ("X", D(2026, 4, 14), 110.0)], "ticker string, price_date date, price double")
    events = spark.createDataFrame([("X", D(2026, 1, 10)), ("X", D(2026, 1, 9)), ("X", D(2026, 1, 7))], "ticker string, at date")
    assert {(r.at, r.price) for r in R.as_of_prices(events, prices, ["ticker"], "at", "price_date", "price").collect()} == {(D(2026, 1, 10), 82.5), (D(2026, 1, 9), 80.0), (D(2026, 1, 7), None)}
    assert list(one(spark, *(S.milestone(F.lit(g), (40, 50, 100, 200)) for g in (100, 41, 39)))) == [100, 40, None]
    assert one(spark, S.performance_score(F.lit(41.2), F.lit(40), F.lit(58), F.lit(50_001)))[0] >= Decimal("0.88")


def test_balances_and_lots_like_a_loop(spark):
    r = random.Random(4)
    rows = [(f"k{k}", n, r.choice(["buy", "sell"]), r.randrange(1, 50)) for k in range(12) for n in range(25)]
    df = spark.createDataFrame(rows, "k string, n int, side string, q long")
    signed = df.withColumn("d", F.when(F.col("side") == "buy", F.col("q")).otherwise(-F.col("q")))
    got = {(x.k, x.n): x.b for x in W.clamped_balance(signed, ["k"], ["n"], "d", "b").collect()}
    left = {(x.k, x.n): x.shares_left for x in W.surviving_lots(df, ["k"], ["n"], "side", "q").collect()}
    want_left = {}
    for k in {x[0] for x in rows}:
        balance, lots = 0, []
        for _, n, side, q in sorted(x for x in rows if x[0] == k):
            balance = max(0, balance + (q if side == "buy" else -q))
            if side == "buy":
                lots.append([n, q])
            while side == "sell" and q and lots:
                used = min(q, lots[0][1])
                q, lots[0][1] = q - used, lots[0][1] - used
                if not lots[0][1]:
                    lots.pop(0)
            assert got[k, n] == balance
        want_left |= {(k, n): q for n, q in lots}
    assert left == want_left


def test_last_wins(spark):
    a = spark.createDataFrame([("e1", 1, "old")], "id string, created int, title string")
    b = spark.createDataFrame([("e1", 1, "new"), ("e2", 2, "other")], a.schema)
    assert {(r.id, r.title) for r in R.last_wins([a, b], ["id"], "created").collect()} == {("e1", "new"), ("e2", "other")}


def test_partition_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "k int, v string, p string").write.partitionBy("p").parquet(path)
    before = sorted(f.name for f in (tmp_path / "t/p=y").iterdir())
    for _ in range(2):
        sinks.upsert_partitions(spark.createDataFrame([(2, "B", "x"), (4, "d", "z")], "k int, v string, p string"), path, ["k"], "p")
        assert {tuple(r) for r in spark.read.parquet(path).select("k", "v", "p").collect()} == {(1, "a", "x"), (2, "B", "x"), (3, "c", "y"), (4, "d", "z")}
    assert before == sorted(f.name for f in (tmp_path / "t/p=y").iterdir())


def test_empty_and_null_inputs(spark):
    none = trades(spark, [(None, None, None, None, None, None, None, None)])
    for rows in (none, none.where("false")):
        assert C.congress_clusters(rows).count() == 0 and C.filing_groups(rows).count() == 0
        assert W.strongest_window(C.congress_events(rows), ["ticker"], "member_id", "published_date", "amount_floor", 45, 4).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["ticker", "direction", "anchor", "actors", "floor_sum"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_notable_clean_and_zero_limits(spark):
    from ledgerlark.operators import rules as B
    base = {"event_id": "1", "signal_type": "politician_trade", "base_type": None, "source": "congress", "direction": "buy", "ticker": "ABC", "actor_name": "Ann Notable", "member_id": None,
            "amount_range": "$1,001 - $15,000", "value": 0, "asset_type": None, "asset_name": None, "theme": None, "member_theme": None, "first_ticker_buy": None, "first_actor_buy": None,
            "change_pct": None, "new_position": None, "gain_pct": None, "milestone_pct": None, "cluster_type": None, "includes_fund": None, "summary_activity": None, "summary_unusual": None,
            "change_type": None, "group_rows": None, "importance": None}
    cases = [base, base | {"actor_name": "A. Else"}, base | {"asset_name": "City Bond 2030"}, base | {"ticker": None}, base | {"signal_type": "insider_cluster", "base_type": "insider_trade", "source": "insider"}]
    schema = ", ".join(f"{k} {'boolean' if k in ('first_ticker_buy', 'first_actor_buy', 'new_position', 'includes_fund', 'summary_activity', 'summary_unusual') else 'int' if k in ('value', 'change_pct', 'gain_pct', 'milestone_pct', 'group_rows') else 'decimal(5,2)' if k == 'importance' else 'string'}" for k in base)
    rows = spark.createDataFrame([tuple(r.values()) for r in cases], schema)
    out = B.behaviour(rows, ("quantum",), ("ann notable",)).withColumn("rule", B.broadcast_rule(("quantum",), ("ann notable",))).collect()
    assert [(r.activity, r.unusual, r.suppressed, r.reasons, r.rule) for r in out] == [
        (True, True, False, ["notable_politician"], "notable_politician_trade"), (True, False, False, [], None), (False, False, True, ["non_clean_asset"], None),
        (False, False, True, ["non_clean_asset"], None), (True, False, False, [], "insider_cluster")]
