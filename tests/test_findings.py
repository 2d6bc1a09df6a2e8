"""Findings of the reviewers, each on a small input that went wrong or whose plan grew too fast before."""

import datetime
import hashlib
import random
import time
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlark.operators import clusters as C
from ledgerlark.operators import deliveries as V
from ledgerlark.operators import relations as R
from ledgerlark.operators import suggest as G
from ledgerlark.operators import windows as W
from ledgerlark.plans import QUERIES
from ledgerlark.plans import aggregates as B
from ledgerlark.plans import reader_queries as T
from ledgerlark.plans import scalar_queries as N
from ledgerlark.plans import signal_queries as Q
from ledgerlark.sources import adapters as A
from ledgerlark.sources import readers as S
from ledgerlark.sources import workspace as X
from ledgerlark.streaming import QuotaRun

D = datetime.date


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_portfolio_shares_are_not_rounded_up(spark):
    """2,000 of 20,000,001 cents are a little less than a ten-thousandth; half shares are rounded as the SQL casts them."""
    rows = [("A", "AA", "P", D(2024, 1, 1), Decimal("1.00")), ("A", "BB", "P", D(2024, 1, 1), Decimal("1.00")), ("B", "AA", "P", D(2024, 1, 1), Decimal("1.50"))]
    insiders = spark.createDataFrame(rows, "filer_name string, ticker string, transaction_code string, transaction_date date, shares decimal(18,2)")
    prices = spark.createDataFrame([("AA", D(2024, 1, 1), Decimal("20.00")), ("BB", D(2024, 1, 1), Decimal("199980.01"))], "ticker string, price_date date, price decimal(18,2)")
    assert {(r.filer_name, r.ticker): (r.held, r.share_bp) for r in Q.c13(insiders, prices).collect()} == {("A", "AA"): (1, 0), ("A", "BB"): (1, 9999), ("B", "AA"): (2, 10000)}


def test_deliveries_are_decided_once_for_equal_keys(spark):
    events = [("d1", "0.72", True, "ticker", "AA"), ("d1", "0.72", True, "actor", "p:1"), ("d2", "0.72", True, "ticker", "AA"), ("d3", "0.56", False, "ticker", "AA"), ("d4", "0.56", True, "ticker", "AA"), ("d5", "0.77", True, "ticker", "ZZ")]
    events = spark.createDataFrame([(d, Decimal(i), u, m, t) for d, i, u, m, t in events], "doc_id string, importance decimal(5,2), unusual boolean, match_type string, target string")
    follows = spark.createDataFrame([("W1", "ticker", "unusual", "AA"), ("W2", "ticker", "both", "AA"), ("W3", "actor", "activity", "p:1"), ("W1", "actor", "unusual", "p:1")], "watchlist_id string, match_type string, alert_mode string, target string")
    subs = spark.createDataFrame([(w, s, "sms", Decimal("0.70")) for w, s in (("W1", "S1"), ("W2", "S2"), ("W3", "S3"), ("W2", "S4"), ("W1", "S4"))], "watchlist_id string, subscription_id string, channel string, minimum_importance decimal(5,2)")
    t, both = "watchlist_ticker_match", "watchlist_actor_match,watchlist_ticker_match"
    want = {("d1", "S1", both), ("d1", "S2", t), ("d1", "S3", "watchlist_actor_match"), ("d1", "S4", both), ("d2", "S1", t), ("d2", "S2", t), ("d2", "S4", t), ("d3", "S2", t), ("d3", "S4", t), ("d4", "S2", t), ("d4", "S4", t)}
    for size in (1, 1000):
        got = [(r.doc_id, r.subscription_id, r.reasons) for r in C.follow_deliveries(events, follows, subs, size).collect()]
        assert sorted(got) == sorted(want)


def test_quota_keeps_no_more_than_its_limit(spark, tmp_path):
    """Open days keep the best three events of a user and no state in Python."""
    at = datetime.datetime(2024, 3, 1, 12)
    spark.createDataFrame([(u, u * 100 + k, float(k), at) for u in range(5) for k in range(40)], "user_id long, event_id long, value double, ts timestamp").write.parquet(str(tmp_path / "in"))
    job = QuotaRun(spark, spark.readStream.schema("user_id long, event_id long, value double, ts timestamp").parquet(str(tmp_path / "in")), 3, "2 days")
    assert job.more().count() == 0
    assert spark.read.parquet(job.versions[max(job.versions)][0]).groupBy("user_id").count().where("count <> 3").count() == 0
    assert {(r.user_id, r.event_id) for r in job.closing().collect()} == {(u, u * 100 + k) for u in range(5) for k in (37, 38, 39)}


def test_equal_names_make_no_pairs_in_suppression(spark):
    """3,000 rows of one name and 3,000 aliases of another meet as one pair of names."""
    own = spark.range(3000).selectExpr("concat('TX', lpad(id, 6, '0')) AS ticker", "'cold bolt works' AS company")
    known = spark.range(3000).selectExpr("concat('TX', lpad(id + 2999, 6, '0')) AS ticker", "'Cold Bolt' AS company")
    out = G.suppressed(own, known)
    assert out.count() == 3000 and "max(ticker" in plan(out)
    assert G.suppressed(own.limit(1), own.limit(1)).count() == 0


def test_quota_selection_cuts_groups_before_they_are_moved(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 10 = 0, 'a', 'b') AS rule", "id % 37 AS amount")
    out = W.quota_top(rows, "rule", [F.desc("amount"), F.asc("id")], 2, 5)
    assert "WindowGroupLimit" in plan(out)
    assert [(r.rule, r.id, r.reserved) for r in out.collect()] == [("b", 36, True), ("b", 73, True), ("a", 110, True), ("a", 480, True), ("b", 147, False)]


def test_nearest_goes_through_no_frame_again(spark):
    points = spark.createDataFrame([("k", 10, "u2"), ("k", 20, "v")], "key string, n int, name string")
    assert "unboundedfollowing" not in plan(R.nearest(spark.createDataFrame([("k", 14)], "key string, n int"), points, ["key"], "n", "name")).lower()


def test_clusters_over_stretches_of_the_calendar(spark):
    """Every anchor's actors over a year by brute force; rows are not copied once for each anchor."""
    r = random.Random(5)
    rows = [(f"M{r.randrange(9)}", "AA", "buy", D(2024, 1, 1) + datetime.timedelta(days=r.randrange(366)), r.choice((1001, 15001))) for _ in range(250)]
    trades = spark.createDataFrame([(*x, "d") for x in rows], "member_id string, ticker string, direction string, published_date date, amount_floor int, doc_id string")
    out = C.congress_clusters(trades)
    want = {}
    for day in {x[3] for x in rows}:
        near = [x for x in rows if 0 <= (day - x[3]).days <= 9]
        who = sorted({x[0].lower() for x in near})
        if len(who) >= 2:
            want[day] = (len(who), sum(x[4] for x in near), hashlib.sha1("|".join(who).encode()).hexdigest())
    assert {x.anchor: (x.actors, x.floor_sum, x.actor_hash) for x in out.collect()} == want and "sequence(" not in plan(out)


def test_ids_are_grouped_by_texts(spark):
    insiders = spark.createDataFrame([("https://x/0000000001-97-000003.txt#3",)] * 2, "source_url string")
    trades = spark.createDataFrame([("house-1996-5-3", None, "buy", "$1 - $1,000")] * 3, "doc_id string, ticker string, direction string, amount_range string")
    out = N.ids(trades, insiders)
    assert sorted((r.filing, r.n) for r in out.collect()) == [("0000000001-97-000003", 2), ("house-1996-5", 3)] and "hashpartitioning(source_url" in plan(out)


def test_rules_evaluate_shared_columns_once(spark, sf_dir):
    assert plan(QUERIES["R1_R4_Q11_event_behaviour"](spark, sf_dir)).count("Project") >= 4


def test_trade_lines_are_not_sorted_together_again(spark):
    """Ranges that end up to five lines further on, and one that ends too far on; documents are dealt by their number."""
    head = "cold bolt [ST]  P 01/02/2024 01/05/2024 $1,001 -"
    docs = spark.createDataFrame([("a", "\n".join(["Header", head, "x", "y", "z", "w", " $15,000 ", head + "$2,000", head])), ("b", "\n".join([head, "1", "2", "3", "4", "5", "$15,000"]))], "filing string, text string")
    out = S.trade_lines(docs, "text", "filing")
    assert "Window" not in plan(out)
    assert [(r.filing, r.at, r.asset, r.amount_range) for r in out.orderBy("filing", "at").collect()] == [("a", 1, "cold bolt", "$1,001 - $15,000"), ("a", 7, "cold bolt", "$1,001 - $2,000"), ("a", 8, "cold bolt", None), ("b", 0, "cold bolt", None)]


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(R, "PART_ROWS", 10)
    assert R.dealt(spark.range(95), "id").rdd.getNumPartitions() == 10


def test_trades_are_joined_without_sorting(spark, sf_dir):
    assert plan(A.view(spark, sf_dir, "trades")).count("ShuffledHashJoin") == 3


def test_filings_are_dealt_and_kept_apart_once(spark, monkeypatch):
    """A filing that holds purchases and sales is fed alone; rows are dealt by their number."""
    url = "https://x/000000000{}-97-00000{}.txt#1"
    rows = [(url.format(1, 1), "P"), (url.format(1, 1), "S"), (url.format(2, 1), "S"), (url.format(2, 1), "S"), (url.format(3, 1), "P"), (url.format(4, 1), "X")]
    monkeypatch.setattr(R, "PART_ROWS", 1)
    out = B.d11(spark.createDataFrame(rows, "source_url string, transaction_code string"))
    assert sorted((r.accession, r.origin) for r in out.collect()) == [("0000000001-97-000001", "feed"), ("0000000002-97-000001", "stored"), ("0000000003-97-000001", "feed")]
    assert "Join" not in plan(out) and "REPARTITION_BY_NUM" in plan(out)


def test_positions_are_dealt_by_their_number(spark, monkeypatch):
    rows = [("A", "AA", D(2024, 1, 1 + k), f"u{k}", Decimal("5.00"), Decimal("2.00"), "P") for k in range(5)]
    monkeypatch.setattr(R, "PART_ROWS", 1)
    out = B.position_changes(spark.createDataFrame(rows, "filer_name string, ticker string, transaction_date date, source_url string, amount decimal(18,2), shares decimal(18,2), transaction_code string"))
    assert "REPARTITION_BY_NUM" in plan(out) and sorted(int(r.after) for r in out.collect()) == [1002, 1004, 1006, 1008, 1010]


def test_insider_clusters_find_economic_rows_once(spark, monkeypatch):
    rows = [(f"p{k}", "ABC", "P", D(2026, 5, 21 + k), D(2026, 5, 21 + k), 10 + k, Decimal(100 + k), f"u{k}") for k in range(5)]
    monkeypatch.setattr(R, "PART_ROWS", 1)
    out = C.insider_clusters(spark.createDataFrame(rows, "filer_name string, ticker string, transaction_code string, transaction_date date, published_date date, shares int, amount decimal(18,2), source_url string"))
    assert "REPARTITION_BY_NUM" in plan(out) and "row_number" not in plan(out)
    assert [(r.window_start, r.actors, r.trades) for r in out.collect()] == [(D(2026, 5, 21), 5, 5)]


def test_calendar_rollup_copies_no_row_for_each_level(spark, sf_dir):
    out = plan(QUERIES["A10_calendar_rollup"](spark, sf_dir))
    assert "Expand" not in out and "lineitem" not in out


def test_cells_are_read_once(spark):
    """A filter on the date is not pushed below the reading of cells."""
    pages = spark.createDataFrame([("a", "<table/>")], "id string, html string")
    assert plan(S.trade_table(pages, "html", "id")).count("<td") == 1


def test_portfolio_sorts_moves_once(spark, sf_dir, monkeypatch):
    """Trades and disclosures are read once and go through all windows in one order; hashed lookups give the same rows as broadcast ones."""
    run = QUERIES["C13_disclosed_portfolio"]
    out = run(spark, sf_dir)
    text = plan(out)
    assert text.count("Sort [") == 1 and text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text and "lineitem" not in text
    monkeypatch.setattr(R, "LOOKUP_ROWS", 0)
    hashed = run(spark, sf_dir)
    assert "ShuffledHashJoin" in plan(hashed) and out.exceptAll(hashed).count() == hashed.exceptAll(out).count() == 0 < out.count()


def test_cross_source_events_are_written_once(spark, sf_dir, monkeypatch):
    """Windows and holdings are read from written rows, distinct actors are not counted by copies of rows; hashed lookups give the same rows."""
    run = QUERIES["J7_cross_source_buys"]
    out = run(spark, sf_dir)
    assert "lineitem" not in plan(out) and "Expand" not in plan(out) and "FullOuter" not in plan(out)
    monkeypatch.setattr(R, "LOOKUP_ROWS", 0)
    hashed = run(spark, sf_dir)
    assert "ShuffledHashJoin" in plan(hashed) and out.exceptAll(hashed).count() == hashed.exceptAll(out).count() == 0


def test_period_changes_by_one_order(spark):
    """A skipped period of the group, a key that leaves and comes back, one that stays out, and rows without a key."""
    q = [D(2024, 3, 31), D(2024, 6, 30), D(2024, 12, 31)]
    rows = [("F", "A", q[0], 5), ("F", "A", q[2], 7), ("F", "B", q[0], 4), ("F", "C", q[1], None), ("F", "C", q[2], 3), ("F", None, q[1], 2), ("G", "A", q[0], 9)]
    out = R.period_changes(spark.createDataFrame(rows, "fund string, ticker string, period date, shares long"), "fund", "ticker", "period", "shares")
    assert "Join" not in plan(out).replace("BroadcastHashJoin", "")
    got = {(r.fund, r.ticker, r.period, r.shares_held, r.change_shares) for r in out.collect()}
    assert got == {("F", "A", q[1], 0, -5), ("F", "A", q[2], 7, 7), ("F", "B", q[1], 0, -4), ("F", "C", q[1], 0, 0), ("F", "C", q[2], 3, 3), ("F", None, q[1], 2, 2), ("F", None, q[2], 0, -2)} and out.count() == 7


def test_ownership_documents_are_dealt_by_their_number(spark, monkeypatch):
    """Trades are dealt before they are grouped; a document's lines keep their order, and those without a ticker are left out."""
    rows = [("A", "AA", D(2024, 1, 2), "P", Decimal(n), Decimal(a)) for n, a in ((12, 7), (11, 9), (11, 8), (5, 1), (10, 1))] + [("A", "AA", D(2024, 1, 3), "S", Decimal(3), Decimal(1)), ("A", None, D(2024, 1, 3), "S", Decimal(3), Decimal(1))]
    monkeypatch.setattr(R, "PART_ROWS", 1)
    out = T.sc15(spark.createDataFrame(rows, "filer_name string, ticker string, transaction_date date, transaction_code string, shares decimal(18,2), amount decimal(18,2)"))
    assert "REPARTITION_BY_NUM" in plan(out)
    # of the codes M, the one of ten shares was neither acquired nor disposed of and comes first
    assert [(r.source_url, r.direction, int(r.shares), int(r.value)) for r in out.orderBy("source_url").collect()] == [
        ("u/A/AA/2024-01-02#1", "buy", 5, 1), ("u/A/AA/2024-01-02#2", "buy", 11, 8), ("u/A/AA/2024-01-02#3", "buy", 11, 9), ("u/A/AA/2024-01-02#4", "buy", 12, 7), ("u/A/AA/2024-01-03#0", "sell", 3, 1)]


def test_ownership_documents_end_with_their_element(spark):
    """Text after a document is not read, an end tag in a comment ends none, and a document that is not closed gives no rows."""
    one = "<ownershipDocument><issuerTicker>ab</issuerTicker><owner>{}</owner><transactions><transaction><code>P</code><acquired/><day>2024-01-02</day><shares>1</shares></transaction></transactions>"
    end = "</ownershipDocument>"
    docs = [("envelope", end + "\n<ownershipDocuments>\U0001f600 " + one.format("A &amp; B") + end + " < & </XML>" + one), ("comment", one.format(f"<!-- {end} -->C") + end), ("open", "x" + one.format("D")), ("cut", one.format("D") + end[:-1]), ("none", "x"), ("empty", ""), ("null", None)]
    got = S.form4_transactions(spark.createDataFrame(docs, "url string, text string"), "text", "url")
    assert sorted((r.source_url, r.ticker, r.filer_name, r.direction, int(r.shares)) for r in got.collect()) == [("comment#0", "AB", "C", "buy", 1), ("envelope#0", "AB", "A & B", "buy", 1)]


def test_deliveries_move_no_pairs(spark):
    """Documents of several keys by brute force, followers in one part or in many; nothing is dealt, sorted or joined after documents and followers met."""
    r = random.Random(3)
    events = list({(f"d{r.randrange(40)}", Decimal(r.choice(("0.56", "0.72", "0.77"))), r.choice((True, False, None)), *(("ticker", r.choice("ABC")) if r.random() < 0.7 else ("actor", r.choice(("p:1", "p:2", "q", None))))) for _ in range(120)})
    follows = list({(f"W{r.randrange(8)}", *r.choice((("ticker", "A"), ("ticker", "B"), ("ticker", "Z"), ("actor", "p:1"), ("actor", "p:2"), ("actor", None))), r.choice(("both", "activity", "unusual", None))) for _ in range(60)})
    subs = list({(f"W{r.randrange(8)}", f"S{r.randrange(9)}", r.choice(("sms", "email")), r.choice((None, Decimal("0.60"), Decimal("0.72"), Decimal("0.75")))) for _ in range(40)})
    found = {}
    for doc, importance, unusual, kind, target in events:
        for w, k, t, mode in follows:
            if kind == k and target == t and target is not None and (mode in ("both", "activity") or unusual):
                for x, s, channel, least in subs:
                    if x == w:
                        found.setdefault((doc, s, channel), []).append((importance, least, mode in ("both", "activity"), f"watchlist_{kind}_match"))
    want = set()
    for key, rows in found.items():
        least = [x[1] for x in rows if x[1] is not None]
        if any(x[2] for x in rows) or least and max(x[0] for x in rows) >= min(least):
            want.add((*key, ",".join(sorted({x[3] for x in rows}))))
    e = spark.createDataFrame(events, "doc_id string, importance decimal(5,2), unusual boolean, match_type string, target string")
    f = spark.createDataFrame(follows, "watchlist_id string, match_type string, target string, alert_mode string")
    u = spark.createDataFrame(subs, "watchlist_id string, subscription_id string, channel string, minimum_importance decimal(5,2)")
    for most in (1, 10, 1000):
        out = C.follow_deliveries(e, f, u, most)
        assert [line.strip(" +-") for line in plan(out).splitlines()][1].startswith("MapInArrow")
        got = [tuple(x) for x in out.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_task_looks_up_few_follows_at_once(monkeypatch):
    """Documents are taken until their follows are as many as ROWS, one at least; follows that come in any order, and a key of no follower."""
    follows = [(f"6:ticker{t}", f"S{s}", "sms", 0.7, s % 2 == 0) for s in range(7) for t in "BA"]
    part = V.Part(pa.Table.from_pylist([dict(zip(("key", "subscription_id", "channel", "least", "activity"), x)) for x in follows]))
    held = [["A"], ["A", "B"], ["X"], ["B", "X"], []]
    documents = pa.RecordBatch.from_pylist([{"doc_id": f"d{k}", "held": [{"key": f"6:ticker{t}", "unusual": t == "B", "importance": 0.8 if t == "B" else None} for t in ts]} for k, ts in enumerate(held)])
    names, want = ["doc_id", "subscription_id", "channel", "reasons"], {("d0", s) for s in (0, 2, 4, 6)} | {(d, s) for d in ("d1", "d3") for s in range(7)}
    for rows in (1, 8, 14, 1000):
        monkeypatch.setattr(V, "ROWS", rows)
        blocks = list(part.deliveries(documents, names))
        got = [(x["doc_id"], int(x["subscription_id"][1:])) for b in blocks for x in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want and {x["reasons"] for b in blocks for x in b.to_pylist()} == {"watchlist_ticker_match"}
        assert len(blocks) == {1: 3, 8: 3, 14: 3, 1000: 1}[rows]


def test_written_tables_leave_no_shuffle_files(spark):
    shuffled = lambda: {x for x in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before, setting = shuffled(), spark.conf.get(X.CLEAN_UP)
    rows = spark.range(3000).selectExpr("id % 700 AS a").groupBy("a").count()
    first, second = X.staged(rows), X.staged(rows)
    assert len(first.collect()) == len(second.collect()) == 700
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(X.CLEAN_UP) == setting


def test_compiled_families_are_counted_one_by_one(spark, sf_dir):
    out = plan(QUERIES["C8_compiled_counts"](spark, sf_dir))
    assert "lineitem" not in out and "orders" not in out and out.count("Exchange hashpartitioning(") <= 1


def test_filings_are_counted_in_one_dealing(spark, monkeypatch):
    """Groups and summaries as the operators make them; a filing without a member, one trade twice, and trades without a ticker."""
    rows = [("f-1-1", "AA", "M1", "buy", 3), ("f-1-2", "AA", "M1", "buy", 4), ("f-1-3", "BB", "M1", "sell", 1), ("f-1-3", "BB", "M2", "sell", 9), ("f-2-1", "AA", None, "buy", 5), ("f-2-1", "AA", None, "buy", 5), ("f-3-1", None, "M1", "buy", 30)]
    trades = spark.createDataFrame([(*x[:4], D(2024, 1, x[4]), D(2024, 1, 1), 1001, "r") for x in rows], "doc_id string, ticker string, member_id string, direction string, published_date date, transaction_date date, amount_floor int, amount_range string")
    filed = trades.where("ticker is not null").withColumn("filing", F.regexp_replace("doc_id", "-[0-9]+$", ""))
    monkeypatch.setattr(R, "PART_ROWS", 1)
    out = C.filing_counts(filed)
    groups = C.filing_groups(trades)
    assert "Exchange hashpartitioning(filing" in plan(out) and plan(out).count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan(out)
    assert {(r.kind, r.n, r.latest) for r in out.collect()} == {("group", 4, D(2024, 1, 9)), ("summary", 2, D(2024, 1, 5))}
    assert groups.count() == 4 and C.filing_summaries(groups).count() == 2
    assert {(r.kind, r.n, r.latest) for r in C.filing_counts(filed.limit(0)).collect()} == {("group", 0, None), ("summary", 0, None)}


def test_lines_are_dealt_less_often(spark, sf_dir):
    """Customers are joined to orders first; the view's rows are those of the plain joins, customers of one key and orders of none included."""
    out = A.view(spark, sf_dir, "trades")
    text = plan(out)
    assert text.index("o_orderkey#") > 0 and "Exchange hashpartitioning(o_custkey" in text and text.count("ShuffledHashJoin") == 3
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "part")}
    plain = tables["lineitem"].join(tables["orders"], F.expr("l_orderkey = o_orderkey")).join(tables["customer"], F.expr("o_custkey = c_custkey")).join(tables["part"], F.expr("l_partkey = p_partkey"))
    assert out.count() == plain.count() and [c.split("#")[0] for c in out.columns][:3] == ["member_id", "politician_name", "ticker"]


def test_ids_are_grouped_by_the_parts_of_their_texts(spark):
    """Odd parts, bars and ends of lines in them included, make the groups that their hashes make (as in the SQL, a text of no document has no content); trades are written before they are grouped, each text moved once."""
    parts = [None, "", "a", "a-1", "a-1\n", "a|b", "a-1|b-2", "b"]
    rows = [(d, t, w, r) for d in parts for t in (None, "", "T", "b|T") for w in ("buy", "T|buy") for r in (None, "", "b|r", "r")] * 2
    trades = spark.createDataFrame(rows, "doc_id string, ticker string, direction string, amount_range string")
    out = N.ids(trades, spark.createDataFrame([], "source_url string"))
    text = plan(out)
    assert "hashpartitioning(doc_id" in text and "LocalTableScan [doc_id" not in text and "Scan ExistingRDD[doc_id" not in text
    stable, content = N.S.stable_id(F.col("doc_id"), F.col("ticker"), F.col("direction")), F.sha2(F.concat("doc_id", F.lit("|"), "amount_range"), 256)
    want = trades.groupBy(N.S.filing_key(F.col("doc_id")).alias("filing"), stable.alias("stable"), content.alias("content")).count()
    assert sorted(map(str, out.collect())) == sorted(str(r).replace("count=", "n=") for r in want.collect())
