"""The quota by event time under different cuts, late days and restarts; walks to the end of a graph."""

import datetime
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import graph as G
from ledgerlark.streaming import QuotaRun

T = datetime.datetime(2024, 3, 1)
SCHEMA = "user_id long, event_id long, value double, ts timestamp"


def rows_of(n, days):
    r = random.Random(7)
    return [(r.randrange(4), i, float(r.randrange(20)), T + datetime.timedelta(days=r.randrange(days), seconds=r.randrange(86_400))) for i in range(n)] + [(None, 9001, 1.0, T), (1, None, 1.0, T), (1, 9002, 1.0, None)]


def best(rows, limit, ledger=()):
    days = {}
    for user, event, value, ts in rows:
        if None not in (user, event, ts):
            days.setdefault((user, ts.strftime("%Y-%m-%d")), set()).add((-value, event))
    out = Counter()
    for (user, day), events in days.items():
        held = {e for u, d, e in ledger if (u, d) == (user, day)}
        out.update((user, day, e, "reserved") for _, e in events if e in held)
        out.update((user, day, e, "queued") for _, e in sorted(x for x in events if x[1] not in held)[: max(0, limit - len(held))])
    return out


def put(spark, folder, rows, parts):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).sortWithinPartitions(F.rand(3)).repartition(parts).write.mode("append").parquet(folder)


def run(spark, folder, limit, delay, ledger=None):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    held = None if ledger is None else spark.createDataFrame(ledger, "user_id long, day string, event_id long")
    return QuotaRun(spark, source, limit, delay, held)


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_quota_is_the_same_for_any_cut(spark, tmp_path, parts):
    rows = rows_of(600, 5)
    ledger = [(1, "2024-03-02", rows[0][1]), (2, "2024-03-03", 99_999), (2, "2024-03-03", 99_998)] + [(u, ts.strftime("%Y-%m-%d"), e) for u, e, _, ts in rows[:40] if u == 3]
    put(spark, str(tmp_path / "in"), rows, parts)
    assert got(run(spark, str(tmp_path / "in"), 3, "30 days", ledger).closing()) == best(rows, 3, ledger)


def test_quota_goes_on_after_a_stop_and_closes_late_days(spark, tmp_path):
    folder = str(tmp_path / "in")
    early, middle = rows_of(200, 4), [(u, e + 5000, v, ts + datetime.timedelta(days=4)) for u, e, v, ts in rows_of(100, 3)[:100]]
    put(spark, folder, early, 2)
    job = run(spark, folder, 2, "1 days")
    first = got(job.more())
    assert first and set(first) <= set(best(early, 2))
    put(spark, folder, middle, 1)
    second = got(job.more())
    closed = {(u, d) for u, d, _, _ in second}
    late = [(0, 7000, 1e6, T), (1, 7001, 1e6, T + datetime.timedelta(hours=5))]
    assert {(0, "2024-03-01"), (1, "2024-03-01")} <= closed
    put(spark, folder, late, 1)  # days that the watermark has closed: no part in anything
    assert got(job.closing()) == best(early + middle, 2)


def test_walks(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("e", "gone"), ("x", "x"), ("y", "gone"), (None, "a"), ("a", None), ("z1", "z2")] + [(f"n{i}", f"n{i + 1}") for i in range(9)]
    roots = [("r", "a"), ("r", "b"), ("s", "e"), ("s", "y"), ("t", "x"), ("u", "n0"), ("u", "f"), (None, "z1"), ("v", None), ("w", "gone")]
    e, r = spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame(roots, "root string, node string")
    assert Counter(tuple(x) for x in G.leaves(e, r).collect()) == Counter([("r", "f"), ("r", "gone"), ("s", "f"), ("s", "gone"), ("u", "n9"), ("u", "f"), (None, "z2"), ("w", "gone")])
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e", "f", "n9", "z2", "y", "x")], "id string")
    assert Counter(tuple(x) for x in G.leaves(e, r, nodes).collect()) == Counter([("r", "f"), ("s", "f"), ("u", "n9"), ("u", "f"), (None, "z2")])
    assert G.reached(e, r).where("root = 'u'").count() == 11 and G.reached(e, r.where("false")).count() == 0


def test_story_floors_count_an_economic_trade_once(spark):
    schema = "id string, ticker string, direction string, source string, transaction_date date, amount decimal(18,2), amount_floor int"
    day, ten = datetime.date(2024, 1, 1), Decimal(10)
    nodes = [("p", None, None, "congress", None, None, 7), ("a", "T", "buy", "insider", day, ten, 100), ("b", "T", "buy", "insider", day, ten, 900), ("c", "T", "buy", "congress", day, ten, 40), ("d", "T", "buy", "insider", day, Decimal(0), 5), ("z", "T", "buy", "congress", day, ten, 0)]
    edges = [("p", "a"), ("p", "b"), ("p", "c"), ("p", "d"), ("p", "lost")]
    stories = [("s", "p", 1), ("s", "c", 1), ("none", "z", 33), ("lost", "lost", 44)]
    out = G.story_floors(spark.createDataFrame(stories, "story string, event string, own_floor int"), spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame(nodes, schema))
    assert {tuple(r) for r in out.collect()} == {("s", 145), ("none", 33), ("lost", 44)}
