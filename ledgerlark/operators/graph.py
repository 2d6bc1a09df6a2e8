"""Walks over parent-child edges: rounds of joins until no root meets a new node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.sources.workspace import shared_folder


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All (root, node) pairs: roots (root, node), and whatever edges (parent, child) lead to, cycles and shared children included.

    A round joins the newest pairs with the edges and keeps those that no round had before. Every round is written under the
    shared folder and read back, so plans stay short, a lost executor costs a part of one round, and the number of rounds is the
    length of the longest shortest path and not a parameter.
    """
    spark = roots.sparkSession
    folder = shared_folder(spark, "walk")
    children = edges.select(F.col("parent").alias("node"), "child").where("node is not null and child is not null").distinct()
    pairs = roots.select("root", "node").where("node is not null").distinct()
    schema, k = pairs.schema, 0
    while True:
        pairs.write.parquet(f"{folder}/round={k}")
        newest = spark.read.schema(schema).parquet(f"{folder}/round={k}")
        if newest.isEmpty():
            break
        seen = spark.read.schema(schema).parquet(*(f"{folder}/round={i}" for i in range(k + 1)))
        step = newest.join(children, "node").select("root", F.col("child").alias("node")).distinct()
        pairs = step.join(seen, [step["root"].eqNullSafe(seen["root"]), step["node"] == seen["node"]], "left_anti")
        k += 1
    return spark.read.schema(schema).parquet(*(f"{folder}/round={i}" for i in range(k + 1)))


def leaves(edges: DataFrame, roots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The reached pairs (root, leaf) whose node names no child; with `nodes` (id), only nodes that stand there."""
    ends = reached(edges, roots).join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    if nodes is not None:
        ends = ends.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return ends.select("root", F.col("node").alias("leaf"))


def economic_key() -> Column:
    """One key for the filings of one insider trade; other rows keep their own id."""
    whole = F.col("ticker").isNotNull() & F.col("direction").isNotNull() & F.col("transaction_date").isNotNull() & (F.coalesce("amount", F.lit(0)) != 0)
    return F.when((F.col("source") == "insider") & whole, F.concat_ws("::", F.lit("insider-economic"), "ticker", "direction", F.col("transaction_date").cast("string"), F.col("amount").cast("string"))).otherwise(F.col("id"))


def story_floors(stories: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """story, floor: the amount floors of the leaves under a story's supporting events (story, event, own_floor), an economic trade
    counted once (its smallest id); the story's own floor where the leaves give nothing."""
    under = leaves(edges, stories.select(F.col("story").alias("root"), F.col("event").alias("node")), nodes)
    rows = under.join(nodes.withColumn("key", economic_key()), under["leaf"] == nodes["id"])
    once = rows.groupBy("root", "key").agg(F.min_by("amount_floor", "id").alias("floor"))
    sums = once.groupBy(F.col("root").alias("story")).agg(F.sum("floor").cast("long").alias("found"))
    own = stories.groupBy("story").agg(F.max("own_floor").cast("long").alias("own"))
    return own.join(sums, "story", "left").select("story", F.when(F.col("found") > 0, F.col("found")).otherwise(F.col("own")).alias("floor"))
