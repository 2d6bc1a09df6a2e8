"""Event graphs walked to their ends, and what stories add up over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators import graph as G
from ledgerlark.plans.catalog import query

REACHED = """r AS (SELECT DISTINCT {root} AS root, {node} AS node FROM {table} {where} UNION SELECT r.root, e.child FROM r JOIN graph_edges e ON r.node = e.parent)"""
ROOTS = REACHED.format(root="id", node="id", table="graph_nodes", where="WHERE p_partkey % 10 = 7")


@query("J12_unequal_depths", "graph_nodes", "graph_edges", sql=f"""
WITH RECURSIVE {ROOTS} SELECT root, node AS leaf FROM r WHERE node IN (SELECT id FROM graph_nodes) AND node NOT IN (SELECT parent FROM graph_edges)""")
def leaves(graph_nodes, graph_edges):
    roots = graph_nodes.where("p_partkey % 10 = 7").select(F.col("id").alias("root"), F.col("id").alias("node"))
    return G.leaves(graph_edges, roots, graph_nodes)


@query("SC32_fetched_graph", "graph_nodes", "graph_edges", sql=f"""
WITH RECURSIVE {ROOTS} SELECT DISTINCT id, ticker, direction, amount_floor FROM graph_nodes WHERE id IN (SELECT node FROM r)""")
def fetched(graph_nodes, graph_edges):
    """All rows that any root leads to, each once."""
    roots = graph_nodes.where("p_partkey % 10 = 7").select(F.lit(0).alias("root"), F.col("id").alias("node"))
    return graph_nodes.join(G.reached(graph_edges, roots), graph_nodes["id"] == F.col("node"), "left_semi").select("id", "ticker", "direction", "amount_floor")


@query("X41_story_floors", "graph_stories", "graph_nodes", "graph_edges", sql=f"""
WITH RECURSIVE {REACHED.format(root="story", node="event", table="graph_stories", where="")}, l AS (SELECT r.root, n.* FROM r JOIN graph_nodes n ON n.id = r.node WHERE r.node NOT IN (SELECT parent FROM graph_edges)),
k AS (SELECT root, id, amount_floor, CASE WHEN source = 'insider' AND ticker IS NOT NULL AND amount <> 0 THEN concat_ws('|', ticker, direction, transaction_date, amount) ELSE id END AS key FROM l),
o AS (SELECT root, key, arg_min(amount_floor, id) AS floor FROM k GROUP BY 1, 2), s AS (SELECT root, sum(floor) AS found FROM o GROUP BY 1), w AS (SELECT story, max(own_floor) AS own FROM graph_stories GROUP BY 1)
SELECT story, CAST(CASE WHEN found > 0 THEN found ELSE own END AS BIGINT) AS floor FROM w LEFT JOIN s ON s.root = w.story""")
def floors(graph_stories, graph_nodes, graph_edges):
    return G.story_floors(graph_stories, graph_edges, graph_nodes)
