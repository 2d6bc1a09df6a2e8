"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as named
users; a system turn stays a system turn and is no participant. The result has one row a turn and perspective: the rendered
segment, its place in the rendered dialogue, and the part of it that the loss mask covers (the text and end mark of the
assistant's turns), so that no dialogue is ever one value. Places are prefix sums: over cells of `CELL` turn numbers first and
over the cells of a conversation after, so a very long conversation is spread over tasks.

Edge cases: a null text is empty; a null role is the participant `unknown`; a null conv_id is one conversation; turns with
equal number follow each other by role and text; a conversation of system turns alone has no perspective and gives no rows;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, CELL = "<|im_start|>", "<|im_end|>\n", 1024

SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, perspective, turn, speaker, body,
             CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
             CASE WHEN speaker NOT IN ('system', perspective) THEN speaker END AS name
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, '{START}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM r),
u AS (SELECT *, head || body || '{END.strip()}' || chr(10) AS segment FROM s),
v AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body
                     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_char FROM u)
SELECT conv_id, perspective, turn, role, name, segment, end_char - length(segment) AS start_char, end_char,
       CASE WHEN role = 'assistant' THEN end_char - length(segment) + length(head) ELSE -1 END AS loss_start,
       CASE WHEN role = 'assistant' THEN end_char - 1 ELSE -1 END AS loss_end
FROM v
"""


def rotated(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, start_char, end_char, loss_start and loss_end (-1: none)."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("body"))
    speakers = turns.where("speaker <> 'system'").select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    rows = turns.join(speakers, turns["conv_id"].eqNullSafe(speakers["_c"])).drop("_c")
    rows = rows.withColumn("role", F.expr("case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end"))
    rows = rows.withColumn("name", F.expr("case when speaker not in ('system', perspective) then speaker end"))
    rows = rows.withColumn("head", F.concat(F.lit(START), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n")))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END))).withColumn("cell", F.expr(f"floor(turn / {CELL})"))
    cells = rows.groupBy("conv_id", "perspective", "cell").agg(F.sum(F.length("segment")).alias("n"))
    before = cells.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("cell").alias("_k"), F.expr(
        "sum(n) over (partition by conv_id, perspective order by cell rows between unbounded preceding and current row) - n").alias("before"))
    rows = rows.withColumn("inside", F.expr("sum(length(segment)) over (partition by conv_id, perspective, cell order by turn, speaker, body "
                                            "rows between unbounded preceding and current row)"))
    same = rows["conv_id"].eqNullSafe(before["_c"]) & (rows["perspective"] == before["_p"]) & rows["cell"].eqNullSafe(before["_k"])
    rows = rows.join(before, same).withColumn("end_char", F.col("before") + F.col("inside")).withColumn("start_char", F.col("end_char") - F.length("segment"))
    own = F.col("role") == "assistant"
    return rows.select("conv_id", "perspective", "turn", "role", "name", "segment", "start_char", "end_char",
                       F.when(own, F.col("start_char") + F.length("head")).otherwise(-1).alias("loss_start"),
                       F.when(own, F.col("end_char") - 1).otherwise(-1).alias("loss_end"))
