"""Names on filings to registered members: blocked on the last name and the district, compared by first names, taken where one is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import scalars as S
from ledgerlark.functions.resolution import first_names_match


def resolved(filers: DataFrame, members: DataFrame, key: str, block: list[str]) -> DataFrame:
    """Adds resolved_id to filers (key, first_name, last_name, block columns): the one member (member_id, first_name, last_name, block columns)
    whose last name is the same, marks and suffixes aside, and whose first names fit; null for none and for several.

    Members of one last name and block who fit in several ways are counted once; rows meet on equal keys alone.
    """
    last = F.array_join(S.name_tokens(F.col("last_name")), " ")
    left = filers.select(key, *block, F.col("first_name").alias("_filed"), last.alias("_last")).where("_last <> ''")
    right = members.select(F.col("member_id").alias("_id"), *block, F.col("first_name").alias("_registered"), last.alias("_last"))
    fits = left.join(right, [*block, "_last"]).where(first_names_match(F.col("_filed"), F.col("_registered")))
    one = fits.groupBy(key).agg(F.count_distinct("_id").alias("_n"), F.min("_id").alias("resolved_id")).where("_n = 1").drop("_n")
    return filers.join(one, key, "left")
