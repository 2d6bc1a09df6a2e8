"""Asset texts to tickers by equal keys: names, beginnings of names by words or letters, and near names that share two words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import assets as A
from ledgerlark.functions import scalars as S
from ledgerlark.operators.relations import first_per
from ledgerlark.sources.workspace import staged

NEAR = 0.96


def company_list(reference: DataFrame, rows: DataFrame) -> DataFrame:
    """ticker, exchange, name (normal form), words of all companies: the reference (ticker, name, exchange), gaps filled from rows (ticker, name)."""
    tick = F.substring(F.upper(F.trim(F.coalesce("ticker", F.lit("")))), 1, 10)
    ref = reference.where(A.is_listable(F.col("name")) & (tick != "")).select(tick.alias("ticker"), "name", F.coalesce("exchange", F.lit("")).alias("exchange"), F.lit(0).alias("source"))
    own = F.trim(F.coalesce("ticker", F.lit("")))
    more = rows.where(A.is_listable(F.col("name")) & (own != "") & ~A.is_placeholder(own, F.col("name"))).select(F.substring(own, 1, 10).alias("ticker"), "name", F.lit("").alias("exchange"), F.lit(1).alias("source"))
    one = first_per(ref.unionByName(more), ["ticker"], [F.asc("source"), F.asc("name")])
    return one.select("ticker", "exchange", A.company_name(F.col("name")).alias("name")).withColumn("words", A.name_words(F.col("name")))


def _order(exact: bool = False) -> Column:
    """What comes first: by name, exchange and ticker; among equal names by exchange, plain and short tickers."""
    rank = S.exchange_rank(F.col("exchange"))
    if exact:
        return F.struct(rank.alias("a"), F.when(F.col("ticker").contains("-"), 1).otherwise(0).alias("b"), F.length("ticker").alias("c"), F.col("ticker").alias("t"))
    return F.struct(F.col("name").alias("a"), rank.alias("b"), F.lit(0).alias("c"), F.col("ticker").alias("t"))


def _key(kind: str, words: Column, n: int) -> Column:
    return F.concat(F.lit(kind), F.array_join(F.slice(words, 1, n), " "))


def index(companies: DataFrame) -> DataFrame:
    """key, ticker: one row for each whole name and each beginning of up to three words. A name of two words answers longer ones too,
    a longer one answers two words only where these are all."""
    w, n = F.col("words"), F.size("words")
    whole = companies.groupBy(F.concat(F.lit("name "), "name").alias("key")).agg(F.min(_order(True))["t"].alias("ticker"))
    keys = F.filter(F.array(F.when(n == 2, _key("2 ", w, 2)), F.when(n >= 3, _key("3 ", w, 3)), F.when(n >= 3, _key("only 2 ", w, 2))), lambda k: k.isNotNull())
    begins = companies.select(F.explode(keys).alias("key"), _order().alias("o")).groupBy("key").agg(F.min("o").alias("o")).select("key", F.col("o.t").alias("ticker"), "o")
    return whole.select("key", "ticker", F.lit(None).cast(begins.schema["o"].dataType).alias("o")).unionByName(begins)


def house_tickers(assets: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds ticker to assets (row, asset, others: an array of fallback texts): written or well-known first, then names of the companies.

    Each text in turn: a whole name, else a shared beginning of two or three words, else the nearest name of at least `NEAR` among those
    that share the first two words. Pairs are formed only for texts that nothing else resolves, on equal two-word keys. N/A else.
    """
    companies = staged(companies)  # it is met three times
    texts = F.concat(F.array("asset"), F.coalesce("others", F.array().cast("array<string>")))
    known = F.get(F.filter(F.transform(texts, A.known_ticker), lambda t: t.isNotNull()), F.lit(0))
    rows = assets.withColumn("_known", known).withColumn("_look", F.col("_known").isNull() & A.may_be_looked_up(texts))
    tries = rows.where("_look").select("row", F.posexplode(F.filter(F.transform(texts, A.company_name), lambda n: n != "")).alias("turn", "name")).withColumn("words", A.name_words(F.col("name")))
    w, n = F.col("words"), F.size("words")
    keys = F.array(F.concat(F.lit("name "), "name"), F.when(n >= 2, _key("2 ", w, 2)), F.when(n >= 3, _key("3 ", w, 3)), F.when(n == 2, _key("only 2 ", w, 2)))
    asked = tries.select("row", "turn", F.posexplode(keys).alias("step", "key")).where("key is not null").join(index(companies), "key")
    # a whole name (no order of its own) comes before beginnings; among beginnings the first company counts
    met = asked.groupBy("row", "turn").agg(F.min(F.struct(F.when(F.col("step") == 0, 0).otherwise(1).alias("step"), "o", "ticker"))["ticker"].alias("ticker"))
    open_ = tries.join(met, ["row", "turn"], "left_anti").where(F.size("words") >= 2).select("row", "turn", "name", _key("", w, 2).alias("key"))
    others = companies.where(F.size("words") >= 2).select(_key("", F.col("words"), 2).alias("key"), F.col("name").alias("other"), _order().alias("o"))
    pairs = open_.join(others, "key").where(A.could_reach(F.col("name"), F.col("other"), NEAR)).withColumn("ratio", A.matching_blocks("name", "other")).where(F.col("ratio") >= NEAR)
    near = pairs.groupBy("row", "turn").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "o"))["o"]["t"].alias("ticker"))
    best = met.unionByName(near).groupBy("row").agg(F.min(F.struct("turn", "ticker"))["ticker"].alias("_found"))
    return rows.join(best, "row", "left").withColumn("ticker", F.coalesce("_known", "_found", F.lit("N/A"))).drop("_known", "_found", "_look")


def senate_tickers(assets: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds ticker to assets (row, asset): written, treasury, the first word that is a ticker, or the first company whose name begins with
    the text, the text without its brackets next. Private entities have no ticker by a word, nor by a name unless they name a share."""
    text = F.coalesce("asset", F.lit(""))
    upper = F.upper(text)
    written = F.nullif(F.regexp_extract(text, r"\(([A-Z]{1,6})\)", 1), F.lit(""))
    fixed = F.coalesce(written, F.when(upper.contains("UNITED STATES TREAS") | upper.contains("U.S. TREASURY"), "US-TREAS"))
    private = A.is_private(F.col("asset"))
    words = F.filter(F.regexp_extract_all(upper, F.lit(r"\b([A-Z]{1,5})\b"), 1), lambda x: ~x.isin(*A.NO_SYMBOLS))
    rows = assets.withColumn("_fixed", fixed)
    rest = rows.where("_fixed is null")
    symbols = companies.select(F.upper(F.trim("ticker")).alias("word")).distinct()
    by_word = (rest.where(~private).select("row", F.posexplode(words).alias("turn", "word")).join(symbols, "word")
               .groupBy("row").agg(F.min(F.struct("turn", "word"))["word"].alias("_word")))
    squeezed = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    texts = F.transform(F.array(text, F.regexp_replace(text, r"\([^)]*\)", "")), lambda x: F.substring(squeezed(x), 1, 80))
    asked = rest.where(~private | A.is_public(F.col("asset"))).select("row", F.posexplode(texts).alias("turn", "begin")).where("begin <> ''")
    # every beginning of a name is a key, so that the search for beginnings is an equality
    begins = (companies.withColumn("name", F.lower("name")).select("ticker", F.explode(F.expr("transform(sequence(1, least(length(name), 80)), i -> substring(name, 1, i))")).alias("begin"))
              .groupBy("begin").agg(F.min("ticker").alias("ticker")))
    by_name = asked.join(begins, "begin").groupBy("row").agg(F.min(F.struct("turn", "ticker"))["ticker"].alias("_name"))
    return rows.join(by_word, "row", "left").join(by_name, "row", "left").withColumn("ticker", F.coalesce("_fixed", "_word", "_name")).drop("_fixed", "_word", "_name")
