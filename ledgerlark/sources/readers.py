"""Readers of the filing formats: text columns in, rows out. Every one is a plan of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.resolution import read_date
from ledgerlark.functions.scalars import insider_direction
from ledgerlark.sources.workspace import staged

FORM4 = "issuerTicker STRING, owner STRING, transactions STRUCT<transaction: ARRAY<STRUCT<code: STRING, acquired: STRING, day: STRING, shares: DECIMAL(18,2), value: DECIMAL(18,2), following: DECIMAL(18,2)>>>"
INFO_TABLE = "infoTable ARRAY<STRUCT<nameOfIssuer: STRING, titleOfClass: STRING, value: DECIMAL(38,2), shares: BIGINT, type: STRING, putCall: STRING>>"


def between_tags(text: Column, tag: str) -> Column:
    """The first block of a tag inside an envelope of other text, with its tags."""
    return F.regexp_extract(text, rf"(?s)(<{tag}\b.*?</{tag}>)", 1)


def from_tag(text: Column, tag: str) -> Column:
    """Text from the first start of a tag on, empty where there is none. What follows the block stays, as a reader of one element ends with that element."""
    return F.regexp_replace(text, rf"(?s)^(?:.*?(?=<{tag}\b)|.*)", "")


def without_namespaces(xml: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', ""), r"(</?)\w+:", "$1")


def form4_transactions(docs: DataFrame, text: str, url: str) -> DataFrame:
    """One row a purchase or sale of an ownership document, by its code or else by whether shares were acquired, with its index in the document as part of its address."""
    parsed = docs.withColumn("_d", F.from_xml(from_tag(F.col(text), "ownershipDocument"), FORM4))
    rows = parsed.select(F.col(url), "_d.issuerTicker", "_d.owner", F.posexplode("_d.transactions.transaction").alias("tx_index", "t"))
    direction = insider_direction(F.coalesce(F.col("t.code"), F.lit("")), F.coalesce(F.col("t.acquired"), F.lit("")))
    return rows.withColumn("direction", direction).where("direction in ('buy', 'sell') and t.day is not null").select(
        F.concat(url, F.lit("#"), "tx_index").alias("source_url"), F.upper(F.trim("issuerTicker")).alias("ticker"), F.col("owner").alias("filer_name"), "direction",
        F.to_date("t.day").alias("transaction_date"), F.col("t.shares").alias("shares"), F.col("t.value").alias("value"), F.col("t.following").alias("following"))


def information_table(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row an issuer and class of a holdings filing, summed over its lines."""
    body = without_namespaces(between_tags(F.col(text), r"(?:\w+:)?informationTable"))
    rows = docs.select(*keys, F.explode(F.from_xml(body, INFO_TABLE)["infoTable"]).alias("i"))
    return rows.groupBy(*keys, F.col("i.nameOfIssuer").alias("issuer"), F.col("i.titleOfClass").alias("title")).agg(F.sum("i.value").cast("decimal(38,2)").alias("value"), F.sum("i.shares").alias("shares"))


def submissions(docs: DataFrame, json: str, forms: tuple[str, ...], *keys: str) -> DataFrame:
    """Rows of an index that comes as parallel arrays, one row an accession."""
    d = docs.select(*keys, F.from_json(json, "form array<string>, accession array<string>, filed array<string>").alias("d"))
    rows = d.select(*keys, F.explode(F.arrays_zip("d.form", "d.accession", "d.filed")).alias("r")).select(*keys, "r.*").where(F.col("form").isin(*forms))
    return rows.groupBy(*keys, "accession").agg(F.min("form").alias("form"), F.min(F.to_date("filed")).alias("filed"))


def fields_and_rows(docs: DataFrame, json: str, wanted: list[str], *keys: str) -> DataFrame:
    """Rows of a table that comes as field names and arrays of values, by name and not by place."""
    d = docs.select(*keys, F.from_json(json, "fields array<string>, data array<array<string>>").alias("d")).select(*keys, "d.fields", F.explode("d.data").alias("row"))
    return d.select(*keys, *(F.try_element_at("row", F.array_position("fields", F.lit(w)).cast("int")).alias(w) for w in wanted))


def tab_separated(lines: DataFrame, line: str, schema: str) -> DataFrame:
    return lines.select(F.from_csv(line, F.lit(schema), {"sep": "\t"}).alias("r")).select("r.*")


def feed_entries(docs: DataFrame, xml: str, since: Column) -> DataFrame:
    """Entries of an Atom feed from `since` on, one row an accession."""
    d = docs.select(F.explode(F.from_xml(xml, "entry ARRAY<STRUCT<title: STRING, id: STRING, updated: STRING>>")["entry"]).alias("e"))
    rows = d.select(F.regexp_extract("e.id", r"(\d{10}-\d{2}-\d{6})", 1).alias("accession"), F.to_date(F.substring("e.updated", 1, 10)).alias("filed"), F.col("e.title").alias("title")).where(F.col("filed") >= since)
    return rows.groupBy("accession").agg(F.max("filed").alias("filed"), F.min("title").alias("title"))


def links_of(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """Text and address of the list links of a page, by place."""
    found = F.regexp_extract_all(html, F.lit(r'(<li><a href="[^"]*">[^<]*</a></li>)'), 1)
    rows = pages.select(*keys, F.posexplode(found).alias("place", "_l"))
    return rows.select(*keys, "place", F.regexp_extract("_l", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("_l", ">([^<]*)</a>", 1).alias("label"))


def relative_day(text: Column, now: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.contains("yesterday"), F.date_sub(now, 1)).when(low.contains("today"), now).otherwise(F.coalesce(F.try_to_date(text, "d MMM yyyy"), F.try_to_date(text, "yyyy-MM-dd")))


LINE = r"^(.*?)\s+(?:\[(\w+)\]\s+)?([PS])\s+(\d{2}/\d{2}/\d{4})\s+(\d{2}/\d{2}/\d{4})\s+(\$[\d,]+\s+-)\s*(\$[\d,]+)?$"


def trade_lines(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """Trades of a filing's text lines: an asset line with dates, whose range may end on one of the next five lines."""
    # a document's lines look ahead inside their own array: its lines are not sorted together again
    lines = docs.select(*keys, F.transform(F.split(text, "\n"), lambda x: F.trim(x)).alias("_lines"))
    found = F.transform("_lines", lambda x, at: F.when(x.rlike(LINE), F.struct(at.cast("int").alias("at"), x.alias("line"), F.slice("_lines", at + 2, 5).alias("_ahead"))))
    rows = lines.select(*keys, F.inline(F.filter(found, lambda x: x.isNotNull())))
    ends = r"^(\$[\d,]+)$"
    rows = rows.select(*keys, "at", "line", F.regexp_extract(F.get(F.filter("_ahead", lambda x: x.rlike(ends)), F.lit(0)), ends, 1).alias("_next"))
    part = lambda k: F.regexp_extract("line", LINE, k)
    return rows.select(*keys, "at", part(1).alias("asset"), F.nullif(part(2), F.lit("")).alias("asset_type"), part(3).alias("code"), F.to_date(part(4), "MM/dd/yyyy").alias("transaction_date"), F.to_date(part(5), "MM/dd/yyyy").alias("filed"),
                       F.concat(F.regexp_replace(part(6), r"\s+", " "), F.lit(" "), F.coalesce(F.nullif(part(7), F.lit("")), F.col("_next"))).alias("amount_range"))


def sections(lines: DataFrame, keys: list[str], at: str, line: str, opens: str, closes: str) -> DataFrame:
    """Lines between an opening and a closing line, with the number of their section."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    start, stop = F.col(line).rlike(opens), F.col(line).rlike(closes)
    rows = lines.withColumn("section", F.count_if(start).over(w)).withColumn("_open", F.last(F.when(start, True).when(stop, False), ignorenulls=True).over(w))
    return rows.where(F.col("_open") & ~start).drop("_open")


def token_lines(tokens: DataFrame, keys: list[str], top: str, left: str, reach: int = 18) -> DataFrame:
    """Adds line: tokens (of a page: keys) that stand at most `reach` below the first token of their line. The fold runs over a page's distinct heights."""
    start = "cast(named_struct('at', null, 'out', array()) as struct<at: bigint, out: array<struct<t: bigint, line: bigint>>>)"

    def step(acc, x):
        at = F.when(acc["at"].isNull() | (x - acc["at"] > reach), x).otherwise(acc["at"])
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("t"), at.alias("line")))).alias("out"))

    heights = tokens.where(F.col(top).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(top).cast("long"))).alias("_tops"))
    lines = heights.select(*keys, F.explode(F.aggregate("_tops", F.expr(start), step)["out"]).alias("l")).select(*keys, F.col("l.t").alias("_t"), F.col("l.line").alias("line"))
    return tokens.withColumn("_t", F.col(top).cast("long")).join(lines, [*keys, "_t"]).drop("_t")


def nested_items(docs: DataFrame, json: str, name: str, *keys: str) -> DataFrame:
    """The objects in every list called `name`, however deep, as JSON; nothing inside such a list is looked into further.

    Payloads of any shape are walked level by level as VARIANT; a level is written before the next one is read.
    """
    spark = docs.sparkSession
    level = docs.where(F.col(json).isNotNull()).select(*keys, F.parse_json(json).alias("v"))
    names, found = ", ".join(keys), None
    while True:
        inner = spark.sql(f"SELECT {names}, e.key, e.value AS v, schema_of_variant(e.value) AS kind FROM {{level}}, LATERAL variant_explode(v) AS e", level=level)
        rows = staged(inner.where("kind like 'OBJECT%' or kind like 'ARRAY%'").select(*keys, "key", "kind", F.to_json("v").alias("text")))
        hit = (F.col("key") == name) & F.col("kind").startswith("ARRAY")
        lists = rows.where(hit).select(*keys, F.parse_json("text").alias("v"))
        items = spark.sql(f"SELECT {names}, to_json(e.value) AS item FROM {{lists}}, LATERAL variant_explode(v) AS e WHERE schema_of_variant(e.value) LIKE 'OBJECT%'", lists=lists)
        found = items if found is None else found.unionByName(items)
        rest = rows.where(~F.coalesce(hit, F.lit(False)))
        if rest.isEmpty():
            return found
        level = rest.select(*keys, F.parse_json("text").alias("v"))


def _plain(html: Column) -> Column:
    bare = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    signs = bare
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        signs = F.replace(signs, F.lit(mark), F.lit(sign))
    return F.trim(F.regexp_replace(F.when(html.contains("&"), signs).otherwise(bare), r"\s+", " "))


def table_rows(pages: DataFrame, html: str, wanted: dict[str, str], *keys: str) -> DataFrame:
    """Rows of the body of a page's first table of class `table`: the cells under the headings wanted (name -> heading), wherever these columns stand."""
    block = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?s)<table\b[^>]*class=["'][^"']*\btable\b[^>]*>(.*?)</table>""", 1)
    cells = lambda text, mark: F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)<{mark}\b[^>]*>(.*?)</{mark}>"), 1), _plain)
    tables = pages.select(*keys, block.alias("_b")).select(*keys, F.transform(cells(F.regexp_extract("_b", r"(?s)<thead\b[^>]*>(.*?)</thead>", 1), "th"), F.lower).alias("_heads"), F.regexp_extract("_b", r"(?s)<tbody\b[^>]*>(.*?)</tbody>", 1).alias("_body"))
    # cells are read inside the generator: a filter on them would be pushed below a projection and read them again
    found = F.transform(F.regexp_extract_all("_body", F.lit(r"(?s)<tr\b[^>]*>(.*?)</tr>"), 1), lambda tr: cells(tr, "td"))
    rows = tables.select(*keys, "_heads", F.posexplode(found).alias("place", "_cells"))
    rows = rows.where(F.size("_cells") >= F.size("_heads"))
    at = lambda heading: F.array_position("_heads", F.lit(heading.lower())).cast("int")
    return rows.select(*keys, "place", *(F.when(at(h) > 0, F.get("_cells", at(h) - 1)).alias(n) for n, h in wanted.items()))


def trade_table(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """Trades of an electronic report's table: date, ticker (N/A for none), asset, direction (exchange unless sale or purchase) and amount range; rows without a date are left out."""
    wanted = {"day": "transaction date", "symbol": "ticker", "issuer": "asset name", "kind": "type", "amount": "amount"}
    rows = table_rows(pages, html, wanted, *keys)
    kind = F.lower(F.coalesce("kind", F.lit("")))
    ticker = F.when(F.coalesce("symbol", F.lit("")).isin("", "--"), "N/A").otherwise(F.col("symbol"))
    direction = F.when(kind.contains("sale"), "sell").when(kind.contains("purchase"), "buy").otherwise("exchange")
    return rows.withColumn("transaction_date", read_date(F.col("day"))).where("transaction_date is not null").select(
        *keys, "place", "transaction_date", ticker.alias("ticker"), F.coalesce(F.nullif("issuer", F.lit("")), F.nullif("symbol", F.lit("")), ticker).alias("asset_name"), direction.alias("direction"), F.coalesce(F.nullif("amount", F.lit("")), F.lit("Unknown")).alias("amount_range"))


def best_parse(candidates: DataFrame, keys: list[str], rows: str, resolved: str, richness: str, payload: str) -> DataFrame:
    """The parse with most rows, then most resolved tickers, then the richest names."""
    return candidates.groupBy(*keys).agg(F.max_by(payload, F.struct(rows, resolved, richness, payload)).alias(payload))


def padded_cik(c: Column) -> Column:
    return F.lpad(F.regexp_replace(c, r"\D", ""), 10, "0")
