"""Readers as round trips: domain rows are written out in each format, read by the reader, and held against the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators.relations import dealt
from ledgerlark.plans.catalog import query
from ledgerlark.sources import readers as D
from ledgerlark.sources import zipped as Z
from ledgerlark.sources.workspace import shared_folder

c = F.col


def tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


@query("SC12_tab_separated", "orders", sql="SELECT o_orderkey, o_custkey, o_orderstatus AS filing_type, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderstatus = 'P'")
def sc12(orders):
    lines = orders.select(F.concat_ws("\t", "o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("line"))
    return D.tab_separated(lines, "line", "o_orderkey bigint, o_custkey bigint, filing_type string, filed date").where("filing_type = 'P'")


@query("SC13_J1_quarter_tables", "lineitem", "orders", "supplier", sql="""
SELECT l_orderkey, CAST(o_orderdate AS DATE) AS filed, s.name AS owner, CAST(l_quantity AS DECIMAL(18,2)) AS shares, CAST(l_extendedprice AS DECIMAL(18,2)) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT s_suppkey % 50 AS k, min(s_name) AS name FROM supplier GROUP BY 1) s ON s.k = l_suppkey % 50
WHERE l_extendedprice >= 1000 AND l_quantity > 0 AND l_returnflag = 'R'""")
def sc13(lineitem, orders, supplier):
    """Three tables of a quarter, written as zipped text and read back with the wanted columns alone, then filtered before they are joined."""
    spark, folder = lineitem.sparkSession, shared_folder(lineitem.sparkSession, "quarter")
    tables = {"NONDERIV_TRANS.tsv": lineitem.select(c("l_orderkey").alias("ACCESSION"), c("l_suppkey").alias("OWNER"), c("l_returnflag").alias("CODE"), c("l_quantity").alias("SHARES"), c("l_extendedprice").alias("VALUE"), F.lit("unread").alias("NOTE")),
              "SUBMISSION.tsv": orders.select(c("o_orderkey").alias("ACCESSION"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("FILING_DATE"), c("o_orderstatus").alias("STATUS")),
              "REPORTINGOWNER.tsv": supplier.select(c("s_suppkey").alias("OWNER"), c("s_name").alias("NAME"), c("s_nationkey").alias("NATION"))}
    for member, rows in tables.items():
        Z.write_zipped(rows, folder, member)
    spark.dataSource.register(Z.ZippedTables)
    read = lambda member, columns: spark.read.format("zipped_tsv").option("member", member).option("columns", columns).load(folder)
    tx = read("NONDERIV_TRANS.tsv", "ACCESSION,OWNER,CODE,SHARES,VALUE").where("CODE = 'R' and SHARES is not null and VALUE is not null").select(
        c("ACCESSION").cast("bigint").alias("l_orderkey"), (c("OWNER").cast("bigint") % 50).alias("k"), c("SHARES").cast("double").cast("decimal(18,2)").alias("shares"), c("VALUE").cast("double").cast("decimal(18,2)").alias("value")).where("value >= 1000 and shares > 0")
    owners = read("REPORTINGOWNER.tsv", "OWNER,NAME").groupBy((c("OWNER").cast("bigint") % 50).alias("k")).agg(F.min("NAME").alias("owner"))
    filed = read("SUBMISSION.tsv", "ACCESSION,FILING_DATE").select(c("ACCESSION").cast("bigint").alias("l_orderkey"), F.to_date("FILING_DATE", "dd-MMM-yyyy").alias("filed"))
    return tx.join(filed, "l_orderkey").join(owners, "k").select("l_orderkey", "filed", "owner", "shares", "value")


@query("SC14_holdings_xml", "holdings", sql="SELECT fund_name, report_period, ticker AS issuer, 'COM' AS title, CAST(value_held AS DECIMAL(38,2)) AS value, shares_held AS shares FROM holdings")
def sc14(holdings):
    line = F.concat(F.lit("<n1:infoTable>"), tag("n1:nameOfIssuer", c("ticker")), tag("n1:titleOfClass", F.lit("COM")), tag("n1:value", c("value_held").cast("string")), tag("n1:shares", c("shares_held").cast("string")), F.lit("</n1:infoTable>"))
    docs = holdings.groupBy("fund_name", "report_period").agg(F.concat(F.lit('HEADER\n<XML><n1:informationTable xmlns:n1="urn:x">\n'), F.array_join(F.collect_list(line), "\n"), F.lit("</n1:informationTable></XML>\ntrailer")).alias("text"))
    return D.information_table(docs, "text", "fund_name", "report_period")


@query("SC15_SC16_form4_xml", "insiders", sql="""
WITH r AS (SELECT *, CASE WHEN CAST(shares AS INT) % 5 = 0 THEN 'M' ELSE transaction_code END AS code, CASE WHEN CAST(shares AS INT) % 10 = 0 THEN '' WHEN transaction_code = 'P' THEN 'A' ELSE 'D' END AS acquired FROM insiders WHERE ticker IS NOT NULL),
d AS (SELECT filer_name, ticker, transaction_date, list({c: code, q: acquired, s: shares, a: amount} ORDER BY code, acquired, shares, amount) AS l FROM r GROUP BY 1, 2, 3), x AS (SELECT *, unnest(range(len(l))) AS i FROM d)
SELECT 'u/' || filer_name || '/' || ticker || '/' || transaction_date || '#' || i AS source_url, ticker, filer_name, CASE WHEN l[i + 1].c = 'P' OR l[i + 1].c = 'M' AND l[i + 1].q = 'A' THEN 'buy' ELSE 'sell' END AS direction, transaction_date, l[i + 1].s AS shares, l[i + 1].a AS value, CAST(l[i + 1].s * 2 AS DECIMAL(18,2)) AS following
FROM x WHERE NOT (l[i + 1].c = 'M' AND l[i + 1].q = '')""")
def sc15(insiders):
    """Codes other than purchase and sale go by whether shares were acquired or disposed of."""
    text = lambda x: x.cast("string")
    n = c("shares").cast("int")
    keys = ["transaction_date", "ticker", "filer_name"]  # in an order that tells rows apart soon: groups are sorted by them
    coded = insiders.where("ticker is not null").select(*keys, "shares", "amount", F.when(n % 5 == 0, "M").otherwise(c("transaction_code")).alias("code"), F.when(n % 10 == 0, "").when(c("transaction_code") == "P", "A").otherwise("D").alias("acquired"))
    # dealt by the number of all trades, which needs fewer columns to be counted than the number of those with a ticker
    rows = dealt(coded, *keys, like=insiders).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("code", "acquired", "shares", "amount"))).alias("l"))
    lines = F.transform("l", lambda t: F.concat(F.lit("<transaction>"), tag("code", t["code"]), tag("acquired", t["acquired"]), tag("day", text(c("transaction_date"))), tag("shares", text(t["shares"])), tag("value", text(t["amount"])),
                                                tag("following", text((t["shares"] * 2).cast("decimal(18,2)"))), F.lit("</transaction>")))
    doc = F.concat(F.lit("SEC HEADER <a>\n<ownershipDocument>"), tag("issuerTicker", F.lower("ticker")), tag("owner", c("filer_name")), tag("transactions", F.array_join(lines, "")), F.lit("</ownershipDocument> end"))
    return D.form4_transactions(rows.select(F.concat_ws("/", F.lit("u"), "filer_name", "ticker", text(c("transaction_date"))).alias("url"), doc.alias("text")), "text", "url")


@query("X19_token_lines", "scan_tokens", sql="""
WITH RECURSIVE t AS (SELECT DISTINCT doc, page, top FROM scan_tokens), n AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY top) AS i FROM t),
r AS (SELECT doc, page, i, top, top AS line FROM n WHERE i = 1 UNION ALL SELECT n.doc, n.page, n.i, n.top, CASE WHEN n.top - r.line > 18 THEN n.top ELSE r.line END FROM r JOIN n ON n.doc = r.doc AND n.page = r.page AND n.i = r.i + 1)
SELECT doc, page, line, count(*) AS n, string_agg(text, ' ' ORDER BY edge, text) AS text FROM scan_tokens JOIN r USING (doc, page, top) GROUP BY 1, 2, 3""")
def x19(scan_tokens):
    lines = D.token_lines(scan_tokens, ["doc", "page"], "top", "edge")
    inside = F.array_sort(F.collect_list(F.struct("edge", "text")))
    return lines.groupBy("doc", "page", "line").agg(F.count("*").alias("n"), F.array_join(F.transform(inside, lambda x: x["text"]), " ").alias("text"))


@query("X26_coverage_gaps", "gap_reports", sql="""
SELECT o_orderkey, i.value ->> 'doc' AS doc FROM gap_reports, json_tree(gap_reports.doc) j, json_each(j.value) i WHERE j.key = 'missing_or_partial_filings' AND j.type = 'ARRAY' AND i.type = 'OBJECT' AND NOT contains(j.path, 'missing_or_partial_filings[')""")
def x26(gap_reports):
    items = D.nested_items(gap_reports, "doc", "missing_or_partial_filings", "o_orderkey")
    return items.select("o_orderkey", F.get_json_object("item", "$.doc").alias("doc"))


@query("SC20_trade_tables", "trades", sql="""
SELECT member_id, published_date, transaction_date, coalesce(ticker, 'N/A') AS ticker, asset_name, CASE WHEN direction = 'buy' THEN 'buy' WHEN amount_floor > 15001 THEN 'sell' ELSE 'exchange' END AS direction, amount_range, count(*) AS n FROM trades GROUP BY ALL""")
def sc20_tables(trades):
    """One report a member and day as a web page, its columns in one of two orders, read back by their headings."""
    cell = lambda x: F.concat(F.lit("<td class='c'> "), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n</td>"))
    kind = F.when(c("direction") == "buy", "Purchase").when(c("amount_floor") > 15_001, "Sale (Full)").otherwise("Exchange")
    swapped = F.crc32(F.concat("member_id", c("published_date").cast("string"))) % 2 == 0
    parts = {"Transaction Date": F.date_format("transaction_date", "MM/dd/yyyy"), "Owner": F.lit("Self"), "Ticker": F.coalesce("ticker", F.lit("--")), "Asset Name": c("asset_name"), "Type": kind, "Amount": c("amount_range")}
    orders = [list(parts), ["Amount", "Type", "Ticker", "Owner", "Asset Name", "Transaction Date"]]
    row = lambda names: F.concat(F.lit("<tr>"), *(cell(parts[n]) for n in names), F.lit("</tr>"))
    head = lambda names: "<table class='x table'><thead><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr></thead><tbody><tr><td>a note</td></tr>"
    lines = trades.select("member_id", "published_date", swapped.alias("s"), F.when(swapped, row(orders[1])).otherwise(row(orders[0])).alias("tr"))
    docs = lines.groupBy("member_id", "published_date", "s").agg(F.array_join(F.collect_list("tr"), "\n").alias("body"))
    docs = docs.select("member_id", "published_date", F.concat(F.lit("<html><table class='other'><tr><td>x</td></tr></table>"), F.when(c("s"), head(orders[1])).otherwise(head(orders[0])), "body", F.lit("</tbody></table></html>")).alias("html"))
    rows = D.trade_table(docs, "html", "member_id", "published_date")
    return rows.groupBy("member_id", "published_date", "transaction_date", "ticker", "asset_name", "direction", "amount_range").agg(F.count("*").alias("n"))


@query("SC17_X13_feed", "orders", sql="""
SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-01-000001' AS accession, CAST(max(o_orderdate) AS DATE) AS filed, min('4 - ' || o_orderpriority) AS title FROM orders WHERE o_orderdate >= DATE '2001-01-01' GROUP BY 1""")
def sc17(orders):
    acc = F.concat(F.lpad(c("o_custkey").cast("string"), 10, "0"), F.lit("-01-000001"))
    entry = F.concat(F.lit("<entry>"), tag("title", F.concat(F.lit("4 - "), "o_orderpriority")), tag("id", F.concat(F.lit("urn:tag:x,2008:accession-number="), acc)), tag("updated", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")), F.lit("</entry>"))
    docs = orders.groupBy("o_orderdate").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("xml"))
    return D.feed_entries(docs, "xml", F.lit("2001-01-01").cast("date"))


@query("SC18_parallel_arrays", "orders", sql="SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS accession, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def sc18(orders):
    l = F.collect_list(F.struct(c("o_orderpriority").alias("form"), c("o_orderkey").cast("string").alias("accession"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed")))
    docs = orders.groupBy("o_custkey").agg(l.alias("l")).select("o_custkey", F.to_json(F.struct(c("l.form").alias("form"), c("l.accession").alias("accession"), c("l.filed").alias("filed"))).alias("json"))
    return D.submissions(docs, "json", ("1-URGENT", "2-HIGH"), "o_custkey")


@query("SC19_fields_and_rows", "companies", sql="SELECT ticker, name, sector FROM companies")
def sc19(companies):
    docs = companies.groupBy("industry").agg(F.collect_list(F.array("name", "sector", "ticker")).alias("data")).select(F.to_json(F.struct(F.array(F.lit("name"), F.lit("sector"), F.lit("ticker")).alias("fields"), "data")).alias("json"))
    return D.fields_and_rows(docs, "json", ["ticker", "name", "sector"])


@query("SC20_SC21_page_links", "pages", sql="""
WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS l FROM pages), x AS (SELECT page_id, l, unnest(range(len(l))) AS i FROM l)
SELECT page_id, i AS place, regexp_extract(l[i + 1], 'href="([^"]*)"', 1) AS href, regexp_extract(l[i + 1], '>([^<]*)</a>', 1) AS label FROM x""")
def sc20(pages):
    return D.links_of(pages, "html", "page_id")


@query("SC21_relative_days", "orders", sql="""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) - 1 WHEN 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def sc21(orders):
    d = c("o_orderdate").cast("date")
    text = F.when(c("o_orderkey") % 4 == 0, "14:05 Today").when(c("o_orderkey") % 4 == 1, " Yesterday ").when(c("o_orderkey") % 4 == 2, F.date_format(d, "d MMM yyyy")).otherwise("soon")
    return orders.select("o_orderkey", D.relative_day(text, d).alias("day"))


@query("SC24_trade_lines", "trades", sql="""
SELECT regexp_replace(doc_id, '-[0-9]+$', '') AS filing, asset_name AS asset, CASE WHEN asset_type IN ('ST', 'ETF', 'Stock') THEN asset_type END AS asset_type, CASE direction WHEN 'buy' THEN 'P' ELSE 'S' END AS code, transaction_date, published_date AS filed, amount_range, count(*) AS n FROM trades WHERE amount >= 1001 GROUP BY ALL""")
def sc24(trades):
    day = lambda x: F.date_format(x, "MM/dd/yyyy")
    kind = F.when(c("asset_type").isin("ST", "ETF", "Stock"), F.concat(F.lit(" ["), "asset_type", F.lit("]"))).otherwise("")
    low, high = F.split_part("amount_range", F.lit(" - "), F.lit(1)), F.split_part("amount_range", F.lit(" - "), F.lit(2))
    line = F.concat("asset_name", kind, F.lit("  "), F.when(c("direction") == "buy", "P").otherwise("S"), F.lit(" "), day("transaction_date"), F.lit(" "), day("published_date"), F.lit(" "), low, F.lit(" -\nFILING STATUS: New\n"), high)
    rows = dealt(trades.where("amount >= 1001").select(F.regexp_replace("doc_id", r"-\d+$", "").alias("filing"), line.alias("line")), "filing")
    docs = rows.groupBy("filing").agg(F.concat(F.lit("Header\n"), F.array_join(F.collect_list("line"), "\n")).alias("text"))
    return D.trade_lines(docs, "text", "filing").groupBy("filing", "asset", "asset_type", "code", "transaction_date", "filed", "amount_range").agg(F.count("*").alias("n"))


@query("SC25_X19_sections", "lineitem", sql="""
WITH l AS (SELECT l_orderkey, l_partkey, l_linestatus, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS line_no FROM lineitem),
s AS (SELECT *, count(*) FILTER (WHERE l_returnflag = 'A') OVER w AS section, max(CASE WHEN l_returnflag = 'A' THEN line_no END) OVER w AS o, max(CASE WHEN l_returnflag = 'R' THEN line_no END) OVER w AS c FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, line_no, section, l_partkey FROM s WHERE o IS NOT NULL AND o > coalesce(c, 0) AND l_returnflag <> 'A'""")
def sc25(lineitem):
    from pyspark.sql import Window
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")).cast("long")
    lines = lineitem.select("l_orderkey", "l_partkey", at.alias("line_no"), c("l_returnflag").alias("line"))
    return D.sections(lines, ["l_orderkey"], "line_no", "line", "^A$", "^R$").select("l_orderkey", "line_no", "section", "l_partkey")


@query("SC26_best_parse", "lineitem", sql="""
WITH p AS (SELECT l_orderkey, l_returnflag || l_linestatus AS parser, count(*) AS n, count(*) FILTER (WHERE l_partkey % 200 NOT IN (7, 8, 9)) AS resolved, CAST(sum(l_linenumber) AS BIGINT) AS richness FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, parser FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, resolved DESC, richness DESC, parser DESC) = 1""")
def sc26(lineitem):
    p = lineitem.groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("parser")).agg(F.count("*").alias("n"), F.count_if(~(c("l_partkey") % 200).isin(7, 8, 9)).alias("resolved"), F.sum("l_linenumber").alias("richness"))
    return D.best_parse(p, ["l_orderkey"], "n", "resolved", "richness", "parser")


@query("SC27_provider_fallback", "prices", sql="""
WITH a AS (SELECT * FROM prices WHERE ascii(ticker[3]) % 2 = 0), b AS (SELECT ticker, price_date, CAST(price + 1 AS DECIMAL(19,2)) AS price FROM prices) SELECT ticker, price_date, coalesce(a.price, b.price) AS price, CASE WHEN a.price IS NULL THEN 'second' ELSE 'first' END AS provider FROM b LEFT JOIN a USING (ticker, price_date)""")
def sc27(prices):
    first = prices.where(F.ascii(F.substring("ticker", 3, 1)) % 2 == 0).select("ticker", "price_date", c("price").alias("p"))
    second = prices.select("ticker", "price_date", (c("price") + 1).cast("decimal(19,2)").alias("q"))
    return second.join(first, ["ticker", "price_date"], "left").select("ticker", "price_date", F.coalesce("p", "q").cast("decimal(19,2)").alias("price"), F.when(c("p").isNull(), "second").otherwise("first").alias("provider"))


@query("SC30_fund_config", "supplier", sql="SELECT DISTINCT lpad(regexp_replace('CIK ' || s_suppkey, '[^0-9]', '', 'g'), 10, '0') AS cik, s_name AS name FROM supplier")
def sc30(supplier):
    return supplier.select(D.padded_cik(F.concat(F.lit("CIK "), "s_suppkey")).alias("cik"), c("s_name").alias("name")).dropDuplicates(["cik"])


@query("SC31_roles_xml", "nation", "region", sql="SELECT r_name AS committee, n_name AS member FROM nation JOIN region ON n_regionkey = r_regionkey")
def sc31(nation, region):
    docs = nation.join(region, c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.concat(F.lit("<committee>"), F.first(tag("name", c("r_name"))), F.array_join(F.collect_list(tag("member", c("n_name"))), ""), F.lit("</committee>")).alias("xml"))
    d = docs.select(F.from_xml("xml", "name STRING, member ARRAY<STRING>").alias("d"))
    return d.select(c("d.name").alias("committee"), F.explode("d.member").alias("member"))
