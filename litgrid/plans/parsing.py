"""Round trips: records rendered from the shared tables as XML or JSON must parse to what they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import jats, records
from litgrid.functions.text import nested, sanitise_error
from litgrid.operators.catalog import error_contract
from litgrid.sources.tables import spread, table


def _xml(c: Column) -> Column:
    """Text with XML's special characters escaped."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def _tagged(tag: str, c: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{attributes}>"), c, F.lit(f"</{tag}>"))


def record_xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", F.regexp_replace("text", r"\s+", " ").alias("whole"))
    article = F.concat(
        _tagged("ArticleTitle", _xml(F.trim("whole"))),
        _tagged("Journal", F.concat(_tagged("ISSN", F.lit("1234-5678"), ' IssnType="Print"'), _tagged("Title", F.col("source")), F.lit("<JournalIssue><Volume>0"), (F.col("doc_id") % 7).cast("string"), F.lit("</Volume><PubDate><MedlineDate>Spring 19"), F.lpad((F.col("doc_id") % 90 + 10).cast("string"), 2, "0"), F.lit("</MedlineDate></PubDate></JournalIssue>"))),
        F.lit('<ELocationID EIdType="doi" ValidYN="N">10.0/old</ELocationID><ELocationID EIdType="doi" ValidYN="Y">10.1/'),
        F.col("doc_id").cast("string"),
        F.lit("</ELocationID><AuthorList><Author><LastName>"),
        F.col("lang"),
        F.lit("</LastName><Initials>A</Initials></Author></AuthorList>"),
    )
    xml = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), _tagged("PMID", F.col("doc_id").cast("string"), ' Version="1"'), _tagged("Article", article), F.lit('<KeywordList><Keyword MajorTopicYN="N">'), F.col("lang"), F.lit('</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pmc">PMC'), F.col("doc_id").cast("string"), F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"))
    out = records.parse_records(docs.select("doc_id", xml.alias("xml")), "xml")
    return out.select("doc_id", "pmid", "title", "journal", "volume", "year", "doi", "pmc_id", F.get("authors", F.lit(0))["last_name"].alias("author"), F.array_join("keywords", ",").alias("keywords"), "issn", "parse_failed")


def jats_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda x: F.concat(F.lit("<sec><title>S</title><p>"), _xml(x), F.lit("</p></sec>"))
    body = F.array_join(F.transform(F.split("text", "\n"), line), "")
    xml = F.concat(F.lit('<!DOCTYPE article><article article-type="research"><front><article-meta><article-id pub-id-type="pmc">'), F.col("doc_id").cast("string"), F.lit("</article-id></article-meta></front><body>"), body, F.lit("</body></article>"))
    parsed = jats.parse_articles(spread(table(spark, sf_dir, "documents")).select("doc_id", xml.alias("xml")), "doc_id", "xml")
    return parsed.select("doc_id", "pmcid", "article_type", F.size("sections").alias("n_sections"), F.md5(F.array_join(F.transform("sections", lambda s: s["text"]), "|").cast("binary")).alias("digest"))


def summary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    day = F.date_format("o_orderdate", "yyyy MMM d")
    people = F.when(F.col("o_orderkey") % 2 == 0, '[{"name":"A B"},{"name":"C D"}]').otherwise('"A B; C D"')
    json = F.concat(F.lit('{"uid":"'), F.col("o_orderkey").cast("string"), F.lit('","title":"T &amp; '), F.col("o_orderpriority"), F.lit('","source":"J","pubdate":"'), day, F.lit('","authors":'), people, F.lit(',"articleids":[{"idtype":"doi","value":"10.1/'), F.col("o_custkey").cast("string"), F.lit('"}]}'))
    new = records.parse_summary_json(o.where("o_orderkey % 3 > 0").select("o_orderkey", json.alias("raw")), "raw").select("o_orderkey", "uid", "title", "pub_date", "doi", "authors_display")
    item = lambda name, c: F.concat(F.lit(f'<Item Name="{name}" Type="String">'), c, F.lit("</Item>"))
    xml = F.concat(F.lit("<DocSum>"), _tagged("Id", F.col("o_orderkey").cast("string")), item("Title", F.concat(F.lit("T &amp;amp; "), F.col("o_orderpriority"))), item("PubDate", day), item("DOI", F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string"))), F.lit('<Item Name="Broken" Type="ERROR">x</Item></DocSum>'))
    old = records.parse_summary_items(o.where("o_orderkey % 3 = 0").select("o_orderkey", xml.alias("raw")), "raw").select("o_orderkey", "uid", "title", "pub_date", "doi", F.lit(None).cast("string").alias("authors_display"))
    return new.unionByName(old)


def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    return events.select("event_id", F.array_join(keys, ",").alias("props_keys"), nested(F.col("props"), "k").alias("k"))


def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as reasons of the error contract: code, whether a retry is worth it, a hint, and a message fit to show."""
    reason = F.get(F.array(*map(F.lit, REASONS)), F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int") - 1)
    rows = table(spark, sf_dir, "events").withColumn("reason", F.when(F.col("event_type").isin(*TYPES), reason))
    message = F.concat(F.lit("failed at https://x.org/"), F.col("event_id").cast("string"), F.lit(" for "), F.col("event_type"))
    # eleven reasons
    found = rows.join(F.broadcast(error_contract(spark)), "reason", "left")
    return found.select("event_id", F.coalesce("code", F.lit("Unknown")).alias("code"), F.coalesce("retryable", F.lit(False)).alias("retryable"), "hint", sanitise_error(message).alias("message"))


TYPES, REASONS = ("click", "view", "purchase"), ("records_unreachable", "records_deadline_exceeded", "records_not_found")
WHOLE = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
QUERIES = {f.__name__: f for f in (record_xml_roundtrip, jats_roundtrip, summary_roundtrip, json_decode, error_classify)}
ORACLES = {
    "record_xml_roundtrip": f"""
        SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, {WHOLE} AS title, source AS journal, '0' || (doc_id % 7) AS volume, '19' || lpad(CAST(doc_id % 90 + 10 AS VARCHAR), 2, '0') AS year,
            '10.1/' || doc_id AS doi, 'PMC' || doc_id AS pmc_id, lang AS author, lang AS keywords, '1234-5678' AS issn, false AS parse_failed FROM documents""",
    "jats_roundtrip": r"""
        SELECT doc_id, 'PMC' || doc_id AS pmcid, 'research' AS article_type, CAST(len(l) AS INT) AS n_sections, md5(array_to_string(l, '|')) AS digest
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)""",
    "summary_roundtrip": """
        SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS uid, 'T & ' || o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS pub_date, '10.1/' || o_custkey AS doi,
            CASE WHEN o_orderkey % 3 > 0 THEN 'A B, C D' END AS authors_display FROM orders""",
    "json_decode": "SELECT event_id, array_to_string(json_keys(props), ',') AS props_keys, json_extract_string(props, '$.k') AS k FROM events",
    "error_classify": """
        SELECT event_id, coalesce(code, 'Unknown') AS code, coalesce(code IN ('ServiceUnavailable', 'Timeout'), false) AS retryable, hint, 'failed at [url] for ' || event_type AS message
        FROM events LEFT JOIN (VALUES ('click', 'ServiceUnavailable', 'Try again later.'), ('view', 'Timeout', 'Ask for less at once.'), ('purchase', 'NotFound', 'Check the id or search for it.')) t(event_type, code, hint) USING (event_type)""",
}
