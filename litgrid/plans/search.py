"""Search: pages of results, filters, notices, spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions.records import once
from litgrid.functions.text import clip, display_text, utf16_length
from litgrid.operators import paging
from litgrid.operators import search as S
from litgrid.plans.texts import display_sql
from litgrid.sources.tables import spread, table

#: Orders stand for records: the priority for types, the status for the language, the date for the date.
RECORDS = S.Fields(id="o_orderkey", date="o_orderdate", types="types", language="o_orderstatus")
PARAMS = S.Search(min_date="1994", max_date="1996/12", types=["1-URGENT", "2-HIGH"], language="F", offset=40, limit=20)
WHERE = "o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'"
WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def _matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    # plain comparisons reach the Parquet reader, which an array of one type would not
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(*PARAMS.types))
    return S.search(orders.withColumn("types", F.array("o_orderpriority")), PARAMS, RECORDS)


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paging.page(_matching(spark, sf_dir), [F.desc("o_totalprice"), "o_orderkey"], PARAMS.offset, PARAMS.limit)
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir).agg(F.count("*").alias("total"))


def search_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of a page of each customer's orders; the customer's number says where it begins and what was asked."""
    found = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left")
    rows = found.groupBy("c_custkey").agg(F.count("o_orderkey").alias("total"))
    start = F.col("c_custkey") % 25
    rows = rows.withColumns({"start": start, "returned": F.greatest(F.lit(0), F.least(F.lit(5), F.col("total") - start)), "filtered": F.col("c_custkey") % 2 == 0, "one_sided": F.col("c_custkey") % 7 == 0})
    return rows.select("c_custkey", "total", "start", S.notice(F.col("total"), F.col("returned"), F.col("start"), F.col("filtered"), F.col("one_sided")).alias("notice"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))


def filter_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).where(S.all_of(F.col("tokens"), ["the", "and", "that"])).select("doc_id")


def filter_any_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).where(S.any_of(F.col("tokens"), ["les", "der", "que"])).select("doc_id")


def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(table(spark, sf_dir, "documents"), S.Search(sources=["src1", "src2", "src3"]), S.Fields(id="doc_id")).select("doc_id", "source")


def free_fulltext_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").where(S.has_text(F.col("text")))
    return docs.join(free, "doc_id", "left_semi").select("doc_id", "lang")


def summary_page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paging.page(_matching(spark, sf_dir), [F.desc("o_totalprice"), "o_orderkey"], 0, 50)
    summaries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    # the page is at most 50 rows, so it is the side to broadcast, however many summaries there are
    joined = summaries.join(F.broadcast(found), "o_custkey", "right")
    return joined.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display text of a document, worked out once, cut to 400 units."""
    docs = once(spread(table(spark, sf_dir, "documents")), "shown", display_text(F.col("text")))
    return docs.select("doc_id", clip(F.col("shown"), 400).alias("snippet"), (utf16_length(F.col("shown")) > 400).alias("truncated"))


MISSPELT = ["amber gear", "steel whel", "cooper rod", "xyzzy"]


def spell_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}')" for w in MISSPELT) + " AS t(word)")
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("entry"))
    return S.suggestions(words, names, 4)


def corpus_sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = {
        "newest": [F.desc("o_orderdate"), "o_orderkey"],
        "cited": [F.desc("o_totalprice"), "o_orderkey"],
        "author": ["o_custkey", "o_orderkey"],
        "year": [F.year("o_orderdate"), "o_orderkey"],
    }
    return paging.sort_modes(table(spark, sf_dir, "orders"), modes, 5, ["o_orderkey"])


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.keyset_page(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", (250000.0, 0), 25).select("o_orderkey", "o_totalprice")


def vocab_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pages = []
    for offset in (0, 5):
        p = paging.pinned_page(part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], F.col("p_partkey") == 7, offset, 5)
        pages.append(p.select(F.lit(offset).alias("start"), "pos", "p_partkey", "next_offset"))
    return pages[0].unionByName(pages[1])


def exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return paging.page(part.withColumn("miss", paging.exact_first(F.col("p_brand"), "BRAND#23")), ["miss", "p_partkey"], 0, 30).select("p_partkey", "p_brand", "miss")


VOCAB_SQL = """
WITH r AS (SELECT p_partkey, p_name, p_partkey = 7 AS pinned, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS rk FROM part),
o AS (SELECT unnest([0, 5]) AS start),
w AS (SELECT start, p_partkey, pinned, rk, sum(CAST(NOT pinned AS INT)) OVER (PARTITION BY start ORDER BY rk) AS plain
      FROM o JOIN r ON rk >= start AND rk < start + 5),
u AS (SELECT w.* FROM w WHERE plain <= 5 - CASE WHEN start = 0 THEN (SELECT count(*) FROM r WHERE pinned) ELSE 0 END),
n AS (SELECT start, count(*) + start AS next_offset FROM u GROUP BY start),
s AS (SELECT start, p_partkey, rk FROM u WHERE NOT pinned UNION ALL SELECT 0, p_partkey, -1 FROM r WHERE pinned)
SELECT start, CAST(row_number() OVER (PARTITION BY start ORDER BY rk) AS INT) AS pos, p_partkey, CAST(next_offset AS INT) AS next_offset
FROM s JOIN n USING (start)
"""
QUERIES = {f.__name__: f for f in (search_page, search_total, search_notice, filter_all_terms, filter_any_type, corpus_filter, free_fulltext_semi, summary_page_join, spell_check, corpus_sort_modes, keyset_page, vocab_page, exact_first)} | {"snippet": snippets}
ORACLES = {
    "search_page": f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {WHERE} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "search_total": f"SELECT count(*) AS total FROM orders WHERE {WHERE}",
    "search_notice": """
        WITH o AS (SELECT c_custkey, count(o_orderkey) AS total, c_custkey % 25 AS start, c_custkey % 2 = 0 AS filtered, c_custkey % 7 = 0 AS one_sided FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
        r AS (SELECT *, greatest(0, least(5, total - start)) AS returned FROM o)
        SELECT c_custkey, total, start, concat_ws(' ',
            CASE WHEN one_sided THEN 'Date range ignored: both bounds are needed.' END,
            CASE WHEN total = 0 AND filtered THEN 'No results: try fewer filters.' END,
            CASE WHEN total = 0 AND NOT filtered THEN 'No results: try other words.' END,
            CASE WHEN total > 0 AND start >= total THEN 'Offset ' || start || ' is beyond the ' || total || ' results.' END,
            CASE WHEN returned > 0 AND start + returned < total THEN 'More results from offset ' || (start + returned) || '.' END) AS notice
        FROM r""",
    "filter_all_terms": f"SELECT doc_id FROM documents WHERE list_has_all({WORDS}, ['the', 'and', 'that'])",
    "filter_any_type": f"SELECT doc_id FROM documents WHERE list_has_any({WORDS}, ['les', 'der', 'que'])",
    "corpus_filter": "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3')",
    "free_fulltext_semi": "SELECT doc_id, lang FROM documents d WHERE text IS NOT NULL AND trim(text) <> '' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)",
    "summary_page_join": f"SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM (SELECT * FROM orders WHERE {WHERE} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "snippet": f"""
        WITH d AS (SELECT doc_id, {display_sql('text')} AS s FROM documents),
        n AS (SELECT doc_id, s, length(s) + length(regexp_replace(s, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units,
                     (SELECT max(i) FROM range(0, 401) r(i) WHERE i + length(regexp_replace(left(s, i), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) <= 400) AS fits FROM d)
        SELECT doc_id, CASE WHEN units > 400 THEN left(s, fits) || '\u2026' ELSE s END AS snippet, units > 400 AS truncated FROM n""",
    "spell_check": "WITH w AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for w in MISSPELT) + ") t(word)), n AS (SELECT DISTINCT lower(p_name) AS entry FROM part), c AS (SELECT word, entry, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, entry), entry) AS rn FROM w, n WHERE levenshtein(word, entry) <= 4) SELECT w.word, coalesce(entry, w.word) AS corrected FROM w LEFT JOIN c ON c.word = w.word AND rn = 1",
    "corpus_sort_modes": """
        SELECT mode, CAST(pos AS INT) AS pos, o_orderkey FROM (
            SELECT 'newest' AS mode, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos, o_orderkey FROM orders
            UNION ALL SELECT 'cited', row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey), o_orderkey FROM orders
            UNION ALL SELECT 'author', row_number() OVER (ORDER BY o_custkey, o_orderkey), o_orderkey FROM orders
            UNION ALL SELECT 'year', row_number() OVER (ORDER BY year(o_orderdate), o_orderkey), o_orderkey FROM orders) WHERE pos <= 5""",
    "keyset_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 250000.0 OR (o_totalprice = 250000.0 AND o_orderkey > 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "vocab_page": VOCAB_SQL,
    "exact_first": "SELECT p_partkey, p_brand, CASE WHEN lower(p_brand) = lower('BRAND#23') THEN 0 ELSE 1 END AS miss FROM part ORDER BY miss, p_partkey LIMIT 30",
}
