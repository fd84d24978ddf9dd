"""Citations in five styles. Orders stand for articles, the suppliers of their lines for authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import cite as C
from litgrid.sources.tables import table


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("people"))
    person = lambda k: F.struct(F.concat(F.lit("Sup"), k.cast("string")).alias("last_name"), F.concat(F.lit("Ann-"), (k % 7).cast("string"), F.lit(" B")).alias("first_name"), F.when(k % 2 == 0, "CD").alias("initials"), F.when(k % 11 == 0, F.concat(F.lit("Group "), k.cast("string"))).alias("collective_name"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    # citing costs far more than the join, whose few small partitions would be put together
    orders = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    key = F.col("o_orderkey")
    some = lambda n, c: F.when(key % n != 0, c)
    return orders.select(
        key.cast("string").alias("pmid"),
        F.concat(F.lit("On 5% of "), F.col("o_orderpriority"), F.when(key % 2 == 0, ".").otherwise("")).alias("title"),
        some(3, F.concat(F.lit("Some  "), F.col("o_orderstatus"))).alias("abstract_text"),
        F.transform("people", person).alias("authors"),
        some(9, F.lit("Journal of Orders & Lines")).alias("journal"),
        some(4, F.lit("J Ord.")).alias("iso_abbreviation"),
        some(5, (key % 40).cast("string")).alias("volume"),
        some(2, (key % 12).cast("string")).alias("issue"),
        some(7, F.concat((key + 100).cast("string"), F.when(key % 3 == 0, "-9").otherwise(""))).alias("pages"),
        F.lit(None).cast("string").alias("issn"),
        F.lit("1234-5678").alias("e_issn"),
        some(10, F.year("o_orderdate").cast("string")).alias("year"),
        F.array().cast("array<struct<year:string,month:string,day:string>>").alias("article_dates"),
        some(6, F.concat(F.lit("10.1/"), key.cast("string"))).alias("doi"),
        some(8, F.concat(F.lit("PMC"), key.cast("string"))).alias("pmc_id"),
        F.when(key % 5 == 0, F.array(F.lit("Review"), F.lit("Preprint"))).alias("publication_types"),
        F.array(F.lit("orders"), F.lit("lines")).alias("keywords"),
        F.when(key % 2 == 0, F.array(F.lit("lines"), F.lit("a_b"))).alias("mesh_terms"),
    )


def _style(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.cite(articles(spark, sf_dir), name).select("pmid", "citation")

    query.__name__ = f"cite_{name}"
    return query


def cite_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cite(articles(spark, sf_dir), *C.STYLES).groupBy("style").agg(F.count("*").alias("n"), F.sum(F.length("citation")).cast("long").alias("chars"))


BASE = """
p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
a AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS pmid, 'On 5% of ' || o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN '.' ELSE '' END AS dot, o_orderstatus,
    CASE WHEN o_orderkey % 9 <> 0 THEN 'Journal of Orders & Lines' END AS journal, CASE WHEN o_orderkey % 4 <> 0 THEN 'J Ord.' END AS iso,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 40 AS VARCHAR) END AS volume, CASE WHEN o_orderkey % 2 <> 0 THEN CAST(o_orderkey % 12 AS VARCHAR) END AS issue,
    CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey + 100) || CASE WHEN o_orderkey % 3 = 0 THEN '-9' ELSE '' END END AS pages,
    CASE WHEN o_orderkey % 10 <> 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS year, CASE WHEN o_orderkey % 6 <> 0 THEN '10.1/' || o_orderkey END AS doi,
    CASE WHEN o_orderkey % 8 <> 0 THEN 'PMC' || o_orderkey END AS pmc FROM orders),
n AS (SELECT l_orderkey AS k, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n,
    CASE WHEN l_suppkey % 11 = 0 THEN 'Group ' || l_suppkey END AS g, 'Sup' || l_suppkey AS last, 'Ann-' || (l_suppkey % 7) || ' B' AS first,
    CASE WHEN l_suppkey % 2 = 0 THEN 'CD' ELSE 'AB' END AS ini FROM p)"""
APA = f"""{BASE},
l AS (SELECT k, max(n) AS n, list(coalesce(g, last || ', ' || left(ini, 1) || '. ' || right(ini, 1) || '.') ORDER BY i) AS x FROM n GROUP BY k),
w AS (SELECT k, CASE WHEN n = 1 THEN x[1] WHEN n <= 20 THEN array_to_string(x[1:n - 1], ', ') || ', & ' || x[n] ELSE array_to_string(x[1:19], ', ') || ', ... ' || x[n] END AS who FROM l),
c AS (SELECT a.pmid, concat_ws(' ', CASE WHEN who LIKE '%.' THEN who ELSE who || '.' END, '(' || coalesce(year, 'n.d.') || ').', title || '.',
    '*' || journal || '*' || coalesce(', *' || volume || '*' || coalesce('(' || issue || ')', ''), '') || coalesce(', ' || pages, '') || '.', 'https://doi.org/' || doi) AS citation FROM a LEFT JOIN w USING (k))"""
MLA = f"""{BASE},
l AS (SELECT k, max(n) AS n, list(coalesce(g, last || ', ' || first) ORDER BY i)[1] AS one, list(coalesce(g, first || ' ' || last) ORDER BY i)[2] AS two FROM n GROUP BY k),
w AS (SELECT k, CASE WHEN n = 1 THEN one WHEN n = 2 THEN one || ', and ' || two ELSE one || ', et al.' END AS who FROM l),
c AS (SELECT a.pmid, concat_ws(' ', CASE WHEN who LIKE '%.' THEN who ELSE who || '.' END, '"' || title || '."',
    CASE WHEN journal IS NOT NULL THEN concat_ws(', ', '*' || journal || '*', 'vol. ' || volume, 'no. ' || issue, year, CASE WHEN contains(pages, '-') THEN 'pp. ' ELSE 'p. ' END || pages) || '.' END, 'https://doi.org/' || doi || '.') AS citation FROM a LEFT JOIN w USING (k))"""
BIBTEX = f"""{BASE},
w AS (SELECT k, string_agg(CASE WHEN g IS NOT NULL THEN '{{' || g || '}}' ELSE '{{' || last || '}}, ' || first END, ' and ' ORDER BY i) AS who FROM n GROUP BY k),
f AS (SELECT a.*, who, CASE WHEN k % 5 = 0 THEN 'misc' ELSE 'article' END AS kind, '{{orders}}, {{lines}}' || CASE WHEN k % 2 = 0 THEN ', {{a\\_b}}' ELSE '' END AS words FROM a LEFT JOIN w USING (k)),
c AS (SELECT pmid, '@' || kind || '{{pmid' || pmid || ',' || chr(10) || concat_ws(',' || chr(10), '  author   = {{' || who || '}}', '  title    = {{{{' || replace(title, '%', '\\%') || '}}}}',
    '  journal  = {{' || replace(journal, '&', '\\&') || '}}', '  year     = {{' || year || '}}', '  volume   = {{' || volume || '}}', '  number   = {{' || issue || '}}', '  pages    = {{' || pages || '}}',
    '  issn     = {{1234-5678}}', '  doi      = {{' || doi || '}}', '  pmid     = {{' || pmid || '}}', '  pmcid    = {{' || pmc || '}}', '  keywords = {{' || words || '}}') || chr(10) || '}}' AS citation FROM f)"""
RIS = f"""{BASE},
w AS (SELECT k, string_agg('AU  - ' || coalesce(g, last || ', ' || first), chr(10) ORDER BY i) AS who FROM n GROUP BY k),
c AS (SELECT a.pmid, concat_ws(chr(10), CASE WHEN k % 5 = 0 THEN 'TY  - GEN' ELSE 'TY  - JOUR' END, who, 'TI  - ' || title || dot, 'JF  - ' || journal, 'JO  - ' || iso, 'PY  - ' || year, 'VL  - ' || volume, 'IS  - ' || issue,
    CASE WHEN pages IS NOT NULL THEN 'SP  - ' || (k + 100) END, CASE WHEN k % 3 = 0 AND pages IS NOT NULL THEN 'EP  - ' || left(CAST(k + 100 AS VARCHAR), length(CAST(k + 100 AS VARCHAR)) - 1) || '9' END, 'SN  - 1234-5678', 'DO  - ' || doi, 'AN  - ' || a.pmid,
    'UR  - {C.ARTICLE_URL}' || a.pmid || '/', 'UR  - {C.FULLTEXT_URL}' || pmc || '/', 'KW  - orders', 'KW  - lines', CASE WHEN k % 2 = 0 THEN 'KW  - a_b' END, CASE WHEN k % 3 <> 0 THEN 'AB  - Some ' || o_orderstatus END, 'ER  - ') AS citation FROM a LEFT JOIN w USING (k))"""
VANCOUVER = f"""{BASE},
w AS (SELECT k, string_agg(coalesce(g, last || ' ' || ini), ', ' ORDER BY i) FILTER (WHERE i <= 6) || CASE WHEN max(n) > 6 THEN ', et al' ELSE '' END || '.' AS who FROM n GROUP BY k),
c AS (SELECT a.pmid, concat_ws(' ', who, title || '.', coalesce(rtrim(iso, '.'), journal) || '.',
    nullif(concat_ws(':', nullif(concat_ws(';', year, volume || coalesce('(' || issue || ')', '')), ''), pages), '') || '.', 'doi: ' || doi) AS citation FROM a LEFT JOIN w USING (k))"""
_CTES = {"apa": APA, "mla": MLA, "bibtex": BIBTEX, "ris": RIS, "vancouver": VANCOUVER}
QUERIES = {f"cite_{s}": _style(s) for s in C.STYLES} | {"cite_multi": cite_multi}
ORACLES = {f"cite_{s}": f"WITH {sql} SELECT pmid, citation FROM c" for s, sql in _CTES.items()} | {
    "cite_multi": " UNION ALL ".join(f"SELECT * FROM (WITH {sql} SELECT '{s}' AS style, count(*) AS n, CAST(sum(length(citation)) AS BIGINT) AS chars FROM c)" for s, sql in _CTES.items())
}
