"""Text, date and identifier functions over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators.resolve import first_seen
from litgrid.sources.tables import spread, table


def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.display_text(F.col("html")).alias("body"))


def partial_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy MMM")).otherwise(F.date_format(d, "yyyy MMM d"))
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", T.partial_date(form).alias("iso"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))


def author_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string")))
    return _people(spark, sf_dir).groupBy("conv_id").agg(names.alias("names")).select("conv_id", T.author_display(F.col("names")).alias("authors"))


def affiliation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    index = first_seen(people, "conv_id", "role", ["turn"])
    return people.join(index, ["conv_id", "role"]).select("conv_id", "turn", "role", "idx")


def keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.concat(F.split("text", " "), F.array("lang", "source", F.lit("the"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, "|").cast("binary")).alias("digest"))


def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    pages = F.concat((F.col("l_partkey") + 1000).cast("string"), F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("l_linenumber").cast("string"))))
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", T.page_start(pages).alias("first_page"), T.page_end(pages).alias("last_page"))


def url_doi_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("page_id") % 3 == 0, "https://doi.org/10.5/").when(F.col("page_id") % 3 == 1, " DOI: 10.5/").otherwise("11.5/"), F.col("page_id").cast("string"))
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), T.doi(raw).alias("doi"), T.trailing_digits(F.col("url")).alias("number"), T.pmcid(F.concat(F.lit("pmc"), F.col("page_id").cast("string"))).alias("pmcid"))


def uid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.get(F.array(*map(F.lit, ("67", "68", "81", "99"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.decode_uid(F.concat(prefix, F.lpad(F.col("p_partkey").cast("string"), 6, "0"))).alias("uid"))


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = T.collapse(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    links = F.size(F.regexp_extract_all("html", F.lit(r"<a [^>]*href="), F.lit(0)))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), links.cast("int").alias("n_links"), F.length(T.html_text(F.col("html"))).alias("n_text"))


SPACE = r"[ \t\n\r\f\v\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def display_sql(c: str) -> str:
    """Display text in SQL, for texts without numeric references."""
    s = f"regexp_replace({c}, '</?[A-Za-z][^<>]*>', ' ', 'g')"
    for name, char in sorted(T.NAMED_ENTITIES.items(), key=lambda kv: kv[0] == "amp"):  # ampersands last: nothing is decoded twice
        s = f"regexp_replace({s}, '(?i)&{name};', '{char.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"trim(regexp_replace(replace({s}, '\u00ad', ''), '{SPACE}', ' ', 'g'))"


def _page_text(c: str) -> str:
    s = f"regexp_replace({c}, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav"):
        s = f"regexp_replace({s}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return display_sql(s)


QUERIES = {f.__name__: f for f in (display_text, partial_date, author_display, affiliation_index, keyword_union, page_range, url_doi_normalise, uid_decode, html_extract)}
ORACLES = {
    "display_text": f"SELECT page_id, {display_sql('html')} AS body FROM pages",
    "partial_date": "SELECT o_orderkey, strftime(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') AS iso FROM orders",
    "author_display": "SELECT conv_id, array_to_string(list(role || turn ORDER BY turn)[1:3], ', ') || CASE WHEN count(*) > 3 THEN ', et al.' ELSE '' END AS authors FROM conversations GROUP BY conv_id",
    "affiliation_index": """
        WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2), i AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY t) - 1 AS idx FROM f)
        SELECT conv_id, turn, role, CAST(idx AS INT) AS idx FROM conversations JOIN i USING (conv_id, role)""",
    "keyword_union": """
        WITH l AS (SELECT doc_id, list_concat(string_split(text, ' '), [lang, source, 'the']) AS l FROM documents),
        u AS (SELECT doc_id, unnest(l) AS k, generate_subscripts(l, 1) AS i FROM l), d AS (SELECT doc_id, k, min(i) AS i FROM u GROUP BY 1, 2)
        SELECT doc_id, CAST(count(*) AS INT) AS n, md5(string_agg(k, '|' ORDER BY i)) AS digest FROM d GROUP BY doc_id""",
    "page_range": """
        SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, CAST(l_partkey + 1000 AS VARCHAR) AS first_page,
            CASE WHEN l_linenumber <> 1 THEN left(CAST(l_partkey + 1000 AS VARCHAR), length(CAST(l_partkey + 1000 AS VARCHAR)) - length(CAST(l_linenumber AS VARCHAR))) || l_linenumber END AS last_page FROM lineitem""",
    "url_doi_normalise": r"""
        SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE WHEN page_id % 3 < 2 THEN '10.5/' || page_id END AS doi,
            nullif(regexp_extract(url, '(\d+)/?\s*$', 1), '') AS number, 'PMC' || page_id AS pmcid FROM pages""",
    "uid_decode": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '99' ELSE ['C', 'D', 'Q'][p_partkey % 4 + 1] END || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS uid FROM part",
    "html_extract": f"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '{SPACE}', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS INT) AS n_links, CAST(length({_page_text('html')}) AS INT) AS n_text FROM pages",
}
