"""Queries through indexes over the shared tables: relevance, spelling, similar texts, citations, layouts, handles."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litgrid.functions import sections, variants, words
from litgrid.operators import budget, citations, handles, paging, ranking, similar_text, spelling
from litgrid.operators import resolve as R
from litgrid.session import ready_checkpoints, shared_folder
from litgrid.sources import layout
from litgrid.sources.tables import spread, table

TERMS = ["the", "ndan", "thonat", "theast", "inly"]
LEAST = 10


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("terms"))


def search_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that answer a query of five words best."""
    index = ranking.build(_texts(spark, sf_dir), _folder(spark, "index"))
    return ranking.top(spark, index, TERMS, 20)


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.vocabulary(_texts(spark, sf_dir))


def spelling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rare word of the documents with the nearest frequent one within two edits."""
    ready_checkpoints(spark)
    found = _vocabulary(spark, sf_dir).checkpoint()  # it is read for either side, and the texts once
    return spelling.suggest(found.where(F.col("n") < LEAST).select(F.col("entry").alias("word")), found.where(F.col("n") >= LEAST))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents most like each of every twentieth, by their words."""
    rows = _words(spark, sf_dir).withColumnRenamed("terms", "words")
    return similar_text.similar_texts(rows, "id % 20 = 0", 10)


def _citable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles with five fields."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k,
        F.col("o_orderpriority").alias("journal"),
        F.year("o_orderdate").cast("string").alias("year"),
        (F.col("o_custkey") % 50).cast("string").alias("volume"),
        (k % 1000).cast("string").alias("page"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("author"),
    )


GAPS = {"journal": "o_orderkey % 2 = 0", "year": "o_orderkey % 3 = 0", "volume": "o_orderkey % 5 < 2", "page": "o_orderkey % 4 = 0", "author": "o_orderkey % 11 < 6"}


def citation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines of every seventh order with fields left out, written, read back and matched; the replies, in two arrivals, reconciled with what was asked."""
    articles, folder = _citable(spark, sf_dir), _folder(spark, "citations")
    gaps = {f: F.when(~F.expr(gap), F.upper(f) if f == "journal" else F.col(f)) for f, gap in GAPS.items()}
    given = articles.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("key"), *(c.alias(f) for f, c in gaps.items()))
    given.select(citations.request_line(given, "key").alias("value")).write.option("lineSep", "\r").text(f"{folder}/requests")
    lines = spark.read.option("lineSep", "\r").text(f"{folder}/requests").where("value <> ''")
    asked = lines.select(citations.parse_request_line(F.col("value")).alias("r")).select("r.*")
    matches = citations.match(asked, articles, "o_orderkey")
    first = asked.where("key % 2 = 0").select(F.concat(F.lit("|||||"), "key", F.lit("|NOT_FOUND")).alias("value"))
    first.write.text(f"{folder}/replies/arrival=1")
    matches.select(citations.reply_line(matches).alias("value")).write.text(f"{folder}/replies/arrival=2")
    read = spark.read.schema("value string, arrival int").text(f"{folder}/replies")
    replies = read.select("arrival", R.parse_match_reply(F.col("value")).alias("r")).select("arrival", "r.*")
    out = R.reconcile(asked.select("key"), replies, "key", "arrival")
    return out.select(F.col("key").cast("long").alias("key"), "status", "matched_id", F.array_join("candidates", ",").alias("candidates"))


def citation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders agree with each customer's last known year and volume, and with the year alone."""
    articles = _citable(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(None).cast("string").alias("journal"), (F.lit(1992) + F.col("c_custkey") % 9).cast("string").alias("year"), F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 60).cast("string")).alias("volume"), F.lit(" ").alias("page"), F.lit(None).cast("string").alias("author"))
    return citations.match(asked, articles, "o_orderkey").select("key", "status", "matched_id", "n_candidates")


def _laid_out(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark, "layout")
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), k.cast("string")).alias("id"), F.when(F.col("source") == "src0", layout.ARCHIVE).otherwise(F.col("source")).alias("source"), F.when(k % 4 == 1, F.concat(F.lit("PMC"), k.cast("string"))).alias("pmcid"), "n_chars")
    layout.write(docs, folder, "source", "id")
    return folder


def layout_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents by source and id, and archive ids of others, from a table laid out by source and id."""
    folder = _laid_out(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id"))
    k = F.col("doc_id")
    refs = toxic.select(F.when(k % 2 == 0, layout.ARCHIVE).otherwise(F.concat(F.lit("src"), (k % 20).cast("string"))).alias("source"), F.when(k % 2 == 0, F.concat(F.lit("PMC"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("D"), k.cast("string"))).alias("id"))
    return layout.lookup(spark, folder, refs, "source", "id", "pmcid").select("source", "id", "pmcid", "n_chars")


def layout_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sources(_laid_out(spark, sf_dir), spark, ["src1", "src2", "src3"], "source").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def search_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of orders kept under a handle; its second half joined with the customers, without a search."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    page = paging.page(orders, [F.desc("o_totalprice"), "o_orderkey"], 10, 40).select("o_orderkey", "o_custkey", "o_totalprice")
    order = Window.orderBy(F.desc("o_totalprice"), "o_orderkey")
    handle = handles.keep(page.withColumn("pos", F.row_number().over(order)), "pos")
    kept = handles.page(spark, handle, "pos", 20, 20)
    return kept.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("pos", "o_orderkey", "c_name")


def _jats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts of documents: a lead paragraph, then a section for each further line, whose second half is a subsection."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9 ]", " "), " +", " "))), lambda x: x != "")
    half = lambda x: F.floor(F.length(x) / 2).cast("int")
    title = lambda x, i: F.concat(F.when(i % 3 == 0, "Methods ").otherwise("Results "), i.cast("string"))
    sec = lambda x, i: F.concat(F.lit("<sec><title>"), title(x, i), F.lit("</title><p>"), F.substring(x, F.lit(1), half(x)), F.lit("</p><sec><title>Part</title><p>"), F.substring(x, half(x) + 1, F.length(x)), F.lit("</p></sec></sec>"))
    rest = F.slice(F.col("lines"), F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    xml = F.concat(F.lit("<!DOCTYPE article><article><body><p>"), F.coalesce(F.get("lines", F.lit(0)), F.lit("")), F.lit("</p>"), F.array_join(F.transform(rest, sec), ""), F.lit("</body></article>"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", lines.alias("lines")).select("doc_id", xml.alias("xml"))


def section_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections parsed from full texts, those of methods chosen, and a budget of 300 units shared out among them in order: one plan."""
    found = sections.sections(_jats(spark, sf_dir), "xml")
    chosen = found.where(F.lower("title").contains("methods") & (F.col("depth") == 1))
    kept = budget.truncate(chosen, "doc_id", "ord", "size", 300)
    return kept.select("doc_id", "path", "ord", "title", "size", "kept", budget.cut(F.col("text"), F.col("kept")).alias("text"))


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every full text by depth."""
    return sections.sections(_jats(spark, sf_dir), "xml").groupBy("doc_id", "depth").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count("title").alias("titled"))


def summary_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of orders in JSON of five shapes: alone, in a list, under `result`, an error, and no JSON; members in three casings."""
    k = F.col("o_orderkey")
    q = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    day = F.date_format("o_orderdate", "yyyy MMM d")
    people = F.when(k % 3 == 0, '[{"name":"A B"},{"Name":"C D"},"E F"]').when(k % 3 == 1, '{"Author":[{"name":"N M"}]}').otherwise('"P Q; R S"')
    lower = q('{"uid":"', k.cast("string"), '","title":"T &amp; ', F.col("o_orderpriority"), '","source":"J","pubdate":"', day, '","authors":', people, ',"articleids":[{"idtype":"doi","value":"10.1/', k.cast("string"), '"}]}')
    title = q('{"Uid":', k.cast("string"), ',"Title":"T &amp; ', F.col("o_orderpriority"), '","FullJournalName":"FJ","PubDate":"', day, '","Authors":', people, ',"ArticleIds":{"IdType":"DOI","Value":"10.2/', k.cast("string"), '"}}')
    upper = q('{"UID":"', k.cast("string"), '","TITLE":"T &amp; ', F.col("o_orderpriority"), '","SO":"S","PUBDATE":"', day, '","AUTHORS":', people, ',"DOI":"10.3/', k.cast("string"), '"}')
    one = F.when(k % 5 < 2, lower).when(k % 5 == 2, title).otherwise(upper)
    reply = F.when(k % 7 == 0, q("[", one, "]")).when(k % 7 == 1, q('{"result":[', one, ',{"title":"no id"}]}')).when(k % 7 == 2, '{"error":"bad"}').when(k % 7 == 3, "<ERROR>x</ERROR>").otherwise(one)
    rows = spread(table(spark, sf_dir, "orders")).select("o_orderkey", reply.alias("raw"))
    return variants.summaries(rows, "raw")


QUERIES = {f.__name__: f for f in (search_relevance, spelling_index, similar_documents, citation_requests, citation_candidates, layout_lookup, layout_sources, search_handle, section_budget, section_tree, summary_variants)}
_WORDS = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)"
ORACLES = {
    "search_relevance": f"""
        WITH w AS {_WORDS}, l AS (SELECT doc_id, count(*) AS length FROM w GROUP BY 1), s AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
        t AS (SELECT term, doc_id, count(*) AS tf FROM w WHERE term IN {tuple(TERMS)} GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
        r AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {ranking.K1 + 1} / (tf + {ranking.K1} * ({1 - ranking.B} + {ranking.B} * length / mean))), {ranking.DECIMALS}) AS score
              FROM t JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY 1)
        SELECT doc_id AS id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS pos FROM r ORDER BY score DESC, doc_id LIMIT 20""",
    "spelling_index": f"""
        WITH v AS (SELECT term, count(*) AS n FROM {_WORDS} GROUP BY 1), a AS (SELECT term AS word FROM v WHERE n < {LEAST}), d AS (SELECT term AS entry, n FROM v WHERE n >= {LEAST}),
        p AS (SELECT word, entry, n, levenshtein(word, entry) AS distance FROM a JOIN d ON length(entry) BETWEEN length(word) - 2 AND length(word) + 2),
        b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, n DESC, entry) AS r FROM p WHERE distance <= 2)
        SELECT a.word, coalesce(entry, a.word) AS corrected, CAST(coalesce(distance, -1) AS INT) AS distance FROM a LEFT JOIN b ON a.word = b.word AND r = 1""",
    "similar_documents": f"""
        WITH w AS {_WORDS}, n AS (SELECT count(*) AS n FROM documents), t AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
        v AS (SELECT doc_id, term, tf * ln(n / df) AS w FROM t JOIN d USING (term), n WHERE df < n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1),
        s AS (SELECT a.doc_id AS query_id, b.doc_id AS id, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 6) AS score
              FROM v a JOIN v b ON a.term = b.term AND a.doc_id <> b.doc_id JOIN l x ON x.doc_id = a.doc_id JOIN l y ON y.doc_id = b.doc_id WHERE a.doc_id % 20 = 0 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM s WHERE score >= {similar_text.LEAST})
        SELECT query_id, id, score, CAST(pos AS INT) AS pos FROM r WHERE pos <= 10""",
    "citation_requests": f"""
        WITH a AS (SELECT o_orderkey, o_orderpriority AS journal, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(o_custkey % 50 AS VARCHAR) AS volume, CAST(o_orderkey % 1000 AS VARCHAR) AS page, 'Customer ' || o_custkey AS author FROM orders),
        q AS (SELECT o_orderkey AS key, {", ".join(f"CASE WHEN NOT ({g}) THEN {f} END AS {f}" for f, g in GAPS.items())} FROM a WHERE o_orderkey % 7 = 0),
        m AS (SELECT q.key, count(a.o_orderkey) AS n, min(a.o_orderkey) AS first, list(a.o_orderkey ORDER BY a.o_orderkey) AS ids
              FROM q LEFT JOIN a ON (q.journal IS NOT NULL OR q.year IS NOT NULL) AND {" AND ".join(f"coalesce(q.{f} = a.{f}, true)" for f in GAPS)} GROUP BY q.key)
        SELECT key, CASE n WHEN 0 THEN 'not_found' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN CAST(first AS VARCHAR) END AS matched_id, CASE WHEN n > 1 THEN array_to_string(ids[1:10], ',') END AS candidates FROM m""",
    "citation_candidates": """
        WITH q AS (SELECT c_custkey AS key, 1992 + c_custkey % 9 AS y, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 60 END AS v FROM customer),
        m AS (SELECT key, count(o_orderkey) AS n, min(o_orderkey) AS first FROM q LEFT JOIN orders ON year(o_orderdate) = y AND (v IS NULL OR o_custkey % 50 = v) GROUP BY key)
        SELECT key, CASE n WHEN 0 THEN 'not_found' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN first END AS matched_id, n AS n_candidates FROM m""",
    "layout_lookup": """
        WITH d AS (SELECT doc_id, 'D' || doc_id AS id, CASE WHEN source = 'src0' THEN 'PMC' ELSE source END AS source, CASE WHEN doc_id % 4 = 1 THEN 'PMC' || doc_id END AS pmcid, n_chars FROM documents),
        t AS (SELECT doc_id AS k, CASE WHEN doc_id % 2 = 0 THEN 'PMC' ELSE 'src' || (doc_id % 20) END AS source, CASE WHEN doc_id % 2 = 0 THEN 'PMC' || (doc_id + 1) ELSE 'D' || doc_id END AS id FROM labels WHERE toxic = 1)
        SELECT DISTINCT d.source, d.id, d.pmcid, d.n_chars FROM d JOIN t ON (d.source = t.source AND d.id = t.id) OR (t.source = 'PMC' AND d.source <> 'PMC' AND d.pmcid = t.id)""",
    "layout_sources": "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1",
    "search_handle": """
        WITH p AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 10 AS pos FROM orders WHERE o_orderstatus = 'F')
        SELECT CAST(pos AS INT) AS pos, o_orderkey, c_name FROM p JOIN customer ON c_custkey = o_custkey WHERE pos BETWEEN 21 AND 40""",
    "section_budget": """
        WITH {0}, c AS (SELECT doc_id, i, first AS text, sum(length(first)) OVER (PARTITION BY doc_id ORDER BY i) - length(first) AS before FROM s WHERE i > 1 AND (i - 2) % 3 = 0)
        SELECT doc_id, CAST(i AS VARCHAR) AS path, CAST(2 * i - 2 AS INT) AS ord, 'Methods ' || (i - 2) AS title, CAST(length(text) AS INT) AS size, CAST(greatest(0, least(length(text), 300 - before)) AS INT) AS kept, left(text, CAST(greatest(0, least(length(text), 300 - before)) AS INT)) AS text FROM c""",
    "section_tree": """
        WITH {0}, z AS (SELECT doc_id, 1 AS depth, length(first) AS size, i > 1 AS titled FROM s UNION ALL SELECT doc_id, 2, length(second), true FROM s WHERE i > 1)
        SELECT doc_id, depth, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, count(*) FILTER (WHERE titled) AS titled FROM z GROUP BY 1, 2""",
    "summary_variants": """
        SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS uid, 'T & ' || o_orderpriority AS title, ['J', 'J', 'FJ', 'S', 'S'][o_orderkey % 5 + 1] AS source, strftime(o_orderdate, '%Y-%m-%d') AS pub_date,
            ['A B; C D; E F', 'N M', 'P Q; R S'][o_orderkey % 3 + 1] AS authors, '10.' || [1, 1, 2, 3, 3][o_orderkey % 5 + 1] || '/' || o_orderkey AS doi FROM orders WHERE o_orderkey % 7 NOT IN (2, 3)""",
}
_SECTIONS = """
    l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
    u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l UNION ALL SELECT doc_id, '', 1 FROM l WHERE len(l) = 0),
    s AS (SELECT doc_id, i, CASE WHEN i = 1 THEN x ELSE trim(left(x, length(x) // 2)) END AS first, CASE WHEN i > 1 THEN trim(substr(x, length(x) // 2 + 1)) END AS second FROM u)"""
for _name in ("section_budget", "section_tree"):
    ORACLES[_name] = ORACLES[_name].replace("{0}", _SECTIONS)
