"""Chains of sources over the shared tables: full texts by tiers, what replies are, open-access copies, links by fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import budget as B
from litgrid.operators import chains, tiers
from litgrid.operators import related as L
from litgrid.operators import resolve as R
from litgrid.plans.texts import _page_text
from litgrid.sources.tables import spread, table


def chain(spark: SparkSession, sf_dir: str, few: int = tiers.FEW_KEYS) -> tiers.Chain:
    """Full texts of customers' numbers: documents first, then pages, then the turns of conversations.

    A document of a single line has no body, one of every seventeenth number failed; a page without a title has no text, and
    neither has a conversation without an assistant's turn. Each tier is one scan.
    """
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    lines = F.size(F.split("text", "\n")) - 1
    pmc = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"), lines.alias("n_sections"), (F.col("doc_id") % 17 == 0).alias("failed"), F.col("n_chars").alias("size"))
    titled = F.col("html").contains("<title>The") | F.col("html").contains("<title>Der")
    epmc = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(titled, F.col("html")).otherwise("").alias("payload"), F.lit(None).cast("int").alias("n_sections"), F.lit(None).cast("boolean").alias("failed"), F.length("html").cast("long").alias("size"))
    said = F.when(F.col("role") == "assistant", F.col("text"))
    oa = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), said.alias("payload"), F.lit(1).alias("n_sections"), (F.col("turn") > 50).alias("failed"), F.length("text").cast("long").alias("size"))
    return tiers.run_chain(asked, "id", [chains.Tier("pmc", pmc), chains.Tier("epmc", epmc), chains.Tier("oa", oa)], ("size",), few)


def fulltext_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tier's outcome for each id up to the one that had the text, that text's size, and why there is none."""
    found = chain(spark, sf_dir)
    text = F.array_join(F.transform("outcomes", lambda o: F.concat(o["tier"], F.lit(":"), o["outcome"])), ",")
    rows = found.outcomes().select("id", "tier", text.alias("outcomes"))
    return rows.join(found.found.select("id", "size"), "id", "left").join(found.reasons(), "id", "left")


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What later tiers found of what the first one missed, by tier."""
    found = chain(spark, sf_dir)
    missed = found.steps.where("tier_no = 0 AND outcome <> 'found'").select("id", F.col("outcome").alias("first_outcome"))
    return missed.join(found.found, "id").groupBy("first_outcome", "tier").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def _reply(c: Column, id_: Column) -> Column:
    """A reply made of a text: of nine kinds, by the number."""
    plain = F.regexp_replace(c, "[^a-z ]", "")
    kinds = [
        F.concat(F.lit('<?xml version="1.0"?><r><p a="1">'), plain, F.lit("</p></r>")),
        F.concat(F.lit("<r><p>"), plain, F.lit("</r>")),
        F.concat(F.lit("<r><p><i>"), plain, F.lit("</p></i></r>")),
        F.concat(F.lit("<r>&bad "), plain, F.lit("</r>")),
        F.concat(F.lit("<!DOCTYPE r [ ]><r>&nbsp;"), plain, F.lit("<br/></r>")),
        F.lit('<?xml version="1.0"?>\n<!DOCTYPE eLinkResult PUBLIC "-//X" "x.dtd">\n'),
        F.concat(F.lit("<r><ERROR>"), plain, F.lit("</ERROR></r>")),
        F.concat(F.lit("<r/><r>"), plain, F.lit("</r>")),
        F.concat(F.lit("<HTML lang='en'><body>"), plain),
    ]
    return F.get(F.array(*kinds), (id_ % 9).cast("int"))


KINDS = ("xml", "invalid", "invalid", "invalid", "xml", "empty", "error", "invalid", "html")


def payload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of documents, whole and broken, and pages as they are."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.lit("document").alias("made_of"), F.col("doc_id").alias("id"), _reply(F.col("text"), F.col("doc_id")).alias("reply"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("made_of"), F.col("page_id").alias("id"), F.col("html").alias("reply"))
    return docs.unionAll(pages).select("made_of", "id", T.payload_kind(F.col("reply")).alias("kind"))


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index replies for pages: doi, status, is_oa, best, locations; every fifth page has no best location, every seventh none at all."""
    k = F.col("page_id")
    place = lambda host: F.struct(F.col("url"), F.when(k % 4 == 0, F.concat("url", F.lit(".pdf"))).alias("url_for_pdf"), F.lit(host).alias("host_type"), F.when(k % 3 == 0, "cc-by").alias("license"), F.lit(None).cast("string").alias("version")).cast(chains.LOCATION)
    none = F.lit(None).cast(chains.LOCATION)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "html",
        F.concat(F.when(k % 11 == 0, "no doi ").otherwise("https://doi.org/10.5/"), k.cast("string")).alias("doi"),
        F.when(k % 13 == 0, 404).when(k % 13 == 1, 422).otherwise(200).alias("status"),
        (k % 6 != 0).alias("is_oa"),
        F.when((k % 5 > 0) & (k % 7 > 0), place("publisher")).otherwise(none).alias("best"),
        F.when(k % 7 > 0, F.array(place("repository"))).otherwise(F.array().cast(f"array<{chains.LOCATION}>")).alias("locations"),
    )


def oa_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open-access location of each page's identifier, or why there is none."""
    return chains.oa_resolve(_locations(spark, sf_dir)).select("page_id", "doi", "kind", "reason", "url", "url_for_pdf", "host_type", "license")


def oa_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was fetched for each location found, as text with its provenance, cut to 200 units with an account of it."""
    found = chains.oa_resolve(_locations(spark, sf_dir)).where("kind = 'found'")
    body = F.when(F.col("page_id") % 10 == 9, F.lit(None).cast("string")).when(F.col("url_for_pdf").isNotNull(), F.concat(F.lit("%PDF-1.4 page "), F.col("page_id").cast("string"))).when(F.col("page_id") % 10 == 3, "<html><script>x</script></html>").otherwise(F.col("html"))
    out = chains.oa_body(found.withColumn("body", body))
    kept, before, after = B.content_budget(F.col("content"), 200)
    return out.select("page_id", "outcome", "content_format", "source_url", F.length("content").alias("n_chars"), "word_count", kept.alias("kept"), before.alias("n_before"), after.alias("n_after"))


def references_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of orders: a first provider for even ones; of the others those with a title are looked up with two more, in turn."""
    orders = table(spark, sf_dir, "orders")
    asked = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("src"))
    links = L.linked(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"), "l_orderkey", "l_partkey", ["l_linenumber", "l_suppkey"])
    titles = orders.select(F.col("o_orderkey").alias("src"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority")).otherwise(" ").alias("title"))
    rest = [("corpus", links.where("src % 3 = 0 AND pos <= 2")), ("graph", links.where("src % 5 = 1 AND pos = 1"))]
    found = chains.coverage_fallback(asked, "src", links.where("src % 2 = 0"), titles, rest, "references")
    return found.select("src", "dst", "pos", "provider", "fallback")


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related works of orders by addresses in a graph: three candidates for each wanted link, the ids among them that are records, distinct and but the work itself."""
    orders = table(spark, sf_dir, "orders")
    address = lambda n: F.concat(F.when(n % 2 == 0, "https://graph.example/W").otherwise("W"), n.cast("string"))
    related = F.transform(F.sequence(F.col("o_orderkey"), F.col("o_orderkey") + 11), lambda n: address(n - n % 2))
    works = orders.select(F.col("o_orderkey").alias("src"), chains.work_ids(chains.capped(related, 3, chains.RELATED_CAP)).alias("related"))
    source = F.when(F.col("o_orderkey") % 4 == 0, "PPR").otherwise("MED")
    pmid = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    ids = orders.select(F.concat(F.lit("W"), F.col("o_orderkey").cast("string")).alias("work_id"), chains.link_id(pmid, source, F.col("o_orderkey").cast("string")).cast("long").alias("pmid"))
    return L.two_hop(works, ids.where("pmid IS NOT NULL")).select("src", "dst", "pos")


def match_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match replies for orders in lines of the piped protocol, read back: their state, ids and candidates."""
    k = F.col("o_orderkey").cast("string")
    told = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("AMBIGUOUS "), F.col("o_custkey").cast("string"), F.lit(","), k)).when(F.col("o_orderkey") % 4 == 2, "NOT_FOUND;INVALID_JOURNAL").otherwise("ambiguous (many)")
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("|", F.lit("J"), F.year("o_orderdate").cast("string"), F.lit(""), F.lit(""), F.lit("A"), k, told).alias("line"))
    r = lines.select("o_orderkey", R.parse_match_reply(F.col("line")).alias("r")).select("o_orderkey", "r.*")
    return r.select("o_orderkey", "status", "matched_id", F.array_join("candidates", ",").alias("candidates"))


def match_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the last of the replies to it, in the order of their arrival; those without any are not found."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    status = F.when(F.col("o_orderstatus") == "F", "matched").otherwise("ambiguous")
    replies = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.struct("o_orderdate", "o_orderkey").alias("at"), status.alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("matched_id"))
    return R.reconcile(asked, replies, "key", "at")


def matched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ids that matches lead to, with their customers' names: the roster warnings are looked up in."""
    matches = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("matched_id"))
    return chains.matched_ids(matches).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("matched_id"), "c_name"), "matched_id")


def crosswalk_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosswalk replies in JSON, a batch of orders each, read back and joined to what was asked: ids as they were written, and counts."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 10 < 3")
    record = F.concat(F.lit('{"requested-id":"PMC'), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", F.lit('","errmsg":"Identifier not found in PMC"}')).otherwise(F.concat(F.lit('","pmid":'), F.col("o_custkey").cast("string"), F.lit(',"pmcid":"PMC'), F.col("o_orderkey").cast("string"), F.lit('"}'))))
    batch = F.col("o_custkey")
    replies = orders.groupBy(batch.alias("batch")).agg(F.concat(F.lit('{"status":"ok","records":['), F.array_join(F.sort_array(F.collect_list(record)), ","), F.lit("]}")).alias("json"))
    asked = orders.select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("pmc"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" "))).alias("asked"))
    keyed = asked.withColumn("requested_id", chains.crosswalk_key(F.col("asked"), "pmcid"))
    out = keyed.join(chains.parse_crosswalk(replies, "json").drop("batch", "json"), "requested_id", "left")
    return out.select("asked", "requested_id", "pmid", "pmcid", R.rewrite_error(F.col("errmsg")).alias("errmsg"))


def crosswalk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.convert_report(crosswalk_reports(spark, sf_dir))


QUERIES = {f.__name__: f for f in (fulltext_outcomes, recovered, payload_kinds, oa_locations, oa_contents, references_fallback, link_candidates, match_reports, match_reconcile, matched_records, crosswalk_reports, crosswalk_totals)}

_CHAIN = """
    pmc AS (SELECT doc_id AS id, min(CASE WHEN doc_id % 17 = 0 THEN 'service-error' WHEN trim(coalesce(text, '')) = '' THEN 'no-fulltext' WHEN NOT contains(text, chr(10)) THEN 'no-body' ELSE 'found' END) AS o, min(n_chars) AS size FROM documents GROUP BY 1),
    epmc AS (SELECT page_id AS id, CASE WHEN contains(html, '<title>The') OR contains(html, '<title>Der') THEN 'found' ELSE 'no-fulltext' END AS o, length(html) AS size FROM pages),
    oa AS (SELECT conv_id AS id, CASE WHEN bool_or(role = 'assistant' AND turn <= 50 AND trim(text) <> '') THEN 'found' WHEN bool_or(turn <= 50) THEN 'no-fulltext' ELSE 'service-error' END AS o,
                  min(length(text)) FILTER (WHERE role = 'assistant' AND turn <= 50 AND trim(text) <> '') AS size FROM conversations GROUP BY 1),
    a AS (SELECT DISTINCT c_custkey AS id FROM customer),
    s AS (SELECT a.id, coalesce(pmc.o, 'miss') AS o1, coalesce(epmc.o, 'miss') AS o2, coalesce(oa.o, 'miss') AS o3, pmc.size AS s1, epmc.size AS s2, oa.size AS s3
          FROM a LEFT JOIN pmc USING (id) LEFT JOIN epmc USING (id) LEFT JOIN oa USING (id)),
    c AS (SELECT *, CASE WHEN o1 = 'found' THEN 'pmc' WHEN o2 = 'found' THEN 'epmc' WHEN o3 = 'found' THEN 'oa' END AS tier,
                 CASE WHEN o1 = 'found' THEN s1 WHEN o2 = 'found' THEN s2 WHEN o3 = 'found' THEN s3 END AS size FROM s)"""
ORACLES = {
    "fulltext_outcomes": f"""WITH {_CHAIN}
        SELECT id, tier, 'pmc:' || o1 || CASE WHEN o1 = 'found' THEN '' ELSE ',epmc:' || o2 || CASE WHEN o2 = 'found' THEN '' ELSE ',oa:' || o3 END END AS outcomes, size,
            CASE WHEN tier IS NULL THEN CASE o3 WHEN 'service-error' THEN 'service-error' ELSE 'not-found' END END AS reason FROM c""",
    "recovered": f"WITH {_CHAIN} SELECT o1 AS first_outcome, tier, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM c WHERE o1 <> 'found' AND tier IS NOT NULL GROUP BY 1, 2",
    "payload_kinds": f"SELECT 'document' AS made_of, doc_id AS id, CASE WHEN text IS NULL AND doc_id % 9 <> 5 THEN 'empty' ELSE {list(KINDS)}[doc_id % 9 + 1] END AS kind FROM documents UNION ALL SELECT 'page', page_id, 'html' FROM pages",
    "oa_locations": """
        WITH l AS (SELECT page_id, CASE WHEN page_id % 11 > 0 THEN '10.5/' || page_id END AS doi, CASE WHEN page_id % 11 = 0 THEN 'Invalid DOI' WHEN page_id % 13 = 0 THEN 'DOI unknown to the index' WHEN page_id % 13 = 1 THEN 'Invalid DOI format'
            WHEN page_id % 6 = 0 THEN 'No open-access copy indexed' WHEN page_id % 7 = 0 THEN 'OA flagged but no usable location URL' END AS reason, url FROM pages)
        SELECT page_id, doi, CASE WHEN reason IS NULL THEN 'found' ELSE 'no-oa' END AS kind, reason, CASE WHEN reason IS NULL THEN url END AS url, CASE WHEN reason IS NULL AND page_id % 4 = 0 THEN url || '.pdf' END AS url_for_pdf,
            CASE WHEN reason IS NULL THEN CASE WHEN page_id % 5 > 0 THEN 'publisher' ELSE 'repository' END END AS host_type, CASE WHEN reason IS NULL AND page_id % 3 = 0 THEN 'cc-by' END AS license FROM l""",
    "oa_contents": f"""
        WITH l AS (SELECT page_id, url, html FROM pages WHERE page_id % 11 > 0 AND page_id % 13 > 1 AND page_id % 6 > 0 AND page_id % 7 > 0),
        b AS (SELECT *, page_id % 10 = 9 AS missing, page_id % 4 = 0 AS pdf, page_id % 10 = 3 AS blank FROM l),
        c AS (SELECT page_id, CASE WHEN missing THEN 'fetch-failed' WHEN pdf THEN 'found' WHEN blank THEN 'parse-failed' ELSE 'found' END AS outcome, missing, pdf, blank, url,
                     CASE WHEN missing THEN NULL WHEN pdf THEN 'page ' || page_id WHEN blank THEN NULL ELSE {_page_text('html')} END AS content FROM b)
        SELECT page_id, outcome, CASE WHEN outcome = 'found' THEN CASE WHEN pdf THEN 'pdf-text' ELSE 'html-markdown' END END AS content_format, CASE WHEN outcome = 'found' THEN url || CASE WHEN pdf THEN '.pdf' ELSE '' END END AS source_url,
            CAST(length(content) AS INT) AS n_chars, CASE WHEN NOT pdf THEN CAST(len(string_split(content, ' ')) AS INT) END AS word_count, left(content, 200) AS kept,
            CASE WHEN length(content) > 200 THEN CAST(length(content) AS INT) END AS n_before, CASE WHEN length(content) > 200 THEN 200 END AS n_after FROM c""",
    "references_fallback": """
        WITH f AS (SELECT l_orderkey AS src, l_partkey AS dst, min((l_linenumber, l_suppkey)) AS place FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY 1, 2),
        l AS (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY place, dst) AS INT) AS pos FROM f), a AS (SELECT DISTINCT o_orderkey AS src FROM orders WHERE o_orderstatus <> 'P'),
        first AS (SELECT l.* FROM l JOIN a USING (src) WHERE src % 2 = 0),
        rest AS (SELECT src FROM a JOIN orders ON o_orderkey = src WHERE src NOT IN (SELECT src FROM first) AND o_custkey % 5 > 0),
        corpus AS (SELECT l.* FROM l JOIN rest USING (src) WHERE src % 3 = 0 AND pos <= 2), graph AS (SELECT l.* FROM l JOIN rest USING (src) WHERE src % 5 = 1 AND pos = 1 AND src NOT IN (SELECT src FROM corpus))
        SELECT *, 'first' AS provider, CAST(NULL AS VARCHAR) AS fallback FROM first UNION ALL SELECT *, 'corpus', 'references_coverage' FROM corpus UNION ALL SELECT *, 'graph', 'references_coverage' FROM graph""",
    "link_candidates": """
        WITH w AS (SELECT o_orderkey AS src, unnest(range(0, 9)) AS i FROM orders), t AS (SELECT src, i, src + i - (src + i) % 2 AS n FROM w),
        m AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 4 > 0 THEN o_orderkey END AS pmid FROM orders)
        SELECT src, pmid AS dst, CAST(min(i) AS INT) AS pos FROM t JOIN m USING (n) WHERE pmid <> src GROUP BY 1, 2""",
    "match_reports": """
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'matched' WHEN 2 THEN 'not_found' ELSE 'ambiguous' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) END AS matched_id,
            CASE WHEN o_orderkey % 4 = 1 THEN o_custkey || ',' || o_orderkey END AS candidates FROM orders""",
    "match_reconcile": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
        SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN o_orderkey IS NULL THEN 'not_found' WHEN o_orderstatus = 'F' THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS matched_id
        FROM customer LEFT JOIN r ON o_custkey = c_custkey AND n = 1""",
    "matched_records": "SELECT c_custkey AS matched_id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "crosswalk_reports": f"""
        SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'pmc' || o_orderkey ELSE ' ' || o_orderkey || ' ' END AS asked, 'PMC' || o_orderkey AS requested_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS pmid,
            CASE WHEN o_orderstatus <> 'P' THEN 'PMC' || o_orderkey END AS pmcid, CASE WHEN o_orderstatus = 'P' THEN '{R.CONVERTER_ADVICE}' END AS errmsg FROM orders WHERE o_orderkey % 10 < 3""",
    "crosswalk_totals": "SELECT count(*) AS n_submitted, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_converted FROM orders WHERE o_orderkey % 10 < 3",
}
