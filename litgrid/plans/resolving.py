"""Reconciliation: unresolved ids, conversions, routes, fallback chains, citation matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import citations
from litgrid.operators import resolve as R
from litgrid.operators.tiers import first_success
from litgrid.sources.tables import table


def unresolved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    found = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return R.unresolved(asked, found, "c_custkey")


def unresolved_refs_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as references; nations' keys as hits, some of which have a full-text id."""
    asked = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "MED").otherwise("PMC").alias("source"), F.concat(F.lit("pmc"), F.col("s_suppkey").cast("string")).alias("id"))
    hits = table(spark, sf_dir, "nation").select(F.lit("MED").alias("source"), F.concat(F.lit("PMC"), (F.col("n_nationkey") * 2).cast("string")).alias("id"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("PMC"), F.col("n_nationkey").cast("string"))).alias("pmcid"))
    return R.unresolved_refs(asked, hits).select("source", "id")


def convert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    asked = orders.select("o_orderkey").unionAll(orders.select(-F.col("o_orderkey") - 1))
    xwalk = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    out = asked.join(xwalk, "o_orderkey", "left")  # the crosswalk's reply as a table; its JSON form is in convert_report
    message = F.when(F.col("o_custkey").isNull(), F.lit("Identifier not found in PMC"))
    return out.select("o_orderkey", T.pmcid(F.col("o_custkey").cast("string")).alias("pmcid"), R.rewrite_error(message).alias("errmsg"))


def id_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    archive = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("target"))
    return R.route(orders.select("o_orderkey"), archive, "o_orderkey", "target").groupBy("bucket").agg(F.count("*").alias("n"))


def doi_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), F.col("o_orderkey").cast("string"))).alias("doi"))
    xwalk = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("doi: 10.2/"), F.col("c_custkey").cast("string")).alias("doi"))
    return R.fill(rows, xwalk, "key", "doi").select("o_orderkey", T.doi(F.col("doi")).alias("doi"))


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    pmc = table(spark, sf_dir, "documents").where("source IN ('src0', 'src1')").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    epmc = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("size"))
    oa = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sum(F.length("text")).cast("long").alias("size"))
    return asked, [("pmc", pmc), ("epmc", epmc), ("oa", oa)]


def fulltext_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, tiers = _tiers(spark, sf_dir)
    return asked.join(first_success(asked, "id", tiers), "id", "left").select("id", F.coalesce("tier", F.lit("unavailable")).alias("tier"), "size")


def chain_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of tiers; their numbers decide which."""
    tier_no = (F.col("event_id") % 3).cast("int")
    tier = F.get(F.array(F.lit("pmc"), F.lit("epmc"), F.lit("oa")), tier_no)
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (tier_no * 1_000_000_000 + F.col("event_id")).alias("tier_no"), tier.alias("tier"), F.get(F.array(*map(F.lit, OUTCOMES)), (F.col("event_id") % 7).cast("int")).alias("outcome"))
    return R.chain_reason(steps, "id")


OUTCOMES = ("not-attempted", "miss", "no-body", "no-fulltext", "no-doi", "no-oa", "service-error")


def citation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by author and year; of several candidates the first ten are listed."""
    none = F.lit(None).cast("string")
    fields = lambda author, year: [none.alias("journal"), year.cast("string").alias("year"), none.alias("volume"), none.alias("page"), author.cast("string").alias("author")]
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), *fields(F.col("c_custkey"), F.lit(1995)))
    records = table(spark, sf_dir, "orders").select("o_orderkey", *fields(F.col("o_custkey"), F.year("o_orderdate")))
    return citations.match(asked, records, "o_orderkey").select("key", "status", "matched_id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


def citation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.when(F.col("o_orderkey") % 4 == 0, "Other").otherwise("Customer#"), F.lit(" X")).alias("author"), F.concat((F.year("o_orderdate") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).cast("string"), F.lit("a")).alias("asked_year"), F.year("o_orderdate").cast("string").alias("year"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.array(F.concat(F.lit("Customer# "), F.col("c_name"))).alias("roster"))
    rows = asked.join(people, "o_custkey")
    warnings = R.citation_warnings(F.col("author"), F.col("roster"), F.col("asked_year"), F.col("year"))
    return rows.select("o_orderkey", F.array_join(warnings, ",").alias("warnings"))


REASON_CASES = " ".join(f"WHEN tier = '{t}' AND outcome = '{o}' THEN '{r}'" for (t, o), r in R.REASONS.items())
QUERIES = {f.__name__: f for f in (unresolved_ids, unresolved_refs_alias, convert_ids, id_routing, doi_backfill, fulltext_chain, chain_reason, citation_match, citation_warnings)}
ORACLES = {
    "unresolved_ids": "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "unresolved_refs_alias": """
        WITH a AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'MED' ELSE 'PMC' END AS source, 'pmc' || s_suppkey AS id FROM supplier),
        k AS (SELECT 'MED:PMC' || (n_nationkey * 2) AS ref FROM nation UNION SELECT 'PMC:PMC' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0)
        SELECT source, id FROM a WHERE source || ':' || upper(id) NOT IN (SELECT ref FROM k)""",
    "convert_ids": f"""
        SELECT r.k AS o_orderkey, 'PMC' || o_custkey AS pmcid, CASE WHEN o_custkey IS NULL THEN '{R.CONVERTER_ADVICE}' END AS errmsg
        FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders) r LEFT JOIN orders ON o_orderkey = r.k AND o_orderstatus <> 'P'""",
    "id_routing": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'archive' ELSE 'fallback' END AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "doi_backfill": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_orderkey ELSE '10.2/' || c_custkey END AS doi FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "fulltext_chain": """
        WITH t AS (SELECT doc_id AS id, 0 AS rk, 'pmc' AS tier, n_chars AS size FROM documents WHERE source IN ('src0', 'src1')
                   UNION ALL SELECT page_id, 1, 'epmc', length(html) FROM pages
                   UNION ALL SELECT conv_id, 2, 'oa', CAST(sum(length(text)) AS BIGINT) FROM conversations GROUP BY conv_id),
        b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rk) AS n FROM t)
        SELECT c_custkey AS id, coalesce(tier, 'unavailable') AS tier, size FROM customer LEFT JOIN b ON b.id = c_custkey AND n = 1""",
    "chain_reason": f"""
        WITH s AS (SELECT user_id AS id, event_id, ['pmc', 'epmc', 'oa'][event_id % 3 + 1] AS tier, {list(OUTCOMES)}[event_id % 7 + 1] AS outcome FROM events),
        l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (event_id % 3) * 1000000000 + event_id DESC) AS n FROM s WHERE outcome <> 'not-attempted')
        SELECT i.id, CASE WHEN tier IS NULL THEN 'no-pmc-fallback-disabled' WHEN outcome = 'service-error' THEN 'service-error' {REASON_CASES} ELSE 'not-found' END AS reason
        FROM (SELECT DISTINCT id FROM s) i LEFT JOIN l ON l.id = i.id AND n = 1""",
    "citation_match": """
        SELECT c_custkey AS key, CASE count(o_orderkey) WHEN 0 THEN 'not_found' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status,
               CASE WHEN count(o_orderkey) = 1 THEN min(o_orderkey) END AS matched_id,
               CASE WHEN count(o_orderkey) > 1 THEN array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:10], ',') END AS candidates
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = 1995 GROUP BY c_custkey""",
    "citation_warnings": """
        SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'author_mismatch' END, CASE WHEN o_orderkey % 5 = 0 THEN 'year_mismatch' END) AS warnings
        FROM orders JOIN customer ON c_custkey = o_custkey""",
}
