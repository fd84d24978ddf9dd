"""Sections of texts: filters, caps and character budgets. The lines of a document stand for its sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions.text import utf16_length
from litgrid.operators import budget as B
from litgrid.sources.tables import table

BUDGET, CAP = 500, 200


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return docs.withColumn("size", utf16_length(F.col("line")))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections: the first three words are the title, a line of fewer has none."""
    words = lambda x: F.regexp_extract(x, r"^((?:[^ ]+ ){2}[^ ]+) ", 1)
    sections = F.transform(F.split("text", "\n"), lambda x: F.struct(F.nullif(words(x), F.lit("")).alias("title"), x.alias("body")))
    return table(spark, sf_dir, "documents").select("doc_id", sections.alias("sections"))


TERMS = ["THE", "der"]


def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose title has one of the terms, and whether a document that has sections loses them all."""
    rows = _titled(spark, sf_dir).withColumn("kept", B.filter_sections(F.col("sections"), TERMS))
    return rows.select("doc_id", F.size("kept").alias("n_kept"), B.filter_miss(F.col("sections"), F.col("kept")).alias("filter_miss"), F.md5(F.array_join(F.transform("kept", lambda s: s["body"]), "|").cast("binary")).alias("digest"))


def max_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(spark, sf_dir).select("doc_id", F.posexplode(B.first_sections(F.col("sections"), 3)).alias("ord", "s"))
    return rows.select("doc_id", "ord", F.col("s.body").alias("line"))


def budget_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.truncate(_sections(spark, sf_dir), "doc_id", "ord", "size", BUDGET, CAP)
    return rows.select("doc_id", "ord", "size", "kept", B.cut(F.col("line"), F.col("kept")).alias("body"))


def budget_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.outline(_sections(spark, sf_dir), "doc_id", "ord", "size", BUDGET).select("doc_id", "ord", "size", "kept")


def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.report(B.truncate(_sections(spark, sf_dir), "doc_id", "ord", "size", BUDGET, CAP), "doc_id", "size")


def budget_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one section whose lines are its fields, with half the document's size to spend."""
    rows = _sections(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 2).alias("allow")), "doc_id")
    return B.fill_fields(rows, ["doc_id"], "ord", "size", "allow").select("doc_id", "ord", "kept")


SECTIONS = "s AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS ord, unnest(l) AS line, CAST(length(unnest(l)) AS INT) AS size FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
TRUNCATED = f"""t AS (SELECT *, CAST(greatest(0, least(least(size, {CAP}), {BUDGET} - coalesce(sum(least(size, {CAP})) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS INT) AS kept FROM s)"""
QUERIES = {f.__name__: f for f in (section_filter, max_sections, budget_truncate, budget_outline, budget_report, budget_fields)}
ORACLES = {
    "section_filter": """
        SELECT doc_id, CAST(len(k) AS INT) AS n_kept, len(k) = 0 AS filter_miss, md5(coalesce(array_to_string(k, '|'), '')) AS digest
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(regexp_extract(x, '^(([^ ]+ ){2}[^ ]+) ', 1), '(?i)(the|der)')) AS k FROM documents)""",
    "max_sections": f"WITH {SECTIONS} SELECT doc_id, ord, line FROM s WHERE ord < 3",
    "budget_truncate": f"WITH {SECTIONS}, {TRUNCATED} SELECT doc_id, ord, size, kept, substring(line, 1, kept) AS body FROM t",
    "budget_outline": f"""
        WITH {SECTIONS}, r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n,
            coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY size, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY size, ord)),
        lv AS (SELECT doc_id, min_by(CAST(floor(({BUDGET} - pre) / (n - k + 1)) AS INT), k) AS level FROM r WHERE pre + size * (n - k + 1) > {BUDGET} GROUP BY doc_id),
        b AS (SELECT s.*, coalesce(least(size, level), size) AS base, level IS NOT NULL AS tight FROM s LEFT JOIN lv USING (doc_id)),
        c AS (SELECT *, CASE WHEN tight THEN {BUDGET} - sum(base) OVER (PARTITION BY doc_id) ELSE 0 END AS rest, sum(CAST(size > base AS INT)) OVER (PARTITION BY doc_id ORDER BY ord) AS turn FROM b)
        SELECT doc_id, ord, size, CAST(base + CASE WHEN size > base AND turn <= rest THEN 1 ELSE 0 END AS INT) AS kept FROM c""",
    "budget_report": f"""
        WITH {SECTIONS}, {TRUNCATED} SELECT doc_id, count(*) AS n_sections, CAST(sum(size) AS BIGINT) AS total_chars, CAST(sum(kept) AS BIGINT) AS kept_chars,
            count(*) FILTER (WHERE kept = 0 AND size > 0) AS n_dropped, count(*) FILTER (WHERE kept > 0 AND kept < size) AS n_cut FROM t GROUP BY doc_id""",
    "budget_fields": f"""
        WITH {SECTIONS} SELECT doc_id, ord, CAST(greatest(0, least(size, n_chars // 2 - coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS INT) AS kept
        FROM s JOIN documents USING (doc_id)""",
}
