"""Reconciling what was asked for with what was found: anti joins, crosswalks, ordered fallbacks, citation matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions.text import surname

# fixed values: outcomes of a tier and the reasons they lead to
REASONS = {
    ("pmc", "miss"): "not-found",
    ("epmc", "miss"): "not-found",
    ("epmc", "no-fulltext"): "no-epmc-fulltext",
    ("pmc", "no-body"): "no-body",
    ("epmc", "no-body"): "no-body",
    ("oa", "no-doi"): "no-doi",
    ("oa", "no-oa"): "no-oa",
    ("oa", "fetch-failed"): "fetch-failed",
    ("oa", "parse-failed"): "parse-failed",
}
SKIPPED = "not-attempted"
CONVERTER_MESSAGE = "(?i)^identifier not found in pmc$"
CONVERTER_ADVICE = "Not in the full-text archive; the identifier may still exist elsewhere."


def unresolved(asked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows asked for whose key was not found, repeats included."""
    return asked.join(found.select(key).distinct(), key, "left_anti")


def unresolved_refs(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """asked: source, id; hits: source, id, pmcid. A hit resolves its own reference and that of its full-text id; ids agree in any case."""
    own = hits.select(F.concat_ws(":", "source", F.upper("id")).alias("ref"))
    archived = hits.where("pmcid IS NOT NULL").select(F.concat(F.lit("PMC:"), F.upper("pmcid")).alias("ref"))
    keyed = asked.withColumn("ref", F.concat_ws(":", "source", F.upper("id")))
    return keyed.join(own.unionAll(archived).distinct(), "ref", "left_anti").drop("ref")


def reconcile(asked: DataFrame, replies: DataFrame, key: str, order: str, default_status: str = "not_found") -> DataFrame:
    """Every row asked for, with the last reply to its key (by `order`) or the default status."""
    last = replies.groupBy(key).agg(F.max_by(F.struct(*[c for c in replies.columns if c != key]), F.col(order)).alias("r"))
    out = asked.join(last, key, "left")
    names = [c for c in replies.columns if c not in (key, order)]
    return out.select(*asked.columns, *(F.coalesce(F.col(f"r.{c}"), F.lit(default_status)).alias(c) if c == "status" else F.col(f"r.{c}").alias(c) for c in names))


def rewrite_error(c: Column) -> Column:
    return F.when(c.rlike(CONVERTER_MESSAGE), CONVERTER_ADVICE).otherwise(c)


def chain_reason(outcomes: DataFrame, key: str) -> DataFrame:
    """Why nothing was found: from the last tier that was tried. outcomes: key, tier_no, tier, outcome."""
    tried = F.col("outcome") != SKIPPED
    last = outcomes.groupBy(key).agg(F.max(F.when(tried, F.struct("tier_no", "tier", "outcome"))).alias("last"))
    reason = F.lit(None).cast("string")
    for (tier, outcome), why in REASONS.items():
        reason = F.when((F.col("last.tier") == tier) & (F.col("last.outcome") == outcome), why).otherwise(reason)
    return last.select(key, F.when(F.col("last").isNull(), "no-pmc-fallback-disabled").when(F.col("last.outcome") == "service-error", "service-error").otherwise(F.coalesce(reason, F.lit("not-found"))).alias("reason"))


def citation_warnings(author: Column, roster: Column, asked_year: Column, year: Column) -> Column:
    """What does not fit a match: author_mismatch if no author of the roster has the surname asked for, year_mismatch if the first four digits in a row of the year asked for are others."""
    wrong_author = ~F.array_contains(F.transform(roster, surname), surname(author))
    wrong_year = F.regexp_extract(asked_year, r"\d{4}", 0) != year
    return F.array_compact(F.array(F.when(wrong_author, "author_mismatch"), F.when(wrong_year, "year_mismatch")))


def parse_match_reply(line: Column) -> Column:
    """A struct of key, status, matched_id and candidates from one line of the pipe-delimited match reply."""
    parts = F.split(line, r"\|")
    key, told = F.trim(F.get(parts, F.lit(5))), F.trim(F.get(parts, F.lit(6)))
    many = told.rlike("(?i)^AMBIGUOUS")
    ids = F.filter(F.transform(F.split(F.regexp_replace(told, "(?i)^AMBIGUOUS", ""), r"[,\s]+"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$"))
    return F.struct(
        key.alias("key"),
        F.when(told.rlike(r"^\d+$"), "matched").when(many, "ambiguous").otherwise("not_found").alias("status"),
        F.when(told.rlike(r"^\d+$"), told).alias("matched_id"),
        F.when(many & (F.size(ids) > 0), ids).alias("candidates"),
    )


def route(ids: DataFrame, crosswalk: DataFrame, key: str, target: str) -> DataFrame:
    """Ids with the crosswalk's target and the bucket they go to; ids the crosswalk lacks go to the fallback."""
    out = ids.join(crosswalk.select(key, target).dropDuplicates([key]), key, "left")
    return out.withColumn("bucket", F.when(F.col(target).isNotNull(), "archive").otherwise("fallback"))


def route_as_written(ids: DataFrame, crosswalk: DataFrame, written: str, key: Column, crosswalk_key: str, target: str) -> DataFrame:
    """Like route, for ids that come in several spellings: they meet by their normal form, and each keeps the spelling it was asked by. Ids without a normal form go to the fallback."""
    known = crosswalk.select(F.col(crosswalk_key).alias("_key"), target).dropDuplicates(["_key"])
    out = ids.withColumn("_key", key).join(known, "_key", "left").drop("_key")
    return out.select(written, *[c for c in out.columns if c not in (written, target)], target, F.when(F.col(target).isNotNull(), "archive").otherwise("fallback").alias("bucket"))


def fill(rows: DataFrame, crosswalk: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the column taken from the crosswalk where they lack it."""
    other = crosswalk.select(key, F.col(column).alias("_other")).dropDuplicates([key])
    return rows.join(other, key, "left").withColumn(column, F.coalesce(column, "_other")).drop("_other")


def first_seen(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """Each distinct value of a group with its index by first appearance, from 0."""
    first = rows.groupBy(group, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.select(group, value, (F.row_number().over(Window.partitionBy(group).orderBy("_at")) - 1).alias("idx"))
