"""Fitting the sections of texts into character budgets: prefix by prefix, or by even shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions.text import utf16_length, utf16_slice


def truncate(sections: DataFrame, article: str, order: str, size: str, budget: int, cap: int | None = None) -> DataFrame:
    """Adds kept: what each section gets in document order, until the budget is used up."""
    want = F.least(F.col(size), F.lit(cap)) if cap is not None else F.col(size)
    before = Window.partitionBy(article).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = sections.withColumn("_want", want)
    left = F.lit(budget) - F.coalesce(F.sum("_want").over(before), F.lit(0))
    return rows.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("_want"), left)).cast("int")).drop("_want")


def outline(sections: DataFrame, article: str, order: str, size: str, budget: int) -> DataFrame:
    """Adds kept: equal shares of the budget, what short sections leave shared again, the last characters in document order."""
    ranked = Window.partitionBy(article).orderBy(size, order)
    whole = Window.partitionBy(article)
    rows = (
        sections.withColumn("_k", F.row_number().over(ranked))
        .withColumn("_n", F.count("*").over(whole))
        .withColumn("_pre", F.coalesce(F.sum(size).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    # the level is where the first section no longer fits: all before it are whole, the rest share what is left
    over = F.col("_pre") + F.col(size) * (F.col("_n") - F.col("_k") + 1) > budget
    share = F.floor((F.lit(budget) - F.col("_pre")) / (F.col("_n") - F.col("_k") + 1))
    rows = rows.withColumn("_level", F.min_by(F.when(over, share), F.when(over, F.col("_k"))).over(whole))
    rows = rows.withColumn("_base", F.when(F.col("_level").isNull(), F.col(size)).otherwise(F.least(F.col(size), F.col("_level"))))
    rows = rows.withColumn("_rest", F.when(F.col("_level").isNull(), F.lit(0)).otherwise(F.lit(budget) - F.sum("_base").over(whole)))
    more = (F.col(size) > F.col("_base")).cast("int")
    rows = rows.withColumn("_turn", F.sum(more).over(Window.partitionBy(article).orderBy(order)))
    kept = F.col("_base") + F.when((more == 1) & (F.col("_turn") <= F.col("_rest")), 1).otherwise(0)
    return rows.withColumn("kept", kept.cast("int")).drop("_k", "_n", "_pre", "_level", "_base", "_rest", "_turn")


def fill_fields(fields: DataFrame, section: list[str], order: str, size: str, allowance: str) -> DataFrame:
    """Adds kept: what a section's own text and then its subsections get of the section's allowance."""
    before = Window.partitionBy(*section).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(allowance) - F.coalesce(F.sum(size).over(before), F.lit(0))
    return fields.withColumn("kept", F.greatest(F.lit(0), F.least(F.col(size), left)).cast("int"))


def filter_sections(sections: Column, terms: list[str]) -> Column:
    """Sections whose title has one of the terms in it, in any case; those without a title never match."""
    hit = lambda s: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(s["title"]), F.lower(t)))
    return F.filter(sections, lambda s: F.coalesce(F.trim(s["title"]) != "", F.lit(False)) & F.coalesce(hit(s), F.lit(False)))


def filter_miss(before: Column, after: Column) -> Column:
    """Whether a filter took all sections of an article that has some; one without any is body-less, which is something else."""
    return (F.size(before) > 0) & (F.size(after) == 0)


def first_sections(sections: Column, most: int) -> Column:
    return F.slice(sections, 1, most)


def content_budget(content: Column, limit: int) -> tuple[Column, Column, Column]:
    """One text cut to a number of UTF-16 units: what is kept, and the units before and after; those are null where nothing was cut."""
    n = utf16_length(content)
    kept = utf16_slice(content, limit)
    over = n > limit
    return kept, F.when(over, n), F.when(over, utf16_length(kept))


def report(budgeted: DataFrame, article: str, size: str) -> DataFrame:
    """Per article: sections, characters before and after, sections dropped and cut."""
    return budgeted.groupBy(article).agg(
        F.count("*").alias("n_sections"),
        F.sum(size).cast("long").alias("total_chars"),
        F.sum("kept").cast("long").alias("kept_chars"),
        F.count_if((F.col("kept") == 0) & (F.col(size) > 0)).alias("n_dropped"),
        F.count_if((F.col("kept") > 0) & (F.col("kept") < F.col(size))).alias("n_cut"),
    )


def cut(text: Column, kept: Column) -> Column:
    """What of a text a budget of UTF-16 units keeps, never half of a pair."""
    return utf16_slice(text, kept)
