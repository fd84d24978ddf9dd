"""Typed filters compiled to one predicate, notices and the notes that go with a page of results."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions.text import date_bounds, string_list


@dataclass
class Fields:
    """The columns of a table of records that the filters use; a filter on a column that is not there is an error."""

    id: str = "id"
    title: str = "title"
    date: str = "date"
    types: str = "types"
    authors: str = "authors"
    journal: str = "journal"
    terms: str = "terms"
    language: str = "language"
    abstract: str = "abstract"
    source: str = "source"


@dataclass
class Search:
    """The parameters of a search; each clause is left out where its parameter is empty."""

    query: str = ""
    min_date: str | None = None
    max_date: str | None = None
    types: list[str] = field(default_factory=list)
    author: str | None = None
    journal: str | None = None
    terms: list[str] = field(default_factory=list)
    language: str | None = None
    has_abstract: bool = False
    free_full_text: bool = False
    species: str | None = None
    sources: list[str] = field(default_factory=list)
    sort: str = "relevance"
    offset: int = 0
    limit: int = 20
    summaries: int = 0


def lits(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def any_of(c: Column, values: list[str]) -> Column:
    return F.arrays_overlap(c, lits(values))


def all_of(c: Column, values: list[str]) -> Column:
    return F.size(F.array_except(lits(values), c)) == 0


def date_range(c: Column, lo: str | None, hi: str | None) -> Column | None:
    """Both bounds or no clause at all; partial dates are widened to their first and last day."""
    if not (lo and hi):
        return None
    a, b = date_bounds(lo, hi)
    return (c >= F.lit(a).cast("timestamp_ntz")) & (c < F.date_add(F.lit(b).cast("date"), 1).cast("timestamp_ntz"))


def clauses(s: Search, f: Fields) -> list[Column]:
    """The clauses in their fixed order; free full text is a join and not among them."""
    found = [
        parse_query(s.query, f) if s.query.strip() else None,
        date_range(F.col(f.date), s.min_date, s.max_date),
        any_of(F.col(f.types), s.types) if s.types else None,
        F.exists(f.authors, lambda a: F.contains(F.lower(a), F.lower(F.lit(s.author)))) if s.author else None,
        F.lower(F.col(f.journal)) == F.lower(F.lit(s.journal)) if s.journal else None,
        all_of(F.col(f.terms), s.terms) if s.terms else None,
        F.col(f.language) == s.language if s.language else None,
        has_text(F.col(f.abstract)) if s.has_abstract else None,
        F.array_contains(f.terms, s.species) if s.species else None,
        F.col(f.source).isin(*s.sources) if s.sources else None,
    ]
    return [c for c in found if c is not None]


def has_text(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


_CLAUSE = re.compile(r'\s+AND\s+|\s+OR\s+|\(|\)|"([^"]*)"\[(\w+)\]|([^\s()"\[\]]+)\[(\w+)\]|([^\s()]+)')


def parse_query(text: str, f: Fields) -> Column:
    """Query text as a predicate: `"x"[Field]`, `x[Field]`, AND, OR and parentheses; other words are searched in the title."""
    by_name = {"author": lambda v: F.exists(f.authors, lambda a: F.contains(F.lower(a), F.lit(v.lower()))), "journal": lambda v: F.lower(F.col(f.journal)) == v.lower(), "mesh": lambda v: F.array_contains(f.terms, v), "language": lambda v: F.col(f.language) == v, "title": lambda v: F.contains(F.lower(F.col(f.title)), F.lit(v.lower())), "type": lambda v: F.array_contains(f.types, v)}

    def term(m: re.Match) -> Column:
        phrase, kind, word, kind2, free = m.groups()
        value, kind = (phrase, kind) if kind else (word, kind2) if kind2 else (free, "title")
        if kind.lower() not in by_name:
            raise ValueError(f"unknown field: {kind}")
        return by_name[kind.lower()](value)

    tokens = [m for m in _CLAUSE.finditer(text) if m.group().strip()]
    at = 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at].group().strip() == "OR":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = one()
        while at < len(tokens) and tokens[at].group().strip() not in ("OR", ")"):
            if tokens[at].group().strip() == "AND":
                at += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"the query ends too early: {text}")
        m = tokens[at]
        at += 1
        if m.group() != "(":
            return term(m)
        out = either()
        if at >= len(tokens) or tokens[at].group() != ")":
            raise ValueError(f"a parenthesis is not closed: {text}")
        at += 1
        return out

    out = either()
    if at < len(tokens):
        raise ValueError(f"not understood from {tokens[at].group()!r} on: {text}")
    return out


def search(records: DataFrame, s: Search, f: Fields, full_text: DataFrame | None = None) -> DataFrame:
    """All records that match. full_text: a table with the id column of those free to read."""
    found = records.where(reduce(lambda a, b: a & b, clauses(s, f), F.lit(True)))
    if s.free_full_text:
        if full_text is None:
            raise ValueError("free_full_text needs a table of full texts")
        found = found.join(full_text.select(f.id), f.id, "left_semi")
    return found


#: The last row that a page may begin at.
LAST_OFFSET = 9998
SORTS = ("relevance", "pub_date", "author", "journal")


def order_of(s: Search, f: Fields) -> list[Column]:
    """The total order of a sort mode: rows without the value last, ties by id."""
    if s.sort not in SORTS:
        raise ValueError(f"sort: one of {', '.join(SORTS)}")
    if s.sort == "relevance":
        words = [w for w in re.findall(r"\w+", re.sub(r"\[\w+\]", " ", s.query)) if w not in ("AND", "OR")]
        first = F.desc(relevance(F.col(f.title), words)) if words else None
    else:
        first = {"pub_date": lambda: F.col(f.date).desc_nulls_last(), "author": lambda: F.lower(F.get(F.col(f.authors), F.lit(0))).asc_nulls_last(), "journal": lambda: F.lower(F.col(f.journal)).asc_nulls_last()}[s.sort]()
    return [c for c in (first, F.col(f.id).asc()) if c is not None]


def results(records: DataFrame, s: Search, f: Fields, full_text: DataFrame | None = None) -> DataFrame:
    """The page of a search that its sort, offset and limit ask for, with pos (from 1 within the page) and summarised (the first
    `summaries` rows, whose summaries are fetched)."""
    if not 0 <= s.offset <= LAST_OFFSET:
        raise ValueError(f"offset: 0 to {LAST_OFFSET}")
    order = order_of(s, f)
    page = search(records, s, f, full_text).orderBy(*order).offset(s.offset).limit(s.limit)
    # a page is bounded by its limit
    placed = page.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    return placed.withColumn("summarised", F.col("pos") <= min(s.summaries, s.limit))


def total_rows(found: DataFrame, page: DataFrame) -> DataFrame:
    """n_matched before paging and n_returned, as one row."""
    return found.agg(F.count("*").alias("n_matched")).crossJoin(page.agg(F.count("*").alias("n_returned")))


def diagnostics(errors: dict[str, Column], warnings: dict[str, Column]) -> dict[str, Column]:
    """ignored_fields and unmatched_phrases: the members of both lists in order, repeats included. Each list may be null; members are JSON values or lists of them."""
    none = F.array().cast("array<string>")
    part = lambda source, name: F.coalesce(string_list(source[name]), none) if name in source else none
    return {
        "ignored_fields": F.concat(part(errors, "FieldNotFound"), part(warnings, "FieldNotFound")),
        "unmatched_phrases": F.concat(part(errors, "PhraseNotFound"), part(warnings, "PhraseNotFound"), part(warnings, "QuotedPhraseNotFound")),
    }


def diagnostic_notice(ignored_fields: Column, unmatched_phrases: Column) -> Column:
    """What the lists mean for the results; empty if there are none."""
    quoted = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    return F.concat_ws(
        " ",
        F.when(F.size(ignored_fields) > 0, F.concat(F.lit("Unknown field tags, searched as free text: "), quoted(ignored_fields), F.lit("."))),
        F.when(F.size(unmatched_phrases) > 0, F.concat(F.lit("Nothing matched: "), quoted(unmatched_phrases), F.lit("."))),
    )


def relevance(text: Column, words: list[str]) -> Column:
    """How many of the words a text has."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def notice(total: Column, returned: Column, offset: Column, filtered: Column, one_sided: Column) -> Column:
    """All notes that apply, with a space between."""
    return F.concat_ws(
        " ",
        F.when(one_sided, "Date range ignored: both bounds are needed."),
        F.when((total == 0) & filtered, "No results: try fewer filters."),
        F.when((total == 0) & ~filtered, "No results: try other words."),
        F.when((total > 0) & (offset >= total), F.concat(F.lit("Offset "), offset.cast("string"), F.lit(" is beyond the "), total.cast("string"), F.lit(" results."))),
        F.when((returned > 0) & (offset + returned < total), F.concat(F.lit("More results from offset "), (offset + returned).cast("string"), F.lit("."))),
    )


def exactly_one(**inputs: object) -> str:
    """The name of the only input given."""
    given = [k for k, v in inputs.items() if v]
    if len(given) != 1:
        raise ValueError(f"exactly one of {', '.join(inputs)} is needed, not {len(given)}")
    return given[0]


def only_given(*names: str) -> Column:
    """The name of the only one of these columns that holds something, a blank text or an empty list being nothing; null where none or several do."""
    given = lambda n: F.coalesce(F.length(F.trim(F.col(n).cast("string"))) > 0, F.lit(False))
    n = reduce(lambda a, b: a + b, (given(x).cast("int") for x in names))
    return F.when(n == 1, F.coalesce(*(F.when(given(x), x) for x in names)))


def suggestions(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """word, corrected: the nearest dictionary entry within `most` edits, ties in alphabetical order; else the word itself.

    Entries are matched by length, which may differ by `most` at most, so this is an equi-join on lengths and not a cross join.
    """
    lengths = F.explode(F.sequence(F.greatest(F.length("word") - most, F.lit(0)), F.length("word") + most))
    near = words.select("word", lengths.alias("n")).join(dictionary.select("entry", F.length("entry").alias("n")).distinct(), "n")
    near = near.withColumn("d", F.levenshtein("word", "entry")).where(F.col("d") <= most)
    best = near.groupBy("word").agg(F.min(F.struct("d", "entry")).alias("best"))
    return words.join(best, "word", "left").select("word", F.coalesce("best.entry", "word").alias("corrected"))
