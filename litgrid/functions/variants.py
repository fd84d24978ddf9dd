"""Brief summaries as VARIANT: parsed once, whatever their shape, and asked for members in any casing, one value or many.

A reply may be one summary, a list of them, or an object of them under `result`; members may be written in any casing, and a
member that can be many may stand there alone. Values are taken from the parsed variant, never from the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.functions.records import once

#: Casings in which members are written.
CASINGS = (lambda n: n, str.lower, str.upper, str.title, lambda n: n[:1].upper() + n[1:])


def parsed(rows: DataFrame, json: str, name: str = "v") -> DataFrame:
    """Adds the variant of a JSON text, null where it is none; worked out once a row."""
    return once(rows, name, F.try_parse_json(json))


def member(v: Column, *names: str, kind: str = "string") -> Column:
    """The first of these members that there is, in any of the casings; blank strings are none."""
    paths = dict.fromkeys(f"$.{case(n)}" for n in names for case in CASINGS)
    found = [F.try_variant_get(v, p, kind) for p in paths]
    return F.coalesce(*(F.nullif(F.trim(f), F.lit("")) for f in found)) if kind == "string" else F.coalesce(*found)


def many(v: Column, *names: str) -> Column:
    """A member that is one value or a list of them, as an array of variants; an object with the list under a member of its own name's singular counts as the list."""
    inner = member(v, *names, kind="variant")
    nested = F.coalesce(*(member(inner, n[:-1], kind="variant") for n in names if n.endswith("s")))
    whole = F.coalesce(nested, inner)
    return F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>")).when(whole.isNotNull() & ~F.is_variant_null(whole), F.array(whole))


def summaries(rows: DataFrame, json: str) -> DataFrame:
    """uid, title, source, pub_date, authors, doi of each summary in a reply; errors and summaries without an id give no row.

    A reply is a summary, a list of summaries, or has them under `result`. Authors are strings, objects with a name, or one
    string with delimiters. Text that is no JSON gives no row.
    """
    with_v = parsed(rows, json, "_v").drop(json)
    v = F.col("_v")
    listed = F.coalesce(F.try_variant_get(v, "$.result", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.when(F.try_variant_get(v, "$.error", "string").isNull(), F.array(v)))
    each = with_v.select(*[c for c in with_v.columns if c != "_v"], F.explode(listed).alias("_s"))
    s = F.col("_s")
    people = F.flatten(F.transform(many(s, "Authors"), lambda a: F.coalesce(_named(a), F.array().cast("array<string>"))))
    names = F.filter(F.transform(people, lambda n: F.trim(n)), lambda n: n != "")
    of_doi = F.filter(F.transform(many(s, "ArticleIds"), lambda i: F.when(F.lower(member(i, "IdType")) == "doi", member(i, "value"))), lambda x: x.isNotNull())
    out = each.select(
        *[c for c in each.columns if c != "_s"],
        member(s, "uid").alias("uid"),
        T.display_text(member(s, "title")).alias("title"),
        member(s, "source", "FullJournalName", "SO").alias("source"),
        T.standard_date(member(s, "PubDate")).alias("pub_date"),
        F.array_join(names, "; ").alias("authors"),
        F.coalesce(member(s, "doi"), F.get(of_doi, F.lit(0))).alias("doi"),
    )
    return out.where("uid IS NOT NULL")


def _named(a: Column) -> Column:
    """The names of a member of the authors: an object's name, or those in a string between delimiters."""
    text = F.coalesce(member(a, "name"), F.try_variant_get(a, "$", "string"))
    return F.split(text, "[;,]")
