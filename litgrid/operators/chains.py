"""Chains of sources: what each tier said of each id, open-access locations, crosswalk replies, coverage fallbacks and their caps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.sources.tables import dealt

# fixed values: why an identifier has no open-access copy, and how many candidates a provider is asked to resolve
NO_OA = {"invalid": "Invalid DOI", "unknown": "DOI unknown to the index", "malformed": "Invalid DOI format", "closed": "No open-access copy indexed", "unusable": "OA flagged but no usable location URL"}
RELATED_CAP, REFERENCES_CAP, PAGE_CAP = 50, 200, 100
LOCATION = "struct<url:string,url_for_pdf:string,host_type:string,license:string,version:string>"


@dataclass
class Tier:
    """A source of full texts. rows: the key, payload (null or blank: there is a record but no text), n_sections (0: front matter
    only; null: not counted) and failed (true: the source failed for it); None: the source is not configured."""

    name: str
    rows: DataFrame | None


def bodyless(n_sections: Column) -> Column:
    """A record that came without a single section of its body."""
    return F.coalesce(n_sections == 0, F.lit(False))


def oa_resolve(rows: DataFrame) -> DataFrame:
    """rows: doi, status (of the index's reply: 200, 404 or 422; null: not asked), is_oa, best (a location) and locations.

    Adds doi normalised, kind (found or no-oa), reason, and the fields of the location: the best one, else the first.
    """
    location = F.coalesce("best", F.get("locations", F.lit(0)))
    normal = T.doi(F.col("doi"))
    why = (
        F.when(normal.isNull(), NO_OA["invalid"])
        .when(F.col("status") == 404, NO_OA["unknown"])
        .when(F.col("status") == 422, NO_OA["malformed"])
        .when(~F.coalesce("is_oa", F.lit(False)), NO_OA["closed"])
        .when(F.coalesce(F.trim(location["url"]) == "", F.lit(True)), NO_OA["unusable"])
    )
    fields = {f: F.when(why.isNull(), location[f]) for f in ("url", "url_for_pdf", "host_type", "license", "version")}
    rest = [c for c in rows.columns if c not in ("doi", "status", "is_oa", "best", "locations")]
    return rows.select(*rest, normal.alias("doi"), F.when(why.isNull(), "found").otherwise("no-oa").alias("kind"), why.alias("reason"), *(v.alias(k) for k, v in fields.items()))


def oa_body(rows: DataFrame) -> DataFrame:
    """rows: url, url_for_pdf, license, host_type, version, body. Adds content_format, source_url, content, title, word_count and outcome.

    The body of a page is its text; what was extracted from a PDF comes as it is. An empty result is `parse-failed`, a body
    that could not be fetched (null) `fetch-failed`.
    """
    kind = T.content_kind(F.col("url_for_pdf"), F.col("body"))
    content = F.when(kind == "html", T.html_text(F.col("body"))).otherwise(F.trim(F.regexp_replace("body", r"^%PDF\S*\s*", "")))
    title = F.nullif(T.collapse(F.regexp_extract("body", r"(?is)<title>(.*?)</title>", 1)), F.lit(""))
    parsed = rows.withColumns({"_kind": kind, "_content": content})
    fine = F.col("_content").isNotNull() & (F.col("_content") != "")
    return parsed.select(
        *rows.columns,
        F.when(F.col("body").isNull(), "fetch-failed").when(~fine, "parse-failed").otherwise("found").alias("outcome"),
        F.when(fine, F.when(F.col("_kind") == "pdf", "pdf-text").otherwise("html-markdown")).alias("content_format"),
        F.when(fine, F.when(F.col("_kind") == "pdf", F.coalesce("url_for_pdf", "url")).otherwise(F.col("url"))).alias("source_url"),
        F.when(fine, F.col("_content")).alias("content"),
        F.when(fine & (F.col("_kind") == "html"), title).alias("title"),
        F.when(fine & (F.col("_kind") == "html"), F.size(F.split("_content", " "))).alias("word_count"),
    )


CROSSWALK = "struct<`requested-id`:string,pmid:string,pmcid:string,doi:string,errmsg:string>"


def crosswalk_key(c: Column, kind: str) -> Column:
    """An id as the crosswalk knows it: bare digits of a full-text id get their prefix, a DOI loses its address."""
    c = F.trim(c)
    return F.when(c.rlike(r"^\d+$"), T.pmcid(c)).otherwise(F.upper(c)) if kind == "pmcid" else F.coalesce(T.doi(c), c) if kind == "doi" else c


def parse_crosswalk(rows: DataFrame, json: str) -> DataFrame:
    """A row for each record of a crosswalk reply: requested_id, pmid, pmcid, doi, errmsg. A reply without records gives none."""
    records = F.inline(F.from_json(json, f"struct<records:array<{CROSSWALK}>>")["records"])
    return rows.select(*rows.columns, records).withColumnRenamed("requested-id", "requested_id")


def convert_report(converted: DataFrame, errmsg: str = "errmsg") -> DataFrame:
    """n_submitted, n_converted (those without a message)."""
    return converted.agg(F.count("*").alias("n_submitted"), F.count_if(F.col(errmsg).isNull()).alias("n_converted"))


def matched_ids(matches: DataFrame, id_column: str = "matched_id") -> DataFrame:
    """The ids to look up summaries for, each once."""
    return matches.where(F.col(id_column).isNotNull()).select(id_column).distinct()


def link_id(pmid: Column, source: Column, record: Column) -> Column:
    """The article id of a citing or cited record: its own, else the record's id in the source whose ids are article ids; digits only."""
    found = F.trim(F.coalesce(pmid, F.when(source == "MED", record)))
    return F.when(found.rlike(r"^\d+$"), found)


def work_ids(addresses: Column) -> Column:
    """Ids of works from their addresses in a graph, or bare as they are."""
    return F.transform(addresses, lambda w: F.regexp_replace(w, "^https?://[^/]+/", ""))


def capped(candidates: Column, wanted: int, cap: int) -> Column:
    """As many candidates as a provider resolves for `wanted` results: three for each, and no more than its cap."""
    return F.slice(candidates, 1, min(3 * wanted, cap))


def coverage_fallback(asked: DataFrame, key: str, primary: DataFrame, articles: DataFrame, fallbacks: list[tuple[str, DataFrame]], relationship: str) -> DataFrame:
    """Links of each record asked for, with their provider; `fallback` where it was not the first one.

    The fallbacks are asked in turn, for references only, and only for records the first provider has no links of and whose
    article is known by a title: of others nothing is known, and the empty answer stays.
    """
    wanted = dealt(asked.select(key), key).distinct()
    out = primary.join(wanted, key, "left_semi").withColumns({"provider": F.lit("first"), "fallback": F.lit(None).cast("string")})
    if relationship != "references":
        return out
    known = dealt(articles.where(F.col("title").isNotNull() & (F.trim("title") != "")).select(key), key).distinct()
    left = wanted.join(primary.select(key).distinct(), key, "left_anti").join(known, key, "left_semi")
    for name, links in fallbacks:
        own = links.join(left, key, "left_semi").withColumns({"provider": F.lit(name), "fallback": F.lit("references_coverage")})
        out = out.unionByName(own)
        left = left.join(own.select(key).distinct(), key, "left_anti")
    return out
