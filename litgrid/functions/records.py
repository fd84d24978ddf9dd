"""Article records, brief summaries and vocabulary records from XML and JSON, by declared schemas and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions import text as T

_ID = "struct<_IdType:string,_VALUE:string>"
_NAMED = "struct<_UI:string,_MajorTopicYN:string,_VALUE:string>"
AUTHOR = "struct<LastName:string,ForeName:string,Initials:string,CollectiveName:string,Identifier:array<struct<_Source:string,_VALUE:string>>,AffiliationInfo:array<struct<Affiliation:string>>>"
RECORD = (
    "MedlineCitation struct<PMID:struct<_Version:string,_VALUE:string>,"
    "Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,"
    f"AuthorList:struct<Author:array<{AUTHOR}>>,"
    "Journal:struct<ISSN:array<struct<_IssnType:string,_VALUE:string>>,Title:string,ISOAbbreviation:string,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>,"
    "Pagination:struct<MedlinePgn:string>,ELocationID:array<struct<_EIdType:string,_ValidYN:string,_VALUE:string>>,"
    "PublicationTypeList:struct<PublicationType:array<struct<_UI:string,_VALUE:string>>>,"
    "GrantList:struct<Grant:array<struct<GrantID:string,Acronym:string,Agency:string,Country:string>>>,"
    "ArticleDate:array<struct<_DateType:string,Year:string,Month:string,Day:string>>>,"
    f"MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:{_NAMED},QualifierName:array<{_NAMED}>>>>,"
    "KeywordList:array<struct<Keyword:array<struct<_MajorTopicYN:string,_VALUE:string>>>>>, "
    f"PubmedData struct<ArticleIdList:struct<ArticleId:array<{_ID}>>>"
)

RECORD_OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _some(c: Column) -> Column:
    """An array without its null members; null if nothing is left."""
    kept = F.array_compact(c)
    return F.when(F.size(kept) > 0, kept)


def _first(c: Column, test) -> Column:
    return F.get(F.filter(c, test), F.lit(0))


def once(rows: DataFrame, name: str, c: Column) -> DataFrame:
    """Adds a column that is worked out once for each row, however many later columns use it: a generator is not written out into them."""
    return rows.select("*", F.explode(F.array(c)).alias(name))


def clean_xml(c: Column) -> Column:
    """Declarations and document types dropped and inline markup flattened, which the record schema cannot hold."""
    return T.flatten_inline(F.regexp_replace(c, r"(?s)<\?xml.*?\?>|<!DOCTYPE[^>]*>", ""))


def parse_records(rows: DataFrame, xml: str, mesh: bool = True, grants: bool = False) -> DataFrame:
    """One article for each row's record; malformed records give null fields and parse_failed."""
    parsed = once(rows, "_r", F.from_xml(clean_xml(F.col(xml)), RECORD, RECORD_OPTIONS))
    c, a = F.col("_r.MedlineCitation"), F.col("_r.MedlineCitation.Article")
    journal, issue = a["Journal"], a["Journal"]["JournalIssue"]
    authors, ids = a["AuthorList"]["Author"], F.col("_r.PubmedData.ArticleIdList.ArticleId")
    affiliations = F.array_distinct(F.flatten(F.transform(authors, lambda x: F.coalesce(F.transform(x["AffiliationInfo"], lambda i: i["Affiliation"]), F.array().cast("array<string>")))))
    people = F.transform(
        authors,
        lambda x: F.struct(
            _given(x["LastName"]).alias("last_name"),
            _given(x["ForeName"]).alias("first_name"),
            _given(x["Initials"]).alias("initials"),
            _given(x["CollectiveName"]).alias("collective_name"),
            F.regexp_extract(_first(x["Identifier"], lambda i: i["_Source"] == "ORCID")["_VALUE"], r"(\d{4}-\d{4}-\d{4}-[\dX]{4})", 1).alias("orcid"),
            F.transform(x["AffiliationInfo"], lambda i: F.array_position(affiliations, i["Affiliation"]) - 1).alias("affiliation_indices"),
        ),
    )
    by_type = lambda kind: _given(_first(ids, lambda i: i["_IdType"] == kind)["_VALUE"])
    is_doi = lambda e: e["_EIdType"] == "doi"
    location = a["ELocationID"]
    parts = F.transform(a["Abstract"]["AbstractText"], lambda p: F.when(_given(p["_Label"]).isNotNull(), F.concat(p["_Label"], F.lit(": "), F.coalesce(p["_VALUE"], F.lit("")))).otherwise(_given(p["_VALUE"])))
    headings = c["MeshHeadingList"]["MeshHeading"]
    major = lambda q: q["_MajorTopicYN"] == "Y"
    terms = F.transform(
        headings,
        lambda h: F.struct(
            h["DescriptorName"]["_VALUE"].alias("name"),
            h["DescriptorName"]["_UI"].alias("ui"),
            (F.coalesce(major(h["DescriptorName"]), F.lit(False)) | F.coalesce(F.exists(h["QualifierName"], major), F.lit(False))).alias("is_major"),
            F.transform(h["QualifierName"], lambda q: F.struct(q["_VALUE"].alias("name"), q["_UI"].alias("ui"), F.coalesce(major(q), F.lit(False)).alias("is_major"))).alias("qualifiers"),
        ),
    )
    issn = lambda kind: _given(_first(journal["ISSN"], lambda i: i["_IssnType"] == kind)["_VALUE"])
    columns = {
        "pmid": _given(c["PMID"]["_VALUE"]),
        "title": T.collapse(a["ArticleTitle"]),
        "abstract_text": _given(F.array_join(F.array_compact(parts), "\n\n")),
        "authors": people,
        "affiliations": _some(affiliations),
        "journal": _given(journal["Title"]),
        "iso_abbreviation": _given(journal["ISOAbbreviation"]),
        "issn": issn("Print"),
        "e_issn": issn("Electronic"),
        "volume": _given(issue["Volume"]),
        "issue": _given(issue["Issue"]),
        "pages": _given(a["Pagination"]["MedlinePgn"]),
        "year": T.year_of(_given(issue["PubDate"]["Year"]), issue["PubDate"]["MedlineDate"]),
        "month": _given(issue["PubDate"]["Month"]),
        "doi": F.coalesce(_given(_first(location, lambda e: is_doi(e) & (F.coalesce(e["_ValidYN"], F.lit("Y")) == "Y"))["_VALUE"]), _given(_first(location, is_doi)["_VALUE"]), by_type("doi")),
        "pmc_id": by_type("pmc"),
        "publication_types": _some(F.transform(a["PublicationTypeList"]["PublicationType"], lambda t: _given(t["_VALUE"]))),
        "keywords": _some(F.flatten(F.transform(c["KeywordList"], lambda k: F.transform(k["Keyword"], lambda w: _given(w["_VALUE"]))))),
        "article_dates": F.transform(a["ArticleDate"], lambda d: F.struct(d["_DateType"].alias("type"), d["Year"].alias("year"), d["Month"].alias("month"), d["Day"].alias("day"))),
        "parse_failed": F.col("_r").isNull() | c["PMID"]["_VALUE"].isNull(),
    }
    if mesh:
        columns["mesh"] = terms
        columns["mesh_terms"] = _some(F.transform(headings, lambda h: _given(h["DescriptorName"]["_VALUE"])))
    if grants:
        again = lambda g, f: T.decode_entities(g[f])
        columns["grants"] = F.transform(a["GrantList"]["Grant"], lambda g: F.struct(*(again(g, f).alias(f.lower()) for f in ("GrantID", "Acronym", "Agency", "Country"))))
    return parsed.select(*rows.columns, *(v.alias(k) for k, v in columns.items()))


_AUTHOR = "struct<_VALUE:string,Name:string,AuthType:string>"
_SUMMARY_ID = "struct<IdType:string,Value:string>"
DOCUMENT = f"_uid string, Title string, Source string, FullJournalName string, SO string, PubDate string, EPubDate string, DOI string, Authors struct<_VALUE:string,Author:array<{_AUTHOR}>>, ArticleIds struct<ArticleId:array<{_SUMMARY_ID}>>"
ITEMS = "Id string, Item array<struct<_Name:string,_Type:string,_VALUE:string,Item:array<struct<_Name:string,_Type:string,_VALUE:string>>>>"
XML_OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE"}


def _split_names(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def _names(listed: Column) -> Column:
    """Authors' names from structs that have them as text or as Name; blank ones go."""
    return F.filter(F.transform(listed, lambda a: F.coalesce(_given(a["_VALUE"]), _given(a["Name"]))), lambda n: n.isNotNull())


def _summary(uid: Column, title: Column, source: Column, pub: Column, epub: Column, names: Column, doi: Column, pmc: Column) -> dict[str, Column]:
    return {"uid": uid, "title": T.display_text(title), "source": source, "pub_date": T.standard_date(pub), "epub_date": T.standard_date(epub), "authors_display": T.author_display(F.when(F.size(names) > 0, names)), "doi": doi, "pmc_id": pmc}


def _project(parsed: DataFrame, rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return parsed.select(*rows.columns, *(v.alias(k) for k, v in columns.items()))


def _pick(members: Column, name: str) -> Column:
    """The first member of a map by its name in any casing."""
    return F.get(F.map_values(F.map_filter(members, lambda k, _: F.lower(k) == name)), F.lit(0))


def parse_summary_json(rows: DataFrame, json: str) -> DataFrame:
    """Brief summaries of the new shape in JSON, names in any casing: authors may be a list of names or objects, an object with one, or one delimited string."""
    first = once(rows, "_m", F.from_json(F.col(json), "map<string,string>"))
    m = F.col("_m")
    inner = lambda c, name: F.coalesce(_pick(F.when(F.trim(c).startswith("{"), F.from_json(c, "map<string,string>")), name), c)
    parsed = once(first, "_s", F.struct(inner(_pick(m, "authors"), "author").alias("authors"), inner(_pick(m, "articleids"), "articleid").alias("ids")))
    people, ids = F.col("_s.authors"), F.col("_s.ids")
    name = lambda t: F.when(t.startswith("{"), _pick(F.from_json(t, "map<string,string>"), "name")).otherwise(t)
    listed = F.filter(F.transform(F.from_json(people, "array<string>"), lambda t: _given(name(t))), lambda n: n.isNotNull())
    names = F.when(people.startswith("["), listed).when(people.startswith("{"), F.array_compact(F.array(_given(name(people))))).otherwise(_split_names(people))
    entries = F.from_json(F.when(ids.startswith("{"), F.concat(F.lit("["), ids, F.lit("]"))).otherwise(ids), "array<map<string,string>>")
    by_type = lambda kind: _given(_pick(_first(entries, lambda i: F.lower(_pick(i, "idtype")) == kind), "value"))
    field = lambda n: _given(_pick(m, n))
    return _project(parsed, rows, _summary(field("uid"), field("title"), F.coalesce(field("source"), field("fulljournalname"), field("so")), field("pubdate"), field("epubdate"), names, F.coalesce(field("doi"), by_type("doi")), by_type("pmc")))


def parse_summary_document(rows: DataFrame, xml: str) -> DataFrame:
    """Brief summaries of the new shape in XML; authors may be listed or one delimited text."""
    parsed = once(rows, "_s", F.from_xml(F.col(xml), DOCUMENT, XML_OPTIONS))
    s, ids = F.col("_s"), F.col("_s.ArticleIds.ArticleId")
    names = F.when(F.size(s["Authors"]["Author"]) > 0, _names(s["Authors"]["Author"])).otherwise(_split_names(s["Authors"]["_VALUE"]))
    by_type = lambda kind: _first(F.transform(F.filter(ids, lambda i: F.lower(i["IdType"]) == kind), lambda i: _given(i["Value"])), lambda v: v.isNotNull())
    return _project(parsed, rows, _summary(s["_uid"], s["Title"], F.coalesce(_given(s["Source"]), _given(s["FullJournalName"]), _given(s["SO"])), s["PubDate"], s["EPubDate"], names, F.coalesce(_given(s["DOI"]), by_type("doi")), by_type("pmc")))


def parse_summary_items(rows: DataFrame, xml: str) -> DataFrame:
    """Brief summaries of the old shape, a list of named items; those that are errors are skipped, the first of a name counts."""
    parsed = once(rows, "_s", F.from_xml(F.col(xml), ITEMS, XML_OPTIONS))
    s = F.col("_s")
    items = F.filter(s["Item"], lambda i: F.coalesce(i["_Type"], F.lit("")) != "ERROR")
    item = lambda name: _first(items, lambda i: i["_Name"] == name)["_VALUE"]
    people = F.transform(_first(items, lambda i: i["_Name"] == "AuthorList")["Item"], lambda i: F.trim(i["_VALUE"]))
    return _project(parsed, rows, _summary(s["Id"], item("Title"), F.coalesce(_given(item("Source")), _given(item("FullJournalName")), _given(item("SO"))), item("PubDate"), item("EPubDate"), F.filter(people, lambda n: F.coalesce(n != "", F.lit(False))), item("DOI"), F.lit(None).cast("string")))


def summary_shape(c: Column) -> Column:
    """error, json, document or items, by the outermost name; null for anything else."""
    return (
        F.when(c.rlike(r"(?is)^\s*(<\?xml.*?\?>\s*)?<(ERROR|eSummaryResult>\s*<ERROR)") | c.rlike(r'(?i)^\s*\{\s*"error"'), "error")
        .when(c.rlike(r"^\s*\{"), "json")
        .when(c.rlike(r"^\s*<DocumentSummary\b"), "document")
        .when(c.rlike(r"^\s*<DocSum\b"), "items")
    )


def parse_summaries(rows: DataFrame, raw: str) -> DataFrame:
    """Brief summaries of any shape; error payloads, other texts and summaries without an id give no row."""
    shaped = rows.withColumn("_shape", summary_shape(F.col(raw)))
    parts = [f(shaped.where(F.col("_shape") == shape), raw) for shape, f in (("json", parse_summary_json), ("document", parse_summary_document), ("items", parse_summary_items))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where(_given(F.col("uid")).isNotNull()).drop("_shape")


VOCABULARY = "Id string, Item array<struct<_Name:string,_VALUE:string,Item:array<struct<_Name:string,_VALUE:string,Item:array<struct<_Name:string,_VALUE:string>>>>>>"


def parse_vocabulary(rows: DataFrame, xml: str) -> DataFrame:
    """Vocabulary records from their raw item lists: uid, id (decoded), name (the first term, else the id), note, terms, trees without pointers."""
    parsed = once(rows, "_v", F.from_xml(F.col(xml), VOCABULARY, XML_OPTIONS))
    v = F.col("_v")
    item = lambda name: _first(v["Item"], lambda i: i["_Name"] == name)
    terms = F.transform(item("DS_MeshTerms")["Item"], lambda i: _given(i["_VALUE"]))
    links = item("DS_IdxLinks")["Item"]
    trees = F.transform(links, lambda s: _given(_first(s["Item"], lambda i: i["_Name"] == "TreeNum")["_VALUE"]))
    uid = v["Id"]
    return parsed.select(*rows.columns, F.inline(F.array(vocabulary_record(uid, F.coalesce(F.get(F.array_compact(terms), F.lit(0)), T.decode_uid(uid)), item("DS_ScopeNote")["_VALUE"], terms, trees))))


def vocabulary_record(uid: Column, name: Column, note: Column, terms: Column, trees: Column) -> Column:
    """A vocabulary record as a struct: its decoded id, name, note, entry terms and tree numbers without pointers."""
    return F.struct(uid.alias("uid"), T.decode_uid(uid).alias("id"), name.alias("name"), _given(note).alias("note"), _some(F.transform(terms, _given)).alias("terms"), _some(F.filter(trees, lambda t: ~t.startswith("@"))).alias("trees"))
