"""Every field of records, full texts, summaries and vocabularies over rows rendered from the shared tables; search by every clause and order."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import jats, records
from litgrid.functions import text as T
from litgrid.operators import paging
from litgrid.operators import resolve as R
from litgrid.operators import search as S
from litgrid.session import shared_folder
from litgrid.sources import tables
from litgrid.sources.tables import spread, table
from litgrid.streaming import flow, replies

def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _keys() -> tuple[Column, Column]:
    """The number of an order and of its customer."""
    return F.col("o_orderkey"), F.col("o_custkey")


def _join(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").where("o_orderkey % 4 < 2"))


def record_xml() -> Column:
    k, c = _keys()
    day = lambda f: F.date_format("o_orderdate", f)
    return _join(
        '<PubmedArticle><MedlineCitation><PMID Version="1">', k, "</PMID><Article><ArticleTitle>T ", k, '</ArticleTitle><Abstract><AbstractText Label="AIM">Why ', c,
        ".</AbstractText><AbstractText>How.</AbstractText></Abstract><AuthorList><Author><LastName>L", c, '</LastName><ForeName>F</ForeName><Initials>F</Initials><Identifier Source="ORCID">https://orcid.org/0000-0001-0002-000X</Identifier><AffiliationInfo><Affiliation>Inst ', c % 5,
        "</Affiliation></AffiliationInfo></Author><Author><CollectiveName>Group ", c % 3, "</CollectiveName><AffiliationInfo><Affiliation>Inst 1</Affiliation></AffiliationInfo></Author></AuthorList>",
        '<PublicationTypeList><PublicationType UI="a">', F.col("o_orderpriority"), "</PublicationType>", F.when(k % 2 == 1, '<PublicationType UI="b">Review</PublicationType>').otherwise(""), "</PublicationTypeList>",
        F.when(k % 3 == 0, _join("<GrantList><Grant><GrantID>R", k, " &amp;amp; 2</GrantID><Acronym>HL</Acronym><Agency>A</Agency><Country>C</Country></Grant></GrantList>")).otherwise(""),
        '<ArticleDate DateType="Electronic"><Year>', day("yyyy"), "</Year><Month>", day("MM"), "</Month><Day>", day("dd"), "</Day></ArticleDate></Article>",
        '<MeshHeadingList><MeshHeading><DescriptorName UI="D', c % 7, '" MajorTopicYN="', F.when(c % 4 == 0, "Y").otherwise("N"), '">Term ', c % 7, '</DescriptorName><QualifierName UI="Q1" MajorTopicYN="', F.when(c % 5 == 0, "Y").otherwise("N"), '">q</QualifierName></MeshHeading>',
        '<MeshHeading><DescriptorName UI="D9" MajorTopicYN="N">Two</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>',
    )


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts by parts, types, grants decoded twice, dates, headings with their major flag, persons and groups with their affiliations."""
    k, _ = _keys()
    r = records.parse_records(_orders(spark, sf_dir).select(k, record_xml().alias("xml")), "xml", grants=True)
    joined = lambda c, f, by="|": F.array_join(F.transform(c, f), by)
    return r.select(
        "o_orderkey",
        "pmid",
        "abstract_text",
        F.array_join("publication_types", "|").alias("types"),
        joined("grants", lambda g: F.concat_ws("/", g["grantid"], g["acronym"], g["agency"], g["country"])).alias("grants"),
        joined("article_dates", lambda d: F.concat_ws(" ", d["type"], F.concat_ws("-", d["year"], d["month"], d["day"]))).alias("dates"),
        joined("mesh", lambda m: F.concat_ws(" ", m["ui"], m["name"], m["is_major"].cast("string"), F.size(m["qualifiers"]).cast("string"))).alias("mesh"),
        joined("authors", lambda a: F.concat_ws(" ", a["last_name"], a["collective_name"], a["orcid"], F.array_join(a["affiliation_indices"].cast("array<string>"), ","))).alias("authors"),
        F.array_join("affiliations", "|").alias("affiliations"),
        F.exists("mesh", lambda m: m["is_major"]).alias("any_major"),
    )


def jats_xml() -> Column:
    k, c = _keys()
    year = F.year("o_orderdate")
    return _join(
        '<article article-type="review"><front><journal-meta><journal-title-group><journal-title>J of ', F.col("o_orderpriority"), "</journal-title></journal-title-group><issn>1111-2222</issn></journal-meta><article-meta>",
        '<article-id pub-id-type="pmc">', k, '</article-id><article-id pub-id-type="doi">10.1/', k, "</article-id><title-group><article-title>On <italic>X</italic> ", k, "</article-title></title-group>",
        '<contrib-group><contrib contrib-type="author"><name><surname>Doe', c, '</surname><given-names>J</given-names></name></contrib><contrib contrib-type="author"><collab>Group ', c % 3, '</collab></contrib><contrib contrib-type="editor"><name><surname>No</surname></name></contrib></contrib-group>',
        '<aff id="a1">Inst ', c % 5, '</aff><aff id="a2">Inst B</aff><pub-date pub-type="ppub"><year>', year - 1, "</year></pub-date>", F.when(k % 2 == 0, _join('<pub-date pub-type="epub"><day>5</day><month>3</month><year>', year, "</year></pub-date>")).otherwise(""),
        "<volume>7</volume><issue>2</issue><fpage>10</fpage><lpage>12</lpage><abstract><p>Short ", c, ".</p></abstract><kwd-group><kwd>k", c % 4, "</kwd><kwd>k9</kwd></kwd-group></article-meta></front><body><p>x</p></body>",
        '<back><ref-list><ref id="r1"><label>1</label><element-citation><person-group><name><surname>Doe</surname><given-names>J</given-names></name><etal/></person-group><article-title>On Y</article-title><source>Cell</source><year>', year, '</year><pub-id pub-id-type="pmid">', c, "</pub-id></element-citation></ref>",
        '<ref id="r2"><mixed-citation>As <i>written</i> in ', year, '.</mixed-citation></ref><ref id="r3"><label>3</label></ref></ref-list></back></article>',
    )


def jats_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full text's front matter and references; a reference without any text is none."""
    k, _ = _keys()
    a = jats.parse_articles(_orders(spark, sf_dir).select(k, jats_xml().alias("xml")), "o_orderkey", "xml")
    people = F.transform("authors", lambda p: F.coalesce(p["collective_name"], F.concat_ws(" ", p["last_name"], p["first_name"])))
    refs = F.transform("references", lambda r: F.concat_ws("=", r["id"], r["citation"]))
    joined = {"keywords": F.col("keywords"), "affiliations": F.col("affiliations"), "authors": people, "refs": refs}
    return a.select("o_orderkey", "pmcid", "doi", "title", "journal", "issn", F.concat("volume", F.lit("("), "issue", F.lit("):"), "pages").alias("place"), "pub_date", "abstract_text", *(F.array_join(c, "|").alias(n) for n, c in joined.items()))


def vocabulary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary records of parts in item lists: entry terms, notes, tree numbers without pointers; every third has no term."""
    k = F.col("p_partkey")
    uid = _join(F.when(k % 2 == 0, "68").otherwise("67"), F.lpad(k.cast("string"), 6, "0"))
    text = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    terms = F.when(k % 3 > 0, _join('<Item Name="DS_MeshTerms" Type="List"><Item Name="string" Type="String">', text(F.col("p_name")), '</Item><Item Name="string" Type="String">', text(F.col("p_brand")), "</Item></Item>")).otherwise("")
    link = lambda x: _join('<Item Name="s" Type="Structure"><Item Name="Parent" Type="Integer">1</Item><Item Name="TreeNum" Type="String">', x, "</Item></Item>")
    xml = _join("<DocSum><Id>", uid, '</Id><Item Name="DS_ScopeNote" Type="String">', F.when(k % 4 > 0, _join("Note ", k)).otherwise(""), "</Item>", terms, '<Item Name="DS_IdxLinks" Type="List">', link(_join("C04.", k % 10)), link(_join("@", k)), "</Item></DocSum>")
    out = records.parse_vocabulary(spread(table(spark, sf_dir, "part")).select("p_partkey", xml.alias("xml")), "xml")
    return out.select("p_partkey", "uid", "id", "name", "note", F.array_join("terms", "|").alias("terms"), F.array_join("trees", "|").alias("trees"))


def summary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries in JSON, as a document, as items; errors, other texts and what has no id give no row."""
    k, c = _keys()
    day = F.date_format("o_orderdate", "yyyy MMM d")
    json = _join('{"uid":"', k, '","title":"T ', c, '","source":"J","pubdate":"', day, '","authors":"A B; C D"}')
    document = _join('<DocumentSummary uid="', k, '"><Title>T &lt;b&gt;', c, "&lt;/b&gt;</Title><SO>S4</SO><PubDate>", day, "</PubDate><Authors><Author><Name>K L</Name></Author><Author>M N</Author></Authors></DocumentSummary>")
    items = _join("<DocSum><Id>", k, '</Id><Item Name="Title" Type="String">T ', c, '</Item><Item Name="FullJournalName" Type="String">FJ</Item><Item Name="PubDate" Type="Date">', day, '</Item><Item Name="AuthorList" Type="List"><Item Name="Author" Type="String">U V</Item></Item></DocSum>')
    raw = F.get(F.array(json, document, items, F.lit("<ERROR>Empty id list</ERROR>"), F.lit('{"error":"bad"}'), F.lit('{"title":"x"}'), F.lit("something else")), (c % 7).cast("int"))
    out = records.parse_summaries(_orders(spark, sf_dir).select(k, raw.alias("raw")), "raw")
    return out.select("o_orderkey", "uid", "title", "source", "pub_date", F.col("authors_display").alias("authors"))


def id_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of id each page's number is in four forms, its addresses and a flag."""
    k = F.col("page_id")
    raw = F.get(F.array(_join(k), _join("pmc", k), _join("https://doi.org/10.1/", k), _join("a b ", k)), (k % 4).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), F.when(k % 3 > 0, F.when(k % 3 == 1, "Y").otherwise("N")).alias("yn"))
    c = F.col("raw")
    return rows.select("page_id", T.is_pmid(c).alias("pmid"), T.is_pmcid(c).alias("pmcid"), T.is_doi(c).alias("doi"), T.is_record_id(c).alias("record"), T.flag(F.col("yn")).alias("flag"), T.search_url(c).alias("search"), T.corpus_url(F.lit("MED"), _join(k)).alias("corpus"), T.article_url(_join(k)).alias("article"), T.fulltext_url(_join(k)).alias("fulltext"))


def diagnostic_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of diagnostics whose members are one value or many, with the note they make."""
    k = F.col("event_id")
    given = {"ef": F.when(k % 2 == 0, F.col("event_type")), "ep": F.when(k % 3 == 0, _join('["p', k % 5, '","q"]')), "wf": F.when(k % 5 == 0, '["w"]'), "wq": F.when(k % 7 == 0, _join('"', k % 4, '"'))}
    rows = table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in given.items()))
    lists = S.diagnostics({"FieldNotFound": F.col("ef"), "PhraseNotFound": F.col("ep")}, {"FieldNotFound": F.col("wf"), "QuotedPhraseNotFound": F.col("wq")})
    rows = rows.withColumns(lists)
    return rows.select("event_id", F.array_join("ignored_fields", "|").alias("ignored"), F.array_join("unmatched_phrases", "|").alias("unmatched"), S.diagnostic_notice(F.col("ignored_fields"), F.col("unmatched_phrases")).alias("notice"))


FIELDS = S.Fields(id="o_orderkey", title="title", date="o_orderdate", authors="authors", journal="o_orderpriority", terms="terms", language="o_orderstatus")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles by two customers, on a few terms; every ninth has no date and no author."""
    k, c = _keys()
    some = k % 9 > 0
    authors = F.when(some, F.array(_join("Customer ", c), _join("Other ", c % 10)))
    return table(spark, sf_dir, "orders").select(k, c, "o_orderpriority", "o_orderstatus", F.when(some, F.col("o_orderdate")).alias("o_orderdate"), _join("Sea ", F.when(c % 2 == 0, "and sky ").otherwise(""), k).alias("title"), authors.alias("authors"), F.array(_join("T", c % 6), _join("U", k % 4), F.lit("human")).alias("terms"), "o_totalprice")


CLAUSES = {
    "author": (S.Search(author="customer 1"), "o_orderkey % 9 > 0 AND contains('customer ' || o_custkey, 'customer 1')"),
    "journal": (S.Search(journal="1-urgent"), "o_orderpriority = '1-URGENT'"),
    "species": (S.Search(species="human"), "true"),
    "terms": (S.Search(terms=["T3", "U1"]), "o_custkey % 6 = 3 AND o_orderkey % 4 = 1"),
    "language": (S.Search(language="P"), "o_orderstatus = 'P'"),
    "dates": (S.Search(min_date="1994/3", max_date="1995"), "o_orderkey % 9 > 0 AND o_orderdate >= TIMESTAMP '1994-03-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    "query": (S.Search(query='sky AND ("2-high"[Journal] OR T5[MeSH])'), "o_custkey % 2 = 0 AND (o_orderpriority = '2-HIGH' OR o_custkey % 6 = 5)"),
    "all": (S.Search(query="sky", author="other 2", terms=["T2"], language="F"), "o_orderkey % 9 > 0 AND o_custkey % 2 = 0 AND o_custkey % 10 = 2 AND o_custkey % 6 = 2 AND o_orderstatus = 'F'"),
}


def search_by_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many articles each clause finds, and their ids' sum; one scan for all of them."""
    rows = _articles(spark, sf_dir)
    found = [F.when(F.coalesce(_all(S.clauses(s, FIELDS)), F.lit(False)), name) for name, (s, _) in CLAUSES.items()]
    return rows.select("o_orderkey", F.explode(F.array_compact(F.array(*found))).alias("clause")).groupBy("clause").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


def _all(clauses: list[Column]) -> Column:
    out = clauses[0]
    for c in clauses[1:]:
        out = out & c
    return out


def search_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in each order, its first rows with summaries: missing values last, ties by id."""
    rows, pages = _articles(spark, sf_dir), None
    for mode in S.SORTS:
        page = S.results(rows, S.Search(query="sea OR sky", sort=mode, offset=7, limit=9, summaries=4), FIELDS).select(F.lit(mode).alias("mode"), "pos", "o_orderkey", "summarised")
        pages = page if pages is None else pages.unionByName(page)
    return pages


SORTS = {"": "o_totalprice DESC", "P_PDATE_D desc": "o_orderdate DESC NULLS LAST", "p_pdate_d asc": "o_orderdate NULLS LAST", "CITED": "o_totalprice DESC", "AUTH_FIRST asc": "first NULLS LAST", "PUB_YEAR desc": "y DESC NULLS LAST"}


def corpus_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in each sort of the second corpus, and the one of preprints by date, which is by relevance and says so."""
    rows = _articles(spark, sf_dir).withColumns({"first": F.get("authors", F.lit(0)), "y": F.year("o_orderdate")})
    columns, out = {"P_PDATE_D": "o_orderdate", "CITED": "o_totalprice", "AUTH_FIRST": "first", "PUB_YEAR": "y"}, None
    for name, sort, sources in (*((s, s, None) for s in SORTS), ("preprints", "P_PDATE_D desc", ["PPR"])):
        order, note = paging.corpus_order(sort, columns, "o_totalprice", "o_orderkey", sources)
        page = paging.sort_modes(rows, {name: order}, 6, ["o_orderkey"]).withColumn("noted", F.lit(note is not None))
        out = page if out is None else out.unionByName(page)
    return out


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as Markdown, fields that are missing left out."""
    k, c = _keys()
    rows = _articles(spark, sf_dir)
    return rows.select("o_orderkey", tables.markdown(F.col("title"), {"Journal": F.col("o_orderpriority"), "Year": F.year("o_orderdate"), "Author": F.get("authors", F.lit(0))}, F.when(k % 2 == 0, _join("Body ", c)).otherwise("")).alias("md"))


def only_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which one of three inputs each request gives, if it is only one."""
    k, c = _keys()
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 2 == 0, F.array(_join("PMC", k))).alias("pmcids"), F.when(k % 3 == 0, _join(c)).alias("pmids"), F.when(k % 5 == 0, " ").when(k % 7 == 0, _join("10.1/", k)).alias("dois"))
    rows = rows.withColumn("pmcids", F.array_join("pmcids", ","))
    return rows.select("o_orderkey", S.only_given("pmcids", "pmids", "dois").alias("given"))


def routes_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs in the spellings they were asked by, routed by their normal form."""
    k, c = _keys()
    asked = table(spark, sf_dir, "orders").select(F.when(k % 3 == 0, _join("https://doi.org/10.1/", k)).when(k % 3 == 1, _join("DOI: 10.1/", k)).otherwise(_join("no id ", k)).alias("asked"), k)
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(_join("10.1/", k).alias("doi"), _join("PMC", c).alias("pmcid"))
    return R.route_as_written(asked, known, "asked", T.doi(F.col("asked")), "doi", "pmcid").select("asked", "o_orderkey", "pmcid", "bucket")


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as files of XML sets and as JSON, read back by declared schemas; a source that is not configured adds nothing."""
    k, c = _keys()
    at, rows = _folder(spark, "records"), _orders(spark, sf_dir)
    made = records.once(rows.select(record_xml().alias("xml")), "r", F.from_xml(F.col("xml"), records.RECORD, records.RECORD_OPTIONS))
    tables.write_xml(made.select("r.MedlineCitation", "r.PubmedData"), f"{at}/xml", "PubmedArticle", "PubmedArticleSet")
    tables.write_records(rows.select(k, c), f"{at}/json", "json")
    c = F.col("MedlineCitation")
    read = tables.record_xml(spark, f"{at}/xml", records.RECORD, "PubmedArticle").select(c["PMID"]["_VALUE"].cast("long").alias("o_orderkey"), c["PMID"]["_Version"].alias("version"), c["Article"]["ArticleTitle"].alias("title"))
    other = tables.optional(spark, "", "o_orderkey long, o_custkey long")
    return read.join(tables.json_lines(spark, f"{at}/json", "o_orderkey long, o_custkey long").unionByName(other), "o_orderkey")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream of files, counted by day and type."""
    at = _folder(spark, "hours")
    stream = flow.file_stream(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)
    replies.run_into(flow.windowed_counts(stream, "1 day", "1 hour"), f"{at}/out", f"{at}/checkpoint", "complete")
    return spark.read.parquet(f"{at}/out").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {f.__name__: f for f in (record_fields, jats_fields, vocabulary_fields, summary_kinds, id_forms, diagnostic_members, search_by_clause, search_orders, corpus_orders, markdown_pages, only_input, routes_as_written, stored_records, hourly_events)}

_SOME = "(SELECT * FROM orders WHERE o_orderkey % 4 < 2)"
_ARTICLES = "(SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS o_orderdate, CASE WHEN o_orderkey % 9 > 0 THEN 'Customer ' || o_custkey END AS first FROM orders)"
_PAGE = "SELECT '{m}' AS mode, CAST(row_number() OVER (ORDER BY {o}, o_orderkey) - {k} AS INT) AS pos, o_orderkey FROM a"
ORACLES = {
    "record_fields": f"""
        SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS pmid, 'AIM: Why ' || o_custkey || '.' || chr(10) || chr(10) || 'How.' AS abstract_text, o_orderpriority || CASE WHEN o_orderkey % 2 = 1 THEN '|Review' ELSE '' END AS types,
            CASE WHEN o_orderkey % 3 = 0 THEN 'R' || o_orderkey || ' & 2/HL/A/C' END AS grants, 'Electronic ' || strftime(o_orderdate, '%Y-%m-%d') AS dates,
            'D' || (o_custkey % 7) || ' Term ' || (o_custkey % 7) || ' ' || (o_custkey % 4 = 0 OR o_custkey % 5 = 0) || ' 1|D9 Two false' AS mesh,
            'L' || o_custkey || ' 0000-0001-0002-000X 0|Group ' || (o_custkey % 3) || ' ' || CASE WHEN o_custkey % 5 = 1 THEN 0 ELSE 1 END AS authors,
            'Inst ' || (o_custkey % 5) || CASE WHEN o_custkey % 5 = 1 THEN '' ELSE '|Inst 1' END AS affiliations, o_custkey % 4 = 0 OR o_custkey % 5 = 0 AS any_major FROM {_SOME}""",
    "jats_fields": f"""
        SELECT o_orderkey, 'PMC' || o_orderkey AS pmcid, '10.1/' || o_orderkey AS doi, 'On X ' || o_orderkey AS title, 'J of ' || o_orderpriority AS journal, '1111-2222' AS issn, '7(2):10-12' AS place,
            CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || '-03-05' ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) END AS pub_date, 'Short ' || o_custkey || '.' AS abstract_text, 'k' || (o_custkey % 4) || '|k9' AS keywords,
            'Inst ' || (o_custkey % 5) || '|Inst B' AS affiliations, 'Doe' || o_custkey || ' J|Group ' || (o_custkey % 3) AS authors,
            'r1=Doe J, et al. On Y Cell ' || year(o_orderdate) || ' PMID ' || o_custkey || '|r2=As written in ' || year(o_orderdate) || '.' AS refs FROM {_SOME}""",
    "vocabulary_fields": """
        WITH p AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS d FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '68' ELSE '67' END || d AS uid, CASE WHEN p_partkey % 2 = 0 THEN 'D' ELSE 'C' END || d AS id,
            CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE CASE WHEN p_partkey % 2 = 0 THEN 'D' ELSE 'C' END || d END AS name, CASE WHEN p_partkey % 4 > 0 THEN 'Note ' || p_partkey END AS note,
            CASE WHEN p_partkey % 3 > 0 THEN p_name || '|' || p_brand END AS terms, 'C04.' || (p_partkey % 10) AS trees FROM p""",
    "summary_kinds": f"""
        SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS uid, 'T ' || o_custkey AS title, ['J', 'S4', 'FJ'][o_custkey % 7 + 1] AS source, strftime(o_orderdate, '%Y-%m-%d') AS pub_date, ['A B, C D', 'K L, M N', 'U V'][o_custkey % 7 + 1] AS authors
        FROM {_SOME} WHERE o_custkey % 7 < 3""",
    "id_forms": """
        SELECT page_id, page_id % 4 = 0 AS pmid, page_id % 4 < 2 AS pmcid, page_id % 4 = 2 AS doi, page_id % 4 < 3 AS record, CASE WHEN page_id % 3 > 0 THEN page_id % 3 = 1 END AS flag,
            'https://pubmed.ncbi.nlm.nih.gov/?term=' || ['', 'pmc', 'https%3A%2F%2Fdoi.org%2F10.1%2F', 'a%20b%20'][page_id % 4 + 1] || page_id AS search, 'https://europepmc.org/article/MED/' || page_id AS corpus,
            'https://pubmed.ncbi.nlm.nih.gov/' || page_id || '/' AS article, 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || page_id || '/' AS fulltext FROM pages""",
    "diagnostic_members": """
        WITH d AS (SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN event_id % 5 = 0 THEN 'w' END], lambda x: x IS NOT NULL) AS i,
            list_filter([CASE WHEN event_id % 3 = 0 THEN 'p' || (event_id % 5) END, CASE WHEN event_id % 3 = 0 THEN 'q' END, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 4 AS VARCHAR) END], lambda x: x IS NOT NULL) AS u FROM events)
        SELECT event_id, array_to_string(i, '|') AS ignored, array_to_string(u, '|') AS unmatched, concat_ws(' ', CASE WHEN len(i) > 0 THEN 'Unknown field tags, searched as free text: "' || array_to_string(i, '", "') || '".' END,
            CASE WHEN len(u) > 0 THEN 'Nothing matched: "' || array_to_string(u, '", "') || '".' END) AS notice FROM d""",
    "search_by_clause": " UNION ALL ".join(f"SELECT '{n}' AS clause, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE {w} HAVING count(*) > 0" for n, (_, w) in CLAUSES.items()),
    "search_orders": f"WITH a AS {_ARTICLES}, r AS ("
    + " UNION ALL ".join(_PAGE.format(m=m, o=o, k=7) for m, o in (("relevance", "o_custkey % 2"), ("pub_date", "o_orderdate DESC NULLS LAST"), ("author", "lower(first) NULLS LAST"), ("journal", "lower(o_orderpriority)")))
    + ") SELECT *, pos <= 4 AS summarised FROM r WHERE pos BETWEEN 1 AND 9",
    "corpus_orders": f"WITH a AS (SELECT *, year(o_orderdate) AS y FROM {_ARTICLES}), r AS (" + " UNION ALL ".join(_PAGE.format(m=m, o=o, k=0) for m, o in (*SORTS.items(), ("preprints", "o_totalprice DESC"))) + ") SELECT *, mode = 'preprints' AS noted FROM r WHERE pos <= 6",
    "markdown_pages": f"""
        SELECT o_orderkey, '## Sea ' || CASE WHEN o_custkey % 2 = 0 THEN 'and sky ' ELSE '' END || o_orderkey || chr(10) || '- **Journal:** ' || o_orderpriority || coalesce(chr(10) || '- **Year:** ' || year(o_orderdate), '')
            || coalesce(chr(10) || '- **Author:** ' || first, '') || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || 'Body ' || o_custkey ELSE '' END AS md FROM {_ARTICLES}""",
    "only_input": """
        SELECT o_orderkey, CASE WHEN a + b + c = 1 THEN CASE WHEN a = 1 THEN 'pmcids' WHEN b = 1 THEN 'pmids' ELSE 'dois' END END AS given
        FROM (SELECT o_orderkey, CAST(o_orderkey % 2 = 0 AS INT) AS a, CAST(o_orderkey % 3 = 0 AS INT) AS b, CAST(o_orderkey % 5 > 0 AND o_orderkey % 7 = 0 AS INT) AS c FROM orders)""",
    "routes_as_written": """
        SELECT CASE o_orderkey % 3 WHEN 0 THEN 'https://doi.org/10.1/' WHEN 1 THEN 'DOI: 10.1/' ELSE 'no id ' END || o_orderkey AS asked, o_orderkey, CASE WHEN o_orderkey % 3 < 2 AND o_orderstatus = 'F' THEN 'PMC' || o_custkey END AS pmcid,
            CASE WHEN o_orderkey % 3 < 2 AND o_orderstatus = 'F' THEN 'archive' ELSE 'fallback' END AS bucket FROM orders""",
    "stored_records": f"SELECT o_orderkey, '1' AS version, 'T ' || o_orderkey AS title, o_custkey FROM {_SOME}",
    "hourly_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
