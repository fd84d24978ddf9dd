"""Operators over stated cases: the SQL is the rows that must come out, written out one by one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import jats, records
from litgrid.functions import text as T
from litgrid.operators import budget as B
from litgrid.operators import catalog, chains, handles, tiers
from litgrid.operators import related as L
from litgrid.operators import resolve as R
from litgrid.operators import search as S
from litgrid.session import shared_folder
from litgrid.sources import tables
from litgrid.streaming import flow, replies

QUERIES, ORACLES = {}, {}


def expected(columns: str, *rows: tuple):
    """Registers a query with the rows it must give; columns: names and DuckDB types."""
    names = [c.split()[0] for c in columns.split(", ")]
    types = [c.split(" ", 1)[1] for c in columns.split(", ")]

    def lit(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (bool, int, float)) else "'" + str(x).replace("'", "''") + "'"

    def register(f):
        QUERIES[f.__name__] = f
        values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
        ORACLES[f.__name__] = "SELECT " + ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types, strict=True)) + f" FROM (VALUES {values}) t({', '.join(names)})"
        return f

    return register


def _texts(spark: SparkSession, *raw: str | None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(raw, 1)), "k int, raw string")


@expected(
    "k INT, result VARCHAR",
    (1, "P<0.001 and n > 3 in all"), (2, "We saw bold text & more"), (3, "n<N in a word"), (4, "<gene> stays"), (5, "microbiome"), (6, "a d"), (7, "one two three"), (8, ""), (9, "5 < 6 and 7 > 4"), (10, "x y"), (11, None),
)
def display_text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ("P<0.001 and n > 3 in all", "We saw <bold>bold</bold> text &amp; more", "n<N in <i>a</i> word", "&lt;gene&gt; stays", "micro­bi&shy;o&#173;me", "a<b and c>d", "  one\n\ttwo  three ", "", "5 < 6 and 7 > 4", "<jats:p>x</jats:p><br/>y", None)
    return _texts(spark, *raw).select("k", T.display_text(F.col("raw")).alias("result"))


@expected("k INT, units INT, result VARCHAR", (1, 5, "abc"), (2, 6, "a😀"), (3, 6, "a😀"), (4, 2, "ab"), (5, 0, ""), (6, 4, "😀"))
def utf16_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut at three UTF-16 units, never within a pair."""
    rows = _texts(spark, "abcde", "a😀bcd", "a😀😀b", "ab", "", "😀😀")
    return rows.select("k", T.utf16_length(F.col("raw")).alias("units"), T.utf16_slice(F.col("raw"), 3).alias("result"))


@expected("k INT, result VARCHAR", (1, "x" * 400 + "…"), (2, "y" * 400), (3, "z" * 399 + "…"), (4, "a b"))
def snippet_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hundred units of display text; a pair that would be divided goes."""
    return _texts(spark, "<p>" + "x" * 401 + "</p>", "<b>" + "y" * 400 + "</b>", "z" * 399 + "😀", "<i>a</i> ­ b").select("k", T.snippet(F.col("raw")).alias("result"))


@expected("k INT, pmid BOOLEAN, pmcid BOOLEAN, doi BOOLEAN, record BOOLEAN", (1, True, True, False, True), (2, False, True, False, True), (3, False, False, True, True), (4, False, False, True, True), (5, False, False, False, False), (6, False, False, False, True))
def id_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw")
    return _texts(spark, "123", "pmc77", "10.1/x", "https://doi.org/10.2/y", "a b!", "PPR12x").select("k", T.is_pmid(c).alias("pmid"), T.is_pmcid(c).alias("pmcid"), T.is_doi(c).alias("doi"), T.is_record_id(c).alias("record"))


@expected("k INT, result BOOLEAN", (1, True), (2, False), (3, None))
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, "Y", "N", None).select("k", T.flag(F.col("raw")).alias("result"))


@expected("k INT, article VARCHAR, fulltext VARCHAR, search VARCHAR, corpus VARCHAR", (1, "https://pubmed.ncbi.nlm.nih.gov/12/", "https://pmc.ncbi.nlm.nih.gov/articles/PMC12/", "https://pubmed.ncbi.nlm.nih.gov/?term=12", "https://europepmc.org/article/MED/12"), (2, "https://pubmed.ncbi.nlm.nih.gov/a b/", "https://pmc.ncbi.nlm.nih.gov/articles/PMCa b/", "https://pubmed.ncbi.nlm.nih.gov/?term=a%20b", "https://europepmc.org/article/MED/a b"))
def computed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("raw")
    return _texts(spark, "12", "a b").select("k", T.article_url(c).alias("article"), T.fulltext_url(c).alias("fulltext"), T.search_url(c).alias("search"), T.corpus_url(F.lit("MED"), c).alias("corpus"))


@expected("k INT, kind VARCHAR", (1, "xml"), (2, "html"), (3, "empty"), (4, "error"), (5, "invalid"), (6, "invalid"), (7, "xml"), (8, "empty"))
def payload_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ('<?xml version="1.0"?><a x="1"><b/></a>', "<!DOCTYPE html><html></html>", "  ", "<r><ERROR>no</ERROR></r>", "not xml", "<a><b></c>", "<a/>", None)
    return _texts(spark, *raw).select("k", T.payload_kind(F.col("raw")).alias("kind"))


@expected("k INT, value VARCHAR", (1, "deep"), (2, None), (3, "7"), (4, None))
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, '{"a":{"b.":1,"b":{"c":"deep"}}}', '{"a":{"b":null}}', '{"a":{"b":{"c":7}}}', "no json").select("k", T.nested(F.col("raw"), "a.b.c").alias("value"))


@expected("k INT, ignored VARCHAR, unmatched VARCHAR, notice VARCHAR", (1, "foo|bar", "p|p|7", 'Unknown field tags, searched as free text: "foo", "bar". Nothing matched: "p", "p", "7".'), (2, "", "q", 'Nothing matched: "q".'), (3, "", "", ""))
def diagnostic_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are one value or many, in the error list and the warning list; repeats stay."""
    rows = spark.createDataFrame([(1, "foo", '["p"]', '["bar"]', "p", "7"), (2, None, None, None, None, '["q"]'), (3, None, None, None, None, None)], "k int, ef string, ep string, wf string, wp string, wq string")
    lists = S.diagnostics({"FieldNotFound": F.col("ef"), "PhraseNotFound": F.col("ep")}, {"FieldNotFound": F.col("wf"), "PhraseNotFound": F.col("wp"), "QuotedPhraseNotFound": F.col("wq")})
    rows = rows.withColumns(lists)
    return rows.select("k", F.array_join("ignored_fields", "|").alias("ignored"), F.array_join("unmatched_phrases", "|").alias("unmatched"), S.diagnostic_notice(F.col("ignored_fields"), F.col("unmatched_phrases")).alias("notice"))


BOOKS = [(1, "Deep sea", "1999-01-02", ["Zed", "Amy"], "B", ["fish"], "mouse"), (2, "sea and sky", "2001-05-06", ["Amy"], "A", ["fish", "air"], "human"), (3, "Sky", None, None, None, [], None), (4, "the sea, the sky", "2001-05-06", ["Bob"], "C", ["air"], "human"), (5, "Sea", "1998-01-01", ["amy"], "a", ["human"], "human")]
BOOK_FIELDS = S.Fields(title="title", date="date", authors="authors", journal="journal", terms="terms")


def _books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOOKS, "id int, title string, date string, authors array<string>, journal string, terms array<string>, language string").withColumn("date", F.col("date").cast("timestamp_ntz"))


@expected("mode VARCHAR, pos INT, id INT, summarised BOOLEAN", ("relevance", 1, 4, True), ("relevance", 2, 1, False), ("pub_date", 1, 4, True), ("pub_date", 2, 1, False), ("author", 1, 5, True), ("author", 2, 4, False), ("journal", 1, 5, True), ("journal", 2, 1, False))
def search_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third rows in each order: missing values last, ties by id."""
    pages = []
    for mode in S.SORTS:
        page = S.results(_books(spark), S.Search(query="sea OR sky", sort=mode, offset=1, limit=2, summaries=1), BOOK_FIELDS)
        pages.append(page.select(F.lit(mode).alias("mode"), "pos", "id", "summarised"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@expected("clause VARCHAR, ids VARCHAR", ("author", "1,2,5"), ("journal", "2,5"), ("species", "5"), ("terms", "2"), ("language", "2,4,5"), ("query", "1,2"))
def search_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"author": S.Search(author="AMY"), "journal": S.Search(journal="a"), "species": S.Search(species="human"), "terms": S.Search(terms=["fish", "air"]), "language": S.Search(language="human"), "query": S.Search(query='amy[Author] AND ("B"[Journal] OR air[MeSH])')}
    out = None
    for name, s in given.items():
        ids = S.search(_books(spark), s, BOOK_FIELDS).agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("ids")).select(F.lit(name).alias("clause"), "ids")
        out = ids if out is None else out.unionByName(ids)
    return out


@expected("n_matched BIGINT, n_returned BIGINT, handled BIGINT", (4, 2, 2))
def result_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals before paging, and a page kept under a handle that a later query joins."""
    s = S.Search(query="sea", limit=2)
    page = S.results(_books(spark), s, BOOK_FIELDS)
    again = handles.read(spark, handles.keep(page, "pos")).select("id").join(_books(spark), "id").agg(F.count("*").alias("handled"))
    return S.total_rows(S.search(_books(spark), s, BOOK_FIELDS), page).crossJoin(again)


LOC = "struct<url:string,url_for_pdf:string,host_type:string,license:string,version:string>"


@expected(
    "k INT, doi VARCHAR, kind VARCHAR, reason VARCHAR, url VARCHAR, license VARCHAR",
    (1, "10.1/a", "found", None, "https://b", "cc"), (2, "10.1/b", "found", None, "https://l", None), (3, None, "no-oa", "Invalid DOI", None, None), (4, "10.1/d", "no-oa", "DOI unknown to the index", None, None),
    (5, "10.1/e", "no-oa", "Invalid DOI format", None, None), (6, "10.1/f", "no-oa", "No open-access copy indexed", None, None), (7, "10.1/g", "no-oa", "OA flagged but no usable location URL", None, None), (8, "10.1/h", "no-oa", "OA flagged but no usable location URL", None, None),
)
def oa_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best location, else the first; and the reasons why there is none."""
    best, first = ("https://b", "https://b.pdf", "publisher", "cc", "v"), ("https://l", None, "repository", None, None)
    rows = [(1, "https://doi.org/10.1/a", 200, True, best, [first]), (2, "doi: 10.1/b", 200, True, None, [first, best]), (3, "x", 200, True, best, None), (4, "10.1/d", 404, None, None, None), (5, "10.1/e", 422, None, None, None), (6, "10.1/f", 200, False, best, None), (7, "10.1/g", 200, True, None, []), (8, "10.1/h", 200, True, (" ", None, None, None, None), [first])]
    found = chains.oa_resolve(spark.createDataFrame(rows, f"k int, doi string, status int, is_oa boolean, best {LOC}, locations array<{LOC}>"))
    return found.select("k", "doi", "kind", "reason", "url", "license")


@expected(
    "k INT, outcome VARCHAR, content_format VARCHAR, source_url VARCHAR, content VARCHAR, title VARCHAR, word_count INT, kept VARCHAR, n_before INT, n_after INT",
    (1, "found", "html-markdown", "https://h", "T Some long text", "T", 4, "T Some lon", 16, 10), (2, "found", "pdf-text", "https://p", "page one", None, None, "page one", None, None), (3, "parse-failed", None, None, None, None, None, None, None, None), (4, "fetch-failed", None, None, None, None, None, None, None, None), (5, "found", "html-markdown", "https://h", "x", None, 1, "x", None, None),
)
def oa_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was fetched, as text with its provenance, cut to ten units with an account of it."""
    rows = [(1, "https://h", None, "<html><title>T</title><nav>menu</nav><p>Some long  text</p></html>"), (2, "https://h", "https://p", "%PDF-1.4 page one"), (3, "https://h", None, "<html><script>x</script></html>"), (4, "https://h", None, None), (5, "https://h", "https://p", "<html><body>x</body></html>")]
    out = chains.oa_body(spark.createDataFrame(rows, "k int, url string, url_for_pdf string, body string"))
    kept, before, after = B.content_budget(F.col("content"), 10)
    return out.select("k", "outcome", "content_format", "source_url", "content", "title", "word_count", kept.alias("kept"), before.alias("n_before"), after.alias("n_after"))


@expected(
    "id INT, tier VARCHAR, outcomes VARCHAR, reason VARCHAR",
    (1, "pmc", "pmc:found", None), (2, "epmc", "pmc:miss,epmc:found", None), (3, None, "pmc:no-body,epmc:no-fulltext,oa:not-attempted", "no-epmc-fulltext"), (4, None, "pmc:service-error,epmc:miss,oa:not-attempted", "not-found"), (5, None, "pmc:miss,epmc:no-body,oa:not-attempted", "no-body"), (6, None, "pmc:miss,epmc:service-error,oa:not-attempted", "service-error"),
)
def chain_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tier's outcome for each id, up to the one that had the text; the third tier is not configured."""
    kind = "id int, payload string, n_sections int, failed boolean"
    asked = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    pmc = spark.createDataFrame([(1, "x", 2, None), (3, "front", 0, None), (4, None, None, True)], kind)
    epmc = spark.createDataFrame([(1, "y", 1, None), (2, "y", None, None), (3, " ", None, None), (5, "front", 0, False), (6, None, None, True)], kind)
    chain = tiers.run_chain(asked, "id", [chains.Tier("pmc", pmc), chains.Tier("epmc", epmc), chains.Tier("oa", None)])
    text = F.array_join(F.transform("outcomes", lambda o: F.concat(o["tier"], F.lit(":"), o["outcome"])), ",")
    return chain.outcomes().join(chain.reasons(), "id", "left").select("id", "tier", text.alias("outcomes"), "reason")


@expected("asked VARCHAR, pmid VARCHAR, pmcid VARCHAR, errmsg VARCHAR, n_submitted BIGINT, n_converted BIGINT", ("PMC1", "11", "PMC1", None, 3, 2), ("PMC2", None, None, R.CONVERTER_ADVICE, 3, 2), ("PMC3", "33", "PMC3", None, 3, 2))
def convert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply in JSON, joined to what was asked; bare digits have their prefix there."""
    reply = '{"status":"ok","records":[{"requested-id":"PMC1","pmid":11,"pmcid":"PMC1"},{"requested-id":"PMC2","errmsg":"Identifier not found in PMC"},{"requested-id":"PMC3","pmid":"33","pmcid":"PMC3","doi":"10.1/z"}]}'
    records_ = chains.parse_crosswalk(_texts(spark, reply, '{"status":"error"}'), "raw")
    asked = _texts(spark, "1", "pmc2", " 3 ").select(chains.crosswalk_key(F.col("raw"), "pmcid").alias("requested_id"))
    out = asked.join(records_, "requested_id", "left").withColumn("errmsg", R.rewrite_error(F.col("errmsg")))
    return out.select(F.col("requested_id").alias("asked"), "pmid", "pmcid", "errmsg").crossJoin(chains.convert_report(out))


@expected("key VARCHAR, status VARCHAR, matched_id VARCHAR, candidates VARCHAR", ("k1", "matched", "123", None), ("k2", "ambiguous", None, "1,2"), ("k3", "not_found", None, None), ("k4", "ambiguous", None, None))
def match_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the match protocol, written and read as files: seven fields, parted by carriage returns or line feeds."""
    folder = f"{shared_folder(spark)}/match-{uuid.uuid4().hex}"
    lines = ["J|2000|1|2|A|k1|123\rJ|2000|1|2|A|k2|AMBIGUOUS 1,2", "J||||A|k3|NOT_FOUND;INVALID", "J||||A|k4|AMBIGUOUS (many)"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(folder)
    return tables.piped_lines(spark, folder).select(F.inline(F.array(R.parse_match_reply(F.col("line"))))).withColumn("candidates", F.array_join("candidates", ","))


@expected("matched_id VARCHAR", ("5",), ("7",))
def matched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.matched_ids(spark.createDataFrame([("a", "5"), ("b", None), ("c", "5"), ("d", "7")], "key string, matched_id string"))


@expected("key VARCHAR, asked_for INT, status VARCHAR, matched_id VARCHAR", ("a", 1, "matched", "2"), ("a", 2, "matched", "2"), ("b", 3, "not_found", None), ("c", 4, "ambiguous", None))
def reconcile_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row asked for, repeats included, with the last reply to its key; dropped ones are not found."""
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "key string, asked_for int")
    replies = spark.createDataFrame([("a", 1, "matched", "1"), ("c", 2, "ambiguous", None), ("a", 3, "matched", "2"), ("z", 4, "matched", "9")], "key string, at int, status string, matched_id string")
    return R.reconcile(asked, replies, "key", "at")


@expected("id INT, status VARCHAR", (1, "ok"), (2, "not_found"), (3, "failed"))
def dropped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.with_missing(spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1, "ok"), (3, "failed")], "id int, status string"), "id")


@expected("k INT, id VARCHAR", (1, "12"), (2, "34"), (3, None), (4, "56"), (5, None))
def link_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, " 12 ", "PPR", "x"), (2, None, "MED", "34"), (3, None, "PPR", "35"), (4, "56", "MED", "57"), (5, None, "MED", "a1")], "k int, pmid string, source string, record string")
    return rows.select("k", chains.link_id(F.col("pmid"), F.col("source"), F.col("record")).alias("id"))


@expected("relationship VARCHAR, src INT, dst INT, provider VARCHAR, fallback VARCHAR", ("references", 1, 10, "first", None), ("references", 2, 20, "corpus", "references_coverage"), ("references", 3, 30, "graph", "references_coverage"), ("similar", 1, 10, "first", None))
def references_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallbacks for references of known articles alone: record 4 has no title, record 5 no article, record 6 no provider."""
    asked = spark.createDataFrame([(i,) for i in range(1, 7)], "src int")
    articles = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, " "), (6, "f")], "src int, title string")
    links = lambda *rows: spark.createDataFrame(rows, "src int, dst int")
    tiers = [("corpus", links((1, 11), (2, 20), (4, 40), (5, 50))), ("graph", links((2, 21), (3, 30), (5, 51)))]
    out = [chains.coverage_fallback(asked, "src", links((1, 10), (9, 90)), articles, tiers, r).select(F.lit(r).alias("relationship"), "src", "dst", "provider", "fallback") for r in ("references", "similar")]
    return out[0].unionByName(out[1])


@expected("wanted INT, related INT, cited INT", (5, 15, 15), (20, 50, 60), (100, 50, 200))
def candidate_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = spark.range(1).select(F.sequence(F.lit(1), F.lit(500)).alias("ids"))
    parts = [many.select(F.lit(n).alias("wanted"), F.size(chains.capped(F.col("ids"), n, chains.RELATED_CAP)).alias("related"), F.size(chains.capped(F.col("ids"), n, chains.REFERENCES_CAP)).alias("cited")) for n in (5, 20, 100)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@expected("src BIGINT, dst BIGINT, pos INT", (1, 2, 0), (1, 3, 1))
def work_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by addresses or bare ids; a capped list is resolved through the id map, the work itself and repeats go."""
    works = spark.createDataFrame([(1, ["https://graph.org/W2", "W3", "W9", "https://graph.org/W2", "W8"])], "src long, related array<string>")
    related = F.transform(chains.capped(F.col("related"), 2, 4), lambda w: F.regexp_replace(w, "^https?://[^/]+/", ""))
    ids = spark.createDataFrame([("W2", 2), ("W3", 3), ("W9", 1), ("W8", 8)], "work_id string, pmid long")
    return L.two_hop(works.withColumn("related", related), ids).withColumn("pos", F.col("pos").cast("int"))


@expected("source VARCHAR, id VARCHAR, title VARCHAR", ("MED", "1", "one"), ("PPR", "x2", "two"))
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by source and id; ids agree in any case."""
    asked = spark.createDataFrame([("MED", "1"), ("PPR", "x2"), ("MED", "X2")], "source string, id string")
    corpus = spark.createDataFrame([("MED", "1", "one"), ("PPR", "X2", "two"), ("PMC", "1", "other")], "source string, rid string, title string")
    hits = corpus.withColumn("key", F.upper("rid"))
    return asked.withColumn("key", F.upper("id")).join(hits, ["source", "key"]).select("source", "id", "title")


SUMMARIES = [
    '{"uid":"1","Title":"A &lt;i&gt;","source":"J","pubdate":"2020 Mar 5","authors":[{"name":"X Y"},{"Name":"Z W"},"P Q"],"articleids":[{"idtype":"doi","value":"10.1/a"},{"IdType":"PMC","Value":"PMC1"}]}',
    '{"uid":"2","title":"B","fulljournalname":"Full J","authors":{"Author":[{"name":"N M"}]},"articleids":{"ArticleId":{"idtype":"doi","value":"10.1/b"}},"doi":""}',
    '{"UID":"3","title":"C","SO":"so","EPubDate":"2021/02/03","authors":"A B; C D, E F, G H"}',
    '<DocumentSummary uid="4"><Title>D &lt;b&gt;d&lt;/b&gt;</Title><SO>S4</SO><PubDate>2019 Jul-Aug</PubDate><Authors><Author><Name>K L</Name></Author><Author>M N</Author></Authors><ArticleIds><ArticleId><IdType>doi</IdType><Value>10.1/d</Value></ArticleId></ArticleIds></DocumentSummary>',
    '<DocumentSummary uid="5"><Title>E</Title><Authors>One A; Two B</Authors></DocumentSummary>',
    '<DocSum><Id>6</Id><Item Name="Title" Type="String">F</Item><Item Name="FullJournalName" Type="String">FJ</Item><Item Name="AuthorList" Type="List"><Item Name="Author" Type="String">U V</Item></Item><Item Name="DOI" Type="ERROR">no</Item></DocSum>',
    '<ERROR>Empty id list</ERROR>',
    '{"error":"bad"}',
    '{"title":"without an id"}',
    "something else",
    None,
]


@expected(
    "uid VARCHAR, title VARCHAR, source VARCHAR, pub_date VARCHAR, epub_date VARCHAR, authors VARCHAR, doi VARCHAR, pmc_id VARCHAR",
    ("1", "A <i>", "J", "2020-03-05", None, "X Y, Z W, P Q", "10.1/a", "PMC1"), ("2", "B", "Full J", None, None, "N M", "10.1/b", None), ("3", "C", "so", None, "2021-02-03", "A B, C D, E F, et al.", None, None),
    ("4", "D d", "S4", "2019-07-01", None, "K L, M N", "10.1/d", None), ("5", "E", None, None, None, "One A, Two B", None, None), ("6", "F", "FJ", None, None, "U V", None, None),
)
def summary_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries in JSON of either casing, in XML, and as named items; errors and what has no id give no row."""
    return records.parse_summaries(_texts(spark, *SUMMARIES), "raw").drop("k", "raw").withColumnRenamed("authors_display", "authors")


@expected("uid VARCHAR, id VARCHAR, name VARCHAR, note VARCHAR, terms VARCHAR, trees VARCHAR", ("68001943", "D001943", "Breast Neoplasms", "Tumors.", "Breast Neoplasms|Breast Cancer", "C04.588|C17.800"), ("67218176", "C218176", "C218176", None, None, None))
def vocabulary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item lists of vocabulary records; a pointer to another heading is no tree number."""
    link = lambda x: f'<Item Name="s" Type="Structure"><Item Name="Parent" Type="Integer">1</Item><Item Name="TreeNum" Type="String">{x}</Item></Item>'
    one = f'<DocSum><Id>68001943</Id><Item Name="DS_ScopeNote" Type="String">Tumors.</Item><Item Name="DS_MeshTerms" Type="List"><Item Name="string" Type="String">Breast Neoplasms</Item><Item Name="string" Type="String">Breast Cancer</Item></Item><Item Name="DS_IdxLinks" Type="List">{link("C04.588")}{link("C17.800")}</Item></DocSum>'
    two = f'<DocSum><Id>67218176</Id><Item Name="DS_ScopeNote" Type="String"></Item><Item Name="DS_IdxLinks" Type="List">{link("@1943")}</Item></DocSum>'
    out = records.parse_vocabulary(_texts(spark, one, two), "raw")
    return out.select("uid", "id", "name", "note", F.array_join("terms", "|").alias("terms"), F.array_join("trees", "|").alias("trees"))


RECORD = (
    '<PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">Why.</AbstractText><AbstractText>How.</AbstractText></Abstract>'
    '<PublicationTypeList><PublicationType UI="a">Review</PublicationType><PublicationType UI="b">Letter</PublicationType></PublicationTypeList>'
    '<GrantList><Grant><GrantID>R01 &amp;amp; 2</GrantID><Acronym>HL</Acronym><Agency>A</Agency><Country>C</Country></Grant></GrantList>'
    '<ArticleDate DateType="Electronic"><Year>2020</Year><Month>03</Month><Day>05</Day></ArticleDate></Article>'
    '<MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="N">One</DescriptorName><QualifierName UI="Q1" MajorTopicYN="Y">q</QualifierName></MeshHeading><MeshHeading><DescriptorName UI="D2" MajorTopicYN="N">Two</DescriptorName></MeshHeading></MeshHeadingList>'
    "</MedlineCitation></PubmedArticle>"
)


@expected("pmid VARCHAR, abstract_text VARCHAR, types VARCHAR, grants VARCHAR, dates VARCHAR, mesh VARCHAR", ("7", "AIM: Why.\n\nHow.", "Review|Letter", "R01 & 2/HL/A/C", "Electronic 2020-03-05", "One D1 true q|Two D2 false "))
def record_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's structured abstract, types, grants (decoded once more), dates and headings, from a file of records."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    tables.write_records(spark.createDataFrame([(RECORD,)], "value string"), folder, "text")
    raw = tables.whole_texts(spark, folder).select(F.trim("value").alias("xml"))
    r = records.parse_records(raw, "xml", grants=True)
    mesh = F.transform("mesh", lambda m: F.concat_ws(" ", m["name"], m["ui"], m["is_major"].cast("string"), F.array_join(F.transform(F.coalesce(m["qualifiers"], F.array().cast("array<struct<name:string,ui:string,is_major:boolean>>")), lambda q: q["name"]), ",")))
    return r.select("pmid", "abstract_text", F.array_join("publication_types", "|").alias("types"), F.array_join(F.transform("grants", lambda g: F.concat_ws("/", g["grantid"], g["acronym"], g["agency"], g["country"])), "|").alias("grants"), F.array_join(F.transform("article_dates", lambda d: F.concat(d["type"], F.lit(" "), F.concat_ws("-", d["year"], d["month"], d["day"]))), "|").alias("dates"), F.array_join(mesh, "|").alias("mesh"))


@expected("pmid VARCHAR, version VARCHAR, title VARCHAR", ("7", "1", "T"), ("8", "2", "U"))
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a file read row by row with a declared schema."""
    folder = f"{shared_folder(spark)}/xml-{uuid.uuid4().hex}"
    other = RECORD.replace('"1">7', '"2">8').replace("<ArticleTitle>T", "<ArticleTitle>U")
    spark.createDataFrame([(f"<Set>\n{RECORD}\n{other}\n</Set>",)], "value string").coalesce(1).write.text(folder)
    rows = tables.record_xml(spark, folder, records.RECORD, "PubmedArticle")
    c = F.col("MedlineCitation")
    return rows.select(c["PMID"]["_VALUE"].alias("pmid"), c["PMID"]["_Version"].alias("version"), c["Article"]["ArticleTitle"].alias("title"))


@expected("event_id INT, kind VARCHAR", (1, "a"), (2, None))
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    tables.write_records(spark.createDataFrame([(1, "a"), (2, None)], "event_id int, kind string"), folder, "json")
    return tables.json_lines(spark, folder, "event_id int, kind string")


@expected("name VARCHAR, n BIGINT", ("configured", 2), ("not configured", 0))
def optional_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source without a path is an empty table of its schema."""
    folder = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    tables.write_records(spark.createDataFrame([(1,), (2,)], "id int"), folder)
    counts = [tables.optional(spark, path, "id int").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, path in (("configured", folder), ("not configured", ""))]
    return counts[0].unionByName(counts[1])


@expected("k INT, md VARCHAR", (1, "## T\n- **Journal:** J\n- **Year:** 2020\n\nBody"), (2, "## U\n- **Year:** 1999"))
def markdown_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "T", "J", 2020, "Body"), (2, "U", "", 1999, None)], "k int, title string, journal string, year int, body string")
    return rows.select("k", tables.markdown(F.col("title"), {"Journal": F.col("journal"), "Year": F.col("year")}, F.col("body")).alias("md"))


ARTICLE = (
    '<article article-type="review"><front><journal-meta><journal-title-group><journal-title>J of X</journal-title></journal-title-group><issn>1111-2222</issn></journal-meta><article-meta>'
    '<article-id pub-id-type="pmc">5</article-id><article-id pub-id-type="doi">10.1/q</article-id><title-group><article-title>On <italic>X</italic></article-title></title-group>'
    '<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>J</given-names></name></contrib><contrib contrib-type="author"><collab>Group</collab></contrib><contrib contrib-type="editor"><name><surname>No</surname></name></contrib></contrib-group>'
    '<aff id="a1">Inst A</aff><aff id="a2">Inst B</aff><pub-date pub-type="ppub"><year>2019</year></pub-date><pub-date pub-type="epub"><day>5</day><month>3</month><year>2020</year></pub-date>'
    "<volume>7</volume><issue>2</issue><fpage>10</fpage><lpage>12</lpage><abstract><p>Short.</p></abstract><kwd-group><kwd>k1</kwd><kwd>k2</kwd></kwd-group></article-meta></front>"
    "<body><p>Lead.</p><sec><label>1</label><title>Intro</title><p>A.</p><sec><title>Sub</title><p>B.</p></sec></sec></body>"
    '<back><ref-list><ref id="r1"><label>1</label><element-citation><person-group><name><surname>Doe</surname><given-names>J</given-names></name><collab>Team</collab><etal/></person-group><article-title>On Y</article-title><source>Cell</source><year>2018</year><pub-id pub-id-type="pmid">99</pub-id><pub-id pub-id-type="other">z</pub-id></element-citation></ref>'
    '<ref id="r2"><citation-alternatives><element-citation><year>1</year></element-citation><mixed-citation>As <i>written</i>, 2001.</mixed-citation></citation-alternatives></ref><ref id="r3"><label>3</label></ref></ref-list></back></article>'
)


@expected(
    "pmcid VARCHAR, doi VARCHAR, title VARCHAR, journal VARCHAR, issn VARCHAR, place VARCHAR, pub_date VARCHAR, abstract_text VARCHAR, keywords VARCHAR, affiliations VARCHAR, authors VARCHAR, sections VARCHAR, refs VARCHAR",
    ("PMC5", "10.1/q", "On X", "J of X", "1111-2222", "7(2):10-12", "2020-03-05", "Short.", "k1|k2", "Inst A|Inst B", "Doe J|Group", ":Lead.[]|Intro:A.[Sub:B.]", "r1=Doe J, Team, et al. On Y Cell 2018 PMID 99 z|r2=As written, 2001."),
)
def jats_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full text's front matter, sections and references; a reference without any text is none."""
    a = jats.parse_articles(_texts(spark, ARTICLE), "k", "raw")
    people = F.transform("authors", lambda p: F.coalesce(p["collective_name"], F.concat_ws(" ", p["last_name"], p["first_name"])))
    inner = lambda s: F.array_join(F.transform(s["subsections"], lambda x: F.concat(x["title"], F.lit(":"), x["text"])), ",")
    sections = F.transform("sections", lambda s: F.concat(F.coalesce(s["title"], F.lit("")), F.lit(":"), s["text"], F.lit("["), inner(s), F.lit("]")))
    refs = F.transform("references", lambda r: F.concat(r["id"], F.lit("="), r["citation"]))
    joined = {"keywords": F.col("keywords"), "affiliations": F.col("affiliations"), "authors": people, "sections": sections, "refs": refs}
    return a.select("pmcid", "doi", "title", "journal", "issn", F.concat("volume", F.lit("("), "issue", F.lit("):"), "pages").alias("place"), "pub_date", "abstract_text", *(F.array_join(c, "|").alias(n) for n, c in joined.items()))


@expected("name VARCHAR, delay INT, concurrent INT, enabled BOOLEAN", ("none", 334, 8, True), ("key", 100, 8, True), ("all", 500, 16, False))
def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"none": {}, "key": {"litgrid.api_key": "k", "litgrid.admin_email": " "}, "all": {"litgrid.api_key": "k", "litgrid.request_delay_ms": "500", "litgrid.max_concurrent": "16", "litgrid.corpus_enabled": "off"}}
    rows = [(k, s.request_delay_ms, s.max_concurrent, s.corpus_enabled) for k, s in ((k, catalog.Settings.read(v)) for k, v in given.items())]
    return spark.createDataFrame(rows, "name string, delay int, concurrent int, enabled boolean")


@expected("w VARCHAR, event_type VARCHAR, n BIGINT", ("2020-01-01 00:00", "a", 2), ("2020-01-01 00:00", "b", 1), ("2020-01-01 01:00", "a", 1))
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream of files, counted by hour."""
    folder, run = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}", uuid.uuid4().hex
    rows = [("2020-01-01 00:05:00", "a"), ("2020-01-01 00:50:00", "a"), ("2020-01-01 00:59:00", "b"), ("2020-01-01 01:00:00", "a")]
    tables.write_records(spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")), folder)
    stream = flow.file_stream(spark, folder, spark.read.parquet(folder).schema)
    replies.run_into(flow.windowed_counts(stream, "1 hour", "1 hour"), f"{shared_folder(spark)}/out-{run}", f"{shared_folder(spark)}/w-{run}", "complete")
    return spark.read.parquet(f"{shared_folder(spark)}/out-{run}").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("w"), "event_type", "n")


@expected("pos INT, record_id VARCHAR", (1, "b"), (2, "c"), (3, "a"))
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one row by cursor until a page is not full, put together."""
    from litgrid.operators import paging

    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "record_id string, score int")
    found = paging.all_pages(rows, "score", "record_id", 1, 10)
    return spark.createDataFrame([(i, r) for i, r in enumerate(found, 1)], "pos int, record_id string")


ENTITIES = {
    1: ("a &amp; b &lt;i&gt; &quot;c&quot; &apos;", "a & b <i> \"c\" '"),
    2: ("&#233;&#x1F600;&#x41;", "é😀A"),
    3: ("&amp;lt;x&amp;gt; &amp;amp;", "&lt;x&gt; &amp;"),
    4: ("&unknown; &#99999999; &#99999999999999999999999; &", "&unknown; &#99999999; &#99999999999999999999999; &"),
    5: ("x&nbsp;y&#8211;z", "x\u00a0y–z"),
    6: ("", ""),
    7: ("&amp;#65; &#xD800;", "&#65; &#xD800;"),
    8: ("&AMP; &Lt;x&GT; &#X41; &#xe9;", "& <x> A \u00e9"),
    9: ("AT&T; A&T &#x1F9EC;&ampx;", "AT&T; A&T \U0001f9ec&ampx;"),
}
INLINE = {
    1: ("H<sub>2</sub>O and Ca<sup>2+</sup>", "H₂O and Ca²⁺"),
    2: ("x<sup>abc</sup> <i>y</i> <b>z</b>", "x^abc y z"),
    3: ("k<inf>10</inf> 5 < 6", "k₁₀ 5 < 6"),
    4: ("plain", "plain"),
    5: ("CO<SUB>2</SUB><sub></sub>", "CO₂"),
    6: ("a<sub>i</sub>", "a_i"),
}
DATES = {
    1: ("2020", "2020-01-01"),
    2: ("2020 Mar", "2020-03-01"),
    3: ("2020 Mar 5", "2020-03-05"),
    4: ("2019 Jul-Aug", "2019-07-01"),
    5: ("2019 Jan/Feb", "2019-01-01"),
    6: ("2019 Foo", None),
    7: ("2021-02-03", "2021-02-03"),
    8: ("2021/12/31", "2021-12-31"),
    9: ("soon", None),
    10: ("2021 Feb 30", None),
}


def _forms(cases: dict, f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k int, raw string").select("k", f(F.col("raw")).alias("result"))

    return query


for _name, _cases, _f in (("entity_decode", ENTITIES, T.decode_entities), ("inline_flatten", INLINE, T.flatten_inline), ("partial_date_forms", DATES, T.standard_date)):
    _query = _forms(_cases, _f)
    _query.__name__ = _name
    expected("k INT, result VARCHAR", *((k, v[1]) for k, v in _cases.items()))(_query)
