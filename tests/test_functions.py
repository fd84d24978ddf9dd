import pytest
from pyspark.sql import functions as F

from litgrid.functions import cite, jats
from litgrid.functions import records as R
from litgrid.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("<p>P&lt;0.001 <i>x</i></p>", "P<0.001 x"), ("a­b&shy;c", "abc"), ("&amp;amp;", "&amp;"), ("a<b and c>d", "a d"), ("  x  y ", "x y"), ("", ""), (None, None)],
)
def test_display_text(spark, raw, want):
    assert one(spark, raw, T.display_text) == want


@pytest.mark.parametrize(("raw", "limit", "want"), [("a😀b", 2, "a"), ("a😀b", 3, "a😀"), ("abc", 5, "abc"), ("abc", 2, "ab"), ("", 1, "")])
def test_slices_keep_pairs_whole(spark, raw, limit, want):
    assert one(spark, raw, lambda c: T.utf16_slice(c, limit)) == want


def test_utf16_length(spark):
    assert one(spark, "a😀b", T.utf16_length) == 4


@pytest.mark.parametrize(("raw", "want"), [("737-8", ("737", "738")), ("12–15", ("12", "15")), ("e12", ("e12", None)), ("", (None, None)), (None, (None, None))])
def test_pages(spark, raw, want):
    assert (one(spark, raw, T.page_start), one(spark, raw, T.page_end)) == want


@pytest.mark.parametrize(("raw", "want"), [("https://doi.org/10.1/X", "10.1/X"), ("doi: 10.2/y", "10.2/y"), ("11.1/z", None), (" 10.3/a ", "10.3/a")])
def test_doi(spark, raw, want):
    assert one(spark, raw, T.doi) == want


@pytest.mark.parametrize(("raw", "want"), [("a b(c)*", "a%20b(c)*"), ("é&", "%C3%A9%26")])
def test_uri_component(spark, raw, want):
    assert one(spark, raw, T.uri_component) == want


@pytest.mark.parametrize(("raw", "want"), [("<html><body>", "html"), ("<?xml version='1.0'?>", "empty"), ("<a><ERROR>x</ERROR></a>", "error"), ("oops", "invalid"), ("<a/>", "xml"), (None, "empty")])
def test_payload_kind(spark, raw, want):
    assert one(spark, raw, T.payload_kind) == want


def article(spark, **fields):
    authors = fields.pop("authors", None)
    base = dict.fromkeys(n.split()[0] for n in cite.ARTICLE.replace(", ", "\n").split("\n"))
    base |= {"pmid": "1", "title": "A title.", "journal": "J", "year": "2020", "authors": authors} | fields
    return spark.createDataFrame([base], cite.ARTICLE)


def person(last=None, first=None, initials=None, group=None):
    return {"last_name": last, "first_name": first, "initials": initials, "collective_name": group}


@pytest.mark.parametrize(
    ("n", "want"),
    [(1, "A0, X."), (2, "A0, X., & A1, X."), (20, "A18, X., & A19, X."), (21, "A18, X., ... A20, X.")],
)
def test_apa_authors(spark, n, want):
    got = article(spark, authors=[person(f"A{i}", None, "X") for i in range(n)]).select(cite.apa()).first()[0]
    assert want in got


def test_apa_without_authors_or_year(spark):
    assert article(spark, year=None).select(cite.apa()).first()[0] == "(n.d.). A title. *J*."


def test_initials_from_first_names(spark):
    assert article(spark, authors=[person("Öz", "Anne-Marie")]).select(cite.apa()).first()[0].startswith("Öz, A. M. (2020).")


def test_latex_escapes_are_not_escaped_again(spark):
    assert one(spark, "a\\b~{c}^&%", cite.escape_latex) == "a\\textbackslash{}b\\textasciitilde{}\\{c\\}\\textasciicircum{}\\&\\%"


def test_vancouver_counts(spark):
    seven = [person(f"A{i}", None, "XY") for i in range(7)]
    assert "A5 XY, et al. A title." in article(spark, authors=seven, pages="3-9").select(cite.vancouver()).first()[0]
    assert article(spark, year=None, volume="3").select(cite.vancouver()).first()[0] == "A title. J. 3."


RECORD = """<?xml version="1.0"?><PubmedArticle><MedlineCitation><PMID Version="2">0123</PMID><Article>
<Journal><ISSN IssnType="Electronic">1-2</ISSN><JournalIssue><PubDate><MedlineDate>1999 Dec-2000 Jan</MedlineDate></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>On H<sub>2</sub>O &amp; more</ArticleTitle><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText>y</AbstractText></Abstract>
<AuthorList><Author><LastName>Q</LastName><AffiliationInfo><Affiliation>U1</Affiliation></AffiliationInfo></Author>
<Author><CollectiveName>G</CollectiveName><AffiliationInfo><Affiliation>U2</Affiliation></AffiliationInfo><AffiliationInfo><Affiliation>U1</Affiliation></AffiliationInfo></Author></AuthorList>
<GrantList><Grant><GrantID>1</GrantID><Agency>A &amp;amp; B</Agency></Grant></GrantList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="N">M</DescriptorName><QualifierName UI="Q1" MajorTopicYN="Y">q</QualifierName></MeshHeading></MeshHeadingList>
</MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""


def test_record(spark):
    r = R.parse_records(spark.createDataFrame([(RECORD,)], "xml string"), "xml", grants=True).first()
    assert (r["pmid"], r["title"], r["year"], r["doi"], r["e_issn"], r["issn"]) == ("0123", "On H₂O & more", "1999", "10.1/x", "1-2", None)
    assert r["abstract_text"] == "AIM: x\n\ny"
    assert r["affiliations"] == ["U1", "U2"] and [a["affiliation_indices"] for a in r["authors"]] == [[0], [1, 0]]
    assert r["mesh"][0]["is_major"] and r["mesh_terms"] == ["M"]
    assert r["grants"][0]["agency"] == "A & B"


def test_broken_record(spark):
    r = R.parse_records(spark.createDataFrame([("<PubmedArticle><Medl",), (None,)], "xml string"), "xml").collect()
    assert all(x["parse_failed"] and x["title"] is None for x in r)


JATS = """<!DOCTYPE article PUBLIC "x" "y.dtd"><article article-type="review"><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta>
<article-id pub-id-type="pmc">PMC7</article-id><contrib-group><contrib contrib-type="author"><name><surname>S</surname></name></contrib><contrib contrib-type="editor"><name><surname>E</surname></name></contrib></contrib-group>
<pub-date pub-type="ppub"><year>2001</year></pub-date><pub-date pub-type="epub"><year>2000</year><month>2</month></pub-date><fpage>1</fpage><lpage>9</lpage></article-meta></front>
<body><p>bare</p><sec><title>One</title><p>a <i>b</i></p><sec><title>Sub</title><p>c</p><sec><title>Deep</title><p>d</p></sec></sec></sec><sec><title>Empty</title></sec></body>
<back><ref-list><ref id="r1"><label>1</label><mixed-citation>X  Y</mixed-citation></ref></ref-list></back></article>"""


def test_jats():
    a = jats.parse(JATS)
    assert (a["pmcid"], a["pub_date"], a["pages"], a["article_type"], a["journal"]) == ("PMC7", "2000-02", "1-9", "review", "J")
    assert [x["last_name"] for x in a["authors"]] == ["S"]
    assert [s["title"] for s in a["sections"]] == [None, "One"]
    assert a["sections"][1]["text"] == "a b" and a["sections"][1]["subsections"][0]["text"] == "c\n\nDeep\n\nd"
    assert a["references"] == [{"id": "r1", "label": "1", "citation": "X Y"}]
    assert jats.parse("<article><front>")["parse_failed"] and jats.parse(None)["parse_failed"]


def evaluated(spark, c, argument):
    """How often the plan of an expression works out its argument."""
    df = spark.createDataFrame([("x",)], "x string").select(c(F.expr(argument)).alias("c"))
    return df._jdf.queryExecution().optimizedPlan().toString().count(argument.split("(")[0])


def test_inline_tags_and_pages_take_a_text_once(spark):
    """Each of three tags used what the one before made of a text three times, so that the first was worked out 27 times."""
    assert evaluated(spark, T.flatten_inline, "reverse(x)") == 1
    assert evaluated(spark, T.page_start, "reverse(x)") == 1 and evaluated(spark, T.page_end, "reverse(x)") == 1
    assert one(spark, "a<sup>2</sup> b<sub>2</sub> <i>c</i><inf>x</inf>", T.flatten_inline) == "a² b₂ c_x"


def test_plain_text_and_ranges_keep_their_form(spark):
    assert [one(spark, s, cite.escape_latex) for s in ("plain", "", "\u0001a", "_")] == ["plain", "", "\\textbackslash{}a", "\\_"]
    assert [one(spark, s, T.page_end) for s in ("12-7", " - 5", "8", "8-", "110–15")] == ["17", None, None, None, "115"]
    bare = article(spark, authors=None, keywords=None, abstract_text=None).select(cite.ris()).first()[0].split("\n")
    assert bare[0] == "TY  - JOUR" and bare[-1] == "ER  - " and not any(x.startswith(("AU", "KW", "AB")) for x in bare)
