"""Citations in five styles, as Column expressions over an article's fields.

An article is a set of columns (see ARTICLE): pmid, title, abstract_text, authors (an array of structs last_name,
first_name, initials, collective_name), journal, iso_abbreviation, volume, issue, pages, issn, e_issn, year,
article_dates (structs with a year), doi, pmc_id, publication_types, keywords, mesh_terms (names). A field that an
article lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions import text as T

ARTICLE = (
    "pmid string, title string, abstract_text string, "
    "authors array<struct<last_name:string,first_name:string,initials:string,collective_name:string>>, "
    "journal string, iso_abbreviation string, volume string, issue string, pages string, issn string, e_issn string, year string, "
    "article_dates array<struct<year:string,month:string,day:string>>, doi string, pmc_id string, "
    "publication_types array<string>, keywords array<string>, mesh_terms array<string>"
)
# fixed values
BIBTEX_TYPES = {"Book": "book", "Book Chapter": "inbook", "Preprint": "misc"}
RIS_TYPES = {"Book": "BOOK", "Book Chapter": "CHAP", "Preprint": "GEN"}
NO_DATE = "n.d."
ARTICLE_URL = "https://pubmed.ncbi.nlm.nih.gov/"
FULLTEXT_URL = "https://pmc.ncbi.nlm.nih.gov/articles/"


def _given(c: Column) -> Column:
    """A field, null where it is empty; what is more than a field is worked out twice by it, and once by T.nonblank."""
    return F.nullif(c, F.lit(""))


def year() -> Column:
    dated = F.filter("article_dates", lambda d: _given(d["year"]).isNotNull())
    return F.coalesce(_given(F.col("year")), F.get(dated, F.lit(0))["year"], F.lit(NO_DATE))


def _title() -> Column:
    return F.regexp_replace(_given(F.col("title")), r"\.\s*$", "")


def _ended(c: Column) -> Column:
    return T.let(c, lambda x: F.when(x.endswith("."), x).otherwise(F.concat(x, F.lit("."))))


def _initials(a: Column) -> Column:
    """The letters of the initials, or of the parts of the first name, each with a full stop."""
    firsts = F.array_join(F.transform(F.filter(F.split(a["first_name"], r"[\s-]+"), lambda p: p != ""), lambda p: F.substring(p, 1, 1)), "")
    letters = F.regexp_replace(F.coalesce(_given(a["initials"]), firsts), r"[^\p{L}]", "")
    return T.nonblank(F.trim(F.regexp_replace(letters, "(.)", "$1. ")))


def _apa_author(a: Column) -> Column:
    last = F.coalesce(a["last_name"], F.lit(""))
    person = T.let(_initials(a), lambda initials: F.when(initials.isNull(), last).when(last == "", initials).otherwise(F.concat(last, F.lit(", "), initials)))
    return F.coalesce(_given(a["collective_name"]), person)


def apa_authors(authors: Column) -> Column:
    def joined(names: Column) -> Column:
        n, final = F.size(names), F.element_at(names, -1)
        return (
            F.when(n == 1, F.get(names, F.lit(0)))
            .when(n.between(2, 20), F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", & "), final))
            .when(n > 20, F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", ... "), final))
        )

    return T.let(F.transform(authors, _apa_author), joined)


def apa() -> Column:
    issue = F.coalesce(F.concat(F.lit("("), _given(F.col("issue")), F.lit(")")), F.lit(""))
    volume = F.coalesce(F.concat(F.lit(", *"), _given(F.col("volume")), F.lit("*"), issue), F.lit(""))
    pages = F.coalesce(F.concat(F.lit(", "), _given(F.col("pages"))), F.lit(""))
    return F.concat_ws(
        " ",
        _ended(T.nonblank(apa_authors(F.col("authors")))),
        F.concat(F.lit("("), year(), F.lit(").")),
        F.concat(_title(), F.lit(".")),
        F.concat(F.lit("*"), _given(F.col("journal")), F.lit("*"), volume, pages, F.lit(".")),
        F.concat(F.lit("https://doi.org/"), _given(F.col("doi"))),
    )


def _mla_author(a: Column, inverted: bool) -> Column:
    last, first = _given(a["last_name"]), _given(a["first_name"])
    both = F.concat(last, F.lit(", "), first) if inverted else F.concat(first, F.lit(" "), last)
    return F.coalesce(_given(a["collective_name"]), both, last, first, F.lit(""))


def mla_authors(authors: Column) -> Column:
    n, first = F.size(authors), _mla_author(F.get(authors, F.lit(0)), True)
    return F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(", and "), _mla_author(F.get(authors, F.lit(1)), False))).when(n > 2, F.concat(first, F.lit(", et al.")))


def mla() -> Column:
    pages = _given(F.col("pages"))
    details = F.concat_ws(
        ", ",
        F.concat(F.lit("*"), F.col("journal"), F.lit("*")),
        F.concat(F.lit("vol. "), _given(F.col("volume"))),
        F.concat(F.lit("no. "), _given(F.col("issue"))),
        F.nullif(year(), F.lit(NO_DATE)),
        F.concat(F.when(pages.rlike("[-–—]"), "pp. ").otherwise("p. "), pages),
    )
    return F.concat_ws(
        " ",
        _ended(T.nonblank(mla_authors(F.col("authors")))),
        F.concat(F.lit('"'), _title(), F.lit('."')),
        F.when(_given(F.col("journal")).isNotNull(), F.concat(details, F.lit("."))),
        F.concat(F.lit("https://doi.org/"), _given(F.col("doi")), F.lit(".")),
    )


def escape_latex(c: Column) -> Column:
    """Special characters escaped once: those whose escapes have braces are set apart until the others are done; most texts have none."""
    apart = {"\\": ("\u0001", "\\textbackslash{}"), "~": ("\u0002", "\\textasciitilde{}"), "^": ("\u0003", "\\textasciicircum{}")}
    out = F.translate(c, "".join(apart), "".join(mark for mark, _ in apart.values()))
    out = F.regexp_replace(out, r"[&%$#_{}]", r"\\$0")
    for mark, text in apart.values():
        out = F.replace(out, F.lit(mark), F.lit(text))
    return F.when(c.rlike(r"[\\~^&%$#_{}\x01-\x03]"), out).otherwise(c)


def _bibtex_author(a: Column) -> Column:
    last, first = escape_latex(_given(a["last_name"])), escape_latex(_given(a["first_name"]))
    after = F.coalesce(F.concat(F.lit(", "), first), F.lit(""))
    return F.coalesce(F.concat(F.lit("{"), escape_latex(_given(a["collective_name"])), F.lit("}")), F.concat(F.lit("{"), last, F.lit("}"), after), first)


def _mapped_type(table: dict[str, str], fallback: str) -> Column:
    known = F.filter("publication_types", lambda t: t.isin(*table))
    lookup = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(lookup[F.get(known, F.lit(0))], F.lit(fallback))


def all_keywords() -> Column:
    """Keywords, then vocabulary names, each once."""
    names = F.filter(F.coalesce("mesh_terms", F.array().cast("array<string>")), lambda m: _given(m).isNotNull())
    return F.array_distinct(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), names))


def bibtex() -> Column:
    names = F.array_join(F.filter(F.transform("authors", _bibtex_author), lambda x: x.isNotNull()), " and ")
    words = F.array_join(F.transform(all_keywords(), lambda k: F.concat(F.lit("{"), escape_latex(k), F.lit("}"))), ", ")
    fields = {
        "author": T.nonblank(names),
        "title": F.concat(F.lit("{"), escape_latex(_title()), F.lit("}")),
        "journal": escape_latex(_given(F.col("journal"))),
        "year": F.nullif(year(), F.lit(NO_DATE)),
        "volume": escape_latex(_given(F.col("volume"))),
        "number": escape_latex(_given(F.col("issue"))),
        "pages": escape_latex(_given(F.col("pages"))),
        "issn": escape_latex(F.coalesce(_given(F.col("issn")), _given(F.col("e_issn")))),
        "doi": _given(F.col("doi")),
        "pmid": F.col("pmid"),
        "pmcid": _given(F.col("pmc_id")),
        "keywords": T.nonblank(words),
    }
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items())), lambda x: x["v"].isNotNull())

    def entry(kept: Column) -> Column:
        width = F.array_max(F.transform(kept, lambda x: F.length(x["k"])))
        return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("  "), F.rpad(x["k"], width, F.lit(" ")), F.lit(" = {"), x["v"], F.lit("}"))), ",\n")

    return F.concat(F.lit("@"), _mapped_type(BIBTEX_TYPES, "article"), F.lit("{pmid"), F.col("pmid"), F.lit(",\n"), T.let(pairs, entry), F.lit("\n}"))


def _tag(code: str, c: Column) -> Column:
    return F.concat(F.lit(f"{code}  - "), _given(c))


def _made(code: str, c: Column) -> Column:
    """A tag of what is more than a field."""
    return F.concat(F.lit(f"{code}  - "), T.nonblank(c))


def ris() -> Column:
    def author(a: Column) -> Column:
        last, first = F.coalesce(a["last_name"], F.lit("")), _given(a["first_name"])
        return F.coalesce(_given(a["collective_name"]), F.concat(last, F.lit(", "), first), _given(last))

    def each(code: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(f"{code}  - "), v))

    # tags and lists of tags that are null are left out
    return F.concat_ws(
        "\n",
        _tag("TY", _mapped_type(RIS_TYPES, "JOUR")),
        each("AU", F.transform("authors", author)),
        _tag("TI", F.col("title")),
        _tag("JF", F.col("journal")),
        _tag("JO", F.col("iso_abbreviation")),
        _tag("PY", F.nullif(year(), F.lit(NO_DATE))),
        _tag("VL", F.col("volume")),
        _tag("IS", F.col("issue")),
        _made("SP", T.page_start(F.col("pages"))),
        _made("EP", T.page_end(F.col("pages"))),
        _tag("SN", F.coalesce(_given(F.col("issn")), F.col("e_issn"))),
        _tag("DO", F.col("doi")),
        _tag("AN", F.col("pmid")),
        _tag("UR", F.concat(F.lit(ARTICLE_URL), F.col("pmid"), F.lit("/"))),
        _tag("UR", F.concat(F.lit(FULLTEXT_URL), _given(F.col("pmc_id")), F.lit("/"))),
        each("KW", all_keywords()),
        _made("AB", T.collapse(F.col("abstract_text"))),
        F.lit("ER  - "),
    )


def vancouver() -> Column:
    """Authors by last name and initials (six at most), title, abbreviated journal, then year, volume, issue and pages."""

    def author(a: Column) -> Column:
        last = _given(a["last_name"])
        person = T.let(F.regexp_replace(_initials(a), r"[. ]", ""), lambda initials: F.coalesce(F.concat(last, F.lit(" "), initials), last, initials))
        return F.coalesce(_given(a["collective_name"]), person)

    names = F.filter(F.transform("authors", author), lambda x: x.isNotNull())
    shown = T.let(names, lambda x: F.concat(F.array_join(F.slice(x, 1, 6), ", "), F.when(F.size(x) > 6, ", et al").otherwise("")))
    issue = F.coalesce(F.concat(F.lit("("), _given(F.col("issue")), F.lit(")")), F.lit(""))
    place = F.concat_ws(";", F.nullif(year(), F.lit(NO_DATE)), F.concat(_given(F.col("volume")), issue))
    place = T.nonblank(F.concat_ws(":", T.nonblank(place), _given(F.col("pages"))))
    return F.concat_ws(
        " ",
        _ended(T.nonblank(shown)),
        F.concat(_title(), F.lit(".")),
        F.concat(F.regexp_replace(F.coalesce(_given(F.col("iso_abbreviation")), _given(F.col("journal"))), r"\.\s*$", ""), F.lit(".")),
        F.concat(place, F.lit(".")),
        F.concat(F.lit("doi: "), _given(F.col("doi"))),
    )


STYLES = {"apa": apa, "mla": mla, "bibtex": bibtex, "ris": ris, "vancouver": vancouver}


def cite(articles: DataFrame, *styles: str) -> DataFrame:
    """pmid, style, citation: a row for each article and style."""
    pairs = [F.struct(F.lit(s).alias("style"), STYLES[s]().alias("citation")) for s in styles]
    return articles.select("pmid", F.inline(F.array(*pairs)))
