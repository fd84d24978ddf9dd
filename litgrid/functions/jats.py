"""Full-text articles in JATS XML, parsed by an Arrow function with the standard library's parser.

Sections nest, which no Spark type can; they come out to a depth of two, with deeper text in its parent at the second level.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from litgrid.session import ready_workers

_SECTION = "struct<title:string,label:string,text:string,subsections:array<struct<title:string,label:string,text:string>>>"
ARTICLE = (
    "parse_failed boolean, article_type string, pmcid string, pmid string, doi string, title string, "
    "authors array<struct<last_name:string,first_name:string,collective_name:string>>, affiliations array<string>, "
    "journal string, issn string, volume string, issue string, pages string, pub_date string, abstract_text string, "
    f"keywords array<string>, sections array<{_SECTION}>, references array<struct<id:string,label:string,citation:string>>"
)
_EMPTY = {"parse_failed": True, "authors": [], "affiliations": [], "keywords": [], "sections": [], "references": []}
#: Articles that are held as Python objects at once.
PARSED = 128
_SPACE = re.compile(r"\s+")


def content(node: ET.Element | None) -> str:
    """All text in document order, with white space collapsed."""
    return "" if node is None else _SPACE.sub(" ", "".join(node.itertext())).strip()


def _find(node: ET.Element | None, path: str) -> ET.Element | None:
    return None if node is None else node.find(path)


def _all(node: ET.Element | None, path: str) -> list[ET.Element]:
    return [] if node is None else node.findall(path)


def _or_none(s: str) -> str | None:
    return s or None


def _authors(meta: ET.Element | None) -> list[dict]:
    out = []
    for c in _all(meta, ".//contrib"):
        if c.get("contrib-type", "author") != "author":
            continue
        name, group = c.find(".//name"), content(c.find("collab"))
        if name is not None or group:
            out.append({"last_name": _or_none(content(_find(name, "surname"))), "first_name": _or_none(content(_find(name, "given-names"))), "collective_name": _or_none(group)})
    return out


def _date(meta: ET.Element | None) -> str | None:
    dates = _all(meta, "pub-date")
    wanted = [[d for d in dates if d.get("pub-type") == "epub"], [d for d in dates if d.get("pub-type") == "ppub"], [d for d in dates if d.get("date-type") == "pub"], dates]
    for group in wanted:
        if group:
            year, month, day = (content(group[0].find(p)) for p in ("year", "month", "day"))
            return "-".join([year, *(x.zfill(2) for x in (month, day) if x)]) if year else None
    return None


def _abstract(meta: ET.Element | None) -> str | None:
    a = _find(meta, "abstract")
    if a is None:
        return None
    parts = []
    for s in a.findall("sec"):
        title = content(s.find("title"))
        body = " ".join(filter(None, (content(p) for p in s if p.tag != "title")))
        parts.append(f"{title}: {body}" if title else body)
    parts = parts or [content(p) for p in a.findall("p")] or [content(a)]
    return _or_none("\n\n".join(filter(None, parts)))


def _flat(sec: ET.Element) -> str:
    """The text of a section's own blocks and of all sections below it."""
    return "\n\n".join(filter(None, (_flat(c) if c.tag == "sec" else content(c) for c in sec if c.tag not in ("label",) and not (c.tag == "title" and not content(c)))))


def _section(sec: ET.Element, depth: int) -> dict | None:
    title, label = _or_none(content(sec.find("title"))), _or_none(content(sec.find("label")))
    blocks = [content(c) for c in sec if c.tag not in ("title", "label", "sec")]
    subs = []
    for s in sec.findall("sec"):
        if depth == 1:
            sub = _section(s, 2)
            if sub:
                subs.append({k: sub[k] for k in ("title", "label", "text")})
        else:
            blocks.append(_flat(s))
    text = "\n\n".join(filter(None, blocks))
    if not text and not subs:
        return None
    return {"title": title, "label": label, "text": text, "subsections": subs}


def _sections(body: ET.Element | None) -> list[dict]:
    """Sections in document order; runs of bare blocks between them are sections without a title."""
    out: list[dict] = []
    bare: list[str] = []

    def close() -> None:
        if any(bare):
            out.append({"title": None, "label": None, "text": "\n\n".join(filter(None, bare)), "subsections": []})
        bare.clear()

    for c in body if body is not None else ():
        if c.tag == "sec":
            close()
            s = _section(c, 1)
            if s:
                out.append(s)
        else:
            bare.append(content(c))
    close()
    return out


# fixed values
ID_LABELS = {"pmid": "PMID", "doi": "DOI", "pmcid": "PMCID"}


def _person(node: ET.Element) -> str:
    if node.tag in ("name", "string-name"):
        return " ".join(filter(None, (content(node.find("surname")), content(node.find("given-names"))))) or content(node)
    return {"collab": content(node), "etal": "et al."}.get(node.tag, "")


def _element_citation(node: ET.Element) -> str:
    """The fields in the order they stand in, persons of a group with commas between, identifiers with what they are; loose text counts."""
    parts = [_SPACE.sub(" ", node.text or "").strip()]
    for field in node:
        value = content(field)
        if field.tag == "person-group":
            value = ", ".join(filter(None, map(_person, field)))
        elif field.tag == "pub-id" and value:
            value = " ".join(filter(None, (ID_LABELS.get(field.get("pub-id-type", "")), value)))
        parts += [value, _SPACE.sub(" ", field.tail or "").strip()]
    return " ".join(filter(None, parts))


def _references(back: list[ET.Element]) -> list[dict]:
    """The references that have any text: as it is written where there is such a form, else put together from the fields."""
    out = []
    for ref in back:
        holder = ref.find("citation-alternatives")
        holder = ref if holder is None else holder
        mixed, element = holder.find("mixed-citation"), holder.find("element-citation")
        text = content(mixed) if mixed is not None else _element_citation(element) if element is not None else ""
        if text:
            out.append({"id": ref.get("id"), "label": _or_none(content(ref.find("label"))), "citation": text})
    return out


def parse(xml: str | None) -> dict:
    """An article as a dict of ARTICLE's fields; what cannot be parsed has parse_failed and nothing else."""
    if not xml or not xml.strip():
        return dict(_EMPTY)
    # no document type is read and so no entity is expanded
    plain = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", xml)
    try:
        root = ET.fromstring(plain)
    except ET.ParseError:
        return dict(_EMPTY)
    article = root if root.tag == "article" else root.find(".//article")
    if article is None:
        return dict(_EMPTY)
    meta, journal = article.find("front/article-meta"), article.find("front/journal-meta")
    ids = {i.get("pub-id-type"): content(i) for i in _all(meta, "article-id")}
    number = ids.get("pmc") or ids.get("pmcid") or ""
    first, last = content(_find(meta, "fpage")), content(_find(meta, "lpage"))
    title = content(_find(journal, "journal-title-group/journal-title")) or content(_find(journal, "journal-title"))
    return {
        "parse_failed": False,
        "article_type": article.get("article-type"),
        "pmcid": f"PMC{re.sub('(?i)^pmc', '', number)}" if number else None,
        "pmid": ids.get("pmid"),
        "doi": ids.get("doi"),
        "title": _or_none(content(_find(meta, "title-group/article-title"))),
        "authors": _authors(meta),
        "affiliations": [x for x in (content(a) for a in _all(meta, "aff")) if x],
        "journal": _or_none(title),
        "issn": _or_none(content(_find(journal, "issn"))),
        "volume": _or_none(content(_find(meta, "volume"))),
        "issue": _or_none(content(_find(meta, "issue"))),
        "pages": f"{first}-{last}" if first and last else _or_none(first or content(_find(meta, "elocation-id"))),
        "pub_date": _date(meta),
        "abstract_text": _abstract(meta),
        "keywords": [x for x in (content(k) for k in _all(meta, "kwd-group/kwd")) if x],
        "sections": _sections(article.find("body")),
        "references": _references(article.findall("back/ref-list/ref")),
    }


def parse_batches(key: str):
    """For mapInArrow over (key, xml): key and ARTICLE's fields, PARSED rows at a time."""
    arrow = to_arrow_schema(T.StructType.fromDDL(ARTICLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARSED):
                batch = whole.slice(at, PARSED)
                parsed = pa.RecordBatch.from_pylist([parse(x) for x in batch.column("xml").to_pylist()], schema=arrow)
                yield pa.record_batch([batch.column("key"), *parsed.columns], names=[key, *parsed.schema.names])

    return run


def parse_articles(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """key and the fields of each row's article."""
    ready_workers(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    schema = T.StructType.fromDDL(f"`{key}` {kind}, {ARTICLE}")
    return rows.selectExpr(f"`{key}` AS key", f"`{xml}` AS xml").mapInArrow(parse_batches(key), schema)
