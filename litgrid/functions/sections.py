"""The sections of full texts as rows, from JATS XML of any depth; in SQL a table function for lateral joins.

A row for each section in document order: its path of places from 1, its depth, order, title, label, its own text (of its
paragraphs, not of its subsections) and that text's size in UTF-16 units, so that filters and budgets take parsed sections.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from litgrid.functions.jats import PARSED, content
from litgrid.session import ready_workers

SECTION = "path string, parent string, depth int, ord int, title string, label string, text string, size int"
_DOCTYPE = re.compile(r"<!DOCTYPE[^>]*>", re.IGNORECASE)
_OWN = {"title", "label", "sec"}


def _units(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def rows(xml: str | None) -> Iterator[tuple]:
    """Text of a body that stands before or between its sections is a section of its own without a title. What is no XML has none."""
    if not xml:
        return
    try:
        body = ET.fromstring(_DOCTYPE.sub("", xml)).find(".//body")
    except ET.ParseError:
        return
    if body is None:
        return
    order = 0
    stack = [(node, "", 1, str(k)) for k, node in reversed(list(enumerate(_sections(body), 1)))]
    while stack:
        node, parent, depth, place = stack.pop()
        path = f"{parent}.{place}" if parent else place
        order += 1
        own = [content(x) for x in node if x.tag not in _OWN] if node.tag == "sec" else [content(node)]
        text = "\n\n".join(t for t in own if t)
        yield path, parent or None, depth, order, content(node.find("title")) or None, content(node.find("label")) or None, text, _units(text)
        inner = [x for x in node if x.tag == "sec"] if node.tag == "sec" else []
        stack += [(x, path, depth + 1, str(k)) for k, x in reversed(list(enumerate(inner, 1)))]


def _sections(body: ET.Element) -> list[ET.Element]:
    out: list[ET.Element] = []
    for x in body:
        if x.tag == "sec":
            out.append(x)
        elif out and out[-1].tag == "lead":
            out[-1].append(x)
        else:
            lead = ET.Element("lead")
            lead.append(x)
            out.append(lead)
    return out


@F.udtf(returnType=SECTION, useArrow=True)
class Sections:
    def eval(self, xml: str) -> Iterator[tuple]:
        yield from rows(xml)


def parse_batches(xml: str):
    """For mapInArrow: the other columns and SECTION's for each section, of PARSED articles at a time."""
    arrow = to_arrow_schema(T.StructType.fromDDL(SECTION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARSED):
                batch = whole.slice(at, PARSED)
                found = [(k, r) for k, x in enumerate(batch.column(xml).to_pylist()) for r in rows(x)]
                own = batch.drop_columns([xml]).take(pa.array([k for k, _ in found], pa.int64()))
                parsed = [pa.array([r[i] for _, r in found], f.type) for i, f in enumerate(arrow)]
                yield pa.record_batch([*own.columns, *parsed], names=[*own.schema.names, *arrow.names])

    return run


def sections(articles: DataFrame, xml: str) -> DataFrame:
    """The articles' columns but the XML, with a row for each section."""
    ready_workers(articles.sparkSession)
    schema = T.StructType([*articles.drop(xml).schema.fields, *T.StructType.fromDDL(SECTION).fields])
    return articles.mapInArrow(parse_batches(xml), schema)


def register(spark: SparkSession) -> None:
    """litgrid_sections(xml) in SQL."""
    ready_workers(spark)
    spark.udtf.register("litgrid_sections", Sections)
