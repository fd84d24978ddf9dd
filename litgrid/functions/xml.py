"""Whether a text is well-formed XML, by a parser."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from litgrid.session import ready_workers

_DOCTYPE = re.compile(r"<!DOCTYPE[^>]*>", re.IGNORECASE)


def parses(text: str) -> bool:
    """Document types are left out first; entities they would have declared count as declared."""
    parser = expat.ParserCreate("utf-8")
    parser.UseForeignDTD(True)
    parser.ExternalEntityRefHandler = lambda *_: 1
    try:
        parser.Parse(_DOCTYPE.sub("", text).strip().encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, ValueError):
        return False
    return True


def well_formed(c: Column) -> Column:
    """Null where the text is null: the parser only sees what it is asked about."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ready_workers(spark)

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else parses(t)).astype("object")

    return check(c)
