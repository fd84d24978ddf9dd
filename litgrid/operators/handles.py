"""Results kept under a handle: a page is written once, with its order, and later queries read the page instead of searching again."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.session import shared_folder

TTL_S = 3600
_NAME = re.compile(r"[0-9a-f]{32}-\d{10,13}")


def _folder(spark: SparkSession, handle: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/handle-{handle}"


def keep(page: DataFrame, position: str, ttl_s: int = TTL_S) -> str:
    """Writes the page's rows and gives the handle, which tells until when it holds."""
    handle = f"{uuid.uuid4().hex}-{int(time.time()) + ttl_s}"
    # one file in the order of the page: a page is of bounded length
    page.orderBy(position).coalesce(1).write.parquet(_folder(page.sparkSession, handle))
    return handle


def read(spark: SparkSession, handle: str) -> DataFrame:
    """The rows kept; a handle that is none, or whose time is over, is an error."""
    if not _NAME.fullmatch(handle):
        raise ValueError(f"no handle: {handle}")
    if int(handle.rpartition("-")[2]) < time.time():
        raise LookupError(f"the handle has expired: {handle}")
    return spark.read.parquet(_folder(spark, handle))


def page(spark: SparkSession, handle: str, position: str, start: int, limit: int) -> DataFrame:
    """A part of the rows kept, by position from 1."""
    return read(spark, handle).where(F.col(position).between(start + 1, start + limit))
