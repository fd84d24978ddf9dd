"""Tables laid out for lookups: partitioned by source, sorted by id in small row groups with Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = "PMC"
ROW_GROUP = 1 << 18
#: References whose ids are named in the filter, so that row groups are skipped by their statistics and Bloom filters.
NAMED = 1000


def write(rows: DataFrame, folder: str, source: str, id_column: str, buckets: int = 4) -> None:
    """A folder for each source; within it files of neighbouring ids, so that statistics tell them apart."""
    placed = rows.repartitionByRange(buckets, id_column).sortWithinPartitions(source, id_column)
    placed.write.partitionBy(source).option("parquet.block.size", ROW_GROUP).option(f"parquet.bloom.filter.enabled#{id_column}", "true").parquet(folder)


def lookup(spark: SparkSession, folder: str, refs: DataFrame, source: str, id_column: str, alias: str | None = None) -> DataFrame:
    """Rows of the references (source, id), each once. Sources prune folders while the query runs; where the references are few their ids reach the row groups.

    alias: a column with archive ids: a reference to the archive finds rows of any source by it as well.
    """
    stored, asked = spark.read.parquet(folder), refs.select(F.col("source").alias(source), F.col("id").alias(id_column)).where(F.col("id").isNotNull()).distinct()
    few = [r[0] for r in asked.select(id_column).distinct().limit(NAMED + 1).collect()]
    own = stored.where(F.col(id_column).isin(few)) if len(few) <= NAMED else stored
    asked = F.broadcast(asked) if len(few) <= NAMED else asked
    found = own.join(asked, [source, id_column], "left_semi")
    if alias is None:
        return found
    archive = [i for i in (r[0] for r in refs.where(F.col("source") == ARCHIVE).select("id").distinct().limit(NAMED + 1).collect())]
    by_alias = stored.where(F.col(alias).isin(archive)) if len(archive) <= NAMED else stored
    ids = refs.where(F.col("source") == ARCHIVE).select(F.col("id").alias(alias)).distinct()
    return found.unionByName(by_alias.where(F.col(source) != ARCHIVE).join(ids, alias, "left_semi").select(found.columns)).distinct()


def sources(folder: str, spark: SparkSession, wanted: list[str], source: str) -> DataFrame:
    """The rows of some sources: only their folders are read."""
    return spark.read.parquet(folder).where(F.col(source).isin(wanted))
