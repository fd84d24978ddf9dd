"""Tables by name, and sinks for records and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan dealt to all cores if its files give fewer tasks than there are; for work that costs far more than moving the rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)


#: Rows that a task sorts or holds at a time, where rows are dealt out by their number.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys to as many tasks as keep each to TASK_ROWS, keys being alike in number; as they are if the session's own number of tasks does that. The rows are counted for it."""
    n = -(-rows.count() // TASK_ROWS)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A source that may not be configured: without a path an empty table of its schema."""
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def record_xml(spark: SparkSession, path: str, schema: T.StructType | str, row_tag: str) -> DataFrame:
    """Records of an XML file or folder, with the schema given and never inferred."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").option("mode", "PERMISSIVE").schema(schema).load(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows: path, value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def piped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the pipe-delimited match protocol, as rows."""
    return spark.read.text(path).select(F.explode(F.split("value", "\r")).alias("line")).where("trim(line) <> ''")


def write_records(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").format(fmt).save(path)


#: Records of an XML file; Spark reads such a file as a whole in one task.
XML_RECORDS = 50_000


def write_xml(rows: DataFrame, path: str, row_tag: str, root_tag: str, records: int = XML_RECORDS) -> None:
    """Files of a root element each with an element for each row, of so many records at most; columns and fields that begin with an underscore are attributes."""
    rows.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).option("attributePrefix", "_").option("valueTag", "_VALUE").option("maxRecordsPerFile", records).save(path)


def markdown(title: Column, fields: dict[str, Column], body: Column | None = None) -> Column:
    """A record as Markdown: a heading, a line for each field that is there, then the body."""
    lines = [F.concat(F.lit("## "), title), *(F.concat(F.lit(f"- **{k}:** "), F.nullif(v.cast("string"), F.lit(""))) for k, v in fields.items())]
    text = F.concat_ws("\n", *lines)
    return text if body is None else F.concat_ws("\n\n", text, F.nullif(body, F.lit("")))
