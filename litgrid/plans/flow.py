"""Schedules, streams and the catalogue."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.operators.catalog import ERRORS, error_contract, table_info
from litgrid.session import shared_folder
from litgrid.sources import cursor
from litgrid.sources.tables import TABLES, table
from litgrid.streaming import flow, replies


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event waits before it is tried again, its user's number being how often it was."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("attempt"), flow.backoff_ms(F.col("user_id") % 7).alias("wait_ms"))


def error_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the error they stand for, with what the contract says of it."""
    reasons = sorted(ERRORS)
    kind = F.get(F.array(*map(F.lit, reasons)), (F.col("event_id") % len(reasons)).cast("int"))
    counted = table(spark, sf_dir, "events").groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(error_contract(spark)), "reason")


def admission_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival_ms"))
    return flow.admission(events, "user_id", "event_id", "arrival_ms", 334 * 1000).select("event_id", "start_ms")


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream of files, all that is there; the table is what the stream has counted."""
    schema = table(spark, sf_dir, "events").schema
    folder = _folder(spark, "stream")
    stream = flow.file_stream(spark, f"{sf_dir}/event[s].parquet", schema)
    replies.run_into(flow.counts_by_type(stream), f"{folder}/out", f"{folder}/checkpoint", "complete")
    return spark.read.parquet(f"{folder}/out").select("event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


WITHIN, KEEP, DELAY, BUCKETS = "6 minutes", "1 hour", "10 minutes", 16


def dropped_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three events that follow each other the first is a request, the others are replies; every seventh request and every fifth reply is missing.

    The first half of the time is one run of the stream, the second half another one that goes on with its state.
    """
    events = table(spark, sf_dir, "events")
    asks = F.col("event_id") % 3 == 0
    rows = events.where(F.when(asks, F.col("event_id") % 7 > 0).otherwise(F.col("event_id") % 5 > 0)).select(F.expr("event_id DIV 3").alias("key"), "ts", asks.alias("is_request"))
    middle = F.lit(rows.select((F.unix_micros(F.min(F.col("ts").cast("timestamp"))) / 2 + F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 2).cast("long")).first()[0])
    folder, late = _folder(spark, "replies"), F.unix_micros(F.col("ts").cast("timestamp")) > middle
    for part in (~late, late):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = flow.file_stream(spark, f"{folder}/in", rows.schema, 10_000)
        replies.run_into(replies.settle(stream, WITHIN, KEEP, DELAY, BUCKETS), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(replies.OUT).parquet(f"{folder}/out")


def cursor_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read page by page through cursors, filters and all."""
    cursor.register(spark)
    rows = spark.read.format(cursor.NAME).option("path", f"{sf_dir}/orders.parquet").option("pageSize", 500).load()
    return rows.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_totalprice")


def cursor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream of pages: what is there at first, then from the stored cursors on what has come since."""
    cursor.register(spark)
    orders, folder = table(spark, sf_dir, "orders"), _folder(spark, "cursor")
    for part in ("o_orderkey % 3 = 0", "o_orderkey % 3 > 0"):
        orders.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.format(cursor.NAME).option("path", f"{folder}/in").option("pageSize", 500).load()
        replies.run_into(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(orders.schema).parquet(f"{folder}/out").select("o_orderkey", "o_custkey", "o_totalprice")


def db_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    infos = [table_info(table(spark, sf_dir, t), t) for t in TABLES]
    out = infos[0]
    for i in infos[1:]:
        out = out.unionByName(i)
    return out


KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}
FIELDS = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate",
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "pages": "page_id,url,html",
    "benchmark": "item_id,text",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}
QUERIES = {f.__name__: f for f in (retry_schedule, error_reasons, admission_schedule, stream_ingest, dropped_replies, cursor_batch, cursor_stream, db_info)}


def _literal(*rows: tuple) -> str:
    q = lambda x: "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


ORACLES = {
    "retry_schedule": "SELECT event_id, user_id % 7 AS attempt, CAST(least(1000 * CAST(2 ** (user_id % 7) AS BIGINT), 30000) AS BIGINT) AS wait_ms FROM events",
    "error_reasons": f"""
        WITH c AS (SELECT * FROM (VALUES {_literal(*((k, *v) for k, v in sorted(ERRORS.items())))}) t(reason, code, retryable, hint)), r AS (SELECT *, row_number() OVER (ORDER BY reason) - 1 AS i FROM c)
        SELECT reason, count(*) AS n, any_value(code) AS code, any_value(retryable) AS retryable, any_value(hint) AS hint FROM events JOIN r ON i = event_id % {len(ERRORS)} GROUP BY reason""",
    "admission_schedule": """
        WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS a, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events)
        SELECT event_id, CAST(max(a - i * 334000) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i * 334000 AS BIGINT) AS start_ms FROM e""",
    "dropped_replies": """
        WITH e AS (SELECT event_id // 3 AS key, epoch_us(ts) // 1000 AS t, event_id % 3 = 0 AS asks FROM events WHERE CASE WHEN event_id % 3 = 0 THEN event_id % 7 > 0 ELSE event_id % 5 > 0 END),
        w AS (SELECT max(t) - 600000 AS w FROM e), q AS (SELECT key, min(t) + 360000 AS deadline FROM e WHERE asks GROUP BY key),
        r AS (SELECT key, t, deadline, row_number() OVER (PARTITION BY key ORDER BY t) AS n, max(t) OVER (PARTITION BY key) AS last FROM e LEFT JOIN q USING (key) WHERE NOT asks),
        s AS (SELECT key, CASE WHEN deadline IS NULL OR t > deadline + 3600000 THEN 'unasked' WHEN t > deadline THEN 'late' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS status, t AS at_ms FROM r, w WHERE deadline IS NOT NULL OR last + 3600000 <= w)
        SELECT * FROM s UNION ALL SELECT key, 'not_found', deadline FROM q, w WHERE deadline <= w AND key NOT IN (SELECT key FROM r WHERE t <= deadline)""",
    "cursor_batch": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "cursor_stream": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "stream_ingest": "SELECT event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(30, 6))) AS DOUBLE), 2) AS total FROM events GROUP BY 1",
    "db_info": " UNION ALL ".join(f"SELECT '{t}' AS name, '{f.count(',') + 1} columns by {f.split(',')[0]}' AS description, '{f}' AS fields, CAST({f.count(',') + 1} AS INT) AS n_columns, count(*) AS n_rows, CAST(max({KEYS[t]}) AS BIGINT) AS last_key FROM {t}" for t, f in FIELDS.items()),
}
