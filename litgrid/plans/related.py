"""Related records: references, citing records, similar ones, and the chain of providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.operators import related as R
from litgrid.session import ready_checkpoints
from litgrid.sources.tables import table

LINES = ["l_linenumber", "l_suppkey", "l_shipdate"]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *LINES)


def related_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of orders as the references of records."""
    return R.link_page(_edges(spark, sf_dir), "l_orderkey", "l_partkey", LINES, None, 0, 5).select("src", "dst", "pos")


def related_cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.link_page(_edges(spark, sf_dir), "l_partkey", "l_orderkey", ["l_orderkey"], None, 10, 10).select("src", "dst", "pos")


def related_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = R.similar(vectors, vectors.where("vec_id % 20 = 0"), 10)
    return found.select("query_id", "pos", "vec_id", F.round("score", 6).alias("score"))


def related_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first provider without lists for odd records, a second one that has them for multiples of three, a last one."""
    ready_checkpoints(spark)
    links = R.linked(_edges(spark, sf_dir), "l_orderkey", "l_partkey", LINES).checkpoint()  # read by every tier
    tiers = [("first", links.where("src % 2 = 0"), True), ("second", links.where("src % 3 = 0 AND pos <= 3"), True), ("third", links.where("pos = 1"), False)]
    return R.first_provider(links, "src", tiers).select("src", "dst", "pos", "provider")


def related_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose related works are other orders of the same customer, by way of an id map."""
    orders = table(spark, sf_dir, "orders")
    works = orders.select(F.col("o_orderkey").alias("src"), F.array(*[(F.col("o_orderkey") + i).alias("w") for i in (1, 2, 3)]).alias("related"))
    return R.two_hop(works, orders.select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("pmid"))).select("src", "dst", F.col("pos").cast("int").alias("pos"))


_LINKED = """SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY a, b, c, dst) AS pos FROM (
    SELECT {s} AS src, {d} AS dst, l_linenumber AS a, l_suppkey AS b, l_shipdate AS c, row_number() OVER (PARTITION BY {s}, {d} ORDER BY l_linenumber, l_suppkey, l_shipdate) AS n
    FROM lineitem WHERE {s} <> {d}) WHERE n = 1"""
REFERENCES = _LINKED.format(s="l_orderkey", d="l_partkey")
QUERIES = {f.__name__: f for f in (related_references, related_cited_by, related_similar, related_fallback, related_two_hop)}
ORACLES = {
    "related_references": f"SELECT src, dst, CAST(pos AS INT) AS pos FROM ({REFERENCES}) WHERE pos <= 5",
    "related_cited_by": "SELECT src, dst, CAST(pos AS INT) AS pos FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM (SELECT DISTINCT l_partkey AS src, l_orderkey AS dst FROM lineitem WHERE l_partkey <> l_orderkey)) WHERE pos BETWEEN 11 AND 20",
    "related_similar": """
        SELECT query_id, CAST(pos AS INT) AS pos, vec_id, score FROM (
            SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS pos
            FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE pos <= 10""",
    "related_fallback": f"""
        WITH l AS (SELECT src, dst, pos FROM ({REFERENCES})),
        t AS (SELECT *, 'first' AS provider, 1 AS rk FROM l WHERE src % 2 = 0 UNION ALL SELECT *, 'second', 2 FROM l WHERE src % 3 = 0 AND pos <= 3 UNION ALL SELECT *, 'third', 3 FROM l WHERE pos = 1)
        SELECT src, dst, CAST(pos AS INT) AS pos, provider FROM (SELECT *, min(rk) OVER (PARTITION BY src) AS best FROM t) WHERE rk = best""",
    "related_two_hop": """
        WITH w AS (SELECT o_orderkey AS src, unnest([0, 1, 2]) AS i FROM orders)
        SELECT src, o_custkey AS dst, CAST(min(i) AS INT) AS pos FROM w JOIN orders ON o_orderkey = src + i + 1 WHERE o_custkey <> src GROUP BY 1, 2""",
}
