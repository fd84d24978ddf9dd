"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions (by default language, source and size) are quantised at their quantiles; each combination is a cell
with an index on the curve. Rows are ordered by the cell's index and the order is cut into runs of nearly equal bytes, so
a shard spans few values of each dimension and files can be pruned by any of them.

No task sees the whole order. Rows are summed by block (a cell, and in it a salt from the text); the running totals over
cells and over a cell's blocks are made from those sums, and a window within each block adds the rest. The number of
cells and blocks follows from parameters, not from the data. Equal texts stay together, in the cell of the one with the
smallest id, as long as they are under 1/20 of a shard; there are at most 20 times as many larger groups as shards, so those
are told to the rows by a broadcast instead of meeting them in one task, and are cut at any row, after being dealt to salted
blocks of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litgrid.session import ready_checkpoints

SHARDS = 40
OVERHEAD = 16
BITS = 4
#: A group of equal texts of over 1 / WHOLE of a shard may be cut.
WHOLE = 20
BIG_SALTS = 64
MOST_BLOCKS = 1 << 17


def string_code(c: Column) -> Column:
    """A number that orders strings by their first seven bytes; null is smallest."""
    head = F.substring(F.rpad(F.hex(F.encode(c, "UTF-8")), 14, "0"), 1, 14)
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1))


def hilbert(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """cell, curve for every cell; a cell's number has the coordinates' bits one dimension after the other.

    The coordinates are turned into the transposed index in place, bit by bit (Skilling, 2004).
    """
    x = [f"x{i}" for i in range(dims)]
    df = spark.range(1 << (dims * bits)).withColumnRenamed("id", "cell")
    df = df.select("cell", *(F.shiftright("cell", (dims - 1 - i) * bits).bitwiseAND((1 << bits) - 1).alias(x[i]) for i in range(dims)))
    for q in range(bits - 1, 0, -1):
        low = (1 << q) - 1
        for i in range(dims):
            on = F.col(x[i]).bitwiseAND(1 << q) != 0
            swap = F.col("x0").bitwiseXOR(F.col(x[i])).bitwiseAND(low)
            new = {"x0": F.when(on, F.col("x0").bitwiseXOR(F.lit(low))).otherwise(F.col("x0").bitwiseXOR(swap))}
            if i:
                new[x[i]] = F.when(on, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))
            df = df.withColumns(new)
    for i in range(1, dims):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    t = F.lit(0).cast("long")
    for q in range(bits - 1, 0, -1):
        t = F.when(F.col(x[-1]).bitwiseAND(1 << q) != 0, t.bitwiseXOR(F.lit((1 << q) - 1))).otherwise(t)
    df = df.withColumn("t", t).withColumns({c: F.col(c).bitwiseXOR(F.col("t")) for c in x})
    index = F.lit(0).cast("long")
    for q in range(bits - 1, -1, -1):
        for c in x:
            index = index * 2 + F.shiftright(c, q).bitwiseAND(1)
    return df.select("cell", index.alias("curve"))


def assign(docs: DataFrame, dims: dict[str, Column] | None = None, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per row of docs with its shard: doc_id, size, text_crc32, curve, shard (from 0), slot (from 0 in each shard, without gaps).

    docs: doc_id, text and what the dimensions use (numeric columns; by default lang, source, size; a missing one is left
    out); other columns, whatever their names, are not read. size: bytes of the text plus 16; a very long text is a row like
    any other. Shards are cut by bytes. A null text is as an empty one, null dimensions come first, a null doc_id is the
    smallest. Rows at the same place of the curve follow each other by the hash of their text, then by id. Repeated rows get
    slots of their own; an empty table gives no rows.
    """
    ready_checkpoints(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    if dims is None:
        dims = {c: string_code(F.col(c)) for c in ("lang", "source") if c in docs.columns} | {"size": size}
    names = [f"dim{i}" for i in range(len(dims))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group_hash"),
        *(F.coalesce(c.cast("double"), F.lit(float("-inf"))).alias(n) for n, c in zip(names, dims.values(), strict=True)),
    ).checkpoint()
    # one row: the quantiles of each dimension, the totals
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    stats = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *(F.percentile_approx(n, cuts, 10_000).alias(n) for n in names)).first()
    n, total = stats["n"], stats["bytes"] or 1
    cell = F.lit(0)
    for name in names:
        level = F.lit(0)
        for edge in stats[name] or []:
            level = level + (F.col(name) > F.lit(edge)).cast("int")
        cell = cell * (1 << bits) + level
    cells = 1 << (bits * len(names))
    curve = hilbert(docs.sparkSession, len(names), bits)
    rows = rows.select("doc_id", "size", "text_crc32", "group_hash", cell.cast("long").alias("cell"))

    key = ["group_hash", "text_crc32", "size"]
    salts = min(max(1, MOST_BLOCKS // cells), 1 << max(0, math.ceil(math.log2(max(1, n) / (cells * 16)))))
    groups = rows.groupBy(*key).agg(F.sum("size").alias("group_bytes"), F.min(F.struct("doc_id", "cell")).alias("head"))
    big = F.col("group_bytes") * (shards * WHOLE) > F.lit(total)
    groups = groups.withColumn("cell", F.col("head.cell")).join(F.broadcast(curve), "cell").select(*key, "group_bytes", "curve", big.alias("big")).checkpoint()
    # at most shards * WHOLE
    large, plain = F.broadcast(groups.where("big")), rows.drop("cell")
    met = plain.join(large, key).unionByName(plain.join(large, key, "left_anti").join(groups.where("NOT big"), key))
    placed = (
        met
        .withColumn("salt", F.pmod(F.xxhash64("group_hash"), F.lit(salts)))
        .withColumn("own", F.when(F.col("big"), F.col("group_hash")))
        .withColumn("part", F.when(F.col("big"), F.pmod(F.xxhash64("doc_id", "group_hash"), F.lit(BIG_SALTS))).otherwise(F.lit(0)))
        .withColumn("block", F.xxhash64("curve", "salt", "own", "part"))
        .checkpoint()
    )
    blocks = placed.groupBy("curve", "salt", "own", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    by_cell = blocks.groupBy("curve").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = by_cell.select("curve", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    before = Window.partitionBy("curve").orderBy("salt", F.col("own").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.join(F.broadcast(by_cell), "curve").select(
        F.xxhash64("curve", "salt", "own", "part").alias("block"),
        (F.col("n0") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("n0"),
        (F.col("b0") + F.coalesce(F.sum("b").over(before), F.lit(0))).alias("b0"),
    )
    # at most MOST_BLOCKS, and BIG_SALTS for each of the shards * WHOLE large groups
    placed = placed.join(F.broadcast(offsets), "block")
    inside = Window.partitionBy("block").orderBy("group_hash", "text_crc32", "size", "doc_id")
    rows_up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("b0") + F.sum("size").over(rows_up_to)
    group_end = F.col("b0") + F.sum("size").over(Window.partitionBy("block").orderBy("group_hash", "text_crc32", "size"))
    middle = F.when(F.col("big"), end * 2 - F.col("size")).otherwise(group_end * 2 - F.col("group_bytes"))
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * total)).cast("int"))
    ranked = placed.select("doc_id", "size", "text_crc32", "curve", shard.alias("shard"), (F.col("n0") + F.row_number().over(inside) - 1).alias("place")).checkpoint()
    firsts = ranked.groupBy("shard").agg(F.min("place").alias("first"))
    return ranked.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Rows that have a shard and a slot, as one folder of Parquet per shard in the order of the slots."""
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op3_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
