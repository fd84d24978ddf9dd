"""Quality classifier by compression: how much better a dictionary of good texts compresses a text than one of bad texts.

Two zstandard dictionaries are trained from labelled texts, one from good ones and one from bad ones. A text is compressed
with both, in blocks of a fixed size so that the dictionary counts alike in short and long texts; the difference of the
compressed sizes divided by the text's size is mapped to a probability by a monotone calibration that is fitted on other
labelled texts. Only the dictionaries and the calibration use labels, from a bounded sample of the rows: whole texts, cut into
blocks over all their length, of which the dictionaries take a sample in turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.llm.batches import map_texts
from litgrid.llm.bytesops import as_bytes

#: Labelled rows of each label that are used at most, half for the dictionary and half for the calibration.
SAMPLE_ROWS = 6000
#: Bytes in a block.
BLOCK = 500
#: Blocks of each label that a dictionary is trained on at most, drawn from all blocks of the sampled texts.
SAMPLE_BLOCKS = 4000
DICT_BYTES = 256 << 10
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5


@dataclass
class Model:
    """What scoring needs: two dictionaries and the calibration's points. Its size does not depend on the corpus."""

    bad: bytes = b""
    good: bytes = b""
    xs: np.ndarray = field(default_factory=lambda: np.zeros(1))
    ps: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))
    block: int = BLOCK
    level: int = LEVEL

    def difference(self):
        """What `difference` takes besides the texts."""
        return _compressor(self.bad, self.level), _compressor(self.good, self.level), self.block

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.xs, self.ps)


def _compressor(data: bytes, level: int) -> zstandard.ZstdCompressor:
    plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(data) < 8:
        return zstandard.ZstdCompressor(**plain)
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, **plain)


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of these samples: trained, or where they are too few for that their end as it is."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def difference(texts: list[bytes], how: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor, int]) -> np.ndarray:
    """Of each text: compressed size with the bad dictionary less that with the good one, divided by its size; 0 for an empty one."""
    bad, good, size = how
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        d = 0
        for i in range(0, len(t), size):
            block = t[i : i + size]
            d += len(bad.compress(block)) - len(good.compress(block))
        if t:
            out[k] = d / len(t)
    return out


def calibration(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of an increasing curve from x to the chance of label 1: a logistic curve with a little weight, else the isotonic fit."""
    if not len(x):
        return np.zeros(1), np.full(1, 0.5)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x, y, strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += t
    xs = np.array([b[2] / b[1] for b in blocks])
    ps = np.array([b[0] / b[1] for b in blocks])
    spread = max(x.std(), 1e-6)
    grid = np.unique(np.concatenate([xs, np.linspace(x[0] - 3 * spread, x[-1] + 3 * spread, 257)]))
    smooth = 1 / (1 + np.exp(-(grid - np.median(x)) / spread))
    return grid, np.clip(0.98 * np.interp(grid, xs, ps) + 0.02 * smooth, 0.0, 1.0)


def _fold(id_column: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds, F.lit(1))


def _blocks(texts: DataFrame, size: int) -> DataFrame:
    """quality, mark (a hash by which a sample is drawn), block: all blocks of whole texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(q, d, i, t[i : i + size]) for q, d, t in zip(batch.column("quality").to_pylist(), batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True) for i in range(0, len(t), size)]
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["quality", "doc_id", "at", "block"])

    return map_texts(texts.select("quality", "doc_id", "text"), run, "quality int, doc_id long, at long, block binary").withColumn("mark", F.xxhash64("doc_id", "at", F.lit("block")))


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK, level: int = LEVEL, dict_bytes: int = DICT_BYTES, left_out: tuple[int, ...] = (0,)) -> Model:
    """A model from the labelled rows whose fold is not left out; docs: doc_id, text; labels: doc_id, quality (0 or 1; other rows are left out). Other columns, whatever their names, are not read.

    Of each label sample_rows rows are used at most, those first by a hash of the id, and of their blocks SAMPLE_BLOCKS. Rows
    with a null doc_id or text have no part; labels that repeat an id count once, with the smaller label; texts that repeat an
    id all count. Without any labelled row the score is 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~_fold(F.col("doc_id"), folds).isin(*left_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    mark = F.xxhash64("doc_id", F.lit("sample"))
    picks = [known.where(F.col("quality") == q).orderBy(mark, "doc_id").limit(sample_rows) for q in (0, 1)]
    # at most 2 * sample_rows ids with a digit each
    sample = picks[0].unionAll(picks[1]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    blocks = _blocks(texts.where("part = 0"), block)
    drawn = [[bytes(r["block"]) for r in blocks.where(F.col("quality") == q).orderBy("mark", "doc_id", "at", "block").limit(SAMPLE_BLOCKS).collect()] for q in (0, 1)]
    model = Model(*(dictionary(x, dict_bytes) for x in drawn), block=block, level=level)
    rest = differences(texts.where("part = 1").select("doc_id", "text", "quality"), model, "quality")
    pairs = rest.orderBy("doc_id", "x").limit(2 * sample_rows).collect()
    model.xs, model.ps = calibration(np.array([r["x"] for r in pairs]), np.array([r["quality"] for r in pairs]))
    return model


def differences(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns named and x, the normalised difference of the compressed sizes of the whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *keep]

    def run(batch: pa.RecordBatch, how: tuple) -> pa.RecordBatch:
        x = difference(as_bytes(batch.column("text")), how)
        return pa.record_batch([*(batch.column(n) for n in names), pa.array(x)], names=[*names, "x"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return map_texts(docs, run, f"{schema}, x double", lambda: shared.value.difference())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out (fold 0: not learned from), score (0 to 1, higher: label 1 likelier), predicted (1 from the threshold on) of each row.

    docs: doc_id, text; other columns, whatever their names, are not read. A null or empty text has no difference and gets the
    calibration's value at 0. A very long text is compressed block by block. Equal texts have equal scores. A row with a null
    doc_id is not held out. Repeated rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch, how: tuple) -> pa.RecordBatch:
        s = shared.value.score(difference(as_bytes(batch.column("text")), how))
        return pa.record_batch([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double", lambda: shared.value.difference())
    return scored.select("doc_id", (_fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch, how: tuple) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.score(difference(as_bytes(batch.column("text")), how)) >= threshold))

    return map_texts(docs, run, docs.schema, lambda: shared.value.difference())


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
