"""Citation matching by whatever fields a request gives: request lines, matching by patterns of fields, replies.

Requests that give the same fields form a pattern, of which there are at most 2 ** len(FIELDS). For every pattern that occurs,
records are grouped by its fields' values, so that a request meets one row with the number of records and the first few ids,
however many records there are; a request with a year alone costs no more than one with a page. Before that, where the records
are read, a bit map of what is asked for drops the values of a record that no request has, and few others pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("journal", "year", "volume", "page", "author")
#: Candidates that a reply lists.
LISTED = 10
#: Bits of hashes that choose a word of the bit map; its words are broadcast, so there are 2 ** WORDS of them at most.
WORDS = 20


def _given(c: Column) -> Column:
    """A field as it is compared: trimmed, in lower case; a blank one is none."""
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def request_line(rows: DataFrame, key: str) -> Column:
    """A line of the request protocol: the five fields, then the key, each closed by a bar; bars and line breaks in fields become spaces."""
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]", " ")
    return F.concat(*(x for f in (*FIELDS, key) for x in (text(f), F.lit("|"))))


def parse_request_line(line: Column) -> Column:
    """A struct of the fields (null where left out) and the key."""
    parts = F.split(line, r"\|")
    return F.struct(*(F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(f) for i, f in enumerate((*FIELDS, "key"))))


def _mask(rows: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(FIELDS)))


def _keyed(rows: DataFrame, mask: Column) -> Column:
    """The values of a pattern's fields as one key, none of which can be mistaken for another's."""
    each = (F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.concat(F.length(f).cast("string"), F.lit(":"), F.col(f))).otherwise(F.lit("-")) for i, f in enumerate(FIELDS))
    return F.concat_ws(" ", *each)


def _hashed(mask: Column) -> Column:
    """A hash of a pattern and the values of its fields."""
    return F.xxhash64(mask, *(F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.col(f)) for i, f in enumerate(FIELDS)))


def _word(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - WORDS)


def _bit(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(63)).cast("int")


def _requests(asked: DataFrame) -> DataFrame:
    rows = asked.select("key", *(_given(F.col(f)).alias(f) for f in FIELDS))
    rows = rows.withColumn("mask", _mask(rows))
    return rows.select("key", "mask", _keyed(rows, F.col("mask")).alias("fields"), _hashed(F.col("mask")).alias("hashed"), (F.col("journal").isNotNull() | F.col("year").isNotNull()).alias("valid"))


def _wanted(requests: DataFrame) -> DataFrame:
    """word, bits: the bit map of the hashes of valid requests, without its empty words."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("hashed")))
    return requests.where("valid").groupBy(_word(F.col("hashed")).alias("word")).agg(F.bit_or(one).alias("bits"))


def _by_pattern(requests: DataFrame, records: DataFrame, id_column: str) -> DataFrame:
    """mask, fields, id of the records under every pattern asked for; those with a null in a pattern's fields are not under it.

    All records that a request wants are there, and few that none does.
    """
    masks = sorted(r["mask"] for r in requests.where("valid").select("mask").distinct().collect())  # at most 2 ** len(FIELDS)
    rows = records.select(*(_given(F.col(f)).alias(f) for f in FIELDS), F.col(id_column).alias("id"))
    rows = rows.withColumn("has", _mask(rows)).withColumn("mask", F.explode(F.array(*map(F.lit, masks)) if masks else F.array().cast("array<int>")))
    rows = rows.where(F.col("has").bitwiseAND(F.col("mask")) == F.col("mask")).withColumn("hashed", _hashed(F.col("mask")))
    asked = F.call_function("shiftright", F.col("bits"), _bit(F.col("hashed"))).bitwiseAND(F.lit(1)) == 1
    rows = rows.join(F.broadcast(_wanted(requests)), (_word(F.col("hashed")) == F.col("word")) & asked, "left_semi")
    return rows.select("mask", _keyed(rows, F.col("mask")).alias("fields"), "id")


def candidates(asked: DataFrame, records: DataFrame, id_column: str) -> DataFrame:
    """key, id of all records that agree in all fields given, as rows."""
    requests = _requests(asked)
    return requests.where("valid").join(_by_pattern(requests, records, id_column), ["mask", "fields"]).select("key", "id")


def match(asked: DataFrame, records: DataFrame, id_column: str) -> DataFrame:
    """key, status, matched_id, n_candidates, candidates (the first LISTED ids, rising) for each row of asked (key and FIELDS).

    Fields that are null or blank are left out; the others must all agree, in any case. One record is a match, several are
    ambiguous, none is not found; without journal and year the request is invalid. Repeated keys each give a row.
    """
    requests = _requests(asked)
    rows = _by_pattern(requests, records, id_column)
    order = Window.partitionBy("mask", "fields").orderBy("id")
    few = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= LISTED).groupBy("mask", "fields").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = rows.groupBy("mask", "fields").agg(F.count("*").alias("n")).join(few, ["mask", "fields"])
    found = requests.join(groups, ["mask", "fields"], "left")
    n = F.coalesce("n", F.lit(0))
    return found.select(
        "key",
        F.when(~F.col("valid"), "invalid").when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("not_found").alias("status"),
        F.when(n == 1, F.get("ids", F.lit(0))).alias("matched_id"),
        n.cast("long").alias("n_candidates"),
        F.when(n > 1, F.col("ids")).alias("candidates"),
    )


def reply_line(matches: DataFrame) -> Column:
    """A line of the reply protocol: five empty fields, the key and what was found."""
    many = F.concat(F.lit("AMBIGUOUS "), F.array_join(F.transform("candidates", lambda i: i.cast("string")), ","))
    told = F.when(F.col("status") == "matched", F.col("matched_id").cast("string")).when(F.col("status") == "ambiguous", many).when(F.col("status") == "invalid", "NOT_FOUND;INVALID_REQUEST").otherwise("NOT_FOUND")
    return F.concat(F.lit("|||||"), F.col("key").cast("string"), F.lit("|"), told)
