"""Ordered sources, asked one after the other: each only for the keys that the ones before have left open.

What is open after a source is materialised once, with the number of keys known: a source's rows are cut to those keys before
anything is made of them, by a broadcast while the keys are few and by a shuffled join beyond, and a source that nobody needs
is not read. So the plan grows with the number of sources, not with its square, and every source is scanned once at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.operators.chains import Tier, bodyless
from litgrid.operators.resolve import SKIPPED, chain_reason
from litgrid.session import ready_checkpoints

#: Open keys that are told by broadcast.
FEW_KEYS = 200_000
STEP = "tier_no int, tier string, outcome string"


@dataclass
class Chain:
    """found: key, tier and what its rows carry, a row for each key that has a text; steps: key, tier_no, tier, outcome of all that was tried; key: its name."""

    key: str
    found: DataFrame
    steps: DataFrame

    def outcomes(self) -> DataFrame:
        """key, tier (null where none had the text), outcomes (tier and outcome, in order). A key has as many steps as there are sources at most."""
        each = F.array_sort(F.collect_list(F.struct("tier_no", "tier", "outcome")))
        by_key = self.steps.groupBy(self.key).agg(each.alias("each"), F.max(F.when(F.col("outcome") == "found", F.col("tier"))).alias("tier"))
        return by_key.select(self.key, "tier", F.transform("each", lambda s: F.struct(s["tier"].alias("tier"), s["outcome"].alias("outcome"))).alias("outcomes"))

    def reasons(self) -> DataFrame:
        """key, reason of those that no source had a text of."""
        return chain_reason(self.steps.join(self.found.select(self.key), self.key, "left_anti"), self.key)


def open_keys(asked: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The distinct keys, kept, and their number."""
    ready_checkpoints(asked.sparkSession)
    keys = asked.select(key).where(F.col(key).isNotNull()).distinct().checkpoint()
    return keys, keys.count()


def cut_to(rows: DataFrame, keys: DataFrame, n: int, key: str, few: int = FEW_KEYS) -> DataFrame:
    """The rows whose key is among the n keys."""
    return rows.join(F.broadcast(keys) if n <= few else keys, key, "left_semi")


def first_success(asked: DataFrame, key: str, tiers: list[tuple[str, DataFrame]], few: int = FEW_KEYS) -> DataFrame:
    """Rows of the first tier that has each key asked for, with the tier's name. tiers: rows of the same columns, in order of preference."""
    left, n = open_keys(asked, key)
    out = None
    for k, (name, rows) in enumerate(tiers):
        if not n and out is not None:
            break
        own = cut_to(rows, left, n, key, few).withColumn("tier", F.lit(name)).checkpoint()
        out = own if out is None else out.unionByName(own)
        if k + 1 < len(tiers):
            left, n = open_keys(left.join(own.select(key).distinct(), key, "left_anti"), key)
    return out


def run_chain(asked: DataFrame, key: str, tiers: list[Tier], carry: tuple[str, ...] = (), few: int = FEW_KEYS) -> Chain:
    """Asks the tiers in turn. carry: columns of the tiers' rows that come along with a text that is found.

    A tier's answer to a key is the best of its rows: found before others, of several found ones the one with the least
    carried values. A tier without a row is a miss, one that is not configured has `not-attempted` for all that is left. Null
    keys ask for nothing, repeated ones once.
    """
    spark = asked.sparkSession
    left, n = open_keys(asked, key)
    kind = dict(asked.dtypes)[key]
    steps, found = spark.createDataFrame([], f"`{key}` {kind}, {STEP}"), None
    for number, t in enumerate(tiers):
        if not n:
            break
        no, name = F.lit(number).alias("tier_no"), F.lit(t.name).alias("tier")
        if t.rows is None:
            steps = steps.unionAll(left.select(key, no, name, F.lit(SKIPPED).alias("outcome")))
            continue
        told = (
            F.when(F.coalesce("failed", F.lit(False)), "service-error")
            .when(F.coalesce(F.trim("payload") == "", F.lit(True)), "no-fulltext")
            .when(bodyless(F.col("n_sections")), "no-body")
            .otherwise("found")
        )
        rows = cut_to(t.rows.select(key, "payload", "n_sections", "failed", *carry), left, n, key, few)
        best = rows.select(key, F.struct((told != "found").alias("worse"), told.alias("outcome"), *carry).alias("r")).groupBy(key).agg(F.min("r").alias("r"))
        said = left.join(best, key, "left").select(key, F.coalesce("r.outcome", F.lit("miss")).alias("outcome"), *(F.col(f"r.{c}").alias(c) for c in carry)).checkpoint()
        steps = steps.unionAll(said.select(key, no, name, "outcome"))
        own = said.where("outcome = 'found'").select(key, name, *carry)
        found = own if found is None else found.unionAll(own)
        left, n = open_keys(said.where("outcome <> 'found'"), key)
    if found is None:
        some = next((t.rows for t in tiers if t.rows is not None), None)
        carried = "".join(f", `{c}` {k}" for c, k in some.select(*carry).dtypes) if carry and some is not None else ""
        found = spark.createDataFrame([], f"`{key}` {kind}, tier string{carried}")
    return Chain(key, found, steps)
