"""Mixing sources to target weights by fitting token budgets.

Each source gets a target: its weight's share of all tokens, at most ``REPEATS`` times its own size; what is above goes to the
others by weight, until none is above. A source gives whole documents: all of them as often as the target holds the source
whole, and of the rest of the target some documents once more:

1. documents are counted by exact length;
2. of each length as many are taken as its share of the rest allows, rounded down; lengths from long to short bring the rest
   below ``WINDOW`` tokens; a bounded knapsack (which sums of what is left can be made) fits the last of it;
3. which documents of a length are taken follows from a seeded hash of the id. They are counted by hash bucket first, so only
   the documents of the one bucket where the count ends are put in order. A length, or a source, that a third of all rows
   have is so spread over 4,096 groups.

The knapsack sees one row a length: a source of n tokens has at most sqrt(2 n) lengths. Water levels are found by passes over
one row a source.

Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last in order. A null id is an
id like others. Rows of one id, source and length are ties: which of them is taken doesn't matter, as they are alike here.
Repeated rows count each. Without rows there is no result. Texts of any length are counted whole. Reruns agree for a seed.
Columns beside the named ones are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X

REPEATS = 3
WEIGHTS = (1, 2, 3)
WINDOW = 1 << 16
BUCKETS = 4096
_FIT = "key string, size long, source_size long, target double, whole long, more long"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Orders sources by code point and the null one last; never null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Stored ``sources`` with their place by key, from 0: sorted in ranges, and counted by range first."""
    ranged = X.durable(sources.orderBy("key")).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("key")) - 1
    return ranged.join(F.broadcast(before), "_part").select("key", "source_size", (F.coalesce("_base", F.lit(0)) + place).alias("place"))


def targets(sources: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (key, source_size) with their targets."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = X.durable(_numbered(sources).withColumn("weight", weight))
    most = F.col("source_size") * repeats
    total, share = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / share if share else 0.0
    while True:  # more sources reach their most as the level rises, so this ends; a pass reads one row a source
        full = most < F.col("weight") * level
        taken, left = rows.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (total - (taken or 0)) / left if left else level
        if now <= level:
            break
        level = now
    return rows.select("key", "source_size", F.least(most.cast("double"), F.col("weight") * level).alias("target"))


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int, most: int) -> np.ndarray:
    """How many of each size to take so that their sum is nearest to the budget (ties: below it), among sums up to ``most``.

    Sums that can be made are the bits of one number. A count is split into parts of 1, 2, 4, ... pieces; each sum remembers the
    part that made it first, and the sum without that part was made by earlier ones.
    """
    mask = (1 << (most + 1)) - 1
    reach, made, parts = 1, {0: -1}, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s, n, k = int(sizes[i]), int(counts[i]), 1
        n = min(n, most // s) if s else 0
        while n > 0:
            k = min(k, n)
            new = (reach << (s * k)) & mask & ~reach
            if new:
                reach |= new
                raw = np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8)
                for v in np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist():
                    made[v] = len(parts)
                parts.append((i, k, s * k))
            n, k = n - k, 2 * k
            if reach >> budget & 1:
                n = 0
        if reach >> budget & 1:
            break
    at = min(made, key=lambda v: (abs(v - budget), v))
    take = np.zeros(len(sizes), np.int64)
    while at:
        i, k, s = parts[made[at]]
        take[i] += k
        at -= s
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, window: int = WINDOW) -> tuple[int, np.ndarray]:
    """How often all documents of a source are taken, and of each length how many once more.

    Few lengths leave room for a wider knapsack: up to 2**20 tokens, or 2**29 tokens times lengths.
    """
    window = max(window, min(1 << 20, (1 << 29) // max(len(sizes), 1)))
    total = int(sizes @ counts)
    none = np.zeros(len(sizes), np.int64)
    if not total:
        return 0, none
    whole = int(target // total)
    budget = int(np.floor(target - whole * total + 0.5))
    if budget >= total:
        return whole + 1, none
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)  # exact: products may pass 64 bits
    left = budget - int(sizes @ take)
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if left <= window:
            break
        if s:
            n = min(int(counts[i] - take[i]), left // s, -((window - left) // s))
            take[i] += n
            left -= n * s
    spare = np.where(sizes > 0, counts - take, 0)
    some = spare > 0
    if left > 0 and some.any():
        least = int(sizes[some].min())
        if left <= window:
            take += knapsack(sizes, spare, left, 2 * left)
        elif least - left < left:  # all that is left is longer than the rest
            take[np.flatnonzero(some & (sizes == least))[0]] += 1
    if 0 < budget <= window and int(sizes @ take) != budget:  # shares of each length may stand in the way of a better fit of few documents
        free = knapsack(sizes, counts, budget, 2 * budget)
        if abs(int(sizes @ free) - budget) < abs(int(sizes @ take) - budget):
            take = free
    return whole, take


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, repeats: int = REPEATS, seed: int = 0, window: int = WINDOW) -> DataFrame:
    """Per document: size, its source's size and target, and how many of its tokens the mix takes (``taken``, repeats counted)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), _key(F.col(source)).alias("key"), word_count(F.col(text).cast("string")).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id)).alias("h"))
    d = X.durable(d.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))))
    cells = X.durable(d.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")))
    lengths = cells.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sums = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))

    def fitted(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("size")
        whole, more = fit(x["size"].to_numpy(np.int64), x["n"].to_numpy(np.int64), float(x["target"].iloc[0]), window)
        return pd.DataFrame({"key": x["key"], "size": x["size"], "source_size": x["source_size"], "target": x["target"], "whole": whole, "more": more})

    plan = lengths.join(targets(sums, weights, repeats), "key").groupBy("key").applyInPandas(fitted, _FIT)
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cut = cells.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, ["key", "size"])
    cut = cut.select("key", "size", "bucket", "source_size", "target", "whole", F.least(F.greatest(F.col("more") - F.col("before"), F.lit(0)), F.col("n")).alias("extra"))
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "doc_id"))
    taken = F.col("size") * (F.col("whole") + (F.col("place") <= F.col("extra")).cast("long"))
    return d.withColumn("place", place).join(cut, ["key", "size", "bucket"]).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
