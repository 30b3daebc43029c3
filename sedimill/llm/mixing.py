"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a total by weight; a target stops at ``most`` times its source's size
and what is left over is shared again. A source's whole passes come first; the rest
of its budget is fitted on the number of documents of each exact length: an even
share of every length, then a bounded-knapsack DP for the words still missing.
Which documents of a length are taken is decided by a seeded hash.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source
is a source of its own, last in order; repeated rows are separate documents; an
empty table gives an empty result. Only the per-source sums (one row per source)
reach the driver. Further columns are carried along whatever their names, but for
source_size, target and repeats, which the result's own replace.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked

#: Words that the dynamic programming may have to fill; even shares come below that first.
WINDOW = 1 << 15


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text: each word end loses one character when it becomes one space."""
    t = F.concat(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), F.lit(" "))
    return (F.length(t) - F.length(F.regexp_replace(t, "[^ ] ", " "))).cast("long")


def shared_targets(sizes: dict, share: float = 1.5, weights: tuple = (3, 1, 2), most: float = 2.0) -> dict:
    """Each source's target. ``sizes``: words by source, None for the null source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        per = left / sum(weigh[s] for s in open_)
        full = [s for s in open_ if weigh[s] * per > most * sizes[s]]
        if not full:
            return out | {s: weigh[s] * per for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fitted_counts(size: np.ndarray, n: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, for a sum as near below ``budget`` as can be."""
    order = np.argsort(-size, kind="stable")
    size, n = size[order].tolist(), n[order].tolist()
    total = sum(a * b for a, b in zip(size, n, strict=True))
    budget = min(budget, total)
    take = [b * budget // total if total else 0 for b in n]
    left = budget - sum(a * b for a, b in zip(size, take, strict=True))
    for i, a in enumerate(size):  # one more of each of the longest, until the window can hold the rest
        if left <= WINDOW:
            break
        more = min(n[i] - take[i], max(1, (left - WINDOW) // max(a, 1)), left // a if a else 0)
        take[i] += more
        left -= more * a
    reach, items, mask = 1, [], (1 << (left + 1)) - 1
    for i, a in enumerate(size):
        free = min(n[i] - take[i], left // a) if a else 0
        part = 1
        while free > 0 and not reach >> left & 1:
            c = min(part, free)
            items.append((i, c, reach))
            reach |= (reach << (a * c)) & mask
            free -= c
            part *= 2
    at = reach.bit_length() - 1
    for i, c, before in reversed(items):
        if not before >> at & 1:
            take[i] += c
            at -= c * size[i]
    out = np.zeros(len(size), np.int64)
    out[order] = take
    return out


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size")
    budget = int(frame["_budget"].iloc[0])
    return pd.DataFrame({"_skey": frame["_skey"], "size": frame["size"], "_take": fitted_counts(frame["size"].to_numpy(), frame["_n"].to_numpy(), budget)})


def mixed(docs: DataFrame, source: str = "source", size: str = "size", doc_id: str = "doc_id", share: float = 1.5, weights: tuple = (3, 1, 2), most: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with source_size, target and repeats (how many times the mix takes the document).

    ``docs`` must have the word count in column ``size`` and is read four times.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("source_size", "target", "repeats")]
    docs = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row_of"), F.col(f"`{size}`").cast("long").alias("_words"), F.col(f"`{doc_id}`").alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("-")).alias("_skey"),
    )
    sums = {r["_skey"]: r["n"] for r in docs.groupBy("_skey").agg(F.coalesce(F.sum("_words"), F.lit(0)).alias("n")).collect()}  # one row per source
    plain = {(k[1:] if k[0] == "s" else None): v for k, v in sums.items()}
    rows = []
    for s, target in shared_targets(plain, share, weights, most).items():
        words = plain[s]
        whole = min(int(most), int(target / words)) if words else 0
        rows.append(("-" if s is None else "s" + s, int(words), float(target), whole, max(0, math.floor(target - whole * words + 0.5)) if whole < most else 0))
    plan = spark.createDataFrame(rows, "_skey string, source_size long, target double, _whole int, _budget long")
    lengths = docs.where("_words > 0").groupBy("_skey", F.col("_words").alias("size")).agg(F.count(F.lit(1)).alias("_n"))
    take = lengths.join(plan.select("_skey", "_budget"), "_skey").groupBy("_skey").applyInPandas(_fit, "_skey string, size long, _take long")
    key = F.xxhash64(F.lit(seed), F.col("_id"))
    docs = docs.withColumn("_size", F.coalesce("_words", F.lit(0)))
    facts = (
        docs.select("_skey", "_size").distinct()
        .join(take.select("_skey", F.col("size").alias("_size"), "_take"), ["_skey", "_size"], "left").join(plan.drop("_budget"), "_skey")
    )
    out = ranked(docs, ["_skey", "_size"], [key, F.col("_id")], F.shiftright(key, 17), "_rank", facts=facts)
    return (
        out.withColumn("repeats", F.when(F.col("_size") > 0, F.col("_whole") + (F.col("_rank") < F.coalesce("_take", F.lit(0))).cast("int")).otherwise(0))
        .select("_row_of.*", "source_size", "target", "repeats")
    )
