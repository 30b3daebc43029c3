"""Deduplicators: exact, MinHash, SimHash and neighbour graphs. Row order means order by ``ctx.id_col``."""

from __future__ import annotations

import hashlib
import itertools
import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimill.functions import text as T
from sedimill.functions.durable import written
from sedimill.functions.graph import connected_components

from .filters import first_of
from .registry import Context, register

PUNCT = re.escape(string.punctuation)


def text_hash(c: Column, lowercase: bool = False, ignore_non_character: bool = False) -> Column:
    """md5 of the stripped text, optionally in lower case and without white space, digits and punctuation."""
    c = T.strip(F.coalesce(c, F.lit("")))
    c = F.lower(c) if lowercase else c
    if ignore_non_character:
        c = F.regexp_replace(c, rf"(?U)\s+|\d+|[{PUNCT}]", "")
    return F.md5(c.cast("binary"))


@register("document_deduplicator", "deduplicator")
def document(df: DataFrame, ctx: Context, lowercase: bool = False, ignore_non_character: bool = False) -> DataFrame:
    """The first of equal texts is kept."""
    return first_of(df, ctx, text_hash(F.col(ctx.text_key), lowercase, ignore_non_character))


@register("ray_document_deduplicator", "deduplicator")
def ray_document(df: DataFrame, ctx: Context, redis_host: str = "localhost", redis_port: int = 6380, lowercase: bool = False, ignore_non_character: bool = False, empty_policy: str = "one") -> DataFrame:
    """As document_deduplicator; the shuffle stands in for the key store. ``empty_policy``: one empty text is kept, or all."""
    key = text_hash(F.col(ctx.text_key), lowercase, ignore_non_character)
    if empty_policy == "all":
        key = F.when(F.length(F.coalesce(F.col(ctx.text_key), F.lit(""))) == 0, F.concat(F.lit("empty:"), F.col(ctx.id_col).cast("string"))).otherwise(key)
    return first_of(df, ctx, key)


def _without_followers(df: DataFrame, ctx: Context, edges: DataFrame) -> DataFrame:
    """Rows but those whose component has a smaller id. The join is hinted, as small files of many ids would be broadcast through the driver."""
    parts = connected_components(edges, "a", "b").where("node != component").select(F.col("node").alias(ctx.id_col))
    return df.join(parts.hint("merge"), ctx.id_col, "left_anti")


def tokens_of(text: str, tokenization: str, lowercase: bool, ignore_pattern: str | None, tokenizer=None) -> list[str]:
    text = text.lower() if lowercase else text
    if ignore_pattern:
        text = re.sub(ignore_pattern, "", text)
    if tokenization == "character":
        return list(text)
    if tokenization == "punctuation":
        return [x for x in re.split(rf"[{PUNCT}\s]+", text) if x]
    if tokenization == "sentencepiece":
        return tokenizer(text)
    return text.split()


def shingles_of(tokens: list[str], window: int, joiner: str, compat: bool) -> set[str]:
    """Windows of tokens. ``compat``: the last window is left out, as in the system whose results are matched."""
    n = len(tokens) - window + (0 if compat else 1)
    found = {joiner.join(tokens[i : i + window]) for i in range(n)}
    return found or (set() if compat or not tokens else {joiner.join(tokens)})


def optimal_bands(threshold: float, permutations: int) -> tuple[int, int]:
    """Bands and rows with the least sum of false positives and negatives, half weight each (Gauss-Legendre)."""
    x, w = np.polynomial.legendre.leggauss(64)

    def area(f, a, b):
        return float((w * f((b - a) / 2 * x + (a + b) / 2)).sum() * (b - a) / 2)

    best = None
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            wrong = 0.5 * area(lambda s, b=b, r=r: 1 - (1 - s**r) ** b, 0, threshold) + 0.5 * area(lambda s, b=b, r=r: (1 - s**r) ** b, threshold, 1)
            if best is None or wrong < best[0]:
                best = (wrong, b, r)
    return best[1], best[2]


@register("document_minhash_deduplicator", "deduplicator", tier="R")
def minhash(df: DataFrame, ctx: Context, tokenization: str = "space", window_size: int = 5, lowercase: bool = True, ignore_pattern: str | None = None, num_permutations: int = 256, jaccard_threshold: float = 0.7, num_bands: int | None = None, num_rows_per_band: int | None = None, tokenizer_model: str | None = None, compat: bool = False) -> DataFrame:
    """Near copies by MinHash bands; of documents that a chain of shared bands joins, the first is kept.

    ``compat`` leaves out each text's last window and lets all texts without a window fall together.
    """
    bands, rows = (num_bands, num_rows_per_band) if num_bands and num_rows_per_band else optimal_bands(jaccard_threshold, num_permutations)
    prime, top = np.uint64((1 << 61) - 1), np.uint64((1 << 32) - 1)
    rng = np.random.RandomState(42)
    drawn = [(rng.randint(1, (1 << 61) - 1, dtype=np.uint64), rng.randint(0, (1 << 61) - 1, dtype=np.uint64)) for _ in range(num_permutations)]
    a, b = (np.array(x, np.uint64) for x in zip(*drawn, strict=True))
    tokenizer = ctx.backends.get("document_minhash_deduplicator")

    @F.pandas_udf("array<string>")
    def signature(texts: pd.Series) -> pd.Series:
        def one(t):
            toks = tokens_of(t or "", tokenization, lowercase, ignore_pattern, tokenizer)
            grams = shingles_of(toks, window_size, "" if tokenization in ("character", "sentencepiece") else " ", compat)
            if not grams and not compat:
                return None
            low = np.full(num_permutations, top)
            h = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams], np.uint64)
            for lo in range(0, len(h), 512):
                low = np.minimum(low, (((h[lo : lo + 512, None] * a + b) % prime) & top).min(0))
            return [f"{i}:" + hashlib.md5(low[i * rows : (i + 1) * rows].tobytes()).hexdigest() for i in range(bands)]

        return texts.map(one)

    keyed = df.select(F.col(ctx.id_col).alias("b"), F.explode(signature(F.col(ctx.text_key))).alias("band"))
    keyed = written(keyed, "bands")
    least = keyed.groupBy("band").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")
    return _without_followers(df, ctx, keyed.join(least, "band").where("a != b").select("a", "b").distinct())


def _simhash(tokens: set[str]) -> int:
    if not tokens:
        return 0
    h = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[-8:], "big") for t in tokens], np.uint64)
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    set_ = bits.sum(0) * 2 > len(h)
    return int((set_.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


#: Hashes of a share, about, that meet in one task, and how many with equal blocks are compared without cutting the rest of their bits again.
HASHES, RUN = 50_000, 2_000


def _cut(bits: np.ndarray, blocks: int, distance: int) -> list[np.uint64]:
    """Masks of which one at least covers no differing bit, if ``distance`` of these bits differ at most."""
    blocks = max(blocks, distance + 1)
    cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    masks = [int(sum(1 << int(x) for x in bits[cuts[i] : cuts[i + 1]])) for i in range(blocks)]
    return [np.uint64(sum(c)) for c in itertools.combinations(masks, blocks - distance)]


def near_hashes(h: np.ndarray, masks: list[np.uint64], bits: np.ndarray, blocks: int, distance: int, label: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """For each of distinct hashes the least index in a chain of hashes that are equal under one of the masks and differ in at most ``distance`` bits.

    Pairs that a chain joins already aren't kept, so that no more than a link for each hash is left. Many hashes
    that are equal under a mask are told apart by the other bits in the same way, exactly.
    """
    label = np.arange(len(h)) if label is None else label
    own = np.arange(len(h)) if own is None else own
    for mask in masks:
        value = h[own] & mask
        order = np.argsort(value, kind="stable")
        value, place = value[order], own[order]
        new = np.append(True, value[1:] != value[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(value)))
        rest = bits[((mask >> bits.astype(np.uint64)) & np.uint64(1)) == 0]
        deeper = (size > RUN) & (len(rest) >= 4 * (distance + 1))
        for lo, n in zip(first[deeper], size[deeper], strict=True):
            near_hashes(h, _cut(rest, blocks, distance), rest, blocks, distance, label, place[lo : lo + n])
        run = np.cumsum(new) - 1
        at, step = np.flatnonzero(~np.repeat(deeper, size)), 1
        while len(at):
            at = at[at + step < len(value)]
            at = at[run[at + step] == run[at]]
            x, y = place[at], place[at + step]
            near = np.bitwise_count(h[x] ^ h[y]) <= distance
            x, y = x[near], y[near]
            while len(x):  # joins the chains of x and y
                a, b = label[x], label[y]
                open_ = a != b
                x, y, a, b = x[open_], y[open_], a[open_], b[open_]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label[:] = label[label]
            step += 1
    return label


@register("document_simhash_deduplicator", "deduplicator", tier="R")
def simhash(df: DataFrame, ctx: Context, tokenization: str = "space", window_size: int = 6, lowercase: bool = True, ignore_pattern: str | None = None, num_blocks: int = 6, hamming_distance: int = 4, compat: bool = False) -> DataFrame:
    """Near copies by 64-bit SimHash: hashes that differ in at most ``hamming_distance`` bits share blocks.

    Hashes that may share blocks meet in one task, which gives a link for each hash at most and never lists their pairs.
    """
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        join = "" if tokenization == "character" else " "
        values = [_simhash(shingles_of(tokens_of(t or "", tokenization, lowercase, ignore_pattern), window_size, join, compat)) for t in texts]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    keyed = written(df.select(F.col(ctx.id_col).alias("id"), hashed(F.col(ctx.text_key)).alias("h")), "simhash")
    least = written(keyed.groupBy("h").agg(F.min("id").alias("a")), "least").hint("merge")  # it is small as a file only
    cuts = [round(i * 64 / num_blocks) for i in range(num_blocks + 1)]
    blocks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(num_blocks)]
    masks = [sum(c) for c in itertools.combinations(blocks, max(1, num_blocks - hamming_distance))]
    shares = max(1, -(-least.count() // HASHES))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64(F.col("h").bitwiseAND(F.lit(signed(m)))), F.lit(shares)).cast("int").alias("share")) for i, m in enumerate(masks)))
    dealt = least.select("h", F.explode(keys).alias("key")).select("h", "key.i", "key.share")

    def chains(table: pa.Table) -> pa.Table:
        h = np.sort(table["h"].to_numpy().view(np.uint64))
        label = near_hashes(h, [np.uint64(masks[table["i"][0].as_py()])], np.arange(64), num_blocks, hamming_distance)
        joined = label != np.arange(len(h))
        return pa.table({"h": h[joined].view(np.int64), "g": h[label[joined]].view(np.int64)})

    near = dealt.groupBy("i", "share").applyInArrow(chains, "h long, g long").distinct()
    same = keyed.join(least, "h").where("id != a").select("a", F.col("id").alias("b"))
    cross = near.join(least, "h").withColumnRenamed("a", "x").join(least.select(F.col("h").alias("g"), F.col("a").alias("y")).hint("merge"), "g").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return _without_followers(df, ctx, same.union(cross))


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Row numbers from 0 in the order of a column: ranges are numbered side by side, and the counts of the ranges before are added."""
    from pyspark.sql.window import Window

    ranges = written(df.repartitionByRange(F.col(by).asc()).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return written(ranges.withColumn("_own", own).join(before, "_range").withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before"), "ranks")


@register("dedup_and_save_deduplicator", "deduplicator")
def neighbour_graph(df: DataFrame, ctx: Context, similarity_threshold: float = 0.5, nn_indices_key: str = "nn_indices", nn_scores_key: str = "nn_scores", fields_to_filter: list | None = None) -> DataFrame:
    """Rows linked to neighbours that score at least the threshold; the first row of each component is kept, listed fields (never the text) go.

    Neighbours are given by row number, that is, by rank of the id.
    """
    ranked = numbered(df.select(ctx.id_col, nn_indices_key, nn_scores_key), ctx.id_col, "a")
    kinds = dict(df.dtypes)
    nested = kinds[nn_indices_key].startswith("array<array")
    ids = F.flatten(nn_indices_key) if nested else F.col(nn_indices_key)
    scores = F.flatten(nn_scores_key) if nested else F.col(nn_scores_key)
    edges = ranked.select("a", F.explode(F.arrays_zip(ids.alias("i"), scores.alias("s"))).alias("e")).where(F.col("e.s") >= similarity_threshold).select("a", F.col("e.i").cast("long").alias("b"))
    edges = edges.join(ranked.select(F.col("a").alias("b")), "b", "left_semi")
    gone = connected_components(edges, "a", "b").where("node != component").select(F.col("node").alias("a")).join(ranked.select("a", ctx.id_col), "a").select(ctx.id_col)
    out = df.join(gone, ctx.id_col, "left_anti")
    drop = fields_to_filter if fields_to_filter is not None else [nn_indices_key, nn_scores_key, "embedding"]
    return out.drop(*(c for c in drop if c != ctx.text_key))
