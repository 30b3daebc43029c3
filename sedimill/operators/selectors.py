"""Selectors: whole-table choices by frequency, rank, chance or nearness. Ties follow ``ctx.id_col``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimill.functions.durable import written

from .filters import field_type
from .registry import Context, register


def _size(df: DataFrame, ratio: float | None, number: int | None) -> int | None:
    """The smaller of int(ratio * rows) and a number; None if neither is given."""
    found = [number] if number is not None else []
    if ratio is not None:
        found.append(int(ratio * df.count()))
    return min(found) if found else None


@register("frequency_specified_field_selector", "selector")
def frequency(df: DataFrame, ctx: Context, field_key: str = "", top_ratio: float | None = None, topk: int | None = None, reverse: bool = True) -> DataFrame:
    """All rows of the most (``reverse=False``: least) frequent values of a field."""
    c, _ = field_type(df, field_key) if field_key else (None, None)
    if c is None or (top_ratio is None and topk is None):
        return df
    counts = df.groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.min(ctx.id_col).alias("_first"))
    k = _size(counts, top_ratio, topk)
    best = counts.orderBy(F.desc("_n") if reverse else F.asc("_n"), "_first").limit(k)
    keyed = df.withColumn("_v", c)
    return keyed.join(best.select(F.col("_v").alias("_w")), F.col("_v").eqNullSafe(F.col("_w")), "left_semi").drop("_v")


@register("random_selector", "selector", tier="R")
def random_rows(df: DataFrame, ctx: Context, select_ratio: float | None = None, select_num: int | None = None, seed: int = 42) -> DataFrame:
    """A number or share of rows, chosen by a seeded hash of the id: the same on every run."""
    k = _size(df, select_ratio, select_num)
    return df if k is None else df.orderBy(F.xxhash64(F.lit(seed), ctx.id_col), ctx.id_col).limit(k)


@register("topk_specified_field_selector", "selector")
def topk(df: DataFrame, ctx: Context, field_key: str = "", top_ratio: float | None = None, topk: int | None = None, reverse: bool = True) -> DataFrame:
    """The rows with the largest (``reverse=False``: smallest) values of a field."""
    c, _ = field_type(df, field_key) if field_key else (None, None)
    k = _size(df, top_ratio, topk)
    if c is None or k is None:
        return df
    if "." in field_key:  # nested values that are no numbers come last
        c = F.coalesce(c.try_cast("double"), F.lit(-9.223372036854776e18 if reverse else 9.223372036854776e18))
    return df.orderBy(c.desc_nulls_last() if reverse else c.asc_nulls_last(), ctx.id_col).limit(k)


@register("range_specified_field_selector", "selector")
def ranked_range(df: DataFrame, ctx: Context, field_key: str = "", lower_percentile: float | None = None, upper_percentile: float | None = None, lower_rank: int | None = None, upper_rank: int | None = None) -> DataFrame:
    """Rows whose rank by a field, from 0, lies in [lower, upper); of a percentile and a rank the narrower bound counts."""
    c, _ = field_type(df, field_key) if field_key else (None, None)
    if c is None or (lower_percentile is None and lower_rank is None) or (upper_percentile is None and upper_rank is None):
        return df
    n = df.count()
    low = max(x for x in (int(lower_percentile * n) if lower_percentile is not None else None, lower_rank) if x is not None)
    high = min(x for x in (int(upper_percentile * n) if upper_percentile is not None else None, upper_rank) if x is not None)
    if high <= low:
        return df.limit(0)
    value = F.coalesce(c.try_cast("double"), F.lit(-9.223372036854776e18)) if "." in field_key else c
    order = [value.asc_nulls_first(), F.col(ctx.id_col).asc()]
    # two bounded sorts (each keeps ``high`` or fewer rows) rather than a rank over the whole table in one task
    lowest = df.withColumn("_value", value).orderBy(*order).limit(high)
    return lowest.orderBy(F.col("_value").desc_nulls_last(), F.col(ctx.id_col).desc()).limit(min(high, n) - low).drop("_value") if n > low else df.limit(0)


@register("encode_and_get_nearest_mapper", "selector")
def nearest(df: DataFrame, ctx: Context, auth_token: str = "", model_url: str = "", model_name: str = "", dimensions: int = 1024, embedding_col: str = "embedding", k: int = 5, block: int = 512) -> DataFrame:
    """nn_indices and nn_scores: the k rows with the largest inner product with a row's embedding, itself left out.

    Every pair is scored: rows are packed into piles, and each pair of piles is met by matrix products, in which only
    scores that reach a row's k-th best so far are looked at. Those are computed again in the order of the components,
    so that equal vectors tie. Piles are sent as bytes to the tasks that need them and never copied for each pair.
    """
    spark = df.sparkSession
    ids = df.select(F.col(ctx.id_col).alias("id"), F.col(embedding_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    rows, wide = ids.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    piles = max(1, -(-rows // (block * min(8, max(1, 512 // max(1, wide or 1))))))
    keyed = ids.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(piles)).cast("int"))  # equal ids are in one pile

    def pack(table: pa.Table) -> pa.Table:
        v = table["v"].combine_chunks()
        if len(set(v.value_lengths().to_pylist())) > 1:
            raise ValueError("embeddings differ in length")
        data = v.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        return pa.table({"g": table["g"].slice(0, 1), "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.int64())), "data": pa.array([data.tobytes()], pa.binary())})

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    packed = written(keyed.groupBy("g").applyInArrow(pack, "g int, ids array<long>, data binary"), "piles")
    left = packed.select(F.col("g").alias("a"), F.col("ids").alias("ids_a"), F.col("data").alias("data_a")).repartition(2 * piles, "a")
    right = packed.select(F.col("g").alias("b"), F.col("ids").alias("ids_b"), F.col("data").alias("data_b")).repartition(-(-piles // 16), "b")

    def product(batches):
        best: dict = {}  # of a pile: ids, and the row, score and id of the best so far, in order
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                (xi, x), (yi, y) = (_pile(batch.column(f"ids_{c}")[i], batch.column(f"data_{c}")[i]) for c in "ab")
                at, score, nn = best[a][1:] if a in best else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
                found = [_reaching(lo, x[lo : lo + block], y, xi[lo : lo + block], yi if a == b else None, at, score, k) for lo in range(0, len(x), block)]
                row, col = (np.concatenate(c) for c in zip(*found, strict=True))
                exact = np.zeros(len(row))
                with np.errstate(all="ignore"):
                    for j in range(x.shape[1]):
                        exact += x[row, j] * y[col, j]
                ok = np.isfinite(exact)
                at, score, nn = (np.concatenate(c) for c in ((at, row[ok]), (score, exact[ok]), (nn, yi[col[ok]])))
                order = np.lexsort((nn, -score, at))
                at, score, nn = at[order], score[order], nn[order]
                keep = np.arange(len(at)) - np.searchsorted(at, at) < k
                best[a] = xi, at[keep], score[keep], nn[keep]
        for xi, at, score, nn in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(xi[at]), pa.array(nn), pa.array(score)], ["id", "nn", "score"])

    found = left.crossJoin(right).mapInArrow(product, "id long, nn long, score double")
    order = F.sort_array(F.collect_list(F.struct((F.lit(0.0) - F.col("score")).alias("far"), "nn", "score")))
    found = found.groupBy("id").agg(F.slice(order, 1, k).alias("n"))
    return df.join(found.select(F.col("id").alias(ctx.id_col), F.col("n.nn").alias("nn_indices"), F.col("n.score").alias("nn_scores")), ctx.id_col, "left")


def _pile(ids: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    own = ids.values.to_numpy()
    return own, (v := np.frombuffer(data.as_buffer(), "<f8")).reshape(len(own), len(v) // len(own))


def _reaching(first: int, x: np.ndarray, y: np.ndarray, xi: np.ndarray, yi: np.ndarray | None, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (from ``first``) and columns whose product reaches the row's k-th best, to within rounding, but a row's own id."""
    with np.errstate(all="ignore"):
        s = x @ y.T
        if not np.isfinite(s.sum()):
            s[~np.isfinite(s)] = -np.inf
        slack = 4 * (x.shape[1] + 1) * np.finfo(float).eps * np.abs(x).max(1, initial=0) * np.nanmax(np.abs(y).sum(1), initial=0)
    if yi is not None:
        s[xi[:, None] == yi[None, :]] = -np.inf
    least = np.full(len(x), -np.inf)
    lo, hi = (np.searchsorted(at, first + np.arange(len(x)), side) for side in ("left", "right"))
    full = hi - lo >= k
    least[full] = score[hi[full] - 1]
    if len(y) > k and not full.all():
        least = np.maximum(least, np.partition(s, len(y) - k, axis=1)[:, len(y) - k])
    row, col = np.nonzero((s >= (least - np.nan_to_num(slack))[:, None]) & (s > -np.inf))
    return first + row, col
