"""Weighted mixtures of sources: 'w1 path1 w2 path2 ...'."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(spec: str) -> list[tuple[float, str]]:
    """Weights and paths; a path without a weight has weight 1."""
    out, weight = [], 1.0
    for part in spec.replace(",", " ").split():
        try:
            weight = max(float(part), 0.0)
        except ValueError:
            out.append((weight, part))
            weight = 1.0
    return out


def sample(df: DataFrame, number: int, id_col: str, seed: int = 42) -> DataFrame:
    """``number`` rows in the order of a seeded hash of the id; more than there are repeats all rows."""
    n = df.count()
    if not n:
        return df
    whole, rest = divmod(number, n)
    some = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(rest)
    if not whole:
        return some
    again = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))).drop("_copy")
    return again.unionByName(some) if rest else again


def mix(frames: list[tuple[float, DataFrame]], id_col: str, max_samples: int | None = None, seed: int = 42) -> DataFrame:
    """Each frame's share: ceil(max_samples * weight / sum of weights), or ceil(rows * weight) without a number."""
    from .readers import union_all

    total = sum(w for w, _ in frames)
    parts = []
    for w, df in frames:
        number = math.ceil(max_samples * w / total) if max_samples else math.ceil(df.count() * w)
        parts.append(sample(df, number, id_col, seed))
    return union_all(parts)


def read_mixture(spark: SparkSession, spec: str, id_col: str | None = None, max_samples: int | None = None, text_keys: str | list = "text") -> DataFrame:
    from .readers import read

    frames = []
    for i, (w, path) in enumerate(parse(spec)):
        df = read(spark, path, text_keys)
        if id_col is None:  # an id of file and content, the same on every run
            df = df.withColumn("_mix_id", F.xxhash64(F.lit(i), F.to_json(F.struct(*(f"`{c}`" for c in df.columns)))))
        frames.append((w, df))
    out = mix(frames, id_col or "_mix_id", max_samples)
    return out.drop("_mix_id")
