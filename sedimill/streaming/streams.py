"""Recipes and counts over Structured Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimill.operators.registry import Context
from sedimill.plans.recipe import Recipe

#: Kinds whose operators look at one row at a time.
STATELESS = ("mapper", "filter")
_WHOLE = ("text_bloom_filter", "gather_generated_data_filter", "annotate_edu_train_bert_scorer_mapper")


def stream(df: DataFrame, recipe: Recipe, ctx: Context | None = None) -> DataFrame:
    """A recipe of row-wise operators over a streaming frame."""
    ctx = ctx or Context(text_key=recipe.text_keys, id_col=recipe.id_col)
    for op, params in recipe.validated():
        if op.kind not in STATELESS or op.name in _WHOLE:
            raise ValueError(f"{op.name} needs the whole table")
        df = op.apply(df, ctx, **params)
    return df


def dedup_stream(df: DataFrame, key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, time: str, by: str, window: str = "5 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts for each window of event time and value, late events up to ``lateness`` included."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return df.withWatermark(time, lateness).groupBy(span, by).agg(F.count(F.lit(1)).alias("n"))
