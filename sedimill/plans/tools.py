"""Tools around recipes: conversions, token counts, language splits, ready recipes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recipe import Recipe


def count_tokens(df: DataFrame, text_key: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Total number of tokens (words without a tokenizer file)."""
    if not tokenizer:
        return df.agg(F.coalesce(F.sum(F.size(F.filter(F.split(text_key, r"\s+"), lambda w: w != ""))), F.lit(0)).alias("tokens"))

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        return pd.Series([len(e.ids) for e in Tokenizer.from_file(tokenizer).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)])

    return df.agg(F.sum(run(text_key)).alias("tokens"))


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """A column with one value in every row; a column of that name is replaced."""
    return df.withColumn(name, F.lit(value))


def at_positions(df: DataFrame, positions: list[int], by: str) -> DataFrame:
    """The rows at these places (from 0) in the order of a column; places that don't exist are passed over."""
    from sedimill.operators.dedup import numbered

    return numbered(df, by, "_at").where(F.col("_at").isin(*positions)).drop("_at")


def shuffled(df: DataFrame, by: str, seed: int = 42) -> DataFrame:
    """All rows with their place in an order that a seed and a column give, the same on every run: column ``place``."""
    from sedimill.operators.dedup import numbered

    return numbered(df.withColumn("_by", F.struct(F.xxhash64(F.lit(seed), by), by)), "_by", "place").drop("_by")


def alpaca_merged(df: DataFrame, path_col: str | None = None) -> DataFrame:
    """text = instruction, input and output joined by spaces, with a meta struct."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("instruction", "input", "output")))
    origin = F.col(path_col) if path_col else F.lit("")
    return df.select(text.alias("text"), F.struct(origin.alias("origin_path")).alias("meta"))


def stack_exchange_pairs(posts: DataFrame, sites: int = 28) -> DataFrame:
    """Questions with their answers by score, 'Q: ...\\nA: ...', of the sites with most posts. Columns: site, Id, PostTypeId, ParentId, Score, Body."""
    top = posts.groupBy("site").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "site").limit(sites)
    posts = posts.join(top.select("site"), "site", "left_semi")
    # scores are compared as strings, as the matched results do
    answers = posts.where("PostTypeId = 2").groupBy("site", F.col("ParentId").alias("Id")).agg(F.sort_array(F.collect_list(F.struct(F.col("Score").cast("string").alias("s"), "Body")), asc=False).alias("a"))
    text = F.concat(F.lit("Q: "), F.col("Body"), F.lit("\nA: "), F.array_join("a.Body", "\nA: "))
    return posts.where("PostTypeId = 1").join(answers, ["site", "Id"]).select("site", "Id", text.alias("text"))


def notebook_code(content: str) -> str:
    """The code cells of a notebook's JSON."""
    cells = json.loads(content).get("cells", [])
    return "\n\n".join("".join(c.get("source", [])) for c in cells if c.get("cell_type") == "code")


def repository_files(df: DataFrame) -> DataFrame:
    """name, path, content rows of a ``binaryFile`` read; notebooks become their code."""
    @F.pandas_udf("string")
    def text(paths: pd.Series, contents: pd.Series) -> pd.Series:
        def one(p, b):
            t = bytes(b).decode("utf-8", "replace")
            return notebook_code(t) if p.endswith(".ipynb") else t

        return pd.Series([one(p, b) for p, b in zip(paths, contents, strict=True)])

    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", text("path", "content").alias("content"))


#: Ready recipes.
FINEWEB_EDU = Recipe(project_name="edu", process=[{"annotate_edu_train_bert_scorer_mapper": {}}, {"text_high_score_filter": {"min_score": 3.0}}, {"text_bloom_filter": {}}])
SMOLTALK = Recipe(project_name="smoltalk", process=[{"pipeline_magpie_zh_mapper": {}}, {"gather_generated_data_filter": {}}, {"encode_and_get_nearest_mapper": {}}, {"dedup_and_save_deduplicator": {}}])
