"""The corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Defined results, for every stage: an empty table gives an empty one; a null text counts as
an empty one (and is null in what the stage returns); rows that repeat an id, or have none,
are documents of their own; further columns are carried along whatever their names; a null
source is a source of its own. Texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimill.functions.durable import written
from sedimill.llm.mixing import mixed, word_count
from sedimill.llm.ngram_join import ngram_jaccard_join
from sedimill.llm.packing import packed
from sedimill.llm.quality import fitted, scored
from sedimill.llm.secrets import redacted

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Without any label outside the held-out fold it knows nothing, and accepts none or all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("document"), "text")
    return scored(whole, fitted(docs, labels)).where("predicted = 1").select(*(F.col(f"document.`{c}`") for c in names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the smallest doc_id (a missing one last), of equal ids one row.

    Documents without a word are linked with nothing and stay.
    """
    names = docs.columns
    row = F.monotonically_increasing_id()  # the same at both readings, as they deal the same files out alike
    named = docs.select("text", F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", row.alias("row")).alias("doc_id"))
    groups = ngram_jaccard_join(named, k=5, num=80, den=100)
    keep = groups.where(F.col("doc_id.row") == F.col("component_id.row")).select(F.col("doc_id.row").alias("row"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("document"), row.alias("row"))
    return whole.join(keep, "row", "left_semi").select(*(F.col(f"document.`{c}`") for c in names))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked, and n_chars (if there is such a column) counted anew; a null text keeps its n_chars."""
    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: those of size 0 never, others up to twice."""
    names = docs.columns
    whole = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("document"))
    out = mixed(whole, size="words").where("repeats > 0")
    return out.select("document", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*(F.col(f"document.`{c}`") for c in names))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packed(docs, TOKENIZER)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixing", mixing), ("packing", packing)]
#: A trained classifier, a tokenizer and a packing aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
