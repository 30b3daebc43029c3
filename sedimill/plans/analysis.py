"""Analysis of statistics: summaries, histograms, distances of distributions, three-sigma bounds, quality models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def describe(df: DataFrame, columns: list[str], percentiles: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std, min, max and exact percentiles of numeric columns: one row for each column, one pass."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(F.struct(
            F.lit(c).alias("name"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
            *(F.percentile(x, F.lit(p)).alias(f"p{round(p * 100)}") for p in percentiles), F.max(x).alias("max"),
        ))
    return df.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def describe_strings(df: DataFrame, column: str) -> DataFrame:
    """count, unique, top and its frequency."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max_by(column, F.struct("n", column)).alias("top"), F.max("n").alias("freq"))


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Counts in equal bins; int(sqrt(n)) bins from 100 rows on."""
    x = F.col(column).cast("double")
    s = df.agg(F.count(x).alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).first()
    if not s["n"]:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    bins = bins or (int(math.sqrt(s["n"])) if s["n"] >= 100 else 10)
    width = (s["b"] - s["a"]) / bins or 1.0
    at = F.least(F.floor((x - s["a"]) / width), F.lit(bins - 1)).cast("int")
    return df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (s["a"] + F.col("bin") * width).alias("low"), (s["a"] + (F.col("bin") + 1) * width).alias("high"), "n")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Values and their shares."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("p"))  # one row


def measures(p: DataFrame, q: DataFrame, tiny: float = 1e-12) -> DataFrame:
    """KL and JS divergence, cross entropy and entropy of two distributions (natural logarithms)."""
    both = p.select("value", F.col("p")).join(q.select("value", F.col("p").alias("q")), "value", "full")
    a, b = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(tiny)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(tiny))
    m = (a + b) / 2
    return both.agg(
        F.sum(a * F.log(a / b)).alias("kl"), (F.sum(a * F.log(a / m)) / 2 + F.sum(b * F.log(b / m)) / 2).alias("js"),
        (-F.sum(a * F.log(b))).alias("cross_entropy"), (-F.sum(a * F.log(a))).alias("entropy"),
    )


def token_counts(df: DataFrame, text_key: str = "text") -> DataFrame:
    """How often each word occurs."""
    return df.select(F.explode(F.split(F.lower(text_key), r"\s+")).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def three_sigma(df: DataFrame, column: str, k: float = 3.0) -> tuple[float, float]:
    """mean - k * std and mean + k * std."""
    r = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
    return r["m"] - k * (r["s"] or 0), r["m"] + k * (r["s"] or 0)


def tuned_recipe(df: DataFrame, recipe, k: float = 3.0):
    """The recipe with every native filter's bounds set three standard deviations around the mean of its statistic."""
    from sedimill.operators.registry import Context

    ctx = Context(text_key=recipe.text_keys, id_col=recipe.id_col)
    steps = []
    for op, params in recipe.validated():
        own = dict(params)
        if op.form == "stats":
            name, c = next(iter(op.stats(ctx, **params)[0].items()))
            low, high = three_sigma(df.select(c.cast("double").alias(name)), name, k)
            for key in op.defaults:
                if key.startswith("min_"):
                    own[key] = low
                elif key.startswith("max_"):
                    own[key] = high
        steps.append({op.name: own})
    return type(recipe)(**{**{f: getattr(recipe, f) for f in recipe.__dataclass_fields__}, "process": steps})


def top_per_group(df: DataFrame, group: str, value: str, groups: int = 20, each: int = 4) -> DataFrame:
    """The most frequent groups and, in each, the most frequent values (verbs and their nouns in a diversity analysis)."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(group).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), group).limit(groups)
    best = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.join(top.select(group), group, "left_semi").withColumn("r", F.row_number().over(best)).where(F.col("r") <= each).drop("r")


def quality_model(train: DataFrame, text_key: str = "text", label: str = "label", features: int = 1 << 16):
    """A Spark ML pipeline: words, hashed counts, logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Tokenizer

    return Pipeline(stages=[
        Tokenizer(inputCol=text_key, outputCol="_words"), HashingTF(inputCol="_words", outputCol="features", numFeatures=features),
        LogisticRegression(labelCol=label, maxIter=10, predictionCol="prediction", probabilityCol="probability"),
    ]).fit(train)


def quality_predictions(model, df: DataFrame, keep_method: str = "label", id_col: str = "doc_id", seed: int = 42, alpha: float = 9.0) -> DataFrame:
    """Rows with ``doc_score`` and ``should_keep``: score above 0.5, or above 1 - a Pareto number drawn from the seeded id."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).withColumn("doc_score", vector_to_array("probability")[1])
    if keep_method == "label":
        keep = F.col("doc_score") > 0.5
    else:
        u = (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) + 1) / float(1 << 30)
        keep = F.col("doc_score") > 1 - (F.pow(u, -1.0 / alpha) - 1)
    return out.withColumn("should_keep", keep.cast("int")).drop("_words", "features", "rawPrediction", "probability")


def quality_scores(df: DataFrame, label: str = "label", predicted: str = "should_keep") -> DataFrame:
    """Precision, recall and F1, each count smoothed by 1."""
    one = lambda a, b: F.sum(((F.col(label) == a) & (F.col(predicted) == b)).cast("int")) + 1
    c = df.agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return c.select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"))
