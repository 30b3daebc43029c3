"""Recipes: a list of operators compiled into one lazy DataFrame plan, with checkpoints, traces and export."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimill.functions.durable import checkpoint_dir
from sedimill.operators import registry
from sedimill.operators.registry import Context


@dataclass
class Recipe:
    """``process``: operators as {name: parameters}, in order."""

    process: list[dict]
    project_name: str = "recipe"
    dataset_path: str | None = None
    export_path: str | None = None
    text_keys: str = "text"
    id_col: str = "doc_id"
    on_error: str = "drop"
    fusion: bool = True
    options: dict = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, text: str) -> Recipe:
        import yaml

        raw = yaml.safe_load(text) or {}
        known = set(cls.__dataclass_fields__)
        steps = [s if isinstance(s, dict) else {s: {}} for s in raw.pop("process", None) or []]
        return cls(process=steps, **{k: v for k, v in raw.items() if k in known}, options={k: v for k, v in raw.items() if k not in known})

    def override(self, **settings) -> Recipe:
        """Settings by name, or operator parameters as ``operator.parameter``."""
        steps = [{k: dict(v or {})} for s in self.process for k, v in s.items()]
        plain = {}
        for key, value in settings.items():
            op, dot, name = key.replace("__", ".").partition(".")
            if not dot:
                plain[key] = value
                continue
            for s in steps:
                if op in s:
                    s[op][name] = value
        return Recipe(**{**{f: getattr(self, f) for f in self.__dataclass_fields__}, **plain, "process": steps})

    def validated(self) -> list[tuple[registry.Operator, dict]]:
        out = []
        for step in self.process:
            for name, params in step.items():
                op = registry.get(name)
                op.check(params or {})
                out.append((op, params or {}))
        return out


def ordered(steps: list[tuple[registry.Operator, dict]]) -> list[tuple[registry.Operator, dict]]:
    """Within each run of filters, native ones first: they are cheap and spare the others rows. Filters that depend on the rows kept before them stay put."""
    out, run = [], []
    cost = {"S": 0, "R": 1, "X": 2}
    fixed = ("text_bloom_filter", "gather_generated_data_filter")

    def flush():
        out.extend(sorted(run, key=lambda s: cost[s[0].tier]))
        run.clear()

    for s in steps:
        if s[0].kind == "filter" and s[0].name not in fixed:
            run.append(s)
        else:
            flush()
            out.append(s)
    flush()
    return out


def compile_plan(df: DataFrame, recipe: Recipe, ctx: Context | None = None, upto: int | None = None) -> DataFrame:
    """The recipe over a frame, as one lazy plan."""
    ctx = ctx or Context(text_key=recipe.text_keys, id_col=recipe.id_col, on_error=recipe.on_error)
    steps = recipe.validated()
    if not recipe.fusion:
        for op, params in steps[:upto]:
            df = op.apply(df, ctx, **params)
        return df
    run: list = []
    for step in [*ordered(steps)[:upto], None]:
        if step and step[0].form in ("column", "stats") and step[0].name not in PYTHON_STATS:
            run.append(step)
            continue
        df = fused(df, run, ctx)
        run = []
        if step:
            df = step[0].apply(df, ctx, **step[1])
    return df


#: Filters whose statistic is a Python function, which can't stand inside a fused expression.
PYTHON_STATS = ("character_repetition_filter", "word_repetition_filter")


def fused(df: DataFrame, steps: list, ctx: Context) -> DataFrame:
    """A run of native mappers and filters as one expression over an array of the one text, which filters may empty.

    Catalyst would copy a mapper's expression into every later use of the text, in
    predicates too, and so compute it many times; here each step is computed once.
    """
    kinds = [op.form for op, _ in steps]
    if "column" not in kinds or "stats" not in kinds[kinds.index("column"):]:
        for op, params in steps:
            df = op.apply(df, ctx, **params)
        return df
    rows = F.array(F.col(f"`{ctx.text_key}`"))
    for op, params in steps:
        if op.form == "column":
            rows = F.transform(rows, _mapped(op, params))
        else:
            rows = F.filter(rows, _kept(op, params))
    names = [c for c in df.columns if c != ctx.text_key]
    out = df.select(*(f"`{c}`" for c in names), F.explode(rows).alias(ctx.text_key))
    return out.select(*(f"`{c}`" for c in df.columns))


def _mapped(op: registry.Operator, params: dict):
    return lambda t: op.fn(t, **params)


def _kept(op: registry.Operator, params: dict):
    def keep(t):
        values, test = op.fn(t, **params)
        return test(values)

    return keep


def stats_frame(df: DataFrame, recipe: Recipe, ctx: Context | None = None) -> DataFrame:
    """``df`` and a ``_stats`` struct with each native filter's statistics, without filtering; equal statistics are computed once."""
    ctx = ctx or Context(text_key=recipe.text_keys, id_col=recipe.id_col)
    found, seen = {}, {}
    for op, params in recipe.validated():
        if op.form != "stats":
            continue
        for name, c in op.stats(ctx, **params)[0].items():
            measured = json.dumps([op.name, {k: v for k, v in params.items() if not k.startswith(("min_", "max_"))}], sort_keys=True, default=str)
            if measured in seen:
                continue
            n = sum(k == name or k.startswith(f"{name}_") for k in found)
            seen[measured] = key = f"{name}_{n + 1}" if n else name
            found[key] = c
    return df.withColumn("_stats", F.struct(*(c.alias(k) for k, c in found.items()))) if found else df


def run(spark: SparkSession, recipe: Recipe, ctx: Context | None = None, resume: bool = False, trace: int = 0) -> DataFrame:
    """Read, process, export. With ``resume``, steps that an earlier run of the same recipe's beginning has written are taken from there."""
    from sedimill.sources.readers import read
    from sedimill.sources.writers import export

    df = read(spark, recipe.dataset_path, recipe.text_keys)
    done = 0
    if resume:
        store = Checkpoint(spark, recipe.project_name)
        done, saved = store.latest([json.dumps(s, sort_keys=True) for s in recipe.process])
        df = saved if saved is not None else df
    rest = Recipe(**{**{f: getattr(recipe, f) for f in recipe.__dataclass_fields__}, "process": recipe.process[done:]})
    if trace:
        for before, after, op in traced(df, rest, ctx):
            changed(before, after, op, recipe.id_col, recipe.text_keys, trace).show(trace, truncate=60)
    out = compile_plan(df, rest, ctx)
    if resume:
        out = store.save(out, [json.dumps(s, sort_keys=True) for s in recipe.process])
    if recipe.export_path:
        export(out, recipe.export_path)
    return out


class Checkpoint:
    """A dataset and the operators that made it, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark, self.path = spark, f"{path or checkpoint_dir(spark)}/recipes/{name}"

    def save(self, df: DataFrame, steps: list[str]) -> DataFrame:
        n = len(steps)
        df.write.mode("overwrite").parquet(f"{self.path}/{n}/data")
        self.spark.createDataFrame([(json.dumps(steps),)], "steps string").coalesce(1).write.mode("overwrite").json(f"{self.path}/{n}/steps")
        return self.spark.read.parquet(f"{self.path}/{n}/data")

    def latest(self, steps: list[str]) -> tuple[int, DataFrame | None]:
        """The longest saved beginning of ``steps``."""
        for n in range(len(steps), 0, -1):
            try:
                saved = json.loads(self.spark.read.schema("steps string").json(f"{self.path}/{n}/steps").first()["steps"])
            except Exception:  # not saved
                continue
            if saved == steps[:n]:
                return n, self.spark.read.parquet(f"{self.path}/{n}/data")
        return 0, None


def traced(df: DataFrame, recipe: Recipe, ctx: Context | None = None):
    """(before, after, operator) for each step."""
    ctx = ctx or Context(text_key=recipe.text_keys, id_col=recipe.id_col)
    for op, params in recipe.validated():
        after = op.apply(df, ctx, **params)
        yield df, after, op
        df = after


def changed(before: DataFrame, after: DataFrame, op: registry.Operator, id_col: str = "doc_id", text_key: str = "text", limit: int = 10) -> DataFrame:
    """A few rows that the operator changed (mappers) or dropped (others)."""
    if op.kind == "mapper":
        new = after.select(id_col, F.col(text_key).alias("after"))
        return before.select(id_col, F.col(text_key).alias("before")).join(new, id_col).where(~F.col("before").eqNullSafe(F.col("after"))).limit(limit)
    return before.join(after.select(id_col), id_col, "left_anti").limit(limit)
