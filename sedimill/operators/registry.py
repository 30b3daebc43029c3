"""The operators' registry: recipes name operators, the registry gives what applies them to a DataFrame."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BackendMissing(RuntimeError):
    """The operator needs a model, codec or service that wasn't given."""


@dataclass
class Context:
    """Names of columns, what fills in for services (``backends`` by operator name), and what happens to rows whose function raises."""

    text_key: str = "text"
    id_col: str = "doc_id"
    backends: dict[str, Callable] = field(default_factory=dict)
    on_error: str = "drop"


@dataclass(frozen=True)
class Operator:
    """kind: mapper, filter, deduplicator or selector; tier: S native, R Python function, X needs a backend."""

    name: str
    kind: str
    tier: str
    fn: Callable
    form: str

    @property
    def defaults(self) -> dict:
        skip = 1 if self.form in ("column", "python", "stats") else 2
        return {k: p.default for k, p in list(inspect.signature(self.fn).parameters.items())[skip:]}

    def check(self, params: dict) -> None:
        known = self.defaults
        unknown = set(params) - set(known)
        if unknown:
            raise ValueError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        missing = [k for k, v in known.items() if v is inspect.Parameter.empty and k not in params]
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")

    def stats(self, ctx: Context, **params) -> tuple[dict[str, Column], Callable]:
        """A native filter's statistics and its predicate on them."""
        return self.fn(F.col(f"`{ctx.text_key}`"), **params)

    def apply(self, df: DataFrame, ctx: Context | None = None, **params) -> DataFrame:
        ctx = ctx or Context()
        self.check(params)
        if self.form == "column":
            return df.withColumn(ctx.text_key, self.fn(F.col(f"`{ctx.text_key}`"), **params))
        if self.form == "python":
            return _python(df, ctx, self.fn, params)
        if self.form == "stats":
            values, keep = self.stats(ctx, **params)
            return df.where(keep(values))
        return self.fn(df, ctx, **params)


REGISTRY: dict[str, Operator] = {}


def register(name: str, kind: str, tier: str = "S", form: str = "table", force: bool = False):
    """form: column (text Column to Column), python (str to str), stats (text Column to statistics and predicate), table."""

    def add(fn):
        if name in REGISTRY and not force:
            raise KeyError(f"{name} is registered already")
        REGISTRY[name] = Operator(name, kind, tier, fn, form)
        return fn

    return add


def get(name: str) -> Operator:
    from . import catalogue  # noqa: F401  (fills the registry)

    if name not in REGISTRY:
        raise KeyError(f"no operator {name}")
    return REGISTRY[name]


def names() -> list[str]:
    from . import catalogue  # noqa: F401

    return sorted(REGISTRY)


def _python(df: DataFrame, ctx: Context, fn: Callable, params: dict) -> DataFrame:
    """Apply a Python function to texts in Arrow batches; rows for which it raises are dropped, kept as they were, or end the job."""

    policy = ctx.on_error

    @F.pandas_udf("struct<text string, failed boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out, failed = [], []
        for t in texts:
            try:
                out.append(None if t is None else fn(t, **params))
                failed.append(False)
            except Exception:
                if policy == "raise":
                    raise
                out.append(t)
                failed.append(True)
        return pd.DataFrame({"text": out, "failed": failed})

    done = df.withColumn("_done", run(F.col(f"`{ctx.text_key}`")))
    if policy == "drop":
        done = done.where("not _done.failed")
    return done.withColumn(ctx.text_key, F.col("_done.text")).drop("_done")
