"""Writers: JSON lines or Parquet by suffix, in shards; statistics beside the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESERVED = ("_stats", "_hash", "_suffix", "_source_file", "_meta", "_context")


def export(df: DataFrame, path: str, shards: int | None = None, max_records: int | None = None, keep_stats: bool = False, keep_hashes: bool = False, stats_path: str | None = None, mode: str = "overwrite") -> str:
    """Write ``df`` without reserved columns; ``path`` ends in .jsonl, .json or .parquet and becomes a folder of parts."""
    form = "parquet" if path.endswith(".parquet") else "json"
    keep = ({"_stats"} if keep_stats else set()) | ({"_hash"} if keep_hashes else set())
    data = df.drop(*(c for c in RESERVED if c in df.columns and c not in keep))
    if shards:
        data = data.repartition(shards)
    writer = data.write.mode(mode)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    getattr(writer, form)(path)
    if stats_path and "_stats" in df.columns:
        df.select("_stats.*").write.mode(mode).json(stats_path)
    return path


def split_by(df: DataFrame, column: str, path: str, form: str = "parquet") -> str:
    """One folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(column).format(form).save(path)
    return path


def serialize_meta(df: DataFrame, keep: list[str], name: str = "meta") -> DataFrame:
    """All other columns as one JSON string."""
    return df.select(*keep, F.to_json(F.struct(*(c for c in df.columns if c not in keep)), {"ignoreNullFields": "false"}).alias(name))


def deserialize_meta(df: DataFrame, schema: str, name: str = "meta") -> DataFrame:
    """Columns back from a JSON string."""
    return df.withColumn("_m", F.from_json(name, schema)).select(*(c for c in df.columns if c != name), "_m.*")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes null."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def next_version(name: str, taken: list[str]) -> str:
    """v1, v2, ... for the main branch; branch.1, branch.2, ... for another one."""
    stem = "v" if name in ("main", "master", "") else f"{name}."
    used = [int(t[len(stem):]) for t in taken if t.startswith(stem) and t[len(stem):].isdigit()]
    return f"{stem}{max(used, default=0) + 1}"
