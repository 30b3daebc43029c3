"""Readers: files by suffix, schemas unified over files, text keys checked; databases by JDBC or table name."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".json": "json", ".jsonl": "json", ".jsonl.zst": "json", ".json.gz": "json", ".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".txt": "text", ".md": "text", ".tex": "text", ".html": "text", ".py": "text", ".java": "text", ".c": "text", ".cpp": "text", ".go": "text", ".js": "text", ".rs": "text", ".sh": "text", ".sql": "text", ".xml": "text", ".yaml": "text", ".docx": "docx"}
FORMATS |= dict.fromkeys(".rst .tei .bib .cls .sty .css .scss .htm .jsx .ts .tsx .vue .php .rb .pl .pm .lua .r .jl .scala .kt .swift .m .h .hpp .hh .cc .cxx .cs .fs .f90 .f .asm .s .clj .erl .ex .hs .ml .lisp .el .vb .bat .ps1 .cmake .mk .toml .ini .cfg .conf .yml .log .proto .thrift .dart .groovy .gradle".split(), "text")
#: Order of simple types: of two, the higher one holds both.
LATTICE = ["void", "boolean", "long", "double", "timestamp", "string"]


def _rank(t: T.DataType) -> int:
    name = {"integer": "long", "short": "long", "byte": "long", "bigint": "long", "float": "double", "decimal": "double", "date": "timestamp"}.get(t.typeName(), t.typeName())
    return LATTICE.index(name) if name in LATTICE else len(LATTICE)


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: structs field by field, arrays by element, else the higher simple type."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged_schema([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType))
    for x, y in ((a, b), (b, a)):
        if isinstance(x, (T.StructType, T.ArrayType)):
            return x if _rank(y) == 0 else (x if not isinstance(y, (T.StructType, T.ArrayType)) else T.StringType())
    high = max(_rank(a), _rank(b))
    return [T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.StringType(), T.StringType()][high]


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    fields: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            fields[f.name] = merged_type(fields[f.name], f.dataType) if f.name in fields else f.dataType
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly these fields; missing ones, also inside structs, are null."""

    def fit(c, have, want):
        if have == want:
            return c
        if isinstance(want, T.StructType):
            if not isinstance(have, T.StructType):
                return F.lit(None).cast(want)
            names = {f.name: f.dataType for f in have.fields}
            return F.when(c.isNotNull(), F.struct(*((fit(c[f.name], names[f.name], f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields)))
        if isinstance(want, T.ArrayType):
            return F.transform(c, lambda x: fit(x, have.elementType, want.elementType)) if isinstance(have, T.ArrayType) else F.lit(None).cast(want)
        if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c)
        return c.try_cast(want)

    own = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*((fit(F.col(f"`{f.name}`"), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames of different schemas one after the other, under the schema that holds them all."""
    schema = merged_schema([f.schema for f in frames])
    out = conform(frames[0], schema)
    for f in frames[1:]:
        out = out.unionByName(conform(f, schema))
    return out


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return next((s for s in sorted(FORMATS, key=len, reverse=True) if name.endswith(s)), "." + name.rsplit(".", 1)[-1] if "." in name else "")


def files(spark: SparkSession, path: str) -> list[str]:
    """All files below a path, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(root).isFile():
        return [path]
    found, it = [], fs.listFiles(root, True)
    while it.hasNext():
        p = it.next().getPath()
        if not p.getName().startswith(("_", ".")):
            found.append(p.toString())
    return sorted(found)


def read(spark: SparkSession, path: str, text_keys: str | list = "text", suffixes: list | None = None, add_suffix: bool = False, **options) -> DataFrame:
    """The files below ``path`` of the format that most of them have; rows with a null text go."""
    if "," in path or " " in path.strip():
        from .mixture import read_mixture

        return read_mixture(spark, path, text_keys=text_keys)
    paths = [p for p in files(spark, path) if not suffixes or suffix_of(p) in suffixes]
    known = Counter(FORMATS[suffix_of(p)] for p in paths if suffix_of(p) in FORMATS)
    if not known:
        raise ValueError(f"{path} holds no file of a known format")
    form = known.most_common(1)[0][0]
    paths = [p for p in paths if FORMATS.get(suffix_of(p)) == form]
    df = _read(spark, paths, form, **options)
    if add_suffix:
        df = df.withColumn("_suffix", F.regexp_extract(F.col("_metadata.file_name"), r"(\.[A-Za-z0-9]+)$", 1))
    return unified(df, text_keys)


def _docx(contents: pd.Series) -> pd.Series:
    """The paragraphs of a word processor's files, a line each; null for what can't be read."""
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(content) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                body = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        kinds = {f"{space}t": lambda x: x.text or "", f"{space}tab": lambda x: "\t", f"{space}br": lambda x: "\n"}
        return "\n".join("".join(kinds[x.tag](x) for x in p.iter() if x.tag in kinds) for p in body.iter(f"{space}p"))

    return contents.map(one)


def _read(spark: SparkSession, paths: list[str], form: str, **options) -> DataFrame:
    if form == "json":
        # an array of objects spans lines; the first characters of each file tell
        heads = spark.read.format("binaryFile").load(paths).select("path", F.substring("content", 1, 64).cast("string").alias("head")) if all(p.endswith(".json") for p in paths) else None
        if heads is not None and not heads.where(F.ltrim(F.col("head")).startswith("[")).isEmpty():
            options = {"multiLine": True} | options
        return spark.read.options(**options).json(paths)
    if form == "docx":
        return spark.read.format("binaryFile").load(paths).select(F.pandas_udf(_docx, "string")("content").alias("text"))
    if form in ("csv", "tsv"):
        return spark.read.options(header=True, inferSchema=True, multiLine=True, escape='"', sep="\t" if form == "tsv" else ",", **options).csv(paths)
    if form == "parquet":
        try:
            return spark.read.option("mergeSchema", True).parquet(*paths)
        except Exception:  # types that Spark won't merge: file by file, under the schema that holds them all
            return union_all([spark.read.parquet(p) for p in paths])
    return spark.read.text(paths, wholetext=True).withColumnRenamed("value", "text")


def unified(df: DataFrame, text_keys: str | list = "text") -> DataFrame:
    """Rows whose texts aren't null; a missing text key is an error."""
    for key in [text_keys] if isinstance(text_keys, str) else text_keys:
        try:
            df = df.where(F.col(key).isNotNull())
        except Exception as e:
            raise KeyError(f"no text key {key}") from e
    return df


def empty(spark: SparkSession, length: int, feature_keys: list[str] = ("text",)) -> DataFrame:
    """``length`` rows of nulls."""
    return spark.range(length).select(*(F.lit(None).cast("string").alias(k) for k in feature_keys))


def jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 16, **options) -> DataFrame:
    """A table or query of a database; with a partition column, read in parallel rather than page by page."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    r = r.option("query", query) if query else r.option("dbtable", table)
    if partition_column:
        r = r.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


def hive(spark: SparkSession, table: str | None = None, query: str | None = None) -> DataFrame:
    return spark.sql(query) if query else spark.table(table)


def mongodb(spark: SparkSession, uri: str, database: str, collection: str, pipeline: str | None = None) -> DataFrame:
    """A collection through the MongoDB connector, if its jar is on the class path."""
    r = spark.read.format("mongodb").option("connection.uri", uri).option("database", database).option("collection", collection)
    return (r.option("aggregation.pipeline", pipeline) if pipeline else r).load()
