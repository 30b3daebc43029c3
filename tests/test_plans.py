"""Recipes, analysis, sources, sinks and streams."""

import importlib
import math
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from sedimill.plans import analysis, tools
from sedimill.plans.recipe import Checkpoint, Recipe, changed, compile_plan, run, stats_frame, traced
from sedimill.sources import mixture, readers, writers
from sedimill.streaming.streams import stream

SF = "/root/testdata/sf0.001"
YAML = """
project_name: demo
text_keys: text
process:
  - whitespace_normalization_mapper:
  - text_length_filter: {min_len: 3}
  - word_repetition_filter: {rep_len: 2}
  - alphanumeric_filter: {min_ratio: 0.5}
  - document_deduplicator: {lowercase: true}
"""


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, " Abc def "), (2, "abc def"), (3, "!!"), (4, None), (5, "?????"), (6, "one two")], "doc_id long, text string")


def test_recipe(spark, docs):
    r = Recipe.from_yaml(YAML)
    ids = lambda x: sorted(i["doc_id"] for i in compile_plan(docs, x).collect())
    assert ids(r) == [1, 6]
    assert ids(Recipe.from_yaml(YAML + "\nfusion: false")) == [1, 6]
    assert ids(r.override(text_length_filter__min_len=8)) == []
    with pytest.raises(ValueError):
        Recipe(process=[{"text_length_filter": {"nope": 1}}]).validated()
    steps = [(b.count(), a.count()) for b, a, _ in traced(docs, r)]
    assert steps[0] == (6, 6)
    assert changed(docs, compile_plan(docs, r, upto=1), r.validated()[0][0]).count() == 1


def test_stats_are_computed_once_for_each_parameter_set(docs):
    r = Recipe(process=[{"word_repetition_filter": {"rep_len": 2}}, {"word_repetition_filter": {"rep_len": 3}}, {"word_repetition_filter": {"rep_len": 3, "max_ratio": 0.9}}])
    assert stats_frame(docs, r).schema["_stats"].dataType.names == ["word_rep_ratio", "word_rep_ratio_2"]


def test_run_resume_export(spark, docs, tmp_path):
    docs.write.json(str(tmp_path / "in"))
    r = Recipe(process=[{"text_length_filter": {"min_len": 3}}, {"document_deduplicator": {}}], dataset_path=str(tmp_path / "in"), export_path=str(tmp_path / "out.jsonl"), project_name="resume")
    assert run(spark, r, resume=True).count() == 4
    assert spark.read.json(str(tmp_path / "out.jsonl")).count() == 4
    import json

    done, saved = Checkpoint(spark, "resume").latest([json.dumps(s, sort_keys=True) for s in [*r.process, {"x": {}}]])
    assert done == 2 and saved.count() == 4


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "m": {"a": 1}}\n{"text": null}\n')
    (tmp_path / "b.jsonl").write_text('{"text": "y", "m": {"b": "z"}}\n')
    (tmp_path / "c.csv").write_text("text\nignored\n")
    df = readers.read(spark, str(tmp_path), add_suffix=True)
    assert sorted(r["text"] for r in df.collect()) == ["x", "y"]
    assert {r["_suffix"] for r in df.collect()} == {".jsonl"}
    with pytest.raises(KeyError):
        readers.read(spark, str(tmp_path), text_keys="body")
    a, b = spark.createDataFrame([(1, (1,))], "i int, s struct<x:int>"), spark.createDataFrame([("q", ("w",))], "i string, s struct<y:string>")
    assert sorted(map(str, readers.union_all([a, b]).collect())) == ["Row(i='1', s=Row(x=1, y=None))", "Row(i='q', s=Row(x=None, y='w'))"]
    assert readers.empty(spark, 3, ["a"]).count() == 3


def test_mixture_and_writers(spark, tmp_path):
    assert mixture.parse("0.5 a b") == [(0.5, "a"), (1.0, "b")]
    df = spark.range(6).withColumnRenamed("id", "doc_id")
    assert mixture.mix([(0.5, df), (2.0, df)], "doc_id").count() == 15
    assert mixture.mix([(1, df), (1, df)], "doc_id", max_samples=7).count() == 8
    assert writers.next_version("main", ["v1", "v3", "dev.9"]) == "v4" and writers.next_version("dev", ["dev.9"]) == "dev.10"
    x = spark.createDataFrame([(1, "t", 2.0)], "doc_id long, text string, v double")
    packed = writers.serialize_meta(x, ["text"])
    assert writers.deserialize_meta(packed, "doc_id long, v double").first().asDict() == {"text": "t", "doc_id": 1, "v": 2.0}
    writers.export(x.withColumn("_stats", F.struct("v")), str(tmp_path / "o.parquet"), shards=2, stats_path=str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "o.parquet")).columns == ["doc_id", "text", "v"]
    assert writers.nan_to_null(spark.createDataFrame([(float("nan"),)], "v double")).first()["v"] is None


def test_analysis(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    r = analysis.describe(df, ["v"]).first()
    assert (r["count"], r["mean"], r["p25"], r["p50"]) == (101, 50.0, 25.0, 50.0)
    assert sum(x["n"] for x in analysis.histogram(df, "v").collect()) == 101
    p = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, p double")
    m = analysis.measures(p, p).first()
    assert abs(m["kl"]) < 1e-12 and math.isclose(m["entropy"], math.log(2))
    assert tools.count_tokens(spark.createDataFrame([("a b  c",)], "text string")).first()["tokens"] == 3


def test_streaming_recipe(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    out = stream(src, Recipe(process=[{"clean_email_mapper": {}}, {"text_length_filter": {"min_len": 6}}]))
    q = out.writeStream.format("memory").queryName("stream_recipe").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["doc_id"] for r in spark.table("stream_recipe").collect()) == [1, 2, 6]
    with pytest.raises(ValueError):
        stream(src, Recipe(process=[{"document_deduplicator": {}}]))


@pytest.mark.parametrize("name", ["recipe_flagship", "alphanumeric_filter", "clean_links_mapper", "gather_generated_data_filter", "histogram"])
def test_queries_match_sql(spark, name):
    from sedimill.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(map(str, d[cols].itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_entry_works_without_the_optional_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sedimill.llm")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "recipe_flagship" in entry.queries() and not any(k.startswith("op1") for k in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_word_processor_files_and_arrays(spark, tmp_path):
    import zipfile

    from sedimill.sources.readers import read

    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'
    (tmp_path / "w").mkdir()
    with zipfile.ZipFile(tmp_path / "w" / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "w" / "b.docx").write_bytes(b"no archive")
    assert [r["text"] for r in read(spark, str(tmp_path / "w")).collect()] == ["one\ttwo\nthree"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('[\n{"text": "a"},\n{"text": "b"}]')
    assert sorted(r["text"] for r in read(spark, str(tmp_path / "j")).collect()) == ["a", "b"]


def test_numbers_places_and_shuffles(spark):
    from pyspark.sql import functions as F

    from sedimill.plans import tools

    df = spark.range(500).select((F.col("id") * 7 % 500).alias("id"))
    assert sorted(r["id"] for r in tools.at_positions(df, [0, 3, 499, 500], "id").collect()) == [0, 3, 499]
    first, again = (sorted((r["place"], r["id"]) for r in tools.shuffled(df, "id").collect()) for _ in range(2))
    assert first == again and [p for p, _ in first] == list(range(500)) and [i for _, i in first] != sorted(i for _, i in first)
    assert tools.shuffled(df.limit(0), "id").collect() == []


def test_first_row_of_a_key_with_repeated_and_missing_ids(spark):
    from sedimill.operators import registry

    df = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b"), (3, None), (4, "")], "doc_id long, text string")
    rows = registry.get("document_deduplicator").apply(df, None).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in rows) == [("2", "a"), ("3", None), ("None", "b")]


def test_ignored_parameters_are_refused(spark):
    from sedimill.operators import registry

    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for name in ("words_num_filter", "word_repetition_filter", "stopwords_filter", "flagged_words_filter"):
        with pytest.raises(ValueError):
            registry.get(name).apply(df, None, tokenization=True)
