"""Registered queries of the library's own operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimill.functions import text as T
from sedimill.operators import mappers as M
from sedimill.operators import registry
from sedimill.operators.filters import FLAGGED, STOPWORDS, cosine_with
from sedimill.operators.registry import Context

from . import analysis
from .recipe import Recipe, compile_plan, stats_frame

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


#: The pieces of SQL that several queries share.
S = T.SPECIAL
STRIP = f"^{T.STRIP_CLASS}+|{T.STRIP_CLASS}+$"
WORDS = "list_filter(string_split_regex({c}, '[ \\n\\t]'), lambda w: w <> '')"
REFINED = f"list_filter(list_transform(string_split_regex(lower(text), '[ \\n\\t]'), lambda w: regexp_replace(w, '^[{S}]+|[{S}]+\\z', '', 'g')), lambda w: w <> '')"
LINES = f"string_split_regex(regexp_replace(text, '({T.LINE_END})\\z', ''), '{T.LINE_END}')"


def _filter(name: str, params: dict, stat: str, value: str, keep: str, digits: int | None = 6) -> None:
    """doc_id, the statistic and whether the row is kept."""
    op = registry.get(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats, test = op.stats(Context(), **params)
        df = table(spark, sf_dir, "documents").select("doc_id", "text").withColumns(stats)
        out = df.select("doc_id", stat, test({k: F.col(k) for k in stats}).alias("keep"))
        return out.withColumn(stat, F.round(stat, digits)) if digits else out

    shown = f"round({value}, {digits})" if digits else value
    query(name, f"SELECT doc_id, {shown} AS {stat}, {keep.format(v=f'({value})')} AS keep FROM documents")(run)


_filter("text_length_filter", {"min_len": 100, "max_len": 5000}, "text_len", "length(text)", "{v} BETWEEN 100 AND 5000", None)
_filter("alphanumeric_filter", {"min_ratio": 0.7}, "alnum_ratio", r"CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::DOUBLE / length(text) ELSE 0.0 END", "{v} >= 0.7")
_filter("average_line_length_filter", {"min_len": 50}, "avg_line_length", f"CASE WHEN length(text) > 0 THEN length(text)::DOUBLE / len({LINES}) ELSE 0.0 END", "{v} >= 50")
_filter("maximum_line_length_filter", {"min_len": 100}, "max_line_length", f"CASE WHEN length(text) > 0 THEN list_max(list_transform({LINES}, lambda l: length(l))) ELSE 0 END", "{v} >= 100", None)
_filter("special_characters_filter", {"max_ratio": 0.25}, "special_char_ratio", f"CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[{S}]', '', 'g')))::DOUBLE / length(text) ELSE 0.0 END", "{v} BETWEEN 0 AND 0.25")
_filter("words_num_filter", {"min_num": 50}, "num_words", f"len({WORDS.format(c='text')})", "{v} >= 50", None)


def _share(words: list) -> str:
    inside = "[" + ", ".join(q(w) for w in words) + "]"
    return f"CASE WHEN len({REFINED}) > 0 THEN least(len(list_filter({REFINED}, lambda w: list_contains({inside}, w)))::DOUBLE / len({REFINED}), 1.0) ELSE 0.0 END"


_filter("stopwords_filter", {"min_ratio": 0.1}, "stopwords_ratio", _share(STOPWORDS["en"]), "{v} >= 0.1")
_filter("flagged_words_filter", {"max_ratio": 0.01}, "flagged_words_ratio", _share(FLAGGED["en"]), "{v} <= 0.01")
_filter("multi_keyword_filter", {"keywords": "token, password"}, "has_keyword", "contains(lower(text), 'token') OR contains(lower(text), 'password')", "NOT {v}", None)
_filter("character_repetition_filter", {"max_ratio": 0.2}, "char_rep_ratio", "0", "{v}")
SQL["character_repetition_filter"] = """
WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
grams AS (SELECT doc_id, i, string_agg(c, '') OVER w AS g, count(*) OVER w AS n FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
counts AS (SELECT doc_id, g, count(*) AS n FROM grams WHERE n = 10 GROUP BY doc_id, g),
ranked AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS r, count(*) OVER (PARTITION BY doc_id) AS d, count(*) FILTER (n > 1) OVER (PARTITION BY doc_id) AS m, sum(n) OVER (PARTITION BY doc_id) AS total FROM counts),
shares AS (SELECT doc_id, coalesce(sum(n) FILTER (r <= least(floor(sqrt(d)), m)), 0)::DOUBLE / any_value(total)::DOUBLE AS v FROM ranked GROUP BY doc_id)
SELECT doc_id, round(coalesce(v, 0.0), 6) AS char_rep_ratio, coalesce(v, 0.0) <= 0.2 AS keep FROM documents LEFT JOIN shares USING (doc_id)
"""
_filter("word_repetition_filter", {"rep_len": 3, "max_ratio": 0.2}, "word_rep_ratio", "0", "{v}")
SQL["word_repetition_filter"] = f"""
WITH lists AS (SELECT doc_id, {REFINED} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS c, generate_subscripts(ws, 1) AS i FROM lists),
grams AS (SELECT doc_id, string_agg(c, ' ') OVER w AS g, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
counts AS (SELECT doc_id, g, count(*) AS n FROM grams WHERE n = 3 GROUP BY doc_id, g),
shares AS (SELECT doc_id, coalesce(sum(n) FILTER (n > 1), 0)::DOUBLE / sum(n)::DOUBLE AS v FROM counts GROUP BY doc_id)
SELECT doc_id, round(coalesce(v, 0.0), 6) AS word_rep_ratio, coalesce(v, 0.0) <= 0.2 AS keep FROM documents LEFT JOIN shares USING (doc_id)
"""


def _mapper(name: str, params: dict, sql: str | None, source: str = "documents", key: str = "doc_id", text: str = "text", suffix: str = "") -> None:
    """The id, the digest of the mapped text and its length."""
    op = registry.get(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).select(key, F.col(text).alias("text"))
        return op.apply(df, Context(id_col=key), **params).select(key, F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n"))

    made = f"SELECT {key}, md5(t) AS digest, length(t) AS n FROM (SELECT {key}, {sql.format(c=text)} AS t FROM {source})" if sql else None
    query(name + suffix, made)(run)


def _gone(pattern: str, repl: str = "", flags: str = "gs") -> str:
    return "regexp_replace({c}, " + q(pattern).replace("{", "{{").replace("}", "}}") + f", {q(repl)}, '{flags}')"


_mapper("clean_email_mapper", {"repl": "<mail>"}, _gone(M.EMAIL, "<mail>"))
_mapper("clean_ip_mapper", {}, _gone(M.IP))
_mapper("clean_links_mapper", {}, _gone(M.LINKS), "pages", "page_id", "html")
_mapper("clean_copyright_mapper", {"matching_rules": ["Licensed under [^\\n]*"]}, f"regexp_replace(regexp_replace({_gone('Licensed under [^\\n]*', ' ', 'g')}, '\\n{{{{3,}}}}', chr(10) || chr(10), 'g'), {q(STRIP).replace('{', '{{').replace('}', '}}')}, '', 'g')".replace("{{{{3,}}}}", "{{3,}}"))
_mapper("replace_content_mapper", {"pattern": ["[0-9]+", "(the) (of)"], "repl": ["#", r"\2 \1"]}, r"regexp_replace(regexp_replace({c}, '[0-9]+', '#', 'g'), '(the) (of)', '\2 \1', 'g')")
_single = {k: v for k, v in M.PUNCTUATION.items() if len(v) == 1}
_mapper("punctuation_normalization_mapper", {}, f"replace(replace(replace(translate({{c}}, {q(''.join(_single))}, {q(''.join(_single.values()))}), '—', ' - '), '．', '. '), '…', '...')")
_mapper("whitespace_normalization_mapper", {}, f"translate(regexp_replace({{c}}, {q(STRIP).replace('{', '{{').replace('}', '}}')}, '', 'g'), {q(T.WHITESPACES)}, {q(' ' * len(T.WHITESPACES))})")
_mapper("remove_bibliography_mapper", {}, _gone(M.BIBLIOGRAPHY))
_mapper("remove_comments_mapper", {}, "regexp_replace(regexp_replace({c}, '(?m)[^\\\\]%.+$', '', 'g'), '(?m)^%.*\\n?', '', 'g')")
_mapper("remove_header_mapper", {"drop_no_head": False}, "CASE WHEN regexp_matches({c}, " + q("(?s)" + M.HEADER).replace("{", "{{").replace("}", "}}") + ") THEN regexp_replace({c}, " + q("(?s)" + M.HEADER).replace("{", "{{").replace("}", "}}") + ", '\\2', 'g') ELSE {c} END")
_BARE = f"regexp_replace(w, '^[{S}]+|[{S}]+\\z', '', 'g')".replace("{", "{{").replace("}", "}}")


def _kept(test: str) -> str:
    part = f"array_to_string(list_filter(string_split(p, ' '), lambda w: w <> '' AND ({test})), ' ')"
    line = f"array_to_string(list_filter(list_transform(string_split(l, chr(9)), lambda p: {part}), lambda p: p <> ''), chr(9))"
    return f"array_to_string(list_filter(list_transform(string_split({{c}}, chr(10)), lambda l: {line}), lambda l: l <> ''), chr(10))"


_mapper("remove_long_words_mapper", {"max_len": 12}, _kept(f"length(w) BETWEEN 1 AND 12 OR length({_BARE}) BETWEEN 1 AND 12"))
_mapper("remove_words_with_incorrect_substrings_mapper", {"substrings": ["ion", "http"]}, _kept(f"NOT contains({_BARE}, 'ion') AND NOT contains({_BARE}, 'http')"))
_mapper("remove_non_chinese_character_mapper", {"keep_number": False}, "regexp_replace({c}, '[^一-龥A-Za-z.， ,\\-。%《*》/•、&＆(—)（+）：？!！“”·]', '', 'g')")
_mapper("remove_specific_chars_mapper", {"chars_to_remove": "|◆!"}, "regexp_replace({c}, '[|◆!]', '', 'g')")
for _name, _src in (("remove_table_text_mapper", None), ("expand_macro_mapper", None), ("fix_unicode_mapper", None), ("remove_repeat_sentences_mapper", None), ("sentence_split_mapper", None)):
    _mapper(_name, {}, None)
_mapper("clean_html_mapper", {}, None, "pages", "page_id", "html")
_mapper("md_to_jsonl_chunk_mapper", {"chunk_size": 100, "overlap": 20}, None)
_mapper("md_to_jsonl_sentence_chunk_mapper", {"chunk_size": 200, "chunk_overlap": 40}, None)


def _rows(name: str, params: dict, sql: str | None, cols: tuple = ("doc_id",), source: str = "documents", make=lambda df: df, key: str = "doc_id", suffix: str = "") -> None:
    """The columns of the rows that an operator leaves."""
    op = registry.get(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.apply(make(table(spark, sf_dir, source)), Context(id_col=key), **params).select(*cols)

    query(name + suffix, sql)(run)


_rows("specified_field_filter", {"field_key": "lang", "target_value": ["fr", "de"]}, "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')", ("doc_id", "lang"))
_rows("specified_numeric_field_filter", {"field_key": "n_chars", "min_value": 500, "max_value": 2000}, "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 2000 AND n_chars <> 0", ("doc_id", "n_chars"))
_rows("suffix_filter", {"suffixes": [".src1", ".src2"]}, "SELECT doc_id, '.' || source AS _suffix FROM documents WHERE source IN ('src1', 'src2')", ("doc_id", "_suffix"), make=lambda df: df.withColumn("_suffix", F.concat(F.lit("."), "source")))
_rows("text_high_score_filter", {"score_field": "score", "min_score": 1.0, "max_score": 3.0}, "SELECT doc_id FROM documents WHERE n_chars / 1000.0 >= 1.0 AND n_chars / 1000.0 < 3.0", make=lambda df: df.withColumn("score", F.col("n_chars") / 1000.0))
_rows("text_bloom_filter", {}, "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
_rows("document_deduplicator", {}, f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(regexp_replace(text, {q(STRIP)}, '', 'g'))")
_rows("document_deduplicator", {"lowercase": True, "ignore_non_character": True}, f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(regexp_replace(lower(regexp_replace(text, {q(STRIP)}, '', 'g')), " + q(r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|\p{Nd}+|[!-/:-@\[-`{-~]") + ", '', 'g'))", suffix="_letters")
_rows("ray_document_deduplicator", {"lowercase": True}, f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(lower(regexp_replace(text, {q(STRIP)}, '', 'g')))")
_rows("document_minhash_deduplicator", {}, None)
_rows("document_simhash_deduplicator", {}, None)
_rows("language_id_score_filter", {"lang": ["en", "fr", "de", "es"], "min_score": 0.5}, None)
_rows("token_num_filter", {"min_num": 100, "max_num": 1000}, None)
_rows("frequency_specified_field_selector", {"field_key": "source", "topk": 3}, "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, min(doc_id) LIMIT 3)", ("doc_id", "source"))
_rows("topk_specified_field_selector", {"field_key": "n_chars", "topk": 50}, "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50", ("doc_id", "n_chars"))
_rows("range_specified_field_selector", {"field_key": "n_chars", "lower_percentile": 0.25, "upper_percentile": 0.5}, "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r >= floor(0.25 * n) AND r < floor(0.5 * n)", ("doc_id", "n_chars"))
_rows("random_selector", {"select_ratio": 0.2}, None)
_rows(
    "encode_and_get_nearest_mapper", {"k": 5},
    "SELECT a.vec_id, list(b.vec_id ORDER BY s DESC, b.vec_id)[1:5] AS nn_indices FROM (SELECT x.vec_id, y.vec_id AS other, list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id) p JOIN embeddings a ON a.vec_id = p.vec_id JOIN embeddings b ON b.vec_id = p.other GROUP BY a.vec_id",
    ("vec_id", "nn_indices"), "embeddings", key="vec_id",
)
_rows(
    "dedup_and_save_deduplicator", {"similarity_threshold": 0.5}, "SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0", ("vec_id",), "embeddings", key="vec_id",
    make=lambda df: df.withColumn("nn_indices", F.array(F.col("vec_id") - 1)).withColumn("nn_scores", F.array(F.when(F.col("vec_id") % 5 == 0, 0.1).otherwise(0.9))),
)
_rows(
    "gather_generated_data_filter", {},
    "WITH t AS (SELECT u.conv_id * 1000 + u.turn AS id, trim(u.text) AS p, trim(a.text) AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') "
    "SELECT id, p AS first_prompt, r AS first_answer FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN length(p) >= 3 THEN p END ORDER BY id) AS n FROM t) WHERE n = 1 AND length(p) >= 3 AND length(r) >= 3",
    ("id", "first_prompt", "first_answer"), "conversations", key="id",
    make=lambda df: df.where("role = 'user'").alias("u").join(df.where("role = 'assistant'").alias("a"), F.expr("a.conv_id = u.conv_id AND a.turn = u.turn + 1")).select(F.expr("u.conv_id * 1000 + u.turn AS id"), F.expr("u.text AS instruction"), F.expr("a.text AS response")),
)
_ONES = "[" + ", ".join(["1.0"] * 64) + "]"


@query("annotate_edu_train_bert_scorer_mapper", f"SELECT vec_id, round(greatest(0.0, least(5.0, CASE WHEN s < 0.3 THEN s * 10 / 3 WHEN s < 0.6 THEN 1 + (s - 0.3) * 6.67 ELSE 3 + (s - 0.6) * 5 END)), 6) AS text_score FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], {_ONES}::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 8.0) AS s FROM embeddings)")
def edu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").withColumn("text", F.lit(""))
    out = registry.get("annotate_edu_train_bert_scorer_mapper").apply(df, Context(), query_embedding=[1.0] * 64)
    return out.select("vec_id", F.round("text_score", 6).alias("text_score"))


@query("cosine_similarity", f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_ONES}::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 8.0), 6) AS cosine FROM embeddings")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine_with(F.col("embedding"), [1.0] * 64), 6).alias("cosine"))


FLAGSHIP = Recipe(process=[
    {"whitespace_normalization_mapper": {}}, {"clean_email_mapper": {}}, {"text_length_filter": {"min_len": 50}},
    {"alphanumeric_filter": {"min_ratio": 0.6}}, {"document_deduplicator": {}},
])


@query(
    "recipe_flagship",
    f"WITH a AS (SELECT doc_id, regexp_replace(translate(regexp_replace(text, {q(STRIP)}, '', 'g'), {q(T.WHITESPACES)}, {q(' ' * len(T.WHITESPACES))}), {q(M.EMAIL)}, '', 'gs') AS t FROM documents), "
    f"b AS (SELECT * FROM a WHERE length(t) >= 50 AND length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE / length(t) >= 0.6) "
    f"SELECT min(doc_id) AS doc_id, md5(any_value(t)) AS digest FROM b GROUP BY regexp_replace(t, {q(STRIP)}, '', 'g')",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_plan(table(spark, sf_dir, "documents"), FLAGSHIP).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("analyzer", "SELECT 'text_len' AS name, count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x)::DOUBLE AS min, quantile_cont(x, 0.25)::DOUBLE AS p25, quantile_cont(x, 0.5)::DOUBLE AS p50, quantile_cont(x, 0.75)::DOUBLE AS p75, max(x)::DOUBLE AS max FROM (SELECT length(text) AS x FROM documents)")
def analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats_frame(table(spark, sf_dir, "documents"), Recipe(process=[{"text_length_filter": {}}])).select("_stats.*")
    return analysis.describe(df, ["text_len"]).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("describe_strings", "SELECT count(source) AS count, count(DISTINCT source) AS \"unique\", (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source DESC LIMIT 1) AS top, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source)) AS freq FROM documents")
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.describe_strings(table(spark, sf_dir, "documents"), "source")


@query("histogram", "WITH s AS (SELECT count(n_chars) AS n, min(n_chars)::DOUBLE AS a, max(n_chars)::DOUBLE AS b FROM documents), w AS (SELECT a, b, floor(sqrt(n))::INT AS k, (b - a) / floor(sqrt(n)) AS d FROM s) SELECT least(floor((n_chars - a) / d), k - 1)::INT AS bin, count(*) AS n FROM documents, w GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.histogram(table(spark, sf_dir, "documents"), "n_chars").select("bin", "n")


@query("distribution_measures", "WITH p AS (SELECT source AS v, count(*) / (SELECT count(*) FROM documents WHERE lang = 'en')::DOUBLE AS a FROM documents WHERE lang = 'en' GROUP BY 1), q AS (SELECT source AS v, count(*) / (SELECT count(*) FROM documents WHERE lang <> 'en')::DOUBLE AS b FROM documents WHERE lang <> 'en' GROUP BY 1), t AS (SELECT greatest(coalesce(a, 0), 1e-12) AS a, greatest(coalesce(b, 0), 1e-12) AS b FROM p FULL JOIN q USING (v)) SELECT round(sum(a * ln(a / b)), 6) AS kl, round(sum(a * ln(a / ((a + b) / 2))) / 2 + sum(b * ln(b / ((a + b) / 2))) / 2, 6) AS js, round(-sum(a * ln(b)), 6) AS cross_entropy, round(-sum(a * ln(a)), 6) AS entropy FROM t")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = analysis.measures(analysis.distribution(docs.where("lang = 'en'"), "source"), analysis.distribution(docs.where("lang <> 'en'"), "source"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("token_counts", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS token FROM documents) WHERE token <> '' GROUP BY token")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.token_counts(table(spark, sf_dir, "documents"))


@query("top_per_group", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM c WHERE lang IN (SELECT lang FROM c GROUP BY lang ORDER BY sum(n) DESC, lang LIMIT 3)) WHERE r <= 4")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.top_per_group(table(spark, sf_dir, "documents"), "lang", "source", 3, 4)


@query("three_sigma", "SELECT doc_id FROM documents WHERE n_chars BETWEEN (SELECT avg(n_chars) - 3 * stddev_samp(n_chars) FROM documents) AND (SELECT avg(n_chars) + 3 * stddev_samp(n_chars) FROM documents)")
def sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    low, high = analysis.three_sigma(docs, "n_chars")
    return docs.where(F.col("n_chars").between(low, high)).select("doc_id")


@query("schema_union", "SELECT id, text, kind, score FROM (SELECT doc_id::VARCHAR AS id, text, 'd' AS kind, NULL::DOUBLE AS score FROM documents UNION ALL SELECT item_id::VARCHAR, text, 'b', 1.5 FROM benchmark)")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedimill.sources.readers import union_all

    a = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit("d").alias("kind"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("b").alias("kind"), F.lit(1.5).alias("score"))
    return union_all([a, b])


@query("mixture")
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedimill.sources.mixture import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return mix([(0.5, docs.where("lang = 'en'")), (1.5, docs.where("lang = 'fr'"))], "doc_id")


@query("language_split", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query("quality_model")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = analysis.quality_model(docs.join(labels, "doc_id"), features=1 << 12)
    return analysis.quality_predictions(model, docs).select("doc_id", F.round("doc_score", 4).alias("doc_score"), "should_keep")


@query("stream_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, counted in windows of event time."""
    from sedimill.streaming.streams import windowed_counts

    schema = table(spark, sf_dir, "events").schema
    counts = windowed_counts(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"), "ts", "event_type", "1 hour")
    name = f"windows_{uuid.uuid4().hex}"
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


# A relational baseline on the star schema: Spark's own operators, no counterpart to match.
@query("baseline_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("baseline_join", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation")}
    x = t["lineitem"].join(t["orders"], F.expr("l_orderkey = o_orderkey")).join(t["customer"], F.expr("o_custkey = c_custkey")).join(t["nation"], F.expr("c_nationkey = n_nationkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("baseline_window", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def window(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(best)).where("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("baseline_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def _tool(name: str, sql: str | None):
    def add(fn):
        query(name, sql)(lambda spark, sf_dir: fn(table(spark, sf_dir, "documents").select("doc_id", "lang")))
        return fn

    return add


@_tool("constant_column", "SELECT doc_id, lang, 'corpus' AS origin FROM documents")
def _constant(df: DataFrame) -> DataFrame:
    from .tools import with_constant

    return with_constant(df, "origin", "corpus")


@_tool("positional_select", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i IN (0, 7, 99)")
def _positions(df: DataFrame) -> DataFrame:
    from .tools import at_positions

    return at_positions(df, [0, 7, 99, 10**9], "doc_id")


@_tool("shuffle", None)
def _shuffle(df: DataFrame) -> DataFrame:
    from .tools import shuffled

    return shuffled(df, "doc_id")
