"""Text and field filters: statistics as Columns and predicates on them."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimill.functions import text as T

from .registry import Context, register

#: Small neutral lists; give your own through the parameters.
STOPWORDS = {"en": ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]}
FLAGGED = {"en": ["idiot", "loser", "moron", "scum"]}


def _between(name: str, low, high):
    return lambda s: (s[name] >= low) & (s[name] <= high)


def _no_tokens(tokenization: bool) -> None:
    """Words are split at white space; splitting them by a trained tokenizer isn't offered here, and isn't passed over in silence."""
    if tokenization:
        raise ValueError("tokenization=True needs a trained tokenizer, which this filter doesn't take")


def _stat(name: str, value: Column, low, high):
    return {name: value}, _between(name, low, high)


@register("text_length_filter", "filter", form="stats")
def text_length(c: Column, min_len: int = 10, max_len: int = sys.maxsize):
    """Number of characters."""
    return _stat("text_len", F.length(c).cast("long"), min_len, max_len)


@register("alphanumeric_filter", "filter", form="stats")
def alphanumeric(c: Column, tokenization: bool = False, min_ratio: float = 0.25, max_ratio: float = sys.maxsize):
    """Share of letters and digits among the characters (``tokenization``: letters for each token)."""
    if tokenization:
        value = T.ratio(F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.size(T.words(c)))
        return _stat("alpha_token_ratio", value, min_ratio, max_ratio)
    return _stat("alnum_ratio", T.ratio(F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")), F.length(c)), min_ratio, max_ratio)


@register("average_line_length_filter", "filter", form="stats")
def average_line_length(c: Column, min_len: int = 10, max_len: int = sys.maxsize):
    """Characters, line ends included, for each line."""
    return _stat("avg_line_length", T.ratio(F.length(c), F.size(T.lines(c))), min_len, max_len)


@register("maximum_line_length_filter", "filter", form="stats")
def maximum_line_length(c: Column, min_len: int = 10, max_len: int = sys.maxsize):
    """Length of the longest line."""
    return _stat("max_line_length", F.coalesce(F.array_max(F.transform(T.lines(c), F.length)), F.lit(0)).cast("long"), min_len, max_len)


@register("character_repetition_filter", "filter", form="stats")
def character_repetition(c: Column, rep_len: int = 10, min_ratio: float = 0.0, max_ratio: float = 0.5):
    """Share of the most frequent character n-grams, as many as the root of their number, among all."""
    return {"char_rep_ratio": _char_repetition(rep_len)(c)}, _between("char_rep_ratio", min_ratio, max_ratio)


def _char_repetition(n: int):
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        from collections import Counter
        from math import isqrt

        def one(t):
            if t is None:
                return None
            counts = sorted(Counter(t[i : i + n] for i in range(len(t) - n + 1)).values(), reverse=True)
            total = sum(counts)
            if not total:
                return 0.0
            return sum(counts[: min(isqrt(len(counts)), sum(x > 1 for x in counts))]) / total

        return texts.map(one)

    return run


@register("word_repetition_filter", "filter", form="stats")
def word_repetition(c: Column, lang: str = "en", tokenization: bool = False, rep_len: int = 10, min_ratio: float = 0.0, max_ratio: float = 0.5):
    """Share of word n-grams that occur more than once. Words are split alike in every language."""
    _no_tokens(tokenization)
    return {"word_rep_ratio": _word_repetition(rep_len)(T.refined_words(c))}, _between("word_rep_ratio", min_ratio, max_ratio)


def _word_repetition(n: int):
    @F.pandas_udf("double")
    def run(lists: pd.Series) -> pd.Series:
        from collections import Counter

        def one(ws):
            if ws is None:
                return None
            ws = list(ws)
            counts = Counter(" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)).values()
            total = sum(counts)
            return sum(x for x in counts if x > 1) / total if total else 0.0

        return lists.map(one)

    return run


@register("special_characters_filter", "filter", form="stats")
def special_characters(c: Column, min_ratio: float = 0.0, max_ratio: float = 0.25):
    """Share of special characters: punctuation, digits, white space, symbols, emoji."""
    value = T.ratio(F.length(c) - F.length(T.without_special(c)), F.length(c))
    return _stat("special_char_ratio", value, min_ratio, max_ratio)


@register("words_num_filter", "filter", form="stats")
def words_num(c: Column, lang: str = "en", tokenization: bool = False, min_num: int = 10, max_num: int = sys.maxsize):
    """Number of words between spaces, tabs and line feeds, in every language."""
    _no_tokens(tokenization)
    return _stat("num_words", F.size(T.words(c)).cast("long"), min_num, max_num)


def _listed(c: Column, words: list, use_words_aug: bool, sizes: list, joiner: str) -> Column:
    def share(ws: Column) -> Column:
        pool = T.augmented(ws, sizes, joiner) if use_words_aug else ws
        hits = F.size(F.filter(pool, lambda w: w.isin(*words) if words else F.lit(False)))
        return F.least(T.ratio(hits, F.size(ws)), F.lit(1.0))

    return F.get(F.transform(F.array(T.refined_words(c)), share), 0)  # the words are made once


def _list_of(lists: dict, lang: str, given) -> list:
    if given is not None:
        lists = given if isinstance(given, dict) else {lang: list(given)}
    return sorted({w for v in lists.values() for w in v}) if lang == "all" else list(lists.get(lang, []))


@register("stopwords_filter", "filter", form="stats")
def stopwords(c: Column, lang: str = "en", tokenization: bool = False, min_ratio: float = 0.3, stopwords_dir: dict | list | None = None, use_words_aug: bool = False, words_aug_group_sizes: tuple = (2,), words_aug_join_char: str = ""):
    """Share of stop words; too few are dropped. ``stopwords_dir`` is the list itself, or lists by language."""
    _no_tokens(tokenization)
    value = _listed(c, _list_of(STOPWORDS, lang, stopwords_dir), use_words_aug, list(words_aug_group_sizes), words_aug_join_char)
    return {"stopwords_ratio": value}, lambda s: s["stopwords_ratio"] >= min_ratio


@register("flagged_words_filter", "filter", form="stats")
def flagged_words(c: Column, lang: str = "en", tokenization: bool = False, max_ratio: float = 0.045, flagged_words_dir: dict | list | None = None, use_words_aug: bool = False, words_aug_group_sizes: tuple = (2,), words_aug_join_char: str = ""):
    """Share of flagged words, at most 1; too many are dropped."""
    _no_tokens(tokenization)
    value = _listed(c, _list_of(FLAGGED, lang, flagged_words_dir), use_words_aug, list(words_aug_group_sizes), words_aug_join_char)
    return {"flagged_words_ratio": value}, lambda s: s["flagged_words_ratio"] <= max_ratio


@register("multi_keyword_filter", "filter", form="stats")
def multi_keyword(c: Column, keywords: str | list = (), case_sensitive: bool = False):
    """Rows that contain a keyword are dropped; keywords may be one string separated by commas."""
    found = [k.strip() for k in re.split("[,，]", keywords)] if isinstance(keywords, str) else [str(k).strip() for k in keywords]
    t = F.coalesce(c, F.lit(""))
    t = t if case_sensitive else F.lower(t)
    hit = F.lit(False)
    for k in found:
        if k:
            hit = hit | t.contains(k if case_sensitive else k.lower())
    return {"has_keyword": hit}, lambda s: ~s["has_keyword"]


def field_type(df: DataFrame, path: str):
    """The Column of a dotted path (a flat name first) and its type; None if the frame has no such field."""
    if path in df.columns:
        return F.col(f"`{path}`"), df.schema[path].dataType
    try:
        frame = df.select(F.col(path).alias("x"))
        return F.col(path), frame.schema["x"].dataType
    except Exception:
        return None, None


@register("specified_field_filter", "filter")
def specified_field(df: DataFrame, ctx: Context, field_key: str = "", target_value: list = ()) -> DataFrame:
    """Rows whose field, or each of its values if it is a list, is among the target values."""
    if not field_key or not target_value:
        return df
    c, kind = field_type(df, field_key)
    if c is None:
        raise KeyError(field_key)
    if kind.typeName() == "array":
        return df.where(F.forall(c, lambda x: x.isin(*target_value)))
    return df.where(c.isin(*target_value))


@register("specified_numeric_field_filter", "filter")
def specified_numeric_field(df: DataFrame, ctx: Context, field_key: str = "", min_value: float = -sys.maxsize, max_value: float = sys.maxsize) -> DataFrame:
    """Rows whose field is a number in range. A numeric 0 counts as no number; the string "0" does."""
    if not field_key:
        return df
    c, kind = field_type(df, field_key)
    if c is None:
        raise KeyError(field_key)
    value = c.try_cast("double")
    found = (value >= min_value) & (value <= max_value)
    if kind.typeName() != "string":
        found = found & (value != 0)
    return df.where(found)


@register("suffix_filter", "filter")
def suffix(df: DataFrame, ctx: Context, suffixes: str | list = ()) -> DataFrame:
    """Rows whose ``_suffix`` is listed."""
    wanted = [suffixes] if isinstance(suffixes, str) else list(suffixes)
    return df.where(F.col("_suffix").isin(*wanted)) if wanted else df


@register("text_high_score_filter", "filter")
def text_high_score(df: DataFrame, ctx: Context, score_field: str = "text_score", min_score: float = 0.0, max_score: float = 5.0) -> DataFrame:
    """min_score <= score < max_score; what is no number is dropped."""
    s = F.col(score_field).try_cast("double")
    return df.where((s >= min_score) & (s < max_score))


@register("text_bloom_filter", "filter")
def text_bloom(df: DataFrame, ctx: Context, error_rate: float = 1e-6, hash_func: str = "md5", initial_capacity: int = 100) -> DataFrame:
    """The first row (by id) of each text is kept. Exact: the digests are grouped rather than kept in a filter."""
    return first_of(df, ctx, F.md5(F.coalesce(F.col(ctx.text_key), F.lit("")).cast("binary")))


def first_of(df: DataFrame, ctx: Context, key: Column) -> DataFrame:
    """One row of each key, the one with the smallest id (a missing id comes last).

    What comes before is computed once, and a task hands on one row for each of its keys, so a frequent key is no burden.
    """
    names = [f"`{c}`" for c in df.columns]
    i = F.col(f"`{ctx.id_col}`")
    rows = df.select(key.alias("_key"), F.struct(i.isNull().alias("missing"), i.alias("id")).alias("_by"), F.struct(*names).alias("_row"))
    return rows.groupBy("_key").agg(F.min_by("_row", "_by").alias("_row")).select("_row.*")


@register("gather_generated_data_filter", "filter")
def gather_generated_data(df: DataFrame, ctx: Context) -> DataFrame:
    """first_prompt, first_answer and conversation from instruction and response; repeats of a prompt and short pairs go."""
    if "conversation" in df.columns:
        return df

    def clean(name):
        t = T.strip(F.replace(F.replace(F.col(name), F.lit("||"), F.lit("")), F.lit("<|im_end|>"), F.lit("")))
        return F.when(F.length(t) >= 3, t)

    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    out = df.withColumn("first_prompt", clean("instruction")).withColumn("first_answer", clean("response"))
    out = out.withColumn("conversation", F.when(F.col("first_prompt").isNotNull() & F.col("first_answer").isNotNull(), F.array(turn("user", "first_prompt"), turn("assistant", "first_answer"))))
    first = Window.partitionBy("first_prompt").orderBy(ctx.id_col)
    return out.withColumn("_nth", F.row_number().over(first)).where("_nth = 1 AND conversation IS NOT NULL").drop("_nth")


@register("annotate_edu_train_bert_scorer_mapper", "mapper")
def edu_score(df: DataFrame, ctx: Context, auth_token: str = "", model_url: str = "", model_name: str = "", dimensions: int = 1024, query_text: str = "What is Deep Learning?", embedding_col: str = "embedding", query_embedding: list | None = None) -> DataFrame:
    """Cosine of each row's embedding and the query's, mapped to 0 to 5, in ``text_score``."""
    if query_embedding is None:
        embed = ctx.backends.get("annotate_edu_train_bert_scorer_mapper")
        if embed is None:
            from .registry import BackendMissing

            raise BackendMissing("an embedding of the query is needed")
        query_embedding = list(embed(query_text))
    cosine = cosine_with(F.col(embedding_col), query_embedding)
    score = F.when(cosine < 0.3, cosine * 10 / 3).when(cosine < 0.6, 1 + (cosine - 0.3) * 6.67).otherwise(3 + (cosine - 0.6) * 5)
    return df.withColumn(f"{ctx.text_key}_score", F.when(cosine.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(5.0), score))))


def cosine_with(v: Column, query: list) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(v.cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, norm * sum(float(x) ** 2 for x in query) ** 0.5)


@register("language_id_score_filter", "filter", tier="R")
def language_id_score(df: DataFrame, ctx: Context, lang: str | list = "", min_score: float = 0.8) -> DataFrame:
    """Rows in one of the languages with at least this score. A backend maps a text to (language, score); the default counts function words."""
    model = ctx.backends.get("language_id_score_filter", guess_language)

    @F.pandas_udf("struct<lang string, score double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model((t or "").lower().replace("\n", " ")) for t in texts], columns=["lang", "score"])

    wanted = [lang] if isinstance(lang, str) else list(lang)
    out = df.withColumn("_lang", run(F.col(ctx.text_key)))
    keep = F.col("_lang.score") >= min_score
    if any(wanted):
        keep = keep & F.col("_lang.lang").isin(*wanted)
    return out.where(keep).drop("_lang")


#: Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as this be at by from",
    "fr": "le la les des et est dans que pour du une un sur pas au par avec qui",
    "de": "der die das und ist nicht ein eine mit auf für von den zu dem sich auch",
    "es": "el los las y es en que por para una un con no del se como más su",
}


def guess_language(text: str) -> tuple[str, float]:
    ws = text.split()
    hits = {k: sum(w.strip(".,;:!?") in set(v.split()) for w in ws) for k, v in FUNCTION_WORDS.items()}
    best = max(hits, key=hits.get)
    total = sum(hits.values())
    if any("\u4e00" <= c <= "\u9fa5" for c in text) and total == 0:
        return "zh", 1.0
    return (best, hits[best] / total) if total else ("unknown", 0.0)


@register("token_num_filter", "filter", tier="R")
def token_num(df: DataFrame, ctx: Context, hf_tokenizer: str | None = None, min_num: int = 10, max_num: int = sys.maxsize) -> DataFrame:
    """Number of tokens in range. ``hf_tokenizer``: a tokenizer's file; without it, words and punctuation marks count."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        if hf_tokenizer:
            from tokenizers import Tokenizer

            found = Tokenizer.from_file(hf_tokenizer).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return pd.Series([len(x.ids) for x in found])
        return texts.map(lambda t: len(re.findall(r"\w+|[^\w\s]", t or "")))

    return df.withColumn("_tokens", run(F.col(ctx.text_key))).where(F.col("_tokens").between(min_num, max_num)).drop("_tokens")
