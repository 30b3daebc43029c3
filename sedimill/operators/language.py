"""Operators that ask a language model or an augmenter. A backend ``messages -> str`` (or ``text -> list``) is injected."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .media import _declare, need
from .registry import Context

_API = {"model_url": "", "model_name": "", "auth_token": ""}


def ask(df: DataFrame, ctx: Context, name: str, prompt, parse, kind: str, out: str, tries: int = 3) -> DataFrame:
    """``df`` with ``out`` = parse(text, answer) of a model asked once a row, again on errors; null after ``tries``."""
    client = need(ctx, name)

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            for _ in range(tries):
                try:
                    return parse(text or "", client(prompt(text or "")))
                except Exception:  # noqa: S112  (the service may answer at the next try)
                    continue
            return None

        return texts.map(one)

    return df.withColumn(out, run(F.col(ctx.text_key)))


def _say(system: str, user: str) -> list[dict]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def _rewriter(name: str, params: dict, system: str, parse=lambda text, answer: answer, out: str | None = None) -> None:
    def fn(df, ctx, p):
        """The model's answer in place of the text (or in a column of its own); on errors the text stays."""
        told = p.get("system_prompt") or system
        found = ask(df, ctx, name, lambda t: _say(told, t), parse, "string", "_answer")
        return found.withColumn(out or ctx.text_key, F.coalesce("_answer", ctx.text_key) if not out else F.col("_answer")).drop("_answer")

    _declare(name, "mapper", params, fn)


def _pairs(text: str, answer: str, pattern: str | None = None) -> str:
    """Question and answer pairs of an answer as JSON lines of chat messages."""
    found = re.findall(pattern or r"Human:(.*?)\s*Assistant:(.*?)(?=\s*Human:|\Z)", answer, re.S)
    return "\n".join(json.dumps({"messages": [{"role": "user", "content": q.strip()}, {"role": "assistant", "content": a.strip()}]}, ensure_ascii=False) for q, a in found)


def _extract_qa(df: DataFrame, ctx: Context, p: dict) -> DataFrame:
    """Question and answer pairs that the model finds in the text, as chat messages in JSON."""
    told = "Write questions that the text answers, and the answers, as lines 'Human: ...' and 'Assistant: ...'."
    found = ask(df, ctx, "extract_qa_mapper", lambda t: _say(told, t), lambda t, a: _pairs(t, a, p["pattern"]), "string", "_answer")
    return found.withColumn(ctx.text_key, F.coalesce("_answer", ctx.text_key)).drop("_answer")


_declare("extract_qa_mapper", "mapper", {**_API, "pattern": None, "qa_format": "chatml"}, _extract_qa)
_rewriter("generate_code_qa_pair_mapper", {**_API, "system_prompt": None, "sampling_params": None}, "Write the request that this code would be the answer to.")
_rewriter("optimize_instruction_mapper", dict(_API), "Make this instruction more detailed and precise without changing what it asks for.")
_rewriter("make_cosmopedia_mapper", {}, "Write a tutorial on the topic of this extract.", out="data")


def rouge_l(a: list[str], b: list[str]) -> float:
    """F1 of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0


def _instructions(df: DataFrame, ctx: Context, p: dict) -> DataFrame:
    """An instruction in the manner of seeds; kept unless it is too like one of them."""
    seeds = p["seed_file"] if isinstance(p["seed_file"], (list, tuple)) else [x for x in open(p["seed_file"], encoding="utf-8").read().split("\n") if x]
    shown = "\n".join(seeds[: p["instruct_num"]])
    bar = p["similarity_threshold"]

    def parse(text, answer):
        return answer if max((rouge_l(answer.split(), s.split()) for s in seeds), default=0) <= bar else ""

    found = ask(df, ctx, "generate_instruction_mapper", lambda t: _say("Write one more like these:\n" + shown, t), parse, "string", "_answer")
    return found.where("_answer IS NOT NULL AND _answer <> ''").withColumn(ctx.text_key, F.col("_answer")).drop("_answer")


_declare("generate_instruction_mapper", "mapper", {
    "hf_model": "", "seed_file": (), "instruct_num": 3, "trust_remote_code": False, "similarity_threshold": 0.7, "prompt_template": None, "qa_pair_template": None, "example_template": None,
    "qa_extraction_pattern": None, "enable_vllm": True, "tensor_parallel_size": None, "max_model_len": None, "max_num_seqs": 256, "sampling_params": None,
}, _instructions)


def _magpie(df: DataFrame, ctx: Context, p: dict) -> DataFrame:
    """Instruction and response pairs made from nothing but a category: one call for each of the backend's ``categories``; the input is ignored."""
    client = need(ctx, "pipeline_magpie_zh_mapper")
    spark = df.sparkSession
    topics = spark.createDataFrame([(c,) for c in getattr(client, "categories", ["general"])], "text string")
    asked = ask(topics, Context(backends=ctx.backends), "pipeline_magpie_zh_mapper", lambda t: _say(t, "Write an instruction, a line '---', and the response."), lambda t, a: a, "string", "_answer")
    parts = F.split("_answer", "\n---\n", 2)
    return asked.where(F.size(parts) == 2).select("text", parts[0].alias("instruction"), parts[1].alias("response"))


_declare("pipeline_magpie_zh_mapper", "mapper", dict(_API), _magpie)


def _rated(name: str, params: dict, system: str, kind: str, keep) -> None:
    def fn(df, ctx, p):
        """Rows whose rating by the model meets the bound."""
        if kind == "double":
            def parse(text, answer):
                return float(re.search(r"-?\d+(?:\.\d+)?", answer)[0])
        else:
            def parse(text, answer):
                return [float(x) for x in json.loads(answer)]
        found = ask(df, ctx, name, lambda t: _say(system, t), parse, kind, "_rating")
        return found.where(keep(p)).drop("_rating")

    _declare(name, "filter", params, fn)


_SERVICE = {"base_url": "", "model": "", "api_key": ""}
_rated("perplexity_filter", {**_SERVICE, "max_ppl": 1500}, "Estimate this text's perplexity; answer with a number.", "double", lambda p: F.coalesce("_rating", F.lit(1500.0)) <= p["max_ppl"])
_rated("text_action_filter", {**_SERVICE, "min_action_num": 1}, "Count the verbs of this text; answer with a number.", "double", lambda p: F.coalesce("_rating", F.lit(0.0)) >= p["min_action_num"])
_rated(
    "text_entity_dependency_filter", {**_SERVICE, "min_dependency_num": 1, "any_or_all": "all"}, "Count the dependency edges of each entity of this text; answer with a JSON list of numbers.", "array<double>",
    lambda p: (F.size("_rating") > 0) & (F.exists if p["any_or_all"] == "any" else F.forall)("_rating", lambda n: n >= p["min_dependency_num"]),
)


def _augmented(name: str, methods: dict) -> None:
    def fn(df, ctx, p):
        """1 to N: the original (if kept) and augmented texts. The backend maps (text, method, seed) to a text."""
        change = need(ctx, name)
        on = [k for k in methods if p[k]]
        sequential, times, keep = p["sequential"], p["aug_num"], p["keep_original_sample"]

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            def one(text):
                out = [text] * keep
                if text is None or not on:
                    return [text]
                for i in range(times):
                    if sequential:
                        t = text
                        for m in on:
                            t = change(t, m, i)
                        out.append(t)
                    else:
                        out += [change(text, m, i) for m in on]
                return out

            return texts.map(one)

        return df.withColumn("_made", run(F.col(ctx.text_key))).withColumn(ctx.text_key, F.explode("_made")).drop("_made")

    _declare(name, "mapper", {"sequential": False, "aug_num": 1, "keep_original_sample": True, **methods}, fn)


_augmented("nlpaug_en_mapper", dict.fromkeys(("delete_random_word", "swap_random_word", "spelling_error_word", "split_random_word", "keyboard_error_char", "ocr_error_char", "delete_random_char", "swap_random_char", "insert_random_char"), False))
_augmented("nlpcda_zh_mapper", dict.fromkeys(("replace_similar_word", "replace_homophone_char", "delete_random_char", "swap_random_char", "replace_equivalent_num"), False))


def _chinese(df: DataFrame, ctx: Context, p: dict) -> DataFrame:
    """Characters converted between scripts; the backend is a table ``{from: to}`` or a function of a text and the mode."""
    table = need(ctx, "chinese_convert_mapper")
    if isinstance(table, dict):
        single = {k: v for k, v in table.items() if len(k) == len(v) == 1}
        c = F.col(ctx.text_key)
        for k, v in sorted(table.items(), key=lambda x: -len(x[0])):
            if k not in single:
                c = F.replace(c, F.lit(k), F.lit(v))
        return df.withColumn(ctx.text_key, F.translate(c, "".join(single), "".join(single.values())))
    mode = p["mode"]
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else table(t, mode))

    return df.withColumn(ctx.text_key, run(F.col(ctx.text_key)))


_declare("chinese_convert_mapper", "mapper", {"mode": "s2t"}, _chinese)
