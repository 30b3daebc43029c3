"""Text mappers. Native ones map a text Column to a Column; the rest are plain Python functions run in Arrow batches."""

from __future__ import annotations

import re
import sys
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimill.functions import text as T

from .registry import Context, register

# Default patterns and the punctuation table.
EMAIL = r"[A-Za-z0-9.\-+_]+@[a-z0-9.\-+_]+\.[a-z]+"
IP = (
    r"(?:(?:1[0-9][0-9]\.)|(?:2[0-4][0-9]\.)|(?:25[0-5]\.)|(?:[1-9][0-9]\.)|(?:[0-9]\.)){3}"
    r"(?:(?:1[0-9][0-9])|(?:2[0-4][0-9])|(?:25[0-5])|(?:[1-9][0-9])|(?:[0-9]))|([\da-fA-F]{1,4}:){7}[\da-fA-F]{1,4}"
)
LINKS = (
    r"(?i)\b((?:[a-z][\w-]+:(?:\/{1,3}|[a-z0-9%])|www\d{0,3}[.]|[a-z0-9.\-]+[.][a-z]{2,4}\/)"
    r"(?:[^\s()<>]+|\(([^\s()<>]+|(\([^\s()<>]+\)))*\))+"
    r"(?:\(([^\s()<>]+|(\([^\s()<>]+\)))*\)|[^\s`!()\[\]{};:'\".,<>?«»“”‘’]))"
)
PUNCTUATION = {
    "，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "１": '"', "」": '"', "「": '"', "《": '"', "》": '"', "´": "'", "∶": ":", "：": ":",
    "？": "?", "！": "!", "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ", "～": "~", "’": "'", "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-",
}
BIBLIOGRAPHY = r"(\\appendix|\\begin\{references\}|\\begin\{REFERENCES\}|\\begin\{thebibliography\}|\\bibliography\{.*\}).*$"
# between paragraph and subparagraph there is no alternative: the first counts only right before the second
HEADER = (
    r"^(.*?)("
    r"\\\bchapter\b\*?(?:\[(.*?)\])?\{(.*?)\}|"
    r"\\\bpart\b\*?(?:\[(.*?)\])?\{(.*?)\}|"
    r"\\\bsection\b\*?(?:\[(.*?)\])?\{(.*?)\}|"
    r"\\\bsubsection\b\*?(?:\[(.*?)\])?\{(.*?)\}|"
    r"\\\bsubsubsection\b\*?(?:\[(.*?)\])?\{(.*?)\}|"
    r"\\\bparagraph\b\*?(?:\[(.*?)\])?\{(.*?)\}"
    r"\\\bsubparagraph\b\*?(?:\[(.*?)\])?\{(.*?)\}"
    r")"
)
SYMBOLS = "◆●■►▼▲▴∆▻▷❖♡□"
SUBSTRINGS = ["http", "www", ".com", "href", "//"]


def _replaced(c: Column, pattern: str, repl: str = "", flags: str = "(?s)") -> Column:
    return F.regexp_replace(c, F.lit(flags + T.unwrapped(pattern)), F.lit(T.java_replacement(repl)))


@register("clean_email_mapper", "mapper", form="column")
def clean_email(c: Column, pattern: str | None = None, repl: str = "") -> Column:
    """E-mail addresses replaced. Texts without an @ aren't looked through by the fixed pattern."""
    return _replaced(c, pattern, repl) if pattern else F.when(c.contains("@"), _replaced(c, EMAIL, repl)).otherwise(c)


@register("clean_ip_mapper", "mapper", form="column")
def clean_ip(c: Column, pattern: str | None = None, repl: str = "") -> Column:
    """IPv4 and full-form IPv6 addresses replaced; there are no word boundaries, so 1.2.3.256 loses 1.2.3.25."""
    return _replaced(c, pattern or IP, repl)


@register("clean_links_mapper", "mapper", form="column")
def clean_links(c: Column, pattern: str | None = None, repl: str = "") -> Column:
    """Links and bare domains with a path replaced."""
    return _replaced(c, pattern or LINKS, repl)


@register("clean_copyright_mapper", "mapper", form="column")
def clean_copyright(c: Column, matching_rules: list | None = None) -> Column:
    """Each rule's matches become one space; three or more line feeds become two; stripped. Rules that don't compile are passed over."""
    for rule in matching_rules or []:
        rule = rule.replace("\\\\", "\\")
        try:
            re.compile(rule)
        except re.error:
            continue
        c = F.regexp_replace(c, rule, " ")
    return T.strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


@register("replace_content_mapper", "mapper", form="column")
def replace_content(c: Column, pattern: str | list | None = None, repl: str | list = "") -> Column:
    """User patterns replaced one after the other; a list of replacements must be as long as that of patterns."""
    if pattern is None:
        return c
    patterns = [pattern] if isinstance(pattern, str) else pattern
    repls = [repl] * len(patterns) if isinstance(repl, str) else repl
    if len(repls) != len(patterns):
        raise ValueError("pattern and repl differ in length")
    for p, r in zip(patterns, repls, strict=True):
        c = _replaced(c, p, r)
    return c


@register("punctuation_normalization_mapper", "mapper", form="column")
def punctuation_normalization(c: Column) -> Column:
    """Typographic and CJK punctuation to ASCII."""
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in PUNCTUATION.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


@register("whitespace_normalization_mapper", "mapper", form="column")
def whitespace_normalization(c: Column) -> Column:
    """Stripped, and every kind of white space but line ends becomes a space."""
    return F.translate(T.strip(c), T.WHITESPACES, " " * len(T.WHITESPACES))


@register("remove_bibliography_mapper", "mapper", form="column")
def remove_bibliography(c: Column) -> Column:
    """All from the first LaTeX appendix or bibliography on is removed."""
    return F.regexp_replace(c, "(?s)" + BIBLIOGRAPHY, "")


@register("remove_comments_mapper", "mapper", form="column")
def remove_comments(c: Column, doc_type: str = "tex", inline: bool = True, multiline: bool = True) -> Column:
    """LaTeX comments removed; an inline one takes the character before the percent sign along."""
    if doc_type != "tex":
        raise ValueError("only tex documents are known")
    if inline:
        c = F.regexp_replace(c, r"(?dm)[^\\]%.+$", "")
    if multiline:
        c = F.regexp_replace(c, r"(?dm)^%.*\n?", "")
    return c


@register("remove_header_mapper", "mapper", form="column")
def remove_header(c: Column, drop_no_head: bool = True) -> Column:
    """Text before the first LaTeX sectioning command removed; a text without one is emptied or left."""
    return F.when(c.rlike("(?s)" + HEADER), F.regexp_replace(c, "(?s)" + HEADER, "$2")).when(c.isNotNull(), F.lit("") if drop_no_head else c)


def _by_words(c: Column, keep) -> Column:
    """Words kept or not, within lines and tabs; what is left empty goes with its separator."""
    def part(p):
        return F.array_join(F.filter(F.split(p, " "), lambda w: (w != "") & keep(w)), " ")

    def line(s):
        return F.array_join(F.filter(F.transform(F.split(s, "\t"), part), lambda p: p != ""), "\t")

    return F.array_join(F.filter(F.transform(F.split(c, "\n"), line), lambda s: s != ""), "\n")


@register("remove_long_words_mapper", "mapper", form="column")
def remove_long_words(c: Column, min_len: int = 1, max_len: int = sys.maxsize) -> Column:
    """Words whose length, with or without special characters at the ends, is out of range are removed."""
    inside = lambda n: (n >= min_len) & (n <= max_len)
    return _by_words(c, lambda w: inside(F.length(w)) | inside(F.length(T.strip_special(w))))


@register("remove_words_with_incorrect_substrings_mapper", "mapper", form="column")
def remove_words_with_incorrect_substrings(c: Column, lang: str = "en", tokenization: bool = False, substrings: list | None = None) -> Column:
    """Words that contain one of the substrings are removed."""
    def keep(w):
        bare = T.strip_special(w)
        out = F.lit(True)
        for s in SUBSTRINGS if substrings is None else substrings:
            out = out & ~bare.contains(s)
        return out

    return _by_words(c, keep)


@register("remove_non_chinese_character_mapper", "mapper", form="column")
def remove_non_chinese_character(c: Column, keep_alphabet: bool = True, keep_number: bool = True, keep_punc: bool = True) -> Column:
    """All but Chinese characters and the kept kinds is removed."""
    inside = "\u4e00-\u9fa5" + "A-Za-z" * keep_alphabet + "0-9" * keep_number
    if keep_punc:
        inside += ".， ,\\-。%《*》/•、\\&＆(—)（+）：？!！“”·"
    return F.regexp_replace(c, f"[^{inside}]", "")


@register("remove_specific_chars_mapper", "mapper", form="column")
def remove_specific_chars(c: Column, chars_to_remove: str | list = SYMBOLS) -> Column:
    """The listed characters and the vertical bar are removed."""
    return F.translate(c, "".join(chars_to_remove) + "|", "") if chars_to_remove else c


@register("remove_table_text_mapper", "mapper", tier="R", form="column")
def remove_table_text(c: Column, min_col: int = 2, max_col: int = 20) -> Column:
    """Two or more consecutive lines of equally many columns are removed."""
    for n in range(min_col - 1, max_col):
        c = F.regexp_replace(c, r"(?U)(?<=\n)((\S+?)([ |\t](\S+?)){%d}\n+){2,}" % n, "")
    return c


@register("expand_macro_mapper", "mapper", tier="R", form="python")
def expand_macro(text: str) -> str:
    """LaTeX macros without arguments, defined by newcommand or def, written out."""
    macros: dict[str, str] = {}
    for pattern in (r"\\\bnewcommand\b\*?\{(\\[a-zA-Z0-9]+?)\}\{(.*?)\}$", r"\\def\s*(\\[a-zA-Z0-9]+?)\s*\{(.*?)\}$"):
        macros.update(re.findall(pattern, text, re.M))
    for name, value in macros.items():
        text = re.sub(re.escape(name) + r"([^a-zA-Z0-9])", lambda m, v=value: v + m[1], text)
    return text


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


@register("clean_html_mapper", "mapper", tier="R", form="python")
def clean_html(text: str) -> str:
    """Text of an HTML page; list items start with an asterisk on a new line."""
    for tag, by in (("<li>", "\n*"), ("</li>", ""), ("<ol>", "\n*"), ("</ol>", "")):
        text = text.replace(tag, by)
    parser = _Text()
    parser.feed(text)
    parser.close()
    return "".join(parser.out)


@register("fix_unicode_mapper", "mapper", tier="R", form="python")
def fix_unicode(text: str, normalization: str | None = None) -> str:
    """Text repaired (if ftfy is installed) and normalised, NFC by default."""
    form = (normalization or "NFC").upper()
    if form not in ("NFC", "NFKC", "NFD", "NFKD"):
        raise ValueError(f"no normal form {form}")
    try:
        import ftfy
    except ImportError:
        return unicodedata.normalize(form, text)
    return ftfy.fix_text(text, normalization=form)


#: Where a sentence ends.
SENTENCE_ENDS = (r"([.。！!？\?])([^’”])", r"(\.{6})([^’”])", r"(\…{2})([^’”])", r"([.。！!？\?{6}…{2}][’”])([^’”])")


def _sentences(line: str) -> list[str]:
    for pattern in SENTENCE_ENDS:
        line = re.sub(pattern, r"\1\n\2", line)
    return line.split("\n")


@register("remove_repeat_sentences_mapper", "mapper", tier="R", form="python")
def remove_repeat_sentences(text: str, lowercase: bool = False, ignore_special_character: bool = True, min_repeat_sentence_length: int = 2) -> str:
    """The first of equal sentences is kept; short ones always."""
    seen, out = set(), []
    for line in text.split("\n"):
        kept = ""
        for sentence in _sentences(line) if line else ():
            key = sentence.strip()
            key = key.lower() if lowercase else key
            if ignore_special_character:
                key = re.sub(r"[^a-zA-Z0-9\u4e00-\u9fa5\n\t ]", "", key)
            if len(key) < min_repeat_sentence_length or key not in seen:
                kept += sentence
                if len(key) >= min_repeat_sentence_length:
                    seen.add(key)
        out.append(kept)
    return "\n".join(out)


@register("sentence_split_mapper", "mapper", tier="R", form="python")
def sentence_split(text: str, lang: str = "en") -> str:
    """One sentence a line: cut after end marks before a capital, digit or quote, but not after common abbreviations."""
    cut = re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+(?=[\"'“‘(\[]?[A-ZÀ-ÞА-Я0-9\u4e00-\u9fa5])|(?<=[。！？])(?=\S)")
    out, start = [], 0
    for m in cut.finditer(text):
        piece = text[start : m.end()].strip()
        if re.search(r"\b(?:Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|vs|etc|e\.g|i\.e|No|Fig|Inc|Ltd|z\.B|M|Mme|Sra?)\.$", piece):
            continue
        out.append(piece)
        start = m.end()
    out.append(text[start:].strip())
    return "\n".join(x for x in out if x)


def _exploded(df: DataFrame, ctx: Context, fn) -> DataFrame:
    """1 to N: a function from a text to its chunks; a text without chunks gives no row."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fn(t) if t else [])

    return df.withColumn("_chunks", run(F.col(f"`{ctx.text_key}`"))).withColumn(ctx.text_key, F.explode("_chunks")).drop("_chunks")


def _spans(text: str, tokenizer=None) -> list[tuple[int, int]]:
    return tokenizer(text) if tokenizer else [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]


@register("md_to_jsonl_chunk_mapper", "mapper", tier="R")
def token_chunks(df: DataFrame, ctx: Context, hf_tokenizer: str | None = None, chunk_size: int = 100, overlap: int = 0) -> DataFrame:
    """Windows of ``chunk_size`` tokens, each starting ``chunk_size - overlap`` after the last. A backend gives the tokens' character spans."""
    tokenizer = ctx.backends.get("md_to_jsonl_chunk_mapper")
    step = chunk_size - (overlap if overlap < chunk_size else 0)

    def cut(text: str) -> list[str]:
        spans = _spans(text, tokenizer) if text.strip() else []
        return [text[spans[i][0] : spans[min(i + chunk_size, len(spans)) - 1][1]] for i in range(0, len(spans), step)]

    return _exploded(df, ctx, cut)


@register("md_to_jsonl_sentence_chunk_mapper", "mapper", tier="R")
def sentence_chunks(df: DataFrame, ctx: Context, hf_tokenizer: str | None = None, chunk_size: int = 512, chunk_overlap: int = 0, min_sentences_per_chunk: int = 1) -> DataFrame:
    """Whole sentences packed up to ``chunk_size`` tokens; the next chunk repeats sentences of up to ``chunk_overlap`` tokens."""
    tokenizer = ctx.backends.get("md_to_jsonl_sentence_chunk_mapper")

    def cut(text: str) -> list[str]:
        parts = sentence_split(text).split("\n") if text.strip() else []
        sizes = [len(_spans(p, tokenizer)) for p in parts]
        out, start = [], 0
        while start < len(parts):
            end, total = start, 0
            while end < len(parts) and (total + sizes[end] <= chunk_size or end - start < min_sentences_per_chunk):
                total += sizes[end]
                end += 1
            end = max(end, start + 1)
            out.append(" ".join(parts[start:end]))
            if end == len(parts):
                break
            back, shared = end, 0
            while back > start + 1 and shared + sizes[back - 1] <= chunk_overlap:
                back -= 1
                shared += sizes[back]
            start = back
        return out

    return _exploded(df, ctx, cut)
