"""Main text of web pages by equivalence-class template deduction.

A page is a run of tokens: elements (with their path of tags and classes) and text
blocks (with path and text). For each host, Spark folds each token's occurrence vector
over the host's pages into a 64-bit signature (the xor of a code of page and count), so
that tokens sharing a vector form a class without gathering a host's pages anywhere. A
class is valid if it is found on most of the host's distinct pages and has an element
among its tokens. Pages count as distinct if their main blocks differ. The text tokens of
valid classes are left out of the host's pages, but never inside an article or main
element. Classes are not ordered or nested into a template with slots: deduction ends at
the classes, and on hosts of fewer than PAGES pages there are none. Text inside elements
that are menus, headers, footers, sidebars, notices, adverts, forms or comments (by tag,
role, class or id) is left out everywhere, and if the page has an article or main element
only text inside it counts.

Defined results: a null or empty html gives an empty text; a null url belongs to the
host ""; broken markup is read as far as it goes; repeated rows are treated alike; an
empty table gives an empty result; other columns are ignored. Nothing is capped.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimill.functions.durable import written

from .textnp import tuned

#: A class is valid on this share of a host's distinct pages, and this many.
SUPPORT, PAGES = 0.6, 5
#: Template tokens that tasks may hold in memory; more are joined to the pages.
HELD = 200_000
SALTS = 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<code>script|style)(?=[\s/>])[^>]*>.*?(?:</(?P=code)\s*>|\Z)"
    # closed by itself, closed by an end tag, or else only the tag
    r"|<(?:noscript|template|iframe|svg|textarea|select|object|title)(?=[\s/>])(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"
    r"|<(?P<inert>noscript|template)(?=[\s/>])[^>]*>.*?</(?P=inert)\s*>"
    r"|<(?P<raw>iframe|textarea|select|title)(?=[\s/>])[^>]*>(?:[^<]++|<(?!/?(?:article|main|body|html|(?P=raw))[\s/>]))*+</(?P=raw)\s*>"
    r"|<(?P<nests>svg|object)(?=[\s/>])[^>]*>(?:[^<]++|<(?!/?(?:article|main|body|html)[\s/>]|/(?P=nests)\s*>))*+</(?P=nests)\s*>"
    r"|<(?:noscript|template|iframe|svg|textarea|select|object|title)(?=[\s/>])[^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that never hold main text, and words in class, id or role that say so of any element.
ASIDE = frozenset("nav footer aside form dialog menu button head".split())
SAID = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs masthead "
    "footer sidebar widget cookie cookies consent notice notices gdpr alert popup modal newsletter subscribe subscription signup comment comments commentlist disqus reply replies "
    "respond discussion share sharing social related recommended login search complementary contentinfo toolbar pagination pager".split()
)
REPLIES = frozenset("comment comments commentlist disqus reply replies respond discussion".split())


class _Open:
    __slots__ = ("tag", "path", "out", "main")

    def __init__(self, tag: str, path: int, out: bool, main: bool):
        self.tag, self.path, self.out, self.main = tag, path, out, main


def _code(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))


def tokens(page: str) -> Iterator[tuple[int, str | None, bool, bool]]:
    """(code, text or None for an element, left out, inside an article or main element) in page order."""
    stack = [_Open("", 0, False, False)]
    parts: list[str] = []
    where = stack[0]

    def flush():
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                yield _code(where.path, text), text, where.out, where.main

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            if not parts:
                where = stack[-1]
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br" or tag in ("td", "th"):
            if parts:
                parts.append(" ")
            if tag == "br":
                continue
        block = tag in BLOCKS
        if block:
            yield from flush()
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if not block and parts and stack[i].out != stack[i - 1].out:
                        yield from flush()
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        named = [(k.lower(), (a or b or c).lower()) for k, a, b, c in _ATTR.findall(attrs)] if attrs else []
        said = {w for _, v in named for w in _WORD.findall(v)} if named else frozenset()
        if block and stack[-1].tag == "p":  # a block ends a paragraph, and what was left open in it
            stack.pop()
        elif block:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in BLOCKS:
                    if stack[i].tag == "p" or (tag == "li" and stack[i].tag == "li"):
                        del stack[i:]
                    break
        up = stack[-1]
        replies = bool(said & REPLIES)
        main = up.main or tag in ("article", "main") or "main" in {v for k, v in named if k == "role"}
        enters = main and not up.main and not replies
        out = (up.out and not enters) or tag in ASIDE or (tag == "header" and not up.main) or (bool(said & SAID) and tag not in ("html", "body") and not (enters and not replies))
        if out != up.out and not block:
            yield from flush()
        path = _code(up.path, tag, *(v for k, v in named if k != "id"))
        if tag not in VOID:
            stack.append(_Open(tag, path, out, main))
        yield path, None, out, main
    if at < len(page):
        if not parts:
            where = stack[-1]
        parts.append(page[at:])
    yield from flush()


def extract(page: str | None, template: frozenset | set = frozenset()) -> str:
    """The page's main text, given its host's template."""
    return "\n\n".join(text for code, text, main in _blocks(tokens(page or "")) if main or code not in template)


def _blocks(found) -> list[tuple[int, str, bool]]:
    """The text blocks that can be main text: those in an article or main element, if there are any."""
    own = [(code, text, main) for code, text, out, main in found if text is not None and not out]
    return [x for x in own if x[2]] if any(main for _, _, main in own) else own


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _counted(batches):
    """host, page, code, element, n: a page's tokens; ``page`` names the page's main blocks, so that copies count once, whatever menu or advert they carry."""
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = page or ""
            own: dict[int, list] = {}
            seen = list(tokens(page))
            for code, text, _, _ in seen:
                own.setdefault(code, [text is None, 0])[1] += 1
            uid = _code(*(text for _, text, _ in _blocks(seen)))
            cols[0] += [name] * len(own)
            cols[1] += [uid] * len(own)
            cols[2] += own.keys()
            cols[3] += [x[0] for x in own.values()]
            cols[4] += [x[1] for x in own.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[1:3]), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.int32())],
            ["host", "page", "code", "element", "n"],
        )


def templates(pages: DataFrame) -> DataFrame:
    """host, code, element: the tokens of all hosts' valid classes, not nested. ``pages`` has host and html."""
    rows = pages.mapInArrow(_counted, "host string, page long, code long, element boolean, n int")
    once = rows.groupBy("host", "page", "code").agg(F.first("element").alias("element"), F.max("n").alias("n"))
    vectors = once.groupBy("host", "code").agg(
        F.first("element").alias("element"), F.count(F.lit(1)).alias("support"), F.bit_xor(F.xxhash64("page", "n")).alias("vector")
    )
    total = once.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= PAGES)
    # only tokens of enough support can be in a valid class, so few rows are left for each host
    often = vectors.join(total, "host").where(F.col("support") >= SUPPORT * F.col("pages"))
    often = written(often.select("host", "code", "element", "vector"), "tokens")
    valid = often.groupBy("host", "vector").agg(F.max("element").alias("framed")).where("framed").select("host", "vector")
    return often.join(valid, ["host", "vector"]).select("host", "code", "element")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    tuned(spark)
    kind = dict(pages.dtypes)[page_id]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("host"))
    found = written(templates(rows.select("host", "html")).where("not element").select("host", "code"), "template")  # what is left out is text
    schema = f"page_id {kind}, url string, text string"

    def texts(batch, of):
        out = [extract(p, of(i, h)) for i, (p, h) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    none: frozenset = frozenset()
    if found.limit(HELD + 1).count() <= HELD:
        held: dict[str, set] = {}
        for r in found.collect():
            held.setdefault(r["host"], set()).add(r["code"] % 2**64)

        def run(batches):
            for batch in batches:
                yield texts(batch, lambda i, h: held.get(h, none))

        out = rows.mapInArrow(run, schema)
    else:  # a host's template goes to each of the shards that its pages are dealt over
        sets = found.groupBy("host").agg(F.collect_list("code").alias("codes")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

        def run(batches):
            for batch in batches:
                codes = batch.column(4)
                yield texts(batch, lambda i, h: {c % 2**64 for c in codes[i].as_py() or ()})  # noqa: B023

        out = salted.join(sets, ["host", "salt"], "left").select("page_id", "url", "html", "host", "codes").mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
