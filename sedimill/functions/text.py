"""Column builders for text: Unicode-aware where the built-in functions are ASCII-only."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, line ends, and what counts as a special character (invisible ones are escaped).
STRIP_CLASS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
WHITESPACES = " \t\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\xa0\u202f\u205f\u3000\u200b\u200c\u200d\u2060\ufffc\x84"
OTHER_SPECIAL = (
    "\x92\u2009\x93\x97\u200a\x9d\x99\u202f\x96\u2005\x95\x91\x9c\u3000\u2002 \u2008\x98\x81\u2003\x82￼\x83\x84’“”–ー一▬…✦�\xad£\u200b•€«»°·═×士＾˘⇓↓↑←→（）§″′´¿−±∈"
    "\ufeff¢ø‚„½¼¾¹²³―⁃，ˌ¸‹›ʺˈʻ¦‐⠀‰\x85‑≤≥‖◆●■►▼▲▴∆▻¡★☆✱ːº。¯˜¥ɪ≈†上ン：∼⁄・♡✓⊕․．"
    "⋅÷１‟；،、¨ाাी्े◦˚゜ʼ≖¤ッツシ℃√！【】‿∞➤～πه۩☛₨➩☻๑٪♥ıॽ《‘©﴿٬？▷Г♫∟™ª₪®「—❖」﴾》"
)
# Emoji of a single code point, as ranges.
EMOJI_RANGES = ((0x203C, 0x203C), (0x2049, 0x2049), (0x231A, 0x231B), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x2600, 0x27BF), (0x2B05, 0x2B07), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x1F004, 0x1F004), (0x1F0CF, 0x1F0CF), (0x1F170, 0x1F251), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F7E0, 0x1F7EB), (0x1F90C, 0x1FAFF))


def special_class() -> str:
    """The special characters as the inside of a regular expression's class, in Java's and RE2's common syntax."""
    points = sorted({ord(c) for c in string.punctuation + string.digits + string.whitespace + OTHER_SPECIAL})
    return "".join(f"\\x{{{p:x}}}" for p in points) + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in EMOJI_RANGES)


SPECIAL = special_class()
#: All of them one after the other, for ``translate``.
SPECIAL_CHARS = "".join(sorted(set(string.punctuation + string.digits + string.whitespace + OTHER_SPECIAL) | {chr(p) for a, b in EMOJI_RANGES for p in range(a, b + 1)}))
#: The same for one character in Java: common letters are told apart before the long class is looked through.
ONE_SPECIAL = f"(?:(?![a-zA-Z\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f9}}-\\x{{ff}}])[{SPECIAL}])"


def is_special(char: str) -> bool:
    p = ord(char)
    return char in string.punctuation + string.digits + string.whitespace + OTHER_SPECIAL or any(a <= p <= b for a, b in EMOJI_RANGES)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{STRIP_CLASS}+|{STRIP_CLASS}+$", "")


def strip_special(c: Column) -> Column:
    return F.regexp_replace(c, f"^{ONE_SPECIAL}+|{ONE_SPECIAL}+\\z", "")


def java_replacement(repl: str) -> str:
    """A Python replacement template for Java: back references and dollar signs."""
    out = repl.replace("$", "\\$")
    return re.sub(r"\\g<(\d+)>|\\(\d)", lambda m: f"${m[1] or m[2]}", out)


def unwrapped(pattern: str) -> str:
    """A pattern that was written as a raw string literal, without the literal's quotes."""
    if len(pattern) > 2 and pattern[:2] in ("r'", 'r"') and pattern[-1] == pattern[1]:
        return pattern[2:-1]
    return pattern


def words(c: Column) -> Column:
    """Non-empty words between spaces, tabs and line feeds."""
    return F.filter(F.split(c, "[ \n\t]"), lambda w: w != "")


def without_special(c: Column) -> Column:
    """The text without its special characters: each character is looked up once, which no regular expression does."""
    return F.translate(c, SPECIAL_CHARS, "")


def refined_words(c: Column, lower: bool = True) -> Column:
    """Words in lower case without special characters at their ends; only words that begin or end with one are looked into."""
    def bare(w: Column) -> Column:
        ends = F.concat(F.substring(w, 1, 1), F.substring(w, -1, 1))
        return F.when(F.length(without_special(ends)) == 2, w).otherwise(strip_special(w))

    return F.filter(F.transform(words(F.lower(c) if lower else c), bare), lambda w: w != "")


def augmented(ws: Column, sizes: list[int], joiner: str) -> Column:
    """Words and their groups of the given sizes."""

    def groups(n: int) -> Column:
        """The lambda has one parameter: a second one, even with a default, would get the index."""
        at = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(ws, i, n), joiner))

    return F.flatten(F.array(ws, *map(groups, sizes)))


def lines(c: Column) -> Column:
    """Lines as Python's splitlines gives them: a line end at the very end makes no further line."""
    found = F.split(F.regexp_replace(c, f"({LINE_END})\\z", ""), LINE_END)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(found)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def repeated_share(grams: Column, top_root: bool) -> Column:
    """Share of repeated n-grams. ``top_root``: only the most frequent, as many as the root of their number; else all that repeat."""
    counts = F.transform(F.array_distinct(grams), lambda g: F.size(F.filter(grams, lambda x: x == g)))
    if not top_root:
        return ratio(F.aggregate(counts, F.lit(0), lambda s, n: s + F.when(n > 1, n).otherwise(0)), F.size(grams))
    order = F.sort_array(counts, asc=False)
    take = F.least(F.floor(F.sqrt(F.size(counts))).cast("int"), F.size(F.filter(counts, lambda n: n > 1)))
    return ratio(F.aggregate(F.slice(order, F.lit(1), take), F.lit(0), lambda s, n: s + n), F.size(grams))
