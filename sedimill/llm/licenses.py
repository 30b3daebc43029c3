"""Licence scan with a trained paragraph classifier, in DataFrame functions only.

Each line is a paragraph, and so is each line in which a template can start (it holds a
telling word or pair, or ends with the words of a template before its first one) with the
words that follow it up to the next blank line, as many as the longest template has, so
that a notice wrapped over lines is read as one. Paragraphs become word 1- to 3-grams; an
n-gram that the training never saw weighs nothing, and one without a telling word or pair
of a template never weighs in favour of a family. So what holds neither is unknown for
certain, and only the others are scored. A wrapped notice is given at the line it starts in, once, and only if no single
line of it is confirmed as the same family. Then a multinomial logistic regression gives each licence family and
the class "unknown" a probability. The weights are trained on the driver from phrases
written out from the families' templates and from other sentences (a few thousand
paragraphs, whatever the corpus); the temperature and the least probability are
calibrated on paragraphs that weren't trained on, so that what the classifier isn't sure
of stays unknown. A prediction is confirmed if the paragraph holds the words of one of
the family's templates.

Defined results: a null or empty text has no finding; a licence text repeated in several
paragraphs or rows is found each time; an empty table gives an empty result; other
columns are ignored; whole texts are read.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimill.functions.durable import written

#: Phrases by licence family. The first word group of each entry is what a template comparison asks for.
FAMILIES = {
    "MIT": ["mit license", "the mit license mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "expat license", "spdx license identifier mit"],
    "Apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache software license version 2.0", "spdx license identifier apache 2.0", "http www.apache.org licenses license 2.0"],
    "GPL": ["gnu general public license", "gnu gpl", "gpl version 3", "gplv3", "gplv2", "spdx license identifier gpl 3.0 or later"],
    "LGPL": ["gnu lesser general public license", "gnu library general public license", "lgpl version 3", "lgplv3", "spdx license identifier lgpl 2.1"],
    "AGPL": ["gnu affero general public license", "agpl version 3", "agplv3", "spdx license identifier agpl 3.0"],
    "BSD": ["bsd license", "3 clause bsd license", "bsd 2 clause license", "redistribution and use in source and binary forms with or without modification are permitted", "spdx license identifier bsd 3 clause"],
    "MPL": ["mozilla public license", "mpl 2.0", "spdx license identifier mpl 2.0"],
    "CC-BY": ["cc by 4.0", "creative commons attribution 4.0 international license", "creative commons attribution license", "cc by 3.0"],
    "CC-BY-SA": ["cc by sa 4.0", "creative commons attribution sharealike 4.0 international license", "creative commons attribution sharealike license"],
    "CC-BY-NC": ["cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license", "cc by nc sa 4.0", "cc by nc nd 4.0", "creative commons attribution noncommercial license"],
    "CC0": ["cc0 1.0 universal", "cc0 public domain dedication", "dedicated to the public domain", "the unlicense", "released into the public domain"],
    "ISC": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "Proprietary": ["all rights reserved", "proprietary and confidential", "may not be reproduced without permission", "unauthorized copying of this file is prohibited"],
}
UNKNOWN = "unknown"
ODD = "\x00"
#: Share of wrong families among those given to paragraphs kept out of the training; the least probability follows from it.
WRONG = 0.01
_LEADS = [
    "", "licensed under the", "released under the", "this work is licensed under the", "distributed under the terms of the", "this file is licensed under the", "available under the",
    "this project is licensed under the", "code is covered by the", "published under a", "see the license file for details", "copyright 2019 the authors", "license", "this software is released under",
]
_TAILS = ["", "version 2", "version 3", "or later", "see license for details", "and may be used freely", "terms", "for more information", "copyright holders", "with attribution", "as published by the foundation"]
_OTHERS = [
    "the driver lost his license last year", "she got a license to practise medicine", "licensed physicians only", "the fishing license costs ten euros", "a licensed electrician must do the work",
    "copyright law is complicated", "the copyright office moved", "public domain characters in film", "permission was not granted to enter", "the warranty covers two years", "no warranty is given on used cars",
    "the apache helicopter landed", "apache people of the southwest", "general public transport", "the general public was invited", "mozilla released a new browser", "creative work in common rooms", "rights of the reserved seats",
    "redistribution of wealth", "a bsd conference", "he studied at mit", "the mit campus is in cambridge", "license plate number", "liquor license hearing", "the license fee was raised", "under the terms of the agreement", "licence renewal office",
]

#: Template words that say nothing by themselves; two of them in a template's order do.
_PLAIN = frozenset("the is of to any a this or and in with without are by for all may not be use free person version source general public file into later copy forms under 1.0 2 2.0 2.1 3 3.0 4.0 released software http modify charge purpose international universal library".split())
_TEMPLATES = [p.split() for phrases in FAMILIES.values() for p in phrases]
#: Words after a line that a template starting in it can reach.
REACH = max(map(len, _TEMPLATES)) - 1


#: Short names that count as a notice only after a lead such as "released under"; no template, so they stay unconfirmed.
SHORT = {
    "MIT": ["mit"], "Apache-2.0": ["apache 2.0"], "GPL": ["gpl", "gpl 3.0"], "LGPL": ["lgpl", "lgpl 2.1"], "AGPL": ["agpl", "agpl 3.0"], "BSD": ["bsd", "bsd 3 clause"],
    "MPL": ["mpl"], "CC-BY": ["cc by"], "CC-BY-SA": ["cc by sa"], "CC-BY-NC": ["cc by nc"], "CC0": ["cc0"], "ISC": ["isc"], "Proprietary": ["proprietary"],
}

#: Telling words that are also words or syllables of other languages; they say something only beside their neighbours in a template or after a lead.
_SHARED = frozenset("mit isc cc nc nd sa".split())
_TELLING = {w for t in _TEMPLATES for w in t} - _PLAIN - _SHARED
_PAIRS = {p for t in _TEMPLATES for p in zip(t, t[1:], strict=False) if _SHARED & set(p)}
_PAIRS |= {(lead.split()[-1], short.split()[0]) for lead in _LEADS if lead for shorts in SHORT.values() for short in shorts if short.split()[0] in _SHARED}


def telling(words: list[str]) -> bool:
    """Whether a run of words holds a telling word or pair. Without one, no weight of the model is in favour of a family."""
    return not _TELLING.isdisjoint(words) or not _PAIRS.isdisjoint(zip(words, words[1:], strict=False))


def _run(words: tuple[str, ...] | list[str]) -> str:
    return r"[^\p{L}\p{N}]+".join(w.replace(".", "[.]") for w in words)


def _prefilter() -> str:
    """A pattern that finds every paragraph with a telling word or pair."""
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(_run, sorted([*((w,) for w in _TELLING), *_PAIRS])))})(?![\p{{L}}\p{{N}}])"


def _starting() -> str:
    """A pattern that finds every line in which a template starts: it holds a telling word or pair, or ends with the words of a template before its first one."""
    before = {tuple(t[:n]) for t in _TEMPLATES for n in range(1, len(t)) if not telling(t[:n])}
    return rf"{_prefilter()}|(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(_run, sorted(before)))})[^\p{{L}}\p{{N}}]*$"


def grams_of(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _training(rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Labelled paragraphs: notices of each family between other words, and paragraphs of the class unknown, some of which hold stray words of templates."""
    filler = " ".join(_OTHERS).split()
    leads = [x for x in _LEADS if x]
    # most words of a text are none of the training's: ODD stands for them
    around = lambda most: " ".join(np.where(rng.random(n := rng.integers(0, most)) < rng.choice([0, 0.7, 1]), ODD, rng.choice(filler, n)))
    texts, y = [], []
    for c, (name, phrases) in enumerate(FAMILIES.items()):
        for i in range(200):
            said = f"{rng.choice(leads)} {rng.choice(SHORT[name])}" if i % 8 == 7 else f"{rng.choice(_LEADS)} {rng.choice(phrases)} {rng.choice(_TAILS)}"
            texts.append(" ".join(f"{around(24)} {said} {around(24)}".split() if rng.random() < 0.5 else said.split()))
            y.append(c)
    long = [t for t in _TEMPLATES if len(t) > 1]
    words = sorted({w for t in long if len(t) > 2 for w in t})
    for i in range(3000):
        parts = list(rng.choice(_OTHERS, rng.integers(0, 3) if rng.random() < 0.5 else 0)) + [around(48)]
        if i % 4 == 0:
            parts.insert(int(rng.integers(0, len(parts) + 1)), str(rng.choice(leads)))
        if i % 10 == 1:  # one stray word and nothing else that is known
            parts = [f"{ODD} {words[i // 10 % len(words)]} {ODD}"]
        elif i % 2 == 1:
            for _ in range(rng.integers(1, 4)):  # stray words and pairs
                t = long[rng.integers(len(long))]
                at = int(rng.integers(0, len(t) - 1))
                stray = " ".join(t[at : at + 2]) if len(t) > 7 and rng.random() < 0.3 else words[rng.integers(len(words))]
                side = lambda: ODD if rng.random() < 0.6 else rng.choice(filler)
                parts.insert(int(rng.integers(0, len(parts) + 1)), f"{side()} {stray} {side()}")
        texts.append(" ".join(" ".join(parts).split()))
        y.append(len(FAMILIES))
    return texts, np.array(y)


def _matrix(texts: list[str], place: dict[str, int]) -> np.ndarray:
    """Rows of known n-grams, each of length 1, and a column of ones: what the training never saw weighs nothing."""
    x = np.zeros((len(texts), len(place) + 1), np.float32)
    for row, text in zip(x, texts, strict=True):
        row[[place[g] for g in set(grams_of(text.split())) if g in place]] = 1
        row /= max(1.0, float(np.sqrt(row.sum())))
    x[:, -1] = 1
    return x


@lru_cache(maxsize=1)
def trained(seed: int = 5, rounds: int = 1000) -> tuple[list[str], dict[str, int], np.ndarray, float, float]:
    """Classes, places of the known n-grams, weights (the last row is the bias), temperature and least probability."""
    names = [*FAMILIES, UNKNOWN]
    texts, y = _training(np.random.default_rng(seed))
    held = np.random.default_rng(seed + 1).random(len(y)) < 0.2
    seen = Counter(g for t, h in zip(texts, held, strict=True) if not h for g in set(grams_of(t.split())))
    place = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 4 and ODD not in g))}
    x = _matrix(texts, place)
    w = np.zeros((x.shape[1], len(names)), np.float32)
    xt, yt = x[~held], np.eye(len(names), dtype=np.float32)[y[~held]]
    step = np.zeros_like(w)
    # n-grams that tell nothing, and the bias, may not favour a family: what the prefilter passes over is unknown for certain
    silent = np.array([not telling(g.split()) for g in place] + [True])
    for _ in range(rounds):
        z = xt @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = 0.9 * step + xt.T @ (p - yt) / len(xt) + 1e-5 * w
        w -= 6.0 * step
        w[silent, :-1] = np.minimum(w[silent, :-1], w[silent, -1:])
    w[:-1][np.abs(w[:-1]) < 0.05] = 0  # sparse weights
    w[silent, :-1] = np.minimum(w[silent, :-1], w[silent, -1:])
    z, truth = x[held] @ w, y[held]
    best = (np.inf, 1.0)
    for t in np.geomspace(0.3, 4, 24):
        q = z / t - (z / t).max(1, keepdims=True)
        loss = float(-(q[np.arange(len(q)), truth] - np.log(np.exp(q).sum(1))).mean())
        best = min(best, (loss, float(t)))
    q = np.exp(z / best[1] - (z / best[1]).max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    said = q.argmax(1) != len(names) - 1
    order = np.argsort(-q.max(1)[said])
    wrong = (q.argmax(1) != truth)[said][order]
    fine = np.flatnonzero(np.cumsum(wrong) <= WRONG * np.arange(1, len(wrong) + 1))
    least = float(q.max(1)[said][order][fine[-1]]) if len(fine) else 0.9
    return names, place, w, best[1], max(0.5, least)


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}.]+|\.(?![0-9a-z])|(?<![0-9a-z])\."), lambda w: w != "")


def license_findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph of a licence family: doc_id, paragraph (from 0), family, probability, confirmed, excerpt (the whole paragraph)."""
    names, place, w, temperature, least = trained()
    may, starting = _prefilter(), _starting()
    lines = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).where(F.col("_text").rlike(may))
        .select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.split("_text", r"\r?\n").alias("_lines"))
    )
    starts = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.element_at("_lines", i).rlike(starting))
    # a nonblank line may hold no word (a border of a comment), so twice as many lines are looked at; their words alone count
    unit = lambda i: F.struct((i - 1).alias("paragraph"), F.element_at("_lines", i).alias("line"), F.slice("_lines", i + 1, 2 * REACH).alias("after"))
    parts = lines.select("_row", "doc_id", F.explode(F.transform(starts, unit)).alias("_part")).select("_row", "doc_id", "_part.*")
    end = F.array_position(F.transform("after", lambda x: F.trim(F.translate(x, "\t\f", "  ")) == ""), True)
    parts = parts.withColumn("_joined", F.array_join(F.when(end > 0, F.slice("after", F.lit(1), (end - 1).cast("int"))).otherwise(F.col("after")), " "))
    parts = parts.withColumn("rest", F.regexp_extract("_joined", rf"^(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}.]+){{0,{REACH}}}", 0))
    rows = (
        parts.select("_row", "doc_id", "paragraph", F.explode(F.array(
            F.struct(F.lit(False).alias("wrapped"), F.col("line").alias("excerpt")),
            F.struct(F.lit(True).alias("wrapped"), F.when(F.length("rest") > 0, F.concat_ws(" ", "line", "rest")).alias("excerpt")),
        )).alias("_unit"))
        .select("_row", "doc_id", "paragraph", "_unit.wrapped", "_unit.excerpt")
        .where(F.col("excerpt").rlike(may))
        .withColumn("_words", _words(F.col("excerpt")))
    )
    none = F.array().cast("array<int>")

    def runs(n: int) -> Column:
        """All runs of n words. The lambda has one parameter: a second one, even with a default, would get the index."""
        starts = F.when(F.size("_words") >= n, F.sequence(F.lit(1), F.size("_words") - (n - 1))).otherwise(none)
        return F.transform(starts, lambda i: F.array_join(F.slice("_words", i, n), " "))

    grams = F.flatten(F.array(*map(runs, (1, 2, 3))))
    cells = F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))
    # a row of weights for each n-gram of the training, whatever the corpus
    known = sorted(place, key=place.__getitem__)
    frame = pd.DataFrame(w[:-1].astype(float), columns=[f"w{c}" for c in range(len(names))])
    frame.insert(0, "_cell", np.array([xxhash.xxh64_intdigest(g.encode(), seed=42) for g in known], np.uint64).view(np.int64))  # as xxhash64() gives it
    weights = docs.sparkSession.createDataFrame(frame)
    key = ["_row", "doc_id", "paragraph", "wrapped", "excerpt", "_words"]
    summed = (
        rows.select(*key, F.explode(cells).alias("_cell")).join(F.broadcast(weights), "_cell")
        .groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(f"w{c}").alias(f"w{c}") for c in range(len(names))))
    )
    norm = F.sqrt(F.col("_n").cast("double"))
    logits = F.array(*((F.col(f"w{c}") / norm + float(w[-1, c])) / temperature for c in range(len(names))))
    scored = summed.select(*key, logits.alias("_logits")).withColumn("_top", F.array_max("_logits"))
    label = F.element_at(F.array(*map(F.lit, names)), F.array_position("_logits", F.col("_top")).cast("int"))
    total = F.aggregate("_logits", F.lit(0.0), lambda sum_, x: sum_ + F.exp(x - F.col("_top")))
    found = scored.select(*key, label.alias("family"), (1 / total).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    said = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    confirmed = F.lit(False)
    for name, phrases in FAMILIES.items():
        confirmed = confirmed | ((F.col("family") == name) & said.rlike("|".join(" " + p.replace(".", "[.]") + " " for p in phrases)))
    found = written(found.select("_row", "doc_id", "paragraph", "wrapped", "family", "probability", confirmed.alias("confirmed"), "excerpt"), "licences")
    # findings of a family in lines that follow each other are one notice: its single lines, or its wrapped start if only that is confirmed
    of = Window.partitionBy("_row", "family")
    run = Window.partitionBy("_row", "family", "_run")
    best = run.orderBy(F.desc("confirmed"), "wrapped", F.desc("probability"), "paragraph")
    found = found.withColumn("_run", F.col("paragraph") - F.dense_rank().over(of.orderBy("paragraph")))
    found = found.withColumn("_best", F.row_number().over(best)).withColumn("_by", F.first("wrapped").over(best))
    found = found.where((F.col("_best") == 1) | (~F.col("wrapped") & ~F.col("_by")))
    return found.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), "confirmed", "excerpt")
