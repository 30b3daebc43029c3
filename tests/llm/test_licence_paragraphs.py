"""Licence notices wrapped over lines, and templates that no cue word names."""

import re

import numpy as np

from sedimill.llm import licenses


def found(spark, texts):
    rows = licenses.license_findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return sorted((r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in rows)


def test_wrapped_notices(spark):
    texts = [
        "Prose.\n\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n\nProse.",
        "This file is licensed under the\nMozilla\nPublic License.",
        "Unauthorized\ncopying of this\nfile is prohibited.",
    ]
    got = found(spark, texts)
    assert [(i, f, c) for i, _, f, c in got if c] == [(0, "GPL", True), (1, "MPL", True), (2, "Proprietary", True)]
    assert got[0][1] == 2
    # a blank line ends a notice
    assert not any(c for *_, c in found(spark, ["Unauthorized copying\n\nof this file is prohibited."]))


def test_templates_without_a_cue(spark):
    texts = ["This may not be reproduced without permission.", "Unauthorized copying of this file is prohibited.", "Released under MIT", "BSD-3-Clause", "The driver was not there.\nHe may be in the house."]
    assert found(spark, texts) == [(0, 0, "Proprietary", True), (1, 0, "Proprietary", True), (2, 0, "MIT", False), (3, 0, "BSD", False)]


def test_prefilter_passes_whatever_can_be_labelled():
    may = licenses._prefilter().replace(r"\p{L}\p{N}", "a-z0-9")
    for phrases in licenses.FAMILIES.values():
        assert all(re.search(may, p) for p in phrases)
    # an n-gram that the pattern doesn't find, and the bias, favour no family over unknown
    _, place, w, _, least = licenses.trained()
    silent = np.array([not re.search(may, g) for g in place] + [True])
    assert least >= 0.5 and silent.sum() > 100 and (w[silent, :-1] <= w[silent, -1:]).all()


def test_templates_wrapped_at_every_word(spark):
    rows = [(f, "\n".join([" ".join(p.split()[:i]), " ".join(p.split()[i:])])) for f, phrases in licenses.FAMILIES.items() for p in phrases for i in range(1, len(p.split()))]
    got = {i for i, _, f, c in found(spark, [t for _, t in rows]) if c and f == rows[i][0]}
    assert [rows[i] for i in range(len(rows)) if i not in got] == []


def test_every_template_is_named_and_scored_as_trained(spark):
    rows = [(f, p) for f, phrases in licenses.FAMILIES.items() for p in phrases]
    docs = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_findings(docs).collect()}
    names, place, w, temperature, _ = licenses.trained()
    z = licenses._matrix([p for _, p in rows], place) @ w / temperature
    q = np.exp(z - z.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    for i, (family, p) in enumerate(rows):
        assert (got[i]["family"], got[i]["confirmed"]) == (family, True), p
        assert abs(got[i]["probability"] - q[i].max()) < 1e-4 and names[q[i].argmax()] == family, p


def test_stray_words_of_templates_are_unknown(spark):
    texts = ["Der Mann kommt mit der Frau.", "Written by and for the people.", "The bank reserved the rights to the house.", "Copying was fine for any person."]
    assert found(spark, texts) == []


def test_paragraphs_kept_out_of_the_training():
    names, place, w, temperature, least = licenses.trained()
    texts, y = licenses._training(np.random.default_rng(99))
    z = licenses._matrix(texts, place) @ w / temperature
    q = np.exp(z - z.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    said = np.where(q.max(1) >= least, q.argmax(1), len(names) - 1)
    family = y < len(names) - 1
    assert (said[family] == y[family]).mean() > 0.9
    assert (said[~family] == len(names) - 1).mean() > 0.98
