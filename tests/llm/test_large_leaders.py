"""A leader whose sets' members are dealt to shares, and pairs fetched in rounds."""

import numpy as np
import pytest

from sedimill.llm import ngram_join as nj


def _texts():
    rng = np.random.default_rng(5)
    base = [f"p{i}" for i in range(200)]
    texts = [" ".join(base)]
    for _ in range(60):  # far from the leader and from one another, with many additions in common
        texts.append(" ".join([*rng.choice(base, 150, replace=False), *(f"q{i}" for i in rng.choice(90, 50, replace=False))]))
    for t in texts[5:10]:  # and some that have a partner, though neither is linked to the leader
        texts.append(" ".join([*t.split()[:-2], "z1"]))
    return texts


def test_shares_of_a_large_leader_leave_no_more_pairs(spark):
    """Pairs that sketches rule out must not come back because their leader is large: their texts would be fetched."""
    docs = spark.createDataFrame([(t,) for t in _texts()], "text string")
    texts = nj.packed_texts(docs, 1).toPandas()
    first = texts.set_id[0]
    pairs = spark.createDataFrame([(int(a), int(first), x, texts.packed[0]) for a, x in zip(texts.set_id[1:], texts.packed[1:], strict=True)], "a long, b long, left binary, right binary")
    stars = pairs.mapInArrow(nj._parted(1, 80, 100), "a long, b long, near boolean, n int, added int, gone int, prefix array<int>, sketch binary")
    parts = spark.createDataFrame([], "node long, component long")
    whole, dealt = ({tuple(r) for r in nj._pairs(stars, parts, 80, 100, held).collect()} for held in (nj.HELD, 400))
    assert len(whole) >= 5 and dealt == whole


@pytest.mark.parametrize("held", [100])
def test_join_with_dealt_leaders(spark, held):
    rows = list(enumerate(_texts()))
    sets = [set(t.split()) for _, t in rows]
    want = list(range(len(sets)))
    for _ in sets:  # the smallest id that links reach
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 80 * len(x | y):
                    want[i] = min(want[i], want[j])
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=1, held=held).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want)) and want != list(range(len(sets)))
