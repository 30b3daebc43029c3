"""Chains of near SimHashes in crowded blocks, against all pairs."""

import itertools

import numpy as np

from sedimill.operators import dedup


def test_chains_in_a_crowded_block(monkeypatch):
    monkeypatch.setattr(dedup, "RUN", 50)
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**40, 400, dtype=np.uint64) << np.uint64(24)  # equal in their low blocks
    for d in range(1, 7):  # and some that differ from others in 1 to 6 bits
        for x in h[:40]:
            h = np.append(h, x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, d, replace=False))))
    h = np.unique(h)
    cuts = [round(i * 64 / 6) for i in range(7)]
    blocks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(6)]
    masks = [np.uint64(sum(c)) for c in itertools.combinations(blocks, 2)]
    got = dedup.near_hashes(h, masks, np.arange(64), 6, 4)
    want = np.arange(len(h))
    close = np.bitwise_count(h[:, None] ^ h[None, :]) <= 4
    for _ in h:
        low = np.where(close, want[None, :], len(h)).min(1)
        if (low == want).all():
            break
        want = low
    assert got.tolist() == want.tolist() and len(set(want)) < len(h)


def test_copies_leave_links_not_pairs():
    """3,000 hashes within 4 bits of one another in part: a pair list would have a million rows, the chain has a link a hash."""
    base = 0x0123456789ABCDEF
    h = np.unique(np.array([base ^ sum(1 << b for b in c) for n in (0, 1, 2) for c in itertools.combinations(range(64), n)], np.uint64))
    label = dedup.near_hashes(h, [np.uint64(0)], np.arange(64), 6, 4)
    assert len(label) == len(h) and set(label.tolist()) == {0}


def test_no_ids_are_broadcast_through_the_driver(spark):
    from sedimill.operators import registry
    from sedimill.operators.registry import Context

    rows = [(i, " ".join(f"w{j + i // 3}" for j in range(50))) for i in range(30)]
    out = registry.get("document_simhash_deduplicator").apply(spark.createDataFrame(rows, "doc_id long, text string"), Context())
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"] for r in out.collect()} <= set(range(0, 30, 3))
