"""Features of texts that fill more than one JPEG frame."""

import numpy as np

from sedimill.llm import media


def test_feature_covers_every_frame(spark):
    """Two texts of over one frame (524,224 bytes) that differ in their last frame only."""
    size = media.ROW * media.ROWS
    head = "one two three four " * (size // 19 + 1)
    head = head[:size]
    rows = [(1, head + "a" * 400_000), (2, head + "a" * 200_000 + "~" * 200_000), (3, head), (4, None)]
    got = {r["doc_id"]: r for r in media.payload_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["payload_bytes"] == got[2]["payload_bytes"] == size + 400_000
    assert got[1]["feature"] != got[2]["feature"]
    assert (got[1]["width"], got[1]["height"]) == (8 * media.ROW, 8 * (size + 400_000) // media.ROW)
    assert got[3]["height"] == 8 * media.ROWS and got[3]["feature"] != got[1]["feature"]
    assert got[4]["height"] == 8


def test_hash_by_strips_is_the_hash_of_area_means():
    rng = np.random.default_rng(2)
    for shape in ((1, 64), (5, 64), (8, 8), (100, 64), (33, 7), (2, 3)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        r, c = (np.linspace(0, n, 9).astype(int) for n in shape)
        r0, c0 = np.minimum(r[:-1], shape[0] - 1), np.minimum(c[:-1], shape[1] - 1)
        means = np.array([[x[a : max(b, a + 1), d : max(e, d + 1)].mean() for d, e in zip(c0, c[1:], strict=True)] for a, b in zip(r0, r[1:], strict=True)])
        assert media.thumb_hash(x) == int("".join("01"[int(v)] for v in (means > means.mean()).ravel()), 2)
    wide, small = np.ones((2, 8), np.uint8), np.ones((3, 5), np.uint8)
    assert media.stacked([wide, small]).shape == (5, 8) and media.stacked([wide, small]).sum() == 16 + 15
