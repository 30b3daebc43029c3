"""Token ids for all code points, growing shards, long tokens, masked places, and the pipeline's defined results."""

import numpy as np
import public_tokenizers

from sedimill.llm import packing, ranking, secrets

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers_for_all_code_points():
    ids = packing.WordIds(PATH)
    points = [chr(p) for p in (*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x1FB00))]
    texts = [f"x{c}." for c in points] + [f"x.{c} A{c}, !{c}" for c in points] + ["BELEDİYESİ. ANKARA BELEDİYESİ, ALİ!", "J\u030c H\u0331. T\u0308, it's I'LL. <|endoftext|>. <|ENDOFTEXT|> a.b.c. ... ?!"]
    plain = ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for lo in range(0, len(texts), 5000):
        for t, own, want in zip(texts[lo : lo + 5000], ids([t.encode() for t in texts[lo : lo + 5000]]), plain[lo : lo + 5000], strict=True):
            assert own.tolist() == want.ids, t


def test_ranks_with_more_shards(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ranking, "ROWS", 3)
    df = spark.range(2000).select((F.col("id") % 3).cast("string").alias("g"), "id")
    rows = ranking.ranked(df, ["g"], [F.col("id")], F.xxhash64("id")).collect()
    for g in "012":
        assert sorted(r["rank"] for r in rows if r["g"] == g) == list(range(sum(r["g"] == g for r in rows)))


def test_long_tokens_and_masked_places(spark):
    rng = np.random.default_rng(1)
    tail = "".join(rng.choice(list("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789"), 40))
    token = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 80)) + tail
    rows = [(1, f"the secret key {token} ends", "s"), (2, "it was monday2x before. password: monday2x9Q!z and monday2x9Q!z again", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    described = secrets._described(df, "text", "source").collect()
    assert [d["secret"] for d in described[0]["_described"]] == [token]
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()}
    assert clean[2] == "it was monday2x before. password: [SECRET] and monday2x9Q!z again"


def test_stages_keep_repeated_and_missing_ids_apart(spark, tmp_path):
    import corpus_pipeline as cp

    word = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [
        (None, word("a"), "en", "s", 1, "x"), (None, word("a"), "en", "s", 1, "x"), (None, word("b"), "en", None, 1, "x"), (7, word("a"), "en", "s", 1, "x"), (7, word("a"), "en", "s", 1, "x"), (7, word("c"), "en", "s", 1, "x"), (8, None, "en", "s", None, "x"), (9, "", "en", "s", 0, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    docs = spark.read.parquet(str(tmp_path / "d.parquet"))
    kept = cp.near_duplicates(spark, docs, "").collect()
    assert sorted(str((r["doc_id"], (r["text"] or "")[:2])) for r in kept) == sorted(str(x) for x in [(None, "b0"), (7, "a0"), (7, "c0"), (8, ""), (9, "")])
    masked = cp.secret_scan(spark, docs, "")
    assert masked.columns == docs.columns and sorted(str(r["n_chars"]) for r in masked.collect()) == sorted(["0", "None", *(str(len(word("a"))) for _ in range(6))])
    mixed = cp.mixing(spark, docs, "")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {None, 7}
    none = docs.limit(0)
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in cp.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == [], name
    cp.quality(spark, docs, str(tmp_path)).collect()


def test_nearest_beyond_the_sample(spark):
    """Recall for vectors the tree wasn't fitted on, and queries with repeated ids or many copies."""
    from pyspark.sql import functions as F

    from sedimill.llm import ann

    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in frame.collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    found: dict = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, sample=400).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in found:
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len(found[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert len(found) == int((ids % 20 == 0).sum()) and hits / (20 * len(found)) >= 0.9
    odd = [(0, [None, 1.0]), (0, [1.0, 1.0]), *((i, [1.0, float(i % 7)]) for i in range(1, 200)), *((400 + i, [5.0, 5.0]) for i in range(60))]
    got = ann.nearest(spark.createDataFrame(odd, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=50, recall=0.01).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 51))
