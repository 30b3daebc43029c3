"""The operators against brute force, exact round trips and held-out accuracy, and their defined results in edge cases."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from sedimill.llm import ann, html_extract, licenses, media, mixing, ngram_join, packing, quality, secrets, suffix_dedup
from sedimill.llm.queries import op2_suffix_dedup, op4_quality, op8_nearest, oracle_sql, queries

SF = "/root/testdata/sf0.001"
EDGE = "doc_id long, text string, lang string, source string, n_chars long, score double, part string, uid string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None, 1.0, "a", "b"), (2, "", "en", "s", 0, None, None, None), (3, " \n\t", "en", "s", 3, 0.0, "", ""), (None, "some words without any id", "en", None, 1, 0.0, "", ""),
    (4, "one two", "en", "s", 7, 0.0, "", ""), (4, "one two", "en", "s", 7, 0.0, "", ""), (5, "ONE two", "en", "t", 7, 0.0, "", ""), (6, LONG, "en", "t", len(LONG), 0.0, "", ""), (7, LONG + " end", "fr", "t", None, 0.0, "", ""),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EDGE)


def components(sets, num, den):
    """Brute force: linked ids by an inverted index."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in index[s])
        for s in sets[i]:
            index[s].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def word_sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def test_join_matches_brute_force_with_families(spark):
    """A family of near copies, most of them just below the threshold, beside exact copies and a shared passage."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts[i] = " ".join(w)
    for i in range(90, 150):
        texts[i] = " ".join(base[:30] + [rng.choice(vocabulary) for _ in range(rng.randrange(60))])
    texts |= {150: texts[0].upper(), 151: texts[0], 152: "", 153: "a b", 154: "A  b"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    # many near neighbours make one-deletion neighbourhoods the cheaper index; few bits make sets share names
    for k, num, near, bits, held in ((4, 85, 1, 64, 1 << 18), (5, 80, 1, 64, 0), (5, 80, 1, 64, 1 << 18), (3, 50, 1, 64, 1 << 18), (4, 95, 1, 64, 0), (4, 85, 1, 4, 0), (4, 85, 400, 64, 1 << 18)):
        sets = word_sets(texts, k)
        assert near == 1 or ngram_join.scheme(130, num, 100, near).deletions == 1
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df, k, num, 100, near=near, bits=bits, held=held).collect()}
        want = components(sets, num, 100)
        assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_join_schemes_cover_every_difference():
    for num in (50, 80, 85, 95):
        for high in (1, 2, 6, 7, 30, 500):
            s, h = ngram_join.scheme(high, num, 100), ngram_join.differ_at_most(2 * high, num, 100)
            assert s.segments >= h // (s.deletions + 1) + 1 + s.spare


def test_join_edges(edge, none):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(edge, 4, 85, 100).collect())
    assert got == sorted([("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("None", 2, None), ("4", 1, 4), ("4", 1, 4), ("5", 1, 4), ("6", 29_997, 6), ("7", 29_998, 6)])
    assert ngram_join.ngram_jaccard_join(none).collect() == []


def removed(texts, n):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(spark, edge, none):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [word(n) for n in (230, 260, 500)]
    texts = [word(rng.randrange(50)) + (rng.choice(shared) + word(rng.randrange(80))) * rng.randrange(3) + word(300) for _ in range(40)]
    texts += [texts[0], "a" * 450, "ab" * 150, None, "", "x" * 199, "y" * 200, "y" * 200, shared[0][:215]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffix_dedup.repeats_removed(df, 200).orderBy("doc_id").collect()]
    assert got == removed(texts, 200)
    assert suffix_dedup.repeats_removed(edge).count() == len(ROWS)
    assert suffix_dedup.repeats_removed(none).collect() == []


def test_repeats_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id")
    got = [tuple(r)[1:] for r in op2_suffix_dedup(spark, SF).orderBy("doc_id").collect()]
    assert got == removed(docs["text"].tolist(), 200)


def test_main_text(spark):
    page = "<title>t</title><header>H</header><nav>m</nav><div class='ad'>x</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five<section id=comments><article>re</article></section></article><footer>f"
    assert html_extract.extract(page) == "A & B\n\none two three four\n\nfive"
    assert html_extract.extract("<body><div class='cookie-notice'>c</div><form>q</form><p>1 < 2</p><script>if (a<b) x</script></body>") == "1 < 2"
    assert html_extract.extract(None) == "" == html_extract.extract("<!-- never closed")
    # a phrase on all pages of a host belongs to its template, though nothing else tells
    rows = [(i, f"http://h.example/{i}", f"<body><div>Follow us</div><div>Own text {i} of the page</div></body>") for i in range(12)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://other.example/", "<div>Follow us</div>"), (23, "http://h.example/0", rows[0][2])]
    got = {r["page_id"]: r for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Own text 3 of the page" == got[3]["text"] and got[3]["n_chars"] == 22
    assert got[22]["text"] == "Follow us" and got[20]["text"] == "" and got[23]["text"] == got[0]["text"]
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_main_text_of_all_pages(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pandas()
    got = {r["page_id"]: r["text"] for r in html_extract.main_texts(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for p in pages.itertuples():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id] == "\n\n".join(b for b in blocks if b)


def test_quality_on_the_held_out_fold(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in op4_quality(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(edge, labels).collect()} == {0.5}
    assert quality.quality_scores(none, labels).collect() == []
    trees = quality.boosted(np.array([[float(i)] for i in range(400)]), np.array([0.0] * 200 + [1.0] * 200))
    assert trees.score(np.array([[0.0]]))[0] < 0.2 and trees.score(np.array([[399.0]]))[0] > 0.8


def test_media_round_trip(edge, none):
    rng = random.Random(1)
    raw = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 64, 700)] + [b"\xff" * 200, b"\x00\xff" * 100, b"z" * (media.ROW * media.ROWS + 5)]
    padded = [b + b"\0" * (max(1, -(-len(b) // 64)) * 64 - len(b)) for b in raw]
    at = np.concatenate([[0], np.cumsum([len(b) for b in padded])])
    images = media.encoded(np.frombuffer(b"".join(padded), np.uint8), at)
    assert [b"".join(p.tobytes() for p in d[2]) for d in media.decoded(images)] == padded
    assert media.decoded([None, b"", b"no image", images[0][:40]]) == [(None, None, [])] * 4
    rows = {(r["doc_id"], r["n_bytes"]): r for r in media.payload_digest(edge).collect()}
    text = LONG.encode()
    full = text + b"\0" * (-len(text) % 64)
    r = rows[6, len(text)]
    assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert rows[1, 0]["payload_bytes"] == 64 and rows[1, 0]["media_sha256"] == rows[2, 0]["media_sha256"]
    assert media.payload_digest(none).collect() == []


def test_decoder_reads_colour_and_ac_coefficients():
    """A made-up image of two components with 2x1 sampling, AC coefficients and no restart markers."""
    dc = media.canonical([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
    ac = media.canonical([0, 2, 1, 1] + [0] * 12, [0x00, 0x01, 0x12, 0xF0])
    bits, last, want = "", [0, 0], []

    def put(code):
        return format(code[0], f"0{code[1]}b")

    for m in range(6):
        for c in (0, 0, 1):
            v = (m * 37 + c * 11) % 90 - 45
            step, size = v - last[c], abs(v - last[c]).bit_length()
            last[c] = v
            bits += put(dc[size]) + (format(step if step > 0 else step + (1 << size) - 1, f"0{size}b") if size else "")
            bits += put(ac[0x12]) + "10" + put(ac[0xF0]) + put(ac[0x01]) + "1" + put(ac[0x00])
            if c == 0:
                want.append(v)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    image = b"\xff\xd8" + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, bytes([8, 0, 16, 0, 48, 2, 1, 0x21, 0, 2, 0x11, 0]))
    image += seg(0xC4, bytes([0, 0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7 + list(range(12)))) + seg(0xC4, bytes([0x10, 0, 2, 1, 1] + [0] * 12 + [0x00, 0x01, 0x12, 0xF0]))
    image += seg(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (w, h, (grey,)), = media.decoded([image])
    assert (w, h, grey.shape) == (48, 16, (2, 6))
    assert grey.ravel().tolist() == [int(np.clip((v * 16 + 4 >> 3) + 128, 0, 255)) for v in want]


def test_packing(spark, edge, none):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    texts = [*[r[1] for r in ROWS], "It's <|endoftext|>a<|ENDOFTEXT|> 12.5, wow!!! …x. Élan¿", "字" * 300 + " don't."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(path)
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for x in texts]
    rows = packing.packed(df, path).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    for r in rows:
        own = ids[r["doc_id"]]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(own), zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()))
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed(none, path).collect() == []


def test_slack_patterns_use_all_pieces():
    stock = {4096: 3, 3000: 40, 1096: 25, 700: 11, 396: 9, 5: 100}
    patterns = packing.slack_patterns(stock)
    used = Counter()
    for uses, parts in patterns:
        assert sum(s * c for s, c in parts) <= 4096
        for s, c in parts:
            used[s] += uses * c
    assert used == stock
    assert sum(u for u, p in patterns if sum(s * c for s, c in p) == 4096) >= 28


def test_mixing(spark, edge, none):
    assert mixing.shared_targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 200.0, "b": 83.33333, None: 166.66667}, rel=1e-4)
    size, n = np.array([7, 5, 3]), np.array([2, 3, 1])
    for budget in range(33):
        got = mixing.fitted_counts(size, n, budget)
        sums = {a * 7 + b * 5 + c * 3 for a in range(3) for b in range(4) for c in range(2)}
        assert (got >= 0).all() and (got <= n).all()
        assert budget - 7 <= (got * size).sum() <= budget or (got * size).sum() == max(s for s in sums if s <= budget)
    from pyspark.sql import functions as F

    sized = edge.withColumn("size", mixing.word_count(F.col("text")))
    assert sorted(r["size"] for r in sized.collect()) == [0, 0, 0, 2, 2, 2, 5, 30_000, 30_001]
    rows = mixing.mixed(sized).select("doc_id", "source", "size", "repeats", "target").collect()
    assert len(rows) == len(ROWS) and all(0 <= r["repeats"] <= 2 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(sized).select("doc_id", "source", "size", "repeats", "target").collect()))
    assert mixing.mixed(none.withColumn("size", F.lit(0))).collect() == []


def test_nearest(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = {i: np.array(v, float) for i, v in rows}
    found = defaultdict(list)
    for r in op8_nearest(spark, SF).collect():
        assert r["score"] == pytest.approx((x[r["query_id"]] * x[r["vec_id"]]).sum(), abs=1e-12)
        found[r["query_id"]].append((r["rank"], r["vec_id"]))
    hits = 0
    for q in found:
        best = sorted((-(x[q] * v).sum(), i) for i, v in x.items() if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i in found[q]})
        assert sorted(r for r, _ in found[q]) == list(range(1, 21))
    assert set(found) == {i for i in x if i % 20 == 0} and hits / (20 * len(found)) >= 0.9


def test_nearest_edges(spark):
    from pyspark.sql import functions as F

    schema = "vec_id long, embedding array<float>, label int"
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 30, 5)] + [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (6, [1.0], 0), (None, [1.0, 0.0], 0), (7, [float("inf"), 0.0], 0)]
    got = ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 5, 1.0), (0, 10, 1.0), (0, 15, 1.0), (20, 0, 1.0), (20, 5, 1.0), (20, 10, 1.0)]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).collect() == []


def test_licences(spark, edge, none):
    lines = {
        "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "BSD": "Code is covered by the 3-clause BSD license.", "Proprietary": "All rights reserved.",
    }
    rows = [(i, f"Some prose.\n{line}\nMore prose.") for i, line in enumerate(lines.values())] + [(9, "The driver lost his license last year.\nA licensed electrician must do the work."), (10, None), (11, lines["MIT"] + "\n" + lines["MIT"])]
    got = sorted((r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in licenses.license_findings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, 1, name, True) for i, name in enumerate(lines)] + [(11, 0, "MIT", True), (11, 1, "MIT", True)]
    assert licenses.license_findings(edge).collect() == [] == licenses.license_findings(none).collect()


def test_secrets(spark, edge, none):
    key, hexed = "AKIA" + "Q7ZP2MWX8RTK4JVN", hashlib.sha1(b"k").hexdigest()
    rows = [
        (1, f'x {key} y token = "{hexed}" z password=Tr0ub4dor&3xy {key}', "s"), (2, 'api_key = "your_api_key_here"', "s"), (3, "plain thandnessesofthings and averyveryverylongword", "s"), (4, None, None), (5, "é" * 50 + f" {key}", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["start"], r["length"], r["secret_sha256"]) for r in secrets.secret_findings(df).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    t = rows[0][1]
    want = [(1, t.index(key), 20, sha(key)), (1, t.index(hexed), 40, sha(hexed)), (1, t.index("Tr0ub"), 13, sha("Tr0ub4dor&3xy")), (1, t.rindex(key), 20, sha(key)), (5, 51, 20, sha(key))]
    assert got == sorted(want)
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()}
    assert key not in clean[1] and hexed not in clean[1] and clean[2] == rows[1][1] and clean[4] is None
    assert secrets.redacted(edge).columns == edge.columns and secrets.redacted(none).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.01"), name)
        assert docs.columns == names
        seen.append(docs.select("doc_id", "text").toPandas())
    accepted, distinct, clean, mixed = seen
    texts = dict(zip(accepted["doc_id"], accepted["text"], strict=True))
    want = components(word_sets(texts, 5), 80, 100)
    assert set(distinct["doc_id"]) == {i for i in texts if want[i] == i}
    assert len(clean) == len(distinct) and not clean["text"].str.contains(r"AKIA[0-9A-Z]{16}").any()
    assert mixed["doc_id"].value_counts().max() <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 4096


def test_queries_are_registered():
    assert [k.split("_")[0] for k in queries()] == [f"op{n}" for n in range(1, 11)]
    assert set(oracle_sql()) <= set(queries())
