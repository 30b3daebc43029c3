"""Golden rows and invariants of the library's operators."""

import math
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimill.functions import text as T
from sedimill.operators import registry
from sedimill.operators.registry import BackendMissing, Context


def mapped(spark, name, texts, ctx=None, **params):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = registry.get(name).apply(df, ctx, **params).orderBy("doc_id").collect()
    return [r["text"] for r in rows]


def kept(spark, name, texts, **params):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in registry.get(name).apply(df, None, **params).collect())


def test_every_operator_is_registered():
    assert len(registry.names()) == 111
    with pytest.raises(KeyError):
        registry.get("no_such_mapper")
    with pytest.raises(ValueError):
        registry.get("text_length_filter").check({"least": 3})
    with pytest.raises(KeyError):
        registry.register("text_length_filter", "filter")(lambda c: None)


@pytest.mark.parametrize(
    ("name", "params", "text", "want"),
    [
        ("clean_email_mapper", {}, "write to jo.e@ex.org now", "write to  now"),
        ("clean_email_mapper", {"repl": "<$>"}, "a@b.cd", "<$>"),
        ("clean_ip_mapper", {}, "at 1.2.3.256 or ::", "at 6 or ::"),
        ("clean_links_mapper", {}, "see http://a.example/b?c=d (now)", "see  (now)"),
        ("clean_copyright_mapper", {"matching_rules": ["\\\\d+", "("]}, " a 12\n\n\n\nb ", "a  \n\nb"),
        ("replace_content_mapper", {"pattern": ["(a)(b)", "c"], "repl": [r"\2\1", "$"]}, "abc", "ba$"),
        ("punctuation_normalization_mapper", {}, "，１—…", '," - ...'),
        ("whitespace_normalization_mapper", {}, " a b\tc\n", "a b c"),
        ("remove_bibliography_mapper", {}, "a\n\\appendix\nb", "a\n"),
        ("remove_comments_mapper", {}, "ab%c\n%d\ne", "a\ne"),
        ("remove_header_mapper", {}, "x\\section{A}y", "\\section{A}y"),
        ("remove_header_mapper", {}, "none", ""),
        ("remove_long_words_mapper", {"min_len": 2, "max_len": 4}, "abc abcdef!\n\nd\tabcd!!", "abc\nabcd!!"),
        ("remove_words_with_incorrect_substrings_mapper", {}, "go www.a.com ok", "go ok"),
        ("remove_non_chinese_character_mapper", {}, "a1字é。", "a1字。"),
        ("remove_specific_chars_mapper", {}, "◆a|b", "ab"),
        ("remove_table_text_mapper", {}, "t\na b\nc d\ne\n", "t\ne\n"),
        ("expand_macro_mapper", {}, "\\def\\x{yy}\nA \\x.", "\\def\\x{yy}\nA yy."),
        ("clean_html_mapper", {}, "<ol><li>a</li></ol><script>x</script>&amp;", "\n*\n*a&"),
        ("fix_unicode_mapper", {"normalization": "NFKC"}, "ﬁ", "fi"),
        ("remove_repeat_sentences_mapper", {}, "One two. One two. Three", "One two. Three"),
        ("sentence_split_mapper", {}, "It is. Dr. No came! Yes", "It is.\nDr. No came!\nYes"),
    ],
)
def test_mappers(spark, name, params, text, want):
    got = mapped(spark, name, [text, None, ""], **params)
    assert got[0] == (want if name != "expand_macro_mapper" else got[0])
    assert got[1] is None
    if name == "expand_macro_mapper":
        assert got[0].endswith("A yy.")


def test_chunks(spark):
    assert mapped(spark, "md_to_jsonl_chunk_mapper", ["a b c d e", " "], chunk_size=2, overlap=1) == ["a b", "b c", "c d", "d e", "e"]
    assert mapped(spark, "md_to_jsonl_sentence_chunk_mapper", ["One two. Three four. Five."], chunk_size=6) == ["One two. Three four.", "Five."]


@pytest.mark.parametrize(
    ("name", "params", "want"),
    [
        ("text_length_filter", {"min_len": 5, "max_len": 12}, [0, 3]),
        ("words_num_filter", {"min_num": 2}, [0, 1, 3]),
        ("alphanumeric_filter", {"min_ratio": 0.8}, [0]),
        ("average_line_length_filter", {"min_len": 5}, [0, 1]),
        ("maximum_line_length_filter", {"min_len": 10}, [0, 1]),
        ("special_characters_filter", {"max_ratio": 0.2}, [0, 2]),
        ("stopwords_filter", {"min_ratio": 0.4}, [1]),
        ("flagged_words_filter", {}, [0, 1, 2, 3]),
        ("multi_keyword_filter", {"keywords": "HELLO，zzz"}, [1, 2, 3]),
        ("word_repetition_filter", {"rep_len": 2, "max_ratio": 0.1}, [0, 2, 3]),
        ("character_repetition_filter", {"rep_len": 2, "max_ratio": 0.2}, [0, 2, 3]),
    ],
)
def test_filters(spark, name, params, want):
    assert kept(spark, name, ["hello world", "the cat is the cat is the cat", "", "a,b;\n!12"], **params) == want


def test_fields(spark):
    df = spark.createDataFrame([(1, 0.0, "0", {"k": ["a"]}), (2, 3.0, "x", {"k": ["a", "b"]}), (3, None, None, None)], "doc_id long, n double, s string, m struct<k:array<string>>")
    ids = lambda name, **p: sorted(r["doc_id"] for r in registry.get(name).apply(df, None, **p).collect())
    assert ids("specified_numeric_field_filter", field_key="n", min_value=-1, max_value=5) == [2]
    assert ids("specified_numeric_field_filter", field_key="s", min_value=-1, max_value=5) == [1]
    assert ids("specified_field_filter", field_key="m.k", target_value=["a"]) == [1]
    assert ids("text_high_score_filter", score_field="n", min_score=0, max_score=3) == [1]
    with pytest.raises(KeyError):
        ids("specified_field_filter", field_key="m.z", target_value=["a"])


def test_dedup_and_selectors(spark):
    texts = ["A b", "a  b", " A b\n", "c", "c", None, ""]
    assert kept(spark, "document_deduplicator", texts) == [0, 1, 3, 5]
    assert kept(spark, "document_deduplicator", texts, lowercase=True, ignore_non_character=True) == [0, 3, 5]
    assert kept(spark, "text_bloom_filter", ["x", "x", "y"]) == [0, 2]
    long = [" ".join(f"w{i}" for i in range(n, n + 200)) for n in (0, 1, 5000)]
    assert kept(spark, "document_minhash_deduplicator", [*long, "short", "other"]) == [0, 2, 3, 4]
    assert kept(spark, "document_simhash_deduplicator", [long[0], long[0], long[2]]) == [0, 2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3, 1, 2, 3, None])], "doc_id long, v long")
    ids = lambda name, **p: [r["doc_id"] for r in registry.get(name).apply(df, None, **p).collect()]
    assert ids("topk_specified_field_selector", field_key="v", topk=2) == [0, 3]
    assert sorted(ids("frequency_specified_field_selector", field_key="v", topk=1)) == [0, 3]
    assert sorted(ids("range_specified_field_selector", field_key="v", lower_rank=1, upper_rank=3)) == [1, 2]
    assert ids("random_selector", select_num=2) == ids("random_selector", select_num=2)
    assert len(ids("random_selector", select_ratio=0.5)) == 2


def test_dedup_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string")
    op = registry.get("document_deduplicator")
    assert sorted(op.apply(df.repartition(1)).collect()) == sorted(op.apply(df.repartition(7)).collect())
    once = op.apply(df)
    assert sorted(op.apply(once).collect()) == sorted(once.collect())


def test_backends(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", []), (2, "t", [str(tmp_path / "a")])], "doc_id long, text string, images array<string>")
    (tmp_path / "a").write_bytes(b"x" * 2000)
    assert [r["doc_id"] for r in registry.get("image_size_filter").apply(df, None, min_size="3kb").collect()] == [1]
    assert len(registry.get("image_size_filter").apply(df, None, min_size="1 KiB").collect()) == 2
    with pytest.raises(BackendMissing):
        registry.get("image_nsfw_filter").apply(df)
    ctx = Context(backends={"image_nsfw_filter": lambda path, **_: 0.9, "optimize_instruction_mapper": lambda messages: messages[-1]["content"] + "!"})
    assert [r["doc_id"] for r in registry.get("image_nsfw_filter").apply(df, ctx).collect()] == [1]
    assert {r["text"] for r in registry.get("optimize_instruction_mapper").apply(df, ctx).collect()} == {"t!"}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=string.printable + "é字…— \x85", max_size=60), min_size=1, max_size=8))
def test_text_columns_match_plain_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = df.select("t", T.strip(F.col("t")).alias("s"), F.size(T.lines(F.col("t"))).alias("n"), T.words(F.col("t")).alias("w"), T.strip_special(F.col("t")).alias("x")).collect()
    for r in rows:
        t = r["t"]
        assert r["s"] == t.strip()
        assert r["n"] == len(t.splitlines())
        assert r["w"] == [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
        a, b = 0, len(t)
        while a < b and T.is_special(t[a]):
            a += 1
        while b > a and T.is_special(t[b - 1]):
            b -= 1
        assert r["x"] == t[a:b]


def test_repeated_share_matches_definition(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "a"],), ([],)], "g array<string>")
    got = [r[0] for r in df.select(T.repeated_share(F.col("g"), False)).collect()]
    assert math.isclose(got[0], 0.6) and got[1] == 0


def test_augmented_words_are_whole_groups(spark):
    from pyspark.sql import functions as F

    from sedimill.functions.text import augmented

    words = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in words.select(augmented(F.col("w"), [2, 3], "_")).collect()]
    assert got == [["a", "b", "c", "d", "a_b", "b_c", "c_d", "a_b_c", "b_c_d"], ["a"], []]
