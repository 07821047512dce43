import pytest
from pyspark.sql import functions as F
from tessera.functions import segments as S
from tessera.functions import text as T


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,stop,want",
    [
        ("Hello, World! This is a TEST.", True, ["hello", "world", "test"]),
        ("Café résumé naïve", False, ["café", "résumé", "naïve"]),
        ("Swift5 iOS17 2024 abc123", True, ["swift5", "ios17", "2024", "abc123"]),
        ("", True, []),
        ("a b", True, []),
    ],
)
def test_tokenize(spark, text, stop, want):
    assert one(spark, T.tokenize(F.col("t"), stop_words=stop), text) == want


def test_stop_words():
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) and {"the", "there", "shall"} <= set(T.STOP_WORDS)


@pytest.mark.parametrize("score,low,high,want", [(5, 0, 10, 0.5), (5, 5, 5, 0.0), (5, 9, 1, 0.0)])
def test_normalize_score(spark, score, low, high, want):
    assert one(spark, T.normalize_score(*(F.lit(float(x)) for x in (score, low, high)))) == want


@pytest.mark.parametrize("text,want", [("Hello\r\n\r\nWorld", "Hello World"), ("  a \t b ", "a b"), ("", "")])
def test_normalize_whitespace(spark, text, want):
    assert one(spark, T.normalize_whitespace(F.col("t")), text) == want


def test_clean_for_embedding(spark):
    assert one(spark, T.clean_for_embedding(F.col("t")), "a\x00b\tc\x07\nd\x7f") == "ab c d"


@pytest.mark.parametrize("text,model,want", [("", "simple", 0), ("a", "simple", 1), ("a" * 8, "simple", 2), ("a" * 38, "cl100k", 10), ("a" * 3, "p50k", 1)])
def test_token_count(spark, text, model, want):
    assert one(spark, T.token_count(F.col("t"), model), text) == want == S.token_count(text, model)
    details = one(spark, T.count_details(F.col("t"), model), text)
    assert details.token_count == want and details.effective_ratio == (len(text) / want if want else 0)


def test_small_functions(spark):
    assert one(spark, T.estimate_characters(F.lit(10), "cl100k")) == 38
    assert one(spark, T.estimate_characters(F.lit(-1))) == 0
    assert one(spark, T.file_stem(F.lit("/a/b.c/d.e.txt"))) == "d.e"
    assert one(spark, T.term_frequency(F.lit("a"), F.split(F.lit("a b a"), " "))) == 2
    assert one(spark, T.preview(F.col("t"), 3), "abcdef") == "abc..." and one(spark, T.preview(F.col("t"), 6), "abcdef") == "abcdef"
    assert one(spark, T.sanitize_query(F.col("t"), 4), " a\x01bcdef ") == "abcd"
    assert one(spark, T.listed_lines(F.col("t")), "1. one\n\n- two\n* three\n four ") == "one two three four".split()
    assert one(spark, T.fill_template("{context} ? {query}", context=F.lit("c"), query=F.col("t")), "q") == "c ? q"
    assert one(spark, T.split_regex(F.col("t"), "\\d+"), "a1 b22c") == ["a", "b", "c"]
    assert one(spark, T.fits(F.col("t"), 1), "abcd") and one(spark, T.word_count(F.col("t")), " a  b ") == 2
    with pytest.raises(ValueError):
        T.fill_template("{context}", query=F.lit("q"))


@pytest.mark.parametrize("text", ["a\n\nb", "a\r\n\r\nb\r\rc", " a \n \n\n b\nc ", "", "\n\n"])
def test_paragraphs(spark, text):
    assert one(spark, T.paragraphs(F.col("t")), text) == S.paragraphs(text)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Smith went to the store. He bought milk.", ["Dr. Smith went to the store.", "He bought milk."]),
        ("Hello. How are you? Great! Let's go.", ["Hello.", "How are you?", "Great!", "Let's go."]),
        ("Pi is 3.14 and e is 2.71. Yes.", ["Pi is 3.14 and e is 2.71.", "Yes."]),
        ("Use e.g. this one. J. Doe agrees.", ["Use e.g. this one.", "J. Doe agrees."]),
        ("What?! No... Really.", ["What?!", "No...", "Really."]),
        ("no end", ["no end"]),
        ("  ", []),
    ],
)
def test_sentences(text, want):
    assert S.sentences(text) == want


def test_separators_and_merging():
    assert S.by_separators("a|b||c", [",", "|"]) == ["a", "b", "c"]
    assert S.by_separators("||", ["|"]) == [] and S.by_separators(" x ", ["|"]) == ["x"] and S.by_separators("", ["|"]) == []
    assert S.merge_small(["a", "bb", "cc", "d"], 4) == ["a bb", "cc d"]
    assert S.merge_small(["aaaa", "b"], 4) == ["aaaa b"] and S.merge_small(["a"], 4) == ["a"] and S.merge_small([], 4) == []


def test_split_to_fit():
    text = "one two three four five " + "x" * 50
    parts = S.split_to_fit(text, 3)
    assert all(S.token_count(p) <= 3 for p in parts) and "".join(parts).replace(" ", "") == text.replace(" ", "")
    assert S.split_to_fit("short", 10) == ["short"] and S.split_to_fit("", 3) == [] and S.split_to_fit("a", 0) == []
    words = " ".join(f"word{i}" for i in range(60))
    over = S.split_to_fit(words, 20, 5)
    assert len(over) > 3 and all(len(p) <= 80 for p in over) and {w for p in over for w in p.split()} >= set(words.split())
    assert S.split_to_fit("y" * 500, 10, 3)[0] == "y" * 40
