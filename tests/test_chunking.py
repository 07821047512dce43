import pytest
from tessera.functions.embed import hashed
from tessera.operators import chunking as C
from tessera.schema import chunk_errors


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def plain_windows(text, size, overlap):
    text, out, at = text.strip(), [], 0
    while text:
        out.append((text[at : at + size], at, min(len(text), at + size)))
        if at + size >= len(text):
            break
        at += size - overlap
    return out


TEXTS = ["a" * 25, "  padded  ", "", " \n ", None, "x", "".join(chr(97 + i % 26) for i in range(100)), "é🙂" * 20]


@pytest.mark.parametrize("size,overlap", [(10, 3), (1, 5), (30, 0), (10, 9), (0, -1)])
def test_fixed_size(spark, size, overlap):
    got = C.fixed_size(docs(spark, *TEXTS), size, overlap).orderBy("document_id", "chunk_index").collect()
    size = max(1, size)
    want = [(i, k, *w) for i, t in enumerate(TEXTS) if t for k, w in enumerate(plain_windows(t, size, min(max(0, overlap), size - 1)))]
    assert [tuple(r) for r in got] == want


def test_fixed_tokens_count_exactly(spark):
    from pyspark.sql import functions as F
    from tessera.functions.text import token_count

    for model, size in (("simple", 7), ("cl100k", 7), ("cl100k", 512)):
        got = C.fixed_tokens(docs(spark, "w" * 9000), size, 2, model)
        n = [r.n for r in got.orderBy("chunk_index").select(token_count(F.col("content"), model).alias("n")).collect()]
        assert set(n[:-1]) == {size} and n[-1] <= size


def test_overlap_there_and_back(spark):
    chunks = C.fixed_size(docs(spark, TEXTS[6], TEXTS[0]), 10, 0)
    wider = C.add_overlap(chunks, 4)
    rows = wider.orderBy("document_id", "chunk_index").collect()
    assert rows[1].content == TEXTS[6][6:20] and rows[1].start_offset == 6
    overlapped = C.fixed_size(docs(spark, TEXTS[6]), 10, 4)
    assert "".join(r.content for r in C.remove_overlap(overlapped).orderBy("chunk_index").collect()) == TEXTS[6]


def test_statistics_and_validation(spark):
    chunks = C.fixed_size(docs(spark, "a" * 25), 10, 0)
    assert tuple(C.statistics(chunks).first()) == (3, 25, 25 / 3, 5, 10, 10)
    assert tuple(C.statistics(chunks.where("chunk_index > 0")).first())[-1] == 7
    assert tuple(C.statistics(chunks.limit(0)).first()) == (0, 0, 0.0, 0, 0, 0)
    from pyspark.sql import functions as F

    assert chunk_errors(chunks.withColumn("chunk_id", F.col("chunk_index")), 9).count() == 2


def test_sentence():
    text = " ".join(f"This is sentence number {i}." for i in range(30))
    out = C.sentence(text, target=100, least=20, most=150, overlap=1)
    assert all(text[p.start : p.end] == p.content for p in out) and all(len(p.content) <= 130 for p in out)
    assert out[1].content.split(". ")[0] in out[0].content
    none = C.sentence(text, target=100, least=20, most=150, overlap=0)
    assert " ".join(p.content for p in none) == text
    assert C.sentence("  ") == [] and [p.content for p in C.sentence("x" * 5000)] == ["x" * 2000, "x" * 2000, "x" * 1000]
    assert C.sentence("Short one. " + "y" * 300 + ". End.", 50, 10, 100, 0)[1].content == "y" * 100
    # a short tail joins the chunk before it
    assert len(C.sentence("A long enough sentence goes here today. Tiny.", 40, 20, 200, 0)) == 1


def test_paragraph():
    text = "\n\n".join(f"Paragraph {i} has some words." for i in range(5))
    out = C.paragraph(text)
    assert [p.content.count("Paragraph") for p in out] == [3, 3] and out[1].content.startswith("Paragraph 2")
    assert all(text[p.start : p.end] == p.content for p in out)
    assert [p.content for p in C.paragraph("a" * 50 + "\n\n" + "b" * 50, size=60, overlap=0)] == ["a" * 50, "b" * 50]
    assert len(C.paragraph("a\n\nb\n\n" + "c" * 60 + "\n\n" + "d" * 70, keep_short=False, most=1, overlap=0)) == 2
    assert C.paragraph(" \n\n ") == []


def test_recursive():
    text = "First part, with a clause. Second part is here.\n\nNew block of text that is a bit longer than the rest, " + "z" * 80
    out = C.recursive(text, 40, 0)
    assert all(len(p.content) <= 40 for p in out) and "".join(p.content for p in out).count("z") == 80
    wide = C.recursive(text, 40, 10)
    assert len(wide) == len(out) and all(len(p.content) <= 50 for p in wide) and wide[1].start < out[1].start
    assert C.recursive("short", 40, 10) == [("short", 0, 5)] and C.recursive("") == []


def test_semantic():
    a = " ".join("The cat sat on the cat mat with a cat." for _ in range(6))
    b = " ".join("Stock markets fell sharply in heavy trading." for _ in range(6))
    out = C.semantic(f"{a} {b}", target=50, threshold=0.8, window=2)
    assert len(out) > 1 and not any("cat" in p.content and "heavy" in p.content for p in out[:1])
    assert C.semantic("One. Two.", window=3) == [("One. Two.", 0, 9)] and C.semantic(" ") == []
    assert hashed(["a b", "", "a b"]).tolist()[0] == hashed(["a b"]).tolist()[0]


MD = "# One\n\nIntro text.\n\n## Two\n\nBody.\n\n### Deep\n\nMore.\n\n```\n# not a header\n```\n\n## Three\n"


def test_markdown():
    out = C.markdown(MD)
    assert [p.content.split("\n")[0] for p in out] == ["# One", "## Two", "## Three"] and "# not a header" in out[1].content
    assert [p.content for p in C.markdown(MD, headers=False)][0] == "Intro text."
    assert len(C.markdown(MD, by_section=False)) == 1 and len(C.markdown(MD, level=3)) == 4
    long = "## Head\n\n" + "\n\n".join("p" * 30 for _ in range(9)) + "\n\n```\n" + "code line\n" * 8 + "```\n"
    parts = C.markdown(long, 120)
    assert all(len(p.content) <= 120 for p in parts) and parts[0].content.startswith("## Head") and sum("code line" in p.content for p in parts) == 1
    assert C.markdown("") == []


PY = "import os\nfrom sys import path\n\nX = 'a constant that is longer than twenty'\n\ndef one(a):\n    return a\n\ndef two(b):\n    return b\n"


def test_code():
    out = C.code(PY, "python")
    assert len(out) == 3 and all(p.content.startswith("import os\nfrom sys import path\n\n") for p in out[1:]) and "def two" in out[2].content
    assert [p.content.startswith("import") for p in C.code(PY, "python", imports=False)] == [True, False, False]
    sized = C.code("line of text here\n" * 40, size=200, by_function=False)
    assert "".join(p.content for p in sized) == ("line of text here\n" * 40).strip() and all(len(p.content) <= 200 for p in sized)
    big = C.code("def f(x):\n" + "    y = x + 1\n" * 60, "python", size=300)
    assert len(big) > 2 and all(len(p.content) <= 300 for p in big)
    assert C.code("  ") == []


@pytest.mark.parametrize(
    "text,extension,want",
    [
        ("x", "RS", "rust"),
        ("x", "tsx", "typescript"),
        ("plain words only", None, "unknown"),
        ("package main\n\nfunc main() {\n x := 1\n y := 2\n}", None, "go"),
        ("public class A { public static void main(String[] a) {} private int f(int x) {} }", None, "java"),
        ("def f(x):\n    pass\n", None, "python"),
        ("fn main() -> i32 { let mut x = 1; }", None, "rust"),
    ],
)
def test_language(text, extension, want):
    from tessera.operators.chunking.python import language_of

    assert language_of(text, extension) == want


def test_strategies_as_plans(spark):
    df = docs(spark, MD, None, "", "One. Two. Three.", PY)
    for name, f in C.STRATEGIES.items():
        got = C.chunk(df, name).orderBy("document_id", "chunk_index").collect()
        want = [(i, k, *p) for i, t in enumerate([MD, "", "", "One. Two. Three.", PY]) for k, p in enumerate(f(t) if t else ())]
        assert [tuple(r) for r in got] == want
    assert C.chunk(df.limit(0), "sentence").collect() == []
    assert C.chunk(df, "sentence", target=4, least=1, overlap=0).where("document_id = 3").count() == 3
