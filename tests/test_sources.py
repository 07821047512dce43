import json

import pytest
from pyspark.sql import functions as F
from tessera.sources import parse
from tessera.sources.loaders import DEFAULTS, Loader, Registry, directory, html_table, load_csv, load_csv_rows, load_html, load_json, load_json_array, load_markdown, load_text, text_rows

HTML = """<!doctype HTML>
<html lang="en"><head><title>A &amp; B</title><meta name="author" content="Ann"><meta name="Description" content="d">
<meta property="og:type" content="page"><meta name="k" content="v"><style>p{}</style><script>var t="</p>";</script></head>
<body><nav><ul><li>menu</li></ul></nav><article class="main big" id="a1"><h1>Title</h1><p>One <b>bo</b>ld<br>two</p><aside>ad</aside></article><div>rest</div><footer>f</footer></body></html>"""


@pytest.mark.parametrize(
    "data,name,want",
    [("é".encode(), "utf-8", "é"), (b"\xef\xbb\xbfa", "utf-8", "a"), (b"\xff\xfe" + "é".encode("utf-16-le"), "utf-16-le", "é"), (b"\xfe\xff" + "é".encode("utf-16-be"), "utf-16-be", "é"), (b"\xe9", "latin-1", "é"), (b"", "utf-8", "")],
)
def test_encodings(data, name, want):
    assert parse.encoding_of(data) == name and parse.decode(data) == want


def test_front_matter():
    assert parse.front_matter("---\ntitle: T\nauthor : A: B\nempty:\n: x\n---\n\n body \n") == ({"title": "T", "author": "A: B"}, "body")
    assert parse.front_matter("---\nno end") == ({}, "---\nno end") and parse.front_matter(" text ") == ({}, " text ")


def test_page():
    content, found = parse.page(HTML)
    assert content == "Title One bold two rest" and found["title"] == "A & B" and found["author"] == "Ann"
    assert found["custom"] == {"description": "d", "og:type": "page", "k": "v"}
    assert parse.page(HTML, ("article",))[0] == "Title One bold two" and parse.page(HTML, (".big p", ".main", "#a1", "h1"))[0] == "Title One bold two Title One bold two Title"
    assert parse.page(HTML, excluded=())[0].startswith("menu") and parse.page("")[0] == "" and parse.page("<p>un<b>closed")[0] == "unclosed"


def test_json_values():
    value = {"data": {"items": [{"t": "x"}, 2, True, None, 1.5]}}
    assert [parse.as_text(parse.at_path(value, f"data.items.{i}")) for i in range(5)] == [json.dumps({"t": "x"}, indent=2), "2", "true", "", "1.5"]
    for path in ("data.none", "data.items.9", "data.items.x"):
        with pytest.raises(KeyError):
            parse.at_path(value, path)


@pytest.fixture()
def folder(tmp_path):
    files = {
        "a.txt": b"plain",
        "b.md": b"---\ntitle: T\nkind: note\n---\n# Head\n",
        "sub/c.html": HTML.encode(),
        "sub/d.json": json.dumps({"text": "t", "meta": {"title": "J", "n": 1}}).encode(),
        "sub/e.csv": b"x,y\n1,2\n",
        ".hidden/f.txt": b"no",
        "sub/.g.txt": b"no",
        "skip/h.txt": b"no",
        "i.bin": b"\x00",
        "draft-j.txt": b"draft",
    }
    for name, data in files.items():
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "docs")


def test_directory(spark, folder):
    got = {r.source: r for r in directory(spark, folder, excluded=["skip", "draft-*"]).collect()}
    assert set(got) == set("abcde") and got["a"].content == "plain" and got["e"].content == "x,y\n1,2\n"
    assert got["b"].title == "T" and json.loads(got["b"].custom) == {"kind": "note"} and got["b"].content == "# Head"
    assert got["c"].mime_type == "text/html" and got["c"].author == "Ann"
    assert {r.source for r in directory(spark, folder, extensions=[".TXT"]).collect()} == {"a", "h", "draft-j"}
    assert directory(spark, folder, Registry()).collect() == [] and len({r.doc_id for r in got.values()}) == 5


def test_registry():
    r = Registry.default()
    assert r.can_load("x/Y.HTM") and not r.can_load("x") and not r.can_load("a.zip") and not Registry().can_load("a.txt")
    mine = Loader(text_rows, (".TXT",), "text/mine")
    r.register(mine)
    assert r.for_path("a.txt") is mine and len({id(x) for x in DEFAULTS}) == 6


def test_single_loaders(spark, folder):
    assert load_text(spark, f"{folder}/a.txt").first().content == "plain"
    assert load_markdown(spark, f"{folder}/b.md", front_matter=False).first().content.startswith("---")
    assert load_html(spark, f"{folder}/sub/c.html", selectors=("h1",)).first().content == "Title"
    assert load_csv(spark, f"{folder}/sub/e.csv").first().source == "e"
    j = load_json(spark, f"{folder}/sub/d.json", content="text", metadata=("meta.title", "meta.n", "meta.none")).first()
    assert (j.content, j.title, j.custom) == ("t", "J", '{"n":"1"}')
    with pytest.raises(Exception, match="d.json"):
        load_json(spark, f"{folder}/sub/d.json", content="none").collect()


def test_json_array(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"t": "one"}, {"t": "two"}]))
    rows = load_json_array(spark, str(tmp_path / "l.json"), content="t").orderBy("doc_id").collect()
    assert [(r.content, json.loads(r.custom)["arrayIndex"]) for r in rows] == [("one", 0), ("two", 1)]


def test_csv_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('title,content,author\n"T ""1""","first, line\nsecond",A\n,,\nT2,c2\n')
    rows = load_csv_rows(spark, str(path), "content", ["author", "nope"]).collect()
    assert [(r.content, json.loads(r.custom)) for r in rows] == [("first, line\nsecond", {"author": "A"}), ("c2", {"author": ""})]
    whole = load_csv_rows(spark, str(path)).collect()
    assert whole[0].content == 'T "1",first, line\nsecond,A' and whole[0].source == "t" and len({r.doc_id for r in whole}) == 2
    path.write_text("1;2\n3;4\n")
    assert [r.content for r in load_csv_rows(spark, str(path), "1", header=False, separator=";").collect()] == ["2", "4"]
    with pytest.raises(ValueError):
        load_csv_rows(spark, str(path), "zzz")


def test_pdf_is_refused(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    with pytest.raises(Exception, match="PDF"):
        directory(spark, str(tmp_path)).collect()


def test_pages(spark, sf):
    rows = html_table(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(rows) == 50 and all(r.content and r.title and "track(" not in r.content for r in rows)
    assert html_table(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")).select(F.sum(F.length("content"))).first()[0] == 0
