import base64
import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnloom.functions import metadata as md
from tarnloom.functions import text as tx
from tarnloom.operators import chunking as ch
from tarnloom.operators import headings as hd
from tarnloom.operators import quality_gate as qg
from tarnloom.session import config_path
from tarnloom.sources import connectors, files, layout
from tarnloom.sources.html import to_markdown
from tarnloom.sources.office import docx_segments


@settings(max_examples=150, database=None, deadline=None)
@given(st.text("ab. \n", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_chunks_of_any_text(text, size, overlap):
    spans = ch.split_spans(text, size, min(overlap, size - 1))
    assert all(0 <= b < e <= len(text) and e - b <= size for b, e in spans)
    assert all(text[b:e] == text[b:e].strip() for b, e in spans)
    assert spans == sorted(spans) and all(x[1] < y[1] for x, y in zip(spans, spans[1:], strict=False))
    covered = {i for b, e in spans for i in range(b, e)}
    assert all(c.isspace() or i in covered for i, c in enumerate(text))


def test_chunks_overlap_and_do_not_cross_segments(spark):
    text = "One sentence of some length here. " * 100
    docs = spark.createDataFrame([(1, [(text.strip(), 1, "A"), ("short", 2, None)]), (2, [])], f"id int, segments {files.SEGMENT_TYPE}")
    rows = ch.build_chunks(docs).orderBy("chunk_index").collect()
    body = text.strip() + "\n\nshort"
    assert [r.chunk_index for r in rows] == [*range(len(rows))]
    assert all(body[r.char_start : r.char_end] == r.content for r in rows)
    assert rows[-1].content == "short" and rows[-1].page == 2 and rows[0].section == "A"
    assert 3 <= len(rows) <= 7 and rows[1].char_start < rows[0].char_end
    assert [r.id for r in ch.without_chunks(docs).collect()] == [2]


def test_heading_segments(spark):
    text = "intro\n# One ##\nbody\r\n## \n### Two\n\n# " + "x" * 300 + "\n"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(hd.heading_segments(F.col("t")).alias("s")).collect()
    assert [(s.section and s.section[:5], s.text.split("\n")[0][:6]) for s in got[0].s] == [(None, "intro"), ("One", "# One "), ("Two", "### Tw"), ("xxxxx", "# xxxx")]
    assert len(got[0].s[3].section) == 255 and got[1].s == [] and not got[2].s


@pytest.mark.parametrize(
    ("text", "expected"),
    [("x 2024-03-15 y 2020-01-01", "2024-03-15"), ("el 5 de marzo 2021", "2021-03-05"), ("Mar 15 2024", "2024-03-15"), ("15 March, 2024", "2024-03-15"), ("30 February 2024", None), ("03/04/2024", None), ("2150-01-01", None), ("2024-13-45 then 2 May 2020", "2020-05-02"), ("", None), (None, None), ("a" * 3995 + " 2024-03-15", None)],
)
def test_dates(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(md.document_date(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("INVOICE NUMBER 5", "invoice"), ("private property, factura", "invoice"), ("photo: de: nobody", "email"), ("subject: x to: y cc: z invoice number", "email"), ("nothing of note in here", "other"), ("short", "other"), ("executive summary user manual", "manual")],
)
def test_doc_types(spark, text, expected):
    padded = text if text == "short" else text + " " + "." * 40
    assert spark.createDataFrame([(padded,)], "t string").select(md.doc_type(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize("bad", [{f"k{i}": 1 for i in range(11)}, {"": 1}, {"a": None}, {"a": [1]}, {"a": {"b": 1}}, {"a": "x" * 257}, {"a": float("nan")}])
def test_bad_filters(bad):
    with pytest.raises(md.InvalidFilter):
        md.validate_filter(bad)


def test_filters_are_strict_about_types(spark):
    rows = spark.createDataFrame([(1, {"n": "12"}), (2, {"n": '"12"'}), (3, {"n": "true"}), (4, {}), (5, None)], "id int, m map<string,string>")
    ids = lambda f: [r.id for r in rows.filter(md.contains(F.col("m"), f)).collect()]
    assert ids({"n": 12}) == [1] and ids({"n": 12.0}) == [1] and ids({"n": "12"}) == [2] and ids({"n": True}) == [3] and ids({}) == [1, 2, 3, 4, 5] and ids({"z": 1}) == []
    assert md.canonical_filter({"b": "é", "a": 1}) == '{"a":1,"b":"\\u00e9"}'


def test_html():
    html = "<html><head><title>T</title><style>p{}</style></head><body><h2>Head <b>x</b></h2><p>a&amp;b <a href='/u'>l</a></p><script>var t='</p>';</script><ul><li>one</li><li>two</li></ul><table><tr><td>1</td><td>2</td></tr></table></body></html>"
    assert to_markdown(html) == "T\n\n## Head **x**\n\na&b [l](/u)\n\n* one\n* two\n\n| 1 | 2 |"


def _docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx():
    content = _docx([("N", "before"), ("H1", "Head"), ("N", "a"), ("N", " "), ("N", "b"), ("Title", "Last")])
    assert [(s["section"], s["text"]) for s in docx_segments(content)] == [(None, "before"), ("Head", "Head\na\nb"), ("Last", "Last")]


def test_loading_by_format(spark):
    rows = [(1, b"# A\nx", "a.md", None), (2, b" ", "a.txt", None), (3, b"<h1>T</h1>", "p", "text/html"), (4, b"\xff\xfe ok", "b.txt", None), (5, b"", "x.zip", None), (6, b"broken", "x.docx", None), (7, _docx([("N", "d")]), "y.docx", None)]
    got = {r.id: r for r in files.load_strict(spark.createDataFrame(rows, "id int, content binary, filename string, content_type string")).collect()}
    assert got[1].segments[0].section == "A" and got[3].segments[0].section == "T" and got[7].segments[0].text == "d"
    assert got[2].error.startswith("No extractable") and got[5].error.startswith("Unsupported") and "BadZipFile" in got[6].error
    assert got[4].segments[0].text.endswith("ok") and got[4].error is None


def test_layout_and_escalation(spark):
    tree = {"blocks": [{"type": "heading-1", "text": "H", "page": 1, "blocks": [{"text": "in", "page": 1}]}, {"text": "next", "page": 2}, {"table": {"header": [[{"blocks": [{"text": "a\nb"}]}]], "rows": [[{"blocks": [{"text": "c"}]}]], "caption": "cap"}}]}
    assert layout.tree_segments(tree, 15) == [{"text": "H\n\nin", "page": 16, "section": "H"}, {"text": "next\n\ncap\n| a b |\n| --- |\n| c |", "page": 17, "section": "H"}]
    assert layout.halved(0, [9, 9, 9, 9], 20) == [(0, 2), (2, 2)] and layout.halved(3, [99], 20) == [(3, 1)]
    seg = lambda t: [(t, 1, None)] if t else []
    rows = [("good", b"x", "application/pdf", seg("y" * 100), None, 1), ("thin", b"x", "application/pdf", seg("y"), None, 20), ("empty", b"x", "application/pdf", [], None, 3), ("plain", b"x", "text/plain", [], None, None), ("long", b"x", "application/pdf", [], None, 900)]
    local = spark.createDataFrame(rows, f"id string, content binary, mime string, segments {files.SEGMENT_TYPE}, error string, page_count int")
    client = lambda content, kind: {"blocks": [{"text": "z" * 2000, "page": 1}]}
    got = {r.id: r for r in layout.extract_with_escalation(local, client, True).collect()}
    assert got["good"].method == "local" and got["thin"].method == layout.OCR_METHOD and got["empty"].error is None
    assert got["plain"].error.startswith("No extractable") and got["long"].error == "more than 500 pages"
    off = {r.id: r for r in layout.extract_with_escalation(local, None, False).collect()}
    assert "0 characters per page across 20 pages" in off["thin"].error and off["thin"].error.endswith(qg.REMEDY_DISABLED)


def test_long_scans_are_cut_and_batched(spark, tmp_path):
    """Parts of 15 pages, halved by bytes; page numbers of the whole document; the batch path joins shards by name and leaves nothing behind."""
    paged = lambda content, first, n: b"%d,%d" % (first, n)
    assert [(at, part) for at, part in layout.cut(b"x", "application/pdf", 40, paged)] == [(0, b"0,15"), (15, b"15,15"), (30, b"30,10")]
    heavy = lambda content, first, n: b"p" * 9 * n
    assert [at for at, _ in layout.cut(b"x" * 99, "application/pdf", 6, heavy, most=20)] == [0, 1, 3, 4] and [at for at, _ in layout.cut(b"x" * 99, "application/pdf", 1, heavy, most=5)] == [0]
    assert [at for at, _ in layout.cut(b"x" * 99, "text/html", 40, heavy, most=5)] == [0]
    rows = [("a", b"x", "application/pdf", [], None, 40), ("b", b"x", "application/pdf", [], None, 200), ("c", b"x", "application/pdf", [], None, None)]
    local = spark.createDataFrame(rows, f"id string, content binary, mime string, segments {files.SEGMENT_TYPE}, error string, page_count int")
    client = lambda content, kind: {"blocks": [{"text": content.decode() * 500, "page": 1}]}

    class Bucket:
        def put(self, name, content, kind):
            (tmp_path / name.replace("/", "~")).write_bytes(content)

        def names(self, prefix):
            return [p.name.replace("~", "/") for p in tmp_path.iterdir() if p.name.replace("~", "/").startswith(prefix)]

        def get(self, name):
            return (tmp_path / name.replace("/", "~")).read_bytes()

        def delete(self, name):
            (tmp_path / name.replace("/", "~")).unlink()

    def start(source, kind, target):
        def wait():
            for name, page in (("2.json", 102), ("10.json", 1), ("note.txt", 0)):
                Bucket().put(target + name, json.dumps({"blocks": [{"text": "z" * 20_000, "page": page}]}).encode(), kind)

        return wait

    got = {r.id: r for r in layout.extract_with_escalation(local, client, True, cutter=paged, batch=layout.batch_client(Bucket(), start), batch_pages=100).collect()}
    assert [(s.page, s.text[:4]) for s in got["a"].segments] == [(1, "0,15"), (16, "15,1"), (31, "30,1")] and [s.page for s in got["b"].segments] == [1, 102] and got["c"].segments[0].text.startswith("xx")
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(RuntimeError):
        layout.batch_client(Bucket(), lambda *a: lambda: None)(b"x", "application/pdf")
    assert list(tmp_path.iterdir()) == []


def test_sources_are_fetched_once(spark, tmp_path):
    """However many formats there are, each address is asked for once on its way to segments."""
    log = str(tmp_path / "asked")

    def fetch(uri):
        with open(log, "a") as f:
            f.write(f"{uri}\n")
        return connectors.Fetched(b"# T\ntext" if uri.endswith("md") else b"<h1>T</h1>", uri.rsplit("/", 1)[1], None)

    names = [f"https://h/{k}.{kind}" for k in range(5) for kind in ("md", "html", "txt", "zip", "docx")]
    fetched = connectors.fetch_sources(spark.createDataFrame([(n,) for n in names], "source string"), {"https": fetch}, 2)
    got = files.extract_local(fetched).collect()
    assert len(got) == 25 and sorted(open(log).read().split()) == sorted(names)
    assert all(bool(r.error) == r.source.endswith(("zip", "docx")) for r in got)


def test_drive():
    answers = {("1", "id,name,mimeType"): {"name": "Doc", "mimeType": "application/vnd.google-apps.document"}, ("2", "id,name,mimeType"): {"name": "a.pdf", "mimeType": "application/pdf"}, ("3", "id,name,mimeType"): {"mimeType": "application/vnd.google-apps.form"}}

    def get(url, query, headers):
        assert headers == {"Authorization": "Bearer t"}
        rest = url.removeprefix(connectors.DRIVE_FILES + "/").split("/")
        if rest[0] == "9":
            return 404, b""
        if "fields" in query:
            return 200, json.dumps(answers[rest[0], query["fields"]]).encode()
        return 200, f"{rest[1:]} {query.get('mimeType') or query['alt']}".encode()

    fetch = connectors.drive_connector(lambda: "t", get)
    assert fetch("gdrive://1") == connectors.Fetched(b"['export'] text/html", "Doc.html", "text/html")
    assert fetch("gdrive://2") == connectors.Fetched(b"[] media", "a.pdf", "application/pdf")
    for bad in ("gdrive://3", "gdrive://9"):
        with pytest.raises(connectors.FetchError):
            fetch(bad)
    with pytest.raises(connectors.FetchError):
        connectors.drive_connector(lambda: "t", get, most_bytes=3)("gdrive://2")
    with pytest.raises(connectors.NotConfigured):
        connectors.CONNECTORS["gdrive"]("gdrive://2")


def test_config_path(tmp_path, monkeypatch):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "key").touch()
    monkeypatch.chdir(tmp_path)
    assert config_path("", "/") == "" and config_path("/x/y", "/") == "/x/y" and config_path("key", tmp_path / "root") == str(tmp_path / "root" / "key")
    (tmp_path / "key").touch()
    assert config_path("key", tmp_path / "root") == str(tmp_path / "key") and config_path("none", "/") == str(tmp_path / "none")


def test_token_counter(spark, tmp_path):
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate([*(bytes([b]) for b in range(256)), b"ab", b"abc"])))
    rows = spark.createDataFrame([("abc ab",), ("",), (None,), ("é",)], "t string").select(tx.token_counter(str(tmp_path / "v"), r"\w+|\W+")("t").alias("n")).collect()
    assert [r.n for r in rows] == [3, 0, None, 2]


def test_connectors(spark):
    assert connectors.drive_plan("Doc", "application/vnd.google-apps.document") == ("export", "Doc.html", "text/html")
    assert connectors.drive_plan("a.pdf", "application/pdf") == ("download", "a.pdf", None)
    with pytest.raises(connectors.FetchError):
        connectors.drive_plan("x", "application/vnd.google-apps.form")
    with pytest.raises(connectors.FetchError):
        connectors.fetch_http("http://localhost/x")
    with pytest.raises(connectors.FetchError):
        connectors.fetch_http("https://127.0.0.1/x")
    assert connectors.response_filename("https://h/a%20b.pdf?x", None) == "a b.pdf" and connectors.response_filename("https://h/", 'attachment; filename="r.md"') == "r.md"
    fake = {"https": lambda u: connectors.Fetched(b"c", "f.txt", "text/plain")}
    got = {r.source: r for r in connectors.fetch_sources(spark.createDataFrame([("https://h/f",), ("upload://u/x",)], "source string"), fake, 2).collect()}
    assert bytes(got["https://h/f"].content) == b"c" and got["upload://u/x"].fetch_error == "no connector for upload://"
