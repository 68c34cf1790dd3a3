import io
import zipfile

import pytest

from quillspark.errors import RequestError, UnsupportedFormat
from quillspark.sources import extraction as x


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = {"[Content_Types].xml": "wordprocessingml", "word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>world</w:t></w:r></w:p></w:body></w:document>", "docProps/core.xml": "<c><title>T</title><creator>Me</creator></c>"}


def test_html():
    found = x.extract(b"<html><head><title>A &amp; B</title><meta name=author content=Me><style>p{}</style></head><body><h1>Hi</h1><p>one <b>two</b><script>no()</script></p><a href='/u'>link</a></body>after</html>")
    assert (found.title, found.author, found.text, found.links) == ("A & B", "Me", "Hi\none two\nlink", ["/u"])


def test_text_and_charsets():
    assert x.extract("é".encode(), name="a.txt").text == "é"
    assert x.extract("é".encode("cp1252"), name="a.txt").charset == "WINDOWS-1252"
    assert x.extract(b"abc", name="a.txt").charset == "ISO-8859-1"
    assert x.extract("\ufeffhi".encode("utf-16-le"), "text/plain").text == "hi"


def test_office():
    found = x.extract(archive(**DOCX))
    assert (found.kind, found.text, found.title, found.author) == ("docx", "Hello\nworld\n", "T", "Me")
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.0</v></c></row></sheetData></worksheet>'
    found = x.extract(archive(**{"[Content_Types].xml": "spreadsheetml", "xl/sharedStrings.xml": "<sst><si><t>x</t></si></sst>", "xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet}))
    assert found.text == "S\n\tx\t\t2\n\n\n"
    odt = '<o xmlns:text="urn:text"><text:h>Head</text:h><text:p>Para</text:p></o>'
    assert x.extract(archive(**{"mimetype": x.MIME["odt"], "content.xml": odt})).text == "HeadPara\n"
    slides = {f"ppt/slides/slide{i}.xml": f"<s xmlns:a='u'><a:t>s{i}</a:t></s>" for i in (10, 2)}
    assert x.extract(archive(**{"[Content_Types].xml": "presentationml", **slides})).text == "s2\n\n\ns10\n\n\n"


def test_rtf():
    assert x.extract(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9 \u8364?}").text == "Hello bold\ncafé €"


def test_refusals():
    for data in (b"%PDF-1.4", b"\xd0\xcf\x11\xe0", b"<?xml version='1.0'?><a/>", archive(a="b")):
        with pytest.raises(UnsupportedFormat):
            x.extract(data)
    with pytest.raises(RequestError):
        x.extract(archive(**DOCX), budget=x.Budget(max_chars=3))
    with pytest.raises(RequestError):
        x.extract(b"PK\x03\x04broken")
    bomb = DOCX | {"word/document.xml": "<a>" * 400 + "</a>" * 400}
    with pytest.raises(RequestError):
        x.extract(archive(**bomb))


def test_mapping():
    found = x.extract(b"<html><title>T</title><body>x<a href=u></a></body></html>")
    doc = x.map_fields(found, {"fmap.content": "body", "literal.id": "1", "uprefix": "attr_"}, {"body", "id", "title"})
    assert doc["body"] == "x" and doc["id"] == "1" and doc["attr_links"] == ["u"]
    assert x.extract_only(found, "text")["file"].startswith("\n" * 13)


def test_over_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive(**DOCX))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    rows = {r.path.rsplit("/")[-1]: r for r in x.extract_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["a.docx"].text == "Hello\nworld\n" and rows["b.pdf"].error
