"""Text from files: format detection, character sets, HTML, plain text, office formats and RTF, within budgets.

Everything here uses the standard library.  PDF has no reader here and is refused by type.
"""

from __future__ import annotations

import codecs
import io
import re
import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError, UnsupportedFormat

MIME = {"html": "text/html", "text": "text/plain", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "odt": "application/vnd.oasis.opendocument.text", "odp": "application/vnd.oasis.opendocument.presentation", "ods": "application/vnd.oasis.opendocument.spreadsheet", "rtf": "application/rtf", "pdf": "application/pdf"}
_BY_MIME = {v: k for k, v in MIME.items()} | {"application/xhtml+xml": "html", "text/rtf": "rtf", "text/csv": "text"}
_BY_ENDING = {"html": "html", "htm": "html", "xhtml": "html", "txt": "text", "md": "text", "csv": "text", **{k: k for k in ("docx", "pptx", "xlsx", "odt", "odp", "ods", "rtf", "pdf")}}


@dataclass
class Budget:
    """Limits of one extraction; each ``spend`` may refuse."""

    max_bytes: int = 32 << 20
    max_chars: int = 10_000_000
    seconds: float = 30.0
    max_entries: int = 4096
    max_entry_bytes: int = 128 << 20
    max_total_bytes: int = 512 << 20
    max_ratio: int = 200
    max_depth: int = 256
    max_events: int = 5_000_000
    max_sheets: int = 256
    max_cells: int = 1_000_000
    chars: int = 0
    events: int = 0
    total: int = 0
    began: float = field(default_factory=time.monotonic)

    def spend(self, chars: int = 0, events: int = 0) -> None:
        self.chars += chars
        self.events += events
        if self.chars > self.max_chars:
            raise RequestError("extracted text is too long")
        if self.events > self.max_events:
            raise RequestError("document has too many parts")
        if self.events % 1024 < max(events, 1) and time.monotonic() - self.began > self.seconds:
            raise RequestError("extraction took too long")


@dataclass
class Extracted:
    text: str
    title: str | None = None
    author: str | None = None
    links: list[str] = field(default_factory=list)
    kind: str = "text"
    charset: str | None = None

    @property
    def metadata(self) -> dict:
        found = {"Content-Type": MIME[self.kind] + (f"; charset={self.charset}" if self.charset else ""), "title": self.title, "Author": self.author}
        return {k: v for k, v in found.items() if v}


# ---------------------------------------------------------------- what it is


def detect(data: bytes, declared: str | None = None, name: str | None = None) -> str:
    """Signature, then the declared type, then the name's ending; archives are told apart by what lies in them."""
    head = data[:1024].lstrip()
    if data.startswith(b"%PDF-"):
        return "pdf"
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if data.startswith(b"PK\x03\x04"):
        return zip_kind(data)
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        raise UnsupportedFormat("old office formats are not read")
    low = head[:256].lower()
    if low.startswith((b"<!doctype html", b"<html")):
        return "html"
    kind = _BY_MIME.get((declared or "").split(";")[0].strip().lower())
    if kind:
        return kind
    kind = _BY_ENDING.get((name or "").rpartition(".")[2].lower())
    if kind:
        return kind
    if low.startswith(b"<?xml"):
        raise UnsupportedFormat("plain XML is not read")
    if b"<html" in low:
        return "html"
    if data and b"\0" not in data[:4096]:
        return "text"
    raise UnsupportedFormat("unknown format")


def zip_kind(data: bytes) -> str:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = set(archive.namelist())
        if "mimetype" in names:
            kind = _BY_MIME.get(archive.read("mimetype").decode("ascii", "replace").strip())
            if kind:
                return kind
        if "[Content_Types].xml" in names:
            types = archive.read("[Content_Types].xml")
            for mark, kind in ((b"wordprocessingml", "docx"), (b"presentationml", "pptx"), (b"spreadsheetml", "xlsx")):
                if mark in types:
                    return kind
    except (zipfile.BadZipFile, KeyError) as e:
        raise RequestError(f"broken archive: {e}") from None
    raise UnsupportedFormat("unknown archive")


def charset(data: bytes, declared: str | None = None) -> str:
    """Byte order mark, declared set, then what the first 64 KiB look like; plain ASCII is reported as ISO-8859-1."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if data.startswith(mark):
            return name
    if declared:
        try:
            return codecs.lookup(declared).name.upper()
        except LookupError:
            pass
    head = data[: 64 << 10]
    if head.isascii():
        return "ISO-8859-1"
    for cut in range(4 if len(data) > len(head) else 1):  # the cut may part a sign
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "WINDOWS-1252"


def decode(data: bytes, declared: str | None = None) -> tuple[str, str]:
    name = charset(data, declared)
    return data.decode(name.lower(), "replace").removeprefix("\ufeff"), name


# ---------------------------------------------------------------- HTML


class _Html(HTMLParser):
    SKIP = {"script", "style", "template", "noscript", "head"}
    BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "ul", "ol", "li", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "dl", "dt", "dd", "figure", "hr", "br", "address"}

    def __init__(self, budget: Budget) -> None:
        super().__init__(convert_charrefs=True)
        self.budget, self.out, self.links = budget, [], []
        self.title, self.author = None, None
        self.skip, self.in_title, self.done = 0, False, False

    def handle_starttag(self, tag, attrs):
        self.budget.spend(events=1)
        values = dict(attrs)
        if tag == "title":
            self.in_title, self.title = self.title is None, self.title or ""
        if tag == "meta" and (values.get("name") or "").lower() == "author":
            self.author = values.get("content")
        if tag == "body":
            self.skip = 0
        if tag in self.SKIP:
            self.skip += 1
        for k in ("href", "src"):
            if values.get(k):
                self.links.append(values[k])
        if values.get("alt") and not self.skip:
            self.add(values["alt"])
        if tag in ("br", "hr"):
            self.add("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag in self.BLOCK and not self.skip:
            self.add("\n")
        if tag == "body":
            self.done = True

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip and not self.done:
            self.add(data)

    def add(self, text: str) -> None:
        self.budget.spend(chars=len(text))
        self.out.append(text)


def html_text(text: str, budget: Budget | None = None) -> Extracted:
    parser = _Html(budget or Budget())
    parser.feed(text)
    parser.close()
    body = re.sub(r"[ \t\r\f\v]+", " ", "".join(parser.out))
    body = re.sub(r" ?\n ?", "\n", body)
    body = re.sub(r"\n{2,}", "\n", body).strip()
    return Extracted(body, (parser.title or "").strip() or None, parser.author, parser.links, "html")


# ---------------------------------------------------------------- office formats


def _part(archive: zipfile.ZipFile, name: str, budget: Budget) -> bytes:
    info = archive.getinfo(name)
    if info.file_size > budget.max_entry_bytes or info.file_size > budget.max_ratio * max(info.compress_size, 1) + 65536:
        raise RequestError(f"{name} unpacks to too much")
    budget.total += info.file_size
    if budget.total > budget.max_total_bytes:
        raise RequestError("archive unpacks to too much")
    return archive.read(name)


def _archive(data: bytes, budget: Budget) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise RequestError(f"broken archive: {e}") from None
    if len(archive.namelist()) > budget.max_entries:
        raise RequestError("archive has too many entries")
    if any(n.startswith("/") or ".." in n.split("/") for n in archive.namelist()):
        raise RequestError("archive has bad paths")
    return archive


def _events(data: bytes, budget: Budget) -> Iterator[tuple[str, ElementTree.Element]]:
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data[:65536]:
        raise RequestError("document types are not allowed in parts")
    depth = 0
    try:
        for what, node in ElementTree.iterparse(io.BytesIO(data), ("start", "end")):
            budget.spend(events=1)
            depth += 1 if what == "start" else -1
            if depth > budget.max_depth:
                raise RequestError("part is nested too deeply")
            yield what, node
    except ElementTree.ParseError as e:
        raise RequestError(f"broken part: {e}") from None


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _core(archive: zipfile.ZipFile, name: str, budget: Budget) -> tuple[str | None, str | None]:
    title = author = None
    if name in archive.namelist():
        for what, node in _events(_part(archive, name, budget), budget):
            if what == "end" and node.text:
                title = node.text if _local(node) == "title" else title
                author = node.text if _local(node) in ("creator", "initial-creator") and not author else author
    return title, author


def docx(data: bytes, budget: Budget) -> Extracted:
    archive, out, line = _archive(data, budget), [], []
    for what, node in _events(_part(archive, "word/document.xml", budget), budget):
        if what == "end":
            name = _local(node)
            if name == "t" and node.text:
                line.append(node.text)
            elif name in ("tab", "br"):
                line.append("\t" if name == "tab" else "\n")
            elif name == "p":
                out.append("".join(line) + "\n")
                budget.spend(chars=len(out[-1]))
                line = []
                node.clear()
    return Extracted("".join(out), *_core(archive, "docProps/core.xml", budget), kind="docx")


def pptx(data: bytes, budget: Budget) -> Extracted:
    archive, out = _archive(data, budget), []
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for _, name in slides:
        for what, node in _events(_part(archive, name, budget), budget):
            if what == "end" and _local(node) == "t" and node.text:
                out.append(node.text + "\n")
                budget.spend(chars=len(out[-1]))
        out.append("\n\n")
    return Extracted("".join(out), *_core(archive, "docProps/core.xml", budget), kind="pptx")


def odf(data: bytes, budget: Budget, kind: str) -> Extracted:
    """Text and presentations: headings of texts have no line feed of their own."""
    archive, out = _archive(data, budget), []
    for what, node in _events(_part(archive, "content.xml", budget), budget):
        if what == "end":
            name = _local(node)
            if name in ("p", "h") and "text" in node.tag:
                text = "".join(node.itertext())
                out.append(text + ("\n" if name == "p" else ""))
                budget.spend(chars=len(text))
            elif name == "page" and kind == "odp":
                out.append("\n")
    return Extracted("".join(out), *_core(archive, "meta.xml", budget), kind=kind)


def _cell(text: str) -> str:
    return str(int(float(text))) if re.fullmatch(r"-?\d+\.0+", text) else text


def _sheet(name: str, rows: list[list[str]]) -> str:
    while rows and not any(rows[-1]):
        rows.pop()
    return name + "\n" + "".join("\t" + "\t".join(r) + "\n" for r in rows) + "\n\n"


def xlsx(data: bytes, budget: Budget) -> Extracted:
    archive, shared, names = _archive(data, budget), [], []
    if "xl/sharedStrings.xml" in archive.namelist():
        for what, node in _events(_part(archive, "xl/sharedStrings.xml", budget), budget):
            if what == "end" and _local(node) == "si":
                shared.append("".join(t.text or "" for t in node.iter() if _local(t) == "t"))
    if "xl/workbook.xml" in archive.namelist():
        names = [n.get("name", "") for w, n in _events(_part(archive, "xl/workbook.xml", budget), budget) if w == "end" and _local(n) == "sheet"]
    sheets = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    if len(sheets) > budget.max_sheets:
        raise RequestError("workbook has too many sheets")
    out, cells = [], 0
    for i, (_, part) in enumerate(sheets):
        rows: list[list[str]] = []
        for what, node in _events(_part(archive, part, budget), budget):
            if what != "end" or _local(node) != "row":
                continue
            row: list[str] = []
            for c in node:
                cells += 1
                if cells > budget.max_cells:
                    raise RequestError("workbook has too many cells")
                found = re.match(r"[A-Z]+", c.get("r", ""))
                if found:
                    at = 0
                    for letter in found[0]:
                        at = at * 26 + ord(letter) - 64
                    if at > 16384:
                        raise RequestError("cell outside the sheet")
                    row += [""] * (at - 1 - len(row))
                value = next((x.text or "" for x in c if _local(x) == "v"), "")
                if c.get("t") == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                else:
                    value = _cell(value)
                row.append(value)
            rows.append(row)
            node.clear()
        out.append(_sheet(names[i] if i < len(names) else f"Sheet{i + 1}", rows))
        budget.spend(chars=len(out[-1]))
    return Extracted("".join(out), *_core(archive, "docProps/core.xml", budget), kind="xlsx")


def ods(data: bytes, budget: Budget) -> Extracted:
    archive, out, cells, sheets = _archive(data, budget), [], 0, 0
    rows: list[list[str]] = []
    row: list[str] = []
    for what, node in _events(_part(archive, "content.xml", budget), budget):
        name = _local(node)
        if what == "start" and name == "table":
            rows, sheets = [], sheets + 1
            if sheets > budget.max_sheets:
                raise RequestError("workbook has too many sheets")
        elif what == "start" and name == "table-row":
            row = []
        elif what == "end" and name == "table-cell":
            times = next((int(v) for k, v in node.attrib.items() if k.endswith("number-columns-repeated")), 1)
            text = "\n".join("".join(p.itertext()) for p in node if _local(p) == "p")
            times = times if text else min(times, 1)
            cells += times
            if cells > budget.max_cells:
                raise RequestError("workbook has too many cells")
            row += [_cell(text)] * times
        elif what == "end" and name == "table-row":
            rows.append(row)
        elif what == "end" and name == "table":
            label = next((v for k, v in node.attrib.items() if k.endswith("}name")), f"Sheet{sheets}")
            out.append(_sheet(label, rows))
            budget.spend(chars=len(out[-1]))
    return Extracted("".join(out), *_core(archive, "meta.xml", budget), kind="ods")


def rtf(data: bytes, budget: Budget) -> Extracted:
    """Control words and groups; tables of fonts, colours, styles and pictures are passed over."""
    text, out = data.decode("cp1252", "replace"), []
    skipped = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "filetbl", "listtable", "listoverridetable"}
    signs = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
    stack, hide, drop = [], False, 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", text):
        budget.spend(events=1)
        word, number, hexes, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(hide)
            if len(stack) > budget.max_depth:
                raise RequestError("document is nested too deeply")
        elif brace == "}":
            hide = stack.pop() if stack else False
        elif word in skipped or sign == "*":
            hide = True
        elif hide:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            drop = 1
        elif word in signs:
            out.append(signs[word])
        elif hexes:
            if drop:
                drop = 0
            else:
                out.append(bytes([int(hexes, 16)]).decode("cp1252", "replace"))
        elif sign:
            out.append({"~": "\xa0", "_": "-", "\\": "\\", "{": "{", "}": "}"}.get(sign, ""))
        elif plain:
            out.append(plain[drop:])
            drop = 0
        if out:
            budget.spend(chars=len(out[-1]))
    return Extracted("".join(out), kind="rtf")


def extract(data: bytes, declared: str | None = None, name: str | None = None, budget: Budget | None = None) -> Extracted:
    budget = budget or Budget()
    if len(data) > budget.max_bytes:
        raise RequestError("document is too large")
    kind = detect(data, declared, name)
    mark = re.search(r"charset=([\w-]+)", declared or "")
    if kind in ("html", "text"):
        if kind == "html" and not mark:
            mark = re.search(r"charset=[\"']?([\w-]+)", data[:2048].decode("latin-1"))
        text, found = decode(data, mark[1] if mark else None)
        out = html_text(text, budget) if kind == "html" else Extracted(text)
        budget.spend(chars=0 if kind == "html" else len(text))
        out.charset = found
        return out
    match kind:
        case "docx":
            return docx(data, budget)
        case "pptx":
            return pptx(data, budget)
        case "odt" | "odp":
            return odf(data, budget, kind)
        case "xlsx":
            return xlsx(data, budget)
        case "ods":
            return ods(data, budget)
        case "rtf":
            return rtf(data, budget)
    raise UnsupportedFormat(f"{kind} is not read here")


# ---------------------------------------------------------------- over tables


def extract_files(files: DataFrame) -> DataFrame:
    """path, text, title, author, kind, error of binary files (as ``spark.read.format('binaryFile')`` gives them).

    A file that is refused gives its row with the reason; the job goes on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    x = extract(bytes(content), name=path)
                    rows.append((path, x.text, x.title, x.author, x.kind, None))
                except RequestError as e:
                    rows.append((path, None, None, None, None, e.message))
            yield pd.DataFrame(rows, columns=["path", "text", "title", "author", "kind", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, title string, author string, kind string, error string")


def extract_html(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, title, text, n_links of a column of HTML."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [html_text(h) if h else Extracted("") for h in frame["html"]]
            yield pd.DataFrame({"key": frame["key"], "title": [x.title for x in found], "text": [x.text for x in found], "n_links": [len(x.links) for x in found]})

    out = pages.select(F.col(key).alias("key"), F.col(column).alias("html")).mapInPandas(run, "key long, title string, text string, n_links long")
    return out.withColumnRenamed("key", key)


def map_fields(found: Extracted, params: dict[str, str], known: set[str]) -> dict:
    """Extracted values as a document: names in small letters if asked, ``fmap.`` renamed, unknown ones with ``uprefix``
    or left out, ``literal.`` added."""
    prefix, default = params.get("uprefix", "ignored_"), {"a": "links", "div": "ignored_"}
    maps = default | {k[5:]: v for k, v in params.items() if k.startswith("fmap.")}
    raw = {"content": found.text, "title": found.title, "author": found.author, "a": found.links or None, "content_type": MIME[found.kind]}
    doc = {}
    for name, value in raw.items():
        if value is None:
            continue
        if params.get("lowernames") == "true":
            name = re.sub(r"\W", "_", name.lower())
        name = maps.get(name, name)
        if name not in known:
            if prefix == "ignored_":
                continue
            name = prefix + name
        doc[name] = value
    return doc | {k[8:]: v for k, v in params.items() if k.startswith("literal.")}


def extract_only(found: Extracted, form: str = "xml") -> dict:
    """The answer that only shows what was drawn from a file."""
    import html

    meta = "".join(f'<meta name="{html.escape(k)}" content="{html.escape(v)}"/>\n' for k, v in found.metadata.items())
    body = found.text if form == "text" else "".join(f"<p>{html.escape(line)}</p>\n" for line in found.text.split("\n") if line)
    text = "\n" * 13 + found.text if form == "text" else f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head>\n{meta}<title>{html.escape(found.title or "")}</title>\n</head>\n<body>{body}</body></html>\n'
    return {"file": text, "file_metadata": [x for k, v in found.metadata.items() for x in (k, [v])]}
