"""Text out of marked-up and office documents, as a person would see it.

Each reader takes the bytes of one file and returns text, or None where there is none to be had:
broken, encrypted, oversized or blank files. Nothing raises.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator

#: Bytes that the parts of one archive may unpack to, together.
ARCHIVE_BYTES = 32 << 20
#: Characters kept of one output of a notebook.
OUTPUT_CHARS = 2000
#: The semicolon of an entity stands at most this far from its ampersand.
ENTITY_WINDOW = 12
#: The named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = re.compile(r"&(?:(#[xX]?[0-9a-fA-F]+)|([a-z]+));")


def decode_entities(text: str) -> str:
    """Named entities of ``ENTITIES`` and numeric ones; anything else stays as written."""

    def one(m: re.Match) -> str:
        if len(m.group()) > ENTITY_WINDOW:
            return m.group()
        if m.group(2):
            return ENTITIES.get(m.group(2), m.group())
        digits = m.group(1)[1:]
        try:
            code = int(digits[1:], 16) if digits[:1] in "xX" else int(digits)
            return chr(code) if not 0xD800 <= code <= 0xDFFF else m.group()
        except (ValueError, OverflowError):
            return m.group()

    return _ENTITY.sub(one, text)


_SKIPPED = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?i:script)(?=[>\s]).*?(?:</script[^>]*(?:>|\Z)|\Z)"
    r"|<(?i:style)(?=[>\s]).*?(?:</style[^>]*(?:>|\Z)|\Z)"
    r"|<[^>]*(?:>|\Z)",
    re.S,
)


def html_text(page: str) -> str:
    """The page without markup, line for line: breaks within what is taken out stay.

    Comments end at ``-->``, scripts and styles at their (lower-case) closing tag, anything else
    that opens with ``<`` at the next ``>``. Entities are decoded afterwards.
    """
    return decode_entities(_SKIPPED.sub(lambda m: "\n" * m.group().count("\n"), page))


def html(content: bytes) -> str | None:
    return html_text(content.decode("utf-8", "replace"))


# ---- notebooks


def _joined(value) -> str:
    if isinstance(value, str):
        return value
    return "".join(x for x in value if isinstance(x, str)) if isinstance(value, list) else ""


def notebook(content: bytes) -> str | None:
    """Cells in order under a heading each, with the text outputs of code cells."""
    try:
        cells = json.loads(content)["cells"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return None
    if not isinstance(cells, list):
        return None
    out = []
    for number, cell in enumerate(cells, 1):
        source = _joined(cell.get("source")) if isinstance(cell, dict) else ""
        if not source.strip():
            continue
        kind = cell.get("cell_type")
        out.append(f"# Cell {number} ({kind if isinstance(kind, str) else 'cell'})\n{source.rstrip()}\n")
        for o in cell.get("outputs") or []:
            if not isinstance(o, dict):
                continue
            data = o.get("data") if isinstance(o.get("data"), dict) else {}
            shown = (_joined(o["text"]) if "text" in o else _joined(data.get("text/plain")))[:OUTPUT_CHARS]
            if shown.strip():
                out.append(f"# Output:\n{shown.rstrip()}\n")
        out.append("\n")
    return "".join(out)


# ---- archives of XML


class Archive:
    """The parts of a ZIP file, read against one budget of unpacked bytes."""

    def __init__(self, content: bytes, budget: int = ARCHIVE_BYTES) -> None:
        self.zip, self.left = zipfile.ZipFile(io.BytesIO(content)), budget

    def names(self) -> list[str]:
        return self.zip.namelist()

    def read(self, name: str) -> str | None:
        """A part's text; None if it is missing, encrypted, damaged or over the budget."""
        try:
            info = self.zip.getinfo(name)
            if info.file_size > self.left or info.flag_bits & 1:
                return None
            with self.zip.open(info) as f:
                data = f.read(self.left + 1)
        except (KeyError, RuntimeError, zipfile.BadZipFile, NotImplementedError, OSError, EOFError, ValueError):
            return None
        if len(data) > self.left:
            return None
        self.left -= len(data)
        return data.decode("utf-8", "replace")


_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[?!][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[^\s/>]+)(?P<attrs>[^>]*?)(?P<empty>/?)(?:>|\Z)|(?P<text>[^<]+)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?P<name>[^\s=\"'<>/]+)\s*=\s*(?P<quote>[\"'])(?P<value>.*?)(?P=quote)", re.S)


def scan(xml: str) -> Iterator[tuple[str, str, str]]:
    """``("open" | "close" | "text", name, attributes or text)``, without asking whether the document is well formed."""
    for m in _PIECE.finditer(xml):
        if m["text"] is not None:
            yield "text", "", m["text"]
        elif m["name"]:
            if m["close"]:
                yield "close", m["name"], ""
            else:
                yield "open", m["name"], m["attrs"]
                if m["empty"]:
                    yield "close", m["name"], ""


def attribute(attrs: str, name: str) -> str | None:
    return next((decode_entities(m["value"]) for m in _ATTRIBUTE.finditer(attrs) if m["name"] == name), None)


class Page:
    """Puts lines and tables together: paragraphs become lines, rows lines of cells between tabs."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.now: list[str] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None

    def write(self, text: str) -> None:
        self.now.append(text)

    def _taken(self) -> str:
        line, self.now = decode_entities("".join(self.now)).strip(), []
        return line

    def end_line(self) -> None:
        line = self._taken()
        if not line:
            return
        if self.cell is not None:
            self.cell.append(line)
        else:
            self.out.append(line)

    def begin_row(self) -> None:
        self.end_line()
        self.row = []

    def begin_cell(self) -> None:
        self._taken()
        self.cell = []

    def end_cell(self) -> None:
        self.end_line()
        if self.row is not None and self.cell is not None:
            self.row.append(" ".join(self.cell))
        self.cell = None

    def end_row(self) -> None:
        if self.row is not None and any(self.row):
            self.out.append("\t".join(self.row))
        self.row = self.cell = None

    def mark(self, heading: str) -> None:
        self.end_line()
        if self.out:
            self.out.append("")
        self.out.append(heading)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.out) + "\n" if self.out else ""


def _body(xml: str, paragraphs: set[str], rows: set[str], cells: set[str], tabs: set[str], words: set[str] | None) -> str:
    page, inside = Page(), 0
    for kind, name, value in scan(xml):
        if kind == "text":
            if words is None or inside:
                page.write(value)
        elif kind == "open":
            inside += words is not None and name in words
            if name in rows:
                page.begin_row()
            elif name in cells:
                page.begin_cell()
            elif name in tabs:
                page.write("\t")
        else:
            inside -= words is not None and name in words and inside > 0
            if name in paragraphs:
                page.end_line()
            elif name in cells:
                page.end_cell()
            elif name in rows:
                page.end_row()
    return page.text()


def docx(content: bytes) -> str | None:
    xml = Archive(content).read("word/document.xml")
    return None if xml is None else _body(xml, {"w:p", "w:br"}, {"w:tr"}, {"w:tc"}, {"w:tab"}, {"w:t"})


def pptx(content: bytes) -> str | None:
    """Slides by number; reading stops at the first that can't be read."""
    archive, out = Archive(content), []
    slides = sorted((int(m.group(1)), m.group()) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in archive.names()) if m)
    for number, name in slides:
        xml = archive.read(name)
        if xml is None:
            break
        out.append(f"# Slide {number}\n{_body(xml, {'a:p', 'a:br'}, {'a:tr'}, {'a:tc'}, {'a:tab'}, {'a:t'})}\n")
    return "".join(out)


def _relations(xml: str) -> dict[str, str]:
    found = ((attribute(a, "Id"), attribute(a, "Target")) for kind, name, a in scan(xml) if kind == "open" and name == "Relationship")
    return {i: t for i, t in found if i and t}


def _shared(xml: str) -> list[str]:
    out, item, inside = [], None, False
    for kind, name, value in scan(xml):
        if name == "si" and kind != "text":
            if kind == "open":
                item = []
            elif item is not None:
                out.append(decode_entities("".join(item)))
                item = None
        elif name == "t" and kind != "text":
            inside = kind == "open"
        elif kind == "text" and inside and item is not None:
            item.append(value)
    return out


def sheet_text(xml: str, shared: list[str]) -> str:
    """Rows as lines, the cells that hold something between tabs, by their stored values."""
    out, row, kind_of, inside, value = [], [], None, False, []
    for kind, name, text in scan(xml):
        if kind == "text":
            if inside:
                value.append(text)
        elif name == "row":
            if kind == "open":
                row = []
            elif row:
                out.append("\t".join(row))
                row = []
        elif name == "c":
            if kind == "open":
                kind_of, value = attribute(text, "t"), []
            else:
                shown = decode_entities("".join(value)).strip()
                if kind_of == "s":
                    shown = shared[int(shown)] if shown.isdigit() and int(shown) < len(shared) else ""
                if shown.strip():
                    row.append(shown.strip())
                value = []
        elif name in ("v", "t"):
            inside = kind == "open"
    return "".join(line + "\n" for line in out)


def xlsx(content: bytes) -> str | None:
    """Sheets in the workbook's order; one whose part isn't named is passed over, one that can't be read ends it."""
    archive = Archive(content)
    book, relations = archive.read("xl/workbook.xml"), archive.read("xl/_rels/workbook.xml.rels")
    if book is None or relations is None:
        return None
    targets, shared, out = _relations(relations), _shared(archive.read("xl/sharedStrings.xml") or ""), []
    for kind, name, a in scan(book):
        if kind != "open" or name != "sheet":
            continue
        target = targets.get(attribute(a, "r:id") or "")
        if target is None:
            continue
        xml = archive.read(target[1:] if target.startswith("/") else posixpath.normpath("xl/" + target))
        if xml is None:
            break
        out.append(f"## Sheet: {attribute(a, 'name') or ''}\n{sheet_text(xml, shared)}\n")
    return "".join(out)


def odf(content: bytes) -> str | None:
    """Text documents, presentations and spreadsheets of the open format."""
    xml = Archive(content).read("content.xml")
    if xml is None:
        return None
    page, slide = Page(), 0
    for kind, name, value in scan(xml):
        if kind == "text":
            page.write(value)
        elif kind == "open":
            if name == "draw:page":
                slide += 1
                own = attribute(value, "draw:name") or ""
                page.mark(f"# Slide {slide}" + (f" ({own})" if own and own.lower() != f"page{slide}" else ""))
            elif name == "table:table":
                page.mark(f"## Sheet: {attribute(value, 'table:name') or ''}")
            elif name == "table:table-row":
                page.begin_row()
            elif name in ("table:table-cell", "table:covered-table-cell"):
                page.begin_cell()
            elif name in ("text:tab", "text:s"):
                page.write("\t" if name == "text:tab" else " ")
        elif name in ("text:p", "text:h", "text:line-break"):
            page.end_line()
        elif name in ("table:table-cell", "table:covered-table-cell"):
            page.end_cell()
        elif name == "table:table-row":
            page.end_row()
    return page.text()


def pdf(content: bytes) -> str | None:
    """Only where a reader for it is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


READERS: dict[str, Callable[[bytes], str | None]] = {
    "ipynb": notebook, "html": html, "htm": html, "docx": docx, "pptx": pptx, "xlsx": xlsx, "odt": odf, "odp": odf, "ods": odf, "pdf": pdf,
}


def extract(path: str, content: bytes | None) -> str | None:
    """Text of a file by its extension; otherwise as UTF-8 unless its beginning holds a zero byte."""
    if not content:
        return None
    name = path.rsplit("/", 1)[-1]
    ext = name.rpartition(".")[2].lower() if "." in name.lstrip(".") else ""
    try:
        reader = READERS.get(ext)
        if reader:
            text = reader(content)
        else:
            text = None if b"\0" in content[:8192] else content.decode("utf-8", "replace")
    except Exception:  # a file that breaks its reader is a file without text
        return None
    return text if text and text.strip() else None
