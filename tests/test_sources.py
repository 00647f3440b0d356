import io
import json
import os
import zipfile

import pytest

from siltstone.sources import corpus
from siltstone.sources.markup_text import ARCHIVE_BYTES, Archive, attribute, decode_entities, extract, html_text, sheet_text


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_entities():
    assert decode_entities("x &unknown; &gt;= y") == "x &unknown; >= y"
    assert decode_entities("&#90;&#x7a;&apos; &euro; &#xDFFF; &#88888888888; &quot") == "Zz' &euro; &#xDFFF; &#88888888888; &quot"
    assert decode_entities("&lt;hr&gt;&nbsp;&amp;amp;") == "<hr> &amp;"


def test_html_keeps_lines():
    page = '<body>\n<script type="m">\nwhile (i < n) i++\n</script>\n<style>\np > a {}\n</style><!-- 1 > 0\n-->\n<div id="t\nu">tea &gt; caf&#xe9;</div><li>x</li><li>y</li>\n'
    text = html_text(page)
    assert text.count("\n") == page.count("\n")
    assert [x for x in text.split("\n") if x] == ["tea > caféxy"]
    assert html_text("<em>cut<") == "cut" and html_text("b<!-- never closed") == "b" and html_text("b <styles>c") == "b c"
    assert html_text("u <STYLE>v</STYLE> w") == "u "


def test_notebook():
    cells = [
        {"cell_type": "markdown", "source": ["# T\n", "line"]}, {"cell_type": "code", "source": "  "},
        {"source": "print(1)\n", "outputs": [{"text": "1\n"}, {"data": {"image/png": "AAA", "text/plain": ["y" * 3000]}}, 3]},
    ]
    text = extract("/a/b.ipynb", json.dumps({"cells": cells}).encode())
    assert text.startswith("# Cell 1 (markdown)\n# T\nline\n\n# Cell 3 (cell)\nprint(1)\n# Output:\n1\n# Output:\n" + "y" * 2000 + "\n")
    assert "AAA" not in text
    assert extract("a.ipynb", b"[1, 2, 3]") is None and extract("a.ipynb", b"not json") is None


def test_office():
    cell = lambda x: f"<w:tc><w:p><w:t>{x}</w:t></w:p></w:tc>"
    doc = f"<w:document><w:p><w:r><w:t>Harbour</w:t><w:tab/><w:t>log</w:t></w:r></w:p><w:tbl><w:tr>{cell('Ship')}{cell('Berth')}</w:tr><w:tr>{cell('Petrel')}{cell('7')}</w:tr><w:tr>{cell('')}</w:tr></w:tbl></w:document>"
    assert extract("n.docx", zipped({"word/document.xml": doc})) == "Harbour\tlog\nShip\tBerth\nPetrel\t7\n"
    slides = {f"ppt/slides/slide{i}.xml": f"<p:sld><a:p><a:t>slide text {i}</a:t></a:p></p:sld>" for i in (1, 2, 10)}
    deck = extract("d.PPTX", zipped(slides | {"ppt/notesSlides/notesSlide1.xml": "<a:t>hidden</a:t>"}))
    assert [x for x in deck.split("\n") if x.startswith("#")] == ["# Slide 1", "# Slide 2", "# Slide 10"] and "hidden" not in deck
    assert sheet_text('<row><c><v>3.25</v></c><c t="s"><v>2</v></c></row><row><c/></row><row><c t="s"><v>0</v></c><c t="s"><v>7</v></c><c t="b"><v>1</v></c></row>', ["tern", "x", "auk"]) == "3.25\tauk\ntern\t1\n"
    book = {
        "xl/workbook.xml": '<sheets><sheet name="Q3 Notes" r:id="r2"/><sheet name="Lost" r:id="r9"/><sheet name="One" r:id="r1"/></sheets>',
        "xl/_rels/workbook.xml.rels": '<Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/>',
        "xl/worksheets/s1.xml": "<row><c><v>1.5</v></c></row>", "xl/worksheets/s2.xml": '<row><c t="inlineStr"><is><t>hi</t></is></c></row>',
    }
    assert extract("b.xlsx", zipped(book)) == "## Sheet: Q3 Notes\nhi\n\n## Sheet: One\n1.5\n\n"
    odp = '<draw:page draw:name="page1"><text:p>a</text:p></draw:page><draw:page draw:name="Plan"><text:p>b &amp; c</text:p></draw:page>'
    assert extract("d.odp", zipped({"content.xml": odp})) == "# Slide 1\na\n\n# Slide 2 (Plan)\nb & c\n"
    ods = '<table:table table:name="Costs"><table:table-row><table:table-cell><text:p>x</text:p><text:p>y</text:p></table:table-cell><table:table-cell/><table:table-cell><text:p>3</text:p></table:table-cell></table:table-row></table:table>'
    assert extract("d.ods", zipped({"content.xml": ods})) == "## Sheet: Costs\nx y\t\t3\n"
    assert attribute(" w:val='k' val = 'm &lt; n'", "val") == "m < n" and attribute(' other="1"', "val") is None


@pytest.mark.parametrize("path,content", [("a.docx", b"PK\x03\x04junk"), ("a.docx", zipped({"other.xml": "x"})), ("a.odt", b"plain"), ("a.xlsx", b""), ("a.ipynb", b'{"cells": 3}'), ("a.bin", b"abc\0def"), ("a.txt", b" \n "), ("a.txt", None), ("a.pdf", b"%PDF")])
def test_unreadable(path, content):
    assert extract(path, content) is None


def test_archives_have_a_budget():
    a = Archive(zipped({"one": "x" * 600, "two": "y" * 600}), 1000)
    assert len(a.read("one")) == 600 and a.read("two") is None
    assert extract("bomb.docx", zipped({"word/document.xml": "<w:t>" + "x" * (ARCHIVE_BYTES + 1)})) is None


def test_plain_text():
    assert extract("/a/b.rs", b"fn main() {}") == "fn main() {}"
    assert extract("/a/.html", b"<p>x") == "<p>x"
    assert extract("/a/b.txt", b"\xff ok") == "� ok"


def tree(tmp_path, files):
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_walk(tmp_path):
    tree(tmp_path, {"a.md": "x", ".hidden.md": "x", "build/b.md": "x", "sub/.gitignore": "*.log\n!keep.log\n/top.txt\nout/\n", "sub/x.log": "x", "sub/keep.log": "x", "sub/top.txt": "x", "sub/deep/top.txt": "x", "sub/out/y": "x", ".siltstone/z": "x", ".gitignore": "build/\n# c\n"})
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    found = {os.path.relpath(p, os.path.realpath(tmp_path)) for p in corpus.walk([str(tmp_path), str(tmp_path / "sub")])}
    assert found == {"a.md", "sub/keep.log", "sub/deep/top.txt"}


def test_excludes_of_repository_and_user(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    tree(tmp_path, {"c/a.md": "x", "c/a.tmp": "x", "c/keep.tmp": "x", "c/sub/b.bak": "x", "c/sub/b.md": "x", "c/.gitignore": "!keep.tmp\n", "c/.git/info/exclude": "*.bak\n", "home/.config/git/ignore": "*.tmp\n", "home/mine": "b.md\n"})
    found = lambda: {os.path.relpath(p, os.path.realpath(tmp_path / "c")) for p in corpus.walk([str(tmp_path / "c")])}
    assert found() == {"a.md", "keep.tmp", "sub/b.md"}
    (tmp_path / "home" / ".gitconfig").write_text("[core]\n\texcludesFile = ~/mine\n")
    assert found() == {"a.md", "a.tmp", "keep.tmp"}


def test_corpus_source(spark, tmp_path):
    tree(tmp_path, {"a.md": "hello", "empty.md": ""})
    rows = {os.path.basename(r["path"]): r for r in corpus.corpus(spark, [str(tmp_path)], 3).collect()}
    assert bytes(rows["a.md"]["content"]) == b"hello" and len(rows["a.md"]["hash"]) == 64
    assert rows["empty.md"]["hash"] is None and rows["empty.md"]["bytes"] == 0
