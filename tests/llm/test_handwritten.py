import re

import pytest

from siltstone.llm import handwritten as h

HAND = "def add(a, b):\n    # Add two things.\n    if a > b:\n        return a + b\n    for x in range(b):\n        a += x * 2\n    log.debug('sum %s', a)\n    return a\n"


@pytest.mark.parametrize("pattern,path,hit", [("*.pb.go", "a/b/x.pb.go", True), ("gen/*.py", "gen/a.py", True), ("gen/*.py", "gen/sub/a.py", False), ("gen/*.py", "x/gen/a.py", False), ("gen/**", "gen/sub/a.py", True), ("**/gen/*.c", "x/gen/a.c", True), ("**/gen/*.c", "gen/a.c", True), ("/top.js", "top.js", True), ("/top.js", "a/top.js", False), ("[ab]?.c", "ax.c", True), ("[!ab]x.c", "ax.c", False), ("dir/", "dir/a", False)])
def test_globs(pattern, path, hit):
    r = h.glob_regex(pattern)
    assert bool(r and re.search(r, path)) == hit


def test_attribute_lines():
    text = "# c\n*.x linguist-generated\n*.y linguist-generated=false -linguist-vendored text\nlib/** linguist-vendored=true\nbare\n"
    assert h.attribute_lines(text) == [(1, "*.x", "generated", True), (2, "*.y", "generated", False), (2, "*.y", "vendored", False), (3, "lib/**", "vendored", True)]


def judge(spark, files):
    f = spark.createDataFrame([(i, p, 1, "x") for i, (p, _) in enumerate(files)], "file_id long, path string, bytes long, text string")
    c = spark.createDataFrame([(i, 1, t, "p") for i, (_, t) in enumerate(files) if t is not ...], "file_id long, start_line int, text string, path string")
    rows = {r["file_id"]: [k for k in ("vendored", "generated", "minified", "data") if r[k]] for r in h.judged(f, c).collect()}
    assert {r[0] for r in h.found(f, c).collect()} == {i for i, k in rows.items() if k}
    return [rows[i] for i in range(len(files))]


def test_contents_and_places(spark):
    accessors = "\n".join(f"  get_f{i}() {{ return this._f[{i}]; }}\n  set_f{i}(v) {{ this._f[{i}] = v; this._d |= {i}; }}" for i in range(12))
    numbers = "static float t[] = {\n" + "\n".join("  1.5, 2.25, 3, 0x1f," for _ in range(30)) + "\n};"
    blob = "X = '''\n" + "\n".join("Ab9/" * 15 for _ in range(20)) + "\n'''"
    cases = [
        ("/p/src/a.py", HAND, []), ("/p/src/b.py", "# Code generated by tool v1. DO NOT EDIT.\n" + HAND, ["generated"]),
        ("/p/src/c.py", "emit('// generated by ' + tool)\n# do not edit the order by hand\n# this was an auto-generated table; rewritten by hand\n" + HAND, []),
        ("/p/node_modules/x/README.MD", "# Read me", ["vendored"]), ("/p/vendor_portal/a.py", HAND, []), ("/p/docs/external_reviews/a.md", "text", []),
        ("/p/src/d.rs", "// Vendored from other 1.2, local changes: none.\nfn a() {}", ["vendored"]), ("/p/src/e.js", "function f(a){return a.b(a,34)};" * 60, ["minified"]),
        ("/p/src/f.c", numbers, ["generated", "data"]), ("/p/src/g.py", blob, ["generated", "data"]), ("/p/src/h.ts", accessors, ["generated"]), ("/p/data.csv", "1,2,3\n" * 30, []),
        ("/p/x.pb.go", HAND, ["generated"]), ("/p/Cargo.LOCK", "[[package]]", ["generated"]), ("/p/src/i.py", None, []), ("/p/src/j.py", "", []), ("/p/src/k.py", ..., []), (None, HAND, []),
        ("/p/src/code_generator.py", HAND, []), ("/p/notes.md", "This file was automatically generated by x", []), ("/p/src/l.py", "# Diese Datei wurde automatisch von x erzeugt.\n" + HAND, ["generated"]),
    ]
    assert judge(spark, [(p, t) for p, t, _ in cases]) == [w for *_, w in cases]


def test_attribute_files_decide(spark):
    attrs = "*.gen.py linguist-generated\nvendor/** -linguist-vendored\n"
    files = [
        ("/p/.gitattributes", attrs), ("/q/.gitattributes", "*.gen.py linguist-generated=true\n"), ("/p/a.gen.py", HAND), ("/p/sub/.gitattributes", "a.gen.py -linguist-generated\n"), ("/p/sub/a.gen.py", HAND),
        ("/p/vendor/x.py", HAND), ("/q/vendor/x.py", HAND), ("/r/b.gen.py", HAND), ("/p/a.py", HAND),
    ]
    # two directories declare *.gen.py, but a third takes one name back for itself only
    assert judge(spark, files) == [[], [], ["generated"], [], [], [], ["vendored"], ["generated"], []]


def test_empty(spark):
    f = spark.createDataFrame([], "file_id long, path string")
    c = spark.createDataFrame([], "file_id long, start_line int, text string")
    assert h.found(f, c).count() == 0


def test_statement_at_the_end(spark):
    body = "\n".join(f"let {'abcdefghij'[i % 10] * (1 + i % 7)} = {'run(' * (i % 5)}x{')' * (i % 5)};" + " y" * (i % 3) for i in range(60))
    rows = [(1, 1, body), (1, 61, "done();\n// Code generated by tool. DO NOT EDIT."), (2, 1, body), (2, 61, "done();\nlet s = 1; // it was generated by hand"), (3, 1, body), (3, 61, "// vendored from upstream")]
    told = {r["file_id"]: r for r in h.file_signs(spark.createDataFrame(rows, "file_id long, start_line int, text string")).collect()}
    assert [told[i]["generated"] for i in (1, 2, 3)] == [1, 0, 0] and [told[i]["foreign"] for i in (1, 2, 3)] == [0, 0, 1]


def test_patterns_are_mined_from_what_says_so(spark):
    """Directories and marks that no list names: files that say so speak for those that don't."""
    files = []
    for p in range(6):
        for n in range(4):
            files.append((f"/repo{p}/imported_stuff/lib{n}/x{p}{n}.py", "# Vendored from elsewhere 1.0\n" + HAND if n == 0 else HAND))
            files.append((f"/repo{p}/src/lib{n}/y{p}{n}.py", HAND))
        files.append((f"/repo{p}/src/api_stencil.rs", "// Code generated by stencil. DO NOT EDIT.\n" + HAND if p < 4 else HAND))
        files.append((f"/repo{p}/src/other_reader.rs", "// Code generated by hand-me-down. DO NOT EDIT.\n" + HAND if p == 0 else HAND))
    f = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(files)], "file_id long, path string")
    c = spark.createDataFrame([(i, 1, t) for i, (_, t) in enumerate(files)], "file_id long, start_line int, text string")
    held = {r["pattern"]: r for r in h.patterns(f, c).collect() if not r["usual"]}
    # what lies below imported_stuff counts for that alone; lib0 is a name of hand-written directories too
    assert set(held) == {"d:imported_stuff", "s:stencil"}
    assert (held["d:imported_stuff"]["fits"], held["d:imported_stuff"]["speak"]) == (24, 6)
    got = {files[r[0]][0] for r in h.found(f, c).collect()}
    assert got == {p for p, t in files if "imported_stuff" in p or "stencil" in p or "generated" in t}


def test_usual_names_can_be_refuted(spark, monkeypatch):
    monkeypatch.setattr(h, "REFUTED_FROM", 8)
    files = [(f"/p{i % 3}/external/a{i}.py", HAND) for i in range(9)]
    assert judge(spark, files) == [[]] * 9
    assert judge(spark, files[:7]) == [["vendored"]] * 7


def test_nested_attribute_files_and_an_undeclared_sibling(spark):
    files = [
        ("/a/.gitattributes", "*.tpl.js linguist-generated\n/deps/** linguist-vendored\n"), ("/a/deps/.gitattributes", "own/** -linguist-vendored\n"), ("/a/deps/own/x.js", HAND), ("/a/deps/y.js", HAND), ("/a/x.tpl.js", HAND),
        ("/b/.gitattributes", "**/deps/* linguist-vendored\n*.tpl.js linguist-generated\n"), ("/b/deps/y.js", HAND), ("/c/deps/z.js", HAND), ("/c/z.tpl.js", HAND), ("/c/src/z.js", HAND),
    ]
    assert judge(spark, files) == [[], ["vendored"], [], ["vendored"], ["generated"], [], ["vendored"], ["vendored"], ["generated"], []]
