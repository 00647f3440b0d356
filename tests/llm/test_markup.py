import numpy as np
import pytest

from siltstone.llm import markup


@pytest.fixture(scope="module")
def model():
    return markup.labeller()


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    m = markup.Labeller(markup.INPUTS, hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = rng.standard_normal((2, 4, markup.INPUTS)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = (rng.random((2, 4, len(markup.LABELS))) < 0.5).astype(float)

    def loss():
        p = np.clip(m.predict(x, mask), 1e-9, 1 - 1e-9)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask[:, :, None]).sum() / mask.sum())

    g = m.gradients(x, mask, y)
    for name in ("xf", "hb", "cf", "o", "q"):
        flat, at = m.p[name].reshape(-1), 1
        old = flat[at]
        flat[at] = old + 1e-4
        up = loss()
        flat[at] = old - 1e-4
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-4 - g[name].reshape(-1)[at]) < 2e-3


def test_held_out_accuracy(model):
    w, right, total = markup.Writer(77), 0, 0
    for _ in range(150):
        lines = w.document()
        found = markup.leaves("\n".join(x for x, _ in lines))
        if lines and len(found) == len(lines):
            p = markup.label(model, ["\n".join(x for x, _ in lines)])[0][1]
            y = np.array([[k in ls for k in markup.LABELS] for _, ls in lines])
            right, total = right + ((p > 0.5) == y).sum(), total + y.size
    assert right / total > 0.98


PROSE = "The reader waits for the lock and the writer holds it for a while.\nNobody expected the cache to skip 12 rows of the table.\n"


@pytest.mark.parametrize(
    "text,kinds",
    [
        (PROSE, []), ("* one thing\n* another thing that we need\n", []), (PROSE + "See C:\\temp\\file, C# and a < 3 & b > 4; it costs $5, not $9.", []),
        (PROSE + "It is <b>bold</b> here.", ["html"]), (PROSE + "Fish &amp; chips are in the house.", ["html"]), (PROSE + "## A heading of the text\n", ["markdown"]), (PROSE + "Call `run_all` to begin with that.", ["markdown"]),
        ("A title of it\n=============\n" + PROSE, ["markdown"]), (PROSE + "It links to [[Main page|the start]] of it.", ["wiki"]), (PROSE + "== Heading of it ==\n", ["wiki"]), (PROSE + "It is \\emph{very} important to us.", ["latex"]),
        (PROSE + "We know that $x_{1} \\le 4$ holds for that.", ["latex"]), ("```python\nx = '<b>' + y\nif [[ a ]]; then b\n```\n" + PROSE, ["markdown"]),
    ],
)
def test_kinds(model, text, kinds):
    assert markup.kinds_of(*markup.label(model, [text])[0]) == kinds


def test_clean(model):
    page = "<h2>Top</h2>\n<ul>\n  <li>one <b>bold</b> &amp; more</li>\n</ul>\n<pre><code>if a &lt; b:\n    return x[1]\n</code></pre>\n"
    assert markup.clean(*markup.label(model, [page])[0]) == "## Top\n- one bold & more\n```\nif a < b:\n    return x[1]\n```"
    note = "# Top\nSee [this page](./a.md) and **that** `code`.\n```\nx = y\n```\n- [x] done with it\n"
    assert markup.clean(*markup.label(model, [note])[0]) == "# Top\nSee this page and that code.\n```\nx = y\n```\n- done with it"
    tex = "\\subsection{Part of it}\n\\begin{itemize}\n  \\item We \\emph{hold} that $x_{1} \\le 4$ is so.\n\\end{itemize}\n"
    assert markup.clean(*markup.label(model, [tex])[0]) == "## Part of it\n- We hold that $x_{1} \\le 4$ is so."
    wiki = "=== Part of it ===\n* We see '''the''' [[Main page|start]] of it.\n"
    assert markup.clean(*markup.label(model, [wiki])[0]) == "### Part of it\n- We see the start of it."


def test_tables(spark, model):
    files = spark.createDataFrame([(1, "/a/x.MD", "t"), (2, "/a/x.py", "t"), (3, None, "t")], "file_id long, path string, text string")
    rows = [(1, 1, PROSE + "## Head of it\n", "k"), (2, 2, "## Head of it", "k"), (3, 1, None, "k"), (4, 1, "", "k"), (5, 3, "## x", "k"), (1, 1, PROSE + "## Head of it\n", "k"), (6, 1, "word " * 20000 + "&amp;", "k")]
    chunks = spark.createDataFrame(rows, "chunk_id long, file_id long, text string, kind string")
    assert sorted(tuple(r) for r in markup.chunk_kinds(files, chunks).collect()) == [(1, "markdown"), (6, "html")]
    clean = {r["chunk_id"]: r["text"] for r in markup.clean_chunks(files, chunks).collect()}
    assert set(clean) == {1, 3, 4, 6} and clean[3] is None and clean[4] == "" and clean[6].endswith("&")
    assert markup.chunk_kinds(files, chunks.limit(0)).count() == 0 and markup.chunk_kinds(files.limit(0), chunks).count() == 0


CODE = "```python\nx = run(a)[0]\n" + "y = x[[1]]\nz = '<b>' + y\n" * 3


def pieces(text, n, overlap=2):
    lines = text.split("\n")
    return [(k, at + 1, "\n".join(lines[at : at + n])) for k, at in enumerate(range(0, len(lines), n - overlap))]


@pytest.mark.parametrize("bucket", [2, 3, 1024])
def test_chunks_begin_in_what_is_open(spark, monkeypatch, bucket):
    monkeypatch.setattr(markup, "BUCKET", bucket)
    texts = {
        1: PROSE + CODE + "````\n" + "~~~\n" + PROSE + "~~~\n" + PROSE + "It links to [[Main page|the start]] of it.\n",
        2: "````\n```\n" + PROSE * 3 + "```\n````\n" + PROSE + "It is \\emph{very} important.\n" + "```run``` is a word\n" + PROSE * 3,
        3: PROSE + "<pre>\n" + "a < b\n" * 9 + "</pre>\n" + PROSE * 3 + "\\begin{verbatim}\n" + "x = y\n" * 9 + "\\end{verbatim}\n" + PROSE,
    }
    rows = [(100 * f + k, f, k, at, t) for f, text in texts.items() for k, at, t in pieces(text, 5)]
    df = spark.createDataFrame(rows + rows[:9], "chunk_id long, file_id long, ord int, start_line int, text string")
    state = {r["chunk_id"]: r["state"] for r in markup.seeds(df).collect()}
    assert set("".join(state.values())) == set("`~pv")
    for f, text in texts.items():
        whole, lines = markup.leaves(text), text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        for i, own, at, t in ((100 * f + k, f, at, t) for k, at, t in pieces(text, 5)):
            inside = [x for n, x in zip(full, whole, strict=True) if at - 1 <= n < at - 1 + len(t.split("\n"))]
            assert markup.leaves(t, state.get(i, "")) == inside, (own, at)


def test_pieces_of_one_line():
    rows = [{"start_line": a, "at": [0] * len(s), "sign": s} for a, s in ((1, ["+p"]), (1, ["```"]), (1, ["-p"]), (2, ["```."]))]
    assert markup.own_signs(rows) == [["+p"], [], ["-p"], ["```."]]


def test_effect_is_that_of_the_signs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        signs = list(rng.choice(["```", "```.", "````.", "`````.", "~~~.", "~~~~", "+p", "-p", "+v", "-v"], rng.integers(0, 9)))
        for state in ("", "p", "pv", "```", "````l", "``````p", "~~~~v"):
            assert markup.apply(markup.effect(signs), state) == markup.advance(state, signs)


def test_signs_after_an_orphan_fence(spark):
    text = PROSE + CODE + "```\n" + "It links to [[Main page|the start]] of it.\nFish &amp; chips are in the house.\n" + PROSE
    lines = text.split("\n")
    files = spark.createDataFrame([(1, "/a/x.md")], "file_id long, path string")
    chunks = spark.createDataFrame([(1, 1, 0, 1, "\n".join(lines[:8])), (2, 1, 1, 7, "\n".join(lines[6:]))], "chunk_id long, file_id long, ord int, start_line int, text string")
    assert {tuple(r) for r in markup.chunk_kinds(files, chunks).collect()} >= {(2, "wiki"), (2, "html")}
    clean = {r["chunk_id"]: r["text"] for r in markup.clean_chunks(files, chunks).collect()}
    assert clean[2].endswith("```\nIt links to the start of it.\nFish & chips are in the house.\n" + PROSE.strip())
