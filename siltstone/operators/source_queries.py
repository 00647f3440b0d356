"""Queries of the document readers, the store, fleets and change streams, with their SQL.

The documents of the test tables are written as files of every format into the shared folder and read
back through the readers; stores are made of them, changed and indexed again. What a session has
written or indexed for a data directory serves all its queries.
"""

from __future__ import annotations

import io
import json
import os
import zipfile
from html import escape
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars
from siltstone.functions.filters import Filter
from siltstone.operators.queries import CHUNK_SQL
from siltstone.plans.tables import once, own_folder, table
from siltstone.service import Service
from siltstone.sources import corpus
from siltstone.sources.fleet import Fleet
from siltstone.sources.markup_text import extract
from siltstone.sources.store import Store

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _once(make):
    """Made once for a session and data directory."""
    return lambda spark, d: once(spark, (make.__name__, d), lambda: make(spark, d))


def _local(spark: SparkSession, name: str) -> str:
    """A folder of the session as a path of the file system that executors share."""
    return os.path.realpath(urlparse(own_folder(spark, name)).path)


def _write(rows: DataFrame, root: str) -> None:
    """Write ``rows(name, content)`` as files below ``root``, on the executors; a null content removes the file."""

    def put(batches):
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                path = os.path.join(root, name)
                if content is None:
                    os.unlink(path)
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one number


# ---- readers


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _formats(doc: int, text: str, lang: str | None, source: str | None) -> dict[str, bytes]:
    """One document in every format that is read."""
    lines, cells = text.split("\n"), [str(doc), source or "", lang or ""]
    page = "<html>\n<script>if (a < b) { s = '</p>' }</script><!-- x > y -->\n<p class=\"t\">" + "</p>\n<p>".join(escape(x, quote=False) for x in lines) + "</p>\n"
    book = {"cells": [{"cell_type": "markdown", "source": [x + "\n" for x in lines]}, {"cell_type": "code", "source": "show()", "outputs": [{"data": {"text/plain": text, "image/png": "A"}}]}, {"cell_type": "raw", "source": " "}]}
    table_row = "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in cells)
    word = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{escape(x)}</w:t></w:r></w:p>" for x in lines) + f"<w:tbl><w:tr>{table_row}</w:tr></w:tbl>"
    slides = {f"ppt/slides/slide{n}.xml": f"<p:sld><a:p><a:r><a:t>{escape(c)}</a:t></a:r></a:p></p:sld>" for n, c in zip((1, 10, 2), cells, strict=True)}
    shared = "".join(f"<si><t>{escape(c)}</t></si>" for c in cells[1:])
    sheet = f'<row><c><v>{doc}</v></c><c t="s"><v>0</v></c><c t="inlineStr"><is><t>{escape(cells[2])}</t></is></c></row><row><c t="s"><v>1</v></c></row>'
    return {
        "txt": text.encode(), "html": page.encode(), "ipynb": json.dumps(book).encode(), "docx": _zipped({"word/document.xml": f"<w:document><w:body>{word}</w:body></w:document>"}), "pptx": _zipped(slides),
        "xlsx": _zipped({"xl/workbook.xml": f'<sheets><sheet name="S{doc} &amp; co" r:id="r1"/><sheet name="gone" r:id="r2"/></sheets>', "xl/_rels/workbook.xml.rels": '<Relationship Id="r1" Target="worksheets/s.xml"/>', "xl/sharedStrings.xml": f"<sst>{shared}</sst>", "xl/worksheets/s.xml": sheet}),
        "odt": _zipped({"content.xml": "".join(f"<text:p>{escape(x)}</text:p>" for x in lines)}),
    }


@_once
def _shelf(spark, d) -> str:
    """The folder with all documents in all formats."""
    root = _local(spark, "shelf")

    def put(batches):
        for b in batches:
            names, contents = [], []
            for doc, text, lang, source in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang", "source")), strict=True):
                for ext, content in _formats(doc, text, lang, source).items():
                    names.append(f"{ext}/{doc}.{ext}")
                    contents.append(content)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

    _write(table(spark, d, "documents").where("text is not null").select("doc_id", "text", "lang", "source").mapInArrow(put, "name string, content binary"), root)
    return root


def _read(spark, d, ext: str) -> DataFrame:
    """``doc_id, text`` as the readers have it, and ``bytes, hash``."""

    def texts(batches):
        for b in batches:
            found = [extract(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("bytes"), b.column("hash"), pa.array(found, pa.string())], ["path", "bytes", "hash", "text"])

    rows = corpus.corpus(spark, [f"{_shelf(spark, d)}/{ext}"]).mapInArrow(texts, "path string, bytes long, hash string, text string")
    return rows.withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long"))


_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _end(x: str) -> str:
    return f"regexp_replace({x}, '{_BLANK}+$', '')"


_SOME = f"regexp_replace(text, '{_BLANK}', '', 'g') <> ''"
_ESCAPED_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, strlen(text) AS bytes, CASE WHEN text <> '' THEN sha256(text) END AS hash, CASE WHEN {_SOME} THEN text END AS text FROM documents WHERE text IS NOT NULL")
def read_text(spark, d):
    """Every document as a plain file: size, digest and text. Empty files have neither digest nor text."""
    return _read(spark, d, "txt").select("doc_id", "bytes", "hash", "text")


@query(f"SELECT doc_id, CASE WHEN {_SOME} THEN chr(10) || chr(10) || text || chr(10) END AS text FROM documents WHERE text IS NOT NULL")
def read_html(spark, d):
    """HTML without tags, scripts and comments, line for line, entities decoded."""
    return _read(spark, d, "html").select("doc_id", "text")


@query(f"""
SELECT doc_id, CASE WHEN {_SOME} THEN '# Cell 1 (markdown)' || chr(10) || {_end('text')} || chr(10) || chr(10) ELSE '' END || '# Cell 2 (code)' || chr(10) || 'show()' || chr(10)
       || CASE WHEN regexp_replace(substring(text, 1, 2000), '{_BLANK}', '', 'g') <> '' THEN '# Output:' || chr(10) || {_end('substring(text, 1, 2000)')} || chr(10) ELSE '' END || chr(10) AS text
FROM documents WHERE text IS NOT NULL
""")
def read_notebook(spark, d):
    """Cells under headings with what code cells put out, cut at 2,000 characters; blank cells and pictures left out."""
    return _read(spark, d, "ipynb").select("doc_id", "text")


_CELLS = f"{_strip('coalesce(source, chr(32))')} AS s, {_strip('coalesce(lang, chr(32))')} AS l"


@query(f"""
SELECT doc_id, 'docx' AS format, array_to_string(list_append({_ESCAPED_LINES}, doc_id || chr(9) || s || chr(9) || l), chr(10)) || chr(10) AS text FROM (SELECT *, {_CELLS} FROM documents WHERE text IS NOT NULL)
UNION ALL SELECT doc_id, 'odt', CASE WHEN len({_ESCAPED_LINES}) > 0 THEN array_to_string({_ESCAPED_LINES}, chr(10)) || chr(10) END FROM documents WHERE text IS NOT NULL
""")
def read_paragraphs(spark, d):
    """Word and open document texts: paragraphs as lines, a table's row as a line of cells."""
    one = lambda ext: _read(spark, d, ext).select("doc_id", F.lit(ext).alias("format"), "text")
    return one("docx").unionByName(one("odt"))


@query(f"SELECT doc_id, '## Sheet: S' || doc_id || ' & co' || chr(10) || array_to_string(list_filter([doc_id::VARCHAR, s, l], lambda x: x <> ''), chr(9)) || chr(10) || CASE WHEN l <> '' THEN l || chr(10) ELSE '' END || chr(10) AS text FROM (SELECT *, {_CELLS} FROM documents WHERE text IS NOT NULL)")
def read_sheets(spark, d):
    """Workbooks by stored values, shared and inline strings; a sheet without a part is passed over."""
    return _read(spark, d, "xlsx").select("doc_id", "text")


@query(f"""
SELECT doc_id, '# Slide 1' || chr(10) || doc_id || chr(10) || chr(10) || '# Slide 2' || chr(10) || CASE WHEN l <> '' THEN l || chr(10) ELSE '' END || chr(10) || '# Slide 10' || chr(10) || CASE WHEN s <> '' THEN s || chr(10) ELSE '' END || chr(10) AS text
FROM (SELECT *, {_CELLS} FROM documents WHERE text IS NOT NULL)
""")
def read_slides(spark, d):
    """Presentations, their slides by number."""
    return _read(spark, d, "pptx").select("doc_id", "text")


@query("SELECT doc_id, text AS decoded, text <> '' AND strlen(text) < 8192 OR text = '' AS zero_seen, false AS zero_in_text FROM documents WHERE text IS NOT NULL")
def decode_bytes(spark, d):
    """Bytes as text, and whether a zero byte behind the text is among the first 8,192 bytes."""
    raw = F.encode("text", "UTF-8")
    return table(spark, d, "documents").where("text is not null").select("doc_id", scalars.utf8_lossy(raw).alias("decoded"), scalars.is_binary(F.concat(raw, F.lit(bytearray(b"\0")))).alias("zero_seen"), scalars.is_binary(raw).alias("zero_in_text"))


# ---- stores




@_once
def _store(spark, d) -> tuple[Store, list[tuple]]:
    """A store of all documents, indexed, and indexed again after German ones were edited and the handbook was removed."""
    docs = table(spark, d, "documents").where("text is not null")
    name = F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md"))
    root = _local(spark, "notes")
    _write(docs.select(name.alias("name"), F.encode("text", "UTF-8").alias("content")), root)
    store = Store(spark, _local(spark, "store") + "/own")
    first = store.index([root])
    _write(docs.where("source = 'handbook'").select(name.alias("name"), F.lit(None).cast("binary").alias("content")), root)
    edited = docs.where("lower(lang) = 'de' and coalesce(source, '') <> 'handbook'")
    _write(edited.select(name.alias("name"), F.encode(F.concat("text", F.lit("\nedited\n")), "UTF-8").alias("content")), root)
    second = store.index([root])
    return store, [(n, r.scanned, r.indexed, r.unchanged, r.skipped, r.removed, r.chunks) for n, r in ((1, first), (2, second))]


_BEFORE = "docs AS (SELECT doc_id, text, lang, source FROM documents WHERE text IS NOT NULL)"
_AFTER = "docs AS (SELECT doc_id, CASE WHEN lower(lang) = 'de' THEN text || chr(10) || 'edited' || chr(10) ELSE text END AS text FROM documents WHERE text IS NOT NULL AND coalesce(source, '') <> 'handbook')"
_AFTER_CHUNKS = CHUNK_SQL.replace("WITH RECURSIVE ", f"WITH RECURSIVE {_AFTER}, ", 1).replace("FROM documents", "FROM docs").replace("FROM docs WHERE text IS NOT NULL AND coalesce", "FROM documents WHERE text IS NOT NULL AND coalesce")


def _doc_id(path: str = "path"):
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")


@query(f"""
WITH RECURSIVE {_AFTER}, was AS (SELECT doc_id, text, coalesce(source, '') = 'handbook' AS gone, coalesce(lower(lang) = 'de', false) AS edited, {_SOME} AS has_text FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS all_1, count(*) FILTER (has_text) AS ok_1, count(*) FILTER (NOT gone) AS all_2, count(*) FILTER (NOT gone AND edited) AS ok_2, count(*) FILTER (NOT gone AND NOT edited AND has_text) AS same_2,
      count(*) FILTER (NOT gone AND NOT edited AND NOT has_text) AS skip_2, count(*) FILTER (gone AND has_text) AS removed_2 FROM was)
SELECT 1 AS run, all_1 AS scanned, ok_1 AS indexed, 0 AS unchanged, all_1 - ok_1 AS skipped, 0 AS removed FROM n UNION ALL SELECT 2, all_2, ok_2, same_2, skip_2, removed_2 FROM n
""")
def store_reports(spark, d):
    """What two runs report: the second reads again what was edited, and drops what is gone."""
    return spark.createDataFrame(_store(spark, d)[1], "run int, scanned long, indexed long, unchanged long, skipped long, removed long, chunks long").drop("chunks")


@query(f"WITH {_AFTER} SELECT doc_id, strlen(text) AS bytes, '1:' || sha256(text) AS hash FROM docs WHERE {_SOME}")
def store_files(spark, d):
    """The files that the store has after both runs."""
    return _store(spark, d)[0].files().select(_doc_id().alias("doc_id"), "bytes", "hash")


@query(_AFTER_CHUNKS + "SELECT doc_id, ord, start_line, end_line, text FROM final")
def store_chunks(spark, d):
    """The live chunks after both runs."""
    store = _store(spark, d)[0]
    return store.table("chunks").join(store.sent_whole(store.files().select("file_id", _doc_id().alias("doc_id"))), "file_id").select("doc_id", "ord", "start_line", "end_line", "text")


_WORDS_OF = r"""regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"""


@query(_AFTER_CHUNKS + f", toks AS (SELECT doc_id, ord, unnest({_WORDS_OF}) AS term FROM final) SELECT term, count(DISTINCT (doc_id, ord)) AS chunks, count(*) AS occurrences FROM toks GROUP BY term")
def store_words(spark, d):
    """The inverted index of the live chunks."""
    return _store(spark, d)[0].table("postings").groupBy("term").agg(F.count("*").alias("chunks"), F.sum(F.size("positions")).alias("occurrences"))


@query(_AFTER_CHUNKS + ", f AS (SELECT doc_id, text FROM docs WHERE " + _SOME + ") SELECT (SELECT count(*) FROM f) AS files, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM f) AS bytes, (SELECT count(*) FROM final) AS chunks, (SELECT count(*) FROM final) AS vectors, (SELECT count(*) FROM final) AS of_unit_length")
def store_counts(spark, d):
    """Files, bytes, chunks and vectors of the store."""
    from siltstone.operators.vectors import norm

    store = _store(spark, d)[0]
    s = store.stats()
    unit = store.table("vectors").where((F.abs(norm(F.col("embedding")) - 1) < 1e-5) | (norm(F.col("embedding")) == 0)).agg(F.count("*").alias("of_unit_length"))
    return unit.select(F.lit(s["files"]).cast("long").alias("files"), F.lit(s["bytes"]).cast("long").alias("bytes"), F.lit(s["chunks"]).cast("long").alias("chunks"), F.lit(len(store)).cast("long").alias("vectors"), "of_unit_length")


@query(_AFTER_CHUNKS + ", n AS (SELECT count(*) AS n FROM final) SELECT CAST(n AS BIGINT) AS vectors, CAST((n) AS BIGINT) AS in_shards FROM n")
def store_shards(spark, d):
    """The vectors of the store by shard add up."""
    store = _store(spark, d)[0]
    return store.shards().agg(F.sum("n_vectors").alias("in_shards")).select(F.lit(len(store)).cast("long").alias("vectors"), "in_shards")


@_once
def _fleet(spark, d) -> tuple[Fleet, str, list[tuple]]:
    """Two stores, of French and Spanish documents; of the first the smallest is forgotten, of the second the largest is edited and the next one removed."""
    docs = table(spark, d, "documents").where("text is not null")
    root = _local(spark, "fleet")
    steps = []
    for lang in ("fr", "es"):
        own = docs.where(F.lower("lang") == lang)
        _write(own.select(F.concat(F.lit(f"{lang}/notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.encode("text", "UTF-8").alias("content")), root)
        Store(spark, f"{root}/{lang}/.siltstone").index([f"{root}/{lang}"])
    fleet = Fleet(spark, [f"{root}/fr/.siltstone", f"{root}/es/.siltstone", f"{root}/fr/.siltstone"])
    fr, es = fleet.stores
    least = fr.files().select(_doc_id().alias("i")).agg(F.min("i")).first()[0]
    if least is not None:
        steps.append(("forget", least, fr.forget(f"{root}/fr/notes/{least}.md")))
    last = [r[0] for r in es.files().select(_doc_id().alias("i")).orderBy(F.desc("i")).limit(2).collect()]
    if len(last) == 2:
        with open(f"{root}/es/notes/{last[0]}.md", "w", encoding="utf-8") as f:
            f.write("edited\n")
        os.unlink(f"{root}/es/notes/{last[1]}.md")
        r = es.index_changed(spark.createDataFrame([(f"{root}/es/notes/{i}.md",) for i in last], "path string"))
        steps += [("indexed", last[0], r.indexed), ("removed", last[1], r.removed)]
    return fleet, root, steps


_FLEET = f"""
nonblank AS (SELECT doc_id, text, lower(lang) AS store FROM documents WHERE text IS NOT NULL AND lower(lang) IN ('fr', 'es') AND {_SOME}),
fr_least AS (SELECT min(doc_id) AS i FROM nonblank WHERE store = 'fr'), es_last AS (SELECT doc_id AS i, row_number() OVER (ORDER BY doc_id DESC) AS n FROM nonblank WHERE store = 'es' QUALIFY n <= 2),
docs AS (SELECT doc_id, store, CASE WHEN doc_id = (SELECT i FROM es_last WHERE n = 1) THEN 'edited' || chr(10) ELSE text END AS text FROM nonblank WHERE doc_id <> (SELECT i FROM fr_least) AND doc_id <> (SELECT i FROM es_last WHERE n = 2))
"""
_FLEET_CHUNKS = CHUNK_SQL.replace("FROM documents", "FROM docs").replace("WITH RECURSIVE ", f"WITH RECURSIVE {_FLEET}, ", 1)


@query(_FLEET_CHUNKS + ", c AS (SELECT doc_id, count(*) AS n FROM final GROUP BY doc_id) SELECT d.store, count(*) AS files, CAST(sum(strlen(d.text)) AS BIGINT) AS bytes, CAST(sum(c.n) AS BIGINT) AS chunks FROM docs d JOIN c USING (doc_id) GROUP BY d.store")
def fleet_totals(spark, d):
    """Totals of each store of a fleet after a file was forgotten in one, and one edited and one removed in the other."""
    rows = [(n, s["files"], s["bytes"], s["chunks"]) for n, s in _fleet(spark, d)[0].stats()]
    return spark.createDataFrame(rows, "store string, files long, bytes long, chunks long")


_FORGOTTEN = CHUNK_SQL.replace("FROM documents", "FROM nonblank").replace("WITH RECURSIVE ", f"WITH RECURSIVE {_FLEET}, ", 1)


@query(_FORGOTTEN + "SELECT 'forget' AS step, i AS doc_id, (SELECT count(*) FROM final WHERE doc_id = i) AS n FROM fr_least UNION ALL SELECT CASE n WHEN 1 THEN 'indexed' ELSE 'removed' END, i, 1 FROM es_last")
def store_steps(spark, d):
    """Chunks that went with a forgotten file, and what indexing of single paths did."""
    return spark.createDataFrame(_fleet(spark, d)[2], "step string, doc_id long, n long")


@query(f"WITH {_FLEET}, p AS (SELECT '[' || store || '] /' || store || '/notes/' || doc_id || '.md' AS line, store, doc_id FROM docs), r AS (SELECT *, row_number() OVER (ORDER BY store DESC, doc_id || '.md') AS position FROM p) SELECT CAST(position AS INTEGER) AS position, line, (SELECT greatest(count(*) - 20, 0) FROM p) AS more FROM r WHERE position <= 20")
def fleet_listing(spark, d):
    """The first 20 paths of the fleet in order of store and path, and how many more there are."""
    fleet, root, _ = _fleet(spark, d)
    shown, more = fleet.paths(Filter.of(exts=["md"]), 20)
    return spark.createDataFrame([(i, line.replace(root, ""), more) for i, line in enumerate(shown, 1)], "position int, line string, more long")


@query(f"WITH {_FLEET} SELECT count(*) AS files FROM docs WHERE store = 'fr' AND doc_id::VARCHAR LIKE '1%'")
def fleet_matching(spark, d):
    """Files of one store of the fleet that a filter lets through."""
    fleet = _fleet(spark, d)[0]
    return spark.createDataFrame([(sum(s.matching_files(Filter.of(paths=["notes/1*.md"])) for _, _, s in fleet.chosen(["fr"])),)], "files long")


@query(_FLEET_CHUNKS + """, c AS (SELECT doc_id, count(*) AS n FROM final GROUP BY doc_id), t AS (SELECT store, count(*) || ' files, ' || CAST(sum(c.n) AS BIGINT) || ' chunks, ' || CAST(sum(strlen(d.text)) AS BIGINT) || ' bytes indexed, model hash-embedder-64 (64 dim)' AS body FROM docs d JOIN c USING (doc_id) GROUP BY store)
SELECT 'ping' AS call, '{}' AS answer UNION ALL SELECT 'stats', (SELECT 'fr: ' || body FROM t WHERE store = 'fr') || chr(10) || (SELECT 'es: ' || body FROM t WHERE store = 'es') UNION ALL SELECT 'forget', 'error' UNION ALL SELECT 'unknown', '-32601' UNION ALL SELECT 'revision', '2024-11-05'
""")
def service_answers(spark, d):
    """What the service answers to a few lines."""
    service = Service(_fleet(spark, d)[0])
    ask = lambda method, **params: service.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    stats = ask("tools/call", name="siltstone_stats", arguments={})["result"]["content"][0]["text"]
    forget = ask("tools/call", name="siltstone_forget", arguments={"path": "/x"})["result"]  # which of two stores?
    rows = [("ping", json.dumps(ask("ping")["result"])), ("stats", stats), ("forget", "error" if forget.get("isError") else "done"), ("unknown", str(ask("nope")["error"]["code"])), ("revision", ask("initialize")["result"]["protocolVersion"])]
    return spark.createDataFrame(rows, "call string, answer string")


# ---- streams


@query(f"""
WITH {_BEFORE}, gone AS (SELECT doc_id FROM docs WHERE source = 'handbook'), edited AS (SELECT doc_id FROM docs WHERE lower(lang) = 'de' AND coalesce(source, '') <> 'handbook')
SELECT 1 AS run, doc_id, true AS present FROM docs UNION ALL SELECT 2, doc_id, false FROM gone UNION ALL SELECT 2, doc_id, true FROM edited
""")
def stream_changes(spark, d):
    """The change stream of a directory: all files, then in a restarted run from the same checkpoint what was edited or removed."""
    docs = table(spark, d, "documents").where("text is not null")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    root, out, snapshots = _local(spark, "watched"), own_folder(spark, "changes"), _local(spark, "snapshots")

    def run(number: int) -> DataFrame:
        rows = corpus.changes(spark, [root], f"{snapshots}/s").writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{out}/run{number}"))
        q = rows.start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.read.schema("path string, exists boolean").parquet(f"{out}/run{number}").select(F.lit(number).alias("run"), _doc_id().alias("doc_id"), F.col("exists").alias("present"))

    _write(docs.select(name.alias("name"), F.encode("text", "UTF-8").alias("content")), root)
    first = run(1)
    _write(docs.where("source = 'handbook'").select(name.alias("name"), F.lit(None).cast("binary").alias("content")), root)
    _write(docs.where("lower(lang) = 'de' and coalesce(source, '') <> 'handbook'").select(name.alias("name"), F.encode(F.concat("text", F.lit("\nedited\n")), "UTF-8").alias("content")), root)
    return first.unionByName(run(2))
