"""Generated, minified and vendored files, and data saved as code.

Three sources of judgement, in this order:

1. Repository attribute files (``.gitattributes``): the lines that set ``linguist-generated`` or
   ``linguist-vendored``, with git's precedence (a deeper directory wins, then the later line). An
   explicit "not generated" or "not vendored" acquits a file of what follows.
2. Patterns for what declares nothing, mined from all that declares something: a file that an
   attribute line or its own statement calls vendored speaks for the names of its directories, one
   that is called generated, or is so by its contents, for the marks of its name (``.mark.`` or
   ``_mark.``). A pattern holds if ``LEAST`` such files of ``MINED_FROM`` directories and the share
   ``VENDORED_SHARE`` or ``GENERATED_SHARE`` of all files that it fits speak for it. A file counts
   for one directory pattern only, the one that most speaks for, so that names below a third-party
   directory gain nothing by it. Globs that attribute files of ``MINED_FROM`` directories agree on hold too.
   Names by which such things commonly go (``PLACES``, ``MARKS``, ``ENDINGS``, ``FILES``) hold unless
   ``REFUTED_FROM`` files or more contradict them; a small collection has too few files to tell.
3. What the file says and looks like: a statement; lines packed with code and
   hardly any blanks; lines of literals; lines of two or three shapes only.

Contents are reduced to a few counts for each chunk and summed per file, map-side first, so a file
of any size costs no task more than its own chunks.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.tables import spread, stage

#: Extensions (lower case) of files that are source code, which only can be generated, minified or data saved as code.
CODE = "rs py pyi js mjs cjs jsx go ts tsx c h cc cpp hpp cs java kt scala rb php pl lua swift m sql sh bash css scss dart ex erl hs jl r proto vue".split()
#: Directories whose contents come from elsewhere.
PLACES = (
    "node_modules bower_components jspm_packages vendor vendors vendored third_party third-party thirdparty 3rdparty 3rd-party 3rd_party external externals extern"
    " pods carthage site-packages dist-packages bundled godeps".split()
)
#: Marks in names, extensions and whole names of files that only tools write.
MARKS = ["m:min", "m:pb", "m:g", "m:designer", "s:pb2", "s:grpc", "s:generated"]
ENDINGS = ["e:lock"]
FILES = ["n:package-lock.json", "n:npm-shrinkwrap.json", "n:pnpm-lock.yaml", "n:go.sum", "n:gradlew", "n:gradlew.bat"]
LEAST, MINED_FROM = 3, 3
VENDORED_SHARE, GENERATED_SHARE = 0.1, 0.5
REFUTED_FROM, REFUTED_SHARE = 100, 0.02
PACKED_LINE = 200
PACKED_BLANKS = 0.1
DATA_SHARE = 0.65
SHAPE_LEAST = 12
SHAPE_SHARE = 0.9

_LEAD = r"^[ \t]*(?:/\*+!?|//+!?|\#+|--|;+|%+|<!--|\*|>|\"\"\")[ \t]*"
#: Statements of tools, at the start of a comment. Words inside code or in the middle of a remark don't count.
_GENERATED = re.compile(
    _LEAD
    + r"(?:<auto-?generated\b|@generated\b|code generated (?:by|from|with)\b|(?:this|the) (?:file|code|class|module) (?:is|was|has been) (?:automatically |auto-?)?generated\b"
    + r"|auto-?\s?generated (?:file|code|from|by|with)\b|automatically generated\b|generated (?:code|file)\b|generated (?:automatically )?(?:by|from|with) \S+.*(?:do not|don't) (?:edit|modify)"
    + r"|machine generated\b|diese datei wurde automatisch\b|automatisch (?:erzeugt|generiert)\b|ce fichier a été généré\b|fichier généré\b|généré automatiquement\b"
    + r"|este (?:archivo|fichero) (?:fue|ha sido|es) generado\b|(?:archivo|código) generado\b|generado automáticamente\b)",
    re.I | re.M,
)
_FOREIGN = re.compile(
    _LEAD
    + r"(?:vendored (?:from|copy of)\b|bundled (?:third-party )?copy of\b|third-party (?:code|copy|source)\b|(?:taken|copied) verbatim from\b|copied (?:unchanged |unmodified )?from upstream\b"
    + r"|.{0,80}\bimported unchanged\b|.{0,80}\bunmodified copy of\b|this (?:file|code) is part of the third-party\b)",
    re.I | re.M,
)
_NUMBER = r"[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d*)?(?:[eE][-+]?\d+)?)[uUlLfF]*"
_DATA = re.compile(
    rf"^[\s\[({{]*{_NUMBER}(?:[\s,\])}};\[({{]+{_NUMBER})*[\s,\])}};]*$"  # rows of numbers
    r"|^\s*[\"'`]?[A-Za-z0-9+/=_-]{40,}[\"'`]?[,;+\\\s]*$"  # encoded blobs
    r"|^\s*[\"'`]?(?:\\x[0-9a-fA-F]{2}){8,}"  # escaped bytes
    r"|^\s*insert\s+into\s+\S+(?:\s*\([^)]*\))?\s+values\s*\("  # dumped rows
    r"|^\s*[\[({]\s*(?:[\"'][^\"']*[\"']\s*[:,=]?\s*|[-+\d.]+\s*,?\s*)+[\])}],?\s*$",  # tuples of literals
    re.I,
)
_WORD = re.compile(r"\w+")
_ATTRIBUTES = r"(?:^|/)\.gitattributes$"
SIGNS = ["generated", "foreign", "lines", "data", "long_chars", "long_blanks", "chars", "shaped"]


def signs(text: str) -> tuple[int, ...]:
    """What one chunk tells, as counts that add up over a file's chunks (see ``SIGNS``)."""
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    data = sum(1 for x in full if _DATA.match(x))
    packed = [x for x in full if len(x) >= PACKED_LINE]
    common = Counter(x for x in _WORD.sub("w", text).split("\n") if x.strip())
    shaped = sum(n for _, n in common.most_common(3) if n > 1)
    return (
        int(bool(_GENERATED.search(text))), int(bool(_FOREIGN.search(text))), len(full), data,
        sum(map(len, packed)), sum(x.count(" ") + x.count("\t") for x in packed), sum(map(len, full)), shaped,
    )


def file_signs(chunks: DataFrame) -> DataFrame:
    """``file_id`` and the sums of ``SIGNS`` over its chunks. Null texts tell nothing."""

    def tell(batches):
        for b in batches:
            rows = [signs(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[] for _ in SIGNS]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), *(pa.array(list(c), pa.int64()) for c in cols)], ["file_id", *SIGNS])

    schema = "file_id long, " + ", ".join(f"{s} long" for s in SIGNS)
    told = spread(chunks.where("text is not null and file_id is not null").select("file_id", "text")).mapInArrow(tell, schema)
    return told.groupBy("file_id").agg(*(F.sum(s).alias(s) for s in SIGNS))


def glob_regex(pattern: str) -> str | None:
    """A regular expression on the path below the attribute file's directory; None for a line that matches no file.

    ``*`` and ``?`` stay within a name, ``**`` crosses directories; a pattern without a slash
    matches names in any directory; one that ends in a slash matches directories, hence nothing.
    """
    if not pattern or pattern.endswith("/") or pattern.startswith("!"):
        return None
    anchored = "/" in pattern
    p = pattern.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p[i:] == "**" and i and p[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            body = p[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            i += p[i] == "\\" and i + 1 < len(p)
            out, i = out + re.escape(p[i]), i + 1
    return f"^{out}$" if anchored else f"^(?:.*/)?{out}$"


def attribute_lines(text: str) -> list[tuple[int, str, str, bool]]:
    """``(line, pattern, 'generated' or 'vendored', set or not)`` of an attribute file's text."""
    out = []
    for n, line in enumerate(text.split("\n")):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        for a in parts[1:]:
            name, _, value = a.lstrip("-!").partition("=")
            if name in ("linguist-generated", "linguist-vendored"):
                out.append((n, parts[0], name[9:], not a.startswith(("-", "!")) and value.lower() not in ("false", "0", "no")))
    return out


def declared_rules(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``dir, line, pattern, regex, kind, value`` of all attribute files, as stored in their chunks."""
    own = files.where(F.col("path").rlike(_ATTRIBUTES)).select("file_id", F.regexp_replace("path", r"\.gitattributes$", "").alias("dir"))

    def parse(batches):
        for b in batches:
            rows = []
            for d, first, text in zip(*(b.column(c).to_pylist() for c in ("dir", "start_line", "text")), strict=True):
                rows += [(d, (first or 1) + n, p, glob_regex(p), kind, on) for n, p, kind, on in attribute_lines(text)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["dir", "line", "pattern", "regex", "kind", "value"])

    rows = chunks.where("text is not null").join(own, "file_id").select("dir", "start_line", "text")
    return rows.mapInArrow(parse, "dir string, line int, pattern string, regex string, kind string, value boolean").where("regex is not null")


def declared(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``file_id, kind, value``: what the attribute files say of each file, by git's precedence.

    Every file meets only the rules of the directories above it, by an equi-join on those.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    near = files.where(F.col("path").contains("/")).select("file_id", "path", F.explode(above).alias("dir"))
    hits = near.join(rules, "dir").where(F.expr("substring(path, length(dir) + 1) rlike regex"))
    last = hits.groupBy("file_id", "kind").agg(F.max(F.struct(F.length("dir"), "line", "value")).alias("m"))
    return last.select("file_id", "kind", F.col("m.value").alias("value"))


def patterns_of(rows: DataFrame) -> DataFrame:
    """``pattern, place`` for each row of ``rows(path, ...)``: ``d:`` a directory's name, ``m:`` and ``s:`` a mark, ``e:`` the extension, ``n:`` the name; ``place`` is the directory that it was met in."""
    parts = F.split(F.lower("path"), "/")
    dirs = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda c, i: F.struct(F.concat(F.lit("d:"), c).alias("pattern"), F.array_join(F.slice(parts, 1, i), "/").alias("place"), i.alias("depth")))
    name, here = F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    mark = lambda kind, regex: F.struct(F.concat(F.lit(kind), F.when(F.regexp_extract(name, regex, 1) != "", F.regexp_extract(name, regex, 1))).alias("pattern"), here.alias("place"), F.lit(-1).alias("depth"))
    marks = F.array(mark("m:", r"[^.]\.(\w+)\.[a-z0-9]+$"), mark("s:", r"[^_]_([a-z0-9]+)\.[a-z0-9]+$"), mark("e:", r"\.([^.]+)$"), mark("n:", "^(.+)$"))
    each = rows.where("path is not null").withColumn("_p", F.explode(F.concat(F.filter(dirs, lambda p: p["pattern"] != "d:"), marks)))
    return each.select(*rows.columns, "_p.*").where("pattern is not null")


def _usual(spark) -> DataFrame:
    return spark.createDataFrame([(p,) for p in [*(f"d:{x}" for x in PLACES), *MARKS, *ENDINGS, *FILES]], "pattern string")


def agreed(rules: DataFrame, least: int = 2) -> DataFrame:
    """``pattern``: what attribute lines of at least ``least`` directories set and none takes back, where it is of a kind that ``patterns_of`` knows."""
    p = F.lower("pattern")
    take = lambda kind, prefix, regex: F.when((F.col("kind") == kind) & p.rlike(regex), F.concat(F.lit(prefix), F.regexp_extract(p, regex, 1)))
    kinds = [
        take("vendored", "d:", r"^(?:\*\*/|/)?([^/*?\[\]]+)/\*\*?$"), take("generated", "m:", r"^(?:\*\*/)?\*\.(\w+)\.(?:\w+|\*)$"), take("generated", "s:", r"^(?:\*\*/)?\*_([a-z0-9]+)\.(?:\w+|\*)$"),
        take("generated", "e:", r"^(?:\*\*/)?\*\.(\w+)$"), take("generated", "n:", r"^([^/*?\[\]]+)$"),
    ]
    each = rules.select(F.coalesce(*kinds).alias("pattern"), "dir", "value").where("pattern is not null").groupBy("pattern")
    return each.agg(F.countDistinct("dir").alias("n"), F.min("value").alias("always")).where((F.col("n") >= least) & F.col("always")).select("pattern")


def mined(evidence: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``pattern, fits, speak, share, usual, declared``: the patterns that hold, once each.

    ``evidence`` has a row for each file: ``file_id, path, code, vendored, generated`` (whether
    something says so of this file). For marks only code files count, as others can't tell.
    """
    spark = evidence.sparkSession
    is_dir = F.col("pattern").startswith("d:")
    speaks = F.when(is_dir, F.col("vendored")).otherwise(F.col("generated"))
    each = patterns_of(evidence.select("file_id", "path", "code", "vendored", "generated")).where(is_dir | F.col("code")).where(~F.col("pattern").startswith("n:"))
    figures = [F.count("*").alias("fits"), F.count_if(speaks).alias("speak"), F.approx_count_distinct(F.when(speaks, F.col("place"))).alias("places")]
    # of few directories the approximate count is exact
    enough = (F.col("speak") >= LEAST) & (F.col("places") >= MINED_FROM) & (F.col("speak") >= F.when(is_dir, VENDORED_SHARE).otherwise(GENERATED_SHARE) * F.col("fits"))
    first = stage(each.groupBy("pattern").agg(*figures).where((F.col("speak") > 0) | (F.col("fits") >= REFUTED_FROM)).select("pattern", "fits", "speak", "places"), "patterns")
    likely = first.where(enough & is_dir).select("pattern", "speak")
    # a file counts for the likeliest of its directories
    owner = each.where(is_dir).join(likely, "pattern").groupBy("file_id").agg(F.max(F.struct("speak", -F.col("depth"), "pattern", "place", "vendored")).alias("o"))
    alone = owner.select("o.pattern", "o.place", "o.vendored").groupBy("pattern").agg(F.count("*").alias("fits"), F.count_if("vendored").alias("speak"), F.approx_count_distinct(F.when(F.col("vendored"), F.col("place"))).alias("places"))
    marks = first.where(enough & (F.col("pattern").startswith("m:") | F.col("pattern").startswith("s:")))
    held = alone.where(enough).unionByName(marks).withColumn("held", F.lit(True))
    usual = _usual(spark).withColumn("usual", F.lit(True)).join(first.select("pattern", F.col("fits").alias("f"), F.col("speak").alias("s")), "pattern", "left")
    usual = usual.where(F.col("f").isNull() | F.col("pattern").startswith("e:") | (F.col("f") < REFUTED_FROM) | (F.col("s") >= REFUTED_SHARE * F.col("f"))).select("pattern", "usual")
    out = held.join(usual, "pattern", "full")
    if rules is not None:
        out = out.join(agreed(rules).distinct().withColumn("declared", F.lit(True)), "pattern", "full")
    else:
        out = out.withColumn("declared", F.lit(None).cast("boolean"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return out.select("pattern", "fits", "speak", (F.col("speak") / F.col("fits")).alias("share"), flag("usual"), flag("declared"))


def _evidence(files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What attribute files, statements and contents say of each row of ``files``, and the attribute lines if there are any."""
    base = files.select("file_id", "path")
    rules = None
    rows = base.join(file_signs(chunks), "file_id", "left")
    if not base.where(F.col("path").rlike(_ATTRIBUTES)).isEmpty():
        rules = stage(declared_rules(base, chunks), "rules")
        said = stage(declared(base, rules), "declared")
    for kind in ("generated", "vendored"):
        if rules is not None:
            own = said.where(F.col("kind") == kind).select("file_id", F.col("value").alias(f"said_{kind}")).dropDuplicates(["file_id"])
            rows = rows.join(own, "file_id", "left")
        else:
            rows = rows.withColumn(f"said_{kind}", F.lit(None).cast("boolean"))
    count = {s: F.coalesce(F.col(s), F.lit(0)) for s in SIGNS}
    code = F.coalesce(F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1).isin(CODE), F.lit(False))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    packed = (share(count["long_chars"], count["chars"]) > 0.5) & (share(count["long_blanks"], count["long_chars"]) < PACKED_BLANKS)
    is_shaped = (count["lines"] >= SHAPE_LEAST) & (share(count["shaped"], count["lines"]) >= SHAPE_SHARE)
    acquitted = F.coalesce("said_generated", F.lit(True))
    rows = rows.select(
        "file_id", "path", "said_generated", "said_vendored", code.alias("code"), (count["foreign"] > 0).alias("foreign"), (code & ((count["generated"] > 0) | is_shaped)).alias("made"),
        (code & packed & acquitted).alias("minified"), (code & acquitted & (share(count["data"], count["lines"]) > DATA_SHARE)).alias("data"),
    )
    return stage(rows.withColumn("vendored", F.coalesce("said_vendored", "foreign")).withColumn("generated", F.coalesce("said_generated", F.col("made") | F.col("minified"))), "evidence"), rules


def patterns(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The patterns that hold for these files (see :func:`mined`)."""
    return mined(*_evidence(files, chunks))


def judged(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file_id, path, vendored, generated, minified, data``: one row for each row of ``files``.

    Null paths are judged by contents only, as code of no known kind, hence only by statements of
    foreign origin; a file without chunks by its path only. Repeated rows stay. Extra columns are
    not kept.
    """
    rows, rules = _evidence(files, chunks)
    hold = stage(mined(rows, rules).select("pattern"), "holding")
    is_mark = F.col("pattern").startswith("m:") | F.col("pattern").startswith("s:")
    fits = patterns_of(rows.select("file_id", "path", "code").distinct()).where(~is_mark | F.col("code")).join(hold, "pattern")
    by = fits.groupBy("file_id").agg(F.max(F.col("pattern").startswith("d:")).alias("in_place"), F.max(~F.col("pattern").startswith("d:")).alias("by_name"))
    no = F.lit(False)
    return rows.join(by, "file_id", "left").select(
        "file_id", "path", F.coalesce("said_vendored", F.coalesce("in_place", no) | F.col("foreign")).alias("vendored"),
        F.coalesce("said_generated", F.coalesce("by_name", no) | F.col("made")).alias("generated"), "minified", "data",
    )


def found(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file_id`` of the files that were not written by hand in this project."""
    return judged(files, chunks).where("vendored or generated or minified or data").select("file_id").distinct()
