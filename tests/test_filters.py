import fnmatch
import re

import pytest

from siltstone.functions import scalars
from siltstone.functions.filters import LANGUAGES, Filter, allowed_chunks, glob_to_regex, languages, listed_paths, matching_files

PATHS = ["/proj/src/lib.rs", "/proj/src/notes.md", "/proj/vendor/other.rs", "/proj/README.MD"]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(i, p, 10) for i, p in enumerate(PATHS)], "file_id long, path string, bytes long")


def count(files, **kw):
    return matching_files(files, Filter.of(**kw)).count()


def test_groups(files):
    assert count(files, paths=["src/**"]) == 2
    assert count(files, exts=["rs"]) == count(files, langs=["rust"]) == 2
    assert count(files, exts=[".RS"], langs=["Markdown"]) == 4
    assert count(files, paths=["src/**"], exts=["md"]) == 1
    assert count(files, paths=["/proj/vendor/*"]) == 1
    assert count(files, paths=["nowhere/**"]) == 0
    assert count(files) == 4
    with pytest.raises(ValueError, match="unknown language"):
        Filter.of(langs=["klingon"])


@pytest.mark.parametrize("glob,text,hit", [("*", "/a/b", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[]x]", "]", True), ("[a", "[a", False), ("a.c", "abc", False), ("a**b", "a/x/b", True)])
def test_glob(glob, text, hit):
    assert bool(re.search(glob_to_regex(glob).replace(r"\z", r"\Z"), text)) == hit
    if "[^" not in glob and glob != "[a":
        assert fnmatch.fnmatchcase(text, glob) == hit


def test_chunks_and_listing(spark, files):
    chunks = spark.createDataFrame([(1, 0), (2, 1), (3, 99)], "chunk_id long, file_id long")
    assert {r[0] for r in allowed_chunks(files, chunks, Filter.of(exts=["rs"])).collect()} == {1}
    rows = listed_paths(files, Filter(), 3).collect()
    assert [r["path"] for r in rows] == sorted(PATHS)[:3] and rows[0]["left_out"] == 1
    assert languages(spark).count() == len(LANGUAGES) == 25


def test_scalars(spark):
    df = spark.createDataFrame([("/a/.bashrc", 10), ("/a/b.tar.GZ", 2048), ("/x", 5 << 20)], "p string, n long")
    rows = df.select(scalars.extension(df.p), scalars.file_name(df.p), scalars.parent(df.p), scalars.human_bytes(df.n), scalars.shard_name(df.n)).collect()
    assert [tuple(r) for r in rows] == [("", ".bashrc", "/a", "10 B", "0000000000000010"), ("gz", "b.tar.GZ", "/a", "2 KB", "0000000000002048"), ("", "x", "", "5.0 MB", "0000000005242880")]
    raw = spark.createDataFrame([(b"abc\0def",), (b"fn main() {}",), (b"\xff ok",)], "c binary")
    assert [tuple(r) for r in raw.select(scalars.is_binary(raw.c), scalars.utf8_lossy(raw.c)).collect()][1:] == [(False, "fn main() {}"), (False, "� ok")]
    durations = spark.createDataFrame([(30.0,), (120.0,), (7200.0,)], "s double")
    assert scalars.progress(10, 30, 50, 5.0) == "10/30 files, 10.0 chunks/s, 10s left" and scalars.progress(0, 3, 0, 0.0).startswith("0/3")
    assert [r[0] for r in durations.select(scalars.human_duration(durations.s)).collect()] == ["30s", "2m", "2.0h"]


def test_path_parts_has_every_file(spark, tmp_path):
    from siltstone.operators import queries

    sizes = [0, 512, 1023, 1024, 1536, 2560, 2561, 3584, 1048575, 1048576, 1310720, 1835008, 3 * 1048576 + 52429, None]
    rows = [(i, f"/a/b{i}/x.Rs", n) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "file_id long, path string, bytes long").write.parquet(str(tmp_path / "files.parquet"))
    got = {r["file_id"]: r["size"] for r in queries.path_parts(spark, str(tmp_path)).collect()}
    want = ["0 B", "512 B", "1023 B", "1 KB", "2 KB", "2 KB", "3 KB", "4 KB", "1024 KB", "1.0 MB", "1.2 MB", "1.8 MB", "3.1 MB", None]
    assert [got.get(i, "missing") for i in range(len(sizes))] == want
