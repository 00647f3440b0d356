import json
import os
import time

import pytest

from siltstone.functions import embedding
from siltstone.functions.filters import Filter
from siltstone.service import Service
from siltstone.sources import corpus
from siltstone.sources.fleet import Fleet, labels, store_dirs
from siltstone.sources.store import Locked, Store, WriterLock
from siltstone.streaming.sessions import batches
from siltstone.streaming.watch import watch
from siltstone import cli


def write(base, **files):
    base.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (base / (name + ".md")).write_text(text)


@pytest.fixture(scope="module")
def corpus_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    write(d, bread="Sourdough bread needs a long fermentation.\n", rust="Ownership moves values between bindings.\n", cells="Cells divide by mitosis.\n")
    (d / "blob.bin").write_bytes(b"\0\1\2\3")
    return d


@pytest.fixture(scope="module")
def store(spark, corpus_dir, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("s1")))
    r = s.index([str(corpus_dir)])
    assert (r.scanned, r.indexed, r.skipped, r.chunks) == (4, 3, 1, 3)
    return s


def names(hits):
    return [os.path.basename(h["path"]) for h in sorted(hits.collect(), key=lambda h: h["position"])]


def test_round_trip(spark, store, corpus_dir):
    again = store.index([str(corpus_dir)])
    assert (again.indexed, again.unchanged, again.removed) == (0, 3, 0)
    assert names(store.search("sourdough fermentation", 2))[0] == "bread.md"
    assert store.matching_files(Filter.of(exts=["md"])) == 3 and store.matching_files(Filter.of(exts=["rs"])) == 0
    assert names(store.search("sourdough", 3, Filter.of(paths=["rust.*"]))) == ["rust.md"]
    before = store.table("chunks").agg({"chunk_id": "max"}).first()[0]
    write(corpus_dir, rust="Borrowing lends values for a while.\n")
    os.unlink(corpus_dir / "cells.md")
    r = store.index([str(corpus_dir)])
    assert (r.indexed, r.removed, r.unchanged) == (1, 1, 1)
    assert "cells.md" not in names(store.search("mitosis cells", 8))
    assert store.table("chunks").agg({"chunk_id": "max"}).first()[0] > before
    (corpus_dir / "bread.md").write_text(" \n ")  # now blank: what was there stays
    assert store.index([str(corpus_dir)]).skipped == 2 and store.stats()["files"] == 2
    import shutil

    for name in store.generation().segments:
        shutil.rmtree(os.path.join(store.root, name, "postings"))
    assert store.backfill() == 2 and store.backfill() == 0 and len(store) == 2
    assert names(store.search("borrowing", 1)) == ["rust.md"]
    assert store.shards().first()["n_vectors"] == 2 and store.warm() == 2
    store.compact()
    assert len(store.generation().segments) == 1 and store.stats()["chunks"] == 2
    assert store.forget(str(corpus_dir / "rust.md")) == 1 and store.forget(str(corpus_dir / "rust.md")) == 0
    assert Store.open_existing(spark, store.root).stats()["files"] == 1


def test_rules_of_opening(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Store.open_existing(spark, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="model"):
        Store(spark, str(tmp_path / "s"), model="hash-embedder-128")
    g = tmp_path / "s" / "generations" / "000000000000.json"
    g.write_text(json.dumps(json.loads(g.read_text()) | {"format_version": 99}))
    with pytest.raises(ValueError, match="99"):
        Store(spark, str(tmp_path / "s"))


def test_one_writer_and_no_half_runs(spark, tmp_path, monkeypatch):
    write(tmp_path / "c", a="alpha\n", b="beta\n")
    s = Store(spark, str(tmp_path / "s"))
    with WriterLock(s.root), pytest.raises(Locked, match="process"):
        s.index([str(tmp_path / "c")])
    monkeypatch.setattr(s, "_write_files", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        s.index([str(tmp_path / "c")])
    monkeypatch.undo()
    assert s.stats()["files"] == 0 and os.listdir(tmp_path / "s" / "segments")
    assert s.index([str(tmp_path / "c")]).indexed == 2
    assert len(os.listdir(tmp_path / "s" / "segments")) == 1  # what the dead run left is gone


def test_budget_leaves_the_rest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("siltstone.sources.store.SLICE_FILES", 2)
    write(tmp_path / "c", **{f"n{i}": f"note {i}\n" for i in range(5)})
    s = Store(spark, str(tmp_path / "s"))
    r = s.index([str(tmp_path / "c")], budget=0.0)
    assert r.remaining > 0 and r.indexed + r.remaining == 5
    assert s.index([str(tmp_path / "c")]).indexed == r.remaining and s.stats()["files"] == 5


def test_commits_leave_nothing_behind_and_number_without_gaps(spark, tmp_path, monkeypatch):
    """Over several commits and tasks; index and lengths are those of the chunks."""
    from siltstone.operators import keyword

    monkeypatch.setattr("siltstone.sources.store.FIRST_FILES", 7)
    monkeypatch.setattr("siltstone.sources.store.SLICE_FILES", 9)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    kinds = lambda: sorted(n.partition("-")[0] for n in os.listdir(shared) if n.partition("-")[0] in ("cut", "words"))
    before = kinds()
    write(tmp_path / "c", **{f"n{i}": f"Note {i} notes Ärger_{i % 3} \n" * (1 + 12 * (i % 5)) for i in range(20)}, blank=" \n")
    s = Store(spark, str(tmp_path / "s"))
    r = s.index([str(tmp_path / "c")])
    assert (r.scanned, r.indexed, r.skipped) == (21, 20, 1) and kinds() == before
    chunks = s.table("chunks")
    assert sorted(c["chunk_id"] for c in chunks.collect()) == list(range(1, r.chunks + 1)) and len(s) == r.chunks > 20
    assert sorted(f["file_id"] for f in s.files().collect()) == list(range(1, 21))
    rows = lambda df, *cols: sorted(map(str, df.select(*cols).collect()))
    words = keyword.tokenized(chunks)
    own = ("term", "chunk_id", "positions", "n_tokens")
    assert rows(s.table("postings"), *own) == rows(keyword.postings(words), *own)
    assert {(p["term"], p["bucket"]) for p in s.table("postings").collect()} == {(t, keyword.bucket(t)) for t in {p["term"] for p in s.table("postings").collect()}}
    assert rows(s.table("lengths"), "chunk_id", "n_tokens") == rows(keyword.lengths(words), "chunk_id", "n_tokens")


def test_words_are_hashed_once(monkeypatch):
    """And vectors are those of a sum word by word."""
    import hashlib

    import numpy as np

    asked, md5 = [], hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda b: asked.append(b) or md5(b))
    texts = ["once zyx zyx wvu", "", "?!", "wvu zyx once once once tsr"] * 5
    got = embedding.HashEmbedder(16).embed(texts)
    assert sorted(asked) == [b"once", b"tsr", b"wvu", b"zyx"]
    want = np.zeros((len(texts), 16), np.float32)
    for i, t in enumerate(texts):
        for w in t.split() if i % 4 != 2 else ():
            h = md5(w.encode()).digest()
            want[i, int.from_bytes(h[:8], "big") % 16] += 1 if h[8] & 1 else -1
    assert (got == embedding.unit(want)).all() and got.dtype == np.float32 and embedding.HashEmbedder(16).embed([]).shape == (0, 16)


@pytest.mark.parametrize(("most", "how"), [(500_000, "BroadcastHashJoin"), (3, "SortMergeJoin")])
def test_live_rows_stay_where_they_are(spark, tmp_path, monkeypatch, most, how):
    """Where only few files were ever indexed; else they are joined by a shuffle."""
    monkeypatch.setattr("siltstone.sources.store.SENT_FILES", most)
    write(tmp_path / "c", **{f"n{i}": f"note {i}\n" for i in range(5)})
    s = Store(spark, str(tmp_path / "s"))
    s.index([str(tmp_path / "c")])
    assert s.forget(str(tmp_path / "c" / "n3.md")) == 1
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("chunks", "postings"):
            rows = s.table(name)
            assert rows.select("chunk_id").distinct().count() == 4
            assert how in rows._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_texts_of_the_store_are_not_shuffled(spark):
    import __spark_entry__

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = __spark_entry__.queries()["store_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_listing_carries_no_contents(spark, tmp_path, monkeypatch):
    """Digests and sizes are the same; links to files still count as what they lead to, once."""
    write(tmp_path / "c" / "sub", a="alpha\n", b="beta\n")
    (tmp_path / "away.md").write_text("gamma\n")
    os.symlink(tmp_path / "away.md", tmp_path / "c" / "link.md")
    os.symlink(tmp_path / "c" / "sub" / "a.md", tmp_path / "c" / "again.md")
    whole, bare = ({r["path"]: (r["bytes"], r["hash"], r["content"]) for r in corpus.corpus(spark, [str(tmp_path / "c")], contents=c).collect()} for c in (True, False))
    assert sorted(whole) == [str(tmp_path / x) for x in ("away.md", "c/sub/a.md", "c/sub/b.md")]
    assert bare == {p: (n, h, None) for p, (n, h, _) in whole.items()} and all(c for _, _, c in whole.values())
    asked, real = [], os.path.realpath
    monkeypatch.setattr(os.path, "realpath", lambda p, **k: asked.append(str(p)) or real(p, **k))
    assert sorted(corpus.walk([str(tmp_path / "c")])) == sorted(whole) and len(asked) == 3  # the root and both links


def test_fleet_service_and_cli(spark, tmp_path, capsys):
    for name, text in (("bread", "sourdough starter and retry\n"), ("rust", "ownership and borrowing retry\n")):
        write(tmp_path / name, **{name: text})
        Store(spark, str(tmp_path / name / ".siltstone")).index([str(tmp_path / name)])
    dirs = [str(tmp_path / n / ".siltstone") for n in ("bread", "rust")]
    fleet = Fleet(spark, [*dirs, dirs[0]])
    assert fleet.labels == ["bread", "rust"]
    hits = fleet.search("sourdough retry", 3).collect()
    assert hits[0]["store"] == "bread" and len(hits) == 2
    assert [h["store"] for h in fleet.search("retry", 3, only=["rust"]).collect()] == ["rust"]
    with pytest.raises(ValueError, match="open stores"):
        fleet.search("x", only=["nope"])
    with pytest.raises(ValueError, match="name one store"):
        fleet.writable()
    assert fleet.paths(Filter(), 1)[1] == 1

    service = Service(fleet)
    ask = lambda method, **params: service.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    call = lambda tool, **args: ask("tools/call", name=f"siltstone_{tool}", arguments=args)["result"]
    assert service.answer("  ") is None and service.answer('{"method": "ping"}') is None
    assert service.answer("{nope")["error"]["code"] == -32700
    assert ask("ping")["result"] == {} and ask("nope")["error"]["code"] == -32601
    assert ask("initialize", protocolVersion="2024-11-05")["result"]["protocolVersion"] == "2024-11-05"
    assert ask("initialize", protocolVersion="1999")["result"]["protocolVersion"] == "2025-11-25"
    assert ask("initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert len(ask("tools/list")["result"]["tools"]) == 5
    meta = {"io.modelcontextprotocol/protocolVersion": "1999"}
    assert ask("ping", _meta=meta)["error"]["code"] == -32022
    assert "ttlMs" in ask("server/discover")["result"]
    text = call("search", query="sourdough", k=1, ext="md")["content"][0]["text"]
    assert text.startswith("[1] bread ") and "bread.md:1-1 (score 0.0" in text
    assert "loosen path" in call("search", query="x", ext=["zzz"])["content"][0]["text"]
    assert call("search", query="x", lang=["klingon"])["isError"]
    assert ask("tools/call", name="siltstone_search", arguments={})["error"]["code"] == -32602
    assert "1 further files" in call("files", limit=1)["content"][0]["text"]
    assert "bread: 1 files" in call("stats")["content"][0]["text"]
    assert call("index", path=str(tmp_path / "rust"))["isError"]
    assert "1 unchanged" in call("index", path=str(tmp_path / "rust"), store="rust")["content"][0]["text"]
    assert "does not know" in call("forget", path="/nowhere", store="rust")["content"][0]["text"]

    assert cli.main(["-s", dirs[0], "search", "sourdough", "--json"], spark) == 0
    assert [sorted(h) for h in json.loads(capsys.readouterr().out)] == [["end_line", "path", "score", "start_line", "text"]]
    assert cli.main(["-s", dirs[0], "search", "sourdough", "--json", "-e", "zzz"], spark) == 0 and capsys.readouterr().out == "[]\n"
    assert cli.main(["-s", dirs[0], "-s", dirs[1], "search", "retry", "-k", "2"], spark) == 0
    text = capsys.readouterr().out
    assert text.startswith("  1  0.0") and "lines 1 to 1 in " in text and text.endswith("by store: bread 1, rust 1\n")
    assert cli.shown(os.path.join(os.getcwd(), "x/y")) == "x/y" and cli.shown("/nowhere/z") == "/nowhere/z"
    assert cli.main(["-s", dirs[0], "-s", dirs[1], "forget", "x"], spark) == 2
    assert cli.main(["-s", str(tmp_path / "no"), "stats"], spark) == 1
    assert cli.main(["languages"], spark) == 0 and "rust: rs" in capsys.readouterr().out


def test_labels_and_dirs():
    assert labels(["/home/dev/api/.siltstone", "/home/dev/stores/api-store"]) == ["api", "api-store"]
    assert labels(["/x/api/.s", "/y/api/.s"]) == ["/x/api/.s", "/y/api/.s"]
    assert store_dirs([], "a::b") == ["a", "b"] and store_dirs(["c"], "a") == ["c"] and store_dirs([], "") == [".siltstone"]


def test_models():
    assert embedding.query_text("bge-small-en-v1.5", "q").endswith("passages: q") and embedding.query_text("other", "q") == "q"
    m = embedding.load("hash-embedder-64")
    v = m.embed(["a b", ""])
    assert abs((v[0] ** 2).sum() - 1) < 1e-6 and not v[1].any()
    with pytest.raises(ValueError):
        embedding.load("none")


def test_batches():
    assert list(batches([0, 0.1, 0.2, 1.0, 1.1])) == [[0, 1, 2], [3, 4]]
    assert [len(b) for b in batches([i * 0.4 for i in range(30)])] == [13, 13, 4]
    assert list(batches([])) == []


def until(true, seconds=120):
    end = time.time() + seconds
    while time.time() < end and not true():
        time.sleep(0.3)
    return true()


def test_watch(spark, tmp_path, monkeypatch):
    write(tmp_path / "c", a="alpha\n", b="beta\n")
    s, seen = Store(spark, str(tmp_path / "s")), []
    w = watch(s, [str(tmp_path / "c")], str(tmp_path / "ck"), seen.append)
    kinds = lambda: [e.kind for e in seen if e.kind != "progress"]
    try:
        ready = next(e for e in seen if e.kind == "ready")
        assert ready.report.indexed == 2
        with pytest.raises(Locked):
            Store(spark, s.root).index([str(tmp_path / "c")])  # the watch is the only writer
        assert until(lambda: os.path.exists(tmp_path / "ck" / "snapshots" / "1.json"))
        write(tmp_path / "c", a="gamma\n")
        os.rename(tmp_path / "c" / "b.md", tmp_path / "c" / "d.md")
        assert until(lambda: {os.path.basename(r["path"]) for r in s.files().collect()} == {"a.md", "d.md"})
        assert until(lambda: kinds()[-1] == "indexed")
        assert names(s.search("gamma", 1)) == ["a.md"]
        n = len(seen)
        os.utime(tmp_path / "c" / "a.md")
        time.sleep(3)
        assert len(seen) == n  # nothing changed but the time
        with monkeypatch.context() as m:
            m.setattr(s, "index_changed", lambda p: (_ for _ in ()).throw(OSError("disk full")))
            write(tmp_path / "c", e="epsilon\n")
            assert until(lambda: kinds()[-1] == "error") and "disk full" in seen[-1].message
        write(tmp_path / "c", f="phi\n")  # what failed comes again with it
        assert until(lambda: {os.path.basename(r["path"]) for r in s.files().collect()} == {"a.md", "d.md", "e.md", "f.md"})
    finally:
        w.stop()
    assert kinds()[-1] == "stopped" and w.wait(0)
    assert Store(spark, s.root).index([str(tmp_path / "c")]).unchanged == 4


def test_a_run_can_be_stopped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("siltstone.sources.store.FIRST_FILES", 2)
    monkeypatch.setattr("siltstone.sources.store.SLICE_FILES", 2)
    write(tmp_path / "c", **{f"n{i}": f"note {i}\n" for i in range(5)})
    s, said = Store(spark, str(tmp_path / "s")), []
    r = s.index([str(tmp_path / "c")], progress=said.append, stop=lambda: len(said) == 1)
    assert (r.indexed, r.remaining) == (2, 3) and said[0].startswith("2/5 files")
    assert s.index([str(tmp_path / "c")]).indexed == 3


def test_quiet_snapshots(tmp_path):
    """A batch waits for quiet, but not longer than the cap; offsets are numbers, old snapshots go."""
    write(tmp_path / "c", a="x")
    r = corpus.SnapshotStream({"roots": str(tmp_path / "c"), "snapshots": str(tmp_path / "k"), "quiet": "0.4", "longest": "1.2"})
    rows, at = r.read(r.initialOffset())
    assert list(rows) == [] and at == {"snapshot": 0}
    time.sleep(0.5)
    rows, at = r.read(at)
    assert [(os.path.basename(p), e) for p, e in rows] == [("a.md", True)] and at == {"snapshot": 1}
    began, turns = time.monotonic(), 0
    while at["snapshot"] == 1:  # never quiet
        write(tmp_path / "c", **{f"n{turns}": "y"})
        turns += 1
        rows, at = r.read(at)
        time.sleep(0.1)
    assert 1.0 < time.monotonic() - began < 3 and len(list(rows)) == turns
    assert len(list(r.readBetweenOffsets({"snapshot": 1}, at))) == turns
    r.commit(at)
    assert os.listdir(tmp_path / "k") == ["2.json"]
