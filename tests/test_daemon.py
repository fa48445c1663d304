import json
import threading
import time

import pytest
from quillspark import api, daemon
from quillspark.config import Config
from quillspark.operators import index as I
from quillspark.runtime import Files
from quillspark.sources import store as ST
from quillspark.sources import vault
from quillspark.sources.events import EventLog
from quillspark.streaming import ingest, watch


def write(root, files):
    for p, text in files.items():
        full = root / p
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)


@pytest.fixture
def opened(spark, tmp_path):
    write(tmp_path / "v", {"a.md": "# a\n\nferry [[b]]\n", "b.md": "harbour\n"})
    v = api.Vault.open(spark, Config(str(tmp_path / "v"), str(tmp_path / "i")))
    v.reconcile()
    return v


def test_serve_status_stop(spark, opened, tmp_path):
    path = str(tmp_path / "s")
    assert daemon.status(path) == {"running": False} and not daemon.stop(path)
    with pytest.raises(daemon.DaemonError):
        daemon.ask(path, "status")
    out = {}
    t = threading.Thread(target=lambda: out.update(daemon.serve(opened, path)), daemon=True)
    t.start()
    for _ in range(100):
        if daemon.status(path)["running"]:
            break
        time.sleep(0.05)
    assert daemon.status(path)["version"] == opened.store.version()
    for _ in range(2):
        got = daemon.ask(path, "query", **{"from": "docs"}, query="ferry", select="path")
        assert got["ok"] and got["data"] == [{"path": "a.md"}] and got["meta"]["count"] == 1
    assert daemon.ask(path, "query", **{"from": "nothing"})["error"]["code"] == "invalid_argument"
    assert daemon.ask(path, "burn")["error"]["code"] == "invalid_argument"
    assert daemon.ask(path, "doc.write", path="n.md", content="x")["error"]["code"] == "write_disabled"
    assert daemon.ask(path, "doc.read", path="b.md")["data"]["body"] == "harbour\n"
    with pytest.raises(daemon.DaemonError):
        daemon.serve(opened, path)
    assert daemon.main(["query", "--socket", path, "--query", "harbour"]) == 0 and daemon.main(["status", "--socket", path]) == 0
    assert daemon.main(["stop", "--socket", path]) == 0
    t.join(10)
    assert not t.is_alive() and out["requests"] >= 4 and not daemon.status(path)["running"]
    assert daemon.main(["stop", "--socket", path]) == 1


def test_a_dead_socket_is_taken_over(opened, tmp_path):
    import socket

    path = str(tmp_path / "dead")
    s = socket.socket(socket.AF_UNIX)
    s.bind(path)
    s.close()
    t = threading.Thread(target=lambda: daemon.serve(opened, path), daemon=True)
    t.start()
    for _ in range(100):
        if daemon.status(path)["running"]:
            break
        time.sleep(0.05)
    assert daemon.stop(path)
    t.join(10)


def test_pages_are_kept_until_the_index_changes(spark, opened, monkeypatch):
    ran = []
    made = api.Vault._rows
    monkeypatch.setattr(api.Vault, "_rows", lambda self, *a: ran.append(a[0]) or made(self, *a))
    for _ in range(3):
        assert [r["path"] for r in opened.query("docs", "ferry").collect()] == ["a.md"]
        assert opened.query("task").count() == 0
    assert ran == ["docs", "task"]
    assert opened.query("docs", "ferry", limit=5).count() == 1 and len(ran) == 3  # another page
    opened.doc_write("c.md", "a ferry too", True)
    assert opened.query("docs", "ferry").count() == 2 and len(ran) == 4
    monkeypatch.setattr(api, "MAX_CACHED", 2)
    for q in ("one", "two", "three"):
        opened.query("docs", q)
    assert len(opened._cache) == 2


def test_watch_notices_and_applies(spark, opened, tmp_path):
    root, log = tmp_path / "v", EventLog(spark, str(tmp_path / "log"))
    state = watch.Watch()
    assert watch.notice(spark, opened.store, str(root), log, state) == 0 and state.generation == 0
    write(root, {"c.md": "new", "a.md": "# a\n\nother words\n", ".git/x": "left out"})
    (root / "b.md").unlink()
    stop = threading.Event()

    def apply():
        ingest.index_stream(opened.store, str(root), log, str(tmp_path / "cp")).awaitTermination()
        stop.set()

    done = watch.watch(spark, opened.store, str(root), log, apply, 0.05, stop)
    assert done.generation == 1 and done.changed == 3
    assert sorted(r["path"] + ":" + r["action"] for r in ingest.parsed(log.read(spark)).collect()) == ["a.md:updated", "b.md:deleted", "c.md:created"]
    assert {r["normalized_path"] for r in opened.store.table("files").collect()} == {"a.md", "c.md"}
    assert watch.notice(spark, opened.store, str(root), log, state) == 0


def test_migrations(spark, opened, monkeypatch):
    store = opened.store
    assert store.preflight() == {"known": [1, 2, 3], "applied": [1, 2, 3], "pending": [], "mismatched": []}
    state = store.state()
    # an index of before the postings: without the step, and without the table
    import shutil

    for s in store.segments():
        shutil.rmtree(f"{store.path}/{s}/postings")
    store.files.replace(ST.POINTER, json.dumps({**state, "migrations": state["migrations"][:2]}))
    assert store.preflight()["pending"] == [3] and store.table("postings").count() == 0
    assert opened.preflight()["pending"] == [3]
    assert opened.migrate() == {"applied": [3]} and store.preflight()["pending"] == []
    assert store.table("postings").filter("token = 'ferry'").count() == 1 and store.table("files").count() == 2
    assert opened.migrate() == {"applied": []}
    bad = [{**m, "checksum": "0" * 64} if m["id"] == 2 else m for m in store.state()["migrations"]]
    store.files.replace(ST.POINTER, json.dumps({**store.state(), "migrations": bad}))
    assert store.preflight()["mismatched"] == [2]
    with pytest.raises(ST.StoreError):
        store.migrate()
    with pytest.raises(ST.StoreError):
        store.table("files")


def test_small_files(spark, tmp_path):
    f = Files(spark, str(tmp_path / "x" / "y"))
    f.make()
    assert not f.exists("a") and f.claim("a", "one ü") and not f.claim("a", "two") and f.read("a") == "one ü"
    f.replace("a", "three")
    f.replace("b", "")
    assert f.read("a") == "three" and f.read("b") == "" and f.names("[ab]") == ["a", "b"]
    log = EventLog(spark, str(tmp_path / "log"))
    assert [log.append("e", {"i": i}) for i in range(3)] == [1, 2, 3]


def test_a_deep_folder_is_many_tasks(spark, tmp_path):
    write(tmp_path, {f"only/one/way/d{i}/n{j}.md": "x" for i in range(40) for j in range(2)} | {"top.md": "t", "only/half.md": "h", ".git/c": "no", "only/.git/kept": "yes"})
    top = vault._top(str(tmp_path), 16)
    assert len(top) > 16 and "top.md" in top and "only/half.md" in top
    got = vault.scan(spark, str(tmp_path))
    paths = [r["normalized_path"] for r in got.collect()]
    assert len(paths) == len(set(paths)) == 83 and "only/.git/kept" in paths and ".git/c" not in paths
    assert got.rdd.getNumPartitions() > 1


def test_rebuild_after_a_migration_is_whole(spark, opened, tmp_path):
    I.rebuild(opened.store, str(tmp_path / "v"))
    assert opened.store.preflight()["applied"] == [1, 2, 3] and opened.query("docs", "harbour").count() == 1
