import json
import os
import shutil

import pytest
from pyspark.sql import functions as F
from quillspark import api
from quillspark.config import Config, ConfigError, resolve
from quillspark.ids import Blake3, blake3_hex, make_id
from quillspark.operators import graph as G
from quillspark.operators import index as I
from quillspark.sources import sinks, tables, vault
from quillspark.sources.events import EventLog, poll
from quillspark.sources.store import IndexStore, StoreError
from quillspark.streaming import ingest

NOTES = {
    "notes/root.md": '---\nrelated:\n  - "[[alpha]]"\n  - "[[missing-frontmatter]]"\n---\n# Root\n\n[[alpha]]\n[[beta#Target Heading]]\n[[beta#^block-a]]\n[[beta#Missing Heading]]\n[[beta#^missing-block]]\n[[missing-body]]\n',
    "notes/alpha.md": "# Alpha\n\n[[beta]]\n",
    "notes/beta.md": "# Target Heading\n\nParagraph content ^block-a\n",
    "notes/incoming.md": "# Incoming\n\n[[deadend]]\n",
    "notes/deadend.md": "# Deadend\n",
    "notes/orphan.md": "# Orphan\n",
    "assets/lone.pdf": "x",
}


def write(root, files):
    for p, text in files.items():
        full = root / p
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    write(root, NOTES)
    store = IndexStore(spark, str(tmp_path_factory.mktemp("index")))
    I.rebuild(store, str(root))
    return root, store


def snapshot(store):
    keep = {"files": ["file_id", "normalized_path", "hash_blake3"], "links": ["link_id", "source_file_id", "raw_target", "resolved_file_id", "is_unresolved", "unresolved_reason"], "properties": ["property_id", "key", "value_json"], "tasks": ["task_id", "state", "text"], "search_index": ["file_id", "content_lc"], "headings": ["file_id", "slug"], "bases": ["base_id", "config_json"]}
    return {t: sorted(map(tuple, store.table(t).select(*c).collect()), key=str) for t, c in keep.items()}


def test_known_ids():
    assert blake3_hex("") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert make_id("file", "notes/root.md") == "file_654c8e839467c8ce"
    data = bytes(i % 251 for i in range(5000))
    h = Blake3()
    for i in range(0, 5000, 700):
        h.update(data[i : i + 700])
    assert h.hexdigest() == blake3_hex(data)
    # published test vectors
    assert blake3_hex(bytes(i % 251 for i in range(1024))) == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3_hex(bytes(i % 251 for i in range(2049))) == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"


def test_graph_of_known_vault(built):
    _, store = built
    f, l = store.table("files"), store.table("links")  # noqa: E741
    out = G.outgoing(l, f, "notes/root.md").collect()
    assert len(out) == 8
    un = G.unresolved(l, f).collect()
    assert [(r["link_id"], r["unresolved_reason"]) for r in un] == [("link_aee44035ef4d8ee6", "missing-note"), ("link_da6a8e47bbd81cb4", "missing-note"), ("link_efc17989b92fa72b", "bad-anchor"), ("link_f93cf3f0a594e22d", "bad-block")]
    assert un[0]["source_field"] == "frontmatter:related[1]"
    assert [(r["source_path"], r["kind"]) for r in G.backlinks(l, f, "notes/beta.md").collect()] == [("notes/alpha.md", "wikilink"), ("notes/root.md", "heading"), ("notes/root.md", "block")]
    assert [(r["normalized_path"], r["n_in"]) for r in G.deadends(l, f).collect()] == [("notes/beta.md", 3), ("notes/deadend.md", 1)]
    assert [r["normalized_path"] for r in G.orphans(l, f).collect()] == ["notes/orphan.md"]
    assert [r["normalized_path"] for r in G.floating(l, f).collect()] == ["assets/lone.pdf", "notes/orphan.md"]
    assert tuple(G.totals(G.floating(l, f)).first()) == (2, 1, 1)
    steps = G.walk(l, f, "notes/root.md", 2, 200, include_unresolved=True).collect()
    assert len(steps) == 14 and steps[0]["link_id"] == "link_00c0eda799009894"
    assert G.walk(l, f, "notes/root.md", 2, 5).count() == 5 and G.walk(l, f, "notes/root.md", 0).count() == 0
    assert G.walk(l, f, "notes/orphan.md", 1, 200, include_folders=True).filter("edge_type = 'folder-sibling'").count() == 5
    with pytest.raises(G.GraphError):
        G.outgoing(l, f, "nope.md")
    assert G.outgoing(l, f, "nope.md", missing_ok=True).count() == 0


def test_paths_and_components(built):
    _, store = built
    f, l = store.table("files"), store.table("links")  # noqa: E741
    p = G.shortest_path(l, f, "notes/root.md", "notes/beta.md")
    assert p.found and p.paths == ("notes/root.md", "notes/beta.md") and p.edge_count == 1
    assert G.shortest_path(l, f, "notes/root.md", "notes/root.md").explored == 1
    assert not G.shortest_path(l, f, "notes/root.md", "notes/orphan.md").found
    assert G.shortest_path(l, f, "notes/root.md", "nope.md").explored == 0
    with pytest.raises(G.GraphError):
        G.shortest_path(l, f, "notes/alpha.md", "notes/orphan.md", max_nodes=1)
    weak = G.weak_components(l, f, sample_size=2).collect()
    assert [(r["size"], r["first_path"]) for r in weak] == [(3, "notes/alpha.md"), (2, "notes/deadend.md"), (1, "notes/orphan.md")]
    assert weak[0]["paths"] == ["notes/alpha.md", "notes/beta.md"]
    assert {(r["path"], r["direction"]) for r in G.neighbors(l, f, "notes/alpha.md").collect()} == {("notes/beta.md", "outgoing"), ("notes/root.md", "incoming")}
    assert G.inbound_totals(G.inbound_scope(l, f, "notes", excludes=("notes/beta.md",))).first()["linked"] == 2
    with pytest.raises(G.GraphError):
        G.inbound_scope(l, f, markdown=False, other=False)


def test_strong_components(spark):
    import random

    rnd = random.Random(3)
    n = 30
    pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(45)} | {(0, 1), (1, 2), (2, 0)}
    reach = {i: {i} for i in range(n)}
    changed = True
    while changed:
        changed = False
        for a in range(n):
            new = set().union(reach[a], *({d for s, d in pairs if s == x} for x in reach[a]))
            if new != reach[a]:
                reach[a], changed = new, True
    want = sorted({frozenset(b for b in reach[a] if a in reach[b]) for a in range(n)}, key=lambda c: (-len(c), min(c)))
    files = spark.createDataFrame([(f"f{i:02d}", f"n{i:02d}.md", True) for i in range(n)], "file_id string, normalized_path string, is_markdown boolean")
    links = spark.createDataFrame([(f"l{i}", f"f{a:02d}", f"f{b:02d}", False) for i, (a, b) in enumerate(pairs)], "link_id string, source_file_id string, resolved_file_id string, is_unresolved boolean")
    got = [(r["size"], r["first_path"]) for r in G.strong_components(links, files).collect()]
    assert got == [(len(c), f"n{min(c):02d}.md") for c in want]


def test_increments_equal_a_rebuild(spark, tmp_path):
    root = tmp_path / "v"
    write(root, NOTES | {"views/p.base": "views: [table]\n"})
    store = IndexStore(spark, str(tmp_path / "i"))
    I.rebuild(store, str(root))
    assert I.repair(store, str(root))["upserted"] == 0
    write(root, {"notes/missing-body.md": "- [x] done\n- [ ] open\n", "notes/alpha.md": "# Alpha\n\n[[orphan]] [b](beta.md)\n", "notes/beta.md": "# Other heading\n", "views/q.base": "views: [table]\n"})
    (root / "notes/deadend.md").unlink()
    found = {(r["normalized_path"], r["change"]) for r in I.drift(vault.scan(spark, str(root)), store.table("files")).collect()}
    assert {("notes/missing-body.md", "insert"), ("notes/deadend.md", "remove"), ("notes/alpha.md", "update")} <= found
    I.repair(store, str(root))
    other = IndexStore(spark, str(tmp_path / "j"))
    I.rebuild(other, str(root))
    assert snapshot(store) == snapshot(other)
    counts = {r["change"]: r["n"] for r in I.metadata_reconcile(store.table("files"), other.table("files")).collect()}
    assert counts == {"unchanged": store.table("files").count()}


def test_checkpointed_batches(spark, tmp_path):
    root = tmp_path / "v"
    write(root, {"a.md": "a", "b.md": "b", "c.md": "[[a]]"})
    store = IndexStore(spark, str(tmp_path / "i"))
    I.rebuild(store, str(root))
    write(root, {"a.md": "a2 x", "b.md": "b2 x", "d.md": "d"})
    assert I.apply_checkpointed(store, str(root), ["a.md", "b.md", "a.md", "d.md"], 1, max_batches=1) == {"batches": 1, "pending": 2}
    assert I.apply_checkpointed(store, str(root), [], 5) == {"batches": 1, "pending": 0}
    assert {r["content_lc"] for r in store.table("search_index").collect()} == {"a2 x", "b2 x", "[[a]]", "d"}
    with pytest.raises(I.IndexError_):
        I.chunks(["a"], 0)


def test_consistency_and_healing(spark, built):
    _, store = built
    t = store.tables()
    assert I.consistency(t).count() == 0
    broken = dict(t)
    broken["files"] = t["files"].filter("normalized_path not in ('notes/beta.md', 'notes/incoming.md')")
    kinds = {r["kind"] for r in I.consistency(broken).collect()}
    assert {"broken_link_target", "orphan_link_source"} <= kinds
    assert I.consistency(I.heal(broken)).count() == 0


def test_front_matter_and_links():
    assert vault.extract_front_matter("---\na: [1\n---\nx").status == "malformed"
    assert vault.extract_front_matter("---\na: 1\nx").status == "missing"
    props = vault.project_properties({"tag": "#a, b B", "Aliases": "one two, three", "d": "2026-03-03", "n": 1, "l": ["x", 2], "m": {"k": 1}, 5: 1, "z": None, "ok": True})
    assert props == [("aliases", "list", ["one two", "three"]), ("d", "date", "2026-03-03"), ("l", "list", ["x", 2.0]), ("m", "string", "{k: 1}"), ("n", "number", 1.0), ("ok", "bool", True), ("tags", "list", ["a", "b"]), ("z", "null", None)]
    with pytest.raises(vault.PropertyError):
        vault.project_properties(None)
    assert vault.parse_wikilink("a b#^id|show") == {"target": "a b", "display": "show", "heading": None, "block": "id"}
    assert vault.parse_wikilink("#h") is None
    got = vault.markdown_links("[a](x%20y.md#h) ![i](p.png) [e](https://x) [m](mailto:a@b) `[c](d.md)`\n```\n[f](g.md)\n```\n[q](<w z.md>)")
    assert [(g["kind"], g["target"]) for g in got] == [("markdown", "x y.md"), ("embed", "p.png"), ("markdown", "w z.md")]
    assert vault.block_ids("x ^b1\nid.^no\n^b0\n") == ["b0", "b1"]
    assert vault.headings("#a\n ## b\n####### c\n#\n") == [(1, "a", 1), (2, "b", 2)]
    assert vault.tasks("- [ ] a\n * [x] b\n  - [X] c\n- [-] d") == [(1, "open", "a"), (3, "done", "c"), (4, "cancelled", "d")]


def test_scan_keeps_hidden_files_and_leaves_out_links(spark, tmp_path):
    write(tmp_path, {".gitkeep": "", "_t/x.md": "x", ".git/config": "x", "sub/.git/y.md": "y", "Ü.md": "u"})
    os.symlink(tmp_path / "_t", tmp_path / "link")
    rows = vault.scan(spark, str(tmp_path), case_sensitive=False).collect()
    assert {r["normalized_path"] for r in rows} == {".gitkeep", "_t/x.md", "sub/.git/y.md", "Ü.md"}
    assert {r["match_key"] for r in rows if r["normalized_path"] == "Ü.md"} == {"Ü.md"}  # ASCII letters only
    for bad in ("", "/a", "a/../b", "./a", "C:\\x"):
        with pytest.raises(vault.VaultPathError):
            vault.validate_relative(bad)


def test_writes(tmp_path):
    root = str(tmp_path)
    with pytest.raises(sinks.WriteDisabledError):
        sinks.note_put(root, "a.md", "x")
    assert sinks.note_put(root, "d/a.md", "---\nk: 1\n---\nbody\n  - [ ] t\r\n", True)["action"] == "created"
    sinks.set_property(root, "d/a.md", "new", ["x"], True)
    sinks.set_task_state(root, "d/a.md", 7, "done", True)
    text = (tmp_path / "d/a.md").read_bytes().decode()
    assert vault.extract_front_matter(text).value == {"k": 1, "new": ["x"]} and "  - [x] t" in text
    with pytest.raises(ValueError):
        sinks.set_task_state(root, "d/a.md", 1, "done", True)

    def fail():
        raise RuntimeError

    before = (tmp_path / "d/a.md").read_bytes()
    with pytest.raises(RuntimeError):
        sinks.note_update(root, "d/a.md", "other", True, fail)
    assert (tmp_path / "d/a.md").read_bytes() == before
    with pytest.raises(RuntimeError):
        sinks.note_move(root, "d/a.md", "e/b.md", True, fail)
    sinks.note_move(root, "d/a.md", "e/b.md", True)
    with pytest.raises(FileExistsError):
        sinks.note_create(root, "e/b.md", "", True)
    sinks.note_delete(root, "e/b.md", True)
    assert not (tmp_path / "e/b.md").exists()


def test_transfer(spark, tmp_path):
    write(tmp_path / "s", {"a.md": "a", "v.base": "b", "x/y.png": "ccc"})
    plan = sinks.plan_transfer(spark, str(tmp_path / "s"), str(tmp_path / "t"))
    assert {r["status"] for r in sinks.execute_transfer(plan).collect()} == {"skipped"}
    done = sinks.execute_transfer(plan, apply=True)
    assert {(r["kind"], r["status"], r["files"], r["bytes"]) for r in sinks.transfer_summary(done).collect()} == {("note", "copied", 1, 1), ("base", "copied", 1, 1), ("asset", "copied", 1, 3)}


def test_events_and_streams(spark, tmp_path):
    root = tmp_path / "v"
    write(root, {"a.md": "a"})
    store = IndexStore(spark, str(tmp_path / "i"))
    I.rebuild(store, str(root))
    log = EventLog(spark, str(tmp_path / "log"))
    write(root, {"a.md": "changed", "b.md": "new"})
    assert [log.note_changed("f", p, "updated") for p in ("a.md", "b.md", "a.md")] == [1, 2, 3]
    page, cursor = poll(log.read(spark), 1, 10)
    assert [r["path"] for r in page.collect()] == ["b.md", "a.md"] and cursor == 3
    assert poll(log.read(spark), 3)[1] == 3
    with pytest.raises(ValueError):
        poll(log.read(spark), 0, 0)
    for _ in range(2):
        ingest.index_stream(store, str(root), log, str(tmp_path / "cp")).awaitTermination()
    assert {r["content_lc"] for r in store.table("search_index").collect()} == {"changed", "new"}
    ingest.event_sink(log.stream(spark), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_store_is_versioned(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    assert store.table("files").count() == 0 and store.version() is None
    v = store.write({"blocks": spark.createDataFrame([("f", "b")], "file_id string, block_id string")})
    assert store.version() == v and store.table("blocks").count() == 1
    blocks = lambda rows: {"blocks": spark.createDataFrame(rows, "file_id string, block_id string")}
    tomb = lambda *ids: spark.createDataFrame([("file", i) for i in ids], "kind string, id string")
    store.append(blocks([("g", "c")]), tomb("zz"))
    store.append(blocks([("f", "b2"), ("f", "b3")]), tomb("f"))
    assert sorted(map(tuple, store.table("blocks").collect())) == [("f", "b2"), ("f", "b3"), ("g", "c")] and len(store.segments()) == 3
    store.append(blocks([]), tomb("f"))
    assert [tuple(r) for r in store.table("blocks").collect()] == [("g", "c")]
    store.write({})
    assert [tuple(r) for r in store.table("blocks").collect()] == [("g", "c")] and len(store.segments()) == 1
    store.files.replace("CURRENT.json", json.dumps({"schema": 99, "version": v}))
    with pytest.raises(StoreError):
        store.table("files")


def test_api(spark, built, tmp_path):
    root, store = built
    shutil.copytree(root, tmp_path / "v")
    write(tmp_path / "v", {"views/all.base": "views:\n  - {type: table, name: All, source: notes, columns: [title, path]}\n", "views/bad.base": "views: [timeline]\n", "notes/task.md": "- [ ] do it\n"})
    v = api.Vault.open(spark, Config(str(tmp_path / "v"), str(tmp_path / "i")))
    assert v.preflight()["needs_rebuild"]
    v.reconcile()
    assert not v.preflight()["needs_rebuild"] and v.health()["status"] == "ready"
    assert [r["path"] for r in v.query("docs", "content", select="path").collect()] == ["notes/beta.md"]
    assert [r["text"] for r in v.query("TASK").collect()] == ["do it"]
    assert v.query("graph").count() == 4 and v.query("graph", path="notes/beta.md").count() == 3
    assert v.query("meta:properties").collect()[0]["key"] == "related"
    rows = v.query("base:views/all.base", view_name="all", where="title starts_with 'a' or title starts_with 'b'", sort="title:desc", select="title")
    assert [json.loads(r["title"]) for r in rows.collect()] == ["beta", "alpha"]
    assert v.base_view("views/all.base", "All", 1, 2)["total"] == 7
    assert [b["path"] for b in v.base_list()["items"]] == ["views/all.base"] and v.base_list()["invalid"][0]["path"] == "views/bad.base"
    assert v.base_schema("views/all.base", "All")[0]["sortable"]
    plan = v.query("docs", "x", where="a == 1", sort="b", explain_only=True)
    assert plan["physical_plan"] == {"adapter": "docs_fts", "stages": ["query_text", "where_expr", "sort"], "limit": 100, "offset": 0, "execute": False}
    assert v.doc_read("notes/beta.md")["title"] == "Target Heading" and len(v.note_context("notes/beta.md")["links"]) == 3
    calls = []
    for _ in range(2):
        v.cached("k", lambda: calls.append(1))
    assert calls == [1]
    with pytest.raises(sinks.WriteDisabledError):
        v.doc_write("notes/n.md", "x")
    log = EventLog(spark, str(tmp_path / "log"))
    assert v.doc_write("notes/n.md", "fresh words", True, log)["event_id"] == 1
    assert v.query("docs", "fresh").count() == 1
    v.cached("k", lambda: calls.append(1))
    assert calls == [1, 1]
    v.task_set_state("notes/task.md", 1, "done", True)
    assert v.query("task").first()["state"] == "done"
    assert v.stats().first()["notes"] == 8
    page, more = tables.notes_page(store.table("files"), None, 2)
    assert [r["path"] for r in page.collect()] == ["notes/alpha.md", "notes/beta.md"] and more == "notes/beta.md"
    assert [json.loads(x)["path"] for x in api.stream_json(page)] == ["notes/alpha.md", "notes/beta.md"]


def test_envelopes_and_errors():
    ok = api.command("t")(lambda: [1, 2])()
    assert ok["ok"] and ok["meta"]["count"] == 2
    for e, code, exit_code in ((sinks.WriteDisabledError(), "write_disabled", 2), (ConfigError("x"), "blocked_prerequisite", 2), (ValueError("x"), "command_failed", 1)):
        got = api.classify(e)
        assert (got.code, got.exit_code) == (code, exit_code)

    def bad():
        raise api.CommandError("invalid_argument", "no")

    assert api.command("t")(bad)()["error"]["code"] == "invalid_argument"
    assert api.envelope("t", [], 0, 2, 5, 2)["meta"]["hasMore"]
    names = [(c["category"], c["name"]) for c in api.catalog()]
    assert names == sorted(names) and ("graph", "graph.walk") in names
    with pytest.raises(api.CommandError):
        api.parse_scope("nowhere")


def test_config(tmp_path):
    root, home, cwd = tmp_path / "v", tmp_path / "h", tmp_path / "c"
    for p in (root, home / ".config", cwd):
        p.mkdir(parents=True)
    (home / ".config/quillspark.toml").write_text(f'vault_root = "{root}"\ncase_sensitive = false\nread_only = false\n')
    (root / "quillspark.toml").write_text("case_sensitive = true\n")
    c = resolve(env={}, cwd=str(cwd), home=str(home))
    assert c.vault_root == str(root.resolve()) and c.case_sensitive and not c.read_only
    assert resolve({"read_only": True}, {"QUILLSPARK_READ_ONLY": "false"}, str(cwd), str(home)).read_only
    assert not resolve(None, {"QUILLSPARK_CASE_SENSITIVE": "off"}, str(cwd), str(home)).case_sensitive
    with pytest.raises(ConfigError):
        resolve(env={}, cwd=str(cwd), home=str(cwd))
    with pytest.raises(ConfigError):
        resolve({"vault_root": str(tmp_path / "none")}, {}, str(cwd), str(home))


def test_columns_are_kept_only_in_documents():
    from quillspark.plans import bases as B

    kept = sinks.persist_view_columns(B.to_config([B.View("A", columns=(B.Column("x"),))]), "a", [B.Column("y")])
    assert B.decode_config(kept)[0].columns == (B.Column("y"),)
    with pytest.raises(B.BaseError):
        sinks.persist_view_columns(json.dumps({"raw": "views: [table]"}), "a", [])


def test_text_functions(spark):
    from quillspark.functions import text as T

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.title_of(F.lit("a/.hidden"))) == ".hidden" and one(T.extension_of(F.lit("a/b.tar.gz"))) == "gz" and one(T.folder_of(F.lit("x.md"))) == ""
    assert one(T.slugify(F.lit("  Überblick: Teil 2! "))) == "überblick-teil-2"
    assert one(T.collapse_dots(F.lit("a/./b/../c"))) == "a/c" and one(T.ancestors(F.lit("a/b"))) == ["a/b", "a"]
    assert one(T.folder_distance(F.lit("a/b"), F.lit("a/c/d"))) == 3 and one(T.folder_distance(F.lit(""), F.lit("a"))) == 1
    assert one(T.normalize_path_like(F.lit(" /a\\b/ "))) == "a/b"
    assert one(T.wikilink_parts(F.lit("p#^b|s"))).asDict() == {"target": "p", "display": "s", "heading": None, "block": "b"}
    assert one(T.fts_normalize(F.lit("Über_straße, naïve"))) == " uber straße naive"
    assert one(T.block_ids(F.lit("x ^b\nid.^no\n^a"))) == ["a", "b"]
    assert one(T.malformed_target(F.lit("a|b"))) and not one(T.malformed_target(F.lit("a/b (c).md")))
