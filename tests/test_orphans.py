import random

from quillspark.operators import orphans as O

LINKS = "link_id string, source_file_id string, raw_target string, resolved_file_id string, created_at string, is_unresolved boolean, ref_key string"
FILES = "file_id string, normalized_path string, indexed_at string, name string"


def brute(links, files):
    ids = {f[0] for f in files if f[0] is not None}
    latest = {}
    for f in files:
        if f[0] is not None and f[1] is not None:
            latest[f[0]] = max(latest.get(f[0], ("", "")), (f[2], f[1]))
    bare = lambda p: p.lower()[:-3] if p.lower().endswith(".md") else p.lower()
    paths = {bare(f[1]) for f in files if f[1] is not None}
    names = {p.rsplit("/", 1)[-1] for p in paths}
    out = set()
    for link, src, raw, dst, *_ in links:
        if src is not None and src not in ids:
            out.add((link, "source_file_id"))
        if dst is not None and dst not in ids:
            out.add((link, "resolved_file_id"))
        if dst is None and raw is not None:
            t = bare(raw)
            if "/" in t:
                home = latest[src][1].lower().rpartition("/")[0].split("/") if src in latest else []
                variants = {t} | {"/".join(home[:i]) + "/" + t for i in range(1, len(home) + 1)}
                ok = bool(variants & paths)
            else:
                ok = t in names
            if not ok:
                out.add((link, "raw_target"))
    return out


def data(seed=2):
    rnd = random.Random(seed)
    files = [(f"f{i}", f"notes/{rnd.choice('abc')}/x{i % 25}/Note {i}.md", "2023", "c") for i in range(60)] + [("f1", "moved/Über.MD", "2024", "c"), ("top", "Top.md", "1", "c"), (None, "lost.md", "1", "c"), ("nopath", None, "1", "c")]
    links = []
    for i in range(600):
        src = "f1" if rnd.random() < 0.4 else rnd.choice([f"f{rnd.randrange(75)}", None, "top"])
        f = rnd.choice(files)
        p = f[1] or "zz/y.md"
        raw = rnd.choice([p, p.upper(), p.removesuffix(".md"), p.rsplit("/", 1)[-1], "/".join(p.split("/")[1:]) or p, "missing", "no/where.md", None, ""])
        links.append((f"l{i}", src, raw, rnd.choice([None, None, f"f{rnd.randrange(80)}"]), f"2023-0{rnd.randint(1, 9)}-01T00:00:00.000Z", rnd.random() < 0.5, "clash"))
    return links + links[:40], files


def test_orphans_equal_brute_force(spark):
    links, files = data()
    got = {(r["link_id"], r["ref_field"]) for r in O.orphan_references(spark.createDataFrame(links, LINKS), spark.createDataFrame(files, FILES)).collect()}
    assert got == brute(links, files)


def test_report_counts(spark):
    links, files = data()
    lf, ff = spark.createDataFrame(links, LINKS), spark.createDataFrame(files, FILES)
    rows = O.orphan_report(lf, ff).collect()
    assert sum(r["n_orphans"] for r in rows) == len(brute(links, files))
    assert all(0 < r["n_keys"] <= r["n_orphans"] for r in rows)


def test_deltas_come_and_go(spark):
    refs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "ref_key string")
    files = spark.createDataFrame([("b",), ("c",)], "ref_key string")
    state = O.apply_deltas(O.reference_deltas(refs), O.existence_deltas(files))
    assert {r[0] for r in O.orphan_keys(state).collect()} == {"a"}
    state = O.apply_deltas(state, O.existence_deltas(files.filter("ref_key = 'b'"), -1), O.existence_deltas(spark.createDataFrame([("a",)], "ref_key string")))
    assert {r[0] for r in O.orphan_keys(state).collect()} == {"b"}
    gone = O.apply_deltas(state, O.reference_deltas(refs.filter("ref_key = 'b'"), -1))
    assert O.orphan_keys(gone).collect() == [] and {r["ref_key"] for r in gone.collect()} == {"a", "c"}


def test_namesakes_are_counted(spark):
    files = [("1", "a/x.md", "1", ""), ("2", "b/x.md", "1", ""), ("1", "a/x.md", "1", ""), ("s", "a/s.md", "1", "")]
    links = [("l", "s", "x", None, "2023-01", True, ""), ("m", "s", "b/x", None, "2023-01", True, ""), ("n", "s", "a/X.md", None, "2023-01", True, "")]
    lf, ff = spark.createDataFrame(links, LINKS), spark.createDataFrame(files, FILES)
    state, _ = O.build(lf, ff)
    assert O.orphan_keys(state.keys).collect() == []
    after = O.advance(state, ff.filter("file_id <> '1'"), files_removed=ff.filter("file_id = '1'").distinct())
    assert {r[0] for r in O.orphan_keys(after.keys).collect()} == {"t:a|a/x"}
    after = O.advance(after, ff.filter("file_id = 's'"), files_removed=ff.filter("file_id = '2'"))
    assert {r[0] for r in O.orphan_keys(after.keys).collect()} == {"t:a|a/x", "t:a|b/x", "n:x"}
    back = O.advance(after, ff, files_added=ff.filter("file_id <> 's'").distinct())
    assert O.orphan_keys(back.keys).collect() == []


def _state(s):
    return {tuple(r) for r in s.keys.select("ref_key", "refs", "exists").collect() if not (r[0].startswith("t:") and r[1] == 0)}


def test_changes_equal_a_rebuild(spark):
    """Links and files that come and go, sources that move: the state advanced is that of a rebuild."""
    links, files = data(5)
    links = list(dict.fromkeys(links))
    files = [f for f in files if f[0] is not None]
    lf, ff = (lambda rows: spark.createDataFrame(rows, LINKS)), (lambda rows: spark.createDataFrame(rows, FILES))
    early_l, early_f = links[:400], files[:40]
    moved = [("f2", "elsewhere/deep/x/Note 2.md", "2025", "c"), ("f3", "notes/a/x3/Note 3.md", "2025", "c")]
    state, _ = O.build(lf(early_l), ff(early_f))
    after_f = early_f + files[40:] + moved
    state = O.advance(state, ff(after_f), links_added=lf(links[400:]), files_added=ff(files[40:] + moved))
    want, _ = O.build(lf(links), ff(after_f))
    assert _state(state) == _state(want)
    gone = [f for f in after_f if f[0] in ("f1", "f7", "f8", "top")]
    left_f = [f for f in after_f if f not in gone]
    state = O.advance(state, ff(left_f), files_removed=ff(gone), links_removed=lf(links[100:200]))
    want, refs = O.build(lf(links[:100] + links[200:]), ff(left_f))
    assert _state(state) == _state(want)
    assert {r["link_id"] for r in refs.join(O.orphan_keys(state.keys), "ref_key").collect()} == {x for x, _ in brute(links[:100] + links[200:], left_f)}


def test_hot_key_is_split(spark, monkeypatch):
    links = [(f"l{i}", "s", None, "missing" if i % 3 else f"gone{i}", "2023-01", True, "") for i in range(3000)]
    ff = spark.createDataFrame([("s", "a/s.md", "1", "")], FILES)
    monkeypatch.setattr(O, "MAX_BROADCAST", 10)
    got = {(r["link_id"], r["ref_field"]) for r in O.orphan_references(spark.createDataFrame(links, LINKS), ff).collect()}
    assert got == brute(links, [("s", "a/s.md", "1", "")])


def test_empty(spark):
    links, files = data()
    none = spark.createDataFrame([], FILES)
    assert O.orphan_references(spark.createDataFrame([], LINKS), spark.createDataFrame(files, FILES)).collect() == []
    got = {(r["link_id"], r["ref_field"]) for r in O.orphan_references(spark.createDataFrame(links, LINKS), none).collect()}
    assert got == brute(links, [])
