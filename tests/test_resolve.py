import random
import time

from quillspark.operators import postings as P
from quillspark.operators import resolve as R
from quillspark.operators import search as S

FILES = "file_id string, normalized_path string"
ASKS = "request_id string, target string, source_path string"


def brute(asks, files):
    folder = lambda p: p.rpartition("/")[0]
    bare = lambda p: p[:-3] if p.endswith(".md") else p
    out = {}
    for rid, target, source in asks:
        if target is None or not target.strip():
            continue
        t, home = target.strip().lower(), folder(source or "")
        parts = [x for x in home.lower().split("/") if x]
        keys = {bare(t)} | {bare("/".join(parts[:i]) + "/" + t) for i in range(1, len(parts) + 1)}
        hits = [(f, p) for f, p in files if ("/" in t and bare(p.lower()) in keys) or ("/" not in t and bare(p.lower().rpartition("/")[2]) == bare(t))]

        def rank(hit):
            there = [x for x in folder(hit[1]).lower().split("/") if x]
            same = 0
            while same < min(len(parts), len(there)) and parts[same] == there[same]:
                same += 1
            return (len(parts) + len(there) - 2 * same, hit[1].lower(), hit[1], hit[0])

        if hits:
            best = min(hits, key=rank)
            out[rid] = (best[0], best[1], len(hits))
    return out


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(7)
    folders = ["", *{"/".join(rnd.choice(["a", "B", "c"]) for _ in range(rnd.randint(1, 4))) for _ in range(30)}]
    files = [(f"f{i}", "/".join(x for x in (rnd.choice(folders), rnd.choice(["Note", "index", "x"]) + rnd.choice([".md", ".md", ".png", ""])) if x)) for i in range(150)]
    files = list({p: (f, p) for f, p in files}.values())
    asks = [(f"r{i}", rnd.choice(["note", "INDEX", "x.md", "x.png", "a/x", "b/index.md", "none", "", None, " note "]), rnd.choice([None, *(f"{d}/s.md" if d else "s.md" for d in folders)])) for i in range(400)]
    got = {r["request_id"]: (r["file_id"], r["path"], r["n_matches"]) for r in R.resolve(spark.createDataFrame(asks, ASKS), spark.createDataFrame(files, FILES)).collect()}
    assert got == brute(asks, files)


def test_namesakes_in_many_folders(spark):
    """20,000 files of one name in 20,000 folders that all ask for it: 400 million pairs, were they made."""
    n = 20_000
    files = spark.range(n).selectExpr("cast(id as string) file_id", "concat('d', id % 100, '/e', id, '/index.md') normalized_path")
    asks = spark.range(n).selectExpr("cast(id as string) request_id", "'index' target", "concat('d', id % 100, '/e', id, '/s.md') source_path")
    began = time.time()
    wrong = R.resolve(asks, files).filter(f"request_id <> file_id or n_matches <> {n}").count()
    assert wrong == 0 and time.time() - began < 60


def test_postings_equal_a_scan(spark):
    rnd = random.Random(3)
    words = ["alpha", "alphabet", "beta", "Béta", "gamma-delta", "x1", "the", "project_map"]
    rows = [(f"n{i}", f"Dir/{rnd.choice(words)}.md", rnd.choice([None, rnd.choice(words).lower()]), " ".join(rnd.choices(words, k=rnd.randint(0, 30))).lower() + rnd.choice(["", ".", "\n"]), "t") for i in range(120)]
    df = spark.createDataFrame(rows + rows[:7], "file_id string, normalized_path string, title_lc string, content_lc string, updated_at string").selectExpr("*", "lower(normalized_path) normalized_path_lc")
    built = P.build(S.with_surfaces(df).dropDuplicates(["file_id"]))
    for q in ("alpha", "alph", "beta gamma", "gamma-delta", "gamma-del", "delta-gamma", "the the", "alpha-beta-x1", "project_map", "nothing", "-", "beta -", "a"):
        want = sorted(map(tuple, S.search(df, q).collect()), key=str)
        assert sorted(map(tuple, S.search(df, q, built).collect()), key=str) == want, q
    assert S.search(df, "alpha", built.limit(0)).collect() == []


def test_only_the_words_asked_for_are_read(spark, tmp_path):
    df = spark.createDataFrame([("a", "a.md", "a", "alpha beta", "t")], "file_id string, normalized_path string, title_lc string, content_lc string, updated_at string")
    P.build(S.with_surfaces(df)).write.parquet(str(tmp_path / "p"))
    plan = P.matching(spark.read.parquet(str(tmp_path / "p")), ["alpha be"])._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(EqualTo(token,alpha),And(GreaterThanOrEqual(token,be),StringStartsWith(token,be)))" in plan


def test_markdown_links():
    from quillspark.sources.vault import markdown_links

    def links(text):
        return [(x["kind"], x["target"]) for x in markdown_links(text)]

    assert links("[a](x.md) ![i](y.png) [t](<z z.md> \"title\") [p](a(b).md)") == [("markdown", "x.md"), ("embed", "y.png"), ("markdown", "z z.md"), ("markdown", "a(b).md")]
    assert links("[![i](inner.png)](outer.md)") == [("embed", "inner.png"), ("markdown", "outer.md")]
    text = "see [one][Ref], [ref][], [REF] and ![pic][img]\n\n[ref]: <a b.md> 'title'\n[img]: p%20q.png#x\n[ref]: second.md\n[out]: https://x.example/\n[out] [^1] [nowhere]\n\n[^1]: note.md\n"
    assert links(text) == [("markdown", "a b.md")] * 3 + [("embed", "p q.png")]
    assert links("\\[no](x.md) `[c](x.md)` [[wiki]] [[wiki|ref]] ![[embed]] [m](mailto:a@b.c) [s](//h/p) [f](#only)\n\n[wiki]: w.md\n[ref]: r.md") == []
    assert links("```\n[c](x.md)\n```\n- [x] task [a](../b.md?q=1#h)\n\n[x]: task.md") == [("markdown", "../b.md"), ("markdown", "task.md")]
    assert links("") == [] and links("[" * 5000) == [] and links("[a]: " * 3000) == []
