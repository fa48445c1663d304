import random

import pytest
from quillspark.llm import neardup as N
from quillspark.operators.components import connected_components

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, p):
    docs = sorted({(i, c) for i, c in rows if i is not None and c is not None})
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(docs) for b, y in docs[k + 1 :] if a != b and N.similarity(x, y, p) >= p.threshold}


def corpus(seed=1, families=12, size=6):
    rnd = random.Random(seed)
    rows = []
    for f in range(families):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 90))]
        for k in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            rows.append((f"d{f}_{k}", " ".join(w)))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), ("short", "too short"), ("short2", "too short"), ("none", None), ("empty", "")]
    return rows + rows[:5]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "id string, content string")


def test_pairs_equal_brute_force(docs):
    got = {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(docs, N.NOTES).collect()}
    want = brute(corpus(), N.NOTES)
    assert want and got == want


def test_groups(docs):
    rows = {r["id"]: r for r in N.near_duplicate_groups(docs, N.NOTES).collect()}
    assert len(rows) == len({i for i, _ in corpus()})
    for a, b in brute(corpus(), N.NOTES):
        assert rows[a]["group_id"] == rows[b]["group_id"]
    assert rows["short"]["group_id"] == rows["short2"]["group_id"] == "short"  # copies are one class
    assert rows["none"]["group_id"] == "none" and rows["empty"]["group_id"] == "empty"
    assert rows["copy1"]["n_copies"] == 3


def test_hot_copies(spark):
    text = " ".join(WORDS[:60])
    rows = [(f"h{i}", text) for i in range(200)] + [(f"x{i}", " ".join(random.Random(i).sample(WORDS, 50))) for i in range(20)]
    g = N.near_duplicate_groups(spark.createDataFrame(rows, "id string, content string"), N.NOTES)
    assert g.filter("group_id = 'h0'").count() == 200
    assert N.near_duplicate_pairs(spark.createDataFrame(rows, "id string, content string"), N.NOTES).count() == 200 * 199 // 2


def test_shards_change_nothing(spark, monkeypatch):
    """Hot band keys and hot texts are cut into shards; every pair is still found, once."""
    base = WORDS[:60]
    rows = [(f"h{i}", " ".join(base)) for i in range(40)] + [(f"v{i}", " ".join(base[:i] + [f"y{i}"] + base[i + 1 :])) for i in range(40)] + corpus(3, 4, 4)
    monkeypatch.setattr(N, "SHARD_ROWS", 20)
    monkeypatch.setattr(N, "LOAD_SLOTS", 64)
    monkeypatch.setattr(N, "COPIES_PER_SHARD", 7)
    got = N.near_duplicate_pairs(spark.createDataFrame(rows, "id string, content string"), N.NOTES).collect()
    pairs = [(r["id_a"], r["id_b"]) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, N.NOTES)


def test_long_text_is_folded(monkeypatch):
    rnd = random.Random(2)
    long = " ".join(rnd.choice(WORDS) for _ in range(5000))
    whole = N.signatures([long, "a b c " * 20], N.NOTES)
    monkeypatch.setattr(N, "_CHUNK", 700)
    parts = N.signatures([long, "a b c " * 20], N.NOTES)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_empty(spark):
    none = spark.createDataFrame([], "id string, content string")
    assert N.near_duplicate_pairs(none, N.NOTES).collect() == []
    assert N.near_duplicate_groups(none, N.NOTES).collect() == []


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 180)] + [(5, 5), (None, 3)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {n: find(n) for n in nodes}
