import random
from collections import Counter, defaultdict

import pytest
from quillspark.operators import skew as S

LINKS = "link_id string, source_file_id string, raw_target string, resolved_file_id string, is_unresolved boolean, created_at string, path string"
FILES = "file_id string, normalized_path string, indexed_at string"


def rows(n=3000, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        hot = rnd.random()
        src = "s_hot" if hot < 0.35 else None if hot < 0.37 else f"s{rnd.randrange(200)}"
        dst = "d_hot" if rnd.random() < 0.4 else None if rnd.random() < 0.2 else f"d{rnd.randrange(300)}"
        out.append((f"l{i}", src, "t", dst, rnd.random() < 0.2, f"2023-{rnd.randint(1, 12):02d}-05T00:00:00.000Z", "clash"))
    return out + out[:50] + [out[0]] * 200


def test_per_file_equals_brute_force(spark):
    data = rows()
    files = [("s_hot", "a.md", "1"), ("s_hot", "b.md", "2"), ("d1", "d1.md", "1"), ("unused", "u.md", "1")]
    got, total = S.per_file_links(spark.createDataFrame(data, LINKS), spark.createDataFrame(files, FILES), tasks=6)
    want = {}
    for name, k, o in (("source_file_id", 1, 3), ("resolved_file_id", 3, 1)):
        group = defaultdict(list)
        for r in data:
            if r[k] is not None:
                group[r[k]].append(r)
        for f, rs in group.items():
            links = {r[0]: r for r in rs}.values()
            months = [int(r[5][:7].replace("-", "")) for r in links]
            path = {"s_hot": "b.md", "d1": "d1.md"}.get(f)
            want[name, f] = (len(rs), len(links), len({r[o] for r in links if r[o] is not None}), sum(r[4] for r in links), min(months), max(months), path)
    result = {(r["field_name"], r["file_id"]): (r["n_rows"], r["n_links"], r["n_others"], r["n_unresolved"], r["first_month"], r["last_month"], r["path"]) for r in got.collect()}
    assert total == len(data)
    assert result == want


def test_hot_ids(spark):
    data = rows()
    got = {tuple(r) for r in S.hot_ids(spark.createDataFrame(data, LINKS), spark.createDataFrame([], FILES)).collect()}
    want = {(n, k) for n, i in (("source_file_id", 1), ("resolved_file_id", 3)) for k, c in Counter(r[i] for r in data).items() if k is not None and c >= 0.02 * len(data)}
    assert got == want and ("source_file_id", "s_hot") in got


def test_tasks_are_balanced(spark):
    df = spark.createDataFrame(rows(6000), LINKS)
    plan = S.plan_load(df, ["source_file_id"], 8)
    assert max(plan.loads) < 1.5 * sum(plan.loads) / 8
    assert len(plan.heavy[("s_hot",)]) > 1
    sizes = [r["n"] for r in S.fragment(df, ["source_file_id"], plan, ["link_id"]).selectExpr("spark_partition_id() as p").groupBy("p").agg({"p": "count"}).withColumnRenamed("count(p)", "n").collect()]
    assert max(sizes) < 2 * sum(sizes) / 8


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain_join(spark, how):
    df = spark.createDataFrame(rows(), LINKS).select("link_id", "source_file_id")
    right = spark.createDataFrame([("s_hot", 1), ("s_hot", 2), ("s3", 3), ("zz", 4), (None, 5)], "source_file_id string, v int")
    got = Counter(tuple(r) for r in S.fragment_replicate_join(df, right, ["source_file_id"], ["link_id"], how).select("link_id", "source_file_id", "v").collect())
    assert got == Counter(tuple(r) for r in df.join(right, "source_file_id", how).select("link_id", "source_file_id", "v").collect())


def test_join_refuses_clashes(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        S.fragment_replicate_join(df, df, ["k"], ["v"])
    with pytest.raises(ValueError):
        S.fragment_replicate_join(df, df.select("k"), ["k"], ["v"], "outer")


def test_empty(spark):
    got, total = S.per_file_links(spark.createDataFrame([], LINKS), spark.createDataFrame([], FILES))
    assert (got.collect(), total) == ([], 0)
    assert S.hot_ids(spark.createDataFrame([], LINKS), spark.createDataFrame([], FILES)).collect() == []


def test_pack_is_longest_first():
    place, loads = S.pack([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2)
    assert max(loads) <= 10 and sum(loads) == 18 and len(place) == 5
