import random

import pytest
from quillspark.llm import mixing as M

TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 2), ("none", 0.05, 3)]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    docs = []
    for s, n in (("a", 200), ("b", 40), ("c", 30), ("other", 50), (None, 5)):
        docs += [(len(docs) + i, " ".join(rnd.choice(("alpha", "beta", "gamma")) for _ in range(rnd.randint(1, 60))), s) for i in range(n)]
    docs += [(9001, None, "a"), (9002, "", "b"), (None, "x", "a")]
    return spark.createDataFrame(docs + docs[:20], "doc_id long, text string, source string"), spark.createDataFrame(TARGETS + TARGETS[:1], "source string, target_weight double, max_repeats int")


def test_tokens_round_trip():
    enc = M.encoder(M.TOKENIZER)
    for text in ("Grüße, naïve 12 x\n\n  y", "a" * 5000, "日本語 <|endoftext|>"):
        ids = enc.encode_ordinary(text)
        assert enc.decode(ids) == text


@pytest.mark.parametrize("rows_per_range", [50_000, 20])
def test_mixture(spark, tables, monkeypatch, rows_per_range):
    monkeypatch.setattr(M, "ROWS_PER_RANGE", rows_per_range)
    docs, targets = tables
    sized = M.sized_documents(docs, targets)
    plan = M.budgets(sized, targets)
    mixed = M.mixture(sized, plan)
    rows = mixed.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    by = {r["source"]: r for r in M.shares(mixed, plan).collect()}
    assert set(by) == {"a", "b", "c", "none"}
    all_rows = sized.collect()
    for s, w, cap in TARGETS:
        own = [r for r in all_rows if r["source"] == s]
        size, total = sum(r["tokens"] for r in own), sum(r["tokens"] for r in all_rows)
        got = sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s)
        assert by[s]["size"] == size and by[s]["mixed_size"] == got
        assert all(r["copies"] <= cap for r in rows if r["source"] == s)
        assert by[s]["reached"] == (cap * size >= w * total)
        longest = max((r["tokens"] for r in own), default=0)
        assert got == cap * size if not by[s]["reached"] else by[s]["target_size"] <= got < by[s]["budget"] + max(longest, 1)
    assert abs(sum(r["actual_share"] for r in by.values()) - 1) < 1e-9


def test_same_whatever_the_ranges(spark, tables, monkeypatch):
    docs, targets = tables
    sized = M.sized_documents(docs, targets)
    plan = M.budgets(sized, targets)
    whole = sorted(map(tuple, M.mixture(sized, plan).collect()))
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 7)
    assert sorted(map(tuple, M.mixture(sized, plan).collect())) == whole


def test_empty(spark, tables):
    docs, targets = tables
    sized = M.sized_documents(docs.filter("false"), targets)
    plan = M.budgets(sized, targets)
    assert M.mixture(sized, plan).collect() == []
    assert all(r["mixed_size"] == 0 for r in M.shares(M.mixture(sized, plan), plan).collect())
    none = M.sized_documents(docs, targets.filter("false"))
    assert M.budgets(none, targets.filter("false")).collect() == []


def test_two_targets_for_a_source(spark):
    with pytest.raises(ValueError):
        M.target_rows(spark.createDataFrame([("a", 0.5, 1), ("a", 0.4, 1)], "source string, target_weight double, max_repeats int"))


def test_found_needs_the_mixture(spark, sf):
    """The plan of p8_shares before it is cut holds the prefix sums and the cut; p8_found reads its result."""
    from quillspark.llm import queries as Q

    mixed, plan = Q._mix(spark, sf)
    text = mixed.join(plan, "source")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [") >= 2 and "rest" in text
    rows = {r["source"]: r for r in M.shares(mixed, plan).collect()}
    assert {r["source"] for r in Q.p8_found(spark, sf).collect()} == {s for s, r in rows.items() if r["mixed_size"] < r["target_size"]}
