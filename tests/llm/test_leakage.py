import random

from quillspark.llm import leakage as L

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("ba", "de", "fi", "go", "hu", "ka", "le", "mo")]


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = L.words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def data(seed=5):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    items = [(i, text(rnd.randint(13, 40))) for i in range(25)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for d in range(120):
        words = text(rnd.randint(5, 120)).split()
        if d % 3 == 0:
            src = items[rnd.randrange(25)][1].split()
            k = rnd.randint(8, len(src))
            at, s = rnd.randrange(len(words) + 1), rnd.randrange(len(src) - k + 1)
            words[at:at] = src[s : s + k]
        sep = rnd.choice([" ", ", ", "\n", " -- "])
        docs.append((d, sep.join(words).upper() if d % 2 else sep.join(words)))
    docs += [(500, None), (501, ""), (502, "ﬁ" + items[0][1]), (None, items[0][1])]
    docs.append((503, " ".join("ｋ" + w[1:] if w[0] == "k" else w for w in items[1][1].split())))  # full-width letters
    return docs + docs[:7], items + items[:3]


def test_runs_equal_brute_force(spark):
    docs, items = data()
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute([d for d in docs if d[0] is not None], items)
    assert want and {(r["doc_id"], r["item_id"]) for r in got if r["kind"] == "run"} == want


def test_small_rank_loses_nothing(spark):
    """What the space leaves out only widens the bound."""
    docs, items = data(8)
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), L.Leakage(rank=4, oversample=2, block=7)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["kind"] == "run"} == brute([d for d in docs if d[0] is not None], items)


def test_paraphrase(spark):
    item = "the northern keeper ravendel signed the blue agenda that olmaris left inside the harbour depot yesterday"
    near = item.replace("northern", "southern").replace("inside", "within")
    noise = [(i, " ".join(random.Random(i).sample(WORDS, 30))) for i in range(10, 40)]
    rows = L.leaks(spark.createDataFrame([(1, near), *noise], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in rows] == [(1, 7, "paraphrase")]


def test_lcs():
    assert L.lcs_length([1, 2, 3, 4], [2, 9, 4, 4]) == 2
    assert L.lcs_length([], [1]) == 0 == L.lcs_length([1], [])


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")
    assert L.leaks(docs, items).collect() == []
    assert L.leaks(spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string"), items.filter("false")).collect() == []


def test_long_document(spark):
    item = " ".join(WORDS[:20])
    text = "x " * 200_000 + item + " y" * 1000
    got = L.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in got] == [(1, 1, "run")]


def test_paraphrased_fragments_inside_other_text(spark):
    """With the defaults: 12 words of an item, one of them replaced, among words of other items."""
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("bdgkmnprtvz", k=6)) for _ in range(400)]
    items = [(i, " ".join(rnd.sample(vocab, 16))) for i in range(40)]
    docs = []
    for i, t in items:
        part = t.split()[2:14]
        part[rnd.randrange(1, 11)] = "other"
        around = [rnd.choice(vocab) for _ in range(60)]
        at = rnd.randrange(61)
        docs.append((i, " ".join(around[:at] + part + around[at:])))
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(i, i) for i, _ in items} <= {(r["doc_id"], r["item_id"]) for r in got if r["kind"] == "paraphrase"}


def test_items_in_parts(spark):
    """Items that are too many to hold at once are taken in parts; the rows are the same."""
    import random

    rnd = random.Random(11)
    vocab = [f"q{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocab, k=30))) for i in range(12)]
    docs = [(100 + i, "intro words " + " ".join(t.split()[5:20]) + " outro") for i, t in items] + [(500, " ".join(rnd.choices(vocab, k=200)))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r)[:3] for r in L.leaks(df, it).filter("kind = 'run'").collect()}
    assert {(d, i) for d, i, _ in whole} == {(100 + i, i) for i, _ in items}
    assert {tuple(r)[:3] for r in L.leaks(df, it, max_items=5).filter("kind = 'run'").collect()} == whole
