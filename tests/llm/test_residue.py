import random

import pytest
from quillspark.llm import residue as R
from quillspark.llm import segments as S
from quillspark.llm.examples import TRUSTED


def label(text):
    return {S.SEEDS[x] for s in S.sentences(text) for x in S.segments(s) if x in S.SEEDS}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dear {{ first_name }}, welcome", "placeholder"),
        ("The <% tp.title %> was moved", "placeholder"),
        ("[Insert title here]", "placeholder"),
        ("[insert the full legal name of the second tenant here]", None),
        ("Status: xxx", "placeholder"),
        ("There are <<title>> items", "placeholder"),
        ("Owner: XX_ANY_NAME_AT_ALL_XX and more", "placeholder"),
        ("Lorem ipsum dolor sit amet consectetur", "filler"),
        ("tbd tbd tbd", "filler"),
        ("qwer tyui qwer tyui qwer tyui", "filler"),
        ("Access denied.", "error"),
        ("Journal calip Access denied.", "error"),
        ("404 Not found", "error"),
        ("Sorry, the page could not be found.", "error"),
        ("WE ARE SORRY, THE SHARED FOLDER COULD NOT BE FOUND.", "error"),
        ("Das Dokument wurde nicht gefunden.", "error"),
        ("Please turn on scripting to open this table view.", "notice"),
        ("Bitte aktivieren Sie JavaScript, um diese Notiz zu sehen.", "notice"),
        ("The exporter reads {{ and }} as markers", None),
        ("Access denied was what Quan saw on monday", None),
        ("He asked why a missing target shows error 404 in the viewer", None),
        ("She calls it lorem ipsum, the filler that designers use", None),
        ("We told him to enable JavaScript in the exporter settings, which fixed it", None),
        ("The cellar in the north-room is narrow and the template is not.", None),
        ("a list of status codes, 403 and 503 among them", None),
        ("due 2024-03-13, 2024-03-13", None),
        ("see [lathe](../a.md) and (a remark)", None),
    ],
)
def test_likeness_to_examples(text, want):
    assert label(text) == ({want} if want else set())


def test_code_quotes_and_data_do_not_count():
    for text in ("it used `{{name}}` then", "```\ncopy {{name}}\n```\nfine", 'the phrase "Your text here." was cut', "“Access denied.” he read", '{"message": "Access denied."}', "> Access denied."):
        assert not label(text)


def _half(part):
    forms = {}
    for kind, lines in TRUSTED.items():
        for line in lines.strip().split("\n")[part::2]:
            got = [x for x in S.whole(line) if x.startswith("slot ") == (kind == "placeholder")]
            forms |= {g: kind for g in [x for x in got if x.startswith("filler ")] or got}
    return forms


@pytest.mark.parametrize("part", [0, 1])
def test_half_of_the_examples_find_nine_tenths(spark, part):
    """Labels reach variants that are worded otherwise: with every second example, over all documents of sf0.1."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text is not null").select("doc_id", "text").distinct()
    all_ = {r["doc_id"] for r in docs.collect() if label(r["text"])}
    got = {r["doc_id"] for r in R.residue_documents(docs, seeds=_half(part)).collect()}
    assert len(all_) > 300 and got <= all_ and len(got) >= 0.9 * len(all_)


def test_documents(spark):
    known = "Unhandled exception while the viewer was opening one of the shared folders named alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron"
    near = known.replace("Unhandled exception", "Unexpected exception")  # one word at its end
    next_ = near.replace("lambda omicron", "sigma psi")  # near to the second, not to the first
    rows = [
        (1, "Real text here about ferries and harbours in spring. " + known),
        (2, near),
        (3, "Real text about ferries and harbours in the early spring."),
        (4, None),
        (5, ""),
        (6, "Notes on templates: `{{x}}` is a marker. " + "word and more " * 50_000),
        (7, "Title\n\n{{ title }}"),
        (8, next_),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:2]], "doc_id long, text string, seg string")
    form = S.bare(S.normal(known)[0])
    first, third = (S.bare(S.normal(x)[0]) for x in (known, next_))
    seeds = S.SEEDS | {form: "error"}
    assert R.alike(first, S.bare(S.normal(near)[0]), R.Residue()) and not R.alike(first, third, R.Residue())
    got = {r["doc_id"]: r["kinds"] for r in R.residue_documents(df, seeds=seeds).collect()}
    assert got == {1: "error", 2: "error", 7: "placeholder", 8: "error"}
    left = {r["doc_id"] for r in R.without_residue(df).collect()}
    assert left == {1, 2, 3, 4, 5, 6, 8}


def test_simhash_of_like_texts_is_near():
    a = [f"w{i}" for i in range(60)]
    b = a[:30] + ["other"] + a[31:]
    x, y, z = R.simhashes([a, b, [f"v{i}" for i in range(60)]])
    assert bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") < bin((int(x) ^ int(z)) & (2**64 - 1)).count("1")


def test_tables_lose_no_pair(spark):
    rnd = random.Random(1)
    p = R.Residue()
    rows = []
    for i in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), p.hamming):
            b ^= 1 << bit
        rows += [(i, 0, a - (a >> 63 << 64)), (i, 1, b - (b >> 63 << 64))]
    t = R.tables(spark.createDataFrame(rows, "pair int, side int, sim long"), p)
    met = t.filter("side = 0").join(t.filter("side = 1").selectExpr("pair", "key"), ["pair", "key"]).select("pair").distinct()
    assert met.count() == 300


def test_empty(spark):
    assert R.residue_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = spark.createDataFrame([(1, "Access denied.")], "doc_id long, text string")
    assert R.residue_documents(one, seeds={}).collect() == []


def test_too_many_bits(spark):
    with pytest.raises(ValueError):
        R.residue_segments(spark.createDataFrame([], "doc_id long, text string"), R.Residue(hamming=4))


def test_long_text_ends():
    for text in ("{{" * 20_000, "[" * 20_000, "<" * 20_000, "A " * 20_000, "A_" * 20_000, "XX_" * 9_999, "(" * 20_000, "test " * 20_000, "Word " * 20_000):
        label(text)


def test_no_pair_of_the_least_similarity_is_lost(spark):
    """With the defaults: segments of 13 words and more whose first word differs have 0.8 in common, of 12 less."""
    rnd = random.Random(2)
    rows, want, seeds = [], set(), {}
    for d in range(0, 200, 2):
        n = rnd.randint(12, 40)
        tail = " ".join(["exception", *("".join(rnd.choices("bdgkmnprtvz", k=7)) for _ in range(n - 2))])
        rows += [(d, "unhandled " + tail), (d + 1, "unexpected " + tail)]
        seeds["unhandled " + tail] = "error"
        want |= {d, d + 1} if n >= 13 else {d}
    got = {r["doc_id"] for r in R.residue_documents(spark.createDataFrame(rows, "doc_id long, text string"), seeds=seeds).collect()}
    assert len(want) > 150 and got == want


def test_sequence_keys_of_like_texts_meet():
    rnd = random.Random(6)
    p, texts = R.Residue(), []
    for _ in range(300):
        a = [f"v{rnd.randrange(40)}" for _ in range(rnd.randint(5, 80))]
        b = list(a)
        for _ in range(rnd.randint(0, 2)):
            b[rnd.choice([0, -1, rnd.randrange(len(b))])] = "other"
        texts += [a, b]
    m, ends, keys = R.sequence_keys(texts, p)
    of = [set(keys[z - (ends[i] - (ends[i - 1] if i else 0)) : z].tolist()) for i, z in enumerate(ends)]
    assert m.tolist() == [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in texts]
    pairs = [(i, i + 1) for i in range(0, len(texts), 2) if R.alike(" ".join(texts[i]), " ".join(texts[i + 1]), p)]
    assert len(pairs) > 100 and all(of[i] & of[j] for i, j in pairs)
