import random

import pytest
from quillspark.llm import markup as M

NAMES = {1: "html", 2: "markdown", 4: "wiki", 8: "latex"}


def kinds(text):
    bits = M.convert(text)[0]
    return {n for b, n in NAMES.items() if bits & b}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("plain text, a < 3 and b > 4 for $64 instead of $4", set()),
        ("see last_sync_time and row_count_8, 5 * 58 * 2 & more, ticket #3 [sic]", set()),
        ("~ ^ | * # alone", set()),
        ("a <b>bold</b> word", {"html"}),
        ("fish &amp; chips", {"html"}),
        ("at&t; and &nosuchname;", set()),
        ("<!-- note --> text", {"html"}),
        ('<a href="https://x.example/?a=1" title="a > b">x</a>', {"html"}),
        ("# heading", {"markdown"}),
        ("text\n=====\nmore", {"markdown"}),
        ("text\n\n-----\n\nmore", set()),
        ("- item\n- item", {"markdown"}),
        ("1. item", {"markdown"}),
        ("- [x] task", {"markdown"}),
        ("> quote", {"markdown"}),
        ("a **strong** and *em* and ~~gone~~", {"markdown"}),
        ("`code`", {"markdown"}),
        ("```\n<b>x</b> $x^2$ [[a]]\n```", {"markdown"}),
        ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}),
        ("[text](../a.md) and ![i](a.png)", {"markdown"}),
        ("[[page|label]] and ![[embed.png]]", {"wiki"}),
        ("[https://x.example/p label here]", {"wiki"}),
        ("{{box|title={{small|x}}}}", {"wiki"}),
        ('{| class="grid"\n! head\n|-\n| a || b\n|}', {"wiki"}),
        ("== heading ==", {"wiki"}),
        ("''em'' and '''strong'''", {"wiki"}),
        ("it's the notes' end", set()),
        ("\\section{a} text", {"latex"}),
        ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}),
        ("$x_{1} * y_{2}$ and \\(a\\) and $$b$$", {"latex"}),
        ("\\begin{verbatim}\n<b>x</b>\n\\end{verbatim}", {"latex"}),
        ("<pre><code>**x**</code></pre>", {"html"}),
        ("<code>[[x]]</code>", {"html"}),
        ("", set()),
        (None, set()),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


def test_structure_is_kept():
    text = "# head\n\n<ul><li>one<li>two</ul>\n\n```\nx = 1\n```\n\n$a^2$ and **bold** [[page|name]] &amp; \\emph{soft}\n\n\\begin{equation}\ny\n\\end{equation}"
    plain = M.convert(text)[1]
    for want in ("# head", "- one", "- two", "```\nx = 1\n```", "$a^2$ and bold name & soft", "$$y$$"):
        assert want in plain
    assert not any(x in plain for x in ("<", "**", "[[", "\\"))


def test_plain_text_is_unchanged():
    for text in ("", "a\n\nb", "x < y & z", "a" * 100_000):
        assert M.convert(text) == (0, text)


def test_long_text_ends():
    for text in ("*" * 20_000, "[" * 5_000, "<" * 20_000, "$" * 9_999, "{{" * 3_000, "`" * 9_999, "''" * 5_000, "_a" * 9_999, "\\" * 9_999, "- x\n" * 20_000):
        M.convert(text)


def test_common_lines_is_a_longest_subsequence():
    rnd = random.Random(4)
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
        got = M.common_lines(a, b)
        assert len(got) == n[-1][-1]
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in got))


def test_shared_lines_go_but_structure_stays():
    a = ["site menu", "own text", "", "- item", "```", "x", "```", "more own", "and more", "and more yet"]
    b = ["site menu", "other", "- item", "```", "x", "```"]
    assert M.shared_lines(a, b, most=0.8) == {0}
    assert M.shared_lines(a, a) == set()


def test_nothing_is_lost():
    assert M.convert("a <!-- open\nreal text") == (1, "a  open\nreal text")
    assert M.convert("x {{a{{a{{a{{a{{a{{a{{a}}}}}}}}}}}}}} y")[1] == "x aaaaaaa y"
    assert M.convert("{{box|title=some words|more}}") == (4, "some words more")
    assert M.convert("{{never closed, and [[a|b]]") == (4, "{{never closed, and b")


def test_any_depth():
    deep = "".join("*a ~~b " for _ in range(3000)) + "[x](y.md)" + "".join("~~ *" for _ in range(3000))
    bits, plain = M.convert(deep)
    assert bits == 2 and "[x]" not in plain
    assert M.convert("\\emph{" * 500 + "x" + "}" * 500) == (8, "x")
    assert M.convert("**a *b ~~c __d [e](f.md)__~~* g**") == (2, "a b c d e g")


@pytest.mark.parametrize("unit", ["<code>x ", "\n{| a", "<!-- a ", "**a ", "\\a{", "{{a ", "[a [b] ", "\\begin{align} ", "_a ", "''a ", "*a **b ", "$$ a ", "\\[ ", "\\begin{a}[", "`a\n"])
def test_time_grows_with_the_text(unit):
    import time

    took = []
    for n in (20_000, 80_000):
        at = time.process_time()
        M.convert(unit * n)
        took.append(time.process_time() - at)
    assert took[1] < 12 * max(took[0], 0.05)


SCHEMA = "file_id string, normalized_path string, title_lc string, content_lc string, updated_at string, host string"


def test_notes(spark):
    rows = [
        ("1", "w/a.md", "# t", "menu\nalpha **x**\nmore text", "", "clash"),
        ("1", "w/a.md", "# t", "menu\nalpha **x**\nmore text", "", "clash"),
        ("2", "w/b.md", None, None, "", ""),
        ("3", "w/c.md", "", "", "", ""),
        ("4", None, "<b>x</b>", "[[y]]", None, None),
        ("5", "top.md", "t", "$x$", "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["file_id"]: r for r in M.clean_notes(df).collect()}
    assert len(out) == 5
    assert out["1"]["title"] == "# t" and out["1"]["content"] == "menu\nalpha x\nmore text"
    assert out["2"]["content"] is None and out["3"]["content"] == ""
    got = {tuple(r) for r in M.markup_kinds(M.clean_notes(df)).collect()}
    assert got == {("1", "title_lc", "markdown"), ("1", "content_lc", "markdown"), ("4", "title_lc", "html"), ("4", "content_lc", "wiki"), ("5", "content_lc", "latex")}


def test_empty(spark):
    assert M.markup_kinds(M.clean_notes(spark.createDataFrame([], SCHEMA))).collect() == []


def test_same_whatever_the_ranges(spark):
    """Against one pass over all notes in order; hosts of one note, of many, and notes of equal path."""
    rnd = random.Random(8)
    lines = ["menu", "imprint <b>x</b>", "all rights", *(f"own {i}" for i in range(40))]
    rows = [(f"{i:03d}", rnd.choice(["big/a", "big/b", "small", "one"]) + f"/{rnd.randrange(90)}.md", "t", "\n".join(rnd.sample(lines[:3], rnd.randint(0, 3)) + rnd.sample(lines[3:], 6)), "", "") for i in range(150)]
    rows += [("x", "lone/p.md", "t", "menu", "", ""), ("y", None, "t", "menu\na\nb\nc", "", ""), ("z", "top.md", "t", "menu\nd\ne\nf", "", "")]
    df = spark.createDataFrame(rows + rows[:9], SCHEMA)
    host = lambda p: p.split("/")[0] if "/" in p else ""
    order = sorted(((host(r[1] or ""), r[1] or "", r[0], r[3]) for r in rows))
    want = {}
    for i, (h, _, fid, text) in enumerate(order):
        near = order[i - 1] if i and order[i - 1][0] == h else order[i + 1] if i + 1 < len(order) and order[i + 1][0] == h else None
        want[fid] = len(M.shared_lines(M.convert_lines(text)[0], M.convert_lines(near[3])[0])) if near else 0
    assert sum(want.values()) > 20
    was = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("8", "12", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = M.clean_notes(df).collect()
            assert {r["file_id"]: r["n_shared"] for r in out} == want and len(out) == len(want)
            seen.append(sorted(map(tuple, out)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1] == seen[2]
    kinds = {(r["file_id"], r["markup"]) for r in M.markup_kinds(M.clean_notes(df)).collect()}
    assert kinds == {(r[0], "html") for r in rows if "<b>" in r[3]}  # also where the line was deleted
    assert any(r["shared_kinds"] for r in M.clean_notes(df).collect())
