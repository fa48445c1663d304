"""Markup residue in notes: clean text that keeps headings, lists, code and formulas.

Pages of a host are sorted by path, and each is compared with the page before it.
Each page is turned into lines of plain text in one small notation (`# ` heading,
`- ` list item, ``` code, $ formula, | table row), each with the kinds of markup
that stood in it; the lines of neighbours are aligned by longest common
subsequence, and lines that both share, which come from the template and not from
the author, are deleted outside of kept structure.
"""

from __future__ import annotations

import html.entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import parallelism

KINDS = ("html", "markdown", "wiki", "latex")
HTML, MARKDOWN, WIKI, LATEX = 1, 2, 4, 8

# fixed values: names of HTML elements
TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del "
    "details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li "
    "link main map mark marquee math menu meta meter nav nobr noframes noscript nowiki object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select "
    "small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xmp ref references gallery syntaxhighlight"
).split()
BLOCK_TAGS = frozenset("address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html main nav ol p pre section table tbody tfoot thead title tr ul".split())
MATH_ENVS = "equation|align|gather|multline|eqnarray|displaymath|math|alignat|flalign|subequations|array|matrix|cases|split"
CODE_ENVS = "verbatim|lstlisting|minted|alltt"
ENTITIES = {k.rstrip(";").lower(): v for k, v in sorted(html.entities.html5.items(), reverse=True)}
# ------------------------------------------------------------------------------

_TAG_NAMES = "|".join(sorted(TAGS, key=len, reverse=True))
_RAW_TAGS = "pre|code|script|style|textarea|nowiki|syntaxhighlight|xmp|tt|kbd|samp"
_ATTR = r"(?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*\s*/?"
_OPTS = r"(?:\[[^\[\]\n]*\]|\{[^{}\n]*\})*"
#: Forms of markup by name: the pattern, and for those that may look far for their end the pattern of their beginning and
#: how far they look. Where the end of a beginning was not found, the same form is not tried again before that place, so
#: the time grows with the text only.
_FORMS: dict[str, tuple[str, str, str]] = {
    "fence": (r"\n[ \t]*(?P<f>```+|~~~+)[^\n`]*(?:\n.*?(?:\n[ \t]*(?P=f)[`~]*[ \t]*(?=\n|\Z)|\Z)|\Z)", "", ""),
    "code": (r"`(?<!``)(?P<k>`*)(?!`)(?P<codetext>[^\n]+?(?:\n[^\n]+?)*?)(?<!`)`(?P=k)(?!`)", r"`(?<!``)(?P<k>`*)(?!`)", "paragraph"),
    "comment": (r"<!--(?:.*?-->)", r"<!--", "text"),
    "opencomment": (r"<!--", "", ""),
    "raw": (rf"<(?P<k>{_RAW_TAGS})\b{_ATTR}>(?P<rawtext>.*?)</(?P=k)\s*>", rf"<(?P<k>{_RAW_TAGS})\b{_ATTR}>", "text"),
    "tag": (rf"</?(?P<tagname>{_TAG_NAMES})(?:(?=[\s/>]){_ATTR})>|<!doctype[^<>]*>", "", ""),
    "entity": (r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});", "", ""),
    "codeenv": (rf"\\begin\{{(?P<k>(?:{CODE_ENVS})\*?)\}}(?P<codeenvtext>.*?)\\end\{{(?P=k)\}}", rf"\\begin\{{(?P<k>(?:{CODE_ENVS})\*?)\}}", "text"),
    "verb": (r"\\verb\*?(?P<k>[^\sa-zA-Z*])(?P<verbtext>[^\n]*?)(?P=k)", r"\\verb\*?(?P<k>[^\sa-zA-Z*])", "line"),
    "mathenv": (rf"\\begin\{{(?P<k>(?:{MATH_ENVS})\*?)\}}(?P<mathtext>.*?)\\end\{{(?P=k)\}}", rf"\\begin\{{(?P<k>(?:{MATH_ENVS})\*?)\}}", "text"),
    "dollars": (r"\$\$(?=[^$])(?P<display>.*?[^$])\$\$", r"\$\$(?=[^$])", "text"),
    "squares": (r"\\\[(?P<display>.*?)\\\]", r"\\\[", "text"),
    "rounds": (r"\\\((?P<display>.*?)\\\)", r"\\\(", "text"),
    "math": (r"\$(?<!\\\$)(?<!\w\$)(?=[^\s$])(?P<mtext>[^$\n]*?)(?<=[^\s\\])\$(?![\w$])", "", ""),
    "tabular": (rf"\\begin\{{(?P<k>tabular[x*]?|longtable)\}}{_OPTS}(?P<tabtext>.*?)\\end\{{(?P=k)\}}", r"\\begin\{(?P<k>tabular[x*]?|longtable)\}", "text"),
    "env": (rf"\\(?:begin|end)\{{[a-zA-Z]+\*?\}}{_OPTS}", "", ""),
    "heading": (r"\n[ ]{0,3}#{1,6}[ \t]+(?=\S)", "", ""),
    "wikiheading": (r"\n(?P<eq>={1,6})[ \t]*(?P<body>[^\n=][^\n]*?)[ \t]*(?P=eq)[ \t]*(?=\n|\Z)", "", ""),
    "setext": (r"\n(?<=\S\n)[ ]{0,3}(?:=+|-{2,})[ \t]*(?=\n|\Z)", "", ""),
    "task": (r"\n[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\[[ xX-]\](?=\s)", "", ""),
    "mdtable": (r"\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*(?=\n|\Z)|\n[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*(?=\n|\Z)", "", ""),
    "wikitable": (r"\n[ \t]*\{\|[^\n]*(?P<wbody>.*?)\n[ \t]*\|\}[^\n]*", r"\n[ \t]*\{\|", "text"),
    "list": (r"\n[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)", "", ""),
    "quote": (r"\n[ ]{0,3}>+[ \t]?(?=\S)", "", ""),
    "wikilink": (r"!?\[\[(?P<ltarget>[^\[\]\n|]+)(?:\|(?P<body>[^\[\]\n]*))?\]\]", "", ""),
    "weblink": (r"\[(?:https?|ftp|mailto):[^\s\[\]]+[ \t]+(?P<body>[^\[\]\n]+)\]", "", ""),
    "mdlink": (r"!?\[", "", ""),
    "template": (r"\{\{", "", ""),
    "apos": (r"''(?<!'''')(?P<k>'{0,3})(?!')(?P<body>[^\n]*?[^'\n])''(?P=k)(?!')", r"''(?<!'''')(?P<k>'{0,3})(?!')", "line"),
    "stars": (r"\*\*(?<!\*\*\*)(?=[^\s*])(?P<body>[^\n]*?[^\s*])\*\*(?!\*)", r"\*\*(?<!\*\*\*)(?=[^\s*])", "line"),
    "scores": (r"__(?<!\w__)(?=[^\s_])(?P<body>[^\n]*?[^\s_])__(?!\w)", r"__(?<!\w__)(?=[^\s_])", "line"),
    "strike": (r"~~(?<!~~~)(?=[^\s~])(?P<body>[^\n]*?[^\s~])~~(?!~)", r"~~(?<!~~~)(?=[^\s~])", "line"),
    "star": (r"\*(?<![\w*\\]\*)(?=[^\s*])(?P<body>[^*\n]*?[^\s*])\*(?![\w*])", "", ""),
    "score": (r"_(?<![\w\\]_)(?=[^\s_])(?P<body>[^\n]*?[^\s_])_(?!\w)", r"_(?<![\w\\]_)(?=[^\s_])", "line"),
    "command": (r"\\(?P<cmd>[a-zA-Z]+)\*?(?P<opt>\[[^\[\]\n]*\])?", "", ""),
    "escape": (r"\\[\\`*_{}\[\]()#+.!|<>~$%&-]", "", ""),
}
_RX = {n: (re.compile(rx, re.S), re.compile(opener, re.S) if opener else None, scope) for n, (rx, opener, scope) in _FORMS.items()}


def _by_sign(names: dict[str, str]) -> dict[str, tuple]:
    return {c: tuple((n, *_RX[n]) for n in line.split()) for c, line in names.items()}


#: Forms by first character; at the start of a line, by the first character that isn't blank.
_INLINE = _by_sign(
    {
        "<": "comment opencomment raw tag",
        "&": "entity",
        "\\": "codeenv verb mathenv squares rounds tabular env command escape",
        "$": "dollars math",
        "`": "code",
        "*": "stars star",
        "_": "scores score",
        "~": "strike",
        "[": "wikilink weblink mdlink",
        "!": "wikilink mdlink",
        "{": "template",
        "'": "apos",
    }
)
_LINE = _by_sign(
    {
        "#": "heading",
        "=": "wikiheading setext",
        "-": "setext task mdtable list",
        "*": "task list",
        "+": "task list",
        ">": "quote",
        "|": "mdtable",
        ":": "mdtable",
        "`": "fence",
        "~": "fence",
        "{": "wikitable",
    }
    | {c: "task list" for c in "0123456789"}
)
_START = re.compile(r"\n[ \t]*(?=([-*+#>=|`~{:\d]))|[<&\\$`*~\[]|!(?=\[)|\{(?=\{)|'(?=')|_(?<![^\W_]_)")
#: Text without any of these has no markup.
_SIGNS = re.compile(r"[<&\\$`*_~\[{|]|''|(?:\A|\n)[ \t]*(?:[-+#>=]|\d{1,9}[.)][ \t])")
_BLANK_RUNS = re.compile(r"\n[ \t]*\n[\n \t]*")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_TARGET = re.compile(r"\((?P<target>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)")
_SECTION = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "title": 1}
_DROP_ARG = frozenset("label ref eqref cite citep citet pageref bibliography bibliographystyle includegraphics input include usepackage documentclass vspace hspace".split())


def _entity(s: str) -> str | None:
    """The character of an entity, or None where there is no such entity."""
    name = s[1:-1]
    if name[0] == "#":
        n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else None
    return ENTITIES.get(name.lower())


def _code_block(body: str) -> str:
    return "\n```\n" + body.strip("\n") + "\n```\n"


class _Text:
    """A text with the ends of its brackets, each found in one pass when first needed."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: dict[str, dict[int, int]] = {}
        self.tried: dict[tuple, int] = {}

    def end(self, at: int, signs: str) -> int:
        """Where the bracket that opens at `at` closes, or -1. signs: `{}`, `[]` (within a line) or `{{}}`."""
        if signs not in self.found:
            half = len(signs) // 2
            ends: dict[int, int] = {}
            stack: list[int] = []
            for m in re.finditer(re.escape(signs[:half]) + "|" + re.escape(signs[half:]) + (r"|\n" if signs == "[]" else ""), self.text):
                if m.group() == signs[:half]:
                    stack.append(m.start())
                elif m.group() == "\n":
                    stack.clear()
                elif stack:
                    ends[stack.pop()] = m.start()
            self.found[signs] = ends
        return self.found[signs].get(at, -1)

    def match(self, forms: tuple, start: int, limit: int) -> Iterator[tuple[str, re.Match]]:
        """The forms that stand at a place, before limit."""
        for name, rx, opener, scope in forms:
            if opener is None:
                m = rx.match(self.text, start, limit)
            else:
                o = opener.match(self.text, start, limit)
                if o is None:
                    continue
                key = (name, o.groupdict().get("k"))
                if start < self.tried.get(key, 0):
                    continue
                m = rx.match(self.text, start, limit)
                if m is None:
                    stop = limit
                    if scope == "line":
                        stop = self.text.find("\n", start, limit)
                    elif scope == "paragraph":
                        blank = _PARAGRAPH.search(self.text, start, limit)
                        stop = blank.start() if blank else limit
                    self.tried[key] = limit if stop < 0 else stop
            if m is not None:
                yield name, m


#: What a form becomes: (text, kind, end) for all of it, or (text, kind, begin of body, its end, end, text) where the body is
#: searched for markup in turn; None where it is no markup after all.
Edit = tuple


def _around(m: re.Match, kind: int, before: str = "") -> Edit:
    return before, kind, m.start("body"), m.end("body"), m.end(), ""


def _on_tag(m: re.Match, t: _Text) -> Edit:
    name, closing = (m["tagname"] or "").lower(), m.group()[1] == "/"
    if name == "li":
        new = "" if closing else "\n- "
    elif name in ("td", "th"):
        new = "" if closing else " | "
    elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
        new = "\n" if closing else "\n" + "#" * int(name[1]) + " "
    else:
        new = "\n" if name in BLOCK_TAGS else ""
    return new, HTML, m.end()


def _on_entity(m: re.Match, t: _Text) -> Edit | None:
    c = _entity(m.group())
    return (c.replace("\xa0", " "), HTML, m.end()) if c is not None else None


def _on_fence(m: re.Match, t: _Text) -> Edit:
    body = m.group().strip("\n").split("\n")
    closed = len(body) > 1 and set(body[-1].strip()) <= set(m["f"])
    return _code_block("\n".join(body[1 : -1 if closed else None])), MARKDOWN, m.end()


def _on_raw(m: re.Match, t: _Text) -> Edit:
    tag, body = m["k"].lower(), m["rawtext"]
    if tag in ("script", "style"):
        body = ""
    elif tag == "pre":
        body = re.sub(r"</?code\b[^<>]*>", "", body)
        body = _code_block(body) if "\n" in body else "`" + body + "`"
    elif tag in ("code", "tt", "kbd", "samp"):
        body = "`" + body + "`"
    return body, HTML, m.end()


def _on_display(m: re.Match, t: _Text) -> Edit:
    body = m["display"]
    return ("$" + body.strip() + "$" if m.group()[1] == "(" else "\n$$" + " ".join(body.split()) + "$$\n"), LATEX, m.end()


def _on_setext(m: re.Match, t: _Text) -> Edit | None:
    line = t.text[t.text.rfind("\n", 0, m.start()) + 1 : m.start()]
    if not line.strip() or line.lstrip()[:1] in "|>#`~{" or set(line.strip()) <= set("=-"):
        return None
    return "", MARKDOWN, m.end()


def _on_wikitable(m: re.Match, t: _Text) -> Edit:
    rows = []
    for line in m["wbody"].split("\n"):
        line = line.strip()
        if line.startswith("|+"):
            rows.append(line[2:].strip())
        elif line.startswith("|-") or not line:
            continue
        elif line[0] in "|!":
            rows.append("| " + " | ".join(c.strip() for c in re.split(r"\|\||!!", line[1:])) + " |")
        else:
            rows.append(line)
    text, kinds = _plain("\n" + "\n".join(rows))
    return text, WIKI | kinds, m.end()


def _on_list(m: re.Match, t: _Text) -> Edit:
    mark = m.group().strip()
    return "\n" + ("- " if mark in "-*+" else mark + " "), MARKDOWN, m.end()


def _on_wikilink(m: re.Match, t: _Text) -> Edit:
    if not m["body"] or m["ltarget"].strip().startswith("http") and " " in m["ltarget"]:
        return m["ltarget"], WIKI, m.end()
    return _around(m, WIKI)


def _on_mdlink(m: re.Match, t: _Text) -> Edit | None:
    close = t.end(m.end() - 1, "[]")
    target = _TARGET.match(t.text, close + 1) if close >= 0 else None
    if target is None or not re.search(r"[./#:\w]", target["target"]):
        return None
    return "", MARKDOWN, m.end(), close, target.end(), ""


def _on_template(m: re.Match, t: _Text) -> Edit | None:
    """The words of a template and of those within it, without their names where they have values, and without keys."""
    close = t.end(m.start(), "{{}}")
    if close < 0:
        return None
    inner = re.sub(r"\{\{[^{}|]*\|", "", t.text[m.start() : close])
    inner = re.sub(r"\|[ \t]*(?:[\w -]+=)?", " ", re.sub(r"\{\{|\}\}", "", inner))
    text, kinds = _plain(re.sub(r"\A[ \t]*[\w-]+=", "", inner).strip())
    return text, WIKI | kinds, close + 2


def _on_command(m: re.Match, t: _Text) -> Edit | None:
    at = m.end()
    close = t.end(at, "{}") if t.text[at : at + 1] == "{" else -1
    before = t.text[m.start() - 1 : m.start()] if m.start() else ""
    if before and before in ":\\" or before.isalnum() and close < 0 and not m["opt"]:
        return None  # part of a path
    name = m["cmd"]
    first = "\n" + "#" * _SECTION[name] + " " if name in _SECTION else ""
    if name == "item":
        return "- ", LATEX, at
    if close < 0:
        return first, LATEX, at
    if name in _DROP_ARG:
        return "", LATEX, close + 1
    if name == "footnote":
        return " (", LATEX, at + 1, close, close + 1, ")"
    return first, LATEX, at + 1, close, close + 1, ""


def _on_escape(m: re.Match, t: _Text) -> Edit:
    return (m.group()[1] if m.group()[1] != "\\" else "\n"), 0, m.end()


def _on_tabular(m: re.Match, t: _Text) -> Edit:
    rows = [r for r in re.split(r"\\\\(?:\[[^\]]*\])?", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b", "", m["tabtext"])) if r.strip()]
    text, kinds = _plain("\n".join("| " + " | ".join(" ".join(c.split()) for c in re.split(r"(?<!\\)&", r)) + " |" for r in rows))
    return "\n" + text + "\n", LATEX | kinds, m.end()


_ON = {
    "fence": _on_fence,
    "code": lambda m, t: ("`" + m["codetext"] + "`", MARKDOWN, m.end()),
    "comment": lambda m, t: ("", HTML, m.end()),
    "opencomment": lambda m, t: ("", HTML, m.end()),
    "raw": _on_raw,
    "tag": _on_tag,
    "entity": _on_entity,
    "codeenv": lambda m, t: (_code_block(m["codeenvtext"]), LATEX, m.end()),
    "verb": lambda m, t: ("`" + m["verbtext"] + "`", LATEX, m.end()),
    "mathenv": lambda m, t: ("\n$$" + " ".join(m["mathtext"].split()) + "$$\n", LATEX, m.end()),
    "dollars": _on_display,
    "squares": _on_display,
    "rounds": _on_display,
    "math": lambda m, t: (m.group(), LATEX, m.end()),
    "tabular": _on_tabular,
    "env": lambda m, t: ("\n", LATEX, m.end()),
    "heading": lambda m, t: ("\n" + m.group().strip() + " ", MARKDOWN, m.end()),
    "wikiheading": lambda m, t: _around(m, WIKI, "\n" + "#" * len(m["eq"]) + " "),
    "setext": _on_setext,
    "task": lambda m, t: ("\n- " + m.group().strip()[-3:], MARKDOWN, m.end()),
    "mdtable": lambda m, t: ("", MARKDOWN, m.end()),
    "wikitable": _on_wikitable,
    "list": _on_list,
    "quote": lambda m, t: ("\n", MARKDOWN, m.end()),
    "wikilink": _on_wikilink,
    "weblink": lambda m, t: _around(m, WIKI),
    "mdlink": _on_mdlink,
    "template": _on_template,
    "apos": lambda m, t: _around(m, WIKI),
    "stars": lambda m, t: _around(m, MARKDOWN),
    "scores": lambda m, t: _around(m, MARKDOWN),
    "strike": lambda m, t: _around(m, MARKDOWN),
    "star": lambda m, t: _around(m, MARKDOWN),
    "score": lambda m, t: _around(m, MARKDOWN),
    "command": _on_command,
    "escape": _on_escape,
}


def scan(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Plain text of `text`, and (place in it, kind) of each piece of markup. Bodies of markup are searched in place, so
    markup may be nested to any depth."""
    t = _Text(text)
    out: list[str] = []
    marks: list[tuple[int, int]] = []
    ends: list[tuple[int, int, str]] = []  # of open bodies, the innermost last
    at = length = 0
    for first in _START.finditer(text):
        start = first.start()
        while ends and ends[-1][0] <= start:
            a, z, after = ends.pop()
            out += (text[at:a], after)
            length += max(0, a - at) + len(after)
            at = z
        limit = ends[-1][0] if ends else len(text)
        edit = None
        # where no line form stands, the character itself may open an inline form, after the break and the blanks
        tries = ((start, _LINE[first[1]]), (first.end(), _INLINE.get(first[1], ()))) if first[1] else ((start, _INLINE[text[start]]),)
        for place, forms in tries:
            if place < at or place >= limit:
                continue
            for name, m in t.match(forms, place, limit):
                edit = _ON[name](m, t)
                if edit is not None and edit[2 if len(edit) == 3 else 4] <= limit:
                    break
                edit = None
            if edit is not None:
                break
        if edit is None:
            continue
        new, kind = edit[:2]
        out += (text[at:place], new)
        length += place - at + len(new)
        if kind:
            marks.append((length - len(new.lstrip("\n")), kind))
        at = edit[2]
        if len(edit) == 6:
            ends.append(edit[3:])
    while ends:
        a, z, after = ends.pop()
        out += (text[at:a], after)
        at = z
    out.append(text[at:])
    return "".join(out), marks


def _plain(text: str) -> tuple[str, int]:
    """Plain text and kinds of a text that was made of a table or a template."""
    if not _SIGNS.search(text):
        return text, 0
    plain, marks = scan(text)
    kinds = 0
    for _, k in marks:
        kinds |= k
    return plain, kinds


def convert_lines(text: str | None) -> tuple[list[str], list[int]]:
    """The lines of a field as plain text, and the kinds of markup that stood in each as bits."""
    if not text:
        return [""], [0]
    if not _SIGNS.search(text):
        lines = text.split("\n")
        return lines, [0] * len(lines)
    plain, marks = scan("\n" + text.replace("\r\n", "\n"))
    if "~" in plain and any(k & LATEX for _, k in marks):
        plain = re.sub(r"(?<=[^\W_])~(?!~)", " ", plain)
    lines = plain.split("\n")
    bits, line, upto = [0] * len(lines), 0, len(lines[0])
    for place, k in marks:
        while place > upto and line + 1 < len(lines):
            line += 1
            upto += 1 + len(lines[line])
        bits[line] |= k
    return lines, bits


def as_text(lines: list[str], kinds: int) -> str:
    """Lines as a text; where markup was taken out, without the blank lines that it leaves."""
    text = "\n".join(lines)
    return (_BLANK_RUNS.sub("\n\n", text) if kinds else text).strip("\n")


def convert(text: str | None) -> tuple[int, str | None]:
    """Kinds of markup in a field as bits, and its plain text."""
    if not text or not _SIGNS.search(text):
        return 0, text
    lines, bits = convert_lines(text)
    kinds = 0
    for k in bits:
        kinds |= k
    return kinds, as_text(lines, kinds)


def _scores(a: list[str], b: list[str]) -> list[int]:
    """Length of the longest common subsequence of `a` with each prefix of `b`, bit-parallel."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    out = [0]
    for bit in reversed(bin(v | full + 1)[3:]):
        out.append(out[-1] + (bit == "0"))
    return out


def _lcs(a: list[str], at: int, b: list[str], out: list[int]) -> None:
    """Appends the positions in `a` (plus at) of a longest common subsequence; memory grows with the lines, not their
    product (Hirschberg)."""
    stack = [(a, at, b)]
    while stack:
        a, at, b = stack.pop()
        while a and b and a[0] == b[0]:
            out.append(at)
            a, b, at = a[1:], b[1:], at + 1
        if not a or not b:
            continue
        if len(a) == 1:
            if a[0] in b:
                out.append(at)
            continue
        mid = len(a) // 2
        left, right = _scores(a[:mid], b), _scores(a[mid:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        stack.append((a[mid:], at + mid, b[cut:]))
        stack.append((a[:mid], at, b[:cut]))


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Positions in `a` of a longest common subsequence of lines with `b`; blank lines are no lines."""
    shared = {x for x in a if x.strip()}.intersection(b)
    if not shared:
        return []
    places = [i for i, x in enumerate(a) if x in shared]
    found: list[int] = []
    _lcs([a[i] for i in places], 0, [x for x in b if x in shared], found)
    return [places[i] for i in sorted(found)]


def shared_lines(lines: list[str], other: list[str], most: float = 0.5) -> set[int]:
    """Places of the lines that are shared with the neighbour and can go. Kept are code, formulas, tables, headings and
    lists, and all lines of pages of which more than `most` is shared: those are versions of one text, not pages of one
    template."""
    shared = common_lines(lines, other)
    if not shared or len(shared) > most * sum(1 for x in lines if x.strip()):
        return set()
    drop, inside = set(), False
    hit = set(shared)
    for i, x in enumerate(lines):
        if x.startswith("```"):
            inside = not inside
        elif i in hit and not inside and not x.startswith(("#", "- ", "|", "$", "`")) and not x[:1].isdigit():
            drop.add(i)
    return drop


ORDER = ["host", "path", "id"]


def _page_ranges(pages: DataFrame, parts: int) -> list[tuple[tuple, tuple]]:
    """Least and greatest (host, path, id) of about equal ranges of pages; at most `parts` rows of keys reach the driver."""
    keys = pages.select(*ORDER).repartitionByRange(parts, *ORDER).groupBy(F.spark_partition_id().alias("p"))
    rows = keys.agg(F.min(F.struct(*ORDER)).alias("least"), F.max(F.struct(*ORDER)).alias("most")).collect()
    return sorted((tuple(r["least"]), tuple(r["most"])) for r in rows)


def _with_neighbours(pages: DataFrame, ranges: list[tuple[tuple, tuple]]) -> DataFrame:
    """Pages sent to their range by number (part); the last page of a range also to the next one, and its first also to
    the one before, as neighbours only (own is false)."""
    least, most = [a for a, _ in ranges], [z for _, z in ranges]

    @F.pandas_udf("array<int>")
    def places(host: pd.Series, path: pd.Series, id_: pd.Series) -> pd.Series:
        out = []
        for key in zip(host, path, id_):
            i = min(bisect_left(most, key), len(most) - 1)
            out.append([i, *([i + 1] if key == most[i] and i + 1 < len(most) else []), *([i - 1] if key == least[i] and i else [])])
        return pd.Series(out)

    sent = pages.withColumn("places", places(*ORDER)).select("*", F.posexplode("places").alias("n", "part")).withColumn("own", F.col("n") == 0).drop("n", "places")
    return sent.repartitionById(len(ranges), "part").sortWithinPartitions(*ORDER, "title_lc", "content_lc")


def clean_notes(notes: DataFrame, host_depth: int = 1) -> DataFrame:
    """Each note once: file_id, title, content (plain text), title_kinds and content_kinds (kinds of markup in the lines that
    are kept, as bits), shared_kinds (in the lines deleted), n_shared (lines deleted).

    notes has file_id, normalized_path, title_lc, content_lc; other columns are ignored, repeated rows count once. The
    host of a note is the first host_depth folders of its path. Notes are sent to ranges of host and path, so a host of
    any size spreads over tasks. A note is compared with the one before it in its host, the first of a host with the one
    after it; pages at the ends of a range are sent to both, so the result does not depend on the ranges. Null and empty
    fields stay so and have no markup.
    """
    path = F.coalesce("normalized_path", F.lit(""))
    host = F.when(path.contains("/"), F.array_join(F.slice(F.split(path, "/"), 1, host_depth), "/")).otherwise("")
    pages = notes.select(host.alias("host"), path.alias("path"), F.coalesce("file_id", F.lit("")).alias("id"), "file_id", "title_lc", "content_lc")
    schema = "file_id string, title string, title_kinds int, content string, content_kinds int, shared_kinds int, n_shared int"
    ranges = _page_ranges(pages, max(8, parallelism(notes.sparkSession)))
    if not ranges:
        return notes.sparkSession.createDataFrame([], schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_host, last, held, previous = None, None, None, None

        def emit(done: list[tuple], own: bool, row: tuple, lines: list[str], bits: list[int], neighbour: list[str] | None) -> None:
            if not own:
                return
            drop = shared_lines(lines, neighbour) if neighbour else set()
            kept = shared = 0
            for i, k in enumerate(bits):
                if i in drop:
                    shared |= k
                else:
                    kept |= k
            text = row[3] if not (drop or kept) else as_text([x for i, x in enumerate(lines) if i not in drop], kept | shared)
            done.append((*row[:3], text, kept, shared, len(drop)))

        for b in it:
            done: list[tuple] = []
            cols = [b.column(c).to_pylist() for c in ("file_id", "title_lc", "content_lc", "host", "path", "own")]
            for fid, title, content, h, path_, own in zip(*cols):
                if previous == (fid, path_, title, content):
                    continue
                previous = (fid, path_, title, content)
                tb, tt = convert(title)
                lines, bits = convert_lines(content)
                page = (own, (fid, tt, tb, content), lines, bits)
                if held is not None:
                    emit(done, *held[1], lines if held[0] == h else None)
                    held = None
                if last_host == h:
                    emit(done, *page, last)
                else:
                    held = (h, page)  # the first of a host waits for the next
                last_host, last = h, lines
            yield _batch(done)
        if held is not None:
            done = []
            emit(done, *held[1], None)
            yield _batch(done)

    return _with_neighbours(pages, ranges).select("file_id", "title_lc", "content_lc", "host", "path", "own").mapInArrow(run, schema)


_FIELDS = {"file_id": pa.string(), "title": pa.string(), "title_kinds": pa.int32(), "content": pa.string(), "content_kinds": pa.int32(), "shared_kinds": pa.int32(), "n_shared": pa.int32()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _FIELDS.values())], list(_FIELDS))


def markup_kinds(cleaned: DataFrame) -> DataFrame:
    """file_id, field_name, markup: a row for each kind of markup that a line of a field held, whether the line was kept or,
    being shared, deleted."""
    bits = {"title": F.col("title_kinds"), "content": F.col("content_kinds").bitwiseOR(F.col("shared_kinds"))}
    each = [F.struct(F.lit(f"{field}_lc").alias("field_name"), F.lit(k).alias("markup"), b.bitwiseAND(F.lit(1 << i)).alias("hit")) for field, b in bits.items() for i, k in enumerate(KINDS)]
    return cleaned.select("file_id", F.inline(F.array(*each))).filter("hit <> 0").select("file_id", "field_name", "markup").distinct()
