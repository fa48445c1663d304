"""Segments of documents in which residue is sought, each in a masked normal form.

Segments are the sentences of a text, the tails of a sentence that begin with a capital, slots (a name between signs that
stand for a place to fill) and runs of filler. That something is a segment does not make it residue: likeness to the
trusted examples does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from quillspark.llm.examples import ALIKE, ALIKE_PAIRS, DUMMY, FIELD, FRAME, LATIN, OPTIONAL, TRUSTED

_CODE = re.compile(r"(?ms)(```+|~~~+)[^\n`~]*\n.*?(?:\1|\Z)|(?<!`)(`{1,3})(?!`)[^`\n]+\2(?!`)|<(pre|code)\b[^<>]*>.*?</\3\s*>")
_QUOTE = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]*’(?!\w)")
_DATA = re.compile(r"(?m)^[ \t]*>.*$|^[ \t]*[{\[][\"'].*[}\]],?[ \t]*$|^[ \t]*\|.*\|[ \t]*$")
_TAG = re.compile(r"(?<!<)</?(?:html|head|title|body|h[1-6]|p|div|span|noscript|br|b|i|em|strong|a|ul|ol|li|section|main|header|footer)\b[^<>]*>(?!>)", re.I)
_CUT = re.compile(r"\n+|(?<=[.!?…;])\s+|\s(?=[-*] |©)")
_WORD = re.compile(r"[^\W_]+|…|\.\.\.")
_NUMBER = re.compile(r"(?=\w*\d)[0-9a-f]+|\d+")
_SLOT = re.compile(
    r"\{\{(?P<a>[^{}\n]*)\}\}|<%(?P<b>[^%<>\n]*)%>|\{%(?P<c>[^%{}\n]*)%\}|%\((?P<d>[^()\n]*)\)[sd]?|(?<![\w%])%(?P<e>\w[\w.]*)%(?!\w)|(?<![\w$])\$(?P<f>[A-Za-z]\w*)\$(?!\w)"
    r"|[$#]\{(?P<g>[^{}\n]*)\}|(?<![\w${#%\\}])\{(?P<h>[^{}\n]*)\}(?!\})|@@(?P<i>[^@\n]+)@@|<<(?P<j>[^<>\n]+)>>|\[\[(?P<fill>[^\[\]\n]*)\]\]"
    r"|\[(?P<square>[^\[\]\n]*)\]|<(?P<angle>[^<>\n]*)>|\((?P<round>[^()\n]*)\)|\b(?P<frame>[A-Z]{2,})_[A-Z_]+_(?P=frame)\b|(?P<todo>__[A-Z][A-Z0-9_]*)"
    r"|\b(?P<caps>[A-Z]+(?: [A-Z]+)+)\b|\b(?P<date>[YMD]{2,4}[-./][YMD]{2,4}[-./][YMD]{2,4})\b|\b(?P<names>[Ff]irst ?[Nn]ame [Ll]ast ?[Nn]ame)\b|:\s*(?P<same>(?P<sign>[x_?])(?P=sign){2,})(?=\s|$)"
)
#: Signs without which a sentence holds no slot.
_SLOT_SIGN = re.compile(r"[{%$@<\[(_]|[A-Z]{2}|ast ?[Nn]ame|:\s*(?:xxx|\?\?\?)")
_AND = frozenset("and or und oder et ou y o".split())
_IN_BRACKETS = 8  # a slot in brackets holds a few words; what is longer is a remark


def _marks() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    one = {w: f"<{c}>" for c, words in ALIKE.items() for w in words.split()}
    two: dict[str, dict[str, str]] = {}
    for c, pairs in ALIKE_PAIRS.items():
        for a, b in map(str.split, filter(lambda p: p.count(" ") == 1, pairs.split(", "))):
            two.setdefault(a, {})[b] = c if c == "cannot" else f"<{c}>"
    return one, two


_ONE, _TWO = _marks()
_OPTIONAL = {p.split()[0]: [q.split() for q in OPTIONAL.split(", ") if q.split()[0] == p.split()[0]] for p in OPTIONAL.split(", ")}


_SPECIAL = frozenset((*_ONE, *_TWO, *_OPTIONAL))


def sentences(text: str) -> list[str]:
    """Sentences and lines of the text without code, quotes and data; tags of a page end a sentence."""
    if "`" in text or "~~~" in text or "<" in text:
        text = _CODE.sub(" ", text)
    text = _DATA.sub("", text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    out = []
    for s in _CUT.split(text):
        s = _QUOTE.sub(' "" ', s).strip(" \t-*#+")
        if s:
            out.append(s)
    return out


def normal(s: str) -> tuple[list[str], list[str]]:
    """Lower-case words of a sentence, with numbers, articles and words that are alike in residue masked; and the word as
    written with which each of them begins. A run of words of one class gives one mark, unless a new clause begins within."""
    found = _WORD.findall(s)
    raw = [w.lower() for w in found]
    out: list[str] = []
    at: list[str] = []
    i, n, article = 0, len(raw), ""
    while i < n:
        w, begin = raw[i], found[i]
        i += 1
        if w in _SPECIAL:
            if w in _OPTIONAL:
                skip = next((len(q) for q in _OPTIONAL[w] if raw[i - 1 : i - 1 + len(q)] == q), 0)
                if skip and out:
                    i += skip - 1
                    continue
            if w in _TWO and i < n and raw[i] in _TWO[w]:
                w = _TWO[w][raw[i]]
                i += 1
            elif w in _ONE:
                w = _ONE[w]
                if w == "<the>":
                    article = article or begin
                    continue
            if w[0] == "<" and out and out[-1] == w and not article[:2].istitle():
                article = ""
                continue
        elif not w.isalpha():
            w = "…" if w == "..." else _NUMBER.sub("0", w)
        out.append(w)
        at.append(article or begin)
        article = ""
    return out, at


def bare(words: list[str]) -> str:
    """The words as a text, without the regrets before a message."""
    i = 0
    while i < len(words) - 1:
        if words[i] in ("<sorry>", "but"):
            i += 1
        elif words[i : i + 3] == ["we", "are", "<sorry>"] and i + 3 < len(words):
            i += 3
        else:
            break
    return " ".join(words[i:])


def _name(inner: str) -> str:
    """The shape of the name in a slot: a (lower case), A (capitals), Aa (mixed), `a a` (several words), or the text itself
    where it is no name."""
    t = inner.strip().lstrip("-= ").strip()
    if t.lower() in _AND or not t[:1].isalpha():
        return t.lower()
    if re.fullmatch(r"[a-z][a-z_]*(?:\.[a-z_]+)*(?::[A-Z.-]+)?", t):
        return "a"
    if re.fullmatch(r"[A-Z][A-Z0-9_.]*", t):
        return "A"
    if re.fullmatch(r"[A-Za-z][\w.]*", t):
        return "Aa"
    return "a a" if re.fullmatch(r"[\w.:|/-]+(?: +[\w.:|/-]+)*", t) else t.lower()


def slots(s: str) -> Iterator[str]:
    """Slots of a sentence: their signs with the shape of the name, or, in brackets, with the words around it."""
    for m in _SLOT.finditer(s):
        kind = m.lastgroup if m.lastgroup != "sign" else "same"
        inner = m.group(kind)
        if kind in ("square", "angle", "round"):
            words = _WORD.findall(inner.lower())
            shape: list[str] = []
            for w in words[: _IN_BRACKETS + 1]:
                w = w if w in FRAME else "x"
                if not shape or shape[-1] != "x" or w != "x":
                    shape.append(w)
            if words and len(words) <= _IN_BRACKETS and shape != ["x"]:
                yield f"slot {m.group()[0]} " + " ".join(shape)
            if kind == "round" and s[: m.start()].rstrip().endswith(":"):
                yield "slot : " + inner.lower()
        elif kind == "fill":
            if ":" in inner:
                yield "slot [[ " + inner.rsplit(":", 1)[1].strip()
        elif kind == "frame":
            yield f"slot {inner} A {inner}"
        elif kind == "todo":
            yield "slot __ A " + (inner.rstrip("_").rsplit("__", 1)[1] if "__" in inner[2:].rstrip("_") else "")
        elif kind == "caps":
            words = ["f" if w.lower() in FIELD else w.lower() for w in inner.split()]
            for pair in zip(words, words[1:]):
                if pair.count("f") == 1 and not FRAME.isdisjoint(pair):
                    yield "slot caps " + " ".join(pair)
        elif kind == "date":
            yield "slot date pattern"
        elif kind == "names":
            yield "slot first name last name"
        elif kind == "same":
            yield "slot : " + inner[0] * 3
        else:
            yield f"slot {re.match(r'[^\w\s]+', m.group()).group()} {_name(inner)}"


def fillers(words: list[str]) -> Iterator[str]:
    """Runs of filler among the normal words: Latin words, a word again and again, two words again and again."""
    n = len(words)
    if n >= 5:
        known = [w in LATIN or w in DUMMY for w in words]
        run = longest = 0
        for k in known:
            run = run + 1 if k else 0
            longest = max(longest, run)
        if longest >= 8 or sum(known) >= 0.8 * n:
            yield "filler of latin"
    if n >= 2 and (words[0] == words[1] or n > 2 and words[2] in words[:2]):
        kinds = set(words)
        if not all(map(str.isalpha, kinds)):
            return
        if len(kinds) == 1:
            yield f"filler {words[0]} twice" if n == 2 else "filler of one word"
        elif len(kinds) == 2 and n >= 6:
            yield "filler of two words"


def whole(s: str) -> list[str]:
    """Segments of a sentence without its tails."""
    words = normal(s)[0]
    out = list(slots(s)) if _SLOT_SIGN.search(s) else []
    out += fillers(words)
    if words:
        out.append(bare(words))
    return out


def _trusted() -> dict[str, str]:
    forms: dict[str, str] = {}
    for kind, lines in TRUSTED.items():
        for line in lines.strip().split("\n"):
            got = [x for x in whole(line) if x.startswith("slot ") == (kind == "placeholder")]
            for g in [x for x in got if x.startswith("filler ")] or got:
                forms.setdefault(g, kind)
    return forms


#: Normal form of each trusted example, and its kind.
SEEDS = _trusted()
_VOCABULARY = frozenset(w for s in SEEDS for w in s.split())
_LONGEST = max(len(s.split()) for s in SEEDS) * 3 // 2


def segments(s: str) -> list[str]:
    """Segments of a sentence. Its tails count where two thirds of their words stand in trusted examples, as less cannot
    be alike, and where they are at most half as long again as the longest of these."""
    words, at = normal(s)
    out = list(slots(s)) if _SLOT_SIGN.search(s) else []
    out += fillers(words)
    if words:
        out.append(bare(words))
    known = 0
    for n, i in enumerate(range(len(words) - 1, 0, -1), 1):
        if n > _LONGEST:
            break
        known += words[i] in _VOCABULARY
        if 3 * known >= 2 * n and (at[i][0].isupper() or at[i][0].isdigit()):
            out.append(bare(words[i:]))
            out += fillers(words[i:])
    return out
