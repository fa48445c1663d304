"""Scalar functions over paths, headings, links and tasks as Catalyst expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names that are no content (fixed values).
NOISE_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini", ".gitkeep", ".gitignore")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def title_of(path: Column) -> Column:
    """Last component without its last extension; a name that only starts with a dot keeps it."""
    return F.regexp_replace(last_segment(path), r"(?<=.)\.[^.]*$", "")


def folder_of(path: Column) -> Column:
    """Folder of a path, empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension_of(path: Column) -> Column:
    """Last extension without the dot, empty if there is none."""
    return F.regexp_extract(last_segment(path), r"(?<=.)\.([^.]*)$", 1)


def normalize_path_like(text: Column) -> Column:
    """Trim blanks, strip slashes at both ends, then turn backslashes into slashes."""
    return F.translate(F.regexp_replace(F.trim(text), r"^/+|/+$", ""), "\\", "/")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_order(path: Column) -> Column:
    """Sort key that compares paths with ASCII case ignored."""
    return ascii_lower(path)


def slugify(heading: Column) -> Column:
    """Letters and digits in lower case; other runs become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def strip_md(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(md|MD)$", "")


def wikilink_parts(raw: Column) -> Column:
    """Struct of a wikilink's text: target, display, heading, block. An empty target gives a null target.

    The first bar splits off the display text; a block (`#^id`) goes before a heading (`#text`).
    """
    head = F.trim(F.regexp_extract(raw, r"(?s)^([^|]*)", 1))
    display = F.when(F.instr(raw, "|") > 0, F.trim(F.regexp_extract(raw, r"(?s)^[^|]*\|(.*)$", 1)))
    target = F.trim(F.regexp_extract(head, r"(?s)^([^#]*)", 1))
    fragment = F.regexp_extract(head, r"(?s)^[^#]*#(.*)$", 1)
    is_block = F.startswith(fragment, F.lit("^"))
    block = F.when(is_block, F.trim(F.substring(fragment, 2, 1_000_000)))
    heading = F.when(~is_block & (fragment != ""), F.trim(fragment))
    return F.struct(F.nullif(target, F.lit("")).alias("target"), F.nullif(display, F.lit("")).alias("display"), F.nullif(heading, F.lit("")).alias("heading"), F.nullif(block, F.lit("")).alias("block"))


def wikilinks(text: Column) -> Column:
    """Texts between double square brackets, across lines, code included; an unterminated one ends the list."""
    return F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))


def block_ids(text: Column) -> Column:
    """Sorted distinct block ids: a caret at a line's start or after a blank, with the id at the line's end."""
    found = F.transform(F.split(text, "\r?\n"), lambda line: F.regexp_extract(line, r"(?:^|\s)\^\s*([A-Za-z0-9_-]+)\s*$", 1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def numbered_lines(text: Column) -> Column:
    """Array of (line_number from 1, line)."""
    return F.transform(F.split(text, "\r?\n"), lambda line, i: F.struct((i + 1).cast("int").alias("line_number"), line.alias("line")))


TASK = r"^\s*- \[( |x|X|-)\] (.*)$"
HEADING = r"^\s*(#{1,6})(?!#)\s*(\S.*)$"


def task_of(line: Column) -> Column:
    """Struct of a checkbox line: state (open, done, cancelled) and trimmed text; null for any other line."""
    mark = F.regexp_extract(line, TASK, 1)
    state = F.when(mark == " ", "open").when(mark == "-", "cancelled").otherwise("done")
    return F.when(F.rlike(line, F.lit(TASK)), F.struct(state.alias("state"), F.trim(F.regexp_extract(line, TASK, 2)).alias("text")))


def heading_of(line: Column) -> Column:
    """Struct of a heading line: level and text; null for any other line. No blank is needed after the signs."""
    return F.when(F.rlike(line, F.lit(HEADING)), F.struct(F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), F.trim(F.regexp_extract(line, HEADING, 2)).alias("text")))


def malformed_target(target: Column) -> Column:
    """Whether a target holds a character other than letters, digits, `/ _ - .`, blanks and round brackets."""
    return F.rlike(target, F.lit(r"[^\p{L}\p{N}/_\-.\s()]"))


def unresolved_reason(target: Column, heading: Column, block: Column) -> Column:
    """Why a link is unresolved; a fragment goes first, even where the note itself is missing."""
    return F.when(block.isNotNull(), "bad-block").when(heading.isNotNull(), "bad-anchor").when(malformed_target(target), "malformed-target").otherwise("missing-note")


def collapse_dots(path: Column) -> Column:
    """Path without `.` segments, and with each `..` taking the segment before it away."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(kept, "/")


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, without the root; the deepest goes first."""
    parts = F.split(folder, "/")
    every = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(every)


def folder_distance(a: Column, b: Column) -> Column:
    """Steps up and down between two folders."""
    pa, pb = (F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, "/")) for x in (a, b))
    depth = F.least(F.size(pa), F.size(pb))
    same = F.aggregate(
        F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, i: F.when(acc["on"] & (i < depth) & (F.get(pa, i) == F.get(pb, i)), F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("on"))),
    )["n"]
    return F.size(pa) + F.size(pb) - 2 * same


def is_noise(path: Column) -> Column:
    return last_segment(path).isin(*NOISE_NAMES)


def link_kind(block: Column, heading: Column, source_field: Column) -> Column:
    """How a link is shown."""
    return F.when(block.isNotNull(), "block").when(heading.isNotNull(), "heading").when(source_field == "body:embed", "embed").when(source_field == "body:markdown", "markdown").otherwise("wikilink")


def fts_normalize(text: Column) -> Column:
    """Text as a search surface: a blank before each word, words in lower case without diacritics.

    Marks are taken off by a table made of Unicode's own decompositions of the Latin, Greek and Cyrillic letters; text of
    ASCII alone, which has as many bytes as characters, is spared that.
    """
    low = F.lower(text)
    folded = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(F.regexp_replace(low, r"\p{M}+", ""), *_fold_table()))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")))


@cache
def _fold_table() -> tuple[str, str]:
    import unicodedata

    source, target = [], []
    for code in range(0x00C0, 0x2000):
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and unicodedata.category(d[0]).startswith("L") and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            source.append(c)
            target.append(d[0])
    return "".join(source), "".join(target)
