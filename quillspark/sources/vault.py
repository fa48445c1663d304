"""Vault source: manifest of a directory tree, fingerprints, and the contents of notes."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillspark.ids import Blake3, blake3_hex, blake3_many, make_id
from quillspark.sources.yaml12 import YamlError, dump_flow, load

PRUNED = (".git", ".obsidian", ".quillspark")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MANIFEST = "absolute_path string, normalized_path string, match_key string, size_bytes long, modified_unix_ms long"


class VaultPathError(ValueError):
    pass


def validate_relative(path: str) -> str:
    """A path within the vault: not empty, not absolute, without `.` and `..`."""
    if not path.strip():
        raise VaultPathError("path is empty")
    if path.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", path):
        raise VaultPathError(f"path is absolute: {path}")
    if any(p in (".", "..") for p in re.split(r"[/\\]", path)):
        raise VaultPathError(f"path holds a dot segment: {path}")
    return path


def canonicalize(root: str, path: str, case_sensitive: bool = True) -> dict:
    """Absolute, normalised and match form of a path; a path that leaves the root through links is an error."""
    real_root, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if full != real_root and not full.startswith(real_root + os.sep):
        raise VaultPathError(f"path is outside of the vault: {path}")
    rel = normalize_relative(os.path.relpath(full, real_root))
    return {"absolute_path": full, "normalized_path": rel, "match_key": rel if case_sensitive else rel.lower()}


def normalize_relative(path: str) -> str:
    """Components in composed form (NFC), joined by slashes."""
    return "/".join(unicodedata.normalize("NFC", p) for p in path.split(os.sep) if p)


def _walk(root: str, sub: str = "") -> Iterator[tuple[str, str, int, int]]:
    stack = [os.path.join(root, sub) if sub else root]
    while stack:
        with os.scandir(stack.pop()) as entries:
            for e in entries:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if not (os.path.dirname(e.path) == root and e.name in PRUNED):
                        stack.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    st = e.stat(follow_symlinks=False)
                    yield e.path, normalize_relative(os.path.relpath(e.path, root)), st.st_size, st.st_mtime_ns // 1_000_000


def _top(root: str, want: int) -> list[str]:
    """Files and folders that together hold the tree, folders opened level by level until there are `want` of them."""
    files: list[str] = []
    folders = [root]
    while folders and len(folders) < want:
        below: list[str] = []
        for folder in folders:
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        if e.is_symlink() or folder == root and e.name in PRUNED and e.is_dir():
                            continue
                        if e.is_dir(follow_symlinks=False):
                            below.append(e.path)
                        elif e.is_file(follow_symlinks=False):
                            files.append(e.path)
            except OSError:
                continue
        folders = below
    return [os.path.relpath(p, root) for p in files + folders]


def scan(spark: SparkSession, root: str, case_sensitive: bool = True) -> DataFrame:
    """Manifest of all regular files under root, hidden ones too; links are not followed, and version control,
    editor and index folders at the top are left out. The driver opens folders until there are enough for all tasks, however
    deep they lie; what is below them is listed by the executors."""
    root = os.path.realpath(root)
    tasks_ = 4 * spark.sparkContext.defaultParallelism
    top = _top(root, tasks_)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name in pdf["name"]:
                full = os.path.join(root, name)
                if os.path.isfile(full):
                    st = os.stat(full)
                    rows = [(full, normalize_relative(name), st.st_size, st.st_mtime_ns // 1_000_000)]
                else:
                    rows = list(_walk(root, name))
                for i in range(0, len(rows), 10_000):
                    part = pd.DataFrame(rows[i : i + 10_000], columns=["absolute_path", "normalized_path", "size_bytes", "modified_unix_ms"])
                    part["match_key"] = part["normalized_path"] if case_sensitive else part["normalized_path"].map(lambda p: p.translate(LOWER))
                    yield part[["absolute_path", "normalized_path", "match_key", "size_bytes", "modified_unix_ms"]]

    names = spark.createDataFrame([(n,) for n in sorted(top)], "name string")
    return names.repartition(max(1, min(len(top), tasks_)), "name").mapInPandas(run, MANIFEST)


def hash_file(path: str) -> str:
    h = Blake3()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def fingerprint(path: str) -> dict:
    st = os.stat(path)
    return {"size_bytes": st.st_size, "modified_unix_ms": st.st_mtime_ns // 1_000_000, "hash_blake3": hash_file(path)}


# --- notes -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FrontMatter:
    raw: str | None
    body: str
    status: str  # missing, parsed, malformed
    value: object = None
    error: str = ""
    first_line: int = 0  # lines before the body


def split_front_matter(text: str) -> tuple[str | None, str, int]:
    """Front matter between `---` lines, if the first line is exactly that; unclosed, all is body."""
    lines = text.splitlines(keepends=True)
    if lines and lines[0].rstrip("\r\n") == "---":
        for i in range(1, len(lines)):
            if lines[i].rstrip("\r\n") == "---":
                return "".join(lines[1:i]), "".join(lines[i + 1 :]), i + 1
    return None, text, 0


def extract_front_matter(text: str) -> FrontMatter:
    raw, body, skipped = split_front_matter(text)
    if raw is None:
        return FrontMatter(None, body, "missing")
    try:
        return FrontMatter(raw, body, "parsed", load(raw), first_line=skipped)
    except YamlError as e:
        return FrontMatter(raw, body, "malformed", error=str(e), first_line=skipped)


HEADING = re.compile(r"^\s*(#{1,6})(?!#)\s*(\S.*)$")
TASK = re.compile(r"^\s*- \[( |x|X|-)\] (.*)$")
BLOCK_ID = re.compile(r"(?:^|\s)\^\s*([A-Za-z0-9_-]+)\s*$")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def headings(body: str) -> list[tuple[int, str, int]]:
    """(level, text, line) of the headings; code is not left out and no blank is needed after the signs."""
    out = []
    for i, line in enumerate(body.splitlines(), 1):
        m = HEADING.match(line)
        if m:
            out.append((len(m[1]), m[2].strip(), i))
    return out


def slugify(text: str) -> str:
    return re.sub(r"[^\w]+|_+", "-", text.strip().lower(), flags=re.UNICODE).strip("-")


def title_of(body: str, path: str) -> str:
    """First heading, else the file's name without extension."""
    found = headings(body)
    name = path.rsplit("/", 1)[-1]
    return found[0][1] if found else name.rsplit(".", 1)[0] if "." in name[1:] else name


def tasks(text: str) -> list[tuple[int, str, str]]:
    state = {" ": "open", "-": "cancelled"}
    return [(i, state.get(m[1], "done"), m[2].strip()) for i, line in enumerate(text.splitlines(), 1) if (m := TASK.match(line))]


def block_ids(text: str) -> list[str]:
    return sorted({m[1] for line in text.splitlines() if (m := BLOCK_ID.search(line))})


# --- properties --------------------------------------------------------------------------------------------------

LIST_KEYS = {"tag": "tags", "tags": "tags", "alias": "aliases", "aliases": "aliases", "cssclass": "cssclasses", "cssclasses": "cssclasses"}


def _typed(v: object) -> tuple[str, object]:
    if v is None:
        return "null", None
    if isinstance(v, bool):
        return "bool", v
    if isinstance(v, int | float):
        return "number", float(v)
    if isinstance(v, list):
        return "list", [_typed(x)[1] for x in v]
    if isinstance(v, dict):
        return "string", dump_flow(v)
    return ("date" if DATE.match(str(v)) else "string"), str(v)


def _split(v: object, key: str) -> list[str]:
    parts = v if isinstance(v, list) else [v]
    out = []
    for p in parts:
        if p is None or isinstance(p, list | dict):
            continue
        text = str(p).lower() if isinstance(p, bool) else str(p)
        for t in re.split(r"," if key == "aliases" else r"[,\s]+", text):
            t = t.strip().lstrip("#") if key == "tags" else t.strip()
            if t:
                out.append(t)
    return out


class PropertyError(ValueError):
    pass


def project_properties(root: object) -> list[tuple[str, str, object]]:
    """(key, type, value) sorted by key. Spellings of tags, aliases and cssclasses are merged and split into words, once
    each with case ignored; keys that are no strings are left out; a root that is no mapping is an error."""
    if not isinstance(root, dict):
        raise PropertyError("front matter must be a mapping")
    out, merged = {}, {}
    for k, v in root.items():
        if not isinstance(k, str):
            continue
        name = LIST_KEYS.get(k.lower())
        if name:
            for t in _split(v, name):
                merged.setdefault(name, {}).setdefault(t.lower(), t)
            merged.setdefault(name, {})
        else:
            out[k] = _typed(v)
    for k, words in merged.items():
        out[k] = ("list", list(words.values()))
    return [(k, *out[k]) for k in sorted(out)]


def json_text(v: object) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


# --- links -------------------------------------------------------------------------------------------------------

WIKI = re.compile(r"\[\[(.*?)\]\]", re.S)
FENCE = re.compile(r"(?ms)^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)")
MD_LINK = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*(?:<([^<>\n]*)>|((?:[^()\s]|\([^()\s]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]+:")


def parse_wikilink(raw: str) -> dict | None:
    """target, display, heading, block of a wikilink's text; None if the target is empty."""
    head, bar, display = raw.partition("|")
    target, sign, fragment = head.strip().partition("#")
    if not target.strip():
        return None
    block = fragment[1:].strip() if sign and fragment.startswith("^") else None
    heading = fragment.strip() if sign and not fragment.startswith("^") else None
    return {"target": target.strip(), "display": display.strip() or None if bar else None, "heading": heading or None, "block": block or None}


#: `[label]: target "title"`, and the uses of such a label: `[text][label]`, `[label][]` and `[label]`.
DEFINITION = re.compile(r"(?m)^[ ]{0,3}\[(?!\^)((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|(\S+))(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*$")
REFERENCE = re.compile(r"(!?)(?<![\[\\])\[(?!\^)((?:[^\[\]\\]|\\.)+)\](?:\[((?:[^\[\]\\]|\\.)*)\])?(?![\[(:\]])")


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _target(url: str) -> str | None:
    """The path in the vault that a URL names, or None."""
    if not url or url.startswith("//") or SCHEME.match(url):
        return None
    return unquote(url.partition("#")[0].partition("?")[0]).strip().strip("/").replace("\\", "/") or None


def markdown_links(text: str) -> list[dict]:
    """Links and images with a target in the vault: kind, raw, target; inline ones, images within the text of links, and those
    by reference to a definition, of which the first of a label counts. Code is left out, and what is escaped; targets with a
    scheme or `//` are dropped; fragment and query are taken off, and percent signs decoded."""
    found: list[tuple[bool, str]] = []
    plain = FENCE.sub("", text)
    plain = re.sub(r"(`+)(?!`).+?(?<!`)\1(?!`)", "", plain)
    named: dict[str, str] = {}
    if "]:" in plain:
        for m in DEFINITION.finditer(plain):
            named.setdefault(_label(m[1]), m[2] if m[2] is not None else m[3])
        plain = DEFINITION.sub("", plain)

    def inline(part: str) -> str:
        """Takes the inline links of a part, and leaves what is around them."""

        def take(m: re.Match) -> str:
            if part[m.start() - 1 : m.start()] == "\\":
                return m[0]
            if "](" in m[2]:
                inline(m[2])
            found.append((bool(m[1]), (m[3] if m[3] is not None else m[4]).strip()))
            return " "

        return MD_LINK.sub(take, part)

    rest = inline(plain)
    if named:
        for m in REFERENCE.finditer(rest):
            url = named.get(_label(m[3] or m[2]))
            if url is not None:
                found.append((bool(m[1]), url))
    return [{"kind": "embed" if image else "markdown", "raw": url, "target": target} for image, url in found if (target := _target(url))]


def _front_links(v: object, where: str) -> Iterator[tuple[str, str]]:
    if isinstance(v, str):
        for m in WIKI.finditer(v):
            yield where, m[0]
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from _front_links(x, f"{where}[{i}]")
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from _front_links(x, f"{where}.{k}")


def links_of(front: object, body: str) -> list[dict]:
    """All links of a note, sorted and without repeats; a link's place becomes part of its id."""
    rows = []
    for m in WIKI.finditer(body):
        rows.append(("body", "wikilink", m[0]))
    if isinstance(front, dict):
        for k, v in front.items():
            rows += [(f"frontmatter:{where}", "wikilink", raw) for where, raw in _front_links(v, str(k))]
    out = set()
    for source, kind, raw in rows:
        link = parse_wikilink(raw[2:-2])
        if link:
            out.add((source, kind, raw, link["target"], link["heading"] or "", link["block"] or ""))
    for link in markdown_links(body):
        source = "body:embed" if link["kind"] == "embed" else "body:markdown"
        out.add((source, link["kind"], link["raw"], link["target"], "", ""))
    return [{"source_field": s, "raw": r, "target": t, "heading": h or None, "block": b or None} for s, _, r, t, h, b in sorted(out)]


# --- preparation of entries --------------------------------------------------------------------------------------

PREPARED = (
    "file_id string, normalized_path string, match_key string, absolute_path string, size_bytes long, modified_unix_ms long, hash_blake3 string, is_markdown boolean, "
    "title_lc string, content_lc string, front_raw string, "
    "properties array<struct<key:string,value_type:string,value_json:string>>, "
    "tasks array<struct<line_number:int,state:string,text:string>>, "
    "headings array<struct<level:int,text:string,slug:string,line_number:int>>, "
    "blocks array<string>, "
    "links array<struct<link_id:string,source_field:string,raw_target:string,heading_slug:string,block_id:string>>, "
    "base_config string, diagnostics array<struct<code:string,message:string>>"
)




def prepare(entry: dict, file_id: str | None = None, strict: bool = False, data: bytes | None = None, digest: str | None = None, raw_ids: bool = False) -> dict:
    """All index rows of one file, read from disk unless its bytes are given; raw_ids leaves link ids as the text to hash. A file that can't be read, and front matter that is no mapping, become diagnostics;
    with strict=True the latter is an error."""
    path = entry["normalized_path"]
    fid = file_id or make_id("file", path)
    out = {**{k: entry[k] for k in ("normalized_path", "match_key", "absolute_path", "size_bytes", "modified_unix_ms")}, "file_id": fid, "is_markdown": path.endswith(".md")}
    out |= {"title_lc": None, "content_lc": None, "front_raw": None, "properties": [], "tasks": [], "headings": [], "blocks": [], "links": [], "base_config": None, "diagnostics": []}
    try:
        data = Path(entry["absolute_path"]).read_bytes() if data is None else data
    except OSError as e:
        return out | {"hash_blake3": None, "diagnostics": [{"code": "read_failed", "message": str(e)}]}
    out["hash_blake3"] = digest or blake3_hex(data)
    if path.endswith(".base"):
        out["base_config"] = json_text({"raw": data.decode(errors="replace")})
    if not out["is_markdown"]:
        return out
    text = data.decode(errors="replace")
    front = extract_front_matter(text)
    name = path.rsplit("/", 1)[-1]
    out["title_lc"] = (name.rsplit(".", 1)[0] if "." in name[1:] else name).lower()
    out["content_lc"] = text.lower()
    out["front_raw"] = front.raw
    if front.status == "parsed":
        try:
            out["properties"] = [{"key": k, "value_type": t, "value_json": json_text(v)} for k, t, v in project_properties(front.value)]
        except PropertyError as e:
            if strict:
                raise
            out["diagnostics"].append({"code": "properties.not_a_mapping", "message": str(e)})
    elif front.status == "malformed":
        out["diagnostics"].append({"code": "frontmatter.malformed", "message": front.error[:500]})
    out["tasks"] = [{"line_number": n, "state": s, "text": t} for n, s, t in tasks(text)]
    out["headings"] = [{"level": lv, "text": t, "slug": slugify(t), "line_number": n} for lv, t, n in headings(front.body)]
    out["blocks"] = block_ids(front.body)
    for i, link in enumerate(links_of(front.value, front.body)):
        id_text = f"{fid}:{i}:{link['source_field']}:{link['raw']}"
        out["links"].append(
            {
                "link_id": id_text if raw_ids else make_id("link", id_text),
                "source_field": link["source_field"],
                "raw_target": link["target"],
                "heading_slug": slugify(link["heading"]) if link["heading"] else None,
                "block_id": link["block"],
            }
        )
    return out


BATCH_BYTES = 8 << 20


def _prepare_all(entries: Iterator[tuple[dict, str | None, bytes | None]], strict: bool) -> Iterator[pd.DataFrame]:
    """Prepared rows, a few megabytes of contents at a time, with contents and link ids hashed in bulk."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", PREPARED)]

    def flush(part: list[tuple[dict, str | None, bytes | None]]) -> pd.DataFrame:
        digests = iter(blake3_many([d for _, _, d in part if d is not None]))
        rows = [prepare(e, fid, strict, d, next(digests) if d is not None else None, True) for e, fid, d in part]
        links = [link for r in rows for link in r["links"]]
        for link, h in zip(links, blake3_many([link["link_id"].encode() for link in links])):
            link["link_id"] = "link_" + h[:16]
        return pd.DataFrame(rows, columns=names)

    part, size = [], 0
    for e, fid, data in entries:
        part.append((e, fid, data))
        size += len(data or b"")
        if size >= BATCH_BYTES or len(part) >= 2000:
            yield flush(part)
            part, size = [], 0
    if part:
        yield flush(part)


def _read(path: str) -> bytes | None:
    try:
        return Path(path).read_bytes()
    except OSError:
        return None  # prepare() tells what is wrong


def prepare_entries(manifest: DataFrame, strict: bool = False) -> DataFrame:
    """PREPARED rows of a manifest; a column file_id, if there is one, keeps the ids of known files."""
    has_id = "file_id" in manifest.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (e for pdf in it for e in pdf.to_dict("records"))
        yield from _prepare_all(((e, e["file_id"] if has_id and isinstance(e["file_id"], str) else None, _read(e["absolute_path"])) for e in every), strict)

    cols = ["absolute_path", "normalized_path", "match_key", "size_bytes", "modified_unix_ms"] + (["file_id"] if has_id else [])
    return manifest.select(*cols).mapInPandas(run, PREPARED)


def prepare_texts(notes: DataFrame) -> DataFrame:
    """PREPARED rows of notes whose text is at hand: file_id, normalized_path, text. A null text is an empty one."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def every() -> Iterator[tuple[dict, str | None, bytes | None]]:
            for pdf in it:
                for fid, path, text in zip(pdf["file_id"], pdf["normalized_path"], pdf["text"]):
                    data = (text or "").encode()
                    yield {"normalized_path": path, "match_key": path, "absolute_path": path, "size_bytes": len(data), "modified_unix_ms": 0}, fid, data

        yield from _prepare_all(every(), False)

    return notes.select("file_id", "normalized_path", "text").mapInPandas(run, PREPARED)


def read_note(root: str, path: str) -> dict:
    """A note as it is on disk, not as indexed: path, title, front_matter, body, headings, properties."""
    validate_relative(path)
    text = Path(canonicalize(root, path)["absolute_path"]).read_text(errors="replace")
    front = extract_front_matter(text)
    props = project_properties(front.value) if front.status == "parsed" and isinstance(front.value, dict) else []
    return {"path": path, "title": title_of(front.body, path), "front_matter": front.raw, "body": front.body, "headings": [{"level": a, "text": b, "line": c} for a, b, c in headings(front.body)], "properties": {k: v for k, _, v in props}}


