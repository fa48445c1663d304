"""Configuration: override, then environment, then the vault's, the working folder's and the user's file, then default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

PREFIX = "QUILLSPARK_"
FILE = "quillspark.toml"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    vault_root: str
    index_path: str
    case_sensitive: bool = True
    read_only: bool = True
    feature_flags: tuple[str, ...] = field(default=())


def _load(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text()) if path.exists() else {}
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e


def parse_bool(name: str, text: str) -> bool:
    low = text.strip().lower()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off"):
        return False
    raise ConfigError(f"{name}: no boolean: {text!r}")


def resolve(overrides: dict | None = None, env: dict | None = None, cwd: str = ".", home: str | None = None) -> Config:
    """The vault's own file cannot name the vault root; everything else it may set goes before the other files."""
    o, e = overrides or {}, os.environ if env is None else env
    local, user = _load(Path(cwd) / FILE), _load(Path(home or e.get("HOME", "/")) / ".config" / FILE)
    root = o.get("vault_root") or e.get(PREFIX + "VAULT_ROOT") or local.get("vault_root") or user.get("vault_root")
    if not root:
        raise ConfigError("vault root is not configured")
    if not os.path.isdir(root):
        raise ConfigError(f"vault root does not exist: {root}")
    root = os.path.realpath(root)
    files = [_load(Path(root) / FILE), local, user]

    def pick(name: str, default: object) -> object:
        if o.get(name) is not None:
            return o[name]
        text = e.get(PREFIX + name.upper())
        if text is not None:
            return parse_bool(name, text) if isinstance(default, bool) else tuple(t.strip() for t in text.split(",") if t.strip()) if isinstance(default, tuple) else text
        for f in files:
            if name in f:
                return tuple(f[name]) if isinstance(default, tuple) else f[name]
        return default

    index = str(pick("index_path", os.path.join(root, ".quillspark", "index")))
    flags = tuple(sorted({str(f).lower() for f in pick("feature_flags", ())}))
    return Config(root, index if os.path.isabs(index) else os.path.join(root, index), bool(pick("case_sensitive", True)), bool(pick("read_only", True)), flags)
