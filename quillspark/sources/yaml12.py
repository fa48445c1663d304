"""YAML as its version 1.2 resolves it: no dates, no yes/no booleans, no octal or base-60 numbers, no repeated keys."""

from __future__ import annotations

import re

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None


class YamlError(ValueError):
    pass


def _loader() -> type:
    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+.0123456789"),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))

    def integer(loader: object, node: object) -> int:
        s = loader.construct_scalar(node)
        return int(s[2:], 8) if s.startswith("0o") else int(s, 16) if s.startswith("0x") else int(s)

    def number(loader: object, node: object) -> float:
        s = loader.construct_scalar(node).lower()
        return float(s.replace(".inf", "inf").replace(".nan", "nan"))

    def mapping(loader: object, node: object) -> dict:
        loader.flatten_mapping(node)
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            if isinstance(key, list | dict):
                key = str(key)
            if key in out:
                raise YamlError(f"duplicate key {key!r}")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Loader.add_constructor("tag:yaml.org,2002:int", integer)
    Loader.add_constructor("tag:yaml.org,2002:float", number)
    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return Loader


_LOADER = _loader() if yaml else None


def load(text: str) -> object:
    if yaml is None:
        raise YamlError("no YAML library is installed")
    try:
        return yaml.load(text, _LOADER)  # noqa: S506
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        raise YamlError(str(e)) from e


def dump(value: object) -> str:
    return yaml.safe_dump(value, allow_unicode=True, sort_keys=False, default_flow_style=False)


def dump_flow(value: object) -> str:
    """Compact text of a nested mapping."""
    return yaml.safe_dump(value, allow_unicode=True, sort_keys=False, default_flow_style=True, width=10**9).strip()
