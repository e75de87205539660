"""Configuration trees from YAML with ``!include`` and ``!template``; driver side."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import IO, Any

import yaml


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over``; mappings merge key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


class Loader(yaml.SafeLoader):
    """Paths are relative to the file that names them."""

    def __init__(self, stream: IO[str]):
        super().__init__(stream)
        self.folder = os.path.dirname(os.path.abspath(getattr(stream, "name", "."))) if hasattr(stream, "name") else os.getcwd()

    def loaded(self, path: str) -> Any:
        with open(os.path.join(self.folder, path)) as f:
            if path.endswith((".yaml", ".yml")):
                return load(f)
            return json.load(f) if path.endswith(".json") else f.read()


def _include(loader: Loader, node: yaml.Node) -> Any:
    return loader.loaded(loader.construct_scalar(node))


def _template(loader: Loader, node: yaml.Node) -> Any:
    """``path`` and ``overrides`` (a mapping, or a list of mappings applied in turn)."""
    args = loader.construct_mapping(node, deep=True)
    out, overrides = loader.loaded(args["path"]), args.get("overrides") or []
    for over in [overrides] if isinstance(overrides, Mapping) else overrides:
        out = merged(out, over)
    return out


Loader.add_constructor("!include", _include)
Loader.add_constructor("!template", _template)


def load(stream: IO[str]) -> Any:
    return yaml.load(stream, Loader)
