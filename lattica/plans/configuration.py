"""Configuration documents: JSON trees with references, and the order in which their parts run."""

from __future__ import annotations

import graphlib
import json
from collections.abc import Callable
from copy import deepcopy
from pathlib import Path


class ReferenceError_(ValueError):
    """A reference leads nowhere, or in a circle."""


def _at(tree, path: str):
    for key in [k for k in path.split("/") if k]:
        try:
            tree = tree[int(key)] if isinstance(tree, list) else tree[key]
        except (KeyError, IndexError, ValueError, TypeError):
            raise ReferenceError_(f"nothing at {path}") from None
    return tree


def merge(base, over):
    """over on top of base: dicts key by key, anything else replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merge(base[k], over[k]) if k in base and k in over else deepcopy(over.get(k, base.get(k))) for k in {**base, **over}}
    return deepcopy(over)


def parse(text: str, folder: str = ".", read: Callable[[str], str] | None = None) -> dict:
    """A JSON document with its references resolved.

    {"$ref": "file#/path", ...} stands for the node there, below which further keys are merged. {"$ref": ...,
    "$import": [keys], ...} takes only those keys of it. Without a file the reference is into the document itself.
    """
    read = read or (lambda name: Path(folder, name).read_text())
    documents: dict[str, object] = {"": json.loads(text)}

    def resolve(node, home: str, open_: tuple):
        if isinstance(node, list):
            return [resolve(x, home, open_) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" not in node:
            return {k: resolve(v, home, open_) for k, v in node.items()}
        name, _, path = node["$ref"].partition("#")
        where = name or home
        if (where, path) in open_:
            raise ReferenceError_(f"{node['$ref']} refers to itself")
        if where not in documents:
            documents[where] = json.loads(read(where))
        target = resolve(_at(documents[where], path), where, (*open_, (where, path)))
        own = {k: resolve(v, home, open_) for k, v in node.items() if k not in ("$ref", "$import")}
        if "$import" in node:
            missing = [k for k in node["$import"] if k not in target]
            if missing:
                raise ReferenceError_(f"{node['$ref']} has no {', '.join(missing)}")
            target = {k: target[k] for k in node["$import"]}
        return merge(target, own)

    return resolve(documents[""], "", ())


def in_order(depends: dict[str, list[str]]) -> list[str]:
    """Names after what they depend on, by name where that leaves a choice; unknown names are ignored, circles raise."""
    sorter = graphlib.TopologicalSorter({k: [d for d in v if d in depends] for k, v in sorted(depends.items())})
    sorter.prepare()
    out: list[str] = []
    ready: list[str] = []
    while sorter.is_active():
        ready = sorted({*ready, *sorter.get_ready()})
        out.append(ready.pop(0))
        sorter.done(out[-1])
    return out


def walk(tree, path: tuple = ()):
    """(path, node) of every node, from the root on."""
    yield path, tree
    for k, v in tree.items() if isinstance(tree, dict) else enumerate(tree) if isinstance(tree, list) else ():
        yield from walk(v, (*path, k))


#: What an empty configuration has.
DEFAULT = {"name": "network", "network": {"x": 200.0, "y": 200.0, "z": 200.0, "chunk_size": [100.0, 100.0, 100.0]}, "regions": {}, "partitions": {}, "cell_types": {}, "placement": {}, "connectivity": {}}


def with_defaults(tree: dict) -> dict:
    return merge(DEFAULT, tree)
