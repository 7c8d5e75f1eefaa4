"""Object-notation sidecar files: dependency manifests and export contracts."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from graphmill.frontend.lexer import string_value
from graphmill.frontend.syntax import Node, Tree


def parse_object(text: str) -> tuple[Tree, Node | None]:
    """The tree of a bare object literal; None where it is empty or broken."""
    tree = Tree(b"const value = " + text.strip().encode() + b";")
    if not text.strip() or tree.problems or not tree.root.members or tree.root.members[0].kind != "var":
        return tree, None
    return tree, tree.root.members[0].init


def entries(tree: Tree, node: Node | None) -> list[tuple[str, Node]]:
    if node is None or node.kind != "struct_init":
        return []
    return [(tree.name(n), v) for n, v in zip(node.names, node.values, strict=True)]


def strings(tree: Tree, node: Node | None) -> list[str]:
    values = node.values if node is not None and node.kind == "array_init" else []
    return [string_value(tree.text(v.token)) for v in values if v.kind == "string"]


@dataclass
class Manifest:
    """Names of dependencies, and the folders of those that are given by path."""

    dependencies: set[str] = field(default_factory=set)
    paths: set[str] = field(default_factory=set)

    @classmethod
    def parse(cls, text: str) -> Manifest:
        out = cls()
        tree, node = parse_object(text)
        for key, value in entries(tree, node):
            if key != "dependencies":
                continue
            for name, spec in entries(tree, value):
                out.dependencies.add(name)
                for k, v in entries(tree, spec):
                    if k == "path" and v.kind == "string":
                        out.paths.add(posixpath.normpath(string_value(tree.text(v.token))))
        return out


@dataclass
class Contract:
    """Declarations that count as used from outside: ``path`` or ``path:name``."""

    exports: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Contract:
        tree, node = parse_object(text)
        return cls([s for key, value in entries(tree, node) if key == "exports" for s in strings(tree, value)])
