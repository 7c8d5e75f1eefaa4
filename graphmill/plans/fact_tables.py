"""Per-file fact tables: one row a token, comment, node, symbol, scope, binding, reference, container item, import or diagnostic.

Each table is a map over files (project, path, text) without a shuffle: a file is read by itself. What needs several files is in ``projects``.
Offsets are bytes; ids count within their file; a null text is an empty file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.frontend.binder import Unit
from graphmill.frontend.resolver import in_container
from graphmill.functions.flags import REFERENCE_FLAGS, SCOPE_FLAGS, SYMBOL_FLAGS, bits

Rows = Iterator[tuple]


def _tokens(u: Unit) -> Rows:
    for i, t in enumerate(u.tree.lexed.tokens):
        yield i, t.tag, t.start, t.end


def _comments(u: Unit) -> Rows:
    yield from u.tree.comments


def _nodes(u: Unit) -> Rows:
    for n in u.tree.nodes:
        owner = u.owner(n)
        yield n.id, n.kind, n.parent.id if n.parent else None, n.token, n.first, n.last, u.scope_of.get(n.id, 0), owner.id if owner else None


def _symbols(u: Unit) -> Rows:
    for s in u.symbols:
        yield s.id, s.name, s.token, s.scope, s.decl.id, s.public, bits(s.flags, SYMBOL_FLAGS)


def _scopes(u: Unit) -> Rows:
    for s in u.scopes:
        yield s.id, s.parent, s.node.id, bits(s.flags, SCOPE_FLAGS)


def _bindings(u: Unit) -> Rows:
    for s in u.scopes:
        for i, b in enumerate(s.bindings):
            yield s.id, i, b.id


def _references(u: Unit) -> Rows:
    for r in u.references:
        yield r.id, r.name, r.token, r.node.id, r.scope, r.symbol.id if r.symbol else None, bits(r.flags, REFERENCE_FLAGS)


def _items(u: Unit) -> Rows:
    for s in u.symbols:
        for role, items in (("member", s.members), ("export", s.exports)):
            for i, x in enumerate(items):
                yield s.id, x.id, role, i, in_container(x)


def _imports(u: Unit) -> Rows:
    for i, x in enumerate(u.imports):
        yield i, x.specifier, x.kind, x.node.id


def _diagnostics(u: Unit) -> Rows:
    for at, message in u.problems:
        yield at, message


#: table -> (columns after project and path, rows of a file)
TABLES: dict[str, tuple[str, Callable[[Unit], Rows]]] = {
    "tokens": ("token bigint, tag string, start bigint, end bigint", _tokens),
    "comments": ("start bigint, end bigint", _comments),
    "nodes": ("node bigint, kind string, parent bigint, main_token bigint, first_token bigint, last_token bigint, scope bigint, owner bigint", _nodes),
    "symbols": ("symbol bigint, name string, token bigint, scope bigint, decl bigint, public boolean, flags bigint", _symbols),
    "scopes": ("scope bigint, parent bigint, node bigint, flags bigint", _scopes),
    "bindings": ("scope bigint, ord bigint, symbol bigint", _bindings),
    "references": ("reference bigint, name string, token bigint, node bigint, scope bigint, symbol bigint, flags bigint", _references),
    "container_items": ("container bigint, child bigint, role string, ord bigint, in_container boolean", _items),
    "imports": ("ord bigint, specifier string, kind string, node bigint", _imports),
    "diagnostics": ("at bigint, message string", _diagnostics),
}
_KINDS = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def fact_table(files: DataFrame, name: str) -> DataFrame:
    """One of TABLES over all files."""
    columns, rows_of = TABLES[name]
    schema = f"project string, path string, {columns}"
    fields = [part.rsplit(" ", 1) for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for project, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [(project, path, *row) for row in rows_of(Unit(path, (text or "").encode()))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*found, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return files.where("path is not null").select("project", "path", "text").mapInArrow(run, schema)


def direct_edges(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, path, owner, symbol): who names what in one file, once each: references joined to the owners of their nodes."""
    owners = nodes.where("owner is not null").select("project", "path", "node", "owner")
    return references.where("symbol is not null").join(owners, ["project", "path", "node"]).select("project", "path", "owner", "symbol").distinct()


def member_edges(items: DataFrame) -> DataFrame:
    """(project, path, owner, symbol): containers to their members."""
    return items.where("role = 'member'").select("project", "path", F.col("container").alias("owner"), F.col("child").alias("symbol"))


def find_export(items: DataFrame, symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first declaration of a name in a container: exports in order (no locals of its functions), then members; ``wanted`` has project, path, container, name."""
    named = items.where("role = 'member' or in_container").join(symbols.select("project", "path", F.col("symbol").alias("child"), "name"), ["project", "path", "child"])
    hit = named.join(wanted, ["project", "path", "container", "name"])
    best = hit.groupBy("project", "path", "container", "name").agg(F.min_by("child", F.struct(F.col("role") != "export", F.col("ord"))).alias("symbol"))
    return wanted.join(best, ["project", "path", "container", "name"], "left")


def nearest_binding(scopes: DataFrame, bindings: DataFrame, symbols: DataFrame, wanted: DataFrame, depth: int = 64) -> DataFrame:
    """The symbol that a name means in a scope: the first binding of that name in the closest scope that has it; ``wanted`` has project, path, scope, name."""
    first = bindings.join(symbols.select("project", "path", "symbol", "name"), ["project", "path", "symbol"]).groupBy("project", "path", "scope", "name").agg(F.min_by("symbol", "ord").alias("symbol"))
    at = wanted.select("project", "path", F.col("scope").alias("asked"), "name", "scope").distinct()
    found = None
    for _ in range(depth):
        here = at.join(first, ["project", "path", "scope", "name"], "left")
        hit = here.where("symbol is not null").select("project", "path", F.col("asked").alias("scope"), "name", "symbol")
        found = hit if found is None else found.unionByName(hit)
        up = scopes.select("project", "path", "scope", "parent")
        at = here.where("symbol is null").join(up, ["project", "path", "scope"]).where("parent is not null").select("project", "path", "asked", "name", F.col("parent").alias("scope"))
        if at.isEmpty():
            break
    else:
        raise RuntimeError(f"scopes are nested deeper than {depth}")
    return wanted.join(found, ["project", "path", "scope", "name"], "left")
