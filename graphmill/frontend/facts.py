"""Rows that a project becomes: symbols, edges, roots, files, imports, modules.

Node ids are 64-bit hashes of project, path and the number of the symbol in its file, so that many projects
share one graph and one fixpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

from graphmill.frontend.binder import Symbol
from graphmill.frontend.project import Project
from graphmill.frontend.resolver import Resolver

#: Columns of a fact row; what a row uses of them depends on ``fact``.
COLUMNS = ("project", "fact", "sid", "other", "path", "name", "kind", "detail", "line", "col", "ord", "candidate", "reportable", "test_only")
SCHEMA = (
    "project string, fact string, sid bigint, other bigint, path string, name string, kind string, detail string, "
    "line bigint, col bigint, ord bigint, candidate boolean, reportable boolean, test_only boolean"
)


def node_id(project: str, symbol: Symbol) -> int:
    raw = f"{project}\0{symbol.unit.path}\0{symbol.id}".encode()
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)


def kind_of(symbol: Symbol) -> str:
    """The first of fn, struct, enum, union, error set, var, const."""
    for flag, name in (("fn", "fn"), ("struct", "struct"), ("enum", "enum"), ("union", "union"), ("error", "error set")):
        if flag in symbol.flags:
            return name
    return "var" if "variable" in symbol.flags and "const" not in symbol.flags else "const"


def bare_type_parameter(symbol: Symbol) -> bool:
    """A named parameter of a function type that declares no function."""
    if symbol.decl.kind == "fn_decl":
        return False
    for node in (symbol.decl, *symbol.decl.ancestors()):
        if node.kind == "fn_proto":
            return node.parent is None or node.parent.kind != "fn_decl"
    return False


def owner_of(symbol: Symbol) -> Symbol | None:
    if "fn_param" in symbol.flags:
        at = symbol.unit.declared.get(symbol.decl.id)
        if at is not None and at is not symbol:
            return at
    return symbol.unit.owner(symbol.decl)


def is_candidate(symbol: Symbol) -> bool:
    """May be dead at all: no external declaration, no discard, no parameter of a bare function type."""
    return "extern" not in symbol.flags and symbol.name != "_" and not ("fn_param" in symbol.flags and bare_type_parameter(symbol))


def is_reportable(symbol: Symbol, resolver: Resolver) -> bool:
    """Worth a finding of its own: a named declaration of a file or container that is no used alias."""
    if symbol.name in ("", "_") or symbol.flags & {"fn_param", "payload", "catch_param", "member"} or not symbol.flags & {"fn", "const", "variable"}:
        return False
    if symbol.references and resolver.alias_init(symbol, False) is not None:
        return False
    scope = symbol.unit.scopes[symbol.scope].flags
    return not scope & {"function", "test"} and bool(scope & {"top", "struct", "enum", "union"})


def project_rows(name: str, files: dict[str, str], roots: list[str] | None = None, policy: str | None = None, contract: str | None = None) -> Iterator[dict]:
    """All facts of one project; with ``roots`` it is loaded from these files, else from its build script and the contract of that name."""
    project = Project.from_roots(files, roots) if roots else Project.from_build(files, contract=contract)
    resolver = Resolver(project)
    sid = lambda s: node_id(name, s)
    place = {path: i for i, path in enumerate(project.units)}

    def row(fact: str, **values: object) -> dict:
        return {c: None for c in COLUMNS} | {"project": name, "fact": fact} | values

    for path in sorted(set(project.discovered()) | set(project.units)):
        yield row("file", path=path, kind=project.status(path), ord=place.get(path), test_only=path in project.test_only)
    for unit in project.units.values():
        for at, message in unit.problems:
            yield row("problem", path=unit.path, detail=message, ord=at)
        for s in unit.symbols:
            line, col = unit.position(s)
            owner = owner_of(s)
            yield row(
                "symbol", sid=sid(s), other=sid(owner) if owner is not None else None, path=unit.path, name=s.name, kind=kind_of(s),
                detail=",".join(sorted(s.flags)), line=line, col=col, ord=place[unit.path] * 2**32 + s.id,
                candidate=is_candidate(s), reportable=is_reportable(s, resolver), test_only=unit.test_only,
            )
    for i, ((a, b, kind), _) in enumerate(resolver.edges().found.items()):
        yield row("edge", sid=sid(a), other=sid(b), path=a.unit.path, name=a.name, kind=kind, detail=f"{b.unit.path}:{b.name}", ord=i)
    for s, kind in project.root_symbols(policy):
        yield row("root", sid=sid(s), path=s.unit.path, name=s.name, kind=kind)
    for s, kind in project.test_roots():
        yield row("test_root", sid=sid(s), path=s.unit.path, name=s.name, kind=kind)
    for i, e in enumerate(project.edges):
        yield row("import", path=e.source, name=e.target, ord=i)
    for i, u in enumerate(project.unresolved):
        yield row("unresolved", path=u.source, name=u.specifier, kind=u.reason, detail=u.kind, ord=i)
    for module, paths in project.build.modules.items():
        for i, path in enumerate(paths):
            yield row("module", name=module, path=path, ord=i)
    for module in project.build.external:
        yield row("module", name=module, kind="external")
    for kind, paths in (("exe", project.build.executables), ("library", project.build.libraries), ("test", project.build.tests)):
        for i, path in enumerate(paths):
            yield row("build_root", path=path, kind=kind, ord=i)
    for spec, missing in project.contract_unresolved:
        yield row("stale_contract", name=spec, detail=missing)
