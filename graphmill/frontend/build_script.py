"""What a build script says: module names and the files they stand for, root files, test roots.

The script is read, not run. Values are followed by name (a variable holds the last module or path that is given to it
in its block; a name that its block doesn't explain, as an unknown parameter, takes the module or path of that name
anywhere in the file), through helpers that return a module or a record of modules, through option records that a
helper forwards, and through literal tables that a loop walks. What depends on a condition keeps every candidate.
Functions that no call leads to, those in structs included, are read with unknown parameters.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field

from graphmill.frontend.lexer import string_value
from graphmill.frontend.syntax import Node, Tree


@dataclass
class BuildGraph:
    modules: dict[str, list[str]] = field(default_factory=dict)
    executables: list[str] = field(default_factory=list)
    libraries: list[str] = field(default_factory=list)
    tests: list[str] = field(default_factory=list)
    external: dict[str, None] = field(default_factory=dict)
    scripts: list[str] = field(default_factory=list)
    has_executable: bool = False
    has_library: bool = False

    def add_module(self, name: str, path: str | None) -> None:
        if path is None:
            self.external.setdefault(name)
        elif path not in self.modules.setdefault(name, []):
            self.modules[name].append(path)

    def add_root(self, kind: str, path: str | None) -> None:
        if path is None:
            return
        if kind == "test":
            self.tests.append(path)
        else:
            (self.libraries if kind == "library" else self.executables).append(path)


@dataclass
class Record:
    """A value with named or numbered parts: options, a table row, a struct of modules."""

    parts: dict[str, object]


@dataclass(frozen=True)
class Module:
    """A build module by its root file; None where that can't be told."""

    path: str | None


@dataclass(frozen=True)
class Function:
    """A function as a value: the script that declares it, and its declaration."""

    script: Script
    node: Node


#: Asked for a helper of a file that is not at hand: (import path, function) -> the root file of the module it returns, or None.
HelperResolver = Callable[[str, str], "str | None"]

#: The calls that make a root.
ROOT_CALLS = {"addTest": "test", "addExecutable": "exe", "addLibrary": "library"}


class Script:
    """One build file; functions of other build files are reached through ``imports``."""

    def __init__(self, files: dict[str, str], path: str, loaded: dict[str, Script]):
        self.path, self.tree = path, Tree(files[path].encode())
        loaded[path] = self
        self.functions: dict[str, Node] = {}
        self.constants: dict[str, Node] = {}
        self.imports: dict[str, Script] = {}
        self.absent: dict[str, str] = {}  # files that are not at hand
        self.bound: dict[str, list[Node]] = {}  # what is given to a name anywhere: modules and paths
        for node in self.tree.nodes:
            if node.kind == "fn_decl" and node.proto.name is not None:
                self.functions.setdefault(self.tree.name(node.proto.name), node)
        for node in self.tree.root.members:
            if node.kind == "var" and node.init is not None:
                self.constants.setdefault(self.tree.name(node.name), node.init)
        for node in self.tree.nodes:
            if node.kind == "var" and node.init is not None and node.init.kind == "call" and node.init.callee.kind == "field_access" and self.tree.name(node.init.callee.name) in ("createModule", "path"):
                self.bound.setdefault(self.tree.name(node.name), []).append(node.init)
        for node in self.tree.nodes:
            if node.kind == "var" and node.init is not None and node.init.kind == "builtin" and self.tree.text(node.init.token) == "@import" and node.init.args and node.init.args[0].kind == "string":
                spec = string_value(self.tree.text(node.init.args[0].token))
                target = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
                if spec.endswith(".zig") and target in files:
                    self.imports[self.tree.name(node.name)] = loaded.get(target) or Script(files, target, loaded)
                elif spec.endswith(".zig"):
                    self.absent[self.tree.name(node.name)] = spec

    def member(self, container: Node, name: str) -> Node | None:
        """The function or value of that name declared in a struct."""
        for m in container.members:
            if m.kind == "fn_decl" and m.proto.name is not None and self.tree.name(m.proto.name) == name:
                return m
            if m.kind == "var" and m.init is not None and self.tree.name(m.name) == name:
                return m.init
        return None


class Evaluator:
    """Follows values through one function body at a time; effects go to ``graph``."""

    def __init__(self, graph: BuildGraph, helpers: HelperResolver | None = None):
        self.graph, self.helpers = graph, helpers
        self.open: set[tuple[str, int]] = set()  # functions and names that are being followed
        self.ran: set[tuple[str, int]] = set()

    def run(self, scripts: dict[str, Script], path: str) -> None:
        """The entry first, then what it does not lead to."""
        first = scripts[path]
        entry = first.functions.get("build")
        if entry is not None:
            self.enter(first, entry, [])
        for script in scripts.values():
            for node in script.tree.nodes:
                if node.kind == "fn_decl" and (script.path, node.id) not in self.ran:
                    self.enter(script, node, [])

    # -- statements
    def block(self, script: Script, node: Node, scopes: list[dict[str, object]]) -> object:
        scopes = [*scopes, {}]
        returned: object = None
        for statement in node.statements:
            value = self.statement(script, statement, scopes)
            if statement.kind == "return":
                returned = value
            elif value is not None and statement.kind in ("if", "block", "switch") and returned is None:
                returned = value
        return returned

    def statement(self, script: Script, node: Node, scopes: list[dict[str, object]]) -> object:
        if node.kind == "var":
            value = self.value(script, node.init, scopes) if node.init is not None else None
            scopes[-1][script.tree.name(node.name)] = value
            return None
        if node.kind == "assign":
            value = self.value(script, node.right, scopes)
            if node.left.kind == "identifier":
                name = script.tree.name(node.left.token)
                for scope in reversed(scopes):
                    if name in scope:
                        scope[name] = value
                        break
            return None
        if node.kind == "return":
            return self.value(script, node.expr, scopes) if node.expr is not None else None
        if node.kind == "block":
            return self.block(script, node, scopes)
        if node.kind == "if":
            self.value(script, node.cond, scopes)
            inner = [*scopes, {script.tree.name(t): self.value(script, node.cond, scopes) for t in node.payload}]
            first = self.statement(script, node.then, inner)
            second = self.statement(script, node.otherwise, scopes) if node.otherwise is not None else None
            return first if first is not None else second
        if node.kind == "for":
            return self.loop(script, node, scopes)
        if node.kind == "while":
            self.statement(script, node.then, [*scopes, {}])
            return None
        if node.kind == "switch":
            for case in node.cases:
                self.statement(script, case.target, [*scopes, {}])
            return None
        if node.kind in ("defer", "errdefer", "comptime"):
            return self.statement(script, node.expr, scopes)
        return self.value(script, node, scopes) and None

    def loop(self, script: Script, node: Node, scopes: list[dict[str, object]]) -> None:
        """The body once for each row of a literal table, else once with unknown captures."""
        tables = [self.value(script, one, scopes) for one in node.inputs]
        rows = max((len(t.parts) for t in tables if isinstance(t, Record) and "0" in t.parts), default=0)
        for i in range(max(rows, 1)):
            row = {}
            for k, token in enumerate(node.payload):
                table = tables[k] if k < len(tables) else None
                row[script.tree.name(token)] = table.parts.get(str(i)) if isinstance(table, Record) else None
            self.statement(script, node.then, [*scopes, row])

    # -- values
    def value(self, script: Script, node: Node | None, scopes: list[dict[str, object]]) -> object:
        if node is None:
            return None
        tree = script.tree
        if node.kind == "string":
            return string_value(tree.text(node.token)) if not node.get("multiline") else None
        if node.kind == "number":
            try:
                return str(int(tree.text(node.token).replace("_", ""), 0))
            except ValueError:
                return tree.text(node.token)
        if node.kind == "identifier":
            return self.named(script, tree.name(node.token), scopes)
        if node.kind == "struct_init":
            return self.record({tree.name(n): self.value(script, v, scopes) for n, v in zip(node.names, node.values, strict=True)}, node)
        if node.kind == "array_init":
            return Record({str(i): self.value(script, v, scopes) for i, v in enumerate(node.values)})
        if node.kind == "field_access":
            base = self.value(script, node.base, scopes)
            name = tree.name(node.name)
            if isinstance(base, Record):
                return base.parts.get(name)
            return base if isinstance(base, Module) and name in ("root_module", "module") else None
        if node.kind == "index":
            base, at = self.value(script, node.base, scopes), self.value(script, node.index, scopes)
            return base.parts.get(str(at)) if isinstance(base, Record) else None
        if node.kind in ("grouped", "comptime", "nosuspend"):
            return self.value(script, node.expr, scopes)
        if node.kind == "unary":
            return self.value(script, node.expr, scopes)
        if node.kind in ("deref", "unwrap", "slice"):
            return self.value(script, node.base, scopes)
        if node.kind == "binary" and node.op == "orelse" or node.kind == "catch":
            first = self.value(script, node.left, scopes)
            return first if first is not None else self.value(script, node.right, scopes)
        if node.kind == "if":
            first = self.value(script, node.then, scopes) if node.then.kind != "block" else self.block(script, node.then, scopes)
            second = self.value(script, node.otherwise, scopes) if node.otherwise is not None and node.otherwise.kind != "block" else None
            return first if first is not None else second
        if node.kind == "block":
            return self.block(script, node, scopes)
        if node.kind == "call":
            return self.call(script, node, scopes)
        if node.kind == "switch":
            values = [self.value(script, case.target, scopes) for case in node.cases]
            return next((v for v in values if v is not None), None)
        return None

    def named(self, script: Script, name: str, scopes: list[dict[str, object]]) -> object:
        found = next((scope[name] for scope in reversed(scopes) if name in scope), None)
        key = (f"{script.path}\0{name}", -1)
        if found is not None or key in self.open:
            return found
        self.open.add(key)
        try:
            if not any(name in scope for scope in scopes):
                if name in script.constants:
                    return self.value(script, script.constants[name], [{}])
                if name in script.functions:
                    return Function(script, script.functions[name])
            return next((v for v in (self.value(script, init, [{}]) for init in script.bound.get(name, ())) if isinstance(v, str) or isinstance(v, Module) and v.path is not None), None)
        finally:
            self.open.discard(key)

    def declared(self, script: Script, node: Node) -> tuple[Script, Node] | None:
        """The declaration that a dotted name of imports and structs stands for; a file's is its root."""
        tree = script.tree
        if node.kind == "identifier":
            name = tree.name(node.token)
            if name in script.imports:
                return script.imports[name], script.imports[name].tree.root
            constant = script.constants.get(name)
            return (script, constant) if constant is not None and constant.kind == "container" else None
        if node.kind != "field_access":
            return None
        base = self.declared(script, node.base)
        if base is None:
            return None
        found = base[0].member(base[1], tree.name(node.name))
        return (base[0], found) if found is not None else None

    def record(self, parts: dict[str, object], node: Node) -> object:
        """An option record; one with a path and a mode names a test runner, one with a path alone stands for that path."""
        if "mode" in parts and isinstance(parts.get("path"), str):
            self.graph.add_root("test", parts["path"])
        imports = parts.get("imports")
        if isinstance(imports, Record):
            for one in imports.parts.values():
                if isinstance(one, Record) and isinstance(one.parts.get("name"), str):
                    module = one.parts.get("module")
                    self.graph.add_module(one.parts["name"], module.path if isinstance(module, Module) else None)
        if set(parts) == {"cwd_relative"} and isinstance(parts["cwd_relative"], str):
            return parts["cwd_relative"]
        return Record(parts)

    def module(self, options: object) -> Module:
        path = options.parts.get("root_source_file") if isinstance(options, Record) else None
        return Module(posixpath.normpath(path) if isinstance(path, str) else None)

    def call(self, script: Script, node: Node, scopes: list[dict[str, object]]) -> object:
        tree, callee = script.tree, node.callee
        if callee.kind == "identifier":
            held = self.named(script, tree.name(callee.token), scopes)
            function = held if isinstance(held, Function) else Function(script, script.functions.get(tree.name(callee.token)))
            return self.invoke(function.script, function.node, node, script, scopes)
        if callee.kind != "field_access":
            return None
        name = tree.name(callee.name)
        found = self.declared(script, callee)
        if found is not None and found[1].kind == "fn_decl":
            return self.invoke(*found, node, script, scopes)
        if found is not None and found[1].kind == "identifier":
            held = self.named(found[0], found[0].tree.name(found[1].token), [{}])
            return self.invoke(held.script, held.node, node, script, scopes) if isinstance(held, Function) else None
        if callee.base.kind == "identifier" and tree.name(callee.base.token) in script.absent:
            path = self.helpers(script.absent[tree.name(callee.base.token)], name) if self.helpers is not None else None
            return Module(posixpath.normpath(path)) if path is not None else None
        receiver = self.value(script, callee.base, scopes)
        args = [self.value(script, a, scopes) for a in node.args]
        if name in ("path", "pathFromRoot") and args:
            return args[-1] if isinstance(args[-1], str) else None
        if name == "createModule":
            return self.module(args[0]) if args else None
        if name == "addModule" and len(args) >= 2 and isinstance(args[0], str):
            self.graph.has_library = True
            module = self.module(args[1])
            if module.path is not None:
                self.graph.add_module(args[0], module.path)
                self.graph.add_root("library", module.path)
            return module
        if name in ROOT_CALLS:
            kind = ROOT_CALLS[name]
            self.graph.has_executable |= kind == "exe"
            self.graph.has_library |= kind == "library"
            options = args[0] if args else None
            if not isinstance(options, Record):
                return None
            root = options.parts.get("root_module")
            module = root if isinstance(root, Module) else self.module(options)
            self.graph.add_root(kind, module.path)
            return module
        if name == "addAnonymousImport" and len(args) >= 2 and isinstance(args[0], str):
            self.graph.add_module(args[0], self.module(args[1]).path)
        elif name == "addOptions" and len(args) >= 2 and isinstance(args[0], str):
            self.graph.add_module(args[0], None)
        elif name == "addImport" and len(args) >= 2 and isinstance(args[0], str):
            self.graph.add_module(args[0], args[1].path if isinstance(args[1], Module) else None)
        return receiver if name in ("dupe", "builder") else None

    def invoke(self, script: Script, function: Node | None, call: Node, caller: Script, scopes: list[dict[str, object]]) -> object:
        """Runs a helper's body with the caller's arguments by position."""
        args = [self.value(caller, a, scopes) for a in call.args]
        return self.enter(script, function, args) if function is not None else None

    def enter(self, script: Script, function: Node, args: list[object]) -> object:
        """A function's body; one that is being followed already (a recursive call) gives nothing."""
        key = (script.path, function.id)
        if key in self.open or function.body is None:
            return None
        frame = {}
        for i, p in enumerate(function.proto.params):
            if p.name is not None:
                frame[script.tree.name(p.name)] = args[i] if i < len(args) else None
        self.open.add(key)
        self.ran.add(key)
        try:
            return self.block(script, function.body, [frame])
        finally:
            self.open.discard(key)


def scan_build_script(files: dict[str, str], path: str = "build.zig", helpers: HelperResolver | None = None) -> BuildGraph:
    """The build graph of a project; empty without a script. ``helpers`` is asked for what lies in files that are not at hand."""
    graph = BuildGraph()
    if path not in files:
        return graph
    loaded: dict[str, Script] = {}
    Script(files, path, loaded)
    Evaluator(graph, helpers).run(loaded, path)
    graph.scripts = list(loaded)
    for kind in ("executables", "libraries", "tests"):
        setattr(graph, kind, list(dict.fromkeys(posixpath.normpath(p) for p in getattr(graph, kind))))
    return graph
