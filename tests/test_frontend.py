"""Lexer, parser, binder, resolver, build scripts and manifests on small sources."""

import pytest

from graphmill.frontend.binder import Unit
from graphmill.frontend.build_script import scan_build_script
from graphmill.frontend.facts import bare_type_parameter, is_reportable, kind_of, owner_of
from graphmill.frontend.lexer import identifier_name, string_value, tokenize
from graphmill.frontend.manifest import Contract, Manifest
from graphmill.frontend.project import Project
from graphmill.frontend.resolver import Resolver, export_of
from graphmill.frontend.syntax import Tree
from graphmill.functions.names import import_kind, primitive_type, primitive_value, skipped_path

RANK = {"definite": 0, "possible": 1, "unknown": 2}


def unit(source):
    return Unit("a.zig", source.encode())


def symbol(u, name):
    return next(s for s in u.symbols if s.name == name)


def edges(files, root="main.zig"):
    """(user, used) -> strongest kind."""
    out = {}
    for a, b, kind in Resolver(Project.from_roots(files, [root])).edges().found:
        key = (a.name or a.unit.path, b.name or b.unit.path)
        out[key] = min(out.get(key, kind), kind, key=RANK.get)
    return out


# -- lexer
def test_tokens_have_byte_offsets():
    source = 'const é = "ñ"; // end\n/// doc\nx'.encode()
    lexed = tokenize(source)
    assert [t.tag for t in lexed.tokens] == ["const", "invalid", "invalid", "=", "string", ";", "doc", "identifier", "eof"]
    assert [source[a:b] for a, b in lexed.comments] == [b"// end"]
    assert lexed.identifiers == 1


@pytest.mark.parametrize(("raw", "value"), [('"a\\n\\x41\\u{e9}"', "a\nAé"), ('"plain"', "plain"), ('"\\""', '"')])
def test_string_values(raw, value):
    assert string_value(raw) == value


def test_quoted_names():
    assert identifier_name('@"a b"') == "a b" and identifier_name("ab") == "ab"


# -- parser
SNIPPETS = [
    "const a = if (x) |v| v else |e| e;",
    "const b = switch (x) { .a, .b => |v| v, 1...5 => 2, else => |*e| { _ = e; } };",
    "fn f(comptime T: type, x: anytype, ...) !?*const [4:0]u8 { while (it.next()) |n| : (i += 1) { _ = n; } else {} return null; }",
    "const c = struct { a: u8 align(4) = 3, const Self = @This(); fn g(self: *Self) void { self.a +%= 1; } };",
    "const d: [*:0]const u8 = &[_]u8{ 1, 2 } ++ .{3} ** 4;",
    "const e = union(enum(u8)) { a, b: struct { x: i32 }, c: void };",
    "const e2 = error{ A, B } || error{C};",
    "fn h() void { const x, var y: u8 = foo(); x, y = bar(); blk: { break :blk; } for (xs, 0..) |*a, i| _ = .{ a, i }; }",
    "fn k() void { errdefer |err| log(err); defer { done(); } inline for (.{1}) |z| { _ = z; } _ = a orelse return; }",
    'extern "c" fn puts(s: [*c]const u8) c_int;',
    "export var counter: u32 = 0;\nthreadlocal var t: u8 = 0;",
    'test "name" { try x; }\ntest ident {}\ncomptime { _ = a; }',
    "const p = @as(u8, @intCast(x)).?.*.y[1..2 :0][0];",
    'const m =\n    \\\\line one\n    \\\\line two\n;',
    "const s: struct { u8, bool } = .{ 1, true };",
    "const fp: *const fn (a: u8) callconv(.C) void = undefined;",
    "fn asmy() void { asm volatile (\"nop\" : : : \"memory\"); }",
    "const v = foo(.{ .a = 1, .b = .{} }) catch |e| switch (e) { error.X => 1, else => return e };",
]


@pytest.mark.parametrize("source", SNIPPETS)
def test_snippets_parse_whole(source):
    tree = Tree(source.encode())
    assert tree.problems == []
    assert tree.root.last >= len(tree.tokens) - 2


def test_errors_keep_the_rest():
    u = unit("fn a( { }\npub fn b() void { const = 1; c(); }\nfn c() void {}\n")
    assert u.problems and symbol(u, "b") and symbol(u, "c")
    assert unit("").problems == [] and len(unit("").symbols) == 1


def test_precedence():
    tree = Tree(b"const a = 1 + 2 * 3 == 4 and x orelse y;")
    top = tree.root.members[0].init
    assert (top.kind, top.op, top.left.op, top.left.left.op) == ("binary", "and", "==", "+")


# -- binder
def test_flags_members_and_exports():
    u = unit("pub const P = struct {\n x: u8,\n y: u8 = 0,\n const z = 1;\n pub fn f(self: P) void { _ = self; }\n};\nvar n: u32 = 0;\nextern fn out() void;\nconst E = enum { a, b };\nconst R = error{Bad};")
    p = symbol(u, "P")
    assert p.flags == {"variable", "const", "struct"} and p.public
    assert [s.name for s in p.members] == ["x", "y"] and [s.name for s in p.exports] == ["z", "f"]
    assert symbol(u, "n").flags == {"variable"} and not symbol(u, "n").public
    assert symbol(u, "out").flags == {"fn", "extern"}
    assert "enum" in symbol(u, "E").flags and [s.name for s in symbol(u, "E").members] == ["a", "b"]
    assert "error" in symbol(u, "R").flags and symbol(u, "Bad").flags == {"member", "error"}
    assert u.root.public and symbol(u, "self").public  # visible unless a declaration says otherwise


def test_reference_uses():
    u = unit("fn f() void { var a: u8 = 0; a = 1; a += 2; g(a); }\nfn g(x: u8) void { _ = x; }")
    uses = [sorted(r.flags) for r in symbol(u, "a").references]
    assert uses == [["write"], ["read", "write"], ["read"]]
    assert [sorted(r.flags) for r in symbol(u, "g").references] == [["call"]]
    assert all("primitive" in r.flags for r in u.references if r.name == "u8")


def test_names_resolve_to_the_nearest_scope_and_later_declarations():
    u = unit("fn f() void { const a = 1; { const a = 2; _ = a; } _ = a; later(); }\nfn later() void {}")
    inner, outer = [s for s in u.symbols if s.name == "a"][::-1]
    assert len(inner.references) == len(outer.references) == 1
    assert len(symbol(u, "later").references) == 1


def test_payloads():
    u = unit("fn f(o: ?u8, e: anyerror!u8) void { if (o) |v| { _ = v; } if (e) |w| { _ = w; } else |x| { _ = x; } for (list, 0..) |*i, k| { _ = i; _ = k; } _ = e catch |c| c; switch (u) { .a => |s| s, else => {} } }")
    assert all("payload" in symbol(u, n).flags for n in "vwxikcs")
    assert "catch_param" in symbol(u, "c").flags


def test_scopes_and_tests():
    u = unit('test "t" { helper(); }\nfn helper() void {}\ncomptime { helper(); }')
    first, second = sorted(symbol(u, "helper").references, key=lambda r: r.id)
    assert u.in_test(first.scope) and not u.in_test(second.scope)
    assert u.owner(first.node) is None and u.owner(second.node) is None


def test_owners():
    u = unit("const S = struct {\n f: u8 = make(),\n};\nfn make() u8 { for (xs) |x| { use(x); } return 0; }\nfn any(a: anytype) void { use(a); }\nfn use(_: anytype) void {}\nconst xs = 1;")
    by_owner = {u.owner(r.node).name for r in symbol(u, "use").references}
    assert by_owner == {"make", "any"}
    assert u.owner(symbol(u, "make").references[0].node).name == "f"
    assert owner_of(symbol(u, "a")).name == "any"


def test_imports_and_kinds():
    u = unit('const a = @import("x.zig");\nconst b = @import("std");\nconst c = @import(name);')
    assert [(i.specifier, i.kind) for i in u.imports] == [("x.zig", "file"), ("std", "module")]
    assert len(u.problems) == 1
    assert [import_kind(s) for s in ("a.zon", "a.c", "abc", ".abc", "abc.", "a.b.c")] == ["file", "file", "module", "module", "module", "file"]


def test_primitives_and_paths():
    assert primitive_type("u8") and primitive_type("i127") and primitive_type("c_int") and not primitive_type("u1") and not primitive_type("u")
    assert primitive_value("undefined") and not primitive_value("void")
    assert skipped_path("a/.git/b.zig") and skipped_path("zig-out/x.zig") and not skipped_path("_a/b.zig") and not skipped_path("./a.zig")


def test_positions_and_kinds():
    u = unit("const a = 1;\n  pub fn näme() void {}\nfn z() void {}")
    assert u.position(symbol(u, "a")) == (1, 7)
    assert u.position(symbol(u, "z")) == (3, 4)
    assert kind_of(symbol(u, "a")) == "const" and kind_of(symbol(u, "z")) == "fn"


def test_bare_function_type_parameters():
    u = unit("const H = struct { f: *const fn (code: u32) void };\nfn real(x: u32) void { _ = x; }\nextern fn ext(y: u32) void;")
    assert bare_type_parameter(symbol(u, "code")) and not bare_type_parameter(symbol(u, "x")) and bare_type_parameter(symbol(u, "y"))


# -- edges
ONE_FILE = [
    ("fn main() void { other(); }\nfn other() void {}", ("main", "other"), "definite"),
    ("const F = struct { pub fn g() void {} };\nfn main() void { F.g(); }", ("main", "g"), "definite"),
    ("const A = struct { const B = struct { fn run() void {} }; };\nfn main() void { A.B.run(); }", ("main", "run"), "definite"),
    ("const A = struct { const Self = @This(); fn run() void { Self.go(); } fn go() void {} };", ("run", "go"), "definite"),
    ("const S = struct { fn run(_: S) void {} };\nfn main() void { const s: S = .{}; s.run(); }", ("main", "run"), "possible"),
    ("const S = struct { fn run(_: S) void {} };\nfn main() void { const s = S{}; s.run(); }", ("main", "run"), "possible"),
    ("const S = struct { fn a(self: *S) void { self.b(); } fn b(_: *S) void {} };", ("a", "b"), "possible"),
    ("const S = struct { fn run(_: *S) void {} };\nfn cast(p: *u8) *S { return @ptrCast(p); }\nfn main() void { cast(raw).run(); }", ("main", "run"), "possible"),
    ("const F = struct { const B = struct { fn z() void {} }; };\nfn main() void { @field(F, \"B\").z(); }", ("main", "z"), "possible"),
    ("const F = struct { fn x() void {} };\nfn main() void { @field(F, pick())(); }\nfn pick() []const u8 { return \"x\"; }", ("main", "x"), "unknown"),
    ("const F = struct { a: u8, b: T };\nconst T = u32;", ("F", "a"), "definite"),
    ("const F = struct { b: T };\nconst T = struct {};", ("b", "T"), "definite"),
    ("fn f() struct { x: u8 } { return .{ .x = 1 }; }", ("f", "x"), "definite"),
    ("fn f() error{Oops}!void {}", ("f", "Oops"), "definite"),
    ("fn f(p: struct { x: u8 }) void { _ = p; }", ("f", "x"), "definite"),
    ("fn List(comptime T: type) type { return struct { item: T }; }", ("List", "item"), "definite"),
    ("const S = struct { n: N, const N = struct { fn go(_: N) void {} }; fn f(self: S) void { self.n.go(); } };", ("f", "go"), "possible"),
    ("const N = struct { fn go(_: N) void {} };\nconst S = struct { ns: [4]N, fn f(self: *S) void { self.ns[0].go(); const p = &self.ns[1]; p.end(); } };", ("f", "go"), "possible"),
    ("const O = struct { const none: O = .{}; };\nfn main() void { const o: O = .none; _ = o; }", ("o", "none"), "possible"),
    ("const O = struct { fn init(a: u8) O { _ = a; return .{}; } };\nfn main() O { return .init(1); }", ("main", "init"), "possible"),
    ("const O = struct { fn go(_: O) void {} };\nfn f(o: ?O) void { if (o) |v| v.go(); }", ("f", "go"), "possible"),
    ("const O = struct { fn go(_: O) void {} };\nfn f(os: []O) void { for (os, 0..) |o, i| { o.go(); _ = i; } }", ("f", "go"), "possible"),
    ("const O = struct { fn go(_: *O) void {} };\nfn f(a: Alloc) !void { const o = try a.create(O); o.go(); }", ("f", "go"), "possible"),
    ("const O = struct { fn init() !O { return .{}; } fn go(_: O) void {} };\nfn f() void { const o = O.init() catch unreachable; o.go(); }", ("f", "go"), "possible"),
    ("const a = b;\nconst b = struct {};", ("a", "b"), "definite"),
]


@pytest.mark.parametrize(("source", "pair", "kind"), ONE_FILE)
def test_edges_in_one_file(source, pair, kind):
    assert edges({"main.zig": source}).get(pair) == kind


LIB = "pub fn start() void {}\npub const Inner = struct { pub fn run() void {} };\npub const W = struct { next: ?*W = null, items: []W, pub fn init() W { return undefined; } pub fn go(_: *W) void {} };\npub const Again = W;\npub var shared: W = undefined;\n"
TWO_FILES = [
    ("const l = @import(\"lib.zig\");\nfn main() void { l.start(); }", ("main", "start"), "definite"),
    ("const l = @import(\"lib.zig\");\nfn main() void { l.Inner.run(); }", ("main", "run"), "definite"),
    ("const l = @import(\"lib.zig\");\nfn main() void { var w: l.W = undefined; w.go(); }", ("main", "go"), "possible"),
    ("const l = @import(\"lib.zig\");\nfn main() void { var w = l.W.init(); w.go(); }", ("main", "go"), "possible"),
    ("const l = @import(\"lib.zig\");\nfn main() void { l.W.init().go(); }", ("main", "go"), "possible"),
    ("const W = @import(\"lib.zig\").W;\nfn main() void { var w: W = undefined; w.go(); }", ("main", "go"), "possible"),
    ("const l = @import(\"lib.zig\");\nconst A = l.Again;\nfn f(a: *A) void { a.go(); }", ("f", "go"), "possible"),
    ("const l = @import(\"lib.zig\");\nfn f(a: *l.W) void { a.next.?.go(); }", ("f", "go"), "possible"),
    ("const l = @import(\"lib.zig\");\nfn f(a: *l.W) void { for (a.items) |*x| x.go(); }", ("f", "go"), "possible"),
    ("const l = @import(\"lib.zig\");\nfn f(a: *l.W) void { if (a.next) |x| x.go(); }", ("f", "go"), "possible"),
    ("const l = @import(\"lib.zig\");\nfn f(a: *l.W) void { const x = &a.items[0]; x.go(); }", ("f", "go"), "possible"),
    ("const l = @import(\"lib.zig\");\nfn main() void { l.shared.go(); }", ("main", "go"), "possible"),
    ("fn main() void { @import(\"lib.zig\").start(); }", ("main", "start"), "definite"),
    ("const l = @import(\"lib.zig\");\nfn main() void { @field(l, \"start\")(); }", ("main", "start"), "possible"),
    ("const l = @import(\"lib.zig\");\nfn main() void { @field(l, name)(); }\nvar name: []const u8 = \"\";", ("main", "start"), "unknown"),
    ("const std = @import(\"std\");\nconst l = @import(\"lib.zig\");\nfn main() void { var list = std.ArrayList(l.W).init(a); for (list.items) |*w| w.go(); }", ("main", "go"), "possible"),
    ("const std = @import(\"std\");\nconst l = @import(\"lib.zig\");\nfn main() void { std.sort(l.Inner, l.Inner); }", ("main", "run"), "unknown"),
    ("const l = @import(\"lib.zig\");\nfn call(comptime T: type) void { T.run(); }\nfn main() void { call(l.Inner); }", ("main", "run"), "definite"),
]


@pytest.mark.parametrize(("source", "pair", "kind"), TWO_FILES)
def test_edges_across_files(source, pair, kind):
    assert edges({"main.zig": source, "lib.zig": LIB}).get(pair) == kind


def test_no_shadowing_by_locals_of_other_methods():
    u = unit("const S = struct { fn a() void { const b = 1; _ = b; } fn b() void {} };")
    assert "fn" in export_of(symbol(u, "S"), "b").flags


def test_reportable():
    files = {"main.zig": "const x = y;\nconst y = 1;\nfn f(p: u8) void { const l = p; _ = l; }\nconst S = struct { m: u8 };\nconst unused = y;\nfn g() void { _ = x; }"}
    project = Project.from_roots(files, ["main.zig"])
    resolver = Resolver(project)
    told = {s.name for s in project.units["main.zig"].symbols if is_reportable(s, resolver)}
    assert told == {"y", "f", "S", "unused", "g"}  # x is an alias in use


# -- projects
def test_files_load_depth_first():
    files = {"m.zig": '_ = @import("b.zig"); const a = @import("a.zig"); const b = @import("b.zig");'.replace("_ = ", "const z = "), "a.zig": "", "b.zig": 'const c = @import("c.zig");', "c.zig": ""}
    assert list(Project.from_roots(files, ["m.zig"]).units) == ["m.zig", "b.zig", "c.zig", "a.zig"]


def test_imports_in_tests_are_put_off():
    files = {"build.zig": 'pub fn build(b: *B) void { _ = b.addExecutable(.{ .root_module = b.createModule(.{ .root_source_file = b.path("m.zig") }) }); }', "m.zig": 'pub fn main() void {}\ntest "t" { _ = @import("t.zig"); }', "t.zig": 'const u = @import("u.zig");', "u.zig": ""}
    project = Project.from_build(files)
    assert [project.status(p) for p in ("m.zig", "t.zig", "u.zig", "build.zig")] == ["loaded", "test_only", "test_only", "build_file"]
    assert project.policy() == "analyze" and all(project.units[p].test_only for p in ("t.zig", "u.zig"))
    assert Project.from_roots(files, ["m.zig"]).status("t.zig") == "orphan"


def test_production_wins_over_tests():
    files = {"build.zig": 'pub fn build(b: *B) void { _ = b.addTest(.{ .root_source_file = b.path("t.zig") }); _ = b.addExecutable(.{ .root_source_file = b.path("m.zig") }); }', "m.zig": 'const s = @import("s.zig"); pub fn main() void {}', "t.zig": 'const s = @import("s.zig");', "s.zig": ""}
    project = Project.from_build(files)
    assert (project.status("s.zig"), project.status("t.zig")) == ("loaded", "test_only")


def test_contract_names():
    files = {"build.zig": 'pub fn build(b: *B) void { _ = b.addExecutable(.{ .root_source_file = b.path("m.zig") }); }', ".contract.zon": '.{ .exports = .{ "m.zig:S.go", "m.zig:T.go", "m.zig:S..go", "m.zig", "gone.zig:x" } }', "m.zig": "pub fn main() void {}\nconst S = struct { fn go() void {} };\nconst T = struct {};"}
    assert Project.from_build(files).contract.exports == [] == Project.from_build(files, contract="other.zon").contract.exports
    project = Project.from_build(files, contract=".contract.zon")
    assert project.contract_unresolved == [("m.zig:T.go", "go"), ("m.zig:S..go", ""), ("gone.zig:x", None)]
    assert len(project.contract_roots) + len(project.contract_unresolved) == len(project.contract.exports)


# -- build scripts and manifests
def build(body, extra=""):
    return scan_build_script({"build.zig": f"const std = @import(\"std\");\n{extra}\npub fn build(b: *std.Build) void {{\n{body}\n}}\n", "helpers.zig": HELPERS})


HELPERS = 'pub fn make(b: *B) *M { return b.createModule(.{ .root_source_file = b.path("made.zig") }); }\npub const Opts = struct { core: *M, file: []const u8 };\npub fn wire(b: *B, exe: *C, opts: Opts) void { exe.root_module.addImport("core", opts.core); exe.root_module.addImport("own", b.createModule(.{ .root_source_file = b.path(opts.file) })); }\n'


def test_modules_of_every_shape():
    g = build(
        """const core = b.createModule(.{ .root_source_file = b.path("core.zig") });
        const exe = b.addExecutable(.{ .name = "x", .root_module = b.createModule(.{ .root_source_file = b.path("main.zig"), .imports = &.{ .{ .name = "inline", .module = core } } }) });
        exe.root_module.addImport("core", core);
        exe.root_module.addAnonymousImport("anon", .{ .root_source_file = b.path("anon.zig") });
        exe.root_module.addImport("cwd", b.createModule(.{ .root_source_file = .{ .cwd_relative = b.pathFromRoot("cwd.zig") } }));
        exe.root_module.addImport("helped", b.createModule(.{ .root_source_file = through(b, "helped.zig") }));
        exe.root_module.addImport("dep", b.dependency("d", .{}).module("d"));
        exe.root_module.addImport(name, core);
        exe.root_module.addOptions("opts", o);
        _ = b.addModule("published", .{ .root_source_file = b.path("published.zig") });""",
        "fn through(b: *B, p: []const u8) L { check(p); return b.path(p); }\nfn check(p: []const u8) void { _ = p; }",
    )
    assert g.modules == {"inline": ["core.zig"], "core": ["core.zig"], "anon": ["anon.zig"], "cwd": ["cwd.zig"], "helped": ["helped.zig"], "published": ["published.zig"]}
    assert list(g.external) == ["dep", "opts"] and g.has_executable and g.has_library
    assert g.executables == ["main.zig"] and g.libraries == ["published.zig"]


def test_branches_keep_every_candidate():
    g = build('if (linux) { m.addImport("os", b.createModule(.{ .root_source_file = b.path("l.zig") })); } else { m.addImport("os", b.createModule(.{ .root_source_file = b.path("w.zig") })); }')
    assert g.modules == {"os": ["l.zig", "w.zig"]}


def test_helpers_of_other_files_and_forwarded_options():
    g = build('const h = @import("helpers.zig");\nm.addImport("made", helpers.make(b));\nhelpers.wire(b, m, .{ .core = b.createModule(.{ .root_source_file = b.path("c.zig") }), .file = "own.zig" });', 'const helpers = @import("helpers.zig");')
    assert g.modules == {"made": ["made.zig"], "core": ["c.zig"], "own": ["own.zig"]}
    assert g.scripts == ["build.zig", "helpers.zig"]


def test_structs_of_modules_and_sibling_blocks():
    g = build(
        """const ms = modules(b);
        { const m = b.createModule(.{ .root_source_file = b.path("one.zig") }); _ = b.addTest(.{ .root_module = m }); }
        { const m = b.createModule(.{ .root_source_file = b.path("two.zig") }); _ = b.addTest(.{ .root_module = m }); }
        _ = b.addExecutable(.{ .name = "e", .root_module = ms.app });
        e.addImport("lib", ms.lib);""",
        'fn modules(b: *B) struct { app: *M, lib: *M } { const lib = b.createModule(.{ .root_source_file = b.path("lib.zig") }); return .{ .app = b.createModule(.{ .root_source_file = b.path("app.zig") }), .lib = lib }; }',
    )
    assert g.tests == ["one.zig", "two.zig"] and g.executables == ["app.zig"] and g.modules == {"lib": ["lib.zig"]}


def test_tables_runners_and_nothing():
    g = build('for (rows) |r| { const m = b.createModule(.{ .root_source_file = b.path(r.path) }); _ = m; }\n_ = b.addTest(.{ .test_runner = .{ .path = b.path("runner.zig"), .mode = .simple } });', 'const rows = [_]R{ .{ .path = "a.zig" } };')
    assert g.tests == ["runner.zig"] and g.executables == []
    assert scan_build_script({}).scripts == [] and scan_build_script({"build.zig": "pub fn build("}).tests == []


ROOT = "{ const m = b.createModule(.{ .root_source_file = b.path(%s) }); _ = b.addTest(.{ .root_module = m }); }"


def test_roots_in_structs_behind_names_and_in_functions_that_nothing_calls():
    g = scan_build_script({
        "build.zig": 'const nested = @import("nested.zig");\nconst Steps = struct { fn tests(b: *B) void ' + ROOT % '"s.zig"' + " };\nfn wire(b: *B, p: []const u8) void " + ROOT % "p" + "\nconst up = down;\nconst down = up;\nfn idle(b: *B) void " + ROOT % '"idle.zig"' + '\npub fn build(b: *B) void {\nSteps.tests(b);\nconst go = wire;\ngo(b, "w.zig");\nup(b);\nnested.Deep.Inner.steps(b, "i.zig");\n}\n',
        "nested.zig": "pub const Deep = struct { pub const Inner = struct { pub fn steps(b: *B, p: []const u8) void " + ROOT % "p" + " }; };",
    })
    assert g.tests == ["s.zig", "w.zig", "i.zig", "idle.zig"] and g.modules == {} and list(g.external) == []


def test_names_that_a_function_does_not_explain_and_kinds_of_roots():
    g = build('const core = b.createModule(.{ .root_source_file = b.path("core.zig") });\nwire(b);\n_ = b.addObject(.{ .root_source_file = b.path("o.zig") });\n_ = b.addStaticLibrary(.{ .root_source_file = b.path("a.zig") });', 'fn wire(b: *B) void { later(b, 0x1_0); }\nfn unused(exe: *C, core: *M) void { exe.addImport("core", core); exe.addImport("other", what); }\nfn later(b: *B, n: u8) void { _ = n; wire(b); }')
    assert g.modules == {"core": ["core.zig"]} and list(g.external) == ["other"]
    assert g.executables == [] == g.libraries and not g.has_executable and not g.has_library


def test_helpers_twenty_deep_and_in_files_that_are_not_at_hand():
    chain = "\n".join(f"fn h{i}(b: *B) *M {{ return h{i + 1}(b); }}" for i in range(20)) + '\nfn h20(b: *B) *M { return b.createModule(.{ .root_source_file = b.path("deep.zig") }); }'
    assert build('m.addImport("deep", h0(b));', chain).modules == {"deep": ["deep.zig"]}
    script = {"build.zig": 'const far = @import("far/kit.zig");\npub fn build(b: *B) void { m.addImport("far", far.make(b)); m.addImport("none", far.nothing(b)); }'}
    asked = []
    g = scan_build_script(script, helpers=lambda path, name: asked.append((path, name)) or ("./far/m.zig" if name == "make" else None))
    assert g.modules == {"far": ["far/m.zig"]} and list(g.external) == ["none"] and asked == [("far/kit.zig", "make"), ("far/kit.zig", "nothing")]
    assert list(scan_build_script(script).external) == ["far", "none"]


def test_manifests():
    m = Manifest.parse('.{ .name = "n", .dependencies = .{ .a = .{ .url = "u" }, .@"b-c" = .{ .path = "../x/" } } }')
    assert m.dependencies == {"a", "b-c"} and m.paths == {"../x"}
    assert Manifest.parse("").dependencies == set() and Manifest.parse(".{ broken").dependencies == set()
    assert Contract.parse('.{ .exports = .{ "a.zig:b", "c.zig" } }').exports == ["a.zig:b", "c.zig"] and Contract.parse("nonsense").exports == []
