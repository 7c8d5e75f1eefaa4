"""Small projects in the analysed language, with the facts that they must give.

The expected rows are all rows of the projects. Findings, verdicts, roots, files and the report are written from the rules; the
full lists of edges, symbols and owners were started from a run and then looked through against the source.
"""

from __future__ import annotations

#: The file that lists what is used from outside, in projects that have one.
CONTRACT = ".contract.zon"
#: project -> (files, root files or None for the build script, public policy or None)
PROJECTS: dict[str, tuple[dict[str, str], str | None, str | None]] = {
    "dead_chain": (
        {"main.zig": "pub fn main() void {}\nfn upper() void {\n    lower();\n}\nfn lower() void {}\n"},
        "main.zig", None,
    ),
    "live_chain": (
        {"main.zig": "pub fn main() void {\n    first();\n}\nfn first() void {\n    second();\n}\nfn second() void {}\n"},
        "main.zig", None,
    ),
    "rollup": (
        {"main.zig": "pub fn main() void {}\nfn gone(a: u32, b: u32) u32 {\n    const sum = a + b;\n    return sum;\n}\n"},
        "main.zig", None,
    ),
    "cycle": (
        {"main.zig": "pub fn main() void {}\nfn ping() void {\n    pong();\n}\nfn pong() void {\n    ping();\n}\nfn again() void {\n    again();\n}\n"},
        "main.zig", None,
    ),
    "runtime_field": (
        {"main.zig": "const Tools = struct {\n    pub fn hammer() void {\n        swing();\n    }\n};\nfn swing() void {}\nfn pick() []const u8 {\n    return \"hammer\";\n}\npub fn main() void {\n    @field(Tools, pick())();\n}\n"},
        "main.zig", None,
    ),
    "literal_field": (
        {"main.zig": "const Tools = struct {\n    pub fn hammer() void {}\n    pub fn saw() void {}\n};\npub fn main() void {\n    @field(Tools, \"hammer\")();\n}\n"},
        "main.zig", None,
    ),
    "method": (
        {"main.zig": "const Lamp = struct {\n    on: bool = false,\n    pub fn flip(self: *Lamp) void {\n        self.on = true;\n    }\n    pub fn dim(self: *Lamp) void {\n        _ = self;\n    }\n};\npub fn main() void {\n    var lamp: Lamp = .{};\n    lamp.flip();\n}\n"},
        "main.zig", None,
    ),
    "two_files": (
        {
            "main.zig": "const std = @import(\"std\");\nconst store = @import(\"store.zig\");\npub fn main() void {\n    store.open();\n    var box: store.Box = .{};\n    box.fill();\n}\n",
            "store.zig": "pub fn open() void {\n    lock();\n}\nfn lock() void {}\npub fn close() void {}\npub const Box = struct {\n    size: u8 = 0,\n    pub fn fill(self: *Box) void {\n        self.size = 1;\n    }\n    pub fn empty(self: *Box) void {\n        self.size = 0;\n    }\n};\n",
            "lost.zig": "pub fn nobody() void {}\n",
        },
        "main.zig", None,
    ),
    "test_block": (
        {"main.zig": "pub fn main() void {}\nfn helper() void {\n    deeper();\n}\nfn deeper() void {}\nfn other() void {}\ntest \"it helps\" {\n    helper();\n}\n"},
        "main.zig", None,
    ),
    "exported": (
        {"main.zig": "export fn hook() void {\n    work();\n}\nfn work() void {}\nextern fn outside(code: c_int) void;\npub fn main() void {}\n"},
        "main.zig", None,
    ),
    "comptime_block": (
        {"main.zig": "const Check = struct {\n    pub fn all() void {}\n};\nfn verify() void {}\ncomptime {\n    verify();\n    Check.all();\n}\npub fn main() void {}\n"},
        "main.zig", None,
    ),
    "payloads": (
        {"main.zig": "const Node = struct {\n    next: ?*Node = null,\n    pub fn visit(self: *Node) void {\n        _ = self;\n    }\n    pub fn skip(self: *Node) void {\n        _ = self;\n    }\n};\nconst List = struct {\n    items: []Node,\n};\npub fn main() void {\n    const list: List = .{ .items = &.{} };\n    for (list.items) |*node| {\n        node.visit();\n    }\n    run() catch |_| {};\n}\nfn run() !void {}\n"},
        "main.zig", None,
    ),
    "decl_literal": (
        {"main.zig": "const Options = struct {\n    level: u8 = 0,\n    pub const empty: Options = .{};\n    pub const full: Options = .{ .level = 9 };\n};\npub fn main() void {\n    const o: Options = .empty;\n    _ = o;\n}\n"},
        "main.zig", None,
    ),
    "library": (
        {
            "build.zig": "const std = @import(\"std\");\npub fn build(b: *std.Build) void {\n    const lib = b.addLibrary(.{ .name = \"l\", .root_module = b.createModule(.{ .root_source_file = b.path(\"src/lib.zig\") }) });\n    _ = lib;\n}\n",
            "src/lib.zig": "pub fn api() void {\n    inner();\n}\nfn inner() void {}\nfn unused() void {}\n",
        },
        None, None,
    ),
    "full_build": (
        {
            "build.zig": "const std = @import(\"std\");\npub fn build(b: *std.Build) void {\n    const core = b.createModule(.{ .root_source_file = b.path(\"src/core.zig\") });\n    const exe = b.addExecutable(.{ .name = \"app\", .root_module = b.createModule(.{ .root_source_file = b.path(\"src/main.zig\") }) });\n    exe.root_module.addImport(\"core\", core);\n    exe.root_module.addImport(\"net\", b.dependency(\"net\", .{}).module(\"net\"));\n    exe.root_module.addOptions(\"config\", b.addOptions());\n    const tests = b.addTest(.{ .root_module = b.createModule(.{ .root_source_file = b.path(\"src/spec.zig\") }) });\n    _ = tests;\n}\n",
            "build.zig.zon": ".{\n    .name = \"app\",\n    .dependencies = .{\n        .net = .{ .url = \"x\" },\n        .local = .{ .path = \"third/local\" },\n    },\n}\n",
            ".contract.zon": ".{\n    .exports = .{ \"src/core.zig:published\", \"src/core.zig:absent\" },\n}\n",
            "src/main.zig": "const core = @import(\"core\");\nconst net = @import(\"net\");\nconst local = @import(\"local\");\nconst what = @import(\"what\");\nconst gone = @import(\"gone.zig\");\nconst text = @import(\"data.txt\");\npub fn main() void {\n    core.start();\n}\n",
            "src/core.zig": "pub fn start() void {}\npub fn published() void {\n    quiet();\n}\nfn quiet() void {}\npub fn forgotten() void {}\npub fn tested() void {}\n",
            "src/spec.zig": "const core = @import(\"core.zig\");\nconst kit = @import(\"kit.zig\");\ntest \"core\" {\n    core.tested();\n    kit.setup();\n}\n",
            "src/kit.zig": "pub fn setup() void {}\n",
            "src/stray.zig": "pub fn stray() void {}\n",
            "third/local/x.zig": "pub fn x() void {}\n",
            ".cache/y.zig": "pub fn y() void {}\n",
            "src/_kept.zig": "pub fn kept() void {}\n",
        },
        None, None,
    ),
    "tables": (
        {
            "build.zig": "const std = @import(\"std\");\nconst Row = struct { path: []const u8 };\nconst rows = [_]Row{ .{ .path = \"a_test.zig\" }, .{ .path = \"b_test.zig\" } };\npub fn build(b: *std.Build) void {\n    inline for (rows) |row| {\n        const m = b.createModule(.{ .root_source_file = b.path(row.path) });\n        const t = b.addTest(.{ .root_module = m });\n        _ = t;\n    }\n    const names = .{ .{ \"one\", \"c_test.zig\" } };\n    inline for (names) |pair| {\n        const t = b.addTest(.{ .name = pair[0], .root_module = b.createModule(.{ .root_source_file = b.path(pair[1]) }) });\n        _ = t;\n    }\n    check(b, \"d_test.zig\");\n    const mod = if (true) b.createModule(.{ .root_source_file = b.path(\"linux.zig\") }) else b.createModule(.{ .root_source_file = .{ .cwd_relative = \"mac.zig\" } });\n    const other = b.createModule(.{ .root_source_file = .{ .cwd_relative = \"mac.zig\" } });\n    const exe = b.addExecutable(.{ .name = \"t\", .root_module = b.createModule(.{ .root_source_file = b.path(\"main.zig\"), .imports = &.{ .{ .name = \"os\", .module = mod } } }) });\n    exe.root_module.addImport(\"os\", other);\n}\nfn check(b: *std.Build, path: []const u8) void {\n    const m = b.createModule(.{ .root_source_file = b.path(path) });\n    const t = b.addTest(.{ .root_module = m });\n    _ = t;\n}\n",
            "main.zig": "const os = @import(\"os\");\npub fn main() void {\n    os.sleep();\n}\n",
            "linux.zig": "pub fn wake() void {}\n",
            "mac.zig": "pub fn sleep() void {}\n",
            "a_test.zig": "test \"a\" {}\n",
            "d_test.zig": "test \"d\" {}\n",
        },
        None, None,
    ),
    "broken": ({"main.zig": "pub fn main() void {\n    const = 3;\n    fine();\n}\nfn fine() void {}\n"}, "main.zig", None),
    "bare_types": (
        {"main.zig": "const Hooks = struct {\n    call: *const fn (code: u32) void,\n};\npub fn main() void {\n    const h: Hooks = undefined;\n    _ = h;\n}\n"},
        "main.zig", None,
    ),
    "generic": (
        {"main.zig": "const Item = struct {\n    pub fn use(self: *Item) void {\n        _ = self;\n    }\n    pub fn idle(self: *Item) void {\n        _ = self;\n    }\n};\nfn apply(comptime T: type, value: *T) void {\n    T.use(value);\n}\npub fn main() void {\n    var item: Item = .{};\n    apply(Item, &item);\n}\n"},
        "main.zig", None,
    ),
    "anytype": (
        {"main.zig": "const Item = struct {\n    pub fn use(_: Item) void {}\n};\nfn apply(value: anytype) void {\n    value.use();\n}\npub fn main() void {\n    apply(Item{});\n}\n"},
        "main.zig", None,
    ),
}

#: (project, path, line, column, kind, name, class, nested, cycle size, cycle): everything that is reported.
FINDINGS: list[tuple[str, str, int, int, str, str, str, int, int, str]] = [
    ("dead_chain", "main.zig", 2, 4, "fn", "upper", "dead", 0, 0, ""),
    ("dead_chain", "main.zig", 5, 4, "fn", "lower", "dead", 0, 0, ""),
    ("rollup", "main.zig", 2, 4, "fn", "gone", "dead", 3, 0, ""),
    ("cycle", "main.zig", 2, 4, "fn", "ping", "dead", 0, 2, "ping, pong"),
    ("cycle", "main.zig", 8, 4, "fn", "again", "dead", 0, 1, "again"),
    ("runtime_field", "main.zig", 2, 12, "fn", "hammer", "possible", 0, 0, ""),
    ("runtime_field", "main.zig", 6, 4, "fn", "swing", "possible", 0, 0, ""),
    ("literal_field", "main.zig", 3, 12, "fn", "saw", "dead", 0, 0, ""),
    ("method", "main.zig", 6, 12, "fn", "dim", "dead", 1, 0, ""),
    ("two_files", "store.zig", 5, 8, "fn", "close", "dead", 0, 0, ""),
    ("two_files", "store.zig", 11, 12, "fn", "empty", "dead", 1, 0, ""),
    ("two_files", "main.zig", 1, 7, "const", "std", "dead", 0, 0, ""),
    ("test_block", "main.zig", 2, 4, "fn", "helper", "test_only", 0, 0, ""),
    ("test_block", "main.zig", 5, 4, "fn", "deeper", "test_only", 0, 0, ""),
    ("test_block", "main.zig", 6, 4, "fn", "other", "dead", 0, 0, ""),
    ("payloads", "main.zig", 6, 12, "fn", "skip", "dead", 1, 0, ""),
    ("decl_literal", "main.zig", 4, 15, "const", "full", "dead", 0, 0, ""),
    ("library", "src/lib.zig", 5, 4, "fn", "unused", "dead", 0, 0, ""),
    ("full_build", "src/core.zig", 6, 8, "fn", "forgotten", "dead", 0, 0, ""),
    ("full_build", "src/core.zig", 7, 8, "fn", "tested", "test_only", 0, 0, ""),
    ("full_build", "src/main.zig", 2, 7, "const", "net", "dead", 0, 0, ""),
    ("full_build", "src/main.zig", 3, 7, "const", "local", "dead", 0, 0, ""),
    ("full_build", "src/main.zig", 4, 7, "const", "what", "dead", 0, 0, ""),
    ("full_build", "src/main.zig", 5, 7, "const", "gone", "dead", 0, 0, ""),
    ("full_build", "src/main.zig", 6, 7, "const", "text", "dead", 0, 0, ""),
    ("tables", "linux.zig", 1, 8, "fn", "wake", "dead", 0, 0, ""),
    ("generic", "main.zig", 5, 12, "fn", "idle", "dead", 1, 0, ""),
]

#: (project, class, text) of the printed report
REPORT: list[tuple[str, str, str]] = [
    ("dead_chain", "dead", "  main.zig"), ("dead_chain", "dead", "    2:4: fn upper"), ("dead_chain", "dead", "    5:4: fn lower"),
    ("rollup", "dead", "  main.zig"), ("rollup", "dead", "    2:4: fn gone (+3 nested)"),
    ("cycle", "dead", "  main.zig"), ("cycle", "dead", "    2:4: fn ping (cycle of 2: ping, pong)"), ("cycle", "dead", "    8:4: fn again (cycle of 1: again)"),
    ("runtime_field", "possible", "  main.zig"), ("runtime_field", "possible", "    2:12: fn hammer"), ("runtime_field", "possible", "    6:4: fn swing"),
    ("literal_field", "dead", "  main.zig"), ("literal_field", "dead", "    3:12: fn saw"),
    ("method", "dead", "  main.zig"), ("method", "dead", "    6:12: fn dim (+1 nested)"),
    ("two_files", "dead", "  main.zig"), ("two_files", "dead", "    1:7: const std"), ("two_files", "dead", "  store.zig"), ("two_files", "dead", "    5:8: fn close"), ("two_files", "dead", "    11:12: fn empty (+1 nested)"),
    ("test_block", "dead", "  main.zig"), ("test_block", "dead", "    6:4: fn other"), ("test_block", "test_only", "  main.zig"), ("test_block", "test_only", "    2:4: fn helper"), ("test_block", "test_only", "    5:4: fn deeper"),
    ("payloads", "dead", "  main.zig"), ("payloads", "dead", "    6:12: fn skip (+1 nested)"),
    ("decl_literal", "dead", "  main.zig"), ("decl_literal", "dead", "    4:15: const full"),
    ("library", "dead", "  src/lib.zig"), ("library", "dead", "    5:4: fn unused"),
    ("full_build", "dead", "  src/core.zig"), ("full_build", "dead", "    6:8: fn forgotten"), ("full_build", "test_only", "  src/core.zig"), ("full_build", "test_only", "    7:8: fn tested"),
    ("full_build", "dead", "  src/main.zig"), ("full_build", "dead", "    2:7: const net"), ("full_build", "dead", "    3:7: const local"), ("full_build", "dead", "    4:7: const what"), ("full_build", "dead", "    5:7: const gone"), ("full_build", "dead", "    6:7: const text"),
    ("tables", "dead", "  linux.zig"), ("tables", "dead", "    1:8: fn wake"),
    ("generic", "dead", "  main.zig"), ("generic", "dead", "    5:12: fn idle (+1 nested)"),
]

_KIND = {"d": "definite", "p": "possible", "u": "unknown"}


def _edges(text: str) -> list[tuple[str, str, str]]:
    """(user, used, strongest kind) from ``user>used:kind``; a file as a whole has no name."""
    parts = (one.replace(">", ":").split(":") for one in text.split())
    return [(a, b, _KIND[k]) for a, b, k in parts]


#: (project, user, used, strongest kind): all edges, by name.
EDGES: list[tuple[str, str, str, str]] = [
    (project, *edge)
    for project, text in {
        "dead_chain": "upper>lower:d",
        "live_chain": "main>first:d first>second:d",
        "rollup": "sum>a:d sum>b:d gone>sum:d",
        "cycle": "ping>pong:d pong>ping:d again>again:d",
        "runtime_field": "hammer>swing:d main>Tools:d main>hammer:u main>pick:d",
        "literal_field": "main>Tools:d main>hammer:p",
        "method": "self>Lamp:d flip>self:d flip>on:p dim>self:d lamp>Lamp:d main>lamp:d main>flip:p Lamp>on:d",
        "two_files": "main>store:d main>open:d box>store:d box>Box:d main>box:d main>fill:p store>:d open>lock:d self>Box:d fill>self:d fill>size:p empty>self:d empty>size:p Box>size:d",
        "test_block": "helper>deeper:d",
        "exported": "hook>work:d",
        "payloads": "next>Node:d self>Node:d visit>self:d skip>self:d items>Node:d list>List:d main>list:d main>items:p main>node:d main>visit:p main>run:d Node>next:d List>items:d",
        "decl_literal": "empty>Options:d full>Options:d o>Options:d main>o:d Options>level:d o>empty:p",
        "library": "api>inner:d",
        "full_build": "main>core:d main>start:d core>:d published>quiet:d >tested:d >setup:d kit>:d",
        "tables": "main>os:d main>sleep:d os>:d",
        "broken": "main>fine:d",
        "bare_types": "h>Hooks:d main>h:d Hooks>call:d",
        "generic": "self>Item:d use>self:d idle>self:d value>T:d apply>T:d apply>value:d item>Item:d main>apply:d main>Item:d main>item:d main>use:d",
        "anytype": "use>Item:d apply>value:d main>apply:d main>Item:d main>use:p",
    }.items()
    for edge in _edges(text)
]

#: (project, path, status)
FILES: list[tuple[str, str, str]] = [
    ("two_files", "main.zig", "loaded"), ("two_files", "store.zig", "loaded"), ("two_files", "lost.zig", "orphan"),
    ("library", "build.zig", "build_file"), ("library", "src/lib.zig", "loaded"),
    ("full_build", "build.zig", "build_file"), ("full_build", "src/main.zig", "loaded"), ("full_build", "src/core.zig", "loaded"),
    ("full_build", "src/spec.zig", "test_only"), ("full_build", "src/kit.zig", "test_only"), ("full_build", "src/stray.zig", "orphan"), ("full_build", "src/_kept.zig", "orphan"),
    ("tables", "build.zig", "build_file"), ("tables", "main.zig", "loaded"), ("tables", "linux.zig", "loaded"), ("tables", "mac.zig", "loaded"),
    ("tables", "a_test.zig", "test_only"), ("tables", "d_test.zig", "test_only"),
    *((p, "main.zig", "loaded") for p in ("dead_chain", "live_chain", "rollup", "cycle", "runtime_field", "literal_field", "method", "test_block", "exported", "comptime_block", "payloads", "decl_literal", "broken", "bare_types", "generic", "anytype")),
]

#: (project, importing file, specifier, reason)
UNRESOLVED: list[tuple[str, str, str, str]] = [
    ("two_files", "main.zig", "std", "external"),
    ("full_build", "src/main.zig", "net", "external"),
    ("full_build", "src/main.zig", "local", "external"),
    ("full_build", "src/main.zig", "what", "unknown_module"),
    ("full_build", "src/main.zig", "gone.zig", "load_failed"),
    ("full_build", "src/main.zig", "data.txt", "not_a_source_file"),
]

#: (project, reason, imports)
REASONS: list[tuple[str, str, int]] = [("two_files", "external", 1), ("full_build", "external", 2), ("full_build", "unknown_module", 1), ("full_build", "load_failed", 1), ("full_build", "not_a_source_file", 1)]

#: (project, module name, path or 'external')
MODULES: list[tuple[str, str, str]] = [
    ("full_build", "core", "src/core.zig"), ("full_build", "net", "external"), ("full_build", "config", "external"),
    ("tables", "os", "linux.zig"), ("tables", "os", "mac.zig"),
]

#: (project, kind, path)
BUILD_ROOTS: list[tuple[str, str, str]] = [
    ("library", "library", "src/lib.zig"), ("full_build", "exe", "src/main.zig"), ("full_build", "test", "src/spec.zig"),
    ("tables", "exe", "main.zig"), ("tables", "test", "a_test.zig"), ("tables", "test", "b_test.zig"), ("tables", "test", "c_test.zig"), ("tables", "test", "d_test.zig"),
]

#: (project, name, root kind); the file of a library is a root as well
ROOTS: list[tuple[str, str, str]] = [
    *((p, "main", "executable_entry") for p in ("dead_chain", "live_chain", "rollup", "cycle", "runtime_field", "literal_field", "method", "two_files", "test_block", "exported", "comptime_block", "payloads", "decl_literal", "full_build", "tables", "broken", "bare_types", "generic", "anytype")),
    ("exported", "hook", "export"), ("comptime_block", "verify", "comptime_block"), ("comptime_block", "all", "comptime_block"), ("comptime_block", "Check", "comptime_block"),
    ("library", "api", "public_api"), ("library", "", "public_api"), ("full_build", "published", "contract"),
]

#: (project, entry, missing name)
STALE: list[tuple[str, str, str]] = [("full_build", "src/core.zig:absent", "absent")]

#: (project, exit code)
EXIT_CODES: list[tuple[str, int]] = [
    ("dead_chain", 1), ("live_chain", 0), ("rollup", 1), ("cycle", 1), ("runtime_field", 0), ("literal_field", 1), ("method", 1), ("two_files", 1), ("test_block", 1),
    ("exported", 0), ("comptime_block", 0), ("payloads", 1), ("decl_literal", 1), ("library", 1), ("full_build", 1), ("tables", 1), ("broken", 2), ("bare_types", 0), ("generic", 1), ("anytype", 0),
]

_PARAM, _VALUE, _TYPE, _FIELD = "const,fn_param", "const,variable", "const,struct,variable", "member,struct"
#: (project, path, name, kind, line, column, flags) of all symbols; the file itself has no name
SYMBOLS: list[tuple[str, str, str, str, int, int, str]] = [
    *((project, path, "", "const", 1, 1, "const") for project, (files, _, _) in PROJECTS.items() for path in files if path.endswith(".zig") and path not in ("build.zig", "lost.zig", "src/stray.zig", "third/local/x.zig", ".cache/y.zig", "src/_kept.zig")),
    *(
        (project, path, name, kind, line, column, flags)
        for project, path, rows in (
            ("dead_chain", "main.zig", [("main", "fn", 1, 8, "fn"), ("upper", "fn", 2, 4, "fn"), ("lower", "fn", 5, 4, "fn")]),
            ("live_chain", "main.zig", [("main", "fn", 1, 8, "fn"), ("first", "fn", 4, 4, "fn"), ("second", "fn", 7, 4, "fn")]),
            ("rollup", "main.zig", [("main", "fn", 1, 8, "fn"), ("gone", "fn", 2, 4, "fn"), ("a", "const", 2, 9, _PARAM), ("b", "const", 2, 17, _PARAM), ("sum", "const", 3, 11, _VALUE)]),
            ("cycle", "main.zig", [("main", "fn", 1, 8, "fn"), ("ping", "fn", 2, 4, "fn"), ("pong", "fn", 5, 4, "fn"), ("again", "fn", 8, 4, "fn")]),
            ("runtime_field", "main.zig", [("Tools", "struct", 1, 7, _TYPE), ("hammer", "fn", 2, 12, "fn"), ("swing", "fn", 6, 4, "fn"), ("pick", "fn", 7, 4, "fn"), ("main", "fn", 10, 8, "fn")]),
            ("literal_field", "main.zig", [("Tools", "struct", 1, 7, _TYPE), ("hammer", "fn", 2, 12, "fn"), ("saw", "fn", 3, 12, "fn"), ("main", "fn", 5, 8, "fn")]),
            ("method", "main.zig", [("Lamp", "struct", 1, 7, _TYPE), ("on", "struct", 2, 5, _FIELD), ("flip", "fn", 3, 12, "fn"), ("self", "const", 3, 17, _PARAM), ("dim", "fn", 6, 12, "fn"), ("self", "const", 6, 16, _PARAM), ("main", "fn", 10, 8, "fn"), ("lamp", "var", 11, 9, "variable")]),
            ("two_files", "main.zig", [("std", "const", 1, 7, _VALUE), ("store", "const", 2, 7, _VALUE), ("main", "fn", 3, 8, "fn"), ("box", "var", 5, 9, "variable")]),
            ("two_files", "store.zig", [("open", "fn", 1, 8, "fn"), ("lock", "fn", 4, 4, "fn"), ("close", "fn", 5, 8, "fn"), ("Box", "struct", 6, 11, _TYPE), ("size", "struct", 7, 5, _FIELD), ("fill", "fn", 8, 12, "fn"), ("self", "const", 8, 17, _PARAM), ("empty", "fn", 11, 12, "fn"), ("self", "const", 11, 18, _PARAM)]),
            ("test_block", "main.zig", [("main", "fn", 1, 8, "fn"), ("helper", "fn", 2, 4, "fn"), ("deeper", "fn", 5, 4, "fn"), ("other", "fn", 6, 4, "fn")]),
            ("exported", "main.zig", [("hook", "fn", 1, 11, "export,fn"), ("work", "fn", 4, 4, "fn"), ("outside", "fn", 5, 11, "extern,fn"), ("code", "const", 5, 19, _PARAM), ("main", "fn", 6, 8, "fn")]),
            ("comptime_block", "main.zig", [("Check", "struct", 1, 7, _TYPE), ("all", "fn", 2, 12, "fn"), ("verify", "fn", 4, 4, "fn"), ("main", "fn", 9, 8, "fn")]),
            ("payloads", "main.zig", [("Node", "struct", 1, 7, _TYPE), ("next", "struct", 2, 5, _FIELD), ("visit", "fn", 3, 12, "fn"), ("self", "const", 3, 18, _PARAM), ("skip", "fn", 6, 12, "fn"), ("self", "const", 6, 17, _PARAM), ("List", "struct", 10, 7, _TYPE), ("items", "struct", 11, 5, _FIELD), ("main", "fn", 13, 8, "fn"), ("list", "const", 14, 11, _VALUE), ("node", "const", 15, 24, "const,payload"), ("_", "const", 18, 18, "catch_param,const,payload"), ("run", "fn", 20, 4, "fn")]),
            ("decl_literal", "main.zig", [("Options", "struct", 1, 7, _TYPE), ("level", "struct", 2, 5, _FIELD), ("empty", "const", 3, 15, _VALUE), ("full", "const", 4, 15, _VALUE), ("main", "fn", 6, 8, "fn"), ("o", "const", 7, 11, _VALUE)]),
            ("library", "src/lib.zig", [("api", "fn", 1, 8, "fn"), ("inner", "fn", 4, 4, "fn"), ("unused", "fn", 5, 4, "fn")]),
            ("full_build", "src/main.zig", [("core", "const", 1, 7, _VALUE), ("net", "const", 2, 7, _VALUE), ("local", "const", 3, 7, _VALUE), ("what", "const", 4, 7, _VALUE), ("gone", "const", 5, 7, _VALUE), ("text", "const", 6, 7, _VALUE), ("main", "fn", 7, 8, "fn")]),
            ("full_build", "src/core.zig", [("start", "fn", 1, 8, "fn"), ("published", "fn", 2, 8, "fn"), ("quiet", "fn", 5, 4, "fn"), ("forgotten", "fn", 6, 8, "fn"), ("tested", "fn", 7, 8, "fn")]),
            ("full_build", "src/kit.zig", [("setup", "fn", 1, 8, "fn")]),
            ("full_build", "src/spec.zig", [("core", "const", 1, 7, _VALUE), ("kit", "const", 2, 7, _VALUE)]),
            ("tables", "main.zig", [("os", "const", 1, 7, _VALUE), ("main", "fn", 2, 8, "fn")]),
            ("tables", "linux.zig", [("wake", "fn", 1, 8, "fn")]),
            ("tables", "mac.zig", [("sleep", "fn", 1, 8, "fn")]),
            ("broken", "main.zig", [("main", "fn", 1, 8, "fn"), ("fine", "fn", 5, 4, "fn")]),
            ("bare_types", "main.zig", [("Hooks", "struct", 1, 7, _TYPE), ("call", "struct", 2, 5, _FIELD), ("code", "struct", 2, 22, "const,fn_param,struct"), ("main", "fn", 4, 8, "fn"), ("h", "const", 5, 11, _VALUE)]),
            ("generic", "main.zig", [("Item", "struct", 1, 7, _TYPE), ("use", "fn", 2, 12, "fn"), ("self", "const", 2, 16, _PARAM), ("idle", "fn", 5, 12, "fn"), ("self", "const", 5, 17, _PARAM), ("apply", "fn", 9, 4, "fn"), ("T", "const", 9, 19, "comptime,const,fn_param"), ("value", "const", 9, 28, _PARAM), ("main", "fn", 12, 8, "fn"), ("item", "var", 13, 9, "variable")]),
            ("anytype", "main.zig", [("Item", "struct", 1, 7, _TYPE), ("use", "fn", 2, 12, "fn"), ("_", "const", 2, 16, _PARAM), ("apply", "fn", 4, 4, "fn"), ("value", "const", 4, 10, _PARAM), ("main", "fn", 7, 8, "fn")]),
        )
        for name, kind, line, column, flags in rows
    ),
]

#: of dead_chain: (tag, tokens)
TOKENS: list[tuple[str, int]] = [("pub", 1), ("fn", 3), ("identifier", 7), ("(", 4), (")", 4), ("{", 3), ("}", 3), (";", 1), ("eof", 1)]

#: of rollup: (name, uses, references)
REFERENCES: list[tuple[str, str, int]] = [
    ("void", "type+primitive", 1), ("u32", "read+primitive", 2), ("u32", "type+primitive", 1), ("a", "read", 1), ("b", "read", 1), ("sum", "read", 1),
]

#: of rollup: (flags, scopes)
SCOPES: list[tuple[str, int]] = [("top", 1), ("function", 2), ("function+block", 2)]

#: (project, names that are used and who owns the use): all names that a file itself declares; what belongs to nobody has no name
_OWNERS: dict[str, str] = {
    "dead_chain": "lower<upper",
    "live_chain": "first<main second<first",
    "rollup": "a<sum b<sum sum<gone",
    "cycle": "pong<ping ping<pong again<again",
    "runtime_field": "swing<hammer Tools<main pick<main",
    "literal_field": "Tools<main",
    "method": "Lamp<self self<flip self<dim Lamp<lamp lamp<main",
    "two_files": "store<main store<box box<main lock<open Box<self self<fill self<empty",
    "test_block": "deeper<helper helper<",
    "exported": "work<hook",
    "comptime_block": "verify< Check<",
    "payloads": "Node<next Node<self self<visit self<skip Node<items List<list list<main node<main run<main",
    "decl_literal": "Options<empty Options<full Options<o o<main",
    "library": "inner<api std<b b<lib lib<build",
    "full_build": "core<main quiet<published core< kit< std<b b<core b<exe b<tests b<build exe<build core<build tests<build",
    "tables": "os<main std<b Row<rows rows<build names<build row<m path<m b<m b<t b<mod b<exe b<other b<build m<t pair<t mod<exe t<build t<check other<build exe<build check<build",
    "broken": "fine<main",
    "bare_types": "Hooks<h h<main",
    "generic": "Item<self self<use self<idle T<value T<apply value<apply Item<item apply<main Item<main item<main",
    "anytype": "Item<use value<apply apply<main Item<main",
}
OWNERS: list[tuple[str, str, str]] = [(project, *one.split("<")) for project, text in _OWNERS.items() for one in text.split()]

#: (project, verdict, names) of everything that may be reported
_VERDICTS: list[tuple[str, str, str]] = [
    ("dead_chain", "reached", "main"), ("dead_chain", "dead", "upper lower"),
    ("live_chain", "reached", "main first second"),
    ("rollup", "reached", "main"), ("rollup", "dead", "gone"),
    ("cycle", "reached", "main"), ("cycle", "dead", "ping pong again"),
    ("runtime_field", "reached", "main Tools pick"), ("runtime_field", "possible", "hammer swing"),
    ("literal_field", "reached", "main Tools hammer"), ("literal_field", "dead", "saw"),
    ("method", "reached", "main Lamp flip"), ("method", "dead", "dim"),
    ("two_files", "reached", "main open lock Box fill"), ("two_files", "dead", "std close empty"),
    ("test_block", "reached", "main"), ("test_block", "dead", "helper deeper other"),
    ("exported", "reached", "main hook work"),
    ("comptime_block", "reached", "main Check all verify"),
    ("payloads", "reached", "main Node visit List run"), ("payloads", "dead", "skip"),
    ("decl_literal", "reached", "main Options empty"), ("decl_literal", "dead", "full"),
    ("library", "reached", "api inner"), ("library", "dead", "unused"),
    ("full_build", "reached", "main start published quiet"), ("full_build", "dead", "net local what gone text forgotten tested setup"),
    ("tables", "reached", "main sleep"), ("tables", "dead", "wake"),
    ("broken", "reached", "main fine"),
    ("bare_types", "reached", "main Hooks"),
    ("generic", "reached", "main Item use apply"), ("generic", "dead", "idle"),
    ("anytype", "reached", "main Item use apply"),
]
VERDICTS: list[tuple[str, str, str]] = [(project, name, verdict) for project, verdict, names in _VERDICTS for name in names.split()]

#: (project, name, members of its component, cyclic) of the same; a type and its field that points at the type are a cycle
_CYCLES = {("cycle", "ping"): (2, 1), ("cycle", "pong"): (2, 1), ("cycle", "again"): (1, 1), ("payloads", "Node"): (2, 1)}
CYCLES: list[tuple[str, str, int, int]] = [(project, name, *_CYCLES.get((project, name), (1, 0))) for project, name, _ in VERDICTS]
