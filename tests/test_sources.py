"""Discovery, reading and report sinks on a tree in a temporary folder."""

import pytest

from graphmill.plans.projects import analyze, exit_codes
from graphmill.sources.files import discover, read_project, relative_path, write_report

TREE = {
    "build.zig": 'pub fn build(b: *B) void { _ = b.addExecutable(.{ .root_source_file = b.path("src/main.zig") }); }',
    "build.zig.zon": ".{}",
    ".contract.zon": '.{ .exports = .{ "src/_odd.zig:told" } }',
    "src/main.zig": 'const odd = @import("_odd.zig");\npub fn main() void { odd.go(); }\n',
    "src/_odd.zig": "pub fn go() void {}\npub fn told() void {}\nfn never() void {}\n",
    "src/lost file.zig": "// ñ\n",
    "src/.hidden/a.zig": "",
    "zig-out/b.zig": "",
    "vendor/c.zig": "",
    "notes.txt": "",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    return tmp_path / "p"


def test_discovery(spark, tree):
    expected = [".contract.zon", "build.zig", "build.zig.zon", "src/_odd.zig", "src/lost file.zig", "src/main.zig"]
    assert discover(spark, str(tree), ".contract.zon") == discover(spark, f"file://{tree}", ".contract.zon") == expected
    assert discover(spark, str(tree)) == expected[1:]
    (tree / "src/twin.zig").symlink_to(tree / "src/main.zig")
    assert discover(spark, str(tree)) == expected[1:]
    with pytest.raises(Exception, match="exist"):
        discover(spark, str(tree / "nowhere"))


def test_read_analyze_and_report(spark, tree, tmp_path):
    files = read_project(spark, str(tree), "p", ".contract.zon")
    assert {r.path: r.text for r in files.collect()} == {k: v for k, v in TREE.items() if k in discover(spark, str(tree), ".contract.zon")}
    result = analyze(files, ".contract.zon")
    assert [(r.path, r.line, r.name, r["class"]) for r in result.findings.collect()] == [("src/_odd.zig", 3, "never", "dead")]
    assert [(r.path, r.kind) for r in result.of("file").where("kind = 'orphan'").collect()] == [("src/lost file.zig", "orphan")]
    assert exit_codes(result).collect()[0].exit_code == 1
    write_report(result.findings, str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text/project=p/class=dead")).collect()] == ["  src/_odd.zig", "    3:4: fn never"]
    write_report(result.findings, str(tmp_path / "parquet"), as_text=False)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1


def test_relative_paths():
    assert relative_path("/a/b", "/a/b/c.zig") == "c.zig" and relative_path("/a/b", "/a/x.zig") == "../x.zig"
