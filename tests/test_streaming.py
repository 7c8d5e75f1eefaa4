"""Incremental facts equal facts from scratch."""

from graphmill.plans.projects import extract_facts
from graphmill.streaming.incremental import FILE_SCHEMA, FactStore, follow


def test_changes_replace_the_facts_of_their_project(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    build = 'pub fn build(b: *B) void { _ = b.addExecutable(.{ .root_source_file = b.path("m.zig") }); }'
    first = [("p", "build.zig", build, 1), ("p", "m.zig", "pub fn main() void {}\nfn a() void {}", 1), ("q", "build.zig", build, 1), ("q", "m.zig", "pub fn main() void {}", 1)]
    second = [("p", "m.zig", "pub fn main() void { b(); }\nfn b() void {}", 2), ("p", "x.zig", "", 2)]
    third = [("p", "m.zig", "stale", 1), ("p", "x.zig", None, 3)]
    source = f"{tmp_path}/in"
    for rows in (first, second, third):
        spark.createDataFrame(rows, FILE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        store = FactStore(spark, f"file://{tmp_path}/store")  # opened anew each time, as after a restart
        query = follow(store, spark.readStream.schema(FILE_SCHEMA).parquet(source), f"{tmp_path}/checkpoint")
        query.awaitTermination()
    final = [("p", "build.zig", build), second[0][:3], ("q", "build.zig", build), ("q", "m.zig", "pub fn main() void {}")]
    expected = extract_facts(spark.createDataFrame(final, "project string, path string, text string"))
    key = lambda df: sorted(map(repr, df.select(*expected.columns).collect()))
    assert key(store.facts) == key(expected)
    assert len(list((tmp_path / "store/facts").iterdir())) <= 3
    store.apply(spark.createDataFrame([("p", path, None, 9) for path in ("build.zig", "m.zig", "x.zig")], FILE_SCHEMA))
    assert {r.project for r in store.facts.select("project").distinct().collect()} == {"q"}
