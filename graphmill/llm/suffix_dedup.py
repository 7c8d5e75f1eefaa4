"""Removal of long repeated strings with a sampled suffix array.

A byte goes if it lies in a string of ``size`` bytes (400) that also starts anywhere else, in
any document. Each window of that size has an anchor: its place with the least hash of
K bytes, the same place wherever the string stands. Windows in a row with one anchor form a segment.

1. One pass finds all segments: anchor hash, hash of the whole segment, place.
2. Anchors that occur once are dropped: no window with them is repeated.
3. Equal segments are counted. A segment that occurs twice is repeated as a whole.
4. A segment that occurs once may still share some windows with another segment of its
   anchor. The distinct segments of such anchors are fetched once each, and the suffixes at
   steps from the anchor are sorted (``suffix_sort``); common prefixes and
   the bytes to their left give the repeated windows. The suffixes of an anchor with more than
   HOT distinct segments are dealt to tasks by their place and their beginning, and sorted there. Where over HOT
   suffixes agree in all but the last STEP - 1 bytes, their windows are hashed and counted.
5. The spans go back to the documents.

Null and empty texts and texts shorter than ``size`` stay as they are. A row is a document of its
own: a repeated row is a copy of the other. Null ids are allowed. Memory of a worker
follows its longest text (about 60 bytes a byte) or one anchor's HOT segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.scratch import cut
from graphmill.llm.suffix_sort import STEP, repeated_windows, suffix_places
from graphmill.llm.textkit import BYTE_CODE, Poly, frugal, minimizer_runs, mix64, ragged, signed, text_slices

#: Segments of one anchor, or suffixes of one place and beginning, that are sorted in one task.
HOT = 1024
#: Tasks among which the rows of one counted window are dealt.
SALTS = 16
#: Bytes of segments that a task sorts at a time.
SORTED = 4 << 20


def anchor_bytes(size: int) -> int:
    return max(8, size * 8 // 25)


def segments(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, anchor hash, segment hash); places are in ``data``."""
    n, k = len(data), anchor_bytes(size)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if n < size:
        return none
    ok = np.zeros(n - size + 1, np.int8)
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths >= size)
    if not len(long):
        return none
    edges = np.zeros(n - size + 2, np.int32)
    np.add.at(edges, offsets[long], 1)
    np.add.at(edges, offsets[long + 1] - size + 1, -1)
    ok = np.cumsum(edges)[:-1] > 0
    poly = Poly(BYTE_CODE[data])
    starts = np.arange(n - k + 1)
    at, first, last = minimizer_runs(poly.span(starts, starts + k), size - k + 1, ok)
    row = np.searchsorted(offsets, first, "right") - 1
    whole = poly.span(first, last + size) ^ ((at - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (last - at).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return row, at, first, last, poly.span(at, at + k), whole


def _segments(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first_row, _, data, offsets in text_slices(batch.column(2)):
                row, at, first, last, anchor, whole = segments(data, offsets, size)
                base = offsets[row]
                columns = [signed(anchor), signed(whole), ids[first_row + row], hashes[first_row + row], (first - base).astype(np.int32), (at - first).astype(np.int32), (last - first + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "whole", "id", "hash", "first", "rel", "windows"])

    return docs.select("_id", "_hash", "_text").mapInArrow(frugal(run), "anchor bigint, whole bigint, id bigint, hash bigint, first int, rel int, windows int")


def _fetched(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The bytes of the wanted segments, from one document that has each."""
    lists = wanted.groupBy("id", "hash").agg(F.collect_list(F.struct("anchor", "whole", "copies", "first", "rel", "windows")).alias("_list"))
    # of a row that is there many times one copy is enough
    joined = docs.join(lists, (F.col("_id") == F.col("id")) & (F.col("_hash") == F.col("hash"))).dropDuplicates(["_id", "_hash"]).select("_text", "_list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, last_row, data, offsets in text_slices(batch.column(0), 4 << 20):
                lists = batch.column(1).slice(first_row, last_row - first_row)
                raw, items = data.tobytes(), lists.flatten()
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                base = np.repeat(offsets[:-1], counts)
                start = base + items.field("first").to_numpy(zero_copy_only=False)
                stop = start + items.field("windows").to_numpy(zero_copy_only=False) - 1 + size
                body = pa.array([raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([items.field(c) for c in ("anchor", "whole", "copies", "rel", "windows")] + [body], names=["anchor", "whole", "copies", "rel", "windows", "body"])

    return joined.mapInArrow(frugal(run), "anchor bigint, whole bigint, copies bigint, rel int, windows int, body binary")


def _intervals(segment: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last) of runs of window numbers."""
    order = np.lexsort((window, segment))
    segment, window = segment[order], window[order]
    new = np.ones(len(segment), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (window[1:] > window[:-1] + 1)
    at = np.flatnonzero(new)
    return segment[at], window[at], window[np.append(at[1:], len(window)) - 1] if len(at) else window


def _split(bodies: DataFrame, size: int) -> DataFrame:
    """The segments of hot anchors in pieces, one for each sampled suffix: (group, copies, rel, windows, body, anchor, whole, shift).

    Windows are equal only if their suffixes lie alike to the anchor and agree in all but STEP - 1 bytes, so a group has one place and one
    such beginning. ``shift`` is the number of the piece's first window in its segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                raw = b"".join(part.column(5).to_pylist())
                rel, windows = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
                lengths = windows - 1 + size
                base = np.cumsum(lengths) - lengths
                segment, step = suffix_places(rel, windows)
                start = rel[segment] - STEP * step  # of the suffix, within its segment
                first = np.maximum(0, start - STEP + 1)
                last = np.minimum(start, windows[segment] - 1)
                poly = Poly(BYTE_CODE[np.frombuffer(raw, np.uint8)])
                at = base[segment] + start
                anchor = part.column(0).to_numpy(zero_copy_only=False)[segment]
                group = mix64(poly.span(at, at + size - STEP + 1) ^ mix64(anchor.view(np.uint64) + step.astype(np.uint64)))
                body = [raw[x:y] for x, y in zip((base[segment] + first).tolist(), (base[segment] + last + size).tolist(), strict=True)]
                columns = [signed(group), part.column(2).to_numpy(zero_copy_only=False)[segment], (start - first).astype(np.int32), (last - first + 1).astype(np.int32)]
                names = [anchor, part.column(1).to_numpy(zero_copy_only=False)[segment], first.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(body, pa.binary()), *map(pa.array, names)], names=["group", "copies", "rel", "windows", "body", "anchor", "whole", "shift"])

    return bodies.select("anchor", "whole", "copies", "rel", "windows", "body").mapInArrow(frugal(run), "group bigint, copies bigint, rel int, windows int, body binary, anchor bigint, whole bigint, shift int")


def _sorted_repeats(bodies: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """(group, *keep, low, high): repeated windows of segments (group, copies, rel, windows, body, *keep) that occur once, by suffix sorting per group."""
    names = ["group", *keep, "low", "high"]

    def solve(table: pa.RecordBatch) -> pa.RecordBatch:
        group, copies, rel, windows = (table.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        buffer = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8)
        lengths = windows - 1 + size
        base = np.cumsum(lengths) - lengths
        segment, window = repeated_windows(buffer, base, base + rel, windows, group, copies, size)
        once = copies[segment] == 1
        segment, low, high = _intervals(segment[once], window[once])
        kept = [table.column(i).take(pa.array(segment)) for i in (0, *range(5, 5 + len(keep)))]
        return pa.RecordBatch.from_arrays([*kept, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_held = 0
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                held.append(part)
                bytes_held += part.column(4).nbytes
                if bytes_held >= SORTED:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    groups = table.column(0).to_numpy(zero_copy_only=False)
                    whole = int(np.searchsorted(groups, groups[-1], "left"))  # the last group may go on
                    if whole:
                        yield solve(table.slice(0, whole))
                        held = [table.slice(whole)]
                        bytes_held = len(held[0]) * 2 * size
        if held and sum(map(len, held)):
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    parts = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = dict(bodies.dtypes)
    given = bodies.select("group", "copies", "rel", "windows", "body", *keep)
    return given.repartition(parts, "group").sortWithinPartitions("group", "whole").mapInArrow(frugal(run), ", ".join(f"{c} {types.get(c, 'int')}" for c in names))


def _counted_repeats(pieces: DataFrame, size: int) -> DataFrame:
    """The same for pieces of groups that are still large: every window is a row keyed by its hash, summed before the shuffle; no group meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                buffer = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8)
                windows = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = windows - 1 + size
                piece, window = ragged(windows)
                start = (np.cumsum(lengths) - lengths)[piece] + window
                hashes = Poly(BYTE_CODE[buffer]).span(start, start + size)
                take = lambda k: part.column(k).to_numpy(zero_copy_only=False)[piece]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(take(0)), pa.array(take(1)), pa.array(take(4)), pa.array(take(5)), pa.array((take(6) + window).astype(np.int32)), pa.array(signed(hashes))], names=["group", "copies", "anchor", "whole", "low", "content"])

    given = pieces.select("group", "copies", "windows", "body", "anchor", "whole", "shift")
    rows = cut(given.mapInArrow(frugal(run), "group bigint, copies bigint, anchor bigint, whole bigint, low int, content bigint"), "windows")
    many = rows.groupBy("group", "content").agg(F.sum("copies").alias("_times")).where("_times >= 2")
    many = many.select(F.col("group").alias("_g"), F.col("content").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salted = rows.where("copies = 1").withColumn("_salt", F.pmod("whole", F.lit(SALTS)).cast("int"))  # a window that is everywhere goes to many tasks
    return salted.join(many, (F.col("group") == F.col("_g")) & (F.col("content") == F.col("_c")) & (F.col("_salt") == F.col("_s")), "left_semi").select("anchor", "whole", "low", F.col("low").alias("high"))


def _hot_repeats(bodies: DataFrame, size: int) -> DataFrame:
    """(anchor, whole, low, high) for hot anchors: sorted piece by piece, counted where over HOT pieces agree in all but STEP - 1 bytes."""
    pieces = cut(_split(bodies, size), "pieces")
    dense = cut(pieces.groupBy(F.col("group").alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("_g"), "dense")
    some = not dense.isEmpty()
    alike = F.col("group") == F.col("_g")
    found = _sorted_repeats(pieces.join(dense, alike, "left_anti") if some else pieces, size, ["anchor", "whole", "shift"])
    found = found.select("anchor", "whole", (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high"))
    return found.unionByName(_counted_repeats(pieces.join(dense, alike, "left_semi"), size)) if some else found


def repeated_spans(docs: DataFrame, size: int) -> DataFrame:
    """(id, hash, spans array of (start, end) in bytes), for documents (_id, _hash, _text) with a repeated string."""
    found = cut(_segments(docs, size), "segments")
    twice = found.groupBy(F.col("anchor").alias("_a")).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("_a")
    twice = cut(twice, "twice")  # apart from the join, so that a hot anchor's rows can be split there
    shared = cut(found.join(twice, F.col("anchor") == F.col("_a"), "left_semi"), "shared")
    distinct = shared.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("id", "hash", "first", "rel", "windows")])
    distinct = cut(distinct, "distinct")
    open_anchors = distinct.groupBy(F.col("anchor").alias("_a")).agg(F.count(F.lit(1)).alias("_segments"), F.min("copies").alias("_least")).where("_segments >= 2 and _least = 1")
    bodies = cut(_fetched(docs, distinct.join(open_anchors, F.col("anchor") == F.col("_a"), "left_semi"), size), "bodies")
    hot = cut(open_anchors.where(F.col("_segments") > HOT).select("_a"), "hot")
    some = not hot.isEmpty()
    cool = bodies.join(hot, F.col("anchor") == F.col("_a"), "left_anti") if some else bodies
    partial = _sorted_repeats(cool.withColumnRenamed("anchor", "group"), size, ["whole"]).withColumnRenamed("group", "anchor")
    if some:
        partial = partial.unionByName(_hot_repeats(bodies.join(hot, F.col("anchor") == F.col("_a"), "left_semi"), size))
    whole = distinct.where("copies > 1").select("anchor", "whole", F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"))
    lists = whole.unionByName(partial).groupBy(F.col("anchor").alias("_a"), F.col("whole").alias("_w")).agg(F.collect_list(F.struct("low", "high")).alias("_runs"))
    lists = cut(lists, "lists")
    spans = shared.join(lists, (F.col("anchor") == F.col("_a")) & (F.col("whole") == F.col("_w"))).select("id", "hash", "first", F.explode("_runs").alias("_run"))
    return spans.select("id", "hash", F.struct((F.col("first") + F.col("_run.low")).alias("start"), (F.col("first") + F.col("_run.high") + F.lit(size)).alias("end")).alias("span")).groupBy("id", "hash").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans; touching spans are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def remove_repeats(df: DataFrame, size: int = 400, doc_id: str = "doc_id", text: str = "text", shorter: int | None = None) -> DataFrame:
    """All columns of ``df`` plus ``removed`` (array of byte spans, maximal and in order), ``kept_bytes`` (binary: the rest) and ``kept_text`` (the rest without characters that were cut through).

    With ``shorter`` also ``repeated``: the spans that strings of so many bytes cover; nothing of them is removed.
    """
    sizes = [size] if shorter is None else [size, shorter]
    mine = ["removed", "kept_bytes", "kept_text", "repeated"][: 2 + len(sizes)]
    rest = [c for c in df.columns if c not in mine]
    other = [c for c in rest if c != text]
    names = [f"_c{i}" for i in range(len(other))]
    docs = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(other, names, strict=True)],
        F.col(f"`{text}`").isNull().alias("_null"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(2**63))).alias("_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_hash", F.xxhash64("_text"))
    joined = docs
    for i, one in enumerate(sizes):
        spans = repeated_spans(docs.select("_id", "_hash", "_text"), one).select(F.col("id").alias(f"_id{i}"), F.col("hash").alias(f"_hash{i}"), F.col("spans").alias(f"_spans{i}"))
        if shorter is not None:
            spans = cut(spans, "spans")  # the tables behind one size go before the next one's are made
        joined = joined.join(spans, (F.col("_id") == F.col(f"_id{i}")) & (F.col("_hash") == F.col(f"_hash{i}")), "left")
    joined = joined.select(*names, "_null", "_text", *[f"_spans{i}" for i in range(len(sizes))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.num_columns - len(sizes)
            found = [[merged(spans or []) for spans in batch.column(given + i).to_pylist()] for i in range(len(sizes))]
            kept = []
            for body, gone in zip(batch.column(given - 1).cast(pa.binary()).to_pylist(), found[0], strict=True):
                edges = [0, *[x for span in gone for x in span], len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            lists = [pa.array([[{"start": a, "end": b} for a, b in spans] for spans in one], kind) for one in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:given], lists[0], pa.array(kept, pa.binary()), pa.array([k.decode(errors="ignore") for k in kept], pa.string()), *lists[1:]], names=[*names, "_null", "_text", *mine])

    array = "array<struct<start:int,end:int>>"
    kinds = {"removed": array, "kept_bytes": "binary", "kept_text": "string", "repeated": array}
    schema = ", ".join([*(f"`{n}` {t}" for n, t in joined.dtypes[: len(names) + 2]), *(f"{c} {kinds[c]}" for c in mine)])
    out = joined.mapInArrow(frugal(run), schema)
    given = {c: F.col(n).alias(c) for c, n in zip(other, names, strict=True)} | {text: F.when(~F.col("_null"), F.col("_text")).alias(text)}
    return out.select(*[given[c] for c in rest], *mine)
