"""Removal of repeated word passages over a compacted de Bruijn graph.

Edges are windows of ``size`` words (20), nodes their first and last ``size - 1`` words.

1. One pass cuts every text into super-edges: runs of windows that share their minimizer
   (the run of LEAD words with the least hash), so that equal passages are cut alike and a row
   stands for several edges. Minimizers that occur once are dropped; a run of rows first drops
   its own repeats of a minimizer to a mark, so a frequent one gives a row per run and not per place.
2. A super-edge that is the only one with its minimizer is a nonbranching path already. Where
   several differ, they are opened into single edges, which are counted.
3. Repeated pieces are compacted: a join of piece ends with piece starts finds the nodes with one
   way in and one way out; pieces that meet there and lie side by side in the text where they first occur
   form one path.
4. Occurrences of pieces are placed on their path. Source coordinates verify that the
   pieces of an occurrence are contiguous, and say whether it is the first. All windows that also
   start earlier (smaller id, or earlier in the text) are removed; the first occurrence stays.

Null and empty texts have no words. Rows with one id and equal text are one document; rows with one
id and other texts are ordered by a hash of the text. Null ids come first, in the order of 62 bits of that hash; ids must be
over -2**62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.scratch import cut, tidy
from graphmill.llm.textkit import BYTE_CODE, Poly, frugal, minimizer_runs, ragged, signed, text_slices, words

#: Words of a minimizer.
LEAD = 8
#: Rows that a task looks through for repeats of a minimizer before it passes them on.
RUN = 400_000
# place: 22 bits version of the text, 31 bits first window, 5 bits minimizer - first window, 5 bits windows - 1
POS, REL, VERSION = 10, 5, 41
POSITIONS = (1 << (VERSION - POS)) - 1
#: Unlike texts of one id, at most.
VERSIONS = 1 << (63 - VERSION)


def position(place):
    return F.shiftright(place, POS).bitwiseAND(F.lit(POSITIONS))


def version(place):
    """Which of the unlike texts of an id a place is in."""
    return F.shiftright(place, VERSION)


def numbered(docs: DataFrame) -> DataFrame:
    """Adds ``_version`` to documents (_id, _hash, ..): 0, or for an id with unlike texts the number of the text in the order of its hash."""
    several = docs.groupBy("_id").agg(F.min("_hash").alias("_a"), F.max("_hash").alias("_b")).where("_a <> _b").select("_id")
    several = cut(several, "several")
    if not several.limit(1).count():
        return docs.withColumn("_version", F.lit(0).cast("long"))
    texts = docs.select("_id", "_hash").join(several, "_id", "left_semi").distinct()
    most = texts.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if most > VERSIONS:
        raise ValueError(f"an id has {most} unlike texts; at most {VERSIONS} are told apart")
    numbers = cut(texts.select("_id", "_hash", (F.row_number().over(Window.partitionBy("_id").orderBy("_hash")) - 1).cast("long").alias("_number")), "numbers")
    return docs.join(numbers, ["_id", "_hash"], "left").withColumn("_version", F.coalesce("_number", F.lit(0).cast("long"))).drop("_number")


def super_edges(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(row, first window within the row, minimizer offset, windows, minimizer hash, hash of the whole)."""
    start, end, first = words(data, offsets)
    n = len(start)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    counts = np.diff(first)
    long = np.flatnonzero(counts >= size)
    if not len(long):
        return none
    edges = np.zeros(n - size + 2, np.int32)
    np.add.at(edges, first[long], 1)
    np.add.at(edges, first[long + 1] - size + 1, -1)
    poly = Poly(Poly(BYTE_CODE[data]).span(start, end))
    places = np.arange(n - LEAD + 1)
    at, low, high = minimizer_runs(poly.span(places, places + LEAD), size - LEAD + 1, np.cumsum(edges)[:-1] > 0)
    row = np.searchsorted(first, low, "right") - 1
    shape = (at - low).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (high - at).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return row, low - first[row], at - low, high - low + 1, poly.span(at, at + LEAD), poly.span(low, high + size) ^ shape


def _repeated(docs: DataFrame, size: int) -> DataFrame:
    """(lead, whole, id, place) of super-edges whose minimizer occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def passed_on() -> pa.RecordBatch:
            lead, whole, ids, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(lead, kind="stable")
            lead, whole, ids, place = lead[order], whole[order], ids[order], place[order]
            new = np.ones(len(lead), bool)
            new[1:] = lead[1:] != lead[:-1]
            at = np.flatnonzero(new)
            sizes = np.diff(np.append(at, len(lead)))
            many = np.repeat(sizes > 1, sizes)
            salt = np.where(many, np.arange(1, len(lead) + 1), 0)  # rows known to repeat go anywhere
            marks = lead[at[sizes > 1]]
            none = np.zeros(len(marks), np.int64)
            columns = [np.concatenate(x) for x in ((lead, marks), (salt, none), (whole, none), (ids, none), (place, none - 1))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lead", "salt", "whole", "id", "place"])

        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first_row, _, data, offsets in text_slices(batch.column(2)):
                row, first, rel, windows, lead, whole = super_edges(data, offsets, size)
                if len(row):
                    held.append((signed(lead), signed(whole), ids[first_row + row], versions[first_row + row] << VERSION | first << POS | rel << REL | windows - 1))
                    rows += len(row)
                if rows >= RUN:
                    yield passed_on()
                    held, rows = [], 0
        if rows:
            yield passed_on()

    found = docs.select("_id", "_version", "_text").mapInArrow(frugal(run), "lead bigint, salt bigint, whole bigint, id bigint, place bigint")
    same = Window.partitionBy("lead", "salt")
    counted = found.withColumn("_rows", F.count(F.lit(1)).over(same))
    return counted.where("place >= 0 and (salt > 0 or _rows > 1)").select("lead", "whole", "id", "place")


def _pieces(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(lead, content, source, target, windows, id, place, copies, open): wanted super-edges, those of open minimizers as single edges."""
    lists = wanted.groupBy("id", version("place").alias("version")).agg(F.collect_list(F.struct("lead", "whole", "copies", "place", "open")).alias("_list"))
    joined = docs.join(lists, (F.col("_id") == F.col("id")) & (F.col("_version") == F.col("version")))
    joined = joined.select("_id", "_text", "_list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first_row, last_row, data, offsets in text_slices(batch.column(1)):
                lists = batch.column(2).slice(first_row, last_row - first_row)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                items = lists.flatten()
                lead, whole, copies, place = (items.field(c).to_numpy(zero_copy_only=False) for c in ("lead", "whole", "copies", "place"))
                opened = items.field("open").to_numpy(zero_copy_only=False).astype(bool)
                start, end, first = words(data, offsets)
                poly = Poly(Poly(BYTE_CODE[data]).span(start, end))
                owner = np.repeat(np.arange(len(counts)), counts)
                windows = (place & 31) + 1
                item, inside = ragged(np.where(opened, windows, 1))
                at = first[:-1][owner[item]] + (place[item] >> POS & POSITIONS) + inside
                each = np.where(opened, 1, windows)[item]
                content = np.where(opened[item], signed(poly.span(at, at + size)), whole[item])
                columns = [lead[item], content, signed(poly.span(at, at + size - 1)), signed(poly.span(at + each, at + each + size - 1)), each.astype(np.int32), ids[first_row + owner[item]], (place[item] >> POS << POS) + (inside << POS), copies[item], opened[item]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lead", "content", "source", "target", "windows", "id", "place", "copies", "open"])

    return joined.mapInArrow(frugal(run), "lead bigint, content bigint, source bigint, target bigint, windows int, id bigint, place bigint, copies bigint, open boolean")


def compacted_paths(pieces: DataFrame) -> DataFrame:
    """(lead, content, path_id, path_place, offset) of repeated pieces (with windows, source, target, id and place of the first occurrence).

    A path is named by where it first occurs; ``offset`` counts windows from its start.
    """
    ends = pieces.groupBy(F.col("target").alias("_node")).agg(F.count(F.lit(1)).alias("_in"), F.first("id").alias("_id_in"), F.first("place").alias("_place_in"), F.first("windows").alias("_windows_in")).where("_in = 1")
    starts = pieces.groupBy(F.col("source").alias("_start")).agg(F.count(F.lit(1)).alias("_out"), F.first("id").alias("_id_out"), F.first("place").alias("_place_out")).where("_out = 1")
    side_by_side = (F.col("_id_in") == F.col("_id_out")) & (version("_place_in") == version("_place_out")) & (position("_place_in") + F.col("_windows_in") == position("_place_out"))
    joints = ends.join(starts, (F.col("_node") == F.col("_start")) & side_by_side).select("_id_out", "_place_out")
    joined = pieces.join(joints, (F.col("id") == F.col("_id_out")) & (F.col("place") == F.col("_place_out")), "left").withColumn("_new", F.col("_id_out").isNull())
    text = Window.partitionBy("id", version("place")).orderBy("place")  # one text's pieces
    numbered = joined.withColumn("_head", F.last(F.when(F.col("_new"), F.col("place")), ignorenulls=True).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.select("lead", "content", "windows", "id", "place", F.col("id").alias("path_id"), F.col("_head").alias("path_place"), (position("place") - position("_head")).alias("offset"))


def repeated_passages(docs: DataFrame, size: int) -> DataFrame:
    """(id, version, spans array of (start, end) in words): all words of windows that also start earlier."""
    shared = cut(_repeated(docs, size), "shared")
    first = F.min(F.struct("id", "place"))
    distinct = shared.groupBy("lead", "whole").agg(F.count(F.lit(1)).alias("copies"), first.alias("_first")).select("lead", "whole", "copies", F.col("_first.id").alias("id"), F.col("_first.place").alias("place"))
    distinct = cut(distinct, "distinct")
    opened = distinct.groupBy(F.col("lead").alias("_lead")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_lead", F.lit(True).alias("_open"))
    wanted = distinct.join(opened, F.col("lead") == F.col("_lead"), "left").withColumn("open", F.coalesce("_open", F.lit(False))).where("open or copies > 1")
    pieces = cut(_pieces(docs, wanted.select("lead", "whole", "copies", "id", "place", "open"), size), "pieces")
    edges = pieces.where("open").groupBy("lead", "content").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("_forms"), F.min(F.struct("id", "place")).alias("_first"), *[F.first(c).alias(c) for c in ("source", "target", "windows")]
    ).where("copies > 1")
    edges = cut(edges.select("lead", "content", "source", "target", "windows", F.col("_first.id").alias("id"), F.col("_first.place").alias("place"), "_forms"), "edges")
    closed = pieces.where("not open and copies > 1").select("lead", "content", "source", "target", "windows", "id", "place")
    paths = cut(compacted_paths(closed.unionByName(edges.drop("_forms"))), "paths")

    # where each repeated piece first occurs, and its place on its path
    on_path = paths.select(F.col("lead").alias("_l"), F.col("content").alias("_w"), "path_id", "path_place", "offset")
    known = lambda df, content: df.select(F.col("lead").alias("_k"), F.col(content).alias("_c"), F.col("id").alias("_i"), F.col("place").alias("_p")).join(on_path, (F.col("_k") == F.col("_l")) & (F.col("_c") == F.col("_w")), "left").drop("_l", "_w")
    later = (F.col("id") > F.col("_i")) | ((F.col("id") == F.col("_i")) & (F.col("place") > F.col("_p")))
    # later occurrences of a super-edge: all its windows
    firsts = cut(known(distinct.where("copies > 1"), "whole"), "firsts")
    wholes = shared.join(firsts, (F.col("lead") == F.col("_k")) & (F.col("whole") == F.col("_c"))).where(later).withColumn("windows", F.col("place").bitwiseAND(F.lit(31)) + 1)
    # later occurrences of single edges, in the first occurrence of a super-edge
    singles = cut(known(edges.where("_forms > 1"), "content"), "firsts")
    again = pieces.where("open").join(singles, (F.col("lead") == F.col("_k")) & (F.col("content") == F.col("_c"))).where(later).withColumn("windows", F.col("windows").cast("bigint"))
    columns = ["id", "place", "windows", "path_id", "path_place", "offset"]
    placed = wholes.select(*columns).unionByName(again.select(*columns))
    start = position("place")
    placed = placed.select("id", version("place").alias("version"), start.alias("start"), (start + F.col("windows")).alias("end"), "path_id", "path_place", (start - F.coalesce("offset", F.lit(0))).alias("_shift"))
    occurrences = placed.groupBy("id", "version", "path_id", "path_place", "_shift").agg(F.min("start").alias("_s"), F.max("end").alias("_e"), F.collect_set(F.struct("start", "end")).alias("_parts"))  # a row that is there many times brings its parts as often
    occurrences = occurrences.withColumn("_sum", F.aggregate("_parts", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"]))
    spans = F.when(F.col("_sum") == F.col("_e") - F.col("_s"), F.array(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end")))).otherwise(F.col("_parts"))
    return occurrences.groupBy("id", "version").agg(F.flatten(F.collect_list(spans)).alias("spans"))


def remove_passages(df: DataFrame, size: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``df`` plus n_words, n_removed, ``removed`` (array of word spans, maximal, in order) and ``kept_text`` (kept words joined by a space)."""
    if not LEAD < size <= LEAD + 31:
        raise ValueError(f"size must be {LEAD + 1} to {LEAD + 31} words")
    mine = ("n_words", "n_removed", "removed", "kept_text")
    rest = [c for c in df.columns if c not in mine]
    other = [c for c in rest if c != text]
    names = [f"_c{i}" for i in range(len(other))]
    docs = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(other, names, strict=True)],
        F.col(f"`{text}`").isNull().alias("_null"),
        F.col(f"`{doc_id}`").cast("long").alias("_given"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_hash", F.xxhash64("_text"))
    below = F.lit(-(1 << 62) - 1) - F.col("_hash").bitwiseAND(F.lit((1 << 62) - 1))
    docs = numbered(docs.withColumn("_id", F.coalesce("_given", below)))
    spans = cut(repeated_passages(docs, size), "spans")
    tidy(df.sparkSession)  # the shuffles behind the spans go before the texts are shuffled
    joined = docs.join(spans, (F.col("_id") == F.col("id")) & (F.col("_version") == F.col("version")), "left").select(*names, "_null", "_text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, removed, kept = [], [], [], []
            for body, found in zip(batch.column(batch.num_columns - 2).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                tokens = body.split()
                spans: list[tuple[int, int]] = []
                for a, b in sorted((s["start"], s["end"] - 1 + size) for s in found or []):
                    if spans and a <= spans[-1][1]:
                        spans[-1] = spans[-1][0], max(b, spans[-1][1])
                    else:
                        spans.append((a, b))
                edges = [0, *[x for s in spans for x in s], len(tokens)]
                total.append(len(tokens))
                gone.append(sum(b - a for a, b in spans))
                removed.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in tokens[a:b]))
            columns = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*names, "_null", "_text", *mine])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in joined.dtypes[:-1]), "n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept_text string"])
    out = joined.mapInArrow(frugal(run), schema)
    given = {c: F.col(n).alias(c) for c, n in zip(other, names, strict=True)} | {text: F.when(~F.col("_null"), F.col("_text")).alias(text)}
    return out.select(*[given[c] for c in rest], *mine)
