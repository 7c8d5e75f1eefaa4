"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every n-gram of SEED words of a test item is counted over all documents in one pass. In each
stretch of STRETCH consecutive n-grams of an item the rarest is its seed, so that an item keeps
seeds however often it leaked. A second pass finds the seeds in all documents; seeds of one
item that agree on where the item begins vote for a window of the document, and each window that has
an item is aligned to it word by word (match +2, mismatch -1, gap -1). The score is the local alignment
score as a share of a perfect one, for all the item or, for items of over PASSAGE words, a passage of so many.

Items are a fixed test set: what is shipped to the workers is checked against ITEM_WORDS words and refused beyond.
Documents are scanned where they are, nothing of them is shuffled but the counts of the items' n-grams.
Null and empty texts and items match nothing; an item shorter than SEED words has one seed, all its words, and
matches only documents of just these words. Items without an id are left out. Repeated item ids keep their texts apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.textkit import BYTE_CODE, LOWER, Poly, frugal, ragged, text_slices, words

SEED, STRETCH = 3, 2
#: A leak scores so much or more.
LEAK = 0.4
#: Words of a long item that must be found for a full score.
PASSAGE = 100
#: Words of all items together, at most (about 100 MB in a worker).
ITEM_WORDS = 2_000_000
#: Pairs of a seed and an equal n-gram that are looked at together; items that share a common seed go through in blocks.
PAIRS = 1 << 20
MATCH, MISMATCH, GAP = 2, 1, 1
SPACE_OR_MARK = np.zeros(256, bool)
SPACE_OR_MARK[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def codes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text plus the total): ASCII letters lower-cased, without ASCII punctuation."""
    clean = np.where(SPACE_OR_MARK[data], np.uint8(32), LOWER[data])
    start, end, first = words(clean, offsets)
    return Poly(BYTE_CODE[clean]).span(start, end), first


def grams(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place within it, hash) of the n-grams of SEED words; a shorter text is one n-gram."""
    counts = np.diff(first)
    text, place = ragged(np.where(counts >= SEED, counts - SEED + 1, np.minimum(counts, 1)))
    at = first[:-1][text] + place
    return text, place, Poly(codes).span(at, at + np.minimum(SEED, counts[text]))


@dataclass
class Items:
    """The test items in one array of word hashes, and their seeds in ascending order of the hash."""

    ids: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    seed: np.ndarray
    seed_item: np.ndarray
    seed_place: np.ndarray


def load_items(benchmark: DataFrame, item_id: str, text: str) -> Items:
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null and id is not null")
    total = rows.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    if total > ITEM_WORDS:
        raise ValueError(f"the test items have {total} words; at most {ITEM_WORDS} are shipped, split them into sets")
    found = sorted((r.id, r.text) for r in rows.collect())  # checked above
    texts = [t.lower().encode() for _, t in found]
    codes, first = codes_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    return Items(np.array([i for i, _ in found], np.int64), codes, first, *(np.zeros(0, np.uint64),) * 3)


def _positions(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in x, index in the ascending table) of equal values, every pair."""
    low, high = np.searchsorted(table, x, "left"), np.searchsorted(table, x, "right")
    where, inside = ragged(high - low)
    return where, low[where] + inside


def _blocks(items: Items, hashes: np.ndarray) -> list[Items]:
    """The items in blocks, each with about PAIRS pairs of a seed and an equal n-gram at most; items without such a pair are in none."""
    edges = np.zeros(len(items.seed) + 1, np.int64)
    np.add.at(edges, np.searchsorted(items.seed, hashes, "left"), 1)
    np.add.at(edges, np.searchsorted(items.seed, hashes, "right"), -1)
    times = np.cumsum(edges)[:-1]
    total = int(times.sum())
    if total <= PAIRS:
        return [items] if total else []
    block = (np.cumsum(np.bincount(items.seed_item, times, len(items.ids))) // PAIRS).astype(np.int64)[items.seed_item]
    parts = (block == b for b in np.unique(block[times > 0]))
    return [replace(items, seed=items.seed[p], seed_item=items.seed_item[p], seed_place=items.seed_place[p]) for p in parts]


def count_in(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted n-gram occurs in all documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)  # bounded by ITEM_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(table >> np.uint64(44)).astype(np.int64)] = True
        counts = np.zeros(len(table) + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(pc.utf8_lower(batch.column(0))):
                hashes = grams(*codes_of(data, offsets))[2]
                hashes = hashes[maybe[(hashes >> np.uint64(44)).astype(np.int64)]]
                at = np.searchsorted(table, hashes)
                hit = table[np.minimum(at, len(table) - 1)] == hashes
                counts += np.bincount(at[hit], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["at", "n"])

    out = np.zeros(len(wanted), np.int64)
    if len(wanted):
        totals = docs.select("_text").mapInArrow(frugal(run), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # two numbers per n-gram of the items
        out[totals["at"].to_numpy()] = totals["n"].to_numpy()
    return out


def with_seeds(items: Items, docs: DataFrame) -> Items:
    """Picks the rarest n-gram of each stretch of each item, by the counts over all documents."""
    item, place, hashes = grams(items.codes, items.first)
    table = np.unique(hashes)
    rare = count_in(docs, table)[np.searchsorted(table, hashes)]
    stretch = place // STRETCH
    order = np.lexsort((place, rare, stretch, item))
    new = np.ones(len(order), bool)
    new[1:] = (item[order][1:] != item[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])
    picked = order[new]
    picked = picked[np.argsort(hashes[picked], kind="stable")]
    return Items(items.ids, items.codes, items.first, hashes[picked], item[picked], place[picked])


def align(query: np.ndarray, query_length: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, last target word of the best alignment) of each pair of padded rows (0 pads and matches nothing)."""
    pairs, width = target.shape
    ramp = np.arange(width + 1, dtype=np.int32) * GAP
    row = np.zeros((pairs, width + 1), np.int32)
    best, end = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64)
    for i in range(query.shape[1]):
        same = (target == query[:, i : i + 1]) & (query[:, i : i + 1] != 0)
        new = np.maximum(row - GAP, 0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + np.where(same, MATCH, -MISMATCH))
        new[:, 0] = 0
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps along the target
        new = np.where((i < query_length)[:, None], new, 0)
        top = new.max(axis=1)
        better = top > best
        if better.any():
            best = np.where(better, top, best)
            end = np.where(better, new.argmax(axis=1) - 1, end)
        row = new
    return best, end


def matches(items: Items, codes: np.ndarray, first: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, score, first word, last word) of the best alignment of each item in each text that shares seeds."""
    text, place, hashes = grams(codes, first)
    near = np.flatnonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)])
    text, place, hashes = text[near], place[near], hashes[near]
    none = np.zeros(0, np.int64)
    found = [(none, none, np.zeros(0), none, none), *(_aligned(block, text, place, hashes, codes, first) for block in _blocks(items, hashes))]
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _aligned(items: Items, text: np.ndarray, place: np.ndarray, hashes: np.ndarray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for one block of items and the n-grams (text, place, hash) that may be seeds."""
    none = np.zeros(0, np.int64)
    where, seed = _positions(items.seed, hashes)
    text, item = text[where], items.seed_item[seed]
    begin = place[where] - items.seed_place[seed]  # where the item would begin
    lengths = np.diff(items.first)
    order = np.lexsort((begin, item, text))
    text, item, begin, seed = text[order], item[order], begin[order], seed[order]
    # seeds whose beginnings lie within a quarter of the item of the one before belong together
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > np.maximum(2, lengths[item[1:]] // 8))
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    votes = np.bincount(np.unique(np.stack([group, seed], axis=1), axis=0)[:, 0], minlength=len(at))
    seeds_of = np.bincount(items.seed_item, minlength=len(items.ids))
    need = np.minimum(np.maximum(1, np.minimum(seeds_of, PASSAGE // STRETCH) // 6), 4)
    good = votes >= need[item[at]]
    low = begin[at][good]
    high = begin[np.append(at[1:], len(begin)) - 1][good]
    text, item = text[at][good], item[at][good]
    size = lengths[item]
    slack = np.maximum(4, size // 4)
    counts = np.diff(first)
    start = np.maximum(0, low - slack)
    stop = np.minimum(counts[text], high + size + slack)
    out: list[tuple[np.ndarray, ...]] = []
    order = np.argsort(size * 100_000 + (stop - start), kind="stable")
    cells = 0
    chunk: list[int] = []

    def flush() -> None:
        k = np.array(chunk)
        q = np.zeros((len(k), int(size[k].max())), np.uint64)
        t = np.zeros((len(k), int((stop - start)[k].max())), np.uint64)
        who, i = ragged(size[k])
        q[who, i] = items.codes[items.first[:-1][item[k]][who] + i]
        who, i = ragged((stop - start)[k])
        t[who, i] = codes[first[:-1][text[k]][who] + start[k][who] + i]
        best, end = align(q, size[k], t)
        full = MATCH * np.minimum(size[k], PASSAGE)
        last = start[k] + end
        out.append((text[k], item[k], np.minimum(1.0, best / full), np.maximum(start[k], last - size[k] + 1), last))

    for i in order.tolist():
        chunk.append(i)
        cells += int(stop[i] - start[i])
        if cells > 200_000:
            flush()
            chunk, cells = [], 0
    if chunk:
        flush()
    if not out:
        return none, none, np.zeros(0), none, none
    text, item, score, begin, last = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((begin, -score, item, text))
    text, item, score, begin, last = text[order], item[order], score[order], begin[order], last[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    return text[new], item[new], score[new], begin[new], last[new]


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", leak: float = LEAK) -> DataFrame:
    """Adds to all columns: ``leaks`` (array of item_id, score, first_word, last_word with score >= ``leak``, best first) and ``contaminated``."""
    rest = [c for c in df.columns if c not in ("leaks", "contaminated")]
    names = [f"_c{i}" for i in range(len(rest))]
    docs = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], F.col(f"`{text}`").cast("string").alias("_text"))
    shipped = df.sparkSession.sparkContext.broadcast(with_seeds(load_items(benchmark, item_id, item_text), docs))  # bounded by ITEM_WORDS
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(items.seed >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for first_row, last_row, data, offsets in text_slices(pc.utf8_lower(batch.column(batch.num_columns - 1))):
                part = batch.slice(first_row, last_row - first_row)
                row, item, score, begin, last = matches(items, *codes_of(data, offsets), maybe)
                found: list[list[dict]] = [[] for _ in range(last_row - first_row)]
                for r, i, s, a, b in zip(row.tolist(), items.ids[item].tolist(), score.round(6).tolist(), begin.tolist(), last.tolist(), strict=True):
                    if s >= leak:
                        found[r].append({"item_id": i, "score": s, "first_word": a, "last_word": b})
                for f in found:
                    f.sort(key=lambda x: (-x["score"], x["item_id"]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind)], names=[*names, "leaks"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes[:-1]), "leaks array<struct<item_id:bigint,score:double,first_word:bigint,last_word:bigint>>"])
    return docs.mapInArrow(frugal(run), schema).toDF(*rest, "leaks").withColumn("contaminated", F.size("leaks") > 0)
