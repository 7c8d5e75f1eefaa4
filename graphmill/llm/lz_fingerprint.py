"""Document fingerprints from Lempel-Ziv phrases.

Each text is parsed into LZ78 dictionary phrases (the shortest string not met before in
the text). The phrase set is hashed and its least hashes, in order, are the fingerprint;
two fingerprints give an estimate of the Jaccard likeness of the phrase sets, which
follows how well one text compresses given the other.

``neighbour_fingerprints`` also compares each document with an edited form of itself and
with the next document in descending id. Ids are cut into ranges; each range gets a copy
of the first row of the following one, so every pair of neighbours meets in one task and
the text is shuffled once. A hot id, and rows without one, are cut by the hash of the text. Null and empty texts have the fingerprint "" (likeness 1 to each other, 0
to others); null ids come last; rows with one id are ordered by a hash of the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.textkit import Poly, frugal

#: Hashes in a fingerprint; each takes 8 hex digits.
KEPT = 64


def lz_cuts(text: str, seen: set[str], start: int, done: int) -> list[int]:
    """Parse text[start:] after ``done`` characters are consumed; adds phrases to ``seen`` and returns their ends."""
    ends: list[int] = []
    add, note = seen.add, ends.append
    for end in range(done + 1, len(text) + 1):
        phrase = text[start:end]
        if phrase not in seen:
            add(phrase)
            note(end)
            start = end
    return ends


def least_hashes(text: str, ends: list[int]) -> np.ndarray:
    """The KEPT least of the distinct 32-bit phrase hashes, ascending; ``ends`` are the cuts of the phrases."""
    if not ends:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    cuts = np.array([0, *ends])
    hashes = (Poly(codes * np.uint64(0xD6E8FEB86659FD93)).span(cuts[:-1], cuts[1:]) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * KEPT:
        least = np.partition(hashes, 2 * KEPT)[: 2 * KEPT]
        found = np.unique(least)
        if len(found) >= KEPT:
            return found[:KEPT]
    return np.unique(hashes)[:KEPT]


def fingerprint(text: str) -> np.ndarray:
    return least_hashes(text, lz_cuts(text, set(), 0, 0))


def to_hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def from_hex(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bottom-k estimate of the Jaccard likeness of two phrase sets, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    least = sorted(x | y)[:KEPT]
    return sum(1 for h in least if h in x and h in y) / len(least)


def both_fingerprints(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of the text and of its edited form, and the edited text: its last third replaced by the start of ``following``.

    Up to the edit both parses are the same, so that part is parsed once.
    """
    third = len(text) // 3
    keep = len(text) - third
    seen: set[str] = set()
    shared = lz_cuts(text[:keep], seen, 0, 0)
    start = shared[-1] if shared else 0
    own = lz_cuts(text, seen, start, keep)
    cuts = [start, *own]
    seen.difference_update([text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    edited = text[:keep] + following[:third]
    other = lz_cuts(edited, seen, start, keep)
    return least_hashes(text, shared + own), least_hashes(edited, shared + other), edited


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to all columns; no shuffle."""
    rest = [c for c in df.columns if c != "fingerprint"]
    names = [f"_{i}" for i in range(len(rest))]
    given = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([to_hex(fingerprint(t or "")) for t in texts], pa.string())], names=[*names, "fingerprint"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in given.dtypes[:-1]), "fingerprint string"])
    return given.mapInArrow(frugal(run), schema).toDF(*rest, "fingerprint")


def _id_ranges(docs: DataFrame, count: int) -> tuple[DataFrame, int, dict[str, list[int]]]:
    """``docs`` with ``_range`` (0 holds the highest ids, the last ones rows without an id), the number of ranges, and for the first ``_key`` of each range the ranges that need its row.

    Rows of an id that fills more than one of ``count`` ranges, and rows without an id, are dealt to several by the hash of the text.
    """
    docs = docs.withColumn("_number", F.col("_id").cast("double"))
    total, known = docs.agg(F.count(F.lit(1)), F.count("_id")).first()
    quantiles = Counter(docs.approxQuantile("_number", [i / count for i in range(1, count)], 1 / (4 * count)) if count > 1 and known else [])
    hot = {x: n for x, n in quantiles.items() if n > 1 and abs(x) < 2**53}  # a double that is one id
    splits = sorted({*quantiles, *(x + 1 for x in hot)})
    parts = [hot.get(x, 0) + 1 for x in [None, *splits]][::-1] + [1 + (total - known) * count // max(1, total)]  # of each bucket of ids, the highest first, then of no id
    base = [sum(parts[:i]) for i in range(len(parts))]
    if splits:
        docs = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="_number", outputCol="_bucket", handleInvalid="keep").transform(docs)
    else:
        docs = docs.withColumn("_bucket", F.lit(0.0))
    group = F.when(F.col("_id").isNull(), len(parts) - 1).otherwise(len(parts) - 2 - F.col("_bucket").cast("int"))
    pick = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), group + 1)
    split = max(parts) > 1
    digest = F.xxhash64("_text") if split else F.lit(0).cast("long")
    part = F.least(F.floor((0.5 - digest / 2.0**64) * pick(parts)).cast("int"), pick(parts) - 1) if split else F.lit(0)
    order = F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("id"), digest.alias("digest"))
    key = F.concat_ws(":", *(F.coalesce(F.col(f"_order.{c}").cast("string"), F.lit("")) for c in ("known", "id", "digest")))
    ranged = docs.select("_id", "_text", (pick(base) + part).alias("_range"), order.alias("_order")).withColumn("_key", key)
    firsts = sorted((r["_range"], r["key"]) for r in ranged.groupBy("_range").agg(F.max_by("_key", "_order").alias("key")).collect())  # a row per range
    needed: dict[str, list[int]] = {}
    for (before, _), (_, first) in zip([firsts[-1:][0], *firsts[:-1]] if firsts else [], firsts, strict=True):
        needed.setdefault(first, []).append(before)
    return ranged, sum(parts), needed


def neighbour_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see the module text)."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    ranged, ranges, needed = _id_ranges(docs, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    own = F.array(F.struct(F.col("_range").alias("to"), F.lit(False).alias("tail")))
    if needed:
        copies = F.create_map(*[x for k, v in needed.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(b).alias("to"), F.lit(True).alias("tail")) for b in v]))])
        own = F.when(F.col("_key").isin(list(needed)), F.concat(own, F.element_at(copies, F.col("_key")))).otherwise(own)
    placed = (
        ranged.withColumn("_at", F.explode(own))
        .select("_id", "_text", F.col("_at.to").alias("_to"), F.col("_at.tail").alias("_tail"))
        .repartitionById(ranges, F.col("_to"))
        .sortWithinPartitions("_to", F.asc("_tail"), F.desc_nulls_last("_id"), F.desc(F.xxhash64("_text")))
    )
    schema = f"`{doc_id}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # (range, id, text) whose follower has not come yet, and what awaits the follower's fingerprint

        def flush() -> pa.RecordBatch:
            nonlocal out
            columns = list(zip(*out, strict=True))
            out = []
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        waiting = None
        for to, key, body, tail in ((a.as_py(), b.as_py(), c.as_py(), d.as_py()) for batch in batches for a, b, c, d in zip(batch["_to"], batch["_id"], batch["_text"], batch["_tail"], strict=True)):
            if held is not None and held[0] == to:
                mine, edited, changed = both_fingerprints(held[2], body)
                if waiting is not None:
                    out.append((*waiting[0], likeness(waiting[1], mine)))
                waiting = ((held[1], len(held[2]), sha256(changed.encode()).hexdigest(), to_hex(mine), to_hex(edited), likeness(mine, edited)), mine)
                if tail:  # the last pair of this range
                    out.append((*waiting[0], likeness(mine, fingerprint(body))))
                    held = waiting = None
                else:
                    held = (to, key, body)
            elif not tail:
                held = (to, key, body)
            if len(out) >= 2000:
                yield flush()
        if out:
            yield flush()

    return placed.select("_to", "_id", "_text", "_tail").mapInArrow(frugal(run), schema)
