"""MinHash near-duplicate components by a chosen-path set similarity join.

Each document is the set of its word shingles, summarised by SLOTS minwise tokens. In
every one of TREES independent trees a document walks a chosen path: at a node the path
so far picks a slot, and the document branches by its minwise token there, so that two
documents of likeness J stay together with probability J a level. A node that has become small (at
most NODE documents) is compared exhaustively; larger nodes branch on, up to LEVELS times. The
trees are walked twice:

1. To find the bulk of each cluster. Of a document's likely partners in a node only two are taken, the least id, so that the
   trees agree on the pairs, and the most alike; a cluster gives a few pairs a document and not all its pairs. Nodes still large after LEVELS are cut into
   blocks with a few common pivots. The pairs are confirmed on the full shingle sets and make first components.
2. With these components contracted. A node is small now if at most WIDE documents of it are outside its largest
   component; that component is cut into blocks, each of which meets all the others. Every likely pair
   between two components is confirmed on the full sets. Nodes still large after LEVELS branch on for DEEPER levels, some
   of them twice over, so that a pair at the threshold keeps its chance to share one. Members of
   nodes that are large even so go through an exact prefix-filter join on their full sets.

Likely pairs are told by 8 bits of each minwise token and by parity bits: BITS of them, each the parity of the shingles
hashed to it. The bits in which two sets differ are no more than the shingles in which they do, so this drops no link.

No link between two components is skipped by either walk; links within one are not needed. At likeness 0.8 a pair shares a
node of depth d in some tree with probability 1 - (1 - 0.8**d)**12: 0.99999 for d = 1 and 2, 0.9998 for 3.
Documents with equal sets are one representative from the start. Components are found by star rounds.

Null and empty texts have an empty set and are linked with nothing; texts with fewer
words than a shingle are one shingle. Null ids are linked with nothing. Rows of one id are one document: all its
texts have its links, and each row gets a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.components import connected_components
from graphmill.scratch import cut
from graphmill.llm.textkit import BYTE_CODE, LOWER, Poly, frugal, mix64, ragged, signed, text_slices, words

SLOTS, TREES, LEVELS, NODE = 128, 12, 3, 64
#: Documents outside the largest component of a node that is small in the second walk, and rows of a block of that component.
WIDE = 512
BITS = 512
#: Levels of the second walk below LEVELS, and how many nodes of a hundred branch by two slots there: at likeness 0.8 a
#: pair is expected in 0.8 * 1.35 = 1.08 children of a node that it shares.
DEEPER, TWICE = 3, 35
#: A candidate's estimate may be so much below the threshold (5.6 standard errors at 0.8).
SLACK = 0.2
#: A pair whose estimate is so much above the threshold is likely to be confirmed, and taken in the first walk.
MARGIN = 0.04
_rng = np.random.Generator(np.random.PCG64(8128))
FACTORS = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; number of them per text)."""
    start, end, first = words(data, offsets)
    codes = Poly(BYTE_CODE[LOWER[data]]).span(start, end)
    counts = np.diff(first)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row, inside = ragged(shingles)
    at = first[:-1][row] + inside
    hashes = Poly(codes).span(at, at + np.minimum(size, counts[row]))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(counts))


def set_codes(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, 0 of an empty one."""
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    a, b = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    if len(starts):
        mixed = mix64(hashes)
        a[some] = np.add.reduceat(mixed, starts)
        b[some] = np.bitwise_xor.reduceat(mixed * np.uint64(0xD6E8FEB86659FD93), starts)
    return a, b


def minwise(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SLOTS minwise tokens (32 bits) per non-empty set."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), SLOTS), np.uint32)
    for i in range(SLOTS if len(starts) else 0):
        out[:, i] = np.minimum.reduceat((hashes ^ OFFSETS[i]) * FACTORS[i], starts) >> np.uint64(32)
    return out


def parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BITS parity bits of each set, as bytes."""
    out = np.zeros((len(counts), BITS // 8), np.uint8)
    ends = np.cumsum(counts)
    bit = (mix64(hashes) & np.uint64(BITS - 1)).astype(np.int64)
    for first in range(0, len(counts), 4096):
        last = min(first + 4096, len(counts))
        a, b = ends[first] - counts[first], ends[last - 1]
        row = np.repeat(np.arange(last - first), counts[first:last])
        odd = np.bincount(row * BITS + bit[a:b], minlength=(last - first) * BITS) & 1
        out[first:last] = np.packbits(odd.reshape(-1, BITS).astype(bool), axis=1)
    return out


def chosen_paths(tokens: np.ndarray) -> np.ndarray:
    """Node keys (documents x TREES x LEVELS): each level's slot is picked by the node above."""
    out = np.empty((len(tokens), TREES, LEVELS), np.uint64)
    rows = np.arange(len(tokens))
    for tree in range(TREES):
        node = np.full(len(tokens), mix64(np.array([tree + 1], np.uint64))[0], np.uint64)
        for level in range(LEVELS):
            # the first slots differ between trees
            slot = np.full(len(tokens), tree * SLOTS // TREES) if level == 0 else (mix64(node) % np.uint64(SLOTS)).astype(np.int64)
            node = mix64(node ^ mix64(tokens[rows, slot].astype(np.uint64) + (slot.astype(np.uint64) << np.uint64(32))))
            out[:, tree, level] = node
    return out


def summaries(docs: DataFrame, size: int) -> DataFrame:
    """id, n, set_a and set_b (128 bits of the set), paths, sketch (one byte a slot, then the parity bits), for every row of (_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                hashes, counts = shingle_sets(data, offsets, size)
                some = counts > 0
                a, b = set_codes(hashes, counts)
                tokens = minwise(hashes, counts)
                paths = signed(chosen_paths(tokens).reshape(-1))
                ends = np.cumsum(some.astype(np.int64))
                sketch = np.concatenate([(tokens & np.uint32(0xFF)).astype(np.uint8), parities(hashes, counts)[some]], axis=1)
                sketches = pa.array([None if not s else sketch[e - 1].tobytes() for s, e in zip(some.tolist(), ends.tolist(), strict=True)], pa.binary())
                width = TREES * LEVELS
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends * width).astype(np.int32)), pa.array(paths))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(counts.astype(np.int64)), pa.array(signed(a)), pa.array(signed(b)), lists, sketches], names=["id", "n", "set_a", "set_b", "paths", "sketch"])

    return docs.mapInArrow(frugal(run), "id bigint, n bigint, set_a bigint, set_b bigint, paths array<bigint>, sketch binary")


def shared_nodes(reps: DataFrame) -> DataFrame:
    """(id, _k0, _k1, ..): the path of each document in each tree where it shares the first node with another, from (id, paths)."""
    levels = [F.element_at("paths", F.col("_tree") * LEVELS + i + 1).alias(f"_k{i}") for i in range(LEVELS)]
    rows = reps.select("id", "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("_tree")).select("id", *levels)
    several = cut(rows.groupBy(F.col("_k0").alias("_node")).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select("_node"), "nodes")
    return cut(rows.join(several, F.col("_k0") == F.col("_node"), "left_semi"), "rows")


def _members():
    """Tells nodes with other members apart; of nodes with the same ones one is enough."""
    return F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("_members")


def first_walk(rows: DataFrame) -> DataFrame:
    """(node, id) with at most NODE rows a node, or blocks of larger ones with common pivots."""
    found: list[DataFrame] = []
    for level in range(LEVELS):
        key = f"_k{level}"
        sizes = rows.groupBy(F.col(key).alias("_node")).agg(F.count(F.lit(1)).alias("_size"), _members(), F.min("id").alias("_least")).where("_size > 1")
        sizes = cut(sizes, "nodes")
        few = sizes.where(F.col("_size") <= NODE).groupBy("_members", "_size", "_least").agg(F.min("_node").alias("_node")).select("_node")
        found.append(rows.join(few, F.col(key) == F.col("_node")).select(F.col("_node").alias("node"), "id"))
        many = sizes.where(F.col("_size") > NODE)
        if not many.limit(1).count():
            return _all(found)
        if level < LEVELS - 1:
            rows = cut(rows.join(many.select("_node"), F.col(key) == F.col("_node"), "left_semi"), "rows")
    blocks = many.withColumn("_blocks", F.ceil(F.col("_size") / (NODE // 2)))
    large = rows.join(blocks, F.col(key) == F.col("_node")).select("_node", "_blocks", "id", F.xxhash64("_node", "id").alias("_draw"))
    found.append(large.select(F.xxhash64("_node", F.pmod("_draw", "_blocks")).alias("node"), "id"))
    pivots = large.groupBy("_node", "_blocks").agg(F.min(F.struct("_draw", "id")).alias("a"), F.max(F.struct("_draw", "id")).alias("b"), F.min("id").alias("c"))
    pivots = pivots.select("_node", "_blocks", F.explode(F.array_distinct(F.array("a.id", "b.id", "c"))).alias("id"))
    everywhere = pivots.select("_node", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    found.append(everywhere.select(F.xxhash64("_node", "_block").alias("node"), "id"))
    return _all(found).distinct()


def second_walk(rows: DataFrame, labels: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, id, component): nodes of several components with at most WIDE rows outside the largest, which is cut into blocks; the ids that are left in larger nodes, if any."""
    of = labels.select(F.col("node").alias("_n"), "component")
    rows = cut(rows.join(of, F.col("id") == F.col("_n"), "left").withColumn("component", F.coalesce("component", "id")).drop("_n"), "rows")
    found: list[DataFrame] = []
    for level in range(LEVELS + DEEPER):
        if level < LEVELS:
            rows = rows.withColumn("_node", F.col(f"_k{level}"))
        else:
            if level == LEVELS:
                rows = rows.select("id", "component", "_node").join(sketches, "id")
            slot = [F.pmod(F.xxhash64("_node", F.lit(i)), F.lit(SLOTS)).cast("int") for i in (0, 1)]
            slots = F.when(F.pmod(F.xxhash64("_node", F.lit(2)), F.lit(100)) < TWICE, F.array(*slot)).otherwise(F.array(slot[0]))
            child = F.xxhash64("_node", "_slot", F.expr("substring(sketch, _slot + 1, 1)"))
            rows = cut(rows.withColumn("_slot", F.explode(slots)).select("id", "component", "sketch", child.alias("_node")), "rows")
        each = rows.groupBy("_node", "component").agg(F.count(F.lit(1)).alias("_rows"), _members())
        sizes = each.groupBy("_node").agg(F.sum("_rows").alias("_size"), F.count(F.lit(1)).alias("_groups"), F.sum("_members").alias("_members"), F.max(F.struct("_rows", "component")).alias("_top")).where("_groups > 1")
        sizes = cut(sizes.select("_node", "_size", "_members", F.col("_top._rows").alias("_rows"), F.col("_top.component").alias("_top")), "nodes")
        outside = F.col("_size") - F.col("_rows")
        few = sizes.where(outside <= WIDE).groupBy("_members", "_size", "_rows", "_top").agg(F.min("_node").alias("_node"))
        few = few.select("_node", "_top", F.ceil(F.col("_rows") / WIDE).alias("_blocks"))
        some = rows.join(few, "_node")
        block = F.explode(F.when(F.col("component") == F.col("_top"), F.array(F.pmod(F.xxhash64("id"), "_blocks"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).alias("_block")
        found.append(some.select("_node", "id", "component", block).select(F.xxhash64("_node", "_block").alias("node"), "id", "component"))
        many = sizes.where(outside > WIDE).select("_node")
        if not many.limit(1).count():
            return _all(found), None
        rows = cut(rows.join(many, "_node", "left_semi"), "rows")
    return _all(found), rows.select("id").distinct()


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _compared(nodes: DataFrame, percent: int, bulk: bool) -> DataFrame:
    """(a, b) of likely pairs within nodes (node, id, n, sketch, component), a < b, not both of one component.

    ``bulk``: for each document only the least of the partners that will likely be confirmed and the most likely one, and (a, a) if it has any.
    """

    threshold = percent / 100

    def compare(node: np.ndarray, ids: np.ndarray, n: np.ndarray, component: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        sizes = np.diff(np.append(cuts, len(node)))
        owner, inside = ragged(sizes)
        later = sizes[owner] - inside - 1
        who, step = ragged(later)
        other = who + step + 1
        fits = (np.minimum(n[who], n[other]) >= threshold * np.maximum(n[who], n[other])) & (component[who] != component[other])
        who, other = who[fits], other[fits]
        bits = np.ascontiguousarray(sketch[:, SLOTS:]).view(np.uint64)
        close = np.zeros(len(who), bool)
        for i in range(0, len(who), 1 << 16):
            part = slice(i, i + (1 << 16))
            differ = np.bitwise_count(bits[who[part]] ^ bits[other[part]]).sum(axis=1, dtype=np.int64)
            close[part] = differ * (100 + percent) <= (n[who[part]] + n[other[part]]) * (100 - percent)
        who, other = who[close], other[close]
        tokens = np.ascontiguousarray(sketch[:, :SLOTS])
        estimate = np.empty(len(who))
        for i in range(0, len(who), 1 << 16):
            part = slice(i, i + (1 << 16))
            estimate[part] = (tokens[who[part]] == tokens[other[part]]).mean(axis=1)
        estimate = (estimate - 1 / 256) / (1 - 1 / 256)
        likely = estimate >= threshold - SLACK
        who, other, estimate = who[likely], other[likely], estimate[likely]
        if bulk:
            sure = estimate >= threshold + MARGIN
            # ids ascend within a node, so the first partner is the least
            second, least = np.unique(other[sure], return_index=True)
            either, mate = np.append(who, other), np.append(other, who)
            order = np.lexsort((mate, -np.append(estimate, estimate), either))
            marks, best = np.unique(either[order], return_index=True)
            who, other = np.concatenate([who[sure][least], marks, marks]), np.concatenate([second, mate[order][best], marks])
        return np.minimum(ids[who], ids[other]), np.maximum(ids[who], ids[other])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0] if len(batch) else None
            if table is None:
                continue
            node = table["node"].to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(node, node[-1], "left"))  # the last node may go on in the next batch
            held = table.slice(last)
            if last:
                yield from emit(table.slice(0, last))
        if held is not None and len(held):
            yield from emit(held)

    def emit(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last in _runs(table["node"].to_numpy(zero_copy_only=False)):
            part = table.slice(first, last - first)
            sketch = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint8).reshape(-1, SLOTS + BITS // 8)
            a, b = compare(*(part[c].to_numpy(zero_copy_only=False) for c in ("node", "id", "n", "component")), sketch)
            seen = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0].copy()), pa.array(seen[:, 1].copy())], names=["a", "b"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(parts, "node").sortWithinPartitions("node", "id").mapInArrow(frugal(run), "a bigint, b bigint").distinct()


def _runs(node: np.ndarray, rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Slices of about ``rows`` rows that hold whole nodes."""
    ends = np.append(np.flatnonzero(node[1:] != node[:-1]) + 1, len(node))
    first = 0
    while first < len(node):
        last = int(ends[min(np.searchsorted(ends, first + rows), len(ends) - 1)])
        yield first, last
        first = last


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, set_a, shingles) of every row of (_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                hashes, counts = shingle_sets(data, offsets, size)
                a, _ = set_codes(hashes, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(signed(hashes)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(signed(a)), lists], names=["id", "set_a", "shingles"])

    return docs.mapInArrow(frugal(run), "id bigint, set_a bigint, shingles array<bigint>")


def sets_of(wanted: DataFrame, reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, shingles), once for each id of ``wanted``; ``reps`` has the document and the set behind each id."""
    # a table, so that its size is known when the join is planned: a few ids go to the texts, many meet them in a shuffle
    of = cut(wanted.join(reps.select("id", F.col("doc").alias("_doc"), F.col("set_a").alias("_set")), "id"), "wanted")
    texts = docs.join(of.select(F.col("_doc").alias("_wanted")), F.col("_id") == F.col("_wanted"), "left_semi")
    sets = full_sets(texts.dropDuplicates(["_id", "_text"]), size).withColumnRenamed("id", "_id")
    return cut(sets.join(of, (F.col("_id") == F.col("_doc")) & (F.col("set_a") == F.col("_set"))).dropDuplicates(["id"]).select("id", "shingles"), "sets")


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b): every pair of ``sets`` with the likeness and unlike components, and some others.

    Shingles are ordered by their number of sets. Of a pair, the first common one is in the smaller set's short prefix
    and in the larger one's long prefix, and enough is left behind it in both. The shingles of one set alone and the
    odd bits of the others (256 of them, each the parity of the shingles hashed to it) are in the difference for certain,
    which drops pairs before they are made. At a shingle, sets of its most frequent component meet the sets of other
    components only.
    """
    n, total = F.col("n"), 100 + percent
    shingles = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = shingles.groupBy("token").agg(F.count(F.lit(1)).alias("_often")).where("_often > 1")
    # shingles of one set come first and meet nothing
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    parity = [F.bit_xor(F.when(F.expr(f"shiftrightunsigned(token, 6) & 3 = {k}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(4)]
    ordered = shingles.join(often, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("_often", "token"))).alias("_shared"), *parity)
    alone, bits = n - F.size("_shared"), [f"p{k}" for k in range(4)]
    long, short = (n - F.floor((percent * n + 99) / 100) + 1).cast("int"), (n - F.floor((2 * percent * n + total - 1) / total) + 1).cast("int")
    prefix = ordered.select("id", "n", *bits, alone.alias("alone"), F.posexplode(F.slice("_shared", F.lit(1), F.greatest(long - alone, F.lit(0)))))
    prefix = prefix.select("id", "n", *bits, "alone", F.col("col.token").alias("token"), (F.col("alone") + F.col("pos")).alias("at")).withColumn("short", F.col("at") < short)
    prefix = prefix.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    prefix = cut(prefix, "prefix")
    groups = prefix.groupBy("token", "component").agg(F.count(F.lit(1)).alias("_rows"), F.max("short").alias("_short")).groupBy("token").agg(F.max(F.struct("_rows", "component")).alias("_top"), F.count(F.lit(1)).alias("_groups"), F.max("_short").alias("_any"))
    rows = cut(prefix.join(groups.where("_groups > 1 and _any").select("token", F.col("_top.component").alias("_top")), "token").withColumn("top", F.col("component") == F.col("_top")), "rows")
    side = F.explode(F.when(F.col("top"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    carried = ["id", "n", *bits, "alone", "at", "component"]
    small = rows.where("short").select("token", side.alias("top"), *(F.col(c).alias(f"{c}_s") for c in carried))
    large = rows.select("token", "top", *(F.col(c).alias(f"{c}_l") for c in carried))
    both = small.join(large, ["token", "top"]).where("component_s <> component_l and (n_s < n_l or n_s = n_l and id_s < id_l)").where(100 * F.col("n_s") >= percent * F.col("n_l"))
    needed = total * (F.least("at_s", "at_l") + F.least(F.col("n_s") - F.col("at_s"), F.col("n_l") - F.col("at_l"))) >= percent * (F.col("n_s") + F.col("n_l"))
    differ = F.expr("alone_s + alone_l + " + " + ".join(f"bit_count({b}_s ^ {b}_l)" for b in bits))
    needed &= total * (F.col("n_s") + F.col("n_l") - differ) >= 2 * percent * (F.col("n_s") + F.col("n_l"))
    first = both.where(needed).groupBy("id_s", "id_l", "n_s", "n_l").agg(F.min("at_s").alias("at_s"), F.min("at_l").alias("at_l"))
    left = F.least(F.col("n_s") - F.col("at_s"), F.col("n_l") - F.col("at_l"))
    return first.where(total * left >= percent * (F.col("n_s") + F.col("n_l"))).select(F.least("id_s", "id_l").alias("a"), F.greatest("id_s", "id_l").alias("b"))


def confirmed_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs with 100 * intersection >= percent * union on the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) once the components that ``links`` (u, v) connect are one."""
    of = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    ends = links
    for end in ("u", "v"):
        ends = ends.join(of, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c")
    new = cut(connected_components(ends).select(F.col("node").alias("_n"), F.col("component").alias("_c")), "labels")
    old = labels.join(new, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    alone = new.join(labels, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_c").alias("component"))
    return cut(old.unionByName(alone), "labels")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 4, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable over links), kept (the id is the component's)."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    all_rows = cut(summaries(docs, words_each), "summaries").withColumnRenamed("id", "doc")
    sets = ["n", "set_a", "set_b"]
    named = all_rows.where("n > 0 and doc is not null")
    # a document with several texts has an id of 62 bits for each of its sets
    code = F.xxhash64(*sets)
    unlike = cut(named.groupBy(F.col("doc").alias("_doc")).agg(F.min(code).alias("_a"), F.max(code).alias("_b")).where("_a <> _b").select("_doc"), "unlike")
    several = unlike.limit(1).count() > 0
    rows = named.select("doc", *sets).join(unlike, F.col("doc") == F.col("_doc"), "left")
    made = F.xxhash64("doc", *sets).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = rows.withColumn("id", F.when(F.col("_doc").isNull(), F.col("doc")).otherwise(made))
    equal = cut(rows.groupBy(*sets).agg(F.min(F.struct("id", "doc")).alias("_rep"), F.min("doc").alias("least")).select(*sets, F.col("_rep.id").alias("rep"), F.col("_rep.doc").alias("_doc"), "least"), "equal")
    picked = equal.select(F.col("rep").alias("id"), "_doc", F.col("set_a").alias("_set")).hint("merge")
    reps = all_rows.where("n > 0").join(picked, (F.col("doc") == F.col("_doc")) & (F.col("set_a") == F.col("_set"))).select("id", "doc", *sets, "paths", "sketch")
    reps = cut(reps.dropDuplicates(["id"]), "reps")

    def pairs_in(nodes: DataFrame, bulk: bool) -> DataFrame:
        return cut(_compared(nodes.join(reps.select("id", "n", "sketch"), "id"), percent, bulk), "pairs")

    walks = shared_nodes(reps.select("id", "paths"))
    pairs = pairs_in(first_walk(walks).withColumn("component", F.col("id")), True)
    known = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), reps, docs, words_each)

    def fetch(wanted: DataFrame) -> None:
        nonlocal known
        missing = cut(wanted.distinct().join(known, "id", "left_anti"), "missing")
        if missing.limit(1).count():
            known = known.unionByName(sets_of(missing, reps, docs, words_each))

    def confirmed(pairs: DataFrame) -> DataFrame:
        fetch(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        return cut(confirmed_links(pairs, known, percent), "links")

    links = cut(confirmed_links(pairs.where("a <> b"), known, percent), "links")
    if several:
        same = rows.where("_doc is not null").join(equal.select(*sets, "rep"), sets).groupBy("doc").agg(F.collect_set("rep").alias("_reps"))
        links = links.unionByName(same.select(F.array_min("_reps").alias("u"), F.explode("_reps").alias("v")).where("u <> v"))
    labels = cut(connected_components(links), "labels")
    nodes, large = second_walk(walks, labels, reps.select("id", "sketch"))
    links = confirmed(pairs_in(nodes, False))
    if links.limit(1).count():
        labels = joined(labels, links)
    if large is not None:
        fetch(large)
        links = confirmed(cut(prefix_pairs(known.join(large, "id", "left_semi"), labels, percent), "prefix_pairs"))
        if links.limit(1).count():
            labels = joined(labels, links)
    by_rep = equal.join(labels, F.col("rep") == F.col("node"), "left").select(*sets, "least", F.coalesce("component", "rep").alias("component"))
    if several:  # the least id of a component may stand behind a made one
        by_rep = cut(by_rep, "components")
        by_rep = by_rep.drop("least").join(by_rep.groupBy(F.col("component").alias("_c")).agg(F.min("least").alias("_least")), F.col("component") == F.col("_c")).select(*sets, F.col("_least").alias("component"))
    on = [all_rows[c] == by_rep[c] for c in sets]
    out = all_rows.join(by_rep, on, "left").select(all_rows["doc"].alias("_id"), all_rows["n"].alias("_n"), F.when(all_rows["doc"].isNotNull(), F.coalesce("component", all_rows["doc"])).alias("_component"))
    return out.select(F.col("_id").alias(doc_id), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))
