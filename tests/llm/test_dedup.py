"""Suffix-array, substring and near-duplicate removal against brute force."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import near_dedup, substring_dedup, suffix_dedup
from graphmill.llm.suffix_sort import BlindTrie, sort_suffixes


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def expected_suffix(rows, size):
    seen = Counter()
    for _, text, *_ in rows:
        body = (text or "").encode()
        seen.update(body[i : i + size] for i in range(len(body) - size + 1))
    out = []
    for doc_id, text, *_ in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - size + 1):
            if seen[body[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out.append((doc_id, len(body), sum(gone), sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size", [100, 400])
@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 4, 1])
def test_suffix_dedup_equals_brute_force(docs, monkeypatch, size, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 4: some anchors go in pieces, of which some are counted; 1: all do
    out = suffix_dedup.remove_repeats(docs, size)
    got = Counter((r.doc_id, len((r.text or "").encode()), sum(s.end - s.start for s in r.removed), sha256(bytes(r.kept_bytes)).hexdigest()) for r in out.collect())
    assert got == expected_suffix(rows_of(docs), size)
    assert out.columns == [*docs.columns, "removed", "kept_bytes", "kept_text"]


def test_suffix_dedup_takes_an_empty_table_and_clashing_columns(docs, empty_docs):
    assert suffix_dedup.remove_repeats(empty_docs, 100).count() == 0
    clash = docs.withColumn("id", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("removed", F.lit("x"))
    assert suffix_dedup.remove_repeats(clash, 100).count() == docs.count()


def test_suffix_dedup_counts_shorter_repeats_beside(docs):
    out = suffix_dedup.remove_repeats(docs, 400, shorter=100).collect()
    both = Counter((r.doc_id, len((r.text or "").encode()), sum(s.end - s.start for s in r.removed), sha256(bytes(r.kept_bytes)).hexdigest()) for r in out)
    assert both == expected_suffix(rows_of(docs), 400)
    assert Counter((r.doc_id, sum(s.end - s.start for s in r.repeated)) for r in out) == sum((Counter({(d, gone): n}) for (d, _, gone, _), n in expected_suffix(rows_of(docs), 100).items()), Counter())


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(5)
    body = np.concatenate([rng.integers(97, 99, 60), np.full(80, 97), rng.integers(97, 99, 60), np.full(80, 97)]).astype(np.uint8)
    start = np.arange(0, len(body) - 50)
    end = start + 50
    slots, lcp = sort_suffixes(body, start, end, np.zeros(len(start), int), 50)
    strings = [body[a:b].tobytes() for a, b in zip(start[slots], end[slots], strict=True)]
    assert strings == sorted(strings)
    for (a, b), n in zip(zip(strings[:-1], strings[1:], strict=True), lcp[1:], strict=True):
        same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert n == same


def test_blind_trie_orders_prefixes_and_equals():
    strings = [b"aab", b"aa", b"aab", b"ab", b"a\0", b"a"]
    order, shared = BlindTrie(strings, 4).ordered()
    assert [strings[i] for i in order] == sorted(strings)
    assert shared[1:] == [1, 1, 2, 3, 1]


def expected_passages(rows, size, spark=None):
    """Texts of one id, or of none, go by their hash; only sets of rows where that decides need ``spark``."""
    if spark is not None:
        texts = spark.createDataFrame([(t or "",) for _, t, *_ in rows], "t string").distinct().select("t", F.xxhash64("t").alias("h")).collect()
        code = {r.t: r.h for r in texts}
    else:
        code = {t or "": t or "" for _, t, *_ in rows}
    low = lambda t: -((code[t] if spark is not None else 0) & (2**62 - 1))
    docs = [(d, t) for *_, d, t in sorted({(d is not None, d or 0, code[t or ""] if d is not None or spark is None else low(t or ""), d, t or "") for d, t, *_ in rows}, key=lambda x: x[:3])]
    place = {x: i for i, x in enumerate(docs)}
    first = {}
    for order, (_, text) in enumerate(docs):
        words = text.encode().split()
        for i in range(len(words) - size + 1):
            first.setdefault(tuple(words[i : i + size]), (order, i))
    out = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        order = place[doc_id, text or ""]
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] != (order, i):
                gone[i : i + size] = [True] * size
        out.append((doc_id, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("size", [12, 20])
def test_substring_dedup_equals_brute_force(docs, size):
    out = substring_dedup.remove_passages(docs, size)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == expected_passages(rows_of(docs), size)


def test_substring_dedup_with_short_runs_and_an_empty_table(docs, empty_docs, monkeypatch):
    before = Counter((r.doc_id, r.kept_text) for r in substring_dedup.remove_passages(docs, 20).collect())
    monkeypatch.setattr(substring_dedup, "RUN", 5)
    assert Counter((r.doc_id, r.kept_text) for r in substring_dedup.remove_passages(docs, 20).collect()) == before
    assert substring_dedup.remove_passages(empty_docs, 20).count() == 0


def test_substring_dedup_tells_all_texts_without_an_id_apart(spark):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for k in range(3000):
        own = " ".join(f"w{x}" for x in rng.integers(0, 10**9, 12))
        rows.append((None if k % 2 else 7, f"{own} {passage}" if k % 3 == 0 else own))
    rows += [rows[0], rows[3]] * 20
    out = substring_dedup.remove_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 20)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect())
    assert got == expected_passages(rows, 20, spark)
    assert sum(n for (_, _, gone, _), n in got.items() if gone) >= 1000 - 1


def test_many_copies_of_a_row(spark):
    text = " ".join(f"w{i % 97}x{i % 31}" for i in range(250))
    rows = [(1, text)] * 4000 + [(None, text)] * 500 + [(2, "before " + text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()
    assert {(r.doc_id, sum(s.end - s.start for s in r.removed)) for r in suffix_dedup.remove_repeats(docs, 400).collect()} == {(1, len(text)), (None, len(text)), (2, len(text))}
    words = Counter((r.doc_id, r.n_removed) for r in substring_dedup.remove_passages(docs, 20).collect())
    assert words == {(None, 0): 500, (1, 250): 4000, (2, 250): 1}
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (None, None)}


def test_paths_compact_repeated_pieces(spark, texts):
    body = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, 0, body), (2, 1, "before " + body + " after")], "_id bigint, _version bigint, _text string")
    shared = substring_dedup._repeated(docs, 20)
    distinct = shared.groupBy("lead", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "place")).alias("f")).select("lead", "whole", "copies", "f.id", "f.place", F.lit(False).alias("open"))
    pieces = substring_dedup._pieces(docs, distinct.where("copies > 1"), 20)
    paths = substring_dedup.compacted_paths(pieces.drop("copies", "open"))
    assert paths.count() > 5
    assert paths.select("path_id", "path_place").distinct().count() == 1  # all inner pieces are one path


def shingles(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset([tuple(words)]) if 0 < len(words) < size else frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def expected_components(rows, size):
    sets = {d: shingles(t, size) for d, t, *_ in rows if d is not None}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return Counter((d, len(shingles(t, size)), root(d) if d is not None else None) for d, t, *_ in rows)


@pytest.mark.parametrize("node", [near_dedup.NODE, 2])
def test_near_duplicates_equal_brute_force(docs, monkeypatch, node):
    monkeypatch.setattr(near_dedup, "NODE", node)  # 2: trees branch to the end, and blocks with pivots and the prefix join are used
    monkeypatch.setattr(near_dedup, "WIDE", node)
    out = near_dedup.near_duplicates(docs, words_each=4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == expected_components(rows_of(docs), 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_pairs_in_a_large_family_are_found(spark):
    """1200 texts of one template, likeness about 0.7 to each other, among them 40 pairs at 0.8 and a little more."""
    rng = np.random.default_rng(3)
    template = [f"t{i}" for i in range(165)]
    rows = []
    for k in range(1160):
        rows.append((k, template + [f"d{k}x{i}" for i in range(35)]))
    for k in range(40):
        own = rows[29 * k][1]
        changed = own[:165] + own[165:182] + [f"e{k}x{i}" for i in range(18)]  # 18 of 197 shingles differ
        rows.append((5000 + k, changed))
    rows = [(i, " ".join(words)) for i, words in rows]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    sets = {i: shingles(text, 4) for i, text in rows}
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.65 < likeness(1, 2) < 0.75 and all(0.8 <= likeness(29 * k, 5000 + k) < 0.85 for k in range(40))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), words_each=4)
    found = {r.doc_id: r.component_id for r in out.collect()}
    assert {i: c for i, c in found.items() if i != c} == {5000 + k: 29 * k for k in range(40)}


def test_an_unlucky_sketch_is_a_candidate(spark):
    """A pair at 0.8 may agree in 84 of 128 slots only."""
    same = bytes(range(128))
    other = same[:84] + bytes(b + 128 for b in same[84:])
    parity = bytes(near_dedup.BITS // 8)
    nodes = spark.createDataFrame([(7, 1, 50, bytearray(same + parity), 1), (7, 2, 50, bytearray(other + parity), 2)], "node bigint, id bigint, n bigint, sketch binary, component bigint")
    assert rows_of(near_dedup._compared(nodes, 80, False)) == [(1, 2)]
    assert rows_of(near_dedup._compared(nodes.withColumn("component", F.lit(1)), 80, False)) == []


def test_all_texts_of_an_id_link(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a), (5, b), (5, b), (3, a + " end"), (9, b + " end"), (4, c), (8, d), (8, c + " end"), (2, d + " end"), (11, "alone")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words_each=4)
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(5, 3), (3, 3), (9, 3), (4, 2), (8, 2), (2, 2), (11, 11)}


def test_near_duplicates_of_nothing(empty_docs):
    assert near_dedup.near_duplicates(empty_docs).count() == 0
