"""Token counts by rank-synchronous array merging.

Whole texts are split into pre-tokens. The pre-tokens that a worker has not met yet are
held as ragged numpy arrays of byte symbols; in each round every sequence applies its
own lowest-rank pair, at all its places at once, and sequences without a mergeable pair
leave. The symbols that survive are the token count. No shuffle: one pass over the rows.

Null and empty texts have 0 tokens. Repeated rows and other columns don't matter; any
input row gives one output row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.bpe import NONE, Splitter, Vocabulary, chunks, flat_symbols
from graphmill.llm.textkit import frugal, text_slices

#: Pre-tokens that a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 300_000


def merge_places(hit: np.ndarray) -> np.ndarray:
    """Of neighbouring hits (which overlap) keep the 1st, 3rd, ... of each run, from the left."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    first = at[np.flatnonzero(new)]
    return at[(at - first[np.cumsum(new) - 1]) % 2 == 0] if len(at) else at


def merged_symbols(symbols: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols that survive, their lengths per sequence, order of the sequences): all merges, sequence by sequence in step."""
    who = np.arange(len(lengths))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        starts = np.cumsum(lengths) - lengths
        rank = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            rank[:-1] = vocabulary.pairs.ranks(symbols[:-1], symbols[1:])
        rank[starts + lengths - 1] = NONE  # the last symbol of a sequence has no right neighbour
        least = np.minimum.reduceat(rank, starts)
        live = least != NONE
        owner_live = np.repeat(live, lengths)
        if not live.all():
            done.append((symbols[~owner_live], lengths[~live], who[~live]))
            symbols, rank, who, lengths, least = symbols[owner_live], rank[owner_live], who[live], lengths[live], least[live]
            if not len(who):
                break
        at = merge_places(rank == np.repeat(least, lengths))  # runs can't cross sequences: the last symbol never hits
        symbols[at] = vocabulary.merged[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        owner = np.repeat(np.arange(len(who)), lengths)
        lengths = lengths - np.bincount(owner[at], minlength=len(who))
        symbols = symbols[keep]
    empty = np.zeros(0, np.int64)
    parts = list(zip(*done, strict=True)) if done else [[empty], [empty], [empty]]
    return np.concatenate(parts[0]), np.concatenate(parts[1]), np.concatenate(parts[2])


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.split = vocabulary, Splitter(vocabulary.special)
        self.known: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        texts = [p for p in pieces if p not in self.vocabulary.special]
        for run in chunks([p.encode() for p in texts], 1 << 20):
            symbols, lengths = flat_symbols(run, self.vocabulary)
            _, counts, who = merged_symbols(symbols, lengths, self.vocabulary)
            out = np.empty(len(run), np.int64)
            out[who] = counts
            self.known.update(zip([p.decode() for p in run], out.tolist(), strict=True))
        self.known.update((p, 1) for p in pieces if p in self.vocabulary.special)

    def count(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new: set[str] = set()
        for tokens in split:
            new.update(tokens)
        new.difference_update(self.known.keys())
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [sum(map(get, tokens)) for tokens in split]


def token_counts(df: DataFrame, vocabulary_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit) to the columns other than the text."""
    shipped = df.sparkSession.sparkContext.broadcast(Vocabulary.from_file(vocabulary_path))  # fixed size
    mine = ("n_bytes", "n_tokens", "over_limit")
    rest = [c for c in df.columns if c != text and c not in mine]
    names = [f"_{i}" for i in range(len(rest))]
    given = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shipped.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes, counts = [], []
            for first, last, _, offsets in text_slices(column, 8 << 20):
                sizes.append(np.diff(offsets))
                counts += counter.count([t or "" for t in column.slice(first, last - first).to_pylist()])
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(sizes) if sizes else n), pa.array(n), pa.array(n > limit)], names=[*names, *mine])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in given.dtypes[:-1]), "n_bytes bigint", "n_tokens bigint", "over_limit boolean"])
    return given.mapInArrow(frugal(run), schema).toDF(*rest, *mine)
