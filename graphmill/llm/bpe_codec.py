"""BPE encoding and decoding by a pair occurrence index.

The new pre-tokens of a run of texts lie side by side in one symbol array with links to
the next and previous symbol. An index maps each mergeable pair (by its rank) to all its
positions in the array. Active ranks are applied in ascending order, each at all its
positions at once; the pairs that a merge makes go to the lists of their own ranks, all
higher than the current one. Decoding gathers the bytes of each id.

Null and empty texts have no ids and decode to the empty text. Any input row gives one
output row, an empty table an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.bpe import NONE, Splitter, Vocabulary, chunks, flat_symbols
from graphmill.llm.textkit import frugal, ragged, text_slices

#: Pre-tokens that a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 300_000


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in order, number of ids of each piece)."""
    symbols, lengths = flat_symbols(pieces, vocabulary)
    n = len(symbols)
    if not n:
        return symbols, lengths
    nxt = np.arange(1, n + 1)
    prev = np.arange(-1, n - 1)
    ends = np.cumsum(lengths)
    ends, begins = ends[lengths > 0], (ends - lengths)[lengths > 0]
    nxt[ends - 1], prev[begins] = n, -1  # n: none to the right
    nxt = np.append(nxt, n)
    symbols = np.append(symbols, np.int32(-1))
    live = np.ones(n + 1, bool)
    merged, table = vocabulary.merged, vocabulary.pairs
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def index(at: np.ndarray) -> None:
        """File positions by the rank of the pair that begins there."""
        at = at[nxt[at] < n]
        if not len(at):
            return
        ranks = table.ranks(symbols[at], symbols[nxt[at]])
        ok = ranks != NONE
        ranks, at = ranks[ok], at[ok]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = ranks[np.append(0, cuts)].tolist()
        for r, part in zip(firsts, np.split(at, cuts) if len(cuts) else [at], strict=True):
            if r in waiting:
                waiting[r].append(part)
            else:
                waiting[r] = [part]
                heapq.heappush(heap, r)

    index(np.arange(n))
    lefts, rights = vocabulary.left, vocabulary.right
    while heap:
        r = heapq.heappop(heap)
        lists = waiting.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = lefts[r], rights[r]
        at = at[live[at] & (symbols[at] == a)]
        at = at[symbols[nxt[at]] == b]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # overlapping places: from the left, every second one of a run
            new = np.ones(len(at), bool)
            new[1:] = nxt[at[:-1]] != at[1:]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)[group]
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        right = nxt[at]
        symbols[at] = merged[r]
        live[right] = False
        after = nxt[right]
        nxt[at] = after
        inner = after < n
        prev[after[inner]] = at[inner]
        before = prev[at]
        index(np.concatenate([at, before[before >= 0]]) if (before >= 0).any() else at)
    keep = live[:n]
    return symbols[:n][keep], np.add.reduceat(np.append(keep, False).astype(np.int64), np.append(0, np.cumsum(lengths)[:-1])) * (lengths > 0)


class Numbers(dict):
    """Pre-token -> its number, given out in order of first use."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.split = vocabulary, Splitter(vocabulary.special)
        self.sizes = np.fromiter(map(len, vocabulary.tokens), np.int64, len(vocabulary.tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        """The ids of pre-token i are ids[ends[i]:ends[i + 1]]."""
        self.numbers = Numbers()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Encodes the pre-tokens that were numbered since the last time."""
        special = self.vocabulary.special
        new = list(islice(self.numbers, len(self.ends) - 1, None))
        ids, counts = [self.ids], [np.diff(self.ends)]
        for run in chunks([p.encode() for p in new], 8 << 20):
            got, n = encode_pieces(run, self.vocabulary)
            ids.append(got)
            counts.append(n)
        self.ids, lengths = np.concatenate(ids), np.concatenate(counts)
        self.ends = np.append(0, np.cumsum(lengths))
        for piece in special:  # an added string is its one id, not its bytes
            i = self.numbers.get(piece)
            if i is not None and i >= len(self.ends) - 1 - len(new):
                before, after = self.ids[: self.ends[i]], self.ids[self.ends[i + 1] :]
                self.ids = np.concatenate([before, np.array([special[piece]], np.int32), after])
                lengths[i] = 1
                self.ends = np.append(0, np.cumsum(lengths))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        number = self.numbers.__getitem__
        coded = []  # numbers, as the pre-tokens themselves would take ten times the memory
        for t in texts:
            tokens = self.split(t)
            coded.append(np.fromiter(map(number, tokens), np.int32, len(tokens)))
        if len(self.numbers) > len(self.ends) - 1:
            self.learn()
        out = []
        for numbers in coded:
            start = self.ends[numbers]
            owner, inside = ragged(self.ends[numbers + 1] - start)
            out.append(self.ids[start[owner] + inside].astype("<u4").tobytes())
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for; broken sequences become U+FFFD."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        owner, inside = ragged(self.sizes[at])
        raw = self.bytes[self.starts[at][owner] + inside].tobytes()
        return raw.decode("utf-8", errors="replace").encode()


def bpe_round_trip(df: DataFrame, vocabulary_path: str, text: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encodes and decodes each text; adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` to the columns other than the text.

    ``keep_ids`` adds ``ids`` (array of int), ``keep_text`` adds ``decoded`` (string).
    """
    shipped = df.sparkSession.sparkContext.broadcast(Vocabulary.from_file(vocabulary_path))  # fixed size
    types = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if keep_ids else {}) | ({"decoded": "string"} if keep_text else {})
    rest = [c for c in df.columns if c != text and c not in types]
    names = [f"_{i}" for i in range(len(rest))]
    given = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shipped.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for first, last, _, _ in text_slices(column, 8 << 20):
                part = batch.slice(first, last - first)
                ids = codec.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                decoded = [codec.decode(x) for x in ids]
                out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256(x).hexdigest() for x in ids], pa.string()), pa.array([sha256(x).hexdigest() for x in decoded], pa.string())]
                if keep_ids:
                    lengths = np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), np.cumsum(lengths, dtype=np.int32))), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                if keep_text:
                    out.append(pa.array([x.decode() for x in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], names=[*names, *types])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in given.dtypes[:-1]), *(f"{n} {t}" for n, t in types.items())])
    return given.mapInArrow(frugal(run), schema).toDF(*rest, *types)
