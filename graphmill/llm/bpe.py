"""Byte-level BPE vocabulary and pre-tokeniser shared by token counts and the codec.

Results equal those of the ``tokenizers`` library for a byte-level BPE ``.json``
(no normaliser, default split pattern): added special strings inside a text become
their one id, the rest is split by the pattern and merged per piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import regex

#: Fixed value: the split pattern of byte-level BPE (must equal the library's).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte value: visible Latin-1 stands for itself, other bytes for 256, 257, ... in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairTable:
    """Vectorised map (left id, right id) -> merge rank: a few levels of hash slots, each level holds the keys that collided above."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.levels: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        todo, bits = np.arange(len(self.keys)), 20
        while len(todo):
            factor, shift = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels) * 0x51ED27), np.uint64(64 - bits)
            slots = np.full(1 << bits, -1, np.int32)
            at = (self.keys[todo] * factor) >> shift
            slots[at[::-1]] = todo[::-1]
            self.levels.append((factor, shift, slots))
            todo = todo[slots[at] != todo]
            bits = max(12, bits - 3)
        self.padded = np.append(self.keys, np.uint64(2**64 - 1))  # -1: no such key

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair never merges."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(keys), NONE, np.int32)
        todo = None
        for factor, shift, slots in self.levels:
            k = keys if todo is None else keys[todo]
            found = slots[(k * factor) >> shift]
            hit = self.padded[found] == k
            if todo is None:
                out[hit] = found[hit]
                todo = np.flatnonzero(~hit & (found >= 0))
            else:
                out[todo[hit]] = found[hit]
                todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
        return out


@dataclass
class Vocabulary:
    """What the workers need of a tokenizer file; about 2 MB, whatever the corpus."""

    tokens: list[bytes]
    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray
    special: dict[str, int]
    _pairs: PairTable | None = field(default=None, repr=False)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        if model["type"] != "BPE" or kind != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: only byte-level BPE without normaliser or prefix space is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take white space or whole words only are not supported")
        ids = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (1 + max([*ids.values(), *added.values()]))
        for token, i in ids.items():
            tokens[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            tokens[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        column = lambda f: np.array([f(a, b) for a, b in merges], np.int32)
        return cls(
            tokens,
            np.array([ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int32),
            column(lambda a, b: ids[a]), column(lambda a, b: ids[b]), column(lambda a, b: ids[a + b]),
            added,
        )

    @property
    def pairs(self) -> PairTable:
        if self._pairs is None:
            self._pairs = PairTable(self.left, self.right)
        return self._pairs

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}


class Splitter:
    """Text -> pre-tokens; an added special string is its own piece."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split if special else None

    def __call__(self, text: str) -> list[str]:
        if self.cut and any(s in text for s in self.special):
            out: list[str] = []
            for i, part in enumerate(self.cut(text)):
                if i % 2:
                    out.append(part)
                elif part:
                    out += self.find(part)
            return out
        return self.find(text)


def flat_symbols(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Byte symbols of all pieces in one array, and the length of each piece."""
    return vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], np.fromiter(map(len, pieces), np.int64, len(pieces))


def chunks(pieces: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Runs of pieces with about ``size`` bytes."""
    run, have = [], 0
    for p in pieces:
        run.append(p)
        have += len(p)
        if have >= size:
            yield run
            run, have = [], 0
    if run:
        yield run
