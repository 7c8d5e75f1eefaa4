"""Language identification by rank-order profiles of character n-grams.

The n-grams of 1 to 3 characters of lower-cased letters (with a boundary mark around
words) are counted over all learning texts of a language; the most frequent make its
profile, in rank order. A text's own most frequent n-grams are compared to each profile
by the out-of-place distance: the sum of rank differences, and the profile length for
n-grams that the profile lacks. The least distance wins, ties go to the first name.

Counting is one pass with sums per worker before the shuffle; predicting is one pass
without a shuffle. Profiles are languages x PROFILE entries. A text that is null or has
no letter is ``und`` with score 0, as is any text when nothing could be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.textkit import frugal

#: n-grams in a profile, and at most in a text's own ranking.
PROFILE = 400
#: Characters are folded to so many bits (14 bits hold all alphabets; later scripts fold onto them).
BITS = 14
GRAM_BITS = 3 * BITS
#: Characters that are counted at a time; bounds the arrays of a worker.
RUN = 1 << 19


@cache
def letter_codes() -> np.ndarray:
    """Per code point: 1 for non-letters (the boundary), else 2 or more."""
    codes = np.ones(0x110000, np.uint64)
    letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
    codes[letters] = 2 + letters % ((1 << BITS) - 2)
    return codes


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram code) of all n-grams, each as often as it occurs; rows without a letter have none."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    codes = letter_codes()[np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(lowered), dtype=np.uint64), sizes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)  # one boundary between words
    keep[0] = codes[0] != 1
    codes, row = codes[keep], row[keep]
    if not len(codes):
        return row, codes
    b = np.empty(len(codes), np.uint64)  # the character before, the boundary at the start of a text
    b[0], b[1:] = 1, codes[:-1]
    c = np.empty(len(codes), np.uint64)
    c[:2], c[2:] = 1, b[1:-1] if len(codes) > 2 else codes[:0]
    c[:2] = 1
    bigram = (codes != 1) | (b != 1)
    trigram = b != 1
    s = np.uint64(BITS)
    two = b << s | codes
    three = c << (s + s) | two
    single = codes != 1
    return np.concatenate([row[single], row[bigram], row[trigram]]), np.concatenate([codes[single], two[bigram], three[trigram]])


def counted(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) in ascending order with counts."""
    keys = np.sort(rows << np.uint64(GRAM_BITS) | codes)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    keys = keys[at]
    return (keys >> np.uint64(GRAM_BITS)).astype(np.int64), keys & np.uint64((1 << GRAM_BITS) - 1), np.diff(np.append(at, len(new)))


def runs(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= RUN:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def language_profiles(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language -> its n-gram codes in rank order, learned from all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def table() -> pa.RecordBatch:
            who = pa.DictionaryArray.from_arrays(pa.array((keys >> np.uint64(GRAM_BITS)).astype(np.int32)), pa.array(list(names), pa.string())).dictionary_decode()
            return pa.RecordBatch.from_arrays([who, pa.array((keys & np.uint64((1 << GRAM_BITS) - 1)).view(np.int64)), pa.array(sums)], names=["lang", "gram", "n"])

        for batch in batches:
            which = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.uint64)
            for first, part in runs(batch.column(1).to_pylist()):
                rows, codes = grams(part)
                if not len(codes):
                    continue
                of, code, n = counted(which[first : first + len(part)][rows.astype(np.int64)], codes)
                both = np.concatenate([keys, of.astype(np.uint64) << np.uint64(GRAM_BITS) | code])
                keys, inverse = np.unique(both, return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([sums, n]), len(keys)).astype(np.int64)
                if len(keys) > 400_000:
                    yield table()
                    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(keys):
            yield table()

    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null")
    totals = rows.mapInArrow(frugal(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = totals.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= PROFILE)
    found = best.select("lang", "gram", "place").toPandas()  # languages x PROFILE rows
    return {name: part.sort_values("place").gram.to_numpy(np.int64).astype(np.uint64) for name, part in sorted(found.groupby("lang"))}


class Ranker:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = list(profiles)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)  # the last row: codes in no profile
        for i, profile in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.codes, profile), i] = np.arange(len(profile))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        rows, codes = grams(texts)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if len(codes) and self.names:
            row, code, n = counted(rows, codes)
            order = np.argsort((row << 32) - n, kind="stable")  # ties by code
            row, code = row[order], code[order]
            sizes = np.bincount(row, minlength=len(texts))
            place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
            top = place < PROFILE
            row, code, place = row[top], code[top], place[top]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            at = np.where(self.codes[at] == code, at, len(self.codes))
            ranks = self.ranks[at]
            away = np.where(ranks < 0, PROFILE, np.abs(ranks - place[:, None]))
            sizes = np.bincount(row, minlength=len(texts))
            distance = np.stack([np.bincount(row, away[:, i], len(texts)) for i in range(len(self.names))], axis=1)
            some = sizes > 0
            best[some] = distance[some].argmin(axis=1)
            score[some] = 1 - distance[some].min(axis=1) / (sizes[some] * PROFILE)
        return [self.names[i] if i >= 0 else "und" for i in best.tolist()], np.clip(score, 0.0, 1.0)


def identify_languages(df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (1 less the distance as a share of the largest one) to all columns."""
    shipped = df.sparkSession.sparkContext.broadcast(profiles)  # languages x PROFILE entries

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(shipped.value)
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for _, part in runs([t if isinstance(t, str) else None for t in batch]):
                found, score = ranker.predict(part)
                names += found
                scores.append(score)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})

    mine = ("lang_pred", "score", "_said")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in mine]
    return df.select(*rest, predict(F.col(f"`{text}`").cast("string")).alias("_said")).select(*rest, "_said.lang_pred", "_said.score")
