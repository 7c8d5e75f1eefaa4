"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features of a text are its distinct lower-cased words and the first 4, 5 and 6 bytes of
longer words, as 64-bit hashes. P(grade <= k) = sigmoid(threshold_k - sum of the weights
of the text's features): one weight vector serves all ordered thresholds. The score is
the expected grade.

The fit uses a bounded sample of labelled rows (``sample``, by hash order of the id, at
most SAMPLE, and no more than fit into SAMPLE_BYTES) in one task; scoring is one pass over all whole texts without a shuffle. Binary labels are spread
over the grades 1..K-1 by how many features that lean positive a positive text has.
Null and empty texts have no features and get the base score. Rows with a null label are
not learned from. Without positive or negative labels every score is 0 or the top grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.scratch import cut
from graphmill.llm.textkit import BYTE_CODE, LOWER, Poly, give_back, text_slices

#: Labelled rows that a model is fitted on, at most; also the bound of what is broadcast for that.
SAMPLE = 10_000
#: Bytes of the texts that a model is fitted on, at most (a longer first text is taken alone).
SAMPLE_BYTES = 64 << 20
#: Expected severity from which a document counts as toxic.
REJECT = 0.3
#: Features that a model keeps, at most.
FEATURES = 4096
PREFIXES = (4, 5, 6)
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each feature, feature hash); features repeat as their words do."""
    n = len(data)
    letter = IS_WORD[data]
    first_byte = np.zeros(n + 1, bool)
    first_byte[offsets] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | first_byte[1:n]
    ends[:-1] &= ~letter[1:] | first_byte[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    poly = Poly(BYTE_CODE[LOWER[data]])
    rows, hashes = [row], [poly.span(start, end)]
    for size in PREFIXES:
        long = end - start > size
        rows.append(row[long])
        hashes.append(poly.span(start[long], start[long] + size) ^ np.uint64(0xA5A5A5A500000000 + size))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class OrdinalModel:
    """Fixed size: at most FEATURES weights."""

    features: np.ndarray  # ascending hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than the grades

    def __post_init__(self):
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.features >> np.uint64(44)).astype(np.int64)] = True

    def match(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature index) of the features that the model knows."""
        maybe = self.coarse[(hashes >> np.uint64(44)).astype(np.int64)]
        rows, hashes = rows[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = self.features[at] == hashes if len(self.features) else np.zeros(len(hashes), bool)
        pairs = np.unique(rows[hit] * len(self.features) + at[hit])
        return pairs // max(1, len(self.features)), pairs % max(1, len(self.features))

    def expected(self, eta: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over k of P(grade > k)."""
        with np.errstate(over="ignore"):
            return (1 / (1 + np.exp(self.thresholds[None, :] - eta[:, None]))).sum(axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, hashes = word_features(data, offsets)
        rows, at = self.match(rows, hashes)
        return self.expected(np.bincount(rows, self.weights[at], len(offsets) - 1) if len(at) else np.zeros(len(offsets) - 1))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, levels: int, l1: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by accelerated proximal gradient; the thresholds are a base plus positive gaps."""
    n = len(grades)
    share = np.clip(np.array([(grades <= k).mean() for k in range(levels - 1)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    w, theta = np.zeros(width), np.maximum.accumulate(start + np.arange(levels - 1) * 1e-3)
    vw, vt = w.copy(), theta.copy()
    lower, upper = grades - 1, grades
    norm = np.bincount(rows, minlength=n).astype(float)  # the square of a row's length: its number of features
    v = np.ones(width)
    for _ in range(12):  # the largest eigenvalue of X'X, by power iteration
        v = np.bincount(columns, np.bincount(rows, v[columns], n)[rows], width) if len(columns) else v
        top = max(1.0, float(np.linalg.norm(v)))
        v = v / top
    rate, momentum = 3.0 / (1 + max(top / n, norm.mean() / max(1, width)) if width else 1.0), 1.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(steps):
        eta = np.bincount(rows, vw[columns], n)
        up = np.where(upper < levels - 1, sigmoid(vt[np.minimum(upper, levels - 2)] - eta), 1.0)
        low = np.where(lower >= 0, sigmoid(vt[np.maximum(lower, 0)] - eta), 0.0)
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g_eta = d_up - d_low  # of -log p
        g_w = np.bincount(columns, g_eta[rows], width) / n
        g_t = np.array([(-(d_up[upper == k].sum()) + d_low[lower == k].sum()) / n for k in range(levels - 1)])
        new_w = vw - rate * g_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * l1, 0)
        new_t = np.maximum.accumulate(vt - rate * g_t + np.arange(levels - 1) * 1e-6)
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        vw, vt = new_w + (momentum - 1) / ahead * (new_w - w), new_t + (momentum - 1) / ahead * (new_t - theta)
        vt = np.maximum.accumulate(vt)
        if ((new_w - w) ** 2).sum() + ((new_t - theta) ** 2).sum() < 1e-14:
            break
        w, theta, momentum = new_w, new_t, ahead
    return w, theta


def _distinct_features(lowered: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature hash), each once a text, for slices of lower-cased texts."""
    for first, _, data, offsets in text_slices(lowered):
        r, h = word_features(data, offsets)
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        yield r[new] + first, h[new]


def learn(texts: pa.Array, labels: np.ndarray, levels: int, least: int = 4, z: float = 4.0, lift: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, thresholds) from texts with 0/1 labels, or grades 0..levels-1 where one is above 1.

    Features enter that ``least`` texts have, whose lean to one side is ``z`` standard
    errors, and that are ``lift`` times as common there: words that merely come with long texts stay out.
    """
    positive = labels > 0
    lowered = pc.utf8_lower(texts)
    features, df, in1 = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for row, hashes in _distinct_features(lowered):  # counts first, so that only features that enter are held by row
        features, at = np.unique(np.concatenate([features, hashes]), return_inverse=True)
        old, new = at[: len(df)], at[len(df) :]
        df = np.bincount(old, df, len(features)).astype(np.int64) + np.bincount(new, minlength=len(features))
        in1 = np.bincount(old, in1, len(features)).astype(np.int64) + np.bincount(new[positive[row]], minlength=len(features))
    n1 = max(1, int(positive.sum()))
    n0 = max(1, len(labels) - int(positive.sum()))
    p = df / len(labels)
    lean = (in1 / n1 - (df - in1) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    odds = ((in1 + 0.5) / (n1 + 1)) / ((df - in1 + 0.5) / (n0 + 1))
    chosen = np.flatnonzero((df >= least) & (np.abs(lean) >= z) & (np.abs(np.log(odds)) >= np.log(lift)))
    if len(chosen) > FEATURES:
        chosen = np.sort(chosen[np.argsort(-np.abs(lean[chosen]), kind="stable")[:FEATURES]])
    known = features[chosen]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for row, hashes in _distinct_features(lowered):
        at = np.searchsorted(known, hashes)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == hashes[hit]
        found.append((row[hit], at[hit]))
    rows, columns = (np.concatenate(x) for x in zip(*found, strict=True))
    grades = labels.astype(np.int64)
    if grades.max(initial=0) <= 1 and levels > 2:  # spread the positive ones by how much of it they have
        much = np.bincount(rows, lean[chosen][columns] > 0, len(labels))
        cuts = np.quantile(much[positive], np.arange(1, levels - 1) / (levels - 1)) if positive.any() else np.zeros(levels - 2)
        grades = np.where(positive, 1 + (much[:, None] > cuts[None, :]).sum(axis=1), 0)
    weights, thresholds = fit_ordinal(rows, columns, grades, len(chosen), levels)
    return features[chosen], weights, thresholds


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", levels: int = 3, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on at most ``sample`` (<= SAMPLE) labelled rows of at most SAMPLE_BYTES: those with the least hash of the id.

    Of unlike labels of an id the higher one counts; a repeated row is learned from once, unlike texts of one id are rows of their own.
    """
    bound = min(sample, SAMPLE)
    picked = (
        labels.select(F.col(f"`{doc_id}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("_label"))
        .where("_key is not null and _label is not null")
        .groupBy("_key").agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(bound)
    )
    texts = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text")).withColumn("_digest", F.xxhash64("_text"))
    place = [F.xxhash64("_id"), F.col("_id"), F.col("_digest")]
    found = texts.join(F.broadcast(picked), F.col("_id") == F.col("_key")).select("_id", "_digest", "_label", F.octet_length("_text").cast("long").alias("_size"))  # at most SAMPLE rows
    found = found.groupBy("_id", "_digest", "_label", "_size").agg(F.count(F.lit(1)).alias("_copies")).orderBy(*place).limit(bound)
    number = Window.orderBy(*place)  # of at most SAMPLE rows
    fitting = found.withColumn("_row", F.row_number().over(number)).withColumn("_total", F.sum("_size").over(number)).where((F.col("_total") <= SAMPLE_BYTES) | (F.col("_row") == 1))
    fitting = cut(fitting.select(F.col("_id").alias("_key"), F.col("_digest").alias("_hash"), "_label", "_copies"), "sample")
    rows = texts.join(F.broadcast(fitting), (F.col("_id") == F.col("_key")) & (F.col("_digest") == F.col("_hash")))  # at most SAMPLE rows
    if not fitting.where("_copies > 1").isEmpty():
        rows = rows.dropDuplicates(["_id", "_digest"])
    rows = rows.select(F.lit(0).alias("_one"), "_id", "_text", "_label")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_id", "ascending"), ("_label", "ascending")])
        features, weights, thresholds = learn(table["_text"].combine_chunks(), table["_label"].to_numpy().astype(np.int64), levels)
        used = weights != 0
        give_back()
        return pa.table({"kind": pa.array(["feature"] * int(used.sum()) + ["threshold"] * len(thresholds), pa.string()), "hash": pa.array(np.concatenate([features[used].view(np.int64), np.arange(len(thresholds))]), pa.int64()), "value": pa.array(np.concatenate([weights[used], thresholds]), pa.float64())})

    model = rows.groupBy("_one").applyInArrow(fit, "kind string, hash bigint, value double").toPandas()  # at most FEATURES rows and the thresholds
    features, thresholds = model[model.kind == "feature"], model[model.kind == "threshold"].sort_values("hash")
    hashes = features.hash.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return OrdinalModel(hashes[order], features.value.to_numpy(float)[order], thresholds.value.to_numpy(float) if len(thresholds) else np.full(levels - 1, np.inf))


def toxicity_scores(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """Adds ``severity`` (expected grade) and ``grade`` (the nearest one) to all columns of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights and a table of 1 MB

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            column = pa.Array.from_pandas(batch, type=pa.string())
            yield pd.Series(np.concatenate([np.zeros(0), *(shipped.value.score(data, offsets) for _, _, data, offsets in text_slices(pc.utf8_lower(column)))]))
        give_back()

    return docs.withColumn("severity", score(F.col(f"`{text}`").cast("string"))).withColumn("grade", F.round("severity").cast("int"))
