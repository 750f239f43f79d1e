"""Quality selection by importance resampling.

Two bag-of-n-grams models with hashed features are estimated: of target text (documents labelled as good) and of raw text
(all documents). A document's log importance weight is the sum over its n-grams of log p_target - log p_raw. Adding Gumbel noise and keeping
the k largest draws k documents without replacement in proportion to their weights. The noise comes from a hash
of doc_id, so reruns agree.

The n-grams are one and two tokens (runs of letters and digits, or of other signs), and three token shapes: case,
digits or signs, length, and whether the token repeats the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.text import IS_SPACE, U64, WORD_A, blocks, mix, tidied
from strandmill.storage import materialize

FEATURES = 1 << 16
#: Bound of what the target model is fitted on: labelled documents with the smallest hash of their id.
LABELLED = 50_000
SMOOTHING = 1.0
_DIGIT_BITS, _LEVELS = 16, 4

_CLASS = np.full(256, 2, np.uint8)  # signs
_CLASS[IS_SPACE] = 0
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _CLASS[_low : _high + 1] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all n-grams of a block."""
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    kind = _CLASS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (row_of[1:] != row_of[:-1])
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    real = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[real], end[real]
    row = row_of[start]
    h = WORD_A.slices(WORD_A.prefix(WORD_A.table[data]), start, end)
    first = data[start]
    second = data[np.minimum(start + 1, end - 1)]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape = kind[start].astype(U64) + U64(4) * _UPPER[first] + U64(8) * _UPPER[second] + U64(16) * ((first >= 48) & (first <= 57)) + U64(32) * same
    shape += U64(64) * np.minimum((end - start).astype(U64), U64(12))
    two = row[1:] == row[:-1]
    three = two[1:] & two[:-1]
    grams = [h, mix(h[:-1] * U64(3) + h[1:])[two], mix((shape[:-2] << U64(40) | shape[1:-1] << U64(20) | shape[2:]) + U64(77))[three]]
    return np.concatenate([row, row[1:][two], row[2:][three]]), (np.concatenate(grams) % U64(FEATURES)).astype(np.int64)


@dataclass
class Ratio:
    """Log p_target - log p_raw by feature."""

    table: np.ndarray

    def weights(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b, data, offsets in blocks(texts):
            row, feature = features(data, offsets)
            out[a:b] = np.bincount(row, self.table[feature], b - a)
        return out


@tidied
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each feature and task: how often all texts, and good texts, have it."""
    raw, target = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        for a, b, data, offsets in blocks(batch.column("text")):
            row, feature = features(data, offsets)
            raw += np.bincount(feature, minlength=FEATURES)
            target += np.bincount(feature[good[a:b][row]], minlength=FEATURES)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(raw[some]), pa.array(target[some])], ["feature", "raw", "target"])


def fit(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[Ratio, float]:
    """The models' ratio, and the share of good documents among those labelled.

    Raw counts cover all documents. Without a good labelled document all weights are 0, and the share is 1.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    # bounded by ``labelled`` rows
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labels", 1)
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rows = rows.join(F.broadcast(known), "doc_id", "left").select("text", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"))
    counts = rows.mapInArrow(_count, "feature long, raw long, target long").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(FEATURES), np.zeros(FEATURES)
    for r in counts.collect():  # at most FEATURES rows
        raw[r["feature"]], target[r["feature"]] = r["raw"], r["target"]
    if not target.any():
        return Ratio(np.zeros(FEATURES)), 1.0 if share is None else float(share)
    log = lambda x: np.log(x + SMOOTHING) - np.log(x.sum() + SMOOTHING * FEATURES)
    return Ratio(log(target) - log(raw)), float(share)


def sortable(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the floats."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(-(1 << 63)), bits)


@tidied
def _score(batches: Iterator[pa.RecordBatch], ratio: Ratio) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weight = ratio.weights(batch.column("text"))
        u = (mix(batch.column("noise").to_numpy().astype(U64)) >> U64(11)).astype(float)
        score = weight - np.log(-np.log((u + 0.5) * 2.0**-53))
        names = [n for n in batch.schema.names if n not in ("text", "noise")]
        out = [batch.column(n) for n in names] + [pa.array(weight), pa.array(score), pa.array(sortable(score))]
        yield pa.RecordBatch.from_arrays(out, [*names, "log_weight", "score", "key"])


def kth_largest(rows: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest key by nested histograms of its bits; None if there are fewer. No sort, at most 65536 bins at a time."""
    prefix, left, shift = None, k, 64
    for _ in range(_LEVELS):
        some = rows if prefix is None else rows.where(F.shiftright(key, shift) == prefix)
        shift -= _DIGIT_BITS
        bins = some.groupBy(F.shiftright(key, shift).alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if b["n"] >= left:
                prefix = b["bin"]
                break
            left -= b["n"]
        else:
            return None
    return prefix


def resample(documents: DataFrame, ratio: Ratio, share: float) -> DataFrame:
    """One row per row: doc_id, log_weight, score (with Gumbel noise), keep.

    ``share`` of the rows are kept, those with the largest scores; rows that tie with the last one are kept too. A null or empty
    text has weight 0. Rows that repeat a doc_id share their noise; rows without one share another. A very long text is
    scored in a block of its own, so memory is bounded by the longest. An empty table gives an empty one. Other columns
    are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", F.lit("gumbel")).alias("noise"))
    scored = materialize(rows.mapInArrow(lambda it: _score(it, ratio), "doc_id long, log_weight double, score double, key long"), "scores")
    n = scored.count()
    k = int(round(share * n))
    least = kth_largest(scored, "key", k) if k else None
    keep = F.lit(k > 0) if least is None else F.col("key") >= least
    return scored.select("doc_id", "log_weight", "score", keep.alias("keep"))


def select_quality(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, share: float | None = None) -> DataFrame:
    """Fits and resamples; by default as large a share is kept as is good among the labelled documents."""
    ratio, good = fit(documents, labels, labelled)
    return resample(documents, ratio, good if share is None else share)
