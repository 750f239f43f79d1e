"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to several random subspaces of ten dimensions; in each, a randomly shifted grid gives them
keys along the Hilbert curve. Every ordering is range-partitioned and sorted by Spark, which gives each vector a rank. A query's candidates
are the vectors within a window of ranks around its own, in any ordering; they merge, and exact Euclidean distances
rerank them.

How wide the window must be depends on the data: vectors without low-dimensional structure need a window that is a
share of all rows. So it is calibrated: a bounded sample of queries is searched by brute force, in blocks over
all rows, and the window is the one that would have held the wished-for share of their true neighbours.

Equal vectors are one point of the orderings with the smallest ids of its rows, so a vector that a third of all
rows share makes no window useless and no task large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.hilbert import hilbert_keys
from strandmill.storage import materialize

K, ORDERINGS, DIMENSIONS, BITS = 10, 16, 10, 6
#: Rows that fit the grids, queries that calibrate the window, and the share of their neighbours it must hold.
SAMPLE, CALIBRATION, WISHED = 5000, 64, 0.96
LEAST_WINDOW, BLOCK = 128, 2048


@dataclass
class Grids:
    """Per ordering: projection (d x DIMENSIONS), and the low corner and width of the shifted grid."""

    projections: np.ndarray
    low: np.ndarray
    width: np.ndarray

    def keys(self, x: np.ndarray) -> np.ndarray:
        """n x orderings."""
        side = 1 << BITS
        out = []
        for p, low, width in zip(self.projections, self.low, self.width, strict=True):
            out.append(hilbert_keys(np.clip((x @ p - low) / width * side, 0, side - 1), BITS))
        return np.stack(out, 1)


def fit_grids(sample: np.ndarray, orderings: int = ORDERINGS, seed: int = 29) -> Grids:
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    projections = np.stack([np.linalg.qr(rng.normal(size=(d, min(d, DIMENSIONS))))[0] for _ in range(orderings)])
    at = np.einsum("nd,odk->onk", sample, projections)
    low, high = at.min(1), at.max(1)
    span = np.maximum(high - low, 1e-12)
    return Grids(projections, low - rng.uniform(0, 0.25, low.shape) * span, 1.25 * span)


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column without nulls, of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def points(vectors: DataFrame, id_column: str, vector_column: str, k: int) -> tuple[DataFrame, int]:
    """(rep, vector, ids): distinct usable vectors, the smallest id of each and its k + 1 smallest ids.

    Null or zero vectors, those with null or non-finite components, and those of another length than most are left
    out; so are rows without an id. Ids are first cut to k + 1 within each part of a vector's rows.
    """
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("id is not null and vector is not null").where(~bad & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    rows = rows.where(F.size("vector") == d).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 equals 0.0
    few = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    parts = rows.mapInArrow(lambda it: _cut_ids(it, k + 1), "vector array<double>, ids array<long>")
    salted = parts.withColumn("salt", F.spark_partition_id() % 64).groupBy("vector", "salt").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    out = salted.groupBy("vector").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("rep"), "vector", "ids")
    return materialize(out, "points"), d


def _cut_ids(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (vector, its n smallest ids), each vector once in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, ids = vectors_of(batch.column("vector")), batch.column("id").to_numpy()
        _, first, owner = np.unique(x, axis=0, return_index=True, return_inverse=True)
        order = np.lexsort((ids, owner.ravel()))
        owner = owner.ravel()[order]
        place = np.arange(len(order)) - np.searchsorted(owner, owner)
        keep = place < n
        counts = np.bincount(owner[keep], minlength=len(first))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids[order][keep], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("vector").take(pa.array(first)), lists], ["vector", "ids"])


def differences(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to each query, from plain differences; a few million numbers at a time."""
    out = np.empty((len(queries), len(x)))
    step = max(1, (1 << 22) // max(1, x.size))
    for at in range(0, len(queries), step):
        out[at : at + step] = np.sqrt(((x[None] - queries[at : at + step, None]) ** 2).sum(2))
    return out


def _first(distance: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of each row, ties to the first."""
    return np.argsort(distance, 1, kind="stable")[:, :k]


def nearest(queries: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, distances) of the k rows of x nearest to each query, ties to the first. Norms and products of the
    centred block sift: a row stays unless rounding can't explain that it is farther than the k-th. Differences decide."""
    k = min(k, len(x))
    centre = x.mean(0)
    y, q = x - centre, queries - centre
    norms, own = (y * y).sum(1), (q * q).sum(1)
    rough = norms - 2 * q @ y.T + own[:, None]
    with np.errstate(invalid="ignore", over="ignore"):
        # of the sums above, and of what centring took from the vectors; norms bound both
        slack = 64 * np.finfo(float).eps * (x.shape[1] + 4) * (norms.max() + own + (np.abs(centre) ** 2).sum())
    kth = np.partition(rough, k - 1, 1)[:, k - 1]
    index, distance = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
    stays = ~(rough > (kth + 2 * slack)[:, None])  # what isn't finite stays
    for i in range(len(queries)):
        some = np.flatnonzero(stays[i])
        exact = differences(queries[i : i + 1], x[some])
        order = _first(exact, k)[0]
        index[i], distance[i] = some[order], exact[0, order]
    return index, distance


_FOUND = "query long, rep long, distance double"


def _brute(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            distance = differences(queries, vectors_of(batch.column("vector")))
            at = _first(distance, k + 1)
            distance = np.take_along_axis(distance, at, 1)
            rep = batch.column("rep").to_numpy()[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, at.shape[1])), pa.array(rep.ravel()), pa.array(distance.ravel())], ["query", "rep", "distance"])


def brute_force(points_: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k nearest other points of a bounded number of queries, against all points in blocks."""
    best = Window.partitionBy("query").orderBy("distance", "rep")
    found = points_.select("rep", "vector").mapInArrow(lambda it: _brute(it, ids, queries, k), _FOUND).where("query <> rep")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def ranks(points_: DataFrame, grids: Grids) -> DataFrame:
    """(ordering, rep, rank) from sorted ranges; rank counts from 0 within an ordering."""
    spark = points_.sparkSession
    orderings = len(grids.projections)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = grids.keys(vectors_of(batch.column("vector"))) if batch.num_rows else np.zeros((0, orderings), np.int64)
            ordering = np.tile(np.arange(orderings, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(ordering), pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), orderings))], ["ordering", "key", "rep"])

    rows = points_.select("rep", "vector").mapInArrow(keyed, "ordering int, key long, rep long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "ordering", "key", "rep").sortWithinPartitions("ordering", "key", "rep")
    place = F.monotonically_increasing_id()
    rows = materialize(rows.withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    # a row for each ordering and range
    starts = rows.groupBy("ordering", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(starts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "starts", 1)
    return rows.join(starts, ["ordering", "part"]).select("ordering", "rep", (F.col("place") - F.col("first") + F.col("before")).alias("rank"))


def calibrate(points_: DataFrame, ranked: DataFrame, queries: DataFrame, k: int, wished: float) -> int:
    """The window that holds ``wished`` of the true neighbours of a bounded sample of queries."""
    some = points_.join(queries, "rep", "left_semi").orderBy(F.xxhash64("rep"), "rep").select("rep", "vector").limit(CALIBRATION).collect()
    if not some:
        return LEAST_WINDOW
    truth = brute_force(points_, np.array([r["rep"] for r in some]), np.array([r["vector"] for r in some]), k)
    truth = materialize(truth, "truth", 1)
    own = ranked.select("ordering", F.col("rep").alias("query"), F.col("rank").alias("at"))
    apart = truth.join(own, "query").join(ranked, ["ordering", "rep"]).groupBy("query", "rep").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("apart"))
    need = apart.agg(F.percentile("apart", wished)).first()[0]
    return max(LEAST_WINDOW, int(need or 0) + 1)


def search(vectors: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, orderings: int = ORDERINGS, wished: float = WISHED, window: int | None = None) -> DataFrame:
    """query_id, rank (from 1), the found id and score of the ``k`` nearest other rows of each query row.

    Score is the Euclidean distance of the vectors as doubles; ties go to the smaller id. Without usable vectors the
    result is empty. Rows that repeat an id count once if their vectors are equal; otherwise each is a candidate. ``is_query`` is a condition on
    the id. Other columns are not read. ``window`` overrides the calibrated one.
    """
    spark = vectors.sparkSession
    pts, d = points(vectors, id_column, vector_column, k)
    asked = vectors.select(F.col(id_column).cast("long").alias("query_id"), F.col(vector_column).cast("array<double>").alias("vector")).where(is_query(F.col("query_id")))
    asked = asked.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    asked = materialize(asked.join(pts.select("rep", "vector"), "vector").select("query_id", "rep").distinct(), "asked")
    reps = asked.select("rep").distinct()
    sample = np.array([r["vector"] for r in pts.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").collect()]).reshape(-1, max(d, 1))
    if not len(sample):
        return spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score double")
    ranked = ranks(pts, fit_grids(sample, orderings))
    ranked = materialize(ranked, "ranks")
    window = window or calibrate(pts, ranked, reps, k, wished)
    block = min(window, BLOCK)
    located = ranked.join(pts.select("rep", "vector"), "rep")
    rows = located.select("ordering", F.floor(F.col("rank") / block).alias("block"), F.lit(False).alias("asks"), "rep", "vector")
    q = located.join(reps, "rep", "left_semi")
    blocks = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / block), F.floor((F.col("rank") + window) / block))
    q = q.select("ordering", F.explode(blocks).alias("block"), F.lit(True).alias("asks"), "rep", "vector")

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"query": [], "rep": [], "distance": []})
        x, ids = np.stack(pdf.loc[~asks, "vector"]), pdf.loc[~asks, "rep"].to_numpy()
        order = np.argsort(ids)
        x, ids = x[order], ids[order]
        y, who = np.stack(pdf.loc[asks, "vector"]), pdf.loc[asks, "rep"].to_numpy()
        out = []
        for at in range(0, len(y), 256):
            i, distance = nearest(y[at : at + 256], x, k + 1)
            out.append(pd.DataFrame({"query": np.repeat(who[at : at + 256], i.shape[1]), "rep": ids[i].ravel(), "distance": distance.ravel()}))
        return pd.concat(out)

    found = rows.unionByName(q).groupBy("ordering", "block").applyInPandas(rerank, _FOUND).distinct()
    best = Window.partitionBy("query").orderBy("distance", "rep")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    found = materialize(found, "found")
    # the points' rows, the query's own left out
    every = asked.join(found.select(F.col("query").alias("rep"), F.col("rep").alias("other"), "distance"), "rep")
    every = every.join(pts.select(F.col("rep").alias("other"), "ids"), "other").select("query_id", "distance", F.explode("ids").alias("id")).where("id <> query_id")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    every = every.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return every.select("query_id", "rank", F.col("id").alias(id_column), F.col("distance").alias("score"))
