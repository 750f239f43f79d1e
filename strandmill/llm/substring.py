"""Substring dedup over a log-structured index of window fingerprints.

A window is 20 consecutive words. What the index keeps of a window is its anchor: the smallest fingerprint
of the 6-word runs within it. Equal windows have equal anchors, neighbouring windows mostly share one, and so
the index is several times smaller than the windows. The index is a log of immutable runs, each cut into
buckets by the leading bits of the anchor and sorted within the bucket. A new batch of documents is reduced to
its sorted anchors and merge-joined with the runs, bucket by bucket: anchors met before (in the runs, in
another part of the batch, or earlier in one text) make their documents candidates. The batch is then written
as a run of its own, and runs are compacted to one when there are too many. Candidates are verified: windows
under a repeated anchor (64 bits) are told apart by 48 more bits over all their words, ordered by (doc_id, start),
and only a window whose words also start earlier counts as repeated. Words themselves are not compared.

Within each Arrow batch an anchor or a window goes to the shuffle once, however often it occurs; what
repeats it there is settled on the spot. So a passage in a third of all documents costs a row for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.text import SPAN_A, U64, Words, blocks, mix, tidied, words
from strandmill.storage import materialize, new_path, plan_bytes, release, remove

WINDOW, RUN = 20, 6
BATCHES = 2
FAN_OUT = 4
#: Bytes of input for each bucket of the index; a bucket's anchors and windows are sorted in one task.
BUCKET_BYTES = 8 << 20
_LOG = "bucket int, generation int, anchors binary, docs binary, doc_id long, anchor long"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, in log2(width) passes."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def windows(w: Words, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window of the block."""
    n = len(w.start)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    pre = SPAN_A.prefix(w.hashes())
    at = np.arange(n - run + 1)
    low = sliding_min(SPAN_A.slices(pre, at, at + run), window - run + 1)
    start = np.flatnonzero(np.arange(window, n + 1) <= w.first[1:][w.doc[: n - window + 1]])
    return start, low[start]


def fingerprints(w: Words, start: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of all words of the windows at ``start``, independent of the anchors."""
    return SPAN_A.slices(SPAN_A.prefix(mix(w.hashes() ^ U64(0x51ED270B9F1A3C77))), start, start + window)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of ascending hashes."""
    bucket = hashes >> U64(64 - bits)
    edges = np.append(np.flatnonzero(_starts(bucket)), len(bucket))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), slice(a, b)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


@tidied
def collect_anchors(batches: Iterator[pa.RecordBatch], bits: int, window: int, run: int) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch, each anchor once with one of its documents; rows (doc_id, anchor) where it repeats."""
    for batch in batches:
        ids, found = _ids(batch), []
        for a, _, data, offsets in blocks(batch.column("text")):
            w = words(data, offsets)
            start, anchor = windows(w, window, run)
            doc = w.doc[start]
            key = fingerprints(w, start, window)
            order = np.lexsort((key, doc))
            twice = np.zeros(len(start), bool)  # windows that their own document has twice
            twice[order] = ~_starts(doc[order], key[order])
            order = np.lexsort((~twice, anchor, doc))
            first = order[_starts(doc[order], anchor[order])]
            found.append((anchor[first], ids[a + doc[first]], twice[first]))
        if not found:
            continue
        anchor, doc, twice = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(anchor, kind="stable")
        anchor, doc, twice = anchor[order], doc[order], twice[order]
        new = _starts(anchor)
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        repeated = np.repeat(size, size) > 1
        repeated |= twice
        logs = [(k, anchor[new][s].tobytes(), doc[new][s].tobytes()) for k, s in _by_bucket(anchor[new], bits)]
        n, m = len(logs), int(repeated.sum())
        none = pa.nulls
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in logs] + [None] * m, pa.int32()), none(n + m, pa.int32()), pa.array([x[1] for x in logs] + [None] * m, pa.binary()), pa.array([x[2] for x in logs] + [None] * m, pa.binary()),
            pa.concat_arrays([none(n, pa.int64()), pa.array(doc[repeated].astype(np.int64))]), pa.concat_arrays([none(n, pa.int64()), pa.array(anchor[repeated].view(np.int64))]),
        ], ["bucket", "generation", "anchors", "docs", "doc_id", "anchor"])


def merge_bucket(pdf: pd.DataFrame, generation: int) -> pd.DataFrame:
    """One bucket: the parts of the new batch (generation null) against each sorted run."""
    bucket = int(pdf["bucket"].iloc[0])
    read = lambda x, t: np.frombuffer(x, t)
    new = pdf[pdf["generation"].isna()]
    if not len(new):
        return pd.DataFrame(columns=["bucket", "generation", "anchors", "docs", "doc_id", "anchor"])
    anchor, doc = np.concatenate([read(x, U64) for x in new["anchors"]]), np.concatenate([read(x, np.int64) for x in new["docs"]])
    order = np.argsort(anchor, kind="stable")
    anchor, doc = anchor[order], doc[order]
    first = _starts(anchor)
    size = np.diff(np.append(np.flatnonzero(first), len(first)))
    hit = np.repeat(size, size) > 1
    docs, anchors = [], []
    for _, old in pdf[pdf["generation"].notna()].iterrows():
        past, owner = read(old["anchors"], U64), read(old["docs"], np.int64)
        at = np.searchsorted(past, anchor)
        met = past[np.minimum(at, len(past) - 1)] == anchor
        hit |= met
        back = np.unique(at[met])
        docs.append(owner[back])
        anchors.append(past[back])
    docs, anchors = np.concatenate([*docs, doc[hit]]), np.concatenate([*anchors, anchor[hit]])
    log = pd.DataFrame({"bucket": [bucket], "generation": [generation], "anchors": [anchor[first].tobytes()], "docs": [doc[first].tobytes()], "doc_id": [None], "anchor": [None]})
    met = pd.DataFrame({"bucket": None, "generation": None, "anchors": None, "docs": None, "doc_id": docs, "anchor": anchors.view(np.int64)})
    return pd.concat([log, met]).astype({"bucket": "Int32", "generation": "Int32", "doc_id": "Int64", "anchor": "Int64"})


def compact_bucket(pdf: pd.DataFrame, generation: int) -> pd.DataFrame:
    """Several sorted runs of a bucket as one; an anchor keeps its earliest run's document."""
    pdf = pdf.sort_values("generation")
    anchor, doc = np.concatenate([np.frombuffer(x, U64) for x in pdf["anchors"]]), np.concatenate([np.frombuffer(x, np.int64) for x in pdf["docs"]])
    order = np.argsort(anchor, kind="stable")
    order = order[_starts(anchor[order])]
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "generation": [generation], "anchors": [anchor[order].tobytes()], "docs": [doc[order].tobytes()]})


class AnchorIndex:
    """The log of runs, in the shared folder. Every run is a table written once."""

    def __init__(self, spark: SparkSession, bits: int, window: int = WINDOW, run: int = RUN, fan_out: int = FAN_OUT):
        self.spark, self.bits, self.window, self.run, self.fan_out = spark, bits, window, run, fan_out
        self.runs: list[str] = []
        self.generation = 0

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(*self.runs).where("bucket is not null")

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds documents (doc_id not null, text) and returns candidates (doc_id, anchor), of this batch and of earlier ones."""
        if len(self.runs) >= self.fan_out:
            self.compact()
        spark, bits, window, run, generation = self.spark, self.bits, self.window, self.run, self.generation
        parts, path = new_path(spark, "anchors"), new_path(spark, "run")
        batch.select("doc_id", "text").mapInArrow(lambda it: collect_anchors(it, bits, window, run), _LOG).write.option("compression", "zstd").parquet(parts)
        found = spark.read.schema(_LOG).parquet(parts)
        log = found.where("bucket is not null")
        log = log.unionByName(self._log()) if self.runs else log
        log.groupBy("bucket").applyInPandas(lambda pdf: merge_bucket(pdf, generation), _LOG).write.option("compression", "zstd").parquet(path)
        met = spark.read.schema(_LOG).parquet(path)
        out = found.unionByName(met).where("bucket is null").select("doc_id", "anchor")
        out = materialize(out, "met")
        remove(spark, parts)
        self.runs.append(path)
        self.generation += 1
        release(spark)
        return out

    def compact(self) -> None:
        """One run in place of all."""
        generation, path = self.generation, new_path(self.spark, "run")
        logs = self._log().select("bucket", "generation", "anchors", "docs").groupBy("bucket")
        logs.applyInPandas(lambda pdf: compact_bucket(pdf, generation), "bucket int, generation int, anchors binary, docs binary").write.option("compression", "zstd").parquet(path)
        self.drop()
        self.runs = [path]
        self.generation += 1

    def drop(self) -> None:
        for path in self.runs:
            remove(self.spark, path)
        self.runs = []


_FOUND = "bucket int, anchors binary, docs binary, starts binary, lengths binary, hashes binary, known binary"


def _spans(doc: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first rows, lengths) of runs of consecutive starts of a document, of rows in ascending order."""
    new = _starts(doc, *same)
    new[1:] |= start[1:] != start[:-1] + 1
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(doc)))


def _repeats(anchor: np.ndarray, h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of their window by (doc_id, start), and the others; both ascending in doc_id and start."""
    order = np.lexsort((start, doc, h, anchor))
    first = np.zeros(len(order), bool)
    first[order] = _starts(anchor[order], h[order])
    order = np.lexsort((start, doc))
    return order[first[order]], order[~first[order]]


def _triples(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Spans of ascending rows as rows of (doc_id, start, length)."""
    at, length = _spans(doc, start)
    return np.stack([doc[at], start[at].astype(np.int64), length], 1)


@tidied
def collect_windows(batches: Iterator[pa.RecordBatch], bits: int, window: int, run: int) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch (doc_id, text, anchors), the first of each candidate window by bucket, in runs under one
    anchor, and the spans of starts that repeat one within the batch (known)."""
    for batch in batches:
        ids, found = _ids(batch), []
        lists = batch.column("anchors")
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
        for a, b, data, offsets in blocks(batch.column("text")):
            w = words(data, offsets)
            start, anchor = windows(w, window, run)
            named = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])).astype(U64)
            tag = lambda anchor, doc: mix(anchor + mix(doc + U64(1)))
            sure = np.isin(tag(anchor, w.doc[start].astype(U64)), tag(values[ends[a] : ends[b]], named))
            start, anchor = start[sure], anchor[sure]
            found.append((anchor, fingerprints(w, start, window), ids[a + w.doc[start]], (start - w.first[w.doc[start]]).astype(np.int32)))
        if not found:
            continue
        anchor, h, doc, start = map(np.concatenate, zip(*found, strict=True))
        first, rest = _repeats(anchor, h, doc, start)
        at, length = _spans(doc[first], start[first], anchor[first])
        head = first[at]
        order = np.argsort(anchor[head] >> U64(64 - bits), kind="stable")
        at, length, head = at[order], length[order], head[order]
        each = first[np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        short = np.ascontiguousarray(h[each]).view(np.uint16).reshape(-1, 4)[:, :3]
        upto = np.append(0, np.cumsum(length))
        rows = [
            (k, *(x[head[s]].tobytes() for x in (anchor, doc, start)), length[s].astype(np.int32).tobytes(), short[upto[s.start] : upto[s.stop]].tobytes(), b"")
            for k, s in _by_bucket(anchor[head] >> U64(64 - bits) << U64(64 - bits), bits)
        ]
        rows.append((int(mix(ids[:1].astype(U64))[0] >> U64(64 - bits)), b"", b"", b"", b"", b"", _triples(doc[rest], start[rest]).tobytes()))
        names = ["bucket", "anchors", "docs", "starts", "lengths", "hashes", "known"]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.binary() if k else pa.int32()) for k in range(len(names))], names)


def verify_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in pdf[c]])
    length = read("lengths", np.int32).astype(np.int64)
    each = np.repeat(np.arange(len(length)), length)
    step = np.arange(len(each)) - np.repeat(np.cumsum(length) - length, length)
    anchor, doc, start = read("anchors", U64)[each], read("docs", np.int64)[each], read("starts", np.int32)[each] + step
    h = np.zeros((len(each), 4), np.uint16)
    h[:, :3] = read("hashes", np.uint16).reshape(-1, 3)
    _, rest = _repeats(anchor, h.view(U64)[:, 0], doc, start)
    out = np.concatenate([_triples(doc[rest], start[rest]), read("known", np.int64).reshape(-1, 3)])
    return pd.DataFrame({"doc_id": out[:, 0], "start": out[:, 1].astype(np.int32), "length": out[:, 2].astype(np.int32)})


def repeated_windows(documents: DataFrame, window: int = WINDOW, run: int = RUN, batches: int = BATCHES, fan_out: int = FAN_OUT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, spans): runs of window starts whose words also start earlier; documents are taken in by batches of ascending doc_id."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    bits = min(31, max(6, (plan_bytes(documents) // bucket_bytes).bit_length()))  # 31: buckets are ints; enough for 2^31 of them
    edges = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10000)).first()[0] if batches > 1 else None
    edges = sorted(set(edges or []))
    index, candidates = AnchorIndex(spark, bits, window, run, fan_out), None
    for k in range(len(edges) + 1):
        part = docs.where(F.lit(True) if not k else F.col("doc_id") > edges[k - 1]).where(F.lit(True) if k == len(edges) else F.col("doc_id") <= edges[k])
        found = index.add(part)
        candidates = found if candidates is None else candidates.unionByName(found)
    index.drop()
    anchors = candidates.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    found = docs.join(anchors, "doc_id").select("doc_id", "text", "anchors").mapInArrow(lambda it: collect_windows(it, bits, window, run), _FOUND)
    spans = found.groupBy("bucket").applyInPandas(verify_bucket, "doc_id long, start int, length int")
    spans = materialize(spans, "spans")
    release(spark)
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


@tidied
def _cut(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("spans")
        spans = lists.flatten()
        counts = lists.value_lengths().fill_null(0).to_numpy()
        ends = np.append(0, np.cumsum(counts))
        begin, length = (spans.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        n_words, n_removed, texts, digests = [], [], [], []
        for a, b, data, offsets in blocks(batch.column("text")):
            w = words(data, offsets)
            limit = np.repeat(w.first[1:], counts[a:b])
            low = np.repeat(w.first[:-1], counts[a:b]) + begin[ends[a] : ends[b]]
            cover = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(cover, np.minimum(low, limit), 1)
            np.add.at(cover, np.minimum(low + length[ends[a] : ends[b]] + window - 1, limit), -1)
            kept = np.cumsum(cover[:-1]) == 0
            size = w.end[kept] - w.start[kept]
            at = np.append(0, np.cumsum(size + 1))
            joined = np.full(at[-1], 0x20, np.uint8)
            source = np.repeat(w.start[kept] - at[:-1], size + 1) + np.arange(at[-1])
            source[at[1:] - 1] = 0
            joined = data[source] if at[-1] else joined
            joined[at[1:] - 1] = 0x20
            edge = at[np.append(0, np.cumsum(kept))[w.first]]
            n_words += np.diff(w.first).tolist()
            n_removed += (np.diff(w.first) - np.diff(np.append(0, np.cumsum(kept))[w.first])).tolist()
            view = memoryview(joined)
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                piece = view[x : max(x, y - 1)]
                digests.append(hashlib.sha256(piece).hexdigest())
                if with_text:
                    texts.append(bytes(piece).decode())
        out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)


def remove_repeats(documents: DataFrame, window: int = WINDOW, run: int = RUN, batches: int = BATCHES, with_text: bool = True, **more: int) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text with ``with_text``.

    Each word covered by a window that also starts earlier (smaller doc_id, or same document and earlier start)
    is removed; windows are judged on the input. A null or empty text, and one shorter than a window, loses
    nothing. A null doc_id takes no part and keeps its words. Rows that repeat a doc_id count as one place each:
    of windows that tie in doc_id and start, one is the first, and what repeats is removed from all rows of that
    doc_id. Very long texts are blocks of their own, so memory is bounded by the longest. An empty table gives an
    empty one. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_windows(documents, window, run, batches, **more)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(lambda it: _cut(it, window, with_text), schema)
