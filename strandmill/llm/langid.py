"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords: the byte 1-, 2- and 3-grams of its lower-case words with
their boundaries, hashed to a table. A linear layer and a softmax follow. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents. A held-back part of the sample gives the
temperature that calibrates the probabilities, and the score below which a prediction is rejected.

Probabilities only compare the learned languages. So a text must also look like the language it is taken for: the
mean log-likelihood of its subwords in that language, less that of the language's own documents, each judged by all
the others, has a threshold too. It works with one language as with many.

As the layer is linear, a trained model is one table of logits by bucket, and a text costs one lookup a subword.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.text import BLOCK, IS_SPACE, blocks, tidied

#: Bound of what is fitted: labelled documents of each language. Training and predictions read whole texts.
PER_LANGUAGE = 600
BUCKETS, WIDTH, EPOCHS, RATE = 1 << 15, 16, 8, 0.5
#: Share of correctly predicted held-back documents whose score may lie below the rejection threshold, and of
#: training documents whose likelihood may.
REJECTED = 0.001
#: Added to the count of each bucket in a language.
SMOOTH = 0.1
#: Bytes of text whose subwords are held at a time in predictions; three for each byte.
PREDICTED = 1 << 18
UNKNOWN = "und"
NO_LETTER = r"^\P{L}*$"


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the byte n-grams of a block; ASCII capitals count as small, digits as one."""
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    low[(low >= 48) & (low <= 57)] = 48
    low[IS_SPACE[low]] = 32
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    x = low.astype(np.uint32)
    rows, out = [row], [x]
    if len(x) > 1:
        two = x[:-1] * np.uint32(257) + x[1:] + np.uint32(0x10000)
        same = row[1:] == row[:-1]
        rows.append(row[1:][same])
        out.append(two[same])
    if len(x) > 2:
        three = two[:-1] * np.uint32(65599) + x[2:] * np.uint32(2654435761)
        same = row[2:] == row[:-2]
        rows.append(row[2:][same])
        out.append(three[same])
    h = np.concatenate(out)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return np.concatenate(rows), (h % np.uint32(BUCKETS)).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages, float32; the mean over a text's subwords is its logits
    bias: np.ndarray
    temperature: float
    threshold: float
    likelihood: np.ndarray  # languages x BUCKETS, float32; the mean over a text's subwords is about 0 for the language's own
    least: float  # of that mean

    def judged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, rows x languages, and the likelihood in the most probable one. Buckets are summed
        a block at a time."""
        out, like = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for a, b, data, offsets in blocks(texts, PREDICTED):
            row, bucket = subwords(data, offsets)
            n = np.maximum(np.bincount(row, minlength=b - a), 1)
            for k in range(len(self.languages)):
                out[a:b, k] = np.bincount(row, self.logits[:, k][bucket], b - a) / n + self.bias[k]
            flat = out[a:b].argmax(1) * BUCKETS
            like[a:b] = np.bincount(row, self.likelihood.reshape(-1)[flat[row] + bucket], b - a) / n
        return softmax(out / self.temperature), like

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.judged(texts)[0]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def likelihoods(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_languages: int) -> tuple[np.ndarray, float]:
    """The table of log-likelihoods, less the mean of each language's documents, and the least of a text; rows of
    (buckets, counts). A document is judged by the counts of the others."""
    counts = np.zeros((n_languages, BUCKETS))
    for (i, c), k in zip(rows, y, strict=True):
        counts[k, i] += c
    total = counts.sum(1) + SMOOTH * BUCKETS
    own = np.array([c @ np.log((counts[k, i] - c + SMOOTH) / (total[k] - c.sum())) / max(1, c.sum()) for (i, c), k in zip(rows, y, strict=True)])
    mean = np.array([own[y == k].mean() for k in range(n_languages)])
    table = np.log((counts + SMOOTH) / total[:, None]) - mean[:, None]
    return table.astype(np.float32), float(np.quantile(own - mean[y], REJECTED, method="lower"))


def fit(counts: list[tuple[np.ndarray, np.ndarray]], checks: list[int], labels: list[str], seed: int = 7) -> Model:
    """SGD over mini-batches of documents, given as (buckets, counts); a fifth of them, by the hash in ``checks``, calibrates."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rows = [(i, (c / max(1, c.sum())).astype(np.float32)) for i, c in counts]
    held = np.array(checks) % 5 == 0 if len(counts) >= 50 else np.zeros(len(counts), bool)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    layer[:] = rng.normal(0, 0.1, layer.shape)
    train = np.flatnonzero(~held)
    steps, done = EPOCHS * -(-len(train) // 8), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), 8):
            some = train[at : at + 8]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = np.stack([w @ table[i] for i, w in (rows[k] for k in some)])
            error = softmax(mean @ layer + bias)
            error[np.arange(len(some)), y[some]] -= 1
            back = error @ layer.T
            layer -= rate / len(some) * mean.T @ error
            bias -= rate * error.sum(0) / len(some)
            for k, g in zip(some, back, strict=True):
                i, w = rows[k]
                table[i] -= (rate / (w @ w) * w)[:, None] * g  # moves this text's mean by rate * g
    model = Model(languages, (table @ layer).astype(np.float32), bias.astype(float), 1.0, 0.0, *likelihoods(counts, y, len(languages)))
    check = np.flatnonzero(held) if held.any() else train
    raw = np.stack([w @ model.logits[i] for i, w in (rows[k] for k in check)]) + bias if len(check) else np.zeros((0, len(languages)))
    if len(check):
        grid = np.geomspace(0.25, 8, 31)
        loss = [-np.log(softmax(raw / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(raw / model.temperature)
        right = p.max(1)[p.argmax(1) == y[check]]
        model.threshold = float(np.quantile(right, REJECTED, method="lower")) if len(right) else 0.0
    return model


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text, a piece at a time: pieces overlap by two bytes and n-grams are counted once."""
    count = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), BLOCK):
        a = max(0, at - 2)
        raw = np.frombuffer(text[a : at + BLOCK], np.uint8)
        count += np.bincount(subwords(raw, np.array([0, len(raw)]))[1], minlength=BUCKETS)
        if a < at:
            again = np.frombuffer(text[a:at], np.uint8)
            count -= np.bincount(subwords(again, np.array([0, 2]))[1], minlength=BUCKETS)
    some = np.flatnonzero(count)
    return some, count[some]


@tidied
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, text) to (key, lang, check, buckets, counts); a row in place of at most BUCKETS counts a text."""
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column("text")[k].as_py().encode()
            i, c = counted(text)
            cols = [pa.array([zlib.crc32(text)], pa.int64()), pa.array([i.astype("<u2").tobytes()], pa.binary()), pa.array([c.astype("<u4").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(k, 1), batch.column("lang").slice(k, 1), *cols], ["key", "lang", "check", "buckets", "counts"])


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, allowed=None) -> Model | None:
    """Fits on at most ``per_language`` documents of each non-null lang, those with the smallest hash of the id.

    Documents without a letter are not used. None if nothing is left to learn from.
    """
    rows = documents.where("lang is not null and text is not null").where(~F.col("text").rlike(NO_LETTER))
    rows = rows if allowed is None else rows.where(allowed)
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # an expected 1.5 x per_language rows of each language pass the hash test, in one pass without a shuffle of texts
    rates = {r["lang"]: min(1.0, 1.5 * per_language / r["n"]) for r in counts.collect()}
    if not rates:
        return None
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    some = rows.where(F.pmod(key, F.lit(1 << 20)) < rate * (1 << 20)).select(key.alias("key"), "lang", "text")
    some = some.mapInArrow(_count, "key long, lang string, check long, buckets binary, counts binary")
    found: dict[str, list[tuple[int, int, bytes, bytes]]] = {}
    for r in some.collect():  # bounded by per_language, the number of languages and BUCKETS
        found.setdefault(r["lang"], []).append((r["key"], r["check"], r["buckets"], r["counts"]))
    chosen = [(lang, *x[1:]) for lang in sorted(found) for x in sorted(found[lang])[:per_language]]
    counts = [(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)) for _, _, i, c in chosen]
    return fit(counts, [x[1] for x in chosen], [x[0] for x in chosen]) if chosen else None


@tidied
def _predict(batches: Iterator[pa.RecordBatch], model: Model | None, filtering: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
        if model is None:
            lang, score, known = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
        else:
            p, like = model.judged(batch.column("text"))
            lang = np.where(letters, np.array(model.languages, object)[p.argmax(1)], UNKNOWN).tolist()
            score = np.where(letters, p.max(1), 0.0)
            known = (score >= model.threshold) & (like >= model.least)
        if filtering:
            yield batch.filter(pa.array(known & letters)).select(batch.schema.names[:-2]).rename_columns(filtering)
            continue
        names = [n for n in batch.schema.names if n not in ("text", "letters")]
        out = [batch.column(n) for n in names] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known & letters)]
        yield pa.RecordBatch.from_arrays(out, [*names, "lang_pred", "score", "accepted"])


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """One row per row: doc_id, lang_pred, score, accepted (not rejected), from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0 and is rejected; so is a score below the model's
    threshold or a text unlike its language, which keep lang_pred. Without a model all is ``und``, and what has a letter
    is accepted. Equal texts are predicted alike, so repeated rows are too. A very long text is summed in a block of its
    own. An empty table gives an empty one. No shuffle; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(~F.col("text").rlike(NO_LETTER), F.lit(False)).alias("letters"))
    return rows.mapInArrow(lambda it: _predict(it, model), "doc_id long, lang_pred string, score double, accepted boolean")


def accepted(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``documents`` that are not rejected, with all their columns, whatever these are called."""
    names = documents.columns
    rows = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.col("text"), F.coalesce(~F.col("text").rlike(NO_LETTER), F.lit(False)).alias("letters"))
    return rows.mapInArrow(lambda it: _predict(it, model, names), documents.schema)


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify_held_out(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learns from the documents that are not held out and predicts all; adds held_out. A null doc_id is not held out."""
    model = train(documents, per_language, ~held_out(F.col("doc_id")))
    return identify(documents, model).withColumn("held_out", held_out(F.col("doc_id")))
