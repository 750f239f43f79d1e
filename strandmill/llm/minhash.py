"""MinHash near-duplicate classes by BagMinHash signatures of five-word shingles.

A document is the multiset of its five-word shingles. Each shingle of count w is a Poisson process of
rate w, built as a hierarchy over the discretised weights: the unit [0, 1), then the dyadic intervals
[1, 2), [2, 4), [4, 8), ... Each interval has its own stream of points (time, height, register), and a
point belongs to the shingle only if its height is below w, the bits of the height being the turns down
the halves of the interval. A register keeps its earliest point, so two documents agree in a register
with exactly the probability of their weighted Jaccard similarity. Points later than the latest register
can change nothing, and generation stops there.

A band is a fixed random choice of registers; documents that share a band are candidates, and candidates are
verified by the overlap of their multisets (sum of minima over sum of maxima of the counts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.components import components
from strandmill.llm.text import U64, bags, blocks, mix, shingles, stream, tidied, words
from strandmill.storage import discard, materialize

WIDTH = 5
SIMILARITY = 0.8
REGISTERS, BANDS, ROWS = 128, 64, 7
#: Mean number of texts in each of the two blocks that are compared at a time.
BLOCK_TEXTS = 48
_GOLDEN, _SALTS = 0x9E3779B97F4A7C15, stream(71, 4)


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Earliest point of each register, n_docs x registers; infinite for documents without shingles."""
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    width = np.where(level == 0, 1.0, low)
    seed = mix(h[owner] + level.astype(U64) * _SALTS[0])
    at, weight = doc[owner] * registers, count[owner].astype(float)
    time = np.zeros(len(seed))
    flat = np.full(n_docs * registers, np.inf)
    step = 0
    while len(seed):
        step += 1
        r = mix(seed + U64(step * _GOLDEN % (1 << 64)))
        time = time - np.log(((r >> U64(11)).astype(float) + 0.5) * 2.0**-53) / width
        r = mix(r ^ _SALTS[1])
        register = (r >> U64(40)).astype(np.int64) % registers
        inside = low + width * ((r & U64((1 << 40) - 1)).astype(float) * 2.0**-40) < weight
        np.minimum.at(flat, (at + register)[inside], time[inside])
        live = time < flat.reshape(n_docs, registers).max(1)[at // registers]
        seed, time, at, low, width, weight = seed[live], time[live], at[live], low[live], width[live], weight[live]
    return flat.reshape(n_docs, registers)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = registers.view(U64)
    keys = []
    for band in range(bands):
        key = np.full(len(bits), stream(83, bands)[band], U64)
        for r in np.argsort(stream(101 + band, bits.shape[1]))[:rows]:
            key = mix(key ^ bits[:, r])
        keys.append(key)
    return np.stack(keys, 1).view(np.int64)


@tidied
def sign(batches: Iterator[pa.RecordBatch], bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    """(id, text, ...) to (id, digest, keys); keys is null for texts without words."""
    for batch in batches:
        lists = []
        for a, b, data, offsets in blocks(batch.column("text")):
            doc, h, count = bags(*shingles(words(data, offsets), width))
            keys = band_keys(signatures(doc, h, count, b - a, REGISTERS), bands, rows)
            some = np.zeros(b - a, bool)
            some[doc] = True
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(keys.ravel()), mask=pa.array(~some)))
        if lists:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.concat_arrays(lists)], ["id", "digest", "keys"])


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as (sorted distinct hashes, counts)."""
    (h, n), (g, m) = left, right
    if not len(h) or not len(g):
        return 1.0 if len(h) == len(g) else 0.0
    at = np.minimum(np.searchsorted(g, h), len(g) - 1)
    same = np.minimum(n, np.where(g[at] == h, m[at], 0)).sum()
    return float(same / (n.sum() + m.sum() - same))


def _bag(text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    doc, h = shingles(words(data, np.array([0, len(data)])), width)
    return bags(doc, h)[1:]


@tidied
def verify(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to (a, b, similarity)."""
    last, bag = None, None
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        left, right = batch.column("text_a"), batch.column("text_b")
        out = []
        for i in range(len(a)):
            if last != (key := (a[i].as_py(), left[i].as_py())):
                last, bag = key, _bag(key[1], width)
            out.append(similarity(bag, _bag(right[i].as_py(), width)))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(out, pa.float64())], ["a", "b", "similarity"])


@tidied
def compare_blocks(batches: Iterator[pa.RecordBatch], least: float, width: int) -> Iterator[pa.RecordBatch]:
    """All texts of a far block against all of a block of members: links (a, b) between different classes."""
    for batch in batches:
        links = []
        for far, others in zip(batch.column("far").to_pylist(), batch.column("members").to_pylist(), strict=True):
            bag = [_bag(x["text"], width) for x in others]
            ids, roots = (np.array([x[k] for x in others]) for k in ("id", "root"))
            sizes = np.array([n.sum() for _, n in bag])
            flat, count = (np.concatenate([x[k] for x in bag]) for k in (0, 1))
            owner = np.repeat(np.arange(len(bag)), [len(h) for h, _ in bag])
            for x in far:
                h, n = _bag(x["text"], width)
                at = np.minimum(np.searchsorted(h, flat), len(h) - 1)
                same = np.bincount(owner, np.where(h[at] == flat, np.minimum(n[at], count), 0), len(bag))
                close = same >= least * (sizes + n.sum() - same)
                links += [(min(x["id"], i), max(x["id"], i)) for i in ids[close & (roots != x["root"])].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_duplicate_links(docs: DataFrame, signed: DataFrame, least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """Verified links (a, b) that connect the classes of representatives (id, keys).

    No bucket emits its pairs. Each bucket names its most connected member, the pivot, and every member is
    compared with the pivots of its buckets. Members close to a pivot are in one class with it. Two members of a
    bucket that could be linked otherwise include one that is far from the pivot: the far ones of a pivot are
    compared exactly with all its members, block against block, unless they already are in one class. So every
    two members of a bucket end in one class or have been compared, and a group of n copies costs n rows.
    """
    keyed = signed.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(shared, "key"), "members")
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("top"))
    pivots = materialize(ranked.select("key", (-F.col("top.minus")).alias("a")), "pivots")
    spokes = materialize(members.join(pivots, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "spokes")
    ids = spokes.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # texts are merge-joined at any size: a plan that broadcasts ids while they are few tells nothing of a larger corpus
    texts = materialize(docs.where("text is not null").join(ids.hint("merge"), "id", "left_semi").select("id", "text").distinct(), "candidates")
    both = spokes.hint("merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    pairs, spokes = spokes, materialize(both.mapInArrow(lambda it: verify(it, width), "a long, b long, similarity double"), "verified")
    discard(members, pivots, pairs)
    near = spokes.where(F.col("similarity") >= least).select("a", "b")

    roots = materialize(components(near), "roots")
    r = roots.withColumnsRenamed({"id": "b", "root": "root_b"})
    q = roots.withColumnsRenamed({"id": "a", "root": "root_a"})
    known = spokes.join(r, "b", "left").join(q, "a", "left").select("a", "b", F.coalesce("root_b", "b").alias("root"), (F.coalesce("root_b", "b") != F.coalesce("root_a", "a")).alias("far"))
    size = known.groupBy("a").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far")).where("n > 1 and n_far > 0")
    known = known.join(size, "a").join(texts.withColumnRenamed("id", "b"), "b")
    text = F.struct(F.col("b").alias("id"), "root", "text")
    block = lambda n: F.pmod(F.xxhash64("b"), F.ceil(F.col(n) / BLOCK_TEXTS))
    far = known.where("far").groupBy("a", block("n_far").alias("block")).agg(F.collect_list(text).alias("far")).select("a", "far")
    others = known.groupBy("a", block("n").alias("block")).agg(F.collect_list(text).alias("members")).select("a", "members")
    found = far.join(others, "a").select("far", "members").mapInArrow(lambda it: compare_blocks(it, least, width), "a long, b long")
    return near.unionByName(materialize(found.distinct(), "found"))


def near_duplicates(documents: DataFrame, least: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its class), keep (it is that document).

    Equal texts are one class from the start. A null doc_id or text is in no class with others (class_id is
    its doc_id, and it is kept); texts without words equal only their exact copies. Rows that repeat a doc_id
    are one document, linked if any of its texts is; with equal ids all of them are kept. Other columns,
    whatever their names, are not read. Memory: one block of texts at a time; of very long texts, one.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    live = docs.where("id is not null and text is not null")
    signed = live.withColumn("digest", F.unhex(F.md5("text"))).select("id", "digest", "text")
    signed = materialize(signed.mapInArrow(lambda it: sign(it, bands, rows, width), "id long, digest binary, keys array<long>"), "signed")
    copies = signed.groupBy("digest").agg(F.min(F.struct("id", "keys")).alias("r"))
    copies = materialize(copies.select("digest", F.col("r.id").alias("rep"), F.col("r.keys").alias("keys")), "copies")
    links = near_duplicate_links(docs, copies.select(F.col("rep").alias("id"), "keys").where("keys is not null"), least, width)
    roots = materialize(components(links), "roots")
    # a doc_id with several texts joins the classes of all of them
    tie = signed.select("id", "digest").join(copies.select("digest", "rep"), "digest").select("id", "rep").distinct()
    tie = tie.join(roots.withColumnsRenamed({"id": "rep"}), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    many = tie.groupBy("id").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    if not many.isEmpty():
        merged = components(tie.join(many, "id", "left_semi").select(F.col("id").alias("a"), F.col("root").alias("b")))
        tie = tie.join(merged.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root")).distinct()
        tie = materialize(tie, "tie")
    classes = tie.groupBy("id").agg(F.min("root").alias("root"))
    out = docs.select("id").join(classes, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("class_id"))
    return out.withColumn("keep", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(documents: DataFrame, least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns: of each class that of the smallest doc_id, once,
    and all rows without a doc_id."""
    kept = near_duplicates(documents, least, width).where("keep and doc_id is not null").select(F.col("doc_id").alias("kept")).distinct()
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"))
    once = rows.join(kept.hint("merge"), F.col("id") == F.col("kept")).dropDuplicates(["id"])
    return once.select("document.*").unionByName(rows.where("id is null").select("document.*"))
