"""Huddinge distances of gapped k-mers.

The distance is the larger number of defined bases less the most defined bases that agree at one offset.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "n"
BLOCK = 512
COUNTS = 1 << 20
"""Counts of agreements, a pair and offset each, that are held at once."""


def _clean(s: str) -> str:
    return s.replace("N", GAP)


def defined(s: str) -> int:
    return len(s) - s.count(GAP)


def agreements(x: str, y: str) -> dict[int, int]:
    """Agreeing defined positions x[j] = y[j - a] by offset a."""
    return {a: sum(x[j] == y[j - a] != GAP for j in range(max(0, a), min(len(x), a + len(y)))) for a in range(1 - len(y), len(x))}


def distance(x: str, y: str) -> int:
    x, y = _clean(x), _clean(y)
    return max(defined(x), defined(y)) - max(agreements(x, y).values(), default=0)


def alignments(x: str, y: str) -> tuple[int, list[int]]:
    """(distance, offsets that attain it)."""
    x, y = _clean(x), _clean(y)
    found = agreements(x, y)
    most = max(found.values(), default=0)
    return max(defined(x), defined(y)) - most, [a for a, n in found.items() if n == most]


def align_all(seqs: list[str]) -> list[str]:
    """Sequences padded with n: each is put beside the one before it at its first best offset."""
    at, offset = [0], 0
    for a, b in itertools.pairwise(seqs):
        offset += alignments(a, b)[1][0]
        at.append(offset)
    low = min(at)
    width = max(o - low + len(s) for o, s in zip(at, seqs, strict=True))
    return [(GAP * (o - low) + s).ljust(width, GAP) for o, s in zip(at, seqs, strict=True)]


def _codes(seqs: np.ndarray) -> np.ndarray:
    """Strings as rows of codes; 0 is a gap or past the end."""
    width = max(map(len, seqs), default=0)
    raw = np.frombuffer("".join(s.ljust(width, GAP) for s in seqs).encode(), np.uint8).reshape(len(seqs), width)
    return np.where((raw == ord("n")) | (raw == ord("N")), 0, raw)


def block_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances of two blocks of coded strings."""
    best = np.zeros((len(x), len(y)), np.int16)
    for a in range(1 - y.shape[1], x.shape[1]):
        left, right = x[:, max(0, a) : a + y.shape[1]], y[:, max(0, -a) : max(0, -a) + min(x.shape[1] - max(0, a), y.shape[1] - max(0, -a))]
        n = min(left.shape[1], right.shape[1])
        same = np.zeros((len(x), len(y)), np.int16)
        for j in range(n):
            same += (left[:, j, None] == right[None, :, j]) & (left[:, j, None] != 0)
        np.maximum(best, same, out=best)
    return np.maximum((x != 0).sum(1)[:, None], (y != 0).sum(1)[None, :]).astype(np.int16) - best


def _packed_pairs(reads: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Pairs of blocks of reads, a row each; blocks by a hash of the id."""
    n = max(1, -(-reads.count() // block))
    packed = reads.groupBy(F.pmod(F.xxhash64("read_id"), F.lit(n)).alias("b")).agg(F.sort_array(F.collect_list(F.struct("read_id", "seq"))).alias("rows"))
    pairs = packed.selectExpr("b as p", "rows as left").join(packed.selectExpr("b as q", "rows as right"), F.col("p") >= F.col("q"))
    return pairs.repartition(max(n, 2), "p", "q"), n


def all_pairs(reads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, dist), i > j, of (read_id, seq): every pair is wanted, so the rows of the result are the square of the input's.

    Reads are packed to blocks; each pair of blocks is one row, and its distances are computed together. So the join
    moves (reads / block)^2 rows, not reads^2.
    """
    pairs, _ = _packed_pairs(reads, block)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, q, left, right in zip(pdf["p"], pdf["q"], pdf["left"], pdf["right"], strict=True):
                ids = [np.array([r["read_id"] for r in rows]) for rows in (left, right)]
                d = block_distances(*(_codes(np.array([r["seq"] for r in rows], object)) for rows in (left, right)))
                i, j = np.indices(d.shape)
                keep = (ids[0][i] > ids[1][j]) if p == q else (ids[0][i] != ids[1][j])
                a, b = ids[0][i[keep]], ids[1][j[keep]]
                yield pd.DataFrame({"i": np.maximum(a, b), "j": np.minimum(a, b), "dist": d[keep].astype(np.int8)})

    return pairs.mapInPandas(compare, "i long, j long, dist tinyint")


def _padded(seqs: list[str], gap: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): strings as columns of codes of any characters, one row a position; gaps and what is past the end are ``gap``."""
    lengths = np.array([len(s) for s in seqs], np.int64)
    width = int(lengths.max(initial=0))
    raw = np.frombuffer("".join(s.ljust(width, GAP) for s in seqs).encode("utf-32-le"), np.uint32).reshape(len(seqs), width)
    raw = np.where((raw == ord("n")) | (raw == ord("N")), ord(gap), raw)
    return np.ascontiguousarray(raw.T.astype(np.uint8 if raw.max(initial=0) < 256 else np.uint32)), lengths


def block_alignments(x: list[str], y: list[str], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Best offsets of each x against each y, in slices of x: (rows of x, offsets a, ends, columns of y, distances).

    Group g is of row x[g] at offset a[g]; its columns and distances lie before ends[g], after the group before it.
    ``wanted`` is false for pairs to leave out.
    """
    # gaps differ on the two sides, so they never agree
    (left, m), (right, n) = _padded(x, "n"), _padded(y, "N")
    shifts = np.arange(1 - len(right), len(left))
    if not len(shifts):
        return
    bases_x, bases_y = (left != ord("n")).sum(0), (right != ord("N")).sum(0)
    inside = None if m.min() == len(left) and n.min() == len(right) else (shifts[:, None] < m, shifts[:, None] > -n)
    kind = np.uint8 if min(len(left), len(right)) < 256 else np.uint32
    step = max(1, COUNTS // (len(shifts) * len(y)))
    for low in range(0, len(x), step):
        rows = np.arange(low, min(low + step, len(x)))
        same = np.zeros((len(shifts), len(rows), len(y)), kind)
        equal = np.empty(same.shape[1:], bool)
        for i in range(len(left)):
            for j in range(len(right)):
                np.equal(left[i, rows, None], right[j], out=equal)
                np.add(same[i - j + len(right) - 1], equal.view(np.uint8), out=same[i - j + len(right) - 1])
        best = same == same.max(0)
        if inside is not None:
            best &= inside[0][:, rows, None] & inside[1][:, None, :]
        if wanted is not None:
            best &= wanted[rows]
        at = np.flatnonzero(best)
        starts = np.arange(len(shifts) * len(rows)) * len(y)
        ends = np.searchsorted(at, starts + len(y))
        held = np.diff(ends, prepend=0)
        columns = at - np.repeat(starts, held)
        row = np.tile(rows, len(shifts))
        distances = np.maximum(np.repeat(bases_x[row], held), bases_y[columns]) - same.reshape(-1)[at]
        some = held > 0
        yield row[some], np.repeat(shifts, len(rows))[some], ends[some], columns, distances


def all_alignments(reads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, dist, shift), i > j: the best offsets of i against j, a row for each.

    Pairs of blocks as in ``all_pairs``; Python returns a row for each read of the left block and offset, with lists of the
    reads of the right one, and Spark explodes the lists.
    """
    pairs, _ = _packed_pairs(reads, block)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, *sides in zip(*(batch.column(c) for c in ("p", "q", "left", "right")), strict=True):
                ids, seqs = zip(*((s.values.field("read_id").to_numpy(), s.values.field("seq").to_pylist()) for s in sides), strict=True)
                wanted = ids[0][:, None] > ids[1] if p == q else None
                for x, a, ends, columns, distances in block_alignments(*seqs, wanted):
                    ends = pa.array(np.append(0, ends), pa.int32())
                    lists = (pa.ListArray.from_arrays(ends, pa.array(v)) for v in (ids[1][columns], distances.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[0][x]), pa.array(a, pa.int32()), *lists], ["x", "a", "ys", "dists"])

    found = pairs.mapInArrow(align, "x long, a int, ys array<long>, dists array<int>").select("x", "a", "dists", F.posexplode("ys").alias("k", "y"))
    return found.select(
        F.greatest("x", "y").alias("i"), F.least("x", "y").alias("j"), F.col("dists")[F.col("k")].alias("dist"), F.when(F.col("x") > F.col("y"), F.col("a")).otherwise(-F.col("a")).alias("shift"),
    )


def neighbourhood(x: str, radius: int, max_length: int, least: int | None = None, most: int | None = None) -> dict[str, int]:
    """Gapped k-mers within ``radius`` of x, of at most ``max_length`` positions, no gap at an end, and a number of defined
    bases from least to most; with their distances. Built column by column around each offset, cut as soon as too
    few bases can still agree."""
    x = _clean(x)
    k = defined(x)
    least, most = max(1, k - radius) if least is None else least, k + radius if most is None else most
    out: dict[str, int] = {}
    for a in range(1 - max_length, len(x)):
        for n in range(max(1, -a + 1), max_length + 1):
            under = [x[a + j] if 0 <= a + j < len(x) else GAP for j in range(n)]
            ahead = [0] * (n + 1)
            for j in range(n - 1, -1, -1):
                ahead[j] = ahead[j + 1] + (under[j] != GAP)
            stack = [("", 0, 0)]
            while stack:
                s, d, same = stack.pop()
                j = len(s)
                if max(k, d) - same - ahead[j] > radius or d > most:
                    continue
                if j == n:
                    if d >= least:
                        out.setdefault(s, distance(x, s))
                    continue
                for c in "ACGT" if j in (0, n - 1) else "ACGTn":
                    stack.append((s + c, d + (c != GAP), same + (c == under[j] != GAP)))
    return {s: d for s, d in out.items() if d <= radius}


def paths(x: str, y: str, limit: int = 1000) -> list[list[str]]:
    """Shortest chains of single steps from x to y over aligned positions of a best offset: a step sets, clears or
    changes one base, or moves one base to another gap. At most ``limit`` chains."""
    found: list[list[str]] = []
    x, y = _clean(x), _clean(y)
    for a in alignments(x, y)[1]:
        low, high = min(0, a), max(len(x), a + len(y))
        u = (GAP * -low + x).ljust(high - low, GAP)
        v = (GAP * (a - low) + y).ljust(high - low, GAP)
        differing = [i for i in range(len(u)) if u[i] != v[i]]
        clear, fill = [i for i in differing if v[i] == GAP], [i for i in differing if u[i] == GAP]
        change = [(i, i) for i in differing if u[i] != GAP and v[i] != GAP]
        swaps = min(len(clear), len(fill))
        options = set()
        for c in itertools.permutations(clear, swaps):
            for f in itertools.combinations(fill, swaps):
                rest = [(i, None) for i in clear if i not in c] + [(None, i) for i in fill if i not in f]
                options.add(tuple(sorted(zip(c, f, strict=True))) + tuple(rest) + tuple(change))
                if len(options) > limit:
                    break
        for steps in options:
            for order in itertools.islice(itertools.permutations(steps), limit):
                s, chain = list(u), [u.strip(GAP)]
                for i, j in order:
                    if i is not None:
                        s[i] = GAP if j is None or i != j else v[i]
                    if j is not None:
                        s[j] = v[j]
                    chain.append("".join(s).strip(GAP))
                if chain not in found:
                    found.append(chain)
                if len(found) >= limit:
                    return found
    return found


def scaled_count(n: float, seq: str, reference: int, palindrome: bool = False) -> float:
    """A count put on the scale of ``reference`` defined bases; half for a palindrome."""
    return n * 4.0 ** (defined(_clean(seq)) - reference) / (2 if palindrome else 1)


def widest_path(counts: dict[str, float], x: str, y: str) -> tuple[float, list[str]]:
    """(bottleneck, path): of paths over k-mers in ``counts`` by steps of distance 1, one whose smallest count is largest."""
    import heapq

    best, back, heap = {x: counts.get(x, 0.0)}, {x: None}, [(-counts.get(x, 0.0), x)]
    while heap:
        w, u = heapq.heappop(heap)
        if u == y:
            path = [u]
            while back[path[-1]] is not None:
                path.append(back[path[-1]])
            return -w, path[::-1]
        if -w < best[u]:
            continue
        for v, c in counts.items():
            if (m := min(-w, c)) > best.get(v, -1.0) and distance(u, v) == 1:
                best[v], back[v] = m, u
                heapq.heappush(heap, (-m, v))
    return 0.0, []
