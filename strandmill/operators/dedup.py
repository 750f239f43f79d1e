"""Removal of duplicate reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.storage import materialize


def exact(reads: DataFrame) -> DataFrame:
    """(seq, n): distinct reads."""
    return reads.groupBy("seq").agg(F.count("*").alias("n"))


def pairs_within(seqs: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b: strings of one length at most ``radius`` mismatches apart.

    Pigeonhole: cut to radius + 1 blocks, two such strings have a block in common, so an equi-join on (length, block
    number, block) finds all of them; the distance decides. A block that a large share of reads has makes this
    join quadratic in that share, as the answer then mostly is.
    """
    n = radius + 1
    size = F.greatest(F.length("seq") / n, F.lit(1)).cast("int")
    block = lambda i: F.substring(F.col("seq"), size * i + 1, size if i < radius else F.length("seq"))
    keyed = seqs.select("seq", F.length("seq").alias("len"), F.posexplode(F.array(*[block(i) for i in range(n)])).alias("i", "block"))
    a = keyed.withColumnRenamed("seq", "a")
    b = keyed.withColumnRenamed("seq", "b")
    both = a.join(b, ["len", "i", "block"]).where("a < b").select("a", "b").distinct()
    return both.where(S.hamming_distance(F.col("a"), F.col("b")) <= radius)


def within(reads: DataFrame, radius: int) -> DataFrame:
    """(seq, n): a maximal set of reads more than ``radius`` apart, chosen greedily by falling count, then by rising string.

    In rounds: an undecided read without an undecided better neighbour stays, and its neighbours go. This gives
    the greedy choice, for as many rounds as the longest chain of ever better neighbours has links.
    """
    if radius == 0:
        return exact(reads)
    counts = materialize(exact(reads), "counts")
    links = pairs_within(counts, radius)
    ca, cb = (counts.withColumnRenamed("seq", c).withColumnRenamed("n", f"n_{c}") for c in "ab")
    links = links.join(ca, "a").join(cb, "b")
    a_first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    links = materialize(links.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("worse")), "pairs")
    open_links, gone = links, None
    while True:
        blocked = open_links.select(F.col("worse").alias("seq")).distinct()
        kept = open_links.select(F.col("better").alias("seq")).distinct().join(blocked, "seq", "left_anti")
        lost = materialize(open_links.join(kept.withColumnRenamed("seq", "better"), "better", "left_semi").select(F.col("worse").alias("seq")).distinct(), "gone")
        if lost.isEmpty():
            break
        gone = lost if gone is None else gone.unionByName(lost)
        for side in ("better", "worse"):
            open_links = open_links.join(lost.withColumnRenamed("seq", side), side, "left_anti")
        open_links = materialize(open_links, "pairs")
    return counts if gone is None else counts.join(gone, "seq", "left_anti")


def drop_near_repeats(reads: DataFrame, radius: int = 1) -> DataFrame:
    """Reads that are not within ``radius``, on either strand, of a sequence that several reads have (strands put together)."""
    canonical = F.least("seq", S.reverse_complement(F.col("seq")))
    repeated = reads.groupBy(canonical.alias("seq")).agg(F.count("*").alias("n")).where("n > 1")
    either = repeated.select(F.explode(F.array("seq", S.reverse_complement(F.col("seq")))).alias("seq")).distinct()
    seqs = reads.select("seq").unionByName(either).distinct()
    near = pairs_within(seqs, radius)
    near = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    bad = near.join(either.withColumnRenamed("seq", "a"), "a", "left_semi").select(F.col("b").alias("seq")).unionByName(either).distinct()
    return reads.join(bad, "seq", "left_anti").select("read_id", "seq")
