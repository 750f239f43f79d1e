"""Counts over reads and windows. Every count is one hash aggregation with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.functions.alphabet import matches
from strandmill.operators.windows import best_of_clusters, lone_hits, only_hits, seed_hits, sites, windows

BASES = "ACGT"


def read_stats(reads: DataFrame) -> DataFrame:
    """n_reads, lmin, lmax, n_bases, gc."""
    gc = F.length(F.regexp_replace("seq", "[^CG]", ""))
    return reads.agg(F.count("*").alias("n_reads"), F.min(F.length("seq")).alias("lmin"), F.max(F.length("seq")).alias("lmax"), F.sum(F.length("seq")).alias("n_bases"), F.try_divide(F.sum(gc).cast("double"), F.sum(F.length("seq")).cast("double")).alias("gc"))


def background(reads: DataFrame) -> DataFrame:
    """(base, n, q) of the forward strand, summed per read before any row is made."""
    counts = reads.agg(*[F.coalesce(F.sum(S.base_counts(F.col("seq"))[i]), F.lit(0)).cast("long").alias(b) for i, b in enumerate(BASES)])
    total = sum((F.col(b) for b in BASES), F.lit(0))
    rows = F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n"), F.try_divide(F.col(b).cast("double"), total.cast("double")).alias("q")) for b in BASES])
    return counts.select(F.inline(rows))


def digrams(reads: DataFrame) -> DataFrame:
    """(prev, base, n) within reads, forward strand."""
    w = windows(reads, 2).groupBy("kmer").agg(F.count("*").alias("n"))
    return w.select(F.substring("kmer", 1, 1).alias("prev"), F.substring("kmer", 2, 1).alias("base"), "n")


def character_counts(reads: DataFrame) -> DataFrame:
    return windows(reads, 1).groupBy(F.col("kmer").alias("char")).agg(F.count("*").alias("n"))


def positional_background(reads: DataFrame) -> DataFrame:
    """(pos, base, n)."""
    return windows(reads, 1).groupBy("pos", F.col("kmer").alias("base")).agg(F.count("*").alias("n"))


def kmer_counts(reads: DataFrame, k: int, two_strands: bool = False, palindromes_twice: bool = False) -> DataFrame:
    """(kmer, n): each window counts for itself and, with two strands, for its reverse complement."""
    return sites(reads, k, two_strands, palindromes_twice).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_probabilities(reads: DataFrame, max_k: int, two_strands: bool = False) -> DataFrame:
    """(k, kmer, n, p) for k = 1 to max_k."""
    every = None
    for k in range(1, max_k + 1):
        one = kmer_counts(reads, k, two_strands).select(F.lit(k).alias("k"), "kmer", "n")
        every = one if every is None else every.unionByName(one)
    return every.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("k")))


def gapped_kmer_counts(reads: DataFrame, k: int, max_gap: int, two_strands: bool = True, middle_only: bool = False) -> DataFrame:
    """(gap_len, gap_pos, kmer, n): k bases around a gap of gap_len after the first gap_pos; without a gap gap_pos is 1.
    Palindromes count for both strands."""
    every = None
    for gap in range(max_gap + 1):
        places = [1] if not gap else sorted({k // 2, (k + 1) // 2}) if middle_only else list(range(1, k))
        w = windows(reads, k + gap, two_strands).select("kmer", F.explode(F.array(*map(F.lit, places))).alias("gap_pos"))
        w = w.select(F.lit(gap).alias("gap_len"), "gap_pos", S.remove_gap(F.col("kmer"), F.col("gap_pos"), gap).alias("kmer"))
        every = w if every is None else every.unionByName(w)
    return every.groupBy("gap_len", "gap_pos", "kmer").agg(F.count("*").alias("n"))


def unique_in_read_kmers(reads: DataFrame, k: int, two_strands: bool = True) -> DataFrame:
    """(kmer, n): reads that have a k-mer exactly once."""
    once = sites(reads, k, two_strands).groupBy("read_id", "kmer").agg(F.count("*").alias("m")).where("m = 1")
    return once.groupBy("kmer").agg(F.count("*").alias("n"))


def top_seed(counts: DataFrame) -> DataFrame:
    """The commonest k-mer of (kmer, n), the less palindromic one of equals, then the smaller; as the smaller of it and its reverse complement."""
    best = counts.withColumn("pi", S.palindromic_index(F.col("kmer"))).orderBy(F.desc("n"), F.desc("pi"), "kmer").limit(1)
    return best.select(F.least("kmer", S.reverse_complement(F.col("kmer"))).alias("seed"), "n", "pi")


def column_counts(sequences: DataFrame, column: str = "seq") -> DataFrame:
    """(col, base, n) of aligned sequences, columns from 1."""
    return windows(sequences.select(F.lit(0).alias("read_id"), F.col(column).alias("seq")), 1).groupBy(F.col("pos").alias("col"), F.col("kmer").alias("base")).agg(F.count("*").alias("n"))


def snips(reads: DataFrame, seed: str, two_strands: bool = True, palindromes_twice: bool = False) -> DataFrame:
    """(col, base, n): counts of the seed (at its own bases) and of its single substitutions, columns from 0."""
    k = len(seed)
    hits = seed_hits(reads, seed, 1, two_strands, palindromes_twice).groupBy("kmer").agg(F.count("*").alias("n"))
    cells = F.array(*[F.struct(F.lit(j).alias("col"), F.lit(b).alias("base"), F.lit(seed[:j] + b + seed[j + 1 :]).alias("kmer")) for j in range(k) for b in BASES])
    spark = reads.sparkSession
    grid = spark.range(1).select(F.inline(cells))
    return grid.join(hits, "kmer", "left").select("col", "base", F.coalesce("n", F.lit(0)).alias("n"))


def snips_corrected(reads: DataFrame, seed: str, two_strands: bool = True) -> DataFrame:
    """Snips less what a uniform background gives, at least 0; sites are counted read by read."""
    k = len(seed)
    n_sites = reads.agg(F.sum(F.greatest(F.length("seq") - k + 1, F.lit(0))).alias("m"))
    expected = F.col("m") * (2 if two_strands else 1) * 4.0**-k
    # one row
    return snips(reads, seed, two_strands).join(F.broadcast(n_sites)).select("col", "base", F.greatest(F.col("n") - expected, F.lit(0.0)).alias("n"))


def counting_hits(reads: DataFrame, seed: str, radius: int, mode: str = "neighbourhood_contains_one", two_strands: bool = True, threshold: int = 4) -> DataFrame:
    """Hits of a seed's neighbourhood that a counting mode lets count."""
    hits = seed_hits(reads, seed, radius, two_strands)
    k = len(seed)
    if mode == "all_occurrences":
        return hits
    if mode == "sequence_contains_one":
        return only_hits(hits)
    if mode == "choose_one_per_cluster":
        return best_of_clusters(hits, k, threshold)
    if mode == "neighbourhood_contains_one":
        return lone_hits(hits, k, threshold)
    raise ValueError(mode)


def _gate(hd: Column, bad: Column, radius: int) -> Column:
    """A column counts if its site has fewer than ``radius`` mismatches, or as many and one is at this column."""
    return (hd < radius) | ((hd == radius) & bad)


def multinomial_counts(hits: DataFrame, seed: str, radius: int, weight: Column | None = None) -> DataFrame:
    """(col, base, n) of (kmer, hd): the gated base counts."""
    w = F.lit(1) if weight is None else weight
    rows = hits.groupBy("kmer", "hd").agg(F.sum(w).alias("w"))
    cells = []
    for j, c in enumerate(seed):
        good = [b for b in BASES if matches(b, c)]
        base = F.substring("kmer", j + 1, 1)
        cells.append(F.when(_gate(F.col("hd"), ~base.isin(*good), radius), F.struct(F.lit(j).alias("col"), base.alias("base"))))
    rows = rows.select("w", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return rows.groupBy("c.col", "c.base").agg(F.sum("w").alias("n"))


def dinucleotide_counts(hits: DataFrame, seed: str, radius: int, grouped: bool = False, weight: Column | None = None) -> DataFrame:
    """(r, col, prev, base, n) of (kmer, hd): transitions to each column, prev null at the first; with ``grouped`` by
    the number r of mismatches to the left, else r is 0."""
    w = F.lit(1) if weight is None else weight
    rows = hits.groupBy("kmer", "hd").agg(F.sum(w).alias("w"))
    cells, left = [], F.lit(0)
    for j, c in enumerate(seed):
        good = [b for b in BASES if matches(b, c)]
        base = F.substring("kmer", j + 1, 1)
        bad = ~base.isin(*good)
        prev = F.substring("kmer", j, 1) if j else F.lit(None).cast("string")
        cells.append(F.when(_gate(F.col("hd"), bad, radius), F.struct((left if grouped else F.lit(0)).alias("r"), F.lit(j).alias("col"), prev.alias("prev"), base.alias("base"))))
        left = left + bad.cast("int")
    rows = rows.select("w", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return rows.groupBy("c.r", "c.col", "c.prev", "c.base").agg(F.sum("w").alias("n"))


def start_positions(posteriors: DataFrame) -> DataFrame:
    """(motif, strand, pos, p) of (motif, strand, pos, z): where sites start, normalised by motif."""
    s = posteriors.groupBy("motif", "strand", "pos").agg(F.sum("z").alias("z"))
    return s.withColumn("p", F.col("z") / F.sum("z").over(Window.partitionBy("motif"))).drop("z")
