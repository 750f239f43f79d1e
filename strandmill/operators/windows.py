"""Windows of reads, and patterns in them. Reads are (read_id, seq); positions count from 1."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.functions.alphabet import bases_of, combine_overlap, contributions, is_palindromic, neighbourhood, pattern_regex
from strandmill.storage import plan_bytes

#: A pattern table of at most this many rows is broadcast.
BROADCAST_ROWS = 200_000


def windows(reads: DataFrame, k: int, two_strands: bool = False, rna: bool = False) -> DataFrame:
    """(read_id, strand, pos, kmer): all windows of k bases; pos on the reverse strand (1) is where the window's
    forward counterpart starts. Reads shorter than k have none."""
    some = reads.where(F.length("seq") >= k).select("read_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("pos"))
    kmer = F.substring(F.col("seq"), F.col("pos"), F.lit(k))
    if not two_strands:
        return some.select("read_id", F.lit(0).alias("strand"), "pos", kmer.alias("kmer"))
    both = some.select("read_id", "pos", kmer.alias("f")).select("read_id", "pos", F.posexplode(F.array("f", S.reverse_complement(F.col("f"), rna))).alias("strand", "kmer"))
    return both.select("read_id", "strand", "pos", "kmer")


def sites(reads: DataFrame, k: int, two_strands: bool = False, palindromes_twice: bool = False, rna: bool = False) -> DataFrame:
    """Windows; with two strands a palindromic window is there once, unless ``palindromes_twice``."""
    out = windows(reads, k, two_strands, rna)
    if two_strands and not palindromes_twice:
        out = out.where(~((F.col("strand") == 1) & S.is_palindromic(F.col("kmer"), rna)))
    return out


def pattern_hits(reads: DataFrame, pattern: str, two_strands: bool = False, palindromes_twice: bool = True, rna: bool = False) -> DataFrame:
    """Sites that match an IUPAC pattern (overlapping). Reads without a match are skipped before they are exploded."""
    regex = pattern_regex(pattern, rna)
    some = reads
    if pattern and not two_strands:
        some = reads.where(F.col("seq").rlike(regex))
    return sites(some, len(pattern), two_strands, palindromes_twice, rna).where(F.col("kmer").rlike(f"^{regex}$"))


def count_pattern(reads: DataFrame, pattern: str, two_strands: bool = False, rna: bool = False) -> DataFrame:
    """(pattern, n): how often a pattern occurs; the empty pattern occurs at each base."""
    if not pattern:
        return reads.agg(F.lit("").alias("pattern"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("n"))
    return pattern_hits(reads, pattern, two_strands, rna=rna).agg(F.lit(pattern).alias("pattern"), F.count("*").alias("n"))


def locate(reads: DataFrame, patterns: DataFrame, k: int, two_strands: bool = False, rna: bool = False) -> DataFrame:
    """Windows joined to a table of k-mers (column ``pattern``) on equality; broadcast behind a check of its size."""
    hint = F.broadcast if plan_bytes(patterns) <= BROADCAST_ROWS * (k + 40) else (lambda df: df)
    return windows(reads, k, two_strands, rna).join(hint(patterns.withColumnRenamed("pattern", "kmer")), "kmer")


def neighbourhood_table(spark, seed: str, radius: int, rna: bool = False) -> DataFrame:
    """(pattern, hd, cols) of the strings within ``radius``: mismatches and the columns they count for."""
    rows = []
    for s in neighbourhood(seed, radius, True, rna):
        hd = sum(a not in bases_of(b, rna) for a, b in zip(s, seed, strict=True))
        rows.append((s, hd, contributions(s.replace("U", "T"), seed.replace("U", "T"), radius), is_palindromic(s, rna)))
    return spark.createDataFrame(rows, "pattern string, hd int, cols array<int>, palindrome boolean")


def seed_hits(reads: DataFrame, seed: str, radius: int, two_strands: bool = False, palindromes_twice: bool = False, rna: bool = False) -> DataFrame:
    """Sites within ``radius`` mismatches of a seed: (read_id, strand, pos, kmer, hd)."""
    out = sites(reads, len(seed), two_strands, palindromes_twice, rna).withColumn("hd", S.pattern_distance(F.col("kmer"), seed))
    return out.where(F.col("hd") <= radius)


def most_frequent_completion(reads: DataFrame, pattern: str, begin: int, length: int, two_strands: bool = False, skip_near_palindromes: bool = False) -> DataFrame:
    """(kmer, n): the commonest string in place of columns begin to begin + length - 1 (from 0) of a pattern, put in
    it; ties go to the largest. The pattern itself, with n 0, if nothing matches."""
    hits = pattern_hits(reads, pattern, two_strands)
    hits = hits.select(F.substring(F.col("kmer"), F.lit(begin + 1), F.lit(length)).alias("part"))
    full = F.concat(F.lit(pattern[:begin]), "part", F.lit(pattern[begin + length :]))
    counts = hits.groupBy("part").agg(F.count("*").alias("n")).withColumn("kmer", full)
    if skip_near_palindromes:
        counts = counts.where(S.palindromic_index(F.col("kmer")) > 1)
    best = counts.agg(F.max(F.struct("n", "kmer")).alias("b"))
    return best.select(F.coalesce("b.kmer", F.lit(pattern)).alias("kmer"), F.coalesce("b.n", F.lit(0)).alias("n"))


def _pattern_is(kmer: Column, pattern: str) -> Column:
    """Whether a string of the pattern's length matches it; plain ends are compared without a regular expression."""
    left, right = (len(x) for x in (re.match("[ACGT]*", pattern).group(), re.search("[ACGT]*$", pattern).group()))
    plain = kmer.startswith(pattern[:left]) & kmer.endswith(pattern[len(pattern) - right :])
    rest = pattern[left : len(pattern) - right]
    return plain & kmer.rlike(f"^{pattern_regex(pattern)}$") if set(rest) - {"N"} else plain


def _completions(reads: DataFrame, cases: list[tuple[str, int, int]], two_strands: bool) -> DataFrame | None:
    """(i, part) of all sites that match a case's pattern; each length's windows are made once for all of its cases."""
    by_length: dict[int, list[int]] = {}
    for i, (pattern, _, _) in enumerate(cases):
        by_length.setdefault(len(pattern), []).append(i)
    out = None
    for k, some in by_length.items():
        kmer = F.col("kmer")
        cells = [F.when(_pattern_is(kmer, cases[i][0]), F.struct(F.lit(i).alias("i"), F.substring(kmer, cases[i][1] + 1, cases[i][2]).alias("part"))) for i in some]
        rows = sites(reads, k, two_strands, True).select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def commonest_completions(reads: DataFrame, cases: list[tuple[str, int, int]], two_strands: bool = False, skip_near_palindromes: bool = False) -> list[tuple[str, int]]:
    """``most_frequent_completion`` of many (pattern, begin, length) in one job: (kmer, n) of each."""
    found = _completions(reads, cases, two_strands)
    out = [(pattern, 0) for pattern, _, _ in cases]
    if found is None:
        return out
    counts = found.groupBy("i", "part").agg(F.count("*").alias("n"))
    if skip_near_palindromes:
        ends = F.array(*[F.array(F.lit(p[:b]), F.lit(p[b + n :])) for p, b, n in cases])
        counts = counts.where(S.palindromic_index(F.concat(ends[F.col("i")][0], "part", ends[F.col("i")][1])) > 1)
    for r in counts.groupBy("i").agg(F.max(F.struct("n", "part")).alias("b")).collect():  # a row for each case
        pattern, begin, length = cases[r["i"]]
        out[r["i"]] = (pattern[:begin] + r["b"]["part"] + pattern[begin + length :], r["b"]["n"])
    return out


def pattern_counts(reads: DataFrame, patterns: list[str], two_strands: bool = False) -> list[int]:
    """How often each of some patterns occurs, in one job; a palindromic site counts on both strands."""
    found = _completions(reads, [(p, 0, 0) for p in patterns], two_strands)
    out = [0] * len(patterns)
    for r in [] if found is None else found.groupBy("i").agg(F.count("*").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def overlapping_seed(reads: DataFrame, a: str, b: str, d: int, how: str = "N", two_strands: bool = False) -> DataFrame:
    """Seed of two motifs at distance d < 0: their combination with the overlap filled by its commonest completion."""
    return most_frequent_completion(reads, combine_overlap(a, b, d, how), len(a) + d, -d, two_strands)


def hit_clusters(hits: DataFrame, k: int, threshold: int = 4) -> DataFrame:
    """Adds ``cluster`` (from 0 in each read): a hit starts a new one if it overlaps the end of the hit before it by
    less than ``threshold``. Hits of one read are ordered by position, strand and string."""
    own = Window.partitionBy("read_id").orderBy("pos", "strand", "kmer")
    gap = F.lag("pos").over(own) + k - 1 - F.col("pos") + 1 < threshold
    return hits.withColumn("new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("cluster", F.sum("new").over(own)).drop("new")


def best_of_clusters(hits: DataFrame, k: int, threshold: int = 4) -> DataFrame:
    """One hit of each cluster: fewest mismatches, then first; of more than two such, the one nearest to their centre."""
    c = hit_clusters(hits, k, threshold)
    same = Window.partitionBy("read_id", "cluster")
    c = c.withColumn("best", F.min("hd").over(same)).where("hd = best")
    c = c.withColumn("ties", F.count("*").over(same)).withColumn("middle", (F.min("pos").over(same) + F.max("pos").over(same)) / 2)
    off = F.when(F.col("ties") > 2, F.abs(F.col("pos") - F.col("middle"))).otherwise(0.0)
    order = same.orderBy(off, "pos", "strand", "kmer")
    return c.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "best", "ties", "middle")


def lone_hits(hits: DataFrame, k: int, threshold: int = 4) -> DataFrame:
    """Hits that are their whole cluster."""
    c = hit_clusters(hits, k, threshold)
    return c.withColumn("n", F.count("*").over(Window.partitionBy("read_id", "cluster"))).where("n = 1").drop("n")


def only_hits(hits: DataFrame) -> DataFrame:
    """Hits of reads that are hit at one position only (on either strand)."""
    own = Window.partitionBy("read_id")
    return hits.withColumn("lo", F.min("pos").over(own)).withColumn("hi", F.max("pos").over(own)).where("lo = hi").drop("lo", "hi")


def scan(reads: DataFrame, scores: list[list[float]], threshold: float, two_strands: bool = True) -> DataFrame:
    """Sites whose score, the sum over columns of ``scores[base][column]``, reaches the threshold; a palindromic hit is there once."""
    k = len(scores[0])
    total = F.lit(0.0)
    for j in range(k):
        base = F.substring("kmer", j + 1, 1)
        total = total + F.when(base == "A", scores[0][j]).when(base == "C", scores[1][j]).when(base == "G", scores[2][j]).otherwise(scores[3][j])
    return sites(reads, k, two_strands).withColumn("score", total).where(F.col("score") >= threshold)
