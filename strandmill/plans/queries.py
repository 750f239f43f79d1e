"""Registered queries of the sequence operators, with the SQL they are checked against.

The reads are made from whole driver tables: a hash of an id, as bases, with a motif planted in every third read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import matrix as M
from strandmill.functions import sequence as S
from strandmill.functions.alphabet import neighbourhood, pattern_regex
from strandmill.operators import counts as C
from strandmill.operators import dedup, huddinge
from strandmill.operators import windows as W
from strandmill.plans import em, report

MOTIF, SEED, PATTERN = "GCCTGAGGC", "GCCTGAGGC", "GCCNNNGGC"
_HEX = "0123456789abcdef"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.translate(F.md5(F.col("event_id").cast("string")), _HEX, "ACGT" * 4)
    planted = F.concat(F.substring(s, 1, 6), F.lit(MOTIF), F.substring(s, 16, 5))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("read_id"), F.when(F.col("event_id") % 3 == 0, planted).otherwise(F.substring(s, 1, 20)).alias("seq"))


def short_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of sixteen bases, a number that grows with the table: of every twenty five copies of others, and three of
    these with one base changed."""
    key = F.col("p_partkey")
    s = F.substring(F.translate(F.md5(F.when(key % 4 == 1, key - 1).otherwise(key).cast("string")), _HEX, "ACGT" * 4), 1, 16)
    changed = F.concat(F.substring(s, 1, 5), F.translate(F.substring(s, 6, 1), "ACGT", "GTAC"), F.substring(s, 7, 10))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("read_id"), F.when((key % 4 == 1) & (key % 20 > 8), changed).otherwise(s).alias("seq"))


def few_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.translate(F.md5(F.col("s_suppkey").cast("string")), _HEX, "ACGT" * 4)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("read_id"), F.substring(s, 1, 8).alias("seq"))


READS = f"""reads as (
  select event_id as read_id, case when event_id % 3 = 0 then concat(substring(s, 1, 6), '{MOTIF}', substring(s, 16, 5)) else substring(s, 1, 20) end as seq
  from (select event_id, translate(md5(cast(event_id as varchar)), '{_HEX}', '{"ACGT" * 4}') as s from events))"""
SHORT = f"""reads as (
  select read_id, case when read_id % 4 = 1 and read_id % 20 > 8 then concat(substring(s, 1, 5), translate(substring(s, 6, 1), 'ACGT', 'GTAC'), substring(s, 7)) else s end as seq
  from (select p_partkey as read_id, substring(translate(md5(cast(case when p_partkey % 4 = 1 then p_partkey - 1 else p_partkey end as varchar)), '{_HEX}', '{"ACGT" * 4}'), 1, 16) as s from part))"""
FEW = f"reads as (select s_suppkey as read_id, substring(translate(md5(cast(s_suppkey as varchar)), '{_HEX}', '{'ACGT' * 4}'), 1, 8) as seq from supplier)"
RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


def _windows(k: int, strands: bool = False, once: bool = True, gap: int = 0) -> str:
    """CTE text: w(read_id, strand, pos, kmer)."""
    fwd = f"f as (select read_id, pos, substring(seq, pos, {k}) as kmer from reads, unnest(range(1, length(seq) - {k} + 2)) t(pos))"
    if not strands:
        return f"with {READS}, {fwd}, w as (select read_id, 0 as strand, pos, kmer from f)"
    skip = f" where kmer <> {RC.format('kmer')}" if once else ""
    return f"with {READS}, {fwd}, w as (select read_id, 0 as strand, pos, kmer from f union all select read_id, 1, pos, {RC.format('kmer')} from f{skip})"


def _hd(seed: str, column: str = "kmer") -> str:
    return "(" + " + ".join(f"(substring({column}, {i + 1}, 1) <> '{c}')::int" for i, c in enumerate(seed) if c != "N") + ")"


@query(f"with {READS} select read_id, seq from reads")
def reads_table(spark, sf_dir):
    return reads(spark, sf_dir)


@query(f"with {READS} select count(*) as n_reads, min(length(seq))::int as lmin, max(length(seq))::int as lmax, sum(length(seq))::bigint as n_bases, sum(length(regexp_replace(seq, '[^CG]', '', 'g')))::double / sum(length(seq)) as gc from reads")
def read_stats(spark, sf_dir):
    return C.read_stats(reads(spark, sf_dir))


@query(f"{_windows(1)} select kmer as base, count(*) as n, count(*)::double / sum(count(*)) over () as q from w group by kmer")
def background(spark, sf_dir):
    return C.background(reads(spark, sf_dir))


@query(f"{_windows(2)} select substring(kmer, 1, 1) as prev, substring(kmer, 2, 1) as base, count(*) as n from w group by kmer")
def digrams(spark, sf_dir):
    return C.digrams(reads(spark, sf_dir))


@query(f"{_windows(1)} select kmer as char, count(*) as n from w group by kmer")
def character_counts(spark, sf_dir):
    return C.character_counts(reads(spark, sf_dir))


@query(f"{_windows(1)} select pos::int as pos, kmer as base, count(*) as n from w group by pos, kmer")
def positional_background(spark, sf_dir):
    return C.positional_background(reads(spark, sf_dir))


@query(f"{_windows(1)} select pos::int as col, kmer as base, count(*) as n from w group by pos, kmer")
def column_counts(spark, sf_dir):
    return C.column_counts(reads(spark, sf_dir))


@query(f"{_windows(6)} select kmer, count(*) as n from w group by kmer")
def kmer_counts(spark, sf_dir):
    return C.kmer_counts(reads(spark, sf_dir), 6)


@query(f"{_windows(6, True)} select kmer, count(*) as n from w group by kmer")
def kmer_counts_canonical(spark, sf_dir):
    return C.kmer_counts(reads(spark, sf_dir), 6, True)


@query(f"{_windows(6, True, False)} select kmer, count(*) as n from w group by kmer")
def kmer_counts_palindromes_twice(spark, sf_dir):
    return C.kmer_counts(reads(spark, sf_dir), 6, True, True)


@query(
    f"with {READS}, c as (select k, substring(seq, pos, k) as kmer, count(*) as n from reads, unnest(range(1, 4)) a(k), unnest(range(1, length(seq) - k + 2)) t(pos) group by 1, 2) "
    "select k::int as k, kmer, n, n::double / sum(n) over (partition by k) as p from c"
)
def kmer_probabilities(spark, sf_dir):
    return C.kmer_probabilities(reads(spark, sf_dir), 3)


@query(
    f"with {READS}, g as (select * from (values (0, 1), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)) v(gap_len, gap_pos)), "
    f"f as (select gap_len, gap_pos, substring(seq, pos, 4 + gap_len) as w from reads, g, unnest(range(1, length(seq) - 4 - gap_len + 2)) t(pos)), "
    f"b as (select * from f union all select gap_len, gap_pos, {RC.format('w')} from f) "
    "select gap_len, gap_pos, concat(substring(w, 1, gap_pos), substring(w, gap_pos + gap_len + 1)) as kmer, count(*) as n from b group by 1, 2, 3"
)
def gapped_kmer_counts(spark, sf_dir):
    return C.gapped_kmer_counts(reads(spark, sf_dir), 4, 2)


@query(f"{_windows(6, True)}, o as (select read_id, kmer from w group by 1, 2 having count(*) = 1) select kmer, count(*) as n from o group by kmer")
def unique_per_read_kmers(spark, sf_dir):
    return C.unique_in_read_kmers(reads(spark, sf_dir), 6)


@query(
    f"{_windows(6, True)}, c as (select kmer, count(*) as n, hamming(kmer, {RC.format('kmer')})::int as pi from w group by kmer) "
    f"select least(kmer, {RC.format('kmer')}) as seed, n, pi from c order by n desc, pi desc, kmer limit 1"
)
def top_seed(spark, sf_dir):
    return C.top_seed(C.kmer_counts(reads(spark, sf_dir), 6, True))


@query(f"with {READS} select read_id, {RC.format('seq')} as rc, reverse(seq) as reversed, seq = {RC.format('seq')} as palindrome, hamming(seq, {RC.format('seq')})::int as palindromic_index from reads")
def reverse_complements(spark, sf_dir):
    s = F.col("seq")
    return reads(spark, sf_dir).select("read_id", S.reverse_complement(s).alias("rc"), F.reverse(s).alias("reversed"), S.is_palindromic(s).alias("palindrome"), S.palindromic_index(s).alias("palindromic_index"))


_CODE = "list_reduce(list_transform(range(1, length(seq) + 1), lambda i: (strpos('ACGT', substring(seq, i, 1)) - 1)::bigint), lambda a, b: a * 4 + b)"


@query(f"with {READS} select read_id, {_CODE} as code, seq as decoded, bit_count(xor(({_CODE}), 0))::int as ones from reads")
def sequence_codes(spark, sf_dir):
    code = S.number_of(F.col("seq"))
    return reads(spark, sf_dir).select("read_id", code.alias("code"), S.sequence_of(code, F.length("seq")).alias("decoded"), F.bit_count(code).alias("ones"))


@query(
    f"with {READS} select read_id, hamming(substring(seq, 1, 9), '{SEED}')::int as hd, hamming(substring(seq, 1, 9), '{SEED}')::int as hd_codes, "
    f"list_min(list_transform(range(1, 13), lambda i: hamming(substring(seq, i, 9), '{SEED}')))::int as nearest from reads"
)
def hamming_to_seed(spark, sf_dir):
    s, seed = F.substring("seq", 1, 9), F.lit(SEED)
    return reads(spark, sf_dir).select("read_id", S.hamming_distance(s, seed).alias("hd"), S.hamming_of_codes(S.number_of(s), S.number_of(seed)).alias("hd_codes"), S.min_hamming_distance(F.col("seq"), seed).alias("nearest"))


@query(
    f"with {READS} select read_id, regexp_matches(seq, '{pattern_regex(PATTERN)}') as found, {_hd(PATTERN, 'substring(seq, 7, 9)')} as hd, "
    + "(" + " + ".join(f"case when substring(seq, {7 + i}, 1) <> '{c}' then {1 << (8 - i)} else 0 end" for i, c in enumerate(PATTERN) if c != "N") + ")::bigint as mask from reads"
)
def pattern_mismatches(spark, sf_dir):
    s = F.substring("seq", 7, 9)
    return reads(spark, sf_dir).select("read_id", S.contains_pattern(F.col("seq"), PATTERN).alias("found"), S.pattern_distance(s, PATTERN).alias("hd"), S.mismatch_mask(s, PATTERN).alias("mask"))


@query(f"with {READS} select read_id, (length(seq) - length(replace(seq, 'AC', '')))::int as ac_bases, length(regexp_replace(seq, '[^G]', '', 'g'))::int as g, concat(substring(seq, 1, 5), substring(seq, 9)) as cut from reads")
def gap_functions(spark, sf_dir):
    s = F.col("seq")
    return reads(spark, sf_dir).select("read_id", (F.length(s) - S.defined_bases(s, "AC")).alias("ac_bases"), S.base_counts(s)[2].alias("g"), S.remove_gap(s, 5, 3).alias("cut"))


@query(f"with {READS} select read_id, array_to_string(list_filter(string_split(seq, 'GG'), lambda x: x <> ''), '|') as fields, array_to_string(list_filter(string_split_regex(replace(seq, 'CC', 'N'), 'N+'), lambda x: length(x) >= 4), '|') as pieces from reads")
def split_functions(spark, sf_dir):
    s = F.col("seq")
    return reads(spark, sf_dir).select("read_id", F.array_join(S.split_fields(s, "GG"), "|").alias("fields"), F.array_join(S.unmasked_pieces(F.replace(s, F.lit("CC"), F.lit("N")), 4), "|").alias("pieces"))


@query(f"{_windows(9, True, False)} select read_id, strand, pos::int as pos, kmer from w where regexp_full_match(kmer, '{pattern_regex(PATTERN)}')")
def iupac_hits(spark, sf_dir):
    return W.pattern_hits(reads(spark, sf_dir), PATTERN, True)


@query(f"{_windows(5)} select 'GNRYC' as pattern, count(*) as n from w where regexp_full_match(kmer, '{pattern_regex('GNRYC')}')")
def iupac_count(spark, sf_dir):
    return W.count_pattern(reads(spark, sf_dir), "GNRYC")


_SEED6 = "GCCTGA"
_NEAR = ", ".join(f"('{p}')" for p in neighbourhood(_SEED6, 1, True))


@query(f"{_windows(6, True, False)} select kmer, count(*) as n from w join (values {_NEAR}) p(pattern) on kmer = pattern group by kmer")
def seed_neighbourhood_counts(spark, sf_dir):
    patterns = W.neighbourhood_table(spark, _SEED6, 1).select("pattern")
    return W.locate(reads(spark, sf_dir), patterns, 6, True).groupBy("kmer").agg(F.count("*").alias("n"))


def _snips(seed: str) -> str:
    cells = ", ".join(f"({j}, '{b}', '{seed[:j] + b + seed[j + 1 :]}')" for j in range(len(seed)) for b in "ACGT")
    return f"{_windows(len(seed), True)}, c as (select kmer, count(*) as n from w group by kmer), g as (select col, base, coalesce(n, 0) as n from (values {cells}) v(col, base, kmer) left join c using (kmer))"


@query(f"{_snips(SEED)} select col, base, n from g")
def multinomial1(spark, sf_dir):
    return C.snips(reads(spark, sf_dir), SEED)


@query(f"{_snips(SEED)} select col, base, greatest(n - (select sum(greatest(length(seq) - {len(SEED)} + 1, 0)) * 2 * {4.0 ** -len(SEED)!r}::double from reads), 0e0) as n from g")
def multinomial1_corrected(spark, sf_dir):
    return C.snips_corrected(reads(spark, sf_dir), SEED)


def _hits(seed: str, radius: int) -> str:
    return f"{_windows(len(seed), True)}, h as (select *, {_hd(seed)} as hd from w where {_hd(seed)} <= {radius})"


def _gated(seed: str, radius: int, source: str) -> str:
    """CTE c(col, prev, base, r, n): gated cells of the hits in ``source``."""
    cells = []
    for j, c in enumerate(seed):
        bad = f"substring(kmer, {j + 1}, 1) <> '{c}'"
        left = " + ".join(f"(substring(kmer, {i + 1}, 1) <> '{seed[i]}')::int" for i in range(j)) or "0"
        prev = f"substring(kmer, {j}, 1)" if j else "null"
        cells.append(f"select {j} as col, {prev} as prev, substring(kmer, {j + 1}, 1) as base, {left} as r from {source} where hd < {radius} or (hd = {radius} and {bad})")
    return "c as (" + " union all ".join(cells) + ")"


@query(f"{_hits(SEED, 2)}, {_gated(SEED, 2, 'h')} select 0 as r, col, prev, base, count(*) as n from c group by col, prev, base")
def dinucleotide_counts(spark, sf_dir):
    return C.dinucleotide_counts(W.seed_hits(reads(spark, sf_dir), SEED, 2, True), SEED, 2)


@query(f"{_hits(SEED, 3)}, {_gated(SEED, 3, 'h')} select r, col, prev, base, count(*) as n from c group by r, col, prev, base")
def dinucleotide_counts_grouped(spark, sf_dir):
    return C.dinucleotide_counts(W.seed_hits(reads(spark, sf_dir), SEED, 3, True), SEED, 3, True)


@query(f"{_hits(SEED, 2)}, {_gated(SEED, 2, 'h')} select col, base, count(*) as n from c group by col, base")
def multinomial_all_occurrences(spark, sf_dir):
    return C.multinomial_counts(C.counting_hits(reads(spark, sf_dir), SEED, 2, "all_occurrences"), SEED, 2)


_CLUSTER_SEED = "GAGG"
_CLUSTERS = (
    f"{_hits(_CLUSTER_SEED, 1)}, n as (select *, coalesce(lag(pos) over o + 4 - pos < 2, false)::int as new from h window o as (partition by read_id order by pos, strand, kmer)), "
    "k as (select read_id, strand, pos, kmer, hd, sum(new) over (partition by read_id order by pos, strand, kmer)::bigint as cluster from n)"
)


@query(f"{_CLUSTERS} select read_id, strand, pos::int as pos, kmer, hd, cluster from k")
def hit_clusters(spark, sf_dir):
    return W.hit_clusters(W.seed_hits(reads(spark, sf_dir), _CLUSTER_SEED, 1, True), 4, 2)


@query(
    f"{_CLUSTERS}, b as (select *, min(hd) over (partition by read_id, cluster) as best from k), "
    "t as (select *, count(*) over p as ties, (min(pos) over p + max(pos) over p) / 2e0 as middle from b where hd = best window p as (partition by read_id, cluster)), "
    "s as (select *, row_number() over (partition by read_id, cluster order by case when ties > 2 then abs(pos - middle) else 0 end, pos, strand, kmer) as n from t) "
    "select read_id, strand, pos::int as pos, kmer, hd, cluster from s where n = 1"
)
def best_of_clusters(spark, sf_dir):
    return W.best_of_clusters(W.seed_hits(reads(spark, sf_dir), _CLUSTER_SEED, 1, True), 4, 2)


@query(f"{_CLUSTERS}, s as (select *, count(*) over (partition by read_id, cluster) as n from k) select read_id, strand, pos::int as pos, kmer, hd, cluster from s where n = 1")
def lone_hits(spark, sf_dir):
    return W.lone_hits(W.seed_hits(reads(spark, sf_dir), _CLUSTER_SEED, 1, True), 4, 2)


@query(f"{_hits(SEED, 2)}, o as (select read_id from h group by read_id having min(pos) = max(pos)), x as (select h.* from h join o using (read_id)), {_gated(SEED, 2, 'x')} select col, base, count(*) as n from c group by col, base")
def multinomial_sequence_contains_one(spark, sf_dir):
    return C.multinomial_counts(C.counting_hits(reads(spark, sf_dir), SEED, 2, "sequence_contains_one"), SEED, 2)


@query(
    f"{_hits(SEED, 2)}, n as (select *, coalesce(lag(pos) over o + 9 - pos < 4, false)::int as new from h window o as (partition by read_id order by pos, strand, kmer)), "
    "k as (select *, sum(new) over (partition by read_id order by pos, strand, kmer) as cluster from n), x as (select * from (select *, count(*) over (partition by read_id, cluster) as m from k) where m = 1), "
    f"{_gated(SEED, 2, 'x')} select col, base, count(*) as n from c group by col, base"
)
def multinomial_neighbourhood_contains_one(spark, sf_dir):
    return C.multinomial_counts(C.counting_hits(reads(spark, sf_dir), SEED, 2), SEED, 2)


_OPEN = "GCCTNNNGC"


@query(
    f"{_windows(9, True, False)}, c as (select substring(kmer, 5, 3) as part, count(*) as n from w where regexp_full_match(kmer, '{pattern_regex(_OPEN)}') group by 1) "
    "select concat('GCCT', part, 'GC') as kmer, n from c order by n desc, part desc limit 1"
)
def overlap_seed_max(spark, sf_dir):
    return W.most_frequent_completion(reads(spark, sf_dir), _OPEN, 4, 3, True)


@query(f"with {SHORT} select seq, count(*) as n from reads group by seq")
def exact_dedup(spark, sf_dir):
    return dedup.exact(short_reads(spark, sf_dir))


@query(
    f"with {SHORT}, c as (select seq, count(*) as n from reads group by seq), m as (select least(seq, {RC.format('seq')}) as s from reads group by 1 having count(*) > 1), "
    f"e as (select s as seq from m union select {RC.format('s')} from m) "
    "select read_id, seq from reads where not exists (select 1 from e where hamming(e.seq, reads.seq) <= 1)"
)
def drop_near_repeats(spark, sf_dir):
    return dedup.drop_near_repeats(short_reads(spark, sf_dir))


@query()
def near_dedup1(spark, sf_dir):
    """Greedy, so no SQL; tests hold it against a brute-force version."""
    return dedup.within(short_reads(spark, sf_dir), 1)


@query(f"with {SHORT}, c as (select distinct seq from reads) select a.seq as a, b.seq as b from c a join c b on a.seq < b.seq and hamming(a.seq, b.seq) <= 1")
def pairs_within1(spark, sf_dir):
    return dedup.pairs_within(dedup.exact(short_reads(spark, sf_dir)), 1)


_MATCHES = "list_max(list_transform(range(-7, 8), lambda o: list_sum(list_transform(range(greatest(0, o), least(8, 8 + o)), lambda j: (substring(x.seq, (j + 1)::bigint, 1) = substring(y.seq, (j - o + 1)::bigint, 1))::int))))"


@query(f"with {FEW} select x.read_id as i, y.read_id as j, (8 - {_MATCHES})::tinyint as dist from reads x join reads y on x.read_id > y.read_id")
def huddinge_pairs(spark, sf_dir):
    return huddinge.all_pairs(few_reads(spark, sf_dir))


_OFFSETS = "list_transform(range(-7, 8), lambda o: {'o': o, 'n': list_sum(list_transform(range(greatest(0, o), least(8, 8 + o)), lambda j: (substring(x.seq, (j + 1)::bigint, 1) = substring(y.seq, (j - o + 1)::bigint, 1))::int))})"


@query(
    f"with {FEW}, a as (select x.read_id as i, y.read_id as j, unnest({_OFFSETS}) as u from reads x join reads y on x.read_id > y.read_id), b as (select i, j, u.o as o, u.n as n, max(u.n) over (partition by i, j) as most from a) "
    "select i, j, (8 - most)::int as dist, o::int as shift from b where n = most"
)
def huddinge_alignments(spark, sf_dir):
    return huddinge.all_alignments(few_reads(spark, sf_dir))


_NEAR_HD = ", ".join(f"('{p}', {sum(a != b for a, b in zip(p, _SEED6))})" for p in neighbourhood(_SEED6, 2, True))


@query(
    f"with {READS}, q as (select substring(seq, pos, 1) as base, count(*)::double / sum(count(*)) over () as q from reads, unnest(range(1, length(seq) + 1)) t(pos) group by 1), "
    f"s as (select * from (values {_NEAR_HD}) v(kmer, hd)), p as (select kmer, hd, exp(sum(ln(q))) as p from s, unnest(range(1, 7)) t(i) join q on base = substring(kmer, i::bigint, 1) group by kmer, hd), "
    + "c as (" + " union all ".join(f"select {j} as col, substring(kmer, {j + 1}, 1) as base, p from p where hd < 2 or (hd = 2 and substring(kmer, {j + 1}, 1) <> '{c}')" for j, c in enumerate(_SEED6))
    + ") select col, base, round(sum(p) * (select sum(greatest(length(seq) - 5, 0)) * 2 from reads), 4) as n from c group by col, base"
)
def expected_counts(spark, sf_dir):
    """What a background alone would give the gated counts."""
    from strandmill.functions import adm

    r = reads(spark, sf_dir)
    q = {x["base"]: x["q"] for x in C.background(r).collect()}
    n = r.agg(F.sum(F.greatest(F.length("seq") - 5, F.lit(0)))).first()[0]
    m = adm.expected_multinomial_counts(_SEED6, 2, 2 * n, [q[b] for b in "ACGT"])
    return spark.createDataFrame([(j, b, round(float(m[i, j]), 4)) for i, b in enumerate("ACGT") for j in range(6)], "col int, base string, n double")


_PROB = [[0.05, 0.05, 0.05, 0.05, 0.05, 0.7, 0.05, 0.05, 0.05], [0.05, 0.7, 0.8, 0.05, 0.1, 0.1, 0.05, 0.1, 0.85], [0.85, 0.2, 0.1, 0.1, 0.7, 0.1, 0.85, 0.8, 0.05], [0.05, 0.05, 0.05, 0.8, 0.15, 0.1, 0.05, 0.05, 0.05]]
_PPM = ", ".join(f"({j}, '{b}', {_PROB[i][j]!r}::double)" for i, b in enumerate("ACGT") for j in range(9))
_LOGODDS = [[float(x) for x in row] for row in M.log_odds(__import__("numpy").array(_PROB)).round(6)]


@query(
    f"{_windows(9, True)}, s as (select *, "
    + " + ".join(f"(case substring(kmer, {j + 1}, 1) when 'A' then {_LOGODDS[0][j]!r}::double when 'C' then {_LOGODDS[1][j]!r}::double when 'G' then {_LOGODDS[2][j]!r}::double else {_LOGODDS[3][j]!r}::double end)" for j in range(9))
    + " as score from w) select read_id, strand, pos::int as pos, kmer, round(score, 4) as score from s where score >= 4"
)
def pwm_scan(spark, sf_dir):
    return W.scan(reads(spark, sf_dir), _LOGODDS, 4.0).withColumn("score", F.round("score", 4))


def pseudo_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(motif, col, base, p): embeddings as matrices, four components a column."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("motif"), F.posexplode(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("i", "v"))
    return report.normalize(e.select("motif", F.floor(F.col("i") / 4).cast("int").alias("col"), F.substring(F.lit("ACGT"), (F.col("i") % 4 + 1).cast("int"), F.lit(1)).alias("base"), F.col("v").alias("p")))


_MODELS = "e as (select vec_id as motif, unnest(range(0, len(embedding))) as i, unnest(list_transform(embedding, lambda x: abs(x::double))) as v from embeddings), m as (select motif, (i // 4)::int as col, substring('ACGT', (i % 4 + 1)::bigint, 1) as base, v / sum(v) over (partition by motif, i // 4) as p from e)"


@query(f"with {_MODELS} select motif, col, round(sum(case when p > 0 then p * log2(p / 0.25e0) else 0 end), 6) as ic, round(-sum(case when p > 0 then p * log2(p) else 0 end), 6) as entropy from m group by motif, col")
def pwm_information(spark, sf_dir):
    return report.information(pseudo_models(spark, sf_dir)).select("motif", "col", F.round("ic", 6).alias("ic"), F.round("entropy", 6).alias("entropy"))


@query(f"with {_MODELS} select motif, col, base, round(log2(p / 0.25e0), 6) as log_odds, round(p / max(p) over (partition by motif, col), 6) as affinity from m where p > 0")
def pwm_log_odds(spark, sf_dir):
    out = report.log_odds(pseudo_models(spark, sf_dir))
    return out.where("p > 0").select("motif", "col", "base", F.round("log_odds", 6).alias("log_odds"), F.round("affinity", 6).alias("affinity"))


@query(
    f"with {_MODELS}, r as (select *, row_number() over (partition by motif, col order by p desc, base) as n from m), "
    "w as (select motif, col, max(case when n = 1 then p end) p1, max(case when n = 2 then p end) p2, max(case when n = 4 then p end) p4, max(case when n = 1 then base end) b1, max(case when n = 2 then base end) b2, max(case when n = 4 then base end) b4 from r group by motif, col), "
    "x as (select motif, col, case when p1 > 0.5 and p1 >= 2 * p2 then b1 when p1 + p2 > 0.75 then case least(b1, b2) || greatest(b1, b2) when 'AT' then 'W' when 'CG' then 'S' when 'AC' then 'M' when 'GT' then 'K' when 'AG' then 'R' else 'Y' end "
    "when p4 < 0.01 then case b4 when 'A' then 'B' when 'C' then 'D' when 'G' then 'H' else 'V' end else 'N' end as c from w) select motif, string_agg(c, '' order by col) as consensus from x group by motif"
)
def consensus_iupac(spark, sf_dir):
    return report.consensus(pseudo_models(spark, sf_dir))


@query(f"with {_MODELS}, x as (select motif, col, max(p) as p from m group by motif, col) select motif, round(exp(sum(ln(p))), 9) as max_probability, round(sum(log2(p / 0.25e0)), 6) as max_score from x group by motif")
def pwm_maximum(spark, sf_dir):
    out = report.maximum(pseudo_models(spark, sf_dir))
    return out.select("motif", F.round("max_probability", 9).alias("max_probability"), F.round("max_score", 6).alias("max_score"))


@query(f"with {_MODELS} select a.motif, round(max(abs(a.p - b.p)), 6) as distance from m a join m b on b.motif = a.motif + 1 and a.col = b.col and a.base = b.base group by a.motif")
def model_distances(spark, sf_dir):
    m = pseudo_models(spark, sf_dir)
    after = m.select((F.col("motif") - 1).alias("motif"), "col", "base", F.col("p").alias("q"))
    return m.join(after, ["motif", "col", "base"]).groupBy("motif").agg(F.round(F.max(F.abs(F.col("p") - F.col("q"))), 6).alias("distance"))


_Q = "q as (select substring(seq, pos, 1) as base, count(*)::double / sum(count(*)) over () as q from reads, unnest(range(1, length(seq) + 1)) t(pos) group by 1)"
_EM = (
    f"with {READS}, {_Q}, ppm as (select * from (values {_PPM}) v(col, base, p)), r as (select col, base, p / q as ratio from ppm join q using (base)), "
    f"f as (select read_id, pos, substring(seq, pos, 9) as kmer from reads, unnest(range(1, length(seq) - 7)) t(pos)), "
    f"w as (select read_id, 0 as strand, pos, kmer from f union all select read_id, 1, pos, {RC.format('kmer')} from f), "
    f"b as (select w.*, j as col, substring(kmer, (j + 1)::bigint, 1) as base from w, unnest(range(0, 9)) t(j)), "
    # on the reverse strand a base stands for its complement's background
    "rr as (select 0 as strand, col, base, ratio from r union all select 1, p.col, p.base, p.p / q.q from ppm p join q on q.base = translate(p.base, 'ACGT', 'TGCA')), "
    "u as (select read_id, b.strand, pos, kmer, exp(sum(ln(ratio))) * 0.5e0 / 24 as u from b join rr on rr.col = b.col and rr.base = b.base and rr.strand = b.strand group by 1, 2, 3, 4), "
    "z as (select *, u / (0.5e0 + sum(u) over (partition by read_id)) as z from u)"
)


def _one_round(spark, sf_dir, radius=2, gate=True):
    import numpy as np

    r = reads(spark, sf_dir)
    q = {x["base"]: x["q"] for x in C.background(r).collect()}
    cfg = em.Config(radius=radius, gate=gate)
    state = em.State([em.tensor(np.array(_PROB))], [SEED], [0.5], np.array([q[b] for b in "ACGT"]))
    return r, cfg, state


@query(f"{_EM}, h as (select *, {_hd(SEED)} as hd from z), c as (" + " union all ".join(f"select {j} as col, substring(kmer, {j + 1}, 1) as base, z from h where hd < 2 or (hd = 2 and substring(kmer, {j + 1}, 1) <> '{c}')" for j, c in enumerate(SEED)) + ") select col, base, round(sum(z), 4) as n from c group by col, base")
def em_round1(spark, sf_dir):
    r, cfg, state = _one_round(spark, sf_dir)
    kernel, sums = em.expectation(r, state, cfg)
    n = kernel.get(sums, "counts", "m", 0)[0].sum(0)
    return spark.createDataFrame([(j, b, round(float(n[i, j]), 4)) for i, b in enumerate("ACGT") for j in range(9) if n[i, j] > 0], "col int, base string, n double")


@query(f"{_EM} select round(sum(z) / (select count(*) from reads), 8) as weight from z")
def em_lambda(spark, sf_dir):
    r, cfg, state = _one_round(spark, sf_dir)
    kernel, sums = em.expectation(r, state, cfg)
    return spark.createDataFrame([(round(float(kernel.get(sums, "lambda", "m", 0)[0] / kernel.get(sums, "n")[0]), 8),)], "weight double")


@query(f"{_EM}, s as (select strand, pos, sum(z) as z from z group by 1, 2) select 0 as motif, strand, pos::int as pos, round(z / sum(z) over (), 7) as p from s")
def em_start_positions(spark, sf_dir):
    r, cfg, state = _one_round(spark, sf_dir)
    out = C.start_positions(em.site_posteriors(r, state, cfg))
    return out.withColumn("p", F.round("p", 7))


@query(
    f"{_EM}, t as (select read_id, log2(0.5e0 + sum(u)) as l from u group by 1), g as (select sum(log2(q)) as l from reads, unnest(range(1, length(seq) + 1)) t(pos) join q on base = substring(seq, pos, 1)) "
    "select round((select sum(l) from t) + (select l from g), 3) as ll"
)
def log_likelihood(spark, sf_dir):
    r, cfg, state = _one_round(spark, sf_dir)
    kernel, sums = em.expectation(r, state, cfg)
    return spark.createDataFrame([(round(float(kernel.get(sums, "ll")[0]), 3),)], "ll double")


@query(f"{_EM}, t as (select read_id from z group by 1 having sum(z) < 1 - sum(z)) select read_id, seq from reads join t using (read_id)")
def unbound_reads(spark, sf_dir):
    r, cfg, state = _one_round(spark, sf_dir)
    return em.unbound(r, state, cfg)


@query()
def em_fit(spark, sf_dir):
    """The whole fit, iterative: its history, a row a round."""
    result = em.fit(reads(spark, sf_dir), [SEED], em.Config())
    return report.history(spark, result)


@query()
def em_fit_adm(spark, sf_dir):
    result = em.fit(reads(spark, sf_dir), [SEED], em.Config(model="adm-fixed"))
    return report.models(spark, result.state, em.Config(model="adm-fixed"))


@query()
def em_fit_pairs(spark, sf_dir):
    """Pairs of a motif with itself: the table of dimer weights by orientation and distance."""
    cfg = em.Config(cob=((0, 0),))
    result = em.fit(reads(spark, sf_dir), ["GCCTGA"], cfg)
    return report.cob_table(spark, result.state)


@query(
    f"with a as (select * from (values {_PPM}) v(col, base, p)), x as (select col, base, p from a union all select col + 7, base, p from a), "
    "y as (select c.col, b.base, exp(sum(ln(p))) * pow(0.25e0, 2 - count(*)) as p from (select distinct col from x) c cross join (values ('A'), ('C'), ('G'), ('T')) b(base) join x on x.col = c.col and x.base = b.base group by 1, 2) "
    "select col::int as col, base, round(p / sum(p) over (partition by col), 6) as p from y"
)
def cob_expected(spark, sf_dir):
    import numpy as np

    m = M.product(np.array(_PROB), np.array(_PROB), -2)
    return spark.createDataFrame([(j, b, round(float(m[i, j]), 6)) for i, b in enumerate("ACGT") for j in range(m.shape[1])], "col int, base string, p double")
