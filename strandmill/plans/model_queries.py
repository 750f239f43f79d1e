"""Registered queries of models, readers, probabilities and whole EM rounds, with the SQL they are checked against."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import adm as A
from strandmill.functions import alphabet, likelihood
from strandmill.functions import matrix as M
from strandmill.functions import sequence as S
from strandmill.operators import counts as C
from strandmill.operators import huddinge
from strandmill.operators import windows as W
from strandmill.plans import em, report
from strandmill.plans.queries import _EM, _HEX, _MODELS, _PPM, _PROB, _Q, _SEED6, FEW, RC, READS, SEED, _gated, _hd, _hits, _windows, few_reads, pseudo_models, query, reads
from strandmill.sources import readers, writers
from strandmill.storage import new_path

BASES = "ACGT"

# files


def _written(df: DataFrame, name: str) -> str:
    """A text file of the column value in the shared folder."""
    path = f"{new_path(df.sparkSession, 'files')}.{name}"
    df.write.text(path)
    return path


def _odd(seq) -> F.Column:
    """Reads as a file may have them: some in small letters, some with a blank at the end, some with a letter that isn't a base."""
    k = F.col("read_id") % 5
    return F.when(k == 1, F.lower(seq)).when(k == 2, F.concat(seq, F.lit(" "))).when(k == 3, F.concat(F.lit("X"), seq)).otherwise(seq)


@query(f"with {READS} select seq, count(*) as n from reads where read_id % 5 <> 3 group by seq")
def read_lines(spark, sf_dir):
    path = _written(reads(spark, sf_dir).select(_odd(F.col("seq")).alias("value")), "seq")
    return readers.read_lines(spark, path).groupBy("seq").agg(F.count("*").alias("n"))


@query(f"with {READS} select count(*)::int as bad from reads where read_id % 5 = 3")
def read_lines_skipped(spark, sf_dir):
    path = _written(reads(spark, sf_dir).select(_odd(F.col("seq")).alias("value")), "seq")
    return spark.createDataFrame([(readers.bad_lines(spark, path),)], "bad int")


@query(f"with {READS} select seq, count(*) as n from reads where read_id % 5 <> 3 group by seq")
def read_fasta(spark, sf_dir):
    """Records of two lines of sequence; those with an invalid line are dropped."""
    s = F.col("seq")
    two = F.concat_ws("\n", F.concat(F.lit(">r"), "read_id"), F.substring(s, 1, 12), F.when(F.col("read_id") % 5 == 3, "X1").otherwise(F.lower(F.substring(s, 13, 100))))
    path = _written(reads(spark, sf_dir).select(two.alias("value")), "fasta")
    return readers.read_reads(spark, path).groupBy("seq").agg(F.count("*").alias("n"))


@query(f"with {READS} select seq, count(*) as n from reads where read_id % 7 <> 2 group by seq")
def read_fastq(spark, sf_dir):
    """Blocks of four lines; reads with an ambiguous base are skipped."""
    s = F.when(F.col("read_id") % 7 == 2, F.concat(F.lit("N"), "seq")).otherwise(F.col("seq"))
    four = F.concat_ws("\n", F.concat(F.lit("@r"), "read_id"), s, F.lit("+"), F.repeat(F.lit("I"), F.length(s)))
    path = _written(reads(spark, sf_dir).select(four.alias("value")), "fastq")
    return readers.read_reads(spark, path).groupBy("seq").agg(F.count("*").alias("n"))


@query(f"with {READS} select read_id, seq from reads")
def read_parquet(spark, sf_dir):
    path = f"{new_path(spark, 'files')}.parquet"
    reads(spark, sf_dir).write.parquet(path)
    return readers.read_reads(spark, path)


def _matrix_of(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The model of the smallest vec_id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").select("embedding").first()["embedding"]
    return M.normalize_columns(np.abs(np.array(e, float)).reshape(-1, 4).T)


def _cells(spark: SparkSession, m: np.ndarray, digits: int = 6) -> DataFrame:
    return spark.createDataFrame([(j, BASES[i], round(float(m[i, j]), digits)) for i in range(4) for j in range(m.shape[1])], "col int, base string, p double")


@query(f"with {_MODELS} select col, base, round(p, 6) as p from m where motif = (select min(vec_id) from embeddings)")
def matrix_file(spark, sf_dir):
    path = new_path(spark, "model") + ".pfm"
    writers.write_bytes(spark, path, writers.matrix_text(_matrix_of(spark, sf_dir), 9).encode())
    return _cells(spark, readers.read_matrix(spark, path))


# order-one models: the first four numbers of a vector are the first column, each following 16 the transitions to one

K = 4
_ADM = (
    f"e as (select vec_id as motif, unnest(range(0, {4 + 16 * (K - 1)})) as i, unnest(list_transform(embedding[1:{4 + 16 * (K - 1)}], lambda x: abs(x::double))) as v from embeddings), "
    "c as (select motif, v, case when i < 4 then 0 else 1 + (i - 4) // 16 end::int as col, case when i < 4 then null else substring('ACGT', ((i - 4) % 16 // 4 + 1)::bigint, 1) end as prev, "
    "substring('ACGT', (i % 4 + 1)::bigint, 1) as base from e), "
    "t as (select motif, col, prev, base, v / sum(v) over (partition by motif, col, prev) as p from c), "
    "ip0 as (select motif, base, p from t where col = 0), "
    + ", ".join(f"ip{j} as (select t.motif, t.base, sum(a.p * t.p) as p from ip{j - 1} a join t on t.motif = a.motif and t.prev = a.base and t.col = {j} group by 1, 2)" for j in range(1, K))
    + ", ip as (" + " union all ".join(f"select motif, {j} as col, base, p from ip{j}" for j in range(K)) + ")"
)


def adm_of(x) -> A.Adm:
    v = np.abs(np.asarray(x, float)[: 4 + 16 * (K - 1)])
    counts = np.zeros((4, 4, K))
    counts[0, :, 0] = v[:4]
    counts[:, :, 1:] = v[4:].reshape(K - 1, 4, 4).transpose(1, 2, 0)
    return A.Adm.from_counts(counts)


def _per_adm(spark: SparkSession, sf_dir: str, rows_of: Callable[..., list[tuple]], schema: str, following: bool = False) -> DataFrame:
    """``rows_of(motif, model)`` of each vector's model; with ``following`` also that of the next vec_id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    if following:
        e = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                rows += rows_of(row[0], *map(adm_of, row[1:]))
            yield pd.DataFrame(rows, columns=names)

    return e.mapInPandas(run, schema)


def _marginals(motif: int, m: A.Adm, *key) -> list[tuple]:
    return [(motif, *key, j, BASES[b], round(float(m.ip[b, j]), 6)) for j in range(m.k) for b in range(4)]


def _transitions(motif: int, m: A.Adm) -> list[tuple]:
    return [(motif, j, BASES[a] if j else None, BASES[b], round(float(m.t[a, b, j]), 6)) for j in range(m.k) for a in range(4 if j else 1) for b in range(4)]


@query(f"with {_ADM} select motif, col, base, round(p, 6) as p from ip")
def adm_marginals(spark, sf_dir):
    return _per_adm(spark, sf_dir, _marginals, "motif long, col int, base string, p double")


@query(f"with {_ADM} select motif, col, prev, base, round(p, 6) as p from t")
def adm_transitions(spark, sf_dir):
    return _per_adm(spark, sf_dir, _transitions, "motif long, col int, prev string, base string, p double")


@query(
    f"with {_ADM}, a as (select t.motif, t.col, case when t.col = 0 then 1e0 else ip.p end as w, t.p from t left join ip on ip.motif = t.motif and ip.col = t.col - 1 and ip.base = t.prev) "
    "select motif, col, round(sum(case when p > 0 then w * p * log2(p / 0.25e0) else 0 end), 6) as ic from a group by 1, 2"
)
def adm_information(spark, sf_dir):
    return _per_adm(spark, sf_dir, lambda motif, m: [(motif, j, round(float(x), 6)) for j, x in enumerate(m.information_content())], "motif long, col int, ic double")


def _string_of(motif: int) -> str:
    import hashlib

    return hashlib.md5(str(motif).encode()).hexdigest().translate(str.maketrans(_HEX, BASES * 4))[:K]


_STRING = f"s as (select vec_id as motif, substring(translate(md5(cast(vec_id as varchar)), '{_HEX}', '{BASES * 4}'), 1, {K}) as s from embeddings)"


@query(
    f"with {_ADM}, {_STRING}, x as (select s.motif, s, exp(sum(ln(p))) as p from s join t on t.motif = s.motif and t.base = substring(s, t.col + 1, 1) and (t.col = 0 or t.prev = substring(s, t.col, 1)) group by 1, 2) "
    f"select motif, s, round(p, 9) as p, round(log2(p), 6) as log_p, round(log2(p) + {2 * K}, 6) as score from x"
)
def adm_scores(spark, sf_dir):
    def rows(motif: int, m: A.Adm) -> list[tuple]:
        s = _string_of(motif)
        return [(motif, s, round(m.probability(s), 9), round(m.log_probability(s), 6), round(m.score(s), 6))]

    return _per_adm(spark, sf_dir, rows, "motif long, s string, p double, log_p double, score double")


@query(
    f"with {_ADM}, j as (select t.motif, t.col, t.prev, t.base, t.p as t, ip.p as back from t join ip on ip.motif = t.motif and ip.col = t.col and ip.base = t.base where t.col > 0), "
    f"x as (select j.motif, {K} - j.col as col, translate(j.base, 'ACGT', 'TGCA') as prev, translate(j.prev, 'ACGT', 'TGCA') as base, j.t * a.p / back as p from j join ip a on a.motif = j.motif and a.col = j.col - 1 and a.base = j.prev "
    f"union all select motif, 0, null, translate(base, 'ACGT', 'TGCA'), p from ip where col = {K - 1}) select motif, col::int as col, prev, base, round(p, 6) as p from x"
)
def adm_reverse_complement(spark, sf_dir):
    return _per_adm(spark, sf_dir, lambda motif, m: _transitions(motif, m.reverse_complement()), "motif long, col int, prev string, base string, p double")


_FLAT = "(select distinct motif from ip) cross join (values ('A'), ('C'), ('G'), ('T')) b(base)"


@query(
    f"with {_ADM}, x as (select motif, 'cut' as kind, col - 1 as col, base, p from ip where col in (1, 2) union all select motif, 'right', col, base, p from ip union all select motif, 'right', {K}, base, 0.25e0 from {_FLAT} "
    f"union all select motif, 'left', col + 1, base, p from ip union all select motif, 'left', 0, base, 0.25e0 from {_FLAT} union all select motif, 'join', col, base, p from ip union all select motif, 'join', col + {K}, base, p from ip) "
    "select motif, kind, col::int as col, base, round(p, 6) as p from x"
)
def adm_edits(spark, sf_dir):
    def rows(motif: int, m: A.Adm) -> list[tuple]:
        return [r for kind, x in (("cut", m.cut(1, 2)), ("right", m.extend_right(1)), ("left", m.extend_left(1)), ("join", m.join(m))) for r in _marginals(motif, x, kind)]

    return _per_adm(spark, sf_dir, rows, "motif long, kind string, col int, base string, p double")


@query(
    f"with {_ADM}, f as (select t.motif, t.col, t.prev, t.base, t.p * case when t.col = 0 then 1 else ip.p end as x from t left join ip on ip.motif = t.motif and ip.col = t.col and ip.base = t.prev) "
    "select a.motif, round(max(abs(a.x - b.x)), 6) as distance from f a join f b on b.motif = a.motif + 1 and a.col = b.col and a.prev is not distinct from b.prev and a.base = b.base group by 1"
)
def adm_distances(spark, sf_dir):
    return _per_adm(spark, sf_dir, lambda motif, m, n: [(motif, round(m.distance(n), 6))], "motif long, distance double", True)


_WIDTH = 2 * K - 2


def _product_sql() -> str:
    """Chained CTEs: the product's unnormalised transitions, then a backward pass of row sums."""
    one = "select motif, {shift} + col as col, prev, base, p from t"
    pairs = "(select distinct motif from t) cross join (values ('A'), ('C'), ('G'), ('T')) x(prev) cross join (values ('A'), ('C'), ('G'), ('T')) y(base)"
    first = "select motif, {col} as col, x.prev, t.base, p from t cross join (values ('A'), ('C'), ('G'), ('T')) x(prev) where col = 0"
    left = f"l as (select motif, col, prev, base, p from t where col > 0 union all {first.format(col=0)} union all " + " union all ".join(f"select motif, {j}, x.prev, y.base, 0.25e0 from {pairs}" for j in range(K, _WIDTH)) + ")"
    right = f"r as (select motif - 1 as motif, col, prev, base, p from ({one.format(shift=_WIDTH - K)} where col > 0 union all {first.format(col=_WIDTH - K)} union all " + " union all ".join(f"select motif, {j}, x.prev, y.base, 0.25e0 from {pairs}" for j in range(_WIDTH - K)) + "))"
    out = [_ADM, left, right, "w as (select l.motif, l.col, l.prev, l.base, l.p * r.p as p from l join r on l.motif = r.motif and l.col = r.col and l.prev = r.prev and l.base = r.base)"]
    out.append(f"s{_WIDTH} as (select distinct motif, base as prev, 1e0 as s from w)")
    for j in range(_WIDTH - 1, -1, -1):
        out.append(f"u{j} as (select w.motif, w.col, w.prev, w.base, w.p * s.s as p from w join s{j + 1} s on s.motif = w.motif and s.prev = w.base where w.col = {j})")
        out.append(f"s{j} as (select motif, prev, sum(p) as s from u{j} group by 1, 2)")
    every = " union all ".join(f"select u.motif, u.col, u.prev, u.base, u.p / s.s as p from u{j} u join s{j} s on s.motif = u.motif and s.prev = u.prev" + (" where u.prev = 'A'" if j == 0 else "") for j in range(_WIDTH))
    return f"with {', '.join(out)} select motif, col::int as col, case when col = 0 then null else prev end as prev, base, round(p, 6) as p from ({every})"


@query(_product_sql())
def adm_products(spark, sf_dir):
    """Two models that overlap by two columns as one, renormalised over whole strings."""
    return _per_adm(spark, sf_dir, lambda motif, m, n: _transitions(motif, A.product(m, n, -2)), "motif long, col int, prev string, base string, p double", True)


@query(
    f"with {_ADM}, g as (select a.base || b.base || c.base || d.base as s from (values ('A'), ('C'), ('G'), ('T')) a(base), (values ('A'), ('C'), ('G'), ('T')) b(base), "
    "(values ('A'), ('C'), ('G'), ('T')) c(base), (values ('A'), ('C'), ('G'), ('T')) d(base)), "
    "x as (select motif, g.s, exp(sum(ln(p))) as p from g join t on t.base = substring(g.s, t.col + 1, 1) and (t.col = 0 or t.prev = substring(g.s, t.col, 1)) group by 1, 2) "
    "select motif, arg_max(s, p) as best, round(max(p), 9) as p from x group by 1"
)
def adm_best_strings(spark, sf_dir):
    """The likeliest string of each model."""

    def rows(motif: int, m: A.Adm) -> list[tuple]:
        s = m.best_string(False)
        return [(motif, s, round(m.probability(s), 9))]

    return _per_adm(spark, sf_dir, rows, "motif long, best string, p double")


@query(f"with {_MODELS} select motif, col, null::varchar as prev, base, round(p, 6) as p, round(sum(case when p > 0 then p * log2(p / 0.25e0) else 0 end) over (partition by motif, col), 6) as ic from m where col < {K}")
def adm_of_ppm(spark, sf_dir):
    """Order-zero models as order-one models: marginals and information stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for motif, x in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                m = A.Adm.from_ppm(M.normalize_columns(np.abs(np.asarray(x, float)[: 4 * K]).reshape(-1, 4).T))
                ic = m.information_content()
                rows += [(motif, j, None, BASES[b], round(float(m.ip[b, j]), 6), round(float(ic[j]), 6)) for j in range(K) for b in range(4)]
            yield pd.DataFrame(rows, columns=["motif", "col", "prev", "base", "p", "ic"])

    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").mapInPandas(run, "motif long, col int, prev string, base string, p double, ic double")


_LEARNED = f"{_hits(SEED, 2)}, {_gated(SEED, 2, 'h')}, d as (select col, prev, base, count(*)::double as n from c group by 1, 2, 3)"


def _learned(spark: SparkSession, sf_dir: str) -> A.Adm:
    counts = np.zeros((4, 4, len(SEED)))
    for r in C.dinucleotide_counts(W.seed_hits(reads(spark, sf_dir), SEED, 2, True), SEED, 2).collect():  # a cell a row
        counts[BASES.index(r["prev"] or "A"), BASES.index(r["base"]), r["col"]] = r["n"]
    return A.Adm.from_counts(counts)


def _adm_table(spark: SparkSession, m: A.Adm) -> DataFrame:
    rows = [r[1:] for r in _transitions(0, m) if r[4] > 0]
    return spark.createDataFrame(rows, "col int, prev string, base string, p double")


@query(f"{_LEARNED} select col, prev, base, round(n / sum(n) over (partition by col, prev), 6) as p from d")
def adm_learned(spark, sf_dir):
    return _adm_table(spark, _learned(spark, sf_dir))


@query(f"{_LEARNED}, x as (select col, prev, base, round(n / sum(n) over (partition by col, prev), 6) as r from d) select col, prev, base, round(r / sum(r) over (partition by col, prev), 6) as p from x where r > 0")
def adm_file(spark, sf_dir):
    """The learned model, written to a file and read back. Marginals are written with the transitions."""
    path = new_path(spark, "model") + ".adm"
    writers.write_bytes(spark, path, writers.adm_text(_learned(spark, sf_dir)).encode())
    return _adm_table(spark, readers.read_adm(spark, path))


# functions on sequences


@query(f"with {READS}, x as (select read_id, substring(seq, 1, 4) || 'N' || substring(seq, 6, 6) as s from reads) select read_id, list_reduce(list_transform(range(1, 12), lambda i: (strpos('ACGTN', substring(s, i, 1)) - 1)::bigint), lambda a, b: a * 5 + b) as code, s as decoded from x")
def sequence_codes_with_gaps(spark, sf_dir):
    s = F.concat(F.substring("seq", 1, 4), F.lit("N"), F.substring("seq", 6, 6))
    code = S.number_of(s, 5)
    return reads(spark, sf_dir).select("read_id", code.alias("code"), S.sequence_of(code, 11, 5).alias("decoded"))


@query(
    f"with {READS}, x as (select read_id, case read_id % 4 when 0 then seq when 1 then replace(seq, 'CC', 'NN') when 2 then replace(seq, 'T', 'U') else 'RX' || seq end as s from reads) "
    "select read_id, regexp_full_match(s, '[ACGT]+') as dna, regexp_full_match(s, '[ACGU]+') as rna, regexp_full_match(s, '[ACGTUWSMKRYBDHVN]+') as iupac, (length(s) - length(replace(s, 'N', '')))::int as gaps, "
    "case when not regexp_matches(s, '^N|N$') then regexp_full_match(s, '[^N]+(N+[^N]+)?') end as one_gap from x"
)
def alphabet_predicates(spark, sf_dir):
    k, seq = F.col("read_id") % 4, F.col("seq")
    s = F.when(k == 0, seq).when(k == 1, F.replace(seq, F.lit("CC"), F.lit("NN"))).when(k == 2, F.replace(seq, F.lit("T"), F.lit("U"))).otherwise(F.concat(F.lit("RX"), seq))
    return reads(spark, sf_dir).select(
        "read_id", S.is_nucleotide(s).alias("dna"), S.is_nucleotide(s, True).alias("rna"), S.is_iupac(s).alias("iupac"), S.gap_count(s).alias("gaps"), S.at_most_one_gap(s).alias("one_gap")
    )


_MASKS = "map {'A': 8, 'C': 4, 'G': 2, 'T': 1, 'R': 10, 'Y': 5, 'S': 6, 'W': 9, 'N': 15}"


@query(
    f"with {READS}, x as (select read_id, substring(seq, 1, 8) as a, translate(substring(seq, 9, 8), 'ACGT', 'RYSW') as b, {_MASKS} as m from reads) "
    "select read_id, round(list_sum(list_transform(range(1, 9), lambda i: 1e0 - bit_count(m[substring(a, i, 1)] & m[substring(b, i, 1)]) / bit_count(m[substring(a, i, 1)] | m[substring(b, i, 1)])::double)), 6) as distance from x"
)
def class_distances(spark, sf_dir):
    a, b = F.substring("seq", 1, 8), F.translate(F.substring("seq", 9, 8), "ACGT", "RYSW")
    return reads(spark, sf_dir).select("read_id", F.round(S.jaccard_hamming(a, b, 8), 6).alias("distance"))


_CODE40 = "list_reduce(list_transform(range(1, 21), lambda i: (strpos('ACGT', substring(seq, i, 1)) - 1)::bigint), lambda a, b: a * 4 + b)"


@query(
    f"with {READS}, c as (select read_id, {_CODE40} as c from reads), x as (select *, lpad(bin(c), 40, '0') as b from c) "
    "select read_id, length(regexp_extract(b, '1*$'))::int as low_ones, length(regexp_extract(b, '^1*'))::int as high_ones, bit_count((c >> 4) & 255)::int as inner_ones from x"
)
def bit_functions(spark, sf_dir):
    c = S.number_of(F.col("seq"))
    return reads(spark, sf_dir).select("read_id", S.trailing_ones(c).alias("low_ones"), S.leading_ones(c, 40).alias("high_ones"), S.bits_in_range(c, 4, 12).alias("inner_ones"))


_STRINGS6 = "g as (select " + " || ".join(f"b{i}.b" for i in range(6)) + " as pattern from " + ", ".join(f"(values ('A'), ('C'), ('G'), ('T')) b{i}(b)" for i in range(6)) + ")"


@query(
    f"{_windows(6, True, False)}, n as (select kmer, count(*) as n from w group by 1), {_STRINGS6}, h as (select pattern, {_hd(_SEED6, 'pattern')} as hd from g where {_hd(_SEED6, 'pattern')} <= 2) "
    "select pattern, hd, array_to_string(list_filter(range(0, 6), lambda i: hd < 2 or substring(pattern, i + 1, 1) <> substring('" + _SEED6 + f"', i + 1, 1)), ',') as cols, pattern = {RC.format('pattern')} as palindrome, coalesce(n, 0) as n from h left join n on kmer = pattern"
)
def neighbourhood_columns(spark, sf_dir):
    """The strings near a seed, the columns they count for, and how often each occurs."""
    table = W.neighbourhood_table(spark, _SEED6, 2)
    n = W.locate(reads(spark, sf_dir), table.select("pattern"), 6, True).groupBy(F.col("kmer").alias("pattern")).agg(F.count("*").alias("n"))
    return table.join(n, "pattern", "left").select("pattern", "hd", F.array_join(F.transform("cols", lambda x: x.cast("string")), ",").alias("cols"), "palindrome", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"with {READS}, x as (select read_id % 15 as i, count(*) as n from reads group by 1) select substring('{alphabet.FROM}', (i + 1)::bigint, 1) as c, n, b.bases, b.others, round(1e0 / length(b.bases), 6) as p from x join "
    "(values ('A', 'A', 'CGT'), ('C', 'C', 'AGT'), ('G', 'G', 'ACT'), ('T', 'T', 'ACG'), ('W', 'AT', 'CG'), ('S', 'CG', 'AT'), ('M', 'AC', 'GT'), ('K', 'GT', 'AC'), ('R', 'AG', 'CT'), ('Y', 'CT', 'AG'), "
    "('B', 'CGT', 'A'), ('D', 'AGT', 'C'), ('H', 'ACT', 'G'), ('V', 'ACG', 'T'), ('N', 'ACGT', '')) b(c, bases, others) on b.c = substring('" + alphabet.FROM + "', (i + 1)::bigint, 1)"
)
def base_classes(spark, sf_dir):
    rows = [(c, alphabet.bases_of(c), alphabet.complement_set(c), round(max(alphabet.class_probability(c).values()), 6)) for c in alphabet.FROM]
    c = F.substring(F.lit(alphabet.FROM), (F.col("read_id") % 15 + 1).cast("int"), F.lit(1))
    n = reads(spark, sf_dir).groupBy(c.alias("c")).agg(F.count("*").alias("n"))
    return n.join(spark.createDataFrame(rows, "c string, bases string, others string, p double"), "c")


def _either(x: str, y: str) -> str:
    return (
        f"case when {x} = {y} then {x} else case least({x}, {y}) || greatest({x}, {y}) when 'AT' then 'W' when 'CG' then 'S' when 'AC' then 'M' when 'GT' then 'K' when 'AG' then 'R' else 'Y' end end"
    )


def _char(s: str, i: int) -> str:
    return f"substring({s}, {i}, 1)"


@query(
    f"with {READS}, x as (select read_id, substring(seq, 1, 6) as a, substring(seq, 7, 6) as b from reads) select read_id, substring(a, 1, 4) || 'NN' || substring(b, 3) as open, "
    f"substring(a, 1, 4) || {_either(_char('a', 5), _char('b', 1))} || {_either(_char('a', 6), _char('b', 2))} || substring(b, 3) as wide, "
    f"substring(a, 1, 4) || case when {_char('a', 5)} = {_char('b', 1)} then {_char('a', 5)} else 'N' end || case when {_char('a', 6)} = {_char('b', 2)} then {_char('a', 6)} else 'N' end || substring(b, 3) as narrow from x"
)
def combined_seeds(spark, sf_dir):
    """Halves that overlap by two columns, in the three ways."""

    def rows(read_id: int, s: str) -> list[tuple]:
        return [(read_id, *(alphabet.combine_overlap(s[:6], s[6:12], -2, how) for how in ("N", "or", "and")))]

    return _per_read(reads(spark, sf_dir), rows, "read_id long, open string, wide string, narrow string")


def _per_read(r: DataFrame, rows_of: Callable[..., list[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for row in pdf.itertuples(index=False) for x in rows_of(*row)], columns=names)

    return r.select("read_id", "seq").mapInPandas(run, schema)


@query(
    f"{_windows(10, True, False)}, c as (select substring(kmer, 5, 2) as part, count(*) as n from w where substring(kmer, 1, 4) = 'GCCT' and substring(kmer, 7, 4) = 'GGCA' group by 1) "
    "select 'GCCT' || part || 'GGCA' as kmer, n from c order by n desc, part desc limit 1"
)
def overlapping_seeds(spark, sf_dir):
    """The seed of two halves that overlap."""
    return W.overlapping_seed(reads(spark, sf_dir), "GCCTGA", "GAGGCA", -2, two_strands=True)


@query(f"{_windows(6, True, False)}, h as (select *, {_hd('GCATGC')} as hd from w where {_hd('GCATGC')} <= 2), {_gated('GCATGC', 2, 'h')} select 0 as r, col, prev, base, count(*) as n from c group by col, prev, base")
def scanned_counts(spark, sf_dir):
    """By scanning: a palindromic site counts on both strands."""
    return C.dinucleotide_counts(W.seed_hits(reads(spark, sf_dir), "GCATGC", 2, True, True), "GCATGC", 2)


_PAIRS6 = f"s as (select pattern as kmer, {_hd(_SEED6, 'pattern')} as hd from g where {_hd(_SEED6, 'pattern')} <= 2)"


@query(
    f"with {READS}, {_Q}, {_STRINGS6}, {_PAIRS6}, p as (select kmer, hd, exp(sum(ln(q))) as p from s, unnest(range(1, 7)) t(i) join q on base = substring(kmer, i::bigint, 1) group by kmer, hd), c as ("
    + " union all ".join(f"select {j} as col, {f'substring(kmer, {j}, 1)' if j else 'null'} as prev, substring(kmer, {j + 1}, 1) as base, p from p where hd < 2 or (hd = 2 and substring(kmer, {j + 1}, 1) <> '{c}')" for j, c in enumerate(_SEED6))
    + ") select col, prev, base, round(sum(p) * (select sum(greatest(length(seq) - 5, 0)) * 2 from reads), 4) as n from c group by 1, 2, 3"
)
def expected_dinucleotide_counts(spark, sf_dir):
    r = reads(spark, sf_dir)
    q = _background(r)
    n = r.agg(F.sum(F.greatest(F.length("seq") - 5, F.lit(0)))).first()[0]
    m = A.expected_background_counts(_SEED6, 2, 2 * n, q)
    rows = [(j, BASES[a] if j else None, BASES[b], round(float(m[a, b, j]), 4)) for j in range(6) for a in range(4 if j else 1) for b in range(4) if m[a, b, j] > 0]
    return spark.createDataFrame(rows, "col int, prev string, base string, n double")


def _background(r: DataFrame) -> list[float]:
    q = {x["base"]: x["q"] for x in C.background(r).collect()}
    return [q[b] for b in BASES]


# probabilities

_LOGQ = f"with {READS}, {_Q}, ppm as (select * from (values {_PPM}) v(col, base, p)), b as (select read_id, pos, substring(seq, pos, 1) as base from reads, unnest(range(1, length(seq) + 1)) t(pos)), l as (select b.*, log2(q) as lq from b join q using (base))"


@query(
    f"{_LOGQ} select l.read_id, s.strand, round(sum(case when pos between 7 and 15 then log2(p) else lq end), 6) as log_p from l cross join (values (0), (1)) s(strand) "
    "left join ppm on ppm.col = case when strand = 0 then pos - 7 else 15 - pos end and ppm.base = case when strand = 0 then l.base else translate(l.base, 'ACGT', 'TGCA') end group by 1, 2"
)
def site_likelihoods(spark, sf_dir):
    """Reads with a site after the sixth base, on either strand."""
    r, m = reads(spark, sf_dir), np.array(_PROB)
    q = _background(r)
    return _per_read(r, lambda i, s: [(i, k, round(likelihood.log_probability(s, m, 6, k, q), 6)) for k in (0, 1)], "read_id long, strand int, log_p double")


@query(f"{_LOGQ} select l.read_id, round(sum(case when pos between 3 and 6 or pos between 9 and 13 then log2(p) else lq end), 6) as log_p from l left join ppm on ppm.base = l.base and ppm.col = case when pos between 3 and 6 then pos - 3 when pos between 9 and 13 then pos - 5 end group by 1")
def pair_likelihoods(spark, sf_dir):
    """Reads with two half-sites, two bases apart."""
    r, m = reads(spark, sf_dir), np.array(_PROB)
    q = _background(r)
    return _per_read(r, lambda i, s: [(i, round(likelihood.log_pair_probability(s, m[:, :4], m[:, 4:], 2, 2, q), 6))], "read_id long, log_p double")


@query(f"{_LOGQ}, c as (select pos, base, count(*)::double / sum(count(*)) over (partition by pos) as p from b group by 1, 2) select read_id, round(sum(log2(p)), 6) as log_p from b join c using (pos, base) group by 1")
def positional_likelihoods(spark, sf_dir):
    r = reads(spark, sf_dir)
    counts = np.zeros((4, r.agg(F.max(F.length("seq"))).first()[0]))
    for x in C.positional_background(r).collect():  # four rows a position
        counts[BASES.index(x["base"]), x["pos"] - 1] = x["n"]
    q = M.normalize_columns(counts)
    return _per_read(r, lambda i, s: [(i, round(likelihood.positional_log_probability(s, q), 6))], "read_id long, log_p double")


@query(
    f"{_LOGQ}, d as (select a.base as prev, b.base as base, count(*)::double as n from b a join b on b.read_id = a.read_id and b.pos = a.pos + 1 group by 1, 2), m as (select prev, base, n / sum(n) over (partition by prev) as p from d), "
    "k as (select b.read_id, sum(log2(p)) as lp from b a join b on b.read_id = a.read_id and b.pos = a.pos + 1 join m on m.prev = a.base and m.base = b.base where b.pos <= 9 group by 1) "
    "select l.read_id, round(sum(case when pos <= 9 then lq end), 6) as order_zero, round(sum(case when pos = 1 then lq end) + any_value(lp), 6) as order_one from l join k using (read_id) group by 1"
)
def background_probabilities(spark, sf_dir):
    """log2 probabilities of the first nine bases under backgrounds of order zero and one."""
    r = reads(spark, sf_dir)
    q, t = _background(r), np.zeros((4, 4))
    for x in C.digrams(r).collect():  # sixteen rows
        t[BASES.index(x["prev"]), BASES.index(x["base"])] = x["n"]
    t = M.normalize_rows(t)
    return _per_read(r, lambda i, s: [(i, round(math.log2(M.bernoulli_probability(s[:9], q)), 6), round(math.log2(M.markov_probability(s[:9], q, t)), 6))], "read_id long, order_zero double, order_one double")


@query(
    f"{_windows(9)}, ppm as (select * from (values {_PPM}) v(col, base, p)), s as (select read_id, pos, sum(log2(p)) as l from w, unnest(range(0, 9)) t(j) join ppm on col = j and base = substring(kmer, (j + 1)::bigint, 1) group by 1, 2) "
    "select read_id, round(log2(sum(pow(2, l))), 6) as total from s group by 1"
)
def log_sums(spark, sf_dir):
    """log2 of the summed probabilities of all sites of a read."""
    m = np.array(_PROB)
    return _per_read(reads(spark, sf_dir), lambda i, s: [(i, round(M.log_sum(math.log2(M.probability(s[k : k + 9], m)) for k in range(len(s) - 8)), 6))], "read_id long, total double")


@query(f"with {READS}, {_Q}, x as (select " + ", ".join(f"max(case when base = '{b}' then q end) as {b}" for b in BASES) + " from q) select 'GNRYCW' as pattern, round(G * 1 * (A + G) * (C + T) * C * (A + T), 9) as p from x")
def pattern_probability(spark, sf_dir):
    return spark.createDataFrame([("GNRYCW", round(M.pattern_probability("GNRYCW", _background(reads(spark, sf_dir))), 9))], "pattern string, p double")


@query(
    f"with {READS}, {_Q}, x as (select base, q, k, exp(lgamma(13e0) - lgamma(k + 1e0) - lgamma(13e0 - k)) * pow(q, k) * pow(1 - q, 12 - k) as p from q, unnest(range(0, 13)) t(k)) "
    "select base, k::int as k, round(p, 9) as p, round(sum(p) over (partition by base order by k desc), 9) as tail, round(12 * q, 6) as mean from x"
)
def binomial_distributions(spark, sf_dir):
    """How often each base occurs among twelve."""
    rows = []
    for b, q in zip(BASES, _background(reads(spark, sf_dir)), strict=True):
        d = M.binomial(12, q)
        rows += [(b, k, round(float(d[k]), 9), round(M.tail(d, k), 9), round(M.expectation(d), 6)) for k in range(13)]
    return spark.createDataFrame(rows, "base string, k int, p double, tail double, mean double")


@query(
    f"with {READS}, c as (select pos, count_if(substring(seq, pos, 1) = substring('{_SEED6}', pos, 1))::double / count(*) as p from reads, unnest(range(1, 7)) t(pos) group by 1), "
    "x as (select m, exp(sum(ln(case when (m >> (pos - 1)) & 1 = 1 then p else 1 - p end))) as p from c, unnest(range(0, 64)) t(m) group by 1) select bit_count(m)::int as k, round(sum(p), 9) as p from x group by 1"
)
def match_distribution(spark, sf_dir):
    """How many of six positions match a seed by chance, from each position's share."""
    r = reads(spark, sf_dir)
    share = r.agg(*[F.avg((F.substring("seq", j + 1, 1) == c).cast("double")).alias(f"p{j}") for j, c in enumerate(_SEED6)]).first()
    return spark.createDataFrame([(k, round(float(p), 9)) for k, p in enumerate(M.poisson_binomial(list(share)))], "k int, p double")


@query(
    f"with {READS}, x as (select read_id, length(seq) as n, " + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) as {b}" for b in BASES) + " from reads) "
    "select read_id, round(ln(factorial(n::int)) - ln(factorial(A::int)) - ln(factorial(C::int)) - ln(factorial(G::int)) - ln(factorial(T::int)), 6) as ways, round(ln(factorial(n::int)) - ln(factorial(A::int)) - ln(factorial((n - A)::int)), 6) as ways_of_a from x"
)
def arrangements(spark, sf_dir):
    """Logarithms of the numbers of ways to arrange a read's bases."""
    return _per_read(reads(spark, sf_dir), lambda i, s: [(i, round(math.log(M.multinomial(*(s.count(b) for b in BASES))), 6), round(M.ln_binomial(len(s), s.count("A")), 6))], "read_id long, ways double, ways_of_a double")


# order-zero models


def _per_ppm(spark: SparkSession, sf_dir: str, rows_of: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """``rows_of(motif, model, next model)`` of the vectors' models."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    e = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                rows += rows_of(row[0], *(M.normalize_columns(np.abs(np.asarray(x, float)).reshape(-1, 4).T) for x in row[1:]))
            yield pd.DataFrame(rows, columns=names)

    return e.mapInPandas(run, schema)


_NEXT = f"with {_MODELS}, x as (select a.motif, a.col, a.base, a.p, b.p as q from m a join m b on b.motif = a.motif + 1 and a.col = b.col and a.base = b.base)"


@query(f"{_NEXT}, k as (select motif, col, sum(p * log2(p / q)) as pq, sum(q * log2(q / p)) as qp from x where p > 0 and q > 0 group by 1, 2) select motif, col, round(pq, 5) as kl, round(least(pq, qp), 5) as least_kl, round((pq + qp) / 2, 5) as mean_kl from k")
def column_divergences(spark, sf_dir):
    def rows(motif: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        return [(motif, j, round(M.kl(a[:, j], b[:, j]), 5), round(M.symmetric_kl(a[:, j], b[:, j]), 5), round(M.symmetric_kl(a[:, j], b[:, j], True), 5)) for j in range(a.shape[1])]

    return _per_ppm(spark, sf_dir, rows, "motif long, col int, kl double, least_kl double, mean_kl double")


@query(f"{_NEXT}, k as (select motif, col, sum(p * log2(p / 0.25e0)) as ic, -sum(p * log2(p)) as h, sum(p * log2(p / q)) as kl from x where p > 0 and q > 0 group by 1, 2) select motif, round(avg(ic), 6) as average_ic, round(sum(h), 6) as entropy, round(sum(kl), 5) as kl from k group by 1")
def matrix_information(spark, sf_dir):
    return _per_ppm(spark, sf_dir, lambda motif, a, b: [(motif, round(M.average_information_content(a), 6), round(M.matrix_entropy(a), 6), round(M.matrix_kl(a, b), 5))], "motif long, average_ic double, entropy double, kl double")


@query(f"{_NEXT}, k as (select *, sum(p * log2(p / 0.25e0)) over (partition by motif, col) as ic from x where p > 0) select motif, col, base, round(log2(p / 0.25e0) * ic, 6) as score from k")
def weighted_log_odds(spark, sf_dir):
    def rows(motif: int, a: np.ndarray, _: np.ndarray) -> list[tuple]:
        w = M.weighted_log_odds(a)
        return [(motif, j, BASES[i], round(float(w[i, j]), 6)) for i in range(4) for j in range(a.shape[1]) if a[i, j] > 0]

    return _per_ppm(spark, sf_dir, rows, "motif long, col int, base string, score double")


def _table(motif: int, kind: str, m: np.ndarray) -> list[tuple]:
    return [(motif, kind, j, BASES[i], round(float(m[i, j]), 6)) for i in range(4) for j in range(m.shape[1])]


@query(
    f"with {_MODELS}, k as (select max(col) + 1 as k from m), y as (select motif, col, base, p, 0 as side from m union all select motif - 1, col + k - 2, base, p, 1 from m, k), g as (select * from y where motif in (select motif from m where motif + 1 in (select motif from m))), "
    "r as (select motif, col, base, exp(sum(ln(p))) * pow(0.25e0, 2 - count(*)) as p, sum(p) as s from g group by 1, 2, 3), "
    "o as (select motif, 'product' as kind, col, base, p / sum(p) over (partition by motif, col) as p from r union all select motif, 'total', col, base, s from r "
    "union all select motif, 'turned', k - 1 - col, translate(base, 'ACGT', 'TGCA'), p from m, k where motif + 1 in (select motif from m) union all select motif, 'cut', col - 3, base, p from m where col between 3 and 6 and motif + 1 in (select motif from m)) "
    "select motif, kind, col::int as col, base, round(p, 6) as p from o"
)
def matrix_algebra(spark, sf_dir):
    """Product and sum of two models that overlap by two columns, reverse complement and a piece."""

    def rows(motif: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        return [*_table(motif, "product", M.product(a, b, -2)), *_table(motif, "total", M.total(a, b, -2)), *_table(motif, "turned", M.reverse_complement(a)), *_table(motif, "cut", M.cut(a, 3, 4))]

    return _per_ppm(spark, sf_dir, rows, "motif long, kind string, col int, base string, p double")


@query(f"with {_MODELS} select motif, string_agg(base, '' order by col) as best from (select motif, col, arg_max(base, p) as base from m group by 1, 2) group by 1")
def best_strings(spark, sf_dir):
    return report.maximum(pseudo_models(spark, sf_dir)).select("motif", "best")


@query(f"with {_MODELS} select motif, col, base, round(p * sum(case when p > 0 then p * log2(p / 0.25e0) else 0 end) over (partition by motif, col), 6) as height from m")
def logo_heights(spark, sf_dir):
    out = report.logo_heights(pseudo_models(spark, sf_dir))
    return out.withColumn("height", F.round("height", 6))


_NAMES = "list_filter(['HT', 'HH', 'TT', 'TH'], lambda x: bits & map {'HT': 1, 'HH': 2, 'TT': 4, 'TH': 8}[x] > 0)"


@query(f"with {READS}, x as (select read_id % 16 as bits, count(*) as n from reads group by 1) select bits::int as bits, n, array_to_string({_NAMES}, ',') as names from x")
def orientation_classes(spark, sf_dir):
    n = reads(spark, sf_dir).groupBy((F.col("read_id") % 16).cast("int").alias("bits")).agg(F.count("*").alias("n"))
    rows = [(b, ",".join(likelihood.orientations_of(b))) for b in range(16) if likelihood.orientation_class(likelihood.orientations_of(b)) == b]
    return n.join(spark.createDataFrame(rows, "bits int, names string"), "bits")


@query(
    f"{_windows(4, True)}, a as (select kmer, count(*) as n from w group by 1), " + f"w6 as (select read_id, pos, substring(seq, pos, 6) as f from reads, unnest(range(1, length(seq) - 4)) t(pos)), b as (select kmer, count(*) as n from (select f as kmer from w6 union all select {RC.format('f')} from w6 where f <> {RC.format('f')}) group by 1) "
    f"select kmer, n, n * pow(4e0, length(kmer) - 4) / case when kmer = {RC.format('kmer')} then 2 else 1 end as scaled from (select * from a union all select * from b)"
)
def scaled_counts(spark, sf_dir):
    """Counts of k-mers of two lengths on one scale."""
    r = reads(spark, sf_dir)
    n = C.kmer_counts(r, 4, True).unionByName(C.kmer_counts(r, 6, True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(scaled=[huddinge.scaled_count(n, s, 4, alphabet.is_palindromic(s)) for s, n in zip(pdf["kmer"], pdf["n"], strict=True)])

    return n.select("kmer", "n").mapInPandas(run, "kmer string, n long, scaled double")


_ENDS, _INNER = "(values ('A'), ('C'), ('G'), ('T'))", "(values ('A'), ('C'), ('G'), ('T'), ('n'))"
_GAPPED = (
    f"z as (select a.b as s from {_ENDS} a(b) union all select a.b || d.b from {_ENDS} a(b), {_ENDS} d(b) union all select a.b || b.b || d.b from {_ENDS} a(b), {_INNER} b(b), {_ENDS} d(b) "
    f"union all select a.b || b.b || c.b || d.b from {_ENDS} a(b), {_INNER} b(b), {_INNER} c(b), {_ENDS} d(b))"
)


@query(
    f"with {FEW}, x as (select distinct substring(seq, 1, 3) as x from reads), {_GAPPED}, p as (select x, s, length(replace(s, 'n', '')) as k, "
    "list_max(list_transform(range(1 - length(s), 3), lambda a: coalesce(list_sum(list_transform(range(greatest(0, a), least(3, a + length(s))), lambda j: (substring(x, (j + 1)::bigint, 1) = substring(s, (j - a + 1)::bigint, 1))::int)), 0))) as same from x, z) "
    "select x, s, (greatest(3, k) - same)::int as dist from p where greatest(3, k) - same <= 1 and k between 2 and 4"
)
def huddinge_neighbourhoods(spark, sf_dir):
    """All gapped k-mers of up to four positions within distance one of the reads' first three bases."""
    starts = few_reads(spark, sf_dir).select(F.substring("seq", 1, 3).alias("seq")).distinct().withColumn("read_id", F.lit(0))
    return _per_read(starts, lambda _, x: [(x, s, d) for s, d in huddinge.neighbourhood(x, 1, 4).items()], "x string, s string, dist int")


# rounds of the mixture model


@functools.cache
def _cases() -> dict[str, tuple[float, int, list[tuple[int, int]]]]:
    """Of each component its weight, width and (offset, column of the six-column motif) of what it models."""
    return {"m": (0.3, 6, [(j, j) for j in range(6)]), "HT5": (0.1, 17, [(j, j) for j in range(6)] + [(11 + j, j) for j in range(6)]), "HT-2": (0.2, 10, [])}


def _overlap() -> np.ndarray:
    """Columns of two copies of the motif that overlap by two."""
    m = np.array(_PROB)[:, :6]
    out = np.concatenate([m[:, :4], m[:, 4:] * m[:, :2], m[:, 2:]], 1)
    return out / out.sum(0)


_OVERLAP_SEED = "GCCTGCCTGA"


def _dimer_state(q: list[float]) -> tuple[em.Config, em.State]:
    pair = em.Pair(0, 0, ("HT", "HH", "TT"), -2, 5, {("HT", 5): 0.1, ("HT", -2): 0.2}, {("HT", -2): _OVERLAP_SEED})
    return em.Config(), em.State([em.tensor(np.array(_PROB)[:, :6])], [_SEED6], [0.3], np.array(q), [pair])


def _dimer_sql() -> str:
    """CTEs up to z(comp, read_id, strand, pos, kmer, z): posteriors of all sites of three components."""
    cells = []
    for name, (_, _, columns) in _cases().items():
        m = _overlap() if name == "HT-2" else np.array(_PROB)
        for off, j in columns or [(j, j) for j in range(10)]:
            cells += [f"('{name}', {off}, '{b}', {float(m[i, j])!r}::double)" for i, b in enumerate(BASES)]
    sites = " union all ".join(f"select '{name}' as comp, {w}::double as weight, {k} as k, read_id, pos, substring(seq, pos, {k}) as f from reads, unnest(range(1, length(seq) - {k} + 2)) t(pos)" for name, (w, k, _) in _cases().items())
    return (
        f"with {READS}, {_Q}, cells as (select * from (values {', '.join(cells)}) v(comp, off, base, p)), f as ({sites}), w as (select comp, weight, k, read_id, 0 as strand, pos, f as kmer from f union all select comp, weight, k, read_id, 1, pos, {RC.format('f')} from f), "
        "r as (select comp, 0 as strand, off, c.base, p / q as ratio from cells c join q using (base) union all select comp, 1, off, c.base, p / q from cells c join q on q.base = translate(c.base, 'ACGT', 'TGCA')), "
        "u as (select w.comp, read_id, w.strand, pos, kmer, exp(sum(ln(ratio))) * any_value(weight) / (2e0 * (21 - any_value(k))) as u from w join r on r.comp = w.comp and r.strand = w.strand and r.base = substring(kmer, r.off + 1, 1) group by 1, 2, 3, 4, 5), "
        "z as (select *, u / (0.4e0 + sum(u) over (partition by read_id)) as z from u)"
    )


def _dimer_round(spark: SparkSession, sf_dir: str):
    r = reads(spark, sf_dir)
    cfg, state = _dimer_state(_background(r))
    return cfg, state, *em.expectation(r, state, cfg)


@query(f"{_dimer_sql()} select comp, round(sum(z) / (select count(*) from reads), 8) as weight from z group by 1")
def em_dimer_weights(spark, sf_dir):
    """New weights of a motif, of its pairs five apart and of its pairs that overlap by two."""
    _, _, kernel, sums = _dimer_round(spark, sf_dir)
    n = float(kernel.get(sums, "n")[0])
    rows = [("m" if c.key[0] == "m" else f"{c.key[2]}{c.key[3]}", round(float(kernel.get(sums, "lambda", *c.key)[0]) / n, 8)) for c in kernel.comps]
    return spark.createDataFrame(rows, "comp string, weight double")


def _weighted(seed: str, source: str, radius: int = 2) -> str:
    """Gated cells (col, base, z) of weighted sites."""
    return " union all ".join(f"select {j} as col, substring(kmer, {j + 1}, 1) as base, z from {source} where hd < {radius} or (hd = {radius} and substring(kmer, {j + 1}, 1) <> '{c}')" for j, c in enumerate(seed))


@query(
    f"{_dimer_sql()}, s as (select kmer, z from z where comp = 'm' union all select substring(kmer, 1, 6), z from z where comp = 'HT5' union all select substring(kmer, 12, 6), z from z where comp = 'HT5'), h as (select *, {_hd(_SEED6)} as hd from s), "
    f"c as ({_weighted(_SEED6, 'h')}) select col, base, round(sum(z), 4) as n from c group by 1, 2"
)
def em_dimer_motif_counts(spark, sf_dir):
    """What a motif is learned from: its own sites, and half-sites of its pairs that are far enough apart."""
    _, _, kernel, sums = _dimer_round(spark, sf_dir)
    n = (kernel.get(sums, "counts", "m", 0) + kernel.get(sums, "half", "m", 0))[0].sum(0)
    return spark.createDataFrame([(j, b, round(float(n[i, j]), 4)) for i, b in enumerate(BASES) for j in range(6) if n[i, j] > 0], "col int, base string, n double")


@query(f"{_dimer_sql()}, h as (select *, {_hd(_OVERLAP_SEED)} as hd from z where comp = 'HT-2'), c as ({_weighted(_OVERLAP_SEED, 'h')}) select col, base, round(sum(z), 4) as n from c group by 1, 2")
def em_overlap_counts(spark, sf_dir):
    """What a pair that overlaps is learned from."""
    _, _, kernel, sums = _dimer_round(spark, sf_dir)
    n = kernel.get(sums, "counts", "d", 0, "HT", -2)[0].sum(0)
    return spark.createDataFrame([(j, b, round(float(n[i, j]), 4)) for i, b in enumerate(BASES) for j in range(10) if n[i, j] > 0], "col int, base string, n double")


def _shares(source: str, width: int) -> str:
    """(col, base, p) of weighted cells; cells that no site has are 0."""
    every = f"select * from {source} union all select j, b, 0 from unnest(range(0, {width})) t(j), {_ENDS} v(b)"
    return f"(select col, base, sum(z) / sum(sum(z)) over (partition by col) as p from ({every}) group by 1, 2)"


_DEVIATION = (
    f"{_dimer_sql()}, h as (select *, {_hd(_OVERLAP_SEED)} as hd from z where comp = 'HT-2'), c as ({_weighted(_OVERLAP_SEED, 'h')}), o as {_shares('c', 10)}, "
    f"ms as (select kmer, z from z where comp = 'm' union all select substring(kmer, 1, 6), z from z where comp = 'HT5' union all select substring(kmer, 12, 6), z from z where comp = 'HT5'), mh as (select *, {_hd(_SEED6)} as hd from ms), "
    f"mc as ({_weighted(_SEED6, 'mh')}), mm as {_shares('mc', 6)}, "
    "x as (select col, base, p from mm union all select col + 4, base, p from mm), y as (select col, base, case when min(p) = 0 then 0 else exp(sum(ln(nullif(p, 0)))) end as p from x group by 1, 2), e as (select col, base, p / sum(p) over (partition by col) as p from y)"
)


@query(f"{_DEVIATION} select o.col::int as col, o.base, round(o.p - e.p, 6) as delta from o join e using (col, base) where o.col between 3 and 6")
def em_deviation(spark, sf_dir):
    """How a pair that overlaps differs from two independent motifs, in its overlap and one column to both sides, after a round."""
    cfg, state, kernel, sums = _dimer_round(spark, sf_dir)
    new = em.maximization(state, cfg, kernel, sums, _totals(spark, sf_dir))
    dev = new.pairs[0].deviation["HT", -2][0]
    assert not dev[:, :3].any() and not dev[:, 7:].any()
    return spark.createDataFrame([(j, b, round(float(dev[i, j]), 6)) for i, b in enumerate(BASES) for j in range(3, 7)], "col int, base string, delta double")


def _totals(spark: SparkSession, sf_dir: str) -> np.ndarray:
    n = {r["base"]: r["n"] for r in C.background(reads(spark, sf_dir)).collect()}
    return np.array([n[b] for b in BASES], float)


def _one_round(spark: SparkSession, sf_dir: str, cfg: em.Config, t: np.ndarray):
    r = reads(spark, sf_dir)
    state = em.State([t], [SEED], [0.5], np.array(_background(r)))
    return r, state, *em.expectation(r, state, cfg)


_REST = (
    f"{_EM}, s as (select z, case when strand = 0 then kmer else {RC.format('kmer')} end as f from z), g as (select substring(f, j, 1) as base, sum(z) as n from s, unnest(range(1, 10)) t(j) group by 1), "
    "a as (select substring(seq, pos, 1) as base, count(*) as n from reads, unnest(range(1, length(seq) + 1)) t(pos) group by 1)"
)


@query(f"{_REST} select a.base, round((a.n - g.n) / sum(a.n - g.n) over (), 8) as q from a join g using (base)")
def em_background(spark, sf_dir):
    """The background after a round: all bases less those expected in sites."""
    cfg = em.Config(radius=2)
    _, state, kernel, sums = _one_round(spark, sf_dir, cfg, em.tensor(np.array(_PROB)))
    new = em.maximization(state, cfg, kernel, sums, _totals(spark, sf_dir))
    return spark.createDataFrame([(b, round(float(x), 8)) for b, x in zip(BASES, new.background, strict=True)], "base string, q double")


@query(
    f"{_EM}, h as (select *, {_hd(SEED)} as hd from z), c as ({_weighted(SEED, 'h')}), n as (select col, base, sum(z) as n from (select * from c union all select j, b, 0 from unnest(range(0, 9)) t(j), {_ENDS} v(b)) group by 1, 2), m as (select col, base, (n + 1e-6) / (sum(n) over (partition by col) + 4e-6) as p from n) "
    "select col::int as col, base, round(p, 6) as p from m"
)
def em_new_model(spark, sf_dir):
    """The motif after a round, with a pseudo-count for each base."""
    cfg = em.Config(radius=2, prior="addone")
    _, state, kernel, sums = _one_round(spark, sf_dir, cfg, em.tensor(np.array(_PROB)))
    return _cells(spark, em.ppm(em.maximization(state, cfg, kernel, sums, _totals(spark, sf_dir)).models[0]))


@query(
    f"{_EM}, t as (select read_id, log2(0.5e0 + sum(u)) as l, 0.5e0 / (0.5e0 + sum(u)) as bg from u group by 1), g as (select sum(log2(q)) as l from reads, unnest(range(1, length(seq) + 1)) t(pos) join q on base = substring(seq, pos, 1)) "
    "select round((select sum(l) + sum(bg * log2(bg)) from t) + (select l from g) + (select sum(case when z > 0 then z * log2(z) else 0 end) from z), 3) as expected_ll"
)
def em_expected_likelihood(spark, sf_dir):
    _, _, kernel, sums = _one_round(spark, sf_dir, em.Config(radius=2), em.tensor(np.array(_PROB)))
    return spark.createDataFrame([(round(float(kernel.get(sums, "ecll")[0]), 3),)], "expected_ll double")


def _transition() -> np.ndarray:
    """Transitions that prefer to stay at a base, around the columns of the motif."""
    t = np.repeat(np.array(_PROB)[None], 4, 0) * (1 + 0.5 * np.eye(4)[:, :, None])
    t[:, :, 0] = np.array(_PROB)[:, 0]
    return t / t.sum(1, keepdims=True)


_T = ", ".join(f"({j}, {repr(BASES[a]) if j else 'null'}, '{BASES[b]}', {float(_transition()[a, b, j])!r}::double)" for j in range(9) for a in range(4 if j else 1) for b in range(4))
_ADM_EM = (
    f"with {READS}, {_Q}, tt as (select * from (values {_T}) v(col, prev, base, p)), r as (select 0 as strand, col, prev, base, p / q as ratio from tt join q using (base) union all select 1, col, prev, tt.base, p / q from tt join q on q.base = translate(tt.base, 'ACGT', 'TGCA')), "
    f"f as (select read_id, pos, substring(seq, pos, 9) as kmer from reads, unnest(range(1, length(seq) - 7)) t(pos)), w as (select read_id, 0 as strand, pos, kmer from f union all select read_id, 1, pos, {RC.format('kmer')} from f), "
    "u as (select w.read_id, w.strand, pos, kmer, exp(sum(ln(ratio))) * 0.5e0 / 24 as u from w join r on r.strand = w.strand and r.base = substring(kmer, r.col + 1, 1) and (r.col = 0 or r.prev = substring(kmer, r.col, 1)) group by 1, 2, 3, 4), "
    "z as (select *, u / (0.5e0 + sum(u) over (partition by read_id)) as z from u), h as (select *, " + _hd(SEED) + " as hd from z)"
)
_ADM_CELLS = " union all ".join(f"select {j} as col, {f'substring(kmer, {j}, 1)' if j else 'null'} as prev, substring(kmer, {j + 1}, 1) as base, z from h where hd < 2 or (hd = 2 and substring(kmer, {j + 1}, 1) <> '{c}')" for j, c in enumerate(SEED))


@query(f"{_ADM_EM}, c as ({_ADM_CELLS}) select col, prev, base, round(sum(z), 4) as n from c group by 1, 2, 3")
def em_adm_round(spark, sf_dir):
    """Expected transitions of a round with an order-one model."""
    _, _, kernel, sums = _one_round(spark, sf_dir, em.Config(model="adm-unfixed", radius=2), _transition())
    n = kernel.get(sums, "counts", "m", 0)[0]
    rows = [(j, BASES[a] if j else None, BASES[b], round(float(n[a, b, j]), 4)) for j in range(9) for a in range(4 if j else 1) for b in range(4) if n[a, b, j] > 0]
    return spark.createDataFrame(rows, "col int, prev string, base string, n double")


@query(f"{_ADM_EM}, c as ({_ADM_CELLS}), n as (select col, prev, base, sum(z) as n from c group by 1, 2, 3) select col, prev, base, round(n / sum(n) over (partition by col, prev), 6) as p from n")
def em_adm_new_model(spark, sf_dir):
    cfg = em.Config(model="adm-unfixed", radius=2)
    _, state, kernel, sums = _one_round(spark, sf_dir, cfg, _transition())
    return _adm_table(spark, A.Adm(em.maximization(state, cfg, kernel, sums, _totals(spark, sf_dir)).models[0]))


@query(
    f"{_EM}, s as (select z, case when strand = 0 then seq else {RC.format('seq')} end as f, case when strand = 0 then pos - 1 else 12 - pos end as j from z join reads using (read_id)), "
    "x as (select 11 - j + i as col, substring(f, i + 1, 1) as base, sum(z) as n from s, unnest(range(0, 20)) t(i) group by 1, 2) select col::int as col, base, round(n / sum(n) over (partition by col), 6) as p from x"
)
def em_flanks(spark, sf_dir):
    """Bases around the sites of a motif."""
    cfg = em.Config(radius=2)
    r, state, *_ = _one_round(spark, sf_dir, cfg, em.tensor(np.array(_PROB)))
    return _cells(spark, em.flanks(r, state, cfg)["m", 0])


@query(f"{_windows(9, True, False)} select '0' as motif, '{SEED}' as seed, count_if(kmer = '{SEED}')::bigint as observed, round((select sum(length(seq) - 8) * 2 * pow(4e0, -9) from reads), 6) as expected from w")
def seed_occurrences(spark, sf_dir):
    r = reads(spark, sf_dir)
    state = em.State([em.tensor(np.array(_PROB))], [SEED], [0.5], np.full(4, 0.25))
    rows = [(x["motif"], x["seed"], x["observed"], round(x["expected"], 6)) for x in em.seed_report(r, state, em.Config())]
    return spark.createDataFrame(rows, "motif string, seed string, observed long, expected double")


def _seed_case(o: str, d: int) -> str:
    a, b = em.oriented(_SEED6, _SEED6, o, False, alphabet.reverse_complement)
    head, tail, k = a[: 6 + d], b[-d:], 12 + d
    w = f"(select substring(seq, pos, {k}) as f from reads, unnest(range(1, length(seq) - {k} + 2)) t(pos))"
    return (
        f"(select '{o}' as orient, {d} as d, '{head}' || part || '{tail}' as seed from (select substring(kmer, {len(head) + 1}, {-d}) as part, count(*) as n from (select f as kmer from {w} union all select {RC.format('f')} from {w}) "
        f"where substring(kmer, 1, {len(head)}) = '{head}' and substring(kmer, {k - len(tail) + 1}) = '{tail}' group by 1) order by n desc, part desc limit 1)"
    )


_SEED_CASES = [(o, d) for o in ("HT", "HH", "TT") for d in (-3, -2, -1)]


@query(f"with {READS}, found as ({' union all '.join(_seed_case(o, d) for o, d in _SEED_CASES)}) select c.orient, c.d, coalesce(found.seed, c.open) as seed from (values {', '.join(f'({o!r}, {d}, {alphabet.combine_overlap(*em.oriented(_SEED6, _SEED6, o, False, alphabet.reverse_complement), d)!r})' for o, d in _SEED_CASES)}) c(orient, d, open) left join found on found.orient = c.orient and found.d = c.d")
def em_pair_seeds(spark, sf_dir):
    """Seeds of the overlapping cases of a motif with itself, all in one job."""
    pair = em.Pair(0, 0, ("HT", "HH", "TT"), -3, -1, {c: 0.1 for c in _SEED_CASES})
    state = em.State([em.tensor(np.array(_PROB)[:, :6])], [_SEED6], [0.1], np.full(4, 0.25), [pair])
    em.adjust_pair_seeds(reads(spark, sf_dir), state, [pair], em.Config())
    return spark.createDataFrame([(o, d, s) for (o, d), s in pair.seeds.items()], "orient string, d int, seed string")


@query(
    f"{_windows(9, True)}, n as (select kmer, count(*) as n from w group by 1), x as (select col, base, greatest(coalesce(n, 0) - (select sum(length(seq) - 8) * 2 * {4.0**-9!r}::double from reads), 0e0) as n from (values "
    + ", ".join(f"({j}, '{b}', '{SEED[:j] + b + SEED[j + 1 :]}')" for j in range(9) for b in BASES)
    + ") v(col, base, kmer) left join n using (kmer)) select col, base, round(n / sum(n) over (partition by col), 6) as p from x"
)
def em_first_model(spark, sf_dir):
    """What a fit starts from: single substitutions of the seed, less the chance level."""
    r = reads(spark, sf_dir)
    return _cells(spark, em.ppm(em.initial_model(r, SEED, em.Config(), np.array(_background(r)))))


@query(
    f"with {READS}, g as (select least(10, min(length(seq)) - 12)::bigint as dmax from reads) select o as orient, d::int as d, round(0.2e0 / (3 * (dmax + 4)), 9) as weight from g, (values ('HT'), ('HH'), ('TT')) v(o), unnest(range(-3, dmax + 1)) t(d)"
)
def em_dimer_grid(spark, sf_dir):
    """The cases of a motif with itself, and their first weights."""
    state = em.initialize(reads(spark, sf_dir), [_SEED6], em.Config(cob=((0, 0),)))
    return spark.createDataFrame([(o, d, round(x, 9)) for (o, d), x in state.pairs[0].lambdas.items()], "orient string, d int, weight double")


@query(
    f"{_dimer_sql()}, x as (select comp, sum(z) / (select count(*) from reads) as l from z where comp <> 'm' group by 1) "
    "select '0-0' as pair, 'HT' as orient, d, round(coalesce(l, 0), 5) as weight from unnest(range(-2, 6)) t(d) left join x on comp = 'HT' || d"
)
def cob_file(spark, sf_dir):
    """A pair's new weights, written as a table and read back."""
    cfg, state, kernel, sums = _dimer_round(spark, sf_dir)
    new = em.maximization(state, cfg, kernel, sums, _totals(spark, sf_dir))
    path = new_path(spark, "pairs") + ".cob"
    writers.write_bytes(spark, path, writers.cob_text(new.pairs[0]).encode())
    rows = [("0-0", o, d, x) for (o, d), x in readers.read_cob(spark, path).items() if o == "HT"]
    return spark.createDataFrame(rows, "pair string, orient string, d long, weight double")


@query(f"{_dimer_sql()} select 'motif0' as motif, round(sum(z) / (select count(*) from reads), 6) as weight, 'motif0-motif0.HT.-2.dev,motif0-motif0.cob,motif0.pfm,monomer_weights.txt' as files from z where comp = 'm'")
def result_files(spark, sf_dir):
    """The files of a result, and the weights that one of them has."""
    cfg, state, kernel, sums = _dimer_round(spark, sf_dir)
    new = em.maximization(state, cfg, kernel, sums, _totals(spark, sf_dir))
    folder = new_path(spark, "result")
    names = writers.write_result(spark, folder, em.Result(new, [], False), cfg)
    head, weights = spark.read.text(f"{folder}/monomer_weights.txt", wholetext=True).first()["value"].splitlines()
    return spark.createDataFrame([(head, float(weights), ",".join(sorted(names, key=lambda x: (x != "motif0-motif0.HT.-2.dev", not x.endswith(".cob"), not x.endswith(".pfm")))))], "motif string, weight double, files string")
