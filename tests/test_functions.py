import itertools
import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import adm as A
from strandmill.functions import alphabet as N
from strandmill.functions import matrix as M
from strandmill.functions import sequence as S
from strandmill.operators import huddinge as H


@pytest.mark.parametrize("k,r", [(k, r) for k in range(1, 6) for r in range(k + 1)])
def test_neighbourhood_size(k, r):
    got = N.neighbourhood("ACGGGAT"[:k], r)
    assert len(got) == len(set(got)) == sum(comb(k, h) * 3**h for h in range(r + 1)) == N.hamming_ball_size(k, r)


def test_iupac_neighbourhood_expands():
    patterns = N.neighbourhood("ARNC", 1)
    assert sorted({s for p in patterns for s in N.sequences_of(p)}) == list(N.neighbourhood("ARNC", 1, True))
    assert all(N.mismatch_positions(s, "ARNC") in ([], [0], [1], [3]) for s in N.neighbourhood("ARNC", 1, True))


def test_patterns():
    assert N.combinations_of("RYN") == 16 and N.sequences_of("AY") == ["AC", "AT"]
    assert N.string_matches("ACR", "NCN") and not N.string_matches("R", "A")
    assert N.complement_set("R") == "CT" and N.class_probability("R") == {"A": 0.5, "C": 0, "G": 0.5, "T": 0}
    assert N.combine_overlap("AAC", "ACC", -2) == "ANNC" and N.combine_overlap("AAC", "ACC", -2, "or") == "AAMC"[:1] + "A" + "C" + "C"
    assert N.combine_overlap("AA", "CC", 2) == "AANNCC"
    assert N.jaccard_hamming("AR", "AA") == 0.5
    assert N.reverse_complement("ACGTN") == "NACGT" and N.reverse_complement("ACGU", rna=True) == "ACGU"
    assert N.contributions("ACG", "AAA", 2) == [1, 2] and N.contributions("ACA", "AAA", 2) == [0, 1, 2]


def test_columns_against_python(spark):
    rng = random.Random(0)
    rows = [("".join(rng.choice("ACGT") for _ in range(12)), "".join(rng.choice("ACGT") for _ in range(12))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    out = df.select(
        "a", "b", S.reverse_complement(a).alias("rc"), S.hamming_distance(a, b).alias("hd"), S.hamming_of_codes(S.number_of(a), S.number_of(b)).alias("bits"), S.number_of(a).alias("n"), S.sequence_of(S.number_of(a), 12).alias("back"),
        S.pattern_distance(a, "NNRYACGTWSKM").alias("pd"), S.mismatches(a, "NNRYACGTWSKM").alias("mm"), S.mismatch_mask(a, "NNRYACGTWSKM").alias("mask"), S.min_hamming_distance(a, F.substring(b, 1, 4)).alias("low"),
        S.matches_pattern(a, "NNNNNNRNNNNN").alias("m"), S.jaccard_hamming(a, b, 12).alias("j"), S.number_of(a, 5).alias("n5"), S.trailing_ones(S.number_of(a)).alias("t1"), S.leading_ones(S.number_of(a), 24).alias("l1"), S.bits_in_range(S.number_of(a), 2, 9).alias("br"),
    ).collect()
    for r in out:
        hd = sum(x != y for x, y in zip(r.a, r.b))
        n = int("".join(str("ACGT".index(c)) for c in r.a), 4)
        mm = N.mismatch_positions(r.a, "NNRYACGTWSKM")
        assert (r.rc, r.hd, r.bits, r.n, r.back) == (N.reverse_complement(r.a), hd, hd, n, r.a)
        assert (r.pd, r.mm, r.mask) == (len(mm), mm, sum(1 << (11 - i) for i in mm))
        assert r.low == min(sum(x != y for x, y in zip(r.a[i : i + 4], r.b[:4])) for i in range(9))
        assert r.m == (r.a[6] in "AG") and r.j == hd and r.n5 == int("".join(str("ACGTN".index(c)) for c in r.a), 5)
        bits = f"{n:024b}"
        assert (r.t1, r.l1, r.br) == (len(bits) - len(bits.rstrip("1")), len(bits) - len(bits.lstrip("1")), bin(n >> 2 & 127).count("1"))


def test_gap_columns(spark):
    df = spark.createDataFrame([("ANNC",), ("ANCNG",), ("NAC",), ("ACG",), ("",)], "s string")
    s = F.col("s")
    got = [tuple(r) for r in df.select(S.gap_count(s), S.at_most_one_gap(s), S.unmasked_pieces(s, 1), S.is_iupac(s), S.is_nucleotide(s)).collect()]
    assert got == [(2, True, ["A", "C"], True, False), (2, False, ["A", "C", "G"], True, False), (1, None, ["AC"], True, False), (0, True, ["ACG"], True, True), (0, False, [], False, False)]


def test_probabilities():
    assert M.entropy([0.25] * 4) == 2 and M.entropy([1, 0, 0, 0]) == 0
    for bad in ([0.0], [2, -1]):
        with pytest.raises(ValueError):
            M.entropy(bad)
    values = [0.5, 0.2, 0.05, 0.005, 0.001]
    for n in range(1, 6):
        assert np.isclose(2 ** M.log_sum(np.log2(values[:n])), sum(values[:n]))
    assert np.isclose(M.log_sum([np.log2(1 / 200)] * 100), -1)
    assert np.isclose(M.poisson_binomial([0.1, 0.5, 0.9]).sum(), 1) and np.isclose(M.expectation(M.binomial(7, 0.3)), 2.1) and np.isclose(M.tail(M.binomial(3, 0.5), 2), 0.5)
    assert M.multinomial(2, 1, 1) == 12 and np.isclose(np.exp(M.ln_binomial(9, 4)), 126)
    p = np.array([[0.7, 0.4, 0.25, 0.34], [0.1, 0.4, 0.25, 0.33], [0.1, 0.1, 0.25, 0.325], [0.1, 0.1, 0.25, 0.005]])
    assert M.consensus(p) == "AMNV"
    assert np.allclose(M.product(p, np.full((4, 2), 0.25), -2), p)
    assert M.symmetric_kl(p[:, 0], p[:, 1]) == min(M.kl(p[:, 0], p[:, 1]), M.kl(p[:, 1], p[:, 0]))
    assert M.bernoulli_probability("A" * 40) > 0 and M.pattern_probability("RN") == 0.5


def random_adm(k, seed=0):
    rng = np.random.default_rng(seed)
    return A.Adm.from_counts(rng.integers(1, 1000, (4, 4, k)).astype(float))


def test_adm_identities():
    m = random_adm(6)
    turned = m.reverse_complement()
    assert np.allclose(turned.reverse_complement().t, m.t)
    total = 0
    for s in map("".join, itertools.product("ACGT", repeat=6)):
        p = m.probability(s)
        total += p
        assert np.isclose(turned.probability(N.reverse_complement(s)), p)
    assert np.isclose(total, 1)
    assert np.allclose(m.extend_right(2).cut(0, 6).t, m.t) and np.allclose(m.extend_left(3).cut(3, 6).t, m.t)
    uniform = A.Adm(np.full((4, 4, 6), 0.25))
    assert np.allclose(m.times(uniform).t, m.t) and m.distance(m) == 0
    joined = m.cut(0, 3).join(A.Adm(m.t[:, :, 3:]))
    assert joined.k == 6
    p = np.abs(np.random.default_rng(1).normal(size=(4, 5)))
    p = M.normalize_columns(p)
    assert np.allclose(A.Adm.from_ppm(p).ip, p) and np.allclose(A.Adm.from_ppm(p).information_content(), M.information_content(p))
    assert np.allclose(A.product(A.Adm.from_ppm(p), A.Adm.from_ppm(p), -2).ip, M.product(p, p, -2))
    best = m.best_string(iupac=False)
    assert m.probability(best) == max(m.probability("".join(s)) for s in itertools.product("ACGT", repeat=6))


def test_adm_learns_what_it_samples():
    m = random_adm(5, 3)
    got = A.learn(m.sample(20000, np.random.default_rng(2)))
    assert np.abs(got.t - m.t).max() < 0.06


def test_seed_bias_of_complete_counts():
    """With the radius beyond the length nothing is missing, and the correction changes nothing."""
    m = random_adm(4, 5)
    seqs = m.sample(4000, np.random.default_rng(4))
    seed, radius = "ACGT", 5
    grouped = [np.zeros((4, 4, 4)) for _ in range(radius)]
    for s in seqs:
        c, r = M.codes(s), 0
        for j in range(4):
            grouped[r][c[j - 1] if j else 0, c[j], j] += 1
            r += s[j] != seed[j]
    assert np.allclose(A.Adm(A.correct_seed_bias(grouped, seed, radius)).t, A.learn(seqs).t)


def test_seed_bias_is_corrected():
    """Counts gathered near the seed only, from a known model, give the model back where counts are high."""
    p = np.full((4, 6), 0.1)
    p[0] = 0.7
    m = A.Adm.from_ppm(p)
    seqs, seed, radius = m.sample(60000, np.random.default_rng(9)), "AAAAAA", 3
    grouped = [np.zeros((4, 4, 6)) for _ in range(radius)]
    plain = np.zeros((4, 4, 6))
    for s in seqs:
        bad = [c != "A" for c in s]
        c, r = M.codes(s), 0
        for j in range(6):
            if sum(bad) < radius or (sum(bad) == radius and bad[j]):
                grouped[r][c[j - 1] if j else 0, c[j], j] += 1
                plain[c[j - 1] if j else 0, c[j], j] += 1
            r = min(r + bad[j], radius - 1)
    fixed = A.Adm(A.correct_seed_bias(grouped, seed, radius))
    assert np.abs(fixed.ip - p).max() < 0.05 and np.abs(fixed.ip - p).max() <= np.abs(A.Adm.from_counts(plain).ip - p).max() + 0.01


def brute_huddinge(x, y):
    best = 0
    for a in range(-len(y), len(x) + 1):
        best = max(best, sum(1 for j, c in enumerate(y) if 0 <= j + a < len(x) and x[j + a] == c != "n"))
    return max(H.defined(x), H.defined(y)) - best


@pytest.mark.parametrize(
    "letters,low,high,counts",
    [("ACGT", 8, 8, H.COUNTS), ("ACGTnN", 0, 8, H.COUNTS), ("ACGTnN", 0, 8, 50), ("nN", 0, 3, 50), ("Aé€\U0001f600N\0", 0, 5, 50), ("A", 250, 260, H.COUNTS), ("A", 0, 0, H.COUNTS)],
)
def test_block_alignments_are_those_of_each_pair(monkeypatch, letters, low, high, counts):
    monkeypatch.setattr(H, "COUNTS", counts)
    rng = random.Random(3)
    x, y = (["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)] for n in (12, 9))
    wanted = np.array([[(i + j) % 3 > 0 for j in range(len(y))] for i in range(len(x))])
    for some in (None, wanted):
        got = []
        for rows, shifts, ends, columns, distances in H.block_alignments(x, y, some):
            for i, a, start, end in zip(rows, shifts, [0, *ends[:-1]], ends, strict=True):
                got += [(i, j, d, a) for j, d in zip(columns[start:end], distances[start:end], strict=True)]
        want = [(i, j, d, a) for i, u in enumerate(x) for j, v in enumerate(y) if some is None or some[i, j] for d, offsets in [H.alignments(u, v)] for a in offsets]
        assert sorted(got) == sorted(want)


def test_huddinge():
    rng = random.Random(3)
    words = ["".join(rng.choice("ACGTn") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    for x, y in itertools.product(words, words):
        assert H.distance(x, y) == brute_huddinge(x, y)
    codes = H._codes(np.array(words, object))
    assert (H.block_distances(codes, codes) == [[H.distance(x, y) for y in words] for x in words]).all()
    near = H.neighbourhood("ACGT", 1, 5)
    for n in range(1, 5):
        for s in map("".join, itertools.product("ACGTn", repeat=n)):
            inside = s[0] != "n" != s[-1] and H.distance("ACGT", s) <= 1 and 3 <= H.defined(s) <= 5
            assert (s in near) == inside
    assert all(len(p) == H.distance("ACG", "AnG") + 1 for p in H.paths("ACG", "AnG"))
    assert H.align_all(["ACG", "CGT"]) == ["ACGn", "nCGT"]
    assert H.widest_path({"AC": 5, "AG": 9, "AT": 4, "CG": 1}, "AC", "AT")[0] == 4
    assert H.scaled_count(10, "ACn", 3) == 2.5
