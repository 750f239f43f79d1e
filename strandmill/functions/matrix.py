"""Order-zero motif models (4 x k matrices, rows A C G T) and the algebra around them, in numpy."""

from __future__ import annotations

import math

import numpy as np

from strandmill.functions.alphabet import FROM_MASK

UNIFORM = np.full(4, 0.25)


def normalize_columns(m: np.ndarray) -> np.ndarray:
    """Columns to sum 1; a column of zeros stays zero."""
    s = m.sum(0)
    return np.divide(m, s, out=np.zeros_like(m, float), where=s > 0)


def normalize_rows(m: np.ndarray) -> np.ndarray:
    return normalize_columns(m.T).T


def normalize_all(m: np.ndarray) -> np.ndarray:
    return m / m.sum() if m.sum() else m


def is_column_stochastic(m: np.ndarray, eps: float = 1e-6) -> bool:
    return bool((m >= -eps).all() and np.allclose(m.sum(0), 1, atol=eps))


def is_row_stochastic(m: np.ndarray, eps: float = 1e-6) -> bool:
    return is_column_stochastic(m.T, eps)


def reverse_complement(m: np.ndarray) -> np.ndarray:
    """Rows A C G T reversed are T G C A: a turn by 180 degrees."""
    return m[::-1, ::-1]


def cut(m: np.ndarray, start: int, length: int) -> np.ndarray:
    return m[:, start : start + length]


def inject(into: np.ndarray, m: np.ndarray, row: int, column: int) -> np.ndarray:
    out = into.copy()
    out[row : row + m.shape[0], column : column + m.shape[1]] = m
    return out


def insert_column(m: np.ndarray, at: int, column: np.ndarray) -> np.ndarray:
    return np.insert(m, at, column, axis=1)


def log2(m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log2(m)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a - b).max())


def product(a: np.ndarray, b: np.ndarray, d: int, normalize: bool = True) -> np.ndarray:
    """Two models d apart as one: columns of the overlap (d < 0) are multiplied, those of the gap are uniform."""
    width = a.shape[1] + b.shape[1] + d
    left, right = np.full((4, width), 0.25 if normalize else 1.0), np.full((4, width), 0.25 if normalize else 1.0)
    left[:, : a.shape[1]], right[:, width - b.shape[1] :] = a, b
    return normalize_columns(left * right) if normalize else left * right


def total(a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    """Sum of two matrices d apart."""
    out = np.zeros((4, a.shape[1] + b.shape[1] + d))
    out[:, : a.shape[1]] += a
    out[:, out.shape[1] - b.shape[1] :] += b
    return out


def entropy(p) -> float:
    p = np.asarray(p, float)
    if (p < 0).any() or not math.isclose(p.sum(), 1, abs_tol=1e-6):
        raise ValueError("not a distribution")
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def kl(p, q) -> float:
    p, q = np.asarray(p, float), np.asarray(q, float)
    some = p > 0
    with np.errstate(divide="ignore"):
        return float((p[some] * np.log2(p[some] / q[some])).sum())


def symmetric_kl(p, q, average: bool = False) -> float:
    a, b = kl(p, q), kl(q, p)
    return (a + b) / 2 if average else min(a, b)


def information_content(m: np.ndarray, bg=UNIFORM) -> np.ndarray:
    """Of each column against a background."""
    return np.array([kl(c, bg) for c in np.atleast_2d(m.T)])


def average_information_content(m: np.ndarray, bg=UNIFORM) -> float:
    return float(information_content(m, bg).mean())


def matrix_entropy(m: np.ndarray) -> float:
    return float(sum(entropy(c) for c in m.T))


def matrix_kl(a: np.ndarray, b: np.ndarray) -> float:
    return float(sum(kl(p, q) for p, q in zip(a.T, b.T, strict=True)))


def log_odds(m: np.ndarray, bg=UNIFORM) -> np.ndarray:
    return log2(m / np.asarray(bg, float)[:, None])


def weighted_log_odds(m: np.ndarray, bg=UNIFORM) -> np.ndarray:
    return log_odds(m, bg) * information_content(m, bg)[None, :]


def affinity(m: np.ndarray) -> np.ndarray:
    return m / m.max(0)


def codes(s: str) -> np.ndarray:
    return np.array(["ACGT".index(c) for c in s.upper().replace("U", "T")], int)


def score(s: str, scores: np.ndarray) -> float:
    return float(scores[codes(s), np.arange(len(s))].sum())


def probability(s: str, m: np.ndarray) -> float:
    return float(m[codes(s), np.arange(len(s))].prod())


def max_score(scores: np.ndarray) -> float:
    return float(scores.max(0).sum())


def max_probability(m: np.ndarray) -> float:
    return float(m.max(0).prod())


def best_string(m: np.ndarray) -> str:
    return "".join("ACGT"[i] for i in m.argmax(0))


def consensus(m: np.ndarray) -> str:
    """IUPAC string: one base above 1/2 that is at least twice the next; two above 3/4 together; three if the fourth is
    below 1/100; else N. Of equal bases the first in A C G T comes first."""
    out = []
    for column in m.T:
        order = sorted(range(4), key=lambda i: (-column[i], i))
        p = column[order]
        n = 1 if p[0] > 0.5 and p[0] >= 2 * p[1] else 2 if p[0] + p[1] > 0.75 else 3 if p[3] < 0.01 else 4
        out.append(FROM_MASK[sum(8 >> i for i in order[:n])])
    return "".join(out)


def from_seed(seed: str, p: float = 0.5) -> np.ndarray:
    """Initial model of a seed: p for its base, the rest shared."""
    m = np.full((4, len(seed)), (1 - p) / 3)
    m[codes(seed), np.arange(len(seed))] = p
    return m


def aic(log_likelihood: float, n_reads: int, k: int) -> float:
    return 2 * (2 * n_reads + 4 + 4 * k) - 2 * log_likelihood


def log_sum(x) -> float:
    """log2 of the sum of powers of two, shifted by the largest."""
    x = np.asarray(list(x), float)
    top = x.max(initial=-np.inf)
    return float(top + np.log2(np.exp2(x - top).sum())) if np.isfinite(top) else float(top)


def binomial(n: int, p: float) -> np.ndarray:
    return poisson_binomial([p] * n)


def poisson_binomial(ps) -> np.ndarray:
    """Distribution of the number of successes."""
    out = np.ones(1)
    for p in ps:
        out = np.convolve(out, [1 - p, p])
    return out


def tail(distribution: np.ndarray, least: int) -> float:
    return float(distribution[least:].sum())


def expectation(distribution: np.ndarray) -> float:
    return float(distribution @ np.arange(len(distribution)))


def multinomial(*counts: int) -> int:
    out, n = 1, 0
    for c in counts:
        n += c
        out *= math.comb(n, c)
    return out


def ln_binomial(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def bernoulli_probability(s: str, q=UNIFORM) -> float:
    return float(np.asarray(q)[codes(s)].prod())


def markov_probability(s: str, initial, transition: np.ndarray) -> float:
    c = codes(s)
    return float(np.asarray(initial)[c[0]] * np.prod(transition[c[:-1], c[1:]]))


def pattern_probability(pattern: str, q=UNIFORM) -> float:
    from strandmill.functions.alphabet import bases_of

    out = 1.0
    for c in pattern:
        out *= sum(q["ACGT".index(b)] for b in bases_of(c))
    return float(out)
