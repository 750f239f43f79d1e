"""Order-one motif models (adjacent dinucleotides): the first column's distribution and 4 x 4 transitions to each
other column, with the marginals they imply."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from strandmill.functions import matrix as M
from strandmill.functions.alphabet import bases_of, neighbourhood


@dataclass
class Adm:
    """``t[a, b, j]``: probability of base b in column j after a; in column 0, of b for every a."""

    t: np.ndarray
    ip: np.ndarray = field(init=False)

    def __post_init__(self):
        self.t = np.array(self.t, float)
        self.t[:, :, 0] = self.t[0, :, 0]
        ip = [self.t[0, :, 0]]
        for j in range(1, self.k):
            p = ip[-1] @ self.t[:, :, j]
            ip.append(p / p.sum() if p.sum() > 0 else p)
        self.ip = np.stack(ip, 1)

    @property
    def k(self) -> int:
        return self.t.shape[2]

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Adm:
        """Dinucleotide counts (4 x 4 x k, column 0 in row 0) to conditional probabilities; a row of zeros stays zero."""
        s = counts.sum(1, keepdims=True)
        return cls(np.divide(counts, s, out=np.zeros_like(counts, float), where=s > 0))

    @classmethod
    def from_ppm(cls, m: np.ndarray) -> Adm:
        return cls(np.broadcast_to(m[None], (4, *m.shape)))

    def rows(self) -> np.ndarray:
        """16 x k, rows AA AC ... TT; of column 0 only the first four rows."""
        out = self.t.reshape(16, self.k).copy()
        out[4:, 0] = 0
        return out

    def reverse_complement(self) -> Adm:
        out = np.zeros_like(self.t)
        turned = self.ip[::-1, ::-1]
        out[:, :, 0] = turned[:, 0]
        for j in range(1, self.k):
            joint = self.t[:, :, j] * self.ip[:, j - 1][:, None]
            back = np.divide(joint, self.ip[:, j][None, :], out=np.zeros((4, 4)), where=self.ip[:, j][None, :] > 0)
            out[:, :, self.k - j] = back.T[::-1, ::-1]
        return Adm(out)

    def probability(self, s: str, start: int = 0) -> float:
        c = M.codes(s)
        p = self.ip[c[0], start]
        for i in range(1, len(c)):
            p *= self.t[c[i - 1], c[i], start + i]
        return float(p)

    def log_probability(self, s: str, start: int = 0) -> float:
        with np.errstate(divide="ignore"):
            return float(np.log2(self.probability(s, start)))

    def score(self, s: str, bg=M.UNIFORM) -> float:
        return self.log_probability(s) - float(np.log2(np.asarray(bg)[M.codes(s)]).sum())

    def information_content(self, bg=M.UNIFORM) -> np.ndarray:
        out = [M.kl(self.ip[:, 0], bg)]
        out += [sum(self.ip[a, j - 1] * M.kl(self.t[a, :, j], bg) for a in range(4) if self.ip[a, j - 1] > 0) for j in range(1, self.k)]
        return np.array(out)

    def cut(self, start: int, length: int) -> Adm:
        t = self.t[:, :, start : start + length].copy()
        t[:, :, 0] = self.ip[:, start]
        return Adm(t)

    def extend_right(self, n: int, bg=M.UNIFORM) -> Adm:
        more = np.broadcast_to(np.asarray(bg)[None, :, None], (4, 4, n))
        return Adm(np.concatenate([self.t, more], 2))

    def extend_left(self, n: int, bg=M.UNIFORM) -> Adm:
        more = np.broadcast_to(np.asarray(bg)[None, :, None], (4, 4, n))
        return Adm(np.concatenate([more, self.t], 2))

    def join(self, other: Adm) -> Adm:
        return Adm(np.concatenate([self.t, other.t], 2))

    def distance(self, other: Adm) -> float:
        """Largest difference of transitions, each weighted by the marginal of its second base, and of first columns."""
        d = np.abs(self.t[:, :, 0] - other.t[:, :, 0]).max()
        if self.k > 1:
            weigh = lambda m: m.ip[:, None, 1:] * m.t[:, :, 1:]
            d = max(d, np.abs(weigh(self) - weigh(other)).max())
        return float(d)

    def times(self, other: Adm) -> Adm:
        """Product of two models of one length, renormalised over whole strings by a backward pass."""
        p = self.t * other.t
        back = np.ones(4)
        out = np.zeros_like(p)
        for j in range(self.k - 1, -1, -1):
            w = p[:, :, j] * back[None, :]
            s = w.sum(1)
            out[:, :, j] = np.divide(w, s[:, None], out=np.zeros((4, 4)), where=s[:, None] > 0)
            back = s
        return Adm(out)

    def best_string(self, iupac: bool = True) -> str:
        """The consensus of the marginals unless more than a third of it is N; then the likeliest string."""
        s = M.consensus(self.ip)
        if iupac and s.count("N") <= self.k / 3:
            return s
        p, back = self.ip[:, 0], []
        for j in range(1, self.k):
            w = p[:, None] * self.t[:, :, j]
            back.append(w.argmax(0))
            p = w.max(0)
        at = [int(p.argmax())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return "".join("ACGT"[i] for i in reversed(at))

    def sample(self, n: int, rng: np.random.Generator) -> list[str]:
        """n strings of the model."""
        out = np.zeros((n, self.k), int)
        u = rng.random((n, self.k))
        for j in range(self.k):
            p = self.ip[:, 0][None].repeat(n, 0) if j == 0 else self.t[out[:, j - 1], :, j]
            out[:, j] = np.minimum((u[:, j][:, None] >= np.cumsum(p, 1)).sum(1), 3)
        return ["".join("ACGT"[i] for i in r) for r in out]


def product(a: Adm, b: Adm, d: int) -> Adm:
    """Two models d apart as one."""
    width = a.k + b.k + d
    return a.extend_right(width - a.k).times(b.extend_left(width - b.k))


def learn(sequences: list[str], pseudo: float = 0.0) -> Adm:
    """Model of aligned sequences."""
    k = len(sequences[0])
    counts = np.full((4, 4, k), pseudo)
    for s in sequences:
        c = M.codes(s)
        counts[0, c[0], 0] += 1
        for j in range(1, k):
            counts[c[j - 1], c[j], j] += 1
    return Adm.from_counts(counts)


def confidence(count: float) -> float:
    """One less the relative standard deviation of a count."""
    return 0.0 if count <= 1 else 1 - count**-0.5


def correct_seed_bias(grouped: list[np.ndarray], seed: str, radius: int) -> np.ndarray:
    """Transitions from counts gathered within ``radius`` mismatches of a seed and grouped by mismatches to the left.

    Columns are done from the right. A site with r mismatches to the left and a mismatch or not here may have
    only as many to the right as the radius leaves. So the count of a base b here is divided by tau(b, t), the
    probability under the corrected columns to the right that a string after b has at most t mismatches.
    Where the counts behind tau are low, tau is drawn to 1 by their confidence.
    """
    k = len(seed)
    everything = sum(grouped)
    out = np.zeros((4, 4, k))
    for j in range(k - 1, -1, -1):
        fixed = np.zeros((4, 4))
        for r, counts in enumerate(grouped):
            for b in range(4):
                bad = "ACGT"[b] not in bases_of(seed[j])
                left = radius - r - bad
                # with the radius used up, only columns that mismatch were counted
                t = min(left if bad else left - 1, k - j - 1)
                if t < 0:
                    continue
                tau, low = _tau(seed[j + 1 :], t, b, j, everything, out)
                c = confidence(low)
                weight = c * tau + (1 - c)
                if weight > 0:
                    fixed[:, b] += counts[:, b, j] / weight
        s = fixed.sum(1, keepdims=True)
        out[:, :, j] = np.divide(fixed, s, out=np.zeros((4, 4)), where=s > 0)
        if j == 0:
            out[:, :, 0] = out[0, :, 0]
    return out


def _tau(rest: str, t: int, b: int, j: int, counts: np.ndarray, corrected: np.ndarray) -> tuple[float, float]:
    """(probability that what follows b has at most t mismatches with ``rest``, the best string's smallest count)."""
    if t >= len(rest):
        return 1.0, np.inf
    good = np.array([["ACGT"[c] in bases_of(x) for c in range(4)] for x in rest])
    p = np.zeros((4, t + 1))
    low = np.full((4, t + 1), -np.inf)
    p[b, 0], low[b, 0] = 1.0, np.inf
    for i in range(len(rest)):
        q, least = np.zeros_like(p), np.full_like(low, -np.inf)
        step, n = corrected[:, :, j + 1 + i], counts[:, :, j + 1 + i]
        for c in range(4):
            for m in range(t + 1):
                to = m + (not good[i, c])
                if to <= t:
                    q[c, to] += p[:, m] @ step[:, c]
                    least[c, to] = max(least[c, to], np.minimum(low[:, m], n[:, c]).max())
        p, low = q, least
    return float(p.sum()), float(low.max())


def expected_background_counts(seed: str, radius: int, n_sites: float, q=M.UNIFORM) -> np.ndarray:
    """Expected gated dinucleotide counts (4 x 4 x k) of a background, over the strings of the neighbourhood."""
    k = len(seed)
    out = np.zeros((4, 4, k))
    for s in neighbourhood(seed, radius, True):
        p = n_sites * M.bernoulli_probability(s, q)
        c = M.codes(s)
        bad = [s[i] not in bases_of(seed[i]) for i in range(k)]
        for j in range(k):
            if sum(bad) < radius or (sum(bad) == radius and bad[j]):
                out[c[j - 1] if j else 0, c[j], j] += p
    return out


def expected_multinomial_counts(seed: str, radius: int, n_sites: float, q=M.UNIFORM) -> np.ndarray:
    """Expected gated base counts (4 x k) of a background."""
    return expected_background_counts(seed, radius, n_sites, q).sum(0)
